"""Repair of a conversation's structure at least cost.

Each conversation is a lattice of (turn index, grammar state). Edits are its edges: keep a row, give it another role, delete it, insert an
empty turn; they are made up as the search meets them, the lattice itself is never built. Dijkstra's search takes nodes by (cost, audit),
audit being the edits' initials so far, and stops at the first accepting end node. Two paths to one node of equal cost are never one the
other's prefix (the longer one would hold further insertions, which cost), so that the smaller key stays smaller however both go on.

A conversation is a stream of rows sorted by turn. Rows are taken in segments of at most ``SEGMENT``; of each state at a segment's end the best
way is kept, with a running hash of what it gave, so that memory holds one segment however long the conversation is. A conversation of one segment
(nearly all) is one search with its early stop. Since the answer holds one hash over all of a conversation's rows, one task reads them in order; what can be
done apart from that (damage, what was seen earlier) is done by Spark before, dealt by text.

Defined results: a null role or text counts as one space, which is blank and no role that may be kept; null turns come first and equal turns are in
order of role and text; null conv_ids are one conversation; repeated rows are duplicates; a conversation of which no row is left has zeros, an empty
audit and the empty text's hash; roles count by their initial, and a kept row keeps its role as it is; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.llm.common import table

#: Costs of the edits, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing given yet, after a system turn, after an assistant's turn, after a user's turn. A conversation may end in START and ANSWERED.
START, OPENED, ANSWERED, ASKED = range(4)
#: The role that a state waits for, and the state after it.
WAITS = {START: ("user", ASKED), OPENED: ("user", ASKED), ANSWERED: ("user", ASKED), ASKED: ("assistant", ANSWERED)}
#: Rows of a segment.
SEGMENT = 512

#: A row: role, text, whether it has to go, whether it is truncated.
Row = tuple[str, str, bool, bool]
#: (cost, audit) of a way.
Way = tuple[int, str]


def edges(state: int, row: Row | None) -> Iterator[tuple[str, int, int, bool]]:
    """Edits that a state allows: initial, cost, next state, whether the row is used up."""
    _, after = WAITS[state]
    yield "I", INSERT, after, False
    if row is None:
        return
    role, _, must_go, truncated = row
    yield "D", DELETE, state, True
    if must_go:
        return
    more = TRUNCATED if truncated else 0
    yield "R", REROLE + more, after, True
    if role[:1] == WAITS[state][0][0]:
        yield "K", more, after, True
    elif role[:1] == "s" and state == START:
        yield "K", more, OPENED, True


def search(rows: list[Row], entry: int, ends: set[int], stop: bool) -> dict[int, Way]:
    """Best ways through all rows from a state to each of the ends; with stop, the first one that is met alone."""
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    done: set[tuple[int, int]] = set()
    found: dict[int, Way] = {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ends:
            found[state] = cost, audit
            if stop or len(found) == len(ends):
                return found
        for initial, more, after, used in edges(state, rows[at] if at < len(rows) else None):
            if (at + used, after) not in done:
                heapq.heappush(heap, (cost + more, audit + initial, at + used, after))
    return found


def replay(rows: list[Row], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that a way gives."""
    at = 0
    for initial in audit:
        role, after = WAITS[state]
        if initial == "I":
            yield role, ""
            state = after
            continue
        own, text, _, _ = rows[at]
        at += 1
        if initial == "R":
            yield role, text
            state = after
        elif initial == "K":
            yield own, text
            state = OPENED if state == START and own[:1] == "s" else after


class Repair:
    """One conversation, fed row by row."""

    def __init__(self, texts: bool):
        self.held: list[Row] = []
        self.texts = texts
        #: state: cost, audit, hash of what was given, whether something was, its turns if texts are asked for
        self.ways: dict[int, tuple[int, str, object, bool, list[str]]] = {START: (0, "", hashlib.sha256(), False, [])}

    def add(self, row: Row) -> None:
        self.held.append(row)
        if len(self.held) > SEGMENT:
            last = self.held.pop()
            self._advance({START, OPENED, ANSWERED, ASKED}, False)
            self.held = [last]

    def _advance(self, ends: set[int], stop: bool) -> None:
        best: dict[int, tuple[int, str, int, str]] = {}
        stop = stop and len(self.ways) == 1
        for entry, (cost, audit, *_) in self.ways.items():
            for end, (more, further) in search(self.held, entry, ends, stop).items():
                key = (cost + more, audit + further, entry, further)
                if end not in best or key < best[end]:
                    best[end] = key
        ways = {}
        for end, (cost, audit, entry, further) in best.items():
            _, _, digest, any_yet, turns = self.ways[entry]
            digest, turns = digest.copy(), list(turns)
            for role, text in replay(self.held, further, entry):
                line = f"{role}:{text}"
                digest.update(("\n" + line if any_yet else line).encode("utf-8"))
                any_yet = True
                if self.texts:
                    turns.append(line)
            ways[end] = (cost, audit, digest, any_yet, turns)
        self.ways, self.held = ways, []

    def end(self) -> tuple[int, str, str, str | None]:
        """cost, audit, hash and, if asked for, text of the repaired conversation."""
        self._advance({START, ANSWERED}, True)
        cost, audit, digest, _, turns = min((self.ways[s] for s in (START, ANSWERED) if s in self.ways), key=lambda x: x[:2])
        return cost, audit, digest.hexdigest(), "\n".join(turns) if self.texts else None


def _repaired(batches, texts: bool, schema: pa.Schema):
    """Rows sorted by conversation and turn, to one row a conversation."""
    out: dict[str, list] = {n: [] for n in schema.names}
    now, one = object(), None

    def finish():
        if one is None:
            return
        cost, audit, digest, text = one["repair"].end()
        gaps = one["high"] - one["low"] + 1 - one["turns"] if one["turns"] else 0
        row = (now, gaps, one["blank"], one["duplicate"], one["truncated"], one["illegal"], cost, audit, digest, text)
        for n, x in zip(out, row, strict=False):
            out[n].append(x)

    def flush():
        made = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        for held in out.values():
            held.clear()
        return made

    for batch in batches:
        columns = [batch.column(n) for n in ("conv_id", "turn", "role", "text", "fault", "gone")]
        for i in range(batch.num_rows):
            conv, turn, role, text, fault, gone = (c[i].as_py() for c in columns)
            if one is None or conv != now:
                finish()
                now, one = conv, {"repair": Repair(texts), "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "before": None}
            if gone:
                continue
            if turn is not None and turn != one["high"]:  # sorted: equal turns follow each other
                one["low"] = turn if one["low"] is None else one["low"]
                one["high"], one["turns"] = turn, one["turns"] + 1
            if fault is not None:
                one[fault] += 1
            if one["before"] is not None and one["before"] + role[:1] not in ("su", "ua", "au"):
                one["illegal"] += 1
            one["before"] = role[:1]
            one["repair"].add((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        if len(out["cost"]) >= 4096:
            yield flush()
    finish()
    yield flush()


def with_faults(rows: DataFrame) -> DataFrame:
    """Each row's first fault, null for none. What was seen earlier is found by (conversation, role, text), not by conversation."""
    seen = W.partitionBy("conv_id", F.xxhash64("role", "text"), "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    visible = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    fault = F.when(visible == "", "blank").when((F.row_number().over(seen) > 1) & ~F.col("gone"), "duplicate").when(~F.substring(visible, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault)


def repair(rows: DataFrame, *, texts: bool = False) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, with texts, ``repaired``.

    rows: conv_id, turn, role, text and, where rows are only there to name their conversation, gone (true).
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), gone.alias("gone"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string" + (", repaired string" if texts else "")
    arrow = pa.schema([("conv_id", pa.int64() if kind != "string" else pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()), *([("repaired", pa.string())] if texts else [])])
    dealt = with_faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").eqNullSafe("duplicate"))
    return dealt.mapInArrow(lambda batches: _repaired(batches, texts, arrow), schema.replace(f"conv_id {kind}", "conv_id " + ("string" if kind == "string" else "long")))


def damaged(rows: DataFrame) -> DataFrame:
    """Damage by crc32 of ``conv_id:turn``, modulo 20: 0 drops the row (it stays as gone), 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes it a user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text")).withColumn("fate", fate)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: crc32 by its polynomial's table; ways as (cost, audit, text), the state's best being the least; SQL steps from row to row.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), fates AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS fate
  FROM raw, tab
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, range(2) r WHERE fate <> 0 AND (r.range = 0 OR fate = 3)
), faults AS (
  SELECT *, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS visible,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again
  FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS place FROM faults
), marked AS (
  SELECT *, visible = '' AS blank, visible <> '' AND again AS duplicate,
    visible <> '' AND NOT again AND right(visible, 1) NOT IN ('.', '!', '?') AS truncated,
    coalesce((lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS rows
  FROM marked GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0 AS place, rows, {'c': 0, 'a': '', 'r': ''} AS w0, {'c': 1000000000, 'a': '', 'r': ''} AS w1, {'c': 1000000000, 'a': '', 'r': ''} AS w2, {'c': 1000000000, 'a': '', 'r': ''} AS w3 FROM counts
  UNION ALL
  SELECT conv_id, place, rows,
    {'c': w0.c + 4, 'a': w0.a || 'D', 'r': w0.r},
    least({'c': w1.c + 4, 'a': w1.a || 'D', 'r': w1.r}, CASE WHEN NOT must AND initial = 's' THEN {'c': w0.c + more, 'a': w0.a || 'K', 'r': w0.r || line} END),
    least({'c': i2.c + 4, 'a': i2.a || 'D', 'r': i2.r}, CASE WHEN NOT must THEN {'c': i3.c + 3 + more, 'a': i3.a || 'R', 'r': i3.r || chr(10) || 'assistant:' || text} END, CASE WHEN NOT must AND initial = 'a' THEN {'c': i3.c + more, 'a': i3.a || 'K', 'r': i3.r || line} END),
    least({'c': i3.c + 4, 'a': i3.a || 'D', 'r': i3.r}, CASE WHEN NOT must THEN {'c': any_u.c + 3 + more, 'a': any_u.a || 'R', 'r': any_u.r || chr(10) || 'user:' || text} END, CASE WHEN NOT must AND initial = 'u' THEN {'c': any_u.c + more, 'a': any_u.a || 'K', 'r': any_u.r || line} END)
  FROM (
    SELECT *, least(w0, w1, i2) AS any_u FROM (
      SELECT *, least(w2, {'c': i3.c + 3, 'a': i3.a || 'I', 'r': i3.r || chr(10) || 'assistant:'}) AS i2 FROM (
        SELECT w.conv_id, m.place, rows, w0, w1, w2, m.text, m.initial, m.blank OR m.duplicate AS must, CASE WHEN m.truncated THEN 3 ELSE 0 END AS more, chr(10) || m.role || ':' || m.text AS line,
          least(w3, {'c': least(w0, w1, w2).c + 3, 'a': least(w0, w1, w2).a || 'I', 'r': least(w0, w1, w2).r || chr(10) || 'user:'}) AS i3
        FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.place = w.place + 1
      )
    )
  )
), ended AS (
  SELECT conv_id, least(w0, w2, {'c': i3.c + 3, 'a': i3.a || 'I', 'r': i3.r || chr(10) || 'assistant:'}) AS best FROM (
    SELECT *, least(w3, {'c': least(w0, w1, w2).c + 3, 'a': least(w0, w1, w2).a || 'I', 'r': least(w0, w1, w2).r || chr(10) || 'user:'}) AS i3 FROM walk WHERE place = rows
  )
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
