"""Identities: which listings are one security, under which names, and which filings are one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.operators.graph import components
from epochlens.session import materialised


def shared_value_edges(observations: DataFrame, node: str, value: str) -> DataFrame:
    """Edges that tie all nodes of one value together: each with the value's smallest one, not all pairs."""
    seen = observations.select(node, value).where(F.col(value).isNotNull()).distinct()
    least = seen.groupBy(value).agg(F.min(node).alias("a"))
    return seen.join(least, value).select("a", F.col(node).alias("b")).where("a <> b").distinct()


def securities(observations: DataFrame, node: str, value: str) -> DataFrame:
    """(node, root): nodes that share a value, directly or through others, have one root."""
    found = components(shared_value_edges(observations, node, value))
    alone = observations.select(F.col(node).alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("root")))


def stable_ids(roots: DataFrame, previous: DataFrame) -> DataFrame:
    """root, security_id, merged (ids that gave way): the smallest previous id of a component's nodes is kept; new components get ids after the last one, by root.

    previous: node, security_id.
    """
    held = roots.join(previous, "node", "left").groupBy("root").agg(F.min("security_id").alias("_kept"), F.sort_array(F.collect_set("security_id")).alias("_all"))
    last = previous.agg(F.coalesce(F.max("security_id"), F.lit(0)).alias("_last"))
    new = held.where("_kept is null").select("root", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("root")).alias("_n"))  # new securities only: few between builds
    ids = held.join(new, "root", "left").crossJoin(F.broadcast(last))  # one row
    return ids.select("root", F.coalesce("_kept", F.col("_last") + F.col("_n")).alias("security_id"), F.array_except("_all", F.array("_kept")).alias("merged"))


def newest_claim(claims: DataFrame, keys: list[str], target: str, known_at: str) -> DataFrame:
    """Of several targets that claim one key the one with the newest evidence, then the largest."""
    return claims.groupBy(*keys).agg(F.max(F.struct(known_at, target)).alias("_r")).select(*keys, F.col(f"_r.{target}").alias(target))


def display(members: DataFrame, by: list[str], value: str, at: str, is_main: str) -> DataFrame:
    """Newest value that isn't null; the main source wins ties."""
    return members.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, F.struct(at, F.col(is_main).cast("int"), value)).alias(value))


def rename_windows(changes: DataFrame, old: str = "old", new: str = "new", effective: str = "effective", rounds: int = 64) -> DataFrame:
    """name, holder (the last name of its chain), valid_from, valid_to: under which name a holder traded when. A name that is used again starts when
    its earlier holder left it.

    Each renaming leads to the next one from its new name at or after its day; chains are followed by pointer doubling.
    """
    c = changes.where(F.col(old) != F.col(new)).select(F.col(old).alias("old"), F.col(new).alias("new"), F.col(effective).alias("at")).distinct()
    c = c.withColumn("id", F.concat_ws("|", "old", "at"))
    later = c.select(F.col("old").alias("new"), F.col("at").alias("_at"), F.col("id").alias("_next"), F.col("new").alias("_final"))
    joined = c.join(later, "new", "left").where("_at is null or _at > at or (_at = at and _next <> id)")
    step = c.join(joined.where("_at is not null").groupBy("id").agg(F.min_by(F.struct("_next", "_final"), "_at").alias("_n")), "id", "left")
    now = materialised(step.select("id", F.col("_n._next").alias("up"), F.coalesce("_n._final", "new").alias("holder")), "renames")
    for _ in range(rounds):
        if not now.where("up is not null").limit(1).count():
            break
        ups = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("holder").alias("_holder"))
        now = materialised(now.join(ups, "up", "left").select("id", F.col("_up").alias("up"), F.coalesce("_holder", "holder").alias("holder")), "renames")
    held = c.join(now.select("id", "holder"), "id")
    names = held.select(F.col("old").alias("name"), "holder", F.lit(None).cast(c.schema["at"].dataType).alias("valid_from"), F.col("at").alias("valid_to")).unionByName(held.select(F.col("new").alias("name"), "holder", F.col("at").alias("valid_from"), F.lit(None).cast(c.schema["at"].dataType).alias("valid_to")))
    merged = names.groupBy("name", "holder").agg(F.max("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
    earlier = F.max("valid_to").over(W.partitionBy("name").orderBy(F.col("valid_to").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1))
    return merged.select("name", "holder", F.coalesce("valid_from", earlier).alias("valid_from"), "valid_to")


def band_pairs(left: DataFrame, right: DataFrame, *, by: list[str], ts: str, max_gap_s: float, score: Column | None = None) -> DataFrame:
    """Pairs of one key within a time gap, left columns l_*, right ones r_*. Time is cut into buckets of the gap's length, so that a busy key
    only meets itself within three buckets.
    """
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    lhs = left.select(*(F.col(c).alias(c if c in by else f"l_{c}") for c in left.columns), F.explode(F.array(*((F.floor(secs(ts) / max_gap_s) + k).cast("long") for k in (-1, 0, 1)))).alias("_bucket"))
    rhs = right.select(*(F.col(c).alias(c if c in by else f"r_{c}") for c in right.columns), F.floor(secs(ts) / max_gap_s).cast("long").alias("_bucket"))
    pairs = lhs.join(rhs, [*by, "_bucket"]).drop("_bucket").withColumn("gap_s", F.abs(F.unix_micros(F.col(f"l_{ts}").cast("timestamp")) - F.unix_micros(F.col(f"r_{ts}").cast("timestamp"))) / 1e6)
    pairs = pairs.where(F.col("gap_s") <= max_gap_s)
    return pairs.withColumn("score", score) if score is not None else pairs


def greedy_pairs(pairs: DataFrame, left: str, right: str, order: list[Column], rounds: int = 200) -> DataFrame:
    """One-to-one matching as a greedy pass over all pairs in order would make it: in each round the pairs that are first for both their sides are
    taken, and what they leave goes on. order must put no two pairs level.
    """
    left_over = materialised(pairs, "pairs")
    taken = left_over.limit(0)
    for _ in range(rounds):
        if not left_over.limit(1).count():
            return taken
        best = lambda side: F.row_number().over(W.partitionBy(side).orderBy(*order)) == 1
        gone = lambda side: F.max("_taken").over(W.partitionBy(side))
        # one step, written down once: what is taken, and what shares no side with it
        marked = left_over.withColumn("_l", best(left)).withColumn("_r", best(right)).withColumn("_taken", F.col("_l") & F.col("_r")).withColumn("_r", gone(right)).withColumn("_l", gone(left))
        step = materialised(marked.where("_taken or not (_l or _r)").drop("_l", "_r"), "pairs")
        taken = taken.unionByName(step.where("_taken").drop("_taken"))
        left_over = step.where("not _taken").drop("_taken")
    raise RuntimeError("matching did not settle")


def event_group_ids(rows: DataFrame, matched: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """The smaller id of its pair, or a row's own."""
    pairs = matched.select(F.explode(F.array(left, right)).alias(key), F.least(left, right).alias("_g"))
    return rows.join(pairs, key, "left").withColumn("event_group_id", F.coalesce("_g", key)).drop("_g")


def group_range(rows: DataFrame, *, key: str, by: list[str], ts: str, source: str, sources: tuple[str, str], start: Column, end: Column, halo_s: int = 21_600) -> DataFrame:
    """key and event_group_id of the rows in [start, end): filings of one security on two sources within the halo are matched one to one, the closest first.

    Rows up to a halo outside the range take part in the matching, so that pairs over its edges are found whichever range is asked for.
    """
    around = rows.where((F.col(ts) >= start - F.make_dt_interval(secs=F.lit(halo_s))) & (F.col(ts) < end + F.make_dt_interval(secs=F.lit(halo_s))))
    pairs = band_pairs(around.where(F.col(source) == sources[0]).select(key, *by, ts), around.where(F.col(source) == sources[1]).select(key, *by, ts), by=by, ts=ts, max_gap_s=float(halo_s))
    matched = greedy_pairs(pairs, f"l_{key}", f"r_{key}", [F.col("gap_s"), F.col(f"l_{key}"), F.col(f"r_{key}")])
    inside = rows.where((F.col(ts) >= start) & (F.col(ts) < end)).select(key)
    return event_group_ids(inside, matched, key, f"l_{key}", f"r_{key}")


def redirects(merges: DataFrame, rounds: int = 64) -> DataFrame:
    """old, security_id: where every id that ever gave way leads now, through all later merges (doubling: log2 of the longest way rounds; a way that comes round raises).

    merges: build, security_id, merged (ids that gave way to it in that build), as stable_ids gives them build by build. An id gives way once; of several records of it the last build's counts.
    """
    steps = merges.select("build", "security_id", F.explode("merged").alias("old")).where(F.col("old").isNotNull() & (F.col("old") != F.col("security_id")))
    now = materialised(steps.groupBy("old").agg(F.max_by("security_id", "build").alias("security_id")), "redirects")
    for _ in range(rounds):
        onward = now.select(F.col("old").alias("security_id"), F.col("security_id").alias("_on"))
        moved = materialised(now.join(onward, "security_id", "left").select("old", F.coalesce("_on", "security_id").alias("security_id"), F.col("_on").isNotNull().alias("_moved")), "redirects")
        now = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            return now
    raise RuntimeError("merged ids lead round in a circle")


def resolve_ids(rows: DataFrame, merged: DataFrame, splits: DataFrame, id_col: str) -> DataFrame:
    """rows of which an id made under an older build is the one that it leads to now, with id_status: same, redirected, or split (several securities came of it: the id is null, nothing is guessed).

    merged: redirects' rows; splits: security_id of ids whose members are in several securities now (split_ids).
    """
    m = merged.select(F.col("old").alias("_old"), F.col("security_id").alias("_new"))
    s = splits.select(F.col("security_id").alias("_split")).distinct()
    joined = rows.join(m, F.col(id_col) == F.col("_old"), "left")
    now = F.coalesce("_new", F.col(id_col))
    joined = joined.withColumn("_now", now).join(s, F.col("_now") == F.col("_split"), "left")
    status = F.when(F.col("_split").isNotNull(), "split").when(F.col("_new").isNotNull(), "redirected").when(F.col(id_col).isNotNull(), "same")
    return joined.withColumn(id_col, F.when(F.col("_split").isNull(), F.col("_now"))).withColumn("id_status", status).select(*rows.columns, "id_status")


def split_ids(roots: DataFrame, previous: DataFrame) -> DataFrame:
    """security_id, securities: ids of the build before whose members (node) lie in several components now."""
    return previous.join(roots, "node").groupBy("security_id").agg(F.countDistinct("root").alias("securities")).where("securities > 1")
