"""Streams with state by key and timers in event time: filings that wait for their facts, and two live sources matched with each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epochlens.operators.identity import greedy_pairs
from epochlens.session import materialised, work_path
from epochlens.streaming import ingest

#: Spark's state API for keyed processors needs this store, which also keeps state on disk instead of in memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Waiting(StatefulProcessor):
    """Filings of one bucket of keys: each goes on with its facts once it has them, without after the wait is over, or is dropped then if it has no security.

    State: of each key the filing, its first facts and whether it went on; a key is forgotten keep_s after its wait, until when it is known if it is polled again. A bucket's keys are read and
    written together, and it has one timer, for what is due next: Python is called once a bucket and batch, not once a key.
    """

    def __init__(self, wait_s: int, keep_s: int):
        self.wait, self.keep = wait_s * 1_000_000, keep_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "key long, known long, security_id long, facts long, gone boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        filings: dict[int, tuple[int, int | None]] = {}
        facts: dict[int, int] = {}
        for part in rows:
            securities = part["security_id"].astype(object).where(part["security_id"].notna(), None)
            for k, at, is_facts, security in zip(part["key"].tolist(), part["us"].tolist(), (part["kind"] == "facts").tolist(), securities.tolist(), strict=True):
                if is_facts:
                    facts[k] = min(at, facts.get(k, at))
                elif k not in filings or at < filings[k][0]:
                    filings[k] = (at, None if security is None else int(security))
        held, out = self._held(), []
        for k in filings.keys() | facts.keys():
            now = held.setdefault(k, [None, None, None, False])
            if k in facts and (now[2] is None or facts[k] < now[2]):
                now[2] = facts[k]
            if now[0] is None and k in filings:
                now[0], now[1] = filings[k]
            if now[0] is not None and not now[3] and now[2] is not None and now[2] <= now[0] + self.wait:
                out.append(self._on(k, now, told=True))
        self._hold(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        reached = expiredTimerInfo.getExpiryTimeInMs()
        reached = max(reached, timerValues.getCurrentWatermarkInMs())
        for k, now in list(held.items()):
            if now[0] is not None and not now[3] and self._due(now) <= reached:
                out.append(self._on(k, now, told=False))
            if (now[0] is None or now[3]) and self._due(now) <= reached:
                del held[k]
        self._hold(held)
        yield self._frame(out)

    def _on(self, key: int, now: list, told: bool) -> tuple:
        now[3] = True
        return key, max(now[2], now[0]) if told else now[0] + self.wait, "dropped" if now[1] is None else "with_facts" if told else "without_facts"

    def _due(self, now: list) -> int:
        """When a timer does something about a key: its wait is over, or it is forgotten. Milliseconds are rounded up: no timer goes off before the wait is over."""
        at = now[2] if now[0] is None else now[0]
        return -(-(at + self.wait + (self.keep if now[0] is None or now[3] else 0)) // 1000)

    def _held(self) -> dict[int, list]:
        return {r[0]: list(r[1:]) for r in self.held.get()} if self.held.exists() else {}

    def _hold(self, held: dict[int, list]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.held.put([(k, *now) for k, now in held.items()])
            self.handle.registerTimer(min(self._due(now) for now in held.values()))
        else:
            self.held.clear()

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "handed_us", "outcome"]).astype({"key": "int64", "handed_us": "int64"})

    def close(self) -> None:
        pass


def hand_over(filings: DataFrame, facts: DataFrame, *, key: str, known: str, security: str, facts_at: str, wait_s: int = 900, keep_s: int = 7 * 86_400, lateness: str = "10 seconds", buckets: int = 1024) -> DataFrame:
    """key, handed_us, outcome of streamed filings and facts, as ``ingest.handed_over`` says of tables.

    Rows come in the order of their instants but for the lateness, in whatever batches. A filing that is without a security goes on as dropped. What still waits when the stream ends is in the checkpoint,
    in so many buckets of keys, a number that stays with the checkpoint. A bucket's keys of keep_s are held in a task at once.
    """
    f = filings.select(F.col(key).cast("long").alias("key"), F.col(known).cast("timestamp").alias("at"), F.lit("filing").alias("kind"), F.col(security).cast("long").alias("security_id"))
    g = facts.where(F.col(facts_at).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(facts_at).cast("timestamp").alias("at"), F.lit("facts").alias("kind"), F.lit(None).cast("long").alias("security_id"))
    both = f.unionByName(g).withWatermark("at", lateness).withColumn("us", F.unix_micros("at")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return both.groupBy("bucket").transformWithStateInPandas(Waiting(wait_s, keep_s), "key long, handed_us long, outcome string", "Append", "EventTime").withColumnRenamed("key", key)


def candidates(left: DataFrame, right: DataFrame, *, by: list[str], ts: str, key: str, max_gap_s: int, lateness: str = "10 seconds") -> DataFrame:
    """Pairs of two live sources within a time gap: a stream-stream join by interval, whose state Spark drops once the watermark is past the gap."""
    lhs = left.select(*(F.col(c).alias(f"l_{c}") for c in (*by, key, ts))).withWatermark(f"l_{ts}", lateness)
    rhs = right.select(*(F.col(c).alias(f"r_{c}") for c in (*by, key, ts))).withWatermark(f"r_{ts}", lateness)
    gap = F.make_dt_interval(secs=F.lit(max_gap_s))
    on: Column = (F.col(f"r_{ts}") >= F.col(f"l_{ts}") - gap) & (F.col(f"r_{ts}") <= F.col(f"l_{ts}") + gap)
    for c in by:
        on &= F.col(f"l_{c}") == F.col(f"r_{c}")
    return lhs.join(rhs, on)


def run_with_state(stream: DataFrame, start: Callable[[DataFrame], None]) -> None:
    """Runs a stream whose processors have keyed state: its state store is set for the start alone."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STATE_STORE)
    try:
        start(stream)
    finally:
        conf.set(name, before) if before else conf.unset(name)


def match_live(left: DataFrame, right: DataFrame, target: str, checkpoint: str, *, by: list[str], ts: str, key: str, max_gap_s: int, lateness: str = "10 seconds", parts: int = 48) -> None:
    """Two live sources matched one to one, the closest pairs first, as a greedy pass over all pairs would.

    New candidate pairs are kept by day. Of a batch's candidates the whole connected group is looked up (pairs that share a row with one of it, and so on; only the days that they can lie on are read) and matched again, all
    others stay as they were. target-nodes holds a row for each row that was decided on, with its partner or null, by batch; the last batch counts (``partners``).

    The join's state is cut into so many parts, a number that stays with the checkpoint: each part has four stores, which every batch opens and writes however little they hold.
    """
    spark = left.sparkSession
    pairs_of = candidates(left, right, by=by, ts=ts, key=key, max_gap_s=max_gap_s, lateness=lateness).select(f"l_{key}", f"r_{key}", f"l_{ts}", f"r_{ts}")
    schema = pairs_of.schema
    gap = F.make_dt_interval(secs=F.lit(max_gap_s))

    def each(batch: DataFrame, number: int) -> None:
        # a batch's own session plans without adaptive execution, each step in as many parts as the stream has state: the batch is written down, and all that follows is planned by the session of the streams
        path = work_path(spark, "candidates")
        batch.write.parquet(path)
        group = frontier = materialised(spark.read.schema(schema).parquet(path).dropDuplicates([f"l_{key}", f"r_{key}"]), "frontier")
        if not frontier.limit(1).count():  # such as a batch that only moves the watermark
            return
        ingest._write(frontier, f"{target}-pairs", number, f"l_{ts}")
        while frontier.limit(1).count():
            # a pair that shares the right row has its left one within the gap of it
            span = frontier.select(F.explode(F.sequence(F.to_date(F.col(f"r_{ts}") - gap), F.to_date(F.col(f"r_{ts}") + gap))).alias("day")).distinct()
            days = sorted(r[0] for r in span.select(F.col("day").cast("string")).collect())  # as many as a batch's pairs span
            stored = ingest.read_target(spark, f"{target}-pairs", schema, days).where(F.col(ingest.BATCH) <= number).drop(ingest.BATCH)
            touched = stored.join(frontier.select(f"l_{key}").distinct(), f"l_{key}", "left_semi").unionByName(stored.join(frontier.select(f"r_{key}").distinct(), f"r_{key}", "left_semi"))
            frontier = materialised(touched.dropDuplicates([f"l_{key}", f"r_{key}"]).join(group.select(f"l_{key}", f"r_{key}"), [f"l_{key}", f"r_{key}"], "left_anti").select(*schema.names), "frontier")
            group = group.unionByName(frontier)
        scored = group.withColumn("gap_s", F.abs(F.unix_micros(F.col(f"l_{ts}").cast("timestamp")) - F.unix_micros(F.col(f"r_{ts}").cast("timestamp"))) / 1e6)
        matched = greedy_pairs(scored, f"l_{key}", f"r_{key}", [F.col("gap_s"), F.col(f"l_{key}"), F.col(f"r_{key}")]).select(f"l_{key}", f"r_{key}")
        sides = lambda rows, partner: [rows.select(F.col(f"{a}_{key}").alias(key), (F.col(f"{b}_{key}") if partner else F.lit(None).cast("long")).cast("long").alias("partner")) for a, b in ("lr", "rl")]
        decided = sides(matched, True)
        asked = sides(group, False)
        nodes = decided[0].unionByName(decided[1]).unionByName(asked[0]).unionByName(asked[1]).groupBy(key).agg(F.max("partner").alias("partner"))
        nodes.write.mode("overwrite").parquet(f"{target}-nodes/{ingest.BATCH}={number}")

    ingest.run(pairs_of, checkpoint, each, parts)


def partners(spark: SparkSession, target: str, key: str) -> DataFrame:
    """key, partner: of each row that ever had a candidate what its last matching says."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("partner", T.LongType()), T.StructField(ingest.BATCH, T.LongType())])
    nodes = spark.read.schema(schema).parquet(f"{target}-nodes") if ingest._exists(spark, f"{target}-nodes") else spark.createDataFrame([], schema)
    return nodes.groupBy(key).agg(F.max_by("partner", ingest.BATCH).alias("partner"))
