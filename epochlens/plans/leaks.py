"""Queries: reads that must not see the future, held against tables of which the future was changed, and one that does see it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epochlens.operators import leaks, pit, windows
from epochlens.operators.asof import asof_join
from epochlens.plans.registry import micros, query, table

_CUTS = ["2024-01-07 11:00:00", "2024-01-15 00:00:00", "2024-01-24 16:30:00"]
_KNOWN = {"events": ("ts", ["event_id", "user_id"])}


def _events(spark, d):
    return {"events": table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")}


def _asof(direction):
    def run(t):
        e = t["events"]
        left, right = e.where("event_id % 3 = 0").select("event_id", "user_id", "ts"), e.where("event_id % 3 > 0").select("user_id", F.col("ts").alias("rts"), "value")
        return asof_join(left, right, by=["user_id"], left_ts="ts", right_ts="rts", take=["value"], direction=direction)

    return run


def _as_known(t):
    """Each user's row before each event, by the clock of that event."""
    e = t["events"]
    return e.select("event_id", "ts", F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


#: Reads that look back only.
_HONEST = {
    "asof_backward": _asof("backward"),
    "rolling_median": lambda t: windows.rolling_median_rows(t["events"], ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", "ts", "median"),
    "known_between": lambda t: pit.known_between(t["events"], "ts", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).select("event_id", "ts", "value", "event_type"),
    "running_high": lambda t: windows.running_max_before(t["events"], ["user_id"], ["ts", "event_id"], "value").select("event_id", "ts", "high_so_far"),
    "row_before": _as_known,
}


def _found(spark, d, runs):
    out = None
    for name, run in runs.items():
        found = leaks.find_leaks(run, _events(spark, d), _KNOWN, _CUTS, decided="ts").select(F.lit(name).alias("read"), micros("cut").alias("cut_us"), "rows")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"SELECT read, epoch_us(cut) AS cut_us, 0::BIGINT AS rows FROM (SELECT unnest({list(_HONEST)}) AS read), (SELECT unnest([{', '.join(f'TIMESTAMP {chr(39)}{c}{chr(39)}' for c in _CUTS)}]) AS cut)")
def no_leaks(spark, d):
    """Five reads that look back give the same up to three moments, whatever comes after."""
    return _found(spark, d, _HONEST)


@query(f"""
WITH r AS (SELECT user_id, ts, value FROM events WHERE event_id % 3 > 0), l AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 = 0), c AS (SELECT unnest([{', '.join(f'TIMESTAMP {chr(39)}{x}{chr(39)}' for x in _CUTS)}]) AS cut),
j AS (SELECT l.event_id, l.ts, r.ts AS rts FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts)
SELECT 'asof_forward' AS read, epoch_us(cut) AS cut_us, count(*) FILTER (ts <= cut AND rts > cut) AS rows FROM j, c GROUP BY cut""")
def planted_leak(spark, d):
    """A read that takes the next row: all rows before a moment of which that row comes after it are found."""
    return _found(spark, d, {"asof_forward": _asof("forward")})
