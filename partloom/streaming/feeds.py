"""Stateful operators over event feeds: rate limits, lockouts, job states, correction windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

ALLOWED = "key string, ts double, event_id long, allowed boolean"


def allow(times: list[float], window: float, limit: int, held: list[float] = ()) -> tuple[list[bool], list[float]]:
    """Sliding window: an attempt passes if fewer than ``limit`` passed within ``window`` before it; refused ones do not count."""
    kept, out = deque(held), []
    for t in times:
        while kept and kept[0] <= t - window:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, list(kept)


def rate_limit(events: DataFrame, window: float = 60.0, limit: int = 30) -> DataFrame:
    """Batch form over (key, ts in seconds, event_id)."""
    ship(events.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        return pdf.assign(allowed=allow(pdf.ts.tolist(), window, limit)[0])[["key", "ts", "event_id", "allowed"]]

    return events.select("key", "ts", "event_id").groupBy("key").applyInPandas(one, ALLOWED)


def rate_limit_stream(events: DataFrame, window: float = 60.0, limit: int = 30) -> DataFrame:
    """The same over a stream: what passed within the window is the state of a key."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(batches).sort_values(["ts", "event_id"])
        passed, held = allow(pdf.ts.tolist(), window, limit, held)
        state.update((held,))
        yield pdf.assign(allowed=passed)[["key", "ts", "event_id", "allowed"]]

    return events.select("key", "ts", "event_id").groupBy("key").applyInPandasWithState(step, ALLOWED, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def lockout(events: DataFrame, max_failures: int = 5, lock_seconds: float = 300.0) -> DataFrame:
    """(key, ts, event_id, locked): logins (key, ts, event_id, success) that meet a lock; it starts with the last failure allowed."""
    ship(events.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        failures, until, out = 0, 0.0, []
        for t, ok in zip(pdf.ts, pdf.success, strict=True):
            if until and t >= until:
                failures, until = 0, 0.0
            out.append(bool(until))
            if until:
                continue
            failures = 0 if ok else failures + 1
            if failures >= max_failures:
                until = t + lock_seconds
        return pdf.assign(locked=out)[["key", "ts", "event_id", "locked"]]

    return events.select("key", "ts", "event_id", "success").groupBy("key").applyInPandas(one, "key string, ts double, event_id long, locked boolean")


def job_states(events: DataFrame) -> DataFrame:
    """Latest status of each job from (job_id, ts, status); batch or stream in complete mode."""
    return events.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def correction_feed(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log of corrections as a stream; malformed lines are dropped."""
    schema = "timestamp timestamp, customer string, target_field string, row_index int, raw_value string, corrected_value string"
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def corrections_per_window(feed: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return feed.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "customer").count()
