"""Streaming forms of limits, breakers, caches and incremental runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_windows(events: DataFrame, ts: str = "ts", by: str = "service", seconds: int = 60, slide: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """Requests by key in windows; on a stream late ones are waited for."""
    window = F.window(ts, f"{seconds} seconds", f"{slide} seconds") if slide else F.window(ts, f"{seconds} seconds")
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def recent_requests(events: DataFrame, by: str, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """For each request how many of its key the last seconds hold, itself included (batch)."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("recent", F.count("*").over(w))


def breaker(events: DataFrame, by: str, failed: Column, ts: str = "ts", order: str = "event_id", limit: int = 4) -> DataFrame:
    """For each event the length of the run of failures that it ends, and whether the breaker is open from it on."""
    w = Window.partitionBy(by).orderBy(ts, order)
    runs = events.withColumn("failed", failed).withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    streak = F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(Window.partitionBy(by, "run").orderBy(ts, order))
    return runs.withColumn("streak", streak).withColumn("open", F.col("streak") >= limit).drop("run")


def latest_fresh(rows: DataFrame, key: str, now: Column, ttl: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Each key's newest row where it is not older than the time to live."""
    new = rows.filter(F.col(ts) > now - F.expr(f"interval {ttl}"))
    return new.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(ts, order)).alias("x")).select("x.*")


def activity_sessions(events: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by key, apart where nothing happens for the gap."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def unseen(stream: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier run has marked, each key once."""
    return stream.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def failure_state(stream: DataFrame, by: str, limit: int = 4, open_seconds: int = 90) -> DataFrame:
    """The breaker as a keyed state of a stream of (by, ts, failed): rows (by, ts, failures, open_until)."""
    schema = f"{by} string, ts timestamp, failures int, open_until timestamp"

    def step(key, batches, state):
        import pandas as pd

        failures, until = state.get if state.exists else (0, None)
        out = []
        for batch in batches:
            for ts, failed in batch.sort_values("ts")[["ts", "failed"]].itertuples(index=False):
                failures = failures + 1 if failed else 0
                until = (ts + pd.Timedelta(seconds=open_seconds)).to_pydatetime() if failures >= limit else until if failed else None
                out.append((key[0], ts, failures, until))
        state.update((failures, until))
        yield pd.DataFrame(out, columns=[by, "ts", "failures", "open_until"])

    return stream.groupBy(by).applyInPandasWithState(step, schema, "failures int, open_until timestamp", "append", "NoTimeout")


def write_incremental(stream: DataFrame, path: str, checkpoint: str, form: str = "json"):
    """Append results as they come; a restarted run goes on where it was and repeats nothing."""
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
