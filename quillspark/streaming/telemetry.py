"""Request telemetry: rate limits, latency histograms and service levels, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Upper bounds of latency buckets; the last bucket is open.
BUCKETS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)


def caller(key: Column, fallback: Column, path: Column) -> Column:
    """Who is counted: the start of the credential's hash, or the host, and the path."""
    return F.concat_ws(":", F.coalesce(F.substring(F.sha2(key, 256), 1, 24), fallback), path)


def tumbling(events: DataFrame, limit: int, seconds: int = 60, ts: str = "ts", key: str = "key") -> DataFrame:
    """(window_start, key, calls, rejected): calls of each window and how many were over the limit. The same for a stream with a watermark."""
    counted = events.groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count("*").alias("calls"))
    return counted.select(F.col("window.start").alias("window_start"), key, "calls", F.greatest(F.lit(0), F.col("calls") - limit).alias("rejected"))


def stream_tumbling(events: DataFrame, limit: int, seconds: int = 60, late: str = "1 minute", ts: str = "ts", key: str = "key") -> DataFrame:
    return tumbling(events.withWatermark(ts, late), limit, seconds, ts, key)


def sliding(events: DataFrame, seconds: int = 60, ts: str = "ts", key: str = "key") -> DataFrame:
    """``events`` with in_window: the calls of the same key in the ``seconds`` up to and with this one (rejected ones included)."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w))


def admit(times: list[float], new: list[float], limit: int, seconds: int) -> tuple[list[float], list[bool]]:
    """The sliding log and the verdicts on new calls: rejected calls are not recorded."""
    held, verdicts = list(times), []
    for t in new:
        held = [h for h in held if h > t - seconds]
        verdicts.append(len(held) < limit)
        if verdicts[-1]:
            held.append(t)
    return held, verdicts


def sliding_exact(events: DataFrame, limit: int, seconds: int = 60, ts: str = "ts", key: str = "key", id_col: str = "event_id") -> DataFrame:
    """(id, key, admitted) by a sliding log that forgets rejected calls: a fold in time order over each busy spell of a key.

    A pause of a window's length empties the log, so the calls on either side of it are independent and are folded apart.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", id_col])
        held, out, at = [], [], 0
        for t in rows["t"].tolist():
            while at < len(held) and held[at] <= t - seconds:
                at += 1
            out.append(len(held) - at < limit)
            if out[-1]:
                held.append(t)
        return rows[[id_col, key]].assign(admitted=out)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    timed = events.select(id_col, key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    by = Window.partitionBy(key).orderBy("t", id_col)
    spells = timed.withColumn("spell", F.coalesce((F.col("t") - F.lag("t").over(by) >= seconds).cast("int"), F.lit(1))).withColumn("spell", F.sum("spell").over(by))
    return spells.groupBy(key, "spell").applyInPandas(fold, f"{id_col} {kinds[id_col]}, {key} {kinds[key]}, admitted boolean")


def stream_sliding(events: DataFrame, limit: int, seconds: int = 60, ts: str = "ts", key: str = "key", late: str = "1 minute") -> DataFrame:
    """(key, admitted, rejected) of each batch of a stream; the log of a key is its state and expires with the watermark."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = sorted(t for b in batches for t in b["t"])
        held, verdicts = admit(list(state.get[0]) if state.exists else [], new, limit, seconds)
        state.update((held,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((max(new) + seconds) * 1000)))
        yield pd.DataFrame([(k[0], sum(verdicts), len(verdicts) - sum(verdicts))], columns=[key, "admitted", "rejected"])

    kind = events.schema[key].dataType.simpleString()
    timed = events.withWatermark(ts, late).select(key, ts, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, admitted long, rejected long", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def slo(events: DataFrame, last: int = 5000, ts: str = "ts", latency: str = "value", failed: Column | None = None, tie: str = "event_id") -> DataFrame:
    """(requests, p95, p99, error_rate) of the last requests; a percentile is the value at place round(p * (n - 1)), halves to even."""
    failed = F.col("failed") if failed is None else failed
    recent = events.select(F.col(latency).alias("v"), failed.cast("double").alias("f"), F.col(ts).alias("t"), F.col(tie).alias("i")).orderBy(F.desc("t"), F.desc("i")).limit(last)
    got = recent.agg(F.count("*").alias("requests"), F.sort_array(F.collect_list("v")).alias("vs"), F.avg("f").alias("error_rate"))
    at = lambda p: F.get("vs", F.bround(F.lit(p) * (F.size("vs") - 1)).cast("int"))
    return got.select("requests", at(0.95).alias("p95"), at(0.99).alias("p99"), "error_rate")


def histogram(events: DataFrame, by: str, latency: str = "value", buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(by, le, requests): cumulative counts for each upper bound, the open one as infinity."""
    counts = [F.struct(F.lit(b).alias("le"), F.count_if(F.col(latency) <= b).alias("requests")) for b in buckets] + [F.struct(F.lit(float("inf")).alias("le"), F.count("*").alias("requests"))]
    return events.groupBy(by).agg(F.array(*counts).alias("h")).select(by, F.inline("h"))
