"""Streaming forms of the time-bucketed operators; each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.history import BREAK_AFTER, BREAK_SECONDS


def bucketed(stream: DataFrame, key: str, ts: str, tokens: Column, every: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Requests and tokens of each key in tumbling buckets; the watermark stands for the counters' lifetime."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), key).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))


def sliding(stream: DataFrame, key: str, ts: str, length: str, step: str, late: str) -> DataFrame:
    """An extension: counts in sliding windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """An extension: counts in sessions that a gap ends."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def once(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Idempotent replay: a key counts once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def breaker(stream: DataFrame, key: str, ts: str, ok: str) -> DataFrame:
    """key, ts, failures, open after each call: every failure renews a counter of one minute, a success deletes it."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            rows = []
            for at, fine in sorted(zip(pdf[ts], pdf[ok]), key=lambda r: r[0]):
                now = round(at.timestamp())
                count = 0 if now - last > BREAK_SECONDS else count
                count, last = (0, now) if fine else (count + 1, now)
                rows.append((k[0], at, count, count >= BREAK_AFTER))
            yield pd.DataFrame(rows, columns=[key, "ts", "failures", "open"])
        state.update((count, last))

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, ts timestamp, failures long, open boolean", "n long, last double", "append", GroupStateTimeout.NoTimeout)
