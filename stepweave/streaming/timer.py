"""Streaming forms: the active-time fold over ticks of sessions, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def work_time(ticks: DataFrame, cap: float, idle: str | None = None) -> DataFrame:
    """Per tick of a stream (session string, key string, at double): active seconds on the key so far, gaps cut at cap.

    The state of a session is (key, active, last). Ticks of a micro-batch are taken in order of time; one that is older
    than the state adds nothing, as a clock that goes back. A session without ticks for `idle` ("1 hour") is forgotten;
    this is for streams that run on, as a query with such time-outs never ends by itself.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    milliseconds = idle and int(float(idle.split()[0]) * {"second": 1e3, "minute": 6e4, "hour": 3.6e6, "day": 8.64e7}[idle.split()[1].rstrip("s")])

    def fold(group: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        key, active, last = state.get if state.exists else (None, 0.0, 0.0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "key"], kind="stable")
        out = []
        for k, at in zip(rows["key"], rows["at"], strict=True):
            active = active + min(max(at - last, 0.0), cap) if k == key else 0.0
            key, last = k, at
            out.append((group[0], k, at, active))
        state.update((key, active, last))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=["session", "key", "at", "active"])

    return ticks.select("session", "key", "at").groupBy("session").applyInPandasWithState(fold, "session string, key string, at double, active double", "key string, active double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, by: list[str], window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and `by`, for events at most `late` behind the latest."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def boundaries(scores: DataFrame, by: list[str], at: str, score: str, least: float) -> DataFrame:
    """Local maxima of a score of at least `least`: candidates for the edge of an event. A batch operator."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(at)
    before, after = F.lag(score).over(w), F.lead(score).over(w)
    return scores.withColumns({"_b": before, "_a": after}).filter((F.col(score) >= least) & (F.coalesce(F.col(score) > F.col("_b"), F.lit(True))) & F.coalesce(F.col(score) >= F.col("_a"), F.lit(True))).drop("_b", "_a")
