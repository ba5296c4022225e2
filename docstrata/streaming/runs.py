"""Resumable runs, failure breaking and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_runs(events: DataFrame, failed: Column, order: tuple[str, ...], by: str = "key") -> DataFrame:
    """Longest run of failures per key, by gaps and islands."""
    w = Window.partitionBy(by).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    runs = events.withColumn("_island", island).filter(failed).groupBy(by, "_island").agg(F.count("*").alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias("longest"))


def breaker(events: DataFrame, failed: Column, order: tuple[str, ...], limit: int = 12, by: str = "key") -> DataFrame:
    """The event at which each key's breaker trips: the ``limit``-th failure in a row; keys that never do have no row."""
    w = Window.partitionBy(by).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    placed = events.withColumn("_call", F.row_number().over(w)).withColumn("_island", island).filter(failed)
    nth = F.row_number().over(Window.partitionBy(by, "_island").orderBy("_call"))
    return placed.withColumn("_nth", nth).filter(F.col("_nth") == limit).groupBy(by).agg(F.min("_call").alias("call"))


def breaker_stream(calls: DataFrame, limit: int = 12) -> DataFrame:
    """The same over a stream of ``calls(key, seq, failed)``: a row each time a key's failures in a row reach the limit."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        trips = []
        for frame in frames:
            for seq, failed in frame.sort_values("seq")[["seq", "failed"]].itertuples(index=False):
                run = run + 1 if failed else 0
                if run == limit:
                    trips.append((key[0], int(seq)))
        state.update((run,))
        yield pd.DataFrame(trips, columns=["key", "seq"])

    return calls.groupBy("key").applyInPandasWithState(step, "key string, seq long", "run int", "append", "NoTimeout")


def captured(model: Callable[[str], str]):
    """A model call that never fails a job: ``struct(value, error, seconds)``."""
    import time

    @F.pandas_udf("value string, error string, seconds double")
    def call(inputs: pd.Series) -> pd.DataFrame:
        rows = []
        for x in inputs:
            began = time.perf_counter()
            try:
                rows.append((model(x), None, time.perf_counter() - began))
            except Exception as e:  # noqa: BLE001
                rows.append((None, f"{type(e).__name__}: {e}", time.perf_counter() - began))
        return pd.DataFrame(rows, columns=["value", "error", "seconds"])

    return call


def retried(call: Callable, tries: int = 5, wait: float = 1.0, factor: float = 1.5, sleep: Callable[[float], None] | None = None) -> Callable:
    """``call`` with growing waits between tries; the last error is raised."""
    import time

    sleep = sleep or time.sleep

    def run(*args):
        pause = wait
        for k in range(tries):
            try:
                return call(*args)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(pause)
                pause *= factor

    return run


def fallback(calls: list[Callable]) -> Callable:
    """The first of several models that answers."""

    def run(*args):
        error: Exception | None = None
        for call in calls:
            try:
                return call(*args)
            except Exception as e:  # noqa: BLE001
                error = e
        raise error or ValueError("no model")

    return run


def limited(call: Callable, interval: float, clock=None, sleep=None) -> Callable:
    """``call`` at most once per interval, within one worker."""
    import time

    clock, sleep, last = clock or time.monotonic, sleep or time.sleep, [float("-inf")]

    def run(*args):
        pause = last[0] + interval - clock()
        if pause > 0:
            sleep(pause)
        last[0] = clock()
        return call(*args)

    return run


# ---------------------------------------------------------------- additions: event time


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which needs instants; batches as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; on streams, late rows up to the watermark count."""
    own = _timed(events, late)
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    own = _timed(events, late)
    return own.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    own = _timed(events, late)
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")


def index_stream(docs: DataFrame, path: str, checkpoint: str, codes: bool = False):
    """Keep a segment index of a stream of documents up to date: each micro-batch is a batch of ``segments.append``, which runs again harmlessly.

    A text is indexed as it comes; an id that comes again replaces what it had.
    """
    from ..operators import segments

    def add(batch: DataFrame, number: int) -> None:
        segments.append(batch.select("doc_id", "text"), path, number, codes=codes)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
