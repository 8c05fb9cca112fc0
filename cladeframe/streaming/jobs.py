"""Streams: a job queue over request files, a running top-k, and windowed event counts with late data bounded by a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "job string, command string, auth string, params string"


def requests(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Requests (a JSON object a line) as they arrive in a folder."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files).json(folder)


def serve(incoming: DataFrame, commands: dict[str, Callable[[DataFrame], DataFrame]], results: str, state: str, once: bool = False) -> StreamingQuery:
    """Runs each batch's requests, those of one command together: its function turns a DataFrame of requests into one of (job, result).
    Results are JSON with the job's status; an unknown command is FAILED. Batches are written by number, so a repeated one replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        done = [f(batch.where(F.col("command") == name)).select("job", F.lit("COMPLETED").alias("status"), "result") for name, f in commands.items()]
        out = batch.where(~F.col("command").isin(*commands) | F.col("command").isNull()).select("job", F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("result"))
        for d in done:
            out = out.unionByName(d)
        out.write.mode("overwrite").json(f"{results}/batch={number}")
        batch.unpersist()

    writer = incoming.writeStream.foreachBatch(run).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type and tumbling window; events later than ``late`` are left out of a stream's results."""
    w = F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def running_top(values: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k largest values by key so far: each key's state is k numbers."""

    def update(key_, frames, state):
        import pandas as pd

        best = list(state.get[0]) if state.exists else []
        for f in frames:
            best = sorted([*best, *f[value].dropna().tolist()], reverse=True)[:k]
        state.update((best,))
        yield pd.DataFrame({key: [key_[0]], "top": [best]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return values.groupBy(key).applyInPandasWithState(update, f"{key} string, top array<double>", "top array<double>", "update", GroupStateTimeout.NoTimeout)
