"""Structured Streaming over frame tables: windowed summaries, late frames, scoring of completed sequences. State that expires is in ``stateful``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(frames: DataFrame, length: str = "1 day", step: str | None = None, late: str = "1 hour", ts: str = "ts", key: str = "phase", value: str = "v") -> DataFrame:
    """Count and mean per time window and key; the same call works on a stream and on a table."""
    timed = frames.withColumn("_ts", F.col(ts).cast("timestamp"))
    if frames.isStreaming:
        timed = timed.withWatermark("_ts", late)
    w = F.window("_ts", length, step) if step else F.window("_ts", length)
    out = timed.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.unix_seconds("w.start").alias("start_second"), key, "n", "mean")


def score_completed(frames: DataFrame, gap: str, score: Callable[[DataFrame, int], None], checkpoint: str, ts: str = "ts", late: str = "1 hour"):
    """Start a query that hands each sequence, once no frame has come for ``gap``, to ``score`` as one row of statistics.

    ``score`` gets a DataFrame and the batch number, and may be called again with
    the same number after a failure. Frames later than the watermark are dropped.
    """
    timed = frames.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    done = timed.groupBy("sequence_id", F.session_window("_ts", gap).alias("s")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("max"))
    rows = done.select("sequence_id", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n", "mean", "std", "max")
    return rows.writeStream.outputMode("append").foreachBatch(score).option("checkpointLocation", checkpoint).start()


COMPLETENESS = "sequence_id long, n long, n_late long, complete boolean"


def _arrivals(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, late: int) -> Iterator[pd.DataFrame]:
    n, n_late, newest, complete = state.get if state.exists else (0, 0, -(1 << 62), False)
    x = pd.concat(list(batches)).sort_values("arrival")
    at = x["at"].to_numpy(np.int64)
    seen = np.maximum.accumulate(np.append(newest, at))[:-1]
    behind = at < seen - late
    n, n_late, newest, complete = n + int((~behind).sum()), n_late + int(behind.sum()), int(max(newest, at.max())), bool(complete or x["last"].any())
    state.update((n, n_late, newest, complete))
    yield pd.DataFrame([(key[0], n, n_late, complete)], columns=[c.split()[0] for c in COMPLETENESS.split(", ")])


def completeness(frames: DataFrame, late: int) -> DataFrame:
    """Per sequence: frames in time, frames more than ``late`` behind the newest before them, and whether its last frame has come.

    ``frames``: sequence_id, arrival (their order), at (a number), last. On a stream, a row per sequence and micro-batch, from four numbers of state
    that stay; for streams without end there is ``stateful.completed``.
    """
    rows = frames.select("sequence_id", "arrival", "at", "last")
    if frames.isStreaming:
        state = "n long, n_late long, newest long, complete boolean"
        run = lambda key, batches, state: _arrivals(key, batches, state, late)
        return rows.groupBy("sequence_id").applyInPandasWithState(run, COMPLETENESS, state, "update", GroupStateTimeout.NoTimeout)
    before = F.max("at").over(Window.partitionBy("sequence_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.coalesce(F.col("at") < before - late, F.lit(False))
    return rows.withColumn("_behind", behind).groupBy("sequence_id").agg(F.count_if(~F.col("_behind")).alias("n"), F.count_if("_behind").alias("n_late"), F.bool_or("last").alias("complete"))


def sequence_source(spark, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of Parquet files, ``files`` at a time, each with whole sequences: what a scoring service is handed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
