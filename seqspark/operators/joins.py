"""Look-ups and range joins over sequences; bounded windows instead of joins wherever the range is in rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.operators.stats import by_time


def lookup(df: DataFrame, dimension: DataFrame, key: str, order: str) -> DataFrame:
    """Left join to the first row of each key of ``dimension`` in ``order``; numbers default to 0. Spark broadcasts a small side by itself."""
    first = dimension.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return df.join(first, key, "left").na.fill(0, [c for c in first.columns if c != key])


def event_window(df: DataFrame, flag: str, value: str, before: int, after: int, sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """For rows with ``flag``: mean and minimum of ``value`` from ``before`` rows back up to ``after`` rows ahead (exclusive)."""
    w = by_time(sequence, idx).rowsBetween(-before, after - 1)
    return df.withColumns({"around_mean": F.avg(value).over(w), "around_min": F.min(value).over(w)}).where(flag)


def resample(df: DataFrame, length: int, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """Each sequence at ``length`` evenly spaced positions, by linear interpolation."""
    w = by_time(sequence, idx)
    d = df.select(sequence, idx, value, F.coalesce(F.lead(value).over(w), F.col(value)).alias("_next"), F.count("*").over(Window.partitionBy(sequence)).alias("_n"))
    lo = F.expr(f"cast(ceil({idx} * ({length} - 1) / greatest(_n - 1, 1)) as long)")
    d = d.withColumn("_lo", lo)
    hi = F.when(F.col(idx) == F.col("_n") - 1, F.lit(length - 1).cast("long")).otherwise(F.expr(f"cast(ceil(({idx} + 1) * ({length} - 1) / greatest(_n - 1, 1)) as long) - 1"))
    d = d.withColumn("_hi", hi).where("_lo <= _hi").withColumn("pos", F.explode(F.sequence("_lo", "_hi")))
    x = F.col("pos") * F.greatest(F.col("_n") - 1, F.lit(1)) / (length - 1) - F.col(idx)
    return d.select(sequence, "pos", (F.col(value) + (F.col("_next") - F.col(value)) * F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).alias(value))


def checked_join(truth: DataFrame, predictions: DataFrame, key: str, label: str, predicted: str) -> DataFrame:
    """(key, label, predicted, state) of every id of either table, for scoring.

    ``state`` is matched, missing (no prediction), unknown (no truth) or repeated
    (more than one prediction; ``predicted`` is null then). A column that is not
    there is an error, before anything runs.
    """
    for name, df, columns in (("truth", truth, (key, label)), ("predictions", predictions, (key, predicted))):
        for c in columns:
            if c not in df.columns:
                raise ValueError(f"{name} has no column {c}")
    said = predictions.groupBy(key).agg(F.count("*").alias("_n"), F.first(predicted).alias(predicted))
    both = truth.select(key, F.col(label), F.lit(True).alias("_true")).join(said, key, "full")
    state = F.when(F.col("_true").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").otherwise("matched")
    return both.select(key, label, F.when(F.col("_n") == 1, F.col(predicted)).alias(predicted), state.alias("state"))


def unfinished(planned: DataFrame, finished: DataFrame, *keys: str) -> DataFrame:
    """Tasks of ``planned`` that ``finished`` doesn't have."""
    return planned.join(finished.select(*keys), list(keys), "left_anti")
