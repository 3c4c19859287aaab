"""Windows over ordered sequences: differences, rolling statistics, tails, islands, peaks, change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.operators.ranks import numbered
from seqspark.operators.stats import by_time, whole


def trailing(k: int, sequence: str = "sequence_id", idx: str = "idx"):
    return by_time(sequence, idx).rowsBetween(-(k - 1), 0)


def centred(k: int, sequence: str = "sequence_id", idx: str = "idx"):
    """A window of k rows around each row; an even one reaches one row further back."""
    return by_time(sequence, idx).rowsBetween(-(k // 2), (k - 1) // 2)


def full(value: Column, window, k: int) -> Column:
    """``value`` where the window has k rows, else null."""
    return F.when(F.count("*").over(window) == k, value)


def from_end(sequence: str = "sequence_id", idx: str = "idx") -> Column:
    """1 for the last row of a sequence, 2 for the one before..."""
    return F.row_number().over(Window.partitionBy(sequence).orderBy(F.col(idx).desc()))


def peaks(df: DataFrame, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """Rows that begin a local maximum; a plateau counts once, at its middle row, and the ends of a sequence never."""
    w = by_time(sequence, idx)
    change = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    flat = df.select(sequence, idx, value).withColumn("_run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = flat.groupBy(sequence, "_run").agg(F.first(value).alias(value), F.expr(f"(min({idx}) + max({idx})) div 2").alias(idx))
    r = Window.partitionBy(sequence).orderBy("_run")
    top = (F.col(value) > F.lag(value).over(r)) & (F.col(value) > F.lead(value).over(r))
    return flat.withColumn("_top", top).where("_top").select(sequence, idx, value)


def change_points(df: DataFrame, k: float, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """Rows whose step from the row before is larger than mean + k * std of the absolute steps."""
    step = F.abs(F.col(value) - F.lag(value).over(by_time(sequence, idx)))
    d = df.withColumn("_step", step)
    d = d.withColumn("_limit", F.avg("_step").over(whole(sequence)) + k * F.stddev_pop("_step").over(whole(sequence)))
    return d.withColumn("is_change", F.coalesce(F.col("_step") > F.col("_limit"), F.lit(False))).drop("_step", "_limit")


def smoothed_classes(df: DataFrame, row: str, probs: str, k: int, block: int = 4096) -> DataFrame:
    """(``row``, class, p): the mean of each of ``k`` class probabilities over five rows in the order of ``row``; the first and the last row's stand in for what is missing.

    Rows are numbered and cut into blocks, each with two rows of its neighbours, so no window grows with the table.
    """
    padded = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(probs, i))
    rows = numbered(df.select(row, padded.alias("_p")), [], [F.asc_nulls_last(row)], "_place")
    ends = rows.agg(F.min_by("_p", "_place").alias("_first"), F.max_by("_p", "_place").alias("_last"))  # one row
    near = F.array_distinct(F.array(*(F.expr(f"(_place + {i}) div {block}") for i in (-2, 0, 2))))
    w = Window.partitionBy("_block").orderBy("_place")
    around = {"_b2": F.lag("_p", 2).over(w), "_b1": F.lag("_p", 1).over(w), "_a1": F.lead("_p", 1).over(w), "_a2": F.lead("_p", 2).over(w)}
    mine = rows.withColumn("_block", F.explode(near)).withColumns(around).where(f"_block = _place div {block}").crossJoin(ends)
    at = lambda c, i, end=None: F.get(c, i) if end is None else F.coalesce(F.get(c, i), F.get(end, i))
    mean = lambda i: (at("_b2", i, "_first") + at("_b1", i, "_first") + at("_p", i) + at("_a1", i, "_last") + at("_a2", i, "_last")) / 5
    found = mine.select(row, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), mean)).alias("class", "p"))
    return found.withColumn("class", F.col("class").cast("long"))


def unwrap(df: DataFrame, angle: str, out: str, sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """Angles without jumps of 2 pi: a running sum of corrections."""
    w, turn = by_time(sequence, idx), 6.283185307179586
    jump = F.col(angle) - F.lag(angle).over(w)
    fix = F.coalesce(F.when(F.abs(jump) >= turn / 2, -F.ceil(jump / turn - 0.5) * turn), F.lit(0.0))
    return df.withColumn("_fix", fix).withColumn(out, F.col(angle) + F.sum("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fix")
