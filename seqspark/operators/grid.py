"""8x8 sensor frames in long form (sequence, idx, sensor, pixel, d): pixel constants by arithmetic, one grouping per frame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.operators.stats import safe_corr

FRAME = ("sequence_id", "idx", "sensor")


def row(pixel: str = "pixel") -> Column:
    return F.expr(f"{pixel} div 8")


def col(pixel: str = "pixel") -> Column:
    return F.col(pixel) % 8


def region(pixel: str = "pixel") -> Column:
    """0: centre (rows and columns 2-4), 1: the ring of rows and columns 1-5 around it, 2: the rest."""
    r, c = row(pixel), col(pixel)
    return F.when(r.between(2, 4) & c.between(2, 4), 0).when(r.between(1, 5) & c.between(1, 5), 1).otherwise(2)


def pixel_places(columns: list[str]) -> dict[str, tuple[int, int]] | None:
    """Row and column of each pixel by its column's name (``r3_c7``, ``px27`` or ``_v27``); None unless all of them tell."""
    out = {}
    for c in columns:
        if m := re.search(r"r(\d+).*?c(\d+)", c, re.I):
            out[c] = int(m[1]), int(m[2])
        elif m := re.search(r"(?:px|_v)(\d+)", c, re.I):
            out[c] = divmod(int(m[1]), 8)
        else:
            return None
    return out


def long_frames(df: DataFrame, keys: list[str], prefix: str = "tof_") -> DataFrame:
    """Wide frames in long form: keys, row, col, pixel, d. Pixels whose names don't tell their place raise an error."""
    names = [c for c in df.columns if c.startswith(prefix)]
    if (places := pixel_places(names)) is None:
        raise ValueError("some pixels' names don't tell their place")
    cell = lambda c: F.struct(F.lit(places[c][0]).cast("long").alias("row"), F.lit(places[c][1]).cast("long").alias("col"), F.lit(places[c][0] * 8 + places[c][1]).cast("long").alias("pixel"), F.col(c).cast("double").alias("d"))
    return df.select(*keys, F.explode(F.array(*map(cell, names))).alias("x")).select(*keys, "x.*")


def per_frame(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.groupBy(*FRAME).agg(*(c.alias(k) for k, c in columns.items()))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def aggregates(d: Column, sample: bool = False) -> dict[str, Column]:
    sd = F.stddev_samp(d) if sample else F.stddev_pop(d)
    return {"mean": zero(F.avg(d)), "std": zero(sd), "min": zero(F.min(d)), "max": zero(F.max(d)), "valid": F.count(d) / F.count("*")}


def weighted_moments(w: Column) -> dict[str, Column]:
    """Centroid and second central moments of pixel places with weights w."""
    x, y = col().cast("double"), row().cast("double")
    x, y = F.when(w.isNotNull(), x), F.when(w.isNotNull(), y)
    total = F.sum(w)
    mean = lambda v: F.try_divide(F.sum(w * v), total)
    cx, cy = mean(x), mean(y)
    return {"cx": zero(cx), "cy": zero(cy), "m20": zero(mean(x * x) - cx * cx), "m02": zero(mean(y * y) - cy * cy), "m11": zero(mean(x * y) - cx * cy)}


def with_eccentricity(frames: DataFrame) -> DataFrame:
    root = F.sqrt((F.col("m20") - F.col("m02")) ** 2 + 4 * F.col("m11") ** 2)
    both = F.col("m20") + F.col("m02")
    return frames.withColumn("ecc", F.when(both + root > 1e-9, F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(both - root, both + root)))).otherwise(0.0))


def as_arrays(df: DataFrame) -> DataFrame:
    """One row per frame with its 64 numbers in order of pixels."""
    return df.groupBy(*FRAME).agg(F.transform(F.array_sort(F.collect_list(F.struct("pixel", F.col("d").alias("d")))), lambda x: x["d"]).alias("a"))


def mirrored(a: Column, flag: Column) -> Column:
    """The frame mirrored left to right where ``flag`` holds."""
    return F.when(flag, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(a, F.floor(i / 8).cast("int") * 8 + 7 - i % 8))).otherwise(a)


def cluster_labels(mask: Column) -> Column:
    """Labels of the 4-connected groups of true cells of a 64-cell mask: the smallest cell of each group plus 1, else 0.

    Each round takes the smallest label beside a cell; a path through 64 cells
    needs fewer than 64 rounds.
    """
    start = F.transform(mask, lambda m, i: F.when(m, i + 1).otherwise(0))

    def best(labels, cell, i):
        beside = lambda ok, at: F.when(ok & (F.get(labels, at) > 0), F.get(labels, at))
        return F.when(cell > 0, F.least(cell, beside(i % 8 > 0, i - 1), beside(i % 8 < 7, i + 1), beside(i > 7, i - 8), beside(i < 56, i + 8))).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, lambda labels, _: F.transform(labels, lambda cell, i: best(labels, cell, i)))


def sensor_components(df: DataFrame, training: Column, k: int = 8, sensors: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Per frame: pc1 .. pck, the centred frame on the sensor's principal components of the ``training`` rows, and ``error``, the mean squared error of the frame built back from them."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    a = as_arrays(df).withColumn("x", array_to_vector("a"))
    out = None
    for s in sensors:  # a model each
        mine = a.where(F.col("sensor") == s)
        fitted = mine.where(training)
        mean = fitted.agg(Summarizer.mean(F.col("x")).alias("m")).head()["m"]
        if mean is None:
            continue
        axes = PCA(k=k, inputCol="x", outputCol="pc").fit(fitted).pc.toArray().T
        literal = lambda v: F.array(*(F.lit(float(x)) for x in v))
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda m, x: m + x)
        part = mine.withColumn("c", F.zip_with("a", literal(mean.toArray()), lambda x, y: x - y))
        part = part.withColumns({f"pc{i + 1}": dot(F.col("c"), literal(axis)) for i, axis in enumerate(axes)})
        rest = dot(F.col("c"), F.col("c")) - sum(F.col(f"pc{i + 1}") ** 2 for i in range(len(axes)))  # the axes are orthonormal
        part = part.select(*FRAME, *(f"pc{i + 1}" for i in range(k)), (F.greatest(rest, F.lit(0.0)) / F.size("a")).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out


def sensor_pairs(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """(sequence_id, sensor, other, r): correlation over frames of ``left`` of a sensor with ``right`` of each other one; 0 where a side is constant."""
    f = df.groupBy("sequence_id", "idx", "sensor").agg(left.alias("a"), right.alias("b"))
    frames = f.groupBy("sequence_id", "idx").agg(F.collect_list(F.struct("sensor", "a", "b")).alias("s"))  # as many as there are sensors
    pairs = frames.select("sequence_id", F.explode("s").alias("x"), "s").select("sequence_id", "x", F.explode("s").alias("y")).where("x.sensor <> y.sensor")
    return pairs.groupBy("sequence_id", F.col("x.sensor").alias("sensor"), F.col("y.sensor").alias("other")).agg(safe_corr(F.col("x.a"), F.col("y.b")).alias("r"))
