"""Recursions over one sequence, as numpy kernels on array columns: one sequence is one array in one row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gathered(df: DataFrame, columns: list[str], sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """One row per sequence: ``rows``, its frames in order."""
    return df.groupBy(sequence).agg(F.array_sort(F.collect_list(F.struct(idx, *columns))).alias("rows"))


def repair_quaternions(q: np.ndarray) -> np.ndarray:
    """Frames x 4 (w, x, y, z), NaN where missing.

    A whole one is normalised. One missing part follows from unit length, with
    the sign that it had in the frame before, after repair. Anything else
    (more missing, no length, or parts that leave nothing) is the identity.
    """
    gone = np.isnan(q)
    n, power = gone.sum(1), np.nansum(q**2, 1)
    whole, one = (n == 0) & (np.sqrt(power) >= 1e-8), (n == 1) & (power <= 1)
    out = np.zeros_like(q)
    out[:, 0] = 1.0
    out[whole] = q[whole] / np.sqrt(power[whole])[:, None]
    out[one] = np.where(gone[one], np.sqrt(1 - power[one])[:, None], q[one])
    for c in range(q.shape[1]):
        lost = one & gone[:, c] & (out[:, c] > 0)
        last = np.maximum.accumulate(np.where(lost, -1, np.arange(len(q))))  # the last frame whose sign is known
        out[lost & (last >= 0) & (out[np.maximum(last, 0), c] < 0), c] *= -1
    return out


def repaired(df: DataFrame, columns: tuple = ("qw", "qx", "qy", "qz"), sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """(sequence, idx, columns) with quaternions repaired in the order of each sequence, by the rule of ``repair_quaternions``, as running columns: no sequence is gathered."""
    before = Window.partitionBy(sequence).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    parts = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]  # NaN is missing as well
    n = sum(p.isNull().cast("int") for p in parts)
    power = sum(F.coalesce(p * p, F.lit(0.0)) for p in parts)
    whole, one = (n == 0) & (F.sqrt(power) >= 1e-8), (n == 1) & (power <= 1)
    rest = F.sqrt(F.greatest(1 - power, F.lit(0.0)))
    out = {c: F.when(whole, p / F.sqrt(power)).when(one, F.coalesce(p, rest)).otherwise(1.0 if i == 0 else 0.0) for i, (c, p) in enumerate(zip(columns, parts))}
    lost = {c: one & p.isNull() & (rest > 0) for c, p in zip(columns, parts)}
    # the last frame whose sign is known says which sign a lost part has
    negative = {c: F.coalesce(F.last(F.when(~lost[c], out[c] < 0), True).over(before), F.lit(False)) for c in columns}
    return df.select(sequence, idx, *(F.when(lost[c] & negative[c], -out[c]).otherwise(out[c]).alias(c) for c in columns))


def prominent_peaks(x: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Places of local maxima: thinned to ``distance`` from the highest down, then kept where they stand out by ``prominence``."""
    edge = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.append(0, edge + 1), np.append(edge, len(x) - 1)
    top = [k for k in range(1, len(starts) - 1) if x[starts[k]] > x[starts[k] - 1] and x[ends[k]] > x[ends[k] + 1]]
    at = np.array([(starts[k] + ends[k]) // 2 for k in top], int)
    keep = np.ones(len(at), bool)
    for k in np.argsort(-x[at], kind="stable") if len(at) else []:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep[near] = False
    out = []
    for p in at[keep]:
        left, right = x[: p + 1][::-1], x[p:]
        low = [side[: int(np.argmax(side > x[p]))] if (side > x[p]).any() else side for side in (left, right)]
        if x[p] - max(s.min() for s in low) >= prominence:
            out.append(p)
    return np.array(out, int)


def peak_features(df: DataFrame, fs: float = 20.0, share: float = 0.5, seconds: float = 0.15, value: str = "v", sequence: str = "sequence_id") -> DataFrame:
    """Per sequence: number, mean height and mean spacing in seconds of peaks with prominence of ``share`` standard deviations."""
    rows = gathered(df, [value], sequence)

    @F.pandas_udf("struct<n_peaks:long,height:double,spacing:double>")
    def kernel(values: pd.Series) -> pd.DataFrame:
        def one(v):
            x = np.asarray(v, float)
            p = prominent_peaks(x, share * x.std(), max(1, round(seconds * fs))) if len(x) > 2 and x.std() > 0 else np.zeros(0, int)
            return len(p), float(x[p].mean()) if len(p) else 0.0, float(np.diff(p).mean() / fs) if len(p) > 1 else 0.0

        return pd.DataFrame([one(v) for v in values], columns=["n_peaks", "height", "spacing"])

    return rows.withColumn("p", kernel(F.transform("rows", lambda r: r[value]))).select(sequence, "p.*")


# The low-pass taps of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523])


def wavelet_levels(x: np.ndarray, levels: int = 3) -> list[np.ndarray]:
    """Details of each level and the last approximation; edges mirrored with the end value repeated."""
    high = DB4[::-1] * np.where(np.arange(8) % 2, 1.0, -1.0)
    out = []
    for _ in range(levels):
        ext = np.pad(x, 7, mode="symmetric") if len(x) else x
        step = lambda taps: np.convolve(ext, taps, "valid")[1::2]  # noqa: E731, B023
        out.append(step(high))
        x = step(DB4)
    return [*out, x]


def wavelet_features(df: DataFrame, levels: int = 3, value: str = "v", sequence: str = "sequence_id") -> DataFrame:
    """(sequence, level, energy, std, mean, share): levels 1.. are details, the last the approximation."""
    rows = gathered(df, [value], sequence)

    @F.pandas_udf("array<struct<level:long,energy:double,std:double,mean:double>>")
    def kernel(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"level": k + 1, "energy": float((c**2).sum()), "std": float(c.std()), "mean": float(c.mean())} for k, c in enumerate(wavelet_levels(np.asarray(v, float), levels)) if len(c)])

    each = rows.withColumn("w", kernel(F.transform("rows", lambda r: r[value]))).select(sequence, "w", F.explode("w").alias("x"))
    total = F.aggregate("w", F.lit(0.0), lambda s, y: s + y["energy"])
    return each.select(sequence, "x.*", F.coalesce(F.try_divide("x.energy", total), F.lit(0.0)).alias("share"))
