"""Spectra of short sequences: a relational DFT (frames x frequencies) and array kernels for recursive filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def power_spectrum(df: DataFrame, fs: float = 20.0, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """(sequence, k, freq, power) for k = 1 .. n/2 of the real Fourier transform; the constant term is left out.

    One sequence is one array in one row, so every frequency is a fold over it:
    one shuffle to gather the sequence, none after.
    """
    arrays = df.groupBy(sequence).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, value))), lambda x: x[value]).alias("a"))
    rows = arrays.withColumn("n", F.size("a")).where("n > 1").withColumn("k", F.explode(F.expr("sequence(1, n div 2)")))
    angle = lambda i: F.lit(2 * math.pi) * F.expr("k") * i / F.expr("n")
    fold = lambda f: F.aggregate(F.transform("a", lambda v, i: v * f(angle(i))), F.lit(0.0), lambda s, x: s + x)
    power = fold(F.cos) ** 2 + fold(F.sin) ** 2
    return rows.select(sequence, F.col("k").cast("long").alias("k"), (F.col("k") * fs / F.col("n")).alias("freq"), power.alias("power"))


def welch(df: DataFrame, nperseg: int, fs: float = 20.0, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """(sequence, k, freq, power): mean periodogram of half-overlapping segments, Hann taper, mean removed, density scaling.

    Sequences shorter than a segment give one segment of their own length.
    """
    arrays = df.groupBy(sequence).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, value))), lambda x: x[value]).alias("a"))
    rows = arrays.withColumn("m", F.least(F.size("a"), F.lit(nperseg))).where("m > 1")
    starts = rows.withColumn("s", F.explode(F.expr("sequence(0, size(a) - m, greatest(m - m div 2, 1))"))).withColumn("x", F.slice("a", F.col("s") + 1, F.col("m")))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("m")
    taper = lambda i: 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * i / F.expr("m"))
    tapered = starts.withColumn("mu", mean).withColumn("x", F.transform("x", lambda v, i: (v - F.expr("mu")) * taper(i)))
    norm = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: taper(i) * taper(i)), F.lit(0.0), lambda s, v: s + v)
    each = tapered.withColumn("u", norm).withColumn("k", F.explode(F.expr("sequence(0, m div 2)")))
    angle = lambda i: F.lit(2 * math.pi) * F.expr("k") * i / F.expr("m")
    fold = lambda f: F.aggregate(F.transform("x", lambda v, i: v * f(angle(i))), F.lit(0.0), lambda s, x: s + x)
    twice = F.when((F.col("k") == 0) | ((F.col("m") % 2 == 0) & (F.col("k") == F.expr("m div 2"))), 1.0).otherwise(2.0)
    power = twice * (fold(F.cos) ** 2 + fold(F.sin) ** 2) / (fs * F.col("u"))
    return each.select(sequence, "k", (F.col("k") * fs / F.col("m")).alias("freq"), power.alias("p")).groupBy(sequence, F.col("k").cast("long").alias("k"), "freq").agg(F.avg("p").alias("power"))


def butterworth(order: int, cutoff: float, fs: float, high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth filter, by bilinear transform with the cutoff prewarped."""
    warped = 2 * fs * math.tan(math.pi * cutoff / fs)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if high:
        poles = warped**2 / poles
    z = (2 * fs + poles) / (2 * fs - poles)
    a = np.real(np.poly(z))
    b = np.poly(np.full(order, 1.0 if high else -1.0))
    at = -1.0 if high else 1.0  # gain 1 at this point of the unit circle
    return b * np.polyval(a, at) / np.polyval(b, at), a


def filtfilt(b: np.ndarray, a: np.ndarray, series: list[np.ndarray]) -> list[np.ndarray]:
    """The filter forwards and backwards over each of the series, with odd reflection at the ends and steady initial states; all series take each step together."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    steady = np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])

    def run(rows: list[np.ndarray]) -> list[np.ndarray]:
        steps = max(map(len, rows))
        y = np.zeros((steps, len(rows)))
        for k, r in enumerate(rows):
            y[: len(r), k] = r
        z, out = steady[:, None] * y[0], np.empty_like(y)
        for t in range(steps):
            out[t] = b[0] * y[t] + z[0]
            z[:-1] = z[1:]
            z[-1] = 0.0
            z += b[1:, None] * y[t] - a[1:, None] * out[t]
        return [out[: len(r), k] for k, r in enumerate(rows)]

    pads = [min(3 * max(len(a), len(b)), len(x) - 1) for x in series]
    result = [x.copy() for x in series]
    order = sorted((k for k, p in enumerate(pads) if p >= 1), key=lambda k: len(series[k]))
    for at in range(0, len(order), 512):  # series of like length
        some = order[at : at + 512]
        ext = [np.concatenate([2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2 : -p - 2 : -1]]) for x, p in ((series[k], pads[k]) for k in some)]
        back = run([x[::-1] for x in run(ext)])
        for k, x in zip(some, back):
            result[k] = x[::-1][pads[k] : pads[k] + len(series[k])]
    return result


def filtered(df: DataFrame, order: int, cutoff: float, fs: float = 20.0, high: bool = False, value: str = "v", out: str = "filtered", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """(sequence, idx, value, out): the zero-phase filter over each sequence; sequences of less than 9 rows give their median (low) or the rest (high)."""
    b, a = butterworth(order, cutoff, fs, high)
    arrays = df.groupBy(sequence).agg(F.array_sort(F.collect_list(F.struct(idx, value))).alias("rows"))

    @F.pandas_udf("array<double>")
    def kernel(values: pd.Series) -> pd.Series:
        series = [np.asarray(v, float) for v in values]
        long = [k for k, x in enumerate(series) if len(x) >= 9]
        out = [x - np.median(x) if high and len(x) else np.full(len(x), np.median(x) if len(x) else 0.0) for x in series]
        for k, x in zip(long, filtfilt(b, a, [series[k] for k in long])):
            out[k] = x
        return pd.Series(out)

    done = arrays.withColumn("f", kernel(F.transform("rows", lambda r: r[value])))
    return done.select(sequence, F.explode(F.arrays_zip("rows", "f")).alias("x")).select(sequence, f"x.rows.{idx}", f"x.rows.{value}", F.col("x.f").alias(out))


def share_edge(df: DataFrame, share: float, sequence: str = "sequence_id") -> Column:
    """The lowest frequency below which ``share`` of the power lies, as an aggregate over rows with ``cum`` and ``total``."""
    return F.min(F.when(F.col("cum") >= share * F.col("total"), F.col("freq")))


def with_shares(spectrum: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    w = Window.partitionBy(sequence)
    return spectrum.withColumns({"total": F.sum("power").over(w), "cum": F.sum("power").over(w.orderBy("freq").rowsBetween(Window.unboundedPreceding, 0))})
