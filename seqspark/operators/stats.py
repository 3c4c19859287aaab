"""Per-sequence statistics: all of them aggregates of one grouping, so one shuffle serves a whole feature row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_time(sequence: str = "sequence_id", idx: str = "idx"):
    return Window.partitionBy(sequence).orderBy(idx)


def whole(sequence: str = "sequence_id"):
    return Window.partitionBy(sequence)


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, ``default`` where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def lagged_steps(df: DataFrame, value: str = "v", out: str = "step", lag: int = 1, sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, lag).over(by_time(sequence, idx)))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation; 0 where either side is constant or there is one row. Rows with a null on either side are left out."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def basic(v: Column) -> dict[str, Column]:
    return {"mean": F.avg(v), "std": F.stddev_pop(v), "var": F.var_pop(v), "min": F.min(v), "max": F.max(v), "range": F.max(v) - F.min(v)}


def quantiles(v: Column) -> dict[str, Column]:
    p = F.percentile(v, F.array(*(F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9))))
    return {"p10": p[0], "q25": p[1], "median": p[2], "q75": p[3], "p90": p[4], "iqr": p[3] - p[1]}


def with_quantiles(df: DataFrame, column: str, probs: tuple[float, ...], by: list[str], out: str) -> DataFrame:
    """``df`` with the array ``out``: the quantiles of ``column`` in the groups ``by``, to the last bit those of the SQL, for rows that are compared with them.

    Between its neighbours a quantile is fma(low, 1 - part, high * part), as DuckDB
    computes it; other formulas differ by a rounding, which moves rows that equal
    their quantile to the other side. Nulls are left out; a group of nulls has null quantiles.
    """
    rank, n = "_rank", "_known"
    group = Window.partitionBy(*by)
    rows = df.withColumns({rank: F.row_number().over(group.orderBy(F.asc_nulls_last(column))), n: F.count(column).over(group)})
    at = {i: (F.col(n) - 1).cast("double") * p for i, p in enumerate(probs)}
    ends = {f"_{side}{i}": F.max(F.when(F.col(rank) == f(r) + 1, F.col(column).cast("double"))).over(group) for i, r in at.items() for side, f in (("low", F.floor), ("high", F.ceil))}

    def between(i):
        low, high, part = F.col(f"_low{i}"), F.col(f"_high{i}"), at[i] - F.floor(at[i])
        given = [F.coalesce(c, F.lit(0.0)) for c in (low, 1 - part, high * part)]
        fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), *given).cast("double")
        return F.when(low.isNull() | (part == 0), low).otherwise(fused)

    return rows.withColumns(ends).withColumn(out, F.array(*(between(i) for i in at))).drop(rank, n, *ends)


def moments(v: Column) -> dict[str, Column]:
    """Population skewness and excess kurtosis; 0 for a constant series."""
    flat = F.stddev_pop(v) <= 1e-12
    return {"skew": F.when(flat, 0.0).otherwise(F.coalesce(F.skewness(v), F.lit(0.0))), "kurt": F.when(flat, 0.0).otherwise(F.coalesce(F.kurtosis(v), F.lit(0.0)))}


def corrected_moments(v: Column) -> dict[str, Column]:
    """Bias-corrected skewness (3 rows or more) and kurtosis (4 or more); else 0, as for standard deviations up to 1e-8."""
    n = F.count(v).cast("double")
    m = moments(v)
    flat = F.coalesce(F.stddev_samp(v), F.lit(0.0)) <= 1e-8
    skew = m["skew"] * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * m["kurt"] + 6)
    return {"skew": F.when(flat | (n < 3), 0.0).otherwise(skew), "kurt": F.when(flat | (n < 4), 0.0).otherwise(kurt)}


def summarise(df: DataFrame, columns: dict[str, Column], *keys: str) -> DataFrame:
    return df.groupBy(*(keys or ("sequence_id",))).agg(*(c.alias(k) for k, c in columns.items()))


def segment(df: DataFrame, k: int, idx: str = "idx", sequence: str = "sequence_id") -> DataFrame:
    """Number ``seg`` of k floor-sized chunks, the last of which takes the remainder; ``n`` rows of the sequence."""
    n = F.count("*").over(whole(sequence))
    return df.withColumn("n", n).withColumn("seg", F.when(F.col("n") < k, F.lit(0)).otherwise(F.least(F.expr(f"{idx} div greatest(n div {k}, 1)"), F.lit(k - 1))))


def runs(df: DataFrame, flag: str, sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """Islands of equal ``flag``: sequence, flag, start, end, length."""
    w = by_time(sequence, idx)
    change = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    island = df.withColumn("_change", change).withColumn("_island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(sequence, "_island", flag).agg(F.min(idx).alias("start"), F.max(idx).alias("end"), F.count("*").alias("length")).drop("_island")


def with_other(df: DataFrame, category: Column, least: float = 0.05, other: str = "Other") -> DataFrame:
    """(category, n); categories with a smaller share of the rows than ``least`` are counted together."""
    c = df.groupBy(category.alias("k")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    s = c.crossJoin(total)  # one row beside a row per category
    return s.groupBy(F.when(F.col("n") / F.col("total") < least, other).otherwise(F.col("k")).alias("category")).agg(F.sum("n").alias("n"))


#: Bits of a number that a scan of ``table_quantiles`` settles.
RADIX = 12


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order: negative infinity, numbers, infinity, NaN. Both zeros are one number, and so are all NaNs."""
    v = np.where(np.isnan(v), np.nan, v + 0.0)
    bits = v.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_ordered_bits(k: int) -> float:
    bits = k & ~(1 << 63) if k >> 63 else ~k & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _radix_counts(rows: DataFrame, known: int, prefixes: list[int]) -> DataFrame:
    """(prefix, n, low, high): rows by the first ``known`` + RADIX bits, of those whose first ``known`` bits are one of ``prefixes``; low and high are the ends of what is there."""
    shift = np.uint64(max(64 - known - RADIX, 0))
    wanted = np.array(sorted(prefixes), np.uint64)

    def run(batches):
        for batch in batches:
            k = ordered_bits(batch.column(0).to_numpy(zero_copy_only=False))
            if known:
                k = k[np.isin(k >> np.uint64(64 - known), wanted)]
            k.sort()
            cell, first, n = np.unique(k >> shift, return_index=True, return_counts=True)
            columns = (cell, n, k[first] if len(k) else k, k[first + n - 1] if len(k) else k)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64).view(np.int64)) for c in columns], names=["cell", "n", "low", "high"])

    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  signed numbers in the order of unsigned ones
    found = rows.mapInArrow(run, "cell long, n long, low long, high long").withColumns({"low": flip("low"), "high": flip("high")})
    return found.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def table_quantiles(df: DataFrame, column: str, probs: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles of a whole column, linear between neighbours; nulls are left out, an empty column gives None.

    Doubles are taken as integers of the same order, of which each scan settles
    RADIX bits around all wanted ranks at once: six scans at most, whatever the
    numbers are, and two for most. A task holds a count per cell. NaN comes after
    infinity, as Spark orders it.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n, known, open_ = None, 0, {0: 0}  # prefix -> rows before it
    wanted: dict[int, list[int]] = {}
    found: dict[int, float] = {}
    while open_:
        cells = [(r["cell"] % (1 << 64), r["n"], r["low"] + (1 << 63), r["high"] + (1 << 63)) for r in _radix_counts(rows, known, list(open_)).collect()]
        bits = min(RADIX, 64 - known)
        if n is None:
            n = sum(c[1] for c in cells)
            if not n:
                return [None] * len(probs)
            wanted = {0: sorted({k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})}
        following, ranks = {}, {}
        for prefix, before in open_.items():
            for cell, count, low, high in sorted(c for c in cells if c[0] >> bits == prefix):
                if mine := [k for k in wanted[prefix] if before <= k < before + count]:
                    if low == high or known + bits == 64:
                        found |= dict.fromkeys(mine, from_ordered_bits(low))
                    elif rest := [k for k in mine if k not in (before, before + count - 1)]:
                        following[cell], ranks[cell] = before, rest
                    found |= {k: from_ordered_bits(low if k == before else high) for k in mine if k in (before, before + count - 1)}
                before += count
        open_, wanted, known = following, ranks, known + bits
    out = []
    for p in probs:
        a, b, part = found[math.floor(p * (n - 1))], found[math.ceil(p * (n - 1))], p * (n - 1) % 1
        out.append(a if a == b or not part else a * (1 - part) + b * part if math.isinf(b - a) else a + (b - a) * part)
    return out
