"""What a user builds feature tables from: statistics by name, families by switch, and functions of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.operators import stats as S
from seqspark.operators import windows as W

#: Name -> aggregate of one column. All of them fit into one grouping.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "count": F.count, "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max, "median": F.median, "range": lambda v: F.max(v) - F.min(v),
    "q25": lambda v: F.percentile(v, F.lit(0.25)), "q75": lambda v: F.percentile(v, F.lit(0.75)), "iqr": lambda v: F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25)),
    "skew": lambda v: S.moments(v)["skew"], "kurt": lambda v: S.moments(v)["kurt"], "energy": lambda v: F.sum(v * v), "rms": lambda v: F.sqrt(F.avg(v * v)), "abs_mean": lambda v: F.avg(F.abs(v)),
}


def statistics(df: DataFrame, columns: list[str], names: list[str], keys: tuple[str, ...] = ("sequence_id",)) -> DataFrame:
    """``column_name`` for every column and statistic asked for by name, in one grouping."""
    if unknown := set(names) - STATISTICS.keys():
        raise ValueError(f"no statistics {sorted(unknown)}; there are {sorted(STATISTICS)}")
    return df.groupBy(*keys).agg(*(STATISTICS[n](F.col(c)).alias(f"{c}_{n}") for c in columns for n in names))


@dataclass(frozen=True)
class FeatureSpec:
    """Which families of features a table of sequences gets; each is a switch."""

    basic: bool = True
    quantiles: bool = True
    moments: bool = False
    steps: bool = False
    ends: bool = False

    @classmethod
    def of(cls, config: dict) -> FeatureSpec:
        """From a configuration: ``{"basic": True}`` or ``{"basic": {"enabled": True}}``; families that aren't named keep their default."""
        known = {f.name for f in fields(cls)}
        if unknown := config.keys() - known:
            raise ValueError(f"no families {sorted(unknown)}; there are {sorted(known)}")
        return cls(**{k: bool(v.get("enabled", True) if isinstance(v, dict) else v) for k, v in config.items()})

    def apply(self, df: DataFrame, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
        """One row per sequence with the columns of all families that are on: one grouping, after one window where steps are asked for."""
        v = F.col(value)
        out: dict[str, Column] = {"n": F.count("*")}
        if self.basic:
            out |= S.basic(v)
        if self.quantiles:
            out |= S.quantiles(v)
        if self.moments:
            out |= S.moments(v)
        if self.steps:
            df = S.lagged_steps(df, value, "_step", 1, sequence, idx)
            out |= {"step_mean": F.coalesce(F.avg("_step"), F.lit(0.0)), "step_std": F.coalesce(F.stddev_pop("_step"), F.lit(0.0)), "line_length": F.coalesce(F.sum(F.abs("_step")), F.lit(0.0))}
        if self.ends:
            out |= {"first": F.min_by(v, idx), "last": F.max_by(v, idx)}
        return S.summarise(df, out, sequence)


#: Functions of a whole series that users have registered: name -> (function, result columns).
_SERIES: dict[str, tuple[Callable, str]] = {}


def register_series_feature(name: str, function: Callable[[pd.Series], dict], schema: str) -> None:
    """``function`` takes the values of one sequence in order and returns a dict; ``schema`` names and types what it returns, as "a double, b long"."""
    _SERIES[name] = function, schema


def series_feature(df: DataFrame, name: str, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """One row per sequence with what the registered function returns; sequences go to Python in Arrow batches of whole arrays. Missing keys are null."""
    function, schema = _SERIES[name]
    names = [c.strip().split()[0] for c in schema.split(",")]

    @F.pandas_udf(f"struct<{', '.join(':'.join(c.strip().split()) for c in schema.split(','))}>")
    def run(arrays: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(pd.Series(a)) for a in arrays], columns=names)

    arrays = df.groupBy(sequence).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, value))), lambda x: x[value]).alias("_a"))
    return arrays.withColumn("_f", run("_a")).select(sequence, "_f.*")


def user_aggregate(function: Callable[[pd.Series], float], kind: str = "double"):
    """A function of all values of a group as an aggregate for ``agg``."""

    @F.pandas_udf(kind)
    def aggregate(values: pd.Series) -> float:
        return function(values)

    return aggregate


def windows_of(df: DataFrame, size: int, step: int, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """The rows of every sliding window: (sequence, begin, idx, value), for begin = 0, step, ... below n - size. A row is in at most ceil(size / step) windows."""
    rows = df.select(sequence, idx, value).withColumn("_n", F.count("*").over(S.whole(sequence)))
    first = f"greatest(0L, (cast(floor(({idx} - {size}) / {step}) as bigint) + 1) * {step})"
    begins = F.explode(F.expr(f"CASE WHEN {first} <= {idx} THEN sequence({first}, {idx} - {idx} % {step}, {step}) END"))
    return rows.withColumn("begin", begins).where((F.col("begin") < F.col("_n") - size) & (F.col(idx) < F.col("begin") + size)).drop("_n")


def window_summaries(df: DataFrame, size: int = 20, step: int = 10, value: str = "v", sequence: str = "sequence_id", idx: str = "idx") -> DataFrame:
    """Per sliding window: mean, std, max, min, range, median, quartiles, skewness, kurtosis, sign changes and peaks."""
    rows = windows_of(df, size, step, value, sequence, idx).withColumn("_w", F.struct(sequence, "begin"))
    before = F.lag(value).over(S.by_time("_w", idx))
    rows = rows.withColumn("_turn", F.when(before.isNotNull() & (F.signum(F.col(value)) != F.signum(before)), 1).otherwise(0))
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    b = S.basic(v)
    out = {k: b[k] for k in ("mean", "std", "max", "min", "range")} | {"q25": q[0], "median": q[1], "q75": q[2], **S.moments(v), "zero_crossings": F.sum("_turn")}
    found = S.summarise(rows, out, "_w")
    peaks = S.summarise(W.peaks(rows, value, "_w", idx), {"n_peaks": F.count("*")}, "_w")
    return found.join(peaks, "_w", "left").select(f"_w.{sequence}", "_w.begin", *out, F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"))


def series_summary(df: DataFrame, fs: float = 20.0, keys: tuple[str, ...] = ("sequence_id", "series"), value: str = "v", idx: str = "idx") -> DataFrame:
    """The bundle of any set of series: statistics, peaks, autocorrelation at lag 1 and the spectrum, one row per series. Nulls are left out."""
    from seqspark.operators.spectral import power_spectrum

    rows = df.where(F.col(value).isNotNull()).withColumn("_s", F.struct(*keys))
    rows = rows.withColumn(idx, (F.row_number().over(S.by_time("_s", idx)) - 1).cast("long"))
    v = F.col(value)
    lagged = rows.withColumn("_mu", F.avg(v).over(S.whole("_s"))).withColumn("_before", F.lag(value).over(S.by_time("_s", idx)))
    out = {"n": F.count("*"), **S.basic(v), **{k: c for k, c in S.quantiles(v).items() if k in ("q25", "median", "q75")}, **S.moments(v)}
    auto = S.ratio(F.sum((v - F.col("_mu")) * (F.col("_before") - F.col("_mu"))), F.sum((v - F.col("_mu")) ** 2))
    found = S.summarise(lagged, out | {"autocorr1": auto}, "_s")
    peaks = S.summarise(W.peaks(rows, value, "_s", idx), {"n_peaks": F.count("*"), "peak_mean": F.avg(value)}, "_s")
    spectrum = power_spectrum(rows, fs, value, "_s", idx)
    total = {"power": F.sum("power"), "centroid": S.ratio(F.sum(F.col("freq") * F.col("power")), F.sum("power"))}
    bands = S.summarise(spectrum, total, "_s")
    joined = found.join(peaks, "_s", "left").join(bands, "_s", "left")
    names = [*out, "autocorr1", "n_peaks", "peak_mean", "power", "centroid"]
    return joined.select(*(f"_s.{k}" for k in keys), *(F.coalesce(F.col(c), F.lit(0)).alias(c) if c == "n_peaks" else F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names))
