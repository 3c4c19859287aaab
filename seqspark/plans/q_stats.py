"""Queries: per-sequence statistics (A) over event and vector frames."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqspark.operators import stats as S
from seqspark.plans.registry import query



@query("a01_basic_stats", "sequence_id", "mean std var min max range", "SELECT sequence_id, avg(v) AS mean, stddev_pop(v) AS std, var_pop(v) AS var, min(v) AS min, max(v) AS max, max(v) - min(v) AS range FROM fe GROUP BY 1")
def _(t):
    return S.summarise(t.fe, S.basic(F.col("v")))


@query(
    "a02_quantiles", "sequence_id", "p10 q25 median q75 p90 iqr",
    "SELECT sequence_id, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM fe GROUP BY 1",
)
def _(t):
    return S.summarise(t.fe, S.quantiles(F.col("v")))


@query("a03_variation", "sequence_id", "cv_abs cv_raw", "SELECT sequence_id, stddev_pop(v) / (abs(avg(v)) + 1e-8) AS cv_abs, stddev_pop(v) / (avg(v) + 1e-10) AS cv_raw FROM fe GROUP BY 1")
def _(t):
    return S.summarise(t.fe, {"cv_abs": F.stddev_pop(F.col("v")) / (F.abs(F.avg(F.col("v"))) + 1e-8), "cv_raw": F.try_divide(F.stddev_pop(F.col("v")), F.avg(F.col("v")) + 1e-10)})


_MOMENTS = "m AS (SELECT fe.sequence_id, count(*)::DOUBLE AS n, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM fe JOIN (SELECT sequence_id, avg(v) AS mu FROM fe GROUP BY 1) AS a USING (sequence_id) GROUP BY 1)"


@query("a04_moments", "sequence_id", "skew kurt", f"WITH {_MOMENTS} SELECT sequence_id, CASE WHEN sqrt(m2) <= 1e-12 THEN 0 ELSE m3 / m2 ** 1.5 END AS skew, CASE WHEN sqrt(m2) <= 1e-12 THEN 0 ELSE m4 / m2 ** 2 - 3 END AS kurt FROM m")
def _(t):
    return S.summarise(t.fe, S.moments(F.col("v")))


@query(
    "a05_corrected_moments", "sequence_id", "skew kurt",
    f"WITH {_MOMENTS} SELECT sequence_id, CASE WHEN n < 3 OR m2 <= 1e-16 THEN 0 ELSE m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) END AS skew, CASE WHEN n < 4 OR m2 <= 1e-16 THEN 0 ELSE (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) END AS kurt FROM m",
)
def _(t):
    return S.summarise(t.fe, S.corrected_moments(F.col("v")))


@query("a06_first_last", "sequence_id", "first last delta", "SELECT sequence_id, arg_min(v, idx) AS first, arg_max(v, idx) AS last, arg_max(v, idx) - arg_min(v, idx) AS delta FROM fe GROUP BY 1")
def _(t):
    first, last = F.min_by("v", "idx"), F.max_by("v", "idx")
    return S.summarise(t.fe, {"first": first, "last": last, "delta": last - first})


_STEP = "d AS (SELECT *, v - lag(v) OVER (PARTITION BY sequence_id ORDER BY idx) AS step FROM fe)"


@query("a07_step_stats", "sequence_id", "step_mean step_std step_max_abs", f"WITH {_STEP} SELECT sequence_id, coalesce(avg(step), 0) AS step_mean, coalesce(stddev_pop(step), 0) AS step_std, coalesce(max(abs(step)), 0) AS step_max_abs FROM d GROUP BY 1")
def _(t):
    s = F.col("step")
    return S.summarise(S.lagged_steps(t.fe), {"step_mean": F.coalesce(F.avg(s), F.lit(0.0)), "step_std": F.coalesce(F.stddev_pop(s), F.lit(0.0)), "step_max_abs": F.coalesce(F.max(F.abs(s)), F.lit(0.0))})


@query("a08_change_count", "sequence_id n_tenth n_half", "", f"WITH {_STEP}, e AS (SELECT *, stddev_pop(v) OVER (PARTITION BY sequence_id) AS sd FROM d) SELECT sequence_id, count(*) FILTER (abs(step) > 0.1 * sd) AS n_tenth, count(*) FILTER (abs(step) > 0.5 * sd) AS n_half FROM e GROUP BY 1")
def _(t):
    df = S.lagged_steps(t.fe).withColumn("sd", F.stddev_pop("v").over(S.whole()))
    return S.summarise(df, {"n_tenth": F.count_if(F.abs("step") > 0.1 * F.col("sd")), "n_half": F.count_if(F.abs("step") > 0.5 * F.col("sd"))})


def _corr_sql(a: str, b: str) -> str:
    return f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)"


@query("a09_time_correlation", "sequence_id", "r", f"SELECT sequence_id, {_corr_sql('idx', 'v')} AS r FROM fe GROUP BY 1")
def _(t):
    return S.summarise(t.fe, {"r": S.safe_corr(F.col("idx"), F.col("v"))})


@query("a10_trend", "sequence_id", "slope intercept", "SELECT sequence_id, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(v, idx) END AS slope, CASE WHEN count(*) < 2 THEN avg(v) ELSE regr_intercept(v, idx) END AS intercept FROM fe GROUP BY 1")
def _(t):
    one = F.count("*") < 2
    return S.summarise(t.fe, {"slope": F.when(one, 0.0).otherwise(F.regr_slope("v", "idx")), "intercept": F.when(one, F.avg("v")).otherwise(F.regr_intercept("v", "idx"))})


@query("a11_energy", "sequence_id", "energy total log_energy", "SELECT sequence_id, avg(v * v) AS energy, sum(v * v) AS total, ln(1 + avg(v * v)) AS log_energy FROM fe GROUP BY 1", digits=4)
def _(t):
    return S.summarise(t.fe, {"energy": F.avg(F.col("v") * F.col("v")), "total": F.sum(F.col("v") * F.col("v")), "log_energy": F.log1p(F.avg(F.col("v") * F.col("v")))})


@query("a12_line_length", "sequence_id", "line_length", f"WITH {_STEP} SELECT sequence_id, coalesce(sum(abs(step)), 0) AS line_length FROM d GROUP BY 1", digits=4)
def _(t):
    return S.summarise(S.lagged_steps(t.fe), {"line_length": F.coalesce(F.sum(F.abs("step")), F.lit(0.0))})


@query(
    "a13_hjorth", "sequence_id", "activity mobility complexity",
    f"WITH {_STEP}, e AS (SELECT *, step - lag(step) OVER (PARTITION BY sequence_id ORDER BY idx) AS step2 FROM d), h AS (SELECT sequence_id, var_pop(v) AS a, coalesce(var_pop(step), 0) AS b, coalesce(var_pop(step2), 0) AS c FROM e GROUP BY 1), k AS (SELECT *, coalesce(sqrt(b / nullif(a, 0)), 0) AS mob FROM h) SELECT sequence_id, a AS activity, mob AS mobility, coalesce(sqrt(c / nullif(b, 0)) / nullif(mob, 0), 0) AS complexity FROM k",
)
def _(t):
    df = S.lagged_steps(S.lagged_steps(t.fe), "step", "step2")
    h = S.summarise(df, {"activity": F.var_pop("v"), "b": F.coalesce(F.var_pop("step"), F.lit(0.0)), "c": F.coalesce(F.var_pop("step2"), F.lit(0.0))})
    h = h.withColumn("mobility", F.sqrt(S.ratio(F.col("b"), F.col("activity"))))
    return h.withColumn("complexity", S.ratio(F.sqrt(S.ratio(F.col("c"), F.col("b"))), F.col("mobility")))


@query(
    "a14_autocorrelation", "sequence_id", "r1 r2 r4 r8",
    "WITH " + "l AS (SELECT sequence_id, v, " + ", ".join(f"lag(v, {k}) OVER (PARTITION BY sequence_id ORDER BY idx) AS l{k}" for k in (1, 2, 4, 8)) + " FROM fe) SELECT sequence_id, " + ", ".join(
        f"coalesce(covar_pop(v, l{k}) / nullif(stddev_pop(v) FILTER (l{k} IS NOT NULL) * stddev_pop(l{k}), 0), 0) AS r{k}" for k in (1, 2, 4, 8)) + " FROM l GROUP BY 1",
)
def _(t):
    df = t.fe.select("sequence_id", "v", *(F.lag("v", k).over(S.by_time()).alias(f"l{k}") for k in (1, 2, 4, 8)))
    return S.summarise(df, {f"r{k}": S.safe_corr(F.col("v"), F.col(f"l{k}")) for k in (1, 2, 4, 8)})


_BINS = ", ".join(f"count(*) FILTER (b = {i})::DOUBLE / count(*) AS b{i}" for i in range(10))


@query(
    "a15_step_histogram", "sequence_id", " ".join(f"b{i}" for i in range(10)),
    f"WITH {_STEP}, e AS (SELECT *, min(step) OVER (PARTITION BY sequence_id) AS lo, max(step) OVER (PARTITION BY sequence_id) AS hi FROM d WHERE step IS NOT NULL), f AS (SELECT *, CASE WHEN hi = lo THEN 5 ELSE least(9, greatest(0, floor((step - lo) / (hi - lo) * 10)))::INT END AS b FROM e) SELECT sequence_id, {_BINS} FROM f GROUP BY 1",
)
def _(t):
    df = S.lagged_steps(t.fe).where("step IS NOT NULL").withColumns({"lo": F.min("step").over(S.whole()), "hi": F.max("step").over(S.whole())})
    df = df.withColumn("b", F.when(F.col("hi") == F.col("lo"), 5).otherwise(F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.try_divide(F.col("step") - F.col("lo"), F.col("hi") - F.col("lo")) * 10)))))
    return S.summarise(df, {f"b{i}": F.count_if(F.col("b") == i) / F.count("*") for i in range(10)})


@query(
    "a16_quantile_histogram", "sequence_id", " ".join(f"b{i}" for i in range(10)),
    f"WITH {_STEP}, e AS (SELECT sequence_id, quantile_cont(step, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q, min(step) AS lo, max(step) AS hi FROM d GROUP BY 1), f AS (SELECT d.sequence_id, CASE WHEN hi = lo THEN 5 ELSE len(list_filter(q, lambda x: x <= step)) END AS b FROM d JOIN e USING (sequence_id) WHERE step IS NOT NULL) SELECT sequence_id, {_BINS} FROM f GROUP BY 1",
)
def _(t):
    df = S.lagged_steps(t.fe).where("step IS NOT NULL AND sequence_id IS NOT NULL")
    df = S.with_quantiles(df, "step", tuple(i / 10 for i in range(1, 10)), ["sequence_id"], "q").withColumns({"lo": F.min("step").over(S.whole()), "hi": F.max("step").over(S.whole())})
    df = df.withColumn("b", F.when(F.col("hi") == F.col("lo"), 5).otherwise(F.size(F.filter("q", lambda x: x <= F.col("step")))))
    return S.summarise(df, {f"b{i}": F.count_if(F.col("b") == i) / F.count("*") for i in range(10)})


@query(
    "a17_jerk", "sequence_id", "mean_abs std max p90 rms",
    f"WITH {_STEP} SELECT sequence_id, avg(abs(step / 0.05)) AS mean_abs, stddev_pop(step / 0.05) AS std, max(abs(step / 0.05)) AS max, quantile_cont(abs(step / 0.05), 0.9) AS p90, sqrt(avg((step / 0.05) ** 2)) AS rms FROM d GROUP BY 1", digits=3,
)
def _(t):
    j = F.col("step") / 0.05
    return S.summarise(S.lagged_steps(t.fe), {"mean_abs": F.avg(F.abs(j)), "std": F.stddev_pop(j), "max": F.max(F.abs(j)), "p90": F.percentile(F.abs(j), F.lit(0.9)), "rms": F.sqrt(F.avg(j * j))})


@query(
    "a18_vector_jerk", "sequence_id", "mean std max l2",
    "WITH d AS (SELECT sequence_id, " + ", ".join(f"a{k} - lag(a{k}) OVER (PARTITION BY sequence_id ORDER BY idx) AS {k}" for k in "xyz") + " FROM fv), n AS (SELECT sequence_id, sqrt(x * x + y * y + z * z) AS j FROM d) SELECT sequence_id, coalesce(avg(j), 0) AS mean, coalesce(stddev_pop(j), 0) AS std, coalesce(max(j), 0) AS max, coalesce(sqrt(sum(j * j)), 0) AS l2 FROM n GROUP BY 1", digits=4,
)
def _(t):
    d = [F.col(f"a{k}") - F.lag(f"a{k}").over(S.by_time()) for k in "xyz"]
    df = t.fv.select("sequence_id", F.sqrt(sum(c * c for c in d)).alias("j"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return S.summarise(df, {"mean": zero(F.avg("j")), "std": zero(F.stddev_pop("j")), "max": zero(F.max("j")), "l2": zero(F.sqrt(F.sum(F.col("j") * F.col("j"))))})


@query(
    "a19_zero_crossings", "sequence_id", "rate centred_rate",
    "WITH c AS (SELECT sequence_id, idx, v, v - avg(v) OVER (PARTITION BY sequence_id) AS u FROM fe), s AS (SELECT sequence_id, sign(v) <> lag(sign(v)) OVER w AS x, sign(u) <> lag(sign(u)) OVER w AS y FROM c WINDOW w AS (PARTITION BY sequence_id ORDER BY idx)) SELECT sequence_id, count(*) FILTER (x)::DOUBLE / count(*) AS rate, count(*) FILTER (y)::DOUBLE / count(*) AS centred_rate FROM s GROUP BY 1",
)
def _(t):
    w = S.by_time()
    df = t.fe.withColumn("u", F.col("v") - F.avg("v").over(S.whole()))
    df = df.withColumns({k: F.signum(c) != F.lag(F.signum(c)).over(w) for k, c in (("x", "v"), ("y", "u"))})
    return S.summarise(df, {"rate": F.count_if("x") / F.count("*"), "centred_rate": F.count_if("y") / F.count("*")})


@query("a20_circular", "sequence_id", "angle concentration", "WITH a AS (SELECT sequence_id, atan2(ay, ax) AS x FROM fv) SELECT sequence_id, atan2(avg(sin(x)), avg(cos(x))) AS angle, sqrt(avg(sin(x)) ** 2 + avg(cos(x)) ** 2) AS concentration FROM a GROUP BY 1")
def _(t):
    df = t.fv.withColumn("x", F.atan2("ay", "ax"))
    s, c = F.avg(F.sin("x")), F.avg(F.cos("x"))
    return S.summarise(df, {"angle": F.atan2(s, c), "concentration": F.hypot(s, c)})


@query(
    "a21_pose", "sequence_id", "vertical_ratio tilt_mean tilt_std",
    "WITH a AS (SELECT *, acos(greatest(-1, least(1, az / greatest(sqrt(ax * ax + ay * ay + az * az), 1e-8)))) AS tilt FROM fv) SELECT sequence_id, var_pop(az) / greatest(var_pop(ax) + var_pop(ay), 1e-8) AS vertical_ratio, avg(tilt) AS tilt_mean, stddev_pop(tilt) AS tilt_std FROM a GROUP BY 1",
)
def _(t):
    norm = F.greatest(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2), F.lit(1e-8))
    df = t.fv.withColumn("tilt", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("az") / norm))))
    return S.summarise(df, {"vertical_ratio": F.var_pop("az") / F.greatest(F.var_pop("ax") + F.var_pop("ay"), F.lit(1e-8)), "tilt_mean": F.avg("tilt"), "tilt_std": F.stddev_pop("tilt")})


_SEG = "s AS (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n FROM fe), g AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE least(idx // greatest(n // 3, 1), 2) END AS seg FROM s)"


def _segment_sql() -> str:
    parts = [f"CASE WHEN max(n) < 9 THEN {f}(v) ELSE {f}(v) FILTER (seg = {i}) END AS {a}{i}" for i in range(3) for f, a in (("avg", "mean"), ("stddev_pop", "std"))]
    return f"WITH {_SEG}, h AS (SELECT sequence_id, max(n) AS n, {', '.join(parts)} FROM g GROUP BY 1) SELECT *, mean1 - mean0 AS step1, mean2 - mean1 AS step2 FROM h"


def segments(t):
    df = S.segment(t.fe, 3)
    short = F.max("n") < 9
    cols = {f"{a}{i}": F.when(short, f("v")).otherwise(f(F.when(F.col("seg") == i, F.col("v")))) for i in range(3) for f, a in ((F.avg, "mean"), (F.stddev_pop, "std"))}
    out = S.summarise(df, cols)
    return out.withColumns({"step1": F.col("mean1") - F.col("mean0"), "step2": F.col("mean2") - F.col("mean1")})


@query("a22_segments", "sequence_id", "mean0 std0 mean1 std1 mean2 std2 step1 step2", _segment_sql())
def _(t):
    return segments(t)


@query("a23_segment_variance_ratio", "sequence_id", "variance_ratio", f"WITH {_SEG}, h AS (SELECT sequence_id, " + ", ".join(f"CASE WHEN max(n) < 9 THEN var_pop(v) ELSE var_pop(v) FILTER (seg = {i}) END AS v{i}" for i in range(3)) + " FROM g GROUP BY 1) SELECT sequence_id, coalesce(greatest(v0, v1, v2) / nullif((v0 + v1 + v2) / 3, 0), 0) AS variance_ratio FROM h")
def _(t):
    s = [F.col(f"std{i}") ** 2 for i in range(3)]
    return segments(t).withColumn("variance_ratio", S.ratio(F.greatest(*s), (s[0] + s[1] + s[2]) / 3))


@query("a24_half_trend", "sequence_id", "half_trend", "WITH s AS (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n FROM fe) SELECT sequence_id, coalesce(avg(v) FILTER (idx >= n // 2) - avg(v) FILTER (idx < n // 2), 0) AS half_trend FROM s GROUP BY 1")
def _(t):
    df = t.fe.withColumn("late", F.col("idx") >= F.expr("count(*) over (partition by sequence_id) div 2"))
    return S.summarise(df, {"half_trend": F.coalesce(F.avg(F.when(F.col("late"), F.col("v"))) - F.avg(F.when(~F.col("late"), F.col("v"))), F.lit(0.0))})


@query("a25_axis_correlation", "sequence_id", "xy xz yz", f"SELECT sequence_id, {_corr_sql('ax', 'ay')} AS xy, {_corr_sql('ax', 'az')} AS xz, {_corr_sql('ay', 'az')} AS yz FROM fv GROUP BY 1")
def _(t):
    c = F.col
    return S.summarise(t.fv, {"xy": S.safe_corr(c("ax"), c("ay")), "xz": S.safe_corr(c("ax"), c("az")), "yz": S.safe_corr(c("ay"), c("az"))})


@query(
    "a26_cross_correlation", "sequence_id best_lag", "best",
    "WITH m AS (SELECT sequence_id, idx, ax - avg(ax) OVER (PARTITION BY sequence_id) AS a, ay - avg(ay) OVER (PARTITION BY sequence_id) AS b FROM fv), l AS (SELECT unnest(range(-5, 6)) AS lag), c AS (SELECT m.sequence_id, lag, sum(m.a * o.b) AS s FROM m, l, m AS o WHERE o.sequence_id = m.sequence_id AND o.idx = m.idx - lag GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY round(s, 4) DESC, lag) AS k FROM c) SELECT sequence_id, lag AS best_lag, s AS best FROM r WHERE k = 1", digits=3,
)
def _(t):
    m = t.fv.select("sequence_id", "idx", (F.col("ax") - F.avg("ax").over(S.whole())).alias("a"), (F.col("ay") - F.avg("ay").over(S.whole())).alias("b"))
    w = S.by_time()  # a bounded lag is a window look-up, not a join
    lags = {k: F.lag("b", k).over(w) if k >= 0 else F.lead("b", -k).over(w) for k in range(-5, 6)}
    df = m.select("sequence_id", "a", *(c.alias(f"b{k + 5}") for k, c in lags.items()))
    sums = df.groupBy("sequence_id").agg(F.array(*(F.struct(F.sum(F.col("a") * F.col(f"b{k + 5}")).alias("s"), F.lit(k).cast("long").alias("lag")) for k in lags)).alias("x"))
    best = F.array_max(F.transform(F.filter("x", lambda x: x["s"].isNotNull()), lambda x: F.struct(F.round(x["s"], 4).alias("r"), (-x["lag"]).alias("l"), x["s"].alias("s"))))
    return sums.select("sequence_id", best.alias("m")).select("sequence_id", (-F.col("m.l")).alias("best_lag"), F.col("m.s").alias("best"))


@query("a28_length", "sequence_id n_frames", "seconds", "SELECT sequence_id, count(*) AS n_frames, count(*) / 20.0 AS seconds FROM fe GROUP BY 1")
def _(t):
    return S.summarise(t.fe, {"n_frames": F.count("*"), "seconds": F.count("*") / 20})


@query(
    "a29_quality", "sequence_id longest_gap", "valid_ratio",
    "WITH i AS (SELECT *, g IS NULL AS gap, idx - row_number() OVER (PARTITION BY sequence_id, g IS NULL ORDER BY idx) AS isl FROM fe), r AS (SELECT sequence_id, gap, isl, count(*) AS n FROM i GROUP BY ALL), q AS (SELECT sequence_id, sum(n) FILTER (NOT gap) AS ok, sum(n) AS total, coalesce(max(n) FILTER (gap), 0) AS longest FROM r GROUP BY 1) SELECT sequence_id, longest::BIGINT AS longest_gap, coalesce(ok, 0) / total AS valid_ratio FROM q",
)
def _(t):
    islands = S.runs(t.fe.withColumn("gap", F.col("g").isNull()), "gap")
    return S.summarise(islands, {"longest_gap": F.coalesce(F.max(F.when(F.col("gap"), F.col("length"))), F.lit(0)), "valid_ratio": F.coalesce(F.sum(F.when(~F.col("gap"), F.col("length"))), F.lit(0)) / F.sum("length")})


@query(
    "a30_grid_valid_ratio", "sequence_id", "mean min p5 p50 p95 empty_share",
    "WITH f AS (SELECT sequence_id, sensor, idx, count(d)::DOUBLE / count(*) AS r FROM grid GROUP BY ALL) SELECT sequence_id, avg(r) AS mean, min(r) AS min, quantile_cont(r, 0.05) AS p5, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.95) AS p95, avg((r = 0)::INT) AS empty_share FROM f GROUP BY 1", digits=5,
)
def _(t):
    f = t.grid.groupBy("sequence_id", "sensor", "idx").agg((F.count("d") / F.count("*")).alias("r"))
    p = F.percentile("r", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return S.summarise(f, {"mean": F.avg("r"), "min": F.min("r"), "p5": p[0], "p50": p[1], "p95": p[2], "empty_share": F.avg((F.col("r") == 0).cast("int"))})


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "a31_profile", "feature n_missing n_distinct", "min max mean std",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std FROM lineitem" for c in _PROFILED), digits=4,
)
def _(t):
    one = t.table("lineitem").agg(*(F.struct((F.count("*") - F.count(c)).alias("n_missing"), F.countDistinct(c).alias("n_distinct"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in _PROFILED))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in _PROFILED))).alias("x")).select("x.feature", "x.s.*")


@query(
    "a32_describe", "column_name n", "mean std min q25 q50 q75 max",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM orders" for c in ("o_totalprice", "o_custkey")), digits=3,
)
def _(t):
    df = t.table("orders")
    cells = []
    for c in ("o_totalprice", "o_custkey"):
        q = zip(("q25", "q50", "q75"), S.table_quantiles(df, c, (0.25, 0.5, 0.75)))
        x = F.col(c).cast("double")
        cells.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *(F.lit(v).alias(k) for k, v in q), F.max(x).alias("max")))
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("a33_family_profile", "family", "mean std", "WITH p AS (SELECT 'amount' AS family, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem UNION ALL SELECT 'amount', avg(l_extendedprice), stddev_samp(l_extendedprice) FROM lineitem UNION ALL SELECT 'rate', avg(l_discount), stddev_samp(l_discount) FROM lineitem UNION ALL SELECT 'rate', avg(l_tax), stddev_samp(l_tax) FROM lineitem) SELECT family, avg(m) AS mean, avg(s) AS std FROM p GROUP BY 1", digits=4)
def _(t):
    long = t.table("lineitem").unpivot([], list(_PROFILED), "feature", "x").groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    return long.groupBy(F.when(F.col("feature").isin("l_quantity", "l_extendedprice"), "amount").otherwise("rate").alias("family")).agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


@query("a34_missing_percent", "sensor", "percent", "SELECT sensor, avg((d IS NULL)::INT) * 100 AS percent FROM grid GROUP BY 1")
def _(t):
    return t.grid.groupBy("sensor").agg((F.avg(F.col("d").isNull().cast("int")) * 100).alias("percent"))


@query("a35_sequence_missingness", "", "all_missing some_missing", "WITH s AS (SELECT sequence_id, bool_and(g IS NULL) AS a, bool_or(g IS NULL) AS b FROM fe GROUP BY 1) SELECT avg(a::INT) * 100 AS all_missing, avg((b AND NOT a)::INT) * 100 AS some_missing FROM s")
def _(t):
    s = S.summarise(t.fe, {"a": F.bool_and(F.col("g").isNull()), "b": F.bool_or(F.col("g").isNull())})
    return s.agg((F.avg(F.col("a").cast("int")) * 100).alias("all_missing"), (F.avg((F.col("b") & ~F.col("a")).cast("int")) * 100).alias("some_missing"))


@query("a36_lacking_modalities", "", "share", "WITH s AS (SELECT u.sequence_id, bool_and(o.o_orderkey IS NULL) AS lacks FROM (SELECT DISTINCT sequence_id FROM fe) AS u LEFT JOIN orders AS o ON o.o_custkey = u.sequence_id GROUP BY 1) SELECT avg(lacks::INT) AS share FROM s")
def _(t):
    users = t.fe.select("sequence_id").distinct()
    have = t.table("orders").select(F.col("o_custkey").alias("sequence_id")).distinct().withColumn("has", F.lit(1))
    return users.join(have, "sequence_id", "left").agg(F.avg(F.col("has").isNull().cast("int")).alias("share"))


@query("a37_duplicate_rows", "n_duplicates", "", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem)) AS n_duplicates FROM lineitem")
def _(t):
    kinds = t.table("lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity").count()
    return kinds.agg((F.sum("count") - F.count("*")).alias("n_duplicates"))


@query("a38_category_other", "category n", "", "WITH c AS (SELECT l_linenumber::VARCHAR AS k, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT k, n, n / sum(n) OVER () AS share FROM c) SELECT CASE WHEN share < 0.05 THEN 'Other' ELSE k END AS category, sum(n)::BIGINT AS n FROM s GROUP BY 1")
def _(t):
    return S.with_other(t.table("lineitem"), F.col("l_linenumber").cast("string"))


@query("a39_sequences_per_category", "phase n_sequences", "", "SELECT phase, count(DISTINCT sequence_id) AS n_sequences FROM fe GROUP BY 1")
def _(t):
    return t.fe.groupBy("phase").agg(F.countDistinct("sequence_id").alias("n_sequences"))


@query("a40_phase_pivot", "o_orderpriority n_f n_o n_p", "", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def _(t):
    p = t.table("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.withColumnsRenamed({"F": "n_f", "O": "n_o", "P": "n_p"})


@query("a41_unpivot", "l_orderkey feature", "x", "SELECT l_orderkey, feature, x FROM (SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE l_quantity > 45) UNPIVOT (x FOR feature IN (l_discount, l_tax))")
def _(t):
    return t.table("lineitem").where("l_quantity > 45").unpivot(["l_orderkey"], ["l_discount", "l_tax"], "feature", "x")


@query(
    "a42_cohort_metrics", "sequence_id cohort", "max_jerk phase_range peak_over_median",
    f"WITH {_STEP}, s AS (SELECT sequence_id, max(abs(step)) AS max_jerk, max(v) FILTER (phase = 'click') - min(v) FILTER (phase = 'click') AS phase_range, max(v) / nullif(median(v) FILTER (phase <> 'click'), 0) AS peak_over_median FROM d GROUP BY 1) SELECT sequence_id, coalesce(c_mktsegment, 'none') AS cohort, max_jerk, phase_range, peak_over_median FROM s LEFT JOIN customer ON c_custkey = sequence_id",
)
def _(t):
    click = F.col("phase") == "click"
    s = S.summarise(S.lagged_steps(t.fe), {"max_jerk": F.max(F.abs("step")), "phase_range": F.max(F.when(click, F.col("v"))) - F.min(F.when(click, F.col("v"))), "peak_over_median": F.try_divide(F.max(F.col("v")), F.percentile(F.when(~click, F.col("v")), F.lit(0.5)))})
    c = t.table("customer").select(F.col("c_custkey").alias("sequence_id"), "c_mktsegment")
    return s.join(c, "sequence_id", "left").withColumn("cohort", F.coalesce("c_mktsegment", F.lit("none")))


@query("a43_correlation_matrix", "a b", "r", " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, {_corr_sql(x, y)} AS r FROM lineitem" for i, x in enumerate(_PROFILED) for y in _PROFILED[i + 1 :]))
def _(t):
    pairs = [(x, y) for i, x in enumerate(_PROFILED) for y in _PROFILED[i + 1 :]]
    one = t.table("lineitem").agg(F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), S.safe_corr(F.col(x), F.col(y)).alias("r")) for x, y in pairs)).alias("m"))
    return one.select(F.explode("m").alias("p")).select("p.*")


@query("a44_fold_scaler_stats", "fold", "mean std", "WITH f AS (SELECT unnest(range(3)) AS fold) SELECT fold, avg(g) AS mean, stddev_pop(g) AS std FROM fe JOIN f ON fe.sequence_id % 3 <> f.fold GROUP BY 1")
def _(t):
    cols = [F.struct(F.lit(k).cast("long").alias("fold"), F.avg(F.when(F.col("sequence_id") % 3 != k, F.col("g"))).alias("mean"), F.stddev_pop(F.when(F.col("sequence_id") % 3 != k, F.col("g"))).alias("std")) for k in range(3)]
    return t.fe.agg(F.explode(F.array(*cols)).alias("x")).select("x.*")


@query("a45_length_percentiles", "p90 p95 shortest", "mean", "WITH n AS (SELECT count(*) AS n FROM fe GROUP BY sequence_id) SELECT floor(quantile_cont(n, 0.9))::BIGINT AS p90, floor(quantile_cont(n, 0.95))::BIGINT AS p95, min(n) AS shortest, avg(n) AS mean FROM n")
def _(t):
    n = S.summarise(t.fe, {"n": F.count("*")})
    p90, p95 = (math.floor(x) for x in S.table_quantiles(n, "n", (0.9, 0.95)))
    return n.agg(F.lit(p90).cast("long").alias("p90"), F.lit(p95).cast("long").alias("p95"), F.min("n").alias("shortest"), F.avg("n").alias("mean"))


@query("a46_class_weights", "phase", "weight", "WITH c AS (SELECT phase, count(*) AS n FROM fe GROUP BY 1) SELECT phase, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c")
def _(t):
    c = t.fe.groupBy("phase").agg(F.count("*").alias("n"))
    return c.crossJoin(c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))).withColumn("weight", F.col("total") / (F.col("k") * F.col("n")))


@query("a47_label_distribution", "phase n", "", "SELECT phase, count(*) AS n FROM fe GROUP BY 1")
def _(t):
    return t.fe.groupBy("phase").agg(F.count("*").alias("n"))


@query("a48_sequence_constant", "sequence_id phase", "", "SELECT sequence_id, arg_min(phase, idx) AS phase FROM fe GROUP BY 1")
def _(t):
    return S.summarise(t.fe, {"phase": F.min_by("phase", "idx")})


@query("a49_mean_importance", "feature place", "importance", "WITH i AS (SELECT l_returnflag || l_linestatus AS feature, l_linenumber AS model, avg(l_discount) AS x FROM lineitem GROUP BY ALL), m AS (SELECT feature, avg(x) AS importance FROM i GROUP BY 1) SELECT feature, row_number() OVER (ORDER BY round(importance, 9) DESC, feature) AS place, importance FROM m")
def _(t):
    i = t.table("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("feature"), "l_linenumber").agg(F.avg("l_discount").alias("x"))
    m = i.groupBy("feature").agg(F.avg("x").alias("importance"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.round("importance", 9).desc(), "feature")).cast("long"))  # a row per feature


@query("a50_fold_scores", "n_folds", "mean std", "WITH s AS (SELECT l_linenumber AS fold, avg(l_discount) AS score FROM lineitem GROUP BY 1) SELECT count(*) AS n_folds, avg(score) AS mean, stddev_pop(score) AS std FROM s")
def _(t):
    s = t.table("lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("score"))
    return s.agg(F.count("*").alias("n_folds"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
