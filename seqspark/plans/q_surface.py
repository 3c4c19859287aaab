"""Queries: the user's surface (D), scoring (M32, S13), bundles of features (A51, G16, G18, G28, G29) and late frames (X02)."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqspark.functions import features as U
from seqspark.functions import scoring as Z
from seqspark.operators import channels as H
from seqspark.operators import grid as G
from seqspark.operators import stats as S
from seqspark.plans.q_clean import shared_folder
from seqspark.plans.q_signals import _WORLD, _velocity_sql
from seqspark.plans.registry import query
from seqspark.streaming import frames as X

BY = "PARTITION BY sequence_id ORDER BY idx"


def _turns(v: pd.Series) -> dict:
    step = v.diff().dropna()
    return {"energy": float((v**2).sum()), "rises": int((step > 0).sum()), "reach": float(v.max() - v.min())}


@query("d02_series_function", "sequence_id rises", "energy reach", f"WITH d AS (SELECT sequence_id, v, v - lag(v) OVER ({BY}) AS st FROM fe) SELECT sequence_id, sum(v * v) AS energy, count(*) FILTER (st > 0) AS rises, max(v) - min(v) AS reach FROM d GROUP BY 1", digits=4)
def _(t):
    U.register_series_feature("turns", _turns, "energy double, rises long, reach double")
    return U.series_feature(t.fe, "turns")


@query("d03_named_statistics", "sequence_id", "ax_mean ax_std ax_iqr ay_mean ay_std ay_iqr", "SELECT sequence_id, " + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr" for c in ("ax", "ay")) + " FROM fv GROUP BY 1", digits=5)
def _(t):
    return U.statistics(t.fv, ["ax", "ay"], ["mean", "std", "iqr"])


@query("d04_feature_families", "sequence_id n", "mean std var min max range step_mean step_std line_length first last", f"WITH d AS (SELECT *, v - lag(v) OVER ({BY}) AS st FROM fe) SELECT sequence_id, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, var_pop(v) AS var, min(v) AS min, max(v) AS max, max(v) - min(v) AS range, coalesce(avg(st), 0) AS step_mean, coalesce(stddev_pop(st), 0) AS step_std, coalesce(sum(abs(st)), 0) AS line_length, arg_min(v, idx) AS first, arg_max(v, idx) AS last FROM d GROUP BY 1", digits=4)
def _(t):
    return U.FeatureSpec.of({"quantiles": {"enabled": False}, "steps": {"enabled": True}, "ends": True}).apply(t.fe)


@query("d05_user_aggregate", "sequence_id", "trimmed", "SELECT sequence_id, (sum(v) - min(v) - max(v)) / (count(*) - 2) AS trimmed FROM fe GROUP BY 1 HAVING count(*) > 2")
def _(t):
    trimmed = U.user_aggregate(lambda v: float((v.sum() - v.min() - v.max()) / (len(v) - 2)) if len(v) > 2 else None)
    return t.fe.groupBy("sequence_id").agg(trimmed("v").alias("trimmed")).where("trimmed IS NOT NULL")


_IN_WINDOW = (
    "w AS (SELECT f.sequence_id, b.begin, f.idx, f.c FROM (SELECT sequence_id, idx, v - 50 AS c, count(*) OVER (PARTITION BY sequence_id) AS n FROM fe) AS f JOIN (SELECT range * 10 AS begin FROM range(100)) AS b ON f.idx >= b.begin AND f.idx < b.begin + 20 AND b.begin < f.n - 20), "
    "s AS (SELECT *, avg(c) OVER p AS mu, stddev_pop(c) OVER p AS sd, lag(c) OVER o AS prev, row_number() OVER o AS pos FROM w WINDOW p AS (PARTITION BY sequence_id, begin), o AS (PARTITION BY sequence_id, begin ORDER BY idx)), "
    "r AS (SELECT *, sum(CASE WHEN c = prev THEN 0 ELSE 1 END) OVER (PARTITION BY sequence_id, begin ORDER BY idx) AS run FROM s), "
    "u AS (SELECT sequence_id, begin, run, any_value(c) AS c FROM r GROUP BY 1, 2, 3), pk AS (SELECT sequence_id, begin, count(*) FILTER (c > a AND c > z) AS n_peaks FROM (SELECT *, lag(c) OVER q AS a, lead(c) OVER q AS z FROM u WINDOW q AS (PARTITION BY sequence_id, begin ORDER BY run)) AS x GROUP BY 1, 2)"
)


@query(
    "a51_window_summaries", "sequence_id begin zero_crossings n_peaks", "mean std max min range q25 median q75 skew kurt",
    f"WITH {_IN_WINDOW} SELECT r.sequence_id, r.begin, sum((prev IS NOT NULL AND sign(c) <> sign(prev))::INT)::BIGINT AS zero_crossings, any_value(n_peaks) AS n_peaks, avg(c) AS mean, stddev_pop(c) AS std, max(c) AS max, min(c) AS min, max(c) - min(c) AS range, quantile_cont(c, 0.25) AS q25, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.75) AS q75, avg((c - mu) ** 3) / any_value(sd) ** 3 AS skew, avg((c - mu) ** 4) / any_value(sd) ** 4 - 3 AS kurt FROM r JOIN pk USING (sequence_id, begin) GROUP BY 1, 2", digits=4,
)
def _(t):
    return U.window_summaries(t.fe.withColumn("c", F.col("v") - 50), 20, 10, "c")


_BUNDLE = (
    "m AS (SELECT sequence_id, idx, sensor, avg(d) AS m FROM grid GROUP BY 1, 2, 3), e AS (SELECT sequence_id, sensor, 'mean' AS series, idx, m AS v FROM m UNION ALL SELECT sequence_id, sensor, 'step', idx, m - lag(m) OVER (PARTITION BY sequence_id, sensor ORDER BY idx) FROM m), "
    "x AS (SELECT sequence_id, sensor, series, row_number() OVER k - 1 AS i, v, count(*) OVER (PARTITION BY sequence_id, sensor, series) AS n, avg(v) OVER (PARTITION BY sequence_id, sensor, series) AS mu, lag(v) OVER k AS prev, lead(v) OVER k AS nxt FROM e WHERE v IS NOT NULL WINDOW k AS (PARTITION BY sequence_id, sensor, series ORDER BY idx)), "
    "f AS (SELECT sequence_id, sensor, series, k, any_value(n) AS n, sum(v * cos(2 * pi() * k * i / n)) ** 2 + sum(v * sin(2 * pi() * k * i / n)) ** 2 AS power FROM x JOIN (SELECT range AS k FROM range(1, 40)) AS ks ON k <= n // 2 GROUP BY 1, 2, 3, 4), "
    "p AS (SELECT sequence_id, sensor, series, sum(power) AS power, sum(k * 20.0 / n * power) / sum(power) AS centroid FROM f GROUP BY 1, 2, 3)"
)


@query(
    "g18_series_summary", "sequence_id sensor series n n_peaks", "mean std median autocorr1 peak_mean power centroid",
    f"WITH {_BUNDLE} SELECT x.sequence_id, x.sensor, x.series, count(*) AS n, count(*) FILTER (v > prev AND v > nxt) AS n_peaks, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.5) AS median, sum((v - mu) * (prev - mu)) / sum((v - mu) ** 2) AS autocorr1, coalesce(avg(v) FILTER (v > prev AND v > nxt), 0) AS peak_mean, any_value(p.power) AS power, any_value(p.centroid) AS centroid FROM x JOIN p USING (sequence_id, sensor, series) GROUP BY 1, 2, 3", digits=3,
)
def _(t):
    w = Window.partitionBy("sequence_id", "sensor").orderBy("idx")
    m = G.per_frame(t.grid, {"m": F.avg("d")}).withColumn("st", F.col("m") - F.lag("m").over(w))
    long = m.select("sequence_id", "sensor", "idx", F.explode(F.array(F.struct(F.lit("mean").alias("series"), F.col("m").alias("v")), F.struct(F.lit("step").alias("series"), F.col("st").alias("v")))).alias("x")).select("sequence_id", "sensor", "idx", "x.*")
    return U.series_summary(long, keys=("sequence_id", "sensor", "series"))


@query("g16_pixel_names", "kind row col n", "total", "WITH p AS (SELECT pixel // 8 AS row, pixel % 8 AS col, d FROM grid) SELECT 'px' AS kind, row, col, count(d) AS n, sum(d) AS total FROM p GROUP BY 2, 3 UNION ALL SELECT 'rc', row, col, count(d), sum(d) FROM p GROUP BY 2, 3", digits=2)
def _(t):
    """The same frames as two wide tables that name their pixels in different ways."""
    e = t.table("embeddings")
    d = [F.when(F.col("embedding")[i] >= 0, F.col("embedding")[i].cast("double") * 254) for i in range(64)]
    px = G.long_frames(e.select("vec_id", *(d[i].alias(f"tof_1_px{i}") for i in range(64))), ["vec_id"]).withColumn("kind", F.lit("px"))
    rc = G.long_frames(e.select("vec_id", *(d[i].alias(f"tof_r{i // 8}_c{i % 8}") for i in range(64))), ["vec_id"]).withColumn("kind", F.lit("rc"))
    return px.unionByName(rc).groupBy("kind", "row", "col").agg(F.count("d").alias("n"), F.sum("d").alias("total"))


_OMEGA = f"om AS (SELECT * FROM ({_velocity_sql('world')}) AS x)"
_TOF = "to0 AS (SELECT sequence_id, idx, coalesce(avg(d), 0) AS tof_mean, coalesce(stddev_pop(d), 0) AS tof_std, coalesce(min(d), 0) AS tof_min, coalesce(max(d), 0) AS tof_max, count(d)::DOUBLE / count(*) AS tof_valid_ratio FROM grid GROUP BY 1, 2), th0 AS (SELECT sequence_id, idx, coalesce(avg(d), 0) AS thm_mean, coalesce(stddev_pop(d), 0) AS thm_std, coalesce(min(d), 0) AS thm_min, coalesce(max(d), 0) AS thm_max, count(d)::DOUBLE / count(*) AS thm_valid_ratio FROM grid WHERE pixel = 0 GROUP BY 1, 2)"


@query(
    "g28_frame_channels", "sequence_id idx", " ".join(H.CHANNELS_18),
    f"WITH {_WORLD}, {_OMEGA}, {_TOF} SELECT w0.sequence_id, w0.idx, wx AS linear_acc_x, wy AS linear_acc_y, wz - 9.81 AS linear_acc_z, ox AS omega_x, oy AS omega_y, oz AS omega_z, sqrt(wx * wx + wy * wy + (wz - 9.81) ** 2) AS linear_acc_mag, sqrt(ox * ox + oy * oy + oz * oz) AS omega_mag, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in H.CHANNELS_18[8:]) + " FROM w0 JOIN om USING (sequence_id, idx) LEFT JOIN to0 USING (sequence_id, idx) LEFT JOIN th0 USING (sequence_id, idx)", digits=4, materialised=True,
)
def _(t):
    """Gravity by subtraction here, so that SQL can follow; the operator's default is the low-pass split."""
    return H.frame_channels(t.fv, t.grid, t.grid.where("pixel = 0"), method="subtract")


_BODY = f"om AS (SELECT * FROM ({_velocity_sql('body')}) AS x)"
_IMU = (
    "i0 AS (SELECT sequence_id, idx, ax - (2 * (qx * qz - qw * qy)) * 9.81 AS linear_acc_x, ay - (2 * (qy * qz + qw * qx)) * 9.81 AS linear_acc_y, az - (1 - 2 * (qx * qx + qy * qy)) * 9.81 AS linear_acc_z, qx AS rot_x, qy AS rot_y, qz AS rot_z, sqrt(ax * ax + ay * ay + az * az) AS acc_mag, 2 * acos(greatest(-1, least(1, qw))) AS rot_angle FROM fv), "
    "i1 AS (SELECT *, sqrt(linear_acc_x ** 2 + linear_acc_y ** 2 + linear_acc_z ** 2) AS linear_acc_mag FROM i0), "
    f"i2 AS (SELECT *, coalesce(acc_mag - lag(acc_mag) OVER ({BY}), 0) AS acc_mag_jerk, coalesce(linear_acc_mag - lag(linear_acc_mag) OVER ({BY}), 0) AS linear_acc_mag_jerk, coalesce(rot_angle - lag(rot_angle) OVER ({BY}), 0) AS rot_angle_vel FROM i1)"
)
_SENSORS = "se AS (SELECT sequence_id, idx, " + ", ".join(f"avg(d) FILTER (sensor = {k}) AS tof_{k}_mean, stddev_samp(d) FILTER (sensor = {k}) AS tof_{k}_std, min(d) FILTER (sensor = {k}) AS tof_{k}_min, max(d) FILTER (sensor = {k}) AS tof_{k}_max, max(d) FILTER (sensor = {k} AND pixel = 0) AS thm_{k}" for k in range(1, 6)) + " FROM grid GROUP BY 1, 2)"


@query(
    "g29_wide_channels", "sequence_id idx", " ".join(H.CHANNELS_41),
    f"WITH {_BODY}, {_IMU}, {_SENSORS} SELECT i2.sequence_id, i2.idx, {', '.join(c for c in H.CHANNELS_41[:12])}, ox AS omega_x, oy AS omega_y, oz AS omega_z, sqrt(ox * ox + oy * oy + oz * oz) AS omega_mag, {', '.join(f'coalesce({c}, 0) AS {c}' for c in H.CHANNELS_41[16:])} FROM i2 JOIN om USING (sequence_id, idx) LEFT JOIN se USING (sequence_id, idx)", digits=4,
)
def _(t):
    return H.wide_channels(t.fv, t.grid, t.grid.where("pixel = 0"))


_LINEAR = {"low": (-0.2, 0.3, 0.1), "mid": (0.1, -0.1, 0.05), "high": (0.15, 0.1, -0.02)}


@query(
    "m32_batch_scoring", "sequence_id predicted", "",
    "WITH f AS (SELECT sequence_id, avg(v) AS a, stddev_pop(v) AS b, max(v) AS c FROM fe GROUP BY 1), s AS (SELECT sequence_id, " + ", ".join(f"a * {w[0]} + b * {w[1]} + c * {w[2]} AS {k}" for k, w in _LINEAR.items()) + " FROM f) SELECT sequence_id, CASE WHEN low >= mid AND low >= high THEN 'low' WHEN mid >= high THEN 'mid' ELSE 'high' END AS predicted FROM s",
)
def _(t):
    """All sequences in one job, by a model of the user's own that each worker loads once."""
    rows = S.summarise(t.fe, {"a": F.avg("v"), "b": F.stddev_pop("v"), "c": F.max("v")})

    def load():
        names = list(_LINEAR)
        weights = pd.DataFrame(_LINEAR, index=["a", "b", "c"])
        return lambda x: pd.Series([names[k] for k in (x[["a", "b", "c"]].to_numpy() @ weights.to_numpy()).argmax(1)])

    return Z.score_with(rows, load)


def fold_models(rows, features, label, folds, fit):
    """(model, score) of every fold: fitted on the other folds, scored by its accuracy on its own."""
    out = []
    for k in range(folds):
        model = fit(rows.where(F.col("fold") != k))
        hits = model.transform(rows.where(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).head()[0]
        out.append((model, hits or 0.0))
    return out


@query("s13_model_bundle", "sequence_id class name")
def _(t):
    """Models of three folds, written as a bundle, read back, and applied to rows that lack one of the features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    features = ["mean", "std", "max", "n"]
    rows = S.summarise(t.fe, {"mean": F.avg("v"), "std": F.stddev_pop("v"), "max": F.max("v"), "n": F.count("*").cast("double"), "label": (F.sum("v") > 3000).cast("double")}).withColumn("fold", F.col("sequence_id") % 3)
    steps = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=4, seed=5)])
    found = fold_models(rows, features, "label", 3, steps.fit)
    path = f"{shared_folder(t)}/bundle-{uuid.uuid4().hex}"
    Z.save_bundle(t.spark, Z.Bundle.of([m for m, _ in found], features, [s for _, s in found], ["small", "large"]), path)
    return Z.score(rows.drop("max"), Z.load_bundle(t.spark, path))


@query("x02_late_frames", "sequence_id n n_late complete", "", "WITH a AS (SELECT user_id AS sequence_id, event_id, epoch_us(ts) AS moment, max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT sequence_id, count(*) FILTER (seen IS NULL OR moment >= seen - 86400000000) AS n, count(*) FILTER (moment < seen - 86400000000) AS n_late, max(event_id) >= 5000 AS complete FROM a GROUP BY 1")
def _(t):
    """Frames in order of arrival; later than a day behind the newest of their sequence they are dropped and counted."""
    arrived = t.table("events").select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("arrival"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") >= 5000).alias("last"))
    return X.completeness(arrived, 86_400_000_000)
