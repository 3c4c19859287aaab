"""Queries: recursions (N03, W18, Q16), further grid and thermal features (G), sampling and routed models (M), sinks (S)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqspark.operators import clean as C
from seqspark.operators import ensemble as E
from seqspark.operators import kernels as K
from seqspark.operators import stats as S
from seqspark.plans.q_clean import _gappy, shared_folder
from seqspark.plans.registry import query


@query("n03_quaternion_repair", "sequence_id idx", "qw qx qy qz")
def _(t):
    return K.repaired(_gappy(t))


@query("w18_prominent_peaks", "sequence_id n_peaks", "height spacing")
def _(t):
    return K.peak_features(t.fe)


@query("q16_wavelet", "sequence_id level", "energy std mean share")
def _(t):
    return K.wavelet_features(t.fe)


_NUMERIC = ("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


@query("p07_numeric_columns", "feature n", "mean", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean FROM lineitem" for c in _NUMERIC), digits=4)
def _(t):
    """Numbers, but for keys by prefix and one column by name."""
    df = t.table("lineitem")
    names = C.numeric_columns(df, prefixes=("l_order", "L_PART"), excluded=("l_tax",))
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean")) for c in names)).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


_TYPED = "CASE typeof(max({0})) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE typeof(max({0})) END"


@query("j03_profile", "feature n_missing n_distinct dtype", "", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, {_TYPED.format(c)} AS dtype FROM orders" for c in ("o_orderstatus", "o_custkey", "o_totalprice")))
def _(t):
    df = t.table("orders").select("o_orderstatus", "o_custkey", "o_totalprice")
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("feature"), (F.count("*") - F.count(c)).alias("n_missing"), F.countDistinct(c).alias("n_distinct"), F.lit(k).alias("dtype")) for c, k in df.dtypes)).alias("p"))
    return one.select(F.explode("p").alias("x")).select("x.*")


_SERIES = "f AS (SELECT sequence_id, sensor, idx, avg(d) AS m FROM grid GROUP BY 1, 2, 3), s AS (SELECT *, m - lag(m) OVER o AS d1, m - 2 * lag(m) OVER o + lag(m, 2) OVER o AS d2 FROM f WINDOW o AS (PARTITION BY sequence_id, sensor ORDER BY idx))"


def _frame_series(t):
    w = Window.partitionBy("sequence_id", "sensor").orderBy("idx")
    f = t.grid.groupBy("sequence_id", "sensor", "idx").agg(F.avg("d").alias("m"))
    return f.withColumns({"d1": F.col("m") - F.lag("m").over(w), "d2": F.col("m") - 2 * F.lag("m").over(w) + F.lag("m", 2).over(w)})


@query("g23_thermal_series", "sequence_id sensor", "mean std step_mean step_std slope bend", f"WITH {_SERIES} SELECT sequence_id, sensor, avg(m) AS mean, stddev_pop(m) AS std, avg(d1) AS step_mean, stddev_pop(d1) AS step_std, regr_slope(m, idx) AS slope, avg(abs(d2)) AS bend FROM s GROUP BY 1, 2", digits=5)
def _(t):
    return _frame_series(t).groupBy("sequence_id", "sensor").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.avg("d1").alias("step_mean"), F.stddev_pop("d1").alias("step_std"), F.regr_slope("m", "idx").alias("slope"), F.avg(F.abs("d2")).alias("bend"))


@query("g24_thermal_events", "sequence_id sensor", "rate spread", f"WITH {_SERIES}, q AS (SELECT *, quantile_cont(abs(d1), 0.75) OVER (PARTITION BY sequence_id, sensor) AS lim FROM s) SELECT sequence_id, sensor, (count(*) FILTER (abs(d1) > lim))::DOUBLE / count(*) AS rate, quantile_cont(m, 0.9) - quantile_cont(m, 0.1) AS spread FROM q GROUP BY 1, 2", digits=5)
def _(t):
    q = S.with_quantiles(_frame_series(t).withColumn("step", F.abs("d1")), "step", (0.75,), ["sequence_id", "sensor"], "q").withColumn("lim", F.col("q")[0])
    p = F.percentile("m", F.array(F.lit(0.1), F.lit(0.9)))
    return q.groupBy("sequence_id", "sensor").agg((F.count_if(F.abs("d1") > F.col("lim")) / F.count("*")).alias("rate"), (p[1] - p[0]).alias("spread"))


@query("g26_cross_modal_sync", "sequence_id sensor other", "sync r", f"WITH {_SERIES}, l AS (SELECT sequence_id, idx, sensor, m, coalesce(abs(d1) > quantile_cont(abs(d1), 0.75) OVER (PARTITION BY sequence_id, sensor), false) AS moved FROM s) SELECT a.sequence_id, a.sensor, b.sensor AS other, avg((a.moved AND b.moved)::INT) AS sync, coalesce(covar_pop(a.m, b.m) / nullif(stddev_pop(a.m) * stddev_pop(b.m), 0), 0) AS r FROM l AS a JOIN l AS b USING (sequence_id, idx) WHERE a.sensor < b.sensor GROUP BY 1, 2, 3", digits=5)
def _(t):
    """Every pair of sensors: how often both make a large step, and the correlation of their means."""
    p = _frame_series(t).select("sequence_id", "idx", "sensor", "m", F.abs("d1").alias("step"))
    p = S.with_quantiles(p, "step", (0.75,), ["sequence_id", "sensor"], "q")
    p = p.withColumn("moved", F.coalesce(F.col("step") > F.col("q")[0], F.lit(False)))
    frames = p.groupBy("sequence_id", "idx").agg(F.collect_list(F.struct("sensor", "m", "moved")).alias("s"))  # as many as there are sensors
    pairs = frames.select("sequence_id", F.explode("s").alias("x"), "s").select("sequence_id", "x", F.explode("s").alias("y")).where("x.sensor < y.sensor")
    both = (F.col("x.moved") & F.col("y.moved")).cast("int")
    return pairs.groupBy("sequence_id", F.col("x.sensor").alias("sensor"), F.col("y.sensor").alias("other")).agg(F.avg(both).alias("sync"), S.safe_corr(F.col("x.m"), F.col("y.m")).alias("r"))


_DRAWN = "('0x' || substr(md5('{0}:' || {1}), 1, 8))::BIGINT / 4294967296.0"


@query(
    "m10_oversample", "vec_id neighbour label", "x0 x1 x2 total",
    "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), r AS (SELECT label, count(*) AS n FROM e GROUP BY 1 ORDER BY n, label LIMIT 3), "
    "d AS (SELECT a.vec_id, b.vec_id AS neighbour, a.label, a.x AS p, b.x AS q, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) ** 2)), b.vec_id) AS k FROM e AS a JOIN r USING (label) JOIN e AS b ON b.label = a.label AND b.vec_id <> a.vec_id), "
    f"o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY {_DRAWN.format(3, 'vec_id || chr(58) || neighbour')}) AS pick, {_DRAWN.format(4, 'vec_id')} AS lam FROM d WHERE k <= 3), "
    "z AS (SELECT vec_id, neighbour, label, list_transform(list_zip(p, q), lambda z: z[1] + (z[2] - z[1]) * lam) AS point FROM o WHERE pick = 1) SELECT vec_id, neighbour, label::BIGINT AS label, point[1] AS x0, point[2] AS x1, point[3] AS x2, list_sum(point) AS total FROM z",
)
def _(t):
    """For each row of a rare class, a point between it and one of its three nearest rows of the class, over all numbers of the embedding."""
    e = t.table("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rare = e.groupBy("label").agg(F.count("*").alias("n")).orderBy("n", "label").limit(3)
    best = C.nearest_of_class(e.join(rare, "label"), 3)
    pick = best.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(C.draw(3, "vec_id", "neighbour")))).where("r = 1")
    pick = pick.join(e.select("vec_id", "x"), "vec_id").join(e.select(F.col("vec_id").alias("neighbour"), F.col("x").alias("y")), "neighbour")
    lam = C.draw(4, "vec_id")
    z = pick.withColumn("point", F.zip_with("x", "y", lambda p, q: p + (q - p) * lam))
    return z.select("vec_id", "neighbour", F.col("label").cast("long").alias("label"), E.total(F.col("point")).alias("total"), *(F.col("point")[i].alias(f"x{i}") for i in range(3)))


@query("m12_two_stage", "vec_id label predicted", "gate")
def _(t):
    """A binary model routes each row to a model of the target classes (0-3) or of the others."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = t.table("embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    fit = lambda df, label: RandomForestClassifier(numTrees=10, maxDepth=4, seed=3, labelCol=label).fit(df)
    train = rows.where("vec_id % 2 = 0").withColumns({"target": F.when(F.col("label") < 4, 1.0).otherwise(0.0), "other": F.col("label") - 4})
    gate, near, far = fit(train, "target"), fit(train.where("label < 4"), "label"), fit(train.where("label >= 4"), "other")
    out = rows.where("vec_id % 2 = 1")
    for model, name in ((gate, "g"), (near, "n"), (far, "f")):
        done = model.transform(out)
        out = done.withColumn(name, vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
    routed = F.when(F.col("g")[1] > 0.5, E.argmax(F.col("n"))).otherwise(E.argmax(F.col("f")) + 4)
    return out.select("vec_id", F.col("label").cast("long").alias("label"), routed.alias("predicted"), F.col("g")[1].alias("gate"))


@query("s06_feature_import", "n_rows n_labels", "", "SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM embeddings")
def _(t):
    """Written features read back, with a check that rows and labels are all there."""
    path = f"{shared_folder(t)}/features-{uuid.uuid4().hex}"
    rows = t.table("embeddings").select("vec_id", "label")
    rows.write.parquet(path)
    back = t.spark.read.schema(rows.schema).parquet(path).agg(F.count("*").alias("n_rows"), F.countDistinct("label").alias("n_labels"))
    if back.head()["n_labels"] < 1:
        raise ValueError("the features have no labels")
    return back


@query("s08_prediction_sink", "sequence_id phase", "", "SELECT sequence_id, arg_min(phase, idx) AS phase FROM fe GROUP BY 1")
def _(t):
    """One prediction per sequence, checked before it is written."""
    said = S.summarise(t.fe, {"phase": F.min_by("phase", "idx")})
    n = said.agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("k"), F.count_if(F.col("phase").isNull()).alias("gone")).head()
    if n["n"] != n["k"] or n["gone"]:
        raise ValueError("predictions are repeated or missing")
    path = f"{shared_folder(t)}/predictions-{uuid.uuid4().hex}"
    said.write.parquet(path)
    return t.spark.read.schema(said.schema).parquet(path)
