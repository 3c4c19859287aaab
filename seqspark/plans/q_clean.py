"""Queries: projections and predicates (P), missing values (N), joins (J), sources and sinks (S)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqspark.operators import clean as C
from seqspark.operators import joins as J
from seqspark.operators import stats as S
from seqspark.plans.registry import query
from seqspark.sources import frames as R
from seqspark.sources.shared import shared_dir

OVER = "OVER (PARTITION BY sequence_id ORDER BY idx)"
LINE = "l_orderkey l_linenumber"


def shared_folder(t) -> str:
    """Where all executors may write."""
    return shared_dir(t.spark)


@query("p01_prefix_family", "l_orderkey", "l_discount", "SELECT l_orderkey, l_discount FROM lineitem")
def _(t):
    df = t.table("lineitem")
    return df.select(*C.family(df.columns, ("L_ORDER", "l_disc")))


@query("p03_presence_flags", "sequence_id has_gaps has_clicks", "", "SELECT sequence_id, max(CASE WHEN g IS NULL THEN 1 ELSE 0 END) AS has_gaps, max(CASE WHEN phase = 'click' THEN 1 ELSE 0 END) AS has_clicks FROM fe GROUP BY 1")
def _(t):
    return S.summarise(t.fe, {"has_gaps": F.max(F.when(F.col("g").isNull(), 1).otherwise(0)), "has_clicks": F.max(F.when(F.col("phase") == "click", 1).otherwise(0))})


@query("p04_filter", "event_id", "value", "SELECT event_id, value FROM events WHERE event_type = 'click'")
def _(t):
    return t.table("events").where("event_type = 'click'").select("event_id", "value")


@query("p05_phase_filter", "event_id", "", "SELECT event_id FROM events WHERE event_type = 'view'")
def _(t):
    df = t.table("events")
    return (df.where("event_type = 'view'") if "event_type" in df.columns else df).select("event_id")


@query("p06_membership", "o_orderkey", "", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    ids = t.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.table("orders").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("p08_magnitude", "sequence_id idx", "mag", "SELECT sequence_id, idx, sqrt(ax * ax + ay * ay + az * az) AS mag FROM fv")
def _(t):
    return t.fv.withColumn("mag", F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2))


@query("p09_magnitude_difference", "sequence_id idx", "diff", "SELECT sequence_id, idx, sqrt(ax * ax + ay * ay + az * az) - sqrt(ax * ax + ay * ay) AS diff FROM fv")
def _(t):
    planar = F.col("ax") ** 2 + F.col("ay") ** 2
    return t.fv.withColumn("diff", F.sqrt(planar + F.col("az") ** 2) - F.sqrt(planar))


@query("p10_rotation_angle", "sequence_id idx", "angle", "SELECT sequence_id, idx, 2 * acos(greatest(-1, least(1, qw))) AS angle FROM fv")
def _(t):
    return t.fv.withColumn("angle", 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("qw")))))


@query("p11_pair_differences", "sequence_id idx", "xy xz yz", "SELECT sequence_id, idx, ax - ay AS xy, ax - az AS xz, ay - az AS yz FROM fv")
def _(t):
    return t.fv.withColumns({a + b: F.col(f"a{a}") - F.col(f"a{b}") for a, b in ("xy", "xz", "yz")})


@query("p12_planar_angle", "sequence_id", "angle energy log_energy", "SELECT sequence_id, avg(atan2(ay, ax)) AS angle, avg(ax * ax + ay * ay) AS energy, ln(1 + avg(ax * ax + ay * ay)) AS log_energy FROM fv GROUP BY 1", digits=4)
def _(t):
    e = F.avg(F.col("ax") ** 2 + F.col("ay") ** 2)
    return S.summarise(t.fv, {"angle": F.avg(F.atan2("ay", "ax")), "energy": e, "log_energy": F.log1p(e)})


@query("p13_rotation_energy", "sequence_id idx", "energy total", "SELECT sequence_id, idx, sqrt(qx * qx + qy * qy + qz * qz) AS energy, qw * qw + qx * qx + qy * qy + qz * qz AS total FROM fv")
def _(t):
    v = F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2
    return t.fv.withColumns({"energy": F.sqrt(v), "total": F.col("qw") ** 2 + v})


@query("p14_label_map", "event_id class_id", "", "SELECT event_id, class_id FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS class_id FROM (SELECT DISTINCT event_type FROM events)) AS c USING (event_type)")
def _(t):
    kinds = t.table("events").select("event_type").distinct()
    classes = kinds.withColumn("class_id", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))  # a row per class
    return t.table("events").join(classes, "event_type")


@query("p15_label_encoding", "event_type code", "", "SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def _(t):
    kinds = t.table("events").select("event_type").distinct()
    return kinds.withColumn("code", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("long"))


@query("p16_binarise", "vec_id is_target", "", "SELECT vec_id, CASE WHEN label <= 3 THEN 1 ELSE 0 END AS is_target FROM embeddings")
def _(t):
    return t.table("embeddings").select("vec_id", F.when(F.col("label") <= 3, 1).otherwise(0).alias("is_target"))


@query("p17_collapse", "vec_id y", "", "SELECT vec_id, CASE WHEN label <= 3 THEN label ELSE 99 END::BIGINT AS y FROM embeddings")
def _(t):
    return t.table("embeddings").select("vec_id", F.when(F.col("label") <= 3, F.col("label")).otherwise(99).cast("long").alias("y"))


@query("p18_one_hot", "row_id", " ".join(f"c{i}" for i in range(10)), "SELECT row_id, " + ", ".join(f"(y = {i})::INT AS c{i}" for i in range(10)) + " FROM proba")
def _(t):
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("y"), 1.0).otherwise(0.0))
    return t.proba.withColumn("hot", hot).select("row_id", *(F.col("hot")[i].alias(f"c{i}") for i in range(10)))


@query("p19_handedness", "o_orderkey hand", "", "SELECT o_orderkey, CASE WHEN lower(trim(o_orderpriority)) LIKE 'r%' THEN 1 WHEN lower(trim(o_orderpriority)) LIKE 'l%' THEN 0 ELSE coalesce((try_cast(lower(trim(o_orderpriority)) AS DOUBLE) >= 1)::INT, 0) END AS hand FROM orders")
def _(t):
    return t.table("orders").select("o_orderkey", C.handedness(F.col("o_orderpriority")).alias("hand"))


@query("p20_safe_cast", "o_orderkey", "x", "SELECT o_orderkey, coalesce(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE), 0) AS x FROM orders")
def _(t):
    return t.table("orders").select("o_orderkey", C.to_number(F.substring("o_orderpriority", 1, 1)).alias("x"))


@query("p21_sentinel", f"{LINE}", "q", "SELECT l_orderkey, l_linenumber, nullif(l_quantity, 10) AS q FROM lineitem")
def _(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(10.0)).alias("q"))


@query("p22_finite", "sequence_id idx", "x", "SELECT sequence_id, idx, coalesce(CASE WHEN v = 0 THEN 0 ELSE g / v END, 0) AS x FROM fe")
def _(t):
    return t.fe.withColumn("x", C.finite(F.try_divide("g", "v")))


@query("p23_align", "", "l_tax l_new l_discount", "SELECT l_tax, 0 AS l_new, l_discount FROM lineitem")
def _(t):
    return C.align(t.table("lineitem"), ["l_tax", "l_new", "l_discount"])


@query("p24_validation", "rule n_violations", "", "SELECT 'null_g' AS rule, count(*) FILTER (g IS NULL) AS n_violations FROM fe UNION ALL SELECT 'large_v', count(*) FILTER (v > 90) FROM fe UNION ALL SELECT 'negative_v', count(*) FILTER (v < 0) FROM fe")
def _(t):
    return C.validation(t.fe, {"null_g": F.col("g").isNull(), "large_v": F.col("v") > 90, "negative_v": F.col("v") < 0})


@query("p25_variant", "kind sequence_id idx", "ax quat_w thm_1 tof_1_v0", "SELECT 'full' AS kind, sequence_id, idx, ax, qw AS quat_w, ay AS thm_1, az AS tof_1_v0 FROM fv UNION ALL SELECT 'imu_only', sequence_id, idx, ax, qw, NULL, NULL FROM fv")
def _(t):
    wide = t.fv.select("sequence_id", "idx", "ax", F.col("qw").alias("quat_w"), F.col("ay").alias("thm_1"), F.col("az").alias("tof_1_v0"))
    of = lambda k: C.variant(wide, k).withColumn("kind", F.lit(k))
    return of("full").unionByName(of("imu_only"))


@query("p02_families", "kind", "n rot_w thm_2 tof_3_v1 tof_1_v0", "SELECT 'first' AS kind, count(*) AS n, avg(qw) AS rot_w, avg(ay) AS thm_2, avg(az) AS tof_3_v1, NULL AS tof_1_v0 FROM fv UNION ALL SELECT 'second', count(*), NULL, avg(ay), NULL, avg(az) FROM fv", digits=4)
def _(t):
    """Two tables that name their families differently, under one set of names."""
    first = t.fv.select("sequence_id", "idx", *(F.col(f"q{k}").alias(f"quat_{k}") for k in "wxyz"), F.col("ay").alias("therm_2"), F.col("az").alias("tof_3_v1"))
    second = t.fv.select("sequence_id", "idx", F.col("qw").alias("rot_w"), F.col("ay").alias("thermal_2"), F.col("az").alias("tof_1_v0"))  # three components are missing
    names = ("rot_w", "thm_2", "tof_3_v1", "tof_1_v0")
    of = lambda df, k: C.unified(df, ["sequence_id", "idx"]).agg(F.lit(k).alias("kind"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names))
    return of(first, "first").unionByName(of(second, "second"))


_DRAW = "('0x' || substr(md5('{seed}:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT / 4294967296.0"


@query("p26_modality_dropout", LINE, "q d", f"SELECT l_orderkey, l_linenumber, CASE WHEN {_DRAW.format(seed=1)} < 0.3 THEN 0 ELSE l_quantity END AS q, CASE WHEN {_DRAW.format(seed=2)} < 0.3 THEN 0 ELSE l_discount END AS d FROM lineitem")
def _(t):
    drop = lambda seed, c: F.when(C.draw(seed, "l_orderkey", "l_linenumber") < 0.3, 0.0).otherwise(F.col(c))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", drop(1, "l_quantity").alias("q"), drop(2, "l_discount").alias("d"))


@query("p27_joint_dropout", LINE, "q d", f"SELECT l_orderkey, l_linenumber, CASE WHEN {_DRAW.format(seed=3)} >= 0.3 THEN l_quantity END AS q, CASE WHEN {_DRAW.format(seed=3)} >= 0.3 THEN l_discount END AS d FROM lineitem")
def _(t):
    on = C.draw(3, "l_orderkey", "l_linenumber") >= 0.3
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.when(on, F.col("l_quantity")).alias("q"), F.when(on, F.col("l_discount")).alias("d"))


@query("p28_frame_dropout", LINE, "q d", f"SELECT l_orderkey, l_linenumber, CASE WHEN {_DRAW.format(seed=4)} < 0.2 AND {_DRAW.format(seed=5)} < 0.5 THEN 0 ELSE l_quantity END AS q, CASE WHEN {_DRAW.format(seed=4)} < 0.2 AND {_DRAW.format(seed=5)} >= 0.5 THEN 0 ELSE l_discount END AS d FROM lineitem")
def _(t):
    key = ("l_orderkey", "l_linenumber")
    hit, first = C.draw(4, *key) < 0.2, C.draw(5, *key) < 0.5
    return t.table("lineitem").select(*key, F.when(hit & first, 0.0).otherwise(F.col("l_quantity")).alias("q"), F.when(hit & ~first, 0.0).otherwise(F.col("l_discount")).alias("d"))


@query("p29_median_split", "cohort n", "mean", "SELECT CASE WHEN c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.5) FROM customer) THEN 'short' ELSE 'long' END AS cohort, count(*) AS n, avg(c_acctbal) AS mean FROM customer GROUP BY 1")
def _(t):
    c = t.table("customer")
    (mid,) = S.table_quantiles(c, "c_acctbal", (0.5,))
    split = c.withColumn("cohort", F.when(F.col("c_acctbal") <= mid, "short").otherwise("long"))
    return split.groupBy("cohort").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))


@query("p30_unknown_labels", "event_type n", "", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def _(t):
    known = t.spark.createDataFrame([("click",), ("view",)], "event_type string")
    return t.table("events").join(known, "event_type", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@query("n01_fill", "sequence_id idx", "filled", "SELECT sequence_id, idx, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value(g IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled FROM fe")
def _(t):
    return t.fe.withColumn("filled", C.fill_both_ways("g"))


_GAPPY = "gq AS (SELECT sequence_id, idx, CASE WHEN l_orderkey % 5 <> 0 THEN qw END AS qw, CASE WHEN l_orderkey % 5 <> 1 THEN qx END AS qx, qy, qz FROM fv)"


def _gappy(t):
    k = F.col("l_orderkey") % 5
    return t.fv.select("sequence_id", "idx", F.when(k != 0, F.col("qw")).alias("qw"), F.when(k != 1, F.col("qx")).alias("qx"), "qy", "qz")


def _filled(c, default):
    return f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {default}) AS {c}"


@query(
    "n02_quaternion_fill", "sequence_id idx", "qw qx qy qz",
    f"WITH {_GAPPY}, f AS (SELECT sequence_id, idx, {', '.join(_filled(c, int(c == 'qw')) for c in ('qw', 'qx', 'qy', 'qz'))} FROM gq), n AS (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS n FROM f) SELECT sequence_id, idx, qw / n AS qw, qx / n AS qx, qy / n AS qy, qz / n AS qz FROM n",
)
def _(t):
    return C.fill_quaternion(_gappy(t))


@query("n04_full_quaternion", "kind sequence_id idx", "qw qx qy qz", f"WITH {_GAPPY} SELECT 'all' AS kind, sequence_id, idx, qw, qx, qy, qz FROM gq UNION ALL SELECT 'no_w', sequence_id, idx, 1.0, qx, qy, qz FROM gq UNION ALL SELECT 'no_z', sequence_id, idx, qw, qx, qy, NULL FROM gq")
def _(t):
    g = _gappy(t)
    have = {k: f"q{k}" for k in "wxyz"}
    of = lambda df, k: C.full_quaternion(df, have).withColumn("kind", F.lit(k))
    return of(g, "all").unionByName(of(g.drop("qw"), "no_w")).unionByName(of(g.drop("qz"), "no_z"))


@query("n05_family_sentinel", "sequence_id idx", "x", "SELECT sequence_id, idx, coalesce(g, -1.5 * (SELECT max(g) FROM fe)) AS x FROM fe")
def _(t):
    top = t.fe.agg(F.max("g").alias("top"))  # one row
    return t.fe.crossJoin(top).withColumn("x", F.coalesce("g", -1.5 * F.col("top")))


@query(
    "n06_median_and_linear", "sequence_id idx", "by_median linear",
    "WITH b AS (SELECT sequence_id, idx, g, last_value(g IGNORE NULLS) OVER p AS a, last_value(CASE WHEN g IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS i, first_value(g IGNORE NULLS) OVER f AS b, first_value(CASE WHEN g IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS j, quantile_cont(g, 0.5) OVER (PARTITION BY sequence_id) AS med FROM fe WINDOW p AS (PARTITION BY sequence_id ORDER BY idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT sequence_id, idx, coalesce(g, med) AS by_median, coalesce(g, a + (b - a) * (idx - i) / (j - i), a, b) AS linear FROM b",
)
def _(t):
    return C.linear_fill(t.fe, "g", "linear").withColumn("by_median", F.coalesce("g", F.percentile("g", F.lit(0.5)).over(S.whole())))


@query("n07_skip_missing", "sequence_id n_known", "mean", "SELECT sequence_id, count(g) AS n_known, avg(g) AS mean FROM fe GROUP BY 1")
def _(t):
    return S.summarise(t.fe, {"n_known": F.count("g"), "mean": F.avg("g")})


@query("n08_clip", "event_id", "x", "SELECT event_id, greatest((SELECT quantile_cont(v, 0.01) FROM fe WHERE sequence_id % 3 <> 0), least((SELECT quantile_cont(v, 0.99) FROM fe WHERE sequence_id % 3 <> 0), v)) AS x FROM fe")
def _(t):
    low, high = S.table_quantiles(t.fe.where("sequence_id % 3 <> 0"), "v", (0.01, 0.99))
    return t.fe.withColumn("x", F.greatest(F.lit(low), F.least(F.lit(high), "v")))


@query("j01_subject_lookup", "sequence_id idx", "c_acctbal", "SELECT sequence_id, idx, coalesce(c_acctbal, 0) AS c_acctbal FROM fe LEFT JOIN customer ON c_custkey = sequence_id")
def _(t):
    subjects = t.table("customer").select(F.col("c_custkey").alias("sequence_id"), "c_acctbal")
    return J.lookup(t.fe, subjects, "sequence_id", "c_acctbal")


@query("j02_full_outer", "k n_clicks n_orders", "balance", "WITH a AS (SELECT user_id AS k, count(*) AS n_clicks FROM events GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, c_acctbal AS balance FROM customer WHERE c_custkey % 2 = 0) SELECT k, n_clicks, n_orders, balance FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)")
def _(t):
    a = t.table("events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n_clicks"))
    b = t.table("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    c = t.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return a.join(b, "k", "full").join(c, "k", "full")


@query("j04_cohort_durations", "c_mktsegment n", "mean_length", "WITH n AS (SELECT sequence_id, count(*) AS len FROM fe GROUP BY 1) SELECT c_mktsegment, count(*) AS n, avg(len) AS mean_length FROM n JOIN customer ON c_custkey = sequence_id GROUP BY 1")
def _(t):
    n = S.summarise(t.fe, {"len": F.count("*")})
    meta = t.table("customer").select(F.col("c_custkey").alias("sequence_id"), "c_mktsegment")
    return n.join(meta, "sequence_id").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("len").alias("mean_length"))


@query("j05_frame_join", "sequence_id idx", "ax v", "SELECT fv.sequence_id, fv.idx, ax, v FROM fv JOIN fe ON fv.sequence_id = fe.sequence_id AND fv.idx = fe.idx")
def _(t):
    return t.fv.select("sequence_id", "idx", "ax").join(t.fe.select("sequence_id", "idx", "v"), ["sequence_id", "idx"])


@query("j06_semi", "c_custkey", "", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def _(t):
    return t.table("customer").join(t.table("events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j07_complete_with_default", "k y", "", "SELECT user_id AS k, min(event_type) AS y FROM events GROUP BY 1 UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(t):
    have = t.table("events").groupBy(F.col("user_id").alias("k")).agg(F.min("event_type").alias("y"))
    missing = t.table("customer").select(F.col("c_custkey").alias("k")).join(have, "k", "left_anti").withColumn("y", F.lit("none"))
    return have.unionByName(missing)


@query("j08_event_window", "sequence_id idx", "around_mean drop", "WITH w AS (SELECT *, avg(v) OVER w AS around_mean, min(v) OVER w AS m FROM fe WINDOW w AS (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)) SELECT sequence_id, idx, around_mean, around_mean - m AS drop FROM w WHERE phase = 'click'")
def _(t):
    out = J.event_window(t.fe.withColumn("hit", F.col("phase") == "click"), "hit", "v", 10, 10)
    return out.withColumn("drop", F.col("around_mean") - F.col("around_min"))


@query(
    "j09_event_triplet", "sequence_id n_events", "share",
    "WITH w AS (SELECT *, avg(v) OVER (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(v) OVER (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS a, max(v) OVER (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS m FROM fe), e AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY idx) AS k FROM w WHERE phase = 'click') SELECT sequence_id, count(*) AS n_events, avg((coalesce(a > b, false) AND m > 60)::INT) AS share FROM e WHERE k <= 10 GROUP BY 1",
)
def _(t):
    w = S.by_time()
    df = t.fe.withColumns({"b": F.avg("v").over(w.rowsBetween(-5, -1)), "a": F.avg("v").over(w.rowsBetween(0, 9)), "m": F.max("v").over(w.rowsBetween(0, 19))})
    e = df.where("phase = 'click'").withColumn("k", F.row_number().over(w)).where("k <= 10")
    return S.summarise(e, {"n_events": F.count("*"), "share": F.avg((F.coalesce(F.col("a") > F.col("b"), F.lit(False)) & (F.col("m") > 60)).cast("int"))})


@query("j10_sensor_coherence", "sequence_id", "coherence", "WITH f AS (SELECT sequence_id, idx, sensor, avg(d) AS m FROM grid GROUP BY ALL), p AS (SELECT a.sequence_id, a.sensor, b.sensor AS other, coalesce(covar_pop(a.m, b.m) / nullif(stddev_pop(a.m) * stddev_pop(b.m), 0), 0) AS r FROM f AS a JOIN f AS b ON a.sequence_id = b.sequence_id AND a.idx = b.idx AND a.sensor < b.sensor GROUP BY 1, 2, 3) SELECT sequence_id, avg(r) AS coherence FROM p GROUP BY 1")
def _(t):
    f = t.grid.groupBy("sequence_id", "idx", "sensor").agg(F.avg("d").alias("m"))
    b = f.select("sequence_id", "idx", F.col("sensor").alias("other"), F.col("m").alias("mb"))
    p = f.join(b, ["sequence_id", "idx"]).where("sensor < other").groupBy("sequence_id", "sensor", "other").agg(S.safe_corr(F.col("m"), F.col("mb")).alias("r"))
    return p.groupBy("sequence_id").agg(F.avg("r").alias("coherence"))


@query(
    "j11_sensor_lags", "sequence_id", "mean_abs_lag",
    "WITH f AS (SELECT sequence_id, idx, sensor, avg(d) AS m FROM grid GROUP BY ALL), c AS (SELECT *, m - avg(m) OVER (PARTITION BY sequence_id, sensor) AS u FROM f), l AS (SELECT a.sequence_id, a.sensor, b.sensor AS other, b.idx - a.idx AS lag, sum(a.u * b.u) AS s FROM c AS a JOIN c AS b ON a.sequence_id = b.sequence_id AND a.sensor < b.sensor AND abs(a.idx - b.idx) <= 3 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, sensor, other ORDER BY round(s, 4) DESC, lag) AS k FROM l) SELECT sequence_id, avg(abs(lag)) / 20 AS mean_abs_lag FROM k WHERE k = 1 GROUP BY 1",
)
def _(t):
    f = t.grid.groupBy("sequence_id", "idx", "sensor").agg(F.avg("d").alias("m"))
    c = f.withColumn("u", F.col("m") - F.avg("m").over(Window.partitionBy("sequence_id", "sensor"))).select("sequence_id", "idx", "sensor", "u")
    b = c.select("sequence_id", F.col("sensor").alias("other"), F.col("idx").alias("j"), F.col("u").alias("ub"))
    near = c.withColumn("j", F.explode(F.sequence(F.col("idx") - 3, F.col("idx") + 3)))  # a bounded lag: an equi-join
    sums = near.join(b, ["sequence_id", "j"]).where("sensor < other").groupBy("sequence_id", "sensor", "other", (F.col("j") - F.col("idx")).alias("lag")).agg(F.sum(F.col("u") * F.col("ub")).alias("s"))
    best = sums.groupBy("sequence_id", "sensor", "other").agg(F.max(F.struct(F.round("s", 4).alias("s"), (-F.col("lag")).alias("lag"))).alias("m"))
    return best.groupBy("sequence_id").agg((F.avg(F.abs(F.col("m.lag"))) / 20).alias("mean_abs_lag"))


@query(
    "j12_resample", "sequence_id pos", "v",
    "WITH n AS (SELECT *, lead(v) OVER (PARTITION BY sequence_id ORDER BY idx) AS nx, count(*) OVER (PARTITION BY sequence_id) AS n FROM fe), p AS (SELECT DISTINCT sequence_id, n, unnest(range(16)) AS pos FROM n), q AS (SELECT *, pos * greatest(n - 1, 1) / 15.0 AS x FROM p) SELECT q.sequence_id, pos, n.v + (coalesce(n.nx, n.v) - n.v) * (x - n.idx) AS v FROM q JOIN n ON n.sequence_id = q.sequence_id AND n.idx = least(floor(x), q.n - 1)",
)
def _(t):
    return J.resample(t.fe, 16)


@query("j13_truth_prediction", "doc_id quality said state", "", "WITH p AS (SELECT doc_id, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS said FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 11 = 5), c AS (SELECT doc_id, count(*) AS n, any_value(said) AS said FROM p GROUP BY 1) SELECT coalesce(l.doc_id, c.doc_id) AS doc_id, quality, CASE WHEN n = 1 THEN said END AS said, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'matched' END AS state FROM labels AS l FULL JOIN c ON l.doc_id = c.doc_id")
def _(t):
    """Predictions that lack some ids, have some twice, and some that nobody asked for."""
    d = t.table("documents")
    said = d.where("doc_id % 7 <> 3").select("doc_id", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("said")).union(d.where("doc_id % 11 = 5").select("doc_id", F.lit(1)))
    return J.checked_join(t.table("labels"), said, "doc_id", "quality", "said")


@query("j14_values_at_peaks", "sequence_id n_peaks", "mean min", f"WITH p AS (SELECT *, v > lag(v) {OVER} AND v > lead(v) {OVER} AS top FROM fe) SELECT sequence_id, count(*) AS n_peaks, avg(g) AS mean, min(g) AS min FROM p WHERE top GROUP BY 1")
def _(t):
    w = S.by_time()
    df = t.fe.withColumn("top", (F.col("v") > F.lag("v").over(w)) & (F.col("v") > F.lead("v").over(w))).where("top")
    return S.summarise(df, {"n_peaks": F.count("*"), "mean": F.avg("g"), "min": F.min("g")})


def _round_trip(t, df, kind: str):
    """Write ``df`` in a format and read it back with its schema."""
    path = f"{shared_folder(t)}/sink-{uuid.uuid4().hex}"
    w = df.write
    if kind == "csv":
        w.option("header", True).csv(path)
        return R.read_frames(t.spark, path, df.schema, df.columns)
    getattr(w, kind)(path)
    return t.spark.read.schema(df.schema).format(kind).load(path)


@query("s01_csv_scan", "c_custkey c_mktsegment", "c_acctbal", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(t):
    return _round_trip(t, t.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "csv")


@query("s03_header", "position name n_known", "", " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, count({c}) AS n_known FROM customer" for i, c in enumerate(("c_custkey", "c_mktsegment", "c_acctbal"))))
def _(t):
    """Columns as the header of a file names them; then what each of them holds."""
    path = f"{shared_folder(t)}/header-{uuid.uuid4().hex}"
    t.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", True).csv(path)
    names = R.header(t.spark, path)
    rows = R.read_frames(t.spark, path, ", ".join(f"`{c}` string" for c in names))
    one = rows.agg(F.array(*(F.struct(F.lit(i).cast("long").alias("position"), F.lit(c).alias("name"), F.count(c).alias("n_known")) for i, c in enumerate(names))).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


@query("s02_pruned_scan", "c_custkey", "c_acctbal", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return t.table("customer").select("c_custkey", "c_acctbal")


@query("s04_common_columns", "n", "mean", "SELECT count(*) AS n, avg(value) AS mean FROM events WHERE user_id % 2 = 0")
def _(t):
    train, test = t.table("events").where("user_id % 2 = 0"), t.table("events").drop("props")
    return train.select(*R.common_columns(train, test)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("s05_feature_export", "sequence_id", "mean std", "SELECT sequence_id, avg(v) AS mean, stddev_pop(v) AS std FROM fe GROUP BY 1")
def _(t):
    return _round_trip(t, S.summarise(t.fe, {"mean": F.avg("v"), "std": F.stddev_pop("v")}), "parquet")


@query("s07_incremental_store", "sequence_id n", "", "SELECT sequence_id, count(*) AS n FROM fe GROUP BY 1")
def _(t):
    rows = S.summarise(t.fe, {"n": F.count("*")})
    path = f"{shared_folder(t)}/store-{uuid.uuid4().hex}"
    rows.where("sequence_id % 3 = 0").write.parquet(path)
    done = t.spark.read.schema(rows.schema).parquet(path).select("sequence_id")
    rows.join(done, "sequence_id", "left_anti").write.mode("append").parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query("s09_csv_sink", "o_orderkey o_orderpriority", "o_totalprice", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders", digits=4)
def _(t):
    return _round_trip(t, t.table("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "csv")


@query("s10_json_sink", "phase n", "mean", "SELECT phase, count(*) AS n, avg(v) AS mean FROM fe GROUP BY 1")
def _(t):
    return _round_trip(t, t.fe.groupBy("phase").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "json")


@query("s11_array_cache", "sequence_id n", "total", "SELECT sequence_id, count(*) AS n, sum(v) AS total FROM fe GROUP BY 1", digits=3)
def _(t):
    arrays = S.summarise(t.fe, {"a": F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"])})
    return _round_trip(t, arrays, "parquet").select("sequence_id", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0.0), lambda x, y: x + y).alias("total"))


@query("s12_resume_plan", "fold phase n resumed", "mean", "SELECT sequence_id % 4 AS fold, phase, count(*) AS n, (sequence_id % 4 = 0 OR phase = 'click') AS resumed, avg(v) AS mean FROM fe GROUP BY ALL")
def _(t):
    """Tasks (fold, phase) of a run that was cut off are read from its store, the others are run and stored."""
    rows = t.fe.withColumn("fold", F.col("sequence_id") % 4)
    run = lambda part: part.groupBy("fold", "phase").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    path = f"{shared_folder(t)}/tasks-{uuid.uuid4().hex}"
    run(rows.where("fold = 0 OR phase = 'click'")).write.parquet(path)
    stored = t.spark.read.parquet(path)
    planned = rows.select("fold", "phase").distinct()
    todo = J.unfinished(planned, stored, "fold", "phase")
    more = f"{path}-more"
    run(rows.join(todo, ["fold", "phase"], "left_semi")).write.parquet(more)
    return stored.withColumn("resumed", F.lit(True)).union(t.spark.read.parquet(more).withColumn("resumed", F.lit(False)))
