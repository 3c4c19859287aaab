"""Queries: datasets, folds, models, ensembles and scores (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import clean as C
from seqspark.operators import ensemble as E
from seqspark.operators import folds as K
from seqspark.operators import stats as S
from seqspark.operators.ranks import numbered
from seqspark.plans.q_signals import _CUM, _PSD, rolloffs
from seqspark.plans.registry import query

LONG = "l AS (SELECT row_id, y, unnest(p) AS p, unnest(p2) AS p2, unnest(p3) AS p3, unnest(range(10)) AS class FROM proba)"
_BEST = "row_number() OVER (PARTITION BY row_id ORDER BY s DESC, class)"


def _wide(df, column: str = "q"):
    return df.select("row_id", *(F.col(column)[i].alias(f"c{i}") for i in range(10)))


_C = " ".join(f"c{i}" for i in range(10))
_PIVOT = ", ".join(f"max(s) FILTER (class = {i}) AS c{i}" for i in range(10))


@query(
    "m01_group_folds", "group_id label fold", "",
    "WITH c AS (SELECT user_id AS group_id, event_type AS label, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT group_id, label FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS k FROM c) AS x WHERE k = 1) SELECT group_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('7:' || group_id), group_id) - 1) % 5 AS fold FROM d",
)
def _(t):
    c = t.table("events").groupBy(F.col("user_id").alias("group_id"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    d = c.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias("label"))
    ranked = numbered(d, [F.col("label")], [K.drawn(7, "group_id"), F.col("group_id")], "k")
    return ranked.withColumn("fold", F.col("k") % 5)


_COST = "list_sum(list_transform(range(1, len(v) + 1), lambda l: list_stddev_pop(list_transform(range(1, 6), lambda g: (m[g][l] + CASE WHEN g = f THEN v[l] ELSE 0 END) / total[l])))) / len(v)"


@query(
    "m01_stratified_group_folds", "group_id fold n", "",
    "WITH RECURSIVE l AS (SELECT event_type AS label, count(*)::DOUBLE AS n FROM events GROUP BY 1), tot AS (SELECT list(n ORDER BY label) AS total FROM l), "
    "c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), "
    "g AS (SELECT u.user_id AS group_id, list(coalesce(c.n, 0) ORDER BY l.label) AS v FROM (SELECT DISTINCT user_id FROM events) AS u CROSS JOIN l LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = l.label GROUP BY 1), "
    "o AS (SELECT group_id, v, row_number() OVER (ORDER BY len(v) * list_sum(list_transform(v, lambda x: x * x)) - list_sum(v) ** 2 DESC, md5('7:' || group_id), group_id) AS i FROM g), "
    "r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS group_id, NULL::BIGINT AS fold, NULL::DOUBLE AS n, list_transform(range(5), lambda f: list_transform(total, lambda x: 0::DOUBLE)) AS m FROM tot "
    "UNION ALL SELECT i, group_id, f - 1, list_sum(v), list_transform(m, lambda x, g: CASE WHEN g = f THEN list_transform(x, lambda y, l: y + v[l]) ELSE x END) "
    f"FROM (SELECT o.i, o.group_id, o.v, r.m, list_sort(list_transform(range(1, 6), lambda f: {{'c': round({_COST}, 10), 'n': list_sum(m[f]), 'f': f}}))[1].f AS f FROM r JOIN o ON o.i = r.i + 1 CROSS JOIN tot) AS x) "
    "SELECT group_id, fold, n::BIGINT AS n FROM r WHERE i > 0",
)
def _(t):
    return K.stratified_group_folds(t.table("events"), "user_id", "event_type").withColumnRenamed("user_id", "group_id")


@query("m02_strata", "stratum n", "", "SELECT c_mktsegment || '_' || c_nationkey AS stratum, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    return t.table("customer").groupBy(F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("stratum")).agg(F.count("*").alias("n"))


@query("m03_stratified_folds", "c_custkey fold is_test", "", "WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1:' || c_custkey), c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, k % 5 AS fold, k < round(n * 0.2) AS is_test FROM r")
def _(t):
    return K.dealt_folds(t.table("customer"), "c_mktsegment", "c_custkey").select("c_custkey", "fold", "is_test")


@query("m04_standard_scaler", "sequence_id idx", "z", "SELECT sequence_id, idx, (v - (SELECT avg(v) FROM fe WHERE sequence_id % 5 <> 0)) / (SELECT stddev_pop(v) FROM fe WHERE sequence_id % 5 <> 0) AS z FROM fe")
def _(t):
    s = t.fe.where("sequence_id % 5 <> 0").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))  # one row
    return t.fe.crossJoin(s).withColumn("z", F.try_divide(F.col("v") - F.col("mu"), F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))))


@query("m05_robust_scaler", "sequence_id idx", "z", "SELECT sequence_id, idx, (v - (SELECT quantile_cont(v, 0.5) FROM fe WHERE sequence_id % 5 <> 0)) / (SELECT quantile_cont(v, 0.75) - quantile_cont(v, 0.25) FROM fe WHERE sequence_id % 5 <> 0) AS z FROM fe")
def _(t):
    low, mid, high = S.table_quantiles(t.fe.where("sequence_id % 5 <> 0"), "v", (0.25, 0.5, 0.75))
    return t.fe.withColumn("z", F.try_divide(F.col("v") - mid, F.lit(high - low)))


FOLDS = 5


def out_of_fold(rows, steps, folds: int = FOLDS):
    """Each fold (column ``fold``) transformed by what was fitted on the others."""
    out = None
    for k in range(folds):
        part = steps().fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


@query("m06_fold_safe_pipeline", "sequence_id fold", "pc1 pc2")
def _(t):
    """Scaler and principal components of each fold from the other four."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = S.summarise(t.fv, {"a": F.avg("ax"), "b": F.stddev_pop("ay"), "c": F.max("ax"), "d": F.avg("qw"), "e": F.avg("az"), "f": F.stddev_pop("az")}).withColumn("fold", F.col("sequence_id") % FOLDS)
    steps = lambda: Pipeline(stages=[VectorAssembler(inputCols=list("abcdef"), outputCol="x"), StandardScaler(withMean=True, inputCol="x", outputCol="z"), PCA(k=2, inputCol="z", outputCol="pc")])
    return out_of_fold(rows, steps).select("sequence_id", "fold", *(vector_to_array("pc")[i].alias(f"pc{i + 1}") for i in range(2)))


@query("m07_pad_and_mask", "sequence_id pos mask", "v", "WITH p AS (SELECT DISTINCT sequence_id, unnest(range(64)) AS pos FROM fe) SELECT p.sequence_id, pos, (v IS NOT NULL)::INT AS mask, coalesce(v, 0) AS v FROM p LEFT JOIN fe ON fe.sequence_id = p.sequence_id AND fe.idx = pos")
def _(t):
    a = S.summarise(t.fe, {"a": F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"])})
    cut = F.slice("a", 1, 64)
    padded = F.concat(F.transform(cut, lambda v: F.struct(F.lit(1).alias("mask"), v.alias("v"))), F.array_repeat(F.struct(F.lit(0).alias("mask"), F.lit(0.0).alias("v")), F.greatest(64 - F.size("a"), F.lit(0))))
    return a.select("sequence_id", F.posexplode(padded).alias("pos", "x")).select("sequence_id", F.col("pos").cast("long").alias("pos"), "x.mask", "x.v")


_DRAWN = "('0x' || substr(md5('{0}:' || {1}), 1, 8))::BIGINT / 4294967296.0"


def _partners_sql(rows: str, key: str, seed: int) -> str:
    """(key, other) of ``clean.partners``."""
    return (
        f"(WITH nb AS (SELECT greatest(1, (count(*) + 1023) // 1024) AS nb FROM {rows}), d AS (SELECT {key}, floor({_DRAWN.format(seed + 7, key)} * nb) AS block, {_DRAWN.format(seed, key)} AS u FROM {rows}, nb), "
        f"k AS (SELECT {key}, block, row_number() OVER (PARTITION BY block ORDER BY u, {key}) - 1 AS k, count(*) OVER (PARTITION BY block) AS m FROM d) SELECT a.{key}, b.{key} AS other FROM k AS a JOIN k AS b ON a.block = b.block AND b.k = (a.k + 1) % a.m)"
    )


@query(
    "m08_mixup", "row_id other", "lam label " + _C,
    f"WITH w AS (SELECT a.row_id, x.other, {_DRAWN.format(9, 'a.row_id')} AS lam, a.y, a.p, b.y AS oy, b.p AS op FROM proba AS a JOIN {_partners_sql('proba', 'row_id', 5)} AS x ON x.row_id = a.row_id JOIN proba AS b ON b.row_id = x.other) "
    "SELECT row_id, other, lam, lam * y + (1 - lam) * oy AS label, " + ", ".join(f"lam * p[{i + 1}] + (1 - lam) * op[{i + 1}] AS c{i}" for i in range(10)) + " FROM w",
)
def _(t):
    """Each row mixed with another of its block, of features and labels alike; blocks have about 1,024 rows, however many there are."""
    m = C.partners(t.proba.select("row_id", "y", "p"), "row_id", seed=5).withColumn("lam", C.draw(9, "row_id"))
    mix = lambda x, y: F.col("lam") * x + (1 - F.col("lam")) * y
    m = m.withColumn("m", F.zip_with("p", "other_p", mix)).withColumn("label", mix(F.col("y"), F.col("other_y")))
    return m.select("row_id", "other", "lam", "label", *(F.col("m")[i].alias(f"c{i}") for i in range(10)))


def _normal_sql(seed: int) -> str:
    u = lambda k: _DRAWN.format(k, "sequence_id || ':' || idx")
    return f"(sqrt(-2 * ln(greatest({u(seed)}, 1 / 4294967296.0))) * cos(2 * pi() * {u(seed + 1000)}))"


@query(
    "m09_augment", "sequence_id idx", "v noisy magnitude warped mixed",
    f"WITH t0 AS (SELECT sequence_id, idx, v, v + 0.05 * {_normal_sql(1)} AS noisy, v * (1 + 0.2 * {_normal_sql(2)}) AS magnitude, count(*) OVER (PARTITION BY sequence_id) AS n, sum(1 + 0.2 * {_normal_sql(3)}) OVER (PARTITION BY sequence_id ORDER BY idx) AS t FROM fe), "
    "t1 AS (SELECT *, t / last_value(t) OVER (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * n AS at, idx::DOUBLE AS pos FROM t0), "
    "s AS (SELECT DISTINCT sequence_id FROM fe), "
    "r AS (SELECT q.*, coalesce(a.v + (b.v - a.v) * (q.pos - a.at) / nullif(b.at - a.at, 0), a.v, b.v) AS warped FROM t1 AS q ASOF LEFT JOIN t1 AS a ON a.sequence_id = q.sequence_id AND a.at <= q.pos ASOF LEFT JOIN t1 AS b ON b.sequence_id = q.sequence_id AND b.at >= q.pos) "
    f"SELECT r.sequence_id, r.idx, r.v, noisy, magnitude, warped, CASE WHEN r.idx >= floor(n * 0.5) THEN coalesce(o.v, r.v) ELSE r.v END AS mixed FROM r JOIN {_partners_sql('s', 'sequence_id', 4)} AS x ON x.sequence_id = r.sequence_id LEFT JOIN fe AS o ON o.sequence_id = x.other AND o.idx = r.idx", digits=5,
)
def _(t):
    """Noise, magnitude warp, time warp, and the second half of another sequence."""
    return C.augmented(t.fe)


@query("m11_fold_model", "vec_id fold label predicted")
def _(t):
    """Ten classes, five folds: every row is predicted by a model that has not seen it."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    x = array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
    rows = t.table("embeddings").select("vec_id", F.col("label").cast("double").alias("label"), x.alias("features"), F.floor(C.draw(11, "vec_id") * FOLDS).alias("fold"))
    done = out_of_fold(rows, lambda: RandomForestClassifier(numTrees=10, maxDepth=5, seed=7, labelCol="label"))
    return done.select("vec_id", "fold", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("predicted"))


@query("m13_hierarchical_routing", "row_id class", "", f"WITH {LONG}, b AS (SELECT row_id, sum(p) FILTER (class < 4) AS target, arg_max(class, p2) FILTER (class < 4) AS a, arg_max(class, p3) FILTER (class >= 4) AS o, arg_max(class, p) AS f FROM l GROUP BY 1) SELECT row_id, CASE WHEN target > 0.6 THEN a WHEN target < 0.4 THEN o ELSE f END AS class FROM b")
def _(t):
    target = E.total(F.slice("p", 1, 4))
    return t.proba.select("row_id", F.when(target > 0.6, E.argmax(F.slice("p2", 1, 4))).when(target < 0.4, E.argmax(F.slice("p3", 5, 6)) + 4).otherwise(E.argmax(F.col("p"))).alias("class"))


@query("m14_majority_vote", "row_id class", "", f"WITH {LONG}, v AS (SELECT row_id, unnest([arg_max(class, p), arg_max(class, p2), arg_max(class, p3)]) AS class FROM l GROUP BY 1), c AS (SELECT row_id, class, count(*) AS n FROM v GROUP BY ALL) SELECT row_id, class FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, class) AS k FROM c) AS r WHERE k = 1")
def _(t):
    votes = t.proba.select("row_id", F.explode(F.array(*(E.argmax(F.col(c)) for c in ("p", "p2", "p3")))).alias("class"))
    n = votes.groupBy("row_id", "class").agg(F.count("*").alias("n"))
    return n.groupBy("row_id").agg((-F.max(F.struct("n", (-F.col("class")).alias("m")))["m"]).alias("class"))


@query("m15_weighted_vote", "row_id class", "", f"WITH {LONG}, v AS (SELECT row_id, unnest([arg_max(class, p), arg_max(class, p2), arg_max(class, p3)]) AS class, unnest([0.45, 0.25, 0.35]) AS w FROM l GROUP BY 1), c AS (SELECT row_id, class, sum(w) AS n FROM v GROUP BY ALL) SELECT row_id, class FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, class) AS k FROM c) AS r WHERE k = 1")
def _(t):
    votes = t.proba.select("row_id", F.explode(F.array(*(F.struct(E.argmax(F.col(c)).alias("class"), F.lit(w).alias("w")) for c, w in (("p", 0.45), ("p2", 0.25), ("p3", 0.35))))).alias("x")).select("row_id", "x.*")
    n = votes.groupBy("row_id", "class").agg(F.sum("w").alias("n"))
    return n.groupBy("row_id").agg((-F.max(F.struct("n", (-F.col("class")).alias("m")))["m"]).alias("class"))


@query("m16_weighted_average", "row_id", _C, f"WITH {LONG}, s AS (SELECT row_id, class, 0.5 * p + 0.3 * p2 + 0.2 * p3 AS s FROM l) SELECT row_id, {_PIVOT} FROM s GROUP BY 1")
def _(t):
    return _wide(t.proba.withColumn("q", E.blend([F.col("p"), F.col("p2"), F.col("p3")], [0.5, 0.3, 0.2])))


@query("m17_global_classes", "row_id", _C, "SELECT row_id, p[1] AS c0, 0 AS c1, p[2] AS c2, 0 AS c3, p[3] AS c4, 0 AS c5, 0 AS c6, 0 AS c7, 0 AS c8, p[4] AS c9 FROM proba")
def _(t):
    local = {0: 0, 2: 1, 4: 2, 9: 3}
    return t.proba.select("row_id", *((F.col("p")[local[i]] if i in local else F.lit(0.0)).alias(f"c{i}") for i in range(10)))


@query("m18_available_blend", "row_id", _C, f"WITH {LONG}, s AS (SELECT row_id, class, CASE WHEN row_id % 3 = 0 THEN (0.5 * p + 0.2 * p3) / 0.7 ELSE 0.5 * p + 0.3 * p2 + 0.2 * p3 END AS s FROM l) SELECT row_id, {_PIVOT} FROM s GROUP BY 1")
def _(t):
    some = F.when(F.col("row_id") % 3 != 0, F.col("p2"))
    return _wide(t.proba.withColumn("q", E.blend([F.col("p"), some, F.col("p3")], [0.5, 0.3, 0.2])))


@query("m19_temperature", "row_id", _C, f"WITH {LONG}, s AS (SELECT row_id, class, p ** (1 / 1.5) / sum(p ** (1 / 1.5)) OVER (PARTITION BY row_id) AS s FROM l) SELECT row_id, {_PIVOT} FROM s GROUP BY 1")
def _(t):
    return _wide(t.proba.withColumn("q", E.temperature(F.col("p"), 1.5)))


def _drawn(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0"


@query(
    "m20_weight_search", "trial", "w1 w2 w3 score",
    f"WITH {LONG}, d AS (SELECT range AS trial, {_drawn(21, 'range')} AS d1, {_drawn(22, 'range')} AS d2, {_drawn(23, 'range')} AS d3 FROM range(1024)), w AS (SELECT trial, d1 / greatest(d1 + d2 + d3, 1e-12) AS w1, d2 / greatest(d1 + d2 + d3, 1e-12) AS w2, d3 / greatest(d1 + d2 + d3, 1e-12) AS w3 FROM d), "
    "s AS (SELECT trial, row_id, least(max(y), 4) AS y, least(arg_max(class, w1 * p + w2 * p2 + w3 * p3), 4) AS h FROM l, w GROUP BY 1, 2), c AS (SELECT trial, y, h, count(*) AS n FROM s GROUP BY 1, 2, 3), "
    "b AS (SELECT trial, 2.0 * coalesce(sum(n) FILTER (y < 4 AND h < 4), 0) / (coalesce(sum(n) FILTER (y < 4), 0) + coalesce(sum(n) FILTER (h < 4), 0)) AS binary_f1 FROM c GROUP BY 1), "
    "k AS (SELECT trial, k, 2.0 * coalesce(sum(n) FILTER (y = k AND h = k), 0) / nullif(coalesce(sum(n) FILTER (y = k), 0) + coalesce(sum(n) FILTER (h = k), 0), 0) AS f FROM c, (SELECT range AS k FROM range(5)) AS ks GROUP BY 1, 2), "
    "m AS (SELECT trial, avg(f) AS macro FROM k GROUP BY 1) SELECT trial, w1, w2, w3, (coalesce(binary_f1, 0) + macro) / 2 AS score FROM w JOIN b USING (trial) JOIN m USING (trial) ORDER BY round(score, 12) DESC, trial LIMIT 1",
)
def _(t):
    """The best of 1,024 random weightings, by hierarchical F1."""
    trials = t.spark.range(1024).withColumnRenamed("id", "trial")
    raw = trials.withColumns({f"d{i}": C.draw(20 + i, "trial") for i in (1, 2, 3)})
    total = F.greatest(F.col("d1") + F.col("d2") + F.col("d3"), F.lit(1e-12))
    weights = raw.select("trial", *((F.col(f"d{i}") / total).alias(f"w{i}") for i in (1, 2, 3)))
    scores = E.trial_scores(t.proba, "y", ["p", "p2", "p3"], weights, 4)
    best = F.max_by(F.struct("trial", "w1", "w2", "w3", "score"), F.struct("score", (-F.col("trial")).alias("first")))
    return scores.agg(best.alias("b")).select("b.*")


@query("m21_boost_targets", "row_id", _C, f"WITH {LONG}, b AS (SELECT row_id, class, CASE WHEN class < 4 THEN p * 1.2 ELSE p END AS s FROM l), n AS (SELECT row_id, class, s / sum(s) OVER (PARTITION BY row_id) AS s FROM b) SELECT row_id, {_PIVOT} FROM n GROUP BY 1")
def _(t):
    return _wide(t.proba.withColumn("q", E.boosted(F.col("p"), 4, 1.2)))


_SIM = "CASE WHEN 1 - abs({0} - {1}) / 10.0 > 0.5 THEN (1 - abs({0} - {1}) / 10.0) * 0.15 ELSE 0 END"


@query(
    "m22_low_confidence", "row_id", _C,
    f"WITH {LONG}, r AS (SELECT *, max(p) OVER (PARTITION BY row_id) AS top, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, class) AS k FROM l), f AS (SELECT *, count(*) FILTER (k <= 5 AND class < 4) OVER (PARTITION BY row_id) AS near FROM r), b AS (SELECT row_id, class, top, CASE WHEN top < 0.35 AND near >= 2 AND k <= 5 AND class < 4 THEN p * 1.15 ELSE p END AS u FROM f), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY u DESC, class) AS k FROM b), "
    "t0 AS (SELECT row_id, " + ", ".join(f"max(class) FILTER (k = {3 - i}) AS c{i}, max(u) FILTER (k = {3 - i}) AS v{i}" for i in range(3)) + " FROM o GROUP BY 1), "
    f"t1 AS (SELECT row_id, c0, c1, c2, v0 + (v1 - v0) * h AS v0, v1 + (v0 - v1) * h AS v1, v2 FROM (SELECT *, {_SIM.format('c0', 'c1')} AS h FROM t0) AS x), "
    f"t2 AS (SELECT row_id, c0, c1, c2, v0 + (v2 - v0) * h AS v0, v1, v2 + (v0 - v2) * h AS v2 FROM (SELECT *, {_SIM.format('c0', 'c2')} AS h FROM t1) AS x), "
    f"t3 AS (SELECT row_id, c0, c1, c2, v0, v1 + (v2 - v1) * h AS v1, v2 + (v1 - v2) * h AS v2 FROM (SELECT *, {_SIM.format('c1', 'c2')} AS h FROM t2) AS x), "
    f"s AS (SELECT o.row_id, class, CASE WHEN top < 0.175 AND class = c0 THEN v0 WHEN top < 0.175 AND class = c1 THEN v1 WHEN top < 0.175 AND class = c2 THEN v2 ELSE u END AS s FROM o JOIN t3 USING (row_id)) SELECT row_id, {_PIVOT} FROM s GROUP BY 1",
)
def _(t):
    alike = {(i, j): 1 - (j - i) / 10.0 for i in range(10) for j in range(i + 1, 10)}
    return _wide(t.proba.withColumn("q", E.low_confidence_boost(F.col("p"), 4, similarity=alike)))


_TIED = {0: "(y = 0 AND p[1] - p[5] < 0.15) OR (y = 4 AND p[5] - p[1] < 0.15)", 1: "(y = 1 AND p[2] - p[6] < 0.15) OR (y = 5 AND p[6] - p[2] < 0.15)"}


@query(
    "m23_confusion_pairs", "row_id", _C,
    "WITH a AS (SELECT row_id, p, list_position(p, list_max(p)) - 1 AS y FROM proba) SELECT row_id, " + ", ".join(f"CASE WHEN {_TIED[i]} THEN p[{i + 1}] * {(1.18, 1.175)[i]} ELSE p[{i + 1}] END AS c{i}" if i in _TIED else f"p[{i + 1}] AS c{i}" for i in range(10)) + " FROM a",
)
def _(t):
    pairs = [(0, 4, 0.8), (4, 0, 0.8), (1, 5, 0.75), (5, 1, 0.75), (2, 6, 0.5), (0, 1, 0.9)]  # the last two change nothing: too little alike, or both targets
    return _wide(t.proba.withColumn("q", E.confusion_boost(F.col("p"), 4, pairs)))


@query("m24_normalise", "row_id", _C, f"WITH {LONG}, z AS (SELECT row_id, class, CASE WHEN row_id % 5 = 0 THEN 0 ELSE p * class END AS s FROM l), n AS (SELECT row_id, class, CASE WHEN sum(s) OVER (PARTITION BY row_id) = 0 THEN s ELSE s / sum(s) OVER (PARTITION BY row_id) END AS s FROM z) SELECT row_id, {_PIVOT} FROM n GROUP BY 1")
def _(t):
    some = t.proba.withColumn("z", F.transform("p", lambda x, i: F.when(F.col("row_id") % 5 == 0, 0.0).otherwise(x * i)))
    return _wide(some.withColumn("q", E.normalised(F.col("z"))))


@query("m25_augmented_average", "row_id", _C, f"WITH {LONG}, s AS (SELECT row_id, class, 0.6 * p + 0.4 * p2 AS s FROM l) SELECT row_id, {_PIVOT} FROM s GROUP BY 1")
def _(t):
    return _wide(t.proba.withColumn("q", E.blend([F.col("p"), F.col("p2")], [0.6, 0.4])))


def _f1_sql(source: str) -> str:
    return (
        f"c AS (SELECT CASE WHEN y < 4 THEN y ELSE 99 END AS t, CASE WHEN h < 4 THEN h ELSE 99 END AS q, count(*) AS n FROM {source} GROUP BY ALL), k AS (SELECT t AS class FROM c UNION SELECT q FROM c), "
        "s AS (SELECT class, coalesce(sum(n) FILTER (t = class AND q = class), 0) AS tp, coalesce(sum(n) FILTER (t = class), 0) AS sup, coalesce(sum(n) FILTER (q = class), 0) AS cl FROM k, c GROUP BY 1), "
        "b AS (SELECT coalesce(2 * coalesce(sum(n) FILTER (t < 99 AND q < 99), 0) / nullif(coalesce(sum(n) FILTER (t < 99), 0) + coalesce(sum(n) FILTER (q < 99), 0), 0), 0) AS binary_f1 FROM c)"
    )


_PRED = f"{LONG}, pr AS (SELECT row_id, max(y) AS y, arg_max(class, p) AS h FROM l GROUP BY 1)"


def _predicted(t):
    return t.proba.select("row_id", "y", E.argmax(F.col("p")).alias("h"))


@query("m26_hierarchical_f1", "", "binary_f1 macro_f1 score", f"WITH {_PRED}, {_f1_sql('pr')}, m AS (SELECT avg(coalesce(2 * tp / nullif(sup + cl, 0), 0)) AS macro_f1 FROM s) SELECT binary_f1, macro_f1, (binary_f1 + macro_f1) / 2 AS score FROM b, m")
def _(t):
    return E.hierarchical_f1(_predicted(t), "y", "h", 4)


@query("m27_target_rows_f1", "", "macro_f1", f"WITH {_PRED}, tr AS (SELECT * FROM pr WHERE y < 4), {_f1_sql('tr')} SELECT avg(coalesce(2 * tp / nullif(sup + cl, 0), 0)) AS macro_f1 FROM s")
def _(t):
    return E.hierarchical_f1(_predicted(t).where("y < 4"), "y", "h", 4)


@query("m28_class_metrics", "class support", "precision recall f1", f"WITH {_PRED}, c AS (SELECT y AS t, h AS q, count(*) AS n FROM pr GROUP BY ALL), k AS (SELECT t AS class FROM c UNION SELECT q FROM c), s AS (SELECT class, coalesce(sum(n) FILTER (t = class AND q = class), 0) AS tp, coalesce(sum(n) FILTER (t = class), 0) AS sup, coalesce(sum(n) FILTER (q = class), 0) AS cl FROM k, c GROUP BY 1) SELECT class, sup::BIGINT AS support, coalesce(tp / nullif(cl, 0), 0) AS precision, coalesce(tp / nullif(sup, 0), 0) AS recall, coalesce(2 * tp / nullif(sup + cl, 0), 0) AS f1 FROM s")
def _(t):
    return E.class_scores(E.confusion(_predicted(t), "y", "h"))


@query("m29_modality_scores", "variant", "score", f"WITH {LONG}, a AS (SELECT row_id, max(y) AS y, arg_max(class, p) AS h, arg_max(class, p + p2) AS g FROM l GROUP BY 1) SELECT 'all' AS variant, avg((y = g)::INT) AS score FROM a UNION ALL SELECT 'first', avg((y = h)::INT) FROM a", digits=5)
def _(t):
    both = F.zip_with("p", "p2", lambda a, b: a + b)
    hits = t.proba.select(F.explode(F.array(F.struct(F.lit("all").alias("variant"), (E.argmax(both) == F.col("y")).alias("hit")), F.struct(F.lit("first").alias("variant"), (E.argmax(F.col("p")) == F.col("y")).alias("hit")))).alias("x")).select("x.*")
    return hits.groupBy("variant").agg(F.avg(F.col("hit").cast("int")).alias("score"))


@query("m30_coverage", "rule n_violations", "", "SELECT 'repeated' AS rule, count(*) - count(DISTINCT doc_id) AS n_violations FROM labels UNION ALL SELECT 'unknown_class', count(*) FILTER (quality NOT IN (0, 1)) FROM labels UNION ALL SELECT 'missing', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(t):
    labels = t.table("labels")
    one = labels.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("k"), F.count_if(~F.col("quality").isin(0, 1)).alias("u")).select(F.explode(F.array(F.struct(F.lit("repeated").alias("rule"), (F.col("n") - F.col("k")).alias("n_violations")), F.struct(F.lit("unknown_class").alias("rule"), F.col("u").alias("n_violations")))).alias("x")).select("x.*")
    missing = t.table("documents").select("doc_id").join(labels, "doc_id", "left_anti").agg(F.lit("missing").alias("rule"), F.count("*").alias("n_violations"))
    return one.unionByName(missing)


@query("m31_default_class", "doc_id quality", "", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return t.table("documents").select("doc_id").join(t.table("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query(
    "m33_override", "row_id class", "",
    f"WITH {_PSD}, {_CUM}, ro AS (SELECT sequence_id, min(freq) FILTER (cum >= 0.85 * total) AS rolloff FROM c GROUP BY 1), {LONG}, u AS (SELECT l.row_id, class, p, CASE WHEN class < 4 THEN p * (CASE WHEN rolloff > 5 THEN 1.26 ELSE 1.2 END) ELSE p END AS u FROM l LEFT JOIN ro ON ro.sequence_id = l.row_id), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY u DESC, class) AS k FROM u), t AS (SELECT row_id, max(p) AS top, max(class) FILTER (k = 1) AS a, arg_min(class, k) FILTER (k <= 3 AND class < 4) AS b FROM r GROUP BY 1) SELECT row_id, CASE WHEN top < 0.25 THEN coalesce(b, a) ELSE a END AS class FROM t",
)
def _(t):
    """Targets are raised, more so where a sequence's spectrum reaches past 5 Hz; then unsure rows take the best target near the top."""
    rolloff = rolloffs(t).withColumnRenamed("sequence_id", "row_id")
    rows = t.proba.join(rolloff, "row_id", "left").withColumn("q", E.boosted_by_rolloff(F.col("p"), 4, F.col("rolloff")))
    return rows.select("row_id", E.override_when_unsure(F.col("q"), 4, sure=F.array_max("p")).alias("class"))
