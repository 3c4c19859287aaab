"""Queries: 8x8 frames (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqspark.operators import grid as G
from seqspark.operators import stats as S
from seqspark.plans.registry import query

KEYS = "sequence_id idx sensor"
_XY = "pixel % 8 AS x, pixel // 8 AS y"


def _agg_sql(std: str) -> str:
    return f"SELECT sequence_id, idx, sensor, coalesce(avg(d), 0) AS mean, coalesce({std}(d), 0) AS std, coalesce(min(d), 0) AS min, coalesce(max(d), 0) AS max, count(d)::DOUBLE / count(*) AS valid FROM grid GROUP BY 1, 2, 3"


@query("g01_frame_aggregates", KEYS, "mean std min max valid", _agg_sql("stddev_pop"))
def _(t):
    return G.per_frame(t.grid, G.aggregates(F.col("d")))


@query("g02_frame_sample_std", KEYS, "mean std min max", _agg_sql("stddev_samp"))
def _(t):
    return G.per_frame(t.grid, G.aggregates(F.col("d"), sample=True))


@query("g03_sequence_means", "sequence_id sensor", "mean std", f"SELECT sequence_id, sensor, avg(mean) AS mean, avg(std) AS std FROM ({_agg_sql('stddev_samp')}) AS f GROUP BY 1, 2")
def _(t):
    f = G.per_frame(t.grid, G.aggregates(F.col("d"), sample=True))
    return f.groupBy("sequence_id", "sensor").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


@query("g04_pixel_stats", "sensor", "mean pixel_std missing", "WITH p AS (SELECT sensor, pixel, stddev_pop(d) AS sd, sum(d) AS s, count(d) AS n, count(*) AS k FROM grid GROUP BY 1, 2) SELECT sensor, sum(s) / sum(n) AS mean, avg(sd) AS pixel_std, 1 - sum(n)::DOUBLE / sum(k) AS missing FROM p GROUP BY 1", digits=4)
def _(t):
    p = t.grid.groupBy("sensor", "pixel").agg(F.stddev_pop("d").alias("sd"), F.sum("d").alias("s"), F.count("d").alias("n"), F.count("*").alias("k"))
    return p.groupBy("sensor").agg((F.sum("s") / F.sum("n")).alias("mean"), F.avg("sd").alias("pixel_std"), (1 - F.sum("n") / F.sum("k")).alias("missing"))


@query("g05_strips", "sequence_id sensor parts strip", "mean std min max", "WITH s AS (SELECT *, unnest([2, 4, 8, 16, 32])::BIGINT AS parts FROM grid) SELECT sequence_id, sensor, parts, pixel // (64 // parts) AS strip, coalesce(avg(d), 0) AS mean, coalesce(stddev_pop(d), 0) AS std, coalesce(min(d), 0) AS min, coalesce(max(d), 0) AS max FROM s GROUP BY 1, 2, 3, 4")
def _(t):
    s = t.grid.withColumn("parts", F.explode(F.array(*(F.lit(k).cast("long") for k in (2, 4, 8, 16, 32))))).withColumn("strip", F.expr("pixel div (64 div parts)"))
    a = G.aggregates(F.col("d"))
    return s.groupBy("sequence_id", "sensor", "parts", "strip").agg(*(a[k].alias(k) for k in ("mean", "std", "min", "max")))


@query("g06_min_distance_series", "sequence_id sensor", "mean std line_length", "WITH f AS (SELECT sequence_id, sensor, idx, min(d) AS m FROM grid GROUP BY 1, 2, 3), s AS (SELECT *, m - lag(m) OVER (PARTITION BY sequence_id, sensor ORDER BY idx) AS st FROM f) SELECT sequence_id, sensor, avg(m) AS mean, stddev_pop(m) AS std, sum(abs(st)) AS line_length FROM s GROUP BY 1, 2", digits=4)
def _(t):
    w = Window.partitionBy("sequence_id", "sensor").orderBy("idx")
    s = G.per_frame(t.grid, {"m": F.min("d")}).withColumn("st", F.col("m") - F.lag("m").over(w))
    return s.groupBy("sequence_id", "sensor").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.sum(F.abs("st")).alias("line_length"))


def _moment_sql(weight: str) -> str:
    return (
        f"WITH p AS (SELECT sequence_id, idx, sensor, {_XY}, {weight} AS w FROM grid), m AS (SELECT sequence_id, idx, sensor, coalesce(sum(w * x) / nullif(sum(w), 0), 0) AS cx, coalesce(sum(w * y) / nullif(sum(w), 0), 0) AS cy, coalesce(sum(w * x * x) / nullif(sum(w), 0), 0) AS xx, coalesce(sum(w * y * y) / nullif(sum(w), 0), 0) AS yy, coalesce(sum(w * x * y) / nullif(sum(w), 0), 0) AS xy FROM p GROUP BY 1, 2, 3), "
        "c AS (SELECT *, xx - cx * cx AS m20, yy - cy * cy AS m02, xy - cx * cy AS m11 FROM m), e AS (SELECT *, m20 + m02 AS b, sqrt((m20 - m02) ** 2 + 4 * m11 ** 2) AS r FROM c) SELECT sequence_id, idx, sensor, cx, cy, m20, m02, m11, CASE WHEN b + r > 1e-9 THEN sqrt(greatest(0, 1 - (b - r) / (b + r))) ELSE 0 END AS ecc FROM e"
    )


@query("g07_inverse_distance_moments", KEYS, "cx cy m20 m02 m11 ecc", _moment_sql("1 / (d + 1)"), digits=5)
def _(t):
    return G.with_eccentricity(G.per_frame(t.grid, G.weighted_moments(1 / (F.col("d") + 1))))


@query("g08_value_moments", KEYS, "cx cy m20 m02 m11 ecc", _moment_sql("d"), digits=5)
def _(t):
    return G.with_eccentricity(G.per_frame(t.grid, G.weighted_moments(F.col("d"))))


@query("g09_gradients", KEYS, "gradient", "WITH z AS (SELECT sequence_id, idx, sensor, pixel, coalesce(d, 0) AS d FROM grid), g AS (SELECT *, CASE WHEN pixel % 8 < 7 THEN lead(d) OVER o - d END AS gx, CASE WHEN pixel < 56 THEN lead(d, 8) OVER o - d END AS gy FROM z WINDOW o AS (PARTITION BY sequence_id, idx, sensor ORDER BY pixel)) SELECT sequence_id, idx, sensor, sum(abs(coalesce(gx, 0)) + abs(coalesce(gy, 0))) AS gradient FROM g GROUP BY 1, 2, 3", digits=4)
def _(t):
    a = G.as_arrays(t.grid.na.fill(0, ["d"]))
    part = lambda v, i: F.when(i % 8 < 7, F.abs(F.get("a", i + 1) - v)).otherwise(0.0) + F.when(i < 56, F.abs(F.get("a", i + 8) - v)).otherwise(0.0)
    return a.withColumn("gradient", F.aggregate(F.transform("a", part), F.lit(0.0), lambda s, x: s + x))


_REGION = "CASE WHEN pixel // 8 BETWEEN 2 AND 4 AND pixel % 8 BETWEEN 2 AND 4 THEN 0 WHEN pixel // 8 BETWEEN 1 AND 5 AND pixel % 8 BETWEEN 1 AND 5 THEN 1 ELSE 2 END"


@query("g10_regions", KEYS, "centre ring rest rest_minus_centre", f"WITH r AS (SELECT *, {_REGION} AS r FROM grid), a AS (SELECT sequence_id, idx, sensor, coalesce(avg(d) FILTER (r = 0), 0) AS centre, coalesce(avg(d) FILTER (r = 1), 0) AS ring, coalesce(avg(d) FILTER (r = 2), 0) AS rest FROM r GROUP BY 1, 2, 3) SELECT sequence_id, idx, sensor, centre, ring, rest, rest - centre AS rest_minus_centre FROM a")
def _(t):
    r = t.grid.withColumn("r", G.region())
    f = G.per_frame(r, {k: G.zero(F.avg(F.when(F.col("r") == i, F.col("d")))) for i, k in enumerate(("centre", "ring", "rest"))})
    return f.withColumn("rest_minus_centre", F.col("rest") - F.col("centre"))


@query("g11_quadrants", KEYS, "q0 q1 q2 q3 left_right top_bottom", "WITH q AS (SELECT *, pixel // 32 * 2 + pixel % 8 // 4 AS q FROM grid) SELECT sequence_id, idx, sensor, " + ", ".join(f"coalesce(avg(d) FILTER (q = {i}), 0) AS q{i}" for i in range(4)) + ", coalesce(avg(d) FILTER (q % 2 = 0), 0) - coalesce(avg(d) FILTER (q % 2 = 1), 0) AS left_right, coalesce(avg(d) FILTER (q < 2), 0) - coalesce(avg(d) FILTER (q >= 2), 0) AS top_bottom FROM q GROUP BY 1, 2, 3")
def _(t):
    q = t.grid.withColumn("q", F.expr("pixel div 32 * 2 + (pixel % 8) div 4"))
    mean = lambda c: G.zero(F.avg(F.when(c, F.col("d"))))
    k = F.col("q")
    return G.per_frame(q, {**{f"q{i}": mean(k == i) for i in range(4)}, "left_right": mean(k % 2 == 0) - mean(k % 2 == 1), "top_bottom": mean(k < 2) - mean(k >= 2)})


@query("g12_near_share", KEYS, "near10 near20", "WITH q AS (SELECT *, quantile_cont(d, 0.1) OVER p AS a, quantile_cont(d, 0.2) OVER p AS b FROM grid WINDOW p AS (PARTITION BY sequence_id, idx, sensor)) SELECT sequence_id, idx, sensor, coalesce((count(*) FILTER (d < a))::DOUBLE / nullif(count(d), 0), 0) AS near10, coalesce((count(*) FILTER (d < b))::DOUBLE / nullif(count(d), 0), 0) AS near20 FROM q GROUP BY 1, 2, 3")
def _(t):
    q = S.with_quantiles(t.grid, "d", (0.1, 0.2), G.FRAME, "q").withColumns({"a": F.col("q")[0], "b": F.col("q")[1]})
    return G.per_frame(q, {k: S.ratio(F.count_if(F.col("d") < F.col(c)), F.count("d")) for k, c in (("near10", "a"), ("near20", "b"))})


@query("g13_anisotropy", KEYS, "anisotropy angle", _moment_sql("d").split("SELECT sequence_id, idx, sensor, cx, cy, m20")[0] + "SELECT sequence_id, idx, sensor, CASE WHEN b + r > 1e-9 THEN 1 - (b - r) / (b + r) ELSE 0 END AS anisotropy, 0.5 * atan2(2 * m11, m20 - m02) AS angle FROM e", digits=4)
def _(t):
    f = G.per_frame(t.grid, G.weighted_moments(F.col("d")))
    both, root = F.col("m20") + F.col("m02"), F.sqrt((F.col("m20") - F.col("m02")) ** 2 + 4 * F.col("m11") ** 2)
    return f.withColumns({"anisotropy": F.when(both + root > 1e-9, 1 - F.try_divide(both - root, both + root)).otherwise(0.0), "angle": 0.5 * F.atan2(2 * F.col("m11"), F.col("m20") - F.col("m02"))})


@query(
    "g14_clusters", f"{KEYS} n_clusters largest", "",
    "WITH RECURSIVE q AS (SELECT *, quantile_cont(d, 0.2) OVER (PARTITION BY sequence_id, idx, sensor) AS b FROM grid), m AS (SELECT sequence_id * 1000 + idx * 10 + sensor AS f, sequence_id, idx, sensor, pixel FROM q WHERE d < b), r AS (SELECT f, pixel AS root, pixel FROM m UNION SELECT m.f, r.root, m.pixel FROM r JOIN m ON m.f = r.f AND ((abs(m.pixel - r.pixel) = 8) OR (abs(m.pixel - r.pixel) = 1 AND m.pixel // 8 = r.pixel // 8))), l AS (SELECT f, pixel, min(root) AS root FROM r GROUP BY 1, 2), s AS (SELECT f, root, count(*) AS n FROM l GROUP BY 1, 2), c AS (SELECT f, count(*) AS k, max(n) AS n FROM s GROUP BY 1), a AS (SELECT DISTINCT sequence_id, idx, sensor, sequence_id * 1000 + idx * 10 + sensor AS f FROM grid) SELECT sequence_id, idx, sensor, coalesce(k, 0) AS n_clusters, coalesce(n, 0) AS largest FROM a LEFT JOIN c USING (f)",
)
def _(t):
    a = G.as_arrays(t.grid)
    known = F.array_sort(F.filter("a", lambda x: x.isNotNull()))
    at = (F.size("k") - 1) * 0.2
    low = F.get("k", F.floor(at).cast("int"))
    limit = low + (F.coalesce(F.get("k", F.floor(at).cast("int") + 1), low) - low) * (at - F.floor(at))
    a = a.withColumn("k", known).withColumn("limit", limit)
    a = a.withColumn("labels", F.filter(G.cluster_labels(F.transform("a", lambda x: F.coalesce(x < F.col("limit"), F.lit(False)))), lambda x: x > 0))
    sizes = F.transform(F.array_distinct("labels"), lambda c: F.size(F.filter("labels", lambda x: x == c)))
    return a.withColumn("s", sizes).select(*G.FRAME, F.size("s").cast("long").alias("n_clusters"), F.coalesce(F.array_max("s"), F.lit(0)).cast("long").alias("largest"))


@query("g15_mirror", f"{KEYS} pixel", "d", "SELECT sequence_id, idx, sensor, CASE WHEN sequence_id % 2 = 1 THEN pixel // 8 * 8 + 7 - pixel % 8 ELSE pixel END AS pixel, d FROM grid")
def _(t):
    m = G.as_arrays(t.grid).withColumn("m", G.mirrored(F.col("a"), F.col("sequence_id") % 2 == 1))
    return m.select(*G.FRAME, F.posexplode("m").alias("pixel", "d")).withColumn("pixel", F.col("pixel").cast("long"))


@query("g17_frame_to_sequence", "sequence_id sensor", "mean std speed", "WITH f AS (SELECT sequence_id, sensor, idx, avg(d) AS m FROM grid GROUP BY 1, 2, 3), s AS (SELECT *, m - lag(m) OVER (PARTITION BY sequence_id, sensor ORDER BY idx) AS st FROM f) SELECT sequence_id, sensor, avg(m) AS mean, stddev_pop(m) AS std, avg(abs(st)) AS speed FROM s GROUP BY 1, 2", digits=5)
def _(t):
    w = Window.partitionBy("sequence_id", "sensor").orderBy("idx")
    s = G.per_frame(t.grid, {"m": F.avg("d")}).withColumn("st", F.col("m") - F.lag("m").over(w))
    return s.groupBy("sequence_id", "sensor").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.avg(F.abs("st")).alias("speed"))


@query("g19_grid_pca", KEYS, " ".join(f"pc{i}" for i in range(1, 9)) + " error")
def _(t):
    """Eight components per sensor, fitted on the even sequences, and the mean squared error of the frame built from them."""
    return G.sensor_components(t.grid.na.fill(0, ["d"]), F.col("sequence_id") % 2 == 0)


@query("g20_sensor_sync", "sequence_id", "share", "WITH f AS (SELECT sequence_id, idx, sensor, min(d) AS m FROM grid GROUP BY 1, 2, 3), q AS (SELECT *, m < quantile_cont(m, 0.2) OVER (PARTITION BY sequence_id, sensor) AS near FROM f), n AS (SELECT sequence_id, idx, count(*) FILTER (near) AS k FROM q GROUP BY 1, 2) SELECT sequence_id, avg((k >= 3)::INT) AS share FROM n GROUP BY 1")
def _(t):
    f = G.per_frame(t.grid, {"m": F.min("d")})
    q = S.with_quantiles(f, "m", (0.2,), ["sequence_id", "sensor"], "q").withColumn("near", F.col("m") < F.col("q")[0])
    n = q.groupBy("sequence_id", "idx").agg(F.count_if("near").alias("k"))
    return n.groupBy("sequence_id").agg(F.avg((F.col("k") >= 3).cast("int")).alias("share"))


@query("g21_global_minimum", "sequence_id idx", "low", "SELECT sequence_id, idx, min(d) AS low FROM grid GROUP BY 1, 2")
def _(t):
    return t.grid.groupBy("sequence_id", "idx").agg(F.min("d").alias("low"))


@query("g22_hot_spots", KEYS, "mean hot", "WITH f AS (SELECT *, avg(d) OVER p AS m, stddev_pop(d) OVER p AS s FROM grid WINDOW p AS (PARTITION BY sequence_id, idx, sensor)) SELECT sequence_id, idx, sensor, coalesce(avg(d), 0) AS mean, coalesce((count(*) FILTER (d > m + s))::DOUBLE / nullif(count(d), 0), 0) AS hot FROM f GROUP BY 1, 2, 3")
def _(t):
    w = Window.partitionBy(*G.FRAME)
    f = t.grid.withColumn("limit", F.avg("d").over(w) + F.stddev_pop("d").over(w))
    return G.per_frame(f, {"mean": G.zero(F.avg("d")), "hot": S.ratio(F.count_if(F.col("d") > F.col("limit")), F.count("d"))})


@query("g25_cross_modal", "sequence_id sensor other", "r", "WITH f AS (SELECT sequence_id, idx, sensor, min(d) AS m, count(d)::DOUBLE / count(*) AS v FROM grid GROUP BY 1, 2, 3) SELECT a.sequence_id, a.sensor, b.sensor AS other, coalesce(covar_pop(a.m, b.v) / nullif(stddev_pop(a.m) FILTER (b.v IS NOT NULL) * stddev_pop(b.v) FILTER (a.m IS NOT NULL), 0), 0) AS r FROM f AS a JOIN f AS b USING (sequence_id, idx) WHERE a.sensor <> b.sensor GROUP BY 1, 2, 3", digits=5)
def _(t):
    """Nearest distance of each sensor against the valid share of every other."""
    return G.sensor_pairs(t.grid, F.min("d"), F.count("d") / F.count("*"))


@query("g27_centre_edge", f"{KEYS} top_cell", "ratio", f"WITH r AS (SELECT *, {_REGION} AS r FROM grid) SELECT sequence_id, idx, sensor, coalesce(arg_max(pixel, d), -1) AS top_cell, coalesce(avg(d) FILTER (r = 0) / nullif(avg(d) FILTER (r = 2), 0), 0) AS ratio FROM r GROUP BY 1, 2, 3")
def _(t):
    r = t.grid.withColumn("r", G.region())
    part = lambda i: F.avg(F.when(F.col("r") == i, F.col("d")))
    return G.per_frame(r, {"top_cell": F.coalesce(F.max_by("pixel", "d"), F.lit(-1)), "ratio": S.ratio(part(0), part(2))})
