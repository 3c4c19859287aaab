"""Queries: windows (W), sorts and top-k (T), set operations (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqspark.operators import stats as S
from seqspark.operators import windows as O
from seqspark.plans.registry import query

OVER = "OVER (PARTITION BY sequence_id ORDER BY idx)"


@query("w01_difference", "sequence_id idx", "step", f"SELECT sequence_id, idx, coalesce(v - lag(v) {OVER}, 0) AS step FROM fe")
def _(t):
    return t.fe.withColumn("step", F.coalesce(F.col("v") - F.lag("v").over(S.by_time()), F.lit(0.0)))


@query("w02_second_difference", "sequence_id idx", "step2", f"SELECT sequence_id, idx, v - 2 * lag(v) {OVER} + lag(v, 2) {OVER} AS step2 FROM fe")
def _(t):
    w = S.by_time()
    return t.fe.withColumn("step2", F.col("v") - 2 * F.lag("v").over(w) + F.lag("v", 2).over(w))


def _rolling_sql(sizes, std_max=False):
    cols = ", ".join(f"avg(v) OVER w{k} AS m{k}, stddev_samp(v) OVER w{k} AS s{k}" for k in sizes)
    wins = ", ".join(f"w{k} AS (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in sizes)
    out = ", ".join(f"avg(m{k}) AS mean_mean{k}, stddev_samp(m{k}) AS mean_std{k}, avg(s{k}) AS std_mean{k}, " + (f"max(s{k}) AS std_max{k}" if std_max else f"stddev_samp(s{k}) AS std_std{k}") for k in sizes)
    return f"WITH r AS (SELECT sequence_id, {cols} FROM fe WINDOW {wins}) SELECT sequence_id, {out} FROM r GROUP BY 1"


def _rolling(t, sizes, std_max=False):
    """Trailing windows count from the first row on; a deviation needs two rows."""
    cols = {}
    for k in sizes:
        w = O.trailing(k)
        cols |= {f"m{k}": F.avg("v").over(w), f"s{k}": F.stddev_samp("v").over(w)}
    df = t.fe.select("sequence_id", *(c.alias(n) for n, c in cols.items()))
    out = {}
    for k in sizes:
        out |= {f"mean_mean{k}": F.avg(f"m{k}"), f"mean_std{k}": F.stddev_samp(f"m{k}"), f"std_mean{k}": F.avg(f"s{k}")}
        out |= {f"std_max{k}": F.max(f"s{k}")} if std_max else {f"std_std{k}": F.stddev_samp(f"s{k}")}
    return S.summarise(df, out)


@query("w03_rolling", "sequence_id", " ".join(f"mean_mean{k} mean_std{k} std_mean{k} std_std{k}" for k in (10, 20, 40)), _rolling_sql((10, 20, 40)), digits=5)
def _(t):
    return _rolling(t, (10, 20, 40))


@query("w04_rolling_wide", "sequence_id", " ".join(f"mean_mean{k} mean_std{k} std_mean{k} std_max{k}" for k in (5, 20, 50)), _rolling_sql((5, 20, 50), True), digits=5)
def _(t):
    return _rolling(t, (5, 20, 50), True)


@query("w05_centred_mean", "sequence_id", "mean std p10 p90", "WITH r AS (SELECT sequence_id, avg(v) OVER w AS m FROM fe WINDOW w AS (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) SELECT sequence_id, avg(m) AS mean, stddev_pop(m) AS std, quantile_cont(m, 0.1) AS p10, quantile_cont(m, 0.9) AS p90 FROM r GROUP BY 1")
def _(t):
    w = O.centred(10)
    p = F.percentile("m", F.array(F.lit(0.1), F.lit(0.9)))
    return S.summarise(t.fe.withColumn("m", F.avg("v").over(w)), {"mean": F.avg("m"), "std": F.stddev_pop("m"), "p10": p[0], "p90": p[1]})


_TAILS = {"s": (30, 20), "m": (80, 60), "l": (256, 200)}  # the last so many rows, of sequences that have so many at least


@query(
    "w06_tail_windows", "sequence_id", " ".join(f"mean_{k} std_{k}" for k in _TAILS),
    "WITH r AS (SELECT sequence_id, ax, row_number() OVER (PARTITION BY sequence_id ORDER BY idx DESC) AS k, count(*) OVER (PARTITION BY sequence_id) AS n FROM fv) SELECT sequence_id, " + ", ".join(f"avg(ax) FILTER (k <= {size} AND n >= {least}) AS mean_{k}, stddev_pop(ax) FILTER (k <= {size} AND n >= {least}) AS std_{k}" for k, (size, least) in _TAILS.items()) + " FROM r GROUP BY 1", digits=5,
)
def _(t):
    df = t.fv.withColumns({"k": O.from_end(), "n": F.count("*").over(S.whole())})
    part = {k: (F.col("k") <= size) & (F.col("n") >= least) for k, (size, least) in _TAILS.items()}
    return S.summarise(df, {f"{a}_{k}": f(F.when(c, F.col("ax"))) for k, c in part.items() for a, f in (("mean", F.avg), ("std", F.stddev_pop))})


@query(
    "w07_energy_window", "sequence_id centre n_rows", "mean",
    "WITH r AS (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n, CASE WHEN count(*) OVER w = 20 THEN sqrt(avg(v * v) OVER w) END AS rms FROM fe WINDOW w AS (PARTITION BY sequence_id ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), c AS (SELECT *, coalesce(first_value(idx) OVER (PARTITION BY sequence_id ORDER BY CASE WHEN rms IS NULL THEN 1 ELSE 0 END, round(rms, 6) DESC, idx), 0) AS centre FROM r) SELECT sequence_id, max(centre) AS centre, count(*) AS n_rows, avg(v) AS mean FROM c WHERE idx BETWEEN least(greatest(centre - 10, 0), greatest(n - 20, 0)) AND least(greatest(centre - 10, 0), greatest(n - 20, 0)) + 19 GROUP BY 1",
)
def _(t):
    w = O.trailing(20)
    df = t.fe.withColumns({"n": F.count("*").over(S.whole()), "rms": O.full(F.sqrt(F.avg(F.col("v") * F.col("v")).over(w)), w, 20)})
    best = F.max(F.when(F.col("rms").isNotNull(), F.struct(F.round("rms", 6), -F.col("idx")))).over(S.whole())
    df = df.withColumn("centre", F.coalesce(-best.getField("col2"), F.lit(0)))
    start = F.least(F.greatest(F.col("centre") - 10, F.lit(0)), F.greatest(F.col("n") - 20, F.lit(0)))
    return S.summarise(df.where(F.col("idx").between(start, start + 19)), {"centre": F.max("centre"), "n_rows": F.count("*"), "mean": F.avg("v")})


@query("w08_tail_fraction", "sequence_id n_tail", "mean std", "WITH r AS (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n FROM fe) SELECT sequence_id, count(*) AS n_tail, avg(v) AS mean, stddev_pop(v) AS std FROM r WHERE n < 10 OR n - idx <= greatest(round(n * 0.2), 1) GROUP BY 1")
def _(t):
    df = t.fe.withColumn("n", F.count("*").over(S.whole()))
    tail = df.where((F.col("n") < 10) | (F.col("n") - F.col("idx") <= F.greatest(F.round(F.col("n") * 0.2), F.lit(1.0))))
    return S.summarise(tail, {"n_tail": F.count("*"), "mean": F.avg("v"), "std": F.stddev_pop("v")})


@query("w09_frame_index", "sequence_id idx event_id", "", "SELECT sequence_id, idx, event_id FROM fe")
def _(t):
    return t.fe


@query("w10_longest_run", "sequence_id longest n_runs", "", "WITH i AS (SELECT *, v > 50 AS f, idx - row_number() OVER (PARTITION BY sequence_id, v > 50 ORDER BY idx) AS isl FROM fe), r AS (SELECT sequence_id, count(*) AS n FROM i WHERE f GROUP BY sequence_id, isl) SELECT sequence_id, max(n) AS longest, count(*) AS n_runs FROM r GROUP BY 1")
def _(t):
    return S.summarise(S.runs(t.fe.withColumn("f", F.col("v") > 50), "f").where("f"), {"longest": F.max("length"), "n_runs": F.count("*")})


@query("w11_phase_spans", "sequence_id phase start_idx end_idx", "", "WITH i AS (SELECT *, idx - row_number() OVER (PARTITION BY sequence_id, phase ORDER BY idx) AS isl FROM fe) SELECT sequence_id, phase, min(idx) AS start_idx, max(idx) AS end_idx FROM i GROUP BY sequence_id, phase, isl")
def _(t):
    return S.runs(t.fe, "phase").withColumnsRenamed({"start": "start_idx", "end": "end_idx"})


@query("w12_sliding_segments", "sequence_id segment n", "mean", "WITH s AS (SELECT *, unnest(range(greatest(0, (idx - 10) // 10), idx // 10 + 1)) AS segment FROM fe) SELECT sequence_id, segment, count(*) AS n, avg(v) AS mean FROM s WHERE idx BETWEEN segment * 10 AND segment * 10 + 19 GROUP BY 1, 2")
def _(t):
    ids = F.expr("sequence(greatest(0L, (idx - 10) div 10), idx div 10)")
    s = t.fe.select("sequence_id", "idx", "v", F.explode(ids).alias("segment")).where("idx between segment * 10 and segment * 10 + 19")
    return s.groupBy("sequence_id", "segment").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def _change_sql(k):
    return f"d AS (SELECT *, abs(v - lag(v) {OVER}) AS step FROM fe), l AS (SELECT *, coalesce(step > avg(step) OVER (PARTITION BY sequence_id) + {k} * stddev_pop(step) OVER (PARTITION BY sequence_id), false) AS is_change FROM d)"


@query(
    "w13_change_points", "sequence_id n_changes", "segment_mean segment_std segment_max",
    f"WITH {_change_sql(1)}, e AS (SELECT sequence_id, idx FROM l WHERE is_change UNION ALL SELECT sequence_id, 0 FROM l GROUP BY 1 UNION ALL SELECT sequence_id, count(*) FROM l GROUP BY 1), g AS (SELECT sequence_id, idx - lag(idx) OVER (PARTITION BY sequence_id ORDER BY idx) AS len FROM e) SELECT sequence_id, count(len) - 1 AS n_changes, avg(len) AS segment_mean, stddev_pop(len) AS segment_std, max(len) AS segment_max FROM g GROUP BY 1",
)
def _(t):
    edges = O.change_points(t.fe, 1.0).groupBy("sequence_id").agg(F.sort_array(F.concat(F.collect_list(F.when(F.col("is_change"), F.col("idx"))), F.array(F.lit(0).cast("long"), F.count("*")))).alias("e"))
    lens = edges.select("sequence_id", F.explode(F.transform(F.slice("e", 2, 1_000_000_000), lambda x, i: x - F.get("e", i))).alias("len"))
    return S.summarise(lens, {"n_changes": F.count("*") - 1, "segment_mean": F.avg("len"), "segment_std": F.stddev_pop("len"), "segment_max": F.max("len")})


@query("w14_change_points_2", "sequence_id n_changes", "segment_mean", f"WITH {_change_sql(2)} SELECT sequence_id, count(*) FILTER (is_change) AS n_changes, count(*)::DOUBLE / (count(*) FILTER (is_change) + 1) AS segment_mean FROM l GROUP BY 1")
def _(t):
    n = F.count_if("is_change")
    return S.summarise(O.change_points(t.fe, 2.0), {"n_changes": n, "segment_mean": F.count("*") / (n + 1)})


@query(
    "w16_unwrap", "sequence_id idx", "u",
    f"WITH a AS (SELECT sequence_id, idx, atan2(ay - 5.03, az - 4.07) AS x FROM fv), d AS (SELECT *, x - lag(x) {OVER} AS j FROM a), f AS (SELECT *, coalesce(CASE WHEN abs(j) >= pi() THEN -ceil(j / (2 * pi()) - 0.5) * 2 * pi() END, 0) AS fix FROM d) SELECT sequence_id, idx, x + sum(fix) OVER (PARTITION BY sequence_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS u FROM f", digits=5,
)
def _(t):
    return O.unwrap(t.fv.withColumn("x", F.atan2(F.col("ay") - 5.03, F.col("az") - 4.07)), "x", "u")


def _peak_sql(limit: str) -> str:
    return (
        f"WITH c AS (SELECT *, CASE WHEN v = lag(v) {OVER} THEN 0 ELSE 1 END AS ch FROM fe), r AS (SELECT *, sum(ch) OVER (PARTITION BY sequence_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM c), f AS (SELECT sequence_id, run, min(v) AS v, (min(idx) + max(idx)) // 2 AS idx FROM r GROUP BY 1, 2), "
        "p AS (SELECT *, v > lag(v) OVER w AND v > lead(v) OVER w AS top FROM f WINDOW w AS (PARTITION BY sequence_id ORDER BY run)), s AS (SELECT sequence_id, stddev_pop(v) AS sd, count(*) AS n FROM fe GROUP BY 1), "
        f"k AS (SELECT p.sequence_id, p.idx, p.v, p.idx - lag(p.idx) OVER (PARTITION BY p.sequence_id ORDER BY p.idx) AS gap FROM p JOIN s USING (sequence_id) WHERE top{limit}) "
    )


@query("w17_peaks", "sequence_id n_peaks", "height spacing", _peak_sql(" AND p.v > 0.5 * sd") + "SELECT s.sequence_id, count(k.idx) AS n_peaks, coalesce(avg(k.v), 0) AS height, coalesce(avg(gap), 0) AS spacing FROM s LEFT JOIN k USING (sequence_id) GROUP BY 1")
def _(t):
    sd = S.summarise(t.fe, {"sd": F.stddev_pop("v")})
    p = O.peaks(t.fe).join(sd, "sequence_id").where("v > 0.5 * sd").withColumn("gap", F.col("idx") - F.lag("idx").over(S.by_time()))
    found = S.summarise(p, {"n_peaks": F.count("*"), "height": F.avg("v"), "spacing": F.avg("gap")})
    return sd.select("sequence_id").join(found, "sequence_id", "left").na.fill(0)


@query("w19_peak_density", "sequence_id", "density", _peak_sql("") + "SELECT s.sequence_id, count(k.idx)::DOUBLE / max(s.n) AS density FROM s LEFT JOIN k USING (sequence_id) GROUP BY 1")
def _(t):
    n = S.summarise(t.fe, {"n": F.count("*")})
    found = S.summarise(O.peaks(t.fe), {"k": F.count("*")})
    return n.join(found, "sequence_id", "left").withColumn("density", F.coalesce("k", F.lit(0)) / F.col("n"))


@query(
    "w20_arrivals", "sequence_id n_starts", "share longest_seconds",
    "WITH q AS (SELECT *, v < quantile_cont(v, 0.2) OVER (PARTITION BY sequence_id) AS f FROM fe), i AS (SELECT *, idx - row_number() OVER (PARTITION BY sequence_id, f ORDER BY idx) AS isl FROM q), r AS (SELECT sequence_id, f, count(*) AS n FROM i GROUP BY sequence_id, f, isl) SELECT sequence_id, count(*) FILTER (f) AS n_starts, coalesce(sum(n) FILTER (f), 0)::DOUBLE / sum(n) AS share, coalesce(max(n) FILTER (f), 0) / 20.0 AS longest_seconds FROM r GROUP BY 1",
)
def _(t):
    near = S.with_quantiles(t.fe, "v", (0.2,), ["sequence_id"], "q").withColumn("f", F.col("v") < F.col("q")[0])
    length = F.when(F.col("f"), F.col("length"))
    return S.summarise(S.runs(near, "f"), {"n_starts": F.count_if("f"), "share": F.coalesce(F.sum(length), F.lit(0)) / F.sum("length"), "longest_seconds": F.coalesce(F.max(length), F.lit(0)) / 20})


@query("w22_angle_steps", "sequence_id", "mean_abs max_abs", f"WITH a AS (SELECT sequence_id, idx, abs(atan2(ay, az) - lag(atan2(ay, az)) {OVER}) AS s FROM fv) SELECT sequence_id, avg(s) AS mean_abs, max(s) AS max_abs FROM a GROUP BY 1")
def _(t):
    df = S.lagged_steps(t.fv.withColumn("a", F.atan2("ay", "az")), "a", "s")
    return S.summarise(df, {"mean_abs": F.avg(F.abs("s")), "max_abs": F.max(F.abs("s"))})


@query("w23_share_edge", "sequence_id median_idx edge_idx", "", "WITH c AS (SELECT sequence_id, idx, sum(v) OVER (PARTITION BY sequence_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s, sum(v) OVER (PARTITION BY sequence_id) AS total FROM fe) SELECT sequence_id, min(idx) FILTER (s >= 0.5 * total) AS median_idx, min(idx) FILTER (s >= 0.85 * total) AS edge_idx FROM c GROUP BY 1")
def _(t):
    s = F.sum("v").over(S.by_time().rowsBetween(Window.unboundedPreceding, 0))
    df = t.fe.withColumns({"s": s, "total": F.sum("v").over(S.whole())})
    return S.summarise(df, {"median_idx": F.min(F.when(F.col("s") >= 0.5 * F.col("total"), F.col("idx"))), "edge_idx": F.min(F.when(F.col("s") >= 0.85 * F.col("total"), F.col("idx")))})


@query("w21_smoothed_probabilities", "row_id class", "p", "WITH l AS (SELECT row_id, unnest(p) AS p, unnest(range(10)) AS class FROM proba), w AS (SELECT *, [lag(p, 2) OVER o, lag(p) OVER o, p, lead(p) OVER o, lead(p, 2) OVER o] AS n, first_value(p) OVER o AS a, last_value(p) OVER (PARTITION BY class ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM l WINDOW o AS (PARTITION BY class ORDER BY row_id)) SELECT row_id, class, (coalesce(n[1], a) + coalesce(n[2], a) + n[3] + coalesce(n[4], b) + coalesce(n[5], b)) / 5 AS p FROM w")
def _(t):
    return O.smoothed_classes(t.proba, "row_id", "p", 10)


@query("t01_order", "sequence_id idx event_id place", "", "SELECT sequence_id, idx, event_id, row_number() OVER (PARTITION BY phase ORDER BY sequence_id, idx) AS place FROM fe")
def _(t):
    return t.fe.withColumn("place", F.row_number().over(Window.partitionBy("phase").orderBy("sequence_id", "idx")).cast("long"))


@query("t02_top_frames", "sequence_id place idx", "v", "SELECT sequence_id, place, idx, v FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY v DESC, idx) AS place FROM fe) AS r WHERE place <= 5")
def _(t):
    return t.fe.withColumn("place", F.row_number().over(Window.partitionBy("sequence_id").orderBy(F.desc("v"), "idx")).cast("long")).where("place <= 5")


@query("t03_top_orders", "o_orderkey", "o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return t.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("t04_argmax", "row_id class", "", "SELECT row_id, list_position(p, list_max(p))::BIGINT - 1 AS class FROM proba")
def _(t):
    return t.proba.withColumn("class", F.array_position("p", F.array_max("p")) - 1)


@query("t05_top_classes", "row_id place class", "p", "WITH l AS (SELECT row_id, unnest(p) AS p, unnest(range(10)) AS class FROM proba), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, class) AS place FROM l) SELECT row_id, place, class, p FROM r WHERE place <= 5")
def _(t):
    ranked = F.slice(F.reverse(F.array_sort(F.transform("p", lambda x, i: F.struct(x.alias("p"), (-i).cast("long").alias("class"))))), 1, 5)
    return t.proba.select("row_id", F.posexplode(ranked).alias("place", "x")).select("row_id", (F.col("place") + 1).cast("long").alias("place"), (-F.col("x.class")).alias("class"), "x.p")


@query("t06_first_events", "sequence_id idx phase", "", "SELECT sequence_id, idx, phase FROM fe WHERE idx < 3")
def _(t):
    return t.fe.where("idx < 3")


@query("t07_first_sequence", "phase sequence_id", "", "SELECT phase, arg_min(sequence_id, event_id) AS sequence_id FROM fe GROUP BY 1")
def _(t):
    return t.fe.groupBy("phase").agg(F.min_by("sequence_id", "event_id").alias("sequence_id"))


@query("u01_union_by_name", "id", "a b", "SELECT o_orderkey AS id, o_totalprice AS a, 0 AS b FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 0, c_acctbal FROM customer")
def _(t):
    left = t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"))
    right = t.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b"))
    return left.unionByName(right, allowMissingColumns=True).na.fill(0)


@query("u02_tagged_union", "dataset key n", "", "SELECT 'train' AS dataset, c_nationkey::BIGINT AS key, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'test', s_nationkey::BIGINT, count(*) FROM supplier GROUP BY 2")
def _(t):
    a = t.table("customer").select(F.col("c_nationkey").cast("long").alias("key")).withColumn("dataset", F.lit("train"))
    b = t.table("supplier").select(F.col("s_nationkey").cast("long").alias("key")).withColumn("dataset", F.lit("test"))
    return a.unionByName(b).groupBy("dataset", "key").agg(F.count("*").alias("n"))


@query("u03_distinct", "o_custkey", "", "SELECT DISTINCT o_custkey FROM orders")
def _(t):
    return t.table("orders").select("o_custkey").distinct()


@query("u04_except", "key", "", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t):
    return t.table("customer").select(F.col("c_custkey").alias("key")).subtract(t.table("orders").select("o_custkey"))


@query("u05_intersect", "key", "", "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(t):
    return t.table("customer").select(F.col("c_custkey").alias("key")).intersect(t.table("orders").select("o_custkey"))
