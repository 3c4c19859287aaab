"""Operators on hand-made rows, kernels against their definitions, and the streaming jobs against batches."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import clean, ensemble, grid, rotation, spectral
from seqspark.operators import stats as S
from seqspark.operators import windows as W
from seqspark.sources.frames import Tables
from seqspark.streaming import frames as X
from seqspark.streaming import stateful


def series(spark, values, sequence=1):
    return spark.createDataFrame([(sequence, i, None if v is None else float(v)) for i, v in enumerate(values)], "sequence_id long, idx long, v double")


def test_moments(spark):
    df = series(spark, [1, 2, 4, 8, 16, 3, 5])
    r = S.summarise(df, {**S.moments(F.col("v")), "r": S.safe_corr(F.col("idx"), F.col("v")), **S.quantiles(F.col("v"))}).head()
    assert math.isclose(r["skew"], 1.317538, abs_tol=1e-6) and math.isclose(r["kurt"], 0.521079, abs_tol=1e-6) and math.isclose(r["r"], 0.391254, abs_tol=1e-6)
    assert (r["q25"], r["median"], r["q75"]) == (2.5, 4, 6.5)
    c = S.summarise(df, S.corrected_moments(F.col("v"))).head()
    assert math.isclose(c["skew"], 1.707725, abs_tol=1e-6) and math.isclose(c["kurt"], 3.050591, abs_tol=1e-6)


def test_constant_and_single(spark):
    for values in ([5, 5, 5], [1]):
        r = S.summarise(series(spark, values), {**S.moments(F.col("v")), **{"c_" + k: c for k, c in S.corrected_moments(F.col("v")).items()}, "r": S.safe_corr(F.col("idx"), F.col("v"))}).head()
        assert [r[k] for k in ("skew", "kurt", "c_skew", "c_kurt", "r")] == [0] * 5


def test_segments_and_runs(spark):
    assert [r["seg"] for r in S.segment(series(spark, range(10)), 3).orderBy("idx").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    runs = S.runs(series(spark, [0, 1, 1, 0, 1]).withColumn("f", F.col("v") > 0), "f").where("f").orderBy("start").collect()
    assert [(r["start"], r["end"], r["length"]) for r in runs] == [(1, 2, 2), (4, 4, 1)]


def test_centred_window_and_peaks(spark):
    df = series(spark, range(20)).withColumn("m", F.avg("v").over(W.centred(4)))
    assert df.where("idx = 8").head()["m"] == 7.5
    assert [r["idx"] for r in W.peaks(series(spark, [0, 1, 0, 2, 2, 2, 1, 3])).orderBy("idx").collect()] == [1, 4]


def test_fills(spark):
    df = series(spark, [None, 1, None, None, 4, None]).withColumn("f", clean.fill_both_ways("v"))
    assert [r["f"] for r in clean.linear_fill(df, "v", "l").orderBy("idx").collect()] == [1, 1, 1, 1, 4, 4]
    assert [r["l"] for r in clean.linear_fill(df, "v", "l").orderBy("idx").collect()] == [1, 1, 2, 3, 4, 4]


def test_rotation(spark):
    h = math.sqrt(0.5)
    df = spark.createDataFrame([(h, 0.0, 0.0, h)], "qw double, qx double, qy double, qz double")
    out = df.select(*rotation.rotate(rotation.quaternion(), (F.lit(1.0), F.lit(0.0), F.lit(0.0)))).head()
    assert np.allclose(list(out), [0, 1, 0])


def test_unwrap_is_numpys(spark):
    a = np.random.default_rng(1).uniform(-math.pi, math.pi, 60)
    got = [r["u"] for r in W.unwrap(series(spark, a), "v", "u").orderBy("idx").collect()]
    assert np.allclose(got, np.unwrap(a))


def test_spectrum_is_numpys(spark):
    x = np.random.default_rng(2).normal(size=37)
    got = [r["power"] for r in spectral.power_spectrum(series(spark, x)).orderBy("k").collect()]
    assert np.allclose(got, np.abs(np.fft.rfft(x))[1:] ** 2)


@pytest.mark.parametrize("high", [False, True])
def test_filter_response(high):
    b, a = spectral.butterworth(3, 2.0, 20.0, high)
    at = lambda f: abs(np.polyval(b, z := np.exp(2j * math.pi * f / 20)) / np.polyval(a, z))
    assert math.isclose(at(2.0), math.sqrt(0.5), rel_tol=1e-9) and math.isclose(at(10.0 if high else 0.0), 1.0, rel_tol=1e-9)
    (flat,) = spectral.filtfilt(b, a, [np.full(40, 3.0)])
    assert np.allclose(flat, 0.0 if high else 3.0, atol=1e-9)


def test_grid(spark):
    cells = [(1, 0, 1, p, 10.0 if p == 2 * 8 + 5 else None) for p in range(64)]
    df = spark.createDataFrame(cells, "sequence_id long, idx long, sensor long, pixel long, d double")
    r = grid.with_eccentricity(grid.per_frame(df, grid.weighted_moments(F.col("d")))).head()
    assert (r["cx"], r["cy"], r["m20"], r["m02"], r["ecc"]) == (5, 2, 0, 0, 0)
    spiral = [i // 8 % 2 == 0 or (i // 8 % 4 == 1 and i % 8 == 7) or (i // 8 % 4 == 3 and i % 8 == 0) for i in range(64)]
    two = [i in (0, 9) for i in range(64)]
    out = [set(spark.createDataFrame([(m,)], "m array<boolean>").select(grid.cluster_labels(F.col("m")).alias("l")).head()["l"]) - {0} for m in (spiral, two)]
    assert out == [{1}, {1, 10}]


def test_probabilities(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2], [0.0, 0.0, 0.0], None)], "p array<double>, z array<double>, q array<double>")
    r = df.select(ensemble.argmax(F.col("p")).alias("a"), ensemble.temperature(F.array(F.lit(0.5), F.lit(0.5)), 3.0).alias("t"), ensemble.normalised(F.col("z")).alias("z"), ensemble.blend([F.col("p"), F.col("q")], [0.3, 0.7]).alias("b")).head()
    assert r["a"] == 0 and np.allclose(r["t"], [0.5, 0.5]) and r["z"] == [0, 0, 0] and np.allclose(r["b"], [0.4, 0.4, 0.2])


def test_hierarchical_score(spark):
    for truth, said, want in ((1, 2, 0.5), (1, 9, 0.0), (1, 1, 1.0)):
        df = spark.createDataFrame([(truth, said)] * 4, "y long, h long")
        assert ensemble.hierarchical_f1(df, "y", "h", 8).head()["score"] == want


def test_stream_matches_batch(spark, sf, tmp_path):
    t = Tables(spark, sf)
    rows = t.fe.select("sequence_id", "idx", "v", "phase", "ts").where("sequence_id < 8")
    for k in range(2):
        rows.where("idx % 1000 < 30" if k == 0 else "idx % 1000 >= 30").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stateful.use_rocksdb(spark)
    got = {}
    for _ in range(2):  # a file each time; processing-time state has no end of its own to wait for
        q = stateful.running_features(stream, 3_600_000).writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({r["sequence_id"]: {"x": r} for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/c1").trigger(once=True).start()
        assert q.awaitTermination(60)
    for r in rows.groupBy("sequence_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        x = got[r["sequence_id"]]["x"]
        assert x["n"] == r["n"] and math.isclose(x["mean"], r["mean"]) and (x["low"], x["high"]) == (r["low"], r["high"])
    q = X.windowed(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    key = ["start_second", "phase", "n"]
    assert sorted(map(tuple, spark.table("windows").select(*key).collect())) == sorted(map(tuple, X.windowed(rows).select(*key).collect()))


def test_completed_sequences_are_scored(spark, sf, tmp_path):
    t = Tables(spark, sf)
    rows = t.fe.select("sequence_id", "v", "ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    seen = []
    q = X.score_completed(stream, "2 days", lambda df, n: seen.extend(df.collect()), f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    assert seen and all(r["n"] >= 1 for r in seen)


def test_quaternion_repair():
    from seqspark.operators.kernels import repair_quaternions

    nan = float("nan")
    out = repair_quaternions(np.array([[0.7, -0.1, 0.5, 0.5], [0.6, nan, 0, 0], [nan, nan, 0, 0], [0, 0, 0, 0], [1, nan, 0.5, 0]]))
    assert np.allclose(out[1], [0.6, -0.8, 0, 0]) and (out[2:] == [1, 0, 0, 0]).all()


def test_prominent_peaks():
    from seqspark.operators.kernels import prominent_peaks

    x = np.array([0, 3, 2.5, 2.8, 0, 1, 0, 5, 0], float)
    assert prominent_peaks(x, 0.5, 1).tolist() == [1, 5, 7] and prominent_peaks(x, 0.1, 1).tolist() == [1, 3, 5, 7] and prominent_peaks(x, 0.1, 3).tolist() == [1, 7]


def test_wavelet_keeps_the_energy():
    from seqspark.operators.kernels import DB4, wavelet_levels

    assert math.isclose((DB4**2).sum(), 1, rel_tol=1e-9) and math.isclose(DB4.sum(), math.sqrt(2), rel_tol=1e-9)
    flat = wavelet_levels(np.full(64, 2.0))
    assert all(np.allclose(d, 0) for d in flat[:-1]) and np.allclose(flat[-1], 2 * math.sqrt(8))


def test_weight_search_returns_the_best_of_all_trials(spark, sf):
    from seqspark.plans import catalog

    got = catalog.queries()["m20_weight_search"](spark, sf).collect()
    assert len(got) == 1 and 0 <= got[0]["trial"] < 1024
    rows = Tables(spark, sf).proba
    raw = spark.range(1024).withColumnRenamed("id", "trial").select("trial", *(clean.draw(20 + i, "trial").alias(f"d{i}") for i in (1, 2, 3))).toPandas().to_numpy()
    w = raw[:, 1:] / raw[:, 1:].sum(1, keepdims=True)
    data = rows.select("y", "p", "p2", "p3").toPandas()
    y, p = data.y.to_numpy(), [np.array(data[c].tolist()) for c in ("p", "p2", "p3")]

    def score(v):
        h = (v[0] * p[0] + v[1] * p[1] + v[2] * p[2]).argmax(1)
        f1 = lambda a, b: 2 * (a & b).sum() / (a.sum() + b.sum())
        t, q = np.where(y < 4, y, 99), np.where(h < 4, h, 99)
        return (f1(y < 4, h < 4) + np.mean([f1(t == k, q == k) for k in sorted({*t, *q})])) / 2

    scores = np.array([score(v) for v in w])
    assert math.isclose(got[0]["score"], scores.max(), abs_tol=1e-6) and math.isclose(scores[int(raw[:, 0].tolist().index(got[0]["trial"]))], scores.max(), abs_tol=1e-9)
    assert np.allclose([got[0][f"w{i}"] for i in (1, 2, 3)], w[raw[:, 0].tolist().index(got[0]["trial"])], atol=1e-6)


def test_oversampling_sees_the_whole_class(spark, sf):
    from seqspark.plans import catalog

    e = Tables(spark, sf).table("embeddings").select("vec_id", "label", "embedding").toPandas()
    n = e.groupby("label").vec_id.count()
    rare = sorted(n.index, key=lambda c: (n[c], c))[:3]
    got = {r["vec_id"]: r for r in catalog.queries()["m10_oversample"](spark, sf).collect()}
    assert set(got) == set(e[e.label.isin(rare)].vec_id)
    x = {v: np.array(a, float) for v, a in zip(e.vec_id, e.embedding)}
    for c in rare:
        ids = e[e.label == c].vec_id.tolist()
        for v in ids:
            near = sorted((((x[v] - x[o]) ** 2).sum(), o) for o in ids if o != v)[:3]
            assert got[v]["neighbour"] in [o for _, o in near]
            lam = int(hashlib.md5(f"4:{v}".encode()).hexdigest()[:8], 16) / 2**32
            point = x[v] + (x[got[v]["neighbour"]] - x[v]) * lam
            assert [got[v][c] for c in ("x0", "x1", "x2", "total")] == pytest.approx([*point[:3], point.sum()], abs=2e-6)
    rows = spark.createDataFrame([(v, 1, x[v].tolist(), len(x)) for v in x], "vec_id long, label int, x array<double>, n long")
    one, many = (sorted((r["vec_id"], r["k"], r["neighbour"]) for r in clean.nearest_of_class(rows, 3, b, pivots=p).collect()) for b, p in ((10**6, 1), (40, None)))
    assert one == many


def test_nearest_rows_by_pivots_skip_most_pairs(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 8)) * 50
    x = np.concatenate([c + r.normal(size=(50, 8)) for c in centres] + [np.repeat(centres[:1], 30, 0)])
    df = spark.createDataFrame([(i, "c", v.tolist(), len(x)) for i, v in enumerate(x)], "vec_id long, label string, x array<double>, n long")
    compared = spark.sparkContext.accumulator(0)
    got = {(row["vec_id"], row["k"]): row["neighbour"] for row in clean.nearest_of_class(df, 3, 16, pivots=200, compared=compared).collect()}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [got[i, k] for k in (1, 2, 3)] == np.lexsort((np.arange(len(x)), d))[:3].tolist()
    assert compared.value < 0.1 * len(x) ** 2
