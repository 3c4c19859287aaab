"""Values of queries that have no SQL form, against numpy or against the operator taken apart; streams against batches."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqspark.functions import features as U
from seqspark.functions import scoring as Z
from seqspark.operators import channels as H
from seqspark.operators import clean, ensemble, grid, kernels, spectral
from seqspark.plans import catalog
from seqspark.sources.frames import Tables
from seqspark.streaming import frames as X

Q = catalog.queries()


@pytest.fixture(scope="module")
def emb(sf):
    e = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id").reset_index(drop=True)
    return e, np.array(e.embedding.tolist(), float)


def draw(seed, *keys):
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / 2**32


def normal(seed, *keys):
    return math.sqrt(-2 * math.log(max(draw(seed, *keys), 2.0**-32))) * math.cos(2 * math.pi * draw(seed + 1000, *keys))


def test_components_per_sensor(spark, sf, emb):
    e, x = emb
    d = np.where(x >= 0, x * 254, 0.0)
    got = Q["g19_grid_pca"](spark, sf).toPandas()
    assert len(got) == len(e)
    got["vec_id"] = got.sequence_id * 50 + got.idx * 5 + got.sensor - 1
    got = got.set_index("vec_id")
    for s in range(1, 6):
        mine = e.vec_id % 5 + 1 == s
        fit = (mine & (e.vec_id // 50 % 2 == 0)).to_numpy()
        mu = d[fit].mean(0)
        _, _, axes = np.linalg.svd(d[fit] - mu, full_matrices=False)
        axes = axes[:8]
        for i in np.flatnonzero(mine.to_numpy()):
            r = got.loc[e.vec_id[i]]
            c = d[i] - mu
            assert np.allclose(np.abs(r[[f"pc{k}" for k in range(1, len(axes) + 1)]].to_numpy(float)), np.abs(axes @ c), atol=1e-3)
            assert math.isclose(r.error, ((c - axes.T @ (axes @ c)) ** 2).mean(), rel_tol=1e-4, abs_tol=1e-3)


def test_fold_safe_components(spark, sf):
    t = Tables(spark, sf)
    rows = t.fv.groupBy("sequence_id").agg(F.avg("ax").alias("a"), F.stddev_pop("ay").alias("b"), F.max("ax").alias("c"), F.avg("qw").alias("d"), F.avg("az").alias("e"), F.stddev_pop("az").alias("f")).toPandas()
    got = Q["m06_fold_safe_pipeline"](spark, sf).toPandas().set_index("sequence_id")
    assert sorted(got.index) == sorted(rows.sequence_id) and set(got.fold) <= set(range(5))
    for k in set(got.fold):
        fit, held = rows[rows.sequence_id % 5 != k], rows[rows.sequence_id % 5 == k]
        x = fit[list("abcdef")].to_numpy(float)
        mu, sd = x.mean(0), x.std(0, ddof=1)
        sd[sd == 0] = np.inf
        _, _, axes = np.linalg.svd((x - mu) / sd - ((x - mu) / sd).mean(0), full_matrices=False)
        want = (held[list("abcdef")].to_numpy(float) - mu) / sd @ axes[:2].T
        assert np.allclose(np.abs(got.loc[held.sequence_id, ["pc1", "pc2"]].to_numpy(float)), np.abs(want), atol=1e-4)


def test_mixup(spark, sf):
    got = Q["m08_mixup"](spark, sf).toPandas()
    p = {r["row_id"]: (r["y"], r["p"]) for r in Tables(spark, sf).proba.select("row_id", "y", "p").collect()}
    assert sorted(got.row_id) == sorted(p) and sorted(got.other) == sorted(p) and (got.row_id != got.other).all()
    for r in got.itertuples():
        lam = draw(9, r.row_id)
        assert math.isclose(r.lam, lam, abs_tol=1e-5) and math.isclose(r.label, lam * p[r.row_id][0] + (1 - lam) * p[r.other][0], abs_tol=1e-4)
        assert np.allclose([getattr(r, f"c{i}") for i in range(10)], lam * np.array(p[r.row_id][1]) + (1 - lam) * np.array(p[r.other][1]), atol=1e-5)


def test_augmentation(spark, sf):
    got = Q["m09_augment"](spark, sf).toPandas().sort_values(["sequence_id", "idx"])
    series = {s: x for s, x in got.groupby("sequence_id")}
    for s, x in series.items():
        v, n = x.v.to_numpy(), len(x)
        assert np.allclose(x.noisy, [a + 0.05 * normal(1, s, i) for i, a in enumerate(v)], atol=1e-4)
        assert np.allclose(x.magnitude, [a * (1 + 0.2 * normal(2, s, i)) for i, a in enumerate(v)], atol=1e-4)
        at = np.cumsum([1 + 0.2 * normal(3, s, i) for i in range(n)])
        assert np.allclose(x.warped, np.interp(np.arange(n), at / at[-1] * n, v), atol=1e-3)
        half = n // 2
        assert (x.mixed.to_numpy()[:half] == v[:half]).all()
        second = x.mixed.to_numpy()[half:]
        assert any(len(y) > half and np.allclose(second[: len(y) - half], y.v.to_numpy()[half:n], atol=1e-6) for k, y in series.items() if k != s or len(series) == 1)


def test_nearest_of_class(spark, sf, emb):
    e, x = emb
    got = Q["m10_oversample"](spark, sf).toPandas()
    rare = e.label.value_counts().rename_axis("label").reset_index(name="n").sort_values(["n", "label"]).label.head(3)
    assert sorted(got.vec_id) == sorted(e.vec_id[e.label.isin(rare)])
    for r in got.itertuples():
        same = e.index[(e.label == r.label) & (e.vec_id != r.vec_id)]
        i = e.index[e.vec_id == r.vec_id][0]
        near = e.vec_id[sorted(same, key=lambda j: (((x[j] - x[i]) ** 2).sum(), e.vec_id[j]))[:3]]
        assert r.neighbour in set(near)
        y = x[e.index[e.vec_id == r.neighbour][0]]
        point = x[i] + (y - x[i]) * draw(4, r.vec_id)
        assert np.allclose([r.x0, r.x1, r.x2, r.total], [*point[:3], point.sum()], atol=1e-5)


def test_fold_models(spark, sf, emb):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    e, _ = emb
    got = Q["m11_fold_model"](spark, sf).toPandas().set_index("vec_id")
    assert sorted(got.index) == e.vec_id.tolist() and set(got.predicted) <= set(range(10))
    assert all(got.fold[k] == int(draw(11, k) * 5) for k in got.index)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"), F.floor(clean.draw(11, "vec_id") * 5).alias("fold"))
    one = RandomForestClassifier(numTrees=10, maxDepth=5, seed=7, labelCol="label").fit(rows.where("fold <> 2")).transform(rows.where("fold = 2")).select("vec_id", "prediction").collect()
    assert all(got.predicted[r["vec_id"]] == int(r["prediction"]) for r in one)


def test_two_stage_routing(spark, sf):
    got = Q["m12_two_stage"](spark, sf).toPandas()
    assert len(got) and ((got.gate > 0.5) == (got.predicted < 4)).all() and (got.vec_id % 2 == 1).all() and set(got.predicted) <= set(range(10))


def _hierarchical(y, h, n=4):
    y, h = np.minimum(y, n), np.minimum(h, n)
    f1 = lambda a, b: 2 * (a & b).sum() / (a.sum() + b.sum()) if (a.sum() + b.sum()) else 0.0
    classes = sorted({*y.tolist(), *h.tolist()})
    return (f1(y < n, h < n) + np.mean([f1(y == c, h == c) for c in classes])) / 2


def test_best_weights(spark, sf):
    rows = Tables(spark, sf).proba.select("y", "p", "p2", "p3").toPandas()
    y, p = rows.y.to_numpy(), [np.array(rows[c].tolist()) for c in ("p", "p2", "p3")]
    scores = []
    for k in range(1024):
        d = [draw(20 + i, k) for i in (1, 2, 3)]
        w = [x / max(sum(d), 1e-12) for x in d]
        scores.append((_hierarchical(y, sum(a * b for a, b in zip(w, p)).argmax(1)), -k))
    best = max(scores)
    got = Q["m20_weight_search"](spark, sf).collect()[0]
    assert (got["trial"], round(best[0], 6)) == (-best[1], round(got["score"], 6))


def test_metric_on_plain_cases(spark):
    score = lambda said: ensemble.hierarchical_f1(spark.createDataFrame([(1, said)] * 4, "t long, h long"), "t", "h", 4).head()["score"]
    assert score(1) == 1.0 and score(2) == 0.5 and score(9) == 0.0  # the same target, another target, no target


def test_bundle_scores_like_its_models(spark, sf, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    assert Q["s13_model_bundle"](spark, sf).count() == Tables(spark, sf).fe.select("sequence_id").distinct().count()
    r = random.Random(1)
    rows = spark.createDataFrame([(i, r.random(), r.random()) for i in range(200)], "sequence_id long, a double, b double").withColumn("label", (F.col("a") + F.col("b") > 1).cast("double"))
    fit = lambda part: Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="x"), DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=5)]).fit(part)
    models = [fit(rows.where(F.col("sequence_id") % 2 == k)) for k in range(2)]
    bundle = Z.Bundle.of(models, ["a", "b"], [3.0, 1.0], ["no", "yes"])
    assert bundle.weights == [0.75, 0.25]
    Z.save_bundle(spark, bundle, str(tmp_path / "b"))
    back = Z.load_bundle(spark, str(tmp_path / "b"))
    assert back is Z.load_bundle(spark, str(tmp_path / "b")) and (back.features, back.weights, back.classes) == (["a", "b"], [0.75, 0.25], ["no", "yes"])
    got = {x["sequence_id"]: x for x in Z.score(rows.withColumn("extra", F.lit(1)), back).collect()}
    parts = [{x["sequence_id"]: x["probability"].toArray() for x in m.transform(rows).collect()} for m in models]
    for k, x in got.items():
        want = 0.75 * parts[0][k] + 0.25 * parts[1][k]
        assert np.allclose(x["p"], want) and x["class"] == int(want.argmax()) and x["name"] == ["no", "yes"][x["class"]]
    assert np.mean([x["class"] == y["label"] for x, y in zip((got[i] for i in range(200)), rows.orderBy("sequence_id").collect())]) > 0.85
    assert Z.score(rows.drop("b"), back).count() == 200  # a feature that is missing counts as 0


def test_user_models_are_loaded_once_per_process(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda x: x["a"].map(lambda v: f"c{int(v)}")

    rows = spark.range(400).select(F.col("id").alias("sequence_id"), (F.col("id") % 3).alias("a")).repartition(12)
    for _ in range(2):
        assert {r["predicted"] for r in Z.score_with(rows, load).collect()} == {"c0", "c1", "c2"}
    made = [x.name.split("-")[0] for x in tmp_path.iterdir()]
    assert made and len(made) == len(set(made))


def test_features_by_name_and_switch(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 4, 8])] + [(2, 0, 5.0)], "sequence_id long, idx long, v double")
    with pytest.raises(ValueError):
        U.statistics(df, ["v"], ["mode"])
    with pytest.raises(ValueError):
        U.FeatureSpec.of({"colour": True})
    off = U.FeatureSpec(basic=False, quantiles=False).apply(df)
    assert off.columns == ["sequence_id", "n"]
    on = {r["sequence_id"]: r for r in U.FeatureSpec(moments=True, steps=True, ends=True).apply(df).collect()}
    assert (on[1]["line_length"], on[1]["first"], on[1]["last"], on[2]["step_mean"], on[2]["skew"]) == (7.0, 1.0, 8.0, 0.0, 0.0)
    U.register_series_feature("gaps", lambda v: {"top": float(v.diff().max()) if len(v) > 1 else None}, "top double")
    assert {r["sequence_id"]: r["top"] for r in U.series_feature(df, "gaps").collect()} == {1: 4.0, 2: None}
    assert {r["a"] for r in df.groupBy("sequence_id").agg(U.user_aggregate(lambda v: float(v.max() - v.min()))("v").alias("a")).collect()} == {7.0, 0.0}


def test_window_starts(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(47)], "sequence_id long, idx long, v double")
    got = U.windows_of(df, 20, 10).groupBy("begin").agg(F.min("idx"), F.max("idx"), F.count("*")).orderBy("begin").collect()
    assert [tuple(r) for r in got] == [(b, b, b + 19, 20) for b in range(0, 47 - 20, 10)]


def test_families_and_pixels(spark):
    assert clean.families(["quat_w", "quat_x", "quat_y", "quat_z", "rot_w", "thermal_1", "tof_2_v0", "tof_x"]) == {"rotation": ["quat_w", "quat_x", "quat_y", "quat_z"], "thermal": ["thermal_1"], "tof": ["tof_2_v0"], "sensors": [2]}
    assert clean.families([]) == {"rotation": [], "thermal": [], "tof": [], "sensors": []}
    assert grid.pixel_places(["tof_r3_c7", "tof_px27", "tof_1_v9"]) == {"tof_r3_c7": (3, 7), "tof_px27": (3, 3), "tof_1_v9": (1, 1)} and grid.pixel_places(["tof_a"]) is None
    wide = clean.unified(spark.createDataFrame([(1, 0.5)], "k long, thm_3 double"), ["k"])
    assert len(wide.columns) == 1 + 4 + 5 + 320 and wide.head()["thm_3"] == 0.5 and wide.head()["rot_w"] is None


def test_clusters_of_a_snake(spark):
    mask = [r % 2 == 0 or c == (7 if r % 4 == 1 else 0) for r in range(8) for c in range(8)]
    got = spark.createDataFrame([(mask,)], "m array<boolean>").select(grid.cluster_labels(F.col("m")).alias("c")).head()["c"]
    assert {x for x, m in zip(got, mask) if m} == {1} and {x for x, m in zip(got, mask) if not m} == {0}


def test_channels(spark):
    motion = spark.createDataFrame([(1, i, 0.0, 0.0, 9.81, 1.0, 0.0, 0.0, 0.0) for i in range(12)], "sequence_id long, idx long, ax double, ay double, az double, qw double, qx double, qy double, qz double")
    for method in ("lowpass", "median", "subtract"):
        r = H.frame_channels(motion, method=method).orderBy("idx").collect()
        assert len(r) == 12 and all(abs(x[c]) < 1e-9 for x in r for c in H.CHANNELS_18)  # at rest, without the other sensors
    assert len(H.CHANNELS_18) == 18 and len(H.CHANNELS_41) == 41
    with pytest.raises(ValueError):
        H.frame_channels(motion, method="none")


def test_rotation_of_plain_vectors(spark):
    rows = spark.createDataFrame([(1, i, *map(float, v), 1.0, 0.0, 0.0, 0.0) for i, v in enumerate([(1, 2, 3), (2, 3, 4), (3, 4, 5)])], "sequence_id long, idx long, ax double, ay double, az double, qw double, qx double, qy double, qz double")
    r = H.frame_channels(rows, method="subtract").orderBy("idx").collect()
    assert [(x["linear_acc_x"], x["linear_acc_y"], round(x["linear_acc_z"], 9), x["omega_mag"]) for x in r] == [(1, 2, -6.81, 0), (2, 3, -5.81, 0), (3, 4, -4.81, 0)]


def test_sine_has_its_frequency(spark):
    x = np.sin(2 * np.pi * 5 * np.linspace(0, 1, 100))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "sequence_id long, idx long, v double")
    top = spectral.power_spectrum(df, 100.0).orderBy(F.desc("power")).head()
    assert abs(top["freq"] - 5) <= 1.0


def test_filters_take_series_together():
    r = np.random.default_rng(0)
    series = [r.normal(size=n) for n in (1, 2, 3, 9, 10, 30, 31, 200)]
    b, a = spectral.butterworth(2, 0.75, 20.0)

    def alone(x):
        pad = min(3 * len(a), len(x) - 1)
        if pad < 1:
            return x
        ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        c = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        zi = np.linalg.solve(np.eye(2) - c, b[1:] - a[1:] * b[0])

        def run(y):
            z, out = zi * y[0], []
            for v in y:
                out.append(b[0] * v + z[0])
                z = np.array([z[1] + b[1] * v - a[1] * out[-1], b[2] * v - a[2] * out[-1]])
            return np.array(out)

        return run(run(ext)[::-1])[::-1][pad : pad + len(x)]

    for got, x in zip(spectral.filtfilt(b, a, series), series):
        assert np.allclose(got, alone(x))


def test_late_frames_on_a_stream(spark, tmp_path):
    r = random.Random(6)
    rows = [(s, k, k * 10 - (r.randrange(200) if r.random() < 0.2 else 0), k == 59) for k in range(60) for s in range(3)]
    schema = "sequence_id long, arrival long, at long, last boolean"
    table = spark.createDataFrame(rows, schema)
    want = {tuple(x) for x in X.completeness(table, 50).collect()}
    for i in range(3):
        table.where(F.col("arrival").between(i * 20, i * 20 + 19)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
        part = next((tmp_path / "in" / f"part{i}").glob("*.parquet"))
        (tmp_path / "files").mkdir(exist_ok=True)
        part.rename(tmp_path / "files" / f"{i}.parquet")
    seen = {}
    stream = X.sequence_source(spark, str(tmp_path / "files"), schema)

    def keep(batch, _):
        seen.update({x["sequence_id"]: tuple(x) for x in batch.collect()})

    X.completeness(stream, 50).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert set(seen.values()) == want and any(n_late for _, _, n_late, _ in want)


def test_quaternions_keep_their_signs():
    nan, r = np.nan, np.random.default_rng(3)
    q = r.normal(size=(50, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    lost = q.copy()
    lost[1:, 2] = nan  # the sign of the last known frame holds on
    out = kernels.repair_quaternions(lost)
    assert np.allclose(np.abs(out), np.abs(q)) and (np.sign(out[1:, 2]) == np.sign(q[0, 2])).all()


def test_table_quantiles_are_exact(spark):
    from seqspark.operators.stats import table_quantiles

    r = np.random.default_rng(1)
    for x in (r.normal(size=3000) * 10.0 ** r.integers(-9, 9, 3000), r.integers(0, 4, 500).astype(float), np.full(7, 2.5), np.array([1.0, np.nextafter(1.0, 2), 3.0])):
        df = spark.createDataFrame(pd.DataFrame({"v": x})).union(spark.createDataFrame([(None,)], "v double"))
        p = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
        assert np.allclose(table_quantiles(df, "v", p), np.quantile(x, p), rtol=1e-12, atol=0)
    assert table_quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)) == [None]
