"""Folds against the exhaustive best, and quantiles of tables on all kinds of doubles."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import folds as K
from seqspark.operators import stats as S


def test_greedy_folds_near_the_best_of_all():
    draw = np.random.default_rng(3)
    worst = 0.0
    for _ in range(5):
        counts = draw.integers(0, 40, (12, 3)).astype(float)
        order = np.argsort(-(3 * (counts**2).sum(1) - counts.sum(1) ** 2), kind="stable")
        got = K.imbalance(counts[order], K.assign(counts[order], 3), 3)
        shares = counts / counts.sum(0)
        every = np.array(list(itertools.product(range(3), repeat=11)), np.int8)
        every = np.hstack([np.zeros((len(every), 1), np.int8), every])  # folds are alike, so the first group may stand in the first
        sums = np.stack([(every == f).astype(np.float32) @ shares.astype(np.float32) for f in range(3)], 1)
        best = float(sums.std(axis=1).mean(axis=1).min())
        assert got <= best + 0.5 * shares.max()
        worst = max(worst, got)
    assert worst < 0.07


@pytest.mark.parametrize("units", [4096, 6])
def test_whole_groups_with_even_labels(spark, units):
    draw = random.Random(1)
    rows = [(g, draw.choice("abc") if g % 4 else draw.choice("aab")) for g in range(120) for _ in range(draw.randrange(1, 30))] + [(500, "c")] * 700 + [(None, None)] * 20
    df = spark.createDataFrame(rows, "g long, label string")
    got = K.stratified_group_folds(df, "g", "label", k=4, units=units).collect()
    assert len(got) == len({r["g"] for r in got}) == 122 and sum(r["n"] for r in got) == len(rows)
    fold = {r["g"]: r["fold"] for r in got}
    for label in "ab":
        n = [sum(1 for g, x in rows if x == label and fold[g] == f) for f in range(4)]
        assert max(n) - min(n) <= (0.05 if units > 100 else 0.35) * sum(n)


def test_folds_of_nothing_and_of_one_label(spark):
    schema = "g long, label string"
    assert K.stratified_group_folds(spark.createDataFrame([], schema), "g", "label").count() == 0
    got = K.stratified_group_folds(spark.createDataFrame([(g, "x") for g in range(10)], schema), "g", "label", k=5).collect()
    assert sorted(r["fold"] for r in got) == sorted([0, 1, 2, 3, 4] * 2)


NAN, INF = math.nan, math.inf


@pytest.mark.parametrize(
    "values",
    [[1.0, NAN, 2.0], [1.0, INF, 2.0, 3.0], [-1.5e308, 0.0, 1.5e308, 1.0], [5e-324, -5e-324, 0.0, -0.0, 1e-310], [NAN], [-INF, INF], [INF, INF, NAN, NAN], [7.0] * 50, list(range(1000)), [None, 3.0, None], [1e300 * k for k in range(-50, 50)], [1.0 + k * 2.0**-52 for k in range(97)]],
)
def test_quantiles_of_all_doubles(spark, values, monkeypatch):
    scans = []
    real = S._radix_counts
    monkeypatch.setattr(S, "_radix_counts", lambda *a: scans.append(1) or real(*a))
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double").repartition(3)
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = S.table_quantiles(df, "v", probs)
    kept = sorted((float(v) for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    for p, g in zip(probs, got):
        at = p * (len(kept) - 1)
        a, b = kept[math.floor(at)], kept[math.ceil(at)]
        part = at % 1
        want = a if a == b or not part else a * (1 - part) + b * part
        assert g == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True)
    assert len(scans) <= 6


def test_quantiles_of_nothing(spark):
    assert S.table_quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)) == [None]
    assert S.table_quantiles(spark.range(4).select(F.lit(None).cast("double").alias("v")), "v", (0.5, 1.0)) == [None, None]


def test_bits_keep_the_order():
    v = np.array([-INF, -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e308, INF, NAN])
    k = S.ordered_bits(v)
    assert (k[1:] > k[:-1]).all() and S.ordered_bits(np.array([-0.0])) == S.ordered_bits(np.array([0.0]))
    assert [S.from_ordered_bits(int(x)) for x in k[:-1]] == v[:-1].tolist() and math.isnan(S.from_ordered_bits(int(k[-1])))


def test_dealt_folds_split_a_hot_class(spark):
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else None)) for i in range(3000)]
    got = K.dealt_folds(spark.createDataFrame(rows, "id long, c string"), "c", "id").collect()
    assert len(got) == 3000
    for c in ("hot", "b", None):
        mine = [r for r in got if r["c"] == c]
        n = [sum(r["fold"] == f for r in mine) for f in range(5)]
        assert max(n) - min(n) <= 1 and sum(r["is_test"] for r in mine) == round(len(mine) * 0.2)
