"""Folds: groups of rows dealt so that every fold has the same share of every label."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.operators.ranks import numbered


def drawn(seed: int, key: str) -> Column:
    """A draw by which rows are ordered; the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def assign(counts: np.ndarray, k: int) -> np.ndarray:
    """The fold of each row of ``counts`` (units x labels), taken in order: that which leaves the label shares of the folds closest.

    Closest is the least mean, over labels, of the deviation of the folds'
    shares; then the fold with fewer rows, then the first.
    """
    total = np.maximum(counts.sum(0), 1)
    folds = np.zeros((k, counts.shape[1]))
    out = np.zeros(len(counts), np.int64)
    for i, c in enumerate(counts):
        tried = folds[None] + np.eye(k)[:, :, None] * c
        cost = np.round((tried / total).std(axis=1).mean(axis=1), 10)
        out[i] = min(range(k), key=lambda f: (cost[f], tried[f, f].sum(), f))
        folds[out[i]] += c
    return out


def imbalance(counts: np.ndarray, folds: np.ndarray, k: int) -> float:
    """Mean over labels of the deviation of the folds' shares."""
    sums = np.stack([counts[folds == f].sum(0) for f in range(k)])
    return float((sums / np.maximum(counts.sum(0), 1)).std(axis=0).mean())


def stratified_group_folds(rows: DataFrame, group: str, label: str, k: int = 5, seed: int = 7, units: int = 4096) -> DataFrame:
    """(group, fold, n): whole groups in ``k`` folds with like shares of each label; rows without a label count, as a label of their own.

    Groups are taken from the most uneven to the least, and each goes to the fold
    that it leaves closest to the others. The driver sees a vector of label counts
    for each unit, not for each group: a group with 1/units of a label or more is
    a unit (at most ``units`` for each label), and all others are dealt into
    ``units`` units in a drawn order. With no more groups than that, each is alone.
    """
    labels = [r[0] for r in rows.select(label).distinct().orderBy(F.asc_nulls_first(label)).collect()]
    names = [f"_c{i}" for i in range(len(labels))]
    counts = rows.groupBy(group).agg(*(F.count_if(F.col(label).eqNullSafe(F.lit(x))).alias(c) for x, c in zip(labels, names)), F.count("*").alias("n"))
    if not labels:
        return counts.select(group, F.lit(0).cast("long").alias("fold"), "n")
    counts = numbered(counts, [], [drawn(seed, group), F.col(group)], "_rank")
    totals = counts.agg(*(F.sum(c).alias(f"{c}_total") for c in names))  # one row
    heavy = F.greatest(*(F.col(c) * units >= F.col(f"{c}_total") for c in names), F.lit(False))
    placed = counts.crossJoin(totals).withColumn("_unit", F.when(heavy & (F.col("n") > 0), -1 - F.col("_rank")).otherwise(F.col("_rank") % units))
    vectors = placed.groupBy("_unit").agg(*(F.sum(c).alias(c) for c in names), F.min("_rank").alias("_first")).collect()
    table = np.array([[r[c] for c in names] for r in vectors], float)
    uneven = len(names) * (table**2).sum(1) - table.sum(1) ** 2
    order = sorted(range(len(vectors)), key=lambda i: (-uneven[i], vectors[i]["_first"]))
    folds = assign(table[order], k)
    found = rows.sparkSession.createDataFrame([(vectors[i]["_unit"], int(f)) for i, f in zip(order, folds)], "_unit long, fold long")
    return placed.join(F.broadcast(found), "_unit").select(group, "fold", "n")


def dealt_folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: int = 1, test: float = 0.2) -> DataFrame:
    """``rows`` with ``fold``, each class dealt in a drawn order, and ``is_test``, the first ``test`` of each class in that order."""
    ranked = numbered(rows, [F.col(label)], [drawn(seed, key), F.col(key)], "_k")
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))  # a row for each class
    out = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_k") % k).alias("fold"), (F.col("_k") < F.round(F.col("_n") * test)).alias("is_test"))
