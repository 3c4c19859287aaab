"""Arrays of class probabilities: blending, calibration, post-processing, and the scores of predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, b: a + b)


def normalised(p: Column) -> Column:
    """p with sum 1; a zero row stays as it is."""
    return F.when(total(p) == 0, p).otherwise(F.transform(p, lambda x: F.try_divide(x, total(p))))


def argmax(p: Column) -> Column:
    """The first class of highest probability."""
    return F.array_position(p, F.array_max(p)) - 1


def blend(parts: list[Column], weights: list[float]) -> Column:
    """Weighted mean of the arrays that are there; the weights of missing ones go to the others. Null if none is there."""
    have = [F.when(p.isNotNull(), F.lit(float(w))).otherwise(0.0) for p, w in zip(parts, weights)]
    size = F.greatest(*(F.coalesce(F.size(p), F.lit(0)) for p in parts)) if len(parts) > 1 else F.size(parts[0])
    scale = sum(have[1:], have[0])
    cell = lambda i: sum((w * F.coalesce(F.get(p, i), F.lit(0.0)) for p, w in zip(parts[1:], have[1:])), have[0] * F.coalesce(F.get(parts[0], i), F.lit(0.0)))
    return F.when(scale > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.try_divide(cell(i), scale)))


def temperature(p: Column, t: float) -> Column:
    return normalised(F.transform(p, lambda x: F.pow(x, 1.0 / t)))


def boosted(p: Column, n_targets: int, factor: float, least: float | None = None) -> Column:
    """Target classes (the first n) times ``factor``, renormalised; with ``least`` only where the best target reaches it."""
    up = normalised(F.transform(p, lambda x, i: F.when(i < n_targets, x * factor).otherwise(x)))
    return up if least is None else F.when(F.array_max(F.slice(p, 1, n_targets)) > least, up).otherwise(p)


def ranked(p: Column) -> Column:
    """(p, class) from the most probable down; the smaller class first on ties."""
    return F.transform(F.reverse(F.array_sort(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("m"))))), lambda s: F.struct(s["p"].alias("p"), (-s["m"]).cast("long").alias("class")))


def _scaled(p: Column, chosen, factor) -> Column:
    """The classes for which ``chosen(class)`` holds, times ``factor``."""
    return F.transform(p, lambda x, i: F.when(chosen(i), x * factor).otherwise(x))


def low_confidence_boost(p: Column, n_targets: int, below: float = 0.35, factor: float = 1.15, similarity: dict[tuple[int, int], float] | None = None) -> Column:
    """Raise the targets among the five best classes where no class is sure and at least two of the five are targets.

    Where the best stays below half of ``below``, similar classes of the three best (over 0.5 in ``similarity``) are drawn together, from the third up.
    """
    five = F.filter(F.transform(F.slice(ranked(p), 1, 5), lambda s: s["class"]), lambda c: c < n_targets)
    up = F.when((F.array_max(p) < below) & (F.size(five) >= 2), _scaled(p, lambda i: F.array_contains(five, i.cast("long")), factor)).otherwise(p)
    if not similarity:
        return up
    known = F.create_map(*(F.lit(x) for (i, j), v in similarity.items() for key in {(i, j), (j, i)} for x in (key[0] * 1000 + key[1], float(v))))
    alike = lambda i, j: F.coalesce(F.try_element_at(known, (i * 1000 + j).cast("int")), F.lit(0.0))
    best = F.slice(ranked(up), 1, 3)
    cls, val = [best[k]["class"] for k in (2, 1, 0)], [best[k]["p"] for k in (2, 1, 0)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        sim = alike(cls[i], cls[j])
        half = F.when(sim > 0.5, sim * 0.3).otherwise(0.0) / 2
        val[i], val[j] = val[i] + (val[j] - val[i]) * half, val[j] + (val[i] - val[j]) * half
    place = lambda x, i: F.when(i == cls[0], val[0]).when(i == cls[1], val[1]).when(i == cls[2], val[2]).otherwise(x)
    return F.when((F.array_max(p) < below / 2) & (F.size(p) >= 3), F.transform(up, place)).otherwise(up)


def confusion_boost(p: Column, n_targets: int, pairs: list[tuple[int, int, float]], gap: float = 0.15, similar: float = 0.7) -> Column:
    """Where the predicted class is nearly tied with one it is often taken for (pairs: predicted, other, similarity), the target of the two is raised."""
    said, out = argmax(p), p
    for a, b, s in pairs:
        if s > similar and (a < n_targets) != (b < n_targets):
            target = b if b < n_targets else a
            out = F.when((said == a) & (out[a] - out[b] < gap), _scaled(out, lambda i, k=target: i == k, 1.1 + 0.1 * s)).otherwise(out)
    return out


def boosted_by_rolloff(p: Column, n_targets: int, rolloff: Column, factor: float = 1.2, limit: float = 5.0, more: float = 1.05) -> Column:
    """Targets times ``factor``, by ``more`` again where the spectrum reaches past ``limit`` Hz; not renormalised."""
    return _scaled(p, lambda i: i < n_targets, F.when(rolloff > limit, factor * more).otherwise(factor))


def override_when_unsure(p: Column, n_targets: int, below: float = 0.25, sure: Column | None = None) -> Column:
    """The predicted class; where ``sure`` (the highest probability, unless given) is low, the best target among the three best classes, if there is one."""
    target = F.get(F.filter(F.slice(ranked(p), 1, 3), lambda s: s["class"] < n_targets), F.lit(0))["class"]
    return F.when((F.array_max(p) if sure is None else sure) < below, F.coalesce(target, argmax(p))).otherwise(argmax(p))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every class of a confusion table; 0 where undefined."""
    rows = counts.select("n", (F.col("truth") == F.col("predicted")).alias("hit"), F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("class"), "truth", "predicted")
    s = rows.groupBy("class").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("truth") == F.col("class"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("predicted") == F.col("class"), F.col("n"))), F.lit(0)).alias("claimed"),
    )
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select("class", "support", div(F.col("tp"), F.col("claimed")).alias("precision"), div(F.col("tp"), F.col("support")).alias("recall"), div(2 * F.col("tp"), F.col("support") + F.col("claimed")).alias("f1"))


def hierarchical_f1(df: DataFrame, truth: str, predicted: str, n_targets: int) -> DataFrame:
    """One row: binary F1 (target or not), macro F1 over targets and one class of all others, and their mean."""
    flat = lambda c: F.when(F.col(c) < n_targets, F.col(c).cast("long")).otherwise(F.lit(99).cast("long"))
    counts = df.groupBy(flat(truth).alias("truth"), flat(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    t, p, n = F.col("truth") < 99, F.col("predicted") < 99, F.col("n")
    part = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    binary = counts.agg(F.coalesce(F.try_divide(2 * part(t & p), part(t) + part(p)), F.lit(0.0)).alias("binary_f1"))
    macro = class_scores(counts).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    return binary.crossJoin(macro).withColumn("score", (F.col("binary_f1") + F.col("macro_f1")) / 2)


def trial_scores(df: DataFrame, truth: str, parts: list[str], weights: DataFrame, n_targets: int) -> DataFrame:
    """``weights`` (trial, w1, w2, ...; a fixed number of rows) with the ``score`` (``hierarchical_f1``) of the weighted sum of ``parts``.

    Tasks add up a confusion table per trial, so nothing grows with rows x trials. Rows without a class or a part are left out.
    """
    found = sorted(weights.collect(), key=lambda r: r["trial"])
    trials, w = [r["trial"] for r in found], np.array([[r[f"w{i + 1}"] for i in range(len(parts))] for r in found])
    k = n_targets + 1  # the last class is that of all others

    def run(batches):
        counts = np.zeros((len(trials), k * k), np.int64)
        at = np.arange(len(trials))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                y = np.minimum(np.array(part.column(0).to_pylist(), np.int64), n_targets)
                p = [np.array(part.column(1 + j).to_pylist(), float) for j in range(len(parts))]
                if len(y):
                    # summed in the order of the parts, as a row by itself would be
                    h = np.minimum(sum(w[:, j, None, None] * p[j] for j in range(len(parts))).argmax(2), n_targets)
                    counts += np.bincount((at[:, None] * k * k + y * k + h).ravel(), minlength=counts.size).reshape(counts.shape)
        trial, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(trials, np.int64)[trial]), pa.array(cell // k), pa.array(cell % k), pa.array(counts[trial, cell])], names=["trial", "t", "h", "n"])

    rows = df.select(F.col(truth).cast("long").alias("y"), *parts).dropna()
    c = rows.mapInArrow(run, "trial long, t long, h long, n long").groupBy("trial")
    part = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0))
    t, h = F.col("t"), F.col("h")
    f1 = lambda hit, real, said: F.try_divide(2 * part(hit), part(real) + part(said))
    binary = F.coalesce(f1((t < n_targets) & (h < n_targets), t < n_targets, h < n_targets), F.lit(0.0))
    each = F.filter(F.array(*(f1((t == j) & (h == j), t == j, h == j) for j in range(k))), lambda x: x.isNotNull())
    macro = F.try_divide(F.aggregate("each", F.lit(0.0), lambda a, b: a + b), F.size("each"))
    scores = c.agg(binary.alias("binary_f1"), each.alias("each")).select("trial", ((F.col("binary_f1") + macro) / 2).alias("score"))
    return weights.join(scores, "trial")
