"""Histogram gradient-boosted trees over document statistics.

Features are counted once per text, in one pass over the corpus. Trees are
fitted on at most ``max_rows`` labelled rows (those with the smallest hash of
their id when there are more), on features cut into at most 255 quantile bins,
level by level from histograms of gradients. All trees are then flattened into
five arrays, and every batch walks them with numpy, all trees at once.

Defined cases: a null text counts as empty, and empty texts get a score;
documents labelled twice count twice in training; null labels are left out;
without training rows the score is 0.5; with one class it is near that class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.quality_rules import MEASURES, measure
from seqspark.llm.shared import fold, least_by_hash, table, written

FEATURES = (
    "n_chars", "n_words", "n_lines", "chars_per_word", "words_per_line", "symbols_per_word", "upper_share", "lettered_share", "duplicate_line_share",
    "repeated_word_share", "distinct_word_share", "commonest_word_share", "mark_share", "exclamation_share", "comma_share", "stop_share", "digit_share", "short_word_share", "longest_word", "non_ascii_share",
)


def statistics(text: str | None) -> tuple[float, ...]:
    """The FEATURES of one text."""
    text = text or ""
    m = dict(zip(MEASURES, measure(text)))
    words = text.split()
    n, chars = max(1, m["n_words"]), max(1, m["word_chars"])
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    sizes = [len(w) for w in kinds]
    share = lambda c: text.count(c) / n
    return (
        len(text), m["n_words"], m["n_lines"], chars / n, n / max(1, m["n_lines"]), m["n_symbols"] / n, m["n_upper"] / chars, m["n_alpha_words"] / n, m["n_dup_lines"] / max(1, m["n_lines"]),
        m["n_repeat_words"] / n, len(kinds) / n, max(kinds.values(), default=0) / n, sum(map(text.count, ";:()[]{}\"'/\\_=~^")) / n, share("!") + share("?"), share(","), share("."), sum(map(text.count, "0123456789")) / chars,
        sum(1 for s in sizes if s < 3) / max(1, len(sizes)), max(sizes, default=0), (len(text.encode("utf-8", "surrogatepass")) - len(text)) / chars,
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``x``, the array of its FEATURES."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], names=[id_col, "x"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


class Boosted:
    """Flattened trees: of each node its feature, threshold, children and value; the trees' roots."""

    def __init__(self, start: float):
        self.start, self.roots = start, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def frozen(self) -> Boosted:
        self.roots, self.feature, self.left, self.right = (np.array(x, np.int64) for x in (self.roots, self.feature, self.left, self.right))
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)
        return self

    def add(self) -> int:
        for x, v in ((self.feature, 0), (self.threshold, np.inf), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            x.append(v)
        self.left[-1] = self.right[-1] = len(self.left) - 1  # a leaf leads to itself
        return len(self.left) - 1

    def raw(self, x: np.ndarray, depth: int) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.start)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 255, least: float = 5.0, l2: float = 1.0) -> Boosted:
    """Boost log-loss. ``least``: rows on either side of a split."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = Boosted(float(np.log(p / (1 - p))) if len(y) else 0.0)
    if not len(y):
        return model.frozen()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])  # value <= cuts[b] where bin <= b
    width = bins + 1
    raw = np.full(len(y), model.start)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        model.roots.append(root := model.add())
        node = np.full(len(y), root)
        level = [root]
        for d in range(depth + 1):
            slot = {v: i for i, v in enumerate(level)}
            at = np.array([slot.get(v, -1) for v in range(root, len(model.left))])[node - root]
            live = at >= 0
            k = len(level)
            g, h = np.bincount(at[live], grad[live], k), np.bincount(at[live], hess[live], k)
            for i, v in enumerate(level):
                model.value[v] = float(-rate * g[i] / (h[i] + l2))
            if d == depth:
                break
            best = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
            for f, b in enumerate(binned):
                key = at[live] * width + b[live]
                gl, hl, nl = (np.bincount(key, w, k * width).reshape(k, width).cumsum(1)[:, :-1] for w in (grad[live], hess[live], None))
                n = nl[:, -1:] + np.bincount(key, None, k * width).reshape(k, width)[:, -1:]
                gain = gl**2 / (hl + l2) + (g[:, None] - gl) ** 2 / (h[:, None] - hl + l2) - (g**2 / (h + l2))[:, None]
                gain[(nl < least) | (n - nl < least)] = -1
                gain[:, len(cuts[f]) :] = -1
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best[0] + 1e-9
                best[0][better], best[1][better], best[2][better] = gain[np.arange(k), top][better], f, top[better]
            following = []
            for i, v in enumerate(level):
                if best[1][i] < 0:
                    continue
                f, b = int(best[1][i]), int(best[2][i])
                model.feature[v], model.threshold[v] = f, float(cuts[f][b])
                left, right = model.add(), model.add()
                model.left[v], model.right[v] = left, right
                mine = at == i
                node[mine] = np.where(binned[f][mine] <= b, left, right)
                following += [left, right]
            level = following
            if not level:
                break
        values = np.array(model.value)
        raw += values[node]
    return model.frozen()


def train(found: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_rows: int = 200_000, depth: int = 4) -> Boosted:
    """Fit on the labelled rows of ``found``, at most ``max_rows`` of them."""
    rows = found.join(labels.select(F.col(id_col), F.col(label_col).alias("y")).where("y IS NOT NULL"), id_col)
    part = least_by_hash(rows, id_col, max_rows, "y").select("x", "y").toArrow()
    x = np.array(part.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, part.column("y").to_numpy().astype(float), depth=depth)


def score(found: DataFrame, model: Boosted, id_col: str = "doc_id", depth: int = 4) -> DataFrame:
    """One row per row of ``found``: the id and the probability of label 1."""
    kind = found.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = batch.column(1).values.to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-model.raw(x, depth))))], names=[id_col, "score"])

    return found.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, score double")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    found = written(features(table(spark, sf_dir, "documents")), "quality-features")
    model = train(found.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return score(found, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
