"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. Over the words of the
benchmark, every passage is a TF-IDF row; document frequencies come from all
passages of the corpus. A randomised SVD is computed where the rows are: each
round sends a words x rank matrix to the tasks and sums their answers, so only
matrices of the benchmark's size ever reach the driver. Benchmark items are
rows too, weighted up so that their directions stay in the latent space. All
passages are then compared with all items by cosine in that space; pairs of
COSINE or more are candidates, and candidates alone are checked, by one rule for
all items: the longest common subsequence of words with the item, whether the
item's answer (its last sentence) is there as well, and how long a common
subsequence the same words would have in a drawn order. Common words in any
order are found almost anywhere; a leak, however common, keeps its own.

Defined cases: null and empty texts have no passages; items that are null or
without words match nothing; an item of more than WINDOW / 2 words is searched
in overlapping pieces, the last one up to its end; equal items are found separately; extra columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import table, written

WINDOW = 128
STRIDE = WINDOW // 2
RANK, EXTRA, ROUNDS = 128, 16, 2
DIMENSIONS = 1 << 14
CHUNK = 512
COMMON = 0.005  # words in a greater share of passages are columns of a dense matrix: a matter of speed alone
TEXTS, FAN = 500, 256  # texts in a row of the table of word ids; sums that a group adds up
LCS, LCS_WITH_ANSWER = 0.7, 0.55
#: Of paraphrases (12 % of the words dropped, a tenth inserted) of items in 1, 50, 90 and 99 % of documents this keeps all that was measured.
COSINE = 0.12
ABOVE_CHANCE = 0.2  # of an item's words, over what a drawn order of the passage has; half of what is left where that is less
MOST_BYTES = 256 << 20  # of the benchmark, which goes to the executors as a broadcast variable
_DRAWN = [np.random.default_rng(k).permutation(WINDOW) for k in range(4)]
_LOG = 1 + np.log(np.maximum(np.arange(WINDOW + 1), 1))  # of a word's count in a passage
_MARKS = ".,;:!?|\"'()[]{}<>*#$%&/\\-–—«»“”„’…¿¡"


def words_of(text: str | None) -> list[str]:
    """Lower-case words without marks."""
    text = (text or "").lower()
    for c in _MARKS:
        if c in text:
            text = text.replace(c, " ")
    return text.split()


def passages(n_words: int) -> int:
    return max(1, -(-(n_words - STRIDE) // STRIDE)) if n_words else 0


class Benchmark:
    """The items' pieces, words and answers."""

    def __init__(self, items: list[tuple]):
        self.words: dict[str, int] = {}
        self.pieces: list[tuple] = []  # item id, word ids, answer's word ids
        for key, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words_of(text)]
            sentences = [x for x in re.split(r"[.!?\n]+", text or "") if x.strip()]
            answer = [self.words[w] for w in words_of(sentences[-1])] if sentences else []
            last = max(0, len(ids) - STRIDE)
            self.pieces += [(key, ids[i : i + STRIDE], answer) for i in [*range(0, last, STRIDE // 4), last] if ids]
        self.dims = min(DIMENSIONS, max(1, len(self.words)))
        self.masks = [self._mask(p) for _, p, _ in self.pieces]
        self.answer_masks = [self._mask(a) for *_, a in self.pieces]

    @staticmethod
    def _mask(ids: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(ids):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def ids(self, text: str | None) -> tuple[np.ndarray, int]:
        """Word ids of a text, -1 for words that no item has."""
        words = words_of(text)
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int32, len(words)), len(words)


def common_subsequence(mask: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence, one row of the table held in the bits of an integer."""
    full = (1 << n) - 1
    v = full
    for w in other:
        if m := mask.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def by_chance(mask: dict[int, int], n: int, window: list[int]) -> float:
    """The mean share of an item's words that are a common subsequence with the window in drawn orders."""
    return sum(common_subsequence(mask, n, [window[i] for i in order if i < len(window)]) for order in _DRAWN) / (len(_DRAWN) * n)


def judged(bench: Benchmark, piece: int, window: list[int]) -> tuple[float, bool] | None:
    """(share of the piece's words in order, whether the answer is there) if the window is a leak of the piece, else None."""
    _, want, answer = bench.pieces[piece]
    share = common_subsequence(bench.masks[piece], len(want), window) / len(want)
    if share < LCS_WITH_ANSWER:
        return None
    has = bool(answer) and common_subsequence(bench.answer_masks[piece], len(answer), window) >= 0.8 * len(answer)
    if share < LCS and not has:
        return None
    chance = by_chance(bench.masks[piece], len(want), window)
    return (share, has) if share >= chance + min(ABOVE_CHANCE, (1 - chance) / 2) - 1e-9 else None


def sent(spark, value, limit: int = MOST_BYTES):
    """A broadcast variable of a value whose size is checked."""
    import pickle

    if (n := len(pickle.dumps(value, protocol=5))) > limit:
        raise ValueError(f"{n} bytes of benchmark; {limit} may be sent to every executor: search it in parts")
    return spark.sparkContext.broadcast(value)


def rows_of(bench: Benchmark, texts: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of each text; of the passages: text, first word; pairs (passage, dimension), each pair once with its count."""
    ids = [bench.ids(t)[0] for t in texts]
    counts = np.array([passages(len(x)) for x in ids], np.int64)
    first = np.cumsum(counts) - counts
    at, dim = [], []
    for k, x in enumerate(ids):
        here = np.flatnonzero(x >= 0)
        if len(here):
            block = here // STRIDE  # word i lies in passages i // STRIDE and the one before
            d = x[here].astype(np.int64) % bench.dims
            last = counts[k] - 1
            one = np.minimum(block, last)
            at.append(first[k] + one)
            dim.append(d)
            two = (block >= 1) & (block - 1 < one)
            at.append(first[k] + block[two] - 1)
            dim.append(d[two])
    key = np.concatenate(at) * bench.dims + np.concatenate(dim) if at else np.zeros(0, np.int64)
    key, n = np.unique(key, return_counts=True)
    text = np.repeat(np.arange(len(ids)), counts)
    return ids, text, (np.arange(len(text)) - first[text]) * STRIDE if len(text) else text, np.stack([key // bench.dims, key % bench.dims, n])


def weighted(pairs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of unit length: passage and dimension of each entry, its weight, and where the rows start."""
    row, dim, n = pairs
    keep = idf[dim] > 0
    row, dim = row[keep], dim[keep]
    w = (_LOG[n[keep]] * idf[dim]).astype(np.float32)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if len(row):
        norm = np.sqrt(np.add.reduceat(w * w, starts))
        w /= np.repeat(norm, np.diff(np.append(starts, len(row))))
    return row, dim, w, starts


def chunked(dim: np.ndarray, w: np.ndarray, starts: np.ndarray, top: np.ndarray, dims: int, step: int = 1 << 15):
    """Stretches of rows: from, to, the dense part over the dimensions ``top``, and row, dimension and weight of the other entries."""
    column = np.full(dims, -1)
    column[top] = np.arange(len(top))
    ends, at = np.append(starts, len(dim)), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + step, "right")) - 1)
        a, b = ends[at], ends[stop]
        row, c = np.repeat(np.arange(stop - at), np.diff(ends[at : stop + 1])), column[dim[a:b]]
        dense = np.zeros((stop - at, len(top)), np.float32)
        dense[row[c >= 0], c[c >= 0]] = w[a:b][c >= 0]
        yield at, stop, dense, row[c < 0], dim[a:b][c < 0], w[a:b][c < 0]
        at = stop


def chunk_times(dense: np.ndarray, row: np.ndarray, dim: np.ndarray, w: np.ndarray, top: np.ndarray, basis: np.ndarray) -> np.ndarray:
    y = dense @ basis[top]
    if len(row):
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        y[row[heads]] += np.add.reduceat(basis[dim] * w[:, None], heads, axis=0)
    return y


def project(dim: np.ndarray, w: np.ndarray, starts: np.ndarray, basis: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Rows x basis."""
    out = [chunk_times(*x[2:], top, basis) for x in chunked(dim, w, starts, top, len(basis))]
    return np.concatenate(out) if out else np.zeros((0, basis.shape[1]), np.float32)


def shared_words(dim: np.ndarray, starts: np.ndarray, counts: np.ndarray, top: np.ndarray) -> np.ndarray:
    """For each row and piece, how many of the piece's words the row has; ``counts`` (dims x pieces) as bytes."""
    dense_counts, out = counts[top].astype(np.float32), []
    for at, stop, dense, row, d, _ in chunked(dim, np.ones(len(dim), np.float32), starts, top, len(counts)):
        y = (dense @ dense_counts).astype(np.uint8)
        if len(row):
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            y[row[heads]] += np.add.reduceat(counts[d], heads, axis=0, dtype=np.uint8)
        out.append(y)
    return np.concatenate(out)


def gram_times(rows: DataFrame, idf: np.ndarray, basis: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A' A basis over all rows of the corpus. Tasks send the stretches of words that they have met; groups of FAN add them up, in steps."""
    dims, width = basis.shape
    kind = "part int, salt long, data binary"

    def run(batches):
        total = np.zeros((dims, width), np.float32)
        for batch in batches:
            for pairs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                _, dim, w, starts = weighted(unpacked(*pairs), idf)
                for _, _, dense, row, d, v in chunked(dim, w, starts, top, dims):
                    y = chunk_times(dense, row, d, v, top, basis)
                    total[top] += dense.T @ y
                    if len(row):
                        order = np.argsort(d, kind="stable")
                        heads = np.flatnonzero(np.diff(d[order], prepend=-1))
                        total[d[order][heads]] += np.add.reduceat((v[:, None] * y[row])[order], heads, axis=0)
        parts = [p for p in range(0, dims, CHUNK) if total[p : p + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p // CHUNK for p in parts], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(parts), pa.int64()), pa.array([total[p : p + CHUNK].tobytes() for p in parts], pa.binary())], names=["part", "salt", "data"])

    def summed(key, rows_of_part):
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(float) for x in rows_of_part.column("data"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    partial = rows.select("row", "dim", "n").mapInArrow(run, kind)
    for _ in range(2):
        partial = partial.withColumn("salt", F.floor(F.col("salt") / FAN)).groupBy("part", "salt").applyInArrow(summed, kind)
    out = np.zeros((dims, width), np.float32)
    for r in partial.collect():  # a row per part, as many times as there are FAN * FAN tasks
        out[r["part"] * CHUNK : (r["part"] + 1) * CHUNK] += np.frombuffer(bytes(r["data"]), np.float32).reshape(-1, width)
    return out


def unpacked(row: bytes, dim: bytes, n: bytes) -> np.ndarray:
    """The pairs of ``rows_of``, as stored."""
    return np.stack([np.frombuffer(row, np.int32), np.frombuffer(dim, np.uint16), np.frombuffer(n, np.uint8)]).astype(np.int64)


def latent_basis(rows: DataFrame, idf: np.ndarray, items: tuple, dims: int, n_rows: int, top: np.ndarray, seed: int = 11) -> np.ndarray:
    """Right singular vectors (dims x rank) of the passages and the items, by randomised subspace iteration."""
    _, dim, w, starts = items
    width = min(dims, RANK + EXTRA)
    weight = max(1.0, n_rows / max(1, len(starts)))  # together the items weigh as much as the corpus

    def times(q: np.ndarray) -> np.ndarray:
        y = project(dim, w, starts, q, top)
        out = gram_times(rows, idf, q, top).astype(float)
        np.add.at(out, dim, weight * w[:, None] * np.repeat(y, np.diff(np.append(starts, len(dim))), axis=0))
        return out

    q = np.random.default_rng(seed).normal(size=(dims, width)).astype(np.float32)
    for _ in range(ROUNDS - 1):
        q = np.linalg.qr(times(q))[0].astype(np.float32)
    # the last iterate spans the subspace; its own singular vectors put it in order, without one more pass over the rows
    vectors, *_ = np.linalg.svd(times(q), full_matrices=False)
    return np.ascontiguousarray(vectors[:, : min(RANK, width)], np.float32)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: id, item, cosine, lcs (share of the item's words, in order), has_answer, first_word, n_candidates."""
    bench = Benchmark([(r[0], r[1]) for r in benchmark.select(item_col, item_text_col).collect()])  # the stated query set
    shared = sent(docs.sparkSession, bench)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out_type = f"id {kind}, piece int, cosine double, lcs double, has_answer boolean, first_word long"

    def indexed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids, text, _, pairs = rows_of(shared.value, part.column(1).to_pylist())
                sizes = np.array([len(x) for x in ids], np.int32)
                stored = (np.concatenate(ids), sizes, pairs[0].astype(np.int32), pairs[1].astype(np.uint16), pairs[2].astype(np.uint8))
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([len(text)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in stored)], names=["ids", "passages", "words", "sizes", "row", "dim", "n"])

    # words of whole texts, once: the rest works on their numbers
    matrix = written(rows.mapInArrow(indexed, f"ids array<{kind}>, passages long, words binary, sizes binary, row binary, dim binary, n binary"), "decontam-rows")

    dims = bench.dims

    def counted(batches):
        df = np.zeros(dims, np.int64)
        for batch in batches:
            for dim in batch.column(0).to_pylist():
                df += np.bincount(np.frombuffer(dim, np.uint16), minlength=dims)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], names=["dim", "n"])

    counts = {r["dim"]: r["n"] for r in matrix.select("dim").mapInArrow(counted, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n_rows = matrix.agg(F.sum("passages")).head()[0] or 0
    df = np.zeros(bench.dims)
    df[list(counts)] = list(counts.values())
    idf = 1 + np.log((n_rows + 2) / (df + 1))  # a word that all have still counts
    top = np.flatnonzero(df > COMMON * n_rows)
    least = np.array([LCS_WITH_ANSWER * len(p) for _, p, _ in bench.pieces])

    key = [np.array([[k, d, n] for k, (_, p, _) in enumerate(bench.pieces) for d, n in zip(*np.unique(np.array(p) % bench.dims, return_counts=True))], np.int64).reshape(-1, 3).T]
    items = weighted(key[0], idf)
    basis = latent_basis(matrix, idf, items, bench.dims, n_rows, top)
    latent = np.zeros((len(bench.pieces), basis.shape[1]), np.float32)
    if len(items[3]):
        latent[items[0][items[3]]] = project(*items[1:], basis, top)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    known = sent(docs.sparkSession, (basis, latent, key[0], idf, top, least))

    def searched(batches):
        bench, (basis, latent, entries, idf, top, least) = shared.value, known.value
        counts = np.zeros((bench.dims, len(bench.pieces)), np.uint8)
        np.add.at(counts, (entries[1], entries[0]), entries[2].astype(np.uint8))
        for batch in batches:
            for b in range(batch.num_rows):
                found = {c: [] for c in ("row", "piece", "cosine", "lcs", "answer", "first")}
                keys, words, sizes = batch.column(0)[b].values, np.frombuffer(batch.column(1)[b].as_buffer(), np.int32), np.frombuffer(batch.column(2)[b].as_buffer(), np.int32)
                row, dim, w, starts = weighted(unpacked(*(batch.column(c)[b].as_buffer() for c in (3, 4, 5))), idf)
                if not len(starts):
                    continue
                n_of = np.array([passages(x) for x in sizes.tolist()])
                text = np.repeat(np.arange(len(sizes)), n_of)
                first = (np.arange(len(text)) - (np.cumsum(n_of) - n_of)[text]) * STRIDE
                begin = np.cumsum(sizes, dtype=np.int64) - sizes
                y = project(dim, w, starts, basis, top)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
                cosine = y @ latent.T
                there = np.flatnonzero((cosine >= COSINE).any(1))
                if not len(there):
                    continue
                # a candidate that shares too few words needs no subsequence
                n = np.diff(np.append(starts, len(dim)))
                of = np.isin(np.repeat(np.arange(len(starts)), n), there)
                enough = shared_words(dim[of], np.cumsum(n[there]) - n[there], counts, top) >= least
                for k, piece in zip(*np.nonzero(enough & (cosine[there] >= COSINE))):
                    r = there[k]
                    p = row[starts[r]]
                    at = begin[text[p]]
                    window = words[at + first[p] : at + min(first[p] + WINDOW, sizes[text[p]])].tolist()
                    if leak := judged(bench, piece, window):
                        for c, v in zip(found, (text[p], piece, float(cosine[r, piece]), *leak, int(first[p]))):
                            found[c].append(v)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(found["row"], pa.int64())), pa.array(found["piece"], pa.int32()), pa.array(found["cosine"], pa.float64()), pa.array(found["lcs"], pa.float64()), pa.array(found["answer"], pa.bool_()), pa.array(found["first"], pa.int64())],
                    names=["id", "piece", "cosine", "lcs", "has_answer", "first_word"],
                )

    hits = matrix.select("ids", "words", "sizes", "row", "dim", "n").mapInArrow(searched, out_type)
    names = docs.sparkSession.createDataFrame([(k, p[0]) for k, p in enumerate(bench.pieces)], f"piece int, item {item_kind}")
    best = hits.join(names, "piece").groupBy("id", "item").agg(F.max(F.struct("lcs", "cosine", "has_answer", "first_word")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.cosine", "b.lcs", "b.has_answer", "b.first_word")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all items. The benchmark table has no answers, so an item's last sentence stands for its answer."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
