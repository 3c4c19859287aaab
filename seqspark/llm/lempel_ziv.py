"""Substring dedup by relative Lempel-Ziv parsing: documents as factors of what the corpus holds earlier.

Every window of WINDOW words belongs to a seed, the SEED-word run in it with the
smallest hash; neighbouring windows with the same seed form a phrase (at most
2 * WINDOW - SEED words). Phrases depend on nothing but their own words, so a
passage that is copied is cut into the same phrases wherever it stands. The
reference is the whole corpus: its phrases are indexed in blocks by seed, with
the earliest place of each.

A document is parsed from left to right. Where a phrase stands earlier, a factor
(source document, start there) begins or, if the place is the next of the same
source, goes on; it goes on as far as such phrases reach. A window across the
end of a factor lies in a phrase that is new as a whole, though a part of it may
be known: such phrases, whose seed is met with other words around it, are
checked window by window against the windows of all phrases with these seeds.
So every window that stands earlier lies in a factor, and no other does.

Phrases and windows are compared by 128 bits of hashes. Of copies inside one
slice of a task only the earliest is looked up elsewhere; so a passage that a
third of all documents share costs a row a slice, not a row a document.

Defined cases: a null text has no words; a null id is smaller than any other;
rows that share an id are one document to the rule (a window at the same start
of such a row is not earlier), and each gets a row; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.shared import mix64, table, written

WINDOW, SEED = 20, 6
SLICE_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a random number for each byte
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int, name: str) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        with np.errstate(over="ignore"):
            _POWERS[name] = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, 1 << 16), base)))
    return _POWERS[name]


def _joined(a: np.ndarray, b: np.ndarray, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(factor) + b)


class Words:
    """The words of a slice of texts: where each begins and ends in ``data``, its 64-bit hash, and its text."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.cumsum(np.append(np.uint64(0), _BYTE[raw] * _powers(_BASE, len(raw), "up")[: len(raw)]))
            self.hash = mix64((sums[self.end] - sums[self.begin]) * _powers(_INVERSE, len(raw), "down")[self.begin])
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.append(0, np.searchsorted(self.begin, ends))  # the first word of each text; at the end, all
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of the window that begins at each word, and which of them lie in one text; by doubling, so with few passes."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        ok = self.doc[:n] == self.doc[size - 1 :]
        return _runs(self.hash, size, 0x9E3779B97F4A7C15), _runs(self.hash, size, 0xBF58476D1CE4E5B9), ok


def _runs(h: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of ``size`` neighbours from every place."""
    n = len(h) - size + 1
    out, done, power, step = None, 0, h, 1
    while True:
        if size & step:
            part = power[done : done + n]
            out = part if out is None else _joined(out, part, factor)
            done += step
        if done == size:
            return out
        power = _joined(power[:-step], power[step:], factor)
        step *= 2


def phrases(words: Words) -> dict[str, np.ndarray]:
    """The phrases of a slice: document, first window, number of windows, hash of the seed, hash of all its words."""
    a, b, ok = words.windows()
    n = len(a)
    seeds = _runs(words.hash, SEED, 0x94D049BB133111EB) if n else a
    low, at = seeds[:n].copy(), np.arange(n)
    for k in range(1, WINDOW - SEED + 1):
        less = seeds[k : n + k] < low
        low[less] = seeds[k : n + k][less]
        at[less] = np.flatnonzero(less) + k
    here = np.flatnonzero(ok)
    new = np.append(True, (at[here][1:] != at[here][:-1]) | (words.doc[here][1:] != words.doc[here][:-1])) if len(here) else np.zeros(0, bool)
    begin = here[new]
    count = np.diff(np.append(np.flatnonzero(new), len(here)))
    last = begin + count - 1
    # the first and the last window overlap, so together they are all the words of the phrase
    whole = _joined(_joined(a[begin], b[last]), count.astype(np.uint64))
    return {"doc": words.doc[begin], "start": begin - words.first[words.doc[begin]], "n": count, "seed": low[begin], "phrase": whole}


def _slices(batches, text: int):
    """(batch, rows, their texts as bytes) in slices of about SLICE_BYTES; a longer text is a slice of its own."""
    for batch in batches:
        size, rows, texts = 0, [], []
        for i, t in enumerate(batch.column(text)):
            t = t.as_py() or b""
            if rows and size + len(t) > SLICE_BYTES:
                yield batch, rows, texts
                size, rows, texts = 0, [], []
            rows.append(i)
            texts.append(t)
            size += len(t)
        if rows:
            yield batch, rows, texts


def _heads(keys: list[np.ndarray], rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row a row at the earliest (rank, start) among those with its keys; the row itself if it stands there."""
    order = np.lexsort((start, rank, *keys))
    same = np.ones(len(order), bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    head = np.empty(len(order), np.int64)
    head[order] = order[~same][np.cumsum(~same) - 1]
    mine = (rank == rank[head]) & (start == start[head])
    return np.where(mine, np.arange(len(order)), head)


def _located(batch, rows: list[int], owner: np.ndarray, start: np.ndarray, keys: list[np.ndarray], names: list[str], *more: np.ndarray) -> pa.RecordBatch:
    """Rows (key, start, keys, known, source, at, more). ``known``: an earlier row with these keys is in the slice, at ``source`` and ``at``.

    A known row needs no look-up; a first key of its own has it dealt to any task.
    """
    ids = pc.struct_field(batch.column(0), "id").take(pa.array(rows))
    # dense ranks, null first: the order of Spark for numbers, texts and dates
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
    head = _heads(keys, rank, start)
    known = head != np.arange(len(head))
    spread = _joined(keys[1], rank.astype(np.uint64) * np.uint64(1 << 32) + start.astype(np.uint64))
    first = np.where(known, spread, keys[0])
    source = ids.take(pa.array(np.where(known, owner[head], 0), mask=~known))
    columns = [batch.column(0).take(pa.array(np.array(rows, np.int64)[owner])), pa.array(start.astype(np.int32)), pa.array(first.view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(known), source, pa.array(start[head].astype(np.int32), mask=~known)]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(m.astype(np.int32)) for m in more)], names=names)


def _indexed(docs: DataFrame, kind: str) -> DataFrame:
    """All phrases of documents (key, text), located; ``n`` windows each."""
    names = ["key", "start", "seed", "phrase", "known", "source", "at", "n"]

    def run(batches):
        for batch, rows, texts in _slices(batches, 1):
            p = phrases(Words(texts))
            yield _located(batch, rows, p["doc"], p["start"], [p["seed"], p["phrase"]], names, p["n"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, start int, seed long, phrase long, known boolean, source {kind}, at int, n int")


def _boundary_windows(cut: DataFrame, kind: str) -> DataFrame:
    """The windows of the phrases listed with each document (key, text, parts), located."""
    names = ["key", "start", "a", "b", "known", "source", "at"]

    def run(batches):
        for batch, rows, texts in _slices(batches, 1):
            words = Words(texts)
            a, b, _ = words.windows()
            parts = batch.column(2).take(pa.array(rows))
            owner = np.repeat(np.arange(len(rows)), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
            flat = pc.list_flatten(parts)
            begin, n = (pc.struct_field(flat, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n"))
            start = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(owner, n)
            place = start + words.first[owner]
            yield _located(batch, rows, owner, start, [a[place], b[place]], names)

    return cut.mapInArrow(run, f"key {cut.schema['key'].dataType.simpleString()}, start int, a long, b long, known boolean, source {kind}, at int")


def parse(spans: list[dict], n_words: int) -> list[tuple]:
    """The greedy parse: (start, length, copied, source, start there) from left to right.

    ``spans`` are runs of n windows that stand earlier, each with a place where
    it does. Runs that go on in one source are joined; the next factor is the one
    that reaches furthest, and words that no run covers are a literal.
    """
    runs: list[list] = []
    live: dict = {}
    for s in sorted(spans, key=lambda s: (s["start"], -s["n"])):
        begin, end, line = s["start"], s["start"] + s["n"] + WINDOW - 1, (s["source"], s["at"] - s["start"])
        if line in live and begin <= live[line][1]:
            live[line][1] = max(live[line][1], end)
        else:
            live[line] = [begin, end, *line]
            runs.append(live[line])
    out, at, k, best = [], 0, 0, None
    while at < n_words:
        while k < len(runs) and runs[k][0] <= at:
            if best is None or runs[k][1] > best[1]:
                best = runs[k]
            k += 1
        if best is not None and best[1] > at:
            out.append((at, best[1] - at, True, best[2], at + best[3]))
            at = best[1]
        else:
            stop = runs[k][0] if k < len(runs) else n_words
            out.append((at, stop - at, False, None, None))
            at = stop
    return out


def relative_parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text, and ``factors``, its parse: an array of (start, length, copied, source, at) in words.

    The words of a factor with ``copied`` are covered by windows that stand
    earlier; they do so in document ``source`` from its word ``at`` (of rows that
    share this id, each window in one of them).
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row")).alias("key"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    place = F.struct("key.id", "start")
    head = lambda *keys: F.first(place).over(Window.partitionBy(*keys).orderBy("key.id", "start"))
    source = [F.when(F.col("known"), F.col("source")).otherwise(F.col("head.id")).alias("source"), F.when(F.col("known"), F.col("at")).otherwise(F.col("head.start")).alias("at")]

    block = Window.partitionBy("seed").orderBy("phrase").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    index = _indexed(rows, kind).withColumn("head", head("seed", "phrase")).withColumns({"low": F.first("phrase").over(block), "high": F.last("phrase").over(block)})
    met = index.withColumn("earlier", F.col("known") | (place > F.col("head"))).where("earlier OR low <> high")
    met = written(met.select("key", "start", "n", "earlier", *source), "lz-phrases")

    documents = rows.repartition("key")  # one exchange, used twice
    listed = met.where("NOT earlier").groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("parts"))
    windows = _boundary_windows(documents.join(listed, "key").select("key", "text", "parts"), kind).withColumn("head", head("a", "b"))
    crossed = windows.where(F.col("known") | (place > F.col("head"))).select("key", "start", F.lit(1).alias("n"), *source)
    spans = met.where("earlier").select("key", "start", "n", "source", "at").unionByName(crossed)
    found = spans.groupBy("key").agg(F.collect_set(F.struct("start", "n", "source", "at")).alias("parts"))
    together = documents.join(found, "key", "left").select("key", "text", "parts")

    def factored(batches):
        for batch in batches:
            n = [len((t.as_py() or b"").split()) for t in batch.column(1)]
            out = [[dict(zip(("start", "length", "copied", "source", "at"), f)) for f in parse(p.as_py() or [], k)] for p, k in zip(batch.column(2), n)]
            ids = pc.struct_field(batch.column(0), "id")
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("copied", pa.bool_()), ("source", ids.type), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(out, kinds)], names=["id", "text", "factors"])

    out = together.mapInArrow(factored, f"id {kind}, text binary, factors array<struct<start: int, length: int, copied: boolean, source: {kind}, at: int>>")
    return out.select(F.col("id").alias(id_col), F.col("text").cast("string").alias("text"), "factors")


def without_copies(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_removed, n_factors, kept): the words of a parse that no copied factor covers, joined by single spaces (binary)."""
    kind = parsed.schema[id_col].dataType.simpleString()
    rows = parsed.select(F.col(id_col).alias("id"), F.col("text").cast("binary").alias("text"), F.filter("factors", lambda f: f["copied"]).alias("copies"))

    def run(batches):
        for batch in batches:
            n, gone, factors, kept = [], [], [], []
            for t, copies in zip(batch.column(1), batch.column(2)):
                words, at, left = (t.as_py() or b"").split(), 0, []
                copies = copies.as_py()
                for f in copies:
                    left += words[at : f["start"]]
                    at = f["start"] + f["length"]
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                factors.append(len(copies))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(factors, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "n_factors", "kept"])

    out = rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, n_factors long, kept binary")
    return out.withColumnRenamed("id", id_col)


def op11_relative_lz(spark, sf_dir: str) -> DataFrame:
    kept = without_copies(relative_parse(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for the whole query, window by window.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
w AS (SELECT r, doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS h FROM i),
f AS (SELECT r, i, min((coalesce(doc_id, -9223372036854775808), i)) OVER (PARTITION BY h) < (coalesce(doc_id, -9223372036854775808), i) AS earlier FROM w),
c AS (SELECT r, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM f WHERE earlier GROUP BY r),
k AS (SELECT doc_id, ws, coalesce(gone, []) AS gone, list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM d LEFT JOIN c USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
