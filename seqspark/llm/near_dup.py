"""Near-duplicates by BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its five-word shingles (lower-cased; a text of fewer
words is one shingle). BagMinHash: every shingle owns independent Poisson
processes over the dyadic pieces [0,1), [1,2), [2,4), [4,8)... of its discretised
weight; a point of a piece that reaches past the weight counts only if its
place, found by halving the piece, lies below it. Each point falls on one of M
components, which keeps its earliest point, so two texts agree in a component
with a probability that is their weighted Jaccard similarity. Points come in
order of time, and a process stops once it is later than all components.

Copies of one word sequence are first gathered into one text. Texts that share a
band of ROWS components are candidates. In each bucket all are verified against
one centre (the text with the most company over all its buckets). Texts of one
bucket that are then still in different components meet by their rarest shingles
(``prefix_pairs``), which every pair at the threshold has in common; these pairs
are verified too. So every candidate pair ends up in one component or can't
reach the threshold; no bucket is capped, and none is paired with itself.

With M = 80, ROWS = 4: a pair at similarity 0.8 misses all 20 bands with
probability 3e-5.

Defined cases: null and empty texts are copies of each other; rows that share
an id each count; null ids are kept, in the class of their text (a class of
texts all without id has a null id); extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.components import connected_components
from seqspark.llm.shared import claim, dropped, mix64, table, written

WORDS, M, ROWS = 5, 80, 4
BANDS = M // ROWS
CACHE_WORDS = 400_000
CLASS = 1.08  # width of a class of sizes, by which profiles look for each other
_HASH: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    claim("near_dup", _HASH.clear)
    if len(_HASH) > CACHE_WORDS:
        _HASH.clear()
    for w in set(words).difference(_HASH):
        _HASH[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(list(map(_HASH.__getitem__, words)), np.uint64)


def shingles(text: str | None, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct 64-bit hashes of the word shingles, ascending; how often each occurs; a hash of the whole sequence."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    h = word_hashes(words)
    if len(h) < size:
        h = np.concatenate([h, np.zeros(size - len(h), np.uint64)])
    out = np.zeros(len(h) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(out) + k])
    kinds, n = np.unique(out, return_counts=True)
    return kinds, n, len(words)


def sequence_key(text: str | None) -> bytes:
    """A 128-bit key of the word sequence."""
    import xxhash

    return xxhash.xxh128_digest(" ".join((text or "").lower().split()).encode("utf-8", "surrogatepass"))


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard of two results of ``shingles``; 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """bags x m BagMinHash values; infinity for an empty bag."""
    sig = np.full((len(bags), m), np.inf)
    if not sum(len(h) for h, _ in bags):
        return sig
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    item = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([n for _, n in bags])
    parts = [(doc, item, np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), weight)]  # piece [0, 1)
    low, k = 1, 1
    while (more := weight > low).any():  # piece [low, 2 * low)
        doc, item, weight = doc[more], item[more], weight[more]
        parts.append((doc, item, np.full(len(doc), k), np.full(len(doc), low), weight))
        low, k = 2 * low, k + 1
    doc, item, piece, low, weight = (np.concatenate(x) for x in zip(*parts))
    length = np.maximum(low, 1)
    with np.errstate(over="ignore"):
        state = mix64(item + piece.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    time, flat = np.zeros(len(doc)), sig.reshape(-1)
    highest = np.full(len(bags), np.inf)
    while len(doc):
        with np.errstate(over="ignore"):
            state = state + np.uint64(0x9E3779B97F4A7C15)
            a = mix64(state)
            b = mix64(a ^ np.uint64(0xA0761D6478BD642F))
        time = time - np.log(((a >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / length
        on = time < highest[doc]
        if not on.all():
            doc, state, time, low, length, weight, b = (x[on] for x in (doc, state, time, low, length, weight, b))
        where = (b >> np.uint64(33)).astype(np.int64) % m
        place = low + (((b & np.uint64(0xFFFFFFFF)).astype(np.int64) * length) >> 32)  # the unit cell, by halving the piece
        inside = place < weight
        np.minimum.at(flat, doc[inside] * m + where[inside], time[inside])
        touched = np.unique(doc)
        highest[touched] = sig[touched].max(1)
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band, different from band to band."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), -1, rows)
    out = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, key of its word sequence, size of its multiset, bands (empty for empty texts)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                texts = part.column(1).to_pylist()
                bags = [shingles(t) for t in texts]
                found = bands(signatures([b[:2] for b in bags]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([sequence_key(t) for t in texts], pa.binary()), pa.array([int(b[1].sum()) for b in bags], pa.int64()), pa.array([list(x) if b[2] else [] for x, b in zip(found, bags)], pa.list_(pa.int64()))],
                    names=["id", "key", "size", "bands"],
                )

    return rows.mapInArrow(run, f"id {kind}, key binary, size long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs`` (a, b: keys of texts) whose texts (key, text) overlap by ``threshold`` or more.

    A text may be the centre of very many pairs: the pairs are light when they
    meet it, and Spark splits such a key's rows.
    """
    left = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "ta"}), "a")
    both = left.join(texts.withColumnsRenamed({"key": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")

    def run(batches):
        last_text, last = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                tb = tb.as_py()
                if last_text != tb:
                    last_text, last = tb, shingles(tb)
                keep.append(similarity(shingles(ta.as_py()), last) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), class_size, n_texts (different word sequences in the class)."""
    sk = written(sketches(docs, id_col, text_col), "neardup-sketch")
    texts = written(sk.groupBy("key").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "neardup-texts")
    spread = texts.select("key", "size", F.explode("bands").alias("band"))
    crowd = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = written(spread.join(crowd, "band"), "neardup-buckets")
    company = met.groupBy("key").agg(F.sum("n").alias("company"))
    centre = met.join(company, "key").groupBy("band").agg(F.max(F.struct("company", "key", "size")).alias("c")).select("band", F.col("c.key").alias("b"), F.col("c.size").alias("sb"))
    fits = F.least("size", "sb") >= threshold * F.greatest("size", "sb")
    star = written(met.join(centre, "band").where("key <> b").where(fits).select(F.col("key").alias("a"), "b").distinct(), "neardup-star")

    # the text of every candidate: one document of each of its word sequences
    body = _texts_of(docs, met.select("key").distinct(), text_col)
    links = written(verified(star, body, threshold), "neardup-links")
    parts = written(connected_components(links.select("a", "b"), "neardup-parts"), "neardup-part")

    # texts that share a bucket but no component yet: those that may still be linked share a rare shingle
    home = met.join(parts.withColumnsRenamed({"node": "key"}), "key", "left").select("band", "key", "size", F.coalesce("component", "key").alias("part"))
    split = home.groupBy("band").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("band")
    open_ = written(home.join(split, "band").select("key", "size", "part").distinct(), "neardup-open")
    rest = prefix_pairs(body.join(open_, "key"), threshold)
    rest = rest.join(star, ["a", "b"], "left_anti").join(star.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    rest = written(rest, "neardup-rest")
    if not rest.isEmpty():
        more = links.union(verified(rest, body, threshold))
        before, parts = parts, written(connected_components(more.select("a", "b"), "neardup-parts"), "neardup-part")
        dropped(before)
    dropped(met, star, body, links, open_, rest)

    placed = texts.join(parts.withColumnsRenamed({"node": "key"}), "key", "left").select("key", "rep", "copies", F.coalesce("component", "key").alias("part"))
    classes = placed.groupBy("part").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n_texts"))
    of_key = placed.join(classes, "part").select("key", "class_id", "class_size", "n_texts")
    return sk.select("id", "key").join(of_key, "key").select(F.col("id").alias(id_col), "class_id", "class_size", "n_texts")


def prefix_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of ``texts`` (key, text, size, part) of different parts, with every pair whose overlap is ``threshold`` or more.

    A shingle that occurs n times counts as n tokens. Texts of x and y tokens
    have to share least(x, y) tokens, so in any one order of all tokens the
    first x - least + 1 of one and y - least + 1 of the other have a token in
    common. The order is by the number of texts that have the token. So a token at
    place i of a text of x counts for partners of at most Y tokens, a number that
    i and x give; two texts meet at a token only if each is small enough for the
    other. This holds for a template with all its pages as exactly as their
    similarity: texts just below the threshold do not meet.

    Who meets whom is found between profiles (token, x, Y), of which a template
    has few, however many texts it has; only then do texts come in.
    Tokens of one text alone never meet anything and are left out once they have
    taken their place.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                bags = [shingles(x.as_py()) for x in part.column(1)]
                out = []
                for h, n, _ in bags:
                    first = np.repeat(np.cumsum(n) - n, n)
                    with np.errstate(over="ignore"):
                        out.append(mix64(np.repeat(h, n) + (np.arange(len(first)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], names=["key", "token"])

    each = texts.select("key", "text").mapInArrow(run, "key binary, token array<long>").select("key", F.explode("token").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(often, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    share = threshold / (1 + threshold)
    place = F.col("i") + F.col("size") - F.col("kept")
    tokens = shared.join(texts.select("key", "size", "part"), "key").withColumn("kept", F.size("tokens"))
    room = (F.floor(F.col("size") - share * (1 + threshold) * F.col("size") + 1e-6) + 1 - (F.col("size") - F.col("kept"))).cast("int")  # for the smallest partners
    tokens = tokens.where(room > 0).select("key", "part", "size", "kept", F.posexplode(F.slice("tokens", 1, room)).alias("i", "t"))
    most = F.floor(F.least((F.col("size") - place + 1e-6) / share - F.col("size"), F.col("size") / threshold + 1e-6)).cast("long")
    rows = tokens.select(F.col("t.token").alias("token"), "size", most.alias("most"), "key", "part").where(F.col("most") >= threshold * F.col("size") - 1e-6)
    rows = written(rows, "neardup-prefixes")

    profiles = rows.groupBy("token", "size", "most").agg(F.min("part").alias("p"), F.max("part").alias("q"))
    of_size = lambda x: F.floor(F.log(x) / math.log(CLASS)).cast("int")
    asked = F.explode(F.sequence(of_size(F.greatest(threshold * F.col("size") - 1e-6, F.lit(1))), of_size(F.col("most") + 1e-6)))
    left = profiles.select("token", asked.alias("class"), F.col("size").alias("x"), F.col("most").alias("x_most"), F.col("p").alias("xp"), F.col("q").alias("xq"))
    right = profiles.select("token", of_size(F.col("size") + 1e-6).alias("class"), F.col("size").alias("y"), F.col("most").alias("y_most"), F.col("p").alias("yp"), F.col("q").alias("yq"))
    fit = left.join(right, ["token", "class"]).where("x <= y_most AND y <= x_most AND (x < y OR x = y AND x_most <= y_most)").where("xp <> xq OR yp <> yq OR xp <> yp")
    fit = fit.select("token", "x", "x_most", "y", "y_most")
    one = rows.select("token", F.col("size").alias("x"), F.col("most").alias("x_most"), F.col("key").alias("a"), F.col("part").alias("pa"))
    two = rows.select("token", F.col("size").alias("y"), F.col("most").alias("y_most"), F.col("key").alias("b"), F.col("part").alias("pb"))
    met = fit.join(one, ["token", "x", "x_most"]).join(two, ["token", "y", "y_most"]).where("pa <> pb AND a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(key, text) of the wanted keys, one text for each."""
    raw = docs.select(F.col(text_col).alias("text"))

    def keyed(batches):
        seen: set[bytes] = set()  # one text for each key and task: copies don't travel
        for batch in batches:
            keys = [sequence_key(x.as_py()) for x in batch.column(0)]
            new = [k not in seen and not seen.add(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "text"]).filter(pa.array(new, pa.bool_()))

    found = raw.mapInArrow(keyed, "key binary, text string").join(wanted, "key", "left_semi")
    return written(found.groupBy("key").agg(F.min("text").alias("text")), "neardup-bodies")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
