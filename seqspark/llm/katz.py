"""Katz backoff n-grams with Good-Turing discounts and exactly normalised backoff weights.

Texts become blocks of token numbers, a table bucketed by block. Order by order,
every block asks for the training counts of its distinct n-grams: an n-gram goes
to the bucket of its context (all words but the last), where what all blocks
sent is added up, and the answers are stored, in the order they were asked for:
the count of each n-gram, and of each context how many of its followers occur
once, twice... and the mass of its followers at the order below, from which the
backoff weight follows exactly. So counts are summed after each block has summed
its own, no task holds a vocabulary, and an order needs nothing but the
probabilities of the order below, which are kept with the block. The followers
of contexts that are met more than HOT times lie in many buckets, by n-gram;
their sums, a bounded number, are added up and sent to all tasks. An order is
asked for in several passes over the buckets, so that the exchange in flight
stays small beside the text.

Per token and order: P(w | c) = d(r) r / n(c) where w follows context c r > 0
times, else alpha(c) P(w | c without its first word); P(w) = d(r) r / N where w
was seen, else the mass that is left, for one unknown word. d are Good-Turing
ratios for counts up to CUT, and 1 above; where the counts of counts give no
ratio in (0, 1), (r - 1/2) / r is taken for that order, and r - 1/2 for r in
contexts whose followers all have larger counts. alpha(c) = (1 - sum of d(r) r /
n(c)) / (1 - sum of the followers' probabilities at the order below), so the
probabilities of all words and the unknown one add up to 1. After an unseen
context the order below is used as it is. The first words of a text follow start
marks, whose count is the number of training texts.

Words are runs of anything but ASCII white space, with A-Z lower-cased; each
text ends in one end mark, which counts as a token. Words, contexts and n-grams
are told apart by 64-bit hashes.

Defined cases: a null text is empty (one token); a null ``train`` means not
training; without training tokens there are no base scores (null) and scores;
extra columns are ignored; repeated rows each count and each get a row.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import Numbered, dropped, fold, mix64, shared_dir, swept, table, written

BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
HOT, MOST_HOT = 250_000, 1 << 16  # a context met more often than HOT and N / MOST_HOT is spread over buckets
PASSES = {2: 2, 3: 3}  # of an order, over the buckets; higher ones take the last
CUT = 5
END, START = 0, 1  # numbers of the two marks in every block


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _frombytes(x, kind) -> np.ndarray:
    return np.frombuffer(x, kind)


def blocks(docs: DataFrame, id_col: str, text_col: str, train_col: str) -> DataFrame:
    """The block table: its documents' ids and train flags, tokens per document, token numbers, and the words' hashes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        part, count, id_type = TaskContext.get().partitionId(), 0, None
        at = Numbered({b" ": END, b"\t": START})  # no word holds a blank
        ids, flags, sizes, data, held = [], [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + count], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([flags], pa.list_(pa.bool_())), pa.array([np.array(sizes, np.int32).tobytes()], pa.binary()), pa.array([np.concatenate(data).tobytes()], pa.binary()), pa.array([_hashes(list(at)).tobytes()], pa.binary())],
                names=["block", "n", "ids", "train", "sizes", "tokens", "words"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text, train in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = tokens(text.as_py())
                x = np.empty(len(words) + 1, np.int32)
                x[:-1] = np.fromiter(map(at.__getitem__, words), np.int32, len(words))
                x[-1] = END
                ids.append(key)
                flags.append(train)
                sizes.append(len(x))
                data.append(x)
                held += len(x)
                if held >= BLOCK_TOKENS:
                    yield flush()
                    count += 1
                    at = Numbered({b" ": END, b"\t": START})
                    ids, flags, sizes, data, held = [], [], [], [], 0
        if ids:
            yield flush()

    made = rows.mapInArrow(run, f"block long, n long, ids array<{kind}>, train array<boolean>, sizes binary, tokens binary, words binary")
    return _bucketed(made, "blocks")


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """Written as a table bucketed by block, so that it meets others by block without an exchange."""
    spark = df.sparkSession
    name = f"katz_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._seqspark_path, out._seqspark_table = path, name
    return out


def _gone(*tables: DataFrame) -> None:
    for df in tables:
        if name := getattr(df, "_seqspark_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        dropped(df)


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable argsort of random 64-bit numbers, and the numbers in that order: their high bits and the places are sorted as one number."""
    bits = np.uint64(max(1, len(x)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = x & ~low
    key |= np.arange(len(x), dtype=np.uint64)
    key.sort()
    key &= low
    order = key.view(np.int64)
    found = x[order]
    if not (found[1:] >= found[:-1]).all():
        order = np.argsort(x, kind="stable")
        found = x[order]
    return order, found


def _top(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash, in order of the hashes."""
    return (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _word_order(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's words by hash, without the start mark; and their buckets."""
    order, _ = _sorted(words)
    order = order[order != START]
    return order, _top(words[order], buckets)


class _Grams:
    """A block's distinct n-grams of one order in the order in which they are asked for.

    ``g`` and ``e`` are hashes of each token's context and n-gram; those of ``hot`` contexts go by n-gram.
    Of several passes, ``part`` takes its share of the buckets.
    """

    def __init__(self, g: np.ndarray, e: np.ndarray, hot: np.ndarray, buckets: int, passes: int = 1, part: int = 0):
        any_hot = bool(hot.any())
        if passes > 1:
            some = np.flatnonzero(_top(np.where(hot, e, g) if any_hot else g, buckets) % passes == part)
            order, found = _sorted(e[some])
            order = some[order]
        else:
            order, found = _sorted(e)
        new = np.append(True, found[1:] != found[:-1])[: len(order)]
        heads = np.flatnonzero(new)
        at, found = order[heads], found[heads]  # a token of each n-gram
        if any_hot:
            on = hot[at]
            cold, warm = np.flatnonzero(~on), np.flatnonzero(on)
            cold = cold[_sorted(g[at[cold]])[0]]
            warm = warm[np.lexsort((g[at[warm]], _top(found[warm], buckets)))]
            place = np.append(cold, warm)
            self.hot = np.append(np.zeros(len(cold), bool), np.ones(len(warm), bool))
            self.g = g[at[place]]
        else:
            place, self.g = _sorted(g[at])
            self.hot = np.zeros(len(place), bool)
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        self.token, self.of_token = order, rank[np.cumsum(new) - 1]  # tokens and their n-grams
        self.example, self.e = at[place], found[place]
        self.bucket = _top(np.where(self.hot, self.e, self.g) if any_hot else self.g, buckets)
        change = np.append(True, self.g[1:] != self.g[:-1])[: len(self.g)]
        if any_hot:
            change[1:] |= (self.bucket[1:] != self.bucket[:-1]) | (self.hot[1:] != self.hot[:-1])
        self.heads = np.flatnonzero(change)  # one per context
        self.runs = np.diff(np.append(self.heads, len(self.g)))

    def per_token(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.token), values.dtype)
        out[self.token] = values[self.of_token]
        return out

    def slices(self):
        """(bucket, hot, n-grams from, to, contexts from, to) of each stretch that goes to one bucket."""
        key = self.bucket[self.heads] * 2 + self.hot[self.heads]
        ends = np.append(self.heads, len(self.g))
        for k, i, j in _slices(key):
            yield k >> 1, bool(k & 1), int(ends[i]), int(ends[j]), i, j


class _Block:
    """What is known of a block: tokens, hashes and, of the orders done, the counts of its n-grams and the probabilities of the last."""

    def __init__(self, sizes: bytes, tok: bytes, words: bytes, c: np.ndarray, buckets: int, hot: int):
        self.sizes, self.tok = np.frombuffer(sizes, np.int32), np.frombuffer(tok, np.int32)
        self.words, self.c, self.buckets, self.hot = np.frombuffer(words, np.uint64), c, buckets, hot
        self.first = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.inside = np.arange(len(self.tok)) - np.repeat(self.first, self.sizes)
        self.h = self.words[self.tok]

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before; ``start`` for the first of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def hashes(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        g, step = np.zeros(len(self.h), np.uint64), np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            for back in range(order - 1, 0, -1):
                w = np.where(self.inside >= back, np.append(np.zeros(back, np.uint64), self.h[: len(self.h) - back])[: len(self.h)], self.words[START])
                g = mix64(g * step + w)
            return g, mix64(g * step + self.h)

    def grams(self, order: int, met: np.ndarray, passes: int = 1, part: int = 0) -> _Grams:
        return _Grams(*self.hashes(order), met > self.hot, self.buckets, passes, part)


def _slices(bucket: np.ndarray):
    """(bucket, from, to) of each stretch of equal buckets."""
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[heads].tolist(), heads.tolist(), np.append(heads, len(bucket))[1:].tolist())


def _binary(values) -> pa.Array:
    return pa.array([x.tobytes() for x in values], pa.binary())


def _squeezed(values) -> pa.Array:
    import zstandard

    pack = zstandard.ZstdCompressor(1).compress
    return pa.array([pack(np.ascontiguousarray(x).tobytes()) for x in values], pa.binary())


def _steps(g: np.ndarray) -> np.ndarray:
    """Ascending numbers as their steps, one byte of all after the other, which packs well."""
    return np.ascontiguousarray(np.diff(g, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _from_steps(x) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(_wide(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _wide(x, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _stats(counts: np.ndarray) -> list[int]:
    """How many have count 1 .. CUT + 1; how many at all; their sum."""
    seen = counts[counts > 0]
    return [*np.bincount(np.minimum(seen, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist(), len(seen), int(seen.sum())]


def word_counts(table_: DataFrame, buckets: int) -> DataFrame:
    """Stored answers (block, bucket, counts, stats): training counts of each block's words, in its order; stats once a bucket."""

    def ask(batches):
        for batch in batches:
            for block, flags, sizes, tok, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
                sizes, tok, words = _frombytes(sizes, np.int32), _frombytes(tok, np.int32), _frombytes(words, np.uint64)
                n = np.bincount(tok[np.repeat(np.array(flags, bool), sizes)], minlength=len(words))
                order, bucket = _word_order(words, buckets)
                parts = list(_slices(bucket))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), pa.array([b for b, *_ in parts], pa.int32()), _binary(words[order[i:j]] for _, i, j in parts), _squeezed(n[order[i:j]] for _, i, j in parts)], names=["block", "bucket", "words", "n"])

    def answer(key, rows):
        words = [_frombytes(x.as_buffer(), np.uint64) for x in rows.column("words")]
        n = [_wide(x.as_py(), np.int64) for x in rows.column("n")]
        _, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(int(inverse.max()) + 1, np.int64)
        np.add.at(total, inverse, np.concatenate(n))
        back = np.split(total[inverse], np.cumsum([len(x) for x in words])[:-1])
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "counts": _squeezed(back), "stats": pa.array([_stats(total), *[None] * (len(back) - 1)], pa.list_(pa.int64()))})

    asked = table_.select("block", "train", "sizes", "tokens", "words").mapInArrow(ask, "block long, bucket int, words binary, n binary")
    return written(asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, counts binary, stats array<long>"), "katz-words")


def _summed(answers: DataFrame) -> list[int]:
    cols = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(CUT + 3)]
    return [x or 0 for x in answers.where("stats IS NOT NULL").agg(*cols).head()]


def discounts(stats: list[int]) -> np.ndarray:
    """d[r] for counts 0 .. CUT; larger counts are not discounted."""
    n = [0, *stats[: CUT + 1]]
    halves = np.array([1.0, *((r - 0.5) / r for r in range(1, CUT + 1))])
    if not all(n[1:]):
        return halves
    a = (CUT + 1) * n[CUT + 1] / n[1]
    d = np.array([1.0, *(((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a != 1 else 0.0 for r in range(1, CUT + 1))])
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else halves


def _discounted(d: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.where(r <= CUT, d[np.minimum(r, CUT)], 1.0) * r


def unigram(stats: list[int], d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """P(w) of words with training counts c; 0 stands for the one unknown word."""
    n = stats[-1]
    counts = np.arange(1, CUT + 1)
    unknown = float((np.array(stats[:CUT]) * counts * (1 - d[1:])).sum()) / n
    return np.where(c > 0, _discounted(d, c) / n, unknown)


def gram_counts(known: DataFrame, order: int, setup: dict, part: int) -> DataFrame:
    """Stored answers of one pass: for each n-gram of a block its training count; of each context, unless hot, the number of followers with count 1 .. CUT,
    the sum and the number of larger counts, and, where a follower was not seen, the mass of all followers at the order below. Of hot contexts, a bucket's share of the same."""
    passes = _passes(order)

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                block, met, below = _opened(row, setup)
                grams = block.grams(order, met, passes, part)
                n = np.bincount(grams.of_token, np.repeat(np.array(row["train"], bool), block.sizes)[grams.token], len(grams.e)).astype(np.int64)
                below = np.where(n > 0, below[grams.example], 0.0)  # others are nobody's followers
                cuts = list(grams.slices())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(cuts), pa.int64()), pa.array([b for b, *_ in cuts], pa.int32()), pa.array([h for _, h, *_ in cuts], pa.bool_())]
                    + [_squeezed(_steps(grams.g[grams.heads[k:m]]) for *_, k, m in cuts), _squeezed(grams.runs[k:m].astype(np.int32) for *_, k, m in cuts)]
                    + [_binary(grams.e[a:b] for _, _, a, b, *_ in cuts), _squeezed(n[a:b] for _, _, a, b, *_ in cuts), _squeezed(below[a:b] for _, _, a, b, *_ in cuts)],
                    names=["block", "bucket", "hot", "contexts", "runs", "grams", "n", "below"],
                )

    def answer(key, rows):
        raw = lambda name: [_frombytes(x.as_buffer(), np.uint64) for x in rows.column(name)]
        wide = lambda name, kind: [_wide(x.as_py(), kind) for x in rows.column(name)]
        contexts, grams, runs = [_from_steps(x.as_py()) for x in rows.column("contexts")], raw("grams"), wide("runs", np.int32)
        v, e, run = np.concatenate(contexts), np.concatenate(grams), np.concatenate(runs)
        n, below = np.concatenate(wide("n", np.int64)), np.concatenate(wide("below", np.float64))
        g, hot = np.repeat(v, run), np.repeat(np.array(rows.column("hot").to_pylist(), bool), [len(x) for x in contexts])
        order_, found = _sorted(e)
        new = np.append(True, found[1:] != found[:-1])
        heads = np.flatnonzero(new)
        total = np.add.reduceat(n[order_], heads)
        r = np.empty(len(e), np.int64)
        r[order_] = total[np.cumsum(new) - 1]
        seen = order_[heads][total > 0]  # a row of each n-gram that occurs
        place, kinds = _sorted(g[seen])
        seen = seen[place]
        lower = np.maximum.reduceat(below[order_], heads)[total > 0][place]  # a block that has an n-gram in held-out texts alone says 0
        mark = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])[: len(seen)])
        kinds, count = kinds[mark], r[seen]
        add = lambda x: np.add.reduceat(x, mark) if len(mark) else np.zeros(0, x.dtype)
        followers = np.stack([*(add((count == k).astype(np.int64)) for k in range(1, CUT + 1)), add(np.where(count > CUT, count, 0)), add((count > CUT).astype(np.int64))], 1)
        mass = add(lower)
        at = np.minimum(np.searchsorted(kinds, v), max(len(kinds) - 1, 0))
        there = kinds[at] == v if len(kinds) else np.zeros(len(v), bool)
        back = np.zeros((len(v), CUT + 2), np.int64)
        cold = there & ~hot
        back[cold] = followers[at[cold]]
        unseen = np.logical_or.reduceat(r == 0, np.cumsum(run) - run)
        mass_back = np.zeros(len(v))
        mass_back[cold & unseen] = mass[at[cold & unseen]]
        warm = np.unique(at[there & hot])
        cut_v, cut_e = np.cumsum([len(x) for x in contexts])[:-1], np.cumsum([len(x) for x in grams])[:-1]
        first = lambda x: pa.array([x, *[None] * (len(grams) - 1)], pa.binary())
        return pa.table(
            {
                "block": rows.column("block"), "bucket": rows.column("bucket"), "hot": rows.column("hot"), "counts": _squeezed(np.split(r, cut_e)), "followers": _squeezed(np.split(back, cut_v)), "mass": _squeezed(np.split(mass_back, cut_v)),
                "stats": pa.array([_stats(total), *[None] * (len(grams) - 1)], pa.list_(pa.int64())), "hot_g": first(kinds[warm].tobytes()), "hot_f": first(followers[warm].tobytes()), "hot_m": first(mass[warm].tobytes()),
            }
        )

    asked = known.mapInArrow(ask, "block long, bucket int, hot boolean, contexts binary, runs binary, grams binary, n binary, below binary")
    kind = "block long, bucket int, hot boolean, counts binary, followers binary, mass binary, stats array<long>, hot_g binary, hot_f binary, hot_m binary"
    return written(asked.groupBy("bucket").applyInArrow(answer, kind), f"katz-counts-{order}")


def _passes(order: int) -> int:
    return PASSES.get(order, PASSES[max(PASSES)])


def _hot(answers: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, followers and mass of the hot contexts, at most MOST_HOT, over all buckets."""

    def parts(batches):
        for batch in batches:
            for g, f, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                f = np.frombuffer(f, np.int64).reshape(-1, CUT + 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(g, np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in f.T), pa.array(np.frombuffer(m, np.float64))], names=["g", *(f"f{i}" for i in range(CUT + 2)), "m"])

    kind = "g long, " + ", ".join(f"f{i} long" for i in range(CUT + 2)) + ", m double"
    rows = answers.where("length(hot_g) > 0").select("hot_g", "hot_f", "hot_m").mapInArrow(parts, kind).groupBy("g").agg(*(F.sum(f"f{i}").alias(f"f{i}") for i in range(CUT + 2)), F.sum("m").alias("m")).toArrow()
    g = rows.column("g").to_numpy().view(np.uint64)
    order = np.argsort(g)
    return g[order], np.stack([rows.column(f"f{i}").to_numpy() for i in range(CUT + 2)], 1)[order], rows.column("m").to_numpy()[order]


def _counts_of(words: np.ndarray, answers: list[dict], buckets: int) -> np.ndarray:
    """Training counts of a block's words, by number; the start mark counts as often as the end mark."""
    order, _ = _word_order(words, buckets)
    out = np.zeros(len(words), np.int64)
    out[order] = np.concatenate([_wide(a["counts"], np.int64) for a in sorted(answers, key=lambda a: a["bucket"])])
    out[START] = out[END]
    return out


def _opened(row: dict, setup: dict) -> tuple[_Block, np.ndarray, np.ndarray]:
    """The block of a row; and, from the answers of the orders done, how often each token's context at the next order was met, and the token's probability at the last one."""
    block = _Block(row["sizes"], row["tokens"], row["words"], _wide(row["c"], np.int64), setup["buckets"], setup["hot"])
    met, p = block.before(block.c[block.tok], block.c[START]), unigram(setup["stats"], setup["d"][0], block.c)[block.tok]
    for k, hot in enumerate(setup["contexts"], 2):
        grams = block.grams(k, met)
        r, q = _answered(grams, row[f"level{k}"], hot.value, met, p, setup["d"][k - 1])
        met, p = block.before(grams.per_token(r), block.c[START]), grams.per_token(q)
    return block, met, p


def _answered(grams: _Grams, answers: list[dict], hot: tuple, met: np.ndarray, below: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and probabilities of a block's n-grams from its stored answers."""
    answers = sorted(answers, key=lambda a: (a["hot"], a["bucket"]))
    get = lambda name, kind: np.concatenate([_wide(a[name], kind) for a in answers])
    r, followers, mass = get("counts", np.int64), get("followers", np.int64).reshape(-1, CUT + 2).copy(), get("mass", np.float64).copy()
    g, f, m = hot
    if len(g):
        at = np.minimum(np.searchsorted(g, grams.g[grams.heads]), len(g) - 1)
        on = grams.hot[grams.heads] & (g[at] == grams.g[grams.heads])
        followers[on], mass[on] = f[at[on]], m[at[on]]
    weights = np.concatenate([d[1:] * np.arange(1, CUT + 1), [1.0, 0.0]])
    of_context = np.repeat(np.arange(len(grams.heads)), grams.runs)
    n = met[grams.example[grams.heads]].astype(float)
    none = ~followers[:, :CUT].any(1)  # nothing to take from by the ratios
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (followers @ weights - np.where(none, 0.5 * followers[:, CUT + 1], 0.0)) / n
        alpha = np.where(n > 0, np.maximum(1 - kept, 0) / np.maximum(1 - mass, 1e-300), 1.0)
        return r, np.where(r > 0, (_discounted(d, r) - np.where(none[of_context], 0.5, 0.0)) / n[of_context], alpha[of_context] * below[grams.example])


def score_texts(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score (add 0.1 to the unigram counts), score (Katz, of ``order`` 2 or more) and score_lower (of the order below), log10."""
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession
    made = blocks(docs, id_col, text_col, train_col)
    kind = made.schema["ids"].dataType.elementType.simpleString()
    total = made.agg(F.sum("n")).head()[0] or 0
    buckets = max(8, math.ceil(total / BUCKET_TOKENS))
    uni = word_counts(made, buckets)
    stats = _summed(uni)
    setup = {"buckets": buckets, "hot": max(HOT, total // MOST_HOT), "stats": stats, "d": [discounts(stats)]}
    n_train, vocabulary = stats[-1], stats[-2]

    def counted(batches):
        for batch in batches:
            for block, words, answers in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), _squeezed([_counts_of(np.frombuffer(words, np.uint64), answers, buckets)])], names=["block", "c"])

    by_block = lambda t, name, *cols: t.groupBy("block").agg(F.collect_list(F.struct("bucket", *cols)).alias(name))
    known = _bucketed(made.select("block", "words").join(by_block(uni, "answers", "counts"), "block").mapInArrow(counted, "block long, c binary"), "counts")
    _gone(uni)
    swept(spark)
    text_cols, levels = ["block", "train", "sizes", "tokens", "words"], []
    setup["contexts"] = []
    for k in range(2, order + 1) if n_train else ():
        asked = made.select(*text_cols).join(known, "block")
        for level in levels:
            asked = asked.join(level, "block")
        parts = []
        for part in range(_passes(k)):
            parts.append(gram_counts(asked, k, setup, part))
            swept(spark)
        answers = parts[0]
        for x in parts[1:]:
            answers = answers.unionByName(x)
        setup = setup | {"d": [*setup["d"], discounts(_summed(answers))], "contexts": [*setup["contexts"], spark.sparkContext.broadcast(_hot(answers))]}
        levels.append(_bucketed(by_block(answers, f"level{k}", "hot", "counts", "followers", "mass"), f"level{k}"))
        _gone(*parts)
        swept(spark)

    def out(block, row, lower, score):
        c, n = block.c, len(block.sizes)
        base = np.add.reduceat(np.log10((c + 0.1) / (n_train + 0.1 * (vocabulary + 1)))[block.tok], block.first) if n_train else np.full(n, np.nan)
        long = lambda x: pa.array(np.asarray(x, np.int64))
        ids = row["ids"]
        return pa.RecordBatch.from_arrays(
            [ids, long(block.sizes), long(np.add.reduceat((c > 0)[block.tok].astype(np.int64), block.first)), long([n_train] * n), *(pa.array(x, from_pandas=True) for x in (base, score, lower))],
            names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score", "score_lower"],
        )

    out_type = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_lower double"

    def scored(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names) if c != "ids"} | {"ids": ids[i].values}
                if n_train:
                    block, met, below = _opened(row, setup | {"contexts": setup["contexts"][:-1]})
                    grams = block.grams(order, met)
                    _, p = _answered(grams, row[f"level{order}"], setup["contexts"][-1].value, met, below, setup["d"][-1])
                    yield out(block, row, *(np.add.reduceat(_log(x), block.first) for x in (below, grams.per_token(p))))
                else:
                    block = _Block(row["sizes"], row["tokens"], row["words"], _wide(row["c"], np.int64), buckets, 1)
                    yield out(block, row, *[np.full(len(block.sizes), np.nan)] * 2)

    rows = made.select(*text_cols, "ids").join(known, "block")
    for level in levels:
        rows = rows.join(level, "block")
    found = written(rows.mapInArrow(scored, out_type), "katz-scores")
    _gone(made, known, *levels)
    swept(spark)
    return found


def _log(value: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(value, 1e-300))


def op6_katz_backoff(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs.select("doc_id", "text", (fold("doc_id", 10) != 0).alias("train")), "train", order=3)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.col("score_lower").alias("score_2"))
