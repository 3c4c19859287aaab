"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target proportions.

The documents of a source form a queue of tokens. A window is WINDOW sequences
of SEQUENCE tokens, in which the queues are served in turn, each with its
quantum (its target share of the window) plus the deficit that it carries from
the windows before, in whole tokens. When a queue runs dry, the others fill the
window, and go on by their targets without it.

Token k of a queue (0, 1, ...) is due at (k + 1/2) / weight, and windows are
filled by due time, ties by the queues' order. So at the end of any window each
queue has given its weight times the time that has come, to half a token: this
is the deficit that it carries. A queue that is dry is due no more, and time
goes faster for the others. What stands between two windows is the time and the
queue of the token that the later one begins with; from these borders, two
numbers a window, follow the tokens of any queue in any window, whatever the
number of queues is. Partitions don't wait for each other.

Without given targets, each source's share of all tokens is its target. In a
window the ``max_queues`` sources with the greatest targets come first, one
after the other, at places that follow by arithmetic; then come all others, by
the time that their stretches of documents end, at places that a sort within the
window gives. How many tokens of a source a window has doesn't depend on that.

Defined cases: a null text is empty (one end token); a null source counts as
the empty one; sources without a weight, or with one of 0, come after all
others, in equal shares; an empty table gives no pieces; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.shared import table, written
from seqspark.llm.tokens import encoder, slices
from seqspark.operators.ranks import numbered

SEQUENCE = 1024
WINDOW = 64
PERIOD = 64
SPAN = 8
STRETCH_BYTES = 1 << 19
HELD_BYTES = 32 << 20


def least_weight(last: float | None) -> float:
    """The weight of queues whose target is 0, so that they are due after ``last``, when the others are dry."""
    return 0.25 / last if last else 1.0


def tokens_before(weight: np.ndarray, due: np.ndarray) -> np.ndarray:
    """How many tokens queues of these weights have that are due before ``due``, if they never run dry."""
    k = np.floor(weight * due + 0.5)
    while (more := (k + 0.5) / weight < due).any():
        k += more
    while (less := (k > 0) & ((k - 0.5) / weight >= due)).any():
        k -= less
    return k.astype(np.int64)


def borders(weights: np.ndarray, sizes: np.ndarray, many: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(due, queue) of the tokens at ``places`` (ascending) of the whole stream.

    Queues of one weight and size form a class, ``many`` says of how many; they
    are numbered class by class. Spans of time are halved, and the places with
    them, until a span has few tokens a class; these are put in order.
    """
    due, queue = np.zeros(len(places)), np.zeros(len(places), np.int64)
    few, first = max(4096, 2 * len(weights)), np.cumsum(many) - many
    end = np.nextafter(((sizes - 0.5) / weights).max(), np.inf) if len(weights) else 0.0
    spans = [(0.0, end, np.zeros_like(sizes), sizes, 0, len(places))]
    while spans:
        begin, end, before, until, i, j = spans.pop()
        if i == j:
            continue
        middle = (begin + end) / 2
        if (until - before).sum() > few and begin < middle < end:
            at = np.minimum(tokens_before(weights, middle), sizes)
            k = i + int(np.searchsorted(places[i:j], (at * many).sum()))
            spans += [(begin, middle, before, at, i, k), (middle, end, at, until, k, j)]
            continue
        n = until - before
        kind = np.repeat(np.arange(len(n)), n)
        when = (before[kind] + np.arange(len(kind)) - (np.cumsum(n) - n)[kind] + 0.5) / weights[kind]
        order = np.lexsort((kind, when))
        kind, when = kind[order], when[order]
        ends = (before * many).sum() + np.cumsum(many[kind])
        at = np.searchsorted(ends, places[i:j], "right")
        due[i:j], queue[i:j] = when[at], first[kind[at]] + places[i:j] - (ends[at] - many[kind[at]])
    return due, queue


def in_order(due: np.ndarray, queue: np.ndarray) -> np.ndarray:
    """Numbers that compare like (due, queue): numpy compares complex ones by their real part, then the other."""
    out = np.empty(np.broadcast(due, queue).shape, np.complex128)
    out.real, out.imag = due, queue
    return out


class Schedule:
    """Where each token of each queue goes. Built from the sizes and weights of the queues that are served in turn, and the borders of windows, if there are others.

    ``period`` windows are worked out at a time.
    """

    def __init__(self, sizes, shares, window: int = WINDOW * SEQUENCE, period: int = PERIOD, found: tuple[np.ndarray, np.ndarray] | None = None):
        self.sizes, self.weights, self.window, self.period = np.array(sizes, np.int64), np.array(shares, float), window, period
        zero = ~(self.weights > 0)
        if zero.any():
            self.weights[zero] = least_weight((self.sizes[~zero] / self.weights[~zero]).max(initial=0.0))
        self.queues = np.arange(len(self.sizes))
        if found is None:
            found = borders(self.weights, self.sizes, np.ones_like(self.sizes), np.arange(window, int(self.sizes.sum()), window))
        self.borders = in_order(*found)

    def window_of(self, queue, weight, k) -> np.ndarray:
        """The window of token ``k`` of each queue."""
        return np.searchsorted(self.borders, in_order((k + 0.5) / weight, queue), "right")

    def before(self, queue, weight, window) -> np.ndarray:
        """How many tokens of each queue, if it never runs dry, go before a window."""
        if not len(self.borders):
            return np.zeros(np.broadcast(queue, window).shape, np.int64)
        border = self.borders[np.clip(window, 1, len(self.borders)) - 1]
        k = tokens_before(weight, border.real)
        k += ((k + 0.5) / weight == border.real) & (queue < border.imag)
        return np.where(window > 0, k, 0)

    def cut(self, queue, weight, at, n) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start in the queue, length, window) of each stretch within one window of ``n`` tokens from ``at`` on: arrays of a row per document."""
        first, last = self.window_of(queue, weight, at), self.window_of(queue, weight, at + n - 1)
        spans = last - first + 1
        thin = spans > n  # less than a token a window: token by token, not window by window
        row = np.repeat(np.arange(len(at)), np.where(thin, n, spans))
        i = np.arange(len(row)) - np.searchsorted(row, row)
        start, window, some = at[row] + i, first[row] + i, thin[row]
        window[some] = self.window_of(queue[row[some]], weight[row[some]], start[some])
        later = ~some & (i > 0)
        start[~some] = at[row[~some]]
        start[later] = self.before(queue[row[later]], weight[row[later]], window[later])
        same = row[1:] == row[:-1]
        keep = ~(some & np.append(False, same & (window[1:] == window[:-1])) | ~some & np.append(same & (start[1:] == start[:-1]), False))
        row, start, window = row[keep], start[keep], window[keep]
        ends = np.append(start[1:], 0)
        new = np.append(row[1:] != row[:-1], True)[: len(row)]
        ends[new] = (at + n)[row[new]]
        return row, start, ends - start, window

    def turns(self, windows: np.ndarray) -> np.ndarray:
        """What the queues that are served in turn have given in each window, before each of them and in all."""
        given = [np.minimum(self.before(self.queues, self.weights, w[:, None]), self.sizes) for w in (windows, windows + 1)]
        given[1][windows >= len(self.borders)] = self.sizes
        return np.cumsum(np.pad(given[1] - given[0], ((0, 0), (1, 0))), 1)

    def begins(self, window: np.ndarray, queue: np.ndarray | None = None) -> np.ndarray:
        """The place in the whole stream at which each queue, or what comes after them all, begins in a window."""
        distinct, which = np.unique(window, return_inverse=True)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(0, len(distinct) + self.period, self.period))
        out = window * self.window
        for k, at in enumerate(range(0, len(distinct), self.period)):
            rows = order[edges[k] : edges[k + 1]]
            out[rows] += self.turns(distinct[at : at + self.period])[which[rows] - at, len(self.sizes) if queue is None else queue[rows]]
        return out

    def places(self, queue, weight, start, window) -> np.ndarray:
        """The place in the whole stream of each stretch of the queues that are served in turn."""
        return self.begins(window, queue) + start - self.before(queue, weight, window)

    def pieces(self, queue: int, start: int, n: int):
        """(start in the document, length, place in the whole stream) of each stretch of a document within one window."""
        if n:
            row, at, length, window = self.cut(np.array([queue]), self.weights[[queue]], np.array([start]), np.array([n]))
            place = self.places(queue + 0 * row, self.weights[queue + 0 * row], at, window)
            yield from zip((at - start).tolist(), length.tolist(), place.tolist())


def window_borders(spark, weights: np.ndarray, sizes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``borders`` of all windows, a few thousand a task."""
    size = WINDOW * SEQUENCE
    n = -(-int((sizes * many).sum()) // size)
    classes = spark.sparkContext.broadcast((weights, sizes, many))

    def run(batches):
        for batch in batches:
            window = batch.column(0).to_numpy()
            due, queue = borders(*classes.value, window * size)
            yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(due), pa.array(queue)], names=["window", "due", "queue"])

    found = spark.range(1, max(n, 1), 1, -(-n // 4096) or 1).mapInArrow(run, "window long, due double, queue long").toArrow().sort_by("window")  # a row per window
    return found["due"].to_numpy(), found["queue"].to_numpy()


def tokens_of(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, one after the other, and how many each has."""
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]].tobytes(), dtype), np.diff(bounds) // dtype.itemsize


def pieces_of(rows: list[pa.Array], row, start, length, place, tokens: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Stretches cut where sequences end: ``rows`` are ids, sizes and sources of documents, ``tokens`` the ids of all stretches, one after the other."""
    offset = place % SEQUENCE
    n = (offset + length - 1) // SEQUENCE + 1
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    begin = np.maximum(i * SEQUENCE - offset[of], 0)
    take = np.minimum((i + 1) * SEQUENCE - offset[of], length[of]) - begin
    ends = np.append(0, np.cumsum(take))
    raw, at = memoryview(tokens.astype("<u4")).cast("B"), (4 * ends).tolist()
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
    index, place = pa.array(row[of]), place[of] + begin
    columns = [rows[0].take(index), pa.array(start[of] + begin), pa.array(take), pa.array(crc, pa.int64()), rows[1].take(index), pa.array(place // SEQUENCE), pa.array(place % SEQUENCE), rows[2].take(index)]
    if len(names) > len(columns):
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.astype(np.int64))))
    return pa.RecordBatch.from_arrays(columns, names=names)


def by_span(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(span, stretches): for each SPAN windows, their rows as one Arrow stream, since single rows of a few tokens cost far more to sort and to send."""
    t = pa.Table.from_batches(held)
    span = t["window"].to_numpy() // SPAN
    order = np.argsort(span, kind="stable")
    t, span = t.take(order).combine_chunks(), span[order]
    edges, out = np.flatnonzero(np.append(True, span[1:] != span[:-1])), []
    for begin, end in zip(edges, np.append(edges[1:], len(span))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(t.slice(begin, end - begin))
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(span[edges]), pa.array(out, pa.binary())], names=["span", "stretches"])


def pack_documents(docs: DataFrame, vocabulary: str, chunks: str = "spaced", end_id: int = 0, weights: dict[str, float] | DataFrame | None = None, max_queues: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and ``token_ids`` if asked for.

    ``weights`` may be a table (source, weight) too, with one row a source. The
    driver holds the sources' distinct pairs of weight and size, not the sources.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def tokenised(batches):
        enc = encoder(vocabulary, chunks)
        end, shard, before = np.array([end_id], enc.dtype).tobytes(), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in slices(batch, 2):
                data = [x + end for x in enc.encode_all(part.column(2))]
                sizes, starts = [len(x) // enc.dtype.itemsize for x in data], []
                for s, n in zip(part.column(1).to_pylist(), sizes):
                    starts.append(before.get(s, 0))
                    before[s] = starts[-1] + n
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(data), pa.int32()), part.column(0), part.column(1), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["shard", "id", "source", "local", "n", "ids"])

    ids = written(rows.mapInArrow(tokenised, f"shard int, id {kind}, source string, local long, n long, ids binary"), "packing-ids")
    runs = ids.groupBy("shard", "source").agg(F.sum("n").alias("n"))
    totals = runs.groupBy("source").agg(F.sum("n").alias("n"))
    if isinstance(weights, DataFrame) or weights:
        given = weights if isinstance(weights, DataFrame) else spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
        totals = totals.join(given.select("source", F.nanvl(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")), "source", "left")
        last = totals.where("weight > 0").agg(F.max(F.col("n") / F.col("weight"))).head()[0]
        totals = totals.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(least_weight(last))))
    else:
        totals = totals.withColumn("weight", F.col("n").cast("double"))
    queues = numbered(totals, [], [F.desc("weight"), F.desc("n"), F.asc("source")], "queue")
    classes = queues.groupBy("weight", "n").agg(F.count("*").alias("many")).orderBy(F.desc("weight"), F.desc("n")).toArrow()  # a row per weight and size
    classes = [classes[c].to_numpy() for c in ("weight", "n", "many")]
    own = queues.where(F.col("queue") < max_queues).orderBy("queue").select("n", "weight").toArrow()  # at most max_queues rows
    schedule = spark.sparkContext.broadcast(Schedule(own["n"].to_numpy(), own["weight"].to_numpy(), found=window_borders(spark, *classes)))
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # a row per shard and source; written, so that Spark knows its size when it chooses how to join it
    base = written(runs.join(queues.drop("n"), "source").select("shard", "source", "queue", "weight", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "packing-base")
    width = encoder(vocabulary, chunks).dtype
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", *["token_ids"] * with_ids]

    def stretches(batches):
        """Documents' columns, and the stretches they are cut into."""
        for batch in batches:
            for part in slices(batch, 6, STRETCH_BYTES):
                col = dict(zip(part.schema.names, part.columns))
                local, base, n, queue, weight = (col[c].to_numpy() for c in ("local", "base", "n", "queue", "weight"))
                row, start, length, window = schedule.value.cut(queue, weight, base + local, n)
                yield col, row, start, start - (base + local)[row], length, window, queue[row], weight[row], tokens_of(col["ids"], width)[0]

    def in_turn(batches):
        for col, row, at, start, length, window, queue, weight, tokens in stretches(batches):
            yield pieces_of([col["id"], col["n"], col["source"]], row, start, length, schedule.value.places(queue, weight, at, window), tokens, names)

    def others(batches):
        held, size = [], 0
        for col, row, at, start, length, window, queue, weight, tokens in stretches(batches):
            ends = np.append(0, np.cumsum(length)) * width.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(tokens)])
            doc = [col[c].take(pa.array(row)) for c in ("id", "n", "source")]
            held.append(pa.RecordBatch.from_arrays([*doc, *map(pa.array, (window, (at + length - 0.5) / weight, queue, start)), data], names=["id", "n", "source", "window", "due", "queue", "start", "ids"]))
            size += held[-1].nbytes
            if size > HELD_BYTES:
                yield by_span(held)
                held, size = [], 0
        if held:
            yield by_span(held)

    def after_those(batches):
        spans = ((span, data.as_buffer()) for batch in batches for span, data in zip(batch.column(0).to_pylist(), batch.column(1)))
        for _, some in groupby(spans, lambda x: x[0]):
            t = pa.concat_tables([pa.ipc.open_stream(data).read_all() for _, data in some])
            t = t.take(np.lexsort([t[c].to_numpy() for c in ("queue", "due", "window")]))
            last, used = -1, 0
            for part in (x for batch in t.combine_chunks().to_batches() for x in slices(batch, 7, STRETCH_BYTES)):
                window, start = part.column(3).to_numpy(), part.column(6).to_numpy()
                tokens, length = tokens_of(part.column(7), width)
                begins = np.append(window[0] != last, window[1:] != window[:-1])
                done = np.cumsum(length) - length
                done -= np.maximum.accumulate(np.where(begins, done, -used))
                last, used = window[-1], int(done[-1] + length[-1])
                yield pieces_of(part.columns[:3], np.arange(len(done)), start, length, schedule.value.begins(window) + done, tokens, names)

    joined = ids.join(base, ["shard", "source"]).select("id", "source", "local", "n", "base", "queue", "ids", "weight")
    out = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", token_ids array<long>" * with_ids
    packed = joined.where(F.col("queue") < max_queues).mapInArrow(in_turn, out)
    if classes[2].sum() <= max_queues:
        return packed
    cut = joined.where(F.col("queue") >= max_queues).mapInArrow(others, "span long, stretches binary")
    return packed.unionByName(cut.repartition("span").sortWithinPartitions("span").mapInArrow(after_those, out))


def op4_mixture_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("source")


def packing_mixture(spark, sf_dir: str) -> DataFrame:
    """(window, source, n_tokens): what every window of sequences has of each source, packed with weights: the third, sixth, ... source by name counts three times."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    names = numbered(docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct(), [], [F.asc("source")], "i")
    weights = names.select("source", F.when(F.col("i") % 3 == 2, 3.0).otherwise(1.0).alias("weight"))
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), weights=weights, with_ids=False)
    return packed.groupBy(F.expr(f"sequence_id div {WINDOW}").alias("window"), "source").agg(F.sum("length").alias("n_tokens"))
