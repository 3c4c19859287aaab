"""Token ids in canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints.

Format: ``path/codebook`` has (id, n, length) for every id that occurs; the
code words follow from the lengths (canonical order: length, then id).
``path/blocks`` has one row per block of whole documents: its shard and number,
ids before it in its shard, the ids and lengths of its documents, the bits, and
the bit offset of every CHECKPOINT-th id. Shards are in ascending order of the
document id. A block is decoded without any other, its stretches between
checkpoints side by side by table look-up.

Defined cases: a null text is an empty one; rows with a null id come first;
rows that share an id are ordered by their bytes; extra columns are ignored; an empty
table gives empty files. A block holds whole documents, so one very long text
makes one long block, still with checkpoints.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.llm.shared import shared_dir, table, written
from seqspark.llm.tokens import encoder, slices

BLOCK_IDS = 1 << 18
CHECKPOINT = 512
MAX_BITS = 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of at most ``limit`` bits that minimise the coded size (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1 : len(both) // 2 * 2 : 2]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code words that belong to the lengths."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` (most significant first) and the bit offset of every CHECKPOINT-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros((total >> 6) + 2, np.uint64)
    if len(ids):
        word, room = starts >> 6, 64 - (starts & 63) - size
        code = codes[ids]
        over = room < 0
        first = np.where(over, code >> np.maximum(-room, 0).astype(np.uint64), code << np.maximum(room, 0).astype(np.uint64))
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[heads]] = np.bitwise_or.reduceat(first, heads)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT].copy()


class Decoder:
    """Table-driven decoding: the next MAX_BITS bits give the id and its length."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 1
        full = np.zeros(size, np.int64)
        full[ids] = lengths
        self.bits = max(1, int(full.max()))
        self.symbol, self.length = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        order = np.lexsort((np.arange(size), full))
        order = order[full[order] > 0]
        span = 1 << (self.bits - full[order])
        filled = int(span.sum())
        self.symbol[:filled] = np.repeat(order, span)
        self.length[:filled] = np.repeat(full[order], span)

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(checkpoints), CHECKPOINT), np.uint32)
        raw = np.frombuffer(payload + b"\0" * (CHECKPOINT * 4 + 8), np.uint8).astype(np.uint64)
        window = (raw[:-3] << np.uint64(24)) | (raw[1:-2] << np.uint64(16)) | (raw[2:-1] << np.uint64(8)) | raw[3:]
        window = window.astype(np.uint32)
        at = checkpoints.astype(np.int64)
        last = len(window) - 1
        mask, down = np.uint32((1 << self.bits) - 1), 32 - self.bits
        for step in range(min(CHECKPOINT, n)):
            key = (window[np.minimum(at >> 3, last)] >> (down - (at & 7)).astype(np.uint32)) & mask
            out[:, step] = self.symbol[key]
            at += self.length[key]
        return out.ravel()[:n]


def encoded(docs: DataFrame, vocabulary: str, chunks: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, ids): the token ids of each text and ``end_id``, as little-endian bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary, chunks)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + end for x in enc.encode_all(part.column(1))], pa.binary())], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {kind}, ids binary")


def count_ids(ids: DataFrame, width: np.dtype, size: int) -> DataFrame:
    """(id, n) over all token ids; counted in every task, then summed."""

    def counted(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = b"".join(batch.column(0).slice(at, 1000).to_pylist())
                total += np.bincount(np.frombuffer(part, width), minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["id", "n"])

    return ids.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, chunks: str = "apart", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write them to ``path``. The code book, at most one entry per id of the vocabulary, is made on the driver."""
    spark = docs.sparkSession
    enc = encoder(vocabulary, chunks)
    width, size = enc.dtype, max(enc.size, end_id + 1)
    rows = written(encoded(docs, vocabulary, chunks, end_id, id_col, text_col), "huffman-ids")
    counts = count_ids(rows, width, size).collect()
    total = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    lengths = code_lengths(total)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths).tolist()
    book = spark.createDataFrame([(i, int(total[i]), int(lengths[i])) for i in used], "id int, n long, length int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    kind = rows.schema["id"].dataType.simpleString()

    def coded(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, parts, held, id_type = [], [], [], 0, None

        def flush():
            data, marks = pack(np.frombuffer(b"".join(parts), width).astype(np.int64), codes, lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["shard", "block", "first", "n_ids", "ids", "sizes", "checkpoints", "bits"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                ids.append(key)
                sizes.append(len(data) // width.itemsize)
                parts.append(data)
                held += sizes[-1]
                if held >= BLOCK_IDS:
                    yield flush()
                    block, before = block + 1, before + held
                    ids, sizes, parts, held = [], [], [], 0
        if ids:
            yield flush()

    blocks = rows.repartitionByRange("id").sortWithinPartitions("id", "ids").mapInArrow(
        coded, f"shard int, block int, first long, n_ids long, ids array<{kind}>, sizes array<long>, checkpoints array<long>, bits binary"
    )
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document, decoded from the files: id, start (ids of all documents before it), n_tokens, ids_crc32, and ``token_ids`` if asked for."""
    book = spark.read.parquet(f"{path}/codebook").select("id", "length").collect()
    symbols, lengths = np.array([r["id"] for r in book], np.int64), np.array([r["length"] for r in book], np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def decoded(batches):
        decoder = Decoder(symbols, lengths)
        for batch in batches:
            for r in range(batch.num_rows):
                shard, first, n, sizes = (batch.column(batch.schema.get_field_index(c))[r].as_py() for c in ("shard", "first", "n_ids", "sizes"))
                marks = batch.column(batch.schema.get_field_index("checkpoints"))[r].values.to_numpy()
                ids = decoder.unpack(batch.column(batch.schema.get_field_index("bits"))[r].as_py(), marks, n).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                parts = [ids[a:b] for a, b in zip(starts, ends)]
                columns = [pa.array([shard] * len(sizes), pa.int32()), batch.column(batch.schema.get_field_index("ids"))[r].values, pa.array(first + starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", id_col, "local", "n_tokens", "ids_crc32", "token_ids"][: len(columns)])

    found = blocks.mapInArrow(decoded, f"shard int, `{id_col}` {kind}, local long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids)
    # one row per shard: the shards' sizes in a row
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return found.join(sizes.select("shard", "before"), "shard").select(id_col, (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["token_ids"] * with_ids)


def op3_huffman_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/huffman-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, with_ids=False)
