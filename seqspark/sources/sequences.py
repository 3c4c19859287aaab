"""A data source of whole sequences: files that no sequence is split over, read in partitions and as a stream with offsets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MANIFEST = "sequences.json"


def write_sequences(df: DataFrame, path: str, key: str = "sequence_id", *order: str, files: int | None = None) -> None:
    """Append ``df`` to ``path`` as files that hold whole sequences of this call, in order.

    One write is one delivery: its files are named after it, and a manifest with
    the next number, made by one rename, lists them.
    """
    spark = df.sparkSession
    dealt = df.repartition(files, key) if files else df.repartition(key)
    folder = f"delivery-{uuid.uuid4().hex}"
    dealt.sortWithinPartitions(key, *order).write.parquet(f"{path}/{folder}")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(jvm.Path(f"{path}/{folder}")) if x.getPath().getName().endswith(".parquet"))
    text = json.dumps({"schema": df.schema.json(), "key": key, "files": [f"{folder}/{n}" for n in names]})
    draft = jvm.Path(f"{path}/_draft-{folder}")
    out = fs.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    number = sum(x.getPath().getName().endswith(MANIFEST) for x in fs.listStatus(jvm.Path(path)))
    while not fs.rename(draft, jvm.Path(f"{path}/{number:08d}-{MANIFEST}")):  # another delivery took this number
        number += 1


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _manifests(path: str) -> list[dict]:
    from pyarrow import fs

    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return [json.loads(store.open_input_stream(x.path).read()) for x in sorted(found, key=lambda x: x.path) if x.base_name.endswith(MANIFEST)]


class _File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def _read(path: str, file: _File, schema: StructType) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    store, root = _open(path)
    with store.open_input_file(f"{root}/{file.name}") as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=8192, columns=schema.names):
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in schema.names], names=schema.names)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        return [_File(f) for m in _manifests(self.path) for f in m["files"]]

    def read(self, partition):
        return _read(self.path, partition, self.schema)


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of deliveries, so a batch holds whole ones, and a restart goes on behind the last that was committed."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"deliveries": 0}

    def latestOffset(self) -> dict:
        return {"deliveries": len(_manifests(self.path))}

    def partitions(self, start: dict, end: dict):
        return [_File(f) for m in _manifests(self.path)[start["deliveries"] : end["deliveries"]] for f in m["files"]]

    def commit(self, end: dict) -> None:
        pass  # what has been delivered stays

    def read(self, partition):
        return _read(self.path, partition, self.schema)


class SequenceSource(DataSource):
    """``spark.read.format("sequences").load(path)``, or ``readStream``: a batch is what has been delivered since the last."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> StructType:
        found = _manifests(self.options["path"])
        if not found:
            raise ValueError(f"no sequences have been delivered to {self.options['path']}")
        return StructType.fromJson(json.loads(found[0]["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], schema)


def sequences(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Whole sequences that ``write_sequences`` has delivered, as a table or as a stream."""
    spark.dataSource.register(SequenceSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("sequences").load(path)


def split_sequences(df: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Sequences whose rows lie in more than one partition of ``df``; none, if the source keeps them whole."""
    return df.select(key, F.spark_partition_id().alias("_p")).distinct().groupBy(key).count().where("count > 1")
