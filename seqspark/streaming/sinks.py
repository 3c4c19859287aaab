"""A sink that takes each micro-batch once, whatever is repeated after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


class Ledger:
    """Folder of batches: ``batch=n`` holds the rows of batch n, and ``ledger/n`` says that it is whole.

    A batch is written under its own number, over whatever a failed attempt has
    left there, and then entered. The entry is made by one rename, which is atomic
    on HDFS and local disks; on stores where it is not, it is still the last thing
    to appear. Readers see entered batches alone, so a batch that was cut off, or
    came twice, is there once or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entered(self) -> list[int]:
        fs, folder = _fs(self.spark, f"{self.path}/ledger")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()) if fs.exists(folder) else []

    def enter(self, batch: int) -> None:
        fs, draft = _fs(self.spark, f"{self.path}/drafts/{batch}")
        fs.create(draft, True).close()
        _, entry = _fs(self.spark, f"{self.path}/ledger/{batch}")
        fs.mkdirs(entry.getParent())
        fs.rename(draft, entry)

    def write(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        fs, entry = _fs(self.spark, f"{self.path}/ledger/{batch}")
        if not fs.exists(entry):
            rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
            self.enter(batch)

    def read(self, schema) -> DataFrame:
        """The rows of all batches that are whole, with their ``batch``."""
        found = self.entered()
        if not found:
            return self.spark.createDataFrame([], schema).selectExpr("*", "0L AS batch")
        paths = [f"{self.path}/rows/batch={n}" for n in found]
        return self.spark.read.option("basePath", f"{self.path}/rows").schema(schema).parquet(*paths).withColumn("batch", _batch())


def _batch():
    from pyspark.sql import functions as F

    return F.col("batch").cast("long")


def score_stream(frames: DataFrame, score: Callable[[DataFrame], DataFrame], ledger: Ledger, checkpoint: str):
    """Start scoring a stream of whole sequences: every micro-batch goes through ``score`` into ``ledger``, once."""

    def run(rows: DataFrame, batch: int) -> None:
        ledger.write(score(rows), batch)

    return frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
