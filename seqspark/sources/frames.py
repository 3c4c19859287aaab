"""Frame tables: adapters that give any sequence table the shape (sequence_id, idx, values...), and the reading of sensor files."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, sequence: str, *order: str, name: str = "idx") -> DataFrame:
    """Number the rows of each sequence from 0, in the given order."""
    w = Window.partitionBy(sequence).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


class Tables:
    """The tables of one folder, and the frame views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def fe(self) -> DataFrame:
        """Events as frames of one channel ``v``; ``g`` is the same with gaps."""
        df = ordered(self.table("events"), "user_id", "ts", "event_id")
        return df.select(F.col("user_id").alias("sequence_id"), "idx", F.col("value").alias("v"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("g"), F.col("event_type").alias("phase"), "event_id", "ts")

    @cached_property
    def fv(self) -> DataFrame:
        """Line items as frames of a three-axis vector and a unit quaternion."""
        df = ordered(self.table("lineitem"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
        parts = {"w": F.col("l_quantity") / 50, "x": F.col("l_extendedprice") / 100000, "y": F.col("l_discount") * 10, "z": F.col("l_tax") * 10}
        norm = F.sqrt(sum(c * c for c in parts.values()))
        return df.select(
            F.col("l_suppkey").alias("sequence_id"), "idx", F.col("l_quantity").alias("ax"), (F.col("l_discount") * 100).alias("ay"), (F.col("l_tax") * 100).alias("az"),
            *((c / norm).alias(f"q{k}") for k, c in parts.items()), "l_orderkey", "l_returnflag",
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Embeddings as 8x8 grids of five sensors and ten frames a sequence; negative numbers have no echo (null)."""
        e = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pixel", "x"))
        return e.select(
            F.expr("vec_id div 50").alias("sequence_id"), F.expr("(vec_id div 5) % 10").alias("idx"), (F.col("vec_id") % 5 + 1).alias("sensor"), F.col("pixel").cast("long").alias("pixel"),
            F.when(F.col("x") >= 0, F.col("x").cast("double") * 254).alias("d"),
        )

    @cached_property
    def proba(self) -> DataFrame:
        """Class probabilities of three models (softmax of ten numbers each) and the true class."""
        e = self.table("embeddings")

        def softmax(at: int):
            part = F.transform(F.slice("embedding", at + 1, 10), lambda x: F.exp(x.cast("double")))
            return F.transform(part, lambda x: x / F.aggregate(part, F.lit(0.0), lambda a, b: a + b))

        return e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("y"), softmax(0).alias("p"), softmax(10).alias("p2"), softmax(20).alias("p3"))


#: The same views as DuckDB common table expressions.
VIEWS = {
    "fe": "fe AS (SELECT user_id AS sequence_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS v, CASE WHEN event_id % 7 <> 0 THEN value END AS g, event_type AS phase, event_id, ts FROM events)",
    "fv": """fv0 AS (SELECT l_suppkey AS sequence_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS idx,
  l_quantity AS ax, l_discount * 100 AS ay, l_tax * 100 AS az, l_quantity / 50 AS w, l_extendedprice / 100000 AS x, l_discount * 10 AS y, l_tax * 10 AS z, l_orderkey, l_returnflag FROM lineitem),
fv AS (SELECT sequence_id, idx, ax, ay, az, w / n AS qw, x / n AS qx, y / n AS qy, z / n AS qz, l_orderkey, l_returnflag FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM fv0))""",
    "grid": """gr0 AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pixel FROM embeddings),
grid AS (SELECT vec_id // 50 AS sequence_id, (vec_id // 5) % 10 AS idx, vec_id % 5 + 1 AS sensor, pixel, CASE WHEN x >= 0 THEN x::DOUBLE * 254 END AS d FROM gr0)""",
    "proba": """pr0 AS (SELECT vec_id AS row_id, label::BIGINT AS y, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS a, list_transform(embedding[11:20], lambda x: exp(x::DOUBLE)) AS b, list_transform(embedding[21:30], lambda x: exp(x::DOUBLE)) AS c FROM embeddings),
proba AS (SELECT row_id, y, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS p2, list_transform(c, lambda x: x / list_sum(c)) AS p3 FROM pr0)""",
}


def read_frames(spark: SparkSession, path: str, schema, columns: list[str] | None = None) -> DataFrame:
    """A sensor CSV with a header, read with a fixed schema and pruned to ``columns``."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV, without reading its rows."""
    return spark.read.option("header", True).csv(path).columns


def common_columns(*tables: DataFrame) -> list[str]:
    """Columns that all tables have, in the order of the first."""
    rest = [set(t.columns) for t in tables[1:]]
    return [c for c in tables[0].columns if all(c in r for r in rest)]
