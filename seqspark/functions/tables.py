"""Table functions for SQL: the sliding windows of any table, told by the names of its columns."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class _Windows:
    """``sliding_windows(TABLE(t), key, order, value, size, step)``: (key, segment, n, mean) of rows [segment * step, segment * step + size) of each key, counted from 0 in order.

    The last windows may be short; null values are counted but not averaged. What
    the table function asks of Spark, and the type of the key in its result, follow
    from its arguments. It holds the rows of one window.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument, size: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument has to be a table")
        names = {f.name: f.dataType for f in rows.dataType.fields}
        for c in (key.value, order.value, value.value):
            if c not in names:
                raise ValueError(f"the table has no column {c}")
        if not 0 < step.value <= size.value:
            raise ValueError("a step is 1 row at least, and a window at most")
        schema = StructType().add(key.value, names[key.value]).add("segment", LongType()).add("n", LongType()).add("mean", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def __init__(self):
        self.held: deque = deque()
        self.at = self.begin = 0
        self.key = self.size = self.step = None

    def _window(self):
        part = [v for v in list(self.held)[: self.size] if v is not None]
        out = (self.key, self.begin // self.step, min(len(self.held), self.size), sum(part) / len(part) if part else None)
        for _ in range(min(self.step, len(self.held))):
            self.held.popleft()
        self.begin += self.step
        return out

    def eval(self, row, key, order, value, size, step):
        self.key, self.size, self.step = row[key], size, step
        v = row[value]
        self.held.append(None if v is None else float(v))
        if len(self.held) == size:
            yield self._window()

    def terminate(self):
        while self.held:
            yield self._window()


def register(spark: SparkSession) -> None:
    """Make ``sliding_windows`` known to the session's SQL."""
    spark.udtf.register("sliding_windows", udtf(_Windows))
