"""Numbers of rows within groups, without a task that holds a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from seqspark.sources.shared import written


def _free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as keep it apart from the columns of ``df``."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def numbered(df: DataFrame, by: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the column ``name``: 0, 1, 2... within the groups ``by``, in the order given.

    Rows are dealt by ranges of (group, order), so a group of any size lies in as
    many partitions as it needs, and a task numbers what it has. Only a
    partition's first group may have begun before it; the rows before it are
    known from one count a partition. Rows that are equal in group and order are
    dealt by their place in the input, so they are spread as well.

    Nulls are a group of their own and come first in an order. The result is
    read from a table in the shared folder.
    """
    group, tie, part, carried = _free(df, "_group", "_tie", "_part", "_carried")
    keys = [*by, *order, F.col(tie)]
    dealt = df.withColumns({group: F.xxhash64(*by) if by else F.lit(0).cast("long"), tie: F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(*(F.asc(k) if isinstance(k, str) else k for k in keys)).sortWithinPartitions(*keys).drop(tie)
    schema = StructType([*dealt.schema.fields]).add(name, LongType()).add(part, LongType()).add(carried, BooleanType())
    at = dealt.columns.index(group)

    def count(batches):
        here, last, n, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(at).to_numpy(zero_copy_only=False)
            place = np.arange(len(key))
            begins = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            since = np.maximum.accumulate(np.where(begins, place, -1))
            rank = np.where(since < 0, place + n, place - since)
            if last is None:
                begins[0] = False  # the first group of the partition
            inside = first & (np.cumsum(begins) == 0)
            first, last, n = bool(inside[-1]), key[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank), pa.array(np.full(len(key), here)), pa.array(inside)], names=schema.names)

    placed = written(dealt.mapInArrow(count, schema), "numbered")
    spark = df.sparkSession
    # one row for each partition, and for each that holds the beginning of a group which others go on with
    head = {r[part]: (r["g"], r["n"]) for r in placed.where(F.col(carried)).groupBy(part).agg(F.first(group).alias("g"), F.count("*").alias("n")).collect()}
    went_on = spark.createDataFrame([(g,) for g in {g for g, _ in head.values()}], f"{group} long")
    begun = placed.where(~F.col(carried)).join(F.broadcast(went_on), group, "left_semi").groupBy(part, group).agg(F.count("*").alias("n"))
    seen = {r[group]: (r[part], r["n"]) for r in begun.collect()}
    before, total = [], {}
    for p in sorted(head):
        g, n = head[p]
        if g not in total:
            total[g] = seen[g][1] if g in seen and seen[g][0] < p else 0
        before.append((p, total[g]))
        total[g] += n
    offsets = spark.createDataFrame(before, f"{part} long, _before long")
    out = placed.join(F.broadcast(offsets), part, "left")
    rank = F.col(name) + F.when(F.col(carried), F.coalesce(F.col("_before"), F.lit(0))).otherwise(F.lit(0))
    return out.withColumn(name, rank).select(*(F.col(f"`{c}`") for c in df.columns), name)
