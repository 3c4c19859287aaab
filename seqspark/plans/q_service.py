"""Queries: serving (S14, D01), state and completion (X02), versioned models (X04), reused features (X05), table functions (D05)."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seqspark.functions import scoring as Z
from seqspark.functions import tables as T
from seqspark.functions.store import FeatureStore
from seqspark.operators import stats as S
from seqspark.plans.q_clean import shared_folder
from seqspark.plans.registry import query
from seqspark.sources import sequences as Q
from seqspark.streaming import sinks as K
from seqspark.streaming import stateful as W

_CLASSES = ("low", "mid", "high")
_WEIGHTS = {"1": ((-0.2, 0.3, 0.1), (0.1, -0.1, 0.05), (0.15, 0.1, -0.02)), "2": ((0.3, -0.2, -0.05), (-0.1, 0.25, 0.02), (0.05, 0.05, 0.01))}


def _linear_sql(version: str, rows: str) -> str:
    scores = ", ".join(f"a * {w[0]} + b * {w[1]} + c * {w[2]} AS {k}" for k, w in zip(_CLASSES, _WEIGHTS[version]))
    return f"SELECT sequence_id, CASE WHEN low >= mid AND low >= high THEN 'low' WHEN mid >= high THEN 'mid' ELSE 'high' END AS predicted FROM (SELECT sequence_id, {scores} FROM {rows}) AS s"


def _linear(payload: bytes):
    """A linear model from its stored weights."""
    weights = np.array(pickle.loads(payload)).T
    return lambda x: pd.Series([_CLASSES[k] for k in (x[["a", "b", "c"]].to_numpy() @ weights).argmax(1)])


def _features(frames):
    return S.summarise(frames, {"a": F.avg("v"), "b": F.stddev_pop("v"), "c": F.max("v")})


_FEATURES = "f AS (SELECT sequence_id, avg(v) AS a, stddev_pop(v) AS b, max(v) AS c FROM fe GROUP BY 1)"


@query("x04_versioned_model", "sequence_id predicted version", "", f"WITH {_FEATURES} SELECT *, 1 AS version FROM ({_linear_sql('1', 'f')}) AS x UNION ALL SELECT *, 2 FROM ({_linear_sql('2', 'f')}) AS y")
def _(t):
    """A model, then another in its place: workers tell them by content."""
    rows, out = _features(t.fe), None
    for version, weights in _WEIGHTS.items():
        part = Z.score_with(rows, Z.Model(_linear, pickle.dumps(weights))).withColumn("version", F.lit(int(version)))
        out = part if out is None else out.union(part)
    return out


@query("d01_scoring_callback", "sequence_id predicted", "", f"WITH {_FEATURES} {_linear_sql('1', 'f')}")
def _(t):
    """Sequences are delivered, streamed whole, scored by the user's callback, and each batch is taken once."""
    path = f"{shared_folder(t)}/serving-{uuid.uuid4().hex}"
    frames = t.fe.select("sequence_id", "idx", "v")
    for k in range(2):
        Q.write_sequences(frames.where(F.col("sequence_id") % 2 == k), f"{path}/in", "sequence_id", "idx")
    ledger, model = K.Ledger(t.spark, f"{path}/out"), Z.Model(_linear, pickle.dumps(_WEIGHTS["1"]))
    started = K.score_stream(Q.sequences(t.spark, f"{path}/in", stream=True), lambda rows: Z.score_with(_features(rows), model), ledger, f"{path}/checkpoint").start()
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    return ledger.read(f"sequence_id {frames.schema['sequence_id'].dataType.simpleString()}, predicted string")


@query("s14_sequence_source", "sequence_id n whole", "total", "SELECT sequence_id, count(*) AS n, true AS whole, sum(v) AS total FROM fe GROUP BY 1", digits=3)
def _(t):
    """Delivered frames read back, a sequence in one partition each."""
    path = f"{shared_folder(t)}/sequences-{uuid.uuid4().hex}"
    Q.write_sequences(t.fe.select("sequence_id", "idx", "v"), path, "sequence_id", "idx")
    read = Q.sequences(t.spark, path).withColumn("part", F.spark_partition_id())
    return read.groupBy("sequence_id").agg(F.count("*").alias("n"), (F.min("part") == F.max("part")).alias("whole"), F.sum("v").alias("total"))


@query(
    "x02_completed_sequences", "sequence_id n first_ms last_ms complete", "",
    "WITH g AS (SELECT sequence_id, ts, epoch_us(ts) // 1000 AS ms, idx, event_id >= 5000 AS last, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY sequence_id ORDER BY ts, idx) < 172800000000 THEN 0 ELSE 1 END AS new FROM fe), s AS (SELECT *, sum(new) OVER (PARTITION BY sequence_id ORDER BY ts, idx ROWS UNBOUNDED PRECEDING) AS part FROM g) "
    "SELECT sequence_id, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, bool_or(last) AS complete FROM s GROUP BY sequence_id, part",
)
def _(t):
    """Sequences as silences of two days and marked last frames end them."""
    return W.completed(t.fe.select("sequence_id", "ts", (F.col("event_id") >= 5000).alias("last")), "2 days", "1 hour")


@query("x05_feature_reuse", "sequence_id n reused", "mean", "WITH c AS (SELECT sequence_id, v + CASE WHEN idx = 0 AND sequence_id % 10 = 0 THEN 1 ELSE 0 END AS v FROM fe) SELECT sequence_id, count(*) AS n, (sequence_id % 2 = 0 AND sequence_id % 10 <> 0) AS reused, avg(v) AS mean FROM c GROUP BY 1")
def _(t):
    """Half of the sequences are in the store; then one frame of a tenth of all changes, and all are asked for."""
    compute = lambda frames: S.summarise(frames, {"n": F.count("*"), "mean": F.avg("v")})
    rows = t.fe.select("sequence_id", "idx", "v")
    kind = rows.schema["sequence_id"].dataType.simpleString()
    store = FeatureStore(t.spark, f"{shared_folder(t)}/features-{uuid.uuid4().hex}", f"sequence_id {kind}, n long, mean double")
    store.features(rows.where("sequence_id % 2 = 0"), compute)
    changed = rows.withColumn("v", F.col("v") + F.when((F.col("idx") == 0) & (F.col("sequence_id") % 10 == 0), 1).otherwise(0))
    return store.features(changed, compute)


@query("d05_table_function", "sequence_id segment n", "mean", "WITH s AS (SELECT *, unnest(range(greatest(0, (idx - 10) // 10), idx // 10 + 1)) AS segment FROM fe) SELECT sequence_id, segment, count(*) AS n, avg(v) AS mean FROM s WHERE idx BETWEEN segment * 10 AND segment * 10 + 19 GROUP BY 1, 2")
def _(t):
    """Sliding windows through a table function that partitions and orders its table by itself."""
    T.register(t.spark)
    view = f"frames_{uuid.uuid4().hex}"
    t.fe.select("sequence_id", "idx", "v").createOrReplaceTempView(view)
    return t.spark.sql(f"SELECT * FROM sliding_windows(TABLE({view}), 'sequence_id', 'idx', 'v', 20, 10)")
