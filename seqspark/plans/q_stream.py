"""Queries: what the streaming jobs compute, run as batches (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import stats as S
from seqspark.plans.registry import query
from seqspark.streaming import frames as X


@query("x01_sessions", "sequence_id n", "mean max", "WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY sequence_id ORDER BY idx) < 172800 THEN 0 ELSE 1 END AS new FROM fe), s AS (SELECT *, sum(new) OVER (PARTITION BY sequence_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS sess FROM g) SELECT sequence_id, count(*) AS n, avg(v) AS mean, max(v) AS max FROM s GROUP BY sequence_id, sess")
def _(t):
    timed = t.fe.withColumn("_ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("sequence_id", F.session_window("_ts", "2 days")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("max"))


@query("x03_running_features", "sequence_id n", "mean var low high last line_length", "WITH d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY sequence_id ORDER BY idx)) AS st FROM fe) SELECT sequence_id, count(*) AS n, avg(v) AS mean, var_pop(v) AS var, min(v) AS low, max(v) AS high, arg_max(v, idx) AS last, coalesce(sum(st), 0) AS line_length FROM d GROUP BY 1", digits=4)
def _(t):
    steps = S.lagged_steps(t.fe)
    return S.summarise(steps, {"n": F.count("*"), "mean": F.avg("v"), "var": F.var_pop("v"), "low": F.min("v"), "high": F.max("v"), "last": F.max_by("v", "idx"), "line_length": F.coalesce(F.sum(F.abs("step")), F.lit(0.0))})


@query("x06_windows", "start_second phase n", "mean", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start_second, phase, count(*) AS n, avg(v) AS mean FROM fe GROUP BY 1, 2")
def _(t):
    return X.windowed(t.fe)
