"""Stateful processors over frames: state that expires, and sequences that end by a mark or by silence.

Both keep their state in RocksDB (``use_rocksdb``), so it may outgrow memory, and
hold a few numbers a sequence, never its frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of queries that start from now on is kept in RocksDB."""
    spark.conf.set(PROVIDER, ROCKSDB)


class RunningFeatures(StatefulProcessor):
    """Count, mean, variance, ends and line length of each sequence; what has had no frame for ``ttl_ms`` is forgotten."""

    COLUMNS = "sequence_id long, n long, mean double, var double, low double, high double, last double, line_length double"
    STATE = "n long, mean double, m2 double, low double, high double, last double, line_length double"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", self.STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2, low, high, last, length = self.known.get() if self.known.exists() else (0, 0.0, 0.0, float("inf"), float("-inf"), None, 0.0)
        v = pd.concat(list(rows)).dropna(subset=["v"]).sort_values("idx")["v"].to_numpy(float)
        if k := len(v):
            mu = float(v.mean())
            m2 += float(((v - mu) ** 2).sum()) + (mu - mean) ** 2 * n * k / (n + k)
            mean += (mu - mean) * k / (n + k)
            steps = pd.Series(v if last is None else [last, *v]).diff().abs().sum()
            n, low, high, last, length = n + k, min(low, float(v.min())), max(high, float(v.max())), float(v[-1]), length + float(steps)
        self.known.update((n, mean, m2, low, high, last, length))
        yield pd.DataFrame([(key[0], n, mean, m2 / n if n else 0.0, low, high, last, length)], columns=[c.split()[0] for c in self.COLUMNS.split(", ")])

    def close(self) -> None:
        pass


def running_features(frames: DataFrame, ttl_ms: int) -> DataFrame:
    """A row per sequence and micro-batch with what is known so far.

    ``frames``: sequence_id, idx, v; those of one sequence come in order from batch
    to batch. A sequence without frames for ``ttl_ms`` of processing time begins anew.
    """
    return frames.select("sequence_id", "idx", "v").groupBy("sequence_id").transformWithStateInPandas(RunningFeatures(ttl_ms), RunningFeatures.COLUMNS, "Update", "ProcessingTime")


class Completion(StatefulProcessor):
    """One row for each sequence once it has ended: with its last frame, or when none has come for ``gap_ms`` of event time.

    A key may have several sequences open, where frames behind a silence come
    before the watermark has passed it; each has a timer.
    """

    COLUMNS = "sequence_id long, n long, n_behind long, first_ms long, last_ms long, complete boolean"
    STATE = "n long, n_behind long, first_ms long, last_ms long, complete boolean"

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", self.STATE)

    def _end(self, sequence: tuple) -> int:
        """When it is over: once the watermark is there, frames before the end are all in, or late."""
        return sequence[3] + (1 if sequence[4] else self.gap_ms)

    def _put(self, sequences: list[tuple]) -> None:
        self.open.put(sequences) if sequences else self.open.clear()
        due = {self._end(s) for s in sequences}
        there = set(self.handle.listTimers())
        for t in there - due:
            self.handle.deleteTimer(t)
        for t in due - there:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows))
        now = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        newest = {s[2]: s[3] for s in now}  # before this batch
        for t, last in sorted(zip(x["ms"].astype("int64").tolist(), x["last"].eq(True).tolist())):
            near = [s for s in now if s[2] - self.gap_ms < t < s[3] + self.gap_ms]
            behind = int(any(t < newest.get(s[2], t) for s in near))
            now = [s for s in now if s not in near]
            now.append((1 + sum(s[0] for s in near), behind + sum(s[1] for s in near), min([t, *(s[2] for s in near)]), max([t, *(s[3] for s in near)]), last or any(s[4] for s in near)))
            if behind:
                newest[now[-1][2]] = max(newest[s[2]] for s in near if s[2] in newest)
        self._put(now)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), [tuple(s) for s in self.open.get()]
        over = [s for s in now if self._end(s) <= at]
        self._put([s for s in now if s not in over])
        if over:
            yield pd.DataFrame([(key[0], *s) for s in over], columns=[c.split()[0] for c in self.COLUMNS.split(", ")])

    def close(self) -> None:
        pass


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def completed(frames: DataFrame, gap: str, late: str, ts: str = "ts") -> DataFrame:
    """(sequence_id, n, n_behind, first_ms, last_ms, complete) of sequences that have ended: ``complete`` by a frame marked ``last``, else by a silence of ``gap``.

    ``frames``: sequence_id, ``ts``, last (boolean, null where unknown). On a stream
    a timer in event time ends a sequence, so its row comes once; frames later than
    ``late`` behind the newest of all are dropped by the watermark and counted
    (``late_rows``). ``n_behind`` are frames that came in a later batch than a later
    one of their sequence. No frame follows one that is marked last. On a table,
    silences cut a sequence as they would on a stream without late frames.
    """
    timed = frames.select("sequence_id", F.col(ts).cast("timestamp").alias("_ts"), "last")
    if frames.isStreaming:
        rows = timed.withWatermark("_ts", late).withColumn("ms", _ms(F.col("_ts")))
        gap_ms = frames.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {gap}) AS x").head()["x"]
        return rows.groupBy("sequence_id").transformWithStateInPandas(Completion(gap_ms), Completion.COLUMNS, "Append", "EventTime")
    ended = timed.groupBy("sequence_id", F.session_window("_ts", gap)).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_behind"), _ms(F.min("_ts")).alias("first_ms"), _ms(F.max("_ts")).alias("last_ms"), F.coalesce(F.bool_or("last"), F.lit(False)).alias("complete"))
    return ended.drop("session_window")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped in the batches that ``query`` still reports on."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last batch."""
    return sum(s.numRowsTotal for s in query.lastProgress.stateOperators) if query.lastProgress else 0
