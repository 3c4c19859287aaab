"""Streams that stop and go on, state that expires, sinks that take a batch once, models and features told by content."""

import pickle
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seqspark.functions import scoring as Z
from seqspark.functions import tables as T
from seqspark.functions.store import FeatureStore, fingerprint
from seqspark.operators import joins as J
from seqspark.operators import stats as S
from seqspark.sources import sequences as Q
from seqspark.streaming import sinks as K
from seqspark.streaming import stateful as W


@pytest.fixture(autouse=True)
def rocksdb(spark):
    W.use_rocksdb(spark)


FRAMES = "sequence_id long, idx long, v double, s long, last boolean, ts timestamp"


def put(folder, rows, k):
    kinds = pa.schema([("sequence_id", pa.int64()), ("idx", pa.int64()), ("v", pa.float64()), ("s", pa.int64()), ("last", pa.bool_()), ("ts", pa.timestamp("us", "UTC"))])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, (*r, r[3] * 1_000_000))) for r in rows], kinds), f"{folder}/{k:03}.parquet")


def test_a_sequence_ends_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [
        [(1, 100, None), (2, 100, None), (3, 100, None)],
        [(1, 130, None), (1, 120, None), (3, 104, True)],
        [(2, 104, None), (4, 140, None)],
        [(2, 50, None), (1, 60, False), (4, 160, None)],  # late
        [(1, 300, None), (4, 301, None)],
        [(5, 600, True)],
    ]
    for k, b in enumerate(batches):
        put(folder, [(q, 0, 0.0, s, last) for q, s, last in b], k)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = []
    q = W.completed(stream, "40 seconds", "30 seconds").writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # sequence 3 by its mark; 1, 2 and 4 by silence; what has come after that is a sequence of its own
    assert sorted(got) == [(1, 1, 0, 300_000, 300_000, False), (1, 3, 0, 100_000, 130_000, False), (2, 2, 0, 100_000, 104_000, False), (3, 2, 0, 100_000, 104_000, True), (4, 1, 0, 301_000, 301_000, False), (4, 2, 0, 140_000, 160_000, False)]
    assert W.late_rows(q) == 2
    rows = [(q_, s, bool(last)) for k, b in enumerate(batches) for q_, s, last in b if (q_, s) not in ((2, 50), (1, 60))]
    table = spark.createDataFrame(rows, "sequence_id long, s long, last boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(x for x in map(tuple, W.completed(table, "40 seconds", "30 seconds").collect()) if x[0] != 5) == sorted(got)


def test_running_features_expire(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, [(q, i, float(i * i), 0, None) for q in range(6) for i in range(4)], 0)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = []

    def step():
        q = W.running_features(stream, 5_000).writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        assert q.awaitTermination(60)
        return W.state_rows(q)

    first = step()
    put(folder, [(0, 4, 16.0, 0, None)], 1)
    step()
    known = [r for r in got if r["sequence_id"] == 0][-1]
    assert known["n"] == 5 and known["mean"] == 6.0 and known["var"] == pytest.approx(34.8) and (known["low"], known["high"], known["last"], known["line_length"]) == (0.0, 16.0, 16.0, 16.0)
    time.sleep(6)
    for k in (2, 3):
        put(folder, [(9, k, 1.0, 0, None)], k)
        last = step()
    assert first >= 6 and last < first  # sequences 0 to 5 have gone
    put(folder, [(0, 5, 2.0, 0, None)], 4)
    step()
    assert [r["n"] for r in got if r["sequence_id"] == 0][-1] == 1  # forgotten, so it begins anew


def test_whole_sequences_once_over_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/seq"
    frames = spark.range(900).select((F.col("id") % 30).alias("sequence_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("v"))
    seen = []

    def keep(df, batch):
        seen.extend((batch, *r) for r in df.withColumn("part", F.spark_partition_id()).groupBy("sequence_id").agg(F.count("*").alias("n"), F.count_distinct("part")).collect())

    for k in range(3):
        Q.write_sequences(frames.where(F.col("sequence_id") % 3 == k), path, "sequence_id", "idx", files=4)
        q = Q.sequences(spark, path, stream=True).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()  # and started again from the checkpoint
    assert sorted(r[1] for r in seen) == list(range(30)) and {r[2:] for r in seen} == {(30, 1)}
    assert {r[1] % 3 for r in seen if r[0] == 1} == {1}
    table = Q.sequences(spark, path)
    assert table.count() == 900 and Q.split_sequences(table).count() == 0
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, frames.collect()))


def test_a_batch_is_taken_once(spark, tmp_path):
    ledger = K.Ledger(spark, f"file://{tmp_path}/out")
    rows = lambda k: spark.range(k * 10, k * 10 + 10).select("id")
    assert ledger.read("id long").count() == 0
    ledger.write(rows(0), 0)
    rows(1).limit(4).write.parquet(f"file://{tmp_path}/out/rows/batch=1")  # cut off before its entry
    assert sorted(r["id"] for r in ledger.read("id long").collect()) == list(range(10))
    for _ in range(2):  # repeated after the failure, and once more
        ledger.write(rows(1), 1)
    ledger.write(rows(7), 0)  # batch 0 has been taken
    got = ledger.read("id long").collect()
    assert sorted(r["id"] for r in got) == list(range(20)) and {r["batch"] for r in got} == {0, 1}


def test_a_stream_killed_between_write_and_entry(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/seq"
    Q.write_sequences(spark.range(50).select(F.col("id").alias("sequence_id"), F.lit(1.0).alias("v")), path, "sequence_id")
    ledger = K.Ledger(spark, f"file://{tmp_path}/out")
    real, failed = K.Ledger.enter, []

    def enter(self, batch):
        if not failed:
            failed.append(batch)
            raise RuntimeError("killed")
        real(self, batch)

    monkeypatch.setattr(K.Ledger, "enter", enter)
    start = lambda: K.score_stream(Q.sequences(spark, path, stream=True), lambda df: df.select("sequence_id"), ledger, str(tmp_path / "c")).start()
    with pytest.raises(Exception, match="killed"):
        start().processAllAvailable()
    assert ledger.read("sequence_id long").count() == 0
    q = start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["sequence_id"] for r in ledger.read("sequence_id long").collect()) == list(range(50)) and failed


def test_a_new_model_under_an_old_name(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("sequence_id"), F.lit(2.0).alias("a"))

    def load(payload):
        k = pickle.loads(payload)
        return lambda x: (x["a"] * k).astype(str)

    for k in (3, 4, 3):
        assert {r["predicted"] for r in Z.score_with(rows, Z.Model(load, pickle.dumps(k))).collect()} == {str(2.0 * k)}
    with pytest.raises(ValueError, match="broadcast"):
        Z.Model(load, bytes(Z.Model.LIMIT + 1))
    cache, made = Z.Cache(2), []
    for key in "abacba":
        cache.get(key, lambda key=key: made.append(key) or key)
    assert made == list("abcba"[:3]) + ["b"] + ["a"] and len(cache.held) == 2


def test_an_overwritten_bundle_is_read(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(20)], "sequence_id long, a double, label double")
    fit = lambda df: Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="x"), DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=5)]).fit(df)
    path = str(tmp_path / "b")
    versions = set()
    for names in (["no", "yes"], ["even", "odd"]):
        versions.add(Z.save_bundle(spark, Z.Bundle.of([fit(rows)], ["a"], [1.0], names), path))
        assert {r["name"] for r in Z.score(rows, Z.load_bundle(spark, path)).collect()} <= set(names)
    assert len(versions) == 2 and Z.load_bundle(spark, path) is Z.load_bundle(spark, path)


def test_features_are_computed_once_per_state(spark, tmp_path):
    asked = []

    def compute(frames):
        asked.append(sorted(r[0] for r in frames.select("sequence_id").distinct().collect()))
        return S.summarise(frames, {"n": F.count("*"), "total": F.sum("v")})

    rows = [(q, i, None if i == 3 else float(q + i)) for q in range(5) for i in range(6)]
    schema = "sequence_id long, idx long, v double"
    store = FeatureStore(spark, f"file://{tmp_path}/store", "sequence_id long, n long, total double")
    frames = spark.createDataFrame(rows, schema)
    first = store.features(frames, compute)
    assert {r["reused"] for r in first.collect()} == {False}
    assert {r["reused"] for r in store.features(frames.repartition(7), compute).collect()} == {True}
    changed = spark.createDataFrame([(q, i, 99.0 if (q, i) == (2, 3) else v) for q, i, v in rows] + [(7, 0, 1.0)], schema)
    got = {r["sequence_id"]: r for r in store.features(changed, compute).collect()}
    assert asked == [[0, 1, 2, 3, 4], [], [2, 7]]
    assert {q for q, r in got.items() if not r["reused"]} == {2, 7} and got[2]["total"] == sum(2 + i for i in range(6) if i != 3) + 99
    assert store.read().count() == 7 and store.compacted(changed).count() == 6
    twice = fingerprint(frames.union(frames.where("sequence_id = 1"))).join(fingerprint(frames).withColumnRenamed("fingerprint", "f"), "sequence_id")
    assert {r["sequence_id"] for r in twice.where("fingerprint <> f").collect()} == {1}


def test_sliding_windows_of_any_table(spark):
    T.register(spark)
    rows = [(k, i, None if i == 4 else float(i)) for k, n in (("a", 20), ("b", 7), ("c", 1), (None, 23)) for i in range(n)]
    spark.createDataFrame(rows, "name string, at int, x double").repartition(4).createOrReplaceTempView("odd_names")
    got = sorted((tuple(r) for r in spark.sql("SELECT * FROM sliding_windows(TABLE(odd_names), 'name', 'at', 'x', 5, 2)").collect()), key=lambda r: (r[0] or "", r[1]))
    want = []
    for k in (None, "a", "b", "c"):
        v = [x for n, _, x in rows if n == k]
        for s in range((len(v) + 1) // 2):
            part = v[s * 2 : s * 2 + 5]
            known = [x for x in part if x is not None]
            want.append((k, s, len(part), sum(known) / len(known) if known else None))
    assert got == want
    for bad in ("'name', 'at', 'none', 5, 2", "'name', 'at', 'x', 5, 6"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM sliding_windows(TABLE(odd_names), {bad})").collect()


def test_checked_join_tells_what_is_wrong(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, gesture string")
    said = spark.createDataFrame([(1, "a"), (3, "c"), (3, "d"), (9, "x")], "id long, said string")
    got = {tuple(r) for r in J.checked_join(truth, said, "id", "gesture", "said").collect()}
    assert got == {(1, "a", "a", "matched"), (2, "b", None, "missing"), (3, "c", None, "repeated"), (9, None, "x", "unknown")}
    for a, b in ((truth.drop("gesture"), said), (truth, said.drop("id"))):
        with pytest.raises(ValueError, match="no column"):
            J.checked_join(a, b, "id", "gesture", "said")
