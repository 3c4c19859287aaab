"""Scoring of sequences: model bundles on shared storage, batch scoring in one job, and models of the user's own."""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import ensemble as E

class Cache:
    """The last ``size`` things made in this process, by a key that tells their content."""

    def __init__(self, size: int):
        self.size, self.held = size, OrderedDict()

    def get(self, key, make: Callable[[], object]) -> object:
        if key not in self.held:
            self.held[key] = make()
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return self.held[key]


_BUNDLES, _MODELS = Cache(4), Cache(4)


def held(version: str, make: Callable[[], object]) -> object:
    """A model of this process. (By name: a function of the user's closure would carry a cache of its own to every task.)"""
    return _MODELS.get(version, make)


class Model:
    """A model of the user's own, told by its content: ``load`` makes it from ``payload`` in a worker, once for each content.

    ``load`` takes the payload, or nothing where there is none, and returns a
    function of a pandas frame that gives a prediction a row. A payload goes to the
    executors as a broadcast variable and may have ``LIMIT`` bytes; a larger model
    belongs in shared storage under a name of its own version, which is then the payload.
    """

    LIMIT = 512 << 20

    def __init__(self, load: Callable, payload: bytes | None = None):
        if payload is not None and len(payload) > self.LIMIT:
            raise ValueError(f"a payload of {len(payload)} bytes; {self.LIMIT} may be broadcast")
        self.load, self.payload = load, payload
        self.version = hashlib.sha256(cloudpickle.dumps(load) + (payload or b"")).hexdigest()

    def sent(self, spark: SparkSession) -> Callable[[], Callable]:
        """What a worker calls to get the model."""
        load, version = self.load, self.version
        if self.payload is None:
            return lambda: held(version, load)
        shared = spark.sparkContext.broadcast(self.payload)
        return lambda: held(version, lambda: load(shared.value))


@dataclass
class Bundle:
    """Models of the folds, the features they take in order, their weights, and the name of every class."""

    models: list[PipelineModel]
    features: list[str]
    weights: list[float]
    classes: list[str]

    @classmethod
    def of(cls, models: list, features: list[str], scores: list[float], classes: list[str]) -> Bundle:
        """Weights are the folds' scores, divided by their sum."""
        total = max(sum(scores), 1e-12)
        return cls(list(models), list(features), [s / total for s in scores], list(classes))


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> str:
    """Write a new version to ``path`` and make it the current one, by the last write; returns its name. Older versions stay."""
    version = uuid.uuid4().hex
    for k, model in enumerate(bundle.models):
        model.write().save(f"{path}/models-{version}/{k}")
    row = [(version, len(bundle.models), bundle.features, [float(w) for w in bundle.weights], bundle.classes)]
    spark.createDataFrame(row, "version string, n_models int, features array<string>, weights array<double>, classes array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/bundle")
    return version


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """The current bundle under ``path``. Which that is, is read each time; its models are read once in this process."""
    r = spark.read.parquet(f"{path}/bundle").head()
    made = lambda: Bundle([PipelineModel.load(f"{path}/models-{r['version']}/{k}") for k in range(r["n_models"])], list(r["features"]), list(r["weights"]), list(r["classes"]))
    return _BUNDLES.get((path, r["version"]), made)


def score(df: DataFrame, bundle: Bundle, key: str = "sequence_id") -> DataFrame:
    """(key, class, name, p) of every row in one job: features are aligned (missing ones are 0), the models' probabilities averaged by weight."""
    keyed = _aligned(df, bundle.features, key)
    for k, model in enumerate(bundle.models):
        done = model.transform(keyed)
        keyed = done.select(*keyed.columns, vector_to_array("probability").alias(f"_p{k}"))
    p = E.blend([F.col(f"_p{k}") for k in range(len(bundle.models))], bundle.weights)
    out = keyed.withColumn("p", p).withColumn("class", E.argmax(F.col("p")))
    names = F.array(*(F.lit(c) for c in bundle.classes))
    return out.select(key, "class", F.get(names, F.col("class").cast("int")).alias("name"), "p")


def _aligned(df: DataFrame, features: list[str], key: str) -> DataFrame:
    return df.select(key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in df.columns else F.lit(0.0).alias(f) for f in features))


def score_with(df: DataFrame, model: Model | Callable, key: str = "sequence_id", kind: str = "string") -> DataFrame:
    """(key, predicted) by a ``Model``, or by what makes one, from the other columns; the scoring callback of a batch or a stream."""
    features = [c for c in df.columns if c != key]
    get = (model if isinstance(model, Model) else Model(model)).sent(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get()
        for x in frames:
            yield pd.DataFrame({key: x[key], "predicted": model(x[features])})

    return df.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, predicted {kind}")
