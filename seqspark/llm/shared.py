"""Small helpers: the shared working folder, written tables, words, stable hashes."""

from __future__ import annotations

import gc
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.sources.shared import dropped, shared_dir, written  # noqa: F401


def swept(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the exchange files of steps that are over; it goes by what the driver's collector finds unused.

    Twice, since Python's side lets go of a plan only with the next call.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col, mod: int):
    """crc32 of the id as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def least_by_hash(df: DataFrame, id_col: str, n: int, *ties) -> DataFrame:
    """At most ``n`` rows, those whose id has the smallest hash; ``ties`` order rows of one id.

    When there are many more, a cut at twice the share that is wanted leaves few
    rows to sort, so what tasks send to the driver follows ``n``, not the table.
    """
    key = F.xxhash64(id_col)
    total = df.count()
    if total > 4 * n:
        cut = df.where(key < -(1 << 63) + int((1 << 64) * 2 * n / total))
        if cut.count() >= n:  # few distinct ids may leave less; then all rows are sorted
            df = cut
    return df.orderBy(key, id_col, *ties).limit(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A stable 64-bit mixing of unsigned integers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_CLAIMED: dict = {}


def claim(name: str, clear) -> None:
    """A worker keeps one large cache: the others are cleared when a stage first uses its own, since workers outlive stages."""
    if name not in _CLAIMED:
        while _CLAIMED:
            _CLAIMED.popitem()[1]()
        _CLAIMED[name] = clear


class Numbered(dict):
    """Word -> number; a word that is not there yet gets the next number, and is noted in ``new``."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
