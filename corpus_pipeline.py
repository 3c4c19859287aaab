"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes and reads again as the next stage's documents. All but the last return
the columns of documents.

Defined cases: a null or empty text fails the quality rules and goes; null ids,
languages and sources are kept as they are; rows that share a doc_id are judged
one by one, and of rows that are equal in every column one stays; of the texts
of a class of near-duplicates that with the smallest id stays (a row without an
id comes before all others); extra columns are carried along, whatever
their names; empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import decontam, near_dup, packing, pii, quality_rules
from seqspark.llm.shared import table, written


def _keyed(docs: DataFrame) -> tuple[str, DataFrame]:
    """Documents with a new column, an id of its own for every row, so rows that share a doc_id are judged one by one; and its name."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return name, docs.select(F.struct(F.col("doc_id"), F.xxhash64("doc_id", "text", *rest).alias("row")).alias(name), "*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy of the rule ledger keeps."""
    columns = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in columns if c != "text"))
    ledger = quality_rules.rule_ledger(docs.select(F.struct(whole.alias("rest"), F.col("text")).alias("row"), "text"), "row")
    kept = quality_rules.apply_policy(ledger, quality_rules.DEFAULT).where("kept")
    return kept.select(*(F.col("row.text") if c == "text" else F.col(f"row.rest.`{c}`") for c in columns))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id; of rows with this id, one."""
    key, keyed = _keyed(docs)
    classes = near_dup.near_duplicates(keyed, key)
    kept = classes.where(F.col(key).eqNullSafe(F.col("class_id"))).select(key).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    key, keyed = _keyed(docs)
    leaks = decontam.find_leaks(keyed, table(spark, sf_dir, "benchmark"), key)
    return keyed.join(leaks.select(key).distinct(), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, mixed by source."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("packing", packed),
]

#: Four of the five stages have no SQL form; tests/llm/test_brute.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
