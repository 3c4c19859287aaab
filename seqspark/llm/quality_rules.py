"""Rule bitmask ledger: measure every rule once, keep failure bits, decide by versioned policies.

``rule_ledger`` reads each text once and writes one row per document: the
measurements and ``fail_bits``, in which bit i is set where rule i fails.
``apply_policy`` and ``ablation`` never look at texts again; they work on the
bits alone, so a new policy or an ablation costs one scan of integers.

Defined cases: a null text has no words; empty texts fail the word-count rule;
ratios over zero words or lines are 0; repeated rows each get a row; extra
input columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha_words")

#: Rule name -> condition of failure over the measurements. A rule's place is its bit: append, never reorder.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_trigrams": "100 * n_repeat_words > 50 * n_words",
    "symbol_ratio": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "few_alphabetic_words": "10 * n_alpha_words < 6 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document is rejected if any of them fails."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_trigrams"))
DEFAULT = Policy("default", 1, tuple(RULES))

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_ASCII_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    at = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array(list(map(at.__getitem__, words)), np.int64)
    repeated = 0
    if 3 < n != len(at):
        pair = np.unique(ids[:-1] * len(at) + ids[1:], return_inverse=True)[1]
        _, kind, count = np.unique(pair[:-1] * len(at) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[kind] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    upper = sum(text.count(c) for c in set(text) if category(c) == "Lu")
    lettered = np.array([w[0] in _ASCII_LETTERS or any(map(str.isalpha, w.decode("utf-8", "surrogatepass"))) for w in at], bool)
    return n, chars, sum(text.count(c) for c in _SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), upper, int(lettered[ids].sum())


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the measurements (long) and ``fail_bits`` (long)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def measured(batches):
        for batch in batches:
            found = np.array([measure(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=[id_col, *MEASURES])

    out = rows.mapInArrow(measured, f"`{id_col}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"CASE WHEN {cond} THEN {BIT[name]}L ELSE 0L END" for name, cond in RULES.items())
    return out.withColumn("fail_bits", F.expr(bits))


def apply_policy(ledger: DataFrame, policy: Policy, out_col: str = "kept") -> DataFrame:
    """Add the verdict of ``policy``: true where none of its rules failed."""
    return ledger.withColumn(out_col, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For every rule of ``policy``: documents failing it, failing nothing else, and kept if it were left out."""
    seen = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    by_bits = ledger.groupBy(seen.alias("bits")).agg(F.count("*").alias("n"))  # at most 2^rules rows
    sums = [
        F.struct(
            F.lit(r).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(BIT[r])) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == BIT[r], F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(policy.mask & ~BIT[r])) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
        for r in policy.rules
    ]
    return by_bits.agg(F.explode(F.array(*sums)).alias("x")).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "x.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from seqspark.llm.shared import table

    ledger = rule_ledger(table(spark, sf_dir, "documents"))
    judged = apply_policy(apply_policy(ledger, BASE, "base_ok"), DEFAULT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "fail_bits")


def rules_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of the default policy does over all documents, from the ledger alone."""
    from seqspark.llm.shared import table

    return ablation(rule_ledger(table(spark, sf_dir, "documents")), DEFAULT)


#: DuckDB SQL for the whole query, over the same rules.
OP8_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM x),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g),
cov AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_alpha_words FROM w LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM (SELECT *, ("""
    + " + ".join(f"CASE WHEN {cond} THEN {BIT[name]} ELSE 0 END" for name, cond in RULES.items())
    + ")::BIGINT AS fail_bits FROM m)"
)

ABLATION_SQL = f"WITH o AS ({OP8_SQL}), b AS (SELECT fail_bits & {DEFAULT.mask} AS bits FROM o) " + " UNION ALL ".join(
    f"SELECT '{DEFAULT.name}' AS policy, {DEFAULT.version} AS version, '{r}' AS rule, count(*) FILTER (bits & {BIT[r]} <> 0) AS n_failed, count(*) FILTER (bits = {BIT[r]}) AS n_failed_alone, count(*) FILTER (bits & {DEFAULT.mask & ~BIT[r]} = 0) AS n_kept_without FROM b" for r in DEFAULT.rules
)
