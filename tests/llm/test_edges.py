"""Every operator on nulls, empty and long texts, repeated rows, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from seqspark.llm import decontam, gbt, html_blocks, huffman, katz, langid, near_dup, packing, pii, quality_rules

LONG = "lorem ipsum dolor sit amet " * 30_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "de", "b"),
    (5, LONG, "en", "b"),
    (6, "ein kleiner Satz über die Straße und den Fluß mit Wörtern", "de", None),
    (6, "ein kleiner Satz über die Straße und den Fluß mit Wörtern", "de", None),
    (7, "😀 ☃ 12345 !!!", "fr", "a"),
    (None, "the quick brown fox jumps over the lazy dog near the river", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(a, b.encode("utf-16", "surrogatepass").decode("utf-16") if b else b, c, d) for a, b, c, d in ROWS]
    clash = {c: F.lit("x") for c in ("id", "text2", "shard", "n", "key", "rep", "band", "block", "x", "score", "spans", "row", "train_flag", "_text", "start", "words")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.rule_ledger(docs).collect()}
    assert quality_rules.rule_ledger(docs).count() == len(ROWS)
    assert got[2]["n_words"] == got[3]["n_words"] == got[4]["n_words"] == 0
    assert got[5]["n_words"] == 150_000 and got[5]["n_repeat_words"] == 150_000
    assert quality_rules.rule_ledger(none).count() == 0
    policy = quality_rules.DEFAULT
    table = {r["rule"]: r for r in quality_rules.ablation(quality_rules.rule_ledger(docs), policy).collect()}
    assert table["few_words"]["n_failed"] == 8


def test_pii(docs, none):
    assert all(r["spans"] == [] for r in pii.find_pii(docs).collect())
    assert pii.find_pii(none).count() == 0
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs).exceptAll(docs).count() == 0


def test_huffman(spark, docs, none, tmp_path):
    for k, df in enumerate((docs, none)):
        path = f"file://{tmp_path}/h{k}"
        huffman.write_tokens(df, path, P.path("word_bpe_49k.json"))
        rows = huffman.read_tokens(spark, path).orderBy("start").collect()
        assert len(rows) == df.count()
        at = 0
        for r in rows:
            assert r["start"] == at and len(r["token_ids"]) == r["n_tokens"] and r["token_ids"][-1] == 1
            at += r["n_tokens"]
        if rows:
            assert rows[0]["doc_id"] is None and [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
            assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "": 1.0}])
def test_packing(docs, none, weights):
    pieces = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), weights=weights).collect()
    place = {}
    for r in pieces:
        at = r["sequence_id"] * packing.SEQUENCE + r["offset"]
        assert r["offset"] + r["length"] <= packing.SEQUENCE and len(r["token_ids"]) == r["length"]
        for i in range(r["length"]):
            assert at + i not in place
            place[at + i] = 1
    assert sorted(place) == list(range(len(place)))
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json")).count() == 0


def test_language(docs, none):
    vocabulary = P.path("piece_bpe_32k.model")
    model = langid.train(docs, vocabulary, rounds=1)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, vocabulary).collect()}
    assert {got[i]["lang_pred"] for i in (2, 3, 4, 7)} == {"und"} and got[2]["score"] == 0
    assert got[1]["lang_pred"] in ("en", "de") and got[6]["lang_pred"] == "de"
    assert langid.predict(none, model, vocabulary).count() == 0
    empty = langid.train(none, vocabulary)
    assert {r["lang_pred"] for r in langid.predict(docs, empty, vocabulary).collect()} == {"und"}


def test_katz(docs, none):
    rows = katz.score_texts(docs.withColumn("train", F.col("doc_id") != 7), "train").collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["n_tokens"] == 1 and got[5]["n_tokens"] == 150_001 and got[7]["n_known"] == 1
    assert all(r["score"] < 0 for r in rows)
    assert katz.score_texts(none.withColumn("train", F.lit(True)), "train").count() == 0
    assert all(r["score"] is None for r in katz.score_texts(docs.withColumn("train", F.lit(None).cast("boolean")), "train").collect())


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "<p>a &amp; b"), (4, "<div" * 5000), (5, "<body>" + "<p>x y</p>" * 3000)], "page_id long, html string").withColumn("text", F.lit("q"))
    model = html_blocks.train(pages, max_pages=10, copies=1)
    rows = html_blocks.extract(pages, model).collect()
    assert len(rows) == 6 and all(r["text"] == "" for r in rows if r["page_id"] in (1, 2, 4))
    assert html_blocks.extract(pages.where("false"), html_blocks.train(pages.where("false"))).count() == 0


def test_near_duplicates(docs, none):
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    of = {r["doc_id"]: r["class_id"] for r in rows}
    assert of[2] == of[3] == of[4] == 2 and of[1] == of[None] == 1 and of[6] == 6
    assert near_dup.near_duplicates(none).count() == 0


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (6, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    found = gbt.features(docs)
    model = gbt.train(found, labels)
    rows = gbt.score(found, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert gbt.score(gbt.features(none), model).count() == 0
    assert all(r["score"] == 0.5 for r in gbt.score(found, gbt.train(found.where("false"), labels)).collect())


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river"), (2, None), (3, ""), (4, "zzz " * 100)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
    assert got == {(1, 1), (None, 1)}
    assert decontam.find_leaks(none, items).count() == 0 and decontam.find_leaks(docs, items.where("false")).count() == 0
