"""The queries against brute force over the smallest tables, and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seqspark.llm import decontam, huffman, katz, langid, near_dup, packing, pii, quality_rules, registry
from seqspark.llm.shared import table
from seqspark.llm.tokens import Encoder

Q = registry.queries()


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def rows(df):
    return df.toPandas()


def test_rules_match_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(quality_rules.OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = rows(Q["op8_quality_rules"](spark, sf)).sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)
    want = con.execute(quality_rules.ABLATION_SQL).df().sort_values("rule").reset_index(drop=True)
    got = rows(Q["rules_ablation"](spark, sf)).sort_values("rule").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)


def _detect(t):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base(spark, sf, docs):
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("ab1290.@+- (%_\n5") for _ in range(r.randint(0, 60)))
        assert pii.detect(t) == _detect(t)
    got = rows(Q["op2_pii"](spark, sf)).set_index("doc_id")
    for d in docs.itertuples():
        found = _detect(d.text or "")
        assert got.base_sha256[d.doc_id] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(got.spans[d.doc_id].split(","))


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("see john [at] example [dot] com", "email", "john [at] example [dot] com"),
        ("to jоhn@example.com", "email", "jоhn@example.com"),
        ("to ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus four nine one seven two three four five six seven eight now", "phone", "plus four nine one seven two three four five six seven eight"),
        ("ip one nine two dot one six eight dot one dot nine", "ip", "one nine two dot one six eight dot one dot nine"),
        ("at 192[.]168[.]1[.]7", "ip", "192[.]168[.]1[.]7"),
        ("look at example.com ok", None, None),
        ("meet at noon dot matrix", None, None),
    ],
)
def test_pii_disguises(text, kind, span):
    added = [(k, text[a:b]) for k, a, b, new in pii.spans(text) if new]
    assert added == ([(kind, span)] if kind else [])


@pytest.mark.parametrize(("name", "chunks"), [("word_bpe_49k.json", "apart"), ("byte_bpe_50k.json", "spaced")])
def test_chunks_give_the_ids_of_whole_texts(name, chunks, docs):
    r = random.Random(3)
    texts = [*docs.text.fillna("").head(60), *("".join(r.choice("ab Zé\n.,\t  '’sS1٣%\x1c\x85\xa0́Σςİ\x0b<|endoftext|>ﬁ你") for _ in range(r.randint(0, 40))) for _ in range(4000))]
    whole = Tokenizer.from_file(P.path(name))
    texts += [f"{x[:20]}<|endoftext|>{x[20:]}" for x in texts[:300]]
    enc = Encoder(P.path(name), chunks)
    for x, want, got in zip(texts, whole.encode_batch(texts, add_special_tokens=False), enc.encode_all(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == want.ids, repr(x)


def test_huffman(spark, sf, docs):
    c = (np.random.default_rng(0).pareto(0.7, 500) * 3).astype(np.int64) + 1
    lengths = huffman.code_lengths(c, 12)
    assert lengths.max() <= 12 and abs((2.0 ** -lengths).sum() - 1) < 1e-12
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [[*x.ids, 1] for x in t.encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False)]
    got = rows(Q["op3_huffman_tokens"](spark, sf)).sort_values("doc_id")
    assert got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.start.tolist() == (np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_packing(spark, sf, docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {k: np.array([*x.ids, 0], "<u4") for k, x in zip(docs.doc_id, t.encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False))}
    got = rows(Q["op4_mixture_packing"](spark, sf))
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert (got.groupby("sequence_id").length.sum().iloc[:-1] == 1024).all() and got.length.sum() == sum(map(len, ids.values()))


def test_windows_follow_the_mixture():
    s = packing.Schedule([40_000, 20_000, 20_000], [2.0, 1.0, 1.0], window=1000, period=8)
    taken = np.zeros((80, 3))
    for q, n in enumerate((40_000, 20_000, 20_000)):
        for _, k, place in s.pieces(q, 0, n):
            taken[place // 1000, q] += k
    assert abs(taken - [500, 250, 250]).max() <= 1


@pytest.mark.parametrize("weighted", [False, True])
def test_sources_that_share_a_queue_keep_their_targets(spark, weighted):
    made = [(s * 1000 + k, f"s{s:02}", "some words " * 20) for s in range(12) for k in range(30 * (1 + s % 3) if s else 5)]
    weights = {f"s{s:02}": float(1 + s % 3) if s else 9.0 for s in range(12)} if weighted else None
    docs = spark.createDataFrame(made, "doc_id long, source string, text string")
    got = rows(packing.pack_documents(docs, P.path("byte_bpe_50k.json"), weights=weights, max_queues=3, with_ids=False))
    n = got.groupby("source").length.sum()
    size = got.doc_tokens.max()
    assert got.length.sum() == size * len(made)
    got["at"] = got.sequence_id * packing.SEQUENCE + got.offset
    if weighted:
        first = got[got.source == "s00"]
        assert first["at"].min() < got[got.source == "s03"]["at"].min()
    mine = weights or n.to_dict()
    shared = sorted(n.index, key=lambda s: (-mine[s], -n[s], s))[3:]
    part = got[got.source.isin(shared)].sort_values("at")
    half = part[part.length.cumsum() <= part.length.sum() // 2].groupby("source").length.sum()
    for s in shared:
        assert abs(half.get(s, 0) - n[s] / 2) <= 2 * size


def test_language_id(spark, sf, docs):
    got = rows(Q["op5_language_id"](spark, sf)).merge(docs[["doc_id", "lang"]])
    held = got[got.held_out]
    assert len(got) == len(docs) and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_all_segmentations_are_summed():
    vocab = langid.pieces(P.path("piece_bpe_32k.model"))
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(vocab.size), 2))
    t = langid.Probabilities(vocab, logp)

    def total(w, k, i=0):
        if i == len(w):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(w) + 1):
            if (piece := vocab.id.get(w[i:j])) is not None:
                out += math.exp(logp[k, piece]) * total(w, k, j)
            elif j == i + 1:
                out += math.exp(sum(logp[k, vocab.byte[b]] for b in w[i:j].encode())) * total(w, k, j)
        return out

    for w in ("the", "straße", "ኩab", "languages"):
        assert np.allclose(langid.word_log_probabilities([w], t)[0], [math.log(total("▁" + w, k)) for k in range(2)])


def test_katz(spark, sf, docs):
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for t in docs.text]
    train = [zlib.crc32(str(k).encode()) % 10 != 0 for k in docs.doc_id]
    one, two = Counter(), Counter()
    for x, on in zip(words, train):
        if on:
            one.update(x)
            two.update(zip([" ", *x[:-1]], x))
    n, cut = sum(one.values()), katz.CUT
    d1, d2 = (katz.discounts(katz._stats(np.array(list(c.values())))) for c in (one, two))
    kept_of = lambda d, r: (d[r] if r <= cut else 1.0) * r
    low = {v for (v, _), r in two.items() if r <= cut}
    kept2 = lambda v, r: kept_of(d2, r) - (0 if v in low else 0.5)
    unknown = 1 - sum(kept_of(d1, c) / n for c in one.values())
    p1 = lambda w: kept_of(d1, one[w]) / n if w in one else unknown
    c = {**one, " ": sum(train)}
    del c["\n"]
    kept, mass = Counter(), Counter()
    for (v, w), r in two.items():
        kept[v] += kept2(v, r) / c[v]
        mass[v] += p1(w)

    def p2(v, w):
        if r := two.get((v, w)):
            return kept2(v, r) / c[v]
        return (1 - kept[v]) / (1 - mass[v]) * p1(w) if v in c else p1(w)

    for v in [" ", *list(c)[:3]]:  # all next words and the unknown one: probability 1
        assert abs(sum(p2(v, w) for w in one) + p2(v, "never seen") - 1) < 1e-9
    got = rows(Q["op6_katz_backoff"](spark, sf)).set_index("doc_id")
    for k, x in zip(docs.doc_id, words):
        r = got.loc[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(w in one for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1))) for w in x), rel_tol=1e-9)
        assert math.isclose(r.score_2, sum(math.log10(p2(v, w)) for v, w in zip([" ", *x[:-1]], x)), rel_tol=1e-9)


@pytest.mark.parametrize("order", [3, 4])
def test_katz_of_higher_orders(spark, sf, docs, order):
    """Every score by recursion over plain counts; the probabilities of all next words and the unknown one sum to 1 after contexts of every length."""
    docs = docs if order == 3 else docs.head(60)
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for t in docs.text]
    train = [zlib.crc32(str(k).encode()) % 10 != 0 for k in docs.doc_id]
    n = [Counter() for _ in range(order)]
    marks = [" "] * (order - 1)
    for x, on in zip(words, train):
        if on:
            y = [*marks, *x]
            for k in range(order):
                n[k].update(zip(*(y[order - 1 - j : len(y) - j] for j in range(k, -1, -1))))
    total, cut = sum(n[0].values()), katz.CUT
    d = [katz.discounts(katz._stats(np.array(list(c.values())))) for c in n]
    kept_of = lambda k, r: (d[k][r] if r <= cut else 1.0) * r
    unknown = 1 - sum(kept_of(0, c) / total for c in n[0].values())
    low = [{g[:-1] for g, r in c.items() if r <= cut} for c in n]
    after, kept, mass = ([Counter() for _ in range(order)] for _ in range(3))

    def p(g):
        k = len(g) - 1
        if k == 0:
            return kept_of(0, n[0][g]) / total if g in n[0] else unknown
        v = g[:-1]
        if g in n[k]:
            return (kept_of(k, n[k][g]) - (0 if v in low[k] else 0.5)) / after[k][v]
        return (1 - kept[k][v]) / (1 - mass[k][v]) * p(g[1:]) if after[k][v] else p(g[1:])

    for k in range(1, order):
        for g, r in n[k].items():
            after[k][g[:-1]] += r
        for g in n[k]:
            kept[k][g[:-1]] += p(g)
            mass[k][g[:-1]] += p(g[1:])
    for k in range(1, order):
        contexts = list(after[k])
        for v in [tuple(marks[:k]), *contexts[:: max(1, len(contexts) // 4)]]:
            assert abs(sum(p((*v, w)) for (w,) in n[0]) + p((*v, "never seen")) - 1) < 1e-9
    if order == 3:
        got = rows(Q["op6_katz_backoff"](spark, sf)).set_index("doc_id").score
    else:
        made = spark.createDataFrame([(int(k), t, on) for k, t, on in zip(docs.doc_id, docs.text, train)], "doc_id long, text string, train boolean")
        got = katz.score_texts(made, "train", order=order).toPandas().set_index("doc_id").score
    for k, x in zip(docs.doc_id, words):
        y = [*marks, *x]
        assert math.isclose(got.loc[k], sum(math.log10(p(tuple(y[i : i + order]))) for i in range(len(x))), rel_tol=1e-6)


def test_html(spark, sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id")
    got = rows(Q["op7_html_extraction"](spark, sf))
    assert len(got) == len(pages)
    import html

    for r in got.itertuples():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages.html[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def _classes(texts):
    bags, parent = [near_dup.shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(bags)):
        for j in range(i):
            if near_dup.similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, sf, docs):
    got = rows(Q["op9_near_duplicates"](spark, sf)).set_index("doc_id").class_id
    ids = docs.doc_id.tolist()
    assert [got[k] for k in ids] == [ids[c] for c in _classes(docs.text.tolist())]


def test_bagminhash_estimates_weighted_jaccard():
    r = np.random.default_rng(0)
    base = np.sort(r.integers(0, 2**63, 300).astype(np.uint64)), r.integers(1, 12, 300)
    for share in (0.1, 0.3, 0.6):
        others = []
        for _ in range(20):
            n = base[1].copy()
            hit = r.random(300) < share
            n[hit] = r.integers(1, 12, hit.sum())
            others.append((base[0], n))
        sig = near_dup.signatures([base, *others], 400)
        want = np.mean([near_dup.similarity((*base, 1), (*o, 1)) for o in others])
        assert abs((sig[1:] == sig[0]).mean() - want) < 0.03


def test_classifier(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = rows(Q["op10_quality_classifier"](spark, sf)).merge(pd.read_parquet(f"{sf}/labels.parquet"))
    held = got[got.held_out]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9


def _leaks(bench, text):
    ids = bench.ids(text)[0].tolist()
    out = set()
    for at in range(decontam.passages(len(ids))):
        window = ids[at * decontam.STRIDE : at * decontam.STRIDE + decontam.WINDOW]
        for k, (key, p, answer) in enumerate(bench.pieces):
            share = decontam.common_subsequence(bench.masks[k], len(p), window) / len(p)
            if share >= decontam.LCS or (share >= decontam.LCS_WITH_ANSWER and decontam.common_subsequence(bench.answer_masks[k], len(answer), window) >= 0.8 * len(answer)):
                chance = sum(decontam.common_subsequence(bench.masks[k], len(p), [window[i] for i in order if i < len(window)]) for order in decontam._DRAWN) / 4 / len(p)
                if share >= chance + min(0.2, (1 - chance) / 2) - 1e-9:
                    out.add(key)
    return out


@pytest.fixture(scope="module")
def bench(sf):
    b = pd.read_parquet(f"{sf}/benchmark.parquet")
    return decontam.Benchmark(list(zip(b.item_id, b.text)))


def test_decontamination(spark, sf, docs, bench):
    got = rows(Q["op1_decontamination"](spark, sf))
    assert set(zip(got.doc_id, got.item_id)) == {(d.doc_id, k) for d in docs.itertuples() for k in _leaks(bench, d.text)}


def test_paraphrases_are_found(spark, sf, docs):
    b = pd.read_parquet(f"{sf}/benchmark.parquet").head(20)
    r = random.Random(5)
    made = []
    for i, t in zip(b.item_id, b.text):
        words = [w for w in decontam.words_of(t) if r.random() > 0.12]
        for _ in range(len(words) // 10):
            words.insert(r.randrange(len(words)), "indeed")
        made.append((int(i), f"{docs.text[int(i) * 3][:300]} {' '.join(words)} {docs.text[int(i) * 5 + 1][:300]}"))
    found = decontam.find_leaks(spark.createDataFrame(made, "doc_id long, text string"), table(spark, sf, "benchmark")).toPandas()
    assert len(set(zip(found.doc_id, found.item_id)) & {(int(i), int(i)) for i in b.item_id}) >= 18


def test_items_of_common_words_are_found(spark):
    r = random.Random(8)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(4000)]
    text = lambda n: [r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(n)]
    leaked, plain, other = [f"leak{i}" for i in range(20)], r.sample(common, 20), text(20)
    made, want = [], set()
    for k in range(300):
        words = text(100)
        for key, item, on in ((1, leaked, k % 10 < 3), (2, plain, k % 50 == 7), (3, other, k % 100 == 4)):
            if on:
                at = r.randrange(len(words))
                words[at:at] = item
                want.add((k, key))
        made.append((k, " ".join(words)))
    items = spark.createDataFrame([(1, " ".join(leaked)), (2, " ".join(plain)), (3, " ".join(other))], "item_id long, text string")
    got = decontam.find_leaks(spark.createDataFrame(made, "doc_id long, text string"), items).toPandas()
    found = set(zip(got.doc_id, got.item_id))
    assert {x for x in want if x[1] == 1} <= found and {x for x in want if x[1] == 2} <= found and sum(x[1] == 1 for x in found) == 90


@pytest.mark.parametrize("share", [0.01, 0.5, 0.9, 0.99])
def test_paraphrases_of_common_leaks_are_found(spark, sf, docs, share):
    """One rule whatever share of the documents has the item; half of the copies are paraphrases."""
    b = pd.read_parquet(f"{sf}/benchmark.parquet")
    item = min(b.itertuples(), key=lambda x: len(x.text.split()))
    r = random.Random(int(share * 100))
    made, want = [], set()
    for k in range(300):
        words = decontam.words_of(docs.text[k % len(docs)] or "")[:400]
        if k % 100 < share * 100:
            said = decontam.words_of(item.text)
            if k % 2:
                said = [w for w in said if r.random() > 0.12]
                for _ in range(len(said) // 10):
                    said.insert(r.randrange(len(said)), "indeed")
            at = r.randrange(len(words) + 1)
            words[at:at] = said
            want.add(k)
        made.append((k, " ".join(words)))
    got = decontam.find_leaks(spark.createDataFrame(made, "doc_id long, text string"), table(spark, sf, "benchmark")).toPandas()
    found = set(got.doc_id[got.item_id == item.item_id])
    print("recall", share, len(found & want) / len(want))
    assert len(found & want) >= 0.9 * len(want)
    assert {k for k in want if k % 2 == 0} <= found  # verbatim
    assert len(found - want) <= len({k for k in range(300) if "indeed" not in made[k][1]}) * 0.05


def test_candidates_come_from_the_latent_space(spark, sf, monkeypatch):
    """With directions in which passages and items have nothing, there are no candidates."""
    docs_ = table(spark, sf, "documents").where("doc_id < 100")
    assert decontam.find_leaks(docs_, table(spark, sf, "benchmark")).count()
    monkeypatch.setattr(decontam, "latent_basis", lambda rows, idf, items, dims, n, top: np.zeros((dims, decontam.RANK), np.float32))
    assert decontam.find_leaks(docs_, table(spark, sf, "benchmark")).count() == 0


def test_quotes_of_long_items_are_found(spark):
    item = [f"w{i}" for i in range(160)]
    quotes = [(n, at) for n in (50, 64, 77, 90) for at in range(0, 161 - n)]
    made = [(k, " ".join([f"f{i}" for i in range(k % 97)] + item[at : at + n] + [f"g{i}" for i in range(60)])) for k, (n, at) in enumerate(quotes)]
    got = decontam.find_leaks(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(len(made)))


def test_pipeline(spark, sf, docs, bench):
    kept = docs[[not (m[0] < 50 or 100 * m[4] > 50 * m[0] or 10 * m[2] > m[0] or 10 * m[3] > 3 * m[5] or m[1] < 2 * m[0] or m[1] > 20 * m[0] or 2 * m[6] > m[1] or 10 * m[7] < 6 * m[0]) for m in map(quality_rules.measure, docs.text)]].reset_index(drop=True)
    first = [i == c for i, c in enumerate(_classes(kept.text.tolist()))]
    kept = kept[first]
    kept = kept[[not _leaks(bench, t) for t in kept.text]]
    texts = {k: pii.masked(t) for k, t in zip(kept.doc_id, kept.text)}
    enc = Encoder(P.path("byte_bpe_50k.json"), "spaced")
    want = {k: len(x) // 2 + 1 for k, x in zip(texts, enc.encode_all(list(texts.values())))}
    got = rows(corpus_pipeline.run(spark, sf))
    assert got.groupby("doc_id").length.sum().to_dict() == want and dict(zip(got.doc_id, got.doc_tokens)) == want
