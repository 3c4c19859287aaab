"""Inverse and brute-force tests of disguises, trees, pieces, schedules and residual near-duplicates."""

import heapq
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqspark.llm import gbt, langid, near_dup, packing, pii

ATS = [" at ", " [at] ", "(at)", " @ ", "[at]", " (at) ", "@"]
DOTS = [" dot ", "[.]", " [dot] ", "(dot)", " (dot) ", "[dot]"]
WORDS = "some words stand around what has been hidden here for now".split()
DIGITS = "zero one two three four five six seven eight nine".split()


def _email(r):
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7)))
    at, dot = r.choice(ATS), r.choice(DOTS)
    local = dot.join(name() for _ in range(r.randint(1, 7)))
    host = dot.join([*(name() for _ in range(r.randint(1, 9))), r.choice(["com", "org", "net", "de", "online"])])
    return f"{local}{at}{host}"


def _ip(r):
    return r.choice(DOTS).join(str(r.randint(0, 255)) for _ in range(4))


def _phone(r):
    return "plus " + " ".join(r.choice(DIGITS) for _ in range(r.randint(9, 15)))


def _folded(r):
    alike = {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у", "i": "і"}
    local = "".join(r.choice("acepxyio") for _ in range(r.randint(3, 8)))
    at = r.randrange(len(local))
    return local[:at] + alike[local[at]] + local[at + 1 :] + "@example" + r.choice([".com", ".org"])


@pytest.mark.parametrize(("kind", "make"), [("email", _email), ("ip", _ip), ("phone", _phone), ("email", _folded)])
def test_disguised_identifiers_are_found_exactly(kind, make):
    r = random.Random(9)
    for _ in range(1500):
        hidden = make(r)
        before, after = (" ".join(r.choice(WORDS) for _ in range(r.randint(1, 5))) for _ in range(2))
        text = f"{before}: {hidden}, {after}"
        assert (kind, len(before) + 2, len(before) + 2 + len(hidden)) in {(k, a, b) for k, a, b, _ in pii.spans(text)}, text


@pytest.mark.parametrize("text", ["a at " * 60_000 + "dot com", "a dot " * 60_000 + "at b dot com", "x at " + "1 dot " * 60_000, "@ " * 100_000, "one " * 100_000, "a@b[.]c " * 50_000])
def test_long_disguises_take_linear_time(text):
    began = time.process_time()
    pii.spans(text)
    assert time.process_time() - began < 10


def test_overlapping_added_spans_are_all_given():
    text = "ann at site dot com and ann@site.com, one nine two dot one six eight dot one dot nine"
    found = pii.spans(text)
    assert found == sorted(found, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2])) and len(set(found)) == len(found)
    assert [(k, text[a:b], new) for k, a, b, new in found][:2] == [("email", "ann at site dot com", True), ("email", "ann@site.com", False)]


def _naive_tree(x, grad, hess, cuts, rows, depth, least, l2, rate):
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-9, None, None)
    if depth:
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left = rows[x[rows, f] <= c]
                right = rows[x[rows, f] > c]
                if len(left) < least or len(right) < least:
                    continue
                part = lambda s: grad[s].sum() ** 2 / (hess[s].sum() + l2)
                gain = part(left) + part(right) - g**2 / (h + l2)
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
    if best[1] is None:
        return {tuple(rows.tolist()): -rate * g / (h + l2)}
    keep = x[rows, best[1]] <= best[2]
    out = _naive_tree(x, grad, hess, cuts, rows[keep], depth - 1, least, l2, rate)
    return out | _naive_tree(x, grad, hess, cuts, rows[~keep], depth - 1, least, l2, rate)


def test_trees_match_exhaustive_search():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(160, 3)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(0, 0.3, 160) > 0).astype(float)
    bins, rate, raw = 255, 0.15, None
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    p = (y.sum() + 1) / (len(y) + 2)
    raw = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(5):
        prob = 1 / (1 + np.exp(-raw))
        for rows, v in _naive_tree(x, prob - y, np.maximum(prob * (1 - prob), 1e-6), cuts, np.arange(len(y)), 3, 5, 1.0, rate).items():
            raw[list(rows)] += v
    model = gbt.fit(x, y, trees=5, depth=3, rate=rate)
    assert np.allclose(model.raw(x, 3), raw)
    # flattened traversal against a walk node by node
    for i in range(0, 160, 16):
        total = model.start
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if x[i, model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        assert math.isclose(total, model.raw(x[i : i + 1], 3)[0])


def _segmentations(w, vocab):
    """All ways to cut a marked word, as tuples of lists of piece ids; letters that are no piece are spelled by bytes."""
    if not w:
        return [()]
    out = []
    for j in range(1, len(w) + 1):
        if w[:j] in vocab.id:
            head = [vocab.id[w[:j]]]
        elif j == 1:
            head = [vocab.byte[b] for b in w[:1].encode()]
        else:
            continue
        out += [(tuple(head), *rest) for rest in _segmentations(w[j:], vocab)]
    return out


def test_language_scores_match_all_segmentations(spark):
    path = P.path("piece_bpe_32k.model")
    vocab = langid.pieces(path)
    rows = [(1, "the cat sat", "en"), (2, "der hund saß", "de"), (3, "the dog", "en"), (4, "die katze ኩ", "de"), (5, "le chat", "fr"), (6, None, "fr"), (7, "x", None)]
    asked = [(10, "the hund"), (11, "chat ኩኩ"), (12, "12, !"), (13, None), (14, "The, cat-dog")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path)
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model, path).collect()}
    langs = ["de", "en", "fr"]
    counts = {k: Counter(w for _, t, lang in rows if lang == k and t for w in langid.WORD.findall(t.lower())) for k in langs}
    p = {k: np.full(vocab.size, 1 / vocab.size) for k in langs}
    weight = lambda k, cut: math.prod(p[k][i] for part in cut for i in part)
    for _ in range(3):
        new = {}
        for k in langs:
            e = np.full(vocab.size, 0.5)
            for w, n in counts[k].items():
                cuts = _segmentations("▁" + w, vocab)
                total = sum(weight(k, c) for c in cuts)
                for c in cuts:
                    for part in c:
                        for i in part:
                            e[i] += n * weight(k, c) / total
            new[k] = e / e.sum()
        p = new
    prior = {"de": 2 / 5, "en": 2 / 5, "fr": 1 / 5}
    for key, text in asked:
        words = langid.WORD.findall((text or "").lower())
        if not words:
            assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
            continue
        like = {k: prior[k] * math.prod(sum(weight(k, c) for c in _segmentations("▁" + w, vocab)) for w in words) for k in langs}
        best = max(langs, key=lambda k: (like[k], -langs.index(k)))
        assert got[key]["lang_pred"] == best and math.isclose(got[key]["score"], like[best] / sum(like.values()), rel_tol=1e-9)


def test_rare_letters_and_long_words_have_scores():
    vocab = langid.pieces(P.path("piece_bpe_32k.model"))
    counts = np.full((2, vocab.size), 0.5)
    counts[:, 300:900] += np.random.default_rng(0).integers(0, 10**9, (2, 600))
    model = {"langs": ["a", "b"], "prior": np.log([0.5, 0.5]), "logp": np.log(counts / counts.sum(1, keepdims=True))}
    texts = ["ኩ" * 38, "𐐨" * 400, "a" * 5000, "ኩ" * 40 + " the", "ß" * 77]
    for lang, score in langid.Scorer(model, P.path("piece_bpe_32k.model")).predict(texts):
        assert lang in "ab" and 0.5 <= score <= 1
    table = langid.Probabilities(vocab, model["logp"])
    for w in texts[:3]:  # expected pieces of one word spell it once
        e = langid.expected_counts([w], np.ones(1), table, 0)
        assert np.isfinite(e).all() and e.sum() > 0


def test_windows_never_drift_from_their_targets():
    r = np.random.default_rng(5)
    for _ in range(12):
        k, window = int(r.integers(2, 7)), 500
        shares = r.dirichlet(np.ones(k)) + 0.01
        sizes = r.integers(2_000, 30_000, k)
        s = packing.Schedule(sizes, shares, window=window, period=8)
        n = int(-(-sizes.sum() // window))
        taken, places = np.zeros((n, k), np.int64), []
        for q in range(k):
            at = 0
            for start, length, place in s.pieces(q, 0, int(sizes[q])):
                assert start == at and place // window == (place + length - 1) // window
                at += length
                taken[place // window, q] += length
                places.append((place, length))
            assert at == sizes[q]
        places.sort()
        assert all(a + m == b for (a, m), (b, _) in zip(places, places[1:])) and (taken.sum(1)[:-1] == window).all()
        # a plain round robin: each window adds its quantum to every queue's credit; what was given never strays from it by more than a token
        quantum, full = shares / shares.sum() * window, np.flatnonzero((taken.cumsum(0) >= sizes).any(1)).min()
        given = taken[:full].cumsum(0)
        assert abs(given - quantum * np.arange(1, full + 1)[:, None]).max() <= 1 + full / 8  # quanta are whole tokens a period
        # once queues are dry, the others share by their targets
        for w in range(full + 1, n - 1):
            open_ = taken[: w + 2].sum(0) < sizes
            alive = taken[w] > 0
            if (open_ == alive).all() and alive.sum() > 1 and (taken[w - 1] > 0).tolist() == alive.tolist():
                want = shares * alive / (shares * alive).sum() * window
                assert abs(taken[w] - want).max() <= 2


def served_in_turn(sizes, weights):
    """The queue of each token of the stream, token by token: the queue that is due first gives the next one."""
    given, due = [0] * len(sizes), [(0.5 / w, q) for q, w in enumerate(weights) if sizes[q]]
    heapq.heapify(due)
    while due:
        _, q = heapq.heappop(due)
        yield q
        given[q] += 1
        if given[q] < sizes[q]:
            heapq.heappush(due, ((given[q] + 0.5) / weights[q], q))


@pytest.mark.parametrize("window", [7, 100, 5000])
def test_windows_of_few_and_many_queues_are_those_of_a_plain_round_robin(window):
    r = np.random.default_rng(window)
    for k, shares in ((3, [5, 1, 0.01]), (40, r.integers(1, 4, 40)), (300, 10.0 ** r.integers(-4, 4, 300))):
        sizes, shares = r.integers(0, 120, k), np.array(shares, float)
        s = packing.Schedule(sizes, shares, window=window, period=5)
        want = [Counter() for _ in range(-(-int(sizes.sum()) // window))]
        for i, q in enumerate(served_in_turn(sizes.tolist(), shares.tolist())):
            want[i // window][q] += 1
        got, places = [Counter() for _ in want], []
        for q in range(k):
            for a, n in ((0, min(5, int(sizes[q]))), (min(5, int(sizes[q])), max(int(sizes[q]) - 5, 0))):  # two documents
                for _, length, place in s.pieces(q, a, n):
                    got[place // window][q] += length
                    places += range(place, place + length)
        assert got == want and sorted(places) == list(range(int(sizes.sum())))


@pytest.fixture(scope="module")
def many_sources(spark, tmp_path_factory):
    """A folder of documents of 704 sources, without a name or with an empty one too; and the tokens of each source."""
    r = random.Random(4)
    names = [f"s{i:03}" for i in range(702)] + ["", None]
    docs = [(k, " ".join(f"w{r.randrange(50)}" for _ in range(r.choice((3, 40, 40, 150)))), names[k % 704 if k < 1100 else r.randrange(5)]) for k in range(1600)]
    folder = str(tmp_path_factory.mktemp("sources"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    t, size = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    ids = {k: [*t.encode(text, add_special_tokens=False).ids, 0] for k, text, _ in docs}
    for k, _, s in docs:
        size[s or ""] += len(ids[k])
    return folder, ids, size


def windows_by_hand(size, weights):
    order = sorted(size, key=lambda s: (-weights[s], -size[s], s))
    out = Counter()
    for i, q in enumerate(served_in_turn([size[s] for s in order], [weights[s] for s in order])):
        out[i // (packing.WINDOW * packing.SEQUENCE), order[q]] += 1
    return out


def test_every_source_has_its_share_of_every_window(spark, many_sources):
    """More sources than have places by arithmetic: all count by their weights, none is put off."""
    folder, _, size = many_sources
    weights = {s: 3.0 if i % 3 == 2 else 1.0 for i, s in enumerate(sorted(size))}
    want = windows_by_hand(size, weights)
    assert len(size) == 703 and max(w for w, _ in want) >= 2
    assert {(r["window"], r["source"]): r["n_tokens"] for r in packing.packing_mixture(spark, folder).collect()} == want


@pytest.mark.parametrize("weighted", [False, True])
def test_windows_do_not_depend_on_how_many_queues_come_first(spark, many_sources, weighted):
    folder, ids, size = many_sources
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weights = {s: float(i % 4) for i, s in enumerate(sorted(size)) if i % 5} if weighted else None  # a third without a weight, or with 0
    mine = {s: weights.get(s) or 1e-9 for s in size} if weighted else size
    want = windows_by_hand(size, mine)
    for most in (0, 3, 256, 1000):
        got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), weights=weights, max_queues=most).toPandas().sort_values(["sequence_id", "offset"])
        n = got.groupby([got.sequence_id // packing.WINDOW, "source"]).length.sum()
        assert n.to_dict() == want
        at = got.sequence_id * packing.SEQUENCE + got.offset
        assert (at == got.length.cumsum() - got.length).all() and got.length.sum() == sum(size.values())
        for r in got.itertuples():
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
            assert list(r.token_ids) == part.tolist() and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def _near_group(n, length, most, seed):
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, most)):
            words[r.randrange(length)] = f"e{r.randrange(60)}"
        out.append(" ".join(words))
    return out


def _classes(texts):
    bags, parent = [near_dup.shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(bags)):
        for j in range(i):
            if near_dup.similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_large_groups_near_the_threshold(spark):
    texts = _near_group(350, 90, 5, 1) + _near_group(150, 60, 9, 2) + ["a b c"] * 3 + [""] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _classes(texts)


def test_prefix_pairs_hold_every_link_and_few_others(spark):
    texts = _near_group(200, 80, 4, 3) + _near_group(200, 80, 30, 4)
    bags = [near_dup.shingles(t) for t in texts]
    rows = [(near_dup.sequence_key(t), t, int(b[1].sum()), near_dup.sequence_key(t)) for t, b in {t: b for t, b in zip(texts, bags)}.items()]
    made = near_dup.prefix_pairs(spark.createDataFrame(rows, "key binary, text string, size long, part binary"), 0.8)
    pairs = {(bytes(r["a"]), bytes(r["b"])) for r in made.collect()}
    by_key = {k: near_dup.shingles(t) for k, t, *_ in rows}
    keys = sorted(by_key)
    links = {(a, b) for i, b in enumerate(keys) for a in keys[:i] if near_dup.similarity(by_key[a], by_key[b]) >= 0.8}
    assert links <= pairs and links
    unlike = {k for k, t, *_ in rows if t in set(texts[200:])}
    assert sum(a in unlike and b in unlike for a, b in pairs) < len(unlike) * 4  # texts that never link are hardly paired


@pytest.mark.parametrize("unique", [36, 29, 28])  # similarities of 0.745, 0.789 and 0.795
def test_a_template_below_the_threshold_makes_no_pairs(spark, unique):
    r = random.Random(unique)
    template = [f"t{i}" for i in range(250 - unique)]
    made = []
    for k in range(400):
        extra = [f"u{k}x{i}" for i in range(unique + r.randrange(0, 2))]
        at = 60
        made.append(" ".join(template[:at] + template[at:] + extra))
    # a few that are linked, so that something has to be found
    made += [m + " one more end" for m in made[:5]]
    bags = [near_dup.shingles(t) for t in made]
    rows = [(near_dup.sequence_key(t), t, int(b[1].sum()), near_dup.sequence_key(t)) for t, b in zip(made, bags)]
    pairs = {(bytes(x["a"]), bytes(x["b"])) for x in near_dup.prefix_pairs(spark.createDataFrame(rows, "key binary, text string, size long, part binary"), 0.8).collect()}
    by_key = {k: b for (k, *_), b in zip(rows, bags)}
    keys = sorted(by_key)
    links = {(a, b) for i, b in enumerate(keys) for a in keys[:i] if near_dup.similarity(by_key[a], by_key[b]) >= 0.8}
    assert links <= pairs and links
    assert len(pairs) < 20 * len(made)


def test_components(spark):
    from seqspark.llm.components import connected_components

    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    low = {}
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    for a, b in clean:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(200):
        for a, b in clean:
            low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_contexts_give_the_same_scores(spark, sf, monkeypatch):
    from seqspark.llm import katz

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text", (F.col("doc_id") % 4 != 0).alias("train")).repartition(5)
    scores = lambda: {r["doc_id"]: r for r in katz.score_texts(docs, "train").collect()}
    want = scores()
    monkeypatch.setattr(katz, "HOT", 4)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 400)
    got = scores()
    assert got.keys() == want.keys() and len(got) == 60
    for k, r in want.items():
        assert r["n_tokens"] == got[k]["n_tokens"] and r["n_known"] == got[k]["n_known"]
        assert all(math.isclose(r[c], got[k][c], rel_tol=1e-9) for c in ("base_score", "score", "score_lower"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("katz_")]


def _folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "what is the capital city of the old northern kingdom by the grey sea? it is the town of seven bridges"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    import corpus_pipeline

    good = corpus_pipeline.deduplicated(spark, corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf)
    texts = [x["text"] for x in good.where("length(text) BETWEEN 600 AND 3000").orderBy("doc_id").limit(60).collect()]
    prose = lambda k: texts[k]
    leak = "what is the capital city of the old northern kingdom by the grey sea? it is the town of seven bridges"
    rows = [
        (1, prose(1), "en", "a", 10), (2, prose(1), "en", "b", 10), (3, prose(2) + " " + leak + " " + prose(3), "en", "a", 10), (4, None, None, None, None), (5, "", "en", "a", 0), (6, prose(4), None, None, None),
        (6, prose(4), None, None, None), (6, prose(5), "de", "c", 1), (None, prose(6), "en", "a", 1), (8, prose(7) + " mail ann@example.com", "en", "a", 1), (9, " ".join(prose(s) for s in range(20, 50)), "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(i) for i, c in enumerate(("_key", "row", "key", "rest", "class_id", "_key_"))})
    got = corpus_pipeline.run(spark, _folder(spark, tmp_path / "some", docs)).toPandas()
    kept = {None if v != v else int(v) for v in got.doc_id}
    assert {1, 6, 8, 9, None} >= kept >= {1, 6, 8, None} and not kept & {2, 3, 4, 5}
    assert got[got.doc_id == 6].groupby("doc_tokens").length.sum().size in (1, 2)  # two texts under one id are judged one by one
    whole = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    stage = corpus_pipeline.deduplicated(spark, corpus_pipeline.quality(spark, whole, ""), "")
    assert stage.columns == docs.columns and stage.where("doc_id = 6").count() == 2
    none = corpus_pipeline.run(spark, _folder(spark, tmp_path / "none", docs.where("false")))
    assert none.count() == 0
