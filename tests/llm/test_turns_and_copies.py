"""Operators 11 to 13 against brute force, on odd rows and cut into small blocks."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqspark.llm import lempel_ziv, prefix_trie, structure_repair


def corpus(seed, n=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shared = [" ".join(draw.choices(words, k=k)) for k in (19, 20, 25, 60, 90)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randrange(0, 5)):
            kind = draw.randrange(4)
            text = draw.choice(shared)
            if kind == 0:
                text = " ".join(draw.choices(words, k=draw.randrange(1, 40)))
            elif kind == 1:
                w = text.split()
                w[draw.randrange(len(w))] = "changed"
                text = " ".join(w)
            elif kind == 2:
                text = " ".join(draw.choice([["x"], ["a", "b"], ["a", "b", "c", "d", "e", "f", "g"]]) * draw.randrange(1, 30))
            parts.append(text)
        rows.append((draw.choice([i, i, i, 7]), draw.choice([" ", "\n", " \t "]).join(parts)))
    return rows + [(None, shared[3]), (None, shared[4] + " tail"), (500, None), (501, ""), (502, " \n\x0b "), (3, rows[3][1]), rows[5], (600, "é ü " * 30), (601, "é ü " * 30)]


def brute_copies(rows):
    """(id, n_words, kept) by the definition, window by window."""
    first, out = {}, []
    order = lambda i, k: (i is not None, i if i is not None else 0, k)
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (2,)), order(i, k))
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < order(i, k):
                gone |= set(range(k, k + 20))
        out.append((i, len(w), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("seed, size", [(1, 1 << 22), (2, 300), (3, 1)])
def test_relative_parse_like_windows(spark, monkeypatch, seed, size):
    monkeypatch.setattr(lempel_ziv, "SLICE_BYTES", size)
    rows = corpus(seed)
    clash = {c: F.lit("x") for c in ("id", "key", "seed", "parts", "start", "at", "known")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(clash)
    parsed = lempel_ziv.relative_parse(docs)
    got = [(r["doc_id"], r["n_words"], bytes(r["kept"])) for r in lempel_ziv.without_copies(parsed).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=order) == sorted(brute_copies(rows), key=order)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode().split())
    for r in parsed.collect():
        words, at = (r["text"] or "").encode().split(), 0
        for f in r["factors"]:
            assert f["start"] == at and f["length"] > 0
            at += f["length"]
            if f["copied"] and len(texts[f["source"]]) == 1:
                assert words[f["start"] : at] == texts[f["source"]][0][f["at"] : f["at"] + f["length"]]
        assert at == len(words)


def test_relative_parse_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert lempel_ziv.without_copies(lempel_ziv.relative_parse(docs)).count() == 0


def conversations(seed, n=40, longest=9):
    draw = random.Random(seed)
    turn = lambda: (draw.choice(["user", "user", "assistant", "assistant", "system", "tool", None, ""]), draw.choice(["a.", "b?", "c!", "d", " ", "", None, "a. \n"]))
    stock = [[turn() for _ in range(longest)] for _ in range(4)]
    rows = []
    for c in range(n):
        turns = draw.choice(stock)[: draw.randrange(0, longest)] + [turn() for _ in range(draw.randrange(0, 4))]
        at = draw.sample(range(-3, 30), len(turns)) if draw.random() < 0.3 else list(range(len(turns)))
        rows += [(c - 7 if draw.random() < 0.98 else None, k if draw.random() < 0.95 else None, *t) for k, t in zip(at, turns)]
    return rows + rows[:3]


def in_order(rows, blank):
    """conv_id -> its (role, text) in order."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    for c, k, role, text in sorted(((c, k, blank if r is None else r, blank if t is None else t) for c, k, r, t in rows), key=key):
        out.setdefault(c, []).append((k, role, text))
    return out


def brute_trie(rows):
    found = {c: [(r, t) for _, r, t in x] for c, x in in_order([r for r in rows if r[0] is not None], "").items()}
    strings = {}
    for c, own in found.items():
        h, donor = zlib.crc32(str(c).encode()) % 9, c - int(c - 5 * int(c / 5))
        strings[c] = found.get(donor, [])[:h] + own[h:]
    members = {}
    for c, s in strings.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {k: {m for m in members if len(m) == len(k) + 1 and m[: len(k)] == k} for k in members}
    out = []
    for k, cs in members.items():
        below = [m for m in members if m[: len(k)] == k]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in cs if len(strings[c]) == len(k))))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids[k]), sum(not kids[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3), (3, 2)])
def test_trie_like_sets_of_prefixes(spark, monkeypatch, seed, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(seed)
    clash = {c: F.lit("x") for c in ("a", "n", "pos", "place", "h1", "low", "salt")}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumns(clash)
    got = [tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(df)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_trie(rows)))


def test_trie_of_chains_and_of_nothing(spark):
    """Strings that are each a prefix of the next: as many nodes in a row as strings; and many that part at one node."""
    chain = [(c, k, "user", "t") for c in range(0, 200, 5) for k in range(c // 5)]
    fan = [(c, k, "user", "t" if k < 3 else str(c)) for c in range(1000, 1200, 5) for k in range(4)]
    schema = "conv_id long, turn long, role string, text string"
    got = [tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame(chain + fan, schema))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_trie(chain + fan)))
    assert prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame([], schema))).count() == 0


def brute_repair(turns):
    """(cost, audit, repaired) over all edits, with up to two inserts before each row and at the end."""
    seen, rows = set(), []
    for _, role, text in turns:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, text, fault))
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    edits = [[("D", None, 3)] + ([] if f in ("blank", "duplicate") else [("K", r, int(f == "truncated"))] + [("R", x, 2 + int(f == "truncated")) for x in ("user", "assistant")]) for r, _, f in rows]
    import re

    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        extra = sum(map(len, gaps)) * 2
        if best is not None and extra > best[0]:
            continue
        for chosen in itertools.product(*edits):
            cost = extra + sum(c for _, _, c in chosen)
            if best is not None and cost > best[0]:
                continue
            audit, out = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(gaps[k])
                out += [(r, "") for r in gaps[k]]
                if k < len(rows):
                    audit += chosen[k][0]
                    if chosen[k][0] != "D":
                        out.append((chosen[k][1], rows[k][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out))
    faults = [f for *_, f in rows]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best)


def test_lightest_derivations_are_the_least_edits(spark):
    draw = random.Random(8)
    stock = [("user", "a."), ("assistant", "b."), ("system", "c."), ("assistant", "d"), ("user", " "), ("tool", "e."), ("", "f."), ("user", "g")]
    for n in (0, 1, 2, 3, 3, 3, 3, 3):
        turns = [(k, *draw.choice(stock)) for k in range(n)]
        seen, letters = set(), ""
        for _, role, text in turns:
            core = text.strip()
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] != "." else ""
            seen.add((role, text))
            letters += next(k for k, v in structure_repair.LETTER.items() if v == (role[:1] if role[:1] in ("s", "u", "a", "") else "?", fault))
        cost, audit = brute_repair(turns)[4:6]
        assert structure_repair.solved([letters]) == (cost, audit)
        if n:
            assert structure_repair.solved(list(letters)) == (cost, audit)


@pytest.mark.parametrize("seed, block", [(5, 1024), (6, 1)])
def test_repair_of_tables(spark, monkeypatch, seed, block):
    monkeypatch.setattr(structure_repair, "BLOCK", block)
    rows = conversations(seed, n=40, longest=3)
    rows = [r for r in rows if r[0] is not None] + [(None, 1, "user", "a."), (None, None, "user", "a.")]
    few = {c: x for c, x in in_order(rows, " ").items() if len(x) <= 4}
    rows = [r for r in rows if r[0] in few]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumns({c: F.lit("x") for c in ("pos", "key", "letter", "block", "audit")})
    repair = structure_repair.Repair(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.verdicts.collect()}
    text = {r["conv_id"]: r["sha256"] for r in repair.digests().collect()}
    whole = {}
    for r in sorted(repair.repaired().collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"])):
        whole.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    gaps = {r["conv_id"]: r["gaps"] for r in repair.gaps().collect()}
    for c, turns in few.items():
        *counts, cost, audit, out = brute_repair(turns)
        assert got[c] == (*counts, cost, audit)
        assert whole.get(c, []) == out
        assert text[c] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        known = [k for k, *_ in turns if k is not None]
        assert gaps.get(c, 0) == (max(known) - min(known) + 1 - len(set(known)) if known else 0)


def test_repair_of_nothing_and_of_dropped_rows(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    gone = next(k for k in range(1000) if zlib.crc32(f"9:{k}".encode()) % 20 == 0)
    for rows in ([], [(9, gone, "user", "a.")]):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        got = [tuple(r) for r in structure_repair.op13_structure_repair(spark, str(tmp_path)).collect()]
        assert got == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())][: len(rows)]


def test_weighted_windows_hold_their_shares(spark, sf):
    """While no queue has run dry, each full window has the shares that the weights ask for; nothing is lost."""
    from seqspark.llm import packing

    folder = sf.replace("sf0.001", "sf0.01")
    got = packing.packing_mixture(spark, folder).toPandas()
    names = sorted(got.source.unique())
    weight = {s: 3.0 if i % 3 == 2 else 1.0 for i, s in enumerate(names)}
    want = {s: w / sum(weight.values()) for s, w in weight.items()}
    size = packing.SEQUENCE * packing.WINDOW
    table = got.pivot(index="window", columns="source", values="n_tokens").fillna(0)
    total = table.sum()
    full, used = 0, table.iloc[0] * 0
    for _, row in table.sort_index().iterrows():
        used += row
        if (used >= total - 1).any() or row.sum() < size:
            break
        full += 1
        assert all(abs(row[s] / size - want[s]) < 0.01 for s in names)
    assert full >= 1
