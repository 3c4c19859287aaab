"""Z-fast trie of conversations: which prefixes of turns are shared, by how many, and what sharing saves.

A conversation is a string of turns; a prefix is known by its depth and 128 bits
of hashes that depend on every turn and its place. The compacted trie has a node
where conversations end or part; a node owns the edge above it, depths (low,
high]. It is hashed at its handle: of the depths of its edge the two-fattest one
(that which the highest power of two divides), with the prefix of that depth.

*Locating.* A conversation finds where it leaves the trie by fat binary search:
for what is left of its depths it looks up the prefix at the two-fattest depth;
a hit moves the lower end to the node's depth, a miss the upper end below the
handle. So it takes as many look-ups, joins of all conversations at once, as a
depth has bits. A last look-up, by the first turn below, finds the edge on which
it leaves.

*Inserting in batches.* Each round locates all conversations that are not in yet.
Edges are cut at all depths where conversations leave them or end. Of those that
leave at one point with the same next turn one, drawn by hash, becomes a leaf;
the others go on from there in the next round. As with quicksort, the draws make
the rounds few: logarithmic in the conversations that share a point.

*Expanding.* Sums over subtrees come from doubling: in round k every node hands
what it has gathered to its ancestor 2^k above, so there are as many rounds as
the deepest chain of nodes has bits. Then each edge is written out as the prefixes
on it.

Rows of at most BLOCK hashes: a longer conversation is cut at every BLOCK turns,
the trie has a node at each cut, and the search of a piece begins there.

Defined cases: turns are ordered by turn (null first), then role and text; null
roles and texts are empty; rows without conv_id belong to no conversation and
are left out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.shared import dropped, table, written
from seqspark.llm.structure_repair import crc32_sql
from seqspark.operators.ranks import numbered

BLOCK = 1024
SALTS = 8


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides; 0 <= low < high."""
    bits = (F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("int")  # the highest bit in which they differ
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def _at(xs: str, depth: Column) -> Column:
    """The hash of the prefix of ``depth`` of a row (low, xs); null outside it."""
    return F.get(xs, (depth - F.col("low") - 1).cast("int"))


def _cut(x: Column) -> Column:
    """A decimal modulo 2^64, as a signed long."""
    whole, half = (F.lit(str(1 << k)).cast("decimal(38,0)") for k in (64, 63))
    m = F.pmod(x, whole)
    return F.when(m >= half, m - whole).otherwise(m).cast("long")


def pieces(turns: DataFrame) -> DataFrame:
    """Pieces (conv_id, low, p, q, lead, a, b, bytes) of at most BLOCK turns, from turns (conv_id, place, h1, h2, n_bytes).

    ``a`` and ``b`` are the two hashes of the prefixes of depths low+1..., ``p`` and
    ``q`` those of depth low, ``bytes`` the bytes of all texts down to each depth and
    ``lead`` down to low. The hash of a prefix is a sum of hashes of (place, turn),
    so what lies before a piece enters as one number.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    block = F.expr(f"place div {BLOCK}").alias("block")
    packed = turns.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("place", "h1", "h2", "n_bytes"))).alias("x"))
    packed = packed.select("conv_id", "block", *(F.col(f"x.{c}").alias(c) for c in ("h1", "h2", "n_bytes")))
    sums = [F.aggregate(c, F.lit("0").cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)")).alias(t) for c, t in (("h1", "p"), ("h2", "q"), ("n_bytes", "lead"))]
    following = packed.where("block > 0").select("conv_id").distinct()  # conversations of one block need no leads
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = packed.join(following, "conv_id", "left_semi").select("conv_id", "block", *sums)
    leads = totals.select("conv_id", "block", *(_cut(F.sum(c).over(before)).alias(c) for c in ("p", "q", "lead"))).where("block > 0")
    led = packed.join(leads, ["conv_id", "block"], "left").select("conv_id", (F.col("block") * BLOCK).alias("low"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("p", "q", "lead")), "h1", "h2", "n_bytes")
    names = ["conv_id", "low", "p", "q", "lead", "a", "b", "bytes"]

    def summed(batches):
        for batch in batches:
            arrays = []
            for k in range(3):
                lists, first = batch.column(5 + k), batch.column(2 + k).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum([0, *(len(x) for x in lists)])
                run = np.cumsum(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))  # wraps, as the hashes do
                base = np.append(0, run)[ends[:-1]]
                arrays.append(pa.ListArray.from_arrays(ends.astype(np.int32), run - np.repeat(base - first, np.diff(ends))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *arrays], names=names)

    return led.mapInArrow(summed, f"conv_id {kind}, low long, p long, q long, lead long, a array<long>, b array<long>, bytes array<long>")


NODE = ("low", "high", "p", "q", "lead", "a", "b", "bytes")


def _locate(pending: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``pending`` (node columns, and ``at``, a depth at which it is at a node) with ``m``, the depth at which it leaves the trie, and ``edge``, that of the top of the edge where it does so (null at a node)."""
    handle = two_fattest(F.col("low"), F.col("high"))
    table_ = nodes.select(_at("a", handle).alias("ka"), _at("b", handle).alias("kb"), F.col("low").alias("top"), F.col("high").alias("bottom"), F.element_at("a", -1).alias("ea"), F.element_at("b", -1).alias("eb"))
    now = pending.withColumns({"l": F.col("at"), "r": F.col("high"), "edge": F.lit(None).cast("long")})
    for _ in range(steps):
        open_ = F.col("edge").isNull() & (F.col("l") < F.col("r"))
        f = F.when(open_, two_fattest(F.col("l"), F.greatest("r", F.col("l") + 1)))
        # whoever has finished looks up what can't be there, each something else
        now = now.withColumn("f", f).withColumns({"ka": F.coalesce(_at("a", F.col("f")), F.xxhash64("a")), "kb": F.coalesce(_at("b", F.col("f")), F.lit(0).cast("long"))})
        hit = now.join(table_, ["ka", "kb"], "left").withColumn("hit", F.col("f").isNotNull() & F.col("bottom").isNotNull())
        through = F.col("hit") & _at("a", F.col("bottom")).eqNullSafe(F.col("ea")) & _at("b", F.col("bottom")).eqNullSafe(F.col("eb"))
        now = hit.select(
            *NODE, "at",
            F.when(through, F.col("bottom")).otherwise(F.col("l")).alias("l"),
            F.when(F.col("f").isNotNull() & ~F.col("hit"), F.col("f") - 1).otherwise(F.col("r")).alias("r"),
            F.when(F.col("hit") & ~through, F.col("top")).otherwise(F.col("edge")).alias("edge"),
        )
    # the edge on which it leaves, by the first turn of the edge
    now = now.withColumn("top", F.coalesce("edge", "l")).withColumns({"ka": F.coalesce(_at("a", F.col("top") + 1), F.xxhash64("a")), "kb": F.coalesce(_at("b", F.col("top") + 1), F.lit(0).cast("long"))})
    edges = nodes.select(F.col("a")[0].alias("ka"), F.col("b")[0].alias("kb"), F.col("low").alias("edge"), F.col("high").alias("bottom"), F.col("a").alias("na"), F.col("b").alias("nb"))
    met = now.drop("edge").join(edges, ["ka", "kb"], "left")
    mine = lambda c: F.slice(c, (F.col("edge") - F.col("low") + 1).cast("int"), F.size("na"))
    alike = F.zip_with(F.zip_with(mine("a"), "na", lambda x, y: x.eqNullSafe(y)), F.zip_with(mine("b"), "nb", lambda x, y: x.eqNullSafe(y)), lambda x, y: x & y)
    m = F.when(F.col("edge").isNull(), F.col("l")).otherwise(F.col("edge") + F.size(F.filter(alike, lambda x: x)))
    out = met.withColumn("m", m)
    return out.select(*NODE, F.col("m").alias("at"), F.when(F.col("m") < F.col("bottom"), F.col("edge")).alias("edge"))


def build(found: DataFrame) -> DataFrame:
    """The nodes of the compacted trie of all pieces: (low, high, p, q, lead, a, b, bytes) of the edge above each."""
    end = lambda c: F.element_at(c, -1)
    distinct = found.groupBy("low", end("a").alias("ea"), end("b").alias("eb")).agg(F.first(F.struct("p", "q", "lead", "a", "b", "bytes")).alias("x")).select("low", (F.col("low") + F.size("x.a")).alias("high"), "x.*")
    pending = written(distinct.select(*NODE, F.col("low").alias("at")), "trie-pieces")
    nodes, turn = written(pending.drop("at").where("false"), "trie-nodes"), 0
    while True:
        n, steps = pending.agg(F.count("*"), F.max(F.length(F.bin(F.col("at").bitwiseXOR(F.col("high")))))).head()
        if not n:
            break
        met = written(_locate(pending, nodes, steps if turn else 0), "trie-met")
        # cut edges where pieces leave them or end
        name = [_at(c, F.col("edge") + 1).alias(k) for c, k in (("a", "ka"), ("b", "kb"))]
        cuts = met.where("edge IS NOT NULL").groupBy(*name).agg(F.collect_set("at").alias("cuts"))
        kept = nodes.withColumns({"ka": F.col("a")[0], "kb": F.col("b")[0]}).join(cuts, ["ka", "kb"], "left")
        ends = F.array_sort(F.array_union(F.coalesce("cuts", F.array().cast("array<long>")), F.array("high")))
        parts = F.transform(ends, lambda h, i: F.struct(F.when(i == 0, F.col("low")).otherwise(F.get(ends, i - 1)).alias("lo"), h.alias("hi")))
        kept = kept.select(*NODE, F.explode(parts).alias("s"))
        piece = lambda c: F.slice(c, (F.col("s.lo") - F.col("low") + 1).cast("int"), (F.col("s.hi") - F.col("s.lo")).cast("int"))
        above = lambda c, top: F.coalesce(_at(c, F.col("s.lo")), F.col(top))
        kept = kept.select(F.col("s.lo").alias("low"), F.col("s.hi").alias("high"), above("a", "p").alias("p"), above("b", "q").alias("q"), above("bytes", "lead").alias("lead"), *(piece(c).alias(c) for c in ("a", "b", "bytes")))
        # of those that leave at one point with one turn, one becomes a leaf
        going = met.where("at < high")
        rest = lambda c: F.slice(c, (F.col("at") - F.col("low") + 1).cast("int"), (F.col("high") - F.col("at")).cast("int"))
        top = lambda c, t: F.coalesce(_at(c, F.col("at")), F.col(t))
        leaf = F.struct(F.col("at").alias("low"), "high", top("a", "p").alias("p"), top("b", "q").alias("q"), top("bytes", "lead").alias("lead"), *(rest(c).alias(c) for c in ("a", "b", "bytes")))
        leaves = going.groupBy(*(_at(c, F.col("at") + 1).alias(k) for c, k in (("a", "ka"), ("b", "kb")))).agg(F.max_by(leaf, F.xxhash64(F.lit(turn), end("a"), end("b"))).alias("x")).select("x.*")
        following = written(kept.unionByName(leaves), "trie-nodes")
        old, nodes = nodes, following
        dropped(old, *([] if not turn else [pending]))
        pending, turn = met.where("at < high").drop("edge"), turn + 1
        pending._seqspark_path = met._seqspark_path
    return nodes


#: Strings below a node, the bytes of all of them, the bytes of the edges below, the leaves.
SUMS = ("n", "read", "stored", "leaves")


def _hashed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, n_bytes) of turns (conv_id, turn, role, text), numbered in order."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = numbered(rows, [F.col("conv_id")], [F.col("turn"), F.col("role"), F.col("text")], "pos")
    return rows.select("conv_id", "pos", *(F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)), F.octet_length("text").cast("long").alias("n_bytes"))


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per prefix of the strings of turns.

    ``turns``: (conv_id, place, h1, h2, n_bytes) with places 0, 1...; ``ids``:
    conv_id of every string, turnless ones as well. Returns conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    kind = ids.schema["conv_id"].dataType.simpleString()
    placed = turns.withColumns({h: F.xxhash64(h, "place") for h in ("h1", "h2")})
    cut = written(pieces(placed), "trie-cut")
    last = F.max(F.struct((F.col("low") + F.size("a")).alias("depth"), F.element_at("a", -1).alias("ka"), F.element_at("b", -1).alias("kb"))).alias("e")
    zero = F.lit(0).cast("long")
    ends = ids.select("conv_id", F.lit(None).cast("struct<depth: bigint, ka: bigint, kb: bigint>").alias("e")).union(cut.groupBy("conv_id").agg(last)).groupBy("conv_id").agg(F.max("e").alias("e"))
    ends = ends.select("conv_id", F.coalesce("e.ka", zero).alias("ka"), F.coalesce("e.kb", zero).alias("kb"))
    ends = _ended(ends, kind)
    nodes = build(cut)

    info = nodes.select(F.element_at("a", -1).alias("ka"), F.element_at("b", -1).alias("kb"), F.col("p").alias("pa"), F.col("q").alias("pb"), F.element_at("bytes", -1).alias("deep"), (F.element_at("bytes", -1) - F.col("lead")).alias("edge"))
    root = ids.sparkSession.createDataFrame([(0, 0, None, None, 0, 0)], "ka long, kb long, pa long, pb long, deep long, edge long")
    children = info.groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    info = info.unionByName(root)
    parts = info.unionByName(children, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    tree = parts.groupBy("ka", "kb").agg(*(F.max(c).alias(c) for c in ("pa", "pb", "deep", "edge", "n_children", "n_end", "sha")), F.min("c").alias("c"))
    tree = tree.withColumns({"n": F.coalesce("n_end", zero), "n_children": F.coalesce("n_children", zero)})
    tree = tree.withColumns({"read": F.col("n") * F.col("deep"), "stored": F.col("edge"), "leaves": (F.col("n_children") == 0).cast("long")})
    tree = written(tree.select("ka", "kb", "pa", "pb", "c", *SUMS, "n_children", "sha"), "trie-tree")
    gathered = _gathered(tree)

    held = gathered.select("ka", "kb", "c", *SUMS, "n_children", "sha")
    whole = nodes.withColumns({"ka": F.element_at("a", -1), "kb": F.element_at("b", -1)}).join(held, ["ka", "kb"])
    salt = F.pmod(F.xxhash64("ka", "kb"), F.lit(SALTS)).cast("int")
    above = gathered.where("n_children > 0").select(F.col("ka").alias("p"), F.col("kb").alias("q"), F.col("c").alias("pc"), F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt"))
    whole = whole.withColumn("salt", salt).join(above, ["p", "q", "salt"])
    empty = F.lit(hashlib.sha256().hexdigest())
    prev = F.when(F.col("i") == 0, F.col("lead")).otherwise(F.get("bytes", F.col("i") - 1))
    bottom = F.col("i") == F.size("bytes") - 1
    rows = whole.select("*", F.posexplode("bytes").alias("i", "len")).select(
        F.col("c").alias("conv_id"), (F.col("low") + F.col("i") + 1).alias("depth"), F.when(F.col("i") == 0, F.col("pc")).otherwise(F.col("c")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("read") - F.col("n") * prev - F.col("stored") + prev - F.col("lead")).alias("saved_tokens"), F.when(bottom, F.coalesce("sha", empty)).otherwise(empty).alias("ends_sha256"),
    )
    origin = gathered.where("ka = 0 AND kb = 0 AND n > 0").select(F.col("c").alias("conv_id"), zero.alias("depth"), F.lit(None).cast(kind).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), (F.col("read") - F.col("stored")).alias("saved_tokens"), F.coalesce("sha", empty).alias("ends_sha256"))
    return rows.unionByName(origin)


def _ended(ends: DataFrame, kind: str) -> DataFrame:
    """(ka, kb, n_end, c, sha) of every prefix at which strings end: how many, the smallest id, the hash of all ids; ids stream through in order."""
    dealt = ends.select("ka", "kb", "conv_id", F.col("conv_id").cast("string").alias("s")).repartition("ka", "kb").sortWithinPartitions("ka", "kb", "conv_id")

    def run(batches):
        now, n, c, sha, schema = None, 0, None, None, None
        for batch in batches:
            schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("n_end", pa.int64()), ("c", batch.column(2).type), ("sha", pa.string())])
            out = []
            for key, i, s in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key != now:
                    if now:
                        out.append((*now, n, c, sha.hexdigest()))
                    now, n, c, sha = key, 0, i, hashlib.sha256()
                sha.update(("," + s if n else s).encode())
                n += 1
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, n, c, sha.hexdigest())))], schema)

    return dealt.mapInArrow(run, f"ka long, kb long, n_end long, c {kind}, sha string")


def _gathered(tree: DataFrame) -> DataFrame:
    """``tree`` with the sums and the smallest id of every node's subtree, by doubling along the pointers (pa, pb)."""
    now = tree
    while now.where("pa IS NOT NULL").limit(1).count():
        handed = now.where("pa IS NOT NULL").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(*(F.sum(s).alias(f"{s}_") for s in SUMS), F.min("c").alias("c_"))
        add = {s: F.col(s) + F.coalesce(f"{s}_", F.lit(0)) for s in SUMS} | {"c": F.least("c", "c_")}
        # a pointer to the root is used up; one to a node that many share is met in many tasks
        nearest = now.where("n_children > 0 AND pa IS NOT NULL").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("pa").alias("ga"), F.col("pb").alias("gb"), F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt"))
        own = F.xxhash64("ka", "kb")
        spread = F.col("pa").isNull() | (F.col("pa") == 0) & (F.col("pb") == 0)
        far = now.withColumns({"salt": F.pmod(own, F.lit(SALTS)).cast("int"), "pa": F.when(spread, own).otherwise(F.col("pa")), "pb": F.when(spread, 0).otherwise(F.col("pb"))}).join(nearest, ["pa", "pb", "salt"], "left")
        moved = far.select("ka", "kb", F.col("ga").alias("pa"), F.col("gb").alias("pb"), "c", *SUMS, "n_children", "sha")
        following = written(moved.join(handed, ["ka", "kb"], "left").withColumns(add).select(*tree.columns), "trie-tree")
        dropped(now)
        now = following
    return now


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): conversation c with the first h turns of conversation c - c % 5 in place of its own first h, h = crc32(c) % 9."""
    rows = written(_hashed(conversations), "trie-turns")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    info = sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % 5).alias("donor"))
    donors = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("given"))
    info = info.join(donors, "donor", "left").withColumn("m", F.least("h", F.coalesce("given", F.lit(0))))
    salts = F.least(F.lit(SALTS), F.expr(f"n div {BLOCK} + 1"))
    shift = info.select("conv_id", "h", "m", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    salted = rows.withColumn("salt", F.expr(f"(pos div {BLOCK}) % {SALTS}"))
    hashes = ("h1", "h2", "n_bytes")
    own = salted.join(shift, ["conv_id", "salt"]).where("conv_id % 5 = 0 OR pos >= h").select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("m")).alias("place"), *hashes)
    first = rows.where("conv_id % 5 = 0 AND pos < 8").select(F.col("conv_id").alias("donor"), F.col("pos").alias("place"), *hashes)
    given = info.where("conv_id % 5 <> 0 AND m > 0").select("conv_id", "donor", "m").join(first, "donor").where("place < m").select("conv_id", "place", *hashes)
    return own.unionByName(given), sizes.select("conv_id")


def op12_zfast_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


#: DuckDB SQL for the whole query, prefix by prefix.
OP12_SQL = f"""
WITH r AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS t FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) AS c GROUP BY 1),
h AS (SELECT conv_id, t, ({crc32_sql('conv_id::VARCHAR')} % 9)::BIGINT AS h FROM r),
s AS (SELECT h.conv_id, list_concat(coalesce(d.t[1:h], []), h.t[h + 1:]) AS t FROM h LEFT JOIN r AS d ON d.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM s),
g AS (SELECT d, t[1:d] AS k, count(*) AS n_convs, min(conv_id) AS conv_id, count(DISTINCT t[d + 1]) FILTER (len(t) > d) AS n_children, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(t) = d) AS ends FROM p GROUP BY 1, 2),
u AS (SELECT unnest(range(0, d + 1)) AS d2, k, d, (n_children = 0)::INT AS leaf, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(k[d].text) ELSE 0 END AS saved FROM g),
a AS (SELECT d2 AS d, k[1:d2] AS k, sum(leaf) AS n_leaves, sum(saved) AS saved FROM u GROUP BY 1, 2)
SELECT g.conv_id, g.d AS depth, o.conv_id AS parent_conv_id, g.n_convs, g.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN a ON a.d = g.d AND a.k = g.k LEFT JOIN g AS o ON o.d = g.d - 1 AND o.k = g.k[1:g.d - 1] AND g.d > 0
"""
