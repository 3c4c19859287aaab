"""Conversation structure repair as lightest derivations (Knuth's generalisation of Dijkstra's algorithm).

An item [i, q] says that i rows have been taken and that the roles written so
far lead the grammar ``(s?(ua)+)?`` to state q. Its weight is (cost, audit), the
audit being the initials of the edits. From [i, q] and the row i one deduces
[i+1, q'] by Keep, Rerole or Delete, and from [i, q] alone [i, q'] by Insert.
Each deduction appends to the audit and adds to the cost, so it is superior:
the agenda pops items in the order of weight, the first time an item is popped
its weight is final, and the search ends when the goal is popped. Derivations of
one item that cost the same differ before either ends (they have taken the same
rows, and inserts cost), so appending keeps their order.

Scale: rows are numbered by ranges, not in a window over a conversation. What
the agenda needs of a row is one letter; letters are gathered in blocks of BLOCK
rows, each block is solved from every state it may begin in, and the blocks of a
conversation are joined in order, as deductions over [block, q]. Only letters
and audits of a conversation come together, never its texts, which stream
through a hash in order.

Defined cases: null roles and texts are one space; rows of the same turn are
taken by role and text; a role whose first letter is none of s, u, a can't be
kept, an empty role has no letter and may stay anywhere; rows without conv_id
are one conversation, whose id is null; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import table
from seqspark.operators.ranks import numbered

BLOCK = 1024
_SPACE = " \t\n\x0b\x0c\r"
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
GOALS = (START, AFTER_ASSISTANT)
NEXT = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
#: A row's letter: its role's (s, u, a, none, other) and its first fault (none, blank, duplicate, truncated).
ROLES, FAULTS = ("s", "u", "a", "", "?"), ("", "blank", "duplicate", "truncated")
LETTER = {chr(ord("A") + len(FAULTS) * i + k): (r, f) for i, r in enumerate(ROLES) for k, f in enumerate(FAULTS)}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _made(q: int) -> tuple[str, int]:
    """The role that may be written in state q by Rerole or Insert, and the state after it."""
    return ("assistant", AFTER_ASSISTANT) if q == AFTER_USER else ("user", AFTER_USER)


def deductions(letters: str, i: int, q: int):
    """(i', q', cost, initial) of every item that [i, q] leads to."""
    made = _made(q)[1]
    yield i, made, 2, "I"
    if i < len(letters):
        role, fault = LETTER[letters[i]]
        yield i + 1, q, 3, "D"
        if fault in ("", "truncated"):
            more = int(fault == "truncated")
            yield i + 1, made, 2 + more, "R"
            if not role:
                yield i + 1, q, more, "K"
            elif (q, role) in NEXT:
                yield i + 1, NEXT[q, role], more, "K"


def lightest(letters: str, begin: int, goals: tuple[int, ...], every: bool = False) -> dict[int, tuple[int, str]]:
    """State -> (cost, audit) of the lightest derivations that take all rows from state ``begin``: until a goal is final, or ``every`` goal that can be reached."""
    agenda, final, found = [(0, "", 0, begin)], set(), {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == len(letters) and q in goals:
            found[q] = (cost, audit)
            if not every or len(found) == len(goals):
                break
        for i2, q2, more, initial in deductions(letters, i, q):
            if (i2, q2) not in final:
                heapq.heappush(agenda, (cost + more, audit + initial, i2, q2))
    return found


#: What can follow a state; nothing comes back to START, nor to AFTER_SYSTEM.
BEHIND = {START: (0, 1, 2, 3), AFTER_SYSTEM: (1, 2, 3), AFTER_USER: (2, 3), AFTER_ASSISTANT: (2, 3)}


@lru_cache(20_000)
def block_items(letters: str, begin: int) -> dict[int, tuple[int, str]]:
    """Every state that a block can end in from ``begin``, with its weight."""
    return lightest(letters, begin, BEHIND[begin], every=True)


@lru_cache(20_000)
def conversation(letters: str) -> tuple[int, str]:
    """(cost, audit) of a conversation of one block."""
    return min(lightest(letters, START, GOALS).values())


def joined(items: dict[int, tuple[int, str]], letters: str) -> dict[int, tuple[int, str]]:
    """The items [k+1, q] of a conversation from its items [k, q] and block k."""
    out: dict[int, tuple[int, str]] = {}
    for q, (cost, audit) in items.items():
        for q2, (more, tail) in block_items(letters, q).items():
            if q2 not in out or (cost + more, audit + tail) < out[q2]:
                out[q2] = (cost + more, audit + tail)
    return out


def solved(blocks: list[str]) -> tuple[int, str]:
    """(cost, audit) of a conversation from its blocks in order."""
    if len(blocks) == 1:
        return conversation(blocks[0])
    items = {START: (0, "")}
    for letters in blocks:
        items = joined(items, letters)
    return min(items[q] for q in GOALS if q in items)


def _letters(rows: DataFrame) -> DataFrame:
    """(conv_id, block, letters) from numbered rows (conv_id, role, text, pos)."""
    end = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    role = F.coalesce(F.array_position(F.array(*(F.lit(r) for r in ROLES[:4])), initial).cast("int"), F.lit(0))
    role = F.when(role == 0, len(ROLES) - 1).otherwise(role - 1)
    # rows of one conversation with one role and text, told apart from all others by 128 bits; the id is part of it
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.length("role").cast("string"), F.concat("role", "text")).cast("binary")))
    fault = F.when(end == "", 1).when(F.right(end, F.lit(1)).isin(*".!?"), 0).otherwise(3)
    coded = rows.select("conv_id", "pos", key.alias("key"), role.alias("role"), fault.alias("fault"))
    salts = 8
    again = coded.where("fault <> 1").groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select("key", "first", F.explode(F.array(*(F.lit(i) for i in range(salts)))).alias("salt"))  # a text repeated in many rows is met in many tasks
    coded = coded.withColumn("salt", F.pmod("pos", F.lit(salts)).cast("int")).join(again, ["key", "salt"], "left")
    fault = F.when((F.col("fault") != 1) & (F.col("pos") > F.col("first")), 2).otherwise(F.col("fault"))
    coded = coded.select("conv_id", "pos", F.char(F.lit(ord("A")) + F.col("role") * len(FAULTS) + fault).alias("letter"))
    packed = coded.groupBy("conv_id", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "letter"))).alias("x"))
    return packed.select("conv_id", "block", F.array_join(F.transform("x", lambda x: x["letter"]), "").alias("letters"))


VERDICT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _kinds(id_kind: pa.DataType, *columns: str) -> pa.Schema:
    return pa.schema([("conv_id", id_kind), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in columns)])


def _verdicts(blocks: DataFrame) -> DataFrame:
    """One row per conversation from its blocks, which come in order; at most the letters of one conversation are held."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def verdict(letters: list[str]) -> tuple:
        counts, before = [0] * 4, None
        for x in "".join(letters):
            role, fault = LETTER[x]
            if fault:
                counts[FAULTS.index(fault) - 1] += 1
            counts[3] += before is not None and (before, role) not in LEGAL
            before = role
        return (*counts, *solved(letters))

    def run(batches):
        now, held, schema = None, [], None
        for batch in batches:
            out = []
            schema = _kinds(batch.column(0).type, *VERDICT.split(", "))
            for c, letters in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if now != (c,):
                    if now:
                        out.append((*now, *verdict(held)))
                    now, held = (c,), []
                held.append(letters)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, *verdict(held))))], schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, {VERDICT}")


def _repaired(rows: DataFrame, verdicts: DataFrame, digest: bool) -> DataFrame:
    """Rows with the edits of their conversation carried out, streamed in order: (conv_id, place, role, text), or with ``digest`` a hash for each conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    plan = verdicts.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    dealt = rows.select("conv_id", "pos", "role", "text").union(plan).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    columns = ["sha256 string"] if digest else ["place long", "role string", "text string"]

    def run(batches):
        state, out, schema = None, [], None

        def put(role, text):
            if digest:
                state["sha"].update((("\n" if state["place"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            else:
                out.append((state["id"], state["place"], role, text))
            state["place"] += 1

        def inserts():
            while state["at"] < len(state["audit"]) and state["audit"][state["at"]] == "I":
                role, state["q"] = _made(state["q"])
                put(role, "")
                state["at"] += 1

        def close():
            if state:
                inserts()
                if digest:
                    out.append((state["id"], state["sha"].hexdigest()))

        def batch_of(found):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in found], schema)

        for batch in batches:
            schema = _kinds(batch.column(0).type, *columns)
            for c, pos, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if pos < 0:
                    close()
                    state = {"id": c, "audit": text, "at": 0, "q": START, "place": 0, "sha": hashlib.sha256()}
                    continue
                inserts()
                edit = state["audit"][state["at"]]
                state["at"] += 1
                if edit == "R":
                    role, state["q"] = _made(state["q"])
                elif edit == "K" and role:
                    state["q"] = NEXT[state["q"], role[0]]
                if edit != "D":
                    put(role, text)
            yield batch_of(out)
            out.clear()
        if state:
            close()
            yield batch_of(out)

    return dealt.mapInArrow(run, f"conv_id {kind}, {', '.join(columns)}")


class Repair:
    """The repair of a table of conversations (conv_id, turn, role, text)."""

    def __init__(self, conversations: DataFrame):
        filled = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        self.rows = numbered(filled, [F.col("conv_id")], [F.col("turn"), F.col("role"), F.col("text")], "pos")
        self.verdicts = _verdicts(_letters(self.rows))

    def gaps(self) -> DataFrame:
        """(conv_id, gaps): turns that are missing between the least and the greatest."""
        turns = self.rows.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
        return turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))

    def repaired(self) -> DataFrame:
        """The rows of the repaired conversations, in order: (conv_id, place, role, text)."""
        return _repaired(self.rows, self.verdicts, digest=False)

    def digests(self) -> DataFrame:
        """(conv_id, sha256) of the repaired rows as ``role:text`` lines."""
        return _repaired(self.rows, self.verdicts, digest=True)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut of their stops, repeated or given to the user, by a checksum of conversation and turn; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_structure_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(conversations))
    parts = [conversations.select("conv_id"), repair.gaps(), repair.verdicts, repair.digests()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.groupBy("conv_id").agg(*counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in DuckDB."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {step}), 4294967295)"


#: DuckDB SQL for the whole query: the least (cost, audit) per state, row by row. Inserts come before a row or at the end, one or two at most.
OP13_SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r FROM dam),
n0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS bad FROM n0),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY 1),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])) AS v(q, q2, c, a, o)),
ed AS (SELECT conv_id, i, 'D' AS e, q, q AS q2, 3 AS c, []::VARCHAR[] AS o FROM f, range(4) AS t(q)
  UNION ALL SELECT conv_id, i, 'R', q, CASE WHEN q = 2 THEN 3 ELSE 2 END, 2 + (fault = 3)::INT, [CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || text] FROM f, range(4) AS t(q) WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, i, 'K', q, q2, (fault = 3)::INT, [role || ':' || text] FROM f JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)) AS v(q, g, q2) ON g = r WHERE fault IN (0, 3)),
st AS (SELECT conv_id, n, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': '', 'o': []::VARCHAR[]}} AS w FROM n
  UNION ALL SELECT st.conv_id, n, st.i + 1, ed.q2, min({{'cost': w.cost + ins.c + ed.c, 'audit': w.audit || ins.a || ed.e, 'o': list_concat(list_concat(w.o, ins.o), ed.o)}})
  FROM st JOIN ins ON ins.q = st.q JOIN ed ON ed.conv_id IS NOT DISTINCT FROM st.conv_id AND ed.i = st.i + 1 AND ed.q = ins.q2 GROUP BY st.conv_id, n, st.i, ed.q2),
g AS (SELECT conv_id, min({{'cost': w.cost + ins.c, 'audit': w.audit || ins.a, 'o': list_concat(w.o, ins.o)}}) AS w FROM st JOIN ins ON ins.q = st.q WHERE st.i = n AND ins.q2 IN (0, 3) GROUP BY 1)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS x LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id
"""
