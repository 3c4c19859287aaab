"""Personal data with offset-preserving deobfuscation.

A chain of small transducers rewrites a text: homoglyphs and full-width forms
become ASCII, invisible characters go, spelled digits become digits, at/dot
disguises become ``@`` and ``.``. Every rewritten text carries the source start
and end of each of its characters, so what the detectors find in it maps back
to exact spans of the source. Spans found in the untouched text always stay;
the rewritten text adds those that hold a rewritten character and do not lie
inside one already found of the same kind.

Defined cases: a null text is an empty one; all offsets are code points, ends
are exclusive; repeated rows each get a row; extra columns are ignored by
``find_pii`` and kept by ``redact``; an empty table gives an empty result.
All scans are linear in the text, also over one very long run of one character.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS_TYPE = "array<struct<kind:string,start:int,end:int,added:boolean>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")  # takes every run of digits whole, so long runs cost no more
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, found from the at signs."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)
    return found


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base identifiers of ``text`` as (kind, start, end), by kind, then start."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if m[1] and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


# Letters of other alphabets that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-",
}
_INVISIBLE = "​‌‍⁠﻿­"


class _Fold(dict):
    """str.translate table, filled as characters come: lookalikes, full-width and other one-to-one compatibility forms, digits of other scripts."""

    def __missing__(self, code: int):
        c = chr(code)
        if code < 128:
            to = c
        elif c in _INVISIBLE:
            to = None
        elif c in _LOOKALIKES:
            to = _LOOKALIKES[c]
        elif unicodedata.category(c) == "Nd":
            to = str(unicodedata.decimal(c))
        else:
            flat = unicodedata.normalize("NFKC", c)
            to = flat if len(flat) == 1 and flat.isascii() and flat != " " else c
        if len(self) < 70_000:
            self[code] = to
        return to


_FOLD = _Fold()

# Digits as words, in the languages of the corpus.
_DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<![^\W_]){_WORD}(?:[\s,-]{{1,2}}{_WORD})*+(?![^\W_])")
_EACH = re.compile(rf"(?i){_WORD}")
_APART = str.maketrans("-,", "  ")
_NEAR = frozenset(_DIGITS) | {"plus", "dot", "punto", "punkt", "point"}
_PLUS = re.compile(r"(?i)(?<![^\W_])plus[\s-]{1,2}(?=[0-9])")

_DOT_WORD = r"(?:dot|punto|punkt|point)"
# White space is taken by whole runs, each from its first character alone, so that long runs take linear time.
_DOT = rf"(?:\s*+[\[({{<]\s?(?:{_DOT_WORD}|\.)\s?[\])}}>]\s*+|\s++{_DOT_WORD}\s++|\s*+_{_DOT_WORD}_\s*+|-dot-)"
_AT = re.compile(r"(?i)(?<!\s)\s*+(?:[\[({<]\s?(?:at|arroba|@)\s?[\])}>]\s*+|@\s*+)|(?<!\s)\s++(?:at|arroba)\s++|_at_|-at-")
_BARE_AT = re.compile(r"(?i)\s++(?:at|arroba)\s++|\s++@\s*+|\s*+@\s++")
_HIDDEN_DOT = re.compile(rf"(?i){_DOT}")
_TAIL = re.compile(rf"(?i)[a-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[a-z0-9-]{{1,63}})*?(?:{_DOT}|\.)[a-z]{{2,24}}(?![a-z0-9-])(?:(?:{_DOT}|\.)[a-z]{{2,24}}(?![a-z0-9-]))*")
_DOT_BEFORE = re.compile(rf"(?i)[a-z0-9]{_DOT}$")
_DOT_HINTS = ("dot", "punto", "punkt", "point", "[.", "(.", "{.", "<.", "[ .", "( .", "{ .", "< .")
_AT_HINTS = ("[at", "(at", "<at", "{at", "[ at", "( at", "{ at", "< at", "_at_", "-at-", "arroba")
#: Where a text may hold what the first transducer changes: anything but ASCII, Latin letters and common punctuation.
_UNUSUAL = re.compile("[^\x00-\xa9\xab\xac\xae-\xb1\xb4-\xb6\xb8\xbb-\u0130\u0132-\u017f\u2018-\u201f\u2026]")
# Endings that a host written with the bare words at and dot must have.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv eu us uk ie ca au nz in de at ch fr be nl lu es pt it pl cz se no dk fi ru ua cn jp kr br mx ar example test invalid "
    "online site shop store xyz club tech blog cloud news live world email pro mobi asia jobs travel museum cat coop aero post tel page link website space digital agency media design group team today life solutions services systems network works studio consulting "
    "ac ad ae al am ba bd bg bo by cl cm cr cu cy cz do dz ec ee eg fo ge gh gr gt hk hn hr hu id il ir jm jo ke kg kh kw kz la lb li lk lt lv ma mc md mk mn mt my ng ni np om pa pe ph pk pr ps py qa ro rs sa sg si sk sm sn sv sy th tn tr tw tz ug uy uz va ve vn ye za zm zw".split())
_IP_DOT = re.compile(rf"(?i)(?<=[0-9]){_DOT}(?=[0-9])")


class Mapped:
    """A rewritten text and, for each of its characters, where its source starts and ends, and whether it was rewritten."""

    __slots__ = ("changed", "end", "start", "text")

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, range(len(text)), range(1, len(text) + 1), None

    def fold(self) -> None:
        out = self.text.translate(_FOLD)
        if out != self.text:
            kept = [i for i, c in enumerate(self.text) if _FOLD[ord(c)] is not None]
            gone = len(kept) != len(self.text)
            self.changed = [_FOLD[ord(self.text[i])] != self.text[i] or (gone and i + 1 < len(self.text) and _FOLD[ord(self.text[i + 1])] is None) for i in kept]
            self.start, self.end, self.text = kept, [i + 1 for i in kept], out

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put other strings for spans of the text, given in order."""
        if not edits:
            return
        old = self.changed or [False] * len(self.text)
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, to in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            changed += old[at:a]
            if to:
                text.append(to)
                start += [self.start[a]] * len(to)
                end += [self.end[b - 1]] * len(to)
                changed += [True] * len(to)
            at = b
        self.text, self.start, self.end, self.changed = "".join(text), start, end, changed


def _digits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "".join(_DIGITS[w.lower()] for w in _EACH.findall(m[0]))) for m in _SPELLED.finditer(text)]


def _spelled(low: str) -> bool:
    """Whether a digit word stands beside another, a numeral or a spelled sign."""
    words = low.translate(_APART).split() if "-" in low or "," in low else low.split()
    if _NEAR.isdisjoint(words):
        return False
    return any(w in _DIGITS and any(x in _NEAR or x[:1].isdigit() or x[-1:].isdigit() or x[:1] == "+" for x in (words[i - 1] if i else "", *words[i + 1 : i + 2])) for i, w in enumerate(words))


def _before_dot(text: str, start: int, least: int) -> int:
    """From where a disguised dot that ends at ``start`` may begin, and the character before it: two runs of white space and ten others."""
    for room in (10, 2):
        while start > least and text[start - 1].isspace():
            start -= 1
        start = max(least, start - room)
    return start


def _head(text: str, at: int, least: int) -> int:
    """Where the local part that ends at ``at`` begins, disguised dots included; ``at`` if there is none."""
    start = at
    while True:
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOT_BEFORE.search(text, _before_dot(text, start, least), start) if start < at else None
        if not m:
            return start
        start = m.start() + 1  # after the letter before the dot, which the next round takes in


def _at_dot(text: str) -> list[tuple[int, int, str]]:
    """Edits that undo at/dot disguises; a bare word ``at`` counts only before a disguised dot and a usual ending."""
    edits, free = [], 0
    for m in _AT.finditer(text):
        if m.start() < free:
            continue
        tail = _TAIL.match(text, m.end())
        if not tail:
            continue
        start = _head(text, m.start(), free)
        if start == m.start():
            continue
        dots = list(_HIDDEN_DOT.finditer(tail[0]))
        bare = _BARE_AT.fullmatch(m[0])
        if bare and not (dots and tail[0][dots[-1].end() :].rsplit(".", 1)[-1].lower() in _ENDINGS):
            continue
        edits += [(start + d.start(), start + d.end(), ".") for d in _HIDDEN_DOT.finditer(text[start : m.start()])]
        if m[0] != "@":
            edits.append((*m.span(), "@"))
        edits += [(m.end() + d.start(), m.end() + d.end(), ".") for d in dots]
        free = tail.end()
    return edits


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of one text as (kind, start, end, added), by kind, then start."""
    if not text:
        return []
    base = detect(text)
    found = [(*x, False) for x in base]
    t = Mapped(text)
    if not text.isascii() and _UNUSUAL.search(text):
        t.fold()
    low = t.text.lower()
    if _spelled(low):
        t.replace(_digits(t.text))
        t.replace([(*m.span(), "+") for m in _PLUS.finditer(t.text)])
    dots = any(x in low for x in _DOT_HINTS)
    if (dots and ("@" in low or "at" in low or "arroba" in low)) or any(x in low for x in _AT_HINTS) or " @" in low or "@ " in low:
        t.replace(_at_dot(t.text))
    if dots:
        t.replace([(*m.span(), ".") for m in _IP_DOT.finditer(t.text)])
    if t.changed:
        known = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}  # in order, none over another
        starts, last = {k: [a for a, _ in v] for k, v in known.items()}, dict.fromkeys(KINDS, (0, -1))
        for kind, a, b in detect(t.text):
            if any(t.changed[a:b]):
                a, b = t.start[a], t.end[b - 1]
                i = bisect_right(starts[kind], a) - 1
                inside = (i >= 0 and b <= known[kind][i][1]) or (last[kind][0] <= a and b <= last[kind][1])
                if not inside:
                    last[kind] = a, b
                    found.append((kind, a, b, True))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _as_structs(found: list) -> list[dict]:
    return [{"kind": k, "start": a, "end": b, "added": x} for k, a, b, x in found]


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``spans``, an array of (kind, start, end, added)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_as_structs(spans(x.as_py())) for x in batch.column(1)], _ARROW_SPANS)], names=[id_col, "spans"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, spans {SPANS_TYPE}")


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    if not text or not (found := sorted((a, b, k) for k, a, b, _ in spans(text))):
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        a, b, k = found[i]
        while i + 1 < len(found) and found[i + 1][0] < b:
            i += 1
            b = max(b, found[i][1])
        out += [text[at:a], f"<{k.upper()}>"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``text_col`` masked."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            kind = batch.schema.field(i).type
            yield batch.set_column(i, batch.schema.field(i), pa.array([masked(x.as_py()) for x in batch.column(i)], kind))

    return docs.mapInArrow(run, docs.schema)


def _joined(of) -> F.Column:
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(found, kind: str) -> F.Column:
    return F.filter(found, lambda x: x["kind"] == kind)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    from seqspark.llm.shared import table

    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: ~x["added"])
    return found.select(
        "doc_id",
        *(F.size(_of_kind(base, k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["added"])).cast("long").alias("n_added"),
    )
