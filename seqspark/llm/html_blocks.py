"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block has a vector: hashed
tag path (names, classes and ids of the elements around it), hashed words, and
a few measures such as link density. A bidirectional LSTM in numpy reads the
whole sequence, so every block is judged in the context of its page, and gives
each block the probability of being part of the article.

It is trained here, on at most ``max_pages`` pages (those with the smallest
hash of their id) and ``max_blocks`` blocks of each (extraction reads all): blocks get weak labels from the meaning of HTML5 elements and of
common class names, and the same blocks are also dealt into other layouts
(comment threads, side bars, notices, forms, pages of plain divs), in part with
names of elements and classes left out, so that context has to be used.

Defined cases: null or empty html gives an empty text; unclosed and stray tags
are taken as browsers do, roughly; repeated rows each get a row; extra columns
are ignored; without training pages the generated layouts stand alone.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import least_by_hash, table

PATH_DIM, WORD_DIM = 96, 48
DIM = PATH_DIM + WORD_DIM + 8
HIDDEN = 20
DEEP = 64  # a block is described by as many elements from either end of its path; its text is never cut

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>|[^<]++|<", re.S)
_OPENS = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "iframe", "xmp"}  # what they hold is no markup; that of xmp is text
_RAW_END = {t: re.compile(rf"(?i)</{t}\b[^>]*>") for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul label".split())
_CLOSES_P = _BLOCK - {"button", "label", "option", "body", "head", "html", "title"}
_HEADLESS = {"head", "title", "option", "select"}
_IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())  # any other start tag, and any text, ends a head
#: Elements whose end tag may be left out: what else they close when they open, and up to where.
_LISTS, _ROWS, _ENTRIES = ("ul", "ol", "menu"), ("table", "tbody", "thead", "tfoot"), ("dl",)
_ENDS = {"li": (("li",), _LISTS), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), _ROWS), "dt": (("dt", "dd"), _ENTRIES), "dd": (("dt", "dd"), _ENTRIES), "option": (("option",), ("select",))}
_P_SCOPE = ("ul", "ol", "table", "td", "th", "div", "section", "article", "body")


class Block:
    __slots__ = ("linked", "path", "text", "words")

    def __init__(self, text: str, words: list[str], path: tuple, linked: int):
        self.text, self.words, self.path, self.linked = text, words, path, linked


class _TagEnds:
    """Where tags end that have other tags or unclosed quotes in them, in one pass over the page.

    Between a tag's quotes, the same place always leads to the same end; so
    places from which a tag has been found not to end are kept.
    """

    def __init__(self, page: str):
        self.page, self.dead, self.near = page, set(), (0, -1)

    def find(self, at: int) -> int:
        """The place of the > that ends a tag, looking from ``at``; -1 if it never ends."""
        page, seen = self.page, []
        a, stop = self.near
        if not a <= at <= stop:
            found = _STOP.search(page, at)
            stop = found.start() if found else len(page)
            self.near = at, stop
        while stop < len(page) and stop not in self.dead:
            if page[stop] == ">":
                return stop
            seen.append(stop)
            close = page.find(page[stop], stop + 1)
            if close < 0:
                break
            found = _STOP.search(page, close + 1)
            stop = found.start() if found else len(page)
        self.dead.update(seen)
        return -1


class _Open:
    """The open elements, with the places of each name."""

    def __init__(self):
        self.stack: list[tuple[str, tuple]] = []
        self.places: dict[str, list[int]] = {}

    def path(self) -> tuple:
        """All open elements; of more than twice DEEP, the DEEP outermost and innermost ones."""
        return tuple(self.stack) if len(self.stack) <= 2 * DEEP else (*self.stack[:DEEP], *self.stack[-DEEP:])

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name; -1 if none is open."""
        x = self.places.get(name)
        return x[-1] if x else -1

    def implied(self, names: tuple, scope: tuple) -> int:
        """The innermost open element of ``names``, unless one of ``scope`` is open inside it; else -1."""
        i = -1
        for n in names:
            if (x := self.places.get(n)) and x[-1] > i:
                i = x[-1]
        if i >= 0:
            for n in scope:
                if (x := self.places.get(n)) and x[-1] > i:
                    return -1
        return i

    def push(self, name: str, names: tuple) -> None:
        if (x := self.places.get(name)) is None:
            x = self.places[name] = []
        x.append(len(self.stack))
        self.stack.append((name, names))

    def cut(self, i: int) -> list[str]:
        """Close element i and all in it."""
        if i == len(self.stack) - 1:
            gone = [self.stack.pop()[0]]
        else:
            gone = [name for name, _ in self.stack[i:]]
            del self.stack[i:]
        for name in gone:
            self.places[name].pop()
        return gone


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: text, words, path of (element, names) and characters inside links."""
    out: list[Block] = []
    if not page:
        return out
    tree, ends = _Open(), _TagEnds(page)
    parts: list[str] = []
    linked = links = hidden = 0

    def flush():
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words and not hidden:
                out.append(Block(" ".join(words), words, tree.path(), linked))
            parts, linked = [], 0

    def pop_to(i):
        nonlocal links, hidden
        for name in tree.cut(i):
            links -= name == "a"
            hidden -= name in _HEADLESS

    def text(x):
        nonlocal linked
        parts.append(x)
        linked += len(x) if links else 0

    at, match = 0, _TOKEN.match
    while at < len(page):
        m = match(page, at)
        slash, name, rest = m[1], m[2], m[3]
        if name is None and m[0] == "<" and (m := _OPENS.match(page, at)) and (end := ends.find(m.end())) >= 0:
            slash, name, rest, at = m[1], m[2], page[m.end() : end], end + 1
        elif name is None:
            word = m[0] if m else "<"
            if m is None or word[0] != "<" or word == "<":
                if tree.stack and tree.stack[-1][0] == "head" and word.strip():
                    flush()
                    pop_to(len(tree.stack) - 1)
                text(word if m else "<")
            at = m.end() if m else at + 1
            continue
        else:
            at = m.end()
        name = name.lower()
        if slash:
            if name in _BLOCK:
                flush()
            if (i := tree.last(name)) >= 0:
                pop_to(i)
            continue
        if name not in _IN_HEAD and (i := tree.last("head")) >= 0 and tree.last("title") < i:
            flush()
            pop_to(i)
        if name == "head" and (tree.last("body") >= 0 or tree.last("head") >= 0):
            continue
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            if name == "xmp":
                flush()
                text(html.escape(page[at : end.start() if end else len(page)]))
            if name in ("textarea", "xmp"):
                flush()
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            flush()
            if name == "body":
                pop_to(0)
            else:
                if name in _CLOSES_P and (i := tree.implied(("p",), _P_SCOPE)) >= 0:
                    pop_to(i)
                if name in _ENDS and (i := tree.implied(*_ENDS[name])) >= 0:
                    pop_to(i)
        if name in _VOID or rest.endswith("/") and (tree.last("svg") >= 0 or tree.last("math") >= 0 or name in ("svg", "math")):
            continue
        names = tuple(w for a in _ATTR.finditer(rest) for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())) if rest else ()
        tree.push(name, names)
        links += name == "a"
        hidden += name in _HEADLESS
    flush()
    return out


_SLOT: dict[str, tuple[int, float]] = {}


def _slot(word: str, dim: int, space: str) -> tuple[int, float]:
    if (got := _SLOT.get(space + word)) is None:
        h = zlib.crc32((space + word).encode("utf-8", "surrogatepass"))
        got = (h >> 1) % dim, 1.0 if h & 1 else -1.0
        if len(_SLOT) < 200_000:
            _SLOT[space + word] = got
    return got


class _Words(dict):
    """Word -> twice its slot, plus 1 where its sign is positive."""

    def __missing__(self, word: str) -> int:
        i, s = _slot(word, WORD_DIM, "word:")
        code = 2 * i + (s > 0)
        if len(self) < 200_000:
            self[word] = code
        return code


_WORDS = _Words()


def word_sums(page: list[Block]) -> np.ndarray:
    """Signed counts of the hashed words of every block."""
    sizes = [len(b.words) for b in page]
    code = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(b.text.lower().split(" ") for b in page)), np.int64, sum(sizes))
    row = np.repeat(np.arange(len(page)), sizes)
    return np.bincount(row * WORD_DIM + (code >> 1), 2.0 * (code & 1) - 1, len(page) * WORD_DIM).reshape(-1, WORD_DIM)


def vectors(page: list[Block], drop=None) -> np.ndarray:
    """One row of DIM numbers per block. ``drop(name)`` leaves out names of elements and classes, in training."""
    out = np.zeros((len(page), DIM))
    if page:
        out[:, PATH_DIM : PATH_DIM + WORD_DIM] = word_sums(page)
    seen: dict[tuple, np.ndarray] = _PATHS if drop is None else {}
    if len(seen) > 20_000:
        seen.clear()
    paths, measures = [], []
    for r, b in enumerate(page):
        if (row := seen.get(b.path)) is None:
            row = seen[b.path] = _path_row(b.path, drop)
        paths.append(row)
        n, text = len(b.words), b.text
        measures.append((math.log1p(n) / 3, math.log1p(len(text)) / 5, min(1.0, b.linked / max(1, len(text))), text[-1] in ".!?…", (text.count(".") + text.count(",") + text.count(";")) / n, r / len(page), (len(page) - r) / len(page), text[:1] == "©" or "copyright" in text[:40].lower()))
    if page:
        out[:, :PATH_DIM] = paths
        out[:, -8:] = measures
        out[:, PATH_DIM : PATH_DIM + WORD_DIM] /= np.array([len(b.words) for b in page])[:, None]
    return out


_PATHS: dict[tuple, np.ndarray] = {}


def _path_row(path: tuple, drop) -> np.ndarray:
    row = np.zeros(PATH_DIM)
    for depth, (name, names) in enumerate(path[::-1]):
        if depth < 2 and not (drop and drop(name)):
            i, s = _slot(name, PATH_DIM, "own:" if depth == 0 else "up:")
            row[i] += s
        for x in (name, *names):
            if not (drop and drop(x)):
                i, s = _slot(x, PATH_DIM, "path:")
                row[i] += s
    return np.clip(row, -2, 2)


class Labeller:
    """A bidirectional LSTM over blocks with one logistic output each."""

    NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "wo", "bo")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"wo": r.normal(0, 0.3, 2 * h), "bo": np.zeros(1)}
        for d in "fb":
            self.p |= {"w" + d: r.normal(0, 1 / np.sqrt(DIM), (DIM, 4 * h)), "u" + d: r.normal(0, 1 / np.sqrt(h), (h, 4 * h)), "b" + d: np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}

    def _run(self, z: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
        """z[time, page, 4 * hidden]: gates in the order input, forget, output, candidate."""
        steps, n, _ = z.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, tape = np.zeros((steps, n, HIDDEN)), []
        for t in range(steps):
            g = z[t] + h @ u
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            a = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * a
            th = np.tanh(new)
            if keep:
                tape.append((h, c, i, f, o, a, th))
            m = mask[t][:, None]
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x[time, page, DIM], mask[time, page] -> probabilities[time, page]."""
        p = self.p
        f, tf = self._run(x @ p["wf"] + p["bf"], p["uf"], mask, keep)
        b, tb = self._run((x @ p["wb"] + p["bb"])[::-1], p["ub"], mask[::-1], keep)
        both = np.concatenate([f, b[::-1]], -1)
        prob = 1 / (1 + np.exp(-np.clip(both @ p["wo"] + p["bo"], -30, 30)))
        return (prob, both, tf, tb) if keep else prob

    def _back(self, dout, tape, u, mask):
        steps, n, _ = dout.shape
        dz, du = np.zeros((steps, n, 4 * HIDDEN)), np.zeros_like(u)
        dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, a, th = tape[t]
            m = mask[t][:, None]
            dh = dh + dout[t]
            dnew = m * (dc + dh * o * (1 - th**2))
            dg = np.concatenate([dnew * a * i * (1 - i), dnew * c * f * (1 - f), m * dh * th * o * (1 - o), dnew * i * (1 - a**2)], 1)
            dz[t] = dg
            du += h.T @ dg
            dh = dg @ u.T + (1 - m) * dh
            dc = dnew * f + (1 - m) * dc
        return dz, du

    def gradients(self, x, mask, y) -> tuple[dict, float]:
        p = self.p
        prob, both, tf, tb = self.forward(x, mask, True)
        n = mask.sum()
        d = (prob - y) * mask / n
        g = {"wo": np.einsum("tn,tnh->h", d, both), "bo": np.array([d.sum()])}
        dboth = d[..., None] * p["wo"]
        dzf, g["uf"] = self._back(dboth[..., :HIDDEN], tf, p["uf"], mask)
        dzb, g["ub"] = self._back(dboth[..., HIDDEN:][::-1], tb, p["ub"], mask[::-1])
        dzb = dzb[::-1]
        for k, dz in (("f", dzf), ("b", dzb)):
            g["w" + k] = np.einsum("tnd,tng->dg", x, dz, optimize=True)
            g["b" + k] = dz.sum((0, 1))
        loss = -(mask * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / n
        return g, float(loss)

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, rate: float = 0.01, seed: int = 7) -> float:
        """Adam over batches of pages of like length."""
        r = np.random.default_rng(seed)
        first, second, step, loss = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, 0.0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [order[i : i + 24] for i in range(0, len(order), 24)]
        for epoch in range(epochs):
            lr = rate * (1 - epoch / epochs) + 1e-4
            for k in r.permutation(len(groups)):
                x, mask = padded([pages[i] for i in groups[k]])
                y = padded([labels[i][:, None] for i in groups[k]])[0][..., 0]
                g, loss = self.gradients(x, mask, y)
                step += 1
                size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                for name, v in g.items():
                    v = v * min(1.0, 5.0 / (size + 1e-9)) + 1e-5 * self.p[name]
                    first[name] = 0.9 * first[name] + 0.1 * v
                    second[name] = 0.999 * second[name] + 0.001 * v**2
                    self.p[name] = self.p[name] - lr * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return loss

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities of every block of every page; pages of like length go together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            part = order[at : at + 64]
            while len(part) > 1 and len(pages[part[-1]]) > 1.5 * len(pages[part[0]]) + 8:
                part.pop()
            at += len(part)
            prob = self.forward(*padded([pages[i] for i in part]))
            for k, i in enumerate(part):
                out[i] = prob[: len(pages[i]), k]
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), rows[0].shape[1])), np.zeros((steps, len(rows)))
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


# Names that mark what is not the article.
_ASIDE = set("nav menu navbar navigation header masthead footer bottom sidebar aside side widget related cookie consent notice banner alert popup modal overlay newsletter subscribe signup login ad ads advert advertisement adverts sponsor sponsored promo promotion comment comments reply replies respond disqus discussion share social breadcrumb breadcrumbs pagination pager tags search form copyright legal toolbar skip".split())
_ARTICLE = set("article main content post entry story body text".split())
_ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label", "legend"}


def weak_label(block: Block) -> int:
    """1 if the elements around the block say article and none says otherwise."""
    inside = 0
    for name, names in block.path:
        if name in ("article", "main") or (name in ("div", "section") and not _ARTICLE.isdisjoint(names)):
            inside = 1
        if (name in _ASIDE_TAGS and not (name == "header" and inside)) or (name != "body" and not _ASIDE.isdisjoint(names)):
            return 0
    return inside


def layouts(page: list[Block], label: list[int], r: np.random.Generator, max_blocks: int = 400) -> tuple[list[Block], list[int]]:
    """The blocks of one page dealt into another layout, with their labels."""
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    good, bad = [b for b, y in zip(page, label) if y], [b for b, y in zip(page, label) if not y]
    good, bad = good or page, bad or page
    root = (("html", ()), ("body", ()))
    wrap = (("div", pick([("wrapper",), ("page",), ("container",), ()])),) if r.random() < 0.5 else ()
    out: list[Block] = []
    ys: list[int] = []

    def put(text_of: Block, path, y, words=None, linked=0):
        words = words or text_of.words
        out.append(Block(" ".join(words), words, root + wrap + tuple(path), linked))
        ys.append(y)

    def short(b: Block, most=8):
        k = int(r.integers(1, most))
        s = int(r.integers(max(1, len(b.words) - k + 1)))
        return b.words[s : s + k]

    def menu(path, most=8):
        for _ in range(int(r.integers(2, most))):
            words = short(pick(page), 3)
            put(page[0], [*path, ("ul", ()), ("li", ()), ("a", ())], 0, words, len(" ".join(words)))

    def lines(path, most, tag=("p", "div")):
        for _ in range(int(r.integers(1, most))):
            put(page[0], [*path, (pick(list(tag)), ())], 0, short(pick(page), 25))

    if r.random() < 0.4:
        lines([("div", (pick(["cookie", "notice", "banner", "consent", "alert"]), pick(["bar", "box"])))], 3)
    if r.random() < 0.6:
        head = ("header", ()) if r.random() < 0.6 else ("div", (pick(["header", "masthead", "top"]),))
        put(page[0], [head, (pick(["h1", "a", "div", "p"]), ())], 0, short(pick(page), 5))
        if r.random() < 0.5:
            menu([head, ("nav", ())])
    if r.random() < 0.6:
        menu([("nav", ()) if r.random() < 0.5 else ("div", (pick(["nav", "menu", "navigation"]),))])
    if r.random() < 0.3:
        lines([("aside", ()) if r.random() < 0.5 else ("div", (pick(["sidebar", "widget", "related"]),))], 5)
    if r.random() < 0.4:
        lines([("div", (pick(["ad", "ads", "advert", "sponsored", "promo"]),))], 3)
    body = pick([[("article", ())], [("main", ())], [("main", ()), ("article", ())], [("div", ("content",))], [("div", ("post", "body"))], [("div", ("entry", "content"))], [("article", ()), ("div", ("text",))], [("section", ("story",))], [("div", ("main",)), ("div", ("article",))], [("div", ("article",))]])
    if r.random() < 0.8:
        put(good[0], [*body, (pick(["h1", "h1", "h2"]), ())], 1, short(good[0], 12))
    for b in good[:max_blocks]:
        tag = pick(["p", "p", "p", "p", "li", "blockquote", "h2", "h3", "td", "pre", "div"])
        words = short(b, 9) if tag in ("h2", "h3") or r.random() < 0.1 else b.words
        put(b, [*body, *([("ul", ())] if tag == "li" else []), (tag, ()), *([("b", ())] if r.random() < 0.1 else [])], 1, words)
        x = r.random()
        if x < 0.06:
            lines([*body, ("div", (pick(["ad", "advert", "promo", "newsletter", "related", "share"]),))], 3)
        elif x < 0.09:
            lines([*body, ("aside", ())], 3)
    if r.random() < 0.5:
        where = body if r.random() < 0.4 else []
        thread = ("section", ("comments",)) if r.random() < 0.5 else ("div", (pick(["comments", "comment", "discussion", "replies"]),))
        for _ in range(int(r.integers(1, 8))):
            put(good[0], [*where, thread, (pick(["div", "li", "article"]), (pick(["comment", "reply"]),)), (pick(["p", "div"]), ())], 0, short(pick(page), 40))
    if r.random() < 0.4:
        lines([("form", ()) if r.random() < 0.6 else ("div", (pick(["subscribe", "login", "newsletter", "search"]),))], 4, ("label", "button", "p", "div"))
    if r.random() < 0.3:
        lines([("aside", ()) if r.random() < 0.5 else ("div", (pick(["sidebar", "related", "widget"]),))], 6)
    if r.random() < 0.85:
        foot = ("footer", ()) if r.random() < 0.6 else ("div", (pick(["footer", "bottom", "copyright", "legal"]),))
        put(page[0], [foot, (pick(["p", "div", "small"]), ())], 0, ["©", *short(pick(page), 10)] if r.random() < 0.6 else short(pick(page), 15))
        if r.random() < 0.4:
            menu([foot], 5)
    return out, ys


_SEED_PAGE = "<body><nav><ul><li><a>home</a></li><li><a>news</a></li></ul></nav><article><h1>A title of some words</h1>" + "<p>Some words of plain prose, which stand for an article, and a few more of them.</p>" * 4 + "</article><footer>All rights reserved</footer></body>"


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 250, max_blocks: int = 400, copies: int = 3, seed: int = 7) -> Labeller:
    """Fit on at most ``max_pages`` pages, the first ``max_blocks`` blocks of each, and ``copies`` other layouts of them."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("html IS NOT NULL")
    taken = [r["html"] for r in least_by_hash(rows, "id", max_pages, F.length("html")).collect()]
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for page in taken or [_SEED_PAGE]:
        found = blocks(page)[:max_blocks]
        if not found:
            continue
        label = [weak_label(b) for b in found]
        if any(label):
            xs.append(vectors(found))
            ys.append(np.array(label, float))
            xs.append(vectors(found, lambda _: r.random() < 0.1))
            ys.append(ys[-1])
        for k in range(copies):
            some, y = layouts(found, label, r, max_blocks)
            xs.append(vectors(some, (lambda _: r.random() < 0.15) if k else None))
            ys.append(np.array(y, float))
    model = Labeller(seed)
    if xs:
        model.fit(xs, ys)
    return model


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """One row per page: the id, ``text`` (blocks of the article, one a line) and ``n_blocks`` (of the page)."""
    rows = pages.select(F.col(id_col), F.col(html_col).alias("_html"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks(x) for x in part.column(1).to_pylist()]
                keep = model.label([vectors(x) for x in found])
                texts = ["\n".join(b.text for b, p in zip(bs, ps) if p > threshold) for bs, ps in zip(found, keep)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[id_col, "text", "n_blocks"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string, n_blocks long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = train(pages)
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    return extract(keyed, model, "page").select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))
