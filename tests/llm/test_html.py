"""The block labeller: linear parsing of broken pages, whole stacks, gradients, and layouts it was not written for."""

import html
import random
import time

import numpy as np
import pandas as pd
import pytest

from seqspark.llm import html_blocks as H


@pytest.mark.parametrize("page", ["<div" * 250_000, '<a "' * 250_000, "<a '\"" * 200_000, "<a " * 300_000 + '">', "<p><div>" + "<span>" * 80_000 + "<h1>" * 80_000, "<div>x" * 100_000, "</div>" * 150_000, "<!--" * 200_000, "<script>" * 100_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    H.blocks(page)
    assert time.process_time() - began < 20  # seconds; quadratic scans take many minutes


def test_stack_is_kept_whole():
    (one, foot) = H.blocks("<article><p>one" + "<span>" * 200 + "</article><footer>f</footer>")
    assert one.path[0][0] == "article" and [x for x, _ in foot.path] == ["footer"]
    for row in ("<tr><td>a<td>b", "<dt>a<dd>b", "<li>a<span>"):
        last = H.blocks(f"<div class=sidebar><table><dl><ul>{row * 300}</ul></dl></table></div><article><p>x</article>")[-1]
        assert [x for x, _ in last.path] == ["article", "p"]


def test_texts_of_all_elements_are_kept():
    page = "<p>Let <math><mi>x</mi></math> be.<object>o</object><noscript>n</noscript><p>a <xmp><b>&amp;</xmp> z < 5 <a href='x>y'>q</a> 1<2<style>p{}</style><script>'<p>no'</script><svg><text>s</text></svg>"
    assert " ".join(b.text for b in H.blocks(page)) == "Let x be.on a <b>&amp; z < 5 q 1<2s"


def test_optional_tags_may_all_be_left_out():
    """The same blocks whichever of the tags that HTML lets one leave out are there."""
    tags = ["<html>", "<head>", "</head>", "<body>", "</body>", "</html>", "</p>", "</li>", "</td>"]
    for bits in range(1 << len(tags)):
        on = {t: t if bits >> k & 1 else "" for k, t in enumerate(tags)}
        page = f"<!doctype html>{on['<html>']}{on['<head>']}<title>x <b></title><meta a=b><link rel=a><style>h1{{}}</style><script>'<p>'</script> {on['</head>']}{on['<body>']}<h1>T</h1><p>one{on['</p>']}<p>two <a href=http://x.org/>link</a> end{on['</p>']}<ul><li>a{on['</li>']}<li>b{on['</li>']}</ul><table><tr><td>c{on['</td>']}<td>d{on['</td>']}</table><div/>e</div>{on['</body>']}{on['</html>']}"
        found = H.blocks(page)
        assert [b.text for b in found] == ["T", "one", "two link end", "a", "b", "c", "d", "e"], page
        assert [b.linked for b in found] == [0, 0, 4, 0, 0, 0, 0, 0]
        assert [b.path[-1][0] for b in found] == ["h1", "p", "p", "li", "li", "td", "td", "div"]
    assert [b.text for b in H.blocks("<head><title>x</title>plain text<p>more")] == ["plain text", "more"]
    assert [b.text for b in H.blocks("<body><p>a<head><p>b")] == ["a", "b"]
    assert [b.text for b in H.blocks("<p>a<svg><path d='x'/><g/><text>s</text></svg><a href=y/>z</a>")] == ["asz"]


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    model = H.Labeller(1)
    x, mask = r.normal(size=(5, 3, H.DIM)), np.ones((5, 3))
    mask[3:, 1] = 0
    y = (r.random((5, 3)) < 0.5).astype(float)
    g, _ = model.gradients(x, mask, y)
    for name, p in model.p.items():
        for at in (np.unravel_index(k, p.shape) for k in r.integers(0, p.size, 4)):
            old, e = p[at], 1e-5
            losses = []
            for d in (e, -e):
                p[at] = old + d
                losses.append(model.gradients(x, mask, y)[1])
            p[at] = old
            assert abs((losses[0] - losses[1]) / (2 * e) - g[name][at]) < 1e-6, name


def _plain_page(r, words):
    """A page without any element or class name that means article; its article is a run of paragraphs in plain divs."""
    some = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    body = [some(15, 60).capitalize() + "." for _ in range(r.randint(4, 9))]
    links = "".join(f"<div><a href=#>{some(1, 2)}</a></div>" for _ in range(r.randint(4, 9)))
    inner = "".join(f"<p>{html.escape(x)}</p>" for x in body)
    return f"<html><body><div>{links}</div><div><div>{inner}</div></div><div class='footer'><p>© {some(2, 5)}</p></div></body></html>", body


def test_layouts_without_article(spark, sf):
    model = H.train(spark.read.parquet(f"{sf}/pages.parquet"))
    words = [w for t in pd.read_parquet(f"{sf}/documents.parquet").text.dropna().head(50) for w in t.lower().split() if w.isalpha()]
    r, good, found, said = random.Random(4), 0, 0, 0
    for _ in range(60):
        page, body = _plain_page(r, words)
        bs = H.blocks(page)
        kept = {b.text for b, p in zip(bs, model.label([H.vectors(bs)])[0]) if p > 0.5}
        want = {" ".join(x.split()) for x in body}
        good, found, said = good + len(want & kept), found + len(want), said + len(kept)
    print("recall", good / found, "precision", good / max(1, said))
    assert good / found > 0.8 and good / said > 0.8
