import html
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracekit.llm import html_text as H

MODEL = H.train(H.labelled_pages(300), steps=60)


def test_articles_of_the_given_pages(lspark):
    pages = lspark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = r["html"].split("<article>", 1)[1].split("</article>")[0]
        body = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body))
        assert got[r["page_id"]]["text"] == " ".join(html.unescape(body).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_held_out_layouts():
    pages = H.labelled_pages(150, seed=77)
    found = H.texts_of([p for p, _ in pages], MODEL)
    assert np.mean([a == b for a, (_, b) in zip(found, pages)]) > 0.8


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    tree = H.parse("<div><p>a<p class=ad>b</div><ul><li>c")
    f = H.forest([tree, H.parse("<p>x")])
    model = H.Model(rng.normal(size=H.N_WEIGHTS), rng.normal(size=(2, 2, 2)))
    p, _ = H.marginals(f, model)
    unary = np.bincount(f.node, model.weights[f.feature], minlength=len(f.parent))
    total, each = 0.0, np.zeros(len(f.parent))
    for y in itertools.product((0, 1), repeat=len(f.parent)):
        y = np.array(y)
        child = np.flatnonzero(f.parent >= 0)
        w = np.exp((unary * y).sum() + model.edges[f.is_leaf[child].astype(int), y[f.parent[child]], y[child]].sum())
        total, each = total + w, each + w * y
    assert np.allclose(p, each / total)


def test_parts_that_are_no_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Logo</a></header>
      <nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies.</div>
      <main><article><h1>A &amp; B</h1><p>First&nbsp;<b>bo</b>ld,<br>text &#233;.</p><script>var x = "<p>no</p>";</script>
      <div class="ads">Buy now!</div><p>Second paragraph, a bit longer than the first one.</p><!-- <p>hidden</p> --></article></main>
      <aside class="sidebar"><p>Other stories</p></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>I like it.</p></div></section>
      <form class="newsletter"><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 Us</footer></body></html>"""
    assert H.texts_of([page], H.train(H.labelled_pages())) == ["A & B First bold, text \u00e9. Second paragraph, a bit longer than the first one."]


def test_odd_pages(lspark):
    rows = [(None, None, None), (1, None, ""), (2, "u", "   "), (2, "u", "<"), (3, "u", "<p"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<!-- x"),
            (6, "u", '<p title="a>b'), (7, "u", "<article><p>" + "long text. " * 50_000), (8, "u", "</p></div></html>"), (9, "u", "<script>x")]
    pages = lspark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = H.extract(pages, MODEL).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[None] == by[1] == by[5] == by[9] == "" and len(by[7]) == 50_000 * 11 - 1
    assert H.extract(pages.limit(0), MODEL).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div", ">", "<a href='", "'", '"', "text", "<li>", "</ul>", "<td>", "<table>", "<!--", "-->", "<script>", "</script", "&amp", " ", "<h1>", "</svg>", "<svg>"]), max_size=30))
def test_any_markup_parses(parts):
    tree = H.parse("".join(parts))
    assert all(up < i for i, up in enumerate(tree.parent))
    assert all(t == " ".join(t.split()) and t for t in tree.text if t is not None)


def test_unclosed_skipped_elements_end():
    texts = lambda page: [t for t in H.parse(page).text if t is not None]
    assert texts("<html><head><title>T</title><article><p>Text</p></article></html>") == ["Text"]
    for tag in ("select", "object", "svg", "template", "map", "audio", "video"):
        assert texts(f"<div><p>a</p><div><{tag}>no</div><p>b</p></div>") == ["a", "b"]
        assert texts(f"<div><{tag}><div><p>no</p></div>no</{tag}>b</div>") == ["b"]


def test_nesting_takes_linear_time():
    import time

    def seconds(n):
        page = "<div>" * n + "<p>text</p><li>x</li>" * 20 + "</div>" * n
        start = time.perf_counter()
        tree = H.parse(page)
        assert len(tree.parent) > n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 14 * seconds(4_000)


def test_signs_count_over_the_whole_run():
    def signs(text):
        tree = H.parse(f"<p>{text}</p>")
        f = H.forest([tree])
        return H.LEAF_BASE + 15 in f.feature.tolist()

    assert signs("x " * 150 + "(c) 2024 copyright") and signs("copyright " + "x " * 150)
    assert signs(("word " * 70 + "copyright ") * 9)
    assert not signs("word " * 400 + "copyright") and not signs("copyright " + "word " * 400)
