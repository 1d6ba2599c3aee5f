from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest

from rookery.llm import html_text as H
from rookery.llm.common import read


def article(page):
    """Brute force for pages that mark their article and have no nested blocks in it."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1)>", found)]
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def pages(spark):
    return read(spark, "/root/testdata/sf0.01", "pages")


@pytest.fixture(scope="module")
def model(pages):
    return H.learn([r["html"] for r in pages.orderBy("page_id").limit(120).collect()])


def extract(model, page):
    nodes = H.parse(page)
    blocks = [H.own_blocks(n) for n in nodes]
    odds = model.scores(H.describe([(nodes, blocks)]))
    kept = H.decode(nodes, odds)
    assert all(kept[n.parent] for i, n in enumerate(nodes) if kept[i] and i)
    return H.text_of(nodes, blocks, kept)


def test_unseen_pages(model, pages):
    rows = [r["html"] for r in pages.orderBy("page_id").collect()][120:]
    assert np.mean([extract(model, p) == article(p) for p in rows]) > 0.97


def test_unseen_frames(model, pages):
    """Sidebars, notices, comments and the like around articles under other names."""
    rows = [r["html"] for r in pages.orderBy("page_id").collect()][120:]
    made = [v for v in H.variants(rows, seed=11)][1::2]
    assert np.mean([extract(model, page) == article(f"<article>{text}</article>") for page, text in made]) > 0.93


def test_query(spark, pages):
    rows = H.main_text(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    texts = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert np.mean([r["text"] == texts[r["page_id"]] for r in rows]) > 0.98


def test_parser():
    nodes = H.parse("<body><p>one<b> two<br>three &amp; &eacute;<p>four<ul><li>a<li>b<ul><li>c</ul></ul>tail<script>var x='</p>'</script><!-- <p>no --> end")
    lines = H.text_of(nodes, [H.own_blocks(n) for n in nodes], np.ones(len(nodes), bool)).split("\n")
    assert lines == ["one two three & é", "four", "a", "b", "c", "tail end"]


@pytest.mark.parametrize("tag, kept", [
    ("<svg class=x />", True), ("<svg/>", True), ("<svg>", True), ("<noscript>", True), ("<template>", True), ("<iframe src=x>", True), ("<object data=x>", True),
    ("<script>", False), ("<style>", False), ("<textarea>", False), ("<title>", False),
])
def test_parser_without_an_end_tag(tag, kept):
    nodes = H.parse(f"<body><p>before</p>{tag}<p>after</p></body>")
    lines = H.text_of(nodes, [H.own_blocks(n) for n in nodes], np.ones(len(nodes), bool)).split("\n")
    assert [x for x in lines if x == "after"] == ["after"] * kept and lines[0] == "before"


def test_parser_keeps_text_between_an_empty_svg_and_a_later_one():
    nodes = H.parse("<body><svg width=1 /><p>one</p><svg><text>no</text></svg><p>two</p></body>")
    assert H.text_of(nodes, [H.own_blocks(n) for n in nodes], np.ones(len(nodes), bool)).split("\n") == ["one", "two"]


@pytest.mark.parametrize("name", ["noscript", "object", "svg", "template", "iframe"])
def test_parser_keeps_text_between_an_unclosed_tag_and_a_closed_one(name):
    nodes = H.parse(f"<body><{name}><p>one</p><{name}>no</{name}><p>two</p><script>'<{name}>'</script><p>three</p></body>")
    assert H.text_of(nodes, [H.own_blocks(n) for n in nodes], np.ones(len(nodes), bool)).split("\n") == ["one", "two", "three"]


def test_parser_drops_nested_objects_whole():
    nodes = H.parse("<body><p>one</p><object>a<object>b</object>c</object><p>two</p></body>")
    assert H.text_of(nodes, [H.own_blocks(n) for n in nodes], np.ones(len(nodes), bool)).split("\n") == ["one", "two"]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(40):
        nodes = [H.Node("div", -1, 0)]
        for _ in range(7):
            p = int(rng.integers(len(nodes)))
            nodes.append(H.Node("div" if rng.random() < 0.8 else "nav", p, nodes[p].depth + 1))
        odds = rng.normal(size=len(nodes))
        best = 0.0
        for choice in itertools.product((False, True), repeat=len(nodes)):
            if all(not k or (n.tag not in H.NEVER and (n.parent < 0 or choice[n.parent])) for k, n in zip(choice, nodes)):
                best = max(best, sum(o for o, k in zip(odds, choice) if k))
        assert abs(odds[H.decode(nodes, odds)].sum() - best) < 1e-9


def test_boosting_fits_an_exclusive_or():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    assert np.mean((H.boost(x, y).scores(x) > 0) == y) > 0.95


def test_odd_rows(spark, pages):
    deep = "<div>" * 3000 + "x" * 50 + "</div>" * 3000
    wide = "<ul>" + "<li>y" * 5000
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text"), (4, None, deep), (5, "u", wide), (6, "u", "<"), (7, "u", "</p></div><p"), (8, "u", "<p " + "a" * 9999), (8, "u", "<nav>only menus</nav>")]
    odd = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.main_text(odd.unionByName(pages.selectExpr("page_id + 1000 AS page_id", "url", "html", "'c' AS text", "0 AS n_chars"))).where("page_id < 1000").collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got if r["page_id"] < 3} == {1: "", 2: ""}
    alone = {r["page_id"]: r["text"] for r in H.main_text(odd.where("page_id IN (3, 5)")).collect()}
    assert alone[3] == "plain text" and alone[5].count("y") == 5000
    assert H.main_text(odd.limit(0)).count() == 0
