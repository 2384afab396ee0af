"""The minimum cut against all labellings of small graphs, and pages of many kinds."""

import itertools
import random
import re

import pytest

from voxmill.llm import html_extract as H


def cost(on, source, sink, edges):
    return sum(k if x else s for x, s, k in zip(on, source, sink, strict=True)) + sum(c for u, v, c in edges if on[u] != on[v])


def test_cut_is_minimal():
    r = random.Random(1)
    for _ in range(200):
        n = r.randrange(1, 8)
        source, sink = [[r.randrange(9) for _ in range(n)] for _ in range(2)]
        edges = [(u, v, r.randrange(1, 6)) for u in range(n) for v in range(u) if r.random() < 0.5]
        found = H.min_cut(source, sink, edges)
        assert cost(found, source, sink, edges) == min(cost(x, source, sink, edges) for x in itertools.product((False, True), repeat=n))


ARTICLE = "<article><h1>Title</h1><p>First &amp; long\n  paragraph, with <b>bold</b>words.</p><p>Second one.</p></article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<script>var a = '<p>no</p>';</script><style>p {}</style>", ""),
        (f"<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><header>Site</header>{ARTICLE}<footer>© All rights reserved</footer></body></html>", "Title First & long paragraph, with boldwords. Second one."),
        (f"<div class='cookie-notice'>We use cookies.</div>{ARTICLE}<aside class=sidebar><ul><li><a href=x>More</a></ul></aside><div id='comments'><p>Nice article, thank you very much for it.</p></div>", "Title First & long paragraph, with boldwords. Second one."),
    ],
)
def test_pages(page, text):
    assert H.extract_text(page) == text


def test_broken_markup_does_not_raise():
    r = random.Random(3)
    bits = ["<p>", "</p>", "<div", ">", "<", "&#x110000;", "&amp", "text ", "<!--", "-->", "<a href='", "'", "<script>", "</table>", "<li>", "\0"]
    for _ in range(300):
        H.extract_text("".join(r.choices(bits, k=r.randrange(40))))
    assert H.extract_text("<div>" * 3000 + "deep" + "</div>" * 3000).strip() in ("", "deep")


def test_rows_of_any_kind(spark):
    """Null and empty pages have an empty text; repeated rows stay; a column of an output's name is replaced."""
    rows = [(1, "u", None, "old"), (2, None, "", "old"), (3, "u", ARTICLE, "old"), (3, "u", ARTICLE, "old")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.extract(pages).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [0, 0, 57, 57] and [r.text for r in got[:2]] == ["", ""]
    assert H.extract(pages.limit(0)).count() == 0


def test_long_references_are_no_crash():
    page = f"<article><p>a &#{'9' * 5000}; b &#{'0' * 5000}65; &#x{'f' * 5000}; c &#1114112; &#8364;</p></article>"
    assert H.extract_text(page) == "a \ufffd b A \ufffd c \ufffd €"


SENTENCE = "This is a sentence of some length with a full stop at its end, as prose has."


def test_the_cut_decides_blocks_that_costs_alone_would_not():
    """A short line between paragraphs stays with them, though its own costs call it boilerplate; a plain cost comparison loses it."""
    page = f"<div><p>{SENTENCE}</p><p>{SENTENCE}</p><div>So there</div><p>{SENTENCE}</p><p>{SENTENCE}</p></div>"
    found = H.blocks(page)
    alone = [a >= b for a, b in (H.costs(*x, False) for x in found)]
    assert alone == [True, True, False, True, True] and H.label(found) == [True] * 5
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(6))
    assert H.extract_text(f"<div><ul>{links}</ul></div><div><p>{SENTENCE}</p></div>") == SENTENCE


def test_weights_are_fitted_on_containers(spark):
    pages = [(i, f"<nav><a href=x>Home {i}</a></nav><article><h1>Title</h1><p>{SENTENCE}</p><p>{SENTENCE}</p></article><footer>© x</footer>") for i in range(20)] + [(None, None), (3, "")]
    weights = H.fit(spark.createDataFrame(pages, "page_id long, html string"))
    assert weights != H.PLAIN and weights[2] < 0 < weights[4]
    prose, link = H.blocks(f"<div><p>{SENTENCE}</p></div><div><a href=x>More</a></div>")
    assert H.costs(*prose, False, weights)[0] > H.costs(*prose, False, weights)[1] and H.costs(*link, False, weights)[0] < H.costs(*link, False, weights)[1]
    assert H.fit(spark.createDataFrame([], "page_id long, html string")) == H.PLAIN


PROSE = "".join(f"<p>Paragraph {i}. {SENTENCE}</p>" for i in range(3))
TEXT = " ".join(f"Paragraph {i}. {SENTENCE}" for i in range(3))
MENU = "<ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li><li><a href=z>More</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{PROSE}</article></div>',
        f'<div id="page" class="header-fixed"><main>{PROSE}</main></div>',
        f'<form id="aspnetForm">{PROSE}</form>',
        f'<form id="aspnetForm"><nav>{MENU}</nav><div class="ad">Buy now, it is cheap today.</div><div>{PROSE}</div><footer>© 2020</footer></form>',
        f'<form><div class="content"><article>{PROSE}</article></div></form>',
        f'<div class="layout sidebar-left"><div class="sidebar">{MENU}</div><div class="main-content"><article>{PROSE}</article></div></div>',
        f'<div class="sidebar"><article>{PROSE}</article></div>',
        f'<div class="page-header">Site name</div><div class="content-with-sidebar"><main>{PROSE}</main><div class="cookie-notice">We use cookies here, as others do.</div></div>',
        f'<article>{PROSE}<aside>{SENTENCE}</aside></article><div id="comments"><article class="comment"><p>{SENTENCE}</p></article><article><p>{SENTENCE}</p></article></div>',
        f'<article>{PROSE}<div class="ad-slot">{SENTENCE}</div></article><aside><article><p>{SENTENCE}</p></article></aside>',
        f'<main>{PROSE}</main><div hidden><main>{SENTENCE}</main></div>',
        f'<nav>{MENU}</nav>{PROSE}<div class="comments">{PROSE}{PROSE}{PROSE}</div>',
    ],
)
def test_the_innermost_container_decides(page):
    assert H.extract_text(page) == TEXT


def test_paragraphs_without_their_element_and_menus_with_it():
    assert H.extract_text(f"<div><p><a href=x>Home</a></p><p><a href=y>About</a></p></div><div>{SENTENCE}</div><div>{SENTENCE}</div>") == f"{SENTENCE} {SENTENCE}"


def test_labels_are_the_cheapest_of_all_labellings():
    r = random.Random(8)
    bits = [f"<p>{SENTENCE}</p>", "<p>Home</p>", "<div class=ad>Buy.</div>", "<article><p>In it.</p>", "</article>", f"<div><div>{SENTENCE}</div>", "</div>", "<li><a href=x>Link</a></li>", "<aside>", "</aside>", "<h2>Head</h2>"]
    for _ in range(150):
        found = H.blocks("".join(r.choices(bits, k=r.randrange(1, 12))))[:9]
        if found:
            source, sink, edges = H.graph(found)
            assert cost(H.label(found), source, sink, edges) == min(cost(x, source, sink, edges) for x in itertools.product((False, True), repeat=len(found)))


def stripped(page):
    """The page without what its containers say."""
    page = re.sub(r"(</?)(?:article|main|nav|header|footer|aside|form)(?=[\s/>])", r"\1div", page, flags=re.I)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def agreement(pages, weights):
    """Share of blocks that get the label of their container once the containers are gone: by the costs alone, and by the cut; blocks that the cut changes."""
    n = alone = cut = changed = 0
    for page in pages:
        truth, bare = H.blocks(page), H.blocks(stripped(page))
        assert [x[0] for x in truth] == [x[0] for x in bare]
        source, sink, _ = H.graph(bare, weights)
        own, joint = [a >= b for a, b in zip(source, sink, strict=True)], H.label(bare, weights)
        for (_, _, node), a, b in zip(truth, own, joint, strict=True):
            if node.kind:
                n, alone, cut, changed = n + 1, alone + (a == (node.kind > 0)), cut + (b == (node.kind > 0)), changed + (a != b)
    return n, alone / n, cut / n, changed


def test_the_cut_raises_agreement_on_stripped_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = H.fit(pages.where("page_id % 5 <> 0"))
    held = [x.html for x in pages.where("page_id % 5 = 0").collect() if x.html]
    n, alone, cut, changed = agreement(held, weights)
    assert n > 500 and changed > 0 and cut > alone and cut > 0.95
