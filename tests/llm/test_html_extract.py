"""Main text of pages: the given pages, whose article is marked, and pages in other shapes."""

import html
import math
import re
import time

import numpy as np
import pytest

from retort.llm import html_extract
from retort.llm.html_extract import extract, main_text, path_scores
from retort.llm.queries import op6_main_text

LONG = "A first sentence of the article, with commas. And a second one that goes on for a while; it has marks too. " * 3
MORE = "Another paragraph of running text follows here, and it is long enough. It ends with a full stop. " * 2


def joined(*blocks):
    return " ".join(re.sub(r"\s+", " ", b).strip() for b in blocks)


def test_given_pages(spark, sf_small):
    pages = {r[0]: r[2] for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", "html").collect()}
    out = op6_main_text(spark, sf_small)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<b>", "").replace("</b>", "")
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"<(?:/?p|br|/?h1)>", article)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGES = {
    "divs": (
        f"<html><body><div class='topbar'>Home News</div><div id=sidebar><p>{MORE}</p></div><div class='content'><h1>Title here</h1><p>{LONG}</p><ul><li>one point<li>two points</ul>"
        f"<p>{MORE}</p></div><div class=comments><p>{LONG}</p></div><div class='cookie-notice'>We use cookies.</div></body></html>",
        joined("Title here", LONG, "one point", "two points", MORE),
    ),
    "main": (f"<body><header><h2>Site</h2></header><main><header><h1>T</h1></header><section><p>{LONG}<p>Of.</section><form><p>{MORE}</p></form></main><footer>{MORE}", joined("T", LONG, "Of.")),
    "inline": (f"<body><article><p>x<b>y</b>z &amp; &lt;i&gt; &#233;&nbsp;q {LONG}</p><script>if (a < b) c('</p>')</script><!-- {MORE} --><p>{MORE}</p></article></body>", joined(f"xyz & <i> é q {LONG}", MORE)),
    "comments": (f"<article><h1>T</h1><p>{LONG}</p><section id='comments'><article class='comment'><p>{LONG}</p></article></section></article>", joined("T", LONG)),
    "links": (f"<body><div><a href=1>one</a> <a href=2>two</a></div><div><p>{LONG}</p><p>{MORE} <a href=3>with a link</a> inside.</p></div></body>", joined(LONG, f"{MORE} with a link inside.")),
    "cut": (f"<body><article><p>{LONG}</p><p>{MORE}</p><p cla", joined(LONG, MORE)),
    "table": (f"<body><table><tr><td class=menu>m1<td><p>{LONG}<p>{MORE}</table>", joined(LONG, MORE)),
}


@pytest.mark.parametrize("name", PAGES)
def test_other_shapes(name):
    page, expected = PAGES[name]
    assert main_text(page) == expected


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "plain text only", 1), (4, "u", "<p>" * 3000 + "deep text. " * 2000, 1), (5, "u", "<div><script>x", 1), (4, "u", "<<<>>> a < b", 1)]
    got = [tuple(r) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()]
    by = {(r[0], r[1]): r for r in got}
    assert by[(1, "u")][2:] == ("", 0) and by[(2, None)][2:] == ("", 0) and by[(5, "u")][2:] == ("", 0)
    assert by[(None, "u")][2] == "plain text only" and len(got) == 6
    assert sorted(r[2] for r in got if r[0] == 4)[1] == ("deep text. " * 2000).strip()
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_that_mention_a_part_are_kept():
    story = "".join(f"<p>Paragraph {i} of the story, with words, commas, and a full stop at its end.</p>" for i in range(8))
    for wrap in ('<div class="has-sidebar">{}</div>', '<div id="content-sidebar-wrap"><div class="no-sidebar">{}</div></div>', "<form action=x>{}</form>", '<div class="post tags"><h1>Title</h1>{}</div>'):
        page = "<html><body>" + wrap.format(f'<div class="sidebar"><p>Other things to see.</p></div><div>{story}</div>') + '<div class="x">Small print.</div></body></html>'
        found = main_text(page)
        assert "Paragraph 0" in found and "Paragraph 7" in found and "Other things" not in found
    comments = '<div class="comments">' + "<p>I think so too, and wrote it down, at length, again.</p>" * 14 + "</div>"
    found = main_text(f"<html><body><div>{story}</div>{comments}</body></html>")
    assert "Paragraph 0" in found and "I think so" not in found


def test_path_scores_against_plain_sums():
    which, lengths, marks, weights = [0, 1, 1, 0, 2, 1, 3], [5, 300, 4, 12, 60, 200, 33], [0, 9, 1, 0, 4, 5, 1], [1, 1, 1, 0.5, 0.001, 1, 1]
    paths, n = sorted(set(which)), len(which)
    total = lambda p, values: sum(v for w, v in zip(which, values, strict=True) if w == p)
    mean = lambda p, values: total(p, values) / which.count(p)
    text, mark = ({p: math.sqrt(total(p, values) * mean(p, values)) for p in paths} for values in (lengths, marks))
    kernel = [math.exp(-0.5 * k * k) for k in range(-2, 3)]
    smooth = lambda of, i: sum(w * of[which[min(max(i + k, 0), n - 1)]] for w, k in zip(kernel, range(-2, 3), strict=True)) / sum(kernel)
    near = [smooth(text, i) * math.sqrt(1 + smooth(mark, i)) for i in range(n)]
    weight = {p: mean(p, [a * b for a, b in zip(lengths, weights, strict=True)]) / mean(p, lengths) for p in paths}
    want = [math.cbrt(mean(p, near) * (text[p] * math.sqrt(1 + mark[p])) ** 2) * weight[p] for p in paths]
    assert np.allclose(path_scores(np.array(which), np.array(lengths, float), np.array(marks, float), np.array(weights)), want)


def weights_alone(which, lengths, marks, weights):
    """A path's score where all ratios are equal."""
    return np.bincount(which, weights=lengths * weights) / np.bincount(which, weights=lengths)


def test_ratios_choose_the_text(spark, monkeypatch):
    """With all text and mark ratios equal, and only the weights of names and links kept, most pages come out otherwise."""
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    right = [main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "path_scores", weights_alone)
    other = [main_text(p) for p in pages]
    assert sum(a != b for a, b in zip(other, right, strict=True)) > 0.5 * len(pages)
    assert all(len(a) >= len(b) for a, b in zip(other, right, strict=True))


def test_weights_are_bounded():
    """A lowered path of enough text is content: names and links are no veto."""
    story = "".join(f"<p>Paragraph {i}, in full, with a stop at its end. {MORE}</p>" for i in range(10))
    page = f"<html><body><div class=intro><p>Short lead, here.</p></div><div class=social>{story}</div><div class=x><p>{MORE}</p><p>{MORE}</p></div></body></html>"
    assert "Paragraph 9" in main_text(page)


@pytest.mark.parametrize("name", ["related", "popular", "legal", "tags", "notice"])
def test_paragraphs_of_the_article_stay_whatever_they_are_called(name):
    page = f"<html><body><nav><a href=1>one</a></nav><article><h1>T</h1><p>{LONG}</p><p class='{name}'>Of the piece, and short.</p><h2 class={name}>Head</h2><p>{LONG * 3}</p></article><footer>(c)</footer></body></html>"
    assert main_text(page) == joined("T", LONG, "Of the piece, and short.", "Head", LONG * 3)
    inner = f"<article><h1>T</h1><p>{LONG * 4}</p><div class=related><a href=1>See this</a> <a href=2>and this</a></div><aside>Buy it now.</aside><p>{MORE}</p></article>"
    assert main_text(f"<html><body>{inner}<footer>(c)</footer></body></html>") == joined("T", LONG * 4, MORE)


def test_short_pages_go_by_their_article_element():
    page = "<html><body><div class=ad>An advert that is longer than all the rest, by far.</div><article><h1>T</h1><p>Hi.</p></article><footer>Some words, and more of them, at the foot of it.</footer></body></html>"
    assert main_text(page) == "T Hi."


@pytest.mark.parametrize("n", [2, 5, 20])
def test_pages_whose_names_say_nothing(n):
    """Only ``div`` and names without meaning: links, a line of small print, and teasers go by their paths' ratios."""
    story = "".join(f"<p class=q1>Paragraph {i} of the story, with words, commas, and a full stop at its end; {MORE}</p>" for i in range(n))
    links = "".join(f"<div class=z8><a href={i}>Item {i}</a></div>" for i in range(12))
    teasers = "".join(f"<div class=z9><a href={i}>Read this too, {i}</a></div>" for i in range(4))
    page = f"<html><body><div class=x1><div class=x2>{links}</div><div class=x3><div class=k2>The title, in short</div>{story}</div><div class=x4>{teasers}</div></div><div class=x5>(c) 2024</div></body></html>"
    assert main_text(page) == joined("The title, in short", *(f"Paragraph {i} of the story, with words, commas, and a full stop at its end; {MORE}" for i in range(n)))


def test_any_nesting_takes_time_in_proportion():
    began = time.process_time()
    for page in ("<div>" * 60_000 + LONG, "<b>" * 60_000 + LONG, ("<div>" * 20 + "</p></i></table>") * 4_000 + LONG, "<div>" * 20_000 + "</span>" * 60_000 + LONG, "<ul><li>" * 20_000 + "x<li>" * 20_000 + LONG):
        assert LONG.strip() in main_text(page)
    assert time.process_time() - began < 30
