"""Main text: made pages, minimum cuts against all labellings, odd rows."""

import html
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import pages, queries

from .conftest import SMALL


def test_min_cut_is_least_of_all_labellings():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 9)
        scores = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]

        def cost(label, scores=scores, edges=edges):
            return sum(-s if c and s < 0 else s if not c and s > 0 else 0 for s, c in zip(scores, label)) + sum(w for i, j, w in edges if label[i] != label[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(pages.min_cut(scores, edges)) - best) < 1e-6


def article(page):
    """What stands in the article element of the generated pages, by block."""
    m = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    clean = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0] == "<br>" else "", p)).split()) for p in parts)
    return "\n\n".join(x for x in clean if x)


def test_whole_small_table(spark):
    source = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.op7_html_extraction(spark, SMALL).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == article(source[r.page_id].html) and r.url == source[r.page_id].url and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T</title><script>if (a < b) { x = "</p><p>no" }</script></head><body class="has-sidebar">
<header><h1>Site</h1><p>Our claim for the site is that it is a very good site, truly.</p></header>
<div id="cookie-notice"><p>We use cookies on this page. Please accept all of them, as everybody does here.</p></div>
<ul class="main-menu"><li><a href="/">Home</a></li><li><a href='/a>b'>About</a></li></ul>
<div class="post-content"><h2>Title &amp; more</h2><p>This is the first long paragraph of the <b>sto</b>ry,
   which has   many words and ends&nbsp;well.<p>The second one is long as well, as you can see, with <a href="u">a link</a> in it.
<div class="advert"><p>Buy this thing now, it is cheap and it is good for you and all of your friends.</p></div>
<ul><li>item one is fine</li><li>item two is fine</ul><p>Short end.</p><!-- <p>gone</p> --><p style="display: none">Hidden words are not for readers of this page.</p></div>
<aside><p>Popular posts are listed over here for your reading pleasure, all of them, every day.</p></aside>
<section id="comments"><article class="comment"><p>I think that this is a great text, thanks a lot for it!</p></article></section>
<form><p>Search for words on our site with this form, please.</p><textarea>x</textarea></form><footer><p>All rights are reserved by us, for ever and ever.</p></footer></body></html>"""


def test_boilerplate_goes_and_article_stays():
    assert pages.main_text(PAGE).split("\n\n") == [
        "Title & more",
        "This is the first long paragraph of the story, which has many words and ends well.",
        "The second one is long as well, as you can see, with a link in it.",
        "item one is fine",
        "item two is fine",
        "Short end.",
    ]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p"), (4, "a < b and <article><p>cut off paragraph of some words, here it ends"), (5, "<script>never closed"), (None, PAGE), (6, "<div>" * 3000 + "deep"), (7, "<article>" + "<p>some words of a long page go here.</p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got[1] == got[2] == got[3] == got[5] == "" and got[None] == pages.main_text(PAGE)
    assert got[4].endswith("cut off paragraph of some words, here it ends") and got[7].count("\n\n") == 19_999
    assert pages.extract(df.limit(0)).count() == 0


MORE = "<p>Another long paragraph of the same article, which has many words, a comma, and an end that closes it well.</p>"
TARGET = "Target paragraph that must survive, with words."


@pytest.mark.parametrize(
    "page",
    [
        f"<article><p title=it's>{TARGET}</p>{MORE}</article>",
        f'<article><p title="a > b" alt=\'"\'>{TARGET}</p>{MORE}</article>',
        f'<article><p data-hidden="false">{TARGET}</p>{MORE}</article>',
        f'<article><p data-state="was hidden before">{TARGET}</p>{MORE}</article>',
        f'<main data-toggle="hidden"><p>{TARGET}</p>{MORE}</main>',
        f'<article><p data-id="comment-7">{TARGET}</p>{MORE}</article>',
        f'<article><p id="more">{TARGET}</p>{MORE}</article>',
        f'<main id="more-on-rivers"><p>{TARGET}</p>{MORE}</main>',
        f'<article class="story popular"><p>{TARGET}</p>{MORE}</article>',
        f"<body><form><div><h1>Rivers</h1><p>{TARGET}</p>{MORE}<input></div></form></body>",
        f"<form action=x><article><h1>Rivers</h1><p>{TARGET}</p>{MORE}</article></form>",
        f"<body><nav><ul><li><a href=x>Home</a></li><article><h1>Rivers</h1><p>{TARGET}</p>{MORE}</article></body>",
        f"<body><nav><ul><li><a href=x>Home</a></li></ul><div><h1>Rivers</h1><p>{TARGET}</p>{MORE}</div></body>",
        f'<div class="page has-sidebar"><div class="sidebar-layout"><main><p>{TARGET}</p>{MORE}</main></div></div>',
        f"<div><p>{TARGET}</p><p>Two words.</p></div>",
    ],
)
def test_attributes_and_wrappers_lose_no_text(page):
    got = pages.main_text(page).split("\n\n")
    assert TARGET in got and ("Another" not in page or any(x.startswith("Another long") for x in got)) and "Home" not in got


LONG = "This is a long paragraph about the subject of the article, with several clauses, and it ends like any other. It goes on for one more sentence."


@pytest.mark.parametrize("text", [TARGET, LONG])
@pytest.mark.parametrize(
    "part",
    ['<p class="ad-free">%s</p>', '<p class="menu">%s</p>', '<div class="login"><p>%s</p></div>', '<p class="related">%s</p>', '<div class="promo-code-explained"><p>%s</p></div>', '<div class="newsletter-archive"><p>%s</p></div>', '<div class="sharing economy"><p>%s</p></div>', "<div role=alert><p>%s</p></div>", "<label>%s</label>", "<audio src=x /><p>%s</p>", "<video><p>%s</p>", '<div class="share"><p>%s</p></div>', '<h2 class="promo">%s</h2>'],
)
def test_no_name_outvotes_prose_in_an_article(part, text):
    got = pages.main_text(f"<article><h1>Rivers</h1>{MORE}{part % text}{MORE}</article>").split("\n\n")
    assert text in got and got.count(MORE[3:-4]) == 2


@pytest.mark.parametrize("name", sorted(pages.UNWANTED - pages.REPLIES))
def test_long_prose_survives_every_name_and_short_notes_do_not(name):
    """A part of some paragraphs in an article is its prose whatever it is called; a short one with that name alone is not."""
    part = lambda text: f'<article><h1>Rivers</h1>{MORE}<div class="{name}">{text}</div>{MORE}</article>'
    assert LONG in pages.main_text(part(f"<p>{LONG}</p>" * 4))
    assert "Buy" not in pages.main_text(part("<p>Buy it now</p>"))


def test_forms_and_comments_in_an_article_go():
    page = f'<article><h1>Rivers</h1><p>{TARGET}</p><form><p>Sign up please, all of you, now.</p><input></form>{MORE}<div class="comments"><p>I like it a lot, thank you for this.</p></div></article>'
    assert len(pages.main_text(page).split("\n\n")) == 3


def words_right(made, shown):
    """Words shown that are content, words shown, words of the content."""
    a, b = (Counter(w for t in texts for w in t.split()) for texts in (made, shown))
    return (a & b).total(), b.total(), a.total()


def test_pages_without_marks_are_told_by_the_classifier():
    """Generated pages of another seed, and those of the table with elements and names hidden."""
    r, total = np.random.default_rng(99), np.zeros(3)
    for _ in range(100):
        page, content = pages.made_page(r, False)
        total += words_right(content, pages.main_text(page).split("\n\n"))
    assert total[0] >= 0.97 * total[1] and total[0] >= 0.97 * total[2]
    total[:] = 0
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        bare = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", row["html"]).replace(' class="ad"', "")
        total += words_right(article(row["html"]).split("\n\n"), pages.main_text(bare).split("\n\n"))
    assert total[0] >= 0.97 * total[1] and total[0] >= 0.97 * total[2]


def test_the_cut_mends_what_single_blocks_get_wrong():
    """A low score among neighbours that are content stays content; alone it goes."""
    assert pages.min_cut([2.0, -0.5, 2.0], [(0, 1, 0.8), (1, 2, 0.8)]) == [True, True, True]
    assert pages.min_cut([2.0, -0.5, 2.0], []) == [True, False, True]


def test_deep_pages_take_linear_time():
    def seconds(n):
        page = "<div>" * n + "<p>some words, here.</p>" + "</section></span></p>" * n + "".join(f"<div><p>word {i}.</p>" for i in range(n))
        began = time.perf_counter()
        pages.main_text(page)
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(16_000) for _ in range(2)) < 20 * min(seconds(2000) for _ in range(2)) + 0.2
