import itertools
import re
import time

import numpy as np
import pytest

from claimspan.llm import extraction as e


def test_articles_of_the_whole_table(spark):
    """The given pages mark their article: its blocks are the text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in e.main_text(pages).join(pages, "page_id").collect():
        inner = re.search("<article>(.*)</article>", row.html, re.S)[1]
        lines = [" ".join(e.html.unescape(re.sub("<[^>]*>", "", x)).split())
                 for x in re.split("</?(?:p|h1)>", inner)]
        assert row.text == "\n".join(x for x in lines if x)
        assert row.n_chars == len(row.text)


def test_marginals_are_exact():
    """Against the sum over all states of a small forest."""
    rng = np.random.default_rng(3)
    parent, depth = np.array([-1, 0, 0, 1, 1, -1, 5]), np.array([0, 1, 1, 2, 2, 0, 1])
    unary, edges = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    want = np.zeros((7, 3))
    for states in itertools.product(range(3), repeat=7):
        w = np.exp(sum(unary[i, s] for i, s in enumerate(states))
                   + sum(edges[states[p], states[i]] for i, p in enumerate(parent) if p >= 0))
        for i, s in enumerate(states):
            want[i, s] += w
    got = e.marginals(unary, parent, depth, edges)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


PARTS = """<html><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, more than you think we do.</p></div>
{open}<h1>A &amp; B</h1><p>First   para<b>graph</b>,<br>
with a long and quiet text about things &eacute;.<p>Second one, also long enough for a text.
<aside><p>Read also: something else</p></aside><script>var x = "<p>no</p>";</script>
<ul><li>item one<li>item two</ul>{close}
<div id="comments"><p>Nice article, I have read it with pleasure and agree.</p></div>
<form><p>Your name</p></form><div class="sidebar"><p>More of the same kind</p></div>
<footer><p>&copy; Site</p></footer></body></html>"""
TEXT = ("A & B\nFirst paragraph, with a long and quiet text about things é.\n"
        "Second one, also long enough for a text.\nitem one\nitem two")


def test_parts_of_other_pages(spark):
    rows = [(1, "u", PARTS.format(open="<article>", close="</article>")),
            (2, "u", PARTS.format(open='<div class="post">', close="</div>")),
            (3, "u", PARTS.format(open="<main><div>", close="</div></main>")),
            (4, "u", None), (5, "u", ""), (6, None, "just text"), (None, "u", "<p"),
            (7, "u", "<article>" + "<div><b>x " * 3000 + "</article>"),
            (8, "u", "<nav>menu</nav>"), (1, "u", PARTS.format(open="<article>", close=""))]
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        (-1 - e.F.col("page_id")).alias("page_id"), "url", "html")
    pages = given.union(spark.createDataFrame(rows, given.schema)).withColumn(
        "text", e.F.lit("clash"))
    out = e.main_text(pages).where("page_id is null or page_id >= 0").collect()
    text = {r.page_id: r.text for r in out if r.page_id != 1}
    assert sum(r.page_id == 1 for r in out) == 2
    assert next(r.text for r in out if r.page_id == 1).startswith(TEXT[:30])
    assert text[2] == TEXT and text[3] == TEXT
    assert text[4] == text[5] == text[8] == "" and text[7].count("x") == 3000
    assert e.main_text(pages.limit(0)).collect() == []


@pytest.fixture(scope="module")
def model(spark):
    """Learned from the given pages, which all mark their article."""
    return e.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def text_of(source, model):
    return e.extract([source.encode()], model)[0]


SENTENCE = "A quiet sentence about the weather of last week, and how it changed. "
LONG = (SENTENCE * 4).strip()
MENU = "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>"


@pytest.mark.parametrize("source, want", [
    (f"<body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></body>", "\n".join([LONG] * 3)),
    (f"<div><h1>A headline</h1><p>{LONG}</p></div>", f"A headline\n{LONG}"),
    (f"{MENU}<div><p>{SENTENCE * 30}</p></div>", (SENTENCE * 30).strip()),
    (f"<div><p>{SENTENCE * 40}</p></div>", (SENTENCE * 40).strip()),
    (f"<body>{MENU}{LONG}<p>{LONG}</p></body>", f"{LONG}\n{LONG}"),
    (f'<body><div class="top"><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>'
     f"<div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
])
def test_pages_without_a_mark(model, source, want):
    assert text_of(source, model) == want


@pytest.mark.parametrize("source, want", [
    (f'<article class="post tags-news banner-none"><p>{LONG}</p></article>', LONG),
    (f'<article><p>{LONG}</p><section id="social-history"><p>{LONG}</p></section>'
     f'<div class="form-factor"><p>{LONG}</p></div></article>', "\n".join([LONG] * 3)),
    (f"<article><header><h1>A headline</h1></header><p>{LONG}</p></article>",
     f"A headline\n{LONG}"),
    (f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo></math>"
     "<object>1</object>.</p></article>", f"{LONG}\nSo x=1."),
    (f'<article><p>{LONG}</p><div id="comments">{"<p>" + LONG + "</p>"}</div></article>', LONG),
    (f'<div class="post"><p>{LONG}</p></div><div class="comment-list">'
     + f"<p>{LONG} I agree.</p>" * 40 + "</div>", LONG),
    (f"<body>{MENU}<header><p>{LONG}</p></header><main><p>{LONG}</p></main>"
     f"<footer><p>{LONG}</p></footer></body>", LONG),
])
def test_names_and_tags(model, source, want):
    assert text_of(source, model) == want


@pytest.mark.parametrize("source, want", [
    ("<article><p title=it's>Hello</p></article>", "Hello"),
    ('<article><p title="a > b">Hello</p></article>', "Hello"),
    ('<article><p title="a>Hello</p><p>there</p></article>', "Hello\nthere"),
    ("<article><p>1 < 2 &lt; 3 <!-- <p>no</p> --><!DOCTYPE x>yes</p></article>", "1 < 2 < 3 yes"),
    ("<article><script>a</b</script >x</article>", "x"),
    ("<article><p>one<b>two<p>three</b></article>", "onetwo\nthree"),
    ("<article><p>Hello</p><p clas", "Hello"),
])
def test_markup_is_no_text(model, source, want):
    assert text_of(source, model) == want


@pytest.mark.parametrize("unit", [
    "<a ", "<!--", '"', "<", "</", "</x>", "<b>", "<div>", "<td>", "<a x='>", '<a x=">"', "<!",
    "<tr><div>", "<u><div><i></u>", "<a =", "&amp", "<script>", "<li><b></i>"])
def test_time_is_linear(model, unit):
    """A megabyte of each; the nested ones take their time in levels of messages."""
    begin = time.monotonic()
    e.parse("<p>x" + unit * (1_000_000 // len(unit)) + ">")
    assert time.monotonic() - begin < 20
