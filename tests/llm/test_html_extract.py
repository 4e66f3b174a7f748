import numpy as np
import pytest

from vertexloom.llm import html_extract as H

W = H.fitted()


def test_weights():
    assert W.tag < 0 < W.of(frozenset({"article", "p"})) and W.of(frozenset({"outside", "nav", "li", "a"})) < 0


def test_region_agrees_with_trying_all():
    r = np.random.default_rng(3)
    for _ in range(200):
        s = r.integers(-5, 6, r.integers(0, 12)).astype(float)
        best = max([0.0, *(s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        a, b = H.best_region(s)
        assert s[a:b].sum() == pytest.approx(best) and (b > a) == (best > 0)


def test_unseen_labelled_pages():
    wrong = []
    for seed in range(5000, 5200):
        page, content = H.labelled_page(seed)
        if set(H.extract(page, W).split()) != content:
            wrong.append(seed)
    assert len(wrong) <= 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<article><h1>A &amp; B</h1><p>one  <b>two</b>three<br>four&nbsp;&eacute; <p>five</article>", "A & B one twothree four é five"),
        ("<article><p>x<script>var a='</p>';</script>y<!-- c --><style>p{}</style> z</p><aside>no</aside><form><p>no</p></form></article><footer>no</footer>", "xy z"),
        ("<nav><ul><li><a href='/a>b'>m</a></li></ul></nav><article><p>yes</p><section class='comments'><p>no no no</p></section></article>", "yes"),
        ("<article><p>cut &am</p><div cla", "cut &am"),
        ("<header><p>site</p></header><main><article><header><h1>Title</h1></header><p>Body text here</p></article></main>", "Title Body text here"),
        ("<article>Bare text of an article with many words.<br>More bare text.</article>", "Bare text of an article with many words. More bare text."),
        ("<article><blockquote>quote</blockquote><pre>code  here</pre><dl><dt>t</dt><dd>d</dd></dl><p>x</p>after <p><a href='/'>a link</a></p></article>", "quote code here t d x after a link"),
        ("<article><p>seen</p><p hidden>no</p><div style='display: none'>no <b>no</b><p>no</p></div>end <span style='visibility:hidden'>no</span>here</article>", "seen end here"),
        ("<article><p>yes</p><div id='disqus_thread'><p>no no</p></div><div class='user-responses'>no<article><p>no no</p></article></div></article>", "yes"),
        ("<article><p>yes yes</p><section><h3>12 comments</h3><p>no no no</p><div>no</div></section><p>more</p></article>", "yes yes more"),
        ("<article><p>a</p><h3>Comments on the budget of the state</h3><p>kept</p></article>", "a Comments on the budget of the state kept"),
        ("<div class='nav' /><a>menu</a> item</div><article><p>Text of it</p></article>", "Text of it"),
        ("<article><p>one two</p><div class='widget'><p>" + "no " * 5000 + "</p></div><p>three four</p></article>", "one two three four"),
        ("<div class='content'><p>" + "word " * 30 + "</p><div class='advert'>" + "no " * 500 + "</div><p>" + "more " * 30 + "</p></div>", ("word " * 30 + "more " * 30).strip()),
    ],
)
def test_pages(page, text):
    assert H.extract(page, W) == text


def test_deep_nesting_is_linear():
    import time

    began = time.perf_counter()
    assert H.extract("<div>" * 50_000 + "</p>" * 50_000, W) == ""
    assert time.perf_counter() - began < 10


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>one two three</p></article>", "other", 7, 8)], "page_id long, url string, html string, text string, n_chars int, kept_0 int")
    assert [tuple(r) for r in H.extract_pages(df).collect()] == [(1, "u", "one two three", 13)]


def test_odd_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<article><p>a " + "word " * 50_000 + "</p></article>", "x"), (3, "u", "<" * 2000, "x"), (4, "u", "<p" + "a='" * 500, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.extract_pages(df).collect()}
    assert got[1].text == "" and got[None].n_chars == len(got[None].text) == 250_001 and H.extract_pages(df).count() == 5
    assert H.extract_pages(df.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark, sf_dir):
    import html
    import re

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert H.extract(r.html, W) == " ".join(" ".join(b.split()) for b in blocks if b.split())
