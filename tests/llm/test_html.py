import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from chalkline.llm import dom, html, labelled_pages

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def chain():
    return html.trained()


def texts(page):
    return [b.text for b in dom.blocks_of(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<br>d<p>e &amp;amp; &lt f&nbsp;g") == ["a bc d", "e &amp; < f g"]
    assert texts("<script>var a='<p>x</p>';</script><STYLE>p{}</STYLE><p>y<!-- <p>z</p> --></p>") == ["y"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>cut off <a hre") == ["cut off"] and texts("a < b > c") == ["a < b > c"] and texts("") == [] and texts("<") == ["<"]
    assert texts("<div title='a > b'>x</div></nonsense></p>y") == ["x", "y"]
    by = {b.text: b for b in dom.blocks_of("<nav><a href=x>l</a></nav><article><p>t</article><div class='side-bar ad'>s</div>")}
    assert by["l"].linked == 1 and by["t"].parent == "p" and by["l"].above != by["t"].above and by["s"].above
    assert len(texts("<div>" * 20_000 + "x")) == 1 and len(texts("<p>x" * 20_000)) == 20_000


def test_held_out_pages(chain):
    wrong = total = 0
    for page, labels in labelled_pages.labelled_pages(150, seed=11):
        blocks = dom.blocks_of(page)
        for b, s in zip(blocks, chain.viterbi(chain.unary(html.features(blocks)).tolist())):
            total += 1
            wrong += s != labels[b.text]
    assert total > 2000 and wrong / total < 0.01


def test_table_pages(spark, chain):
    """The articles of the given pages, read off their one layout."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.id: r.text for r in html.extract(pages, chain=chain).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_parts_that_are_no_article(chain):
    page = """<html><head><title>T t</title></head><body><div class="cookie-notice"><p>We use cookies. Accept them.</p></div><header><h1>Site</h1></header>
    <div id="menu"><ul><li>Home</li><li>News</li></ul></div><main><article><h1>The title</h1><p>One  two\n three. Four &eacute;.</p>
    <div class="ad">Buy this now. It is cheap.</div><p>Five six seven.</p></article><section id="comments"><h3>Comments</h3><p>I like it. Really.</p></section>
    <form><label>Mail</label><p>Subscribe to our letter.</p></form></main><aside><h3>More</h3><p>Other story of note.</p></aside><footer>© X</footer></body></html>"""
    assert html.main_text(page, chain) == "The title\nOne two three. Four é.\nFive six seven."


def test_odd_rows(spark, chain):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<article><p>Some words, here they are.</p></article>"), (3, "w", "<article>" + "<p>Many words in a row.</p>" * 20_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit(1)).withColumn("id", F.lit(2)).withColumn("body", F.lit(3))
    got = sorted(((r.id, r.url, r.n_chars, len(r.text)) for r in html.extract(df, chain=chain).collect()), key=str)
    n = 20_000 * 21 - 1
    assert got == sorted([(1, "u", 0, 0), (1, "u", 0, 0), (2, None, 0, 0), (None, "v", 26, 26), (3, "w", n, n)], key=str)
    assert html.extract(df.limit(0), chain=chain).count() == 0


def test_only_scripts_and_styles_are_skipped():
    texts = lambda page: [b.text for b in dom.blocks_of(page)]
    assert texts("<article><p>Before</p><svg viewBox='0 0 1 1'><path d='M0'><p>After</p></article><p>End</p>") == ["Before", "After", "End"]
    assert texts("<p>We write <math>x=2</math> for the <object>sum</object></p>") == ["We write x=2 for the sum"]
    assert texts("<p>a<canvas>b</p><p>c</p>") == ["ab", "c"]
    assert texts("<p>a<script>var x = '<p>';</script>b<style>p{}</style>c<iframe>d</iframe></p><template>e</template>") == ["abc"]
    assert texts("<p>a" + "<b>" * 20 + "b<div>c</div>") == ["ab", "c"]
    notice = dom.blocks_of("<noscript><p>Please enable it</p></noscript>")[0]
    assert notice.above & dom._FAMILY["notice"]
