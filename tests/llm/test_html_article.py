import html
import random
import re

import pytest
from pyspark.sql import functions as F

from pixelframe.llm.html_article import extract, main_text


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text\n only", "plain text only"),
        ("<p>a<p>b", "a\nb"),
        ("<p>Fish &amp; chips&nbsp;&#8211; &lt;b&gt;", "Fish & chips – <b>"),
        ("<title>t</title><style>x</style><script>if(a<b){'</p>'}</script><p>x < y<!-- <p>c --> z", "x < y z"),
        ("<div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></div>", "one\ntwo\nc1\nc2"),
        ("<nav><a href=/>Home</a></nav><main><h1>T</h1><p>One, two.</p><p>s</p><aside>no</aside></main><footer>f</footer>", "T\nOne, two.\ns"),
        (
            '<div id="sidebar"><p>Side, side, side, side.</p></div><div class="content"><h2>Head</h2>Some text, that is'
            ' here.<br>More.<p>Par.</p></div><div class="comments"><p>Nice, nice, nice, very, very nice.</p></div>',
            "Head\nSome text, that is here. More.\nPar.",
        ),
        ("<article><section><p>Long, long, long text.</p></section><section><p>short</p></section></article>", "Long, long, long text.\nshort"),
        ('<div class="cookie-notice">We use, as all, cookies.</div><article><form>f</form><p>Text.</p></article>', "Text."),
        ("<article><p>Body text, here.</p><ul><li><a>m1</a><li><a>m2</a><li><a>m3</a></ul></article>", "Body text, here."),
        ("<article><p>One, two.<svg-icon name=x></svg-icon></p><title-card>t</title-card><p>Three.</p></article>", "One, two.\nt\nThree."),
        (
            '<article><h2 id="social-impact">A</h2><h2 id="search-algorithms">B</h2><section class="related-work"><p>C, c.</p>'
            '</section><div class="side-by-side">D</div><p class="share-price">E</p><div class="share-buttons">no</div>'
            '<section class="comments"><p>no</p></section></article>',
            "A\nB\nC, c.\nD\nE",
        ),
        ("<article><p>Let <math><mi>x</mi></math> be.</p></article>", "Let x be."),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("seed", range(12))
def test_generated_pages_without_article(seed):
    """Sections of similar length in the same wrappers, among marked boxes: all of their text comes back."""
    rng = random.Random(seed)
    prose = lambda: " ".join(rng.choice(["word,", "river", "stone", "& so", "light."]) for _ in range(rng.randint(40, 80)))
    depth, text, body = rng.randint(0, 3), [], []
    for _ in range(rng.randint(1, 5)):
        paragraphs = [prose() for _ in range(rng.randint(2, 4))]
        text += paragraphs
        inner = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
        for k in range(depth):
            inner = f'<div class="{rng.choice(["row", "col-md", "w"])}">{inner}</div>'
        body.append(inner)
        if rng.random() < 0.5:
            body.append(f'<div class="{rng.choice(["ad", "cookie-notice", "related-posts", "share-buttons"])}"><p>{prose()}</p></div>')
    page = f"<body><nav><a href=/>Home</a></nav><div>{''.join(body)}</div><div id=comments><p>{prose()}</p></div><footer>{prose()}</footer>"
    assert extract(page) == "\n".join(text)


def test_odd_markup_takes_linear_time():
    for piece in ('<a "', "<div>", "<p>x", "<", "<!--", "<script>", "<div>x", "</b>", "<b></i>"):
        extract(piece * 20_000)


def test_table_and_edge_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "<p>" + "word, " * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit(0).alias("text"))
    out = main_text(df).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 0, 599_999] and main_text(df.limit(0)).count() == 0
