from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from quillon.llm.extract import extract, main_text

LONG = "It was a long day, and the rain, which had begun early, did not stop before the evening came over the hills."
MORE = "The second paragraph goes on about the same hills, the same rain, and a road that nobody had taken for years."


def page(body: str, before: str = "", after: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body>{before}{body}{after}</body></html>"


CHROME = '<nav><ul><li><a href="/">Home, sweet, home</a></li></ul></nav><header><p>The Daily, est. 1900, all the news</p></header><div class="cookie notice">We use cookies, many, many cookies, on this site, always.</div>'
TAIL = f'<aside><p>{MORE} Read more, now, here.</p></aside><div id="comments"><p>I think, {LONG}</p></div><form><p>Name, please, {LONG}</p></form><footer>&copy; all, rights, reserved</footer>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("just text, no tags", "just text, no tags"),
        (page(f"<article><h1>Head</h1><p>{LONG}</p><p>{MORE}</p></article>", CHROME, TAIL), f"Head\n{LONG}\n{MORE}"),
        (page(f"<div class='post'><p>{LONG}<p>{MORE}</div>", CHROME, TAIL), f"{LONG}\n{MORE}"),
        (page(f"<table><tr><td><p>{LONG}</p><p>{MORE}</p></td></tr></table>", CHROME, TAIL), f"{LONG}\n{MORE}"),
        (page(f"<p><b>{LONG}<br><p>{MORE} &amp; so&nbsp;on &#233;&#x4e2d; &lt;b&gt;"), f"{LONG}\n{MORE} & so on é中 <b>"),
        (page(f"<article><p>{LONG}</p><ul><li>one, <i>two</i>\n  three<li>four</ul><!-- <p>hidden</p> --><p>{MORE}</p></article>"), f"{LONG}\none, two three\nfour\n{MORE}"),
        (page(f"<article><p>{LONG}</p><div style='display: none'>{MORE}</div><p hidden>{MORE}</p></article>", CHROME), LONG),
        (page(f"<article><p>{LONG}</p><p>{MORE}</p><footer>&middot; end"), f"{LONG}\n{MORE}"),
        (page("<nav><a href='/'>only, a, menu</a></nav>"), ""),
        (f"<ARTICLE><P>{LONG}</P><SCRIPT>if (a < b) x('<p>');</SCRIPT ><P TITLE='a > b'>{MORE}</P></ARTICLE>", f"{LONG}\n{MORE}"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    for html in ("<div>" * 50_000 + LONG, "<b>" * 50_000 + LONG, f"<p>{LONG}" * 20_000, "<p><b>" * 20_000 + LONG, "<ul><li>" * 20_000 + LONG, "&" * 100_000, "<!--" * 50_000, "</p>" * 100_000, '<a b="' * 20_000, "< " * 50_000):
        main_text(html)
    assert time.time() - began < 60


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", page(f"<article><p>{LONG} 𝄞</p></article>"), 5), (1, "u", None, 5), (None, None, "", 1)], "page_id long, url string, html string, n_chars int")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "", 0), (1, "u", f"{LONG} 𝄞", len(LONG) + 2), (None, None, "", 0)]
    assert extract(df.limit(0)).count() == 0


class Article(HTMLParser):
    """A plain version for pages that mark their article: its text, a line for each block."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "blockquote", "pre", "section", "article", "table", "tr", "td", "th", "figure", "figcaption"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.gone, self.lines = 0, 0, [""]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if self.gone or tag in ("script", "style", "form", "aside", "nav", "footer", "noscript"):
            self.gone += tag not in ("br", "img", "hr", "wbr", "input", "meta", "link")
        if tag in self.BLOCKS:
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.gone -= bool(self.gone)
        if tag in self.BLOCKS:
            self.lines.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.lines[-1] += data

    def text(self):
        return "\n".join(x for line in self.lines if (x := " ".join(line.split())))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_page_against_its_article(spark, sf):
    """Scoring over the whole page finds what a plain version finds that goes by the tag alone."""
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows)
    marked = [r for r in rows if "<article" in r.html]
    assert len(marked) > 0.2 * len(rows)
    wrong = [r.page_id for r in marked if got[r.page_id][0] != Article(r.html).text()]
    assert not wrong
    assert all(n == len(t) for t, n in got.values())


def test_names_and_commas(spark):
    df = spark.createDataFrame([(1, "<p>x, y</p>", 5)], "page_id long, html string, html_of_row int")
    assert [tuple(r) for r in extract(df, keep=("page_id", "html_of_row")).collect()] == [(1, 5, "x, y", 4)]
    with pytest.raises(ValueError):
        extract(df.withColumnRenamed("html_of_row", "text"), keep=("text",))
    cjk = "雨、風、雪、雲、霧、虹、星、月、日、川" * 2
    assert main_text(f"<div><div><p>{cjk}</p></div><div><span>{'y' * 90}</span></div></div>") == cjk
