import re

import pytest

from stowage.llm.html import extract, main_text

SHELL = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header>Site <a href=/>home</a></header><nav><ul><li><a href=/a>a</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, really, ok?</p></div><div class="ad">Buy, buy, buy</div>
<div class="wrap">{body}<div class="sidebar"><p>Side text, with commas, too.</p></div></div>
<section id=comments><p>A long comment, far longer, with more commas, than the article has.</p></section>
<form><p>Name</p><input name=x></form><footer>&copy; 2020, all</footer></body></html>"""


@pytest.mark.parametrize(("body", "text"), [
    ("<article><h1>T &amp; t</h1><p>One  two\n three<br>four.</p><p>B&nbsp;c</p></article>", "T & t\nOne two three four.\nB c"),
    ("<main><p><b>One.<br><p>Two.</main>", "One.\nTwo."),
    ("<div class=post-content><p>First, of all.</p><ul><li>x<li>y</ul><blockquote>Q</blockquote></div>",
     "First, of all.\nx\ny\nQ"),
    ("<article><p>Text.</p><aside>no</aside><div class='share-buttons'>no</div><p hidden>no</p>"
     "<p style='display: none'>no</p><p>End <i>of</i> <a href=x>it</a>.</p><!-- <p>no</p> --></article>",
     "Text.\nEnd of it."),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    ("<article><p>Short.</p></article>", "Short."),
    ("<article><p data-x='a>b'>Quoted > sign &lt;b&gt;</p></article>", "Quoted > sign <b>"),
])
def test_articles(body, text):
    assert main_text(SHELL.format(body=body)) == text


_ONE, _TWO, _THREE = (f"<p>{n} words of an article, long enough, with commas, to be one.</p>" * 2 for n in ("Some", "More", "Last"))
_PLAIN = lambda *parts: re.sub("</p><p>", "\n", "".join(parts)).replace("<p>", "").replace("</p>", "")


@pytest.mark.parametrize("body", [
    f"<section>{_ONE}{_ONE}</section><div>{_TWO}</div>",
    f"<div class=content>{_ONE}{_ONE}</div><section><h2>Then</h2>{_TWO}</section>",
    f"<div class=row><div class=c1>{_ONE}{_ONE}</div></div><div class=row><div class=c1>{_TWO}</div></div>",
    f"<div><div>{_ONE}{_ONE}</div><ul><li><a href=x>Some link, or other</a></ul></div><div><div>{_TWO}</div></div>",
    f"<section><h2>A</h2><p>Short, one.</p></section><div>{_ONE}{_ONE}</div><section><h2>B</h2>{_TWO}</section>",
])
def test_no_chapter_is_lost(body):
    text = main_text(SHELL.format(body=body))
    assert text.count("Some words") == 4 and text.count("More words") == 2
    assert "link" not in text and "Side text" not in text and "Buy" not in text
    assert [h for h in ("A", "B", "Then") if f">{h}<" in body] == [x for x in text.split("\n") if len(x) < 5]


def test_a_list_of_links_beside_an_article_stays_out():
    body = f"<article>{_ONE}</article><div><h3>Latest</h3><p>Not, of, this, article, at, all, really.</p></div>"
    assert main_text(SHELL.format(body=body)).count("\n") == 1


@pytest.mark.parametrize("part", [
    "<a title=\"", "<a b='", "<div \"", "</x>", "</div>", "<b class=ad></i>", "<", "<!--", "<p class=\"a>b ", "<div></p>", "<li><b>",
    "<script", "&amp", "<![CDATA[", "<td><i class=ad>",
])
def test_broken_markup_takes_linear_time(part):
    import time

    seconds = []
    for n in (30_000, 240_000):
        page = "<div><p>Text.</p>" + part * (n // len(part))
        start = time.perf_counter()
        main_text(page)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 24 * seconds[0] + 0.5 and seconds[1] < 6


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body>") == ""
    assert main_text("plain &amp; simple") == "plain & simple"
    assert main_text("<p>cut off <b") == "cut off"
    assert main_text("<p>cut &am") == "cut &am"
    assert main_text("</div></p><p>a</p>") == "a"
    assert main_text("<script>never closed <p>x") == ""
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = "<article>" + "<p>word, word</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n") == 19_999


def test_given_pages(spark):
    """The given pages' articles, cut out by what is known of their making."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    for row in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", x))).strip()
                 for x in re.split(r"</?(?:p|h1)>", article))
        assert main_text(row["html"]) == "\n".join(p for p in parts if p), row["page_id"]


def test_table(frame):
    rows = [(1, "u", "<p>a</p>", "old"), (1, "u", "<p>a</p>", "old"), (2, None, None, None)]
    out = extract(frame(rows, "page_id bigint, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "html", "text"]
    assert sorted((r["page_id"], r["text"]) for r in out.collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert extract(frame([], "page_id bigint, html string")).collect() == []


LONG = "Words of the article, one after the other, with commas, so that they count as prose in a page."


@pytest.mark.parametrize(("body", "text"), [
    (f"<div class='content has-sidebar'><p>{LONG}</p></div>", LONG),
    (f"<div class='post no-footer'><p>{LONG}</p></div>", LONG),
    (f"<div class='layout has-sidebar'><p>{LONG}</p><div class=sidebar>no</div></div>", LONG),
    (f"<form action=/><nav>no</nav><div><p>{LONG}</p><p>End.</p></div><input></form>", f"{LONG}\nEnd."),
    (f"<article><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>So it is.</p></section>"
     f"<section id=related-work><p>Others.</p></section></article>", f"{LONG}\nDiscussion\nSo it is.\nOthers."),
    (f"<article><h2 id=search>Search</h2><p>{LONG}</p></article>", f"Search\n{LONG}"),
    ("<article><p>It is <span class=alert>not</span> so.</p></article>", "It is not so."),
    ("<article><p>It is <span hidden>not</span> so.</p></article>", "It is so."),
    ("<article><p title='a hidden place'>Here.</p></article>", "Here."),
    (f"<div>Before.<section><p>{LONG * 9}</p></section>Between.<section><p>Short.</p></section></div>",
     f"Before.\n{LONG * 9}\nBetween.\nShort."),
    (f"<my-page class=widget><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></my-page>", "\n".join([LONG] * 3)),
    (f"<div><p>{LONG}</p></div><div id=comments>" + f"<p>{LONG}</p>" * 9 + "</div>", LONG),
    (f"<article><p>{LONG}</p><span class=ad>Buy</span><span class=ad><p>Buy</p></span><p>End.</p></article>",
     f"{LONG}\nEnd."),
    (f"<article><p>{LONG}</p><div class='post-footer'>no</div><div class=comment-body>no</div></article>", LONG),
])
def test_only_furniture_is_left_out(body, text):
    assert main_text(f"<html><body><header>no</header>{body}<footer>no</footer></body></html>") == text
