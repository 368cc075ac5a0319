import html as entities
import re

import pyarrow.dataset as ds
import pytest

from emberline.llm import html_text


def plain_article(page):
    """The fixture's own markup: one article element of headings and paragraphs."""
    own = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split(r"</?(?:p|h1|br)>", own)
    texts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
    return "\n".join(x for x in texts if x)


def test_whole_table(spark, sf):
    pages = ds.dataset(f"{sf}/pages.parquet").to_table().to_pylist()
    rows = {r.page_id: r for r in html_text.op3_html_extraction(spark, sf).collect()}
    assert len(rows) == len(pages)
    for p in pages:
        r = rows[p["page_id"]]
        assert r.text == plain_article(p["html"]) and r.url == p["url"] and r.n_chars == len(r.text)


LONG = "Words of a sentence that goes on for a while, as sentences of articles do. " * 3
PARTS = [LONG + str(i) for i in range(4)]


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("body", [
    "<header><a href=/>Home</a></header><div class='sidebar'><p>{0}</p></div><main><h1>Title</h1>{p}</main><footer>f</footer>".replace("{0}", LONG),
    "<div id=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class=post><h1>Title</h1>{p}<div class='comments'><p>{0}</p></div></div><form><input><p>x</p></form>".replace("{0}", LONG),
    "<nav><p>{0}</p></nav><h1>Title</h1>{p}<div class='cookie-notice'>{0}</div><div role=complementary>{0}</div>".replace("{0}", LONG),
    "<article><h1>Title</h1>{p}<aside>{0}</aside><script>var a='<p>no</p>'</script><noscript>n</noscript></article><section class=related-posts>{0}</section>".replace("{0}", LONG),
])
def test_other_layouts(body):
    text = html_text.main_text(page(body.replace("{p}", "".join(f"<p>{x}<p>Short.</p>" for x in PARTS))))
    assert text.split("\n") == ["Title", *[y.strip() for x in PARTS for y in (x, "Short.")]]


def test_references_and_white_space():
    text = html_text.main_text(page(f"<article><p>a&amp;b &lt;i&gt;&#233;&nbsp;\n\t c<b>d</b>e <!-- no --> f</p><p>{LONG}</p></article>"))
    assert text == f"a&b <i>é cde f\n{LONG.strip()}"


@pytest.mark.parametrize("raw", ["", "   ", "<!-- x -->", "<nav><a href=x>y</a></nav>", "</div></div>", "<!doctype html>", "<script>x"])
def test_pages_without_an_article(raw):
    assert html_text.main_text(raw) == ""


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5), (None, "u", "<p>" + LONG * 4000, 6), (3, "v", "plain words alone", 7)], "page_id long, url string, html string, text int")
    rows = sorted((r.page_id or 0, r.url or "", r.n_chars) for r in html_text.extract(df).collect())
    assert rows == [(0, "u", len((LONG * 4000).strip())), (1, "", 0), (1, "", 0), (3, "v", 17)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_linked_paragraphs_of_an_article_stay():
    body = "<article><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in PARTS) + "<p><a href=1>A whole linked sentence.</a></p><ul><li><a href=2>More of it</a></ul></article>"
    assert html_text.main_text(page(body)) == "\n".join(["Title", *(x.strip() for x in PARTS), "A whole linked sentence.", "More of it"])


def test_wrappers_marked_by_a_word_keep_their_article():
    inner = "<article><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in PARTS) + f"<div class=comments><p>{LONG}</p></div></article>"
    want = "\n".join(["Title", *(x.strip() for x in PARTS)])
    assert html_text.main_text(page(f"<div class='content with-sidebar'>{inner}</div><p>Other</p>")) == want
    assert html_text.main_text(page(f"<div hidden class=sidebar>{inner}</div>")) == ""
    assert html_text.main_text(page(f"<main>{inner}</main><div class=sidebar><article><p>{LONG}</p></article></div>")) == want


BODY = "".join(f"<p>{x}</p>" for x in PARTS)
TEXTS = [x.strip() for x in PARTS]


@pytest.mark.parametrize(("inner", "want"), [
    ("<div class='post-header'><h1>Title</h1></div>{p}", ["Title", *TEXTS]),
    ("{p}<ul><li class=promo>Buy now<li>Plain one<li>Plain two</ul>", [*TEXTS, "Plain one", "Plain two"]),
    ("{p}<p class=notice>We use cookies<h2>More</h2><p>And text.", [*TEXTS, "More", "And text."]),
    ("{p}<p><a href=x>This whole sentence is a link.</a></p><p>End.</p>", [*TEXTS, "This whole sentence is a link.", "End."]),
    ("{p}<p id=share-prices>Share prices fell.</p><p>End.</p>", [*TEXTS, "Share prices fell.", "End."]),
    ("{p}<section class=discussion><h2>Discussion</h2><p>{l}</p></section>", [*TEXTS, "Discussion", LONG.strip()]),
    ("{p}<dl><dt>Term<dd class=ad>Buy<dt>Other<dd>Its meaning</dl>", [*TEXTS, "Term", "Other", "Its meaning"]),
    ("{p}<table><tr><td class=ad>Buy<td>Cell one<tr><td>Cell two</table><p>End.</p>", [*TEXTS, "Cell one", "Cell two", "End."]),
    ("<b>{p}</b><p>End <i>of <b>it</i> all</b>.</p>", [*TEXTS, "End of it all."]),
    ("{p}<ul class=social-share><li>Tweet<li>Post</ul><div id=comments><p>{l}</p></div><p class=ad-slot>{l}</p>", TEXTS),
    ("<header><h1>Title</h1></header>{p}<footer>{l}</footer><form><p>{l}</p></form>", ["Title", *TEXTS]),
])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=story>{}</div>"])
def test_nothing_of_the_article_is_lost(inner, want, wrap):
    if "<header>" in inner and "div" in wrap:
        want = want[1:]  # without an article element, a header is the page's
    body = inner.replace("{p}", BODY).replace("{l}", LONG)
    text = html_text.main_text(page("<nav><a href=/>Home</a></nav>" + wrap.replace("{}", body) + "<div class=sidebar><p>" + LONG + "</p></div>"))
    assert text.split("\n") == want


@pytest.mark.parametrize("open_tag", ["<div>", "<b>", "<li>", "<p>x<b>", "<ul><li>", "<table><tr><td>", "<div class=ad>", "<article>", "<span><article></span>", "<div><li></li>", "<dd>a</b>", "<a href=x>"])
def test_unclosed_tags_take_linear_time(open_tag):
    import time

    began = time.perf_counter()
    html_text.main_text(page(open_tag * 80_000 + "word " * 10))
    assert time.perf_counter() - began < 8


HEAD = "<nav><a href=/>Home</a><a href=/b>Blog</a></nav>"


@pytest.mark.parametrize("body", [
    "<form id=aspnetForm>" + HEAD + "<article>{p}</article><footer>{l}</footer></form>",
    "<form id=aspnetForm><div class=page>" + HEAD + "<div class=story>{p}</div><div class=sidebar>{l}</div></div></form>",
    "<form>" + HEAD + "<main>{p}</main></form><footer>{l}</footer>",
    "<nav><a href=/>Home</a><article>{p}</article>",
    "<header><h1>Site</h1><article>{p}</article>",
    "<nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul><div class=story>{p}</div>",
    "<div class=sidebar><form><article>{p}</article></form></div>",
])
def test_wrapping_forms_and_unclosed_menus_keep_the_article(body):
    assert html_text.main_text(page(body.replace("{p}", BODY).replace("{l}", LONG))).split("\n") == TEXTS


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=story>{}</div>"])
@pytest.mark.parametrize("slug", ["comments", "navigation", "social-sharing", "advertising", "related"])
def test_headings_with_slug_ids_stay(wrap, slug):
    text = html_text.main_text(page(HEAD + wrap.replace("{}", f"<h2 id={slug}>Heading</h2>{BODY}<h3 id={slug}-2>Next</h3><p>{LONG}</p>")))
    assert text.split("\n") == ["Heading", *TEXTS, "Next", LONG.strip()]


def test_sections_named_by_their_headings_stay_but_comments_go():
    inner = f"<section id=navigation><h2>Navigation</h2>{BODY}</section><section id=sharing><p>Short.</p></section><section id=comments><p>{LONG}</p></section><div id=navigation><p>{LONG}</p></div>"
    assert html_text.main_text(page(f"<article>{inner}</article>")).split("\n") == ["Navigation", *TEXTS, "Short."]


@pytest.mark.parametrize("short", ["<p id=share-prices>Up.</p>", "<p class=hidden-gems-text>Up.</p>", "<p id=comments>Up.</p>", "<div class=popular-science>Up.</div>"])
def test_short_doubtful_blocks_of_an_article_stay(short):
    assert html_text.main_text(page(f"<article>{BODY}{short}<div>x</div></article>")).split("\n") == [*TEXTS, "Up.", "x"]


def test_marked_words_within_a_sentence_stay():
    text = html_text.main_text(page(f"<article>{BODY}<p>He sold his <span class=share>last part</span> today.</p><p><span class=ad>Buy now</span></p><p><b class=promo>Buy</b> <i class=ad>now</i></p></article>"))
    assert text.split("\n") == [*TEXTS, "He sold his last part today."]


def test_articles_side_by_side_are_one():
    body = f"<main><article>{BODY}</article><article><h2>Part two</h2><p>{LONG}</p></article><div class=comments><article><p>{LONG}</p></article></div></main>"
    assert html_text.main_text(page(body)).split("\n") == [*TEXTS, "Part two", LONG.strip()]
    assert html_text.main_text(page(body.replace("main", "div"))).split("\n") == [*TEXTS, "Part two", LONG.strip()]


def test_lines_of_bare_pages():
    assert html_text.main_text(page(f"{LONG}<br>Short.<br>{LONG}")).split("\n") == [LONG.strip(), "Short.", LONG.strip()]
    body = f"<div class=story>{BODY}<ul><li><a href=1>One link</a></ul><ul><li>Plain<li><a href=2>Linked</a><li>Plain two</ul></div>"
    assert html_text.main_text(page(HEAD + body)).split("\n") == [*TEXTS, "One link", "Plain", "Linked", "Plain two"]


def test_what_hides_or_holds_little_stays_out():
    assert html_text.main_text(page(f"<div hidden><form><article>{BODY}</article></form></div>")) == ""
    assert html_text.main_text(page(f"<form><p>{LONG}</p></form><div>{BODY}</div>")).split("\n") == TEXTS
    assert html_text.main_text(page(f"<nav>{BODY}</nav><article><p>Short one.</p></article>")) == "Short one."
    assert html_text.main_text(page(f"<footer><p>{LONG}</p></footer>")) == ""
