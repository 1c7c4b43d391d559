import html
import re

from lodestack.llm import html_extract as H

HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>'


def article(page):
    """Brute force for pages that have an article element: its text, tags being breaks if they are blocks."""
    m = re.search(r"<article\b[^>]*>(.*?)(?:</article>|$)", page or "", re.S)
    body = re.sub(r"<(/?)(\w+)[^>]*>", lambda t: "" if t[2].lower() in H.INLINE else " ", m[1]) if m else ""
    return re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(body)).strip(" ")


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.url, r.text) for r in H.main_text(pages).collect()}
    assert got == {r.page_id: (r.url, article(r.html)) for r in pages.collect()}


def test_furniture_goes():
    page = HEAD + """<header><h1>Site</h1></header><nav><ul><li><a href=x>In</a></li></ul></nav><div class="cookie-notice">We use</div>
    <div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>,
    three<br>four<p>five<div class="ad box">Buy more</div><aside>see also</aside><form><input name=q>Ask</form><!-- gone --><script>if (a<b) x()</script></article>
    <section class="comments"><p>first!</p></section><div id=sidebar><p>links</p></div><footer>&copy; x</footer></body></html>"""
    items, places = H.observe(page)
    root, allowed = H.article_places({p: (n, 0) for p, n in places.items()})
    assert H.extract(page, root, frozenset(allowed)) == "A & B One two, three four five"


def test_pages_without_article_elements():
    page = HEAD + '<div id="top" class="menu"><a>x</a></div><div class="wrap"><div class="post-content"><h2>Title</h2><p>Some long text here, some more.</p></div><div class="related"><p>Other</p></div></div>'
    _, places = H.observe(page)
    root, allowed = H.article_places({p: (n, 0) for p, n in places.items()})
    assert H.extract(page, root, frozenset(allowed)) == "Title Some long text here, some more."


def test_wrapper_of_a_host():
    rows = [f"<ul>{'<li><a>x</a></li>' * n}</ul>{'<hr>' if n == 3 else ''}<p>text {n}</p>" for n in (1, 2, 3)]
    w = None
    for r in rows:
        items = H.observe(r)[0]
        w = items if w is None else H.align(w, items)
    assert H.regular_expression(w) == "<ul>(<li><a>#</a></li>)+</ul>(<hr>)?<p>#</p>"
    assert H.slots(w) == ["ul/li/a", "p"]


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "no url", "", "x"), (3, "http://a.b/c", "plain & <b>bold</b>", "x"), (None, "http://a.b/d", "<p>cut <", "x"), (3, "http://a.b/c", "plain & <b>bold</b>", "x"), (4, "http://A.b", "<article>" + "<p>word " * 3000, "x")]
    schema = "page_id bigint, url string, html string, text string"
    got = sorted(((r.page_id, r.text) for r in H.main_text(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert sorted(str(i) for i, _ in got) == sorted(str(r[0]) for r in rows)
    assert dict(got)[3] == "plain & bold" and dict(got)[1] == dict(got)[2] == "" and dict(got)[4] == " ".join(["word"] * 3000)
    assert H.main_text(spark.createDataFrame([], schema)).count() == 0


def test_wrapper_decides(spark):
    """Text that all pages of a host share is furniture under any name, and ids of single pages hide no article."""
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    page = '<body><div class="zq7"><p>Our great offers for you, read on every page, again and again</p></div><article id="post-{i}"><h1>On {w}</h1><p>{w} is here<p>and <em>more</em> {w}<div class="kx">Print this page</div></article><div class="qq">{w} elsewhere</div></body>'
    rows = [(i, f"http://h.x/{i}", page.format(i=i, w=w)) for i, w in enumerate(words)]
    rows += [(9, "http://one.x/1", page.format(i=9, w="zeta"))]  # a page alone tells nothing of its slots
    rows += [(20 + i, f"http://copies.x/{i}", page.format(i=1, w="eta")) for i in range(4)]  # nor do copies
    rows += [(30 + i, f"http://none.x/{i}", f'<div class="zq7">Our offers</div><p>only {w}</p>') for i, w in enumerate(words)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"On {w} {w} is here and more {w}" for w in words]
    assert got[9] == "On zeta zeta is here and more zeta Print this page"
    assert {got[20 + i] for i in range(4)} == {"On eta eta is here and more eta Print this page"}
    assert [got[30 + i] for i in range(5)] == [f"only {w}" for w in words]


def test_article_parts_stay():
    """Captions, slugs of headings and sections, and names of an article's own parts are no furniture."""
    body = '<div class="post-header"><p>By A</p></div><h2 id="related-work">Related work</h2><h2 id=search>Search</h2><section id="social-effects"><p>Effects</p></section><figure><img src=x><figcaption>A figure</figcaption></figure><p>The end</p><div class="related-posts"><p>More</p></div>'
    for page in (HEAD + f'<div class="menu-box">x</div><article>{body}</article><div class="share-box">y</div>', HEAD + f'<div class="menu-box">x</div><div class="post-content">{body}</div><div id="site-comments">y</div>'):
        _, places = H.observe(page)
        root, allowed = H.article_places({p: (n, 0) for p, n in places.items()})
        assert H.extract(page, root, frozenset(allowed)) == "By A Related work Search Effects A figure The end"
