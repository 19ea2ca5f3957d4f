import re

import pytest

from papyrium.llm import html_extract, url_filter
from papyrium.llm.html_extract import extract

LONG = "First long paragraph of text that goes on and on with plenty of words inside it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &lt; more", "just text < more"),
        ("<div>one</div><div>two</div>", "one\ntwo"),
        ("<article><p>Body a<br>b</p><section class='comments'><p>nice!</p></section></article>", "Body a\nb"),
        ("<main><div class='cookie-notice'>We use</div><p>Hello <i>wor</i>ld.</p></main><footer>x</footer>", "Hello world."),
        (f"<nav><a href=1>A</a></nav><div id=content><h1>T</h1><p>{LONG}<p>{LONG}</div><div class=sidebar>links</div>", f"T\n{LONG}\n{LONG}"),
        ("<article><p>a&nbsp;&nbsp;b\n\tc</p><script>var t='</p>';</script><style>p{}</style><!-- no --><form>f</form></article>", "a b c"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<script>only()", ""),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
        ("a < b and c > d <b>bold</b>", "a < b and c > d bold"),
        ("<article><h1>T</h1><aside>ad</aside><div hidden>no</div><p>p</p></article><div class='ad'>buy</div>", "T\np"),
    ],
)
def test_extract(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-comments", "search-result", "page-search"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
@pytest.mark.parametrize("wrap", ["<div class='{}'>{}</div>", "<div id=x class='{}'><form action=/>{}</form></div>"])
def test_wrappers_with_names_of_other_things(name, inner, wrap):
    body = inner.format(f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>")
    page = "<body><nav><a href=1>A</a></nav>" + wrap.format(name, body) + "<div class=sidebar><a href=2>links</a></div></body>"
    assert extract(page) == f"T\n{LONG}\n{LONG}"


def test_sections_and_side_blocks():
    prose = f"<article><p>{LONG}</p><section class=discussion><p>{LONG}</p></section><div class=related><a href=1>More of this</a></div></article>"
    assert extract(prose) == f"{LONG}\n{LONG}"
    # Neither a long comment section nor teasers in a sidebar outweigh an article that says it is one.
    assert extract(f"<article><p>{LONG}</p></article><div class=comments>" + f"<p>{LONG} No!</p>" * 9 + "</div>") == LONG
    assert extract(f"<div><p>{LONG}</p><p>{LONG}</p></div><aside class=related><article><a href=1>teaser</a></article></aside>") == f"{LONG}\n{LONG}"


def test_long_and_deep_pages():
    assert extract("<div>" * 4000 + "deep") == "deep"
    assert extract("<p>" + "word " * 200_000).count(" ") == 199_999
    assert len(extract("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").split("\n")) == 3000


def test_pages(spark):
    rows = [(1, "u", "<article>x</article>"), (2, None, None), (None, "v", ""), (1, "u", "<article>x</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS text")
    found = sorted((str(r["page_id"]), r["text"]) for r in html_extract.extract_pages(df).collect())
    assert found == [("1", "x"), ("1", "x"), ("2", ""), ("None", "")]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


URLS = [
    "http://a.org/x", "https://Sub.ORG/", "http://example.org/es/q", "http://www.example.org/en/12?x=/es/", "http://example.org/en/2", "http://notexample.org/es/",
    "http://x.com/fr/1#a", "http://x.com/de/1", "http://x.com/en/", "http://com/fr/", "ftp://x.net/cheap", "no scheme", None, "", "http://org", "http://x.org?/a", "a://b://c/d", "http://é.com/fr/é",
]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_urls(spark, tmp_path):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(100 + i, f"http://h{i}.{'org/a' if i % 2 else 'com/de/'}{i}", "") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS host").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: r for r in url_filter.op8_url_filter(spark, str(tmp_path)).collect()}
    for i, u, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = (m[1] if m else "").translate({c: c + 32 for c in range(65, 91)})
        path = m[2] if m else ""
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, best[1]), u
        assert found[i]["verdict"] in ("allow", "block") and (best[2] is None or found[i]["verdict"] == best[2])
    only = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert url_filter.judge(only).first()["verdict"] == "allow"
    assert url_filter.judge(only.limit(0)).count() == 0


def test_ratio_tells_classes_apart(spark):
    rows = [(f"cheap-pills{i}.net/buy/{i}", "block") for i in range(80)] + [(f"library{i}.net/read/{i}", "allow") for i in range(80)]
    labels = spark.createDataFrame(rows, "text string, verdict string")
    pages = spark.createDataFrame([(1, "http://cheap-pills999.net/buy/7"), (2, "http://library999.net/read/7")], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels=labels).collect()}
    assert found == {1: "block", 2: "allow"}
