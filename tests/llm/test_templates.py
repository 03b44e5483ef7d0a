"""Main text of pages: reading, references, and templates counted per host."""

import html as markup
import re

import pytest

from reviewmill.llm import html_tree
from reviewmill.llm import templates as tp
from reviewmill.llm.html_tree import read_page

SF = "/root/testdata/sf0.001"


def text(html):
    _, _, blocks = read_page(html)
    return " ".join([t for t, main, _ in blocks if main] or [t for t, _, _ in blocks])


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b <p>c", "a < b c"), ("<p>one<p>two<br>three", "one two three"),
    ("<p>so<b>me</b>thing</p>", "something"), ("<script>var a='<p>no</p>'</script><p>yes", "yes"), ("<p>x<!-- <p>no</p> -->y", "xy"),
    ("<article><h1>T</h1><p>b</p></article><footer>f</footer>", "T b"), ("<nav>n</nav><main><p>m</p><aside>s</aside></main>", "m"),
    ("<div class='cookie-notice'>c</div><p>body</p>", "body"), ("<div class=ad><article>kept</article>", "kept"),
    ("<article>a<form>f</form><div id='comments'>c</div></article>", "a"), ("<p hidden>no</p><p>&eacute;&#233;&#xe9;", "ééé"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a b 1 2"), ("<p>a\n\t b&nbsp; c</p>", "a b c"), ("<p>broken <p class=\"x", "broken"),
    ("<style>p{}</style><title>t</title><body class='sidebar-left'><p>kept", "kept"), ("<p>a</p></div></p>b", "a b"),
    ("<article><header><h1>Title</h1></header><p>x</article>", "Title x"), ("<header>site</header><p>x", "x"),
    ("<article>main</article><article class='comment'>no</article>", "main"),
    ("<main><p>Real story</p></main><div class='comments'><article><p>first comment</p></article></div>", "Real story"),
    ("<div id=c><p>The text</p></div><article class='comment'>c1</article><article class='comment'>c2</article>", "The text"),
    ("<article><p>Real story.</p><div class='comments'><article><p>c1</p></article></div></article>", "Real story."),
    ("<div class='post with-sidebar'><p>Body</p></div>", "Body"), ("<div class='sidebar layout'><p>Body</p></div>", "Body"),
    ("<div class=sidebar><article>teaser</article></div><p>A much longer body than that</p>", "A much longer body than that"),
    ("<div class=sidebar><article>an article in a frame</article><nav>menu</nav></div>", "an article in a frame"),
    ("<article></article><p>body", "body"), ("<article class='post comments-open'>body</article>", "body"),
    ("<span><article>in</article>out</span>", "in"), ("a<article>b</article>c<article>d</article>e", "b d"), ("<" * 2000, "<" * 2000),
    ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
])
def test_reading(html, want):
    assert text(html) == want


def test_equals_the_articles_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in tp.op4_html_main_text(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, h in pages.items():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", h, re.S)[1]
        want = " ".join(markup.unescape(re.sub(r"</?(p|h1|br|b)>", lambda m: "" if m[1] == "b" else " ", body)).split())
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def test_recurring_subtrees_are_removed_per_host(spark):
    rows = [(i, f"http://a.example/{i}", f"<div><p>All about us since 19{i:02}</p></div><p>Text number {'x' * i}.</p>") for i in range(20)]
    rows += [(100 + i, f"https://user@B.example:8080/{i}", "<div><p>All about us since 1999</p></div><p>Other</p>") for i in range(2)]
    # Copies of one page are one page: its content is no template.
    rows += [(200 + i, "http://c.example", "<div><p>The same page</p></div>") for i in range(40)]
    rows += [(300 + i, "http://d.example", f"<article><p>A shared passage.</p><div>Follow us</div><p>{'y' * i}</p></article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in tp.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text number {'x' * i}." for i in range(20))
    assert got[100] == "All about us since 1999 Other"
    assert got[200] == "The same page"
    assert got[303] == "A shared passage. yyy"


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "", "", "x"), (1, "", "", "x"), (2, "::", "<p>t", "x"), (3, "http://h/", "<p>" + "long words " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumns(
        {c: tp.F.col("host") for c in ("blocks", "page", "row", "gone", "page_hash")})
    out = tp.extract_main_text(df)
    assert out.columns == [c for c in df.columns if c != "html"] + ["text"]
    texts = sorted(r["text"] for r in out.collect())
    assert texts == ["", "", "", ("long words " * 50_000).strip(), "t"]
    assert tp.extract_main_text(df.limit(0)).collect() == []


def test_a_box_on_many_pages_goes_whatever_the_size_of_the_host(spark):
    # 200 pages; 20 adverts in turn, each on 10 different pages, and one box on fewer than MIN_PAGES.
    rows = [(i, f"http://big.example/{i}", f"<div><p>Buy product {'abcdefghijklmnopqrst'[i % 20]} today</p></div><p>Text number {'x' * i}.</p>") for i in range(200)]
    rows += [(200 + i, f"http://big.example/{i}", f"<div><p>A rare box</p></div><p>Other {'y' * i}.</p>") for i in range(tp.MIN_PAGES - 1)]
    got = {r["page_id"]: r["text"] for r in tp.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text number {'x' * i}." for i in range(200))
    assert all(got[200 + i] == f"A rare box Other {'y' * i}." for i in range(tp.MIN_PAGES - 1))


def _frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_a_box_shown_as_an_article_everywhere_is_none(spark):
    teaser = "<div id=t><article><p>Read our prize story</p></article></div>"
    rows = [(i, "http://a.example/", f"{teaser}<div><p>The real text {'z' * (i + 1)} of this page</p></div>") for i in range(8)]
    # Copies of one article with other words around them: it stays.
    rows += [(100 + i, "http://b.example/", f"<article><p>A story told by many</p></article><p>{'w' * (i + 1)}</p>") for i in range(8)]
    got = {r["page_id"]: r for r in tp.extract_main_text(_frame(spark, rows)).collect()}
    assert all(got[i]["text"] == f"The real text {'z' * (i + 1)} of this page" for i in range(8))
    assert all(got[100 + i]["text"] == "A story told by many" for i in range(8))


LISTS = [("MARKS", set()), ("COMMENTS", set()), ("ROLES", set()), ("ARTICLES", set()), ("DROPPED", {"head", "script", "style"})]


@pytest.mark.parametrize("lists", [True, False])
def test_counts_over_a_table_equal_a_plain_count(spark, monkeypatch, lists):
    for name, value in [] if lists else LISTS:
        monkeypatch.setattr(html_tree, name, value)
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    seen, of_page = {}, {}
    for r in pages:
        host = re.match(r"^(?:https?:)?//(?:[^/?#@]*@)?([^/?#:]*)", r["url"] or "")
        known_by, subtrees, blocks = read_page(r["html"] or "")
        keys = {(host[1].lower() if host else "", s): s for s in subtrees}
        of_page[r["page_id"]] = keys, blocks
        for k in keys:
            seen.setdefault(k, set()).add(known_by)
    got = {r["page_id"]: r for r in tp.op4_html_main_text(spark, sf).collect()}
    assert set(got) == set(of_page)
    for i, (keys, blocks) in of_page.items():
        gone = {s for k, s in keys.items() if len(seen[k]) >= tp.MIN_PAGES}
        stays = [(t, main) for t, main, path in blocks if gone.isdisjoint(path)]
        assert got[i]["text"] == " ".join([t for t, main in stays if main] or [t for t, _ in stays])
    frame = spark.createDataFrame(pages)
    counted = tp.site_templates(tp.read_pages(frame, tp.F.col("page_id"))).collect()
    assert {(r["host"], r["subtree"]) for r in counted} == {k for k, on in seen.items() if len(on) >= tp.MIN_PAGES}
    assert len(counted) == len({tuple(r) for r in counted}) > 50


def test_counting_alone_finds_menus_and_footers(spark, monkeypatch):
    """Without any list of tags or words, the menu, notice and footer of a site still go."""
    for name, value in LISTS:
        monkeypatch.setattr(html_tree, name, value)
    page = "<nav><ul><li>Home<li>News</ul></nav><div class=cookie>We use cookies</div><article><p>{}</p></article><footer>Page {} of our site</footer>"
    rows = [(i, "http://a.example/", page.format(f"Story {'s' * i}", i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in tp.extract_main_text(_frame(spark, rows)).collect()}
    assert got == {i: f"Story {'s' * i}".strip() for i in range(9)}
