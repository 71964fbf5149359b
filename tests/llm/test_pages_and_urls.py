"""URL filters and page texts."""

from __future__ import annotations

import pytest

from fieldloom.llm.html_wrapper import content_paths, expression, extract_pages, page_text, parse
from fieldloom.llm.html_wrapper import _merged as merged
from fieldloom.llm.queries import QUERIES
from fieldloom.llm.url_filter import build_trie, filter_urls, look_up

RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"),
    ("allow", "b.example.org", "/"), ("block", "b.example.org", "/"), ("block", "c.example.org", "/x"), ("allow", "example.org", "/x/y/z"),
]
URLS = {
    "http://a.example.com/en/712?q": ("allow", "example.com/en/7"), "http://A.Example.COM/en/812#/en/7": ("block", "com/en/"),
    "https://com/en/": ("block", "com/en/"), "http://xcom/en/": ("allow", None), "http://example.net/de/9": ("block", "net/de/"),
    "http://b.example.org/": ("block", "b.example.org/"), "http://b.example.org": ("allow", None),
    "http://c.example.org/x/y/zz": ("block", "c.example.org/x"), "http://d.example.org/x/y/zz": ("allow", "example.org/x/y/z"),
    "no scheme.com/en/": ("allow", None), None: ("allow", None), "": ("allow", None), "x://?": ("allow", None), "a://b://com/en/": ("allow", None),
}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_longest_match(spark, limit):
    """With the trie sent to the executors, and with rules that are too large for that."""
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, ("block", None, "/")], "action string, host string, path string")
    got = filter_urls(pages, rules, broadcast_bytes=limit).collect()
    assert len(got) == 2 * len(URLS)
    assert {r.url: (r.verdict, r.rule) for r in got} == URLS
    assert {(r.host, r.path) for r in got if r.url in (None, "no scheme.com/en/")} == {("", "")}
    assert {r.host for r in got if r.url and "Example" in r.url} == {"a.example.com"}


def test_the_rules_of_the_query(spark, tmp_path):
    """Each rule of the query's contract decides, subdomains included."""
    want = {
        "http://shop.com/en/1": ("block", "com/en/"), "http://a.example.com/en/70": ("allow", "example.com/en/7"),
        "http://shop.net/de/1": ("allow", "net/de/"), "http://a.example.net/de/9": ("allow", "net/de/"),
        "http://a.example.net/de/80": ("block", "example.net/de/8"), "http://x.org/es/": ("block", "org/es/"), "http://x.org/en/": ("allow", None),
    }
    rows = list(enumerate([*want, "http://shop.net/de/1"]))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op8_url_filter"](spark, str(tmp_path)).collect()
    assert {r.page_id: (r.verdict, r.rule) for r in got} == {i: want[u] for i, u in rows} and len(got) == len(rows)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "action string, host string, path string")
    assert [r.verdict for r in filter_urls(pages, none).collect()] == ["allow"]
    assert filter_urls(pages.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        filter_urls(pages, spark.createDataFrame([("maybe", "a", "/")], "action string, host string, path string"))


def test_trie_prefers_hosts_before_paths():
    trie = build_trie([("block", "b", "/long/path/"), ("allow", "a.b", "/")])
    assert look_up(trie, "x.a.b", "/long/path/1") == ("a.b/", "allow")


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="with-sidebar"><header>Site</header>
<nav><ul><li><a href=/x>Home</a><li>About</ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>
<main><h1>Title &amp; more</h1><p>One <b>two</b>three&nbsp;four<p>Five<br>six &lt;p&gt; &amp;amp;<div class=ad>Buy</div>
<ul><li>a<li>b</ul><form><input name=q>search</form><script>var a = "</p><p>";</script><!-- <p>gone</p> -->
<table><tr><td>c<td>d</table><section id="comments"><p>nice!</p></section><p hidden>no</p></main><footer>foot</footer>"""


def test_page_text():
    assert page_text(PAGE, None, None) == "Title & more One twothree four Five six <p> &amp; a b c d"
    assert page_text("", None, None) == ""
    assert page_text("plain <b>te</b>xt", None, None) == "plain text"
    assert page_text("<p>cut off <a href='x", None, None) == "cut off"
    deep = "<div>" * 300 + "x" + "</div>" * 300
    assert page_text(deep, None, None) == "x"


def page(body: str, links: int = 2) -> str:
    return f"<body><div><ul>{'<li>go</li>' * links}</ul></div><div id=box>{body}</div><p>All rights reserved</p></body>"


def test_wrapper_alignment():
    pages = [page("<h2>A</h2><p>one</p>", 2), page("<h2>B</h2><img><p>two</p><p>three</p>", 5), page("<p>four</p>", 1)]
    total = None
    for p in pages:
        own = expression(parse(p))
        total = own if total is None else merged(total, own)
    body = total["k"][0]
    assert [p["n"] for p in body["k"]] == ["div", "p"]
    box = body["k"][0]
    assert box["r"] and [(p["n"], bool(p.get("o")), bool(p.get("r"))) for p in box["k"]] == [("ul", True, False), ("h2", True, False), ("p", True, True)]
    # Nothing is marked as main text, so what all pages say is left out.
    paths, fixed = content_paths(total)
    assert paths == [""] and "All rights reserved" in fixed


def test_pages_of_hosts(spark):
    rows = [
        (1, "http://a.b/1", page("<h2>A</h2><p>one</p>")), (2, "http://a.b/2", page("<h2>B</h2><p>two</p><p>three</p>")),
        (3, "http://c.d/", PAGE), (4, "http://c.d/2", None), (5, None, ""), (6, "http://c.d/3", "<main><h1>X</h1></main>"),
        (6, "http://c.d/3", "<main><h1>X</h1></main>"), (None, "nonsense", "<p>y &eacute;"),
    ]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = sorted([(r.id or 0, r.url, r.text, r.n_chars) for r in extract_pages(frame).collect()], key=str)
    main = "Title & more One twothree four Five six <p> &amp; a b c d"
    want = [(1, "A one"), (2, "B two three"), (3, main), (4, ""), (5, ""), (6, "X"), (6, "X"), (0, "y é")]
    assert [(g[0], g[2]) for g in got] == sorted(want, key=str) or {(g[0], g[2]) for g in got} == set(want)
    assert all(g[3] == len(g[2]) for g in got) and len(got) == len(rows)
    assert extract_pages(frame.limit(0)).count() == 0


TEXT = "<p>The story begins here and goes on for a while.</p>"


@pytest.mark.parametrize("body", [
    f'<div class="content-sidebar-wrap"><main>{TEXT}</main><div class="sidebar">Side</div></div>',
    f'<div class="container with-sidebar"><article>{TEXT}</article><div class="sidebar">Side</div></div>',
    f'<div id="page" class="site has-comments">{TEXT}<div id="comments">nice</div></div>',
    f'<div class="layout-sidebar">{TEXT}<div class="left-sidebar">Side</div></div>',
    f'<div class="sidebar-right"><div class="entry">{TEXT}</div><div class="site-header">Site</div></div>',
    f'<article>{TEXT}</article><div class="related-posts"><article>Another story</article></div>',
])
def test_containers_that_name_what_they_have(spark, body):
    want = "The story begins here and goes on for a while."
    assert page_text(f"<body><nav>Home</nav>{body}</body>", None, None) == want
    # The same on a host of many pages.
    pages = [(i, "http://h.org/", f"<body><nav>Home</nav>{body.replace('while', f'while {i}')}</body>") for i in range(6)]
    got = extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {(r.id, r.text) for r in got} == {(i, want.replace("while", f"while {i}")) for i in range(6)}


def test_all_main_elements_are_taken(spark):
    """A short lead beside a long article, and a rarer layout on a host of many other pages."""
    long = "word " * 300
    pages = [(i, "http://h.org/", f'<body><section class="entry">Lead {i}</section><article>Body {i} {long}</article></body>') for i in range(20)]
    pages += [(100, "http://h.org/", '<body><article>Summary</article><div class="post">The text itself</div></body>')]
    got = {r.id: r.text for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Lead {i} Body {i} {long}".strip() for i in range(20)} | {100: "Summary The text itself"}


@pytest.mark.parametrize("tag", ["div", "center", "span", "li", "article"])
def test_very_deep_pages(spark, tag):
    """A page of 100,000 levels keeps its text and takes no longer than its length."""
    levels = 100_000
    article = "<article>kept <b>bo</b>ld<div>two</div><nav>menu</nav></article>"
    deep = "<body>" + f"<{tag}>" * levels + article + f"</{tag}>" * levels + "</body>"
    flat = "<body><div><article>other <b>te</b>xt</article></div></body>"
    frame = spark.createDataFrame(
        [(1, "http://a.x/1", deep), (2, "http://a.x/2", flat), (3, "http://b.x/", deep), (4, None, None)], "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in extract_pages(frame).collect()}
    assert got == {1: "kept bold two", 2: "other text", 3: "kept bold two", 4: ""}


def test_depth_changes_no_text():
    for levels in (10, 150, 198, 199, 200, 201, 230, 1000):
        page = "<body>" + "<div>" * levels + "x<i>y</i><aside>no</aside><main>kept<div>two</div><nav>n</nav></main> out" + "</div>z" * levels
        assert page_text(page, None, None) == "kept two"
        page = "<body>" + "<div>" * levels + "<p class='post'>a<em>b</em>c<div>d</div>" + "</div>" * levels
        assert page_text(page, None, None).split() == ["abc"] or page_text(page, None, None).split() == ["abc", "d"]
