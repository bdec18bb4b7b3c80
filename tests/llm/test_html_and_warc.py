import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from attestry.llm import html_wrappers as hw
from attestry.llm import warc
from attestry.llm.queries import ORACLE_SQL, QUERIES


def alone(page):
    return hw.article_text(page, hw.roles(hw.page_wrapper(page)))


PARTS = {
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav>": "menu", "<header><h1>Site</h1></header>": "header", "<footer>&copy; x</footer>": "footer", "<aside>side</aside>": "sidebar", "<div class='cookie-notice'>We use cookies</div>": "notice",
    "<div class=\"ad\">Buy</div>": "advert", "<section class='reader-comments'><p>Me too</p></section>": "comments", "<div class='related-articles'><p>More</p></div>": "teasers", "<div class='privacy-notice wide'>We</div>": "notice", "<form><p>Your name<input></p></form>": "form", "<script>var t='</p>';</script>": "script", "<style>p{}</style>": "style", "<section id='comments'><p>First!</p></section>": "comments", "<!-- hidden <p>x</p> -->": "comment", "<div id=\"sidebarLeft\"><p>more</p></div>": "sidebar", "<div hidden>no</div>": "hidden",
}


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("inside", [False, True])
def test_furniture_is_left_out(part, inside):
    if inside and part.startswith("<header"):
        pytest.skip("a header inside an article holds its title")
    article = f"<article><h1>Title</h1><p>First &amp; <b>bold</b>\n text.</p>{part if inside else ''}<p>Second.</p></article>"
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{'' if inside else part}{article}{'' if inside else part}</body></html>"
    assert alone(page) == "Title\nFirst & bold text.\nSecond."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one<p>two<br>more", "one\ntwo more"), ("<ul><li>a<li>b</ul>", "a\nb"), ("a&nbsp;b &#233;&amp;lt; &bogus;", "a b é&lt; &bogus;"), ("", ""), ("plain", "plain"), ("<p>a</p>\n\n  <p> </p><p>b", "a\nb"),
        ("<main><div class='related'>x</div><div><p>y</p></div></main>", "y"), ("<p>x<!-- never closed <p>y", "x"), ("<p title='a>b'>t</p><p title=\"open>u", "t\nu"), ("<div>" * 3000 + "deep", "deep"), ("</p></div>x</b>", "x"), ("1 < 2 <3", "1 < 2 <3"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<div class='topbar'>n</div><div id='content'><h2>T</h2>B</div>", "T\nB"), ("<body class='has-sidebar'><article>x</article>", "x"), ("<article>a<article class='comment'>c</article></article>", "a"),
    ],
)
def test_blocks(page, want):
    assert alone(page) == want


def wrapper_of(pages):
    w = None
    for p in pages:
        w = hw.page_wrapper(p, w)
    return w


def test_wrappers_infer_groups_options_and_slots():
    pages = ["<div><h2>A</h2><p>1</p><p>2</p></div><i>same</i>", "<div><h2>B</h2><p>3</p><em>x</em></div><i>same</i>"]
    assert wrapper_of(pages).expression() == 'div(h2(#) p(#)+ em("x")?) i("same")'
    assert wrapper_of(["<dl><dt>a<dd>b<dt>c<dd>d</dl>"]).expression() == "dl((dd(#)+ dt(#)+)+)"
    assert wrapper_of(["<p>a</p><ul>b</ul>", "<ul>c</ul><p>d</p>", "<p>e</p>"]).expression() == "(p(#) ul(#)?)+"
    w = wrapper_of(pages)
    assert hw.read_wrapper(w.flat()).flat() == w.flat()


def test_aligning_is_commutative_and_associative():
    rng = random.Random(3)
    part = lambda: "".join(f"<{(t := rng.choice(['p', 'div', 'ul', 'b']))} class='{rng.choice('abcd') * rng.randint(1, 3)}{rng.choice('xyz') * rng.randint(0, 40)}'>{rng.choice(['same', 'other', ''])}</{t}>" for _ in range(rng.randint(0, 90)))
    pages = [f"<div>{part()}</div>{part()}" for _ in range(12)]
    whole = wrapper_of(pages)
    want = whole.flat()
    assert "p" in whole.wide and not wrapper_of(pages[:1]).wide  # some parts narrow only when aligned
    for _ in range(20):
        parts = [wrapper_of([p]) for p in pages]
        while len(parts) > 1:
            rng.shuffle(parts)
            parts[0].align(parts.pop())
        assert parts[0].flat() == want


def test_a_wrapper_stays_small():
    page = "".join(f"<h{i % 5 + 1}>x</h{i % 5 + 1}><x{i % 60}>y</x{i % 60}><p class='u{chr(97 + i % 26) * (i // 26 + 1)}'>z</p>" for i in range(2000))
    w = wrapper_of([page, page[500:]])
    assert w.nodes() < 150 and alone(page).count("z") == 2000


def extracted(spark, rows):
    return hw.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()


def test_template_texts_go(spark):
    page = "<div>Follow us today</div><div><p>text {0}</p></div><p>All rights</p>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(8)]
    assert {(r.page_id, r.text) for r in extracted(spark, rows)} == {(i, f"Follow us today\ntext {i}") for i in range(8)}  # one kind of div
    rows = [(i, u, h.replace("<div>F", "<div class='us'>F")) for i, u, h in rows]
    assert {(r.page_id, r.text) for r in extracted(spark, rows)} == {(i, f"text {i}") for i in range(8)}
    assert alone(rows[0][2]) == "Follow us today\ntext 0\nAll rights"
    same = [(i, f"http://h.example/{i}", f"<nav>{i}</nav><article><p>copy</p></article>") for i in range(8)]
    assert {r.text for r in extracted(spark, same)} == {"copy"}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 30])
def test_what_all_articles_of_a_host_have_stays_at_any_number_of_pages(spark, n):
    page = "<body><div class='promo-box'>{1}</div><article><h1>t{0}</h1><p>By Ann Lee</p><p>body of some length {0}</p><div class='follow'>Follow us</div></article></body>"
    got = texts_of(spark, [(f"http://x.org/{i}", page.format(i, "w " * 200)) for i in range(n)])
    assert got == [f"t{i}\nBy Ann Lee\nbody of some length {i}" + ("\nFollow us" if n == 1 else "") for i in range(n)]


NAMED_IN_ARTICLES = "<p class='legal'>L</p><p class='share-quote'>S</p><div class='notice-period'>N</div><section id='discussion'><h2 id='legal-basis'>H</h2>D</section><section id='related-work'>R</section><p class='notice'>P</p><p>E = <math><mi>m</mi></math><svg/>c</p>"


def test_class_words_alone_take_nothing_out_of_an_article(spark):
    page = "<body><div class='layout-sidebar'><article class='post comments-open'><p>x {0}</p>" + NAMED_IN_ARTICLES.replace("<p class='notice'>P", "<p class='notice'>P{0}") + "</article><div class='cookie-bar'>{0} biscuits</div></div></body>"
    want = [f"x {i}\nL\nS\nN\nH\nD\nR\nP{i}\nE = mc" for i in range(3)]
    assert [alone(page.format(i)) for i in range(3)] == want
    # the same text in all articles, under a name that may be furniture's, is the template's
    assert texts_of(spark, [(f"http://x.org/{i}", page.format(i)) for i in range(3)]) == [w.replace("\nL\nS\nN", "").replace("\nH\nD\nR", "") for w in want]


def test_what_holds_the_article_stays(spark):
    for page in ("<form><div class='overlay'><p>{0} {1}</p></div><p>end {0}</p></form>", "<div class='banner'><main><p>{0} {1}</p><p>end {0}</p></main></div><aside><article>teaser {0}</article></aside>"):
        pages = [(f"http://x.org/{i}", page.format(i, "words " * 9)) for i in range(4)]
        assert texts_of(spark, pages) == [f"{i} {'words ' * 9}".strip() + f"\nend {i}" for i in range(4)] == [alone(h) for _, h in pages]


def test_several_templates_of_a_host_in_any_order(spark):
    """Articles of known blocks in four templates; nothing but the wrapper tells menus, teasers and footers from them."""
    rng = random.Random(8)
    menu = "<ul class='m'>" + "".join(f"<li><a href='/{i}'>go {i}</a></li>" for i in range(6)) + "</ul>"
    end = "<div class='low'><p>Printed in town.</p><p>Call 555.</p></div>"
    templates = [
        "<body>" + menu + "<div class='c1'>{0}</div>" + end + "</body>",
        "<body><table><tr><td>" + menu + "</td><td>{0}</td></tr></table><section class='off'>Ask <b>our</b> staff</section></body>",
        "<body><div class='top'>The Daily</div>{0}<p class='sign'>Yours, the desk</p></body>",
        "<body><div class='promo-bar'>{1} offers</div><main>{0}</main>" + end + "</body>",
    ]
    pages, want = [], []
    for i in range(40):
        blocks = [f"Title {i}", *[f"block {i} {k} {rng.random()}" for k in range(rng.randint(1, 5))]]
        html = f"<h1>{blocks[0]}</h1>" + "".join(f"<{t}>{b}</{t}>" for b in blocks[1:] for t in [rng.choice(["p", "p", "blockquote", "pre"])])
        pages.append((i, "http://many.org/x", templates[i % 4].format(html, i)))
        want.append("\n".join(blocks))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    runs = []
    for way in (df.orderBy("page_id").coalesce(1), df.orderBy(F.desc("page_id")).repartition(7), df.repartition(3, "html")):
        runs.append([w.wrapper for w in hw.host_wrappers(way).collect()])
        assert [r.text for r in sorted(hw.extract(way).collect(), key=lambda r: r.page_id)] == want
    assert len(runs[0]) == 1 and runs[0] == runs[1] == runs[2]
    alone_too = [alone(h) == w for (_, _, h), w in zip(pages, want, strict=True)]
    assert sum(alone_too) <= 20  # the wrapper decides the rest


def test_a_host_in_many_tasks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(hw, "FAN_IN", 2)
    monkeypatch.setattr(hw, "SHARE_PAGES", 7)
    monkeypatch.setattr(hw, "fits_broadcast", lambda df: False)
    page = "<div class='top'>The Daily</div><p>text {0}</p>"
    rows = [(i % 50, "http://hot.org/" if i % 10 else None, page.format(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    assert sorted(r.text for r in hw.extract(df).collect()) == sorted(f"text {i}" for i in range(90))


def test_pages(spark, table):
    pages = table("pages")
    got = {r.page_id: r for r in QUERIES["op1_html_wrappers"](spark, "/root/testdata/sf0.001").collect()}
    for p in pages.collect():
        body = p.html.split("<article>", 1)[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?p>|</?h1>", body)]
        want = "\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, host string, wrapper string, text string"
    rows = [(1, None, "<p>x"), (2, "http://a.b/c", None), (None, "no url", "<p>y"), (4, "http://a.b/c", "<p>" + "z " * 100_000), (4, "http://a.b/c", "<p>" + "z " * 100_000)]
    got = hw.extract(spark.createDataFrame([(*r, "h", "w", "t") for r in rows], schema)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 1), ("2", 0), ("4", 199_999), ("4", 199_999), ("None", 1)]
    assert hw.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#f", "example.com/a?a=1&b=2"), ("https://e.com", "e.com"), ("e.com/A//", "e.com/A"), ("https://e.com/?ref=x", "e.com"), ("http://e.com:8080/x?", "e.com:8080/x"), (None, None), ("", "")],
)
def test_canonical_urls(spark, url, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


RECORD = "record_id long, url string, type string, time long, etag string, last_modified string, headers map<string,string>, outcome string"


def test_resolution(spark):
    r = [
        (1, "http://e.com/a", "response", 10, '"x"', None, {"Content-Type": "t", "Date": "1", "Content-Length": "5"}), (2, "https://www.e.com/a#f", "revisit", 20, 'W/"x"', None, {"date": "2", "content-length": "0", "Expires": "9"}),
        (3, "http://e.com/a", "response", 20, '"y"', None, {}), (4, "http://e.com/a", "revisit", 21, '"x"', None, {}), (5, "http://e.com/b", "revisit", 5, None, None, None), (6, "http://e.com/b", "response", 5, None, "m", {"a": "b"}),
        (7, "http://e.com/b", "revisit", 6, None, None, None), (8, "http://e.com/b", "revisit", 7, None, "m", None), (9, None, "revisit", 7, None, None, None), (10, "http://e.com/b", "revisit", None, None, None, None), (11, None, "response", 7, None, None, None),
    ]
    got = {x.record_id: x for x in warc.resolve(spark.createDataFrame([(*x, "old") for x in r], RECORD)).collect()}
    assert {k: (x.outcome, x.source_id) for k, x in got.items()} == {1: ("full", None), 2: ("resolved", 1), 3: ("full", None), 4: ("mismatch", 3), 5: ("orphan", None), 6: ("full", None), 7: ("unverified", 6), 8: ("resolved", 6), 9: ("orphan", None), 10: ("orphan", None), 11: ("full", None)}
    assert got[2].merged_headers == {"Content-Type": "t", "Content-Length": "5", "date": "2", "Expires": "9"} and got[8].merged_headers == {"a": "b"} and got[4].merged_headers is None
    assert warc.resolve(spark.createDataFrame([], RECORD)).count() == 0


def test_a_hot_url_over_many_tasks(spark):
    rows = [(i, "http://hot.example/", "response" if i % 50 == 7 else "revisit", i, "e", None, None, None) for i in range(3000)]
    got = {x.record_id: x.source_id for x in warc.resolve(spark.createDataFrame(rows, RECORD).repartition(7)).where("type = 'revisit'").collect()}
    last = None
    for i in range(3000):
        if i % 50 == 7:
            last = i
        else:
            assert got[i] == last


def brute(rows):
    """A row for each row: (record_id, source_id), by looking at all responses."""
    out = []
    for i, url, kind, time, etag, *_ in rows:
        if kind == "response" or None in (i, url, time):
            out.append((i, None))
        else:
            before = [(r[3], r[0], r[4]) for r in rows if r[2] == "response" and r[1] == url and None not in (r[0], r[3]) and r[3] < time]
            out.append((i, max(before)[1] if before else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_ids_rows_and_nulls_against_brute_force(spark, seed):
    rng = random.Random(seed)
    some = lambda x, p=0.1: None if rng.random() < p else x
    rows = [(some(i // 2), some(rng.choice(["h.example", "h.example", f"e.com/{i % 9}"]), 0.4), rng.choice(["response", "revisit", "revisit", "revisit"]), some(rng.randint(0, 300)), f"t{i // 2}", None, {"a": str(i)}) for i in range(800)]
    rows += rows[:40] * 3
    df = spark.createDataFrame([(*x, "old") for x in rows], RECORD).repartition(5)
    assert sorted([(x.record_id, x.source_id) for x in warc.resolve(df).collect()], key=str) == brute(rows)


def test_a_repeated_page_gives_a_row_for_each(spark):
    pages = [(i, f"http://e.com/{i}", "x") for i in (1, 2, 3, 3)]
    assert warc.resolved_captures(spark.createDataFrame(pages, "page_id long, url string, html string")).count() == 8


def test_captures_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    want = {tuple(r) for r in con.sql("select record_id, canonical_url, type, capture_time, source_id, outcome, merged_headers from (" + ORACLE_SQL["op4_warc_revisits"] + ")").fetchall()}
    assert {tuple(r) for r in QUERIES["op4_warc_revisits"](spark, "/root/testdata/sf0.001").collect()} == want


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(hw.extract(df).collect(), key=lambda r: r.page_id)]


def test_pages_of_another_template_keep_their_text(spark):
    a, b, c = "<body><nav>menu</nav><article><p>one {0}</p></article></body>", "<body><nav>menu</nav><div class='content'><p>two {0}</p></div><p>beside</p></body>", "<body><nav>menu</nav><p>three {0}</p></body>"
    for url in ("http://x.org/{0}", None, "/rel/{0}"):
        pages = [(url and url.format(i), t.format(i)) for i, t in enumerate([a, b, c, a, b, c])]
        assert texts_of(spark, pages) == ["one 0", "two 1", "three 2", "one 3", "two 4", "three 5"]


def test_only_what_all_articles_share_is_the_templates(spark):
    page = "<body>{2}<p>text {0} <strong>Note:</strong> of {1}</p>" + "<div class='by'>{3}</div></body>"
    quote, line = "<blockquote>a passage</blockquote>", "Published with the press. " + "All of this stands under every article. " * 9
    copies = [page.format("same " * 200, "one", quote, line)] * 8
    others = [page.format(f"w{i} " * 200, f"v{i}", "", line) for i in range(8)]
    got = texts_of(spark, [(f"http://x.org/{i}", h) for i, h in enumerate(copies + others)])
    assert got == [f"a passage\ntext {'same ' * 200}Note: of one"] * 8 + [f"text {f'w{i} ' * 200}Note: of v{i}" for i in range(8)]


def test_text_and_furniture_after_and_in_a_deep_nest():
    deep = "<div>" * 130 + "<p>x</p><p>y</p><nav>menu</nav>" + "</div>" * 130
    page = f"<body><div><article>{deep}<p>after</p></article></div></body>"
    assert alone(page).split() == ["x", "y", "after"]
    left_open = "<font><b>" * 100
    assert alone(f"<body><article><p>one</p>{left_open}two<nav>menu</nav><div class='comments'>said</div> three").split() == ["one", "two", "three"]
