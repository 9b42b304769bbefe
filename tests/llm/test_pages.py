"""WARC archives and main-text extraction: round trips and defined cases."""

import base64
import hashlib
import io
import random

import pytest

from storyloom.llm import dom, html_extract, warc

SCHEMA = "page_id bigint, url string, html string"


def test_frames_round_trip():
    records = [warc.record(f"http://a/{i}", f"<p>page {i} é</p>".encode() * (i % 40), i, None if i % 3 else 0) for i in range(200)]
    data = b"".join(warc.frames(records))
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.read_frames(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(data[:-3])))


def test_every_archive_has_a_dictionary():
    for records in ([b"x" * 3_000_000, b"", b"y"], [b"one record"], [b"abc" * 9] * 20):
        data = b"".join(warc.frames(records))
        assert list(warc.read_frames(io.BytesIO(data))) == records and int.from_bytes(data[4:8], "little") > 0


def test_revisits_name_the_record_they_repeat():
    head, _ = warc.parse(warc.record("http://b", b"same", 9, 4))
    first, _ = warc.parse(warc.record("http://a", b"same", 4, None))
    assert head["WARC-Refers-To"] == first["WARC-Record-ID"] != head["WARC-Record-ID"]
    assert warc.parse(warc.info("x.warc.zst"))[0]["WARC-Type"] == "warcinfo"


def test_archives_round_trip(spark):
    rows = [(i, f"http://h{i % 3}/{i}", f"<p>text {i % 20}</p>" * 30) for i in range(60)] + [(90, None, None), (91, "http://x", ""), (91, "http://x", ""), (None, "u", "<p>null id</p>"), (None, "v", "<p>text 5</p>" * 30), (5, "http://again", "<p>text 5</p>" * 30),
            (5, "http://other", "<p>a second payload</p>"), (7, "http://other", "<p>a second payload</p>"), (2**53 + 1, "http://big", "é" * 3_000_000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS digest", "1 AS refers_to", "2 AS again")
    got = warc.round_trip(frame.repartition(4)).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h in rows:
        h = h or ""
        revisit = h in first and first[h] != i
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want.append((i, u or "", "revisit" if revisit else "response", len(h.encode()), digest, first[h] if revisit else None, b"" if revisit else h.encode()))
    assert sorted(((*x[:6], bytes(x.payload)) for x in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header class="top"><a href="/">Site</a></header><nav><ul><li><a>Link {n}</a></li></ul></nav><div class="cookie-notice">We use cookies {n}</div>
<div id="content{n}"><article><h1>Title &amp; {n}</h1><p><b>Bold {n}<br><p>First&nbsp;para   {n}
goes on.</p><p class="subscribe">Sign up {n}</p><ul><li>One {n}<li>Two {n}</ul><p>Same on all pages.</p><section class="comments"><p>Reader {n}</p></section></article></div>
<aside>Side {n}</aside><form>Search {n}</form><footer>&copy; {n}</footer></body>"""


def test_wrapper_extracts_the_article(spark):
    rows = [(i, f"http://host/{i}", PAGE.format(n=i)) for i in range(8)] + [(50, "http://alone/1", PAGE.format(n=50)), (51, None, None), (52, "x", ""), (53, "http://host/x", "<p>plain &lt;text&gt;"), (50, "http://alone/1", PAGE.format(n=50))]
    got = {}
    for x in html_extract.main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x.page_id, []).append((x.text, x.n_chars))
    want = "Title & {n}\nBold {n}\nFirst para {n} goes on.\nOne {n}\nTwo {n}"
    for i in range(8):
        assert got[i] == [(want.format(n=i), len(want.format(n=i)))]
    alone = want.format(n=50) + "\nSame on all pages."
    assert got[50] == [(alone, len(alone))] * 2
    assert got[51] == got[52] == [("", 0)] and got[53] == [("plain <text>", 12)]
    assert html_extract.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_matching():
    a = dom.parse("<div><p>1</p><ul><li>a</ul><p>2</p></div>").nodes()[0]
    b = dom.parse("<div><p>1</p><p>2</p><ul><li>a<li>b</ul></div>").nodes()[0]
    size, pairs = dom.align(a, b)
    assert size == len(pairs) == 4  # div, p, ul and li, or div, p and p with ul and li


def test_tree_matching_against_brute_force():
    def brute(x, y):
        if x.label != y.label:
            return 0
        xs, ys = x.nodes(), y.nodes()
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, c in enumerate(xs, 1):
            for j, d in enumerate(ys, 1):
                own = brute(c, d)
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + own if own else 0)
        return 1 + best[-1][-1]

    r = random.Random(1)

    def tree(depth):
        node = dom.Node(r.choice("ab") if depth < 4 else "a")
        node.children = [tree(depth - 1) for _ in range(r.randrange(5))] if depth else []
        return node

    for _ in range(200):
        a, b = tree(4), tree(4)
        size, pairs = dom.align(a, b)
        assert size == brute(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)


NEUTRAL = """<html><body><div class="a1"><div>Home {n}</div><div>World of {m}</div></div><div class="b2">Buy {m} now, only {n} left, it is the very best of all.</div>
<div class="c3"><div class="k7">{text}<div class="q9">Quick {n} deals for you</div></div></div><div class="d4"><div>Written by robot {n}</div><div>All rights kept</div></div></body></html>"""


def test_neutral_names_are_told_by_variation(spark, prose):
    rows, want = [], {}
    for i in range(12):
        paragraphs = [prose(100 * i + k, 60) for k in range(2 + i % 5)]
        text = "".join(f"<p>{p}</p>" + ("<h3>Part</h3>" if k % 2 else "") for k, p in enumerate(paragraphs)) + "<p>Read more in our app</p>"
        rows.append((i, f"http://neutral/{i}", NEUTRAL.format(n=i, m=prose(i, 2), text=text)))
        want[i] = [line for k, p in enumerate(paragraphs) for line in ([p, "Part"] if k % 2 else [p])]
    rows += [(100 + i, u, h + " ") for i, (_, u, h) in enumerate(rows[:1] * 30)] + [(50, *rows[3][1:])] * 40
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {x.page_id: x.text.split("\n") for x in html_extract.main_text(frame).collect()}
    for i in range(12):
        lines = [x for x in got[i] if x != "Part"]
        assert lines == [x for x in want[i] if x != "Part"], i
    assert got[100] == got[0] and got[50] == got[3]
    alone = html_extract.extract(rows[0][2], None)
    assert "Buy" in alone and "Written by" in alone  # by tags and names only, the rest of the page stays


def test_deep_and_wide_pages(spark):
    deep = ["<div>" * 5000 + f"<p>core {i} of the page</p>" + "</div>" * 5000 for i in range(5)]
    wide = ["<article>" + "".join(f"<div><p>part {k} of {i}</p></div>" for k in range(600)) + "</article>" for i in range(3)]
    rows = [(i, "http://deep/x", h) for i, h in enumerate(deep)] + [(10 + i, "http://wide/x", h) for i, h in enumerate(wide)] + [(2**53 + 1, "http://big", "<p>big</p>"), (None, "http://big", "<p>none</p>")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS host", "'b' AS digest", "1 AS shape", "2 AS known").coalesce(1)
    got = {x.page_id: x.text for x in html_extract.main_text(frame).collect()}
    assert all(got[i] == f"core {i} of the page" for i in range(5))
    assert all(got[10 + i].count("\n") == 599 for i in range(3))
    assert got[2**53 + 1] == "big" and got[None] == "none"


def test_tree_matching_of_long_lists():
    middle = "<p>x <b>y</b></p>" * 150 + "<h2>z</h2>" + "<p>x</p>" * 100
    a = dom.parse(f"<div><ul></ul>{middle}<table></table></div>").nodes()[0]
    b = dom.parse(f"<div><h3>n</h3>{middle}<pre></pre></div>").nodes()[0]
    size, pairs = dom.align(a, b)
    assert size == len(pairs) == 1 + 150 * 2 + 1 + 100
    assert [dom.blocks(x) for x, _ in pairs[1:]] == [dom.blocks(y) for _, y in pairs[1:]]


def test_parser_survives_broken_pages():
    for source in ("<", "<p", "</p></div>", "<!--", "<script>", "<a href='x>y", "a<b>c</i>d", "<table><tr><td>1<td>2<tr><td>3"):
        dom.blocks(dom.parse(source))
    assert dom.blocks(dom.parse("<table><tr><td>1<td>2<tr><td>3</table>")) == ["1 2", "3"]


def test_an_articles_own_header_stays():
    page = '<header><h1>Site</h1></header><article><div class="article-header"><h1>Title</h1></div><p>Text.</p><header>Menu</header><div class="footer">x</div></article>'
    assert html_extract.extract(page, None) == "Title\nText."


def _texts(spark, pages):
    rows = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    return [r.text for r in html_extract.main_text(rows).orderBy("page_id").collect()]


def test_slots_win_over_names(spark, prose):
    """A part that holds much of the article stays whatever its name hints at; small parts of such names go."""
    page = '<body><div class="site-header"><a href="/">Home</a></div><article><p>{}</p><div class="{}"><p>{}</p></div><div class="share-buttons">Share this now</div></article></body>'
    pages = [("https://h.example/%d" % k, page.format(prose(k, 60), name, prose(50 + k, 55))) for k, name in enumerate(["ad-hoc-analysis", "side-by-side"] * 4)]
    for k, text in enumerate(_texts(spark, pages)):
        assert text == f"{prose(k, 60)}\n{prose(50 + k, 55)}"


def test_names_never_leave_a_page_empty(spark, prose):
    text = prose(1, 50)
    wrapped = [f"<body><form><p>{text}</p></form></body>", f'<div class="side-by-side"><p>{text}</p></div>', f'<div class="promo"><p>{text}</p></div>', f'<div class="comments"><p>{text}</p></div>']
    assert _texts(spark, [("https://h%d.example/a" % k, h) for k, h in enumerate(wrapped)]) == [text] * len(wrapped)
    assert _texts(spark, [("https://h.example/a", f"<nav><p>{text}</p></nav>")]) == [""]


def test_comments_go_however_long(spark, prose):
    page = '<body><div id="c"><p>{}</p><p>{}</p></div><div class="comments"><p>{}</p></div></body>'
    pages = [("https://h.example/%d" % k, page.format(prose(k, 30), prose(k + 20, 30), prose(k + 40, 200))) for k in range(6)]
    assert _texts(spark, pages) == [f"{prose(k, 30)}\n{prose(k + 20, 30)}" for k in range(6)]


def test_levels_of_names():
    from storyloom.llm import dom

    level = lambda tag, mark="": dom.apart(dom.Node(tag, mark))
    assert [level("nav"), level("form"), level("div", "ad-slot"), level("div", "sidebar"), level("div", "sign-up")] == [3, 2, 2, 2, 2]
    assert [level("div", "post-comments"), level("div", "ad-hoc-analysis"), level("div", "story"), level("article", "promo")] == [3, 1, 0, 0]
