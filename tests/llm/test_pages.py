"""Main text of pages."""

from sparkweave.llm import pages


def test_main_part():
    page = (
        '<!DOCTYPE html><html><head><title>T&amp;</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">m</a></li></ul></nav>'
        '<!-- ad --><div class="ad">buy</div><article><h1>Head &am</h1><p><b>a</b>b &lt;c&gt;\n  d<br>e<p>f<aside>side</aside><div class="comments">no</div></p></article><footer>&copy; x</footer>'
    )
    assert pages.main_text(page) == "Head &am ab <c> d e f"
    assert pages.main_text("") == "" and pages.main_text(None) == ""
    assert pages.main_text("<p>plain <i>t</i>ext<p>two") == "plain text two"
    assert pages.main_text("<article>a<article>b</article>c</article><article>d</article>") == "a b c d"


def test_style_tree(spark):
    rows = [(k, f"http://h.example.org/{k}", f"<body><div class=top>Same words everywhere</div><div class=text><p>Body {k} é</div>", "x") for k in range(8)]
    rows += [(100, None, None, "x"), (101, "no url", "", "x"), (102, "http://single.org/", "<div class=top>once</div>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert [got[k] for k in range(8)] == [f"Body {k} é" for k in range(8)]
    assert got[100] == "" and got[101] == "" and got[102] == "once"
    assert pages.extract(df.limit(0)).count() == 0


def test_verdicts_hold_inside_main_parts(spark):
    box = "<div><p>Read our other offers today</div>"
    rows = [(k, f"http://a.org/{k}", f"<body><article><p>Own words {k}<ul><li>point {k}</ul>{box}</article>") for k in range(6)]
    rows += [(10 + k, f"http://copies.org/{k}", f"<body><article><p>One page{box}</article>") for k in range(6)]  # copies are one page
    rows += [(20, "http://one.org/", "<body><article><p>Tables" + "<table><tr><td>x</table>" * 5 + "</article>")]
    rows += [(30 + k, f"http://only.org/{k}", f"<title>{k}</title><body><article>{box}</article>") for k in range(6)]  # never emptied
    deep = "<div class=wrapping-element-of-a-page>" * 12
    rows += [(40 + k, f"http://deep.org/{k}", f"<body><section>{deep}<p>Text {k}{'</div>' * 12}</section><form></form><ol>{deep}<p>All the same{'</div>' * 12}</ol>") for k in range(6)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(6)] == [f"Own words {k} point {k}" for k in range(6)]
    assert {got[10 + k] for k in range(6)} == {"One page Read our other offers today"}
    assert got[20] == "Tables x x x x x"
    assert {got[30 + k] for k in range(6)} == {"Read our other offers today"}
    assert [got[40 + k] for k in range(6)] == [f"Text {k}" for k in range(6)]


def test_paths_are_whole():
    deep = "<div class=wrapping-element-of-a-page>" * 12
    paths = [p for p, _, _ in pages.nodes_of(f"<section>{deep}{'</div>' * 12}</section><ol>{deep}{'</div>' * 12}</ol>")]
    assert len(paths) == len(set(paths)) == 26
    assert pages.main_text(f"<main>{deep}<article>a</article>{'</div>' * 12}</main><article>b</article>") == "a b"


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<div>" * 20000 + "x", "<a " * 30000, "<a \"" * 30001, "<p>" + "<" * 30000, "<!--" * 20000, "<div>a" * 8000 + "</div>" * 8000):
        began = time.time()
        pages.main_text(page)
        pages.nodes_of(page)
        assert time.time() - began < 5, page[:20]
    assert pages.main_text("<p>1 < 2 <b class='x>y'>bold</b> <i title=\">\">it</i></p>") == "1 < 2 bold it"
