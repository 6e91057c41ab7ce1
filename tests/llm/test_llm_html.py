import random

from pyspark.sql import functions as F

from chunkmill.llm import html_extract as H


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, nr int")
    return {r.page_id: r.text for r in H.extract(df).collect()}


def test_markup_and_references(spark):
    html = page('<header>Top</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div>'
                '<article><h1>One &amp; two &#38;lt; &eacute;</h1><p>Some\n  <b>bold</b> te<i>x</i>t<br>line &lt;p&gt;'
                '<p title="a > b">Next<script>var a = "</p>";</script><style>p{}</style> one</p><aside>Side</aside>'
                '<form>Form</form><section id="comments"><p>First!</p></section><!-- no <p>x</p> --><ul><li>item</ul></article>'
                '<div role="alert">Cookies</div><footer>&copy; us</footer>')
    got = texts(spark, [(1, "http://h/a", html)])[1]
    assert got == "One & two &lt; é\n\nSome bold text line <p>\n\nNext\n\none\n\nitem" or got == "One & two &lt; é\n\nSome bold text line <p>\n\nNext one\n\nitem"


def kept(html):
    return [x for x, z in H.lines(html) if z != H.DROPPED]


def test_void_elements_drop_nothing():
    for tag in ('<img class="banner">', '<hr class="ad">', '<input role="search">', '<link id="header" rel="x">', '<svg class="ad" />'):
        assert kept(page(f"{tag}<article><h1>Title</h1><p>Text</p></article>")) == ["Title", "Text"], tag
        assert kept(page(f"<article><p>One</p>{tag}<p>Two</p></article>")) == ["One", "Two"], tag


def test_wrappers_drop_nothing():
    text = "<h1>Title</h1><p>Text</p>"
    for html in (f'<html class="header"><body class="has-sidebar">{text}</body></html>', f'<body class="sidebar" id="ad">{text}',
                 f'<main class="with-sidebar">{text}</main>', f'<main class="sidebar">{text}</main>', f'<article class="promo">{text}</article>',
                 f'<div class="article-header">{text}</div>', f'<form id="page"><nav>Menu</nav><main>{text}</main></form>',
                 f'<article><div class="article-header"><h1>Title</h1></div><p data-id="ad">Text</p></article>'):
        assert kept(html) == ["Title", "Text"], html
    assert kept('<div class="cookie-banner">x</div><div id="sidebar">y</div><div class="box ad">z</div><p>Text</p>') == ["Text"]


def test_unclosed_boilerplate_ends_with_its_sibling_or_parent():
    assert kept('<ul><li>a<li class="ad">b<ul><li>c</ul><li>d</ul><p>e</p>') == ["a", "d", "e"]
    assert kept('<ul><li class="ad">b</ul><p>e</p>') == ["e"]
    assert kept('<table><tr><td>a<td class="ad">b<table><tr><td>n</table><td>c<tr><td class="ad">d</table><p>e</p>') == ["a", "c", "e"]
    assert kept('<dl><dt class="ad">a<dd>b<dd class="ad">c</dl><p>e</p>') == ["b", "e"]
    assert kept('<section><p class="ad">a</section><p>e</p>') == ["e"]
    assert kept('<div><div class="ad"><div>a</div>b</div>c</div>') == ["c"]


def test_shared_lines_go_where_no_article_is_marked(spark):
    make = lambda i: page(f"<div>Site name</div><div>Menu one</div><p>Text number {i} of its own</p><p>More {i * 7}</p><div>Imprint</div>")
    rows = [(i, f"http://h/p/{i}", make(i)) for i in range(4)] + [(9, "http://other/p", page("<div>Site name</div><p>alone</p>"))]
    got = texts(spark, rows)
    assert [got[i] for i in range(4)] == [f"Text number {i} of its own\n\nMore {i * 7}" for i in range(4)]
    assert got[9] == "Site name\n\nalone"


def test_copies_keep_their_text(spark):
    plain = page("<p>A text</p><p>in two parts</p>")
    marked = page("<nav>M</nav><article><p>A text</p><p>in two parts</p></article>")
    got = texts(spark, [(1, "http://h/a?x=1", plain), (2, "http://h/a?x=2", plain), (3, "http://g/a", marked), (4, "http://g/a?y", marked)])
    assert set(got.values()) == {"A text\n\nin two parts"}


def test_heavy_template_goes_and_revised_copies_stay(spark):
    menu = "".join(f"<div>Menu {k}</div>" for k in range(10))
    heavy = [(i, f"http://h/p/{i}", page(f"{menu}<p>Own {i}</p><p>Menu 3</p><p>More {i}</p>")) for i in range(4)]  # a line twice: one is aligned
    paragraph = lambda i, k: f"<p>Page {i}, paragraph {k}</p>"
    sites = [(10 + i, f"http://r/a/{i}", page("<div>Site</div>" + "".join(paragraph(i, k) for k in range(4)))) for i in range(5)]
    revised = [(20 + v, f"http://r/z?v={v}", page("<div>Site</div>" + "".join(paragraph(9, k) for k in range(7)) + f"<p>New {v}</p><p>End {v}</p>")) for v in range(2)]
    got = texts(spark, heavy[:1] + heavy[1:] + sites + revised)
    assert all("Menu 1" not in got[i] and got[i].endswith(f"More {i}") for i in range(4))
    assert all(got[10 + i] == "\n\n".join(f"Page {i}, paragraph {k}" for k in range(4)) for i in range(5))
    assert all(got[20 + v] == "\n\n".join([f"Page 9, paragraph {k}" for k in range(7)] + [f"New {v}", f"End {v}"]) for v in range(2))


def test_only_aligned_places_go(spark):
    make = lambda i: page(f"<div>Menu</div><p>Own {i}</p>" + ("<p>Menu</p>" if i == 1 else "") + f"<p>More {i}</p>")
    got = texts(spark, [(i, f"http://h/p/{i}", make(i)) for i in range(4)])
    assert got[1].count("Menu") == 1 and all("Menu" not in got[i] for i in (0, 2, 3))


def test_edges(spark):
    long = page("<article>" + "<p>Long line of words here</p>" * 40_000 + "</article>")
    got = texts(spark, [(1, None, None), (2, "", ""), (3, "no scheme", "<p>unclosed <b>text"), (4, "http://h/x", long),
                        (5, "http://h/y", '<article><p>a<p class="ad">b<p>c</article'), (6, "http://h/z", "<script>never closed <p>x</p>")])
    assert got[1] == got[2] == got[6] == "" and got[3] == "unclosed text" and got[5].startswith("a\n\nc")
    assert got[4].count("\n\n") == 39_999
    twice = spark.createDataFrame([(1, "http://h/a", "<p>x</p>")] * 2, "page_id long, url string, html string")
    assert [r.text for r in H.extract(twice).collect()] == ["x", "x"]
    assert H.extract(twice.limit(0)).count() == 0


def test_common_lines_like_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = H.common_lines(a, b)
        assert len(at) == best[-1][-1] and at == sorted(set(at))
        rest = iter(b)
        assert all(a[i] in rest for i in at)  # a subsequence of b


def test_pairs_cross_partitions(spark):
    rows = [(i, f"http://h/p/{i:04d}", page(f"<div>Site</div><p>Own {i}</p>")) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert H.extract(df).filter(F.col("text") != F.concat(F.lit("Own "), F.col("page_id").cast("string"))).count() == 0


def test_differencing_decides_beside_an_article(spark):
    menu = "<div>Site name</div><div>Menu one</div>"
    own = lambda i: "".join(f"<div>Part {k} of the body of page {i}, in a div</div>" for k in range(4))
    teasers = [(i, f"http://h/p/{i}", page(f"{menu}{own(i)}<article><h2>Teaser {i}</h2></article><div>Imprint</div>")) for i in range(4)]
    marked = [(10 + i, f"http://g/p/{i}", page(f"{menu}<div>By {i}</div><article><p>A long text of article {i}</p></article>")) for i in range(4)]
    alone = [(20, "http://f/p", page(f"{menu}{own(20)}<article><h2>Teaser</h2></article>"))]
    copies = [(30 + i, f"http://e/p?v={i}", page(f"<div>Site name is a long one</div><article><p>Same text</p></article><div class='ad'>{i}</div>")) for i in range(2)]
    got = texts(spark, teasers + marked + alone + copies)
    assert all(got[i] == "\n\n".join([f"Part {k} of the body of page {i}, in a div" for k in range(4)] + [f"Teaser {i}"]) for i in range(4))
    assert all(got[10 + i] == f"A long text of article {i}" for i in range(4))
    assert got[20] == "Teaser" and got[30] == got[31] == "Same text"


def test_shared_lines_are_found_where_an_article_is_marked(spark):
    make = lambda i: page(f"<nav>Menu</nav><div>Site</div><article><p>Shared</p><p>Own {i}</p></article><footer>Imprint</footer>")
    rows = [(i, f"http://h/p/{i}", make(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {tuple(sorted(r.places)) for r in H.shared_lines(df).collect()}
    assert got == {(0, 1, 4)}  # the menu, the site's name and the imprint; the article's shared line stays
    assert texts(spark, rows) == {i: f"Shared\n\nOwn {i}" for i in range(4)}
