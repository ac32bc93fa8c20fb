import time

from cellwright.llm import html_text as ht
from cellwright.llm.html_text import extract, main_text, op2_main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this long advert now, it is very long indeed.</div>
<article><h1>Head&nbsp;line</h1><p><b>First   <i>part</i>.<br><p>Second &lt;part&gt;</p><ul><li>one<li>two</ul>
<section class="comments"><p>a reader writes much more than the article itself ever did, and then some</p></section></article>
<footer>&copy; me</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Head line\nFirst part.\nSecond <part>\none\ntwo"


def test_without_article_element():
    page = """<body><header><h1>Site</h1></header><div id="top"><a href=a>a</a> <a href=b>b</a> <a href=c>c</a></div>
    <div class=content><h2>Title</h2><div><p>A long first paragraph of the story, it goes on.</p><p>A second paragraph, just as long as that.</p></div></div>
    <aside><p>Not this text, which is in a side bar.</p></aside><form><p>Sign here please, thank you.</p></form></body>"""
    assert main_text(page) == "Title\nA long first paragraph of the story, it goes on.\nA second paragraph, just as long as that."


def test_short_parts_beside_the_body_text():
    head, lead, part, long = "H" * 40, "l" * 150, "s" * 150, ["x" * 500 for _ in range(5)]
    links = "".join(f"<li><a href=x>Link number {k}</a>" for k in range(20))
    body = "".join(f"<p>{x}</p>" for x in long)
    page = f"""<body><div><p><b>Plain</b> words above links</p><h3>More</h3><ul>{links}</ul></div><div id=content><h1>{head}</h1><p>By <a href=x>A. Long Name</a></p>
    <p>{lead}</p>Bare <i>te</i>xt<div class=text>{body}</div><div><p>{part}</p><p>{part}</p></div>tail<ul>{links}</ul></div><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></body>"""
    assert main_text(page).split("\n") == ["Plain words above links", head, "By A. Long Name", lead, "Bare text", *long, part, part, "tail"]
    assert main_text(f"<h2><a href=x>{head}</a></h2>{body}") == "\n".join([head, *long])
    assert main_text("<div><ul>" * 2000 + links + "</ul></div>" * 2000 + body) == "\n".join(long)


def test_articles_and_what_is_beside_them():
    links = "<div>" + "".join(f"<a href=x>Link number {k}</a> " for k in range(20)) + "</div>"
    a, b, c = "a" * 300, "b" * 300, "c" * 300
    assert main_text(f"<main><h1>Title</h1>{links}<article><p>{a}</p><p>{b}</p></article></main>") == f"Title\n{a}\n{b}"
    assert main_text(f"<body>{links}<article><p>{a}</p></article>{links}<article><p>{b}</p><p>{c}</p></article>{links}</body>") == f"{a}\n{b}\n{c}"
    assert main_text(f"<body>{links}<article><p>{a}</article>{links}<article>{b}</article></body>") == f"{a}\n{b}"
    assert main_text(f"<body><h1>Title</h1><p>Lead</p><article><p>{a}<p>{b}{links}</article>{links}</body>").startswith(f"Title\nLead\n{a}\n{b}\nLink number 0")
    cards = "".join(f"<article><a href=x>Other story {k}</a></article>" for k in range(5))
    assert main_text(f"<body><main><article><p>{a}<p>{b}</article></main><div>{cards}</div></body>") == f"{a}\n{b}"


def test_layout_named_like_a_cut_part():
    a, b = "a" * 300, "b" * 300
    story, note = f"<p>{a}</p><p>{b}</p>", "<p>not the story but a note</p>"
    for open_, close in (("<div class='content has-sidebar'>", "</div>"), ("<div id='page-with-nav'>", "</div>"), ("<section class='related-topic'>", "</section>"), ("<div class=widget>", "</div>")):
        for text in (story, f"<article>{story}</article>", f"<main><article>{story}</article></main>"):
            for more in ("", f"<div class=sidebar>{note}</div>", f"<div class='ad-box'>{note}</div>", f"<div id=comments><article>{note}</article></div>"):
                assert main_text(f"<body>{open_}{more}{text}{more}{close}</body>") == f"{a}\n{b}"
                assert main_text(f"<body>{more}{open_}{text}{close}{more}</body>") == f"{a}\n{b}"
    cards = f"<div class='related-posts'><article>{note}</article></div>"
    assert main_text(f"<body><main><p>{a}</p><div class='content has-sidebar'><p>{b}</p>{story}</div></main></body>") == f"{a}\n{b}\n{a}\n{b}"
    assert main_text(f"<body><article>{story}{cards}</article><div class=comments>{story}{story}</div></body>") == f"{a}\n{b}"


def test_cut_parts_without_end_tags():
    a, b = "a" * 300, "b" * 300
    for cut in ("class='notice'", "hidden", "role=status", "style='display: none'"):
        assert main_text(f"<body><article><p {cut}>Note<p>{a}<p>{b}</article></body>") == f"{a}\n{b}"
        assert main_text(f"<body><article><p {cut}>Note <b>bold<div>{a}</div><p>{b}</article></body>") == f"{a}\n{b}"
        assert main_text(f"<body><article><ul><li {cut}>Note<ul><li>x<li>y</ul><li>{a}<li>{b}</ul></article></body>") == f"{a}\n{b}"
        assert main_text(f"<body><article><ul><li>{a}<li {cut}>Note</ul><p>{b}</article></body>") == f"{a}\n{b}"
    assert main_text("<article><p>one <svg><text>x</text></svg>two <select><option>y<option>z</select>three</article>") == "one two three"
    assert main_text(f"<html><head><noscript><p>x</head><body><nav><p>menu<p>menu</nav><article>{a}<aside>x</article>{b}</body>") == f"{a}\n{b}"


def test_formulas_and_fallback_text():
    math = "<math><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mi>y</mi></mrow><annotation encoding='application/x-tex'>x^2=y</annotation></semantics></math>"
    assert main_text(f"<article><p>Let {math} hold.</p><p>Second</p></article>") == "Let x2=y hold.\nSecond"
    for tag in ("object", "map", "audio", "video"):
        assert main_text(f"<article><p>See <{tag}><source src=x>a chart</{tag}> here.</p><{tag}><p>Fallback</p></{tag}></article>") == "See a chart here.\nFallback"


def test_edges():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<p>" * 3000 + "x") == "x"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<article>a<b title='>'>b</b> < c</article>") == "ab < c"


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "u", "old"), (1, "<p>new</p>", None, None)], "page_id long, html string, url string, text string")
    assert sorted(r.text for r in extract(df).collect()) == ["", "new"]
    assert extract(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = op2_main_text(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) for r in rows)


def test_time_grows_with_the_page():
    """Malformed pages that a search through all open elements, or to the end of the page, makes quadratic."""
    made = [
        lambda n: "<div>" * n + "</b>" * n,
        lambda n: '<a "' * n,
        lambda n: "<a " * n,
        lambda n: "<table><tr><td><table>" + "<div>" * n + "<td></td>" * n,
        lambda n: "<b>" * n + "<hr>" * n,
        lambda n: "<script>x</script " * n,
    ]
    for page in made:
        begin = time.perf_counter()
        ht.main_text(page(30_000))
        assert time.perf_counter() - begin < 15
    assert ht.main_text("<p>one two</p>" + '<a "' * 50_000).startswith("one two")


def test_extra_columns_nulls_and_repeats(spark):
    rows = [(1, "u", "<p>one</p>", "t", "h"), (1, "u", "<p>one</p>", "t", "h"), (None, None, None, None, None), (2, "u", "", "t", "h"), (3, "u", "<p>" + "long " * 500_000, "t", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string, __html string")
    got = ht.extract(pages)
    assert got.columns == ["page_id", "url", "html", "__html", "text"]
    assert sorted((r.page_id or 0, len(r.text), r["__html"]) for r in got.collect()) == [(0, 0, None), (1, 3, "h"), (1, 3, "h"), (2, 0, "h"), (3, 2_499_999, "h")]
    assert ht.extract(pages, out="html").columns == ["page_id", "url", "Text", "__html", "html"]
    assert ht.extract(pages.limit(0)).count() == 0
