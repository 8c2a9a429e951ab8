import random
from itertools import product

from odd_rows import odd
from pyspark.sql import functions as F

from ticktape.llm import min_cut, tables

STORY = "The town of the hill was built by the river, and it is known for its old bridge."
MORE = "It was opened in the spring of that year, with a fair for all of the people in the valley."


def page(main, before="", after=""):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{before}<article>{main}</article>{after}</body></html>"


def test_boilerplate_is_left_out():
    body = f"<h1>Old &amp; new</h1><p>{STORY}</p><p>{MORE}</p>"
    want = f"Old & new\n\n{STORY}\n\n{MORE}"
    before = '<header><a href="/">Home</a> The site of the town</header><nav><ul><li><a href="/a">News</a></li></ul></nav>'
    before += "<div class='cookie-notice'>We use cookies on the site, and with it you agree to the terms of use.</div>"
    after = f'<aside><p>{MORE}</p></aside><div id="comments"><p>I was in the town and it was the best of days.</p></div>'
    after += '<form><p>Search the site</p><input value="x"><button>Go</button></form><footer>&copy; The town</footer><script>var a = "<p>no</p>";</script>'
    assert min_cut.main_text(page(body, before, after)) == want
    assert min_cut.main_text(page(body + '<div class="ad">Buy the best of bridges now.</div>', before, after)) == want
    # without an article element, text decides
    loose = page(body, before, after).replace("article>", "div>")
    assert min_cut.main_text(loose) == want


def test_names_that_mislead():
    inner = f'<div class="article-header"><h1>Old bridge</h1></div><p>{STORY}</p><p>{MORE}</p><div class="article-footer">Filed under the bridges.</div>'
    want = f"Old bridge\n\n{STORY}\n\n{MORE}"
    assert min_cut.main_text(page(inner)) == want
    assert min_cut.main_text(f'<body class="home"><div class="layout has-sidebar">{page(inner)}<div class="sidebar-wrapper"><p>{MORE}</p></div></div>') == want
    assert min_cut.main_text(f'<body><form id="whole"><p>Search the site of the town for it.</p><main>{inner}</main></form>') == want
    replies = f'<div id="comments"><article class="comment"><p>{MORE}</p></article></div>'
    assert min_cut.main_text(page(inner, after=replies)) == want


def test_markup_inside_blocks():
    cases = {
        "<p>a  <b>bold</b>\n\tword<br>next</p>": "a bold word next",
        "<p>one<p>two <i>three": "one\n\ntwo three",
        "<p>x &lt;tag&gt; &#233; &#x41; &nbsp;y</p>": "x <tag> é A y",
        "<p>5 < 6 and <3</p>": "5 < 6 and <3",
        "<ul><li>first<li>second</ul>": "first\n\nsecond",
        "<p>cut <!-- <p>no</p> -->off</p><scr": "cut off",
        '<p title="a > b">kept</p><p': "kept",
        "<P CLASS=lead>Upper</P>": "Upper",
    }
    for markup, want in cases.items():
        assert "\n\n".join(b.text for b in min_cut.blocks(f"<body>{markup}")) == want, markup


def test_minimum_cut_against_every_labelling():
    rng = random.Random(10)
    for _ in range(150):
        n = rng.randint(1, 7)
        odds = [rng.randint(-30, 30) / 10 for _ in range(n)]
        edges = [(a, b, rng.randint(0, 20) / 10) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(chosen):
            own = sum(abs(o) for o, c in zip(odds, chosen) if (o > 0) != c and o)
            return round(1000 * own + 1000 * sum(w for a, b, w in edges if chosen[a] != chosen[b]))

        got = min_cut.labels(odds, edges)
        assert cost(got) == min(cost(c) for c in product((False, True), repeat=n))


def test_long_and_broken_pages():
    assert min_cut.main_text("") == "" and min_cut.main_text("<" * 1000) != None  # noqa: E711
    long = page("".join(f"<p>{STORY} {i}</p>" for i in range(5000)))
    assert min_cut.main_text(long).count("\n\n") == 4999
    assert min_cut.blocks("<div>" * 3000 + "deep" + "</div>" * 3000)[0].text == "deep"
    min_cut.main_text('<a "' * 2000)


def test_pages_give_their_articles(spark, sf_dir):
    import html
    import re

    rows = min_cut.extracted(tables.pages(spark, sf_dir)).select("row.html", "text").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        body = re.sub(r"<[^>]*$", "", body).replace("<br>", " ").replace("<b>", "")
        parts = [" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(p for p in parts if p)


def test_odd_pages(spark):
    pages = odd(spark).select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), "key", "row")
    rows = min_cut.extracted(pages).collect()
    assert len(rows) == pages.count()
    assert all(r["text"] == "" for r in rows if not (r["row"]["html"] or "").strip())
    assert min_cut.extracted(pages.where("false")).count() == 0


def test_values_are_not_attributes():
    """Words inside another attribute's value, or of a longer name, say nothing about an element."""
    want = f"Of the old mill.\n\n{STORY}\n\n{MORE}"
    for link in (
        '<a href="https://x.org/hidden-gems">the old mill</a>', "<a href=https://x.org/hidden>the old mill</a>",
        '<span title="hidden valley">the old mill</span>', "<span data-x='style=display:none hidden'>the old mill</span>",
        '<span data-hidden aria-hidden="false">the old mill</span>', '<span title="a > b, hidden">the old mill</span>',
    ):
        assert min_cut.main_text(page(f"<p>Of {link}.</p><p>{STORY}</p><p>{MORE}</p>")) == want, link
    for attributes in ('data-role="search"', 'data-id="related-7"', "my-class=sidebar", 'data-kind="x" data-style="display:none"'):
        loose = page(f"<p>Of the old mill.</p><p>{STORY}</p><div {attributes}><p>{MORE}</p></div>").replace("article>", "div>")
        assert min_cut.main_text(loose) == want, attributes
    for gone in ("hidden", "HIDDEN=''", 'style="color:red; display : none"', "aria-hidden=true", "title='x' hidden"):
        assert min_cut.main_text(page(f"<p>{STORY}</p><p {gone}>{MORE}</p>")) == STORY, gone
    for gone in ('class="sidebar"', "id=comments", "CLASS='x sidebar'", 'role="search"'):
        assert min_cut.main_text(page(f"<p>{STORY}</p>", after=f"<div {gone}><p>{MORE}</p></div>")) == STORY, gone


def test_tags_of_any_length():
    for n in (10, 25_000, 300_000):
        menu = f"<div class=menu data-x='{'y' * n}'><p>{MORE}</p></div>"
        assert min_cut.main_text(page(f"<p>{STORY}</p>", before=menu).replace("article>", "div>")) == STORY


def test_broken_tags_are_read_in_one_go():
    import time

    begin = time.perf_counter()
    for broken in ('<b "', "<b '", "<b \"'", '<b x="'):
        min_cut.main_text(page(f"<p>{STORY}</p>") + broken * 100_001)
    assert time.perf_counter() - begin < 30
