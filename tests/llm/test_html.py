"""Main text of pages made here, and repeated runs against all pairs of pages."""

import html as references
import random
import re
import time

import numpy as np
import pytest
from stratalens.llm import html

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p><article>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article class="post ad-free-reading"><h1>Title &amp; more</h1><p><b>First  para<br>graph&nbsp;here.<p>Second &lt;b&gt; &#233;&#x1F600; &copy
<div class="share-buttons">Share</div><form>Mail <input></form><aside>Side</aside><ul><li>one<li>two</ul><pre>a
 b</pre><p></p><section class="comments"><p>A reader says</p></section></article><footer>&copy; host</footer>"""


def test_blocks():
    assert html.blocks(PAGE) == (True, ["Title & more", "First para graph here.", "Second <b> é😀 ©", "one", "two", "a b"])
    assert html.blocks(None) == html.blocks("") == (False, [])
    assert html.blocks("plain & simple &am") == (False, ["plain & simple &am"])
    assert html.blocks("<p>cut <a href='x") == (False, ["cut"])
    assert html.blocks("<article>a < b <1> &lt;</article>") == (True, ["a < b <1> <"])
    assert html.blocks("<main><p>x" + "<div>" * 5000 + "y")[1] == ["x", "y"]


def test_table_pages(spark, data):
    got = {r.page_id: r for r in html.main_text(spark.read.parquet(f"{data}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(references.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def covered(texts, run=8, pages=3):
    """By text, which tokens are covered, from the definition: all runs of every distinct stream."""
    streams = {" ".join(t.split()) for t in texts}
    runs = {s: {tuple(s.split()[i : i + run]) for i in range(len(s.split()) - run + 1)} for s in streams}
    count = {}
    for r in runs.values():
        for x in r:
            count[x] = count.get(x, 0) + 1
    out = {}
    for t in texts:
        tokens, gone = t.split(), set()
        for k in range(len(tokens) - run + 1):
            if count[tuple(tokens[k : k + run])] >= pages:
                gone |= set(range(k, k + run))
        out[t] = gone
    return out


@pytest.mark.parametrize("shard", [html.SHARD_BYTES, 700])
def test_repeats_against_all_pairs(spark, shard):
    rng = random.Random(2)
    common = [f"c{i}" for i in range(25)]
    pages = []
    for i in range(60):
        own = [f"u{rng.randrange(60)}" for _ in range(rng.randrange(30))]
        pages.append((i, f"http://h{i % 2}/x", " ".join(own[:9]) + "\n" + " ".join(common[rng.randrange(9) :][: rng.randrange(20)]) + "\n" + " ".join(own[9:])))
    pages += [(100 + i, u, t) for i, (_, u, t) in enumerate(pages[:20])]
    rows = [(i, u, "".join(f"<p>{x}</p>" for x in t.split("\n"))) for i, u, t in pages]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_bytes=shard).collect()}
    assert len(got) == len(rows) and sum(r.repeated_tokens for r in got.values()) > 300
    for host in ("http://h0/x", "http://h1/x"):
        gone = covered([t for _, u, t in pages if u == host])
        for i, _, text in [p for p in pages if p[1] == host]:
            want, at = [], 0
            for line in text.split("\n"):
                n = len(line.split())
                want.append(" ".join(w for k, w in enumerate(line.split(), at) if k not in gone[text]))
                at += n
            assert got[i].text == "\n".join(w for w in want if w)
            assert got[i].repeated_tokens == len(gone[text])


def test_array_is_sorted_and_complete():
    rng = np.random.default_rng(4)
    for run in (1, 3, 5, 8):
        streams = [rng.integers(1, 4, rng.integers(0, 60)).astype(np.uint64) for _ in range(12)]
        array = html.HostArray.build(streams, run)
        suffix = lambda i: tuple(array.text[i : i + run])
        assert [suffix(i) for i in array.at] == sorted(suffix(i) for i in array.at)
        assert len(array.at) == sum(max(0, len(s) - run + 1) for s in streams)
        number, pages = array.groups()
        for k in range(len(pages)):
            mine = {suffix(i) for i in array.at[number == k]}
            assert len(mine) == 1
            assert pages[k] == sum(any(tuple(s[j : j + run]) in mine for j in range(len(s) - run + 1)) for s in streams)
        assert len(set(array.fingerprints(run).tolist())) == len(pages)


def test_every_page_goes_through_the_array(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r.page_id: r.repeated_tokens for r in html.main_text(spark.createDataFrame(pages)).collect()}
    hosts = {}
    for r in pages:
        hosts.setdefault(re.match(r"\w+://([^/?#]*)", r.url)[1] if r.url else "", {})[r.page_id] = "\n".join(html.parse(r.html).texts)
    for texts in hosts.values():
        gone = covered(list(texts.values()))
        assert all(got[i] == len(gone[t]) for i, t in texts.items())


def test_odd_rows(spark):
    bare = "<body><p>About us and our company terms and conditions here today</p><p>own text {}</p>"
    rows = [(None, None, None), (1, "x", ""), (2, "http://a.b/", PAGE), (2, "http://a.b/", PAGE)] + [(10 + i, "http://h/" + str(i), bare.format(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS id", "'h' AS host", "2 AS shard", "3 AS of")
    got = html.main_text(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.text for r in got if r.page_id and r.page_id >= 10) == [str(i) for i in range(5)]  # "own text" stands in repeated runs
    assert [r.text for r in got if r.page_id is None or r.page_id == 1] == ["", ""]
    assert html.main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_stay(spark):
    one = " ".join(f"w{i}" for i in range(30))
    menu = "home news about contact terms privacy help imprint jobs "
    rows = [(i, "http://a.b/" + str(i), f"<body><p>{one}</p>") for i in range(3)] + [(9, "http://a.b/0", f"<body><p>{one}</p>")] * 2
    rows += [(20 + i, None, f"<body><div>{one}</div>") for i in range(4)]  # hosts unknown
    rows += [(30 + i // 2, "http://c.d/" + str(i), f"<body><p>{menu}</p><p>own{i // 2}</p>") for i in range(6)]  # three pages, each twice
    rows += [(40 + i // 2, "http://e.f/" + str(i), f"<body><p>{menu}</p><p>own{i // 2}</p>") for i in range(4)]  # two pages, each twice
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 30:
            assert r.text == one and r.n_chars == len(one)
        elif r.page_id < 40:
            assert r.text == f"own{r.page_id - 30}"
        else:
            assert r.text == menu.strip() + f"\nown{r.page_id - 40}"


def test_names_of_layouts():
    for name in ("layout has-sidebar", "no-sidebar", "with-sidebar", "comments-open", "promo-free", "menu-open", "sidebar", "page widget-area", "content-sidebar-wrap"):
        for inner in ("<main><article><p>Text</p></article></main>", "<main><p>Text</p></main>", "<article><p>Text</p></article>", "<div role=main><p>Text</p></div>", "<div role='main' class='sidebar'>Text</div>"):
            for page in (f"<body><div class='{name}'>{inner}</div></body>", f"<header>h</header><a>Go</a><section id='x' class='{name}'><div class='modal'>{inner}</div><div class='ads'>Buy</div></section>"):
                assert html.blocks(page) == (True, ["Text"]), page
        assert html.blocks(f"<article><p>A</p><div class='{name}'>b</div></article>")[1] == (["A"] if name in ("sidebar", "page widget-area") else ["A", "b"])
    for name in ("share-price", "related-work", "social-history", "notice-of-meeting", "subscription-model"):
        assert html.blocks(f"<main><p id='{name}'>Text</p></main>") == (True, ["Text"])
    for name in ("ad", "ads", "ad-300x250", "cookie_notice", "site-header", "main-menu", "footer-widgets", "share-buttons big", "comment-list", "related-posts", "sidebar__inner", "breadcrumbs"):
        assert html.blocks(f"<main><p>Text</p><div class='{name}'>out</div></main>") == (True, ["Text"]), name


def test_articles_that_are_not_the_text():
    said = "<div id='comments'><article>I agree</article><article>So do I</article></div>"
    assert html.blocks("<body><div><p>The text of the page itself.</p></div>" + said) == (False, ["The text of the page itself."])
    assert html.blocks("<main><p>The text of the page itself.</p>" + said + "</main>") == (True, ["The text of the page itself."])
    assert html.blocks("<article>Short</article>" + said) == (True, ["Short"])
    assert html.blocks("<div class='sidebar'><nav><main>no</main></nav></div><p>yes") == (False, ["yes"])
    assert html.blocks("<main><h1>Title</h1><div class='sidebar'><article>The whole article is here.</article></div></main>") == (True, ["Title", "The whole article is here."])


def test_comments_ids_and_teasers(spark):
    main = "<main><article><h1>Title</h1><h2 id='related-work'>Related work</h2><p id='menu'>The menu of the day, told at length and with care.</p></article>"
    want = ["Title", "Related work", "The menu of the day, told at length and with care."]
    assert html.blocks(main + "<article class='comment'>I agree</article></main>") == (True, want)
    assert html.blocks(main + "<article class='user-comment-3 odd'>I agree at great length, and this is why I do so every day and all of the night.</article></main>") == (True, want)
    assert html.blocks(main + "<article><a href='/x'>Next</a></article></main>") == (True, want)
    assert html.blocks("<!-- <article> --><script>'<main>'</script><p>All of it</p>") == (False, ["All of it"])
    assert html.blocks("<p class='ad'>Buy<p>Text") == (False, ["Text"])
    # a teaser as long as the article goes once it stands on three pages
    teaser = "<article>" + " ".join(f"t{i}" for i in range(12)) + "</article>"
    rows = [(i, "http://a.b/c", f"<article><p>{' '.join(f'own{i}x{k}' for k in range(14))}</p></article>{teaser if i < 3 else ''}") for i in range(4)]
    rows += [(9, "http://x.y/", f"<article>{' '.join(f'z{k}' for k in range(14))}</article>{teaser}")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(f"own{i}x{k}" for k in range(14)) for i in range(4))
    assert got[9].endswith("t11")  # once on its host, so it stays


def test_time_is_linear_in_nesting():
    began = time.process_time()
    for page in ("<div>" * 200_000, "<p>x" + "<object>" * 3000 + "<div>" * 100_000, "<p>a<b>" * 100_000, "</div>" * 200_000 + "<div>" * 100_000, "<main><article>" * 50_000):
        html.blocks(page)
    assert time.process_time() - began < 15
    assert html.blocks("<article>" + "<div>" * 200_000 + "deep" + "</div>" * 200_000 + "<p>end</article><p>x")[1] == ["deep", "end"]
