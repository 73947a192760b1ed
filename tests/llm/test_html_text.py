import random

import pytest
from pyspark.sql import functions as F

from waylark.llm import html_text
from waylark.llm.html_text import lines, main_text, shared

PAGES = "page_id bigint, url string, html string"


def text_of(html, nearest=None):
    return main_text(lines(html), lines(nearest) if nearest else None)[0]


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<article></article>", ""),
    ("<article><h1>Title</h1><p>One\n two&nbsp;&amp; three.</p><p>Four</article>", "Title\nOne two & three.\nFour"),
    ("<article><p><b>Open bold.<br><p>Next<p>Last</article><p>outside", "Open bold.\nNext\nLast"),
    ("<article><p>A<script>var t='</p>';x(1<2)</script>B<style>p{}</style></p></article>", "AB"),
    ("<article><p>a<!-- <p>no</p> -->b</p><div class='ad'>Buy</div><aside>side</aside><p>c</p></article>", "ab\nc"),
    ("<article><p>in</p><section id=comments><p>Reader says</p></section></article>", "in"),
    ("<article><header><h1>Head</h1></header><p>x</p><footer>by me</footer></article>", "Head\nx"),
    ("<body><nav><a href=/>Home</a></nav><main><div class='cookie-notice'>Ok?</div><p>Main</p></main><form>f</form>", "Main"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one\ntwo\nc1\nc2"),
    ("<article><p title='a > b'>quoted</p><p>cut &am", "quoted\ncut &am"),
    ("<article><p>&lt;b&gt; &#233;&#x41;&copy &quo</p></article>", "<b> éA© &quo"),
    ("<article><p>never ended <p", "never ended"),
    ("<ARTICLE><P CLASS=\"Text Body\">Upper</P><DIV CLASS='SIDEBAR'>no</DIV></ARTICLE>", "Upper"),
    ("<article><p hidden>secret</p><p>seen <em>and</em> <span>more</span></p></article>", "seen and more"),
    ("<article><p>one <span class=ad>buy</span>two <button>Like</button>three</p></article>", "one two three"),
    ("<script>never closed <article><p>x</p>", ""),
    ("<article><p>heads and adverbs</p><p class='header-image'>kept</p></article>", "heads and adverbs\nkept"),
])
def test_blocks(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize("html,text", [
    ("<body class='right-sidebar'><article><p>in</p></article></body>", "in"),
    ("<html class='has-navbar'><body id=search><p>in</p></body></html>", "in"),
    ("<div class='layout has-navbar'><article><p>in</p></article></div>", "in"),
    ("<div class='page sidebar-left'><nav>n</nav><main><p>in</p></main></div>", "in"),
    ("<form id=f><nav>n</nav><article><p>in</p></article></form>", "in"),
    ("<form id=f><nav>n</nav><p>in</p><div class=menu>m</div></form>", "in"),
    ("<main><form><article><p>in</p></article></form></main>", "in"),
    ("<div class='sidebar'><main><p>in</p></main></div>", "in"),
    ("<div class='c-sidebar'><article><p>in</p></article><div class='related-posts'><article>no</article></div></div>", "in"),
    ("<article><p>in</p></article><div class='related-posts'><article>no</article></div>", "in"),
    ("<div id=content><p>the text of the page</p></div><div class='related-posts'><article>no</article></div>", "the text of the page"),
    ("<div class=sidebar><article>no</article></div><p>in</p>", "in"),
    ("<aside><article>no</article></aside><nav><main>no</main></nav><p>in</p>", "in"),
    ("<article><section id='related-work'><h2 id='social-impact'>a</h2><div id='search-algorithms'>b</div></section></article>", "a\nb"),
    ("<article><h2 id='search'>a</h2><p data-id='ad' data-class=menu>b</p><div class='x social share'>no</div></article>", "a\nb"),
    ("<article><p>in</p><form>no</form><div class=comments><article>no</article></div></article>", "in"),
])
def test_wrappers_and_names_made_from_headings(html, text):
    assert text_of(html) == text


def test_pages_without_landmarks_lose_what_the_nearest_has():
    one = "<body><div>Site name</div><div>Only here</div><p>Shared tail</p></body>"
    two = "<body><div>Site name</div><p>Other text</p><p>Shared tail</p></body>"
    assert text_of(one, two) == "Only here"
    assert text_of(two, one) == "Other text"
    assert text_of(one) == "Site name\nOnly here\nShared tail"
    inside = "<article><p>Site name</p><p>Only here</p></article>"
    assert text_of(inside, two) == "Site name\nOnly here"


@pytest.mark.parametrize("seed", range(30))
def test_shared_is_a_longest_common_subsequence(seed):
    random.seed(seed)
    one, two = ([random.choice("abcde") for _ in range(random.randint(0, 14))] for _ in range(2))
    table = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    kept = [one[k] for k in sorted(shared(one, two))]
    assert len(kept) == table[-1][-1]
    rest = iter(two)
    assert all(x in rest for x in kept)


def site(rng, host, n):
    return [
        (rng.randint(0, 10**6), f"https://{host}/{rng.choice('ab')}/{rng.randint(0, 500)}?q={k}",
         f"<div>{host} menu</div><div>{rng.randint(0, 10**9)}</div><p>{host} foot</p>")
        for k in range(n)]


def brute(rows):
    key = lambda r: (*html_text.host_and_path(r[1]), r[1] is not None, r[1] or "", r[0] is not None, r[0] or 0)
    order = sorted(rows, key=key)
    out = []
    for k, row in enumerate(order):
        host, path = html_text.host_and_path(row[1])
        near = [order[j] for j in (k + 1, k - 1) if 0 <= j < len(order) and html_text.host_and_path(order[j][1])[0] == host]
        near.sort(key=lambda r: -html_text._common_prefix(path, html_text.host_and_path(r[1])[1]))
        text, deleted = main_text(lines(row[2]), lines(near[0][2]) if near else None)
        out.append((row[0], row[1], text, len(text), deleted))
    return sorted(out, key=repr)


def test_extracted_against_brute_force(spark):
    rng = random.Random(6)
    rows = site(rng, "hot.example", 150) + site(rng, "b.example", 9) + site(rng, "alone.example", 1)
    rows += [(1, None, "<p>no url</p>"), (2, "https://b.example/x", None), (3, "not a url [", "<p>x</p>"), (None, "https://b.example/y", ""),
             (4, "https://long.example/", "<article>" + "<p>many words</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("own")).withColumn("path", F.lit(3)).repartition(6)
    assert sorted((tuple(r) for r in html_text.extracted(pages).collect()), key=repr) == brute(rows)


def test_repeated_and_no_rows(spark):
    rows = [(1, "https://a.example/p", "<p>same</p>")] * 3 + [(2, "https://a.example/q", "<p>other</p>")]
    got = html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r.page_id for r in got) == [1, 1, 1, 2]
    assert html_text.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_copies_are_no_neighbours(spark):
    """Copies keep their text, however many they are and wherever the ranges end."""
    page = lambda text: f"<div>menu</div><p>{text}</p><script>{random.random()}</script>"
    rows = [(k, f"https://a.example/{k // 7}?q={k}", page("copied")) for k in range(200)]
    rows += [(500, "https://a.example/00", page("first")), (501, "https://a.example/999", page("last"))]
    rows += [(600 + k, "https://b.example/x", page("one")) for k in range(3)] + [(700, "https://b.example/y", page("two"))]
    rows += [(800, "https://c.example/", "<p>only</p>"), (801, "https://c.example/", "<p>only</p>")]
    got = {r.page_id: (r.text, r.deleted) for r in html_text.extracted(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    want = dict.fromkeys(range(200), ("copied", 1)) | {500: ("first", 1), 501: ("last", 1), 700: ("two", 1)}
    want |= dict.fromkeys((600, 601, 602), ("one", 1)) | dict.fromkeys((800, 801), ("only", 0))
    assert got == want


@pytest.mark.parametrize("name", [
    "comment-list", "comments-area", "ad-slot", "advert-box", "article-sidebar", "site-notice", "promo-box", "share-buttons",
    "user-comments", "cookie-banner", "post__related-posts"])
@pytest.mark.parametrize("around", ["article", "main"])
def test_compound_names_inside_an_article(name, around):
    page = f"<{around}><h1>Title</h1><p>The text of the page.</p><div class='x {name}'><p>Not text.</p></div><p>More.</p></{around}>"
    assert text_of(page) == "Title\nThe text of the page.\nMore."


@pytest.mark.parametrize("inner", [
    '<section id="related-work"><p>Kept.</p></section>', '<h2 id="social-impact">Kept.</h2>', '<div id="search-algorithms">Kept.</div>',
    '<div class="has-sidebar">Kept.</div>', '<p class="notice-of-terms">Kept.</p>'])
def test_names_made_from_headings_are_kept(inner):
    assert text_of(f"<article><p>One.</p>{inner}</article>") == "One.\nKept."


def test_layout_wrappers_inside_main():
    page = ("<main><div class='content-sidebar-wrap'><p>A long text that the layout wraps.</p></div>"
            "<div class='right-sidebar'>Aside.</div></main>")
    assert "A long text that the layout wraps." in text_of(page)


def test_a_teaser_beside_a_plain_text():
    text = "<p>" + "The story goes on and on. " * 20 + "</p>"
    page = f"<div>{text}</div><article><p>Read this too.</p></article>"
    assert text_of(page) == ("The story goes on and on. " * 20).strip()
    assert text_of(f"<div><p>Short.</p></div><article>{text}</article>") == ("The story goes on and on. " * 20).strip()
