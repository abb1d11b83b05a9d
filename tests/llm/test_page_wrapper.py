"""Main texts of pages: given pages, hosts whose boilerplate only their other pages tell, and awkward rows."""

import html
import re

import pytest

from tessera.llm import page_wrapper, queries
from tessera.llm.common import Scratch

SCHEMA = "page_id long, url string, html string"


def article(page):
    """The given pages keep their text in one article element."""
    inner = re.sub(r"</?(p|br|h1)[^>]*>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_page_wrapper(spark, sf)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = got.collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam".split()


def running(k, n):
    return " ".join(WORDS[(k * 7 + i * (k + 3)) % len(WORDS)] for i in range(n))


def plain_host(k):
    """No semantic tag: a constant masthead, a varying list of links, a wrapper named after its sidebar, text, comments."""
    body = f"{running(k, 30 + k)} &amp; more&nbsp;x"
    page = (
        f'<html><body><div class="page with-sidebar"><div id="top-{k}">Daily Planet — all the news</div><div class="lst"><ul><li><a href="/{k}">link {k}</a><li><a href="/b">b {k}</a></ul></div>'
        f'<div class="post post-{k}"><h1>Title {k}</h1><div class="txt"><p>{body}<p>{running(k + 1, 25)}<div>{running(k + 2, 15)}<br>end {k}</div></div>'
        f'<p class="note">We use tracking. Agree?</p></div><div class="reader-comments"><div class="comment">I disagree {running(k, 60)}</div></div>'
        f'<form>Search <input name=q></form><div class="footer">Contact {k}</div><script>if (a < b) "</div>"</script></body></html>')
    return page, " ".join(f"Title {k} {running(k, 30 + k)} & more x {running(k + 1, 25)} {running(k + 2, 15)} end {k}".split())


def test_a_host_without_semantic_tags(spark, scratch):
    made = [plain_host(k) for k in range(14)]
    pages = spark.createDataFrame([(k, f"https://User@Plain.example.org:8080/{k}", p) for k, (p, _) in enumerate(made)], SCHEMA).repartition(3)
    got = {r.page_id: r.main_text for r in page_wrapper.extract(pages, scratch).collect()}
    for k, (_, text) in enumerate(made):
        assert got[k] == text


def test_boilerplate_within_and_around_articles(spark, scratch):
    page = (
        "<body><header><h1>Site</h1></header><aside>side</aside><div role=alert>We have cookies</div><main><nav>menu</nav><article class='has-comments'><header><h2>Head</h2> by me</header>"
        "<p>First <b>bo</b>ld &lt;tag&gt; &#233;&copy<!-- gone --></p><div class='advert'>buy</div><ul><li>point one<li>point <a href=x>two</a></ul><table><tr><td>c1<td>c2</table>"
        "<section id=comments><article class=comment>great post</article></section></article></main><footer>foot</footer><p hidden>no</p>")
    pages = spark.createDataFrame([(1, "http://a/1", page), (2, None, page), (3, "", page.replace("First", "Second"))], SCHEMA)
    got = {r.page_id: r.main_text for r in page_wrapper.extract(pages, scratch).collect()}
    assert got[1] == got[2] == "Head First bold <tag> é© point one point two c1 c2" and got[3] == got[1].replace("First", "Second")


def test_nulls_repeats_copies_and_clashing_columns(spark, scratch):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, "http://h/1", None), (2, "http://h/2", ""), (3, "http://h/3", "just text, no tag"), (4, "http://h/4", deep), (5, "http://h/5", "<p>" + "long " * 20000), (6, "http://h/6", "<a href='never closed"),
            (7, None, "<article></article>"), *[(8, "http://copy/8", "<article><p>same</p><p>text</p></article>")] * 5, (9, "http://h/9", "<script>only()</script>"), (10, "nonsense", "<p>a<b>b</p>c</b> d")]
    pages = spark.createDataFrame([(*r, "clash", "clash", "old") for r in rows], SCHEMA + ", host string, template string, main_text string")
    found = page_wrapper.extract(pages, scratch)
    assert sorted(found.columns) == sorted(pages.columns)
    got = [(r.page_id, r.main_text) for r in found.collect()]
    assert sorted(got) == [(1, ""), (2, ""), (3, "just text, no tag"), (4, "deep text"), (5, ("long " * 20000).strip()), (6, ""), (7, ""), *[(8, "same text")] * 5, (9, ""), (10, "ab c d")]
    assert page_wrapper.extract(pages.limit(0), Scratch(spark)).count() == 0


def test_shuffled_templates_give_the_same(spark, scratch, monkeypatch):
    made = [plain_host(k) for k in range(8)]
    pages = spark.createDataFrame([(k, f"http://h{k % 2}/", p) for k, (p, _) in enumerate(made)], SCHEMA)
    first = sorted(map(tuple, page_wrapper.extract(pages, scratch).select("page_id", "main_text").collect()))
    monkeypatch.setattr(page_wrapper, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(page_wrapper, "TOGETHER", 1)
    assert sorted(map(tuple, page_wrapper.extract(pages.repartition(5), Scratch(spark)).select("page_id", "main_text").collect())) == first


@pytest.mark.parametrize("a,b,best", [
    (["r", [["x", []], ["y", [["z", []]]]]], ["r", [["y", [["z", []], ["w", []]]], ["x", []]]], 3),
    (["r", []], ["s", []], 0),
    (["r", [["x", []]] * 3], ["r", [["x", []]] * 2], 3),
])
def test_simple_tree_matching(a, b, best):
    assert page_wrapper.weight(a, b) == page_wrapper.weight(b, a) == best
    matched = [(x, y) for x, y in page_wrapper.align(a[1], b[1]) if x is not None and y is not None]
    assert not best or 1 + sum(page_wrapper.weight(x, y) for x, y in matched) == best


def test_a_bounded_template_keeps_what_many_pages_share(monkeypatch):
    monkeypatch.setattr(page_wrapper, "NODES", 6)
    trees = [["", [["div", [], 1, 5, 0, 7], [f"div u{k}", [], 1, 9, 0, k]], 1, 0, 0, 0] for k in range(30)]
    whole = page_wrapper.merge_all(trees)
    assert page_wrapper._count(whole) <= 6 and ["div", [], 30, 150, 0, 7] in whole[1]


def test_a_template_keeps_every_place():
    """130 shapes of a host with 40 places of their own each, each on three pages: a notice that all of them show is no content, in the rarest shape either."""
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    wide = lambda k: f"<div class='s{name(k)}'>" + "".join(f"<div class='k{name(i)}'><p>{running(k + i, 3)}</div>" for i in range(20)) + "</div>"

    def shaped(body, j):
        return page_wrapper.Shaped(f"<body><article><div class='seen'>text {j} {running(j, 12)}</div>{body}</article></body>")

    def tree(body):
        same = [shaped(body, j) for j in range(3)]
        total = lambda field: [sum(x) for x in zip(*(getattr(s, field) for s in same), strict=True)]
        sums = [x[0] if len(set(x)) == 1 else None for x in zip(*(s.sums for s in same), strict=True)]
        return page_wrapper._row_template(same[0].shape, 3, total("chars"), total("linked"), sums)

    rare = "<div class='zz'>Unsubscribe in your account</div>"
    whole = page_wrapper.merge_all([tree(rare), *(tree(wide(k)) for k in range(130))])
    count = lambda t: 1 + sum(map(count, t[1]))
    template = page_wrapper.json.dumps(whole)
    page = f"<body><article><div class='seen'>text 9 of today</div>{rare}</article></body>"
    assert count(whole) > 4000 and page_wrapper.main_text(page, template) == "text 9 of today"
