"""Main text of pages."""

import html
import math
import random
import re

import pytest

from codequarry.llm import html_text as H

SF = "/root/testdata/sf0.01"


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        body = row.html[row.html.index("<article>") + 9:row.html.index("</article>")]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(x for x in lines if x)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want)
        assert got[row.page_id].url == row.url


ARTICLE = "<article><h1>Head &amp; more</h1><p>First\n  para <b>bold</b>.<p>Second<br>line<ul><li>one<li>two</ul></article>"
TEXT = "Head & more\nFirst para bold.\nSecond line\none\ntwo"


@pytest.mark.parametrize("around", [
    "{}", "<html><body><nav><a href=x>menu</a></nav>{}<footer>foot</footer>", "<header><h1>Site</h1></header>{}",
    "<body><div class='sidebar'><p>A long text beside the article, which is much longer than it is.</p></div>{}",
    "<div class=\"cookie-notice\">We use cookies</div>{}<div id='comments'><p>I liked this one a lot</p></div>",
    "<form><p>Your name<input></form>{}<script>var a='</article>';</script><style>p{{}}</style>",
    "<!-- <article>no</article> -->{}", "<aside><article><p>x</p></article></aside>{}", "<div hidden><p>secret</p></div>{}",
    "<div><div><div>{}</div></div><div class=adBanner>Buy</div></div>", "<main>{}</main>"])
def test_what_is_left_out(around):
    assert H.main_text(around.format(ARTICLE)) == TEXT


def test_values_are_not_attributes():
    page = "<article><p title='a hidden class=ad gem' data-id=ad>kept</p><p HIDDEN>gone</p><p id=Notice-1>gone</p></article>"
    assert H.main_text(page) == "kept"


def test_inner_parts_are_left_out():
    page = ARTICLE.replace("<ul>", "<div class='share'>Share</div><span class=ad>buy <span>now</span></span><ul>")
    assert H.main_text(page) == TEXT


def test_without_an_article_density_decides():
    page = """<body><div id=links><a href=a>one link</a><a href=b>two links</a><a href=c>three links</a></div>
      <div id=text><h2>Title</h2><p>A paragraph with quite a number of words in it.</p><p>And another one,
      which has words too, and many.</p><p>Short.</p></div></body>"""
    assert H.main_text(page) == ("Title\nA paragraph with quite a number of words in it.\n"
                                 "And another one, which has words too, and many.\nShort.")


LONG = "".join(f"<p>Paragraph {i} says quite a lot about the subject of the page, and then some more.</p>" for i in range(4))
LONG_TEXT = "\n".join(f"Paragraph {i} says quite a lot about the subject of the page, and then some more." for i in range(4))
MENU = "<ul class=menu><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>"


@pytest.mark.parametrize("page", [
    "<body><div class='layout has-sidebar'>{}<article>{}</article></div>", "<div class='content no-sidebar'>{}<article>{}</article></div>",
    "<div id='page' class='with-nav'>{}<article>{}</article></div>", "<body>{}<article><div class='comments-open entry'>{}</div></article>",
    "<body>{}<article><section class='social-science'>{}</section></article>", "<body><div class='social'>{}<article>{}</article></div>",
    "<body><form id='aspnetForm'><div>{}<div id=text>{}</div></div></form></body>", "<body><div id='sidebar'>{}<div>{}</div></div></body>",
    "<body>{}<article><p>Teaser</p></article><article>{}</article><article><p>Other</p></article></body>",
    "<body>{}<div class='post'>{}</div><div class='comments'><p>I liked this one, it is good.</p><p>Me too</p></div></body>",
    "<body><div><div>{}</div><div><div class=col>{}</div></div></div></body>", "<aside>{}<main>{}</main></aside>"])
def test_classes_and_elements_only_weigh_in(page):
    assert H.main_text(page.format(MENU, LONG)) == LONG_TEXT


def plain_weights(nodes):
    """Density and density sum of every node, each worked out from its own subtree alone."""
    kids = {i: [j for j, n in enumerate(nodes) if n.parent == i and not n.dropped] for i in range(len(nodes))}
    own = [(n.chars, n.tags, n.link_chars, n.links) for n in nodes]

    def whole(i):
        parts = [own[i]] + [(c, t + 1, lc, k) for c, t, lc, k in map(whole, kids[i])]
        return tuple(map(sum, zip(*parts)))

    body = next((i for i, n in enumerate(nodes) if n.tag == "body" and not n.dropped), 0)
    chars, _, linked, _ = whole(body)
    rate = linked / max(1, chars)

    def density(i):
        c, t, lc, k = whole(i)
        if not c:
            return 0.0
        lc = min(lc, c)
        base = math.log(c / max(1, c - lc) * lc + rate * c + math.e)
        return c / max(1, t) * math.log(c / max(1, lc) * max(1, t) / max(1, k) + 1) / max(
            math.log(base), math.log(math.log(1 + math.e)))

    return [density(i) for i in range(len(nodes))], [sum(density(j) * nodes[j].weight for j in kids[i]) for i in kids]


def test_densities_equal_a_plain_computation():
    rng = random.Random(4)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(2, 25)):
            parts.append(rng.choice(["<div>", "</div>", "<div class=ad>", "<article>", "</article>", "<a href=x>link</a>", "<p>words of a text ",
                                     "<ul><li>item", "</ul>", "some <b>more</b> words ", "<form>", "</form>", "<script>x</script>"]))
        page = "<body>" + "".join(parts)
        nodes, _ = H.parse(page)
        want = plain_weights(nodes)
        nodes, _ = H.parse(page)
        body = H.weigh(nodes)
        live = [i for i, n in enumerate(nodes) if not n.dropped]
        assert [nodes[i].density for i in live] == pytest.approx([want[0][i] for i in live])
        assert [nodes[i].total for i in live] == pytest.approx([want[1][i] for i in live])
        under = [i for i in live if i == body or body in _above(nodes, i)]
        assert nodes[nodes[body].best].total == pytest.approx(max(want[1][i] for i in under))


def _above(nodes, i):
    while nodes[i].parent >= 0:
        i = nodes[i].parent
        yield i


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain &lt; text", "plain < text"), ("a < b > c", "a < b > c"),
    ("<p>x&nbsp;\u2003y</p>", "x y"), ("<article><p>open", "open"), ("<div>" * 50_000 + "deep", "deep"),
    ("<article><script>x", ""), ("</p></div>text", "text"), ("<article>" + "<p>w " * 20_000, "\n".join(["w"] * 20_000))])
def test_odd_pages(page, text):
    assert H.main_text(page) == text


def test_null_and_empty_tables(spark):
    kind = "page_id long, url string, html string"
    rows = H.extract(spark.createDataFrame([(1, None, None), (None, "u", "<p>a"), (1, None, None)], kind)).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in rows), key=str) == \
        sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "a", 1)], key=str)
    assert H.extract(spark.createDataFrame([], kind)).collect() == []
