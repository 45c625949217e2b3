import html
import math
import random
import re

import pytest

from prefixlake.llm import density
from prefixlake.llm.density import main_text, page_texts


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in page_texts(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = re.split(r"</?(?:p|h1|li|ul|div)>", article)
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


LONG = "This is a long paragraph with a good many words in it, as articles have, and it goes on for a while."


def test_pages_without_an_article_element():
    page = f"""<html><body><div id="top-menu"><a href=/>Home</a> <a href=/b>News</a></div>
      <div class="cookie-notice">We use cookies on this page, accept them all please, thank you very much indeed.</div>
      <div class="wrap"><div class="post"><h2>Head &amp; line</h2><p>{LONG}<p>{LONG}<ul><li>one<li>two</ul></div>
      <div class="links"><a href=1>{LONG}</a><a href=2>more</a></div></div>
      <div id="comments"><p>{LONG}</p></div><form>Search <input></form><footer>Imprint</footer></body></html>"""
    assert main_text(page) == f"Head & line\n{LONG}\n{LONG}\none\ntwo"


def test_names_do_not_remove_the_article():
    article = f"<h2>Head</h2><p>{LONG}</p><p>{LONG}</p>"
    text = f"Head\n{LONG}\n{LONG}"
    for name in ("layout no-sidebar", "with-sidebar", "sidebar", "elementor-widget", "no-comments", "comments-open", "social"):
        for page in (f"<div class='{name}'>{article}</div>", f"<div class='{name}'><div class=post>{article}</div></div><p>x",
                     f"<div class='{name}'><article>{article}</article></div>", f"<div id='{name}'><main>{article}</main></div>"):
            assert main_text(page).removesuffix("\nx") == text, page
    for name in ("no-comments", "comments-open", "post sidebar"):
        assert main_text(f"<article class='{name}'>{article}</article>") == text
    inner = f"<h2 id='related-work'>A</h2><h3 id=search>B</h3><section id='search-and-menu'><p>{LONG}</section>"
    inner += f"<section id=related><p>{LONG}</section><div class='elementor-widget'><p>{LONG}</div><div class=notice><p>{LONG}</div>"
    assert main_text(f"<article>{inner}</article>") == "A\nB" + 4 * f"\n{LONG}"


def test_marked_elements_beside_the_article_are_left_out():
    article, more = f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>", f"<p>{LONG}</p>"
    for name in ("sidebar", "related", "share", "comments"):
        assert main_text(f"<div><div class=post>{article}</div><div class='box {name}'>{more}</div></div>") == "\n".join([LONG] * 3)
        assert main_text(f"<main>{article}<div class='{name}'>{more}</div></main>") == "\n".join([LONG] * 3)
    assert main_text(f"<div class=post>{article}</div><div id=comments>{more * 9}</div>") == "\n".join([LONG] * 3)


def test_wrapping_elements_do_not_remove_the_article():
    article = f"<h2>Head</h2><p>{LONG}</p><p>{LONG}</p>"
    text = f"Head\n{LONG}\n{LONG}"
    form = "<form id=aspnetForm action=x>"
    for page in (
            f"{form}<div class=page>{article}</div></form>", f"{form}<article>{article}</article></form>",
            f"<aside><article>{article}</article></aside>", f"<dialog open>{article}</dialog>", f"<header>{article}</header>",
            f"<nav><a href=1>Home</a><a href=2>News</a><article>{article}</article>",
            f"<nav><a href=1>Home</a></nav><div>{article}</div><aside><p>{LONG}</p></aside><footer>Imprint</footer>",
            f"<aside><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></aside><main>{article}</main>"):
        assert main_text(f"<html><body>{page}</body></html>") == text, page


def test_attribute_values_are_not_names():
    quoted = f"""<article><p title="see class=sidebar here">{LONG}<p data-x='id="comments" class=ad'>{LONG}<p title = class=menu>{LONG}</article>"""
    assert main_text(quoted) == "\n".join([LONG] * 3)
    assert main_text(f"<main><p>{LONG}</p><div title='x'class=sidebar>y</div></main>") == LONG


def test_unmatched_tags_take_one_step_each():
    import time

    begun = time.perf_counter()
    for part in ("</b>", "<span></i>", "<li></ul>", "<span class=x>", "<body>", "<b><p>"):
        assert main_text("<div>text " + part * 40_000).split("\n")[0].startswith("text")
    assert time.perf_counter() - begun < 60


def plain_densities(tree):
    """Composite text density from the definition, each node on its own."""
    size = len(tree.tag)
    under = [[n for n in range(size) if n == k or k in lineage(tree, n)] for k in range(size)]

    def characters(nodes, links):
        return sum(len("".join(t.split())) for n, _, t in tree.texts if n in nodes and not tree.removed[n] and (
            not links or any(tree.tag[m] == "a" for m in [n, *lineage(tree, n)])))

    whole, all_links = characters(set(range(size)), False), characters(set(range(size)), True)
    density = []
    for k in range(size):
        below = {n for n in under[k] if not tree.removed[n]}
        c, lc = characters(below, False), characters(below, True)
        t, lt = max(1, len(below - {k})), max(1, sum(tree.tag[n] == "a" for n in below - {k}))
        base = math.log(c / max(1, c - lc) * lc + all_links / max(1, whole) * c + math.e) if c else 0
        density.append(0.0 if not c or tree.removed[k] else
                       c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / (math.log(base) if base > 1 else 1.0))
    return density, [sum(density[n] for n in range(size) if tree.parent[n] == k) for k in range(size)]


def lineage(tree, node):
    out = []
    while tree.parent[node] >= 0:
        node = tree.parent[node]
        out.append(node)
    return out


def test_densities_by_definition():
    rng = random.Random(12)
    for _ in range(40):
        page = "".join(rng.choice(["<div>", "<p>", "</div>", "<a href=1>", "</a>", "<ul><li>", "</ul>", "<script>x</script>", "word word ", LONG])
                       for _ in range(40))
        tree = density._Tree(page)
        found, sums, _, _ = density._densities(tree)
        expected, expected_sums = plain_densities(tree)
        assert found == pytest.approx(expected) and sums == pytest.approx(expected_sums)
        assert density._best(sums) == max(range(len(sums)), key=lambda n: (round(expected_sums[n], 9), -n))


def test_markup_of_all_kinds():
    assert main_text("<article><p>a<b>b</b>\n c&nbsp;d<br>e<p>f &lt;g&gt; &copy;<!-- x --><script>if (a < b) '</p>'</script>h</article>") == \
        "ab c d e\nf <g> ©h"
    assert main_text("<article><a title='x > y' href=z>t</a> <a 'open>q</a></article>") == "t q"
    assert main_text("a < b > c <é>") == "a < b > c <é>"
    assert main_text("<p>no end <b") == "no end"
    assert main_text("<script>only code") == "" and main_text(None) == "" and main_text("") == "" and main_text("<nav>x</nav>") == "x"
    assert main_text("<article><header><h1>T</h1></header><p>x</p><div class=comments>c</div></article>") == "T\nx"


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    assert main_text(deep) == "text"
    many = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert main_text(many) == "\n".join(["word word"] * 20_000)


def test_odd_rows(spark):
    kind = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "t", 0), (1, None, None, "t", 0), (None, "u", "", "t", 1), (2, "u", "<p>x", "t", 2)]
    got = page_texts(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, None, "", 0), (1, None, "", 0), (None, "u", "", 0), (2, "u", "x", 1)]))
    assert page_texts(spark.createDataFrame([], kind)).count() == 0
