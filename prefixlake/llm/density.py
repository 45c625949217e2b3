"""Main text of web pages by composite text density.

A page becomes a tree of its elements; what is never text (scripts, styles, controls, ...) is taken out by
element. Elements for menus, forms, sidebars and the like, and whole names in class, id and
role, only mark an element: it is taken out unless it holds an article or main element or, on pages that have neither,
the node of the largest sum below; an id marks nothing on headings and inside the article. For every node that is left, the density is characters per tag, damped by
the share of link text; the sum over its children says how much text stands directly below it.
The node with the largest sum is the article, widened to an enclosing article or main element;
subtrees beside it under the same parent belong to it when they are as dense as the least dense
node of the path from body and hold no more links than text.

Character references are decoded, white space inside a block is one space, blocks are trimmed
and joined by a line break. A null, empty or text-free page gives an empty text; repeated rows
and null ids are extracted one by one; no rows give no rows; nothing is cut off. Other columns
are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.words import text_groups

# Fixed names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
REMOVED = frozenset(
    "script style textarea title noscript iframe xmp template noembed noframes head button "
    "select option svg canvas object audio video map".split())
MARKED = frozenset("nav footer aside form dialog menu".split())  # by name; pages may wrap everything in one of them
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup legend summary body html".split())
# An element that starts closes an open one of these, up to the nearest of the boundaries.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Names in class, id and role that mark what is not the article.
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe signup login sidebar aside widget widgets related "
    "recommended share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar "
    "masthead header footer copyright search complementary contentinfo dialog reply replies respond responses discussion "
    "cookie-notice cookie-banner related-posts share-buttons social-share widget-area site-header site-footer "
    "main-navigation post-navigation top-menu".split())
IN_ARTICLE = frozenset(  # of these, the ones that also name parts of an article mark nothing inside one
    "notice alert banner header overlay widget widgets search menu copyright promotion dialog discussion responses".split())
COMMENT_NAMES = frozenset(
    "comment comments commentlist comment-list comments-list comments-area comment-body comment-respond comment-form "
    "disqus disqus_thread".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE, BY_ID, COMMENT, BY_TAG = 1, 2, 3, 4  # marks

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'/=]""")


class _Tree:
    """Nodes in page order by number: parent, element name, mark; and text by node."""

    def __init__(self, page: str):
        self.parent, self.tag, self.removed, self.mark = [-1], ["#root"], [False], [0]
        self.texts: list[tuple[int, int, str]] = []  # node, block number, text
        self.block = 0
        self._open = [0]
        self._count: Counter[str] = Counter()  # open elements by name
        self._seen: set[str] = set()
        self._read(page)

    def _start(self, tag: str, attributes: str) -> None:
        stack = self._open
        if tag in CLOSES_P:
            self._close({"p"}, {"#root", "article", "section", "div", "td", "th", "li", "blockquote", "button", "table"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in BLOCK:
            self.block += 1
        if tag in ("html", "body"):
            if tag in self._seen:
                return
            self._seen.add(tag)
        node = len(self.tag)
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.removed.append(self.removed[stack[-1]] or tag in REMOVED)
        self.mark.append(self._marked(tag, attributes) or BY_TAG * self._is_aside(tag))
        if tag not in VOID:
            stack.append(node)
            self._count[tag] += 1

    def _is_aside(self, tag: str) -> bool:
        return tag in MARKED or (tag == "header" and not self._count["article"] and not self._count["main"])

    def _cut(self, place: int) -> None:
        """Closes the open elements from this one on."""
        for node in self._open[place:]:
            self._count[self.tag[node]] -= 1
        del self._open[place:]

    def _marked(self, tag: str, attributes: str) -> int:
        if tag in ("html", "body", "main") or not attributes:
            return 0
        names: set[str] = set()
        ids: set[str] = set()
        for m in _ATTRIBUTE.finditer(attributes):
            if m[2] and (key := m[1].lower()) in ("class", "id", "role"):
                (ids if key == "id" else names).update(m[2].strip("\"'").lower().split())
        if tag in HEADINGS or tag == "article" or self._count["article"]:
            ids = set()
        if (names | ids) & COMMENT_NAMES:
            return COMMENT
        known = ASIDE_NAMES - IN_ARTICLE if self._count["article"] or self._count["main"] else ASIDE_NAMES
        if tag == "article" or not (names | ids) & known:
            return 0
        return ASIDE if names & known else BY_ID

    def remove(self, nodes: set[int]) -> None:
        for node in range(1, len(self.tag)):
            self.removed[node] = self.removed[node] or node in nodes or self.removed[self.parent[node]]

    def _close(self, tags: set[str], until: set[str]) -> None:
        if not any(self._count[tag] for tag in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[k]]
            if tag in tags:
                self._cut(k)
                self.block += 1
                return
            if tag in until:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        if not self._count[tag]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[k]] == tag:
                self._cut(k)
                return

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._open[-1], self.block, html.unescape(text)))

    def _read(self, page: str) -> None:
        at, quoted = 0, True
        while at < len(page):
            begin = page.find("<", at)
            if begin < 0:
                self._text(page[at:])
                return
            after = page[begin + 1 : begin + 2]
            if after.isalpha() or (after == "/" and page[begin + 2 : begin + 3].isalpha()):
                self._text(page[at:begin])
                name = _NAME.match(page, begin + 1 + (after == "/"))
                if name is None:  # a letter beyond ASCII starts no element
                    self._text("<")
                    at = begin + 1
                    continue
                rest = _REST.match(page, name.end()) if quoted else None
                quoted = quoted and rest is not None  # an open quote: from here tags end at the first >
                end = rest.end() if rest else page.find(">", name.end()) + 1 or len(page)
                tag = name[0].lower()
                if after == "/":
                    self._end(tag)
                else:
                    self._start(tag, page[name.end() : end - 1])
                    if tag == "br":
                        self._text(" ")
                    if tag in RAW:
                        close = re.compile(f"</{tag}", re.IGNORECASE | re.ASCII).search(page, end)
                        end = close.start() if close else len(page)
                at = end
            elif after in ("!", "?", "/"):
                self._text(page[at:begin])
                mark = "-->" if page.startswith("<!--", begin) else ">"
                end = page.find(mark, begin + (4 if mark == "-->" else 2))
                at = len(page) if end < 0 else end + len(mark)
            else:
                self._text(page[at : begin + 1])
                at = begin + 1


def _densities(tree: _Tree) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite density and density sum of every node, its characters and its link characters."""
    size = len(tree.tag)
    chars, links, tags, link_tags = [0] * size, [0] * size, [0] * size, [0] * size
    in_link = [False] * size
    for node in range(1, size):
        in_link[node] = tree.tag[node] == "a" or in_link[tree.parent[node]]
    for node, _, text in tree.texts:
        if not tree.removed[node]:
            length = len("".join(text.split()))
            chars[node] += length
            links[node] += length * in_link[node]
    for node in range(size - 1, 0, -1):
        if not tree.removed[node]:
            up = tree.parent[node]
            chars[up] += chars[node]
            links[up] += links[node]
            tags[up] += tags[node] + 1
            link_tags[up] += link_tags[node] + (tree.tag[node] == "a")
    share = links[0] / max(1, chars[0])
    density, sums = [0.0] * size, [0.0] * size
    for node in range(size - 1, -1, -1):
        c, t, lc, lt = chars[node], max(1, tags[node]), links[node], link_tags[node]
        if c and not tree.removed[node]:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            inner = (c / max(1, lc)) * (t / max(1, lt))
            density[node] = c / t * (math.log(max(inner, 1.0)) / math.log(base) if base > 1 else math.log(max(inner, 1.0)))
        if node:
            sums[tree.parent[node]] += density[node]
    return density, sums, chars, links


def _best(sums: list[float]) -> int:
    return max(range(len(sums)), key=lambda n: (sums[n], -n))


def _remove_marked(tree: _Tree) -> None:
    """Takes out the marked elements that are not the article or around it."""
    if not any(tree.mark):
        return
    holds = [tag == "main" or (tag == "article" and mark != COMMENT) for tag, mark in zip(tree.tag, tree.mark)]
    for node in range(len(tree.tag) - 1, 0, -1):
        holds[tree.parent[node]] |= holds[node]
    marked = [n for n, mark in enumerate(tree.mark) if mark and not holds[n] and not tree.removed[n]]
    before = list(tree.removed)
    tree.remove({n for n in marked if tree.mark[n] == COMMENT or (tree.mark[n] == BY_TAG and holds[0])})
    _, sums, chars, _ = _densities(tree)
    if not chars[0]:  # all text is in them
        tree.removed = list(before)
        _, sums, chars, _ = _densities(tree)
    before = list(tree.removed)
    best = node = _best(sums)
    around = set()
    while node >= 0:
        around.add(node)
        node = tree.parent[node]
    inside = [n == best != 0 for n in range(len(tree.tag))]
    for node in range(1, len(tree.tag)):
        inside[node] |= inside[tree.parent[node]]
    tree.remove({
        n for n in marked
        if tree.mark[n] in (ASIDE, BY_TAG) and n not in around or tree.mark[n] == BY_ID and n not in around and not inside[n]})
    if not any(text.strip() and not tree.removed[node] for node, _, text in tree.texts):
        tree.removed = before


def main_text(page: str | None) -> str:
    """The article of one page, blocks joined by line breaks."""
    tree = _Tree(page or "")
    _remove_marked(tree)
    density, sums, chars, links = _densities(tree)
    if not chars[0]:
        return ""
    best = _best(sums)
    path = [best]
    while path[-1] > 0:
        path.append(tree.parent[path[-1]])
    chosen = {best}
    outer = next((n for n in reversed(path) if tree.tag[n] in ("article", "main")), None)
    if outer is not None:
        chosen = {outer}
    elif len(path) > 1:
        body = [n for n in path if tree.tag[n] not in ("#root", "html")]
        least = min(density[n] for n in body or path)
        for node in range(1, len(tree.tag)):
            if tree.parent[node] == path[1] and density[node] >= least and 2 * links[node] <= chars[node]:
                chosen.add(node)
        direct = any(node == path[1] and text.strip() for node, _, text in tree.texts)
        if direct and tree.tag[path[1]] not in ("#root", "html", "body"):
            chosen.add(path[1])
    inside = [False] * len(tree.tag)
    for node in range(len(tree.tag)):
        inside[node] = node in chosen or (node > 0 and inside[tree.parent[node]])
    blocks: dict[int, list[str]] = {}
    for node, block, text in tree.texts:
        if inside[node] and not tree.removed[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "html"):
            found = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
