"""Main-text extraction by scoring a page's tree.

The page is read once into a tree (tags that HTML lets stay open are closed as HTML does). Scripts, styles, form controls, what is
hidden and the like are left out. Each block of text gives points for its length and its commas, less by its share of
links, to its ancestors: all to the parent, half to the grandparent, a third of the inverse distance to others. Signs weigh
points and containers: an element that says by name, role, class, id or heading that it is a menu, header, footer, sidebar, notice,
advert, form or place for reader comments (as an article within an article is) counts a fiftieth, one that has such a word among
others counts half. A container's score is its points, less by its share of links, times the weights of itself and of what it stands in.

The best container is kept; within an article or main element its parent takes its place as long as that doesn't lower
the total of points. Siblings are kept that score a fifth of it, or are headings or long text with few links. Within what is kept, elements with
a sign go unless they score a fifth of the best (or, with a weak sign, few of their characters are links). No sign
removes what the best container stands in. Blocks are joined in page order.

Null or empty html: empty text. Markup that never ends, quotes that never close, stray ends and very deep nesting are read without
recursion. Nothing is cut. A page without any scored block gives all its blocks. Repeated rows are extracted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe svg math canvas object audio video select option textarea button head title datalist dialog input".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
FURNITURE = frozenset("nav header footer aside menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of the second begins.
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
}
SCOPES = frozenset("table td th ul ol dl article section div body main blockquote button".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
SIGNS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navi menu menus menubar breadcrumb breadcrumbs header masthead topbar footer foot bottombar copyright sidebar side rail aside widget widgets "
    "comment comments commentlist disqus respond reply replies response responses feedback kommentar kommentare commentaire commentaires comentario comentarios "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pager pagination toolbar toc tags taglist legal disclaimer skip search".split()
)
#: Words that name an element's place or shape beside a sign.
PLACES = frozenset(
    "site page main top bottom left right box bar block list area section wrap wrapper container content inner outer link links item items module panel row col column button buttons icon icons form group global primary secondary post article entry user reader readers visitor wp js the text thread title body card inline sticky fixed unit slot holder google dfp"
    .split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
STRONG, WEAK, SHARE = 0.02, 0.5, 0.2

_TAG = r"(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+(?:[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?)?)*+)\s*"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:{_TAG}>|[!?/a-zA-Z][^>]*(?:>|\Z))", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)")
#: A quote that closes beyond the tag's end: text and tags stand in it.
_OVERRUN = re.compile(r"=\s*(?:\"[^\"<>]*>[^\"]*</?[a-zA-Z][a-zA-Z0-9]*[\s>]|'[^'<>]*>[^']*</?[a-zA-Z][a-zA-Z0-9]*[\s>])")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "weight", "hidden")

    def __init__(self, name: str, parent: Node | None, weight: float = 1.0, hidden: bool = False) -> None:
        self.name, self.parent, self.weight, self.hidden = name, parent, weight, hidden
        self.children: list[Node | str] = []

    def within(self, names: frozenset) -> Node | None:
        """The nearest element of these names that holds this one."""
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node


ARTICLES = frozenset(["article", "main"])


@lru_cache(maxsize=10_000)
def _sign(value: str) -> tuple[float, bool]:
    """Weight of a class or id, and whether it names a header alone, which in an article is the article's own."""
    weight, header = 1.0, False
    for name in value.split():
        pieces = [x.lower() for x in _NAME.findall(name)]
        signs = [x for x in pieces if x in SIGNS]
        if signs:
            found = STRONG if all(x in SIGNS or x in PLACES for x in pieces) else WEAK
            if found == STRONG and set(signs) == {"header"}:
                header = True
            else:
                weight = min(weight, found)
    return weight, header


def _weighed(name: str, attributes: str, parent: Node) -> tuple[float, bool]:
    """(weight, hidden) of an element by what it says of itself."""
    weight, header, hidden = 1.0, name == "header", False
    if name in FURNITURE and name != "header" or name == "form":
        weight = STRONG
    if name == "article" and parent.name != "#root" and (parent.name == "article" or parent.within(frozenset(["article"]))):
        weight = STRONG
    if attributes and name not in ("html", "body"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                if name not in ARTICLES:
                    found, heads = _sign(value)
                    weight, header = min(weight, found), header or heads
            elif key == "role":
                if value.lower() in ROLES:
                    weight = STRONG
            elif key == "aria-hidden":
                if value.lower() == "true":
                    weight = STRONG
            elif key == "hidden" or key == "style" and _NONE.search(value):
                hidden = True
    if header and weight > STRONG and not (parent.name in ARTICLES or parent.within(ARTICLES)):
        weight = STRONG
    return weight, hidden


_NONE = re.compile(r"display\s*:\s*none", re.I)


def parse(page: str) -> Node:
    """The tree; text is kept as found, character references undecoded."""
    root = top = Node("#root", None)
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            top.children.append(page[at:])
            break
        if m.start() > at:
            top.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None or m[3] and "=" in m[3] and _OVERRUN.search(m[3]):
            m = _LOOSE.match(page, m.start())  # a tag with a quote that doesn't close ends at its first >
            if not m:
                continue
            at = min(m.end() + 1, end)
        name = m[2].lower()
        if m[1]:
            if name == "p" and not _within(top, "p"):
                top.children.append(Node("p", top))
                continue
            node = top
            while node is not root and node.name != name and not (name not in BLOCKS and node.name in SCOPES):
                node = node.parent
            if node is not root and node.name == name:
                top = node.parent
            continue
        if name in CLOSES_P and (p := _within(top, "p")):
            top = p.parent
        if name in HEADINGS and top.name in HEADINGS:
            top = top.parent
        node = top
        while node is not root and node.name not in SCOPES - {"td", "th"} or node.name in ("td", "th"):
            if name in CLOSED_BY.get(node.name, ()):
                top = node.parent
            if node is root:
                break
            node = node.parent
        child = Node(name, top, *_weighed(name, m[3], top))
        top.children.append(child)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if not m[3].endswith("/") or name in BLOCKS or name in ("a", "b", "i", "span"):
            top = child
    return root


def _within(node: Node, name: str) -> Node | None:
    while node and node.name not in ("#root", "table", "td", "th", "button", "article", "section", "div", "body"):
        if node.name == name:
            return node
        node = node.parent
    return None


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, its text, characters within links), in page order, dropped and hidden elements left out."""
    out: list[tuple[Node, str, int]] = []
    owner, parts, linked = root, [], 0

    def flush() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            out.append((owner, text, linked))
        parts, linked = [], 0

    stack: list[tuple] = [(root, None, 0)]
    while stack:
        node, before, links = stack.pop()
        if isinstance(node, str):
            parts.append(node)
            if links:
                linked += len(_SPACE.sub(" ", node).strip())
            continue
        if node is None:  # an element ends
            if before is not None:
                flush()
                owner = before
            continue
        if node.hidden or node.name in DROPPED:
            if node.name in BLOCKS:
                flush()
            continue
        if node.name in VOID:
            if node.name == "hr":
                flush()
            parts.append(" ")
            continue
        if node.name in BLOCKS:
            flush()
            stack.append((None, owner, 0))
            owner = node
        links += node.name == "a"
        stack.extend((x, None, links) for x in reversed(node.children))
    flush()
    return out


PASSED = frozenset(["p", "pre", "td", "blockquote", "li", "dd", "dt"])  # text in these counts for what they stand in


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    found = blocks(root)
    if not found:
        return ""
    length: dict[Node, int] = {}
    linked: dict[Node, int] = {}
    first: dict[Node, bool] = {}
    headings: dict[Node, bool] = {}
    for owner, text, links in found:
        node, is_comments = owner, owner.name in HEADINGS and _COMMENTS.fullmatch(text)
        while node is not None:
            if node not in first:
                first[node] = True
                if is_comments and node is not owner and node.name not in ("#root", "html", "body") and node.name not in ARTICLES:
                    node.weight = min(node.weight, STRONG)  # it begins with such a heading
            length[node] = length.get(node, 0) + len(text)
            linked[node] = linked.get(node, 0) + links
            headings[node] = headings.get(node, True) and owner.name in HEADINGS
            node = node.parent
    score: dict[Node, float] = {}
    total: dict[Node, float] = {}
    for owner, text, links in found:
        if owner.name in HEADINGS:
            continue
        points = (1 + text.count(",") + len(text) / 100) * (1 - min(1.0, links / len(text)))
        node, level = owner, 0
        if owner.name in PASSED:
            points *= owner.weight
            node = owner.parent
        while node is not None:
            score[node] = score.get(node, 0.0) + points * (1.0, 0.5)[level] if level < 2 else score.get(node, 0.0) + points / (3 * level)
            total[node] = total.get(node, 0.0) + points
            points *= node.weight
            node, level = node.parent, level + 1
    if not score:
        return "\n".join(text for _, text, _ in found)
    weight: dict[Node, float] = {}  # of an element and all that it stands in; parents come first in `first`'s owners

    def weight_of(node: Node) -> float:
        chain = []
        while node is not None and node not in weight:
            chain.append(node)
            node = node.parent
        w = weight[node] if node is not None else 1.0
        for x in reversed(chain):
            w = weight[x] = w * x.weight
        return w

    density = lambda x: linked[x] / max(1, length[x])
    final = {x: v * (1 - min(1.0, density(x))) * weight_of(x) for x, v in score.items()}
    best = max(final, key=final.__getitem__)  # the first of equals, in page order
    most = final[best]
    around = set()
    node = best
    while node is not None:
        around.add(node)
        node = node.parent

    def rejected(x: Node) -> bool:
        if x.weight == 1 or x in around:
            return False
        return density(x) > 0.5 if x.weight > STRONG else final.get(x, 0.0) < SHARE * most

    top = best
    if best.name not in ARTICLES and (article := best.within(ARTICLES)):
        while top is not article and total.get(top.parent, 0.0) * (1 - density(top.parent)) >= total.get(top, 0.0) * (1 - density(top)):
            top = top.parent
    kept = {top}
    if top.parent is not None:
        before = True
        for x in top.parent.children:
            if x is top:
                before = False
            elif isinstance(x, Node) and x in length and not rejected(x):
                few = density(x) < 0.25
                if final.get(x, 0.0) >= SHARE * most or few and (x.name == "p" and length[x] >= 80 or x.name in HEADINGS or before and headings[x]):
                    kept.add(x)
    inside: dict[Node, bool] = {}

    def stays(x: Node | None) -> bool:
        chain = []
        while x is not None and x not in inside:
            chain.append(x)
            x = x.parent
        yes = inside[x] if x is not None else False
        for node in reversed(chain):
            yes = inside[node] = (yes or node in kept) and not rejected(node)
        return yes

    return "\n".join(text for owner, text, _ in found if stays(owner) or owner is top.parent and owner.name in PASSED)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            text = [extract(x) for x in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
