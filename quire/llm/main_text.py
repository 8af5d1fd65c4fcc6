"""Main text of web pages by tree scoring.

A page becomes a tree of elements.  Every paragraph earns points for its length and
its commas; its parent gets them whole, its grandparent half, higher ancestors less.
A container's score is discounted by the share of its text that is inside links, and
raised a little where tags or names speak for it.  The best container is kept, with those
of its siblings that read like it, and its text comes out block by block.  Elements that
are never part of an article (menus, headers, footers, sidebars, forms, scripts, adverts,
comments) are set aside before scoring.  A name alone, such as "legal" or "header", sets
aside what is outside the best container and nothing in it; so does a form, unless most
of the page is inside it.

Each page is one row of work; pages are independent, so the work follows the rows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.words import slices

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements that the start of another closes, and how far up to look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
# Start tags that end an open paragraph: all blocks but those of tables' insides.
ENDS_P = BLOCKS - set("body html td th tr tbody thead tfoot caption legend".split())
SCOPE = set("table td th caption button object html".split())

# Never part of an article.
ASIDE = set(
    "nav header footer aside menu dialog button select option input textarea script style noscript iframe template svg "
    "math object embed canvas audio video label head title link meta noembed noframes xmp".split()
)
# Names of what is no part of an article wherever it stands, and of what may be part of one.
_APART = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promo(?:tion|ted)?s?|banners?|"
    r"sidebars?|side[\s_-]?bar|nav|navbar|navigation|menus?|breadcrumbs?|masthead|topbar|toolbar|"
    r"comments?|commentlist|respond|disqus|cookies?|consent|gdpr|popups?|modals?|overlay|newsletter|"
    r"subscribe|signup|login|related|share|sharing|social|widgets?|pagination|pager|taboola|outbrain)(?:$|[\s_-])"
)
_DOUBTFUL = re.compile(
    r"(?:^|[\s_-])(?:footers?|headers?|replies|discussion|notices?|alerts?|subscription|recommend(?:ed|ations?)?|"
    r"skip|search|copyright|legal|disclaimer|tags)(?:$|[\s_-])"
)
_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|main|content|entry|post|story|body|text|page|blog)(?:$|[\s_-])")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*?)(>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"\S+")


class Node:
    """An element, or a run of text (``tag`` empty)."""

    __slots__ = ("tag", "parent", "children", "text", "score", "apart", "doubtful", "likely", "links", "size")

    def __init__(self, tag: str, parent: Node | None, text: str = "") -> None:
        self.tag, self.parent, self.text = tag, parent, text
        self.children: list[Node] = []
        self.score, self.links, self.size = 0.0, 0, 0
        self.apart = self.doubtful = self.likely = False


def _mark(node: Node, raw: str) -> None:
    """Set the node apart, or mark it as likely content, by its tag and attributes."""
    node.apart = node.tag in ASIDE
    if not raw or raw.isspace():
        node.likely = node.tag in ("article", "main")
        return
    given = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
    names = f"{given.get('class', '')} {given.get('id', '')}".lower()
    role = given.get("role", "").lower()
    style = given.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style
    node.likely = node.tag in ("article", "main") or role == "main" or given.get("itemprop", "") == "articleBody"
    if node.tag in ("html", "body"):
        return
    # A page often names the body after its theme, and an article after its place in a list.
    named = bool(_APART.search(names)) and not node.likely
    comment = bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", names))
    node.apart = node.apart or hidden or role in _ROLES or named or comment
    node.doubtful = not node.apart and not node.likely and bool(_DOUBTFUL.search(names))
    node.likely = not node.apart and not node.doubtful and (node.likely or bool(_ARTICLE.search(names)))


class _Open:
    """The open elements, from the root down, and at what depths each tag and any block is open."""

    def __init__(self, root: Node) -> None:
        self.path, self.depths, self.blocks = [root], {root.tag: [0]}, [0]

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.path.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCKS:
            self.blocks.append(depth)

    def cut(self, depth: int) -> None:
        """Close all elements from ``depth`` down; the root stays open."""
        while len(self.path) > max(1, depth):
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """Depth of the innermost open ``tag``, -1 without one."""
        found = self.depths.get(tag)
        return found[-1] if found else -1

    def close(self, tags: set[str], scope: set[str]) -> None:
        """Close the outermost open element of ``tags`` that is inside the innermost of ``scope``."""
        open_ = [found for tag in tags if (found := self.depths.get(tag))]
        if not open_:
            return
        least = max((self.last(tag) for tag in scope), default=-1)
        below = [found[k] for found in open_ if (k := bisect_right(found, max(least, 0))) < len(found)]
        if below:
            self.cut(min(below))


def parse(page: str) -> Node:
    """The tree of a page, repaired as browsers do for common faults.

    A start tag closes what cannot hold it, an end tag without its start is passed over,
    an end closes what is open inside it, and what is open at the end of the page ends
    there.  Text inside scripts and the like is not kept; a tag cut off by the end of
    the page is dropped.
    """
    root, at = Node("html", None), 0
    open_ = _Open(root)
    size = len(page)

    def text(upto: int) -> None:
        if upto > at:
            open_.path[-1].children.append(Node("", open_.path[-1], page[at:upto]))

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(size)
            break
        text(found.start())
        at = found.end()
        if found[2] is None:
            continue  # comment or declaration
        if found[4] == "":
            break  # cut off
        tag = found[2].lower()
        if found[1]:
            depth = open_.last(tag)
            # An inline end tag does not close blocks around it.
            if depth > 0 and (tag in BLOCKS or open_.blocks[-1] < depth):
                open_.cut(depth)
            elif tag == "p" or tag == "br":
                open_.path[-1].children.append(Node("br", open_.path[-1]))
            continue
        if tag == "html" or (tag == "body" and open_.last("body") > 0):
            continue
        if tag in ENDS_P:
            open_.close({"p"}, SCOPE)
        if tag in HEADINGS and open_.path[-1].tag in HEADINGS:
            open_.cut(len(open_.path) - 1)
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        if tag == "a":
            open_.close({"a"}, BLOCKS)
        if tag == "body":
            open_.close({"head"}, set())
        here = open_.path[-1]
        node = Node(tag, here)
        _mark(node, found[3])
        here.children.append(node)
        raw = found[3].rstrip()
        if tag in RAW and not (raw.endswith("/") and tag in ("svg", "math")):
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID:
            open_.push(node)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """(node, whether it is being left), without nodes set apart; no recursion, pages nest deeply."""
    stack = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        yield node, leaving
        if not leaving and node.tag:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children) if not c.apart)


def _set_forms(root: Node) -> None:
    """Set forms aside, but not one that most of the page's text is in."""
    forms: list[tuple[Node, int]] = []
    total, started = 0, {}
    for node, leaving in _walk(root):
        if not node.tag:
            total += len(node.text.strip())
        elif node.tag == "form":
            if leaving:
                forms.append((node, total - started[id(node)]))
            else:
                started[id(node)] = total
    for node, size in forms:
        node.apart = 2 * size <= total


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks under the nodes, in page order; white space is one space."""
    out, run = [], []

    def flush() -> None:
        if run:
            words = entities.unescape("".join(run)).split()
            run.clear()
            if words:
                out.append(" ".join(words))

    for root in roots:
        for node, _ in _walk(root):
            if not node.tag:
                run.append(node.text)
            elif node.tag in BLOCKS:
                flush()
            elif node.tag == "br":
                run.append(" ")
        flush()
    return out


def _score(root: Node) -> None:
    """Give every element its size, link text and points."""
    linked = 0
    for node, leaving in _walk(root):
        if not node.tag:
            words = len(" ".join(_WORDS.findall(node.text)))
            node.parent.size += words
            node.parent.links += words if linked else 0
            continue
        if node.tag == "a":
            linked += -1 if leaving else 1
        if not leaving:
            continue
        if node.parent:
            node.parent.size += node.size
            node.parent.links += node.links
        own = _own_text(node)
        if own:
            points = 1 + own.count(",") + own.count("，") + min(len(own) / 100, 3.0)
            share, up = 1.0, node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "dd", "dt") or node.tag in HEADINGS else node
            points *= 0.3 if node.tag in HEADINGS else 1.0
            level = 0
            while up and level < 5:
                up.score += points * share
                level += 1
                share = 0.5 if level == 1 else share / 3
                up = up.parent


def _own_text(node: Node) -> str:
    """Text of a block that is not in blocks inside it."""
    if node.tag not in BLOCKS:
        return ""
    out, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if not child.tag:
            out.append(child.text)
        elif not child.apart and child.tag not in BLOCKS:
            stack.extend(reversed(child.children))
    return " ".join(" ".join(out).split())


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _final(node: Node) -> float:
    bonus = 1.25 if node.likely else 1.0
    return node.score * (1 - _density(node)) * bonus


LEAST_POINTS, LEAST_SIZE = 1.5, 60  # of a sibling that has a paragraph's worth of text of its own
SHARE = 0.35  # of the best score, for an article or main part around it to be taken whole


def _reads_like(sibling: Node, best: Node) -> bool:
    """Whether a sibling of the best container belongs to it: headings, paragraphs and blocks of prose."""
    if not sibling.tag or sibling.apart or sibling.tag not in BLOCKS or not sibling.size:
        return False
    if _density(sibling) >= 0.25:
        return False
    if sibling.tag in HEADINGS or sibling.tag in ("p", "hgroup", "blockquote", "pre", "figure"):
        return True
    return _final(sibling) >= max(LEAST_POINTS, 0.2 * _final(best)) or (sibling.size >= LEAST_SIZE and _final(sibling) >= LEAST_POINTS)


def _best(root: Node) -> Node | None:
    best = None
    for node, leaving in _walk(root):
        if not leaving and node.tag in BLOCKS and node.tag not in ("p", "li") and node.score > 0:
            if best is None or _final(node) > _final(best):
                best = node
    return best


def _set_doubtful(roots: list[Node], apart: bool) -> None:
    """Set what is doubtful below ``roots`` aside, or take it back in."""
    stack = list(roots)
    while stack:
        node = stack.pop()
        if node.doubtful:
            node.apart = apart
        if not node.apart:
            stack.extend(node.children)


def kept(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    _set_forms(root)
    _set_doubtful([root], True)
    _score(root)
    best = _best(root)
    if best is None:  # all that there is may be doubtful
        _set_doubtful([root], False)
        _score(root)
        best = _best(root)
    if best is None:
        return [root]
    out = _around(best)
    if not any(node.tag in ("html", "body") for node in out):
        _set_doubtful(out, False)
    return out


def _around(best: Node) -> list[Node]:
    # An article or main part around it that has much of the score, too, is the better cut.
    around, least = best.parent, SHARE * _final(best)
    while best.tag != "article" and around:
        if around.tag in ("article", "main") and _final(around) >= least:
            best = around
            if around.tag == "article":
                break
        around = around.parent
    if best.parent is None or best.tag in ("html", "body"):
        return [best]
    return [s for s in best.parent.children if s is best or _reads_like(s, best)]


def extract(page: str | None) -> str:
    """Main text of one page; empty for null, empty or textless pages."""
    if not page:
        return ""
    return "\n\n".join(blocks(kept(parse(page))))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    A null or empty page has an empty text.  Character references are decoded, white
    space inside a block is one space, blocks are joined by an empty line in page order.
    Repeated rows come out once each, pages of any length whole; other columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"]
            )

    source = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op7_main_text")
def op7(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
