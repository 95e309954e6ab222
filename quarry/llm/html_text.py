"""Main text of web pages by tree scoring (operator 3).

A page is cut into tags and text by one regular expression and built into a tree with the end-tag rules that
matter here (a block closes an open paragraph, list items and table cells close their kind). Boilerplate subtrees, known by
their element (menus, footers, sidebars, controls, scripts, styles ...), role or class words (adverts, notices, comments ...),
are left out. Class words that tell of a page's state (has-sidebar, menu-closed ...) say nothing. Elements known by class words alone stay if hardly any text stands outside them and most of the page's
paragraphs inside; forms, and elements with words that say less for certain (share, related ...), stay if most of its paragraphs' plain text stands in them. Then

* every paragraph-like block passes points to its parent and, halved, to the levels above it: one, one per comma, and up to three
  for its length;
* an element's points are discounted by its link density, the share of its text inside links;
* elements that say what they are (article, main, itemprop ...) get a bonus;
* the best container is kept, or the one around it as long as all else in that is text too; and of its siblings those that
  score a fifth of it, dense paragraphs and the headings before it.

Character references are decoded in the text between two tags. The kept text is cut at block elements. In a block white space becomes one space and is trimmed;
blocks are joined by a line feed in page order. Inside what is kept nothing is dropped or capped.

A page is one row's work and pages do not meet, so the plan is one narrow stage without a shuffle.

Defined results: null or empty html gives an empty text; a page without any scoring container gives the text of its
body that is not boilerplate; broken and unclosed markup is read as far as it goes; deep nesting is not recursed into, and
very long pages are read whole, in time that grows with their length; an empty table gives an empty result.
Repeated rows and null ids are extracted row by row; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, table

SCHEMA = "page_id long, url string, text string, n_chars long"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")

#: Elements without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag.
RAW = set("script style textarea title noscript iframe noembed noframes template xmp svg math".split())
#: Elements that begin and end a block of text.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no part of an article wherever they stand.
DROPPED = set("nav footer aside button select input textarea script style noscript iframe template dialog menu head title link meta svg math object embed canvas audio video noembed noframes label".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar tablist toolbar".split())
#: Words of class and id that mark what is no article text.
JUNK = set(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored newsletter subscribe subscription signup comment comments disqus "
    "respond reply replies reader-comments sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs pager pagination "
    "footer masthead cookie cookies consent gdpr popup modal overlay toolbar skip login hidden".split()
)
#: Words that mark it too, but also stand on wrappers of a whole page.
UNSURE = set("banner promo promotion promoted discussion widget widgets notice notices share sharing social related recommended recommendations".split())
#: Parts of a class word that make it tell of a page's state or layout ("has-sidebar", "menu-closed") rather than of what the element is.
STATE = set(
    "no not has have with without is are hide hides show shows free open opened close closed enable enabled disable disabled active inactive visible invisible collapsed expanded "
    "sticky fixed page pages site layout template theme wrap wrapper wrapped container single type format status support supports supported".split()
)
#: Text outside junk, in characters, below which what looks like junk wraps the page.
REST = 100
#: Share of the page's plain paragraph text, and characters of it, that make an unsure element a wrapper.
WRAPS, WRAPPED = 0.6, 200
#: Class words that keep an element although another word would drop it.
CONTENT = set("article content main post story entry body text articlebody article-body post-content entry-content".split())
#: Start tags that close an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an element to close ends.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PARAGRAPH = set("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption section article div main".split())
BONUS = {"article": 30.0, "main": 25.0, "section": 2.0, "div": 1.0, "blockquote": 1.0, "body": -3.0, "ul": -3.0, "ol": -3.0, "table": -3.0, "li": -3.0, "td": 0.0}


#: Elements in which a paragraph outside is not closed.
BARRIER = set("table td th caption button object".split())
SURE, JUNKY, MAYBE, NO = "boilerplate", "junk", "unsure", "content"


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "unsure", "junk", "points", "chars", "linked", "named", "in_p", "in_article", "depth", "block")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, named: bool):
        self.tag, self.parent, self.dropped, self.named, self.unsure, self.junk = tag, parent, dropped, named, False, False
        self.depth = 0 if parent is None else parent.depth + 1
        # The depth of the innermost block, itself included.
        self.block = self.depth if parent is None or tag in BLOCK else parent.block
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        # Whether a paragraph is open that a block would close, and whether an article is.
        self.in_p = tag == "p" or (parent is not None and parent.in_p and tag not in BARRIER)
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _judged(tag: str, raw: str, parent: Node) -> tuple[str, bool]:
    """Whether an element is boilerplate, and whether it says that it holds the content."""
    found = _attributes(raw)
    whole = {w for v in (found.get("class", ""), found.get("id", "")) for w in v.lower().replace("_", "-").split()}
    words = {x for w in whole for x in re.split(r"[^a-z0-9]+", w)} | whole
    named = bool(words & CONTENT) or found.get("itemprop", "").lower() == "articlebody" or found.get("role", "").lower() in ("main", "article")
    if tag in DROPPED or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return SURE, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return SURE, False
    if (tag == "header" or (words & {"header"} and not named)) and not parent.in_article:
        return SURE, False
    if tag in ("form", "fieldset"):
        return MAYBE, named
    # Compound words of a page's state say nothing of the element itself.
    told = {x for w in whole if not STATE & set(parts := re.split(r"[^a-z0-9]+", w)) for x in (w, *parts)}
    if tag not in ("html", "body", "article", "main") and told & (JUNK | UNSURE) and not (named and not told & {"comment", "comments", "ad", "ads", "sidebar"}):
        return JUNKY if told & JUNK else MAYBE, False
    return NO, named


def tree(page: str) -> Node:
    root = Node("#root", None, False, False)
    at, place, size = root, 0, len(page)
    # Open elements by tag, outermost first.
    open_: dict[str, list[Node]] = {}

    def climb(to: Node) -> None:
        nonlocal at
        while at is not to:
            open_[at.tag].pop()
            at = at.parent

    while place < size:
        found = _TOKEN.search(page, place)
        end = found.start() if found else size
        if end > place and not at.dropped:
            at.children.append(html.unescape(page[place:end]))
        if not found:
            break
        place = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA[") and not at.dropped:
                at.children.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = found[2].lower()
        if found[1]:
            standing = open_.get(tag)
            if tag == "br" or (tag == "p" and not standing):
                at.children.append(Node(tag, at, at.dropped, False))
            # An end tag of an inline element does not reach out of its block.
            elif standing and (tag in BLOCK or standing[-1].depth > at.block):
                climb(standing[-1].parent)
            continue
        if tag in BLOCK and at.in_p:
            climb(open_["p"][-1].parent)
        if tag in CLOSES:
            scope = max((open_[x][-1].depth for x in SCOPE[tag] if open_.get(x)), default=0)
            # The outermost element to close inside the innermost scope.
            firsts = [nodes[i] for x in CLOSES[tag] if (nodes := open_.get(x)) and (i := bisect_right(nodes, scope, key=lambda n: n.depth)) < len(nodes)]
            if firsts:
                climb(min(firsts, key=lambda n: n.depth).parent)
        kind, named = (SURE, False) if at.dropped else _judged(tag, found[3], at)
        node = Node(tag, at, kind == SURE, named)
        node.unsure, node.junk = kind == MAYBE, kind == JUNKY
        at.children.append(node)
        if tag in RAW:
            closing = re.compile(rf"</{tag}[\s/>]", re.I).search(page, place)
            if closing is None:
                # Only what cannot hold an article may swallow the rest of the page.
                place = size if tag in ("script", "style", "textarea", "title") else place
            else:
                place = page.find(">", closing.start()) + 1 or size
        elif tag not in VOID and not (found[3].endswith("/") and tag not in BLOCK):
            at = node
            open_.setdefault(tag, []).append(node)
    _decide(root)
    return root


def _decide(root: Node) -> None:
    """Drop what looks like junk unless hardly any text stands outside, then the unsure elements that do not wrap the page."""
    nodes = _order(root)
    if any(n.junk for n in nodes):
        outside = 0
        shut: set[int] = set()
        for node in nodes:
            if node.junk or node.tag == "a" or (node.parent is not None and id(node.parent) in shut):
                shut.add(id(node))
            else:
                outside += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if outside >= REST or _plain(root, nodes)[id(root)] < WRAPPED:
            for node in nodes:
                node.dropped = node.dropped or node.junk
        else:
            for node in nodes:
                node.unsure = node.unsure or node.junk
        nodes = _order(root)
    if not any(n.unsure for n in nodes):
        return
    plain = _plain(root, nodes)
    whole = plain[id(root)]
    for node in nodes:
        if node.unsure and (plain[id(node)] < WRAPPED or plain[id(node)] < WRAPS * whole):
            node.dropped = True


def _plain(root: Node, nodes: list[Node]) -> dict[int, int]:
    """Plain paragraph text of each subtree: outside links, under something paragraph-like."""
    plain: dict[int, int] = {}
    linked = {id(n) for n in nodes if n.tag == "a"}
    told = {id(root): False}
    for node in nodes[1:]:
        told[id(node)] = (told[id(node.parent)] or node.tag in ("p", "pre", "blockquote", "td", "li", "dd") or node.named) and id(node) not in linked
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str)) if told[id(node)] else 0
        plain[id(node)] = plain.get(id(node), 0) + own
        if node.parent is not None:
            plain[id(node.parent)] = plain.get(id(node.parent), 0) + plain[id(node)]
    return plain


def _order(root: Node) -> list[Node]:
    """Kept elements, parents first."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            nodes.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return nodes


def container(root: Node) -> list[Node]:
    """The best container and the siblings that are kept with it, in page order."""
    nodes = _order(root)
    own: dict[int, list[str]] = {}
    for node in reversed(nodes):
        texts = [c for c in node.children if isinstance(c, str)]
        flat = " ".join(texts).split()
        node.chars += sum(map(len, flat)) + max(0, len(flat) - 1)
        if node.tag == "a":
            node.linked = node.chars
        own[id(node)] = texts
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    scored = []
    for node in nodes:
        direct = node.tag in ("p", "pre", "td", "blockquote", "li", "dd") or any(t.strip() for t in own[id(node)])
        if node.tag not in PARAGRAPH or not direct or not node.chars:
            continue
        inner = [node]
        commas = 0
        while inner:
            x = inner.pop()
            for c in x.children:
                if isinstance(c, str):
                    commas += c.count(",")
                elif not c.dropped and c.tag not in PARAGRAPH:
                    inner.append(c)
        points = (1 + commas + min(node.chars // 100, 3)) * (1 - min(1.0, node.linked / node.chars))
        up, share = node.parent if node.tag not in ("div", "section", "article", "main", "td") else node, 1.0
        for _ in range(4):
            if up is None or up.tag in ("#root", "html"):
                break
            up.points += points * share
            up, share = up.parent, share / 2
    best, most = None, 0.0
    for node in nodes:
        if node.points > 0 and node.tag not in ("p", "li", "tr", "ul", "ol", "dl", "h1", "h2", "h3", "h4", "h5", "h6"):
            score = (node.points + BONUS.get(node.tag, 0.0) + (25.0 if node.named else 0.0)) * (1 - min(1.0, node.linked / max(1, node.chars)))
            scored.append((node, score))
            if score > most:
                best, most = node, score
    if best is None:
        return [n for n in nodes if n.tag == "body"][:1] or [root]
    by_node = {id(n): s for n, s in scored}
    # A container whose other children are text as well belongs to the article as a whole.
    while best.tag not in ("article", "main", "body") and best.parent is not None and best.parent.tag not in ("body", "html", "#root"):
        others = [c for c in best.parent.children if isinstance(c, Node) and c is not best and not c.dropped and c.chars]
        if any(c.linked >= 0.5 * c.chars for c in others):
            break
        best = best.parent
    kept = []
    before = True
    for sibling in (best.parent or root).children:
        if not isinstance(sibling, Node) or sibling.dropped:
            continue
        before = before and sibling is not best
        dense = sibling.linked < 0.25 * max(1, sibling.chars)
        if (
            sibling is best
            or (by_node.get(id(sibling), 0.0) >= max(0.2 * most, min(10.0, 0.5 * most)) and dense)
            or (before and sibling.tag in ("h1", "h2", "h3") and best.tag not in ("article", "main") and dense)
            or (sibling.tag == "p" and best.tag not in ("article", "main") and sibling.chars > 80 and dense)
        ):
            kept.append(sibling)
    return kept


def text_of(nodes: list[Node]) -> str:
    """Blocks of the kept elements."""
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if parts:
            block = " ".join("".join(parts).split())
            if block:
                blocks.append(block)
            parts.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            item = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                parts.append(item)
            elif item.dropped:
                continue
            elif item.tag == "br":
                parts.append(" ")
            else:
                block = item.tag in BLOCK
                if block:
                    close()
                    stack.append(None)
                stack.extend(reversed(item.children))
        close()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    return text_of(container(tree(page)))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(p) for p in part.column("h").to_pylist()]
                arrays = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    columns = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"))
    return map_arrow(columns, run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
