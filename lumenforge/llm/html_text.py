"""Operator 3: main text of web pages by tree scoring.

A tolerant tag reader builds a small element tree in one pass over the page. Paragraph-like blocks pass points (one, one for
each comma, up to three for length) to their ancestors, in full to the parent and in falling shares above; link density
discounts every container. The container with the best score is kept with those siblings that score alike or read like
paragraphs, and its blocks are joined in page order.

Elements that are boilerplate by what they are (menus, footers, sidebars, forms, scripts, styles; headers outside an article) are
cut before scoring. Names of classes and ids are weaker evidence: a part is cut for its name only if one of its names consists
of such words alone (`site-header`, `related-posts`; not `social-history`). A part that holds an article is not cut for its name,
unless it names comments or adverts: there articles are the comments of readers and the cards of sponsors. An article is cut
for such a name, or for another one if the page has an article without a bad name. A paragraph named like a part of the page
(`related`, `header`) stays if it is a sentence without many links; one named as an advert, notice or the like goes, however long it is.
Headings, captions and tables of the article stay, and so do paragraphs beside the best container, if they are sentences or stand
next to what is kept; length decides nothing.

Defined results: null and empty html and pages without text give an empty text; unclosed, crossed and unknown tags are closed
as browsers do for blocks; a quote in a tag counts only behind an equals sign; an unclosed value, comment or script goes to the
next tag end, or to the end of the page; very long and malformed pages take time in proportion to their length; repeated rows are
independent; further columns pass unchanged, but the output replaces an old column of its name.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.llm.shared import cleared

#: Elements of HTML by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg object canvas select".split())
CUT = frozenset("nav footer aside form button dialog menu head audio video map".split()) | RAW
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote td li h1 h2 h3 h4 h5 h6 dd dt figcaption caption".split())
CLOSES_P = BLOCK - {"html", "body"}
#: What an open item is closed by, and the elements that hold items of their own.
ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = ("table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "td", "li", "blockquote")
#: Words of class and id names of parts that are no main text, and words that say nothing about a part.
BAD_WORD = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice gdpr popup modal newsletter subscribe signup share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments disqus replies respond toolbar widget skip legal copyright".split())
PLAIN_WORD = frozenset("site page top bottom left right box bar block list wrap wrapper container inner outer section link links button buttons icon icons item items area content slot unit form post posts story stories text global primary secondary main fixed sticky title heading body group row col column".split())
GOOD_ROLE = frozenset(["main", "article"])
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Those of them that name comments of readers or adverts, and those that name places of a page, where a sentence may still be text.
GUEST_WORD = frozenset("comment comments disqus replies respond ad ads advert advertisement advertising sponsor sponsored".split())
PLACE_WORD = frozenset("nav navbar navigation menu header masthead footer sidebar aside social related recommended recommendations toolbar widget legal".split())
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
COMMAS = re.compile("[,،、，﹐﹑､]")
#: Shares of a paragraph's points for its parent, grandparent and so on.
SHARES = (1.0, 0.5, 0.33, 0.25)
SIBLING_SHARE = 0.2

OPENING = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
TAG_END = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "named", "guest", "place", "score", "length", "linked", "good", "at")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts, self.at = tag, parent, [], 0
        self.cut, self.named, self.guest, self.place, self.good, self.score, self.length, self.linked = False, False, False, True, False, 0.0, 0, 0


def bad_words(name: str) -> set[str]:
    """The words of a class or id name that say that its part is boilerplate; none if it says anything else."""
    words = [w.lower() for w in NAME_PARTS.findall(name)]
    return {w for w in words if w in BAD_WORD} if all(w in BAD_WORD or w in PLAIN_WORD or w.isdigit() for w in words) else set()


def _attributes(node: Node, raw: str) -> None:
    for m in ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if key in ("class", "id") and node.tag not in ("main", "body", "html"):
            for words in map(bad_words, value.split()):
                node.named |= bool(words)
                node.guest |= not words.isdisjoint(GUEST_WORD)
                node.place &= words <= PLACE_WORD
        elif key == "role":
            node.cut |= value.lower() in BAD_ROLE
            node.good |= value.lower() in GOOD_ROLE
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            node.cut = True


class Reader:
    """One pass over a page: the open elements are a stack, and the places of each tag in it are known."""

    def __init__(self, page: str):
        self.page, self.size, self.last_end = page, len(page), page.rfind(">")
        self.root = Node("html", None)
        self.open, self.places = [self.root], {"html": [0]}
        self.blocks = [0]  # how many block elements are open up to each place of the stack
        self.never: set[str] = set()  # raw elements without any further closing tag

    def last(self, tags) -> int:
        """Place of the innermost open element of some tags, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, place: int) -> None:
        """Closes the open element at a place and all inside it."""
        for node in self.open[place:]:
            self.places[node.tag].pop()
        del self.open[place:], self.blocks[place:]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)
        self.blocks.append(self.blocks[-1] + (node.tag in BLOCK))

    def close_items(self, tags) -> None:
        """Ends an open element of tags, unless an element that holds its own items is open inside it."""
        place = self.last(tags)
        if place > 0 and place >= self.last(HOLDERS):
            self.close(place)

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, -1 if none does."""
        while at <= self.last_end:
            m = TAG_END.search(self.page, at)
            if m is None:
                return -1
            if not m[1]:
                return m.start()
            closing = self.page.find(m[1], m.end())
            if closing < 0:
                return self.page.find(">", m.end())
            at = closing + 1
        return -1

    def read(self) -> Node:
        page, at = self.page, 0
        while True:
            m = OPENING.search(page, at)
            if m is None or m.start() > self.last_end and not (m[1] or m[2]):
                self.open[-1].parts.append(page[at:])
                return self.root
            if m.start() > at:
                self.open[-1].parts.append(page[at : m.start()])
            if m[1] or m[2] or m[3]:
                mark = "-->" if m[1] else "]]>" if m[2] else ">"
                end = page.find(mark, m.end() - (2 if m[1] else 0))
                if end < 0:
                    return self.root
                at = end + len(mark)
                continue
            end = self.tag_end(m.end())
            if end < 0:
                self.open[-1].parts.append(page[m.start() :])
                return self.root
            at = self.element(m[5].lower(), bool(m[4]), page[m.end() : end], end + 1)

    def element(self, tag: str, closing: bool, raw: str, at: int) -> int:
        if closing:
            place = self.last((tag,))
            # an inline element is not closed across a block
            if place > 0 and (tag in BLOCK or self.blocks[-1] == self.blocks[place]):
                self.close(place)
            return at
        if tag == "html" or tag == "body" and len(self.open) == 1:
            return at
        if tag in CLOSES_P:
            self.close_items(("p",))
        if tag in ITEMS:
            self.close_items(ITEMS[tag])
        node = Node(tag, self.open[-1])
        node.cut = tag in CUT or tag == "header" and self.last(("article", "main")) < 0
        if raw:
            _attributes(node, raw)
        self.open[-1].parts.append(node)
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            return at
        if tag in RAW:
            end = None if tag in self.never else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
            if end:
                return end.end()
            self.never.add(tag)
            if tag in ("script", "style", "template", "textarea"):
                return self.size
        self.push(node)
        return at


def parse(page: str) -> Node:
    """Element tree of a page; text parts are strings between the child nodes. Parts are cut for their names here."""
    root = Reader(page).read()
    _measure(root)
    order = _nodes(root)
    holds = set()
    plain_article = any(n.tag == "article" and not n.named for n in order)
    for node in reversed(order):  # children first
        if (node.tag == "article" and not node.named) or node.tag == "main" or node.good or id(node) in holds:
            holds.add(id(node.parent))
    for node in order:
        if not node.named or node.cut:
            continue
        if node.tag == "article":
            node.cut = node.guest or plain_article
        elif node.tag in PARAGRAPH:
            node.cut = not (node.place and density(node) < 0.5 and is_sentence(node))
        else:
            node.cut = node.guest or id(node) not in holds
    return root


def _nodes(root: Node) -> list[Node]:
    """Uncut nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        out.append(todo.pop())
        todo += [p for p in out[-1].parts if not isinstance(p, str) and not p.cut]
    return out


def is_sentence(node: Node) -> bool:
    """Whether the text of a paragraph ends as sentences do and is no note of rights."""
    text = " ".join(t for _, t in blocks(node))
    return SENTENCE.search(text) is not None and RIGHTS.match(text) is None


def plain(text: str) -> str:
    return SPACES.sub(" ", html.unescape(text)).strip() if text else ""


def blocks(top: Node) -> list[tuple[Node, str]]:
    """(block element, text) of the uncut blocks below top, in page order."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    owner = top

    def end() -> None:
        nonlocal held
        if held:
            text = plain("".join(held))
            if text:
                out.append((owner, text))
            held = []

    stack = [(top, iter(top.parts), top)]
    while stack:
        node, parts, around = stack[-1]
        for part in parts:
            if isinstance(part, str):
                held.append(part)
            elif part.cut:
                continue
            elif part.tag in ("br", "wbr", "img"):
                held.append(" " if part.tag == "br" else "")
            else:
                stack.append((part, iter(part.parts), owner))
                if part.tag in BLOCK:
                    end()
                    owner = part
                break
        else:
            stack.pop()
            if node.tag in BLOCK or not stack:
                end()
                owner = around
    return out


def _measure(root: Node) -> list[Node]:
    """All uncut nodes, children before parents, with text length and length inside links."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        order.append(node)
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        node.length, node.linked = own, own if linked else 0
        todo += [(p, linked or p.tag == "a") for p in node.parts if not isinstance(p, str) and not p.cut]
    order.reverse()
    for node in order:
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    return order


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that are kept with it, in page order."""
    order = _measure(root)
    touched = []
    for block, text in blocks(root):
        points = 1.0 + len(COMMAS.findall(text)) + min(len(text) / 100, 3.0)
        points *= 1.0 - density(block)
        node = block if block.tag not in PARAGRAPH else block.parent
        for share in SHARES:
            if node is None:
                break
            if node.score == 0.0:
                touched.append(node)
            node.score += points * share
            node = node.parent
    if not touched:
        return []
    for node in touched:
        if node.tag in ("article", "main") or node.good:
            node.score *= 1.5
        node.score *= 1.0 - density(node)
    rank = {id(n): k for k, n in enumerate(order)}
    best = max(touched, key=lambda n: (n.score, -rank[id(n)]))
    while best.tag in PARAGRAPH and best.parent is not None:
        best = best.parent
    for node in _ancestors(best):  # an article around the winner is one text
        if node.tag == "article" or node.good:
            best = node
    if best.parent is None:
        return [best]
    limit = max(5.0, best.score * SIBLING_SHARE)
    parts = [p for p in best.parent.parts if not isinstance(p, str) and not p.cut and p.length]
    keep = []
    for part in parts:
        text = part.tag in PARAGRAPH and density(part) < 0.25 and is_sentence(part)
        keep.append(part is best or part.score >= limit and density(part) < 0.3 or part.tag in ("h1", "h2") or text)
    for step in (1, -1):  # short paragraphs next to what is kept
        for k in range(len(parts))[::step]:
            beside = k - step
            if not keep[k] and 0 <= beside < len(parts) and keep[beside] and parts[k].tag in PARAGRAPH and density(parts[k]) < 0.25:
                keep[k] = not RIGHTS.match(" ".join(t for _, t in blocks(parts[k])))
    return [p for p, k in zip(parts, keep, strict=True) if k]


def _ancestors(node: Node):
    node = node.parent
    while node is not None:
        yield node
        node = node.parent


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks joined by line breaks."""
    if not page:
        return ""
    return "\n".join(text for node in main_nodes(parse(page)) for _, text in blocks(node))


def extract(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """df with out_col: the main text of html_col."""
    df = cleared(df, [out_col], [html_col])
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType(), False)])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [main_text(x) for x in part.column(part.schema.get_field_index(html_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", F.col("html").cast("string")))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
