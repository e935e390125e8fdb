"""Main text of web pages by tree scoring.

A page is read into a tree of its block elements, with the rules by which HTML
closes what its writers leave open. Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are told by their elements, roles and names
and taken out, unless hardly any text would be left. Then

1. every paragraph has points for its length and commas, less its share of
   link text, and passes them to its parent, half of them to the next ancestor
   and a sixth, a ninth and so on to those above;
2. an ancestor's points, and what its own element and name are worth, are
   discounted by the link density of all that it holds; the best one is the
   container, or the article or main element that it stands in;
3. siblings of the container with a fifth of its score, and paragraphs beside
   a container that isn't an article, are kept with it.

What is left of these is rendered block by block. All of it is linear in the
page: no step looks at a part of the text twice, and nesting is cut at the depth at
which browsers cut it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices

#: Nesting beyond this is flat.
MAX_DEPTH = 512
#: Share of the container's score that a sibling needs, and link text beyond which a list of links is a menu.
SIBLING, MENU = 0.2, 0.9
#: Levels of ancestors that get points.
LEVELS = 5

_TAG = re.compile(r"<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)>?)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)\s*+(?:=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+")
_HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_COMMA = re.compile("[,،、，]")

# Elements by what they do
_RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"}
_GONE = _RAW | set("noscript template svg math object embed applet canvas audio video select button datalist menu dialog nav footer aside map".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _HEADINGS | set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split())
_CELLS = set("td th caption".split())
_BLOCKS = _CLOSES_P | _CELLS | set("tr tbody thead tfoot legend optgroup option".split())
_FLAT = set("html head body".split())
_PARAGRAPHS = _HEADINGS | set("p pre li dd dt figcaption summary address td th caption legend".split())
#: An opening tag ends these, up to the nearest of those.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    **{x: ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for x in ("tbody", "thead", "tfoot")},
}

# Words of class names and ids
_NEVER = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors outbrain taboola comment comments commentlist disqus respond replies cookie cookies consent gdpr "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager skip skiplink share sharing sharebar social hidden invisible noprint".split()
)
_SELDOM = set("footer sidebar aside masthead topbar banner notice notices notification notifications alert alerts promo promos promotion popup modal overlay lightbox newsletter subscribe signup login signin paywall toolbar widget widgets related recommended recommendations copyright disclaimer".split())
_HEADER = {"header"}
_GOOD = set("article body content entry main post story text".split())
_ABOUT = set("has with no without layout not".split())
_UNSEEN = {"sr-only", "visually-hidden", "screen-reader-text"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist", "form"}

KEPT, HEADINGS_ONLY, SELDOM_KEPT, DROPPED = range(4)


def _names(value: str) -> tuple[int, bool]:
    """(verdict, whether a word speaks for content) of a class attribute or id."""
    verdict, good = KEPT, False
    for name in value.split():
        words = {w.lower() for part in re.split(r"[^A-Za-z0-9]+", name) for w in (*_HUMP.findall(part), part)}
        good = good or bool(words & _GOOD)
        if words & _ABOUT:
            continue
        if words & _NEVER or name.lower() in _UNSEEN:
            verdict = max(verdict, DROPPED)
        elif words & _SELDOM:
            verdict = max(verdict, SELDOM_KEPT)
        elif words & _HEADER:
            verdict = max(verdict, HEADINGS_ONLY)
    return verdict, good


def _judge(tag: str, attributes: str) -> tuple[int, int, bool]:
    """(verdict, worth, whether it stands for an article) of an element."""
    verdict = DROPPED if tag in _GONE else SELDOM_KEPT if tag == "form" else HEADINGS_ONLY if tag == "header" else KEPT
    worth, article = (20, True) if tag == "article" else (10, False) if tag == "main" else (0, False)
    if attributes:
        found: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), a or b or c)
        role = found.get("role", "").lower()
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or role in _ROLES:
            verdict = max(verdict, DROPPED if role not in ("banner", "form") else SELDOM_KEPT)
        if "comment" in (found.get("itemprop", "") + found.get("itemtype", "")).lower():
            verdict = DROPPED
        for key in ("class", "id"):
            said, good = _names(found.get(key, ""))
            verdict, worth = max(verdict, said), worth + 5 * good
        if found.get("itemprop", "").lower() == "articlebody" or role == "article":
            worth, article = worth + 20, True
        elif role == "main":
            worth += 10
    return verdict, worth, article


_judged = lru_cache(1 << 13)(_judge)


class Node:
    """A block element, or an inline one that is dropped: what it holds in order, text as (text, whether a link's)."""

    __slots__ = ("article", "held", "links", "of_links", "own", "parent", "points", "size", "tag", "verdict", "worth")

    def __init__(self, tag: str, parent: Node | None, verdict: int = KEPT, worth: int = 0, article: bool = False) -> None:
        self.tag, self.parent, self.verdict, self.worth, self.article = tag, parent, verdict, worth, article
        self.held: list = []
        self.points, self.size, self.of_links, self.links = 0.0, 0, 0, 0
        self.own = [0, 0, 0]  # its own text, link text and links

    @property
    def link_density(self) -> float:
        return self.of_links / self.size if self.size else 0.0

    @property
    def score(self) -> float:
        return (self.points + self.worth) * (1 - self.link_density) if self.points > 0 else 0.0


class _Reader:
    """Builds the tree of a page."""

    def __init__(self) -> None:
        self.root = Node("", None)
        self.stack, self.open, self.flat = [self.root], Counter(), Counter()
        self.link = 0  # depth at which the open link began; 0 outside of links
        self.doubtful = False

    def read(self, page: str) -> Node:
        at, text_from, n = 0, 0, len(page)
        while (at := page.find("<", at)) >= 0:
            m = _TAG.match(page, at)
            if m is None:
                at += 1
                continue
            if at > text_from:
                self.text(page[text_from:at])
            comment, other, close, tag, attributes = m.groups()
            at = m.end()
            if comment:
                end = page.find("-->", m.start() + 2)
                at = n if end < 0 else end + 3
            elif other:
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:
                tag = tag.lower()
                if close:
                    self.end(tag)
                elif page[at - 1] == ">":  # a tag that the page's end cuts is none
                    self.start(tag, attributes.strip())
                    if tag in _RAW:
                        end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                        at = n if end is None else end.start()
            text_from = at
        if n > text_from:
            self.text(page[text_from:])
        return self.root

    def text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        node, n = self.stack[-1], len(" ".join(text.split()))
        node.held.append((text, self.link > 0))
        node.own[0] += n
        node.own[1] += n if self.link else 0

    def push(self, node: Node) -> None:
        if len(self.stack) >= MAX_DEPTH:
            self.flat[node.tag] += 1
            return
        node.parent.held.append(node)
        self.stack.append(node)
        self.open[node.tag] += 1

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag] -= 1
        if self.link > len(self.stack):
            self.link = 0

    def close(self, tags: set[str], barriers: set[str]) -> None:
        """Ends the outermost open element of ``tags`` within the nearest barrier."""
        if not sum(map(self.open.__getitem__, tags)):
            return
        found = 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                found = depth
            elif tag in barriers:
                break
        if found:
            self.pop_to(found)

    def start(self, tag: str, attributes: str) -> None:
        if tag in _FLAT:
            return
        if tag == "br":
            self.stack[-1].held.append((" ", self.link > 0))
            return
        if tag in _CLOSES_P:
            self.close({"p"}, _CELLS | {"table"})
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if tag in _ENDS:
            self.close(*_ENDS[tag])
        if tag in _VOID:
            if tag == "hr":
                self.stack[-1].held.append(Node("hr", self.stack[-1]))
            return
        if tag == "a":
            self.link = len(self.stack)
            self.stack[-1].own[2] += 1
        top = self.stack[-1]
        if tag not in _BLOCKS and tag not in _GONE and not attributes and top.tag != tag:
            return
        verdict, worth, article = (_judged if len(attributes) < 300 else _judge)(tag, attributes)
        if tag in _BLOCKS or verdict == DROPPED or (top.tag == tag and top.verdict == DROPPED):
            self.push(Node(tag, top, verdict, worth, article))
            self.doubtful = self.doubtful or verdict == SELDOM_KEPT

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        if tag not in _HEADINGS and not self.open[tag]:
            return
        tags = _HEADINGS if tag in _HEADINGS else {tag}
        for depth in range(len(self.stack) - 1, 0, -1):
            here = self.stack[depth].tag
            if here in tags:
                self.pop_to(depth)
                return
            if (here in _CELLS and tag not in ("table", "tr", "tbody", "thead", "tfoot")) or (here in _BLOCKS and tag not in _BLOCKS and tag not in _GONE):
                return


def _in_order(root: Node, dropped: int = DROPPED) -> list[Node]:
    """The nodes below and with ``root`` whose verdicts are less than ``dropped``, parents first."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(x for x in reversed(node.held) if isinstance(x, Node) and x.verdict < dropped)
    return found


def _measure(root: Node, dropped: int) -> list[Node]:
    """Sizes, link text and link counts of all that is not dropped."""
    nodes = _in_order(root, dropped)
    for node in nodes:
        node.size, node.of_links, node.links = node.own
    for node in reversed(nodes[1:]):
        up = node.parent
        up.size += node.size
        up.of_links += node.of_links
        up.links += node.links
    return nodes


def _spare(root: Node) -> None:
    """Keeps an element of a doubtful name if less than a quarter of its text would be left without it."""
    _measure(root, SELDOM_KEPT)
    left = root.size
    for node in _measure(root, DROPPED):
        if node.verdict == SELDOM_KEPT and 4 * left < node.size - node.of_links:
            node.verdict = KEPT


def _pass_points(nodes: list[Node]) -> None:
    for node in nodes:
        own, linked, _ = node.own
        if not own or node.verdict == HEADINGS_ONLY:
            continue
        commas = sum(len(_COMMA.findall(x[0])) for x in node.held if not isinstance(x, Node))
        points = (min(1.0, own / 25) + commas + min(own / 100, 3.0)) * (1 - linked / own)
        to = node.parent if node.tag in _PARAGRAPHS and node.parent is not None else node
        for level in range(LEVELS):
            to.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            to = to.parent
            if to is None:
                break


def _under(node: Node, test) -> Node | None:
    while node is not None and not test(node):
        node = node.parent
    return node


def _menu(node: Node) -> bool:
    return node.tag not in _PARAGRAPHS and node.links >= 3 and node.link_density > MENU


def _render(node: Node, blocks: list[str]) -> None:
    """Appends the blocks of a subtree, without what is dropped."""
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    todo: list = [(node, False)]
    while todo:
        x, headings = todo.pop()
        if x is None:
            flush()
        elif not isinstance(x, Node):
            if not headings:
                run.append(x[0])
        elif x.verdict >= SELDOM_KEPT or (x is not node and _menu(x)):
            if x.tag in _BLOCKS:
                flush()
        else:
            if x.verdict == HEADINGS_ONLY and x is not node:
                headings = True
                if _under(x, lambda n: n.article or n.worth > 0) is None:
                    continue
            headings = headings and x.tag not in _HEADINGS
            flush()
            todo.append((None, False))
            todo.extend((y, headings) for y in reversed(x.held))
    flush()


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks, joined by a newline each; empty if there is none."""
    reader = _Reader()
    root = reader.read(page or "")
    if reader.doubtful:
        _spare(root)
    nodes = _measure(root, SELDOM_KEPT)
    _pass_points(nodes)
    best = max(nodes, key=lambda n: n.score)  # the outermost of equals comes first
    if best.score <= 0:
        best = next((n for n in nodes if n.article), None) or next((n for n in nodes if n.tag == "main"), root)
    article = _under(best, lambda n: n.article)
    best = article or _under(best, lambda n: n.tag == "main") or best
    blocks: list[str] = []
    if best.parent is None:
        _render(best, blocks)
        return "\n".join(blocks)
    for x in best.parent.held:
        if not isinstance(x, Node):
            t = " ".join(x[0].split())
            if not article and not x[1] and len(t) >= 25:
                blocks.append(t)
        elif x is best or (x.verdict == KEPT and not _menu(x) and _beside(x, best, article is not None)):
            _render(x, blocks)
    return "\n".join(blocks)


def _beside(x: Node, best: Node, article: bool) -> bool:
    if x.tag in _HEADINGS:
        return x.tag == "h1" or not article
    if article and not (x.article or x.worth):
        return False
    if x.score >= max(10.0, SIBLING * best.score):
        return True
    return not article and x.tag in ("p", "ul", "ol", "dl", "pre", "blockquote", "figure", "table") and x.link_density < 0.25


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row.

    A null or empty page, and one of markup alone, has an empty text. Pages are
    read whole however long they are. Text outside of any element counts as a
    paragraph of the page. Repeated rows and null ids or urls give one row each;
    other columns are not carried. An empty table gives no rows.
    """
    kept = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "html"):
                part = batch.slice(a, b - a)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind, of = (kept.schema[c].dataType.simpleString() for c in ("id", "url"))
    found = kept.mapInArrow(run, f"id {kind}, url {of}, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))
