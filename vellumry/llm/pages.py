"""Main-text extraction from HTML by tree scoring.

A page becomes a tree.  What can never be text of an article is left out while it is read; what its
element, class, id or role calls boilerplate is only suspect, and goes unless it holds most of the
page's paragraphs, several or with a title.  Every paragraph then passes points for its length and its commas to its parent,
half of them to the grandparent and less to higher ancestors; a container's points are discounted by
its link density.  From the best container the choice climbs as long as the parent has half of the
points and adds no links, and siblings with enough points, or that read like a paragraph or a
heading, are kept with it.  Lists of links inside are menus and go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import slices, texts_of

# Fixed values of the HTML standard: elements without content, with raw text, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
search section summary table tbody td tfoot th thead tr ul""".split())
#: Start tags that end an open element of the given names, up to the given border.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select", "datalist"))}
SCOPE = frozenset("html body table td th caption button article section div aside nav main header footer form blockquote".split())

#: Elements that are never part of an article, and those that are boilerplate unless they hold it.
CUT = frozenset("""head script style noscript template nav button input select textarea
iframe object embed svg canvas dialog menu map audio video noembed noframes""".split())
SUSPECT = frozenset("header footer aside form".split())
#: Words of class, id and role that mark boilerplate, those of them that mark readers' comments and
#: those that mark what an article may have of its own.
CUT_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary footer header masthead
cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login
share sharing social related recommended comment comments disqus reply replies respond pagination pager toolbar
widget contentinfo search skip""".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
HEADERS = frozenset("header masthead banner".split())
#: Words that say nothing of their own beside such a word, and words that turn it into a remark on
#: something else (has-sidebar).
FILLERS = frozenset("""site page main top bottom left right inner outer box bar area block list item items link links section
wrap wrapper container content group buttons button icons panel posts articles form text global primary secondary desktop mobile inline slot unit""".split())
REMARKS = frozenset("has with without no not is open closed enabled disabled hide show".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAG_POINTS = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3,
              "address": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
#: Share of the paragraphs that saves a suspect; shares of points and of linked text that a climb
#: takes; linked text and number of links of a menu.
SAVED, CLIMB, LINKED, MENU, MENU_LINKS = 0.5, 0.5, 0.3, 0.75, 3
#: Paragraphs that a suspect without a title must have to be saved: one advert is no article.
SAVED_PARAGRAPHS = 3

#: A quote that is not closed before the next tag is taken as a character of the tag.
TOKEN = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"(?:[^"<]|<(?![/A-Za-z!]))*+"|'(?:[^'<]|<(?![/A-Za-z!]))*+'|["'])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.DOTALL)
HINTS = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("name", "parent", "children", "points", "chars", "link_chars", "links", "text_chars", "paragraphs", "headings", "titles", "own_titles", "inside", "kinds", "order")

    def __init__(self, name: str, parent: Node | None, order: int, kinds: frozenset = frozenset()):
        self.name, self.parent, self.children, self.order, self.kinds = name, parent, [], order, kinds
        self.points, self.inside = 0.0, parent is not None and (parent.inside or parent.name in ("article", "main"))
        self.chars = self.link_chars = self.links = self.text_chars = self.paragraphs = self.headings = self.titles = self.own_titles = 0

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def suspicions(name: str, attrs: str) -> frozenset:
    """The boilerplate words that an element goes by.

    A name counts if it is made of such words and fillers alone (cookie-notice, site-footer), or if
    its last word is one and no other turns it into a remark (post-comments, but not has-sidebar).
    """
    found = {name} if name in SUSPECT else set()
    if attrs and name not in ("html", "body"):
        for _, a, b, c in HINTS.findall(attrs):
            for token in (a or b or c).split():
                words = WORDS.findall(CAMEL.sub(" ", token).lower())
                hits = CUT_WORDS.intersection(words)
                if hits and (words[-1] in CUT_WORDS and REMARKS.isdisjoint(words) or FILLERS.issuperset(set(words) - hits)):
                    found |= hits
    if name in ("article", "main"):  # an article is no boilerplate, unless it is a reader's comment
        found &= COMMENTS
    return frozenset(found)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all its elements in page order; elements of CUT are left out whole.
    Character references in text are decoded; comments, declarations and raw text are skipped."""
    root = now = Node("#root", None, 0)
    nodes, at, cut = [root], 0, None  # cut: the outermost open element that is boilerplate
    end_of = len(page)

    def close(names: tuple[str, ...], border: frozenset | tuple) -> None:
        nonlocal now, cut
        node = now
        while node.parent is not None and node.name not in names:
            if node.name in border:
                return
            node = node.parent
        if node.parent is not None:
            leave = node.parent
            while cut is not None and now is not leave:
                if now is cut:
                    cut = None
                now = now.parent
            now = leave

    while at < end_of:
        tag = page.find("<", at)
        m = TOKEN.match(page, tag) if tag >= 0 else None
        if tag >= 0 and m is None:  # a lone "<" is text
            if cut is None:
                now.children.append(html.unescape(page[at:tag + 1]))
            at = tag + 1
            continue
        stop = tag if tag >= 0 else end_of
        if stop > at and cut is None:
            now.children.append(html.unescape(page[at:stop]))
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                if cut is None:
                    now.children.append(" ")
            elif name == "p" or name not in BLOCK:
                close((name,), SCOPE if name != "body" else ())
            else:
                close((name,), ())
            continue
        if name in RAW:
            tail = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = tail.end() if tail else end_of
            continue
        if name in VOID:
            if cut is None and name in ("br", "hr", "wbr", "img"):
                now.children.append(" " if name != "wbr" else "")
                if name == "hr":
                    now.children.append(None)
            continue
        if name in BLOCK:
            close(("p",), SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        node = Node(name, now, len(nodes), suspicions(name, m["attrs"]) if cut is None else frozenset())
        if cut is None:
            if name in CUT:
                cut = node
            else:
                now.children.append(node)
                nodes.append(node)
        if not m["attrs"].rstrip().endswith("/") or name in BLOCK:
            now = node
        elif cut is node:
            cut = None
    return root, nodes


def _is_paragraph(node: Node) -> bool:
    return node.name in PARAGRAPHS or node.name == "div" and not any(c.name in BLOCK for c in node.elements)


SUMS = ("chars", "link_chars", "links", "text_chars", "paragraphs", "headings", "titles", "own_titles")


def _measure(nodes: list[Node]) -> None:
    """Sums over all that an element holds, children before parents: lengths of text, link text and
    paragraph text, numbers of links, paragraphs, headings and titles (own: not of a comment)."""
    for node in nodes:
        for k in SUMS:
            setattr(node, k, 0)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.links += c.links
                node.text_chars += c.text_chars
                title = c.name in ("h1", "article", "main")
                node.paragraphs += c.paragraphs + (_is_paragraph(c) and c.chars >= 25)
                node.headings += c.headings + (c.name in HEADINGS or title)
                node.titles += c.titles + title
                node.own_titles += c.own_titles + (title and not c.kinds)
            elif c:
                node.chars += len(" ".join(c.split()))
        if node.name == "a":
            node.link_chars, node.links = node.chars, 1
        if _is_paragraph(node):
            node.text_chars = node.chars - node.link_chars


def _saved(node: Node, whole: int) -> bool:
    """Whether a suspect stays: an article's own header does, and what holds most paragraphs, several
    or with a title; of readers' comments only what holds the article's title as well."""
    if node.kinds <= HEADERS and node.inside and node.headings:
        return True
    most = node.text_chars > SAVED * whole and (node.titles or node.paragraphs >= SAVED_PARAGRAPHS)
    if node.kinds & COMMENTS:
        return bool(most and node.name not in ("article", "main") and node.own_titles)
    return bool(most)


def _prune(root: Node) -> list[Node]:
    """The elements that stay, in page order: suspects go from the outermost inwards."""
    kept, stack, whole = [], [root], root.text_chars
    while stack:
        node = stack.pop()
        kept.append(node)
        node.children = [c for c in node.children if not isinstance(c, Node) or not c.kinds or _saved(c, whole)]
        stack.extend(reversed(node.elements))
    return kept


def _text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, Node):
            stack.extend(reversed(n.children))
        elif n:
            out.append(n)
    return " ".join("".join(out).split())


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below some nodes, in page order."""
    out, now = [], []
    stack: list = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if isinstance(n, Node):
            block = n.name in BLOCK
            if block:
                stack.append(None)
            stack.extend(reversed(n.children))
            if block:
                stack.append(None)
        elif n is None:
            if now:
                out.append(" ".join("".join(now).split()))
                now = []
        else:
            now.append(n)
    if now:
        out.append(" ".join("".join(now).split()))
    return [b for b in out if b]


def _density(chars: int, link_chars: int) -> float:
    return link_chars / max(chars, 1)


def _score(nodes: list[Node]) -> list[Node]:
    """Points of all containers; those that have some, in page order."""
    scored: dict[int, Node] = {}
    for node in nodes:
        if not _is_paragraph(node) or node.chars < 25:
            continue
        text = _text(node)
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
        above, level = node.parent, 0
        while above is not None and above.name != "#root" and level < 5:
            if above.order not in scored:
                scored[above.order] = above
                above.points += TAG_POINTS.get(above.name, 0)
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above, level = above.parent, level + 1
    for node in scored.values():
        node.points *= 1 - _density(node.chars, node.link_chars)
    return [scored[k] for k in sorted(scored)]


def _climbed(best: Node) -> Node:
    """The best container, or the ancestor that has much the same points and adds no links."""
    while (above := best.parent) is not None and above.name not in ("body", "html", "#root"):
        added = _density(above.chars - best.chars, above.link_chars - best.link_chars)
        if above.points < CLIMB * best.points or added > LINKED:
            break
        best = above
    return best


def _is_menu(node: Node) -> bool:
    """Whether a block inside the article is a list of links."""
    return node.name in ("ul", "ol", "div", "section", "table", "dl") and node.links >= MENU_LINKS and _density(node.chars, node.link_chars) > MENU


def _drop_menus(node: Node) -> None:
    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if not isinstance(c, Node) or not _is_menu(c)]
        stack.extend(n.elements)


def main_text(page: str) -> str:
    """The main text: one line per block, empty if there is none."""
    root, nodes = parse(page)
    _measure(nodes)
    nodes = _prune(root)
    _measure(nodes)
    scored = _score(nodes)
    if scored:
        best = _climbed(max(scored, key=lambda n: n.points))  # the first of equals
    else:  # no paragraph is long enough to tell
        named = [n for n in nodes if n.name == "article"] or [n for n in nodes if n.name == "main"]
        best = max(named, key=lambda n: n.chars) if named else next((n for n in nodes if n.name == "body"), root)
    if best.parent is None:
        kept = [best]
    else:
        kept = _with_siblings(best)
    for n in kept:
        _drop_menus(n)
    return "\n".join(_blocks(kept))


def _with_siblings(best: Node) -> list[Node]:
    bound, kept, heads = max(10.0, best.points * 0.2), [], []
    for n in best.parent.elements:
        density = _density(n.chars, n.link_chars)
        if n.name in HEADINGS and density <= LINKED:
            heads.append(n)  # a heading goes with what follows it
            continue
        if n is best or n.points >= bound or (n.name == "p" and (n.chars > 80 and density < 0.25 or n.chars and density == 0 and _text(n).endswith("."))):
            kept += [*heads, n]
        heads = []
    return kept


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages.

    Null and empty pages have an empty text; an empty table gives no rows.  Of containers with equal
    points the first is taken.  A page of any length is parsed whole, in the memory of one row.  An
    article's own header, with its title, is part of it.  Rows that repeat stay repeated; a null
    page_id or url stays null; only page_id, url and html are read.
    """
    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(t) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url"), "html").mapInArrow(run, schema)
