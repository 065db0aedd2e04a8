"""Main text of web pages by tree scoring.

A light tree is built from the tags; branches that never hold the article (menus,
forms, scripts and the like, by tag or role) are cut. So are branches that their
class or id marks (sidebars, comments, adverts), unless they hold most of the page's
paragraph points: then they wrap the article. Each paragraph earns points for its length and commas and passes them to its
ancestors, less with distance; containers are discounted by the share of their
text that stands in links. The best container and its siblings that score alike
are kept whole, block by block in page order. Siblings with little text are kept too
unless links make up much of it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_workers

#: Comments, declarations, and tags with attributes. A lone "<" is text.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only behind "=", elsewhere it is a plain sign
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
WORD = re.compile(r"[a-z0-9]+")
#: Class words that tell of a state of the page: no-sidebar, has-comments, with-ads, share-enabled. Fixed values.
NEUTRAL = re.compile(r"(?<!\S)(?:(?:no|has|with|without)[-_]+\S+|\S+[-_]+(?:enabled|disabled))(?!\S)")

#: Element names by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset("script style textarea title noscript iframe noembed noframes template head nav footer aside form button select option input svg math canvas object audio video map dialog menu fieldset label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SCORED = frozenset("p pre td blockquote li dd div section article main".split())
CONTAINERS = frozenset("article main".split())
ENDS_P = frozenset("address article aside blockquote center details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
#: Words in class or id that mark what is not the article. Fixed values.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail aside footer masthead "
    "comment comments disqus reply replies respond discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations popular trending widget toolbar pagination pager skip hidden search form copyright legal disclaimer".split()
)


#: Words that say where a part stands or what holds it. With dropped words alone beside them they mark it. Fixed values.
PLACES = frozenset("bar block blocks box btn button buttons bottom center container content entry footer global group header holder icons inline inner item items left link links list lower main mobile module article page panel post row right section side site sticky text top upper widget wide wrap wrapper primary secondary unit slot zone area count form".split())
#: Words that name what may wrap an article, and words of threads, which are long and never do. Fixed values.
WRAPPERS = frozenset("content main article post entry story page body layout wrap wrapper container column text site app root".split())
THREADS = frozenset("comment comments disqus reply replies respond discussion".split())


class Node:
    """An element. ``block`` is the nearest element at or above it that is not inline."""

    __slots__ = ("tag", "parent", "block", "inside", "items", "dropped", "marked", "points", "n_text", "n_link", "commas")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, marked: int = 0):
        self.tag, self.parent, self.dropped, self.marked = tag, parent, dropped, marked  # marked: 0 no, 1 unless it holds the most, 2 unless little is left
        self.block: Node = parent.block if parent and tag in INLINE else self
        self.inside: bool = tag in CONTAINERS or (parent is not None and parent.inside)
        self.items: list = []
        self.points = 0.0
        self.n_text = self.n_link = self.commas = 0


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    """Whether a branch never belongs to the article. ``inside``: within an article or main element."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            if value.strip() in DROPPED_ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marked(tag: str, attributes: str) -> int:
    """Whether class or id say that a branch is not the article: 0 no, 2 yes, 1 if they also name a wrapper. A compound like ``no-sidebar`` says nothing."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for name in NEUTRAL.sub(" ", (m[2] or m[3] or m[4] or "").lower()).split():
                parts = set(WORD.findall(name))
                # share-price or legal-history name a thing of the article
                if all(x in DROPPED_WORDS or x in PLACES or x in WRAPPERS or x.isdigit() for x in parts):
                    words |= parts
    if DROPPED_WORDS.isdisjoint(words):
        return 0
    return 2 if WRAPPERS.isdisjoint(words) or not THREADS.isdisjoint(words) else 1


def parse(page: str) -> Node:
    """The page's tree; text is kept as strings between child nodes, references undecoded."""
    root = at = Node("#root", None, False)
    pos, end = 0, len(page)
    live: dict[str, int] = {}  # open elements by name, so that an end tag without one costs nothing

    def close(down: Node, up: Node) -> None:
        while down is not up:
            live[down.tag] -= 1
            down = down.parent

    while pos < end:
        m = TAG.search(page, pos)
        if not m:
            at.items.append(page[pos:])
            break
        if m.start() > pos:
            at.items.append(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                at.items.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if not live.get(tag):
                continue
            up = at
            while up.parent and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:  # a stray inline end closes no block
                    up = root
                    break
                up = up.parent
            if up.parent:
                close(at, up.parent)
                at = up.parent
            continue
        if tag in ENDS_P:
            if at.block.tag == "p":
                close(at, at.block.parent)
                at = at.block.parent
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            closes = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}[tag]
            up = at if any(live.get(x) for x in closes) else root
            while up.parent and up.tag not in ("ul", "ol", "dl", "table", "tbody", "select", "body") and up.tag not in closes:
                up = up.parent
            while up.tag in closes and up.parent:
                close(at, up.parent)
                at = up = up.parent
        node = Node(tag, at, at.dropped or _unwanted(tag, m[3], at.inside), 0 if at.dropped else _marked(tag, m[3]))
        at.items.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in RAW and tag not in ENDS_P and tag not in INLINE:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, pos)
            if not stop:
                if tag in ("noscript", "template"):  # never closed: what follows is page
                    continue
                break
            after = page.find(">", stop.start())
            pos = end if after < 0 else after + 1
            continue
        at = node
        live[tag] = live.get(tag, 0) + 1
    return root


def _measure(root: Node) -> list[Node]:
    """Text, link and comma counts of every kept node, children before parents; returns kept nodes in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.dropped:
            continue
        order.append(node)
        node.n_text = node.n_link = node.commas = 0
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                n = len(x) - x.count(" ") if x.strip() else 0
                node.n_text += n
                node.commas += x.count(",")
            elif not x.dropped:
                node.n_text += x.n_text
                node.n_link += x.n_link
                node.commas += x.commas
        if node.tag == "a":
            node.n_link = node.n_text
    return order


def _is_paragraph(node: Node) -> bool:
    """Whether text stands directly in the node, or in inline children of it."""
    return any((isinstance(x, str) and x.strip()) or (isinstance(x, Node) and x.tag in INLINE and x.n_text and not x.dropped) for x in node.items)


def _is_menu(node: Node) -> bool:
    """Whether a block is a list of links: three or more that make up most of its text."""
    if node.tag in INLINE or node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or node.n_link < 0.6 * node.n_text:
        return False
    n, todo = 0, [node]
    while todo and n < 3:
        x = todo.pop()
        n += x.tag == "a"
        todo += [y for y in x.items if isinstance(y, Node) and not y.dropped]
    return n >= 3


def _set_dropped(node: Node, dropped: list[Node]) -> None:
    """Drop a branch; the nodes that were not dropped yet are added to ``dropped``."""
    todo = [node]
    while todo:
        x = todo.pop()
        if not x.dropped:
            x.dropped = True
            dropped.append(x)
            todo += [y for y in x.items if isinstance(y, Node)]


def _cut_marked(root: Node) -> None:
    """Drop the branches that class or id mark, smallest first, but none that wraps the article.

    A branch that holds most of the page's paragraph points stays if its words also name
    a wrapper, or if hardly any points would be left; all stay if no text would be left.
    """
    order = _measure(root)
    marked = [n for n in order if n.marked]
    if not marked:
        return
    below: dict[int, float] = {}
    for node in reversed(order):
        own = 0.0
        if node.tag in SCORED and node.n_text:
            near = [x for x in node.items if isinstance(x, str) or (x.tag in INLINE and not x.dropped)]
            n = sum(len(x) - x.count(" ") if isinstance(x, str) else x.n_text for x in near if not isinstance(x, str) or x.strip())
            if n:
                own = (1 + sum(x.count(",") if isinstance(x, str) else x.commas for x in near) + min(n / 100, 3)) * (1 - node.n_link / node.n_text)
        below[id(node)] = own + sum(below[id(x)] for x in node.items if isinstance(x, Node) and not x.dropped)
    whole, dropped = root.n_text, []
    for node in sorted(marked, key=lambda n: below[id(n)]):
        if node.dropped:
            continue
        points, live = below[id(node)], below[id(root)]
        rest = live - points
        little = rest < 0.1 * live and (rest < 10 or rest < 0.02 * live)
        if points > live / 2 and (node.marked == 1 or little):
            continue
        _set_dropped(node, dropped)
        up = node
        while up:
            below[id(up)] -= points
            up = up.parent
    if whole and dropped:
        _measure(root)
        if not root.n_text:
            for x in dropped:
                x.dropped = False


def best(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order; none if the page has no text."""
    _cut_marked(root)
    order = _measure(root)
    scored = []
    for node in order:
        if node.tag in SCORED and node.n_text and _is_paragraph(node):
            points = 1 + node.commas + min(node.n_text / 100, 3)
            share, up = 1.0, node.parent
            for step in range(1, 6):
                if up is None or up.parent is None:
                    break
                if not up.points:
                    scored.append(up)
                up.points += points * share
                share = 1 / 2 if step == 1 else 1 / (3 * step)
                up = up.parent
            if node.tag not in ("p", "li", "td", "dd", "pre") and not node.points:
                node.points += points  # a container that holds its text directly
                scored.append(node)
    discounted = {id(n): n.points * (1 - n.n_link / max(1, n.n_text)) for n in scored}
    if not scored or max(discounted.values()) <= 0:
        return [root] if root.n_text else []
    top = max(scored, key=lambda n: discounted[id(n)])
    up = top  # the whole article, if the best container is a part of one
    while up:
        if up.tag in CONTAINERS:
            top = up
        up = up.parent
    if top.tag in CONTAINERS or top.parent is None:
        peers = [x for x in top.parent.items if isinstance(x, Node) and x.tag == top.tag and not x.dropped] if top.parent else [top]
    else:
        peers = [x for x in top.parent.items if isinstance(x, Node) and not x.dropped]
    floor = max(10.0, 0.2 * discounted.get(id(top), 0.0))

    def alike(x: Node) -> bool:
        if x is top:
            return True
        links = x.n_link / max(1, x.n_text)
        if discounted.get(id(x), 0.0) >= floor and links < 0.5:
            return True
        return top.tag not in CONTAINERS and x.n_text > 0 and links < 0.25

    kept = [x for x in peers if alike(x)]
    todo = list(kept)
    while todo:  # without the lists of links in it
        for x in todo.pop().items:
            if isinstance(x, Node) and not x.dropped and x.tag not in INLINE:
                if 2 * x.n_text < top.n_text and _is_menu(x):
                    x.dropped = True
                else:
                    todo.append(x)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """The text blocks below the nodes in page order: references decoded, white space single, none empty."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            text = "".join(line)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            line.clear()

    for top in nodes:
        todo: list = [(top, False)]
        while todo:
            x, done = todo.pop()
            if isinstance(x, str):
                line.append(x)
            elif done:
                close()
            elif not x.dropped:
                if x.tag in INLINE or x.tag == "br":
                    if x.tag == "br":
                        line.append(" ")
                else:
                    close()
                    todo.append((x, True))
                todo += [(y, False) for y in reversed(x.items)]
        close()
    return out


def main_text(page: str | None) -> str:
    """The page's article: blocks joined by one line feed; empty for null, empty or textless pages."""
    return "\n".join(blocks(best(parse(page)))) if page else ""


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``; n_chars counts code points.

    Null, empty and textless pages give empty text, repeated rows repeated results, an empty table
    an empty result; pages of any length are read whole, one at a time. Other columns are ignored.
    """
    with_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark, table(spark, sf_dir, "pages"))
