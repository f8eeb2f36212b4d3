"""Main-text extraction from web pages by scoring the element tree.

Each block of text earns points for its length and its commas and passes them to its ancestors (all to the
nearest container, less to each one further up). A container's points are discounted by its link density, and
by what its element or names say of it: menus, page headers, footers, sidebars, notices, adverts, forms and reader
comments count little. The best container is kept whole. Inside an article or main element all of that element is kept with it,
but for parts that are mostly links; elsewhere those siblings that score well, and paragraphs and headings without
links. Only then parts whose names mark them as no article text go, never one that the best container lies in; a name that
merely holds such a word (share-price) takes links with it, not prose. Scripts, styles and form controls have no text at all.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

TOKEN = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|textarea|iframe|title|noembed|noframes)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
SPACE = re.compile(r"\s+")
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p li dd dt pre blockquote td th h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
BLOCKS = PARAGRAPHS | frozenset("html head body main article section div center ul ol dl table thead tbody tfoot tr figure details hgroup header footer nav aside form fieldset dialog".split())
NEVER = frozenset("head button select option".split())
ASIDE = frozenset("nav footer aside form fieldset dialog menu".split())
CLOSES_P = BLOCKS - frozenset("td th tr thead tbody tfoot caption li dd dt html head body".split()) | {"hr"}
#: Words in a class, id or role that mark what isn't article text,
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidenav footer masthead comment comments commentlist respond disqus discussion replies reply cookie cookies consent notice notices notification alert gdpr popup "
    "modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar widget "
    "complementary contentinfo".split()
)
#: words that may stand beside them in such a name,
NEUTRAL = frozenset(
    "area box section wrapper wrap container bar block item items list left right top bottom main site page post posts article articles content body inner outer group panel user "
    "global primary secondary link links text title button buttons icons row col column thread entry story unit slot holder form header the".split()
)
#: and words that make a name tell a page's state.
STATE = frozenset("no not has have with without open opened closed enabled disabled is are on off hide hidden show".split())
#: What text counts under a marked element, and under one that merely has such a word in its name.
STRONG, WEAK = 0.1, 0.5


class Node:
    __slots__ = ("chars", "children", "factor", "link_chars", "mark", "points", "skip", "tag", "up")

    def __init__(self, tag: str, up: Node | None, skip: bool, mark: float = 1.0):
        self.tag, self.up, self.skip, self.mark = tag, up, skip, mark
        self.factor = mark if up is None else min(mark, up.factor)
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        self.children: list[Node | str | None] = []
        if up is not None:
            up.children.append(self)


def named(value: str) -> float:
    """What the names of a class, id or role make of an element's text: 1, WEAK or STRONG."""
    least = 1.0
    for name in value.lower().split():
        parts = set(re.split(r"[^a-z]+", name)) - {""}
        if parts & UNLIKELY and not parts & STATE:
            least = min(least, STRONG if parts <= UNLIKELY | NEUTRAL else WEAK)
    return least


def marked(tag: str, attrs: str, up: Node) -> float:
    if tag in ASIDE:
        return STRONG
    if tag == "header":
        node: Node | None = up
        while node is not None and node.tag not in ("article", "main"):
            node = node.up
        return 1.0 if node is not None else STRONG
    if not attrs or "=" not in attrs or (tag not in BLOCKS and tag != "span"):
        return STRONG if attrs and HIDDEN.search(attrs) else 1.0
    if HIDDEN.search(attrs):
        return STRONG
    return min([named(m[1] or m[2] or m[3] or "") for m in NAMED.finditer(attrs)], default=1.0)


def parse(page: str) -> Node:
    """The element tree; a None child stands for a break inside a block."""
    root = node = Node("html", None, False)
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            if not node.skip:
                node.children.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            target: Node | None = node
            while target is not None and target.tag != tag:
                if target.tag in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot") and tag not in BLOCKS:
                    target = None
                    break
                target = target.up
            if target is not None and target.up is not None:
                node = target.up
            elif tag in BLOCKS and not node.skip:
                node.children.append(None)
            continue
        if tag in ("html", "body"):
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in VOID:
            if tag in ("br", "hr") and not node.skip:
                node.children.append(" " if tag == "br" else None)
            continue
        if tag in CLOSES_P:
            probe: Node | None = node
            while probe is not None and probe.tag != "p" and (probe.tag not in BLOCKS):
                probe = probe.up
            if probe is not None and probe.tag == "p" and probe.up is not None:
                node = probe.up
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            probe = node
            while probe is not None and probe.tag not in same and probe.tag not in ("ul", "ol", "dl", "table", "div", "section", "article", "body"):
                if tag in ("td", "th") and probe.tag == "tr":
                    break
                probe = probe.up
            if probe is not None and probe.tag in same and probe.up is not None:
                node = probe.up
        node = Node(tag, node, node.skip or tag in NEVER, marked(tag, attrs, node))
        if attrs.endswith("/") and tag not in BLOCKS:
            node = node.up or root
    if at < len(page) and not node.skip:
        node.children.append(page[at:])
    return root


def blocks(node: Node, inside: Node, link: bool, out: list[tuple[Node, list[tuple[str, bool]]]]) -> None:
    """Text by block in page order: (block element, [(text, whether in a link)])."""
    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, inside, link)]
    current: list[tuple[str, bool]] = []
    owner: Node = inside

    def flush(to: Node) -> None:
        nonlocal current, owner
        if current:
            out.append((owner, current))
            current = []
        owner = to

    while stack:
        at, k, block, linked = stack.pop()
        if k == 0 and at.tag in BLOCKS:
            flush(at)
            block = at
        while k < len(at.children):
            child = at.children[k]
            k += 1
            if child is None:
                flush(block)
            elif isinstance(child, str):
                if owner is not block:
                    flush(block)
                current.append((child, linked))
            elif not child.skip:
                stack.append((at, k, block, linked))
                stack.append((child, 0, block, linked or child.tag == "a"))
                break
        else:
            if at.tag in BLOCKS:
                flush(at.up or at)


def clean(parts: list[tuple[str, bool]]) -> str:
    text = "".join([x for x, _ in parts])
    if "&" in text:
        text = html.unescape(text)
    return SPACE.sub(" ", text).strip()


def extract(page: str | None) -> str:
    """The article's blocks joined by newlines; empty if there are none."""
    if not page:
        return ""
    root = parse(page)
    found: list[tuple[Node, list[tuple[str, bool]]]] = []
    blocks(root, root, False, found)
    texts = [(node, clean(parts), sum(len(clean([x])) for x in parts if x[1])) for node, parts in found]
    texts = [x for x in texts if x[1]]
    if not texts:
        return ""
    for node, text, linked in texts:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * node.factor
        to, share = (node.up if node.tag in PARAGRAPHS and node.up is not None else node), 1
        while to is not None:
            to.points += points / share
            share += 1
            to = to.up
        to = node
        while to is not None:
            to.chars += len(text)
            to.link_chars += linked
            to = to.up
    density = lambda n: n.link_chars / max(n.chars, 1)
    score = lambda n: (n.points + {"article": 25, "main": 10}.get(n.tag, 0) * (n.points > 0) * n.factor) * (1 - density(n))
    best, most, seen = root, -1.0, set()
    for node, _, _ in texts:
        to = node
        while to is not None and id(to) not in seen:
            seen.add(id(to))
            if to.tag not in ("ul", "ol", "dl", "tr", "tbody", "thead", "table") and to.tag not in PARAGRAPHS and score(to) > most:
                best, most = to, score(to)
            to = to.up
    keep, drop, path = {id(best)}, set(), [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    above = {id(n) for n in path}
    home = next((n for n in path if n.tag in ("article", "main")), root)
    if best.tag not in ("article", "main") and home is not root:  # all of it, but for parts that are mostly links
        keep.add(id(home))
        for node in path[1 : path.index(home) + 1]:
            drop |= {id(o) for o in node.children if isinstance(o, Node) and id(o) not in above and density(o) >= 0.5 and o.chars}
    elif best.up is not None and best.tag != "article":
        for other in best.up.children:
            if isinstance(other, Node) and other is not best and other.chars:
                prose = other.tag in PARAGRAPHS and (density(other) < 0.25 and other.chars > 80 or density(other) == 0)
                if prose or other.points and score(other) >= max(10.0, 0.2 * most) and density(other) < 0.25:
                    keep.add(id(other))
    elif best.tag == "article" and best.up is not None:  # further articles of the same page part are the same text's
        keep |= {id(o) for o in best.up.children if isinstance(o, Node) and o.tag == "article" and score(o) >= 0.2 * most}

    def lines(marks: bool) -> list[str]:
        out = []
        for node, text, _ in texts:
            to, gone = node, False
            while to is not None and id(to) not in drop:
                gone = gone or marks and to.mark < 1 and id(to) not in above and (to.mark == STRONG or density(to) >= 0.25)
                if id(to) in keep:
                    break
                to = to.up
            if to is not None and id(to) in keep and not gone:
                out.append(text)
        return out

    return "\n".join(lines(True) or lines(False))


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        pages = get("html")
        for at in range(0, max(len(batch), 1), 500):  # the texts of few pages are in memory at once
            texts = [extract(x.as_py()) for x in pages.slice(at, 500)]
            yield pa.RecordBatch.from_arrays([get("page_id").slice(at, 500), get("url").slice(at, 500).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=RESULT)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, without a shuffle.

    Null and empty pages give an empty text; a page of any length is read whole; repeated pages, null ids and
    urls pass through; other columns aren't read.
    """
    return pages.select("page_id", "url", "html").mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
