"""Main text of web pages by composite text density.

The page's markup becomes a tree. Elements that are boilerplate by what they are or are called
(navigation, footers, forms, scripts, adverts, comments of readers, ...) leave it first. A name in class
or id does not count on an element around the page's main or longest article; a name that is only a part
of a word (has-sidebar) not around any article either or, on pages without, around most of the text. For each
other node the density is its characters per tag, adjusted for links:

    C = characters, T = tags, LC = characters in links, LT = link tags (each at least 1)
    density = C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

A node's density sum is the sum of its children's densities (its own text counts as a child). The
subtree with the largest sum is the core of the text. The highest article or main around it (or, without
one, the highest element) that isn't mostly links is the container, and all of its text counts, headings,
short sections and bare text too. Only blocks off the core's path that are lists of links (three at least,
of over half the characters, and no paragraph with text beside its links) leave a container that is no article or main. The smallest density on the path from
the core up to the body is the threshold for what lies outside of the container: every highest subtree off
the path, and every bare text, that reaches it counts as text too, subtrees if they aren't mostly links. The
text is returned block by block in page order.

Defined results: null and empty pages, and pages without any text, give an empty string. Open
elements end as their parents end; text outside of any element belongs to the body. A head ends where text or an element
begins that can't stand in one. Elements are opened and closed in time linear in the page, however deep they are. Pages of any length
count whole, repeated rows one each; empty tables give no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

# Element names of the markup language, and names that sites give their boilerplate
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style head title noscript template iframe object embed svg canvas nav header footer aside form button select textarea dialog menu noembed noframes".split())
HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLING_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|disqus|footer|header|masthead|menu|menus|modal|nav|navbar|navigation|newsletter|notice|notices|pager|pagination|popup|promo|promoted|related|respond|share|sharing|sidebar|sidenav|social|sponsor|sponsored|subscribe|toolbar|topbar|widget|widgets)(?:$|[\s_-])"
)

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<(?P<open>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: A subtree off the core's path counts only below this share of link characters.
LINK_SHARE = 0.5
#: Links that a block has at least to be a list of links.
LINK_LIST = 3


class Node:
    __slots__ = ("chars", "children", "density", "dropped", "link_chars", "link_tags", "named", "parent", "prose", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, named: float = 0) -> None:
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        self.children: list[Node | str] = []


def _boilerplate(tag: str, rest: str) -> bool:
    if tag in DROPPED:
        return True
    if not rest or tag in ("body", "html", "main", "article"):
        return False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            return True
        if name == "role" and value.strip() in ROLES or name == "aria-hidden" and value.strip() == "true":
            return True
    return False


def _named(rest: str) -> float:
    """2 if a whole word of class or id is a boilerplate name, 1 if only a part of one is, 0.5 if that is only `related`, else 0."""
    found = 0
    for m in ATTRIBUTE.finditer(rest):
        if m[1].lower() in ("class", "id"):
            value = (m[2] or m[3] or m[4] or "").lower()
            if NAMES.search(value):
                found = max(found, 2 if any(NAMES.search(w) and not re.search("[_-]", w.strip("_-")) for w in value.split()) else 1 if NAMES.search(re.sub(r"related[_-]|[_-]related", "", value)) else 0.5)
    return found


def _without_named(body: Node) -> Node:
    """body without the elements that have boilerplate names, layout around the main text excepted."""
    order = _measure(body)
    if not any(x.named for x in order):
        return body
    mains = [x for x in order if x.tag in ("article", "main") and not x.named]
    text = lambda x: x.chars - x.link_chars
    principal = max(mains, key=lambda x: (x.tag == "main", text(x)), default=None)
    around: set[int] = set()
    for x in mains:
        up = x.parent
        while up is not None and id(up) not in around:
            around.add(id(up))
            up = up.parent
    first: set[int] = set()
    while principal is not None:
        first.add(id(principal))
        principal = principal.parent

    def stays(x: Node) -> bool:
        if not x.named or x.tag in ("article", "main") or id(x) in first:
            return True
        if x.named < 1 and x.link_chars <= LINK_SHARE * x.chars:  # related-work has text, related-posts has links
            return True
        return x.named <= 1 and (id(x) in around or not mains and 2 * text(x) > text(body))

    for x in order:
        x.children = [c for c in x.children if isinstance(c, str) or stays(c)]
    return body


class _Open:
    """The open elements from the body down, and for each name the depths at which it is open."""

    def __init__(self, body: Node) -> None:
        self.path, self.depths = [body], {"body": [0]}

    def push(self, x: Node) -> None:
        self.depths.setdefault(x.tag, []).append(len(self.path))
        self.path.append(x)

    def close(self, tag: str, fence: frozenset | set = frozenset()) -> None:
        """Ends the innermost open `tag` and all within it, unless a fence is open within it."""
        depth = self.depths.get(tag)
        if not depth or any(inner[-1] > depth[-1] for f in fence if (inner := self.depths.get(f))):
            return
        keep = depth[-1]
        while len(self.path) > keep:
            self.depths[self.path.pop().tag].pop()


def parse(page: str) -> Node:
    """The body's tree, without boilerplate."""
    body = Node("body", None, False)
    opened = _Open(body)
    at, end = 0, len(page)

    def text(part: str) -> None:
        if opened.path[-1].tag == "head" and part.strip():
            opened.close("head")
        opened.path[-1].children.append(part)

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if tag := m["open"]:
            tag = tag.lower()
            if tag == "body" or opened.path[-1].tag == "head" and tag not in HEAD:
                opened.close("head")
            if tag in ("html", "body"):
                continue
            if tag in ENDS_P:
                opened.close("p", {"table", "td", "th", "button", "article", "section", "div", "blockquote"})
            if tag in SIBLING_END:
                for name in sorted(SIBLING_END[tag]):
                    opened.close(name, SCOPE[tag])
            node = opened.path[-1]
            child = Node(tag, node, node.dropped or _boilerplate(tag, m["rest"]), _named(m["rest"]) if m["rest"] and "=" in m["rest"] else 0)
            if tag in VOID:
                if tag in ("br", "hr", "wbr") or not child.dropped:
                    node.children.append(child)
            elif tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                if not child.dropped:
                    child.children.append(page[at : stop.start() if stop else end])
                    node.children.append(child)
                at = stop.end() if stop else end
            else:
                if not child.dropped:
                    node.children.append(child)
                opened.push(child)
        elif tag := m["close"]:
            tag = tag.lower()
            if tag not in ("html", "body"):
                opened.close(tag)
        elif m["cdata"]:
            text(m["cdata"])
    return _without_named(body)


def _measure(body: Node) -> list[Node]:
    """Counts characters and tags of all nodes; returns them, children before parents."""
    order, stack = [], [body]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if not isinstance(c, str)]
    order.reverse()
    for x in order:
        x.chars = x.link_chars = x.tags = x.link_tags = x.prose = 0
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(c.strip())
            else:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
                x.prose += c.prose
        if x.tag == "a":
            x.link_chars = x.chars
        elif x.tag == "p":
            x.prose = x.chars - x.link_chars
    share = body.link_chars / max(body.chars, 1)
    for x in order:
        x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, share)
    return order


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1.0) + 1e-9) / max(math.log(base), 0.1) if base > 1 else chars / t


def _own_text(node: Node) -> int:
    return sum(len(c.strip()) for c in node.children if isinstance(c, str))


def _container(path: list[Node]) -> Node:
    """The highest article or main on the core's path, or the highest element of any kind, that isn't mostly links."""
    texts = [x for x in reversed(path) if x.link_chars <= LINK_SHARE * x.chars]
    return next((x for x in texts if x.tag in ("article", "main")), texts[0] if texts else path[0])


def _link_list(x: Node) -> bool:
    return x.tag in BLOCKS and x.link_tags >= LINK_LIST and x.link_chars > LINK_SHARE * x.chars and not x.prose


def chosen(body: Node) -> list[Node | str]:
    """The subtrees, and texts that stand between them, that hold the main text."""
    order = _measure(body)
    share = body.link_chars / max(body.chars, 1)
    core, most = body, -1.0
    for x in reversed(order):
        own = _own_text(x)
        total = sum(c.density for c in x.children if not isinstance(c, str)) + (_density(own, 1, own if x.tag == "a" else 0, 0, share) if own else 0)
        if total > most and x.tag != "a":
            core, most = x, total
    path, x = [core], core
    while x.parent is not None:
        x = x.parent
        path.append(x)
    threshold = min(x.density for x in path)
    on_path = {id(x) for x in path}
    container = _container(path)
    if container.tag not in ("article", "main"):
        for x in order:
            x.children = [c for c in x.children if isinstance(c, str) or id(c) in on_path or not _link_list(c)]
    out: list[Node | str] = []
    stack: list[Node | str] = [body]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if len(x.strip()) >= threshold > 0:
                out.append(x)
        elif x is container:
            out.append(x)
        elif id(x) in on_path:
            stack += reversed(x.children)
        elif x.density >= threshold > 0 and x.link_chars <= LINK_SHARE * x.chars:
            out.append(x)
    return out


def _blocks(root: Node | str) -> list[str]:
    """The texts of a subtree's blocks, in order: white space as one space, trimmed."""
    done: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(held)).split()):
            done.append(text)
        held.clear()

    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        x, closing = stack.pop()
        if isinstance(x, str):
            held.append(x)
        elif closing:
            flush()
        elif x.tag == "br":
            held.append(" ")
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append((x, True))
            stack += [(c, False) for c in reversed(x.children)]
    flush()
    return done


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body = parse(page)
    return "\n".join(b for x in chosen(body) for b in _blocks(x))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns with text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    source = pages.select(*keep, html)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
