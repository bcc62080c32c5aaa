"""Main text of HTML pages by tree scoring.

A page becomes a tree of block elements. Paragraphs pass points for length and commas on to their
ancestors, a link's share of the text discounts them; the outermost marked article, else main element, around the container
with the most points is the article, else the container and those of its siblings that are not mostly links. Menus, forms, adverts, comments and the like are cut off first.

Defined results: NULL and empty pages, and pages without text, give the empty text; broken markup is read
as browsers do (implied and missing end tags); pages of any length are read whole; repeated rows are read
row by row; input columns stay in ``row``.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from cohortlens.llm.arrays import map_texts

#: Elements whose content is no markup.
_RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>|([^<]+)|<",
    re.IGNORECASE | re.DOTALL)
#: One name with its value, if any; read in order, so nothing is found inside of names and values.
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby
    s samp small span strike strong sub sup time tt u var wbr br""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("""nav footer aside form button select option object embed svg canvas audio video map dialog menu
    fieldset head datalist""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar tablist".split())
HEADERS = frozenset("header masthead topbar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion
    banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup
    comment comments disqus respond replies sidebar sidebars rail widget widgets related recommended recommendations
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer share sharing social login
    paywall outbrain taboola""".split())
#: Last parts of compound names that say no more than that something is a box.
BOXES = frozenset("""area bar block body box button buttons card container content feed form frame group holder inner item items
    link links list module outer panel placeholder post posts row section slot stories strip thread unit wrap wrapper zone""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag (key) ends these open elements up to the next one that bounds its scope.
_P_ENDERS = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd""".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
           "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
_CLOSES = {k: (frozenset(v[0].split()), frozenset(v[1])) for k, v in _CLOSES.items()}


class _Node:
    __slots__ = ("tag", "parent", "cut", "inside", "points", "size", "links", "depth")

    def __init__(self, tag: str, parent: _Node | None, cut: bool, inside: bool):
        self.tag, self.parent, self.cut, self.inside = tag, parent, cut, inside
        self.points, self.size, self.links = 0.0, 0, 0
        self.depth = parent.depth + 1 if parent else 0


def _cut(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of any article. ``inside``: it lies in an article or main element."""
    if tag in BOILERPLATE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    inside = inside or tag in ("article", "main")
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            if any(_names_boilerplate(word, inside) for word in value.split()):
                return True
    return False


def _names_boilerplate(word: str, inside: bool) -> bool:
    """Whether a class or id names something beside the article. Within an article only names of such a thing itself
    or of a box for it count: ``comments``, ``share-buttons``, but not ``notice-period``."""
    parts = [x.lower() for x in _TOKENS.findall(word)]
    if not inside:
        return any(x in NAMES or x in HEADERS for x in parts)
    return bool(parts) and (parts[-1] in NAMES or parts[-1] in BOXES and any(x in NAMES for x in parts))


def blocks_of(html: str) -> list[tuple[_Node, str]]:
    """The page's text blocks outside of cut-off parts, in page order, with the element that holds each."""
    node = _Node("html", None, False, False)
    out: list[tuple[_Node, str]] = []
    text: list[str] = []
    in_link = links = 0
    open_tags: dict[str, int] = {}

    def flush() -> None:
        nonlocal links
        if text:
            value = " ".join("".join(text).split())
            text.clear()
            if value:
                out.append((node, value))
                at, n = node, min(links, len(value))
                while at is not None:
                    at.size += len(value)
                    at.links += n
                    at = at.parent
            links = 0

    def leave(to: _Node) -> None:
        """Close all open elements below ``to``."""
        nonlocal node
        while node is not to:
            open_tags[node.tag] -= 1
            node = node.parent

    for m in _TOKEN.finditer(html):
        raw, end, tag, attributes, data = m.group(1, 2, 3, 4, 5)
        if data is not None:
            if not node.cut:
                value = unescape(data) if "&" in data else data
                text.append(value)
                if in_link:
                    links += len(value.strip())
            continue
        if tag is None:
            if raw is None and m[0] == "<" and not node.cut:
                text.append("<")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if end else 1
            elif tag == "br" and not node.cut:
                text.append(" ")
            elif not end and attributes and not node.cut and tag not in VOID and _cut(tag, attributes, node.inside):
                flush()
                node = _Node(tag, node, True, node.inside)
                open_tags[tag] = open_tags.get(tag, 0) + 1
                continue
            if not (end and open_tags.get(tag)):
                continue
        flush()
        if end:
            if open_tags.get(tag):
                at = node
                while at.tag != tag:
                    at = at.parent
                leave(at.parent or at)
            continue
        if tag in ("html", "body") and tag in open_tags:
            continue
        if tag in _P_ENDERS and open_tags.get("p"):
            at = node
            while at.tag != "p":
                at = at.parent
            leave(at.parent)
        if tag in _CLOSES:
            ended, bounds = _CLOSES[tag]
            at, last = node, None
            while at.parent is not None and at.tag not in bounds:
                if at.tag in ended:
                    last = at
                at = at.parent
            if last is not None:
                leave(last.parent)
        if tag in HEADINGS and node.tag in HEADINGS:
            leave(node.parent)
        if tag in VOID or attributes.endswith("/") and tag not in _P_ENDERS:
            continue
        if tag == "html":
            open_tags[tag] = 1
            continue
        cut = node.cut or _cut(tag, attributes, node.inside)
        node = _Node(tag, node, cut, node.inside or tag in ("article", "main"))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return out


_PARAGRAPH = frozenset("p pre li dd dt td th blockquote figcaption caption summary address".split()) | HEADINGS


def main_text(html: str) -> str:
    """The article's blocks, joined by newlines."""
    found = blocks_of(html)
    if not found:
        return ""
    scored: dict[int, _Node] = {}
    for node, value in found:
        if node.tag in HEADINGS:
            points = 1.0
        else:
            points = 1.0 + value.count(",") + min(len(value) / 100, 3.0)
        at = node.parent if node.tag in _PARAGRAPH and node.parent else node
        share = 1.0
        level = 1
        while at is not None and level <= 5:
            at.points += points * share
            scored[id(at)] = at
            level += 1
            share = 1 / 2 if level == 2 else 1 / (3 * (level - 1))
            at = at.parent

    def score(n: _Node) -> float:
        return n.points * (1 - n.links / max(n.size, 1))

    best = max(scored.values(), key=lambda n: (score(n), n.depth))
    # the article, else the main element, that holds the best container, where the page marks one
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    at = next((n for n in reversed(above) if n.tag == "article"), None) or next((n for n in reversed(above) if n.tag == "main"), None)
    if at is not None:
        kept = {id(at)}
    else:
        while best.tag in ("ul", "ol", "dl", "table", "tbody", "tr") and best.parent is not None:
            best = best.parent  # a list or table is no article of its own
        while best.parent is not None and best.parent.size == best.size:
            best = best.parent  # wrappers of nothing else
        kept, within = {id(best)}, best.parent
        if within is not None:
            for node, _ in found:
                child = node
                while child.depth > within.depth + 1:
                    child = child.parent
                if child.parent is within and 2 * child.links < child.size:
                    kept.add(id(child))
    out = []
    inside: dict[int, bool] = {}
    for node, value in found:
        key = id(node)
        if key not in inside:
            at = node
            while at is not None and id(at) not in kept:
                at = at.parent
            inside[key] = at is not None
        if inside[key]:
            out.append(value)
    return "\n".join(out)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns), ``text`` and ``n_chars``."""
    def make():
        def work(pages_: pa.Array) -> list[pa.Array]:
            texts = [main_text(x) if x else "" for x in pages_.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        return work

    return map_texts(pages, html, StructType().add("text", StringType()).add("n_chars", LongType()), make, keep)
