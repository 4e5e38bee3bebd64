"""Main text of web pages by composite text density.

For every element: C characters of text, LC of them in links, T tags and LT
link tags below it. Its link-adjusted density is the one of Sun, Song and Liao
("DOM based content extraction via text density", 2011): C / T, scaled down by
a logarithm whose base grows with the share of links (C / T itself where there
are none to adjust for). The density sum of an
element adds the densities of its children (and its own text). The container
with the largest density sum is the main text; the smallest density on its path
to the body is the threshold at which other elements, beside that path, join it.

Elements that never hold main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out first,
by element name, role, class or id. A class or id counts if all its words are
such names, numbers or words for a part of a layout ("cookie-notice",
"sidebar_2", "site-footer", but not "no-sidebar" or "post-header"), and drops no
element that holds the page's articles, or most of its text if it has none.

Defined results: null and empty html, and pages without text, give an empty
string. Broken markup is read leniently: unknown end tags are ignored, open
elements end with the page, a truncated tag at the end is dropped, a truncated
character reference stays as it is. Repeated rows are extracted each, null ids
and urls are passed through, extra columns are ignored whatever their names, an
empty table gives an empty table. A page is read whole in one task; time and
memory grow with its length, however deep its elements lie.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends the open elements named here, up to the given limits.
IMPLIED = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
#: A start tag of any others ends an open head.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form button select textarea input iframe object embed svg canvas dialog menu title link meta".split())
#: Elements that hold text, and so are no containers.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Names of what is no main text, and words that only place it (fixed values).
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead toolbar share sharing social related recommended newsletter subscribe signup login comment comments commentlist replies respond disqus pagination pager skip".split()
)
_PLACES = frozenset("site page main top bottom left right global primary secondary box bar block container wrap wrapper widget widgets section area list item items inner outer links link buttons button icons posts articles stories news slot unit form thread js sticky fixed mobile desktop".split())
_WORDS = re.compile("[a-zA-Z]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)", re.DOTALL)
_ATTRS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def names_a_fault(value: str) -> bool:
    """Does a class or id name something that is no main text?"""
    for name in value.lower().split():
        words = _WORDS.findall(name)
        if any(w in _NAMES for w in words) and all(w in _NAMES or w in _PLACES for w in words):
            return True
    return False


class Node:
    __slots__ = ("C", "LC", "LT", "T", "density", "drop", "kids", "name", "named", "parent", "sum")

    def __init__(self, name: str, parent: Node | None, drop: bool = False):
        self.name, self.parent, self.drop, self.named = name, parent, drop, False
        self.kids: list[Node | str] = []


def parse(page: str) -> Node:
    """A tree of the elements and decoded texts of a page. ``depth`` counts the
    open elements of a name, so that none is looked for in vain."""
    root = now = Node("#root", None)
    depth: dict[str, int] = {}
    at, end = 0, len(page)

    def leave(to: Node) -> Node:
        """Close open elements up to ``to``, which stays open."""
        node = now
        while node is not to:
            depth[node.name] -= 1
            node = node.parent
        return to

    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            now.kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None or not m[4]:
            continue
        name = name.lower()
        if m[1]:
            if not depth.get(name):
                continue
            node = now
            while node.name != name:
                if name == "p" and node.name in ENDS_P:
                    break
                node = node.parent
            if node.name == name:
                now = leave(node.parent)
            continue
        if depth.get("head") and (name == "body" or now.name == "head" and name not in IN_HEAD):
            node = now
            while node.name != "head":
                node = node.parent
            now = leave(node.parent)
        if name in ENDS_P and depth.get("p"):
            node = now
            while node.name in INLINE:
                node = node.parent
            if node.name == "p":
                now = leave(node.parent)
        if name in IMPLIED:
            ended, limits = IMPLIED[name]
            ended, node, to = ended.split(), now, None
            if any(depth.get(x) for x in ended):
                while node.parent is not None and node.name not in limits:
                    if node.name in ended:
                        to = node.parent
                    node = node.parent
                if to is not None:
                    now = leave(to)
        drop, named = name in DROPPED, False
        if not drop and m[3] and name not in ("body", "html", "article", "main"):
            for key, a, b, c in _ATTRS.findall(m[3]):
                value = a or b or c
                if key.lower() == "role":
                    drop |= value.lower() in DROPPED_ROLES
                else:
                    named |= names_a_fault(value)
        kid = Node(name, now, drop or named)
        kid.named = named and not drop
        now.kids.append(kid)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            close = re.compile(f"</{name}[\\s/>]", re.IGNORECASE).search(page, at)
            stop = close.start() if close else end
            kid.kids.append(page[at:stop])
            at = page.find(">", stop) + 1 if close and page.find(">", stop) >= 0 else stop if not close else end
            continue
        now = kid
        depth[name] = depth.get(name, 0) + 1
    return root


def _keep_the_page(root: Node) -> None:
    """Take back drops by class or id that would leave the page without its
    articles or, if it has none, without most of its text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if not isinstance(k, str) and (not k.drop or k.named)]
    if not any(n.named for n in order):
        return
    size, holds = {}, {}
    for n in reversed(order):
        below = [k for k in n.kids if not isinstance(k, str) and id(k) in size]
        size[id(n)] = sum(len("".join(k.split())) for k in n.kids if isinstance(k, str)) + sum(size[id(k)] for k in below)
        holds[id(n)] = n.name in ("article", "main") and size[id(n)] > 0 or any(holds[id(k)] for k in below)
    while True:  # the outermost first; what is named inside is judged again
        kept, named, todo = False, [], [root]
        while todo:
            node = todo.pop()
            if node.named and node.drop:
                named.append(node)
                continue
            kept |= node.name in ("article", "main") and size[id(node)] > 0
            todo += [k for k in node.kids if not isinstance(k, str) and id(k) in size]
        if kept or not named:
            return
        if holds[id(root)]:
            back = max((n for n in named if holds[id(n)]), key=lambda n: size[id(n)])
        else:
            back = max(named, key=lambda n: size[id(n)])
            if 2 * size[id(back)] <= size[id(root)]:
                return
        back.drop = False


def _measure(root: Node) -> list[Node]:
    """Counts of every kept element, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if not isinstance(k, str) and not k.drop]
    order.reverse()
    for node in order:
        c = lc = t = lt = 0
        for k in node.kids:
            if isinstance(k, str):
                c += len("".join(k.split()))
            elif not k.drop:
                c += k.C
                lc += k.LC
                t += k.T + 1
                lt += k.LT + (k.name == "a")
        node.C, node.T, node.LT = c, t, lt
        node.LC = c if node.name == "a" else lc
    return order


def _density(n: Node, body: Node) -> float:
    if not n.C:
        return 0.0
    t, lc, lt = max(n.T, 1), max(n.LC, 1), max(n.LT, 1)
    base = math.log(n.C / max(n.C - n.LC, 1) * n.LC + max(body.LC, 0) / max(body.C, 1) * n.C + math.e)
    scale = n.C / lc * t / lt
    return n.C / t * (math.log(scale) / math.log(base) if scale > 1 and base > 1.0001 else 1.0 if n.LC == 0 else 0.0)


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks under an element, white space collapsed."""
    out: list[str] = []
    own: list[str] = []

    def close():
        text = " ".join("".join(own).split())
        if text:
            out.append(text)
        own.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            own.append(x)
        elif x is None:
            close()
        elif not x.drop:
            if x.name in ("br", "td", "th", "img"):
                own.append(" ")
            if x.name in INLINE:
                todo += reversed(x.kids)
            elif x.name in ("td", "th"):
                todo += [" ", *reversed(x.kids)]
            else:
                close()
                todo.append(None)
                todo += reversed(x.kids)
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    _keep_the_page(root)
    order = _measure(root)
    body = next((n for n in reversed(order) if n.name == "body"), root)
    if not body.C:
        body = root
    for n in order:
        n.density = _density(n, body)
    best, inside = None, {id(body)}
    for n in reversed(order):  # parents before children
        if n is body or n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
    for n in order:
        if id(n) not in inside or n.name in INLINE or n.name in TEXTUAL or not n.C:
            continue
        n.sum = sum(len("".join(k.split())) if isinstance(k, str) else 0.0 if k.drop else k.density for k in n.kids)
        if best is None or n.sum >= best.sum:
            best = n
    if best is None:
        return ""
    above, node, threshold = set(), best, best.density
    while node is not body:
        node = node.parent
        above.add(id(node))
        threshold = min(threshold, node.density)
    out: list[str] = []
    todo: list = [body]
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.drop:
            continue
        if id(x) in above:
            todo += reversed(x.kids)
        elif x is best or x.name not in INLINE and x.C and x.density >= threshold and x.density > 0:
            out += _blocks(x)
    return "\n\n".join(out)


def html_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars of every row of ``df``."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [main_text(x) for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["_id", "_url", "text", "n_chars"])

    pages = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = map_batches(pages, fn, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
