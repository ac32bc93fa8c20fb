"""Main text of HTML pages by composite text density.

The page is parsed to a tree (with the closing tags that HTML implies).  Parts
that are never article are cut: scripts, styles, forms, menus, page headers,
footers, asides, hidden parts, and elements whose class, id or role says so
(adverts, sidebars, notices, comments and the like).  A word of a class or id may
also be of a layout ("has-sidebar"), so the part stays if it holds the page's
only articles or most of its text outside links; a name that is such a word as a
whole ("sidebar") needs both, or four fifths of the text, and no article beside it.

Each node has C characters and T tags below it, LC characters in links and LT
link tags.  Its composite density is

    C / T * ln(C / LC * T / LT) / ln(ln(C / (C - LC) * LC + LC_body / C_body * C + e))

(zero divisors count as 1, the last logarithm as 0.1 at least), so link lists
weigh little.  A node's density sum adds the densities of its children; that of
an <article> or <main> counts twice.  The subtree of greatest density sum is main
text, as a whole unless it is the body or a part around articles.  Density grows
with a part's size, so what lies beside the path from that subtree to the body
(headlines, leads, short sections, further articles, bare text) is not judged by
density alone: it is left out only if it is below the least density on the path
and mostly links, more so than the path itself (an <article> or <main>: nearly
all links).  Headings stay, and so do paragraphs of one or two links between
parts that stay; text within a list of links stays if a block of it is not
mostly links.

Character references are decoded, white space within a block becomes one space,
blocks are trimmed and joined by line feeds, empty ones left out.  Nothing is cut
by length.

Nulls and empty pages have an empty text; null ids and urls play no part.  Very
long and malformed pages are parsed whole, in time that grows with their length.
Ties: of subtrees of equal density sums the first in page order is chosen.  Equal
pages have equal texts.  An empty table gives an empty result.  A column named
like the new one is replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import Own, arrow_map, quoted, table

# Element names of HTML, and words that mark parts other than the article.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes plaintext script style textarea title xmp".split())
MATH = frozenset("maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img area audio map object param source track video".split()) | MATH
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split())
CUT = frozenset("annotation annotation-xml aside button canvas datalist dialog embed footer form frame frameset head iframe input menu nav noembed noframes noscript option script search select style svg template textarea title xmp".split())
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
CUT_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts advertising aside banner breadcrumb breadcrumbs byline-links comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination pager popup promo promoted promotion rail recommended register related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
REGIONS = frozenset(("article", "main"))
SAFE = frozenset("html body article main".split())
#: Articles have at least this share of their characters outside links.
REGION_SHARE = 0.1
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What _cut says of an element, in order of strength.
NAMED, TITLED, CUT_OFF = 1, 2, 3


class Node:
    __slots__ = ("chars", "children", "cut", "density", "link_chars", "link_tags", "name", "parent", "tags", "total")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.children, self.cut = name, parent, [], 0
        if parent is not None:
            parent.children.append(self)


class _Open:
    """The open elements, with the places of each name and of what is not inline, so that none has to be searched for."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, at: int) -> None:
        """Close the element at this place and all in it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)


def _cut(name: str, attributes: str, inside: _Open) -> int:
    """Whether the element is no part of an article: 0 it may be, NAMED a word of its class or id says so, TITLED all of one, CUT_OFF it is none."""
    if name in CUT:
        return CUT_OFF
    if name == "header":
        return 0 if inside.last(*REGIONS) else CUT_OFF
    if not attributes or name in SAFE:
        return 0
    cut = 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            if any(w.lower() in CUT_WORDS for w in _NAME_WORD.findall(value)):
                cut = max(cut, TITLED if any(w in CUT_WORDS for w in value.lower().split()) else NAMED)
        elif key == "role" and value.lower() in CUT_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return CUT_OFF
    return cut


def parse(page: str) -> Node:
    """The tree of the page's parts that may be article, in time that grows with the page's length."""
    root = Node("html", None)
    opened = _Open(root)
    stack = opened.stack
    off: list[Node] = []  # parts that are cut; tags within them close elements like others
    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        # Behind the last ">" no tag ends any more; only a comment may still begin.
        m = _TAG.search(page, at) if at <= last else None
        stop = m.start() if m else page.find("<!--", at) if "<!--" in page[at:] else size
        if stop > at:
            text = page[at:stop]
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if k := opened.last(name):
                opened.close(k)
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        if name == "body" and opened.last("head"):
            opened.close(opened.places["head"][0])
        if name == "html" or name == "body" and opened.last(name):
            continue
        if name in CLOSES_P and stack[opened.blocks[-1]].name == "p":
            opened.close(opened.blocks[-1])
        if name in SCOPE and (k := opened.last(*PEERS[name])) > opened.last(*SCOPE[name]):
            opened.close(k)
        if name in VOID:
            Node(name, stack[-1])
        else:
            cut = _cut(name, attributes, opened)
            opened.push(Node(name, stack[-1]))
            stack[-1].cut = cut
            if cut == CUT_OFF:
                off.append(stack[-1])
    for n in off:
        n.children = []
    for n in {n.parent for n in off}:
        n.children = [c for c in n.children if isinstance(c, str) or c.cut != CUT_OFF or c.name in CLOSES_P]
    for n in off:
        n.cut = 0
    return root


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out = [root]
    for n in out:
        out += [c for c in n.children if isinstance(c, Node)]
    return out


def settle(root: Node) -> None:
    """Empty the parts that class or id names as no article, but for those around the page's article."""
    nodes = _ordered(root)
    if not any(n.cut for n in nodes):
        return
    plain, regions, open_, sure = {}, {}, {}, {}
    for n in reversed(nodes):
        plain[n] = regions[n] = open_[n] = sure[n] = 0
        for c in n.children:
            if not isinstance(c, Node):
                plain[n] += len(c.strip())
                open_[n] += len(c.strip())
            elif c.name != "a":
                plain[n] += plain[c]  # characters outside links
                regions[n] += plain[c] if c.name in REGIONS else regions[c]  # those in articles
                if not c.cut:
                    open_[n] += open_[c]  # those in no named part
                    sure[n] += open_[c] if c.name in REGIONS else sure[c]  # those in articles and in no named part
    rival = {root: False}  # an article with text in no named part is beside the node or one around it, or an <article> with such text is around
    for n in nodes:
        if n not in rival:
            continue
        of = {c: (open_[c] if c.name in REGIONS else sure[c]) if not c.cut else 0 for c in n.children if isinstance(c, Node)}
        total, around = sum(of.values()), rival[n] or n.name == "article" and open_[n] > 0
        for c in of:
            rival[c] = around or total > of[c]
            if not c.cut:
                continue
            share, holds = plain[c] / (plain[root] or 1), regions[c] > 0
            if c.cut == NAMED:
                keep = share > 0.5 or holds and not rival[c]
            else:
                keep = share > (0.5 if holds else 0.8) and not rival[c]
            if not keep:
                c.children = []
                del rival[c]


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and density sums of the tree."""
    nodes = _ordered(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, Node):
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.chars if c.name == "a" else c.link_chars
                n.link_tags += c.link_tags + (c.name == "a")
            else:
                n.chars += len(c.strip())
    share = root.link_chars / (root.chars or 1)
    for n in nodes:
        c, t, lc, lt = n.chars, n.tags or 1, n.link_chars, n.link_tags
        if n.name == "a":
            lc, lt = c, lt + 1
        if not c:
            n.density = 0.0
            continue
        down = math.log(math.log(c / ((c - lc) or 1) * lc + share * c + math.e))
        n.density = c / t * max(0.0, math.log(c / (lc or 1) * t / (lt or 1))) / max(0.1, down)
    for n in nodes:
        n.total = sum(c.density for c in n.children if isinstance(c, Node))
    return nodes


def _blocks(chosen: list[Node]) -> list[str]:
    """Texts of the blocks below the nodes, in page order."""
    out, now = [], []

    def end() -> None:
        if now and (text := " ".join("".join(now).split())):
            out.append(text)
        now.clear()

    for root in chosen:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif x.name == "br":
                now.append(" ")
            elif x.name in INLINE:
                stack += reversed(x.children)
            else:
                end()
                stack.append(None)
                stack += reversed(x.children)
        end()
    return out


def _units(n: Node) -> list[tuple[int, int]]:
    """Where a node's children are blocks, and runs of bare text and inline elements between them."""
    out, block = [], True
    for k, c in enumerate(n.children):
        if isinstance(c, Node) and c.name not in INLINE:
            out.append((k, k + 1))
            block = True
        elif block:
            out.append((k, k + 1))
            block = False
        else:
            out[-1] = (out[-1][0], k + 1)
    return out


def _links(unit: list) -> tuple[int, int, int]:
    """Characters outside links, characters in links, and links of a unit."""
    nodes = [c for c in unit if isinstance(c, Node)]
    chars = sum(c.chars for c in nodes) + sum(len(c.strip()) for c in unit if not isinstance(c, Node))
    inside = sum(c.chars if c.name == "a" else c.link_chars for c in nodes)
    return chars - inside, inside, sum(c.link_tags + (c.name == "a") for c in nodes)


def _prune(body: Node, best: Node) -> None:
    """Empty what is mostly links beside the path from the body to best (and in best, if that is the body or around articles)."""
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    share = min([0.5, *(1 - n.link_chars / n.chars for n in path)])
    on_path = {id(n) for n in path}
    todo = path[:0:-1]  # the path; then what is below parts that are mostly links
    if not any(n.name in REGIONS for n in path) and (best is body or any(n.name in REGIONS and n.chars for n in _ordered(best))):
        todo.append(best)
    n_path = len(todo)
    for at, n in enumerate(todo):
        spans = _units(n)
        units = [n.children[i:j] for i, j in spans]
        counts = [_links(u) for u in units]
        fits = []
        for u, (plain, inside, _) in zip(units, counts, strict=True):
            nodes = [c for c in u if isinstance(c, Node)]
            dense = any(id(c) in on_path or c.chars and c.density >= threshold for c in nodes)
            title = at < n_path and nodes and nodes[0].name in HEADINGS
            least = min(share, REGION_SHARE) if nodes and nodes[0].name in REGIONS else share
            fits.append(bool(plain + inside) and bool(dense or title or plain >= least * (plain + inside)))
        for k, (i, j) in enumerate(spans):
            if fits[k]:
                continue
            block = units[k][0] if isinstance(units[k][0], Node) and units[k][0].name not in INLINE else None
            if at < n_path and (block is None or block.name == "p") and counts[k][2] <= 2 and any(fits[:k]) and any(fits[k + 1 :]):
                continue  # a byline or the like
            if block is not None and any(isinstance(c, Node) and c.name not in INLINE for c in block.children):
                todo.append(block)
                continue
            for c in units[k]:
                if isinstance(c, Node):
                    c.children, c.chars = [], 0
            n.children[i:j] = [c if isinstance(c, Node) else " " for c in units[k]]
    for n in reversed(todo[n_path:]):
        text = False
        for c in reversed(n.children):
            if isinstance(c, Node) and c.name in HEADINGS and not text:
                c.children, c.chars = [], 0
            text = text or bool(c.chars if isinstance(c, Node) else c.strip())
        n.chars = sum(c.chars if isinstance(c, Node) else len(c.strip()) for c in n.children)


def main_text(page: str | None) -> str:
    """The page's main text."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    nodes = measure(root)
    if not root.chars:
        return ""
    body = next((n for n in nodes if n.name == "body" and n.chars), root)
    best = max(_ordered(body), key=lambda n: n.total * (2 if n.name in REGIONS else 1))
    if not best.total:
        return "\n".join(_blocks([body]))
    _prune(body, best)
    return "\n".join(_blocks([body]))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each in column out."""
    own = Own(pages.withColumn(out, F.col(quoted(html_col))) if out.lower() == html_col.lower() else pages, [] if out.lower() == html_col.lower() else [out])
    source = own.name(html_col)
    df = own.df.withColumn("__html", F.col(source).cast("string"))
    left = [c for c in df.columns if c != "__html" and not (out.lower() == html_col.lower() and c == source)]
    at = df.columns.index("__html")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([main_text(p) for p in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in left], texts], [*left, "__text"])

    schema = T.StructType([*df.select(*left).schema.fields, T.StructField("__text", T.StringType())])
    got = arrow_map(df, run, schema)
    return got.select(*[F.col(own.name(c)).alias(c) for c in own.names if own.name(c) in left], F.col("__text").alias(out))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html")))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
