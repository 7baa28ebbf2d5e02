"""Main text of web pages, without what a site's template repeats.

Each page is parsed into a tree, and its subtrees are hashed (tag, class, texts and child hashes).
Spark counts, per host, on how many different pages a subtree stands; copies of one page count once.  A subtree
is template where it stands on ``min_pages`` pages of its host at least and on a share of the host's pages:
containers (lists, tables, divisions) outside an article or main element on ``share`` of them, paragraphs there
and containers inside an article or main element on ``prose_share``.  What stands inside articles is counted by
itself, on pages whose articles differ in more than a passage (near copies of one article count once as a rule).
Paragraphs and headings inside an article stay, as articles share passages.

Elements that are boilerplate by their own tag or role (menus, forms, asides and so on) go too, and those of which a
whole class or id is the name of such: inside an article only the names of adverts, notices on cookies, subscriptions
and reader comments, as other names there may be those of content.  Longer names that hold such a word say nothing;
what they name goes if it recurs.  What is left
of the article (or the main element, or else the body) is the text: character references are decoded in each piece of text, white space
in a block becomes one space, blocks are joined in page order by one space.

The template table has one row for each recurring subtree of a host, not for each page.  It is broadcast only
below a checked number of rows; beyond, pages are joined with their deleted hashes.  Both delete the same nodes.

Rows: null and empty html give an empty text; unclosed and broken markup is read as far as it goes, to any
depth and length, in time that grows in proportion; a null url counts as a host without a name; pages that repeat an id are extracted one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.batches import bounded_batches, tidy
from canopy.llm.store import drop, save

MIN_PAGES, SHARE, PROSE_SHARE = 5, 0.05, 0.5
BROADCAST_ROWS = 500_000

# Kinds of HTML elements, and names by which sites mark what isn't the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption caption".split())
BOILERPLATE = RAW | set("head nav header footer aside form button select option input dialog menu object embed applet canvas audio video datalist".split())
MARKED_INSIDE = set(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle ad-slot ad-container sponsored promo cookie cookies cookie-notice cookie-banner consent newsletter "
    "newsletter-signup subscribe comment comments comment-list commentlist comments-area comment-section comment-form comment-respond disqus_thread respond replies sidebar "
    "notice-cookie site-notice social-share share-buttons sharing-buttons related-posts related-articles".split()
)
MARKED_OUTSIDE = MARKED_INSIDE | set(
    "nav navbar navigation menu main-menu site-menu side-bar breadcrumb breadcrumbs pagination pager footer site-footer page-footer header site-header page-header masthead "
    "topbar toolbar sharing social banner popup modal overlay signup login skip-link".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
KEEP = set("html body main article".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul figure details".split()
)

# A quote counts only where a value begins, and what isn't closed ends with the page, so each tag is read once.
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_NODE = "struct<kind:int,hash:long>"
_HOST = re.compile(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)")


class Node:
    __slots__ = ("attributes", "hash", "parent", "parts", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent, self.parts, self.hash = tag, attributes, parent, [], 0

    def boilerplate(self, inside: bool) -> bool:
        """By its own tag, role or names; inside: in an article or main element."""
        if self.tag == "header" and self.parent is not None and self.parent.tag == "article":
            return False  # the article's own heading
        if self.tag in BOILERPLATE or self.attributes.get("role") in ROLES or "hidden" in self.attributes:
            return True
        if self.tag in KEEP and not (self.tag == "article" and self.parent is not None):
            return False
        marked = MARKED_INSIDE if inside else MARKED_OUTSIDE
        return any(x in marked for k in ("class", "id") for x in self.attributes.get(k, "").lower().split())

    def holds_main(self) -> bool:
        return self.tag in ("article", "main") or self.attributes.get("role") == "main"


class Open:
    """The elements that are open, and where those of each tag stand among them."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if not (node.tag in INLINE or node.tag in ("p", "li", "td", "th", "dt", "dd")):
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """Place of the innermost one with such a tag; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, k: int) -> None:
        """The element at a place and all inside it."""
        for node in reversed(self.nodes[k:]):
            self.at[node.tag].pop()
        del self.nodes[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def end(self, tag: str) -> None:
        k = self.last(tag)
        if k and (tag in ("body", "html", "main") or k >= self.last("article", "main", "body")):  # others belong to nothing in here
            self.close(k)

    def start(self, tag: str) -> None:
        """Close what a start tag ends: the innermost such element, unless a block stands between."""
        if tag in BLOCKS_END_P or tag in CLOSES:
            k = self.last(*CLOSES.get(tag, {"p"}))
            if k and k >= (self.blocks[-1] if self.blocks else 0):
                self.close(k)


def parse(html: str) -> list[Node]:
    """All elements in page order, the root first."""
    root = Node("", {}, None)
    nodes, inner, at = [root], Open(root), 0
    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            inner.nodes[-1].parts.append(html[at:])
            break
        if m.start() > at:
            inner.nodes[-1].parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            inner.end(tag)
            continue
        inner.start(tag)
        attributes = {a.lower(): markup.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        if m[3] and re.search(r"(?:^|\s)hidden(?:\s|/|$)", m[3]):
            attributes["hidden"] = ""
        node = Node(tag, attributes, inner.nodes[-1])
        node.parent.parts.append(node)
        nodes.append(node)
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            inner.push(node)
    for node in reversed(nodes):  # children come after their parents
        inside = "\0".join(x if isinstance(x, str) else f"\1{x.hash}" for x in node.parts)
        node.hash = xxhash.xxh3_64_intdigest(f"{node.tag}\0{node.attributes.get('class', '')}\0{inside}") - (1 << 63)
    return nodes


def main_nodes(nodes: list[Node]) -> tuple[list[Node], set[int]]:
    """The elements that hold the main text, and those that are boilerplate by themselves or stand in such."""
    gone: set[int] = set()
    inside: set[int] = set()
    for node in nodes[1:]:
        within = id(node.parent) in inside
        if within or node.holds_main():
            inside.add(id(node))
        if id(node.parent) in gone or node.boilerplate(within):
            gone.add(id(node))
    for find in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.attributes.get("role") == "main", lambda n: n.tag == "body"):
        outer, below = [], set()  # those that don't stand in another
        for n in nodes:
            found = find(n) and id(n) not in gone
            if found and id(n.parent) not in below:
                outer.append(n)
            if found or id(n.parent) in below:
                below.add(id(n))
        if outer:
            return outer, gone
    return nodes[:1], gone


def text_of(mains: list[Node], gone: set[int]) -> str:
    """Blocks of the main elements joined by one space, without the nodes that are gone."""
    raw: list[str] = []
    stack: list = list(reversed(mains))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            raw.append(markup.unescape(x))
        elif x is None:
            raw.append("\n")
        elif id(x) not in gone:
            if x.tag not in INLINE:  # a block begins and ends
                raw.append("\n")
                stack.append(None)
            stack.extend(reversed(x.parts))
    return " ".join("".join(raw).split())


#: Kinds of nodes that may be template.
CONTAINER, PARAGRAPH, INSIDE = range(3)


def deletable(nodes: list[Node], mains: list[Node]) -> list[tuple[int, Node]]:
    """What is counted, with its kind, which is all that a template may delete."""
    out = []
    holds: set[int] = set()  # what the main text stands in
    for main in mains:
        up = main
        while up is not None and id(up) not in holds:
            holds.add(id(up))
            up = up.parent
    inside: set[int] = {id(m) for m in mains if m.holds_main()}
    for node in nodes[1:]:
        within = id(node.parent) in inside
        if within:
            inside.add(id(node))
        if id(node) in holds or node.tag in INLINE or node.tag in VOID or node.tag in RAW or node.tag in KEEP or not node.parts:
            continue
        if node.tag not in PROSE:
            out.append((INSIDE if within else CONTAINER, node))
        elif not within and node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
            out.append((PARAGRAPH, node))
    return out


def hashes_by_kind(nodes: list[Node], mains: list[Node]) -> list[list[int]]:
    """Sorted hashes of the deletable nodes of each kind."""
    found: list[set[int]] = [set(), set(), set()]
    for kind, node in deletable(nodes, mains):
        found[kind].add(node.hash)
    return [sorted(x) for x in found]


def _passage(mains: list[Node]) -> int:
    """The smallest hash of a paragraph of the main text: most often equal for near copies, seldom for other pages."""
    least, stack = 1 << 62, list(mains)
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            least = min(least, x.hash) if x.tag in PROSE else least
            stack.extend(x.parts)
    return least


def host_of(url: str | None) -> str:
    found = _HOST.match((url or "").lower())
    return found[1] if found else ""


def _counted(pages: DataFrame) -> DataFrame:
    """(host, page, passage, k0, k1, k2) of each page; page: digest of its main text, k: hashes of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                nodes = parse(batch.column(1)[k].as_py() or "")
                mains, gone = main_nodes(nodes)
                page = xxhash.xxh3_64_intdigest(text_of(mains, gone)) - (1 << 63)
                rows.append((host_of(batch.column(0)[k].as_py()), page, _passage(mains), *hashes_by_kind(nodes, mains)))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), longs, longs, longs))],
                names=["host", "page", "passage", "k0", "k1", "k2"],
            )

    return pages.select("url", "html").mapInArrow(tidy(run), "host string, page long, passage long, k0 array<long>, k1 array<long>, k2 array<long>")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """(host, kind, hash) of the subtrees that recur on a host, a saved table; pages: (url, html)."""
    seen = save(_counted(pages), "subtrees")
    rows = [seen.select("host", F.col(page).alias("page"), F.explode(f"k{kind}").alias("hash"), F.lit(kind).alias("kind")) for kind, page in ((CONTAINER, "page"), (PARAGRAPH, "page"), (INSIDE, "passage"))]
    often = rows[0].union(rows[1]).union(rows[2]).distinct().groupBy("host", "kind", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    # copies and near copies of a page count once here too; two steps, as a host may have very many pages
    sizes = [seen.select("host", c).distinct().groupBy("host").agg(F.count("*").alias(c + "s")) for c in ("page", "passage")]
    sized = often.join(sizes[0], "host").join(sizes[1], "host")
    least = F.when(F.col("kind") == CONTAINER, share * F.col("pages")).when(F.col("kind") == PARAGRAPH, prose_share * F.col("pages")).otherwise(prose_share * F.col("passages"))
    found = save(sized.filter(F.col("n") >= least).select("host", "kind", "hash"), "templates")
    drop(seen)
    return found


def extract_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, prose_share: float = PROSE_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = bounded_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    templates = site_templates(pages, min_pages, share, prose_share)
    spark, known = pages.sparkSession, None
    if templates.count() <= BROADCAST_ROWS:
        by_host: dict[str, set[tuple[int, int]]] = {}
        for host, kind, hash_ in zip(*(c.to_pylist() for c in templates.toArrow().columns), strict=True):
            by_host.setdefault(host, set()).add((kind, hash_))
        known = spark.sparkContext.broadcast(by_host)
        drop(templates)
        read = pages.withColumn("gone", F.lit(None).cast(f"array<{_NODE}>"))
    else:  # too many for every task: each page gets its own
        key = pages.withColumn("digest", F.xxhash64("html"))
        own = key.mapInArrow(tidy(_own_hashes), f"page_id long, url string, digest long, host string, nodes array<{_NODE}>")
        own = own.select("page_id", "url", "digest", "host", F.inline("nodes"))
        gone = own.join(templates, ["host", "kind", "hash"]).groupBy("page_id", "url", "digest").agg(F.collect_set(F.struct("kind", "hash")).alias("gone"))
        same = [key[c].eqNullSafe(gone[c]) for c in ("page_id", "url", "digest")]
        read = key.join(gone, same[0] & same[1] & same[2], "left").select(key["page_id"], key["url"], "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for k in range(batch.num_rows):
                own = batch.column(3)[k].as_py()
                templates = {(x["kind"], x["hash"]) for x in own or ()} if known is None else known.value.get(host_of(batch.column(1)[k].as_py()), frozenset())
                nodes = parse(batch.column(2)[k].as_py() or "")
                mains, gone = main_nodes(nodes)
                if templates:
                    gone |= {id(node) for kind, node in deletable(nodes, mains) if (kind, node.hash) in templates}
                texts.append(text_of(mains, gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return read.select("page_id", "url", "html", "gone").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def _own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for html in batch.column(2).to_pylist():
            nodes = parse(html or "")
            by_kind = hashes_by_kind(nodes, main_nodes(nodes)[0])
            found.append([{"kind": kind, "hash": h} for kind in range(3) for h in by_kind[kind]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string()), pa.array(found, pa.list_(pa.struct([("kind", pa.int32()), ("hash", pa.int64())])))],
            names=["page_id", "url", "digest", "host", "nodes"],
        )
