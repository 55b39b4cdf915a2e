"""Operator 2: main text of web pages by site style trees.

Pages of a host are merged by element path (tag and class names from the root). For each element node of
the merged tree the entropies say how much it matters: a leaf whose words are spread evenly over
the host's pages is boilerplate, one whose words differ from page to page is content; an inner node
matters by the diversity of its children's presentation and by its children. Branches of low composite
importance are removed from each page. Identical pages of a host count once; a node that few pages have is no evidence and matters fully.

An article element is content by its author's word: the tree weighs what is around it, and inside it only firm furniture goes
(navigation, asides, footers, forms, adverts and comment threads), so headings and paragraphs that articles of a host have in
common stay. What a name there likens to furniture (a newsletter, a share bar, a related section) is weighed by the tree and goes
if the host repeats it: a name alone or a repetition alone takes nothing. On pages without an article the tree decides. What entropy cannot tell there is a prior: scripts, forms, hidden elements and reader
comments are no text, and elements marked as navigation, adverts, footers and the like have importance 0 even if their words differ from page to
page. A mark never hides a page's only article, nor, without an article, the greater part of the page.

Each page is parsed twice: once for what it adds to its site's tree, once against the tree, with an article or without.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from folioscope.llm.common import FEW_ROWS, materialize, spread_if_few, table

#: Weight of a node's own importance falls with GAMMA^(kinds of children); branches below LEAST go. Nodes at or above it count fully.
GAMMA, LEAST = 0.9, 0.3
#: Pages of a host that must have a node or block before its entropy counts.
EVIDENCE = 4
#: Statistics that a task gathers before it sends them on.
HELD = 300_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold an article's text.
SILENT = frozenset("head script style noscript template textarea title iframe form button select option datalist dialog svg canvas object embed video audio map".split())
#: Elements that mark page furniture.
LANDMARKS = frozenset("nav footer aside menu figure-ad".split())
#: Class, id and role words that mark page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert "
    "sidebar sidebars rail nav navbar navigation topnav menu menus submenu breadcrumb breadcrumbs footer foot masthead topbar toolbar "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager skip search complementary contentinfo form widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Class and id words that mark furniture inside an article.
FIRM_WORDS = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored".split())
HEADERS = frozenset("header head masthead".split())
#: Words that say nothing of their own beside a word that marks, and those that begin the name of a state.
BESIDE = frozenset("main site page top bottom left right box container wrapper wrap block section area list item items bar button buttons link links post posts article articles inner outer primary secondary global mobile desktop fixed sticky content panel group row col column slot unit zone thread".split())
STATES = frozenset("has with without no is not".split())
BODIES = frozenset(("html", "body"))
#: A start tag in the first column ends an open element of the second.
ENDS = {
    **{t: frozenset(("p",)) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split()},
    "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",)), "body": frozenset(("head",)),
}
LISTS = frozenset("ul ol dl table select article section div main body html nav aside".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: How firmly an element is marked: by the name of its element or as comments, by a name of such words only, by a name with others beside.
FIRM, PLAIN, LOOSE = 3, 2, 1


class Node:
    """Element: its tag, style (tag and classes), path hash, whether it never holds text, mark, whether it is an article, and its children in order (nodes and texts).

    inside says that it is in an article, named that it is and a name of it is one of furniture, which is no mark there; above is the firmest mark of the element and what is around it; dead says that something around it never holds text.
    """

    __slots__ = ("tag", "style", "path", "silent", "mark", "article", "children", "parent", "above", "dead", "inside", "named")

    def __init__(self, tag: str, style: str, path: int, silent: bool, mark: int, article: bool, parent: Node | None, inside: bool = False, named: bool = False):
        self.inside, self.named = inside, named
        self.tag, self.style, self.path, self.silent, self.mark, self.article, self.parent = tag, style, path, silent, mark, article, parent
        self.children: list[Node | str] = []
        self.above = mark if parent is None or parent.above < mark else parent.above
        self.dead = parent is not None and (parent.dead or parent.silent)


def mark_of(name: str, in_article: bool) -> int:
    """How firmly a class name or id marks furniture or comments; 0 for not at all."""
    words = [w for w in WORDS.findall(name) if not w.isdigit()]
    marks = [w for w in words if w in FIRM_WORDS] if in_article else [w for w in words if w in FURNITURE or w in COMMENTS or w in HEADERS or w == "discussion"]
    if not marks or words[0] in STATES or any(w not in BESIDE for w in words if w not in marks):
        return 0
    return LOOSE if len(marks) < len(words) else FIRM if in_article or COMMENTS.intersection(marks) else PLAIN


def _node(tag: str, attributes: str, parent: Node, in_article: bool) -> Node:
    style, silent, article, named, mark = tag, tag in SILENT, tag == "article", False, FIRM if tag in LANDMARKS or (tag == "header" and not in_article) else 0
    if attributes and not attributes.isspace():
        given = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
        names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
        role = given.get("role", "").lower()
        style = ".".join([tag, *sorted({w for w in WORDS.findall(" ".join(names)) if not w.isdigit()})])
        if tag not in BODIES:
            mark = max([mark, *(mark_of(n, in_article) for n in names)])
            named = in_article and any(mark_of(n, False) for n in names)
            if role in FURNITURE:
                mark = FIRM
            silent = silent or "hidden" in given or bool(HIDDEN.search(given.get("style", "")))
            article = article or role == "article"
    return Node(tag, style, xxhash.xxh64_intdigest(f"{parent.path}>{style}") >> 1, silent, mark, article, parent, in_article, named)


def parse(page: str | None) -> Node:
    """Forgiving parse: unknown end tags are ignored, open elements end where their parent ends. Marks are settled."""
    root = Node("", "", 0, False, 0, False, None)
    stack, at, page = [root], 0, page or ""
    depth_article, count, is_open = 0, {}, set()
    marked: list[Node] = []
    found: list[Node] = []

    def close(i: int) -> int:
        articles = 0
        for n in stack[i:]:
            articles += n.article
            count[n.tag] -= 1
            if not count[n.tag]:
                is_open.discard(n.tag)
        del stack[i:]
        return articles

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if page[m.start() + 1] == "/":
            if tag in is_open:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                depth_article -= close(i)
            continue
        ends = ENDS.get(tag)
        if ends and not ends.isdisjoint(is_open):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    depth_article -= close(i)
                elif stack[i].tag not in INLINE:
                    break
        node = _node(tag, m[2], stack[-1], depth_article > 0)
        stack[-1].children.append(node)
        if node.mark and not node.dead:
            marked.append(node)
        if node.article and not (depth_article or node.dead or node.silent):
            found.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.silent = True
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[2].rstrip().endswith("/"):
            stack.append(node)
            count[tag] = count.get(tag, 0) + 1
            is_open.add(tag)
            depth_article += node.article
    if marked:
        _settle(root, marked, found)
    return root


def _settle(root: Node, marked: list[Node], found: list[Node]) -> None:
    """Marked elements become silent, unless their mark would hide the page's only articles or, without articles, most of its words."""
    least = min((n.above for n in found), default=FIRM)
    if 0 < least < FIRM:
        for n in found:
            around: Node | None = n if n.above == least else None
            while around is not None:
                around.mark, around = 0, around.parent
    elif least == FIRM and any(n.mark < FIRM for n in marked):
        order, todo = [], [root]
        while todo:
            n = todo.pop()
            if not n.silent:
                order.append(n)
                todo += [c for c in n.children if isinstance(c, Node)]
        words = {id(n): sum(len(c.split()) for c in n.children if isinstance(c, str)) for n in order}
        for n in reversed(order):
            if n.parent is not None:
                words[id(n.parent)] += words[id(n)]
        for n in marked:
            if n.mark < FIRM and 2 * words.get(id(n), 0) > words[id(root)]:
                n.mark = 0
    for n in marked:
        n.silent = n.silent or n.mark > 0


def blocks(node: Node, dropped: frozenset[int] = frozenset(), own: bool = False) -> list[str]:
    """Text blocks of a branch without furniture and dropped paths; in an article only what is named like furniture is dropped. own: without the block elements in it."""
    out: list[list[str]] = [[]]
    todo: list[Node | str | None] = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if c is None:
            out.append([])
        elif isinstance(c, str):
            out[-1].append(c)
        elif not c.silent and (c.path not in dropped or (c.inside and not c.named)):
            if c.tag in INLINE:
                todo += reversed(c.children)
            elif own:
                out.append([])
            else:
                out.append([])
                todo.append(None)
                todo += reversed(c.children)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in out)
    return [t for t in texts if t]


def articles(root: Node) -> list[Node]:
    """Outermost article elements outside furniture, in document order."""
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.article and not n.silent:
            found.append(n)
        elif not n.silent:
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return found


def region(root: Node) -> list[Node]:
    """The branches that the text is taken from: all articles, else the main element, else all."""
    found = articles(root)
    if found:
        return found
    todo = [root]
    while todo:
        n = todo.pop(0)
        if n.tag == "main":
            return [n]
        todo += [c for c in n.children if isinstance(c, Node)]
    return [root]


def region_blocks(root: Node, dropped: frozenset[int] = frozenset()) -> list[str]:
    return [b for top in region(root) for b in blocks(top, dropped)]


def _below(n: Node) -> list[Node]:
    """What the style tree weighs next under n: its block elements, those in inline elements too; under an article what is named like furniture, however deep."""
    found: list[Node] = []
    todo = n.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, str) or c.silent:
            continue
        if not c.named if n.article else c.tag in INLINE and not c.article:
            todo += reversed(c.children)
        else:
            found.append(c)
    return found


def style_nodes(top: Node) -> dict[int, tuple[tuple[str, ...], Counter]]:
    """path -> (distinct child styles in order, words of its own text) of what the tree weighs; equal paths of a page are merged."""
    found: dict[int, tuple[dict[str, None], Counter]] = {}
    todo = [top]
    while todo:
        n = todo.pop()
        styles, words = found.setdefault(n.path, ({}, Counter()))
        if not n.article:
            for c in n.children:
                if isinstance(c, str):
                    words.update(html.unescape(c).lower().split())
                elif not c.silent and c.tag in INLINE and not c.article:
                    words.update(w for b in blocks(c, own=True) for w in b.lower().split())
        for c in _below(n):
            styles[c.style] = None
            todo.append(c)
    return {p: (tuple(s), w) for p, (s, w) in found.items()}


FEATURE = "host string, path long, feature long, word boolean, n long, nlogn double"
NODES = "array<struct<path: long, own: double, kinds: long>>"


def features(root: Node) -> Iterator[tuple[int, int, bool, int]]:
    """(path, feature, whether it is a word, how often) of a page's nodes: presentations and words."""
    for path, (styles, words) in style_nodes(root).items():
        yield path, xxhash.xxh64_intdigest("|".join(styles)) >> 1, False, 1
        for w, n in words.items():
            yield path, xxhash.xxh64_intdigest(w) >> 1, True, n


def _learnt(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(host, html) -> sums of the pages' features, by task."""
    held: dict[tuple, list[float]] = {}

    def sums() -> pa.RecordBatch:
        host, path, feature, word = zip(*held) if held else ((), (), (), ())
        n, nlogn = zip(*held.values()) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((host, path, feature, word, n, nlogn), schema)], schema=schema)

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            for path, feature, word, n in features(parse(page.as_py())):
                own = held.setdefault((host, path, feature, word), [0, 0.0])
                own[0] += n
                own[1] += n * log(n)
            if len(held) > HELD:
                yield sums()
                held.clear()
    yield sums()


def low_nodes(sums: DataFrame) -> DataFrame:
    """Features (host, path, feature, word, n, nlogn), summed or in parts, -> (host, nodes): per host the merged nodes of low importance with their kinds of presentation."""
    sums = sums.groupBy("host", "path", "feature", "word").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn"))
    # a word's entropy over the pages is ln(total) - sum(c ln c) / total, a presentation's share is n / pages
    nodes = sums.groupBy("host", "path").agg(
        F.sum(F.when(~F.col("word"), F.col("n"))).alias("pages"),
        F.count(F.when(~F.col("word"), 1)).alias("kinds"),
        F.sum(F.when(~F.col("word"), F.col("n") * F.log("n"))).alias("shown"),
        F.count(F.when(F.col("word"), 1)).alias("words"),
        F.sum(F.when(F.col("word"), F.log("n") - F.col("nlogn") / F.col("n"))).alias("spread"),
    )
    scale = F.log("pages")
    leaf = F.when(F.col("words") > 0, 1 - F.col("spread") / F.col("words") / scale)
    inner = (scale - F.col("shown") / F.col("pages")) / scale
    weighed = nodes.where(f"pages >= {EVIDENCE}").select("host", "path", F.coalesce(leaf, inner).alias("own"), "kinds")
    return weighed.where(f"own < {LEAST}").groupBy("host").agg(F.collect_list(F.struct("path", "own", "kinds")).alias("nodes"))


def low_paths(top: Node, low: dict[int, tuple[float, int]]) -> frozenset[int]:
    """Paths of a page's branches whose composite importance is below LEAST. A node that is not known to be low matters fully."""
    gone: set[int] = set()
    done: dict[int, float] = {}
    todo: list[tuple[Node, bool]] = [(top, False)]
    while todo:
        n, ready = todo.pop()
        below = _below(n)
        if not ready:
            todo.append((n, True))
            todo += [(c, False) for c in below]
            continue
        own, kinds = low.get(n.path, (1.0, 1))
        if below:
            keep = GAMMA**kinds
            own = (1 - keep) * own + keep * sum(done[id(c)] for c in below) / len(below)
        done[id(n)] = 1.0 if n.article else own
        # in an article only what is named like furniture may go, what is in it stays or goes with it
        if own < LEAST and not n.article and n is not top and (n.named or not n.inside):
            gone.add(n.path)
    return frozenset(gone)


def main_text(page: str | None, low: dict[int, tuple[float, int]] | None = None) -> str:
    """Text of one page, given its site's nodes of low importance (path -> importance, kinds of presentation)."""
    root = parse(page)
    # a page all of whose branches are common to its host keeps what is no furniture
    return " ".join(region_blocks(root, low_paths(root, low or {})) or region_blocks(root))


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text of each page as a new column instead of html_col.

    A null or empty page has an empty text. Pages without a host in their address form one site. Every row
    stays, repeated ones too; no text is cut. The other columns stay, whatever their names, but may not be named like the new one.
    An empty table gives an empty result.
    """
    if name in pages.columns and name != html_col:
        raise ValueError(f"column {name} exists")
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[^/]*//(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    names = [c for c in pages.columns if c != html_col]
    # the page's columns are one struct, so that no name can clash
    given = pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    keyed = given.select("host", "html", F.xxhash64("host", "html").alias("same"))
    twins = materialize(keyed.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same", F.lit(True).alias("twin")))
    marked = keyed.join(spread_if_few(twins), "same", "left")
    # identical pages count once: one of each is weighed, whichever it is
    once = marked.where("twin").groupBy("same").agg(F.first(F.struct("host", "html")).alias("p")).select("p.host", "p.html")
    kind = to_arrow_schema(StructType.fromDDL(FEATURE))
    sums = marked.where("twin is null").select("host", "html").unionAll(once).mapInArrow(lambda it: _learnt(it, kind), FEATURE)
    # each page meets its site's tree; pages stay where they are while all sites' low nodes together are counted to be few
    nodes = materialize(low_nodes(sums))
    few = (nodes.agg(F.sum(F.size("nodes") + 1)).first()[0] or 0) <= FEW_ROWS
    joined = given.join(F.broadcast(nodes) if few else nodes, "host", "left").select("row", "html", "host", "nodes")
    schema = StructType([*pages.select(*(f"`{c}`" for c in names)).schema, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, site, nodes in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                if site not in cached:
                    if len(cached) > 64:
                        cached.clear()
                    cached[site] = {n["path"]: (n["own"], n["kinds"]) for n in nodes.as_py() or []}
                texts.append(main_text(page.as_py(), cached[site]))
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(texts, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)


def op2_style_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_style_tree_extraction": op2_style_tree_extraction}
ORACLE: dict[str, str] = {}
