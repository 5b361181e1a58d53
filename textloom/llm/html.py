"""Main text of web pages by a site style tree.

The DOM trees of a host's pages are merged: a style node is the chain of tags and class names from the body down
(siblings of one name are told apart by their place), and keeps the sequences of children and the texts seen
there on distinct pages.  Its importance joins two entropies: that of its presentation (how much its sequence of
children varies from page to page) and that of its content (the self-information of its blocks among the host's
pages, weighed by their words outside links, relative to its most informative sibling).  Content is composed up
the branch, from blocks to their ancestors.  A host's evidence is shrunk towards that of all hosts, and that
towards a prior which the tag and class words give; a branch of low importance is removed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, table

# What tags mean.
SILENT = {"script", "style", "noscript", "template", "title", "iframe", "object", "canvas"}
CONTROL = {"button", "select", "textarea"}
HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "head", "html"}
FRAME = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
MAIN = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "dfn", "del", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr", "mi", "mn", "mo", "mrow", "mfrac", "msup", "msub", "msqrt", "mtext", "text", "tspan", "path", "g", "circle", "rect", "line"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that a site's frame is made of; only these, and what lies directly in the body, are judged.
STRUCTURE = {"div", "section", "nav", "aside", "header", "footer", "form", "menu", "dialog", "article", "main", "center", "table", "tbody", "tr", "td", "ul", "ol", "dl", "fieldset", "details", "address"}
#: End tags that HTML lets be left out: a start tag of the key closes an open one of the values.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
P_CLOSERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Whole class, id or role words of what isn't the article's; inside an article only those of the second list are.
FRAME_WORDS = re.compile(r"^(?:menu|main-menu|nav|navbar|navigation|site-(?:nav|header|footer)|footer|header|masthead|breadcrumbs?|sidebar|side-bar|banner|notices?|login|search|toolbar|pagination|pager|widgets?|copyright|contentinfo|complementary)$", re.I)
ALIEN_WORDS = re.compile(r"^(?:ads?|ad-(?:slot|banner|unit|box|container)|advert\w*|sponsor(?:ed)?|promo|cookies?|cookie-(?:notice|banner|consent|bar)|consent|consent-banner|gdpr|popup|modal|newsletter|newsletter-signup|subscribe|signup|share|share-(?:buttons|bar)|sharing|social|social-(?:links|share)|comments?|comment-(?:list|section|area)|replies|disqus|disqus_thread|related|related-(?:posts|articles|links)|recommended)$", re.I)
#: Importance at which a branch stays, weight of the presentation, and the pages that a prior counts for.
KEEP, PRESENTATION, PRIOR_PAGES = 0.3, 0.4, 4.0
SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Blocks of a page in order, and its judged nodes.

    A block is (path, text, words outside links).  A judged node is (path, parent's path, sequence of children,
    prior): children of one name in a row count once unless they are text elements.
    """

    def __init__(self, words: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.words = words
        self.open: list[tuple[str, str, bool]] = []  # tag, path, whether judged
        self.out: list[tuple[str, str, int]] = []
        self.nodes: list[list] = []
        self.text: list[str] = []
        self.linked = 0
        self.links = self.silent = 0
        self.head, self.control = False, ""
        self.children: list[list[str]] = [[]]
        self.named: list[dict[str, int]] = [{}]
        self.main = False

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.out.append((self.open[-1][1] if self.open else "", text, max(0, len(text.split()) - self.linked)))
        self.text, self.linked = [], 0

    def _pop(self) -> None:
        self._flush()
        _, path, judged = self.open.pop()
        children = self.children.pop()
        self.named.pop()
        if judged:
            node = next(n for n in reversed(self.nodes) if n[0] == path and n[2] is None)
            node[2] = ",".join(c for i, c in enumerate(children) if not i or c != children[i - 1] or c not in STRUCTURE and c != "li")

    def _prior(self, tag: str, words: list[str], inside: bool) -> float:
        if not self.words:
            return 0.5
        alien = any(ALIEN_WORDS.match(w) for w in words)
        if inside:
            return 0.0 if alien or tag in FRAME - {"header"} else 1.0
        if tag in MAIN:
            return 1.0
        return 0.0 if alien or tag in FRAME or any(FRAME_WORDS.match(w) for w in words) else 0.5

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            self.silent += tag in SILENT and tag not in VOID
            return
        if tag == "head":
            self.head = True
            return
        if self.head and tag not in HEAD:
            self.head = False
        if self.control and tag in P_CLOSERS:
            self.control = ""  # left open
        if tag in SILENT:
            self.silent += 1
            return
        if tag in ("html", "body") or self.control:
            return
        if tag in CONTROL:
            self.control = tag
            return
        if tag in INLINE:
            self.links += tag == "a"
            if tag == "br":
                self.text.append(" ")
            return
        self._flush()
        if tag in VOID:
            return
        closes = CLOSES.get(tag, {"p"} if tag in P_CLOSERS else set())
        while self.open and self.open[-1][0] in closes:
            self._pop()
        words = [w for k, v in attrs if k in ("class", "id", "role") for w in (v or "").split()]
        classes = [w for k, v in attrs if k == "class" for w in (v or "").split()]
        inside = any(t in MAIN for t, _, _ in self.open)
        self.main |= tag in MAIN
        name = tag + "".join("." + w for w in sorted(classes)[:3])
        nth = self.named[-1][name] = self.named[-1].get(name, 0) + 1
        if tag in STRUCTURE and tag not in ("tr", "td") and nth > 1:
            name += f"[{min(nth, 9)}]"
        path = f"{self.open[-1][1] if self.open else ''}/{name}"
        prior = self._prior(tag, words, inside)
        # inside an article nothing but what its words call alien is judged
        judged = (tag in STRUCTURE or not self.open) and (not inside or prior == 0.0)
        if judged:
            self.nodes.append([path, self.open[-1][1] if self.open else "", None, prior, inside])
        self.children[-1].append(tag)
        self.open.append((tag, path, judged))
        self.children.append([])
        self.named.append({})

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.silent -= tag in SILENT
        elif tag == "head":
            self.head = False
        elif self.control:
            if tag == self.control or tag not in INLINE and any(t == tag for t, _, _ in self.open):
                was, self.control = self.control, ""
                if tag != was:
                    self.handle_endtag(tag)
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in INLINE and any(t == tag for t, _, _ in self.open):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag not in INLINE:
            self._flush()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in INLINE and tag != "a":
            self.handle_starttag(tag, attrs)
        elif tag not in SILENT:
            self.handle_starttag(tag, attrs)
            if tag not in ("html", "body"):
                self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.silent or self.control or (self.head and not data.strip()):
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data.split())

    def finish(self) -> None:
        self.close()
        while self.open:
            self._pop()
        self._flush()


def parse(html: str | None, words: bool = True) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, str, float]]]:
    """Blocks (path, text, words outside links) and judged nodes (path, parent, children, prior); none of a null or empty page.

    On a page with an article or main element, nodes outside it that say nothing of themselves have a low prior.
    """
    parser = _Blocks(words)
    parser.feed(html or "")
    parser.finish()
    chains = [n[0] for n in parser.nodes]
    wraps = {p for p in chains if words and parser.main and any(n[3] == 1.0 and n[0].startswith(p + "/") for n in parser.nodes)}
    low = lambda n: 0.25 if words and parser.main and n[3] == 0.5 and not n[4] and n[0] not in wraps else n[3]
    return parser.out, [(n[0], n[1], n[2] or "", low(n)) for n in parser.nodes]


BLOCK_SCHEMA = "page_id long, url string, host string, page long, texts array<string>, paths array<string>, words array<int>, nodes array<string>, parents array<string>, shapes array<string>, priors array<double>"


def parsed(pages: DataFrame, words: bool = True) -> DataFrame:
    """Blocks and nodes of each page; ``page`` is a hash of its html, the same for copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        kinds = [pa.list_(k) for k in (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64())]
        for batch in batches:
            rows = []
            for html in batch.column(4):
                blocks, nodes = parse(html.as_py(), words)
                path, text, n = zip(*blocks) if blocks else ((),) * 3
                node, parent, shape, prior = zip(*nodes) if nodes else ((),) * 4
                rows.append((text, path, n, node, parent, shape, prior))
            cols = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array(list(map(list, c)), k) for c, k in zip(cols, kinds))], names=names)

    host = F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.xxhash64("html").alias("page"), "html").mapInArrow(run, BLOCK_SCHEMA)


def _bits(c: Column) -> Column:
    return F.log2(c.cast("double"))


def _evidence(held: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(by.., path, parent, prior, pages, seen): on how many distinct pages a node was, and its observed importance, 0 to 1.

    Counts are of distinct pages, so copies of a page are one.  Values are counted first and summed then, so a host or
    a node with most of the rows is added up in parts.
    """
    nodes = held.select(*by, "page", F.explode(F.arrays_zip("nodes", "parents", "shapes", "priors")).alias("x")).select(*by, "page", F.col("x.nodes").alias("path"), F.col("x.parents").alias("parent"), F.xxhash64("x.shapes").alias("shape"), F.col("x.priors").alias("prior"))
    once = nodes.groupBy(*by, "path", "parent", "shape", "page").agg(F.min("prior").alias("prior"))
    shapes = once.groupBy(*by, "path", "parent", "shape").agg(F.count("*").alias("c"), F.sum("prior").alias("prior"))
    looks = shapes.groupBy(*by, "path", "parent").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * _bits(F.col("c"))).alias("s"), F.sum("prior").alias("prior"))
    entropy = F.greatest(F.lit(0.0), _bits(F.col("pages")) - F.col("s") / F.col("pages"))
    looks = looks.select(*by, "path", "parent", "pages", (F.col("prior") / F.col("pages")).alias("prior"), (entropy / (1 + entropy)).alias("look"))
    # self-information of each block's text among the pages, by its words outside links
    total = held.groupBy(*by).agg(F.count_distinct("page").alias("all")) if by else held.agg(F.count_distinct("page").alias("all"))
    blocks = held.select(*by, "page", F.explode(F.arrays_zip("paths", "texts", "words")).alias("x")).select(*by, "page", F.col("x.paths").alias("path"), F.xxhash64("x.texts").alias("text"), F.col("x.words").alias("words"))
    texts = blocks.groupBy(*by, "path", "text", "page").agg(F.max("words").alias("words")).groupBy(*by, "path", "text").agg(F.count("*").alias("c"), F.max("words").alias("words"))
    sums = texts.groupBy(*by, "path").agg(F.sum(F.col("words") * F.col("c")).alias("w"), F.sum(F.col("words") * F.col("c") * _bits(F.col("c"))).alias("known"))
    sums = sums.join(total, by) if by else sums.crossJoin(total)  # one row
    told = sums.select(*by, "path", (F.col("w") * _bits(F.col("all") + 1) - F.col("known")).alias("told"))
    # composed up the branch: a node tells what the blocks below it tell
    parts = F.split("path", "/")
    chains = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = told.filter("path <> ''").select(*by, F.explode(chains).alias("path"), "told").groupBy(*by, "path").agg(F.sum("told").alias("told"))
    joined = scratch.keep(looks.join(above, [*by, "path"], "left").withColumn("told", F.coalesce("told", F.lit(0.0)) / F.col("pages")), name)
    most = joined.groupBy(*by, "parent").agg(F.max("told").alias("most"))
    share = F.when(F.col("most") > 0, F.col("told") / F.col("most")).otherwise(0.0)
    seen = PRESENTATION * F.col("look") + (1 - PRESENTATION) * share
    return joined.join(most, [*by, "parent"]).select(*by, "path", "parent", "prior", "pages", seen.alias("seen"))


def style_tree(held: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, path, pages, importance) of every judged node.

    Importance is the mean of what the host's pages show and of what all hosts' do, the latter counted as
    PRIOR_PAGES pages; that in turn is shrunk towards the prior of the node's tag and words.
    """
    own = _evidence(held, ["host"], scratch, "own")
    every = _evidence(held, [], scratch, "every").select("path", ((F.col("pages") * F.col("seen") + PRIOR_PAGES * F.col("prior")) / (F.col("pages") + PRIOR_PAGES)).alias("common"))
    joined = own.join(every, "path")
    # a prior of 0 or 1 is what the page itself says of a node: it bounds what other hosts' nodes of the same name suggest
    common = F.when(F.col("prior") <= 0.0, F.least("common", F.lit(KEEP / 2))).when(F.col("prior") >= 1.0, F.greatest("common", F.lit(1.0))).otherwise(F.col("common"))
    return joined.select("host", "path", "pages", "prior", ((F.col("pages") * F.col("seen") + PRIOR_PAGES * common) / (F.col("pages") + PRIOR_PAGES)).alias("importance"))


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, low): the chains of the branches to remove, the topmost of each."""
    low = tree.filter(F.col("importance") < KEEP).groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("low"))  # a host's templates
    top = F.filter("low", lambda p: ~F.exists("low", lambda q: p.startswith(F.concat(q, F.lit("/")))))
    return low.select("host", top.alias("low"))


def chosen(texts: list[str], paths: list[str], low: list[str]) -> str:
    """The blocks outside low branches, one a line."""
    gone = set(low)

    def stays(path: str) -> bool:
        at = path.find("/", 1)
        while at > 0:
            if path[:at] in gone:
                return False
            at = path.find("/", at + 1)
        return path not in gone

    known: dict[str, bool] = {}
    for p in paths:
        if p not in known:
            known[p] = stays(p)
    return "\n".join(t for t, p in zip(texts, paths) if known[p])


def extract(pages: DataFrame, spark: SparkSession, words: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; an empty text for a null or empty page, and for one without main text.

    Pages with a null url form one host; copies of a page are one page to the tree, and repeated rows each give a
    row.  Without ``words`` tags and class words say nothing and the tree alone decides.  Pages of any length are
    parsed whole; an empty table gives no rows.
    """
    scratch = Scratch(spark, "html")
    held = scratch.keep(parsed(pages, words), "blocks")
    low = scratch.keep(low_branches(style_tree(held, scratch)), "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 5)))
            texts = [chosen(t, p, low or ()) for t, p, low in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = held.join(low, "host", "left").select("page_id", "url", "texts", "paths", "low")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"), spark)
