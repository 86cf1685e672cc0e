"""Main text of web pages by site style trees (op6).

Pages of one host are merged into a style tree: a node is a path of block
elements with their classes. For each node, over the pages that have it, the
diversity of its presentation (the runs of its child elements) and of its
content (its texts) is measured by entropy to the base of the number of pages:
1 where every page differs, 0 where all agree. A branch's importance is
GAMMA x the mean content importance below it + (1 - GAMMA) x its own
presentation importance; branches under LEAST, on MIN_PAGES pages or more, are
removed from each page of the host, inside the article (or main) as well. The
article element itself and what holds it are never removed by entropy, and
where a page's article consists of low branches alone it is kept as it is,
whatever its host repeats.

Where markup itself says that a branch is no main text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments), its tag, class,
id or role decides: such a branch has importance 0 on any host, also on hosts
of one page. Text inside an article element is the main text if there is one;
else that of main; else what is left of the page.

Statistics cover every page: rows of (host, node, content) are added up before
the shuffle, so a host with most pages is no hot key. The low nodes go to the
pages by broadcast if there are at most BROADCAST_NODES, else by a join on
host and salt.

Defined results: null and empty html give an empty text; a null or odd url
belongs to no host and takes no part in statistics; repeated rows keep their
rows; unclosed and misplaced tags follow the nearest open element; a "<"
that opens no tag is text; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import slices
from tessera.session import cut, ship

GAMMA, LEAST, MIN_PAGES, BROADCAST_NODES, SALTS = 0.9, 0.3, 5, 200_000, 64
_TAG = re.compile(r"""<(?:!--(?P<comment>)|(?P<other>[!?][^>]*)>|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*')*)>)""")
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|$)")
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED_TAGS = frozenset("nav footer aside form head menu dialog select button svg canvas object audio video datalist map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark a branch as no main text.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond footer masthead topbar toolbar pagination pager search skip".split()
)
_NOT_OWN = frozenset("has no with without".split())
_CLOSES_P = BLOCKS - {"option", "optgroup", "body", "html", "head", "legend", "caption"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_IDS: dict[tuple[int, str], int] = {}


def _child(parent: int, style: str) -> int:
    """The node of a style below a parent node."""
    found = _IDS.get((parent, style))
    if found is None:
        import xxhash

        if len(_IDS) > 200_000:
            _IDS.clear()
        found = _IDS[parent, style] = xxhash.xxh3_64_intdigest(f"{parent}/{style}") - (1 << 63)
    return found


def _marks(name: str, rest: str) -> tuple[str, bool]:
    """An element's style (tag and classes) and whether its markup drops it."""
    if not rest.strip("/ \t\n\r\f"):
        return name, name in DROPPED_TAGS
    style, dropped = name, name in DROPPED_TAGS
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            words = _WORD.findall(value)
            if key == "class" and words:
                style += "." + ".".join(words)
            if name not in ("article", "main", "body", "html"):
                dropped |= any(w in DROPPED_WORDS and not (k and words[k - 1] in _NOT_OWN) for k, w in enumerate(words))
        elif key == "role":
            dropped |= value in DROPPED_ROLES
        elif key == "hidden":
            dropped = True
        elif key == "aria-hidden":
            dropped |= value == "true"
        else:
            dropped |= "display:none" in value.replace(" ", "")
    return style, dropped


class Page:
    """Blocks of a page: (text, nodes above it, dropped by markup, region, nodes
    down to the region's element), and the presentation of its elements: node -> runs of child elements."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, tuple[int, ...], bool, int, int]] = []
        self.shapes: list[tuple[int, tuple[int, ...], str]] = []
        # open elements: tag, nodes, dropped, region (2 article, 1 main), nodes
        # down to the element that opened the region, child runs
        self.open: list[tuple[str, tuple[int, ...], bool, int, int, list[str]]] = [("", (0,), False, 0, 0, [])]
        self.text: list[str] = []
        self._read(source)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            if text:
                _, nodes, dropped, region, depth, _ = self.open[-1]
                self.blocks.append((text, nodes, dropped, region, depth))

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            _, nodes, *_, runs = self.open.pop()
            if runs:
                self.shapes.append((nodes[-1], nodes, ">".join(runs)))

    def _start(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self._flush()
        if name in _CLOSES_P:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    self._close(k)
                    break
                if self.open[k][0] in BLOCKS:
                    break
        if name in _SAME:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in _SAME[name]:
                    self._close(k)
                    break
                if self.open[k][0] in _SCOPE[name]:
                    break
        if name in ("article", "main", "body"):  # a menu or head left open doesn't hold the article
            for k, entry in enumerate(self.open):
                if entry[0] in ("nav", "head"):
                    self._close(k)
                    break
        if name in VOID:
            if name in ("br", "hr"):
                self.text.append(" ")
            return
        _, nodes, dropped, region, depth, runs = self.open[-1]
        style, drops = _marks(name, rest)
        if name == "header" and not region:
            drops = True
        if name in BLOCKS:
            if not runs or runs[-1] != style:
                runs.append(style)
            nodes = (*nodes, _child(nodes[-1], style))
            inner = 2 if name == "article" else max(region, 1) if name == "main" else region
            if inner > region:
                region, depth = inner, len(nodes)
        self.open.append((name, nodes, dropped or drops, region, depth, []))

    def _end(self, name: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == name:
                if name in BLOCKS:
                    self._flush()
                self._close(k)
                return
            if name not in BLOCKS and self.open[k][0] in BLOCKS:
                return
        if name == "p":
            self._flush()

    def _add(self, text: str) -> None:
        if not text.strip():
            if self.text:
                self.text.append(" ")
            return
        if self.open[-1][2]:  # inside a dropped branch nothing is kept, but what was before it stays one block
            inline = self.open[-1][0] not in BLOCKS
            if not inline or self.text:
                if not inline:
                    self._flush()
                    _, nodes, _, region, depth, _ = self.open[-1]
                    self.blocks.append((" ".join(entities.unescape(text).split()), nodes, True, region, depth))
            return
        self.text.append(text)

    def _read(self, s: str) -> None:
        at, size = 0, len(s)
        while at < size:
            lt = s.find("<", at)
            if lt < 0:
                self._add(s[at:])
                break
            if lt > at:
                self._add(s[at:lt])
            m = _TAG.match(s, lt) or _LOOSE.match(s, lt)
            if m is None:
                if s.startswith(("<!", "<?"), lt):  # a declaration without end
                    break
                self._add("<")
                at = lt + 1
                continue
            at = m.end()
            if m.re is _TAG and m["comment"] is not None:
                close = s.find("-->", at)
                at = size if close < 0 else close + 3
                continue
            if m.re is _TAG and m["other"] is not None:
                continue
            name = m["name"].lower()
            if m["end"]:
                self._end(name)
            elif name in RAW:
                if name not in ("script", "noscript", "template"):
                    self._flush() if name in BLOCKS else None
                close = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(s, at)
                end = s.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else size
            else:
                self._start(name, m["rest"])
        self._flush()
        self._close(1)

    def main_text(self, low: frozenset[int] | set[int] = frozenset()) -> str:
        """Blocks of the article, else of main, else of the page, without those
        that markup or the style tree drops."""
        kept = [(t, n[at:], r) for t, n, d, r, at in self.blocks if not d]
        best = max((r for *_, r in kept), default=0)
        own = [(t, n) for t, n, r in kept if r == best]
        high = [t for t, n in own if low.isdisjoint(n)]
        return " ".join(high or [t for t, _ in own if best])


def _host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, node, m, importance) of every branch of each host's style tree; m
    is the number of pages that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from tessera.llm.html_text import Page

        digest = lambda t: xxhash.xxh3_64_intdigest(t) - (1 << 63)
        for b in slices(batches, "html"):
            found: dict[tuple, int] = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page, seen = Page(source), set()
                for text, nodes, *_ in page.blocks:
                    seen.add((host, nodes[1:], 1, digest(text)))
                for _, nodes, shape in page.shapes:
                    seen.add((host, nodes[1:], 2, digest(shape)))
                    seen.add((host, nodes[1:], 0, 0))
                for _, nodes, *_ in page.blocks:
                    seen.add((host, nodes[1:], 0, 0))
                for key in seen:
                    found[key] = found.get(key, 0) + 1
            keys = [k for k in found if k[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.list_(pa.int64())), pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())],
                names=["host", "nodes", "kind", "content", "k"],
            )

    rows = pages.where("html is not null and host <> ''").select("host", "html").mapInArrow(run, "host string, nodes array<long>, kind int, content long, k long")
    # (host, node, content) -> pages that have it; then the sums that entropy needs
    each = rows.groupBy("host", "nodes", "kind", "content").agg(F.sum("k").alias("k"))
    sums = each.groupBy("host", "nodes").agg(
        *[f.alias(n) for kind, a, b in ((1, "n1", "e1"), (2, "n2", "e2")) for f, n in ((F.sum(F.when(F.col("kind") == kind, F.col("k")).otherwise(0)), a), (F.sum(F.when(F.col("kind") == kind, F.col("k") * F.log("k")).otherwise(0.0)), b))],
        F.max(F.when(F.col("kind") == 0, F.col("k")).otherwise(0)).alias("m"),
    )
    spread = lambda n, e: F.when((F.col(n) > 0) & (F.col("m") > 1), F.greatest(F.lit(0.0), 1 - F.col(e) / F.col(n) / F.log("m"))).otherwise(F.lit(1.0))
    # written once: pages are read for statistics a single time
    own = cut(sums.select("host", "nodes", "m", "n1", spread("n1", "e1").alias("content_imp"), F.when(F.col("n2") > 0, spread("n2", "e2")).alias("shape_imp")), "nodes")
    # every branch gathers the content below it
    below = own.select("host", F.explode("nodes").alias("node"), "n1", (F.col("n1") * F.col("content_imp")).alias("w"))
    below = below.groupBy("host", "node").agg(F.sum("n1").alias("n"), F.sum("w").alias("w"))
    at = own.select("host", F.element_at("nodes", -1).alias("node"), "m", "shape_imp").groupBy("host", "node").agg(F.max("m").alias("m"), F.max("shape_imp").alias("shape_imp"))
    mean = F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(F.lit(1.0))
    whole = below.join(at, ["host", "node"]).withColumn("importance", F.when(F.col("shape_imp").isNull(), mean).otherwise(GAMMA * mean + (1 - GAMMA) * F.col("shape_imp")))
    return whole.select("host", "node", "m", "importance")


def low_nodes(pages: DataFrame) -> DataFrame:
    """(host, node) of the branches whose importance is too low."""
    return node_importance(pages).where((F.col("m") >= MIN_PAGES) & (F.col("importance") < LEAST)).select("host", "node", "importance")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of
    pages(page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    hosted = _host(pages.select("page_id", "url", "html"))
    low = cut(low_nodes(hosted), "low-nodes")
    by_host = low.groupBy("host").agg(F.collect_set("node").alias("low"))
    if low.count() <= BROADCAST_NODES:
        joined = hosted.join(F.broadcast(by_host), "host", "left")
    else:
        salted = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
        joined = salted.join(by_host.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.html_text import Page

        for b in slices(batches, "html"):
            texts = [Page(h or "").main_text(set(x or ())) for h, x in zip(b.column("html").to_pylist(), b.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "low").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
