"""Main text of HTML pages, with site templates removed by subtree counts per host.

Each page is parsed once, leniently and in time linear in its length, into
blocks.  Every element's subtree outside articles, and every container's inside
them, is hashed over its tags and text.  Spark counts, for each host, on how
many pages with different main parts a hash occurs; a subtree on many of them,
by number or by share, is template and its blocks are deleted.  Headings and
paragraphs of an article are never counted, so that copies of an article stay
whole.

Elements and names only assist: what is never main text by its element (menus,
footers, forms, scripts, styles, asides ...) or by a class, id or role that
names such a part is left out, but not where it holds the page's only articles.
If a page has articles or a main element, its text is theirs: those outside
such parts, or else those inside them.

Only hashes are counted and shuffled; the template hashes come back to the
pages, by host where they are few, and by page otherwise.

Defined cases: null or empty html has an empty text; pages without a host form
one site; unclosed and stray tags, bare ampersands and unfinished references
are taken as browsers take them; very long and very deep pages are taken whole;
pages that repeat an id are answered each on their own but share their template
hashes; extra columns are ignored; no pages give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import storage

#: A subtree is template on at least so many pages of its host that are this share of them, or on so many pages.
PAGES, SHARE, MANY = 5, 0.02, 50
#: Template hashes that every task may get; beyond that pages meet theirs in a join.
SHARED_HASHES = 200_000

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea svg iframe object canvas dialog menu".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Names of parts that are never main text, and names of parts that are none outside articles.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner comment comments consent cookie cookies footer header menu nav navbar navigation notice notices replies sidebar sponsor sponsored".split())
OUTSIDE = NAMES | frozenset("breadcrumb breadcrumbs disqus masthead modal newsletter pagination popup promo related share sharing social subscribe toolbar widget".split())
#: What may stand beside such a name in a class.
FILLERS = frozenset("area bar block box bottom container content inner left list main module outer page panel primary reader right section secondary site slot top unit user wrap wrapper".split())
_SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: What can be template inside an article.
CONTAINER = frozenset("div dl figure ol section table ul".split())
#: Elements whose start ends an open paragraph.
_ENDS_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Opening one of these closes an open one of the same group.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


def _names_part(names: str, parts: frozenset[str]) -> bool:
    """Whether a class, id or role is made of part names and fillers alone."""
    for name in names.split():
        own = {x.lower() for x in _SPLIT.split(name) if x and not x.isdigit()}
        if own & parts and own <= parts | FILLERS:
            return True
    return False


#: Ranks of blocks: outside articles, in an article inside a part that is left out, in another article.
OUTER, SUSPECT, ARTICLE = 0, 1, 2


class _Element:
    __slots__ = ("digest", "dropped", "first", "parts", "rank", "tag")

    def __init__(self, tag: str, dropped: bool, rank: int, first: int) -> None:
        self.tag, self.dropped, self.rank, self.first = tag, dropped, rank, first
        self.parts: list[bytes] = []


class _Page(HTMLParser):
    """Blocks of a page, each with the chain of subtree hashes that it lies in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = [_Element("", False, OUTER, 0)]
        self.at: dict[str, list[int]] = defaultdict(list)  #: places of the open elements by tag
        self.blocks: list[tuple[str, int]] = []  #: text and rank
        self.subtrees: list[tuple[bytes, int, int]] = []  #: hash and the blocks [a, b) inside
        self.text: list[str] = []
        self.main: list[bytes] = []  #: hashes of the outermost articles
        self.last_article = 0  #: the number of blocks up to the last one in an article

    def _flush(self) -> None:
        top = self.open[-1]
        words = " ".join("".join(self.text).split())
        self.text.clear()
        if words:
            self.blocks.append((words, top.rank))
            if top.rank:
                self.last_article = len(self.blocks)
            top.parts.append(words.encode("utf-8", "surrogatepass"))

    def _close(self) -> None:
        if self.open[-1].tag in BLOCK or self.open[-1].dropped:
            self._flush()
        e = self.open.pop()
        self.at[e.tag].pop()
        up = self.open[-1]
        digest = hashlib.blake2b(b"\x00".join([e.tag.encode(), *e.parts]), digest_size=8).digest()
        if e.rank and not up.rank:
            self.main.append(digest)
        if e.first < len(self.blocks) and (e.tag in CONTAINER if e.rank else e.tag not in ("html", "body") and self.last_article <= e.first):
            self.subtrees.append((digest, e.first, len(self.blocks)))
        up.parts.append(digest)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag in _ENDS_P:
            self._close_through(("p",), ("article", "main", "section", "div", "td", "th", "li", "table", "button", "object"))
        if tag in _SIBLINGS:
            self._close_through(_SIBLINGS[tag], _SCOPE[tag])
        if tag in BLOCK:
            self._flush()
        up = self.open[-1]
        named = [(k, v) for k, v in attrs if v and k in ("class", "id", "role")]
        article = tag in ("article", "main") or ("role", "main") in named
        names = " ".join(v for _, v in named)
        part = tag in NEVER or tag == "header" and not up.rank or bool(names) and not article and tag not in ("html", "body") and _names_part(names, NAMES if up.rank else OUTSIDE)
        if article and names and _names_part(names, NAMES):
            part = True  # a reader's comment as an article
        rank, dropped = up.rank, up.dropped or part
        if article and not up.rank:
            rank, dropped = SUSPECT if dropped else ARTICLE, tag in NEVER
        if dropped != up.dropped:
            self._flush()
        self.at[tag].append(len(self.open))
        self.open.append(_Element(tag, dropped, rank, len(self.blocks)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _last(self, tags: tuple[str, ...]) -> int:
        """Place of the last open element of these, 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def _close_to(self, place: int) -> None:
        while len(self.open) > place:
            self._close()

    def _close_through(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        k = self._last(tags)
        if k > self._last(scope):
            self._close_to(k)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not (k := self._last((tag,))):
            return
        if tag in BLOCK or k > self._last(("article", "main", "body", "table")):
            self._close_to(k)

    def handle_data(self, data: str) -> None:
        if not self.open[-1].dropped:
            self.text.append(data)

    def finish(self) -> None:
        self.close()
        self._close_to(1)
        self._flush()


def parse(source: str) -> _Page:
    page = _Page()
    page.feed(source)
    page.finish()
    return page


def identity(page: _Page) -> int:
    """The same for pages whose main parts are the same."""
    parts = page.main or page.open[0].parts
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def main_text(page: _Page) -> str:
    """The blocks of the best rank that the page has, without regard to its host."""
    best = max((rank for _, rank in page.blocks), default=OUTER)
    return "\n".join(text for text, rank in page.blocks if rank == best)


_PARSED = "page bigint, blocks array<string>, subtrees array<struct<hash:bigint,first:int,last:int>>, uid bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page with its blocks of the best rank and the subtrees that hold any of them."""
    uid = TaskContext.get().partitionId() << 40
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        own, blocks, subtrees = [], [], []
        for source in batch.column("html"):
            page = parse(source.as_py() or "")
            best = max((rank for _, rank in page.blocks), default=OUTER)
            kept = [0, *accumulate(int(rank == best) for _, rank in page.blocks)]
            own.append(identity(page))
            blocks.append([text for text, rank in page.blocks if rank == best])
            subtrees.append([{"hash": int.from_bytes(d, "little", signed=True), "first": kept[a], "last": kept[b]} for d, a, b in page.subtrees if kept[b] > kept[a]])
        columns = [*[batch.column(c) for c in ("page_id", "url", "host")], pa.array(own, pa.int64()), pa.array(blocks, pa.list_(pa.string())), pa.array(subtrees, kind), pa.array(range(uid, uid + len(own)), pa.int64())]
        uid += len(own)
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "page", "blocks", "subtrees", "uid"])


def host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


def template_hashes(parsed: DataFrame) -> DataFrame:
    """host, hash of the subtrees that are template."""
    sizes = parsed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    once = parsed.select("host", "page", F.explode(F.array_distinct("subtrees.hash")).alias("hash")).distinct()
    counts = once.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    return counts.join(sizes, "host").where((F.col("n") >= SHARE * F.col("pages")) | (F.col("n") >= MANY)).select("host", "hash")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.col(source).alias("html"))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    parsed, _ = storage.materialize(rows.mapInArrow(_parse, f"page_id {kind('page_id')}, url {kind('url')}, host string, {_PARSED}"), "parsed")
    common, _ = storage.materialize(template_hashes(parsed), "templates")
    if common.count() <= SHARED_HASHES:
        lists = common.groupBy("host").agg(F.collect_list("hash").alias("template"))
        joined = parsed.join(F.broadcast(lists), "host", "left")
    else:
        own = parsed.select("uid", "host", F.explode(F.array_distinct("subtrees.hash")).alias("hash")).join(common, ["host", "hash"])
        lists = own.groupBy("uid").agg(F.collect_list("hash").alias("template"))  # of one page
        joined = parsed.join(lists, "uid", "left")
    gone = F.filter("subtrees", lambda s: F.array_contains("template", s["hash"]))
    kept = F.filter("blocks", lambda _, i: ~F.exists(gone, lambda s: (s["first"] <= i) & (i < s["last"])))
    return joined.select("page_id", "url", F.array_join(F.when(F.col("template").isNull(), F.col("blocks")).otherwise(kept), "\n").alias("text"))
