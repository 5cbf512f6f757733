"""Main text of web pages by a host suffix array.

Pages are cut into blocks of text, and what structure drops (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) is left out, whether it is a block or stands in a line. The token streams of a host's pages
are concatenated, and a suffix array of the stream, by prefix doubling down to ``min_run`` tokens, shows all runs that
occur in two distinct pages of the host. They decide where structure is silent:

* On a page without an article or main element, covered text is boilerplate and goes; unique runs stay.
* With such an element, text outside it goes. A block within goes if runs cover it whole, at least half of the host's pages
  (and five) hold it, and such blocks are the smaller part of the page's text. So a passage that some articles share, or a
  copy of an article, stays.

Hosts are dealt to shards of bounded text, and repeats are those of the host, not of a shard: shards of one host exchange
hashes (64 bits) of their runs, and of the blocks of articles. A hash seen on two pages of any shards counts in all of them.

Defined cases: null or empty html gives an empty text; pages without a host form one host; repeated rows are extracted as
often as they occur, and don't count as distinct pages if their id is the same; a page without an id is told apart by its url
and html; hosts of few words, and pages of any length, are no exception; ties don't arise, as no choice depends on order;
unclosed elements and comments end as browsers end them; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import broadcast_if_small, materialise, small_batches

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Fixed values of HTML: elements whose content is text without markup; void elements; elements that stand in a line.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements, and words of class, id or role, that mark what isn't main text.
DROPPED = frozenset("nav footer aside form script style noscript iframe template textarea title head button select option menu dialog svg canvas object audio video".split())
#: Of these, what stands in a line of text and doesn't end it.
UNSEEN = frozenset("script style noscript iframe template textarea button select option svg canvas object audio video".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription"
    " sidebar nav navbar navigation menu menus breadcrumb breadcrumbs comment comments disqus replies footer share sharing social related popup modal overlay paywall complementary contentinfo search dialog form".split()
)
HEADERS = frozenset(["header", "masthead"])
#: Names of two or more words are marks if a mark comes with such words only ("ad-slot", "comment-list", "site-footer"; not "ad-hoc").
WITH_MARKS = frozenset("site page main top bottom left right global primary secondary widget slot unit container box wrapper wrap list section area block links link buttons button bar item items inner outer signup posts articles panel header title".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def names_of(tag: str) -> set[str]:
    return {t for m in ATTRIBUTE.finditer(tag) for t in (m[2] or m[3] or m[4] or "").lower().split()}


def marked(names: set[str], marks: frozenset[str]) -> bool:
    """Whether one of the names, as a whole, is a mark or made of marks and words that go with them."""
    for name in names:
        if name in marks:
            return True
        words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
        if words and any(w in marks for w in words) and all(w in marks or w in WITH_MARKS for w in words):
            return True
    return False


def blocks(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page has an article or main element, and its blocks of text: those of that element, or else all, in page
    order and without what structure drops."""
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name; inside something dropped, an article, a main element
    nowhere = ("", False, False, False)

    def flush() -> None:
        words = "".join(text).split()
        text.clear()
        if words:
            _, _, article, main = stack[-1] if stack else nowhere
            out.append((" ".join(words), article, main))

    skip_to, page = 0, page or ""
    for m in PIECE.finditer(page):
        if m.start() < skip_to:
            continue
        piece = m[0]
        if piece[0] != "<" or piece == "<":
            if not (stack and stack[-1][1]):
                text.append(entities.unescape(piece))
            continue
        named = NAME.match(piece)
        if not named:
            continue
        name = named[1].lower()
        in_line = name in INLINE or name in UNSEEN
        if piece[1] == "/":
            if not in_line:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name == "br" and not (stack and stack[-1][1]):
            text.append("\n")
        if not in_line:
            flush()
            ends = CLOSED_BY.get(name, set()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in VOID or piece.endswith("/>"):
            continue
        _, dropped, article, main = stack[-1] if stack else nowhere
        names = names_of(piece) if "=" in piece else set()
        if name in DROPPED or (names and name not in ("body", "html", "article", "main") and marked(names, MARKS)) or (name == "article" and names and marked(names, frozenset(["comment", "comments"]))):
            dropped = True
        if not article and not main and (name in HEADERS or (names and name not in ("body", "html", "article", "main") and marked(names, HEADERS))):
            dropped = True
        stack.append((name, dropped, article or name == "article", main or name == "main"))
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, m.end())
            skip_to = end.start() if end else len(page)
            stack.pop()
    flush()
    for held in (1, 2):
        if any(b[held] for b in out):
            return True, [b[0] for b in out if b[held]]
    return False, [b[0] for b in out]


class Runs:
    """All runs of min_run tokens of some streams: a suffix array, down to that depth, by prefix doubling.

    pages: for each stream the page that it is of. ``hashes`` are the same for the same run in any other array.
    """

    def __init__(self, streams: list[list[str]], pages: list[int], min_run: int):
        numbers: dict[str, int] = {}
        self.min_run, self.sizes = min_run, [len(s) for s in streams]
        n = sum(self.sizes) + len(streams)
        rank, self.page = np.empty(n, np.int64), np.empty(n, np.int64)
        at, ends = 0, np.empty(len(streams), np.int64)
        for k, (s, p) in enumerate(zip(streams, pages, strict=True)):
            rank[at : at + len(s)] = [numbers.setdefault(t, len(numbers)) for t in s]
            self.page[at : at + len(s) + 1] = p
            at += len(s) + 1
            ends[k] = at - 1
        rank[ends] = len(numbers) + np.arange(len(ends))  # each stream ends in a token of its own
        known = np.array([*(xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t in numbers), *([0] * len(ends))], np.uint64)
        hashes, length = known[rank], 1
        while length < min_run:  # rank by the first `length` tokens
            step = min(length, min_run - length)
            after, far = np.full(n, -1, np.int64), np.zeros(n, np.uint64)
            if step < n:
                after[: n - step], far[: n - step] = rank[step:], hashes[step:]
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + (far ^ (far >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(step)
            length += step
        self.rank, self.hashes = rank, hashes.view(np.int64)
        self.whole = np.arange(n) + min_run <= np.repeat(ends, np.array(self.sizes, np.int64) + 1) if n else np.zeros(0, bool)
        self.order = np.argsort(rank, kind="stable")  # the suffix array
        self.starts = np.flatnonzero(np.r_[True, np.diff(rank[self.order]) > 0]) if n else np.zeros(0, np.int64)
        own = self.page[self.order]
        self.low, self.high = (np.minimum.reduceat(own, self.starts), np.maximum.reduceat(own, self.starts)) if n else (own, own)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, least and largest page of each run that lies whole in a stream."""
        first = self.order[self.starts]
        ok = self.whole[first]
        return self.hashes[first[ok]], self.low[ok], self.high[ok]

    def covered(self, elsewhere: np.ndarray | None = None) -> list[np.ndarray]:
        """For each stream, which tokens lie in runs that two pages share, or that stand elsewhere."""
        n = len(self.rank)
        shared = (self.low != self.high)[self.rank] if n else np.zeros(0, bool)
        if elsewhere is not None and len(elsewhere):
            shared |= self.whole & np.isin(self.hashes, elsewhere)
        edges = np.zeros(n + self.min_run + 1, np.int64)
        edges[:n] += shared
        edges[self.min_run : self.min_run + n] -= shared
        inside = np.cumsum(edges)[:n] > 0
        return [part[:-1] for part in np.split(inside, np.cumsum(np.array(self.sizes, np.int64) + 1)[:-1])] if self.sizes else []


def digest(block: str) -> int:
    """As Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(block.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


class Shard:
    """Pages of one host: (page, sure, blocks) each; ``page`` names a page, repeated rows share it."""

    def __init__(self, pages: list[tuple[int, bool, list[str]]], min_run: int = 12):
        self.pages = pages
        places = {p: k for k, p in enumerate(dict.fromkeys(p for p, _, _ in pages))}
        self.names = np.array(list(places), np.int64)
        self.words = [[b.split(" ") for b in own] for _, _, own in pages]
        self.runs = {}
        for sure in (False, True):
            of = [k for k, x in enumerate(pages) if x[1] == sure]
            self.runs[sure] = of, Runs([[w for b in self.words[k] for w in b] for k in of], [places[pages[k][0]] for k in of], min_run)

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What other shards of the host must know of pages without a main element: hash, least and largest page of each run."""
        hashes, low, high = self.runs[False][1].distinct()
        return hashes, self.names[low], self.names[high]

    def texts(self, elsewhere: np.ndarray | None = None, common: set[int] | None = None) -> list[str]:
        """elsewhere: hashes of runs that pages of two shards share; common: of blocks that most pages of the host hold (None: count here)."""
        if common is None:
            counts = Counter(h for _, h in {(p, digest(x)) for p, sure, own in self.pages if sure for x in own})
            common = {h for h, c in counts.items() if is_common(c, len(self.names))}
        out = [""] * len(self.pages)
        for sure, (of, runs) in self.runs.items():
            for k, seen in zip(of, runs.covered(elsewhere if not sure else None), strict=True):
                kept, gone, at = [], 0, 0
                for words, block in zip(self.words[k], self.pages[k][2], strict=True):
                    repeated, at = seen[at : at + len(words)], at + len(words)
                    if not sure:
                        words = [w for w, r in zip(words, repeated.tolist(), strict=True) if not r]
                        if words:
                            kept.append(" ".join(words))
                    elif common and len(words) >= runs.min_run and digest(block) in common and (repeated.all() or elsewhere is not None):
                        gone += len(words)
                    else:
                        kept.append(block)
                if sure and 2 * gone >= at:
                    kept = self.pages[k][2]
                out[k] = "\n\n".join(kept)
        return out


def is_common(pages, of):
    return (pages >= 5) & (2 * pages >= of)


def extract(pages: list[tuple[int | None, str | None]], min_run: int = 12) -> list[str]:
    """Main texts of pages (id, html) of one host."""
    return Shard([(-1 if i is None else i, *blocks(h)) for i, h in pages], min_run).texts()


def host_of() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def cut_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (what tells pages apart), sure and texts, the blocks."""
    small_batches(pages.sparkSession)
    page = F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url", "html"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of().alias("host"), page.alias("page"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [blocks(h) for h in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([c[0] for c in cut], pa.bool_()), pa.array([c[1] for c in cut], pa.list_(pa.string()))], names=["page_id", "url", "host", "page", "sure", "texts"])

    return own.mapInArrow(run, "page_id long, url string, host string, page long, sure boolean, texts array<string>")


def main_text(pages: DataFrame, min_run: int = 12, shard_chars: int = 400_000, max_broadcast: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    chars = F.sum(F.length(F.coalesce("html", F.lit(""))))
    hosts = pages.groupBy(host_of().alias("_host")).agg(chars.alias("chars")).where(F.col("chars") > shard_chars).select("_host", F.ceil(F.col("chars") / shard_chars).alias("_shards"))
    hosts = materialise(hosts, "hosts")
    placed = lambda df: df.join(broadcast_if_small(hosts, max_broadcast), F.col("host") == F.col("_host"), "left").drop("_host").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("page"), F.col("_shards")), F.lit(-1)).cast("long"))
    own = placed(cut_pages(pages)).select("page_id", "url", "host", "page", "sure", "texts", "shard")
    rows = own
    if hosts.limit(1).count():

        def tell(got: pa.Table) -> pa.Table:
            hashes, low, high = Shard(list(zip(got["page"].to_pylist(), got["sure"].to_pylist(), got["texts"].to_pylist(), strict=True)), min_run).told()
            n = len(hashes)
            return pa.table({"host": pa.array([got["host"][0].as_py()] * n, pa.string()), "shard": pa.array([got["shard"][0].as_py()] * n, pa.int64()), "hash": hashes, "low": low, "high": high})

        # Pages are cut twice, as that is cheaper than to write all texts: here for what shards must know, then for the shards.
        long = F.filter("texts", lambda x: F.size(F.split(x, " ")) >= min_run)
        facts = cut_pages(pages).select("host", "page", "sure", F.when(~F.col("sure"), F.col("texts")).alias("texts"), F.when(F.col("sure"), F.array_distinct(F.transform(long, lambda x: F.xxhash64(x)))).alias("hashes"))
        many = placed(materialise(facts, "facts", compression="zstd")).where("shard >= 0")
        # Runs of pages without a main element: a shard hears of those that it saw on one page only and that another page holds.
        told = materialise(many.where("NOT sure").groupBy("host", "shard").applyInArrow(tell, "host string, shard long, hash long, low long, high long"), "told")
        shared = told.groupBy("host", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "hash")
        heard = told.where("low = high").select("host", "shard", "hash").join(shared, ["host", "hash"]).select("host", "shard", F.lit(0).cast("long").alias("kind"), "hash")
        # Blocks of main elements, of which only hashes move: every shard of a host hears of its common ones, which are few.
        sizes = many.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("_of"))
        held = many.where("sure").select("host", "page", F.explode("hashes").alias("hash"))
        held = held.groupBy("host", "hash", "page").agg(F.lit(1).alias("one")).groupBy("host", "hash").agg(F.count("*").alias("pages")).where("pages >= 5")
        common = materialise(held.join(broadcast_if_small(materialise(sizes, "sizes"), max_broadcast), "host").where(is_common(F.col("pages"), F.col("_of"))).select("host", "hash"), "common")
        common = common.join(broadcast_if_small(hosts, max_broadcast), F.col("host") == F.col("_host"))
        common = common.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shards") - 1)).alias("shard"), F.lit(1).cast("long").alias("kind"), "hash")
        rows = own.unionByName(heard.unionByName(common), allowMissingColumns=True)
    else:
        rows = own.withColumns({"kind": F.lit(None).cast("long"), "hash": F.lit(None).cast("long")})

    def run(got: pa.Table) -> pa.Table:
        kinds = got["kind"].to_numpy(zero_copy_only=False)
        is_page = np.isnan(kinds.astype(float))
        hashes = got["hash"].to_pylist()
        many = got["shard"][0].as_py() >= 0
        elsewhere = np.array([h for h, k in zip(hashes, kinds, strict=True) if k == 0], np.int64) if many else None
        common = {h for h, k in zip(hashes, kinds, strict=True) if k == 1} if many else None
        got = got.filter(pa.array(is_page))
        texts = Shard(list(zip(got["page"].to_pylist(), got["sure"].to_pylist(), got["texts"].to_pylist(), strict=True)), min_run).texts(elsewhere, common)
        return pa.table({"page_id": got["page_id"], "url": got["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return rows.groupBy("host", "shard").applyInArrow(run, "page_id long, url string, text string, n_chars long")
