"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that of two fingerprints within ``max_bits`` at least one segment
differs by one bit at most (``segments > max_bits / 2``). Each distinct fingerprint is indexed under every segment as it
is and under the segment with each one bit as a wildcard; equality joins of these keys yield all pairs that agree on a
segment up to one bit, and the whole fingerprints are then compared. Copies share a fingerprint and meet before the join,
so that a group of copies is one row of it. Keys that very many fingerprints share leave the join; their fingerprints are
joined on longer keys, with one of ``max_bits + 1`` parts of the other bits, and where very many share these too, compared
in blocks that leave out what is connected already. So no group is ever expanded into all pairs, and no link is lost. Groups are the connected components, found by
alternating large-star and small-star steps over written tables.

Few bits of 64 reach only very near texts: at a Jaccard similarity of 0.8 of word shingles, fingerprints differ in 15 % of
their bits on average. ``similar_groups`` therefore takes them for candidates only, adds those of MinHash bands, and
links by the shingles themselves.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; repeated rows share a group; a null id is never a group's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import broadcast_if_small, materialise, small_batches
from schemaloom.llm.jaccard import signatures, sketches_near, texts_near

SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit majority of the XXH64 of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), ">u8").astype("<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ SPREAD for k in range(8)])
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def segment_masks(segments: int) -> list[int]:
    edges = [round(k * 64 / segments) for k in range(segments + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parts_of(mask: int, n: int) -> list[int]:
    """The bits of the mask in n masks of about as many bits each."""
    bits = [j for j in range(64) if mask >> j & 1]
    edges = [round(k * len(bits) / n) for k in range(n + 1)]
    return [sum(1 << j for j in bits[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def unsent(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input: never by way of the driver, however small their compressed files look."""
    return left.join(right.hint("merge"), on, how)


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2, hot: int = 512, block: int = 4096) -> DataFrame:
    """Pairs (a, b) of different fingerprints; every pair within max_bits is connected by them. fps: distinct, column fp."""
    if not 2 * segments > max_bits:
        raise ValueError("of two fingerprints within max_bits, one segment must differ by one bit at most")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    masks = segment_masks(segments)
    # Key kinds: a segment as it is (wild = 0), and with one wildcard bit (wild = that bit), which then tells the sides apart.
    kinds = [(k, m, 0) for k, m in enumerate(masks)] + [(k, m, 1 << j) for k, m in enumerate(masks) for j in range(64) if m >> j & 1]
    table = F.array(*(F.struct(F.lit(k).alias("seg"), F.lit(signed(m & ~w)).alias("mask"), F.lit(signed(w)).alias("wild")) for k, m, w in kinds))
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a small table that grows 66-fold
    keys = fps.select("fp", F.explode(table).alias("k")).select(
        "fp", F.col("k.seg").alias("seg"), F.col("k.wild").alias("wild"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("part"), (F.col("fp").bitwiseAND(F.col("k.wild")) != 0).alias("one")
    )
    on = ["seg", "wild", "part"]
    sides = ((F.col("wild") == 0) & (F.col("a") < F.col("b"))) | (~F.col("one_a") & F.col("one_b"))

    def split(keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Pairs that meet in keys of at most ``hot`` fingerprints, and the rows of the other keys, if there are any."""
        crowd = materialise(keys.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*on), "crowded")
        dense = None
        if crowd.limit(1).count():
            dense = materialise(unsent(keys, crowd, on, "left_semi"), "dense")
            keys = unsent(keys, crowd, on, "left_anti")
        a = keys.select(F.col("fp").alias("a"), *on, F.col("one").alias("one_a"))
        b = keys.select(F.col("fp").alias("b"), *on, F.col("one").alias("one_b"))
        return unsent(a, b, on).where(sides & near(F.col("a"), F.col("b"))).select("a", "b"), dense

    found, dense = split(keys)
    if dense is None:
        return found
    # Outside the segment, a pair agrees on one of max_bits + 1 parts at least.
    finer = F.array(*(F.array(*(F.struct(F.lit(segments + k * (max_bits + 1) + j).alias("seg"), F.lit(signed(m)).alias("mask"), F.lit(signed(r)).alias("rest")) for j, r in enumerate(parts_of(((1 << 64) - 1) ^ m, max_bits + 1)))) for k, m in enumerate(masks)))
    finer = dense.select("fp", "wild", "one", F.explode(F.get(finer, F.col("seg"))).alias("k")).select(
        "fp", F.col("k.seg").alias("seg"), "wild", "one", F.col("fp").bitwiseAND(F.col("k.mask").bitwiseAND(F.bitwise_not("wild")).bitwiseOR(F.col("k.rest"))).alias("part")
    )
    more, dense = split(finer)
    found = found.unionByName(more)
    if dense is None:
        return found

    def measure(t: pa.Table) -> Callable:
        fps = t["id"].to_numpy().view("<u8")
        return lambda x, y: np.bitwise_count(fps[x] ^ fps[y]) <= max_bits

    return found.unionByName(all_links(dense.select(F.xxhash64(*on).alias("key"), F.col("fp").alias("id")), measure, block))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that can be reached."""
    links = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before = None
    for _ in range(max_rounds if links.limit(1).count() else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = unsent(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = unsent(large, least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = materialise(small.where("u != v").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        if before:
            raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row."""
    marked = materialise(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(materialise(distinct.select("fp"), "distinct"), max_bits, segments))
    placed = unsent(distinct, roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = placed.where(F.col("root").isNotNull())
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialise(unsent(linked, best, "root").select("fp", "component_id"), "groups")
    return unsent(marked, by_fp, "fp").select("doc_id", "fp", "component_id")


# --- groups by similarity: what few differing bits of 64 can't reach ---

WIDE = 4  #: 64-bit words of a wide fingerprint
BAND = 16  #: bits of a band


def wide_fingerprint(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """256 bits: the 64-bit fingerprint, then those of three scramblings of the shingles' hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(WIDE, "<u8")
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), ">u8").astype("<u8")
    out = np.empty(WIDE, "<u8")
    for k in range(WIDE):
        if k:  # a 64-bit finaliser, keyed by k
            h = h + np.uint64(0x9E3779B97F4A7C15)
            z = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        else:
            z = h
        columns = np.ascontiguousarray(z).view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(columns[:, j], minlength=256) @ SPREAD for j in range(8)])
        out[k] = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that join what the edges (a, b) join."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        for ends in (x, y, root[x], root[y]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def links_within(bounds: np.ndarray, label: np.ndarray, near: Callable, few: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect all that near() joins within the groups bounds[k] to bounds[k + 1].

    label: rows of one label are connected already and aren't compared. near(x, y) takes row numbers: two arrays for groups
    of at most ``few`` rows, one row and an array for larger ones, which are done one after the other.
    """
    sizes = np.diff(bounds)
    end, at = np.repeat(bounds[1:], sizes), np.flatnonzero(np.repeat(sizes <= few, sizes))
    found = ([], [])
    for step in range(1, few):
        at = at[at + step < end[at]]
        if not len(at):
            break
        x = at[label[at] != label[at + step]]
        x = x[near(x, x + step)] if len(x) else x
        found[0].append(x)
        found[1].append(x + step)
    for k in np.flatnonzero(sizes > few):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        own = np.unique(label[lo:hi], return_inverse=True)[1]
        for i in range(hi - lo - 1):
            y = i + 1 + np.flatnonzero(own[i + 1 :] != own[i])
            y = y[near(lo + i, lo + y)] if len(y) else y
            if len(y):
                found[0].append(np.full(len(y), lo + i))
                found[1].append(lo + y)
                own[np.isin(own, own[y])] = own[i]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found[0]]), np.concatenate([none, *found[1]])


def all_links(rows: DataFrame, measure: Callable[[pa.Table], Callable], block: int = 4096, size: Column | None = None, max_size: int = 16_000_000, few: int = 32) -> DataFrame:
    """Links (a, b) of ids that connect every pair of rows of one key that is near.

    rows: key, id, and what measure() reads; it turns a table of rows into near(x, y). A key of up to ``block`` rows (and
    ``max_size`` of the sum of size) is compared in one task. Larger ones are cut into blocks. First each block is compared within itself
    and with a few rows common to all blocks, which joins most of a group of like rows. Of what that left in other
    components than the key's largest, each block then meets each block of the key. So no pair of different components
    is left out, no task gets over two blocks of a key, and a group of like rows is dealt a few times only.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, part, id_ = (t[c].to_numpy() for c in ("key", "part", "id"))
        order = np.lexsort((id_, part, key))
        key, part, t = key[order], part[order], t.take(pa.array(order))
        bounds = np.r_[0, np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1, len(key)]
        id_ = t["id"].to_numpy()
        x, y = links_within(bounds, t["label"].to_numpy(), measure(t), few)
        if len(x):
            a, b = forest(id_[x], id_[y])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    columns = [c for c in rows.columns if c not in ("key", "id")]
    dealt = lambda df: df.select("key", "part", "id", "label", *columns).repartition(parts, "key", "part").mapInArrow(run, "a long, b long")
    alone = rows.withColumns({"part": F.lit(0).cast("long"), "label": F.col("id")})
    sums = rows.groupBy("key").agg(F.count("*").alias("_n"), F.sum(F.lit(0) if size is None else size).alias("_size"))
    crowds = sums.select("key", "_n", F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_size") / max_size)).alias("_k")).where("_k > 1 AND _n > 1")
    crowds = materialise(crowds, "crowds")
    if not crowds.limit(1).count():
        return dealt(alone)
    crowds = broadcast_if_small(crowds, 100_000)
    big = materialise(rows.join(crowds, "key"), "crowded")
    spread = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    common = spread(2, F.col("_n")) < 64
    own = spread(1, F.col("_k"))
    every = F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)
    first = big.withColumns({"part": F.explode(F.when(common, every).otherwise(F.array(own))), "label": F.col("id")})
    found = materialise(dealt(alone.join(crowds, "key", "left_anti")).unionByName(dealt(first)), "found")
    big = unsent(big, components(found), F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "id")).drop("node", "root")
    big = materialise(big, "labelled")
    most = big.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("_most"), F.count("*").alias("_labels"))
    big = big.join(broadcast_if_small(most.where("_labels > 1"), 100_000), "key").withColumn("_other", F.col("label") != F.col("_most"))
    # Rows outside the largest component, in as many blocks as their share of the key asks for.
    others = big.where("_other").groupBy("key").agg(F.count("*").alias("_s"), F.sum(F.lit(0) if size is None else size).alias("_t"))
    others = others.select("key", F.greatest(F.lit(1), F.ceil(F.col("_s") / block), F.ceil(F.col("_t") / max_size)).alias("_m"))
    big = big.join(broadcast_if_small(others, 100_000), "key")
    pair = lambda i, j: i * F.col("_m") + j
    along = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1), lambda j: pair(own, j))
    across = F.transform(every, lambda i: pair(i, spread(3, F.col("_m"))))
    second = big.withColumn("part", F.explode(F.when(F.col("_other"), F.array_union(along, across)).otherwise(along)))
    return found.unionByName(dealt(second))


def similar_links(reps: DataFrame, max_bits: int, window: int = 4096) -> DataFrame:
    """Links (a, b) of ids that connect all whose wide fingerprints differ in max_bits at most and agree on a band of 16 bits.

    reps: id, w0 ... w3, one row per fingerprint. Rows are dealt by band value, those of crowded values in blocks of ``window`` rows.
    """
    bands = F.array(*(F.struct(F.lit(k * 64 // BAND + j).alias("band"), F.shiftrightunsigned(F.col(f"w{k}"), j * BAND).bitwiseAND(F.lit((1 << BAND) - 1)).alias("value")) for k in range(WIDE) for j in range(64 // BAND)))
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.repartition(parts, "id").select("id", *(f"w{k}" for k in range(WIDE)), F.explode(bands).alias("b")).select((F.col("b.band") * (1 << BAND) + F.col("b.value")).cast("long").alias("key"), "id", *(f"w{k}" for k in range(WIDE)))

    def measure(t: pa.Table) -> Callable:
        fps = np.stack([t[f"w{k}"].to_numpy() for k in range(WIDE)], axis=1).view("<u8")
        return lambda x, y: np.bitwise_count(fps[x] ^ fps[y]).sum(axis=-1) <= max_bits

    return all_links(rows, measure, window)


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, max_bits: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """doc_id and component_id: texts linked by a Jaccard similarity of their shingles of ``similarity`` or more.

    Candidates are fingerprints within max_bits of 64 and MinHash bands (see jaccard.py); the shingles decide. Null ids are left out.
    """
    named = docs.where(F.col(id_col).isNotNull())
    marked = materialise(signatures(named, shingle, id_col, text_col).where("doc_id IS NOT NULL"), "signatures")
    reps = marked.groupBy("e0", "e1").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "fp", "bands", "sketch")))
    reps = materialise(reps, "reps")
    by_first = materialise(reps.groupBy("fp").agg(F.min("id").alias("least")), "firsts")
    close = links(by_first.select("fp"), max_bits, segments)
    ends = unsent(unsent(close, by_first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a"), by_first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = unsent(reps, by_first, "fp").where("id <> least")
    bands = reps.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").select(F.explode("bands").alias("key"), "id", "n", "sketch")
    candidates = ends.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same.select(F.col("id").alias("a"), F.col("least").alias("b"))).unionByName(all_links(bands, sketches_near(similarity), block))
    members = broadcast_if_small(materialise(components(candidates), "candidates"), 500_000)
    texts = named.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = materialise(texts.join(members, F.col("id") == F.col("node")).select(F.col("root").alias("key"), "id", "text"), "texts")
    roots = components(all_links(texts, texts_near(similarity, shingle), block, F.length("text"), few=0))
    placed = materialise(unsent(reps, roots, reps.id == roots.node, "left").select("e0", "e1", F.coalesce("root", "id").alias("component_id")), "groups")
    return unsent(marked, placed, ["e0", "e1"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, max_bits: int = 3, segments: int = 2, id_col: str = "doc_id") -> DataFrame:
    """The documents without all but the smallest id of each near-duplicate group.

    Of repeated rows of that id one stays. A document without an id can't be named as a group's member, and stays.
    """
    groups = similar_groups(docs, similarity, shingle, max_bits, segments, id_col=id_col)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    named = unsent(docs.where(F.col(id_col).isNotNull()), stay, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
