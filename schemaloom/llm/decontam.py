"""Benchmark decontamination: BM25 inverted index of test items, queried with every training passage by block-max WAND.

Passages are windows of words that overlap by half. Impacts are BM25 term scores of an item divided by the item's score
for its own text, so one threshold holds for long and short items. Postings lie in blocks with their largest impact;
a passage's query walks the postings document-at-a-time, from pivot to pivot, and skips blocks whose bound can't reach
the threshold, so that it retrieves exactly the items at or above it. Before that, all passages of a text are bounded at
once, per item: what its rarer terms in the passage score, plus the most that its common terms can add. Retrieved items are verified on
the text around the passage: word n-grams of the item's question and of its answer (last sentence, or last third) must
both occur there. An item longer than a window is indexed as a whole and in parts of half a window at most, which lie
whole in some passage; a hit of a part says where the item would lie, and it is verified on all of that span.

Training texts are read once, without a shuffle. The index is built from items in blocks of bounded size, each broadcast
in turn; so the items may grow.

Defined cases: null and empty texts match nothing; null and wordless items are never matched; repeated rows match alike;
items with equal text are all reported; extra columns are carried along (or ignored in ``leaks``).
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import free_name, materialise, with_arrow_columns

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    window: int = 64  #: words of a passage; the next one starts half a window later
    threshold: float = 0.5  #: of an item's score for its own text
    question: float = 0.6  #: share of the question's n-grams near the passage
    answer: float = 0.6
    ngram: int = 3
    common: float = 0.1  #: terms in more than this share of the items are common
    k1: float = 1.2
    b: float = 0.75
    block: int = 16  #: postings of a block
    max_block_chars: int = 64_000_000  #: text of the items of one index


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(ws: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the last sentence is the answer, or the last third of a single one."""
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)", text.rstrip())]
    if ends:
        question, answer = words(text[: ends[-1]]), words(text[ends[-1] :])
        if question and answer:
            return question, answer
    ws = words(text)
    cut = max(1, len(ws) - max(1, len(ws) // 3))
    return ws[:cut], ws[cut:]


@dataclass
class Postings:
    items: list[int]
    impacts: list[float]
    top: float
    block_last: list[int] = field(default_factory=list)
    block_top: list[float] = field(default_factory=list)


class Index:
    """Inverted index of items with block maxima."""

    def __init__(self, rows: list[tuple[int, str]], s: Settings):
        self.s = s
        rows = [(i, t) for i, t in rows if words(t)]
        self.ids = [i for i, _ in rows]
        own = [words(t) for _, t in rows]
        self.lengths = [len(w) for w in own]
        self.parts = [tuple((grams(p, s.ngram), min(s.ngram, len(p))) for p in parts(t)) for _, t in rows]
        counts = [Counter(w) for w in own]
        # Entries of the index: the items, then the parts of long items, with the word at which they begin.
        self.entries: list[tuple[int, int | None]] = [(k, None) for k in range(len(rows))]
        pieces = []
        for k, w in enumerate(own):
            if len(w) > s.window:
                edges = np.linspace(0, len(w), -(-len(w) // (s.window // 2)) + 1).round().astype(int).tolist()
                self.entries += [(k, at) for at in edges[:-1]]
                pieces += [w[at:end] for at, end in zip(edges, edges[1:], strict=False)]
        self.whole: dict[int, dict[str, float]] = {}
        frequency = Counter(t for c in counts for t in c)
        n, mean = len(rows), sum(map(len, own)) / max(1, len(rows))
        idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
        postings: dict[str, tuple[list[int], list[float]]] = {}
        rest = [0.0] * len(self.entries)
        limit = max(3, s.common * n)
        for k, w in enumerate([*own, *pieces]):
            c = counts[k] if k < n else Counter(w)
            impact = {t: idf[t] * f * (s.k1 + 1) / (f + s.k1 * (1 - s.b + s.b * len(w) / mean)) for t, f in c.items()}
            whole = sum(impact.values())
            if k < n and len(w) > s.window:
                self.whole[k] = {t: x / whole for t, x in impact.items()}
            for t, x in impact.items():
                items, impacts = postings.setdefault(t, ([], []))
                items.append(k)
                impacts.append(x / whole)
                rest[k] += x / whole if frequency[t] > limit else 0.0
        self.number = {t: i for i, t in enumerate(postings)}
        self.lists: list[Postings] = []
        for items, impacts in postings.values():
            p = Postings(items, impacts, max(impacts))
            for at in range(0, len(items), s.block):
                p.block_last.append(items[min(at + s.block, len(items)) - 1])
                p.block_top.append(max(impacts[at : at + s.block]))
            self.lists.append(p)
        # For the bound: postings of the rarer terms as flat arrays, and what common terms can add to each item.
        rare = [p if frequency[t] <= limit else None for t, p in zip(postings, self.lists, strict=True)]
        self.sizes = np.array([len(p.items) if p else 0 for p in rare] + [0], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat_items = np.array([i for p in rare if p for i in p.items], np.int64)
        self.flat_impacts = np.array([x for p in rare if p for x in p.impacts])
        self.rest = np.array(rest)

    def passages(self, numbers: np.ndarray) -> np.ndarray:
        """Passages of a text (term numbers, -1: none) for which the bound of some item's score reaches the threshold.

        The bound: impacts of the item's rarer terms in the passage, repeats included, and of all its common terms.
        """
        theta, n, half = self.s.threshold - 1e-9, len(self.entries), self.s.window // 2
        at = np.flatnonzero(self.sizes[numbers])
        sizes = self.sizes[numbers[at]]
        total = int(sizes.sum())
        if not total:
            return np.flatnonzero(np.full(-(-len(numbers) // half), float(self.rest.max(initial=0.0)) >= theta))
        flat = np.repeat(self.starts[numbers[at]] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
        items, impacts, halves = self.flat_items[flat], self.flat_impacts[flat], np.repeat(at // half, sizes)
        # Each half of a window belongs to the passage that starts there and to the one before.
        keys = np.concatenate([halves * n + items, np.maximum(halves - 1, 0) * n + items])
        keys, inverse = np.unique(keys, return_inverse=True)
        before = np.where(halves > 0, impacts, 0.0)
        sums = np.bincount(inverse, np.concatenate([impacts, before]))
        found = np.unique(keys[sums + self.rest[keys % n] >= theta] // n)
        if float(self.rest.max()) >= theta:  # common terms alone may do
            return np.arange(-(-len(numbers) // half))
        return found

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all entries whose score for the terms reaches the threshold."""
        theta = self.s.threshold - 1e-9
        cursors = [[self.lists[t].items[0], 0, self.lists[t]] for t in terms]  # current item, position, list
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[2].top
                if total >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, nearest = 0.0, None
            for c in cursors[: pivot + 1]:
                k = bisect.bisect_left(c[2].block_last, item)
                if k < len(c[2].block_last):
                    bound += c[2].block_top[k]
                    nearest = c[2].block_last[k] if nearest is None else min(nearest, c[2].block_last[k])
            if bound < theta:  # no item up to the nearest block's end, or up to the next list, can reach it
                target = (nearest if nearest is not None else item) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
                moving = cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(c[2].impacts[c[1]] for c in cursors[: pivot + 1])
                if score >= theta:
                    found.append((item, score))
                target, moving = item + 1, cursors[: pivot + 1]
            else:
                target, moving = item, [c for c in cursors[: pivot + 1] if c[0] < item]
            for c in moving:
                p = c[2]
                c[1] = bisect.bisect_left(p.items, target, c[1])
                c[0] = p.items[c[1]] if c[1] < len(p.items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def matches(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question share, answer share, first word of the passage), the best passage per item."""
        ws = words(text)
        if not ws or not self.lists:
            return []
        s, half = self.s, self.s.window // 2
        get = self.number.get
        numbers = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        best: dict[int, tuple[float, float, float, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for k in self.passages(numbers):
            start = int(k) * half
            terms = np.unique(numbers[start : start + s.window])
            for entry, score in self.search([int(t) for t in terms if t >= 0]):
                item, at = self.entries[entry]
                if item not in self.whole:
                    if item in best and best[item][0] >= score:
                        continue
                    near = ws[max(0, start - s.window) : start + 2 * s.window]
                else:
                    # Where the item would begin, to a window; texts with words put in are longer.
                    length, slack = self.lengths[item], s.window + self.lengths[item] // 2
                    low, high = (start - length, start) if at is None else ((start - at) // s.window * s.window,) * 2
                    if (item, low, high) in tried:
                        continue
                    tried.add((item, low, high))
                    near = ws[max(0, low - slack) : max(0, high + s.window + length + slack)]
                    score = sum(self.whole[item].get(w, 0.0) for w in set(near))
                    if item in best and best[item][0] >= score:
                        continue
                (question, n), (answer, m) = self.parts[item]
                around = {size: grams(near, size) if len(near) >= size else set() for size in {n, m}}
                q = len(question & around[n]) / len(question) if question else 1.0
                a = len(answer & around[m]) / len(answer) if answer else 1.0
                if q >= s.question and a >= s.answer:
                    best[item] = (score, q, a, start)
        return sorted((self.ids[i], *v) for i, v in best.items())


def item_blocks(items: DataFrame, s: Settings) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded text, read one block at a time."""
    own = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * chars / s.max_block_chars))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]


HIT = "array<struct<item_id: bigint, score: double, question: double, answer: double, start: bigint>>"


def matched(docs: DataFrame, items: DataFrame, s: Settings = Settings(), text_col: str = "text", keep=None) -> Iterator[DataFrame]:
    """For each block of items, docs with a column hits."""
    sc = docs.sparkSession.sparkContext
    for block in item_blocks(items, s):
        shared = sc.broadcast(block)

        def make(shared=shared):
            index = Index(shared.value, s)
            names = ("item_id", "score", "question", "answer", "start")
            return lambda texts: [[[dict(zip(names, m, strict=True)) for m in index.matches(t)] for t in texts]]

        yield with_arrow_columns(docs, [text_col], make, f"hits {HIT}", keep)


def leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per leaking document row and item: doc_id, item_id, score, question, answer, start."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for df in matched(own, items, s, keep=lambda hits: [bool(h) for h in hits]):
        df = df.select("doc_id", F.inline("hits"))
        found = df if found is None else found.unionByName(df)
    return found


def clean_documents(docs: DataFrame, items: DataFrame, s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with their own columns. Each block of items filters what the one before left."""
    columns, sc = docs.columns, docs.sparkSession.sparkContext
    for k, block in enumerate(item_blocks(items, s)):
        if k:
            docs = materialise(docs, "clean")
        shared = sc.broadcast(block)

        def make(shared=shared):
            index = Index(shared.value, s)
            return lambda texts: [[bool(index.matches(t)) for t in texts]]

        docs = with_arrow_columns(docs, [text_col], make, f"`{free_name(docs, 'leaks')}` boolean", lambda leak: [not x for x in leak]).select(*(f"`{c}`" for c in columns))
    return docs
