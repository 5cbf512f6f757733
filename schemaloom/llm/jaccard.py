"""Near-duplicate groups by exact Jaccard similarity of word shingles.

Candidates come from MinHash bands (20 of 4 values: a pair of similarity 0.8 shares none with a probability of 3e-5) that
also agree in a sketch (the low bytes of all 80 values, five standard deviations below the similarity: 3e-7 at 0.8) and from
close SimHash fingerprints. The texts of each connected set of candidates then meet, and are linked only by the shingles
themselves: prefixes of the rarer shingles say which sets can reach the similarity, and the sets are intersected.

Defined cases: a text of fewer words than a shingle is one shingle; null and blank texts have no shingle and equal each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import small_batches

SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BANDS, ROWS = 20, 4
VALUES = BANDS * ROWS
_RANDOM = np.random.default_rng(20240)
FLIPS = _RANDOM.integers(0, 1 << 64, VALUES, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, VALUES, np.uint64) | np.uint64(1)
MIXES = _RANDOM.integers(0, 1 << 64, VALUES, np.uint64) | np.uint64(1)


def hashes_of(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), ">u8").astype("<u8")


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    return np.unique(hashes_of(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint, as in simhash.py."""
    if not len(hashes):
        return 0
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ SPREAD for k in range(8)])
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    least = np.full(VALUES, np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), 2048):
        mixed = (hashes[at : at + 2048, None] ^ FLIPS) * FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return least


def signatures(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, e0 and e1 (a digest of the set of shingles), n (its size), fp (SimHash), bands (a key each) and sketch."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "e0", "e1", "n", "fp", "bands", "sketch"]
    numbers = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [hashes_of(t, shingle) for t in batch.column(1).to_pylist()]
            sets = [np.unique(h) for h in every]
            equal = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), "<i8").reshape(-1, 2)
            values = np.array([signature(h) for h in sets], np.uint64).reshape(-1, VALUES)
            keys = (values * MIXES).reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64) + numbers
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view("<i8")))
            sketches = pa.array([v.astype(np.uint8).tobytes() for v in values], pa.binary())
            columns = [batch.column(0), pa.array(np.ascontiguousarray(equal[:, 0])), pa.array(np.ascontiguousarray(equal[:, 1])), pa.array([len(h) for h in sets], pa.int64()), pa.array([majority(h) for h in every], pa.int64()), keys, sketches]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, e0 long, e1 long, n long, fp long, bands array<long>, sketch binary")


def sketches_near(similarity: float) -> Callable[[pa.Table], Callable]:
    """near(x, y) of rows with n and sketch, for pairs that may have the similarity."""
    least = int(VALUES * similarity - 5 * math.sqrt(VALUES * similarity * (1 - similarity)))

    def measure(t: pa.Table) -> Callable:
        n = t["n"].to_numpy()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, VALUES)
        return lambda x, y: (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9) & ((sketch[x] == sketch[y]).sum(axis=-1) >= least)

    return measure


class Sets:
    """Sets of shingles, flat: set k holds the tokens flat[starts[k]:starts[k + 1]], rarest first."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.similarity, self.sizes = similarity, np.array([len(s) for s in sets], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        tokens = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        counts = np.bincount(tokens)
        self.flat = tokens[np.lexsort((tokens, counts[tokens], owner))]
        # Two sets of the similarity share a token among the first n - ceil(similarity n) + 1 of each.
        self.prefix = self.sizes - np.ceil(similarity * self.sizes - 1e-9).astype(np.int64) + 1
        first = np.arange(len(self.flat)) - self.starts[owner] < self.prefix[owner]
        token, own = self.flat[first], owner[first]
        order = np.argsort(token, kind="stable")
        self.lists = own[order]
        self.list_ends = np.searchsorted(token[order], np.arange(len(counts) + 1))
        self.mark = np.zeros(len(counts), bool)

    def spans(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))

    def near(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are of the similarity to set k."""
        if not self.sizes[k]:
            return self.sizes[others] == 0
        prefix = self.flat[self.starts[k] : self.starts[k] + self.prefix[k]]
        at = self.list_ends[prefix]
        shares = np.zeros(len(self.sizes), bool)
        shares[self.lists[self.spans(at, self.list_ends[prefix + 1] - at)]] = True
        small, large = np.minimum(self.sizes[k], self.sizes[others]), np.maximum(self.sizes[k], self.sizes[others])
        out = shares[others] & (small >= self.similarity * large - 1e-9)
        some = others[out]
        if len(some):
            own = self.flat[self.starts[k] : self.starts[k + 1]]
            self.mark[own] = True
            met = self.mark[self.flat[self.spans(self.starts[some], self.sizes[some])]]
            self.mark[own] = False
            both = np.add.reduceat(met.astype(np.int64), np.cumsum(self.sizes[some]) - self.sizes[some])
            out[out] = both >= self.similarity * (self.sizes[k] + self.sizes[some] - both) - 1e-9
        return out


def texts_near(similarity: float, shingle: int) -> Callable[[pa.Table], Callable]:
    """near(x, y) of rows with text, exactly. Rows are asked for group by group (in the order of the table)."""

    def measure(t: pa.Table) -> Callable:
        texts, key, part = t["text"], t["key"].to_numpy(), t["part"].to_numpy()
        held: dict = {}

        def group(row: int) -> tuple[int, Sets]:
            if not held or not held["lo"] <= row < held["hi"]:
                lo, hi = np.searchsorted(key, key[row], "left"), np.searchsorted(key, key[row], "right")
                lo, hi = lo + np.searchsorted(part[lo:hi], part[row], "left"), lo + np.searchsorted(part[lo:hi], part[row], "right")
                held.update(lo=lo, hi=hi, sets=Sets([shingle_hashes(s, shingle) for s in texts.slice(lo, hi - lo).to_pylist()], similarity))
            return held["lo"], held["sets"]

        def near(x, y) -> np.ndarray:
            lo, sets = group(int(x))
            return sets.near(int(x) - lo, y - lo)

        return near

    return measure
