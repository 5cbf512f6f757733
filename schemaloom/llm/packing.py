"""Best-fit packing of tokenised documents into fixed-size training sequences.

Documents become runs of token ids plus one end id; runs longer than a sequence are cut into full pieces. Pieces are
dealt by hash to shards of a bounded number of pieces, and each shard packs its pieces, longest first, by *vector best
fit*: a sequence has residual capacities for tokens, documents and attention cost (sum of squared lengths), and a piece
goes to the sequence that, under every constraint, leaves the smallest weighted residual norm (or, with
``score="dot"``, has the largest weighted dot product of residual and demand). Pieces of badly filled sequences are then
packed once more together, so that shards leave no open ends.

Which capacities bind: tokens always, documents where texts are tiny (``max_docs`` bounds the segments that a training step
must mask). Attention cost can't bind while pieces may be as long as a sequence, for a sum of squares is at most the
square of the sum; it binds with a lower ``max_attention``, for pieces cut shorter, and else takes part in the score only.

Defined cases: a null or empty text is a document of the end id alone; a text of any length is cut into full pieces and a
rest; repeated rows are packed as often as they occur; ties in length go by id and piece; an empty table gives an empty one;
a null id is kept; no input row is ever dropped, and extra columns are ignored, whatever their names. Strings of special
tokens in a text become these tokens, as the tokenizer itself has it.
"""

from __future__ import annotations

import math
import re
import string
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import materialise, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHE_WORDS = 400_000


PUNCTUATION = string.punctuation.encode()


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: visible Latin-1 bytes as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Learned(dict):
    """Ids of words, asked for when first met."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


ENCODERS: dict[str, "WordEncoder"] = {}  #: of this process, by vocabulary; one at a time


def encoder_of(vocabulary: str) -> "WordEncoder":
    """The encoder that earlier tasks of this process have made, or a new one."""
    if vocabulary not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return ENCODERS[vocabulary]


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, by way of a bounded cache of words.

    The vocabulary's pre-tokeniser never joins text across white space and ignores ASCII case, so the ids of a text are
    those of its white-space separated parts, one after another. A part of a letter or digit and then punctuation is looked up as
    two, since these always end before a run of symbols. A part of Latin letters is one word of the model,
    and goes to the model itself; any other part goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.plain = Tokenizer.from_str(tokenizer_json)  # for whole texts that hold a special token
        special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)")
        self.tokenizer.encode_special_tokens = True  # parts are in lower case, so what looks like one here is none
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.cache = Learned(self._learn)
        self.limit = cache_words

    @staticmethod
    def _latin(part: bytes) -> str | None:
        """The part's normal form if it is one word of Latin letters."""
        if part.isalpha():
            return part.decode("ascii")
        text = part.decode("utf-8", "replace")
        if not text.isalpha() or max(text) >= "\u0250":
            return None
        text = unicodedata.normalize("NFC", text).lower()
        return text if text.isalpha() else None

    def _learn(self, p: bytes) -> bytes:
        if p.isalpha():
            word = p.decode("ascii")
        else:
            stem = p.rstrip(PUNCTUATION)
            if stem and len(stem) < len(p) and (stem[-1:].isalnum() or self._latin(stem) is not None):
                return self.cache[stem] + self.cache[p[len(stem) :]]
            word = self._latin(p)
            if word is None:
                ids = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
                return struct.pack(f"<{len(ids)}I", *ids)
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = {k: t for k, t in enumerate(texts) if t and self.special.search(t)}
        parts = [b"" if k in whole else (t or "").encode("utf-8", "replace").lower().split() for k, t in enumerate(texts)]
        if len(self.cache) > self.limit:
            self.cache.clear()
        get = self.cache.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for k, t in whole.items():
            out[k] = np.array(self.plain.encode(t.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def encode_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, with_ids, the ids themselves."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary file on the driver, some MB; executors get its text
        vocabulary = spark.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary.value)
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), []
            for name, ids in zip(names, encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            doc, piece, start, length, crc, part = zip(*rows, strict=True) if rows else [[]] * 6
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in part], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_attention: float, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; the pieces come longest first."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tokens, docs, attention = np.empty(n), np.empty(n), np.empty(n)
    number, opened, count = np.empty(n, np.int64), 0, 0
    wt, wd, wa = weights
    least = lengths[-1] if n else 0
    for i in range(n):
        size = float(lengths[i])
        cost = size * size
        if i % 256 == 0 and opened:  # drop sequences that nothing still to come fits into
            keep = np.flatnonzero((tokens[:opened] >= least) & (docs[:opened] >= 1))
            opened = len(keep)
            for a in (tokens, docs, attention, number):
                a[:opened] = a[keep]
        fits = (tokens[:opened] >= size) & (docs[:opened] >= 1) & (attention[:opened] >= cost)
        at = np.flatnonzero(fits)
        if len(at):
            t, d, a = tokens[at] / max_tokens, docs[at] / max_docs, attention[at] / max_attention
            if score == "dot":
                j = at[np.argmax(wt * t * size / max_tokens + wd * d / max_docs + wa * a * cost / max_attention)]
            else:
                t, d, a = t - size / max_tokens, d - 1 / max_docs, a - cost / max_attention
                j = at[np.argmin(wt * t * t + wd * d * d + wa * a * a)]
        else:
            j, opened = opened, opened + 1
            tokens[j], docs[j], attention[j], number[j] = max_tokens, max_docs, max_attention, count
            count += 1
        bins[i], offsets[i] = number[j], max_tokens - int(tokens[j])
        tokens[j] -= size
        docs[j] -= 1
        attention[j] -= cost
    return bins, offsets


def pack_pieces(pieces: DataFrame, max_tokens: int = 4096, max_docs: int = 256, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "norm", shard_pieces: int = 8192, full: float = 0.97) -> DataFrame:
    """Adds sequence_id and offset to pieces (of at most max_tokens each). ``pieces`` should be a written table.

    max_docs binds where pieces have under max_tokens / max_docs tokens on average; max_attention defaults to the cost of one
    full piece.
    """
    max_attention = max_attention or float(max_tokens) ** 2
    columns = pieces.columns

    def dealt(df: DataFrame, round_no: int) -> DataFrame:
        shards = max(1, math.ceil(df.count() / shard_pieces))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if not parts:
                return
            got = pa.Table.from_batches(parts).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            lengths = got["length"].to_numpy()
            bins, offsets = best_fit(lengths, max_tokens, max_docs, max_attention, weights, score)
            used = np.bincount(bins, weights=lengths)
            first = (2 * TaskContext.get().partitionId() + round_no) << 32
            got = got.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets)).append_column("used", pa.array(used[bins].astype(np.int64)))
            yield from got.to_batches()

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, used long"
        return materialise(df.select(*columns).repartition(shards, F.xxhash64("doc_id", "piece", "length", "ids_crc32")).mapInArrow(run, schema), f"packed{round_no}")

    first = dealt(pieces, 0)
    rest = first.where(F.col("used") < int(full * max_tokens))
    return first.where(F.col("used") >= int(full * max_tokens)).unionByName(dealt(rest, 1)).drop("used")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, **limits) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    return pack_pieces(materialise(encode_documents(docs, tokenizer_path, max_tokens, end_id), "pieces"), max_tokens, **limits)


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """The token ids of each sequence, of a packing made from pieces with ids. One row per sequence, of max_tokens ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
