import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents
from tokenizers import Tokenizer

from schemaloom.llm.packing import best_fit, encode_documents, encoder_of, pack_documents, pack_pieces, sequences

path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def ids_of(text):
    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_equal_plain_tokenizer(spark):
    got = {}
    for r in encode_documents(documents(spark), path, with_ids=True).collect():
        got.setdefault((r.doc_id,), []).append(r)
    for doc_id, text, *_ in awkward():
        if doc_id is None:
            continue
        want = ids_of(text)
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got[(doc_id,)]})
        assert [i for p in pieces for i in p[4]] == want
        for piece, start, length, crc, ids in pieces:
            assert start == 4096 * piece and length == len(ids) <= 4096
            assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_are_learned_when_met_and_once_in_a_process():
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    encoder = encoder_of(vocabulary)
    assert encoder_of(vocabulary) is encoder  # a task makes none of its own
    texts = ["foo-bar, it's, they'll! 12. 3.14; a1?! (x) é, Éa. ñ-2: e\u0301. ½, ２！ x\x1c. \x00, a'. 's 's' ''ll ...", "foo-bar; 12! don't." * 3]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [encoder.plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert b"foo-bar" in encoder.cache and b"12" in encoder.cache  # split from the symbols behind them


def test_packing_is_whole_and_gapless(spark):
    rows = pack_documents(documents(spark), path, max_tokens=256, shard_pieces=50).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t, *_ in awkward())
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_seq) <= 1.03 * sum(r.length for r in rows) / 256 + 2


def test_every_constraint_binds():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 100, 500))[::-1]
    for score in ("norm", "dot"):
        bins, _ = best_fit(lengths, 100, 3, 4000.0 + 99 * 99, (1, 1, 1), score)
        for b in np.unique(bins):
            own = lengths[bins == b].astype(float)
            assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 4000 + 99 * 99


def test_empty_table_and_sequences(spark):
    assert pack_documents(documents(spark, []), path).count() == 0
    pieces = encode_documents(documents(spark, [(1, "a b c", "en", "s", 5), (2, None, None, None, None)]), path, with_ids=True)
    (row,) = sequences(pack_pieces(pieces)).collect()
    assert sorted(row.ids) == sorted(ids_of("a b c") + [1])


def plain_best_fit(lengths, max_tokens, max_docs, max_attention, weights, score):
    """Bins as lists; every open bin is tried for every piece."""
    bins, out = [], []
    for size in lengths:
        best = None
        for k, own in enumerate(bins):
            left = (max_tokens - sum(own), max_docs - len(own), max_attention - sum(x * x for x in own))
            if left[0] < size or left[1] < 1 or left[2] < size * size:
                continue
            full, need = (max_tokens, max_docs, max_attention), (size, 1, size * size)
            if score == "dot":
                value = -sum(w * (a / f) * (b / f) for w, a, b, f in zip(weights, left, need, full))
            else:
                value = sum(w * ((a - b) / f) ** 2 for w, a, b, f in zip(weights, left, need, full))
            if best is None or value < best[0] - 1e-12:
                best = (value, k)
        if best is None:
            bins.append([])
            best = (0, len(bins) - 1)
        out.append((best[1], sum(bins[best[1]])))
        bins[best[1]].append(size)
    return out


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize(("max_docs", "max_attention"), [(99, 10_000.0), (3, 10_000.0), (99, 3_000.0), (4, 4_000.0)])
def test_vector_best_fit_equals_plain_loops_under_each_constraint(score, max_docs, max_attention):
    rng = random.Random(max_docs)
    lengths = sorted((rng.randint(1, 50) for _ in range(200)), reverse=True)
    bins, offsets = best_fit(np.array(lengths), 100, max_docs, max_attention, (1.0, 0.1, 0.1), score)
    assert list(zip(bins.tolist(), offsets.tolist())) == plain_best_fit(lengths, 100, max_docs, max_attention, (1.0, 0.1, 0.1), score)


def test_documents_bind_where_texts_are_tiny_and_names_may_clash(spark):
    rows = [(i if i % 2 else None, "a b", "en", "s", 1) for i in range(1200)]
    df = documents(spark, rows).selectExpr("*", "1 AS piece", "2 AS length", "'x' AS used", "3 AS sequence_id")
    got = pack_documents(df, path).collect()
    assert len(got) == 1200
    per = Counter(r.sequence_id for r in got)
    assert max(per.values()) == 256 and len(per) == 5
    assert pack_documents(df.limit(0), path).count() == 0
