import random

import numpy as np
import xxhash
from helpers import awkward, documents

from schemaloom.llm.simhash import components, fingerprint, forest, keep_one, links, near_groups, signed, similar_groups, similar_links, wide_fingerprint


def plain(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(rows, bits):
    """doc ids to the least id reachable, by union of all pairs."""
    fps = [plain(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, *_) in enumerate(rows)), key=str)


def test_groups_equal_brute_force(spark):
    got = near_groups(documents(spark)).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == grouped(awkward(), 2)
    assert all(fingerprint(t) == plain(t) for _, t, *_ in awkward())


def test_no_link_is_lost_in_crowded_keys(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = []
    for hot in (4, 10_000):
        roots.append({r.node: r.root for r in components(links(df, 2, 2, hot=hot)).collect()})
    assert roots[0] == roots[1]
    linked = {signed(a) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert set(roots[0]) == linked


def test_crowds_of_three_bits_need_no_wildcards_of_all_bits(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(20)})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                linked |= {a, b}
                x, y = sorted((find(a), find(b)), key=signed)
                root[y] = x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for hot, block in ((2, 8), (4, 4096), (40, 4096)):
        found = links(df, 3, 2, hot=hot, block=block)
        assert len(found._jdf.queryExecution().toString()) < 200_000  # the plan, which the driver keeps
        assert {r.node % (1 << 64): r.root % (1 << 64) for r in components(found).collect()} == {f: find(f) for f in linked}


def test_tables_that_grow_are_not_sent_to_the_driver(spark):
    for got in (near_groups(documents(spark)), similar_groups(documents(spark)), keep_one(documents(spark))):
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    random.Random(2).shuffle(ids)
    got = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    assert {r.node for r in got} == set(ids) and {r.root for r in got} == {0} and len(got) == 60


def test_keep_one_and_empty_table(spark):
    kept = keep_one(documents(spark)).collect()
    ids = [r.doc_id for r in kept]
    assert sum(i is None for i in ids) == 2 and len({i for i in ids if i is not None}) == len(ids) - 2
    assert keep_one(documents(spark)).columns == documents(spark).columns
    assert near_groups(documents(spark, [])).count() == 0


def edited(rng, words, share):
    return [f"new{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_meet_and_others_do_not(spark):
    rng = random.Random(4)
    texts, pairs = [], []
    for _ in range(60):
        base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
        other = edited(rng, base, 0.012)
        pairs.append((len(texts), len(texts) + 1, jaccard(base, other)))
        texts += [base, other]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, " ", None, None, None)]
    group = {r.doc_id: r.component_id for r in similar_groups(documents(spark, rows)).collect()}
    close = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(close) > 40 and sum(group[a] == group[b] for a, b in close) >= 0.9 * len(close)
    assert all(group[a] == a and group[b] in (a, b) for a, b, _ in pairs)
    assert group[500] == group[501] == 500


def test_forest_joins_what_edges_join():
    rng = random.Random(6)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]
    a, b = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        root[max(find(x), find(y))] = min(find(x), find(y))
    assert {(int(x), int(y)) for x, y in zip(a, b)} == {(x, find(x)) for x in root if find(x) != x}


def test_wide_fingerprint_begins_with_the_plain_one():
    assert all(int(wide_fingerprint(t, 3)[0]) == fingerprint(t) for _, t, *_ in awkward())


def test_crowded_bands_compare_all_pairs(spark):
    """Each row's partner lies further off, in the order of fingerprints, than the window; all share one band."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = [rng.getrandbits(64) & ~0xFFFF, *(rng.getrandbits(64) for _ in range(3))]
        other = [base[0] ^ 1 << 63, *(w ^ sum(1 << 16 * j for j in range(4)) for w in base[1:])]
        other[0] ^= sum(1 << 16 * j for j in (1, 2))
        rows += [(i, *map(signed, base)), (1000 + i, *map(signed, other))]
    crowd = [rng.getrandbits(64) & ~0xFFFF, *(rng.getrandbits(64) for _ in range(3))]
    rows += [(2000 + i, signed(crowd[0] ^ 1 << 16 + i % 48), signed(crowd[1] ^ 1 << i // 48), *map(signed, crowd[2:])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, w0 long, w1 long, w2 long, w3 long")
    for window in (8, 4096):
        root = {r.node: r.root for r in components(similar_links(df, 20, window)).collect()}
        assert root == {**{i: i for i in range(60)}, **{1000 + i: i for i in range(60)}, **{2000 + i: 2000 for i in range(200)}}


def test_links_equal_brute_force_around_the_similarity(spark):
    rng = random.Random(9)
    texts = []
    for share in (0.01, 0.02, 0.025, 0.03, 0.04):
        for _ in range(40):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 300))]
            texts += [base, edited(rng, base, share)]
    passage = [f"p{k}" for k in range(150)]
    texts += [passage + [f"own{i}x{k}" for k in range(30 + i % 30)] for i in range(60)]  # a crowd about the similarity
    texts += [edited(rng, passage, 0.01) for _ in range(60)] + [["short", "text"], ["short", "text"], ["short"]]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    df = documents(spark, [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)])
    for block in (16, 4096):
        assert {r.doc_id: r.component_id for r in similar_groups(df, block=block).collect()} == dict(enumerate(root))
