import hashlib
import random
import re

from helpers import awkward, documents, prose

from schemaloom.llm.pii import digests, em, learn, candidates, personal_data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m[0])]


TEXTS = [
    "mail a.b@c.de or x@y.z_q@w.e. and é😀 u@v.co", "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 9.9.9.9", "card 4111 1111 1111 1111 and 4111111111111112 4111-1111-1111-1111-1",
    "call +1 (555) 010-9999 or +49 30 1234567 +1 2 +12345678901234567", "(555) 010-9999 tel: 555-010-9999, me [at] host [dot] com, 2001:0db8:0:0:0:0:0:1", "1" * 3000 + " " + "a" * 5000 + "@", "+" * 50 + "1" + "-" * 400, "0.0.0.0" * 3, "@@a@b.c@d.e.f..g", None, "", "tel 4000 0000 0000 0000 card",
]


def rows():
    return [(i, t, "en", "s", None) for i, t in enumerate(TEXTS)] + [(100 + i, *r[1:]) for i, r in enumerate(awkward())] + [(None, TEXTS[0], None, None, None)]


def test_base_spans_equal_plain_patterns(spark):
    want = {r[0]: brute(r[1]) for r in rows()}
    got = digests(personal_data(documents(spark, rows()))).collect()
    assert len(got) == len(rows())
    for r in got:
        own = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest(), (r.doc_id, r.spans, own)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in own) for k in BASE]
        assert set(own) <= set(r.spans.split(",")) | {""}


def test_votes_add_spans_and_em_ranks_labelers(spark):
    rows = [(i, f"tel: (555) 010-{1000 + i} and call +1 555 010 {1000 + i}", "en", "s", 1) for i in range(30)]
    got = digests(personal_data(documents(spark, rows))).collect()
    assert all(r.n_phone == 1 and r.spans.count("phone") == 2 for r in got)
    prior, rates = em({(1, 1, 1, 1): 60, (0, 0, 2, 0): 30, (1, 1, 2, 1): 10})
    assert 0.5 < prior < 0.9 and rates[0][0][1] > rates[0][1][1]
    assert set(learn(candidates(documents(spark, []))).prior) == {"email", "ip", "card", "phone", "secret"}
    assert personal_data(documents(spark, [])).count() == 0


def test_added_spans_stand_apart_and_votes_decide_them(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    rows = [(i, f'so token = "{h}" and {prose(rng, 8)}', "en", "s", 1) for i, h in enumerate(hexes)]
    rows += [(100 + i, f"see https://x.example/a_long_path_of_words_{i}/and-more-of-the-same and commit {h}", "en", "s", 1) for i, h in enumerate(hexes)]
    rows += [(200 + i, f"card 4111 1111 1111 111{i % 10} or 4000 0000 0000 0000 order 1234 5678 9012 3456", "en", "s", 1) for i in range(30)]
    got = {r.doc_id: r for r in digests(personal_data(documents(spark, rows))).collect()}
    for r in got.values():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert len(spans) == r.n_spans and len({tuple(s) for s in spans}) == len(spans)
        for kind, a, b in spans:
            assert not any(k == kind and int(x) < int(b) and int(a) < int(y) for k, x, y in spans if (k, x, y) != (kind, a, b))
    assert all(got[i].spans == f"secret:{rows[i][1].index(hexes[i])}:{rows[i][1].index(hexes[i]) + 40}" for i in range(40))
    assert not any("secret" in got[100 + i].spans for i in range(40))


def test_positions_in_texts_of_many_matches(spark):
    text = " ".join(f"a{i}@b.cc 1.2.3.{i % 300} +4930{i:06d} é" for i in range(3000))
    own = brute(text)
    got = digests(personal_data(documents(spark, [(1, text, "en", "s", 1)]).selectExpr("*", "1 AS spans", "2 AS kind", "3 AS sums"))).collect()[0]
    assert len(own) > 7000 and got.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
