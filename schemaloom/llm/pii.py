"""Personal data by weak supervision. DataFrame and SQL functions only; Python sees bounded tables of counts on the driver.

Candidates are spans that a kind's strict or loose pattern finds. Labelers vote on each: the strict pattern with its
check (parts, checksum, digits), a gazetteer (top-level domains, card issuers, reserved address blocks, calling codes),
the context before the span (words such as "mail", "tel", "card") and the shape. A vote is for, against or none.
Expectation-maximisation over the counts of vote patterns - a table of bounded size, whatever the corpus - estimates each
labeler's reliability per kind, and from the posteriors a logistic span classifier is trained, whose features are the
votes and the shape. Spans that pass the strict pattern always stay; others are added if the classifier accepts them.
Credentials (kind "secret") have no strict pattern, so that the votes alone find them; they come after the other kinds.

Strict patterns match leftmost and don't overlap, within a kind; a match that fails its check is dropped, without retries.
No two spans of a kind overlap: a loose match gives way to an accepted strict one. Defined cases: null text is empty text;
without candidates nothing is added; repeated rows are judged alike; a text of any length is searched whole, and positions
are summed up in blocks; ties (a span that both patterns find) are one span; an empty table gives an empty one; a
null id is kept; spans count code points; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

#: Strict patterns. Possessive, and begun only where a run begins or the last match ended, so that long runs take linear
#: time; they match what the plain patterns of the contract match.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose patterns, of candidates that only the votes can judge.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+",
}
#: A cheap test without which neither pattern can match.
HINT = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]|[0-9][\x20.-][0-9]", "secret": r"[A-Za-z0-9_/+-]{20}"}
#: Words before a span that speak for its kind, words that speak against it, and top-level domains.
CONTEXT = {"email": r"mail|contact|write|from:|to:", "ip": r"\bip\b|host|server|address|ping", "card": r"card|visa|master|credit|pay", "phone": r"tel|phone|call|fax|mobile|cell", "secret": r"(?:token|secret|passw|pwd|key|auth|credential)[a-z_]*[\"']?\s*(?:[:=]|is)\s*[\"']?$"}
OTHER_CONTEXT = {"email": r"/[^ ]*$", "ip": r"(?:version|release|section|chapter|v\.?) ?$", "card": r"isbn|order|invoice|serial|version|ref(?:erence|\.)", "phone": r"isbn|order|invoice|serial|version|ref(?:erence|\.)", "secret": r"https?:[^ ]*$|(?:commit|sha|hash|digest|checksum|md5)[a-z0-9]*[:= ]*$"}
DOMAINS = r"(?i)(?:\.|[\[(]dot[\])]) ?(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|us|eu|ch|at|it|nl|ca|au|jp|cn|in|br|ru)$"
LABELERS = ("strict", "gazetteer", "context", "shape")
LEFT = 24  #: code points of context
BLOCK = 256  #: matches of which positions are summed up at once


def luhn(digits: Column) -> Column:
    chars = F.reverse(F.split(digits, ""))
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def quad(s: Column) -> Column:
    """Whether all parts between dots are numbers of at most 255."""
    return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def passes(kind: str, s: Column) -> Column:
    n = F.length(digits_of(s))
    if kind == "email":
        return F.lit(True)
    if kind == "secret":
        return F.lit(False)
    if kind == "ip":
        return quad(s)
    if kind == "card":
        return (n >= 16) & (n <= 19) & luhn(digits_of(s))
    return (n >= 8) & (n <= 15)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


def gazetteer(kind: str, s: Column) -> Column:
    d = digits_of(s)
    if kind == "email":
        return vote(s.rlike(DOMAINS), F.lit(False))
    if kind == "ip":
        return vote(s.rlike("(?i)^(?:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cde][0-9a-f]{2}):") | (quad(s) & ~s.rlike(r"^(?:0|127|255|22[4-9]|2[3-5][0-9])\.")), s.rlike(r"^(?:0|255)\.") | ~quad(s))
    if kind == "card":
        return vote(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), F.lit(True))
    if kind == "secret":
        return vote(s.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xox[abp]-|eyJ|AIza)"), s.rlike(r"^[A-Za-z]+$|/"))
    return vote(s.rlike(r"^\+(?:1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), F.lit(False))


def shape(kind: str, s: Column) -> Column:
    n = F.length(digits_of(s))
    if kind == "email":
        return vote(F.length(s) <= 64, F.length(s) > 254)
    if kind == "ip":
        return vote(quad(s) | s.contains(":"), F.lit(True))
    if kind == "card":
        return vote((n == 16) & luhn(digits_of(s)), F.lit(True))
    if kind == "secret":  # letters and digits mixed as chance mixes them; digests are so as well, so this speaks for nothing
        return vote(F.lit(False), ~s.rlike("[0-9][A-Za-z]+[0-9]+[A-Za-z]+[0-9]"))
    return vote(n.between(9, 13), (n < 8) | (n > 15))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of all candidates, one row per row of docs.

    Positions come from the lengths of what lies between matches. Each step is a projection of its own, so that no
    pattern runs twice over a text.
    """
    uses = [(kind, patterns[kind], patterns is STRICT) for kind in ALL_KINDS for patterns in (STRICT, LOOSE) if kind in patterns]
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    cut = []
    for k, (kind, pattern, _) in enumerate(uses):
        has = F.col("t").rlike(HINT[kind])
        cut.append(F.when(has, F.split("t", pattern, -1)).otherwise(F.array(F.lit(""))).alias(f"g{k}"))
        cut.append(F.when(has, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"h{k}"))
    t = t.select("doc_id", *cut)

    def pair(g: Column, h: Column) -> Column:
        return F.struct(F.length(g).alias("gap"), h.alias("s"), F.lower(F.right(g, F.lit(LEFT))).alias("left"))

    t = t.select("doc_id", *(F.zip_with(F.slice(f"g{k}", F.lit(1), F.size(f"h{k}")), f"h{k}", pair).alias(f"p{k}") for k in range(len(uses))))

    # Ends of matches: running sums of gaps and lengths, of all patterns in one array; within blocks, then over blocks.
    own = [f"p{k}" for k in range(len(uses))]

    def running(numbers: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x)).alias("all"))
        return F.aggregate(numbers, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])

    t = t.select("doc_id", *own, F.concat(*(F.transform(p, lambda x: x["gap"] + F.length(x["s"])) for p in own)).alias("sums"))
    numbers = F.filter(F.sequence(F.lit(0), F.floor(F.size("sums") / BLOCK).cast("int")), lambda b: b * BLOCK < F.size("sums"))
    t = t.select("doc_id", *own, F.transform(numbers, lambda b: running(F.slice("sums", b * BLOCK + 1, F.lit(BLOCK)))).alias("parts"))
    t = t.select("doc_id", *own, "parts", running(F.transform("parts", lambda x: F.element_at(x, -1))).alias("totals"))
    t = t.select("doc_id", *own, F.flatten(F.zip_with("parts", "totals", lambda x, total: F.transform(x, lambda y: y + total - F.element_at(x, -1)))).alias("sums"))
    done, before = F.lit(0), []
    for p in own:
        before.append(done)
        done = done + F.size(p)
    cut = lambda k: F.slice("sums", before[k] + 1, F.size(own[k]))
    since = lambda k: F.when(before[k] > 0, F.element_at("sums", F.greatest(before[k], F.lit(1)))).otherwise(0)

    def start_of(k: int):
        return lambda x, end: end - F.col(f"e{k}.from") - F.length(x["s"])

    t = t.select("doc_id", *own, *(F.struct(cut(k).alias("ends"), since(k).alias("from")).alias(f"e{k}") for k in range(len(uses))))
    t = t.select("doc_id", *own, *(F.zip_with(f"p{k}", f"e{k}.ends", start_of(k)).alias(f"s{k}") for k in range(len(uses))))

    def judge(kind: str, strict: bool):
        def judged(x: Column, start: Column) -> Column:
            s = x["s"]
            base = passes(kind, s) if strict else F.lit(False)
            votes = [F.when(base, 1).otherwise(0 if kind in STRICT else 2), gazetteer(kind, s), vote(x["left"].rlike(CONTEXT[kind]), x["left"].rlike(OTHER_CONTEXT[kind])), shape(kind, s)]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(s)).alias("end"), base.alias("base"), F.lit(not strict).alias("loose"), *(v.alias(name) for v, name in zip(votes, LABELERS, strict=True)))

        return judged

    return t.select("doc_id", F.concat(*(F.zip_with(f"p{k}", f"s{k}", judge(kind, strict)) for k, (kind, _, strict) in enumerate(uses))).alias("spans"))


@dataclass(frozen=True)
class Labels:
    """Per kind: the share of true spans, and per labeler and vote the chance of that vote for true and other spans."""

    prior: dict[str, float]
    rates: dict[str, list[tuple[list[float], list[float]]]]
    classifier: dict[str, list[float]]


Pattern = tuple[int, ...]


def posterior(prior: float, rates: list[tuple[list[float], list[float]]], votes: Pattern) -> float:
    a, b = math.log(prior), math.log(1 - prior)
    for (yes, no), v in zip(rates, votes, strict=True):
        a, b = a + math.log(yes[v]), b + math.log(no[v])
    return 1 / (1 + math.exp(max(-500, min(500, b - a))))


def em(counts: dict[Pattern, int], rounds: int = 50) -> tuple[float, list[tuple[list[float], list[float]]]]:
    """Reliabilities of labelers from counts of vote patterns (votes 0 against, 1 for, 2 none).

    It starts from the belief that labelers are better than chance, which weighs as much as half of the spans, so that few
    patterns can't turn a labeler's meaning around.
    """
    n = len(LABELERS)
    total = sum(counts.values())
    prior = 0.5
    belief = ([0.1, 0.65, 0.25], [0.65, 0.1, 0.25])
    rates, weight = [belief for _ in range(n)], 1 + total / 2
    for _ in range(rounds):
        p = {v: posterior(prior, rates, v) for v in counts}
        true = sum(p[v] * c for v, c in counts.items())
        prior = (true + weight / 2) / (total + weight)
        new = []
        for k in range(n):
            yes, no = ([weight * x for x in side] for side in belief)
            for v, c in counts.items():
                yes[v[k]] += p[v] * c
                no[v[k]] += (1 - p[v]) * c
            new.append(([x / sum(yes) for x in yes], [x / sum(no) for x in no]))
        rates = new
    return prior, rates


def features(votes: Pattern) -> list[float]:
    return [1.0, *(float(v == 1) for v in votes), *(float(v == 0) for v in votes)]


def fit_classifier(counts: dict[Pattern, int], p: dict[Pattern, float], rounds: int = 300, rate: float = 0.5, penalty: float = 0.01) -> list[float]:
    """Logistic regression on weighted vote patterns with the posteriors as soft labels."""
    w = [0.0] * (1 + 2 * len(LABELERS))
    total = sum(counts.values()) or 1
    for _ in range(rounds):
        g = [penalty * x for x in w]
        for v, c in counts.items():
            x = features(v)
            s = sum(a * b for a, b in zip(w, x, strict=True))
            e = (1 / (1 + math.exp(-max(-30, min(30, s)))) - p[v]) * c / total
            g = [a + e * b for a, b in zip(g, x, strict=True)]
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def learn(spans: DataFrame) -> Labels:
    """From candidates: the counts of vote patterns per kind (at most 5 x 3^4 rows), then EM and the classifier."""
    rows = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", *(f"s.{x}" for x in LABELERS)).agg(F.count("*").alias("n")).collect()
    counts: dict[str, dict[Pattern, int]] = {k: {} for k in ALL_KINDS}
    for r in sorted(rows):
        counts[r.kind][tuple(r[x] for x in LABELERS)] = r.n
    prior, rates, classifier = {}, {}, {}
    for k in ALL_KINDS:
        prior[k], rates[k] = em(counts[k])
        classifier[k] = fit_classifier(counts[k], {v: posterior(prior[k], rates[k], v) for v in counts[k]})
    return Labels(prior, rates, classifier)


def accepted(labels: Labels, span: Column, threshold: float = 0.5) -> Column:
    out = F.lit(False)
    for k in ALL_KINDS:
        bias, *rest = labels.classifier[k]
        score = F.lit(bias)
        for i, name in enumerate(LABELERS):
            score = score + F.when(span[name] == 1, rest[i]).when(span[name] == 0, rest[len(LABELERS) + i]).otherwise(0.0)
        out = F.when(span["kind"] == k, score >= math.log(threshold / (1 - threshold))).otherwise(out)
    return out


def place(span: Column) -> Column:
    order = F.coalesce(*(F.when(span["kind"] == k, i) for i, k in enumerate(ALL_KINDS)))
    return F.struct(order.alias("order"), span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.transform(spans, place)), lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of spans), one row per row of docs."""
    spans = materialise(candidates(docs, id_col, text_col), "candidates")
    labels = learn(spans)
    base = F.filter("spans", lambda s: s["base"])
    own = spans.select("doc_id", base.alias("base"), F.filter("spans", lambda s: ~s["base"] & accepted(labels, s)).alias("more"))
    strict, loose = F.filter("more", lambda s: ~s["loose"]), F.filter("more", lambda s: s["loose"])
    own = own.select("doc_id", "base", strict.alias("strict"), loose.alias("loose"), F.concat("base", strict).alias("ahead"))

    def apart(s: Column) -> Column:
        return ~F.exists("ahead", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return own.select("doc_id", "base", F.concat("strict", F.filter("loose", apart)).alias("added"))


def digests(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
