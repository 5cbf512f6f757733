"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Each text is measured once. The measures, as whole numbers per thousand, go into sketches per language and source: counts
by value, of which only the 7 leading bits are kept (so a quantile is off by under 1 in 64). Such sketches merge by
adding counts, to those of languages and of the whole corpus. A measure's cutoff is a fence: some spreads (the 90th
percentile less the median) above the median, plus a slack, as a short text has few lines and words to be measured by.
A group's cutoff is drawn towards its language's, and that towards the corpus's, as if ``prior`` documents of the larger group
were in the smaller one; so there is no least size of a group. Documents are joined to their group's cutoffs; those that
fail a base rule or pass a cutoff go.

Defined cases: a null text has no words and fails the base rule; null languages and sources are groups of their own;
texts of any length are measured whole; a text at a cutoff (a tie) stays; repeated rows count and are returned as often as
they occur; an empty table gives an empty one; null ids are kept; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import BLANK_CLASS, broadcast_if_small, materialise, trimmed

WINDOW = 8
#: measure: (spreads above the median, slack per thousand)
FENCES = {"symbols": (8, 50), "dup_lines": (8, 350), "repeats": (8, 150), "word_length": (4, 300)}
HIGH = 90
PRIOR = 25


def _tail(a: Column, start: int) -> Column:
    """a without its first start items; a's first items that pair with them are _head."""
    return F.slice(a, start + 1, F.greatest(F.size(a) - start, F.lit(0)))


def _head(a: Column, less: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - less, F.lit(0)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the base counts of each row. Arrays stay within their row; nothing is exploded."""
    t = docs.select(F.col(id_col).alias("doc_id"), "lang", "source", F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumn("s", trimmed(F.col("t")))
    t = t.select("doc_id", "lang", "source", "t", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", BLANK_CLASS + "+")).alias("w"), F.filter(F.split("t", "\n"), lambda x: trimmed(x) != "").alias("lines"))
    t = t.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # Hashes of windows of 2, 4 and 8 words, each from two of the size before.
    for size in (1, 2, 4):
        t = t.withColumn("h", F.zip_with(_head(F.col("h"), size), _tail(F.col("h"), size), lambda a, b: F.xxhash64(a, b)))
    t = t.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    t = t.withColumn("sorted", F.when(F.col("again"), F.sort_array(F.zip_with("h", F.sequence(F.lit(1), F.size("h")), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
    t = t.withColumn("equal", F.when(F.col("again"), F.zip_with(_head(F.col("sorted"), 1), _tail(F.col("sorted"), 1), lambda a, b: a["h"] == b["h"])))
    no = F.array(F.lit(False))
    t = t.withColumn("either", F.when(F.col("again"), F.zip_with(F.concat(no, "equal"), F.concat("equal", no), lambda a, b: a | b)))
    t = t.withColumn("at", F.when(F.col("again"), F.sort_array(F.filter(F.zip_with("sorted", "either", lambda a, b: F.when(b, a["p"])), lambda p: p.isNotNull()))))
    t = t.withColumn("steps", F.when(F.col("again"), F.zip_with(_head(F.col("at"), 1), _tail(F.col("at"), 1), lambda a, b: F.least(F.lit(WINDOW), b - a))))
    repeat = F.when(F.col("again"), F.aggregate("steps", F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(0)
    return t.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeat.cast("long").alias("n_repeat_words"))


def permille(m: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000 DIV {b}")).otherwise(0)
    return m.withColumns({"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")})


def sketch_key(v: Column) -> Column:
    """v with its 7 leading bits only."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.expr("1L") * F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(m: DataFrame) -> DataFrame:
    """(lang, source, measure, v, n): mergeable, at most some hundred rows for each group and measure."""
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).cast("long").alias("v")) for k in FENCES))
    return m.select("lang", "source", F.explode(pairs).alias("x")).select("lang", "source", "x.measure", sketch_key(F.col("x.v")).alias("v")).groupBy("lang", "source", "measure", "v").agg(F.count("*").alias("n"))


def cutoffs(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group with a cutoff column per measure, and the group's size. Quantiles by one aggregation per level."""
    own = sketch.groupBy(*groups, "measure", "v").agg(F.sum("n").alias("n"))
    runs = own.groupBy(*groups, "measure").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("r"), F.sum("n").alias("total"))  # the sketch: of bounded size

    def quantile(hundredths: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("q"))
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["q"].isNull() & ((acc["seen"] + x["n"]) * 100 >= F.col("total") * hundredths), x["v"]).otherwise(acc["q"]).alias("q"))
        return F.aggregate("r", start, step, lambda acc: acc["q"])

    q = runs.select(*groups, "measure", "total", quantile(50).alias("mid"), quantile(HIGH).alias("high"))
    fence = F.coalesce(*(F.when(F.col("measure") == k, F.col("mid") + spreads * (F.col("high") - F.col("mid")) + slack) for k, (spreads, slack) in FENCES.items()))
    return q.groupBy(*groups).agg(F.max("total").alias("size"), *(F.max(F.when(F.col("measure") == k, fence)).alias(f"max_{k}") for k in FENCES))


def judge(docs: DataFrame, prior: int = PRIOR, max_broadcast: int = 100_000) -> DataFrame:
    """The measures of each row with base_failed and kept."""
    m = permille(materialise(measured(docs), "measures"))
    sketch = materialise(sketches(m), "sketches")
    names = [f"max_{k}" for k in FENCES]
    fine, coarse, all_ = cutoffs(sketch, ["lang", "source"]), cutoffs(sketch, ["lang"]), cutoffs(sketch, [])
    whole = all_.first()  # one row, or none of an empty table
    drawn = lambda own, to: F.call_function("div", F.col("size") * own + F.lit(prior) * to, F.col("size") + F.lit(prior))
    coarse = coarse.select(F.col("lang").alias("_lang"), *(drawn(F.col(n), F.lit(whole[n] if whole else 0).cast("long")).alias(f"c_{n}") for n in names))
    groups = fine.join(broadcast_if_small(materialise(coarse, "languages"), max_broadcast), F.col("lang").eqNullSafe(F.col("_lang")))
    groups = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *(drawn(F.col(n), F.col(f"c_{n}")).alias(n) for n in names))
    groups = broadcast_if_small(materialise(groups, "cutoffs"), max_broadcast)
    judged = m.join(groups, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.lit(True)
    for k in FENCES:
        within = within & (F.col(k) <= F.col(f"max_{k}"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)


def oracle_sql(prior: int = PRIOR) -> str:
    blank = r"[^\x20\x09-\x0D]+"
    trimmed_ = "trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    drop = "greatest(length(bin(v)) - 7, 0)"

    def cut(groups: list[str], name: str) -> str:
        g = ", ".join(groups) + (", " if groups else "")
        part = "PARTITION BY " + ", ".join([*groups, "measure"])
        fences = " ".join(f"WHEN '{k}' THEN mid + {a} * (high - mid) + {b}" for k, (a, b) in FENCES.items())
        return f"""{name}_runs AS (SELECT {g}measure, v, sum(sum(n)) OVER ({part} ORDER BY v) AS seen, sum(sum(n)) OVER ({part}) AS total FROM sketch GROUP BY {g}measure, v),
{name}_q AS (SELECT {g}measure, any_value(total) AS total, min(CASE WHEN seen * 100 >= total * 50 THEN v END) AS mid, min(CASE WHEN seen * 100 >= total * {HIGH} THEN v END) AS high FROM {name}_runs GROUP BY {g}measure),
{name} AS (SELECT {g}max(total) AS size, {', '.join(f"max(CASE WHEN measure = '{k}' THEN (CASE measure {fences} END) END) AS max_{k}" for k in FENCES)} FROM {name}_q {'GROUP BY ' + ', '.join(groups) if groups else ''})"""

    names = [f"max_{k}" for k in FENCES]
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{blank}') AS w, list_filter(string_split(t, chr(10)), lambda x: {trimmed_} <> '') AS lines FROM docs),
starts AS (SELECT r, unnest(range(1, len(w) - 6)) AS p, w FROM words WHERE len(w) >= {WINDOW}),
windows AS (SELECT r, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g FROM starts),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - p, {WINDOW})))::BIGINT AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM twice) GROUP BY r),
m0 AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM words),
m AS (SELECT m0.*, coalesce(n, 0)::BIGINT AS n_repeat_words, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
  CASE WHEN n_words > 0 THEN coalesce(n, 0)::BIGINT * 1000 // n_words ELSE 0 END AS repeats, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length FROM m0 LEFT JOIN covered USING (r)),
long AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS measure, {k} AS v FROM m" for k in FENCES)}),
sketch AS (SELECT lang, source, measure, (v >> {drop}) << {drop} AS v, count(*) AS n FROM long GROUP BY lang, source, measure, 4),
{cut(['lang', 'source'], 'fine')},
{cut(['lang'], 'coarse')},
{cut([], 'whole')},
languages AS (SELECT c.lang, {', '.join(f'((c.size * c.{n} + {prior} * a.{n}) // (c.size + {prior}))::BIGINT AS {n}' for n in names)} FROM coarse c CROSS JOIN whole a),
drawn AS (SELECT f.lang, f.source, {', '.join(f'((f.size * f.{n} + {prior} * c.{n}) // (f.size + {prior}))::BIGINT AS {n}' for n in names)} FROM fine f JOIN languages c ON c.lang IS NOT DISTINCT FROM f.lang),
judged AS (SELECT m.*, {', '.join(f'd.{n}' for n in names)} FROM m JOIN drawn d ON m.lang IS NOT DISTINCT FROM d.lang AND m.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(f'{k} <= max_{k}' for k in FENCES)} AS kept FROM judged
"""
