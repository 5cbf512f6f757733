"""The passes, keys, validation and comparison as tables over nodes, for collections of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.functions.exprs import GAMMA
from schemaloom.operators import monoids as M
from schemaloom.params import CLUSTER_DISTANCE, KEY_LENGTH_PENALTY


def dynamic_paths(nodes: DataFrame, least: float = 1.0) -> DataFrame:
    """(path, entropy, is_dynamic): objects whose keys come and go, with values of one type."""
    types = nodes.where(F.col("key").isNotNull()).groupBy(F.col("parent").alias("path")).agg(F.size(F.collect_set("type")).alias("types"))
    p = M.key_presence(nodes).groupBy("path").agg(F.sum(-F.col("presence") * F.log("presence")).alias("entropy"))
    return p.join(types, "path").select("path", "entropy", ((F.col("types") == 1) & (F.col("entropy") > least)).alias("is_dynamic"))


def similar_objects(nodes: DataFrame, distance: float = CLUSTER_DISTANCE) -> DataFrame:
    """(a, b, similarity) of object paths that share keys: fuzzy Jaccard of their presences. Joins schema rows, not data."""
    p = M.key_presence(nodes).select("path", "key", "presence")
    size = p.groupBy("path").agg(F.sum("presence").alias("size"))
    both = p.select(F.col("path").alias("a"), "key", F.col("presence").alias("x")).join(p.select(F.col("path").alias("b"), "key", F.col("presence").alias("y")), "key").where("a < b")
    shared = both.groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("low"))
    out = shared.join(size.select(F.col("path").alias("a"), F.col("size").alias("p")), "a").join(size.select(F.col("path").alias("b"), F.col("size").alias("q")), "b")
    return out.withColumn("similarity", F.col("low") / (F.col("p") + F.col("q") - F.col("low"))).select("a", "b", "similarity", (1 - F.col("similarity") <= distance).alias("alike"))


# --- keys ---

#: How the names of keys begin or end.
KEY_WORDS = ("id", "key", "nr", "no", "pk", "num", "code")


def key_scores(nodes: DataFrame, exact: bool = True) -> DataFrame:
    """(path, score) of leaf paths with a distinct value for each document."""
    leaves = nodes.where("type IN ('integer', 'number', 'string') AND key IS NOT NULL")
    facts = leaves.groupBy("path", "type").agg(F.max("depth").alias("depth"), F.max(F.lower("key")).alias("key"), F.max(F.length("s")).alias("longest"), F.count("*").alias("n"), F.count_if(F.col("s").rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")).alias("uuids"))
    distinct = (M.distinct_counts if exact else M.approx_distinct)(leaves).select("path", "type", "distinct_values")
    total = nodes.where("depth = 0").count()
    named = F.lit(False)
    for w in KEY_WORDS:
        named = named | F.col("key").startswith(w) | F.col("key").endswith(w)
    slack = F.lit(1.0) if exact else F.lit(1.03)
    length = F.when(F.col("uuids") == F.col("n"), 0).otherwise(F.coalesce("longest", F.lit(0)))
    score = F.when(named, 1.0).otherwise(0.0) + 1 / (F.col("depth") + 1) + F.when(F.col("type").isin("integer", "string"), 1.0).otherwise(0.0) + 1 / F.greatest(F.lit(1.0), (length - KEY_LENGTH_PENALTY).cast("double"))
    found = facts.join(distinct, ["path", "type"]).where(F.col("distinct_values") * slack >= total)
    return found.select("path", score.alias("score"))


def primary_keys(nodes: DataFrame) -> DataFrame:
    """Paths before the largest drop of the score (the first such drop). The scores are as many as the schema's leaves."""
    s = key_scores(nodes)
    order = W.orderBy(F.desc("score"), "path")  # schema rows only
    ranked = s.select("path", "score", F.row_number().over(order).alias("rank"), (F.lead("score").over(order) - F.col("score")).alias("drop"))
    cliff = ranked.where(F.col("drop").isNotNull()).agg(F.min_by("rank", F.struct("drop", "rank")).alias("cliff")).first().cliff
    return (ranked if cliff is None else ranked.where(F.col("rank") <= cliff)).select("path", "score")


def foreign_keys(nodes: DataFrame) -> DataFrame:
    """(source, target): every value at source occurs at target, of the same type.

    Values meet once: for each value the set of paths that hold it (as many as the schema's leaves), and for each source
    and set the count. A self-join of values isn't needed.
    """
    values = M.value_sets(nodes.where("key IS NOT NULL OR path LIKE '%]'"))
    where = values.groupBy("type", "value").agg(F.array_sort(F.collect_set("path")).alias("paths")).groupBy("type", "paths").agg(F.count("*").alias("n"))
    own = where.select("type", "paths", "n", F.explode("paths").alias("source"))
    size = own.groupBy("type", "source").agg(F.sum("n").alias("size"))
    pairs = own.select("type", "source", "n", F.explode("paths").alias("target")).where("source <> target").groupBy("type", "source", "target").agg(F.sum("n").alias("shared"))
    return pairs.join(size, ["type", "source"]).where("shared = size").select("source", "target")


# --- validation of nodes against a property table ---


def validate_nodes(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, path, message, level) of nodes that the nodes ``known`` don't admit.

    Bounds of ``known`` are aggregated to one row per path and type, a table of the schema's size, and broadcast.
    """
    facts = known.groupBy("path", "type").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min(F.length("s")).alias("short"), F.max(F.length("s")).alias("long"), F.min("n").alias("few"), F.max("n").alias("many"))
    types = facts.groupBy("path").agg(F.collect_set("type").alias("types"))
    required = M.required_keys(known).groupBy("path").agg(F.collect_list("key").alias("required")).withColumn("type", F.lit("object"))
    needs = M.dependencies(known).groupBy("path").agg(F.collect_list(F.struct("key", "needs")).alias("needs")).withColumn("type", F.lit("object"))
    seen = nodes.join(F.broadcast(types), "path", "left")
    for of_schema_size in (facts, required, needs):
        seen = seen.join(F.broadcast(of_schema_size), ["path", "type"], "left")
    admitted = F.array_contains("types", F.col("type")) | ((F.col("type") == "integer") & F.array_contains("types", F.lit("number")))
    size = F.length("s")
    rules = [
        (F.col("types").isNull() & F.col("key").isNotNull(), "unknown field", "fatal"),
        (F.col("types").isNotNull() & ~admitted, "wrong type", "fatal"),
        (F.col("d") < F.col("lo"), "below minimum", "warning"),
        (F.col("d") > F.col("hi"), "above maximum", "warning"),
        (size < F.col("short"), "too short", "warning"),
        (size > F.col("long"), "too long", "warning"),
        ((F.col("type") == "array") & (F.col("n") < F.col("few")), "too few items", "warning"),
        ((F.col("type") == "array") & (F.col("n") > F.col("many")), "too many items", "warning"),
    ]
    found = F.filter(F.array(*(F.when(c, F.struct("path", F.lit(m).alias("message"), F.lit(level).alias("level"))) for c, m, level in rules)), lambda x: x.isNotNull())
    fatal = lambda key, message: F.struct(F.concat("path", F.lit("."), key).alias("path"), F.lit(message).alias("message"), F.lit("fatal").alias("level"))
    # An object's keys stand in its row, so no key is joined to its object.
    missing = F.transform(F.array_except("required", "keys"), lambda key: fatal(key, "missing required field"))
    unmet = F.transform(F.filter("needs", lambda x: F.array_contains("keys", x["key"]) & ~F.array_contains("keys", x["needs"])), lambda x: fatal(x["needs"], "unmet dependency"))
    none = F.array().cast("array<struct<path: string, message: string, level: string>>")
    all_ = F.concat(found, F.coalesce(missing, none), F.coalesce(unmet, none))
    return seen.select("doc_id", F.explode(all_).alias("a")).select("doc_id", "a.path", "a.message", "a.level")


def verdicts(anomalies: DataFrame) -> DataFrame:
    """(doc_id, level): the worst level of each document that has anomalies."""
    rank = F.when(F.col("level") == "fatal", 3).when(F.col("level") == "warning", 2).otherwise(1)
    worst = anomalies.groupBy("doc_id").agg(F.max(rank).alias("w"))
    return worst.select("doc_id", F.when(F.col("w") == 3, "fatal").when(F.col("w") == 2, "warning").otherwise("info").alias("level"))


def outside_histogram(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Numbers outside the outermost bins of ``known``: (doc_id, path, value)."""
    bins = M.number_bins(known)
    high = F.when(F.col("sign") == 0, 0.0).when(F.col("sign") > 0, F.pow(F.lit(GAMMA), F.col("bin"))).otherwise(-F.pow(F.lit(GAMMA), F.col("bin") - 1))
    low = F.when(F.col("sign") == 0, 0.0).when(F.col("sign") > 0, F.pow(F.lit(GAMMA), F.col("bin") - 1)).otherwise(-F.pow(F.lit(GAMMA), F.col("bin")))
    edges = bins.groupBy("path").agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    return M.numeric(nodes).join(F.broadcast(edges), "path").where((F.col("d") < F.col("lo") - 1e-9) | (F.col("d") > F.col("hi") * (1 + 1e-9))).select("doc_id", "path", F.col("d").alias("value"))


# --- comparison and splits ---


def bounds_of(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("path", "type").agg(F.min("d").alias("minimum"), F.max("d").alias("maximum"), F.min(F.length("s")).cast("double").alias("min_length"), F.max(F.length("s")).cast("double").alias("max_length"), F.min("n").cast("double").alias("min_items"), F.max("n").cast("double").alias("max_items"))


def incompatibilities(own: DataFrame, other: DataFrame) -> DataFrame:
    """(path, property): why the schema of nodes ``own`` doesn't cover that of ``other``. Compares two tables of schema size."""
    a, b = bounds_of(own), bounds_of(other)
    pair = b.alias("b").join(a.alias("a"), ["path", "type"], "left")
    checks = [F.when(F.col("a.minimum").isNull() & F.col("b.minimum").isNotNull() & F.col("a.maximum").isNull(), F.lit("type"))]
    known = own.select("path", "type").distinct().withColumn("known", F.lit(True))
    pair = pair.join(known, ["path", "type"], "left")
    checks = [F.when(F.col("known").isNull(), F.lit("type"))]
    for name in ("minimum", "min_length", "min_items"):
        checks.append(F.when(F.col(f"b.{name}") < F.col(f"a.{name}"), F.lit(name)))
    for name in ("maximum", "max_length", "max_items"):
        checks.append(F.when(F.col(f"b.{name}") > F.col(f"a.{name}"), F.lit(name)))
    flat = pair.select("path", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("property"))
    mine, theirs = M.required_keys(own), M.required_keys(other)
    lost = mine.join(theirs, ["path", "key"], "left_anti").join(other.where("type = 'object'").select("path").distinct(), "path", "left_semi")
    return flat.unionByName(lost.select("path", F.lit("required").alias("property"))).distinct()


def split_documents(docs: DataFrame, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test documents: by a hash of the id, so that a rerun or a lost executor changes nothing."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10_000))
    return docs.where(place < int(fraction * 10_000)), docs.where(place >= int(fraction * 10_000))


# --- value table ---


def value_table(nodes: DataFrame, k: int = 100, seed: int = 42) -> DataFrame:
    """(path, position, value): examples of each leaf path in order, in long form."""
    own = M.examples(nodes, k, seed)
    return own.select("path", F.row_number().over(W.partitionBy("path").orderBy("value")).alias("position"), "value")  # at most k rows and types per path
