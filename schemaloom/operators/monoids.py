"""Facts about the values at each path, as aggregations of nodes. Every one merges, so partial aggregation does the work.

Functions take the nodes of plans.shred (and what else they need) and return small tables keyed by path and type.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.functions import membership
from schemaloom.functions.exprs import bin_of, common_prefix, format_of, formats, shown
from schemaloom.params import MAX_DEPENDENCY_KEYS, MIN_FORMAT_VALUES, MIN_PATTERN_VALUES


def lift(nodes: DataFrame, paths: list[str]) -> DataFrame:
    """Integers at paths that hold other numbers too count as numbers."""
    return nodes.withColumn("type", F.when((F.col("type") == "integer") & F.col("path").isin(paths), "number").otherwise(F.col("type"))) if paths else nodes


def path_types(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("path", "type").agg(F.count("*").alias("count"))


def type_products(nodes: DataFrame) -> DataFrame:
    """Paths with several kinds of value: (path, types, count)."""
    kinds = path_types(nodes).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"), F.sum("count").alias("count"), F.count("*").alias("n"))
    return kinds.where("n > 1").drop("n")


# --- objects ---


def key_presence(nodes: DataFrame) -> DataFrame:
    """(path, key, present, total, presence): in how many objects at path the key occurs (a null value counts)."""
    keys = nodes.where(F.col("key").isNotNull()).groupBy(F.col("parent").alias("path"), "key").agg(F.count("*").alias("present"))
    totals = nodes.where("type = 'object'").groupBy("path").agg(F.count("*").alias("total"))
    return keys.join(totals, "path").withColumn("presence", F.col("present") / F.col("total"))


def required_keys(nodes: DataFrame) -> DataFrame:
    return key_presence(nodes).where("present = total").select("path", "key")


def key_sets(nodes: DataFrame) -> DataFrame:
    """Objects with their sorted keys, which stand in the object's row; none where the keys became a map's while shredding."""
    return nodes.where("type = 'object'")


def key_pairs(nodes: DataFrame, max_keys: int = MAX_DEPENDENCY_KEYS) -> DataFrame:
    """(path, a, b, both) for a < b; paths where some object has more than max_keys keys are left out.

    Keys meet within their object (an array of max_keys at most), not by a self-join, and only counts of key sets move.
    """
    wide = nodes.where((F.col("type") == "object") & (F.col("n") > max_keys)).select(F.col("path").alias("parent")).distinct()
    own = key_sets(nodes).where((F.size("keys") > 0) & (F.col("n") <= max_keys))
    same = own.groupBy(F.col("path").alias("parent"), "keys").agg(F.count("*").alias("times")).join(wide, "parent", "left_anti")
    pairs = same.select("parent", "keys", "times", F.explode("keys").alias("a")).select("parent", "times", "a", F.explode(F.filter("keys", lambda k: k > F.col("a"))).alias("b"))
    return pairs.groupBy(F.col("parent").alias("path"), "a", "b").agg(F.sum("times").alias("both"))


def dependencies(nodes: DataFrame, everywhere: bool = False) -> DataFrame:
    """(path, key, needs): wherever key is, needs is too. Keys that are always there are left out unless ``everywhere``."""
    pairs = key_pairs(nodes)
    both = pairs.select("path", F.col("a").alias("key"), F.col("b").alias("needs"), "both").unionByName(pairs.select("path", F.col("b").alias("key"), F.col("a").alias("needs"), "both"))
    counts = key_presence(nodes)
    mine = counts.select("path", "key", F.col("present").alias("mine"), "total")
    theirs = counts.select("path", F.col("key").alias("needs"), F.col("present").alias("theirs"))
    found = both.join(mine, ["path", "key"]).join(theirs, ["path", "needs"]).where("mine = both")
    return (found if everywhere else found.where("both <> total AND theirs <> total")).select("path", "key", "needs")


# --- arrays ---


def array_bounds(nodes: DataFrame) -> DataFrame:
    a = nodes.where("type = 'array'").groupBy("path").agg(F.count("*").alias("count"), F.min("n").alias("min_items"), F.max("n").alias("max_items"))
    return a.withColumn("is_tuple", (F.col("min_items") == F.col("max_items")) & (F.col("max_items") > 0))


def bounds_of_kinds(spark: SparkSession, kinds: dict[tuple[str, str], tuple[int, int | None, int | None]]) -> DataFrame:
    """array_bounds of what shredding counted of all values on its way, so that nodes need no pass of their own."""
    rows = [(path, count, low, high, low == high and high > 0) for (path, type_), (count, low, high) in kinds.items() if type_ == "array"]
    return spark.createDataFrame(rows, "path string, count long, min_items long, max_items long, is_tuple boolean")


def unique_arrays(nodes: DataFrame, max_items: int = 100) -> DataFrame:
    """(path, is_unique): all arrays hold only numbers or only strings, without repeats, and some array has several items."""
    good = (F.col("n") == 0) | (F.col("unique") & (F.col("n") <= max_items))
    return nodes.where("type = 'array'").groupBy("path").agg((F.bool_and(good) & F.bool_or(F.col("n") > 1)).alias("is_unique"))


# --- numbers ---


def numeric(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("type").isin("integer", "number") & F.col("d").isNotNull())


def statistics_columns(d: Column) -> dict[str, Column]:
    return {"mean": F.avg(d), "variance": F.var_samp(d), "stdev": F.stddev_samp(d), "skewness": F.skewness(d), "kurtosis": F.kurtosis(d)}


def number_facts(nodes: DataFrame) -> DataFrame:
    own = numeric(nodes)
    return own.groupBy("path", "type").agg(F.count("*").alias("count"), F.min("d").alias("minimum"), F.max("d").alias("maximum"), *(c.alias(k) for k, c in statistics_columns(F.col("d")).items()))


def multiples(nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """(path, type, multiple): the greatest common divisor of the values at a path, by Euclid's algorithm over passes.

    A pass finds each path's least remainder of its values by the divisor so far; with a bounded state, so that a path of
    any number of values will do. Few passes are needed, as the remainder of many values is soon a small one.
    """
    spark = nodes.sparkSession
    values = numeric(nodes).where(F.col("m").isNotNull()).select("path", "type", F.abs("m").alias("v"))
    first = values.groupBy("path", "type").agg(F.min(F.when(F.col("v") > 0, F.col("v"))).alias("g"), F.bool_or(F.col("v") < 1e-10).alias("tiny")).collect()  # a row per path
    tiny = {(r.path, r.type) for r in first if r.tiny}
    divisors = {(r.path, r.type): r.g for r in first if r.g is not None and not (r.type == "number" and r.tiny)}
    schema = "path string, type string, g decimal(38,12)"
    open_ = dict(divisors)
    for _ in range(rounds):
        if not open_:
            break
        known = F.broadcast(spark.createDataFrame([(*k, v) for k, v in open_.items()], schema))
        left = values.join(known, ["path", "type"]).select("path", "type", (F.col("v") % F.col("g")).alias("r")).where("r <> 0")
        found = {(r.path, r.type): r.r for r in left.groupBy("path", "type").agg(F.min("r").alias("r")).collect()}
        open_ = {}
        for k, r in found.items():
            unit = Decimal(10) ** 12
            divisors[k] = open_[k] = Decimal(math.gcd(int(divisors[k] * unit), int(r * unit))) / unit
    rows = [(*k, v) for k, v in divisors.items() if (k[1] == "number" and k not in tiny) or v > 1]
    return spark.createDataFrame(rows, schema).withColumnRenamed("g", "multiple")


def bins(nodes: DataFrame, value: Column) -> DataFrame:
    """(path, type, sign, bin, count): a logarithmic histogram of 1 % relative error. Zeros have sign 0 and no bin."""
    own = nodes.select("path", "type", value.cast("double").alias("v")).where("v IS NOT NULL")
    return own.groupBy("path", "type", F.signum("v").cast("int").alias("sign"), bin_of(F.col("v")).alias("bin")).agg(F.count("*").alias("count"))


def number_bins(nodes: DataFrame) -> DataFrame:
    return bins(numeric(nodes), F.col("d"))


def length_bins(nodes: DataFrame) -> DataFrame:
    return bins(nodes.where("type IN ('string', 'array')"), F.when(F.col("type") == "string", F.length("s")).otherwise(F.col("n")))


# --- values ---


def scalar(nodes: DataFrame) -> DataFrame:
    """Nodes of strings and numbers with their value as text."""
    own = nodes.where("type IN ('integer', 'number', 'string')")
    number = F.coalesce(F.col("i").cast("string"), F.col("d").cast("string"))
    return own.withColumn("value", F.when(F.col("type") == "string", F.col("s")).when(F.col("type") == "integer", number).otherwise(F.col("d").cast("string")))


def distinct_counts(nodes: DataFrame) -> DataFrame:
    """Exact, by values first and paths next, so that no path's values meet in one task."""
    return scalar(nodes).groupBy("path", "type", "value").agg(F.count("*").alias("n")).groupBy("path", "type").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("count"))


def approx_distinct(nodes: DataFrame, rsd: float = 0.03) -> DataFrame:
    return scalar(nodes).groupBy("path", "type").agg(F.approx_count_distinct("value", rsd).alias("distinct_values"))


def distinct_sketches(nodes: DataFrame, lg: int = 10) -> DataFrame:
    """HyperLogLog states that hll_union_agg merges."""
    return scalar(nodes).groupBy("path", "type").agg(F.hll_sketch_agg("value", F.lit(lg)).alias("hll"))


def examples(nodes: DataFrame, k: int = 100, seed: int = 42, by_value: bool = False) -> DataFrame:
    """(path, type, value): at most k distinct values of each path, those of least hash (or the least ones).

    Each task keeps k values of a path before the shuffle (Spark's window group limit).
    """
    own = scalar(nodes).select("path", "type", F.when(F.col("type") == "string", shown(F.col("s"))).otherwise(F.col("value")).alias("value")).groupBy("path", "type", "value").agg(F.count("*").alias("n"))
    order = [F.col("value")] if by_value else [F.xxhash64("value", F.lit(seed)), F.col("value")]
    return own.withColumn("rank", F.row_number().over(W.partitionBy("path", "type").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "n")


def value_sets(nodes: DataFrame) -> DataFrame:
    """Distinct (path, type, value): what a Bloom filter would stand for, exactly."""
    return scalar(nodes).select("path", "type", "value").distinct()


def unseen_values(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Values of nodes that ``known`` nodes never had at that path."""
    return value_sets(nodes).join(value_sets(known), ["path", "type", "value"], "left_anti")


def bloom_filters(nodes: DataFrame) -> DataFrame:
    """(path, type, words): each path's Bloom filter as (place, 64 bits) rows. Tasks keep the filter's words, not the values."""
    own = nodes.where("type = 'string' OR (type IN ('integer', 'number') AND d IS NOT NULL)")
    place = F.explode(F.when(F.col("type") == "string", membership.places_of(F.col("s"))).otherwise(membership.places_of(F.col("d"))))
    words = own.select("path", "type", place.alias("place")).groupBy("path", "type", F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, place & 63))").alias("bits"))
    return words.groupBy("path", "type").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))  # at most BITS / 64 a path


def enumerations(nodes: DataFrame, ratio: int = 10, limit: int = 50) -> DataFrame:
    """(path, type, values): paths whose values repeat often enough and are few. Only counts of large paths move on."""
    counts = scalar(nodes).groupBy("path", "type", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("path", "type").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where((F.col("total") > ratio * F.col("k")) & (F.col("k") < limit)).select("path", "type")
    return counts.join(F.broadcast(few), ["path", "type"]).groupBy("path", "type").agg(F.array_sort(F.collect_set("value")).alias("values"))  # few: a row per path


# --- strings and booleans ---


def strings(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'string'")


def string_lengths(nodes: DataFrame) -> DataFrame:
    return strings(nodes).groupBy("path").agg(F.count("*").alias("count"), F.min(F.length("s")).cast("long").alias("min_length"), F.max(F.length("s")).cast("long").alias("max_length"))


def affixes(nodes: DataFrame, at_least: int = MIN_PATTERN_VALUES) -> DataFrame:
    """(path, prefix, suffix) that all strings of a path share; together they are shorter than any of them."""
    own = strings(nodes).groupBy("path").agg(F.count("*").alias("count"), F.min(F.length("s")).alias("shortest"), F.min("s").alias("low"), F.max("s").alias("high"), F.min(F.reverse("s")).alias("back_low"), F.max(F.reverse("s")).alias("back_high"))
    own = own.select("path", "count", "shortest", common_prefix(F.col("low"), F.col("high")).alias("prefix"), F.reverse(common_prefix(F.col("back_low"), F.col("back_high"))).alias("suffix"))
    size = F.length("prefix") + F.length("suffix")
    return own.where((F.col("count") >= at_least) & (size > 0) & (size < F.col("shortest"))).select("path", "prefix", "suffix")


def format_counts(nodes: DataFrame, extended: bool = False) -> DataFrame:
    return strings(nodes).groupBy("path", format_of(F.col("s"), extended).alias("format")).agg(F.count("*").alias("count"))


def string_formats(nodes: DataFrame, threshold: float = 1.0, extended: bool = False, at_least: int = MIN_FORMAT_VALUES) -> DataFrame:
    """(path, format): the most frequent format, if it is one and frequent enough."""
    rank = {name: k for k, (name, _) in enumerate(formats(extended))}
    place = F.coalesce(*(F.when(F.col("format") == name, k) for name, k in rank.items()), F.lit(len(rank)))
    own = format_counts(nodes, extended).groupBy("path").agg(F.sum("count").alias("total"), F.max_by("format", F.struct("count", -place)).alias("format"), F.max("count").alias("top"))
    return own.where((F.col("total") >= at_least) & (F.col("format") != "none") & (F.col("top") >= threshold * F.col("total"))).select("path", "format")


def numeric_strings(nodes: DataFrame) -> DataFrame:
    """(path, is_numeric, minimum, maximum) of strings read as decimal numbers."""
    number = F.when(F.col("s").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.expr("try_cast(s AS double)"))
    return strings(nodes).groupBy("path").agg(F.bool_and(number.isNotNull()).alias("is_numeric"), F.min(number).alias("minimum"), F.max(number).alias("maximum"))


def boolean_facts(nodes: DataFrame) -> DataFrame:
    own = nodes.where("type = 'boolean'").groupBy("path").agg(F.count("*").alias("count"), F.avg(F.col("b").cast("double")).alias("percent"), F.bool_and("b").alias("all"), F.bool_or("b").alias("any"))
    return own.select("path", "count", "percent", F.when(F.col("all"), True).when(~F.col("any"), False).alias("constant"))
