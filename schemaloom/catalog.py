"""One query per operator over the driver's tables, with the SQL that says what it must return."""

from __future__ import annotations

import io
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom import model
from schemaloom.cli import serve
from schemaloom.functions.exprs import GAMMA, bin_value, formats
from schemaloom.functions.numbers import contract, widen
from schemaloom.model import of_value
from schemaloom.operators import monoids as M
from schemaloom.operators import passes, relations
from schemaloom.operators import tables as X
from schemaloom.operators.split import split_discover
from schemaloom.operators.validate import find_anomalies
from schemaloom.params import Params
from schemaloom.plans.discover import discover, discover_schema, grouped_nodes
from schemaloom.plans.shred import shred, shred_strict
from schemaloom.sources.documents import bad_documents, from_table, from_text_column, from_values
from schemaloom.sources.schema_import import Unsupported, detect, load, resolve_references
from schemaloom.sources.sinks import schema_json, value_rows
from schemaloom.streaming.discover import key_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs_of(spark: SparkSession, sf: str, source: str, id_: str, **fields: str) -> DataFrame:
    """Documents of a table's rows: each field an expression; a null is an absent key."""
    df = table(spark, sf, source)
    pairs = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return df.select(F.expr(id_).cast("long").alias("doc_id"), F.expr(f"to_json(named_struct({pairs}))").alias("json"))


def nodes_of(docs: DataFrame, depth: int | None = None) -> DataFrame:
    found = shred(docs, Params(cache=False), depth)  # whoever reads the nodes later couldn't release cached levels
    return M.lift(found.nodes, found.lifted())


OPTIONAL = {"id": "o_orderkey", "cust": "o_custkey", "price": "IF(o_orderstatus = 'F', o_totalprice, NULL)", "prio": "IF(o_custkey % 3 = 0, o_orderpriority, NULL)", "note": "IF(o_custkey % 3 = 0 AND o_orderstatus = 'F', 'n', NULL)"}
OPTIONAL_SQL = "opt AS (SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS prio, CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'F' THEN 'n' END AS note FROM orders)"


def optional(spark: SparkSession, sf: str) -> DataFrame:
    return nodes_of(docs_of(spark, sf, "orders", "o_orderkey", **OPTIONAL))


def long_counts(cols: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS key, count({c})::BIGINT AS present, count(*)::BIGINT AS total FROM {source}" for c in cols)


PRESENCE_SQL = f"WITH {OPTIONAL_SQL}, k AS ({long_counts(list(OPTIONAL), 'opt')})"


def orders_with_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("lines"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.to_json(F.struct("lines", F.transform("lines", lambda x: x["l_linenumber"]).alias("numbers"), F.transform("lines", lambda x: x["l_returnflag"]).alias("flags"), F.array(F.col("l_orderkey"), F.size("lines").cast("long")).alias("pair"))).alias("json"))


# --- sources, shredding, types ---


@query("path_types", "SELECT '$' AS path, 'object' AS type, count(*)::BIGINT AS count FROM events WHERE props IS NOT NULL UNION ALL SELECT '$.k', 'integer', count(*)::BIGINT FROM events WHERE props IS NOT NULL")
def path_types(spark, sf):
    return M.path_types(nodes_of(from_text_column(table(spark, sf, "events").where("props IS NOT NULL"), "props", "event_id")))


@query("path_types_strict", SQL["path_types"])
def path_types_strict(spark, sf):
    return M.path_types(shred_strict(from_text_column(table(spark, sf, "events").where("props IS NOT NULL"), "props", "event_id")))


@query("property_table", "SELECT '$.k' AS path, 'integer' AS type, count(*)::BIGINT AS count, min(json_extract(props, '$.k')::BIGINT)::DOUBLE AS minimum, max(json_extract(props, '$.k')::BIGINT)::DOUBLE AS maximum FROM events WHERE props IS NOT NULL")
def property_table(spark, sf):
    d = discover(from_text_column(table(spark, sf, "events").where("props IS NOT NULL"), "props", "event_id"))
    return d.table.where("type = 'integer'").select("path", "type", "count", F.col("min_d").alias("minimum"), F.col("max_d").alias("maximum"))


MIXED_FIELDS = {"id": "o_orderkey", "v": "CASE o_orderkey % 3 WHEN 0 THEN '1' ELSE NULL END"}


def mixed(spark, sf):
    v = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS string) WHEN 1 THEN concat('\"', o_orderstatus, '\"') WHEN 2 THEN concat(o_custkey, '.5') ELSE 'true' END"
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(f"concat('{{\"id\":', o_orderkey, ',\"v\":', {v}, '}}')").alias("json"))


@query("type_products", "SELECT '$.v' AS path, 'boolean|number|string' AS types, count(*)::BIGINT AS count FROM orders")
def type_products(spark, sf):
    return M.type_products(nodes_of(mixed(spark, sf)))


@query("integer_number_lift", "SELECT '$.v' AS path, count(*)::BIGINT AS count, min(CASE o_orderkey % 4 WHEN 0 THEN o_custkey ELSE o_custkey + 0.5 END)::DOUBLE AS minimum, max(CASE o_orderkey % 4 WHEN 0 THEN o_custkey ELSE o_custkey + 0.5 END)::DOUBLE AS maximum FROM orders WHERE o_orderkey % 4 IN (0, 2)")
def integer_number_lift(spark, sf):
    return M.number_facts(nodes_of(mixed(spark, sf)).where("path = '$.v'")).select("path", "count", "minimum", "maximum")


@query("bad_lines", "SELECT count(*)::BIGINT AS documents, count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END)::BIGINT AS unparsable, 0::BIGINT AS bad_encoding FROM orders")
def bad_lines(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("IF(o_orderkey % 5 = 0, '{\"broken\": ', '{\"a\": 1}')").alias("json"))
    return bad_documents(df)


# --- objects ---


@query("field_presence", f"{PRESENCE_SQL} SELECT '$' AS path, key, present, total, round(present / total, 6) AS presence FROM k WHERE present > 0")
def field_presence(spark, sf):
    return M.key_presence(optional(spark, sf)).withColumn("presence", F.round("presence", 6))


@query("required_keys", f"{PRESENCE_SQL} SELECT '$' AS path, key FROM k WHERE present = total")
def required_keys(spark, sf):
    return M.required_keys(optional(spark, sf))


def _pairs_sql() -> str:
    keys = list(OPTIONAL)
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END)::BIGINT AS n FROM opt" for a in keys for b in keys if a != b)


@query("dependent_required", f"WITH {OPTIONAL_SQL}, k AS ({long_counts(list(OPTIONAL), 'opt')}), p AS ({_pairs_sql()}) SELECT '$' AS path, p.a AS key, p.b AS needs FROM p JOIN k x ON x.key = p.a JOIN k y ON y.key = p.b WHERE p.n = x.present AND x.present > 0 AND p.n <> x.total AND y.present <> x.total")
def dependent_required(spark, sf):
    return M.dependencies(optional(spark, sf))


@query("disjoint_keysets", "SELECT '$' AS path, unnest(['acctbal,cust', 'nation,supp']) AS keys")
def disjoint_keysets(spark, sf):
    a = docs_of(spark, sf, "customer", "c_custkey", cust="c_custkey", acctbal="c_acctbal")
    b = docs_of(spark, sf, "supplier", "-1 - s_suppkey", supp="s_suppkey", nation="s_nationkey")
    n = nodes_of(a.unionByName(b))
    found = relations.disjoint_key_sets(n)
    return spark.createDataFrame([(p, ",".join(sorted(g))) for p, gs in found.items() for g in gs], "path string, keys string")


# --- arrays ---

LINES_SQL = "per AS (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1)"


@query("array_bounds", f"WITH {LINES_SQL}, b AS (SELECT count(*)::BIGINT AS count, min(n)::BIGINT AS min_items, max(n)::BIGINT AS max_items, min(n) = max(n) AS is_tuple FROM per) SELECT '$.lines' AS path, * FROM b UNION ALL SELECT '$.numbers', * FROM b UNION ALL SELECT '$.flags', * FROM b UNION ALL SELECT '$.pair', count(*)::BIGINT, 2, 2, true FROM per")
def array_bounds(spark, sf):
    return M.bounds_of_kinds(spark, shred(orders_with_lines(spark, sf), Params(cache=False)).kinds)


@query("tuple_or_list", f"WITH {LINES_SQL}, t AS (SELECT unnest(['$.pair[0]', '$.pair[1]']) AS path) SELECT path, 'integer' AS type, (SELECT count(*) FROM per)::BIGINT AS count FROM t UNION ALL SELECT '$.numbers[*]', 'integer', count(*)::BIGINT FROM lineitem UNION ALL SELECT '$.flags[*]', 'string', count(*)::BIGINT FROM lineitem")
def tuple_or_list(spark, sf):
    return M.path_types(nodes_of(orders_with_lines(spark, sf), depth=2).where("key IS NULL AND depth = 2 AND type <> 'object'"))


@query("array_unique", f"WITH {LINES_SQL}, f AS (SELECT l_orderkey, count(*) = count(DISTINCT l_returnflag) AS u FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AS u FROM lineitem GROUP BY 1) SELECT '$.flags' AS path, (bool_and(u) AND (SELECT max(n) > 1 FROM per)) AS is_unique FROM f UNION ALL SELECT '$.numbers', (bool_and(u) AND (SELECT max(n) > 1 FROM per)) FROM n UNION ALL SELECT '$.pair', bool_and(l_orderkey <> n) FROM per UNION ALL SELECT '$.lines', false")
def array_unique(spark, sf):
    return M.unique_arrays(nodes_of(orders_with_lines(spark, sf)))


LN_GAMMA = "ln(1.01 / 0.99)"


def bins_sql(path: str, type_: str, value: str, source: str) -> str:
    return f"SELECT '{path}' AS path, '{type_}' AS type, sign({value})::INTEGER AS sign, CASE WHEN {value} <> 0 THEN ceil(ln(abs({value})) / {LN_GAMMA})::BIGINT END AS bin, count(*)::BIGINT AS count FROM {source} GROUP BY 3, 4"


@query("array_length_histogram", f"WITH {LINES_SQL} {bins_sql('$.lines', 'array', 'n', 'per')}")
def array_length_histogram(spark, sf):
    return M.length_bins(nodes_of(orders_with_lines(spark, sf), depth=1).where("path = '$.lines'"))


# --- numbers ---

NUMBER_COLUMNS = {"o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "number"}


def order_numbers(spark, sf):
    return nodes_of(from_table(table(spark, sf, "orders"), "o_orderkey", *NUMBER_COLUMNS))


def _numbers_sql() -> str:
    one = "SELECT '$.{c}' AS path, '{t}' AS type, count(*)::BIGINT AS count, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum FROM orders"
    return " UNION ALL ".join(one.format(c=c, t=t) for c, t in NUMBER_COLUMNS.items())


@query("number_bounds", _numbers_sql())
def number_bounds(spark, sf):
    return M.number_facts(order_numbers(spark, sf)).select("path", "type", "count", "minimum", "maximum")


def _moments_sql() -> str:
    one = "SELECT '$.{c}' AS path, round(m, 4) AS mean, round(v, 2) AS variance, round(sqrt(v), 4) AS stdev, round(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 4) AS skewness, round(avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3, 4) AS kurtosis FROM orders, (SELECT avg({c}) AS m, var_samp({c}) AS v FROM orders) GROUP BY m, v"
    return " UNION ALL ".join(one.format(c=c) for c in ("o_custkey", "o_totalprice"))


@query("number_statistics", _moments_sql())
def number_statistics(spark, sf):
    own = M.number_facts(order_numbers(spark, sf)).where("path <> '$.o_orderkey'")
    return own.select("path", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), F.round("stdev", 4).alias("stdev"), F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query("multiple_of", "SELECT '$.a' AS path, 'integer' AS type, list_reduce(list(DISTINCT abs(p_size * 6)::BIGINT), lambda a, b: gcd(a, b))::DOUBLE AS multiple FROM part UNION ALL SELECT '$.b', 'number', list_reduce(list(DISTINCT (round(p_retailprice * 100)::BIGINT) * 5), lambda a, b: gcd(a, b)) / 1000 FROM part")
def multiple_of(spark, sf):
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr("concat('{\"a\":', p_size * 6, ',\"b\":', CAST(CAST(p_retailprice AS decimal(12,2)) * CAST(0.5 AS decimal(2,1)) AS decimal(14,3)), '}')").alias("json"))
    return M.multiples(nodes_of(docs)).select("path", "type", F.col("multiple").cast("double").alias("multiple"))


@query("number_histogram", " UNION ALL ".join(bins_sql(f"$.{c}", t, c, "orders") for c, t in NUMBER_COLUMNS.items()))
def number_histogram(spark, sf):
    return M.number_bins(order_numbers(spark, sf))


@query("histogram_values", f"WITH b AS ({bins_sql('$.c_acctbal', 'number', 'c_acctbal', 'customer')}) SELECT path, sign, bin, count, round(sign * 2 * pow({GAMMA!r}, bin) / ({GAMMA!r} + 1), 4) AS value FROM b")
def histogram_values(spark, sf):
    b = M.number_bins(nodes_of(from_table(table(spark, sf, "customer"), "c_custkey", "c_acctbal")))
    return b.select("path", "sign", "bin", "count", F.round(F.col("sign") * bin_value(F.col("bin")), 4).alias("value"))


@query("distinct_counts", "SELECT '$.c_name' AS path, 'string' AS type, count(DISTINCT c_name)::BIGINT AS distinct_values, count(*)::BIGINT AS count FROM customer UNION ALL SELECT '$.c_nationkey', 'integer', count(DISTINCT c_nationkey)::BIGINT, count(*)::BIGINT FROM customer UNION ALL SELECT '$.c_mktsegment', 'string', count(DISTINCT c_mktsegment)::BIGINT, count(*)::BIGINT FROM customer")
def distinct_counts(spark, sf):
    return M.distinct_counts(nodes_of(from_table(table(spark, sf, "customer"), "c_custkey", "c_name", "c_nationkey", "c_mktsegment")))


@query("approx_distinct", "SELECT unnest(['$.c_name', '$.c_nationkey']) AS path, true AS within_tenth")
def approx_distinct(spark, sf):
    n = nodes_of(from_table(table(spark, sf, "customer"), "c_custkey", "c_name", "c_nationkey"))
    a, b = M.approx_distinct(n), M.distinct_counts(n).withColumnRenamed("distinct_values", "exact")
    return a.join(b, ["path", "type"]).select("path", (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within_tenth"))


@query("distinct_sketch_merge", "SELECT '$.o_custkey' AS path, true AS within_tenth")
def distinct_sketch_merge(spark, sf):
    n = nodes_of(from_table(table(spark, sf, "orders"), "o_orderkey", "o_custkey"))
    parts = M.distinct_sketches(n.where("doc_id % 2 = 0")).unionByName(M.distinct_sketches(n.where("doc_id % 2 = 1")))
    whole = parts.groupBy("path").agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("estimate"))
    return whole.join(M.distinct_counts(n), "path").select("path", (F.abs(F.col("estimate") - F.col("distinct_values")) <= 0.1 * F.col("distinct_values")).alias("within_tenth"))


@query("examples_topk", "SELECT '$.c_name' AS path, 'string' AS type, value FROM (SELECT DISTINCT c_name AS value FROM customer ORDER BY 1 LIMIT 100) UNION ALL SELECT '$.c_mktsegment', 'string', value FROM (SELECT DISTINCT c_mktsegment AS value FROM customer ORDER BY 1 LIMIT 100)")
def examples_topk(spark, sf):
    return M.examples(nodes_of(from_table(table(spark, sf, "customer"), "c_custkey", "c_name", "c_mktsegment")), 100, by_value=True)


@query("examples_truncated", "SELECT DISTINCT CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS value FROM benchmark")
def examples_truncated(spark, sf):
    n = nodes_of(from_table(table(spark, sf, "benchmark"), "item_id", "text"))
    return M.examples(n, 1_000_000).select("value")


@query("bloom_membership", "SELECT DISTINCT '$.v' AS path, 'integer' AS type, o_custkey::VARCHAR AS value FROM orders WHERE o_orderkey % 10 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 <> 0)")
def bloom_membership(spark, sf):
    n = nodes_of(docs_of(spark, sf, "orders", "o_orderkey", v="o_custkey")).where("path = '$.v'")
    return M.unseen_values(n.where("doc_id % 10 = 0"), n.where("doc_id % 10 <> 0"))


BLOOM_SQL = "WITH v AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT '$.v' AS path, 'integer' AS type, count(*)::BIGINT AS known, 0::BIGINT AS missed FROM v"


@query("bloom_filter", BLOOM_SQL)
def bloom_filter(spark, sf):
    """A discovered filter knows every value it has seen."""
    docs = docs_of(spark, sf, "orders", "IF(o_orderstatus = 'F', o_orderkey, NULL)", v="o_custkey").where("doc_id IS NOT NULL")
    n = discover_schema(docs, Params().only("bloom", "properties", "required"))
    known = M.distinct_counts(nodes_of(docs).where("path = '$.v'")).select("path", "type", F.col("distinct_values").alias("known"))
    return known.crossJoin(find_anomalies(docs, n).agg(F.count("*").alias("missed")))  # one row each


# --- strings, booleans, enumerations ---


@query("string_lengths", " UNION ALL ".join(f"SELECT '$.{c}' AS path, count({c})::BIGINT AS count, min(length({c}))::BIGINT AS min_length, max(length({c}))::BIGINT AS max_length FROM part" for c in ("p_name", "p_brand", "p_type")))
def string_lengths(spark, sf):
    return M.string_lengths(nodes_of(from_table(table(spark, sf, "part"), "p_partkey", "p_name", "p_brand", "p_type")))


@query("document_lengths", "SELECT '$.text' AS path, count(*)::BIGINT AS count, min(length(text))::BIGINT AS min_length, max(length(text))::BIGINT AS max_length FROM documents WHERE text IS NOT NULL")
def document_lengths(spark, sf):
    return M.string_lengths(nodes_of(from_table(table(spark, sf, "documents"), "doc_id", "text")))


@query("string_length_histogram", bins_sql("$.p_name", "string", "length(p_name)", "part"))
def string_length_histogram(spark, sf):
    return M.length_bins(nodes_of(from_table(table(spark, sf, "part"), "p_partkey", "p_name")))


def _lcp_sql(col: str, source: str) -> str:
    lcp = "coalesce((SELECT max(i) FROM range(1, 200) r(i) WHERE left(lo, i) = left(hi, i) AND i <= length(lo) AND i <= length(hi)), 0)"
    return f"SELECT '$.{col}' AS path, left(lo, {lcp}) AS prefix, '' AS suffix FROM (SELECT min({col}) AS lo, max({col}) AS hi FROM {source})"


@query("string_pattern", _lcp_sql("c_name", "customer"))
def string_pattern(spark, sf):
    return M.affixes(nodes_of(from_table(table(spark, sf, "customer"), "c_custkey", "c_name", "c_mktsegment")))


FORMAT_VALUES = {
    "date": "strftime(o_orderdate, '%Y-%m-%d')", "uuid": "'00000000-0000-4000-8000-' || lpad(o_orderkey::VARCHAR, 12, '0')", "ipv4": "'10.1.' || (o_orderkey % 200)::VARCHAR || '.7'",
    "email": "'user' || o_custkey::VARCHAR || '@example.com'", "uri": "'https://example.com/o/' || o_orderkey::VARCHAR", "time": "'10:20:' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || 'Z'", "word": "o_orderpriority",
}


def formatted(spark, sf):
    fields = {k: v.replace("strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')").replace("::VARCHAR", "") for k, v in FORMAT_VALUES.items()}
    return nodes_of(docs_of(spark, sf, "orders", "o_orderkey", **fields))


@query("string_formats", " UNION ALL ".join(f"SELECT '$.{k}' AS path, '{k}' AS format FROM (SELECT count(*) AS n FROM orders) WHERE n >= 10" for k in FORMAT_VALUES if k != "word"))
def string_formats(spark, sf):
    return M.string_formats(formatted(spark, sf))


def _format_case(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in formats(False)) + " ELSE 'none' END"


@query("format_counts", " UNION ALL ".join(f"SELECT '$.{k}' AS path, {_format_case(v)} AS format, count(*)::BIGINT AS count FROM orders GROUP BY 2" for k, v in FORMAT_VALUES.items()))
def format_counts(spark, sf):
    return M.format_counts(formatted(spark, sf))


@query("url_formats", f"SELECT '$.url' AS path, {_format_case('url')} AS format, count(*)::BIGINT AS count FROM pages GROUP BY 2")
def url_formats(spark, sf):
    return M.format_counts(nodes_of(from_table(table(spark, sf, "pages"), "page_id", "url")))


@query("extended_formats", "SELECT '$.doi' AS path, 'doi' AS format UNION ALL SELECT '$.geo', 'geo-uri' UNION ALL SELECT '$.isbn', 'isbn'")
def extended_formats(spark, sf):
    n = nodes_of(docs_of(spark, sf, "part", "p_partkey", doi="concat('10.1234/x', p_partkey)", geo="concat('geo:', p_size, '.5,', p_size)", isbn="concat('978', lpad(p_partkey, 10, '0'))"))
    return M.string_formats(n, extended=True)


@query("numeric_strings", "SELECT '$.key' AS path, true AS is_numeric, min(p_partkey)::DOUBLE AS minimum, max(p_partkey)::DOUBLE AS maximum FROM part UNION ALL SELECT '$.brand', false, NULL, NULL")
def numeric_strings(spark, sf):
    return M.numeric_strings(nodes_of(docs_of(spark, sf, "part", "p_partkey", key="CAST(p_partkey AS string)", brand="p_brand")))


@query("boolean_facts", "SELECT '$.big' AS path, count(*)::BIGINT AS count, round(avg((p_size > 25)::INTEGER), 6) AS percent, NULL AS constant FROM part UNION ALL SELECT '$.yes', count(*)::BIGINT, 1.0, 'true' FROM part UNION ALL SELECT '$.no', count(*)::BIGINT, 0.0, 'false' FROM part")
def boolean_facts(spark, sf):
    return M.boolean_facts(nodes_of(docs_of(spark, sf, "part", "p_partkey", big="p_size > 25", yes="p_size > 0", no="p_size < 0"))).withColumns({"percent": F.round("percent", 6), "constant": F.col("constant").cast("string")})


def _enum_sql(cols: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '$.{c}' AS path, '{t}' AS type, array_to_string(list_sort(list(DISTINCT {c}::VARCHAR)), ',') AS vals FROM {source} HAVING count(*) > 10 * count(DISTINCT {c}) AND count(DISTINCT {c}) < 50" for c, t in cols.items())


@query("enum_values", _enum_sql({"event_type": "string", "user_id": "integer"}, "events"))
def enum_values(spark, sf):
    e = M.enumerations(nodes_of(from_table(table(spark, sf, "events"), "event_id", "event_type", "user_id")))
    return e.select("path", "type", F.array_join("values", ",").alias("vals"))


# --- equivalence relations ---


def _label_sql() -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in OPTIONAL) + "], lambda x: x IS NOT NULL)), ',')"


@query("er_label", f"WITH {OPTIONAL_SQL} SELECT '$' AS path, {_label_sql()} AS keys, count(*)::BIGINT AS objects FROM opt GROUP BY 2")
def er_label(spark, sf):
    return relations.label_groups(optional(spark, sf))


@query("er_label_presence", f"WITH {OPTIONAL_SQL}, g AS (SELECT *, {_label_sql()} AS label FROM opt), r AS (SELECT label, row_number() OVER (ORDER BY replace(label, ',', chr(1))) - 1 AS grp, count(*)::BIGINT AS objects FROM g GROUP BY 1) SELECT CASE WHEN grp > 0 THEN '$<' || grp || '>' ELSE '$' END AS path, objects FROM r")
def er_label_presence(spark, sf):
    n = grouped_nodes(optional(spark, sf), "Label")
    return n.where("type = 'object'").groupBy("path").agg(F.count("*").alias("objects"))


@query("er_intersecting", "SELECT 0 AS \"group\", count(*)::BIGINT AS objects FROM customer UNION ALL SELECT 1, count(*)::BIGINT FROM supplier")
def er_intersecting(spark, sf):
    a = docs_of(spark, sf, "customer", "c_custkey", cust="c_custkey", acctbal="IF(c_custkey % 2 = 0, c_acctbal, NULL)")
    b = docs_of(spark, sf, "supplier", "-1 - s_suppkey", supp="s_suppkey", nation="s_nationkey")
    return relations.groups(nodes_of(a.unionByName(b)), "IntersectingLabel").groupBy("group").agg(F.count("*").alias("objects"))


@query("er_typematch", "SELECT CASE o_orderkey % 2 WHEN 0 THEN 0 ELSE 1 END AS \"group\", count(*)::BIGINT AS objects FROM orders GROUP BY 1")
def er_typematch(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("IF(o_orderkey % 2 = 0, concat('{\"a\":', o_custkey, '}'), '{\"a\":\"s\"}')").alias("json"))
    return relations.groups(nodes_of(df), "TypeMatch").groupBy("group").agg(F.count("*").alias("objects"))


# --- post-passes ---


@query("dynamic_objects", "WITH p AS (SELECT n_name, count(*) / (SELECT count(*) FROM customer) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT '$.by' AS path, round(sum(-p * ln(p)), 5) AS entropy, sum(-p * ln(p)) > 1 AS is_dynamic FROM p")
def dynamic_objects(spark, sf):
    df = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    docs = df.select(F.col("c_custkey").alias("doc_id"), F.to_json(F.struct(F.create_map("n_name", "c_acctbal").alias("by"))).alias("json"))
    return X.dynamic_paths(nodes_of(docs)).where("path = '$.by'").withColumn("entropy", F.round("entropy", 5))


@query("definitions_similarity", "WITH c AS (SELECT count(CASE WHEN c_custkey % 2 = 0 THEN 1 END) / count(*) AS p FROM customer) SELECT '$.a' AS a, '$.b' AS b, round((1 + p) / 2, 6) AS similarity, 1 - (1 + p) / 2 <= 0.1 AS alike FROM c")
def definitions_similarity(spark, sf):
    docs = docs_of(spark, sf, "customer", "c_custkey", a="named_struct('id', c_custkey, 'name', c_name)", b="named_struct('id', c_custkey, 'name', IF(c_custkey % 2 = 0, c_name, NULL))")
    return X.similar_objects(nodes_of(docs)).withColumn("similarity", F.round("similarity", 6))


# --- keys ---


@query("primary_keys", "SELECT '$.c_custkey' AS path, 3.5 AS score")
def primary_keys(spark, sf):
    return X.primary_keys(nodes_of(from_table(table(spark, sf, "customer"), "c_custkey", "c_custkey", "c_name", "c_acctbal", "c_mktsegment"))).withColumn("score", F.round("score", 6))


@query("key_scores", "SELECT '$.c_custkey' AS path, 3.5 AS score FROM (SELECT 1) UNION ALL SELECT '$.c_name', round(1 + 0.5 + 1.0 / greatest(1.0, max(length(c_name)) - 10), 6) FROM customer HAVING count(DISTINCT c_name) = count(*)")
def key_scores(spark, sf):
    return X.key_scores(nodes_of(from_table(table(spark, sf, "customer"), "c_custkey", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"))).withColumn("score", F.round("score", 6))


@query("foreign_keys", "WITH v AS (SELECT DISTINCT 'ck' AS p, c_custkey AS v FROM customer UNION ALL SELECT DISTINCT 'nk', c_nationkey FROM customer UNION ALL SELECT DISTINCT 'ok', o_custkey FROM orders) SELECT '$.' || a.p AS source, '$.' || b.p AS target FROM v a JOIN v b ON a.v = b.v AND a.p <> b.p GROUP BY a.p, b.p HAVING count(*) = (SELECT count(*) FROM v c WHERE c.p = a.p)")
def foreign_keys(spark, sf):
    a = docs_of(spark, sf, "customer", "c_custkey", ck="c_custkey", nk="c_nationkey")
    b = docs_of(spark, sf, "orders", "-1 - o_orderkey", ok="o_custkey")
    return X.foreign_keys(nodes_of(a.unionByName(b)))


# --- validation, comparison, splits ---

KNOWN_SQL = "k AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_custkey) AS clo, max(o_custkey) AS chi FROM orders WHERE o_orderstatus = 'F')"


def _checked(spark, sf):
    """All orders, to be checked against the schema that the finished ones show."""
    fields = {"price": "o_totalprice", "cust": "o_custkey", "extra": "IF(o_orderstatus <> 'F' AND o_custkey % 7 = 0, 1, NULL)", "status": "IF(o_orderstatus <> 'F' AND o_custkey % 5 = 0, NULL, o_orderstatus)"}
    known = {"price": "o_totalprice", "cust": "o_custkey", "status": "o_orderstatus"}
    finished = nodes_of(docs_of(spark, sf, "orders", "IF(o_orderstatus = 'F', o_orderkey, NULL)", **known).where("doc_id IS NOT NULL"))
    return nodes_of(docs_of(spark, sf, "orders", "o_orderkey", **fields)), finished


ANOMALY_SQL = f"""WITH {KNOWN_SQL}, c AS (SELECT * FROM orders, k)
SELECT o_orderkey AS doc_id, '$.price' AS path, 'below minimum' AS message, 'warning' AS level FROM c WHERE o_totalprice < lo UNION ALL
SELECT o_orderkey, '$.price', 'above maximum', 'warning' FROM c WHERE o_totalprice > hi UNION ALL
SELECT o_orderkey, '$.cust', 'below minimum', 'warning' FROM c WHERE o_custkey < clo UNION ALL
SELECT o_orderkey, '$.cust', 'above maximum', 'warning' FROM c WHERE o_custkey > chi UNION ALL
SELECT o_orderkey, '$.extra', 'unknown field', 'fatal' FROM c WHERE o_orderstatus <> 'F' AND o_custkey % 7 = 0 UNION ALL
SELECT o_orderkey, '$.status', 'missing required field', 'fatal' FROM c WHERE o_orderstatus <> 'F' AND o_custkey % 5 = 0"""


@query("anomalies", ANOMALY_SQL)
def anomalies(spark, sf):
    return X.validate_nodes(*_checked(spark, sf))


@query("anomaly_levels", f"WITH a AS ({ANOMALY_SQL}) SELECT doc_id, CASE max(CASE level WHEN 'fatal' THEN 3 ELSE 2 END) WHEN 3 THEN 'fatal' ELSE 'warning' END AS level FROM a GROUP BY 1")
def anomaly_levels(spark, sf):
    return X.verdicts(X.validate_nodes(*_checked(spark, sf)))


@query("validate_imported", "SELECT o_orderkey AS doc_id, '$.price' AS path, 'warning' AS level FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_orderkey, '$.status', 'fatal' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def validate_imported(spark, sf):
    schema = load({"type": "object", "required": ["price"], "properties": {"price": {"type": "number", "maximum": 100000}, "status": {"enum": ["F", "O"]}}, "additionalProperties": False})
    docs = docs_of(spark, sf, "orders", "o_orderkey", price="o_totalprice", status="o_orderstatus")
    return find_anomalies(docs, schema).select("doc_id", "path", "level")


@query("outside_histogram", f"WITH b AS (SELECT min(sign * pow({GAMMA!r}, bin - (sign > 0)::INTEGER)) AS lo, max(sign * pow({GAMMA!r}, bin - (sign < 0)::INTEGER)) AS hi FROM ({bins_sql('$.v', 'number', 'c_acctbal', '(SELECT * FROM customer WHERE c_custkey % 50 = 1)')})) SELECT c_custkey AS doc_id, '$.v' AS path, c_acctbal AS value FROM customer, b WHERE c_custkey % 50 <> 1 AND (c_acctbal < lo - 1e-9 OR c_acctbal > hi * (1 + 1e-9))")
def outside_histogram(spark, sf):
    n = nodes_of(docs_of(spark, sf, "customer", "c_custkey", v="c_acctbal"))
    return X.outside_histogram(n.where("doc_id % 50 <> 1"), n.where("doc_id % 50 = 1"))


@query("incompatibilities", "WITH a AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 100 = 1), b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 100 <> 1) SELECT '$.price' AS path, 'minimum' AS property FROM a, b WHERE b.lo < a.lo UNION ALL SELECT '$.price', 'maximum' FROM a, b WHERE b.hi > a.hi")
def incompatibilities(spark, sf):
    n = nodes_of(docs_of(spark, sf, "orders", "o_orderkey", price="o_totalprice", status="o_orderstatus"))
    return X.incompatibilities(n.where("doc_id % 100 = 1"), n.where("doc_id % 100 <> 1"))


@query("schema_subset", "SELECT true AS whole_covers_part, (SELECT min(o_totalprice) FROM orders WHERE o_orderkey % 100 = 1) <= (SELECT min(o_totalprice) FROM orders) AND (SELECT max(o_totalprice) FROM orders WHERE o_orderkey % 100 = 1) >= (SELECT max(o_totalprice) FROM orders) AS part_covers_whole")
def schema_subset(spark, sf):
    docs = docs_of(spark, sf, "orders", "o_orderkey", price="o_totalprice")
    keep = Params().only("minimum", "maximum", "required", "properties", "additional")
    whole, part = discover_schema(docs, keep), discover_schema(docs.where("doc_id % 100 = 1"), keep)
    return spark.createDataFrame([(model.covers(whole, part), model.covers(part, whole))], "whole_covers_part boolean, part_covers_whole boolean")


def halves(spark, sf) -> list[model.Node]:
    """The schemas of orders of even and of odd keys."""
    docs, keep = from_table(table(spark, sf, "orders"), "o_orderkey", *NUMBER_COLUMNS), Params().only("minimum", "maximum", "properties", "required")
    return [discover_schema(docs.where(f"doc_id % 2 = {k}"), keep) for k in (0, 1)]


@query("union_merge", _numbers_sql().replace("count(*)::BIGINT AS count, ", ""))
def union_merge(spark, sf):
    n = reduce(model.merge, halves(spark, sf))
    return literal(spark, [(f"$.{k}", x.kind, float(x.facts["minimum"][0]), float(x.facts["maximum"][0])) for k, x in n.keys.items()], "path string, type string, minimum double, maximum double")


@query("intersect_merge", "SELECT '$.' || k AS path, greatest(lo0, lo1)::DOUBLE AS minimum, least(hi0, hi1)::DOUBLE AS maximum FROM (SELECT 'o_totalprice' AS k, min(o_totalprice) FILTER (o_orderkey % 2 = 0) AS lo0, min(o_totalprice) FILTER (o_orderkey % 2 = 1) AS lo1, max(o_totalprice) FILTER (o_orderkey % 2 = 0) AS hi0, max(o_totalprice) FILTER (o_orderkey % 2 = 1) AS hi1 FROM orders)")
def intersect_merge(spark, sf):
    n = model.merge(*halves(spark, sf), model.INTERSECT).keys["o_totalprice"]
    return literal(spark, [("$.o_totalprice", n.facts["minimum"][0], n.facts["maximum"][0])], "path string, minimum double, maximum double")


@query("split_train_test", "SELECT count(*)::BIGINT AS documents, true AS near_fraction FROM orders")
def split_train_test(spark, sf):
    docs = docs_of(spark, sf, "orders", "o_orderkey", price="o_totalprice")
    a, b = X.split_documents(docs, 0.8)
    n, m = a.count(), b.count()
    return spark.createDataFrame([(n + m, abs(n / (n + m) - 0.8) < 0.03)], "documents long, near_fraction boolean")


@query("value_table", "SELECT '$.c_mktsegment' AS path, row_number() OVER (ORDER BY v) AS position, v AS value FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)")
def value_table(spark, sf):
    return X.value_table(nodes_of(from_table(table(spark, sf, "customer"), "c_custkey", "c_mktsegment"))).withColumn("position", F.col("position").cast("long"))


# --- schema trees: small literal inputs ---


@query("json_schema_document")
def json_schema_document(spark, sf):
    n = discover_schema(from_table(table(spark, sf, "orders"), "o_orderkey"))
    return spark.createDataFrame([(schema_json(n, False),)], "document string")


@query("discovered_schema_accepts", "SELECT 0::BIGINT AS rejected")
def discovered_schema_accepts(spark, sf):
    docs = docs_of(spark, sf, "orders", "o_orderkey", **OPTIONAL)
    return find_anomalies(docs, discover_schema(docs)).agg(F.count("*").alias("rejected"))


@query("expand_bounds", "SELECT * FROM (VALUES (101, 117, 120, 14), (123, 124, 127, 14), (14, 12, 14, 12), (130, 129, 130, 128)) AS t(current, lim, wide, narrow)")
def expand_bounds(spark, sf):
    pairs = [(101, 117), (123, 124), (14, 12), (130, 129)]
    narrow = {(101, 117): contract(14, 28)[0], (123, 124): contract(14, 28)[0], (14, 12): contract(14, 12)[0], (130, 129): contract(130, 129)[0]}
    return spark.createDataFrame([(a, b, widen(a, b)[0], narrow[a, b]) for a, b in pairs], "current int, lim int, wide int, narrow int")


@query("import_round_trip", "SELECT unnest(['array', 'integer', 'object', 'string']) AS kind, true AS same")
def import_round_trip(spark, sf):
    docs = [{"type": "integer", "minimum": 1, "exclusiveMaximum": 9, "multipleOf": 2}, {"type": "string", "minLength": 1, "maxLength": 5}, {"type": "array", "prefixItems": [{"type": "null"}], "items": False}, {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "boolean"}}}]
    return spark.createDataFrame([(d["type"], model.write(load(model.write(load(d)))) == model.write(load(d)) == d) for d in docs], "kind string, same boolean")


@query("reference_resolution", "SELECT * FROM (VALUES ('#/$defs/a', 'integer'), ('#/$defs/b', 'integer'), ('#/$defs/c', 'none')) AS t(target, kind)")
def reference_resolution(spark, sf):
    root = load({"type": "object", "properties": {"x": {"$ref": "#/$defs/a"}, "y": {"$ref": "#/$defs/b"}, "z": {"$ref": "#/$defs/c"}}, "$defs": {"a": {"type": "integer"}, "b": {"$ref": "#/$defs/a"}, "c": {"$ref": "#/$defs/c"}}})
    return spark.createDataFrame([(t, n.kind if n else "none") for t, n in resolve_references(root).items()], "target string, kind string")


@query("all_of_merge", "SELECT 3 AS minimum, 8 AS maximum")
def all_of_merge(spark, sf):
    n = passes.merge_all_of(load({"allOf": [{"type": "integer", "minimum": 1, "maximum": 8}, {"type": "integer", "minimum": 3}]}))
    return spark.createDataFrame([(n.facts["minimum"][0], n.facts["maximum"][0])], "minimum int, maximum int")


@query("entropy", "SELECT 4::BIGINT AS choices")
def entropy(spark, sf):
    n = reduce(model.merge, [of_value({"a": 1, "b": True}), of_value({"a": "x"})])
    return spark.createDataFrame([(model.entropy(n),)], "choices long")


@query("pointers", "SELECT * FROM (VALUES ('/a/0', 'integer'), ('/b~1c', 'string'), ('/d/e', 'boolean')) AS t(pointer, kind)")
def pointers(spark, sf):
    n = of_value({"a": [1], "b/c": "x", "d": [{"e": True}]})
    return spark.createDataFrame([(p, f.kind if f else "none") for p, f in (("/a/0", model.find(n, "/a/0")), ("/b~1c", model.find(n, "/b~1c")), ("/d/e", model.find_inexact(n, "/d/e")))], "pointer string, kind string")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def folded(*vs) -> model.Node:
    return reduce(model.merge, map(of_value, vs), model.ZERO)


@query("enum_pass", "SELECT DISTINCT event_type AS value FROM events WHERE (SELECT count(*) > 10 * count(DISTINCT event_type) FROM events)")
def enum_pass(spark, sf):
    n = discover_schema(docs_of(spark, sf, "events", "event_id", t="event_type"), Params().only("examples", "format", "properties", "required"))
    found = passes.enums(n).keys["t"]
    return literal(spark, [(v,) for v in found.get("enum", ())], "value string")


@query("dynamic_pass", "SELECT 'dynamic' AS kind, count(*)::BIGINT AS members FROM (SELECT 1)")
def dynamic_pass(spark, sf):
    df = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    docs = df.select(F.col("c_custkey").alias("doc_id"), F.to_json(F.struct(F.create_map("n_name", "c_acctbal").alias("by"))).alias("json"))
    n = passes.dynamic_objects(discover_schema(docs, Params().only("properties", "presence", "required", "minimum"))).keys["by"]
    return literal(spark, [(n.kind, int(n.items is not None))], "kind string, members long")


@query("disjoint_pass", "SELECT unnest(['bar,foo', 'baz,quux']) AS keys")
def disjoint_pass(spark, sf):
    docs = from_values(spark, [{"foo": 1, "bar": 2}, {"baz": 1, "quux": 2}])
    n = passes.disjoint_objects(discover_schema(docs), relations.disjoint_key_sets(shred(docs).nodes))
    return literal(spark, [(",".join(sorted(p.keys)),) for p in n.parts], "keys string")


@query("disjoint_pass_accepts", "SELECT 0::BIGINT AS rejected, 3::BIGINT AS alternatives")
def disjoint_pass_accepts(spark, sf):
    """Optional keys that do meet stay one object, whatever their dependencies; keys that never meet become alternatives."""
    docs = docs_of(spark, sf, "orders", "o_orderkey", p="IF(o_orderstatus = 'F', o_custkey, NULL)", q="IF(o_orderstatus = 'F' AND o_custkey % 2 = 0, 1, NULL)", r="IF(o_orderstatus = 'F' AND o_custkey % 3 = 0, 1, NULL)", s="IF(o_orderstatus = 'O', o_custkey, NULL)", t="IF(o_orderstatus = 'P', o_custkey, NULL)")
    params = Params().only("properties", "presence", "required", "dependencies")
    n = passes.apply(discover_schema(docs, params), params, disjoint=True, key_groups=relations.disjoint_key_sets(shred(docs).nodes))
    return find_anomalies(docs, n).agg(F.count("*").alias("rejected")).withColumn("alternatives", F.lit(len(n.parts)).cast("long"))


@query("definitions_pass", "SELECT '$.foo' AS path, '#/$defs/defn0' AS target UNION ALL SELECT '$.quux', '#/$defs/defn0'")
def definitions_pass(spark, sf):
    n = passes.shared_definitions(of_value({"foo": {"bar": 1, "baz": 2}, "quux": {"bar": 3, "baz": 4}}))
    return literal(spark, [(p, x.target) for p, x in model.walk(n) if x.kind == "reference"], "path string, target string")


@query("format_length_pass", "SELECT 'date' AS format, false AS has_length")
def format_length_pass(spark, sf):
    n = passes.reset_format_lengths(discover_schema(docs_of(spark, sf, "orders", "o_orderkey", d="date_format(o_orderdate, 'yyyy-MM-dd')"), Params().named("Simple"))).keys["d"]
    return literal(spark, [(model.top_format(n.facts["formats"]), "min_length" in n.facts)], "format string, has_length boolean")


@query("split_expand", "SELECT true AS final_covers_train, true AS final_covers_test")
def split_expand(spark, sf):
    docs = docs_of(spark, sf, "orders", "o_orderkey", cust="o_custkey", status="o_orderstatus", price="IF(o_orderkey % 9 = 0, NULL, o_totalprice)")
    s = split_discover(docs, 0.1, Params().named("Simple"))
    return literal(spark, [(model.covers(s.final, s.train), model.covers(s.final, s.test))], "final_covers_train boolean, final_covers_test boolean")


@query("tree_incompatibilities", SQL["incompatibilities"])
def tree_incompatibilities(spark, sf):
    docs, keep = docs_of(spark, sf, "orders", "o_orderkey", price="o_totalprice"), Params().only("minimum", "maximum", "required", "properties", "additional")
    own, other = discover_schema(docs.where("doc_id % 100 = 1"), keep), discover_schema(docs.where("doc_id % 100 <> 1"), keep)
    return literal(spark, list(model.gaps(own, other)), "path string, property string")


@query("product_matches", "SELECT * FROM (VALUES ('allOf', 3, false), ('allOf', 7, true), ('allOf', 12, false), ('anyOf', 3, true), ('anyOf', 7, true), ('anyOf', 12, true), ('oneOf', 3, true), ('oneOf', 7, false), ('oneOf', 12, true)) AS t(how, value, valid)")
def product_matches(spark, sf):
    parts = [{"type": "integer", "maximum": 10}, {"type": "integer", "minimum": 5}]
    return literal(spark, [(how, v, not model.anomalies(load({how: parts}), v)) for how in ("allOf", "anyOf", "oneOf") for v in (3, 7, 12)], "how string, value int, valid boolean")


@query("import_refusals", "SELECT unnest(['if', 'not', 'unevaluatedProperties', 'dependencies', 'dependentSchemas', 'contains', 'unevaluatedItems', 'additionalProperties', 'type date', 'items with prefixItems']) AS keyword")
def import_refusals(spark, sf):
    bad = [{"if": {}}, {"type": "object", "not": {"type": "null"}}, {"unevaluatedProperties": False}, {"dependencies": {}}, {"dependentSchemas": {}}, {"contains": {}}, {"unevaluatedItems": False}, {"type": "object", "additionalProperties": {"type": "null"}}, {"type": "date"}, {"type": "array", "prefixItems": [{}], "items": [{}]}]
    rows = []
    for doc in bad:
        try:
            load(doc)
        except Unsupported as e:
            rows.append((str(e),))
    return literal(spark, rows, "keyword string")


@query("type_detection", "SELECT * FROM (VALUES ('minItems', 'array'), ('minimum', 'number'), ('required', 'object'), ('pattern', 'string'), ('title', 'none'), ('minLength minimum', 'number,string'), ('minimum maxItems minItems', 'number,array')) AS t(keyword, kind)")
def type_detection(spark, sf):
    return literal(spark, [(k, ",".join(detect(dict.fromkeys(k.split(), 1))) or "none") for k in ("minItems", "minimum", "required", "pattern", "title", "minLength minimum", "minimum maxItems minItems")], "keyword string, kind string")


@query("detected_types_apply", "SELECT o_orderkey AS doc_id, '$' AS path FROM orders WHERE o_totalprice < 100000")
def detected_types_apply(spark, sf):
    """A schema of no type: its bound holds for numbers, its length for strings, and a value may be either."""
    schema = load({"minimum": 100000, "minLength": 1})
    prices = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS doc_id", "to_json(named_struct('v', o_totalprice)) AS json")
    numbers = prices.selectExpr("doc_id", "substring(json, 6, length(json) - 6) AS json")
    statuses = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("-o_orderkey AS doc_id", "concat('\"', o_orderstatus, '\"') AS json")
    return find_anomalies(numbers.unionByName(statuses), schema).select("doc_id", "path").distinct()


@query("merge_kinds", "SELECT * FROM (VALUES ('union', 'integer', 'number', 'number'), ('union', 'integer', 'string', 'product'), ('union', 'any', 'string', 'any'), ('union', 'zero', 'string', 'string'), ('intersect', 'integer', 'string', 'zero'), ('intersect', 'any', 'string', 'string'), ('intersect', 'zero', 'string', 'zero'), ('intersect', 'integer', 'number', 'number')) AS t(how, a, b, kind)")
def merge_kinds(spark, sf):
    kinds = {"integer": of_value(1), "number": of_value(1.5), "string": of_value("x"), "any": model.ANY, "zero": model.ZERO}
    cases = [("union", "integer", "number"), ("union", "integer", "string"), ("union", "any", "string"), ("union", "zero", "string"), ("intersect", "integer", "string"), ("intersect", "any", "string"), ("intersect", "zero", "string"), ("intersect", "integer", "number")]
    return literal(spark, [(how, a, b, model.merge(kinds[a], kinds[b], how).kind) for how, a, b in cases], "how string, a string, b string, kind string")


@query("tuple_merge", "SELECT * FROM (VALUES (1, 'tuple'), (2, 'list')) AS t(lengths, kind)")
def tuple_merge(spark, sf):
    return literal(spark, [(k, "tuple" if n.tuple is not None else "list") for k, n in ((1, folded([1, 2], [3, 4])), (2, folded([1, 2], [3])))], "lengths int, kind string")


@query("multiple_expansion", "SELECT * FROM (VALUES (12, 18, 6.0), (6, 12, 6.0), (7, 3, 1.0)) AS t(own, other, multiple)")
def multiple_expansion(spark, sf):
    out = []
    for own, other in ((12, 18), (6, 12), (7, 3)):
        n = model.expand(model.Node("integer", {"multiple": own}), model.Node("integer", {"multiple": other}))
        out.append((own, other, float(n.get("multiple", 0))))
    return literal(spark, out, "own int, other int, multiple double")


@query("schema_walk", "SELECT * FROM (VALUES ('$', 'object'), ('$.a', 'array'), ('$.a[*]', 'integer'), ('$.b', 'array'), ('$.b[0]', 'integer'), ('$.b[1]', 'string'), ('$.c', 'product'), ('$.c[0]', 'boolean'), ('$.c[1]', 'null')) AS t(path, kind)")
def schema_walk(spark, sf):
    n = folded({"a": [1], "b": [1, "x"], "c": True}, {"a": [1, 2], "b": [2, "y"], "c": None})
    return literal(spark, [(p, x.kind) for p, x in model.walk(n)], "path string, kind string")


@query("schema_edits", "SELECT * FROM (VALUES ('replace', 'a:string,b:integer'), ('only_keys', 'b:integer'), ('only_facts', 'a:integer,b:integer')) AS t(edit, keys)")
def schema_edits(spark, sf):
    n = of_value({"a": 1, "b": 2})
    show = lambda x: ",".join(f"{k}:{v.kind}" for k, v in sorted(x.keys.items()))
    return literal(spark, [("replace", show(model.replace_at(n, "/a", of_value("x")))), ("only_keys", show(model.only_keys(n, {"b"}))), ("only_facts", show(model.only_facts(n, {"minimum"})))], "edit string, keys string")


@query("serving_protocol", "SELECT * FROM (VALUES (1, 'true,false'), (2, 'skipped')) AS t(seq, reply)")
def serving_protocol(spark, sf):
    asked = [{"cmd": "start", "version": 1}, {"cmd": "dialect"}, {"cmd": "run", "seq": 1, "case": {"schema": {"type": "integer"}, "tests": [{"instance": 1}, {"instance": "x"}]}}, {"cmd": "run", "seq": 2, "case": {"schema": {"if": {}}, "tests": []}}, {"cmd": "stop"}]
    out = io.StringIO()
    serve(io.StringIO("\n".join(map(json.dumps, asked))), out)
    rows = []
    for reply in map(json.loads, out.getvalue().splitlines()):
        if "seq" in reply:
            rows.append((reply["seq"], "skipped" if reply.get("skipped") else ",".join(str(r["valid"]).lower() for r in reply["results"])))
    return literal(spark, rows, "seq int, reply string")


@query("value_csv", "SELECT 0 AS line, '$.r_name' AS cell UNION ALL SELECT row_number() OVER (ORDER BY r_name), r_name FROM (SELECT DISTINCT r_name FROM region)")
def value_csv_query(spark, sf):
    n = discover_schema(docs_of(spark, sf, "region", "r_regionkey", r_name="r_name"))
    return literal(spark, [(k, r[0]) for k, r in enumerate(value_rows(n))], "line int, cell string")


@query("windowed_key_counts", "SELECT count(DISTINCT date_trunc('hour', ts))::BIGINT AS windows, count(*)::BIGINT AS documents FROM events WHERE props IS NOT NULL")
def windowed_key_counts(spark, sf):
    docs = table(spark, sf, "events").where("props IS NOT NULL").select("ts", F.col("props").alias("json"))
    counts = key_counts(docs, "ts", "1 hour")
    return counts.agg(F.count_distinct("start").alias("windows"), F.sum("documents").alias("documents"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The property table of orders as documents, with every plain fact."""
    d = discover(from_table(table(spark, sf, "orders"), "o_orderkey"))
    return d.table.select("path", "type", "count", "min_d", "max_d", "min_length", "max_length", "distinct")


def document_of(spark: SparkSession, sf: str, name: str, id_: str) -> dict:
    return json.loads(schema_json(discover_schema(from_table(table(spark, sf, name), id_))))
