"""Grouping, distinct, deduplication and unions."""

from pyspark.sql import functions as F

from tessera.operators.relational import drop_duplicates, union_by_name
from tessera.plans.registry import query
from tessera.sources.tables import load


@query("A1", "P16", oracle="SELECT o_custkey % 10 AS bucket, upper(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def group_expr_key(spark, sf_dir):
    keys = (F.col("o_custkey") % 10).alias("bucket"), F.upper("o_orderstatus").alias("status")
    return load(spark, sf_dir, "orders").groupBy(*keys).agg(F.count("*").alias("n"))


@query("A2", "A7", oracle="SELECT count(*) AS n, min(l_quantity) AS min_q, max(l_shipdate)::DATE AS last FROM lineitem")
def global_agg(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.min("l_quantity").alias("min_q"), F.max("l_shipdate").cast("date").alias("last"))


@query("A3", oracle="SELECT l_returnflag, (1 + sum(l_linenumber) + count(*) + 1)::BIGINT AS v FROM lineitem GROUP BY l_returnflag")
def agg_arithmetic(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((1 + F.sum("l_linenumber") + F.count("*") + 1).alias("v"))


@query("A4", oracle="SELECT DISTINCT o_orderstatus, CAST(NULL AS VARCHAR) AS nothing, 7 AS seven FROM orders")
def agg_constant(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.lit(None).cast("string").alias("nothing"), F.lit(7).alias("seven"))


@query("A5", oracle="SELECT event_type, count(*) AS n, count(CASE WHEN value > 50 THEN value END) AS n_high FROM events GROUP BY event_type")
def count_rows_and_values(spark, sf_dir):
    high = F.when(F.col("value") > 50, F.col("value"))
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(high).alias("n_high"))


@query("A6", oracle="SELECT l_linestatus, sum(l_linenumber)::BIGINT AS s_int, sum(l_quantity) AS s_double, sum(CAST(l_linenumber AS VARCHAR)::DOUBLE) AS s_text FROM lineitem GROUP BY l_linestatus")
def sum_types(spark, sf_dir):
    text = F.sum(F.col("l_linenumber").cast("string"))
    return load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum("l_linenumber").alias("s_int"), F.sum("l_quantity").alias("s_double"), text.alias("s_text"))


@query("A7", oracle="SELECT p_brand, min(p_name) AS min_name, max(p_size) AS max_size, min(p_retailprice) AS min_price FROM part GROUP BY p_brand")
def min_max(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_name").alias("min_name"), F.max("p_size").alias("max_size"), F.min("p_retailprice").alias("min_price"))


@query(
    "A8", "A9",
    oracle="""SELECT c_mktsegment, arg_min_null(v, c_custkey) AS first_v, arg_max_null(v, c_custkey) AS last_v
              FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_name END AS v FROM customer) GROUP BY c_mktsegment""",
)
def min_by_max_by(spark, sf_dir):
    v = F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min_by(v, "c_custkey").alias("first_v"), F.max_by(v, "c_custkey").alias("last_v"))


@query(
    "A10", "A11",
    oracle="""SELECT c_nationkey, any_value(v) AS only_v, any_value(v) AS same_v, bool_or(v IS NULL) AS some_null, true AS first_is_member FROM
              (SELECT c_nationkey, CASE WHEN c_acctbal > 0 THEN 'n' || c_nationkey END AS v FROM customer) GROUP BY c_nationkey""",
)
def first_last_group(spark, sf_dir):
    """In a group without an order, first and last are some value of it, and with ignorenulls one that isn't null."""
    rows = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("n"), "c_nationkey")).alias("v"))
    first, last = F.first("v", ignorenulls=True).alias("only_v"), F.last("v", ignorenulls=True).alias("same_v")
    inside = F.array_contains(F.collect_set("c_custkey"), F.first("c_custkey")) & F.array_contains(F.collect_set("c_custkey"), F.last("c_custkey"))
    return rows.groupBy("c_nationkey").agg(first, last, F.max(F.col("v").isNull()).alias("some_null"), inside.alias("first_is_member"))


@query("A12", oracle="SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*)::INTEGER AS n FROM nation GROUP BY n_regionkey")
def collect_list_sorted(spark, sf_dir):
    names = F.collect_list("n_name")
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat_ws(",", F.array_sort(names)).alias("names"), F.size(names).alias("n"))


@query("A13", oracle="SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_orderpriority")
def collect_set_sorted(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.concat_ws(",", F.array_sort(F.collect_set("o_orderstatus"))).alias("statuses"))


@query("A14", oracle="SELECT l_linestatus, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_linestatus")
def approx_distinct_lowcard(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.approx_count_distinct("l_returnflag").alias("n"))


@query("A15", oracle="SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("A16", oracle="SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def dedup_subset(spark, sf_dir):
    return drop_duplicates(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("A16", oracle="SELECT count(DISTINCT (o_orderstatus, o_orderpriority)) AS n FROM orders")
def dedup_any_survivor(spark, sf_dir):
    return load(spark, sf_dir, "orders").dropDuplicates(["o_orderstatus", "o_orderpriority"]).agg(F.count("*").alias("n"))


@query("A17", oracle="SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_names(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return union_by_name(n, load(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


@query("A17", oracle="SELECT n_nationkey AS k, n_name AS name, NULL::DOUBLE AS extra FROM nation UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_missing_cols(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("extra"), F.col("s_suppkey").alias("k"))
    return union_by_name(n, s, missing=True)


@query("A17", oracle="SELECT n_nationkey::DOUBLE AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier")
def union_widen(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v"))
    return union_by_name(n, load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v")))
