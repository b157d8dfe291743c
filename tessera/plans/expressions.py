"""Operators, predicates, casts and conditionals."""

from pyspark.sql import functions as F

from tessera.functions.compat import isin, safe_divide
from tessera.plans.registry import query
from tessera.sources.tables import load


@query("E1", oracle="SELECT r_regionkey, 1 AS i, 2.5::DOUBLE AS d, 'x' AS s, true AS b, DATE '2020-02-29' AS day, 'NaN'::DOUBLE AS nan, 2 AS second FROM region")
def literals(spark, sf_dir):
    import datetime as dt

    return load(spark, sf_dir, "region").select(
        "r_regionkey", F.lit(1).alias("i"), F.lit(2.5).alias("d"), F.lit("x").alias("s"), F.lit(True).alias("b"),
        F.lit(dt.date(2020, 2, 29)).alias("day"), F.lit(float("nan")).alias("nan"), F.lit([1, 2])[1].alias("second"),
    )


@query("E2", oracle="SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, CASE WHEN p_size = 1 THEN 1 END AS one FROM part")
def case_when(spark, sf_dir):
    band = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return load(spark, sf_dir, "part").select("p_partkey", band.alias("band"), F.when(F.col("p_size") == 1, 1).alias("one"))


@query("E2", oracle="SELECT r_regionkey, CASE WHEN r_regionkey > 1 THEN '1.5' ELSE r_name END AS v FROM region")
def case_widening(spark, sf_dir):
    return load(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_regionkey") > 1, F.lit(1.5)).otherwise(F.col("r_name")).alias("v"))


@query("E3", "E4", "E5", "E13", oracle="SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AS mid, l_linenumber <> 1 AS not_first, l_tax >= 0.05 AS taxed, l_discount <= 0.02 AS low, CAST(l_linenumber AS VARCHAR) = '3' AS third FROM lineitem")
def comparisons_between(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").between(10, 20).alias("mid"), (F.col("l_linenumber") != 1).alias("not_first"),
        (F.col("l_tax") >= 0.05).alias("taxed"), (F.col("l_discount") <= 0.02).alias("low"), (F.col("l_linenumber") == "3").alias("third"),
    )


_NULLED = "CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END"


@query("E6", oracle=f"SELECT s_suppkey, ({_NULLED}) IS NOT DISTINCT FROM 5 AS five, ({_NULLED}) IS NOT DISTINCT FROM NULL AS none FROM supplier")
def null_safe_eq(spark, sf_dir):
    k = F.expr(_NULLED)
    return load(spark, sf_dir, "supplier").select("s_suppkey", k.eqNullSafe(5).alias("five"), k.eqNullSafe(F.lit(None)).alias("none"))


@query("E7", "E8", oracle="SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS neg FROM (VALUES (true), (false), (NULL)) x(a), (VALUES (true), (false), (NULL)) y(b)")
def three_valued_logic(spark, sf_dir):
    a = spark.createDataFrame([(True,), (False,), (None,)], "a boolean")
    rows = a.crossJoin(a.toDF("b"))
    return rows.select("a", "b", (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (~F.col("a")).alias("neg"))


@query("E9", "E10", oracle="SELECT p_partkey, -p_size AS neg, p_size + 1 AS plus, 100 - p_size AS minus, p_size * 2.5::DOUBLE AS times, '2'::DOUBLE + p_size AS text FROM part")
def arith_mixed(spark, sf_dir):
    s = F.col("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", (-s).alias("neg"), (s + 1).alias("plus"), (100 - s).alias("minus"), (s * 2.5).alias("times"), (F.lit("2") + s).alias("text"))


@query("E11", oracle="SELECT p_partkey, p_size / nullif(p_size % 5, 0)::DOUBLE AS q, 1 / p_size::DOUBLE AS inv FROM part")
def div_nullif(spark, sf_dir):
    s = F.col("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", safe_divide(s, s % 5).alias("q"), (1 / s).alias("inv"))


@query("E12", oracle=f"SELECT s_suppkey, ({_NULLED}) IS NULL AS a, ({_NULLED}) IS NOT NULL AS b FROM supplier")
def null_tests(spark, sf_dir):
    k = F.expr(_NULLED)
    return load(spark, sf_dir, "supplier").select("s_suppkey", k.isNull().alias("a"), F.isnotnull(k).alias("b"))


@query("E14", oracle="SELECT n_nationkey, TRY_CAST(n_name AS DOUBLE) AS bad, CAST(n_nationkey AS VARCHAR) AS s, CAST(CAST(n_nationkey AS VARCHAR) AS BIGINT) AS back, n_nationkey <> 0 AS b, TRY_CAST('20201231x' AS DATE) AS day FROM nation")
def casts_try(spark, sf_dir):
    k = F.col("n_nationkey")
    return load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").cast("double").alias("bad"), k.cast("string").alias("s"), k.cast("string").cast("bigint").alias("back"), k.cast("boolean").alias("b"), F.lit("20201231x").cast("date").alias("day"))


@query("E15", oracle="SELECT n_nationkey, n_name IN ('ALGERIA', 'CHINA', 'PERU') AS a, n_nationkey IN (1, 2, n_regionkey) AS b FROM nation")
def isin_list(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", isin(F.col("n_name"), ["ALGERIA", "CHINA"], "PERU").alias("a"), isin(F.col("n_nationkey"), 1, 2, F.col("n_regionkey")).alias("b"))


@query("E16", "E17", oracle="SELECT p_partkey, p_name LIKE '%1_' AS a, regexp_matches(p_type, '^[A-Z]+ .*E') AS b FROM part")
def like_rlike(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").like("%1_").alias("a"), F.col("p_type").rlike("^[A-Z]+ .*E").alias("b"))


@query("E18", "E19", oracle="SELECT c_custkey, starts_with(c_mktsegment, 'A') AS a, ends_with(c_mktsegment, 'Y') AS b, contains(c_name, '9') AS c FROM customer")
def starts_ends_contains(spark, sf_dir):
    s = F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").select("c_custkey", s.startswith("A").alias("a"), s.endswith("Y").alias("b"), F.col("c_name").contains("9").alias("c"))


@query("E23", oracle=f"SELECT s_suppkey, coalesce({_NULLED}, -1) AS a, coalesce(NULL, s_name, 'x') AS b FROM supplier")
def coalesce_null(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.expr(_NULLED), F.lit(-1)).alias("a"), F.coalesce(F.lit(None), "s_name", F.lit("x")).alias("b"))


@query("E20", "E21", "E22", oracle="SELECT vec_id, embedding[1] AS first_v, NULL::FLOAT AS beyond, label AS by_field, label + 1 AS by_key, NULL::INTEGER AS no_key FROM embeddings")
def get_item_array_map_struct(spark, sf_dir):
    e, m = F.col("embedding"), F.create_map(F.lit("k"), F.col("label") + 1)
    return load(spark, sf_dir, "embeddings").select("vec_id", e[0].alias("first_v"), e.getItem(9999).alias("beyond"), F.struct(F.col("label").alias("f")).getField("f").alias("by_field"), m["k"].alias("by_key"), m.getItem("z").alias("no_key"))


@query("E21", "C4", oracle="SELECT n_nationkey, NULL::INTEGER AS below, n_regionkey AS last, NULL::INTEGER AS beyond FROM nation")
def array_index_edges(spark, sf_dir):
    a = F.array("n_nationkey", "n_regionkey")
    return load(spark, sf_dir, "nation").select("n_nationkey", a[-1].alias("below"), F.element_at(a, -1).alias("last"), F.element_at(a, 5).alias("beyond"))


@query("E24", oracle="""SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS rest, power(l_linenumber, 2) AS square, (l_linenumber & 3) AS both, (l_linenumber | 8) AS either, xor(l_linenumber, 5) AS one,
    l_shipmode_like AS liked, nullif(l_returnflag, 'N') AS flag, greatest(l_quantity, l_tax) AS most, least(l_quantity, l_tax) AS least FROM (SELECT *, l_returnflag ILIKE 'n%' AS l_shipmode_like FROM lineitem)""")  # fmt: skip
def arithmetic_beyond(spark, sf_dir):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7).alias("rest"), (n**2).alias("square"), n.bitwiseAND(3).alias("both"), n.bitwiseOR(8).alias("either"), n.bitwiseXOR(5).alias("one"),
        flag.ilike("n%").alias("liked"), F.nullif(flag, F.lit("N")).alias("flag"), F.greatest("l_quantity", "l_tax").alias("most"), F.least("l_quantity", "l_tax").alias("least"),
    )
