"""Joins: every kind, on keys, conditions and names."""

from pyspark.sql import functions as F

from tessera.operators.relational import join_keep_order
from tessera.plans.registry import query
from tessera.sources.tables import load


@query("J1", oracle="SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner_eq(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query(
    "J2",
    oracle="""SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000""",
)
def join_using_order(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where(F.col("o_totalprice") > 100000).select("o_orderkey", "o_custkey", "o_totalprice")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return join_keep_order(o, c, "o_custkey")


@query(
    "J3",
    oracle="""SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > p_size""",
)
def join_multi_cond(spark, sf_dir):
    i, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return i.join(p, [i.l_partkey == p.p_partkey, i.l_quantity > p.p_size]).select("l_orderkey", "l_linenumber", "p_partkey")


#: All rows of both tables; keys moved out of the other side's range make rows without a partner.
_LEFT = "(SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, c_name FROM customer) c"
_RIGHT = "(SELECT o_orderkey, CASE WHEN o_custkey % 2 = 1 THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey FROM orders) o"


def _sides(spark, sf_dir):
    c_key, o_key = F.col("c_custkey"), F.col("o_custkey")
    c = load(spark, sf_dir, "customer").select(F.when(c_key % 3 == 0, -c_key).otherwise(c_key).alias("c_custkey"), "c_name")
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(o_key % 2 == 1, o_key + 1_000_000_000).otherwise(o_key).alias("o_custkey"))
    return c, o


@query("J4", oracle=f"SELECT c_custkey, c_name, o_orderkey FROM {_LEFT} LEFT JOIN {_RIGHT} ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    c, o = _sides(spark, sf_dir)
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "o_orderkey")


@query("J5", oracle=f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM {_LEFT} RIGHT JOIN {_RIGHT} ON c_custkey = o_custkey")
def join_right(spark, sf_dir):
    c, o = _sides(spark, sf_dir)
    return c.join(o, c.c_custkey == o.o_custkey, "right").select("c_custkey", "c_name", "o_orderkey", "o_custkey")


@query("J6", oracle=f"SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name, o_orderkey FROM {_LEFT} FULL JOIN {_RIGHT} ON c_custkey = o_custkey")
def join_full(spark, sf_dir):
    c, o = _sides(spark, sf_dir)
    return join_keep_order(c.withColumnRenamed("c_custkey", "custkey"), o.withColumnRenamed("o_custkey", "custkey"), "custkey", "full")


@query("J7", oracle="SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").where(F.col("o_totalprice") > 200000)
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query(
    "J8",
    oracle="""SELECT s_suppkey, k FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier) s
              WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1 AND n_nationkey = k)""",
)
def join_anti(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey")).alias("k"))
    n = load(spark, sf_dir, "nation").where("n_regionkey = 1")
    return s.join(n, s.k == n.n_nationkey, "left_anti")


@query("J9", oracle="SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    return load(spark, sf_dir, "region").select("r_name").crossJoin(load(spark, sf_dir, "nation").select("n_name"))


@query("J1", "J13", oracle="SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("a_key"), F.col("n_regionkey").alias("a_region"))
    b = n.select(F.col("n_nationkey").alias("b_key"), F.col("n_regionkey").alias("b_region"))
    return a.join(b, (F.col("a_region") == F.col("b_region")) & (F.col("a_key") < F.col("b_key"))).select("a_key", "b_key")


_NULLED = "CASE WHEN {k} % 4 <> 0 THEN {k} END"


@query(
    "J10", "E6",
    oracle=f"""SELECT a.n_nationkey AS n_nationkey, b.s_suppkey AS s_suppkey
               FROM (SELECT n_nationkey, {_NULLED.format(k='n_nationkey')} AS k FROM nation) a
               JOIN (SELECT s_suppkey, {_NULLED.format(k='s_nationkey')} AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k""",
)
def join_null_safe(spark, sf_dir):
    a = load(spark, sf_dir, "nation").select("n_nationkey", F.expr(_NULLED.format(k="n_nationkey")).alias("ka"))
    b = load(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_NULLED.format(k="s_nationkey")).alias("kb"))
    return a.join(b, a.ka.eqNullSafe(b.kb)).select("n_nationkey", "s_suppkey")


@query("J11", oracle="SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON TRUE WHERE n_nationkey > r_regionkey GROUP BY r_regionkey")
def join_constant(spark, sf_dir):
    r, n = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    return r.join(n, F.lit(True)).where("n_nationkey > r_regionkey").groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("P18", "J1", oracle="SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    n = F.broadcast(load(spark, sf_dir, "nation"))  # nations are a fixed list
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name")


@query("J12", "P5", "P4", oracle="SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")
def self_join_alias(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.col("a.n_nationkey") == F.col("b.n_regionkey")).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query(
    "J12", "P3",
    oracle="""SELECT n.n_nationkey AS nationkey, n.n_name AS n_name, m.n_name AS upper_name
              FROM nation n JOIN (SELECT n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_regionkey <> 2) m USING (n_nationkey)""",
)
def join_diamond(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name", "n_regionkey")
    upper = n.where("n_regionkey <> 2").select("nationkey", F.upper("n_name").alias("upper_name"))
    return join_keep_order(n, upper, ["nationkey"]).drop("n_regionkey")
