"""Window functions and frames."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.tables import load


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


_SQL_BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@query("W8", "W1", "X8", oracle="SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rn FROM orders) WHERE rn <= 3")
def row_number_topk(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("W9", "W10", oracle="SELECT p_partkey, rank() OVER w::INTEGER AS r, dense_rank() OVER w::INTEGER AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def rank_dense_rank(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return load(spark, sf_dir, "part").select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query(
    "W11", "W12",
    oracle=f"""SELECT event_id, lag(event_type, 1, 'none') OVER w AS before, lead(event_id, 2) OVER w AS after2,
               lag(event_id, -1) OVER w AS next_id, lag(event_id, 0) OVER w AS same_id FROM events WINDOW w AS ({_SQL_BY_USER})""",
)
def lag_lead_default(spark, sf_dir):
    w = _by_user()
    return load(spark, sf_dir, "events").select(
        "event_id", F.lag("event_type", 1, "none").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after2"),
        F.lag("event_id", -1).over(w).alias("next_id"), F.lag("event_id", 0).over(w).alias("same_id"),
    )


@query("W5", "W13", "A6", oracle=f"SELECT event_id, round(sum(value) OVER ({_SQL_BY_USER}), 2) AS running FROM events")
def running_sum(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(_by_user()), 2).alias("running"))


@query("W2", "W4", oracle=f"SELECT event_id, max(event_id) OVER ({_SQL_BY_USER} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS m, count(*) OVER ({_SQL_BY_USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM events")
def rows_frame(spark, sf_dir):
    before = _by_user().rowsBetween(-2, -1)
    rest = _by_user().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return load(spark, sf_dir, "events").select("event_id", F.max("event_id").over(before).alias("m"), F.count("*").over(rest).alias("n"))


@query("W3", oracle="SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n FROM part")
def range_frame(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 2)
    return load(spark, sf_dir, "part").select("p_partkey", F.count("*").over(w).alias("n"))


@query("W5", "W13", "W14", oracle="SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, min(c_name) OVER (PARTITION BY c_nationkey) AS low, max(c_custkey) OVER (PARTITION BY c_mktsegment) AS high FROM customer")
def window_count_partition(spark, sf_dir):
    nation, segment = Window.partitionBy("c_nationkey"), Window.partitionBy("c_mktsegment")
    return load(spark, sf_dir, "customer").select("c_custkey", F.count("*").over(nation).alias("n"), F.min("c_name").over(nation).alias("low"), F.max("c_custkey").over(segment).alias("high"))


@query(
    "A10", "A11", "W13",
    oracle=f"""SELECT event_id, first(v IGNORE NULLS) OVER ({_SQL_BY_USER}) AS first_v, last(v IGNORE NULLS) OVER ({_SQL_BY_USER}) AS last_v, last(v) OVER ({_SQL_BY_USER}) AS v
               FROM (SELECT *, CASE WHEN value > 50 THEN event_id END AS v FROM events)""",
)
def first_last_ignore_nulls(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("x", F.when(F.col("value") > 50, F.col("event_id")))
    return e.select("event_id", F.first("x", True).over(_by_user()).alias("first_v"), F.last("x", True).over(_by_user()).alias("last_v"), F.last("x").over(_by_user()).alias("v"))


@query(
    "W6",
    oracle="""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY k ASC NULLS FIRST, c_custkey)::INTEGER AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY k DESC NULLS LAST, c_custkey)::INTEGER AS down
              FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS k FROM customer)""",
)
def window_nulls_order(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("k"))
    nation = Window.partitionBy("c_nationkey")
    up, down = nation.orderBy(F.asc("k"), "c_custkey"), nation.orderBy(F.col("k").desc(), "c_custkey")
    return c.select("c_custkey", F.row_number().over(up).alias("up"), F.row_number().over(down).alias("down"))


@query("W7", "W13", oracle="SELECT l_orderkey, l_linenumber, 1 + (l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey)) AS at, approx_n FROM (SELECT *, count(DISTINCT l_linestatus) OVER (PARTITION BY l_returnflag) AS approx_n FROM lineitem)")
def window_in_expression(spark, sf_dir):
    order, flag = Window.partitionBy("l_orderkey"), Window.partitionBy("l_returnflag")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1 + (F.col("l_linenumber") - F.min("l_linenumber").over(order))).alias("at"), F.approx_count_distinct("l_linestatus").over(flag).alias("approx_n"))


@query("W15", oracle="""SELECT c_custkey, ntile(4) OVER w::INTEGER AS quarter, percent_rank() OVER w AS share, cume_dist() OVER w AS below, nth_value(c_custkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")  # fmt: skip
def ranks_beyond(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf_dir, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"), F.percent_rank().over(w).alias("share"), F.cume_dist().over(w).alias("below"), F.nth_value("c_custkey", 2).over(whole).alias("second"))
