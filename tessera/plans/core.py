"""The flagship query."""

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.tables import load


@query(
    "A1", "A5", "A6", "J1", "IO4",
    oracle="""SELECT o_orderpriority, count(*) AS n_items, sum(l_quantity) AS sum_qty
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""",
)
def group_count_sum(spark, sf_dir):
    items, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n_items"), F.sum("l_quantity").alias("sum_qty"))
