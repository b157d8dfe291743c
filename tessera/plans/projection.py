"""Sources, sinks, projection, filters and column resolution."""

from pyspark.sql import functions as F

from tessera.operators.relational import materialize, with_columns
from tessera.plans.registry import query
from tessera.sources.infer import create_dataframe
from tessera.sources.shared import fresh_path
from tessera.sources.tables import load, read_csv, register, write_csv, write_parquet


@query("IO4", "P1", oracle="SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5")
def scan_parquet(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").where(F.col("l_quantity") < 5).select("l_orderkey", "l_quantity")


@query("IO3", "IO4", oracle="SELECT r_regionkey, r_name FROM region")
def scan_parquet_schema(spark, sf_dir):
    return spark.read.schema("r_regionkey int, r_name string").parquet(f"{sf_dir}/region.parquet")


@query("IO2", "IO8", oracle="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "csv")
    write_csv(load(spark, sf_dir, "nation"), path)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int", header=True)


@query("IO7", "IO10", oracle="SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "parquet")
    write_parquet(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ("o_orderstatus",), "zstd")
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("IO9", "IO5", oracle="SELECT r_regionkey, r_name FROM region")
def saved_table(spark, sf_dir):
    path = fresh_path(spark, "table")
    name = path.rpartition("/")[2].replace("-", "_")
    load(spark, sf_dir, "region").write.option("path", path).saveAsTable(name)
    return spark.table(name)


@query("IO5", "S10", oracle="SELECT r_name FROM region WHERE r_regionkey > 1")
def temp_view_table(spark, sf_dir):
    register(load(spark, sf_dir, "region"), "tessera_region")
    return spark.sql("SELECT r_name FROM tessera_region WHERE r_regionkey > 1")


@query("IO1", oracle="SELECT * FROM (VALUES (1, 1.0::DOUBLE, 'x', NULL), (NULL, 2.5, '7', 3000000000)) t(a, b, c, d)")
def create_dataframe_infer(spark, sf_dir):
    return create_dataframe(spark, [{"a": 1, "b": 1, "c": "x"}, {"b": 2.5, "c": 7, "d": 3_000_000_000}])


@query("IO1", oracle="""SELECT * FROM (VALUES (1, 2.5::DOUBLE, 'x', 'k=1', 's:7'), (2, NULL, NULL, 'k=2,m=3', 's:'), (NULL, 1.0, 'y', '', ':9')) t(a, b, c, m, s)""")
def create_dataframe_schema(spark, sf_dir):
    """Rows under an explicit schema: types as given, maps, structs of mappings and of tuples, and NaN as null."""
    schema = "a int, b double, c string, m map<string,int>, s struct<p:string,q:int>"
    frame = create_dataframe(spark, [[1, 2.5, "x", {"k": 1}, {"p": "s", "q": 7}], [2, float("nan"), None, {"k": 2, "m": 3}, ("s", None)], [None, 1, "y", {}, {"q": 9}]], schema)
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return frame.select("a", "b", "c", entries.alias("m"), F.concat(F.coalesce("s.p", F.lit("")), F.lit(":"), F.coalesce(F.col("s.q").cast("string"), F.lit(""))).alias("s"))


@query("IO1", "IO14", oracle="SELECT r_regionkey AS k, r_name AS name, CASE WHEN r_regionkey > 1 THEN r_regionkey / 2.0 END AS half FROM region")
def create_dataframe_pandas(spark, sf_dir):
    """A pandas frame under an explicit schema, by position; its missing values are null."""
    held = load(spark, sf_dir, "region").select("r_regionkey", "r_name", F.expr("CASE WHEN r_regionkey > 1 THEN r_regionkey / 2.0D END AS h")).toPandas()
    return create_dataframe(spark, held, "k int, name string, half double")


@query("IO1", "E1", oracle="SELECT 1 AS one, 'x' AS x")
def create_dataframe_one_row(spark, sf_dir):
    return create_dataframe(spark, [[]]).select(F.lit(1).alias("one"), F.lit("x").alias("x"))


@query("IO2", "IO8", oracle="SELECT r_regionkey::VARCHAR AS _c0, r_name AS _c1 FROM region")
def csv_without_schema(spark, sf_dir):
    """A folder of CSV files read without a schema: all strings."""
    path = fresh_path(spark, "csv")
    write_csv(load(spark, sf_dir, "region").repartition(3, "r_regionkey"), path, header=False)
    return read_csv(spark, path)


@query("IO15", "S6", oracle="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def eager_cache(spark, sf_dir):
    grouped = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return materialize(grouped)


@query("IO15", "S6", oracle="SELECT c_nationkey, count(*) AS n, true AS there FROM customer GROUP BY c_nationkey")
def cache_path(spark, sf_dir):
    """The folder of eager caches as an option of the session."""
    folder = fresh_path(spark, "cache-path")
    spark.conf.set("tessera.cache_path", folder)
    try:
        held = materialize(load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")))
    finally:
        spark.conf.unset("tessera.cache_path")
    return held.withColumn("there", F.lit(all(folder in f for f in held.inputFiles())))


@query("IO12", oracle="SELECT count(*) AS n FROM events WHERE value > 10")
def count_action(spark, sf_dir):
    n = load(spark, sf_dir, "events").where("value > 10").count()
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"))


@query("IO13", oracle="SELECT count(*) = 0 AS none, false AS empty FROM events WHERE value < -1e18")
def is_empty(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    none, some = e.where("value < -1e18").isEmpty(), e.isEmpty()
    return spark.range(1).select(F.lit(none).alias("none"), F.lit(some).alias("empty"))


@query("P2", "P1", oracle="SELECT *, n_nationkey * 2 AS twice FROM nation")
def select_star(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("*", (F.col("n_nationkey") * 2).alias("twice"))


@query("P4", "P5", "P3", oracle="SELECT c_custkey, n_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def select_alias_star(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer").alias("c"), load(spark, sf_dir, "nation").alias("n")
    return c.join(n, F.col("c.c_nationkey") == F.col("n.n_nationkey")).select("c.c_custkey", "n.*")


@query("P6", "P9", "P7", oracle="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20 AND (l_discount < 0.03 OR l_returnflag = 'R') AND NOT l_linestatus = 'O'")
def where_compound(spark, sf_dir):
    i = load(spark, sf_dir, "lineitem")
    kept = i.where((i["l_quantity"] > 20) & ((i.l_discount < 0.03) | (F.col("l_returnflag") == "R")) & ~(F.col("l_linestatus") == "O"))
    return kept.select(i[0], i["l_linenumber"])


@query("P9", oracle="SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")
def where_boolean_name(spark, sf_dir):
    return load(spark, sf_dir, "orders").withColumn("large", F.col("o_totalprice") > 150000).filter("large").select("o_orderkey")


@query("P10", "P11", oracle="SELECT s_suppkey + 1 AS s_suppkey, s_nationkey, s_suppkey * 10 AS tenfold, upper(s_name) AS up FROM supplier")
def with_columns_many(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    new = with_columns(s, {"s_suppkey": F.col("s_suppkey") + 1}, {"tenfold": F.col("s_suppkey") * 10, "up": F.upper("s_name")})
    return new.select("s_suppkey", "s_nationkey", "tenfold", "up")


@query("P12", "P13", "P14", oracle="SELECT r_regionkey AS id, r_name AS label FROM region")
def rename_drop(spark, sf_dir):
    r = load(spark, sf_dir, "region").withColumn("extra", F.lit(1)).withColumnRenamed("missing", "x")
    return r.withColumnsRenamed({"r_regionkey": "id", "r_name": "label"}).drop("extra", "missing")


@query("P15", "P16", oracle="SELECT n_nationkey + 1 AS plus, n_regionkey AS \"region key\" FROM nation")
def alias_expressions(spark, sf_dir):
    return load(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("plus"), F.col("n_regionkey").alias("region key"))


@query("P17", oracle="SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def replace_string(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").replace("F", "done")


@query("P19", "P21", oracle="SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark")
def explode_words(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word"))


@query("P20", oracle="SELECT n_nationkey, v FROM nation LEFT JOIN (SELECT n_nationkey AS k, unnest([n_regionkey, n_nationkey]) AS v FROM nation WHERE n_nationkey % 2 = 0) ON k = n_nationkey")
def explode_outer(spark, sf_dir):
    pair = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_regionkey", "n_nationkey"))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.explode_outer(pair).alias("v"))


@query("P21", oracle="SELECT r_name, unnest([1, 2, 3]) AS n FROM region")
def explode_with_column(spark, sf_dir):
    return load(spark, sf_dir, "region").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("r_name", "n")


@query("P7", "P8", "C1", "E20", oracle="SELECT n_name AS name, n_regionkey AS region FROM nation")
def struct_path(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("at")).alias("s")).alias("t")
    return n.select("t.s.name", F.col("s.at")["region"].alias("region"))
