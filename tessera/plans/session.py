"""Sessions, configuration, catalog and actions, and a few operators beyond the inventory."""

import io
from collections.abc import Iterator
from contextlib import redirect_stdout

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import PROFILE, described, profile
from tessera.sources.infer import create_dataframe
from tessera.sources.shared import fresh_path
from tessera.sources.tables import load


@query("S1", "S2", "S3", "S4", "S7", "S12", "X6", oracle="SELECT true AS active, 'false' AS ansi, 'none' AS unset, 'tessera' AS described, true AS refused, true AS configured")
def session_conf(spark, sf_dir):
    from pyspark.errors import AnalysisException

    spark = profile(spark)
    spark.sparkContext.setLocalProperty("callSite.short", "tessera")
    try:
        spark.range(1).select("missing").schema  # noqa: B018
        refused = False
    except AnalysisException:
        refused = True
    told = spark.sparkContext.getLocalProperty("callSite.short")
    spark.sparkContext.setLocalProperty("callSite.short", None)
    active = spark.getActiveSession() is not None and all(spark.conf.get(k) == v for k, v in PROFILE.items())
    return create_dataframe(spark, [{"active": active, "ansi": spark.conf.get("spark.sql.ansi.enabled"), "unset": spark.conf.get("tessera.none", "none"), "described": told, "refused": refused, "configured": spark.sparkContext.getConf().contains("spark.app.name")}])


@query("S5", oracle="SELECT 'call_stack' AS caller, 2::BIGINT AS frames, 0::BIGINT AS without, count(*) AS n FROM region")
def call_stack(spark, sf_dir):
    """The frames that an action logs, with the option and without."""
    region = load(spark, sf_dir, "region")
    with described(spark, "count") as none:
        region.count()
    spark.conf.set("tessera.call_stack_depth", "2")
    try:
        with described(spark, "count") as frames:
            n = region.count()
    finally:
        spark.conf.unset("tessera.call_stack_depth")
    told = F.lit(frames[0].rpartition(" - ")[2]).alias("caller"), *[F.lit(x).cast("bigint").alias(name) for name, x in (("frames", len(frames)), ("without", len(none)), ("n", n))]
    return spark.range(1).select(*told)


@query("S8", "S9", "IO16", oracle="SELECT 'tessera_catalog' AS name, true AS temporary, 5::BIGINT AS n, true AS held, false AS unpersisted, false AS cleared FROM region LIMIT 1")
def catalog_tables(spark, sf_dir):
    load(spark, sf_dir, "region").createOrReplaceTempView("tessera_catalog")
    table = spark.catalog.getTable("tessera_catalog")
    frame = spark.table("tessera_catalog").cache()
    n, held = frame.count(), spark.catalog.isCached("tessera_catalog")
    frame.unpersist()
    unpersisted = spark.catalog.isCached("tessera_catalog")
    spark.table("tessera_catalog").cache().count()
    spark.catalog.clearCache()
    told = {"name": table.name, "temporary": table.isTemporary, "n": n, "held": held, "unpersisted": unpersisted, "cleared": spark.catalog.isCached("tessera_catalog")}
    return spark.range(1).select(*[F.lit(v).cast({int: "bigint", str: "string", bool: "boolean"}[type(v)]).alias(k) for k, v in told.items()])


@query("IO17", "IO18", oracle="""SELECT * FROM (VALUES ('n_nationkey', 'int', ' |-- n_nationkey: integer (nullable = true)'), ('n_name', 'string', ' |-- n_name: string (nullable = true)'),
    ('pair', 'struct<a:int,b:array<string>>', ' |-- pair: struct (nullable = false)')) t(name, kind, line)""")  # fmt: skip
def schema_of_frame(spark, sf_dir):
    """Columns, dtypes and printed schema of a frame, none of which runs it."""
    frame = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.struct(F.col("n_regionkey").alias("a"), F.array("n_name").alias("b")).alias("pair"))
    printed = io.StringIO()
    with redirect_stdout(printed):
        frame.printSchema()
    line = {name: next(x for x in printed.getvalue().split("\n") if x.startswith(f" |-- {name}:")) for name in frame.columns}
    assert frame.columns == frame.schema.names
    return create_dataframe(spark, [{"name": name, "kind": kind, "line": line[name]} for name, kind in frame.dtypes])


@query("IO11", "IO14", oracle="SELECT r_regionkey, r_name FROM region")
def collect_and_pandas(spark, sf_dir):
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = [r.asDict() for r in region.limit(3).collect()]
    seen = {r["r_regionkey"] for r in rows}
    rest = region.where(~F.col("r_regionkey").isin(*seen)).toPandas()
    return create_dataframe(spark, [*rows, *({"r_regionkey": int(k), "r_name": str(n)} for k, n in rest.itertuples(index=False))])


@query("X7", "X11", oracle="WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM big WHERE total > (SELECT avg(total) FROM big)")
def sql_text(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("tessera_orders")
    return spark.sql("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM tessera_orders GROUP BY o_custkey) SELECT count(*) AS n FROM big WHERE total > (SELECT avg(total) FROM big)")


@query("X8", oracle="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_limit(spark, sf_dir):
    return load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("X9", oracle="SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf_dir):
    c = load(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return c.intersect(load(spark, sf_dir, "supplier").select("s_nationkey")).subtract(load(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("X10", oracle="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("X10", oracle="SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("X10", oracle="SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return load(spark, sf_dir, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.sum("l_quantity").alias("quantity"))


@query("X10", oracle="SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority")
def pivot(spark, sf_dir):
    wide = load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderkey"))
    return wide.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("X10", oracle="SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, sum(DISTINCT length(c_mktsegment))::BIGINT AS lengths FROM customer GROUP BY c_nationkey")
def distinct_aggregates(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("segments"), F.sum_distinct(F.length("c_mktsegment")).alias("lengths"))


@query("X2", oracle="SELECT p_partkey, p_retailprice * 1.1 + p_size AS taxed FROM part")
def vectorised_function(spark, sf_dir):
    """A user's function over Arrow batches, never row by row."""

    @F.pandas_udf("double")
    def taxed(price: pd.Series, size: pd.Series) -> pd.Series:
        return price * 1.1 + size

    return load(spark, sf_dir, "part").select("p_partkey", taxed("p_retailprice", "p_size").alias("taxed"))


@query("X3", oracle="SELECT s_nationkey, sum(cents * cents)::BIGINT AS squares, count(*) AS n FROM (SELECT s_nationkey, round(s_acctbal * 100)::BIGINT AS cents FROM supplier) GROUP BY s_nationkey")
def user_aggregate(spark, sf_dir):
    """A user's aggregate in two steps: partial sums of each task in Arrow batches, then Spark's own sums, so that a large group needs no task of its own."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squared = pa.table({"k": batch.column("k"), "n": pa.array([1] * batch.num_rows, pa.int64()), "t": pc.multiply(batch.column("v"), batch.column("v"))})
            summed = squared.group_by("k").aggregate([("n", "sum"), ("t", "sum")])
            yield from summed.select(["k", "n_sum", "t_sum"]).rename_columns(["k", "n", "t"]).to_batches()

    cents = F.round(F.col("s_acctbal") * 100).cast("long").alias("v")
    parts = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), cents).mapInArrow(partial, "k int, n long, t long")
    return parts.groupBy(F.col("k").alias("s_nationkey")).agg(F.sum("t").alias("squares"), F.sum("n").alias("n"))


@query("X3", oracle="SELECT n_nationkey, unnest(regexp_extract_all(n_name, '.')) AS letter FROM nation")
def user_table_function(spark, sf_dir):
    @F.udtf(returnType="letter string")
    class Letters:
        def eval(self, name: str):
            yield from ((c,) for c in name)

    spark.udtf.register("tessera_letters", Letters)
    load(spark, sf_dir, "nation").createOrReplaceTempView("tessera_nation")
    return spark.sql("SELECT n_nationkey, letter FROM tessera_nation, LATERAL tessera_letters(n_name)")


@query("X1", oracle="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_counts(spark, sf_dir):
    """Events read as a stream straight from their table until all files are done; each batch adds its counts by window to a table."""
    from tessera.streaming.events import event_stream, windows_stored

    folder = fresh_path(spark, "stream")
    stream = windows_stored(event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet"), f"{folder}/windows", f"{folder}/state")
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/windows").groupBy("event_type").agg(F.sum("n").alias("n"))
