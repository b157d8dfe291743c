"""Arrays, structs, maps and higher-order functions."""

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.tables import load


@query("C2", "C3", oracle="SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE -1 END AS n, len(string_split(n_name, 'A'))::INTEGER AS m FROM nation")
def array_build_size(spark, sf_dir):
    pair = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_nationkey", "n_regionkey"))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.size(pair).alias("n"), F.size(F.split("n_name", "A")).alias("m"))


@query("C5", oracle="SELECT n_nationkey, n_nationkey = 3 OR n_regionkey = 3 AS three, NULL::BOOLEAN AS none FROM nation")
def array_contains(spark, sf_dir):
    pair = F.array("n_nationkey", "n_regionkey")
    return load(spark, sf_dir, "nation").select("n_nationkey", F.array_contains(pair, 3).alias("three"), F.array_contains(F.lit(None).cast("array<int>"), 3).alias("none"))


@query("C6", oracle="SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_filter([n_nationkey, n_regionkey, 1], lambda x: x NOT IN (1, 2)))), ',') AS a FROM nation")
def array_except(spark, sf_dir):
    rest = F.array_except(F.array("n_nationkey", "n_regionkey", F.lit(1)), F.array(F.lit(1), F.lit(2)))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(",", F.array_sort(rest).cast("array<string>")).alias("a"))


@query("C7", oracle="SELECT n_nationkey, array_to_string(list_sort([n_regionkey, n_nationkey, 3]), ',') AS a FROM nation")
def array_sort(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(",", F.array_sort(F.array("n_regionkey", "n_nationkey", F.lit(3))).cast("array<string>")).alias("a"))


@query("C8", "P19", oracle="SELECT n_nationkey, x AS a, y AS b FROM (SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x, unnest(['p', NULL]) AS y FROM nation)")
def arrays_zip_explode(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").select("n_nationkey", F.array("n_nationkey", "n_regionkey").alias("x"), F.array(F.lit("p")).alias("y"))
    return rows.select("n_nationkey", F.explode(F.arrays_zip("x", "y")).alias("z")).select("n_nationkey", F.col("z.x").alias("a"), F.col("z.y").alias("b"))


@query("C9", oracle="SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm, CASE WHEN vec_id % 2 = 0 THEN len(embedding) * 10 END AS tenfold FROM embeddings")
def array_aggregate(spark, sf_dir):
    e = F.col("embedding")
    norm = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"), lambda a: F.round(a, 4))
    even = F.when(F.col("vec_id") % 2 == 0, e)
    return load(spark, sf_dir, "embeddings").select("vec_id", norm.alias("norm"), F.aggregate(even, F.lit(0).cast("bigint"), lambda a, x: a + 10).alias("tenfold"))


@query("C10", "C11", "C12", oracle="SELECT n_nationkey, 'a,b' AS k, n_nationkey || ',' || n_regionkey AS v FROM nation")
def create_map_keys_values(spark, sf_dir):
    m = F.create_map(F.lit("a"), "n_nationkey", F.lit("b"), "n_regionkey")
    return load(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(",", F.map_keys(m)).alias("k"), F.concat_ws(",", F.map_values(m).cast("array<string>")).alias("v"))


@query("C13", "C3", oracle="SELECT n_nationkey, 3 AS n, 'a,b,c' AS k, concat_ws(',', n_nationkey, 2, n_regionkey) AS v, 0 AS none FROM nation")
def map_concat(spark, sf_dir):
    m = F.map_concat(F.create_map(F.lit("a"), F.col("n_nationkey"), F.lit("b"), F.lit(2)), F.create_map(F.lit("c"), F.col("n_regionkey")))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.size(m).alias("n"), F.concat_ws(",", F.map_keys(m)).alias("k"), F.concat_ws(",", F.map_values(m).cast("array<string>")).alias("v"), F.size(F.map_concat()).alias("none"))


@query("C1", "A15", oracle="SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
def struct_distinct(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.struct("l_returnflag", F.col("l_linestatus").alias("s")).alias("x")).distinct().select(F.col("x.l_returnflag").alias("f"), "x.s")
