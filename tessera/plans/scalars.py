"""String, regex, JSON, hash and date functions."""

from pyspark.sql import functions as F

from tessera.functions.compat import consecutive_id
from tessera.plans.registry import query
from tessera.sources.tables import load


@query("F1", oracle="SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '-', 'g') AS t FROM part")
def regexp_replace(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_type", "[AEIOU]", "-").alias("t"))


@query("F2", oracle="SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS n, regexp_extract(c_name, 'zzz', 0) AS none FROM customer")
def regexp_extract(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).alias("n"), F.regexp_extract("c_name", "zzz", 0).alias("none"))


@query("F3", "C4", oracle="SELECT p_partkey, string_split_regex(p_type, ' +')[1] AS head, len(string_split_regex(p_type, ' +'))::INTEGER AS n FROM part")
def split_element_at(spark, sf_dir):
    parts = F.split("p_type", " +")
    return load(spark, sf_dir, "part").select("p_partkey", F.element_at(parts, 1).alias("head"), F.size(parts).alias("n"))


@query("F4", oracle="SELECT p_partkey, split_part(p_type, ' ', 1) AS a, split_part(p_type, ' ', -1) AS b, split_part(p_type, ' ', 99) AS c FROM part")
def split_part(spark, sf_dir):
    part = lambda n: F.split_part("p_type", F.lit(" "), F.lit(n))
    return load(spark, sf_dir, "part").select("p_partkey", part(1).alias("a"), part(-1).alias("b"), part(99).alias("c"))


_NULLED = "CASE WHEN n_nationkey % 2 = 0 THEN n_name END"


@query("F5", "F7", oracle=f"SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '-' || n_regionkey END AS a, concat_ws('/', {_NULLED}, 'x', n_regionkey) AS b FROM nation")
def concat_concat_ws(spark, sf_dir):
    half = F.expr(_NULLED)
    return load(spark, sf_dir, "nation").select("n_nationkey", F.concat(half, F.lit("-"), "n_regionkey").alias("a"), F.concat_ws("/", half, F.lit("x"), F.col("n_regionkey").cast("string")).alias("b"))


@query("F6", oracle="SELECT n_nationkey, array_to_string([n_nationkey, n_regionkey] || [7], ',') AS a FROM nation")
def concat_arrays(spark, sf_dir):
    both = F.concat(F.array("n_nationkey", "n_regionkey"), F.array(F.lit(7)))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(",", both.cast("array<string>")).alias("a"))


@query("F8", "F9", oracle="SELECT n_nationkey, lpad(n_name, 6, '*') AS a, length(n_name)::INTEGER AS n, length(n_nationkey::VARCHAR)::INTEGER AS m FROM nation")
def lpad_length(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.lpad("n_name", 6, "*").alias("a"), F.length("n_name").alias("n"), F.length(F.col("n_nationkey").cast("string")).alias("m"))


@query("F10", "F11", "F12", oracle="SELECT r_regionkey, trim('  ' || r_name || ' ') AS t, upper(r_name) AS u, lower(r_name) AS l FROM region")
def trim_case(spark, sf_dir):
    return load(spark, sf_dir, "region").select("r_regionkey", F.trim(F.concat(F.lit("  "), "r_name", F.lit(" "))).alias("t"), F.upper("r_name").alias("u"), F.lower("r_name").alias("l"))


@query("F13", oracle="SELECT n_nationkey, substring(n_name, 2, 3) AS a, substring(n_name, -3, 2) AS b, substring(n_name, 1, 2) AS c FROM nation")
def substring_cases(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.substring("n_name", 2, 3).alias("a"), F.substring("n_name", -3, 2).alias("b"), F.substring("n_name", 0, 2).alias("c"))


@query("F14", "F15", oracle="SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, round(c_custkey, -1)::BIGINT AS t FROM customer")
def abs_round(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("a"), F.round("c_acctbal", 1).alias("r"), F.round("c_custkey", -1).alias("t"))


@query("F16", oracle="SELECT 16 AS buckets, count(*) AS n FROM customer")
def hash_buckets(spark, sf_dir):
    bucket = F.pmod(F.hash("c_custkey", "c_name"), F.lit(16))
    return load(spark, sf_dir, "customer").agg(F.count_distinct(bucket).cast("int").alias("buckets"), F.count(F.xxhash64("c_custkey")).alias("n"))


@query("F17", oracle="SELECT count(*) AS n, count(*) AS n_ids, true AS apart FROM events")
def monotonic_id_unique(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("id", F.monotonically_increasing_id())
    n = F.count("*")
    return e.agg(n.alias("n"), F.count_distinct("id").alias("n_ids"), (n == F.count_distinct("id")).alias("apart"))


@query("F17", "W8", oracle="SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INTEGER AS id FROM events")
def consecutive_ids(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", consecutive_id("event_id", partition=["event_type"]).alias("id"))


@query("F18", oracle="SELECT r_regionkey, true AS past FROM region")
def now_not_null(spark, sf_dir):
    return load(spark, sf_dir, "region").select("r_regionkey", (F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")).alias("past"))


@query("F19", oracle="SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def from_json_map(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query("F19", oracle="SELECT event_id, props->>'k' AS k, NULL::BIGINT AS bad, event_id < 0 AS nulls FROM events")
def from_json_edges(spark, sf_dir):
    as_map = F.from_json("props", "map<string,string>")
    bad = F.from_json(F.lit("{oops"), "struct<k:bigint>")["k"]
    return load(spark, sf_dir, "events").select("event_id", as_map["k"].alias("k"), bad.alias("bad"), as_map.isNull().alias("nulls"))


_DAY = "CAST(o_orderdate AS DATE)"


@query("D1", "D2", oracle=f"SELECT o_orderkey, ({_DAY} + 40)::DATE AS later, ({_DAY} - o_orderkey::INTEGER % 30)::DATE AS before, NULL::DATE AS bad FROM orders")
def date_add_sub(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.date_add(day, 40).alias("later"), F.date_sub(day, (F.col("o_orderkey") % 30).cast("int")).alias("before"), F.date_add(F.lit("no date"), 1).alias("bad"))


@query("D3", oracle=f"SELECT o_orderkey, (dayofweek({_DAY}) + 1)::INTEGER AS d FROM orders")
def dayofweek(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.dayofweek("o_orderdate").alias("d"))


@query("D4", oracle=f"SELECT o_orderkey, strftime({_DAY}, '%Y-%m-%d') AS s FROM orders")
def date_format(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))


@query("D5", oracle=f"SELECT o_orderkey, {_DAY} AS a, {_DAY} AS b, {_DAY} AS c, NULL::DATE AS bad FROM orders")
def to_date_formats(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    a, b, c = (F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "d.M.yyyy", "MMM dd yyyy"))
    return o.select("o_orderkey", F.to_date(a).alias("a"), F.to_date(b, "d.M.yyyy").alias("b"), F.to_date(c, "MMM dd yyyy").alias("c"), F.to_date(F.lit("a"), "yyyy-MM-dd").alias("bad"))


@query("D6", oracle="SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, NULL::VARCHAR AS bad FROM events")
def to_timestamp(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    back = F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", F.date_format(back, "yyyy-MM-dd HH:mm:ss").alias("s"), F.to_timestamp(F.lit("a")).cast("string").alias("bad"))


@query("D7", oracle="SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'")
def timestamp_to_date(spark, sf_dir):
    i = load(spark, sf_dir, "lineitem")
    year = (F.col("l_shipdate") >= F.lit("1996-01-01").cast("date")) & (F.col("l_shipdate") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    return i.where(year).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
