import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.compat import consecutive_id, isin, safe_divide
from tessera.operators.relational import drop_duplicates, join_keep_order, materialize, union_by_name, with_columns
from tessera.session import described
from tessera.sources.infer import common_type, create_dataframe, value_type
from tessera.sources.tables import read_csv, register, write_csv, write_parquet


def test_inference(spark):
    df = create_dataframe(spark, [{"a": 123, "b": "x"}, {"b": None, "c": [1, 2**40], "a": 123.5}])
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "array<bigint>")]
    assert [tuple(r) for r in df.collect()] == [(123.0, "x", None), (123.5, None, [1, 2**40])]
    assert [f.nullable for f in df.schema] == [False, True, True]
    assert create_dataframe(spark, [[1, True], [2**31, None]]).dtypes == [("_1", "bigint"), ("_2", "boolean")]
    assert create_dataframe(spark, [[dt.date(2020, 1, 1), dt.datetime(2020, 1, 1)]], ["d", "t"]).dtypes == [("d", "date"), ("t", "timestamp")]
    assert create_dataframe(spark, [[]]).count() == 1
    assert create_dataframe(spark, [[1], ["x"], [True]], ["v"]).collect()[2].v == "true"
    assert value_type(2**31 - 1) == T.IntegerType()
    with pytest.raises(TypeError):
        common_type(T.ArrayType(T.IntegerType()), T.IntegerType())
    with pytest.raises(TypeError):
        value_type(object())


def test_given_schemas(spark):
    every = "n void, b boolean, y tinyint, h smallint, i int, l bigint, f float, d double, e date, t timestamp, s string, r struct<s:string,i:int,b:boolean>, a array<string>, m map<string,string>"
    assert create_dataframe(spark, [], every).dtypes == [tuple(x.split(" ", 1)) for x in every.split(", ")]
    kind = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("r", T.StructType([T.StructField("x", T.IntegerType())]))])
    assert create_dataframe(spark, [[{"a": 1}, {"x": 2}], [None, (3,)], [{"b": float("nan")}, None]], kind).collect() == [({"a": 1.0}, (2,)), (None, (3,)), ({"b": None}, None)]
    assert create_dataframe(spark, [{"b": 1}], "a int, b int").collect() == [(None, 1)]
    maps = create_dataframe(spark, [[{"a": 1}], [{"b": 2.5, "c": None}]], ["m"])
    assert maps.dtypes == [("m", "map<string,double>")] and maps.collect()[1].m == {"b": 2.5, "c": None}
    frame = pd.DataFrame({"x": [1.0, None], "y": ["a", None]})
    assert create_dataframe(spark, frame, "k int, v string").collect() == [(1, "a"), (None, None)]
    with pytest.raises(TypeError):
        create_dataframe(spark, frame)
    assert create_dataframe(spark, [], ["a", "b"]).columns == ["a", "b"]


def test_duplicates_are_cut_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    plan = drop_duplicates(rows, ["k"], [F.desc("v")])._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:]


def test_call_stack(spark, caplog):
    with caplog.at_level("INFO", "tessera"), described(spark, "count") as none:
        pass
    assert none == [] and not caplog.records
    spark.conf.set("tessera.call_stack_depth", "1")
    with caplog.at_level("INFO", "tessera"), described(spark, "count") as frames:
        assert spark.sparkContext.getLocalProperty("spark.job.description").startswith("count at ")
    spark.conf.unset("tessera.call_stack_depth")
    assert len(frames) == 1 and frames[0].endswith("test_call_stack") and "count called at" in caplog.text


def test_joins_keep_order(spark):
    a = spark.createDataFrame([(1, "x", 9), (2, "y", 8), (None, "z", 7)], "p int, k string, v int")
    b = spark.createDataFrame([("x", 5), ("x", 6), ("q", 1)], "k string, w int")
    assert join_keep_order(a, b, "k").columns == ["p", "k", "v", "w"]
    assert sorted(map(tuple, join_keep_order(a, b, ["k"], "left").collect()), key=str) == sorted([(1, "x", 9, 5), (1, "x", 9, 6), (2, "y", 8, None), (None, "z", 7, None)], key=str)
    assert {(r.k, r.w) for r in join_keep_order(a, b, "k", "full").collect()} == {("x", 5), ("x", 6), ("y", None), ("z", None), ("q", 1)}
    assert join_keep_order(a, b, "k", "left_semi").collect() == [(1, "x", 9)]
    clash = b.withColumnRenamed("w", "v")
    assert join_keep_order(a, clash, "k").columns == ["p", "k", "v", "v"]


def test_columns_and_unions(spark, tmp_path):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    assert with_columns(a, {"a": F.col("b")}, {"c": F.col("a")}).collect() == [(2, 2, 1)]
    assert union_by_name(a, spark.createDataFrame([(3.5,)], "b double"), missing=True).dtypes == [("a", "int"), ("b", "double")]
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(drop_duplicates(rows, ["k"], ["v"]).collect()) == [(1, "a"), (2, "c")]
    kept = materialize(rows, str(tmp_path / "m"))
    assert kept.count() == 3 and "LogicalRDD" not in kept._jdf.queryExecution().toString()


def test_functions(spark):
    rows = spark.createDataFrame([(1, 0), (2, 4), (None, 3)], "a int, b int")
    assert [r[0] for r in rows.select(isin(F.col("a"), [1], 7, {9})).collect()] == [True, False, None]
    assert [r[0] for r in rows.select(safe_divide(F.col("a"), F.col("b"))).collect()] == [None, 0.5, None]
    assert sorted(r[0] for r in rows.select(consecutive_id("b")).collect()) == [1, 2, 3]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a\"b,c", None), ("x", "null?"), ("y", "2")], "s string, t string")
    write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), header=True).collect()), key=str) == sorted([("a\"b,c", None), ("x", "null?"), ("y", "2")], key=str)
    (tmp_path / "short.csv").write_text('1,"p ""q"""\n2\nnull,\n')
    assert read_csv(spark, str(tmp_path / "short.csv"), "a int, b string").collect() == [(1, 'p "q"'), (2, None), (None, None)]
    write_parquet(rows, str(tmp_path / "p"), ("s",), "zstd")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert register(rows, "helper_rows").count() == 3


def test_null_on_error(spark):
    one = spark.range(1)
    checks = {
        "cast": F.lit("abc").cast("double"), "date": F.to_date(F.lit("a")), "index": F.array(F.lit(1))[5], "element": F.element_at(F.array(F.lit(1)), 5),
        "compare": F.lit(123) < "2 3", "add": F.date_add(F.lit("20201231"), 1), "json": F.from_json(F.lit("{"), "struct<a:int>")["a"],
    }
    assert set(one.select(*[c.alias(n) for n, c in checks.items()]).first()) == {None}
    assert one.select(F.size(F.lit(None).cast("array<int>")), F.lit("2") + "1", F.when(F.lit(False), "abc").otherwise(F.lit(1.5))).first() == (-1, 3.0, "1.5")


def test_stream_windows(spark, tmp_path):
    from tessera.streaming.events import event_stream, windowed

    at = [dt.datetime(2024, 1, 1, h, 5) for h in (1, 1, 2, 9)]
    spark.createDataFrame([(t, "a", float(i)) for i, t in enumerate(at)], "ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "e"))
    q = windowed(event_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.n, r.total) for r in spark.table("w").collect()} <= {(2, 1.0), (1, 2.0), (1, 3.0)}
