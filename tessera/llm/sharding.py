"""Sharding by fixed virtual slots (operator 6), in DataFrame functions only.

Records hash into ``n_slots`` virtual slots, which never change. Bytes are summed per slot,
and a small versioned map, stored as a table, says which shard owns each slot. Rebalancing adds a
version in which some whole slots have moved; records never hash again.

The map has exactly ``n_slots`` rows, so folding it in one row and broadcasting it are
bounded by that parameter, not by the data.

A record's slot follows from its id and text, so that an id that many rows share fills many slots;
``spread`` also numbers the copies of equal records, and copies go by their numbers. A null id or
text counts as empty, and a very long text is one record, whose bytes no map can divide. Repeated
rows each keep a place of their own, and an empty table yields an empty result. Other columns are
carried along; an input column with the name of an added one is replaced by it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed

#: Virtual slots, copies of a record that one row stands for, and how far a shard may be over the mean before slots move.
N_SLOTS, COPIES, TOLERANCE = 4096, 65_536, 0.02


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def virtual_slot(id_col: Column, text: Column, n_slots: int = N_SLOTS, copy: Column | None = None) -> Column:
    """The slot of a record by its id and text, and by its number among equal records if ``copy`` gives that."""
    empty = F.lit("")
    told = F.xxhash64(F.coalesce(id_col.cast("string"), empty), F.coalesce(text, empty))
    return F.pmod(told if copy is None else F.when(copy == 0, told).otherwise(F.xxhash64(told, copy)), F.lit(n_slots)).cast("int")


def spread(records: DataFrame) -> DataFrame:
    """``records`` with copy: the number of each among equal ones, from 0 on. Equal records are counted before the shuffle and dealt out again COPIES at a time."""
    counted = records.groupBy(*records.columns).agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    dealt = parts.repartition(*records.columns, "part").withColumn("first", F.col("part") * COPIES)
    return dealt.select(*records.columns, F.explode(F.sequence("first", F.least(F.col("first") + (COPIES - 1), F.col("n") - 1))).alias("copy"))


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """virtual_slot, n_rows, n_bytes of every slot; ``records`` has virtual_slot and size."""
    held = records.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
    every = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(held, "virtual_slot", "left").na.fill(0, ["n_rows", "n_bytes"])


def _in_one_row(slots: DataFrame, *columns: str) -> DataFrame:
    """The slots by falling bytes (ties to the lower slot) as one array ``s``; n_slots entries at most."""
    entry = F.struct((-F.col("n_bytes")).alias("order"), "virtual_slot", "n_bytes", *columns)
    return slots.agg(F.array_sort(F.collect_list(entry)).alias("s"))


def _map_rows(folded: Column, version: int) -> list[Column]:
    return [F.lit(version).alias("version"), F.inline(folded)]


def first_map(slots: DataFrame, n_shards: int) -> DataFrame:
    """Version 1: version, virtual_slot, shard. Each slot, the largest first, goes to the shard with the fewest bytes."""
    state = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("owner"))

    def put(acc: Column, x: Column) -> Column:
        to = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        load = F.transform(acc["load"], lambda b, i: F.when(i == to, b + x["n_bytes"]).otherwise(b))
        return F.struct(load.alias("load"), F.concat(acc["owner"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), to.alias("shard")))).alias("owner"))

    return _in_one_row(slots).select(*_map_rows(F.aggregate("s", state, put)["owner"], 1))


def rebalanced(slot_map: DataFrame, slots: DataFrame, n_shards: int, version: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The map edited to ``version``: slots leave shards over the mean by more than ``tolerance``, and shards that are gone.

    The largest slots move first, to the shard with the fewest bytes, and only where they fit;
    every other slot stays where it is.
    """
    held = slots.join(slot_map.select("virtual_slot", "shard"), "virtual_slot", "left")
    one = _in_one_row(held, "shard")
    load = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda k: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] == k, x["n_bytes"]).otherwise(F.lit(0))))
    most = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n_bytes"]) * (1 + tolerance) / n_shards
    one = one.select("s", load.alias("load"), most.alias("most"))
    state = F.struct(F.col("load").alias("load"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("owner"))

    def edit(acc: Column, x: Column) -> Column:
        least = F.array_min(acc["load"])
        to = (F.array_position(acc["load"], least) - 1).cast("int")
        homeless = x["shard"].isNull() | (x["shard"] >= n_shards)
        over = F.get(acc["load"], F.when(homeless, 0).otherwise(x["shard"])) > F.col("most")
        moves = homeless | (over & (least + x["n_bytes"] <= F.col("most")))
        load = F.transform(acc["load"], lambda b, i: b + F.when(moves & (i == to), x["n_bytes"]).otherwise(F.lit(0)) - F.when(moves & ~homeless & (i == x["shard"]), x["n_bytes"]).otherwise(F.lit(0)))
        owner = F.struct(x["virtual_slot"].alias("virtual_slot"), F.when(moves, to).otherwise(x["shard"]).alias("shard"))
        return F.struct(load.alias("load"), F.concat(acc["owner"], F.array(owner)).alias("owner"))

    return one.select(*_map_rows(F.aggregate("s", state, edit)["owner"], version))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add the map's version to the store at ``path``; a version that is there is never overwritten."""
    version = slot_map.first()["version"]
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map at ``path``, the latest by default."""
    every = spark.read.parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def kept_map(slots: DataFrame, n_shards: int, path: str, tolerance: float = TOLERANCE) -> DataFrame:
    """The map at ``path``, read back: version 1 made from the slots where there is none, and a further version where slots must move."""
    spark = slots.sparkSession
    try:
        current = stored_map(spark, path)
    except AnalysisException:  # no map yet
        store_map(first_map(slots, n_shards), path)
        current = stored_map(spark, path)
    edited = rebalanced(current, slots, n_shards, current.first()["version"] + 1, tolerance)
    moved = edited.join(current.select("virtual_slot", F.col("shard").alias("held")), "virtual_slot").where("shard <> held")
    if moved.isEmpty():
        return current
    store_map(edited, path)
    return stored_map(spark, path)


def sharded(records: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """``records`` with virtual_slot and shard. No shuffle: the map's n_slots rows are broadcast."""
    pack = packed(records, id=id_col, text=text_col)
    own = pack.frame.withColumn("virtual_slot", virtual_slot(F.col("id"), F.col("text").cast("string"), n_slots))
    return pack.restored(own.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot"), {c: F.col(c) for c in ("virtual_slot", "shard")})


def placed(records: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns, virtual_slot, shard and slot: the place of each record in its shard, 0, 1, 2 and so on.

    Equal records are counted before they are shuffled. A place is the number of records in
    the shard's earlier virtual slots plus that within the virtual slot, so no task sees more
    than a virtual slot's distinct records.
    """
    alike = records.groupBy("virtual_slot", "shard", *key).agg(F.count("*").alias("_n"))
    within = Window.partitionBy("virtual_slot").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    before = alike.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    totals = records.groupBy("shard", "virtual_slot").agg(F.count("*").alias("_n_slot"))
    ahead = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("virtual_slot", F.coalesce(F.sum("_n_slot").over(ahead), F.lit(0)).alias("_start"))
    start = F.col("_start") + F.col("_before")
    put = before.join(F.broadcast(starts), "virtual_slot")
    return put.select(*key, "virtual_slot", "shard", F.explode(F.sequence(start, start + F.col("_n") - 1)).alias("slot"))
