import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import queries, sharding


def records(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumn("virtual_slot", sharding.virtual_slot(F.col("doc_id"), F.col("text"), 64)).withColumn("size", sharding.record_bytes(F.col("text")))


def test_query_places_every_row_once(spark, tmp_path):
    rows = [(i, "é" * (i * 37 % 500)) for i in range(900)] + [(None, None), (None, "x"), (5, "twice"), (5, "twice"), (6, "")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    loads = Counter()
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
        loads[shard] = sum(r["size"] for r in got if r.shard == shard)
    assert max(loads.values()) - min(loads.values()) <= 1001
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op6_sharding(spark, str(tmp_path)).collect() == []


def test_first_map_is_greedy(spark):
    slots = sharding.slot_bytes(records(spark, [(i, "a" * (i * i % 301)) for i in range(500)]), 64)
    load, want = [0] * 5, {}
    for b, s in sorted((-r.n_bytes, r.virtual_slot) for r in slots.collect()):
        k = load.index(min(load))
        want[s], load[k] = k, load[k] - b
    assert {r.virtual_slot: r.shard for r in sharding.first_map(slots, 5).collect()} == want


def test_versions_and_rebalancing(spark, tmp_path):
    slots = sharding.slot_bytes(records(spark, [(i, "a" * (i * i % 301)) for i in range(3000)]), 64)
    old = sharding.first_map(slots, 4)
    sharding.store_map(old, str(tmp_path / "map"))
    grown = sharding.rebalanced(old, slots, 5, 2, 0.1)
    sharding.store_map(grown, str(tmp_path / "map"))
    before, after = ({r.virtual_slot: r.shard for r in m.collect()} for m in (sharding.stored_map(spark, str(tmp_path / "map"), 1), sharding.stored_map(spark, str(tmp_path / "map"))))
    assert set(after) == set(before) == set(range(64))
    assert {after[s] for s in after if after[s] != before[s]} == {4}
    size = {r.virtual_slot: r.n_bytes for r in slots.collect()}
    load = [sum(size[s] for s in after if after[s] == k) for k in range(5)]
    assert max(load) <= sum(load) / 5 * 1.1
    shrunk = {r.virtual_slot: r.shard for r in sharding.rebalanced(grown, slots, 4, 3).collect()}
    assert all(shrunk[s] == after[s] for s in shrunk if after[s] < 4) and set(shrunk.values()) == {0, 1, 2, 3}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 3, "v", "r")], "doc_id long, text string, shard int, id string, rest string")
    slot_map = spark.range(sharding.N_SLOTS).selectExpr("1 AS version", "CAST(id AS int) AS virtual_slot", "9 AS shard")
    (row,) = sharding.sharded(docs, slot_map).collect()
    assert (row.doc_id, row.text, row.shard, row.id, row.rest) == (1, "a", 9, "v", "r")


def test_hot_ids_and_copies_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    rows = [(7, f"text {i}") for i in range(2000)] + [(8, "copy")] * 2500 + [(i, None) for i in range(100, 900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    load, slots = Counter(), Counter()
    for r in got:
        load[r.shard] += r["size"]
        slots[r.virtual_slot] += r["size"]
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= max(slots.values())
    assert sorted((r.shard, r.slot) for r in got) == [(k, i) for k in range(16) for i in range(sum(r.shard == k for r in got))]
    # brute force: the greedy map of the slots
    want, free = {}, [0] * 16
    for size, slot in sorted((-n, v) for v, n in slots.items()):
        want[slot] = free.index(min(free))
        free[want[slot]] -= size
    assert {r.virtual_slot: r.shard for r in got} == want


def test_map_is_kept_and_edited(spark, tmp_path):
    slots = sharding.slot_bytes(records(spark, [(i, "a" * (i * i % 301)) for i in range(3000)]), 64)
    path = str(tmp_path / "kept")
    first = sharding.kept_map(slots, 4, path, 0.1)
    assert {r.version for r in first.collect()} == {r.version for r in sharding.kept_map(slots, 4, path, 0.1).collect()} == {1}
    grown = sharding.kept_map(slots, 5, path, 0.1)
    assert {r.version for r in grown.collect()} == {2} and {r.shard for r in grown.collect()} == set(range(5))
    assert {r.version for r in sharding.stored_map(spark, path, 1).collect()} == {1}


def test_long_text(spark, tmp_path):
    spark.createDataFrame([(1, "é" * 3_000_000), (2, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_sharding(spark, str(tmp_path)).collect()}
    assert got[1]["size"] == 6_000_001 and got[1].shard != got[2].shard
