import os
import random

import corpus_pipeline
from tessera.sources.shared import shared_folder
from tests.llm.test_neardup import classes


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choices("aeioutnrsl", k=rng.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    item = prose(25)
    clean = {i: prose(rng.randint(30, 200)) for i in range(300)}
    toxic = {i: f"{prose(50)} vileword {prose(20)}" for i in range(300, 380)}
    near = {i: clean[i - 400] + " more" for i in range(400, 440)} | {i: clean[7] for i in range(440, 500)}
    leaks = {i: f"{prose(40)} {item} {prose(40)}" for i in range(500, 520)}
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", len(t)) for i, t in (clean | toxic | near | leaks).items()]
    rows += [rows[3], (None, None, None, None, None), (None, "", "en", "s1", 0), (None, clean[9], "en", "s1", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 380, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{i}")
        docs = spark.read.parquet(f"{d}/out{i}")
        seen.append(docs.collect())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = [[r.doc_id for r in s] for s in seen]
    assert not set(toxic) & set(ids[0]) and set(clean) <= set(ids[0])
    want = [min((d for d in c if d is not None), default=None) for c in classes([(r.doc_id, r.text) for r in seen[0]])]
    assert sorted(ids[1], key=str) == sorted(want, key=str)
    assert set(ids[2]) == set(ids[1]) - set(leaks)
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) > 0.6 * len(ids[2])
    assert sorted(ids[4], key=str) == sorted(ids[3], key=str) and {r.shard for r in seen[4]} == set(range(16))
    before = len(os.listdir(shared_folder(spark)))
    whole = corpus_pipeline.run(spark, d).collect()
    assert len(os.listdir(shared_folder(spark))) == before + 5
    assert sorted((r.doc_id or -1, r.shard) for r in whole) == sorted((r.doc_id or -1, r.shard) for r in seen[4])


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["p_poor", "weight", "topic", "name", "component", "rest", "id", "key", "shard_", "host", "n", "probability"]
    rows = [(i, f"some text number {i} with several words in it", "en", "s", 1) for i in range(30)]
    for name, data in (("few", rows), ("none", [])):
        d = str(tmp_path / name)
        docs = spark.createDataFrame(data, kind).selectExpr("*", *[f"'{c}' AS `{c}`" for c in extra])
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d)
        assert got.columns == [*docs.columns, "virtual_slot", "shard"]
        got = got.collect()
        assert all(r[c] == c for r in got for c in extra) and (len(got) > 15 if data else got == [])
