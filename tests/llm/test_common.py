import random

import numpy as np
import pyarrow as pa

from tessera.llm import common


def test_word_hashes(monkeypatch):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abé日\0", k=rng.randint(0, 6))) for _ in range(5000)}) + ["x" * 700, "x" * 300_000, "y" * 300_000]
    whole = common.hashed_words(pa.array(words))
    assert len(set(whole.tolist())) == len(words)
    alone = np.concatenate([common.hashed_words(pa.array([w])) for w in words])
    assert (whole == alone).all() and (common.hashed_words(pa.array(["z", *words]).slice(1)) == whole).all()
    assert common.hashed_words(pa.array([], pa.string())).tolist() == []


def test_packed_columns(spark):
    frame = spark.createDataFrame([(1, "t", 2, 3, 4)], "doc_id long, text string, id int, rest int, `a b.c` int")
    pack = common.packed(frame, id="doc_id", text="text")
    assert pack.frame.columns == ["id", "text", "rest"]
    out = pack.restored(pack.frame, {"rest": pack.frame["id"] * 10, "new": pack.frame["text"]})
    assert out.columns == ["doc_id", "text", "id", "a b.c", "rest", "new"] and out.collect() == [(1, "t", 2, 4, 10, "t")]
