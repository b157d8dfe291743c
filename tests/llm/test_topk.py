import math

import numpy as np
import pytest

from tessera.llm import queries, topk


def brute(rows, k=20, every=20):
    """(query, rank, id, score) of each query; query rows of one id are ranked together."""
    use = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in use if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for j, own in use if j == q for i, v in use if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def table(spark, path, rows):
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").write.parquet(f"{path}/embeddings.parquet")


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 128)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i - 40, np.float32(centres[i % 6] + rng.normal(size=8) / 4).tolist()) for i in range(700)]
    rows += [(i, np.float32(centres[0]).tolist()) for i in range(2000, 2300)]
    rows += [(3000, None), (3020, []), (3040, [0.5]), (3001, [1.0, None]), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8), (None, [1.0] * 8), (3060, [1e6] * 8), (3061, [-1e6] * 8)]
    table(spark, tmp_path, rows)
    assert sorted(tuple(r) for r in queries.op1_topk(spark, str(tmp_path)).collect()) == brute(rows)


def test_repeated_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 32)
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(topk, "BLOCKS", 2)
    rng = np.random.default_rng(4)
    rows = [(i % 90, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(300)] + [(40, [1.0] * 5)] * 100 + [(41, [1.0] * 5)] * 100
    table(spark, tmp_path, rows)
    assert sorted(tuple(r) for r in queries.op1_topk(spark, str(tmp_path)).collect()) == brute(rows)


def test_ranges_are_pruned_before_anything_is_sent(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 100)
    sent = []
    searched = topk._searched
    monkeypatch.setattr(topk, "_searched", lambda chosen, *rest: sent.append(chosen.select("id", "range_no").toPandas()) or searched(chosen, *rest))
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=16) / 5).tolist()) for i in range(4000)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10)
    assert len(sent[0]) <= 2 * 200 and len(sent[1]) < 0.1 * 200 * 40
    assert sorted(n for _, _, n in topk._dealt({0: 10, 1: 95, 3: 1000, 4: 5})) == [1, 1, 1, 10]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (21, [1.0, 0.0])]])
def test_few_rows(spark, tmp_path, rows):
    table(spark, tmp_path, rows)
    assert sorted(tuple(r) for r in queries.op1_topk(spark, str(tmp_path)).collect()) == brute(rows)


def test_pruning_skips_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(-40, 40, (8, 16))
    vectors = np.repeat(centres, 200, 0) + rng.integers(-3, 4, (1600, 16))
    scored = []
    product = topk._product
    monkeypatch.setattr(topk, "_product", lambda a, b: scored.append(len(a) * len(b)) or product(a, b))
    own = topk.Range(np.arange(1600), vectors, 50)
    q = np.arange(0, 1600, 20)
    who, ids, score = own.best(q, vectors[q], np.full(len(q), np.iinfo(np.int64).min), 5)
    every = vectors[q] @ vectors.T
    every[np.arange(len(q)), q] = -(10**9)
    want = np.argsort(-every, 1, kind="stable")[:, :5]
    assert (ids.reshape(-1, 5) == want).all() and (score.reshape(-1, 5) == np.take_along_axis(every, want, 1)).all()
    assert sum(scored[2:]) < 0.5 * every.size


def test_choices_of_every_range_send_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 50)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "GROUP", 16)
    monkeypatch.setattr(topk, "COMPONENTS", 8 * 100, raising=False)  # three blocks of queries and parts of two ranges
    held, found = [], []
    written, searched = topk.written, topk._searched
    monkeypatch.setattr(topk, "written", lambda df, name: (held.append((name, out.count())) if "v" in (out := written(df, name)).columns else None) or out)
    monkeypatch.setattr(topk, "_searched", lambda *given: found.append(searched(*given)) or found[-1])
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 8)) / 8)]  # nothing is near, so bounds exclude little
    rows += [(i, [0.25] * 8) for i in range(2000, 2400)] + [(40, [0.125] * 8)] * 3
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 10).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 10)
    n_ranges = len(rows) / topk.RANGE
    assert max(n for _, n in held) < 1.2 * len(rows), held  # not a row for each query and range, with its vector
    assert found[1].count() < 240 * 5 * n_ranges / 2  # k a part, not k a range
