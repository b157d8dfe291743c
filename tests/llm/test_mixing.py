from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import mixing, queries


def raked(cells, power, rounds=3000):
    """Plain raking of {(source, lang, topic): tokens} to shares."""
    keys = list(cells)
    w = np.array([cells[k] for k in keys], float)
    of = [sorted({k[d] for k in keys}) for d in range(3)]
    index = [np.array([of[d].index(k[d]) for k in keys]) for d in range(3)]
    target = []
    for d in range(3):
        t = np.bincount(index[d], w)
        t = np.where(t > 0, t**power, 0)
        target.append(t / t.sum())
    for _ in range(rounds):
        for d in (1, 2, 0):
            m = np.bincount(index[d], w)
            w *= np.divide(target[d], m, out=np.ones_like(m), where=m > 0)[index[d]]
    return {k: x / cells[k] * sum(cells.values()) for k, x in zip(keys, w, strict=True) if cells[k]}


def margins(cells, chance):
    """Expected tokens by source, language and topic."""
    out = [defaultdict(float) for _ in range(3)]
    for k, v in cells.items():
        for d in range(3):
            out[d][k[d]] += v * chance[k]
    return out


def cells_of(seed, hot=20):
    rng = np.random.default_rng(seed)
    return {(f"s{s}", f"l{a}", b): int(rng.integers(1, 400) * (hot if s == 0 else 1)) for s in range(12) for a in range(3) for b in range(4) if rng.random() < 0.8 or a == 0}


def fit(spark, cells, *args, **options):
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic int, tokens long")
    return {(r.source, r.lang, r.topic): r for r in mixing.calibrated(frame, *args, **options).collect()}


def test_uncut_probabilities_against_plain_raking(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-5)
    monkeypatch.setattr(mixing, "ROUNDS", 200)
    cells = cells_of(1)
    got, want = fit(spark, cells, 0.05, 0.5), raked(cells, 0.5)
    assert set(got) == set(cells) and max(r.probability for r in got.values()) < 1
    assert all(got[k].probability == pytest.approx(0.05 * want[k], rel=1e-3) for k in want)


@pytest.mark.parametrize(("kept", "power"), [(0.8, 0.7), (0.6, 0.5), (0.5, 0.0), (0.95, 0.9)])
def test_cut_probabilities_meet_the_marginals(spark, kept, power):
    cells = cells_of(2)
    got = fit(spark, cells, kept, power)
    total = sum(cells.values())
    held, met = margins(cells, dict.fromkeys(cells, 1.0)), margins(cells, {k: r.probability for k, r in got.items()})
    assert any(r.probability == 1 for r in got.values()) and all(0 <= r.probability <= 1 for r in got.values())
    for d in range(3):
        names = list(held[d])
        want = mixing._filled(np.array([held[d][n] for n in names]), np.array([held[d][n] ** power for n in names]), kept * total)
        assert want.sum() == pytest.approx(kept * total) and [met[d][n] for n in names] == pytest.approx(want.tolist(), rel=0.01)


def test_targets_are_filled_up():
    assert mixing._filled(np.array([10.0, 100, 50]), np.array([1.0, 1, 0]), 60).tolist() == [10, 50, 0]
    assert mixing._filled(np.array([10.0, 10]), np.array([3.0, 1]), 20).tolist() == [10, 10]
    assert mixing._filled(np.array([10.0, 30]), np.array([1.0, 3]), 20).tolist() == [5, 15]


def test_marginals_that_rule_each_other_out_step_back(spark):
    cells = {("a", "x", 0): 100, ("b", "y", 0): 100}
    with pytest.warns(UserWarning, match="0% of the way"):
        got = fit(spark, cells, 0.5, wanted={"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})
    assert [r.probability for r in got.values()] == pytest.approx([0.5, 0.5])


def test_marginals_met_part_of_the_way(spark):
    """A hot source whose tokens that may go are fewer than those that should."""
    cells = {("hot", "en", 0): 500, ("hot", "fr", 0): 1000, ("hot", "fr", 1): 1500}
    cells |= {(f"s{i}", a, b): n for i in range(20) for a, b, n in (("en", 0, 150), ("en", 1, 140), ("fr", 0, 10))}
    with pytest.warns(UserWarning, match="of the way") as told:
        got = fit(spark, cells, 0.8, 0.0)
    way = int(next(str(w.message) for w in told if "of the way" in str(w.message)).split("those ")[1].split("%")[0]) / 100
    assert 0.1 < way < 0.3
    held, met = margins(cells, dict.fromkeys(cells, 1.0)), margins(cells, {k: r.probability for k, r in got.items()})
    total = sum(cells.values())
    for d in range(3):
        names = list(held[d])
        size = np.array([held[d][n] for n in names])
        want = way * mixing._filled(size, size**0.0, 0.8 * total) + (1 - way) * 0.8 * size
        assert [met[d][n] for n in names] == pytest.approx(want.tolist(), rel=0.01)


def test_topics_keep_subjects_together(spark):
    rng = np.random.default_rng(7)
    subject = [[f"s{s}w{i}" for i in range(60)] for s in range(3)]
    rows = []
    for i in range(600):
        s, lang = i % 3, ["en", "fr"][i // 3 % 2]
        text = [*rng.choice(subject[s], 40), *rng.choice([f"{lang}{j}" for j in range(30)], 60)]
        rows.append((i, " ".join(rng.permutation(text)), lang, "src"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed_sample(docs, 1.0).collect()
    assert len(got) == 600
    of = defaultdict(lambda: defaultdict(int))
    for r in got:
        of[r.topic][r.doc_id % 3] += 1
    assert sum(max(x.values()) for x in of.values()) > 0.95 * 600
    assert [(r.doc_id, r.topic) for r in got] == [(r.doc_id, r.topic) for r in mixing.mixed_sample(docs, 1.0).collect()]


def test_sample(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60))), ["en", "fr", None][i % 7 % 3], "hot" if i % 3 else f"src{i % 11}") for i in range(1500)]
    rows += [(9000, None, "en", "hot"), (9001, "", None, None), (9002, "...", "en", "only-empty"), (5, rows[5][1], rows[5][2], rows[5][3]), (None, "null id", "en", "hot")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_mixing(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.lang, r.source) for r in got} <= {(r[0], r[2], r[3]) for r in rows}
    assert len(got) == len(queries.op4_mixing(spark, str(tmp_path)).collect())
    kept, size = sum(r.n_tokens for r in got), sum(len((t or "").split()) for _, t, *_ in rows)
    assert kept == pytest.approx(mixing.KEPT * size, rel=0.1)
    each = defaultdict(set)
    for r in got:
        each[r.source, r.lang, r.topic].add((r.weight, r.probability))
    assert all(len(x) == 1 for x in each.values()) and {r.topic for r in got} <= set(range(-1, mixing.TOPICS))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mixed_sample(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "a"), (2, "", None, None)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in mixing.mixed_sample(blank).collect()} == {1, 2}
    clash = blank.selectExpr("*", "7 AS topic", "'a' AS source_label", "'b' AS `key`", "'c' AS profile", "'d' AS rest", "'e' AS slot")
    for r in mixing.mixed_sample(clash).collect():
        assert (r.topic, r.source_label, r.key, r.profile, r.rest, r.slot) == (-1, "a", "b", "c", "d", "e") and r.n_tokens == 0
    long = spark.createDataFrame([(1, "many different words " * 200_000, "en", "a"), (2, "x", "en", "a")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.n_tokens for r in mixing.mixed_sample(long, 1.0).collect()} == {1: 600_000, 2: 1}


def test_every_language_has_its_marginal(spark):
    langs = [f"l{i:02}" for i in range(40)] + ["other"]
    rows = [(100 * i + j, f"word{j} " * (60 - i), a, "s") for i, a in enumerate(langs) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed_sample(docs, 0.1, wanted={"lang": {"l39": 0.5, "other": 0.25, "l00": 0.25}}).collect()
    assert {r.lang for r in got} == {"l39", "other", "l00"}
    assert {r.lang for r in mixing.mixed_sample(docs, 0.9, 0.0).collect()} == set(langs)
