import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup, queries
from tessera.llm.components import components


def grams(text, counted=False):
    w = (text or "").lower().split()
    c = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0)))
    return c if counted else Counter(dict.fromkeys(c, 1))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def classes(rows, counted=False):
    g = [grams(t, counted) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (not g[i] and not g[j]) or jaccard(g[i], g[j]) >= 0.8:
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[find(i)].append(d)
    return list(out.values())


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(("  " if rng.random() < 0.3 else " ").join(copy))
    base = rng.choices(vocabulary, k=200)
    rows += [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 200, 4)]
    for n in range(60):  # copies of one text, near enough to its first ones only
        copy = list(base)
        for i in rng.sample(range(200), n // 6):
            copy[i] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    rows += [" ".join(rng.choices(vocabulary, k=40) + passage) for _ in range(20)]
    rows += ["a a a a a a a a a", "a a a a a", "", None, "one two", "ONE two", "x " * 3000]
    return [(i if i % 31 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("weights", ["set", "count"])
def test_classes_against_brute_force(spark, weights, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 12)
    monkeypatch.setattr(neardup, "SHINGLES", 1500)
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, name int")
    got = defaultdict(list)
    for r in neardup.near_duplicates(docs, weights=weights).collect():
        got[r.class_id].append(r.doc_id)
    lone = [(i, t) for i, t in rows if i is not None]
    have = sorted(sorted((d for d in x if d is not None)) for x in got.values())
    want = [sorted(d for d in x if d is not None) for x in classes(rows, weights == "count")]
    assert sorted(x for x in have if x) == sorted(x for x in want if x)
    assert sum(map(len, got.values())) == len(rows) and all(k == min(d for d in v if d is not None) for k, v in got.items() if k is not None)
    assert len(lone) == sum(map(len, have))


def test_groups_without_links_and_long_texts(spark, monkeypatch):
    """Families in which many pairs collide and few are links, in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rng.sample(range(0, 120, 12), rng.randint(0, 5)):
            copy[at] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(copy)))
    long = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    rows += [(100, " ".join(long)), (101, " ".join(long[:-9])), (102, " ".join(long[:20_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in neardup.near_duplicates(docs).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes(rows, True)))


def test_deduplicated_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, text, 1, "a"), (None, text, 2, "b"), (7, text.upper(), 3, "c"), (9, text, 4, "d"), (7, text, 4, "d"), (7, text, 4, "d"), (None, "alone and without any id", 5, "e"), (None, "another one that has none", 6, "f"), (None, None, 7, "g"), (3, "", 8, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name int, component string").withColumn("rest", F.col("name"))
    got = neardup.deduplicated(docs).collect()
    assert sorted((r.doc_id or 0, r.component) for r in got if r.component not in "cd") == [(0, "e"), (0, "f"), (3, "h")] and len(got) == 4
    assert got[0].asDict().keys() == {"doc_id", "text", "name", "component", "rest"} and all(r.rest == r.name for r in got)
    assert [r.doc_id for r in got if r.component in "cd"] == [7]
    unique = neardup.deduplicated(docs.where("component NOT IN ('d', 'g')")).collect()
    assert sorted(r.component for r in unique) == ["c", "e", "f", "h"]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    n, k = 300, 2048
    a, b = rng.gamma(1, 2, n), rng.gamma(1, 2, n)
    b[:200] = a[:200] * rng.choice([1, 1, 0.5], 200)
    ids = neardup.mixed(np.arange(n, dtype=np.uint64))
    s = neardup.signatures(np.repeat([0, 1], n), np.concatenate([ids, ids]), np.concatenate([a, b]), 3, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / k)
    assert not s[2].any() and len(set(s[0].tolist())) > k / 4


def test_signature_does_not_depend_on_the_slice():
    texts = [t for _, t in corpus(1)]
    row, element, count = neardup.shingles(pa.array(texts))
    every = neardup.signatures(row, element, np.ones(len(row)), len(texts), 150)
    for i in (0, 5, 60):
        r, e, _ = neardup.shingles(pa.array([texts[i]]))
        assert (neardup.signatures(r, e, np.ones(len(r)), 1, 150)[0] == every[i]).all()
    assert [dict(Counter(row.tolist()))[i] for i in range(20)] == [len(grams(t)) for t in texts[:20]]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_query(spark, tmp_path):
    spark.createDataFrame(corpus(9), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_near_duplicates(spark, str(tmp_path)).collect()
    assert len(rows) == len(corpus(9))
    kept = [r for r in rows if r.is_kept]
    assert len({r.class_id for r in kept}) == len({r.class_id for r in rows}) == len(kept) - sum(r.doc_id is None for r in kept) + (None in {r.class_id for r in rows})
