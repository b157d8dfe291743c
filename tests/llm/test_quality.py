import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, queries


def corpus(seed, n=900):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "ti", "ro", "mel", "san") for b in ("lo", "ne", "dir", "ka", "vos", "u")]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 120))
        poor, toxic = rng.random() < 0.2, rng.random() < 0.15
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vileword", "vilename"])
        if poor:
            text = [w + "***" for w in text]
        rows.append((i, " ".join(text), "en", f"site{i % 9}"))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_evidence_equals_the_sum_over_features(spark):
    rows, labels = corpus(1)
    model = quality.trained(spark.createDataFrame(rows[:600], "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"))
    assert 5 < len(model.weights) <= 2 * quality.FEATURES and model.weights["vileword"][1] > 1 and model.weights["<s>0.4"][0] > 1
    texts = [r[1] for r in rows[600:]] + ["", " \n ", "a | b | c", "VILEWORD!! VILEWORD!!", "x " * 9000]
    got = model.evidence(pa.array(texts))
    for text, row in zip(texts, got.tolist(), strict=True):
        have = [model.weights[f] for f in quality.text_features(text) if f in model.weights]
        for t in range(2):
            assert row[t] == pytest.approx(model.bias[t] - quality._logit(model.prior[t]) + sum(w[t] for w in have))


def test_posteriors_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"]), rng.gauss(-1, 2), rng.gauss(0, 1)) for i in range(200)] + [(999, "tiny", "x", 5.0, -5.0)]
    frame = spark.createDataFrame(rows, "doc_id long, host string, path string, evidence_poor double, evidence_toxic double")
    got = {r.doc_id: r for r in quality.posteriors(frame, (0.2, 0.1), F.col("host"), F.col("path")).collect()}
    assert len(got) == len(rows)
    for t, prior, e in (("poor", 0.2, 3), ("toxic", 0.1, 4)):
        own = {r[0]: 1 / (1 + math.exp(-(r[e] + quality._logit(prior)))) for r in rows}
        host, path = {}, {}
        for r in rows:
            host.setdefault(r[1] or "", []).append(own[r[0]])
            path.setdefault((r[1] or "", r[2] or ""), []).append(own[r[0]])
        mean = sum(own.values()) / len(own)

        def strength(groups):
            n = sum(k for k, _, _ in groups)
            noise = sum(m * (1 - m) for _, _, m in groups) / n
            spread = max(sum(k * (x - m) ** 2 for k, x, m in groups) / n - noise, 1e-12)
            return min(max(sum(m * (1 - m) for _, _, m in groups) / len(groups) / spread - 1, quality.WEAKEST), quality.STRONGEST)

        rate = {h: sum(v) / len(v) for h, v in host.items()}
        s_host = strength([(len(v), rate[h], mean) for h, v in host.items()])
        s_path = strength([(len(v), sum(v) / len(v), rate[k[0]]) for k, v in path.items()])
        for r in rows:
            h, p = host[r[1] or ""], path[r[1] or "", r[2] or ""]
            at_host = (sum(h) - own[r[0]] + s_host * mean) / (len(h) - 1 + s_host)
            at_path = (sum(p) - own[r[0]] + s_path * at_host) / (len(p) - 1 + s_path)
            assert got[r[0]][f"p_{t}"] == pytest.approx(1 / (1 + math.exp(-(r[e] + math.log(at_path / (1 - at_path))))), rel=1e-4)


def test_held_out_accuracy_of_the_query(spark, tmp_path):
    rows, labels = corpus(3)
    rows += [(5000, None, None, None), (5001, "", "en", "site1"), (None, rows[0][1], "en", "site2"), (5002, "balo " * 30_000, "en", "new"), rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels[:400], (1, None, None), (None, 1, 0), (77_777, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in queries.op3_quality(spark, str(tmp_path)).collect()}
    held = labels[400:]
    bad = {i for i, q, t in held if not q or t}
    assert len(bad - kept) / len(bad) > 0.95
    assert len({i for i, *_ in held} - bad - kept) / len(held) < 0.02
    assert kept <= {r[0] for r in rows}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "some text", "h"), (2, None, None)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    even = quality.trained(docs, none)
    got = quality.rated(docs, even, F.col("source"), F.col("source"))
    assert sorted(got.columns) == sorted([*docs.columns, *quality.ADDED]) and got.count() == 2
    assert quality.accepted(got).count() == 2
    assert quality.rated(docs.limit(0), even, F.col("source"), F.col("source")).collect() == []
    clash = docs.selectExpr("*", "1 AS p_toxic", "2 AS n", "3 AS n_host", "4 AS h_poor", "5 AS s_toxic", "6 AS host", "7 AS path", "8 AS own_poor", "9 AS `row`", "10 AS evidence_poor", "11 AS _host")
    for r in quality.rated(clash, even, F.col("source"), F.col("n")).collect():
        assert (r.n, r.n_host, r.h_poor, r.s_toxic, r.host, r.path, r.own_poor, r.row, r._host) == (2, 3, 4, 5, 6, 7, 8, 9, 11) and r.p_toxic < 0.5 and r.evidence_poor == 0


def test_sample_is_bounded_and_repeats_count_once(spark):
    rows, labels = corpus(5, 300)
    schema = "doc_id long, text string, lang string, source string"
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, many = (quality.trained(spark.createDataFrame(rows + more, schema), told) for more in ([], [rows[3]] * 400 + rows[:50]))
    assert once.weights.keys() == many.weights.keys() and once.prior == many.prior
    assert all(once.weights[f] == pytest.approx(many.weights[f]) for f in once.weights)
    few = quality.trained(spark.createDataFrame(rows, schema), told, sample=40, features=7)
    assert len(few.weights) <= 14
