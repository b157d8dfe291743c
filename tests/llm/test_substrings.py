import hashlib
import random

import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm import substrings as ss


def brute(texts, length, keep):
    """Removed byte ranges of each text."""
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    hit = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for i, s in places[1:] if keep == "first" else places if len(places) > 1 else ():
            hit[i][s : s + length] = b"\1" * length
    return [[(m.start(), m.end()) for m in __import__("re").finditer(b"\1+", bytes(h))] for h in hit]


def corpus(seed, unit=20):
    rng = random.Random(seed)
    word = lambda: bytes(rng.choices(b"abcdefgh ", k=rng.randint(1, 7)))
    prose = lambda n: b" ".join(word() for _ in range(n))
    passage, line = prose(unit * 5), prose(unit // 2)
    texts = [prose(rng.randint(1, unit * 8)) for _ in range(30)]
    texts += [prose(5) + passage + prose(9), passage, passage[3:], prose(30) + passage[: len(passage) // 2] + prose(3)]
    texts += [texts[3], texts[3], texts[5][:-7] + b"x", b"", b"ab" * unit * 20, b"q" * unit * 30, prose(3) + b"q" * unit * 12]
    texts += [prose(9) + line + prose(9) for _ in range(40)]
    base = bytearray(prose(unit * 9))
    for i in range(0, len(base), 37):
        copy = bytearray(base)
        copy[i] = 35
        texts.append(bytes(copy))
    return texts


@pytest.mark.parametrize(("keep", "wide"), [("first", 20_000), ("none", 20_000), ("first", 2), ("none", 2)])
def test_ranges_against_brute_force(spark, keep, wide, monkeypatch):
    monkeypatch.setattr(ss, "WIDE", wide)
    monkeypatch.setattr(ss, "GROUP_BYTES", 2000)
    monkeypatch.setattr(ss, "PIECE", 1500)
    monkeypatch.setattr(ss, "SLOT_BITS", 6 if wide > 2 else 18)
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t.decode(), 1) for i, t in enumerate(texts)], "doc_id long, text string, n int").coalesce(1)
    got = {r.doc_id: r for r in ss.without_repeats(docs, length=40, keep=keep).collect()}
    want = brute(texts, 40, keep)
    assert [[tuple(s) for s in got[i].spans] for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        assert bytes(got[i].data) == t and bytes(got[i].kept) == b"".join(t[a:b] for a, b in zip([0, *(e for _, e in want[i])], [*(s for s, _ in want[i]), len(t)], strict=True))


def test_query(spark, tmp_path):
    texts = [t.decode() for t in corpus(8, 90)] + [None, "é" * 500, "ü" + "é" * 500, "z" * 700_000]
    texts += [texts[4], texts[4]]
    ids = [i if i != 4 else None for i in range(len(texts))]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    data = [(t or "").encode() for t in texts]
    want = []
    for i, t, spans in zip(ids, data, brute(data, 200, "none"), strict=True):
        cut = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)], strict=True))
        want.append((i, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_substrings(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert ss.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeats():
    rows = np.frombuffer(b"abcabdabcxyzabc\0b\0\0b\0", np.uint8).reshape(-1, 3)
    assert ss.repeats(rows, 3, "first").tolist() == [False, False, True, False, True, False, True]
    assert ss.repeats(rows, 3, "none").tolist() == [True, False, True, False, True, True, True]


def fibonacci(n):
    a, b = b"b", b"a"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("text", [fibonacci(200), b"ab" * 90, b"a" * 120, b"abc" * 20 + b"abd" * 20, *(bytes(random.Random(i).choices(b"ab" if i % 2 else b"abcdefgh", k=150)) for i in range(6)), b"", b"a"])
@pytest.mark.parametrize("length", [4, 200])
def test_factors_against_brute_force(text, length):
    rows = np.frombuffer(b"".join((text[i:] + bytes(length))[:length] for i in range(len(text))), np.uint8).reshape(-1, length)
    order, common = ss.suffix_order(rows)

    def shared(i, j):
        n = 0
        while max(i, j) + n < len(text) and text[i + n] == text[j + n] and n < length:
            n += 1
        return n

    assert ss.factors(order, common).tolist() == [max((shared(i, j) for j in range(i)), default=0) for i in range(len(text))]
    assert ss.factors(order, common, before=False).tolist() == [max((shared(i, j) for j in range(i + 1, len(text))), default=0) for i in range(len(text))]


def test_a_repeated_byte_makes_few_marks(spark):
    docs = spark.createDataFrame([(1, "z" * 2_000_000), (2, "y" * 5000 + "x")], "doc_id long, text string")
    texts = ss._stored(docs, "doc_id", "text")
    assert ss._segmented(texts, 200, 64).count() < 60
    got = {r.doc_id: r for r in ss.without_repeats(docs, keep="none").collect()}
    assert [tuple(s) for s in got[1].spans] == [(0, 2_000_000)] and bytes(got[2].kept) == b"x"


def test_a_task_sends_few_copies(spark):
    line = "".join(random.Random(2).choices("abcdefgh ", k=900))
    docs = spark.createDataFrame([(i, line + f" {i}" * 60) for i in range(3000)], "doc_id long, text string").coalesce(1)
    found = ss._segmented(docs.selectExpr("doc_id AS row", "CAST(text AS binary) AS data"), 200, 64)
    counts = found.where("copies > 0").groupBy("anchor", "content").count().orderBy("count", ascending=False).first()
    assert counts["count"] <= 2
    for keep, left in (("none", 0), ("first", 1)):
        got = ss.without_repeats(docs, keep=keep).collect()
        assert sum(line in bytes(r.kept).decode() for r in got) == left


def test_rows_resolve_alike_in_any_batches(spark):
    rng = random.Random(6)
    rows = sorted((a, c, r, r, 5, k) for a, c, r, k in {(rng.randint(1, 9), rng.randint(1, 4), r, rng.choice([1, 1, 2])) for r in range(60)})
    frame = spark.createDataFrame(rows, ss._SEGMENT)
    for keep in ("first", "none"):
        want = set()
        for a in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == a]
            for c in {r[1] for r in own}:
                same = [r for r in own if r[1] == c]
                total = sum(r[5] for r in same)
                want |= {(a, r[2], 0) for r in (same[1:] if keep == "first" else same if total > 1 else [])}
                if len({r[1] for r in own}) > 1:
                    want.add((a, same[0][2], 2 if total > 1 else 1))
        for size in ("1", "3", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {(r.anchor, r.row, r.copies) for r in ss._resolved(frame, keep).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
