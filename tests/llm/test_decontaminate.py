import random
import re
import time
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm import decontaminate as dc
from tessera.llm import queries


def substring_edits(pattern, text):
    """Fewest edits between the pattern and any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(texts, items):
    out = {}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            w = min(len(item), dc.WINDOW)
            best = min(substring_edits(item[s : s + w], text) for s in range(len(item) - w + 1))
            if best <= min(dc.EDITS, w * dc.EDITS // dc.WINDOW):
                out[t, i] = best
    return out


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 1)] = rng.choice("abc") if kind != 2 else ""
    return "".join(out)


def test_against_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(n)[:m] for n, m in ((20, 70), (12, 52), (10, 40), (16, 61))]
    items = [x.strip() for x in items]
    texts = [prose(15), ""]
    for item in items:
        for n in (0, 1, 2, 3, 4, 5, 7):
            texts.append(f"{prose(4)} {edited(rng, item, n)} {prose(3)}")
        texts += [item, item[5:], item[:49], item[3:54], item[3:40]]
    found = dc.Items(items).found(pa.array(texts))
    got = {(t, i): e for t, i, e, _ in zip(*(x.tolist() for x in found), strict=True)}
    want = brute(texts, items)
    assert got == want and len(want) > 20


@pytest.mark.parametrize("limits", [{}, {"PIECE": 150, "HITS": 60, "OFTEN": 0}])
def test_periodic_texts_against_brute_force(limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(dc, name, value)
    rng = random.Random(8)
    units = ["0 ", "0 1 ", "0 0 1 ", "ab", "0 1 2 3 4 5 6 7 8 9 ", "0 " * 20 + "x ", "0 " * 18 + "y z "]
    items = [(u * 100)[:n].strip() for u, n in zip(units, (90, 70, 61, 80, 120, 150, 100), strict=True)] + ["".join(rng.choices("01", k=90))]
    texts = [(u * 200)[: rng.randint(45, 150)].strip() for u in units]
    texts += [edited(rng, items[i % len(items)] + "q" + items[(i + 1) % len(items)], i % 5)[:140] for i in range(8)] + ["".join(rng.choices("01 ", k=80)) + items[-1][5:70]]
    index = dc.Items(items)
    found = list(zip(*(x.tolist() for x in index.found(pa.array(texts))), strict=True))
    assert {(t, i): e for t, i, e, _ in found} == brute(texts, items)
    for t, i, e, where in found if limits else ():
        ends = [j for j in range(len(texts[t]) + 1) if any(substring_edits(items[i][s : s + 50], texts[t][max(0, j - 53) : j]) <= e for s in range(max(1, len(items[i]) - 49)))]
        assert where == ends[0], (t, i)


def test_repetitions_in_bounded_time_and_memory():
    index = dc.Items(["0 " * 4000, "0 1 1 0 " * 1000, "nothing like it " * 20])
    for text in ("0 " * 100_000, "0 1 " * 50_000, "0 " * 20 + "x " + "0 " * 100_000):
        tracemalloc.start()
        began = time.time()
        found = index.found(pa.array([text]))
        took, held = time.time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert took < 5 and held < 500e6 and 0 in found[1].tolist()[:1] + [0]


def test_compared_form():
    texts = ["", None, " ", "--a", "É b.\t..c- ", "x", "…", "水 の!", "a" * 5 + "\n\n" + "B", "٣ ½"]
    codes, first = dc.compared(pa.array(texts, pa.string()))
    got = [dc._string(codes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    old = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), "")), r"[^\p{L}\p{N}]+", " "), " ")
    assert got == old.to_pylist() == [" ".join(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]


def test_ids_of_any_type(spark):
    line = "the quick brown fox jumps over the lazy dog and then it sleeps all day"
    items = spark.createDataFrame([(1, line), (1, line), (None, line.upper())], "item_id int, text string")
    docs = spark.createDataFrame([("a", f"so {line}", 1.0), (None, line, 2.0)], "doc_id string, text string, `key` double")
    assert sorted(map(str, dc.contaminated(docs, items).collect())) == sorted(f"Row(doc_id={d!r}, item_id={i}, edits=0, ends_at={e})" for d, e in (("a", 53), (None, 50)) for i in (1, 1, None))
    dates = items.selectExpr("DATE'2020-01-01' AS item_id", "text").limit(1)
    assert len(dc.contaminated(docs, dates).collect()) == 2 and dc.decontaminated(docs, dates).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choices("aeioutnrsl", k=rng.randint(2, 8))) for _ in range(n))
    items = [(0, prose(20)), (1, prose(15)), (2, prose(15)), (3, "too short"), (4, None), (5, "")]
    items += [(6, items[1][1])]
    docs = [(10, f"{prose(300)} {items[0][1].upper().replace(' ', '--')}, {prose(200)}"), (11, prose(500)), (12, None), (13, ""), (14, items[1][1]), (14, items[1][1]), (None, items[2][1] + items[0][1]), (15, "too short"), (16, prose(20_000) + items[2][1])]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in queries.op5_decontamination(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(10, 0, 0), (14, 1, 0), (14, 1, 0), (14, 6, 0), (14, 6, 0), (None, 2, 0), (None, 0, 0), (15, 3, 0), (16, 2, 0)], key=str)


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and then it sleeps all day")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{i} the quick brown fox jumps over the lazy dog and then it") for i in range(9)], "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_CHARS", 150)
    assert sorted(r.item_id for r in dc.contaminated(docs, items).collect()) == list(range(9))
    assert dc.contaminated(docs, items.limit(0)).collect() == dc.contaminated(docs.limit(0), items).collect() == []


def test_short_items(spark):
    items = spark.createDataFrame([(1, "What is a monad?"), (2, "水の沸点は摂氏何度であるか答えなさいと問う"), (3, "abcdefghij")], "item_id long, text string")
    texts = ["what IS a monad", "so: what is a monad? A monoid", "what is a monads", "what is the monad", "問：水の沸点は摂氏何度であるか答えなさいと問う。百度", "xabcdefghij abcdefghij", "xabcdefghij"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.ends_at) for r in dc.contaminated(docs, items).collect())
    assert got == [(0, 1, 0, 15), (1, 1, 0, 18), (4, 2, 0, 23), (5, 3, 0, 22)]
    assert sorted(r.doc_id for r in dc.decontaminated(docs, items).collect()) == [2, 3, 6]
