import functools

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_counts as tc

BPE = public_tokenizers.path("byte_bpe_50k.json")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
COUNTER = tc.Counter(BPE)


@functools.cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def brute(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    own = library(path)
    return [len(own.encode(t, add_special_tokens=False)) for t in texts]


TEXTS = ["", " ", "a", "a  b", "a   b", "\n\n a \n  b \t c", "x" * 300, "it's <|endoftext|> we'll  ", "é　   b\x85 c", "日本語 テキスト " * 40, "word, " * 500, "a  ", "\x1c  b"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sé1.　 \x85\x1c<|endoftext|>", max_size=40), min_size=1, max_size=5))
def test_segments_equal_the_library(texts):
    import pyarrow as pa

    assert COUNTER.counts(pa.array(texts)).tolist() == brute(BPE, texts)


@pytest.mark.parametrize("name", FILES[:2])
def test_splicing_equals_the_library(name):
    path = public_tokenizers.path(name)
    counter = tc.Counter(path)
    rng = np.random.default_rng(1)
    words = ["the", "Über", "ing", "12", "don't", "<|endoftext|>", "...", "naïve", "\n", "a\tb", "x" * 60]
    texts = [" ".join(rng.choice(words, 900)) for _ in range(3)] + ["y" * 3000 + " z" * 700]
    assert [tc.spliced_count(t, counter.starts, 400, 8) for t in texts] == brute(path, texts)


def test_rows(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, None, 1), (3, "a  b", 2), (99, "of the " * 20_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tc.token_counts(docs, BPE).collect()), key=str)
    want = [(i, len((t or "").encode()), n) for (i, t, _), n in zip(rows, brute(BPE, [t or "" for _, t, _ in rows]), strict=True)]
    assert got == sorted(want, key=str)
    assert tc.token_counts(docs.limit(0), BPE).collect() == []


def test_model_files_count_whole_texts():
    import pyarrow as pa

    path = public_tokenizers.path(FILES[2])
    texts = [*TEXTS, "of the " * 20_000]
    assert tc.Counter(path).counts(pa.array(texts)).tolist() == brute(path, texts)
