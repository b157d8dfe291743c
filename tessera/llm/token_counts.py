"""Token counts of whole texts by overlap resynchronisation (operator 10).

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a position where (a) both encodings begin a token and (b) the text is proven to
be cut in any context: a space after a character that isn't white space. The split patterns
of the supported tokenizers never match across such a place, and what they match from there
on depends only on what follows. When the overlap holds no such place it is widened, up to
the whole rest of the text.

Texts of ordinary size use the same places: where the pre-tokenizer is the byte-level
pattern, a text is the sequence of its segments between spaces, and every distinct segment
is encoded once per batch of rows (a bounded memo carries counts on). Texts with runs of
white space in which a space stands neither first nor last are encoded whole, and so are all
texts under a sentencepiece model, whose dummy prefix makes a chunk differ from its place in
the text.

Nulls count as empty texts (0 bytes, 0 tokens). Rows that repeat are counted row by row;
columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: Characters from which a text is encoded in chunks, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 65_536, 16_384, 512
#: Segments whose counts a worker remembers.
MEMO = 200_000

#: White space as the tokenizers see it (fixed values: Unicode White_Space and the separators U+001C to U+001F).
SPACE = "\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}"
#: A space inside a run of white space, neither its first nor its last character.
_INNER = f"[{SPACE}] ([{SPACE}]|$)"
_STABLE = re.compile(r"(?<=\S) ")

Starts = Callable[[str], np.ndarray]


def stable_places(text: str, lo: int, hi: int) -> list[int]:
    """Places from lo up to hi where every supported tokenizer cuts the text."""
    return [m.start() for m in _STABLE.finditer(text, lo, hi)]


def spliced_count(text: str, starts: Starts, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``starts`` gives the first character of each token of a string."""
    total, at, size = 0, 0, chunk
    while len(text) - at > size:
        end = at + size
        left = starts(text[at:end]) + at
        wide, cut = overlap, None
        while cut is None:
            begin = max(at, end - wide)
            right = set((starts(text[begin : min(len(text), end + wide)]) + begin).tolist())
            seen = set(left.tolist())
            # the last character of a chunk may belong to a longer token, so it proves nothing
            cut = next((p for p in reversed(stable_places(text, begin, end - 1)) if p > at and p in seen and p in right), None)
            if cut is None and begin == at:
                break
            wide *= 2
        if cut is None:  # no such place in the whole chunk
            size *= 2
            continue
        total, at, size = total + int((left < cut).sum()), cut, chunk
    return total + len(starts(text[at:]))


class Counter:
    """Counts tokens as the library of a tokenizer file does: ``.json`` tokenizers, ``.model`` sentencepiece."""

    def __init__(self, path: str) -> None:
        self.memo: dict[str, int] = {}
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import json

            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            kind = json.loads(own.to_str())
            pre = kind["pre_tokenizer"] or {}
            self.segmented = kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in kind["added_tokens"])
            self.starts = lambda text: np.array([a for a, _ in own.encode(text, add_special_tokens=False).offsets], np.int64)
            self.whole = lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.segmented = False
            self.starts = None
            self.whole = lambda texts: [len(e) for e in own.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"{path}: neither .json nor .model")

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a string array without nulls."""
        out = np.zeros(len(texts), np.int64)
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        huge = (chars > HUGE) & (self.starts is not None)
        for i in np.flatnonzero(huge):
            out[i] = spliced_count(texts[int(i)].as_py(), self.starts)
        plain = ~huge & (chars > 0)
        if self.segmented:
            cut = plain & ~pc.match_substring_regex(texts, _INNER).to_numpy(zero_copy_only=False)
            if cut.any():
                out[cut] = self._segmented(texts.filter(pa.array(cut)))
            plain &= ~cut
        if plain.any():
            out[plain] = self.whole(texts.filter(pa.array(plain)).to_pylist())
        return out

    def _segmented(self, texts: pa.Array) -> np.ndarray:
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy()
        pieces = parts.flatten().dictionary_encode()
        first = np.zeros(len(pieces), bool)
        first[offsets[:-1] - offsets[0]] = True
        code = pieces.indices.to_numpy().astype(np.int64) * 2 + ~first  # odd: with the space before it
        distinct, index = np.unique(code, return_inverse=True)
        words = pieces.dictionary.to_pylist()
        segments = [" " + words[c >> 1] if c & 1 else words[c >> 1] for c in distinct.tolist()]
        memo = self.memo
        if fresh := [s for s in segments if s not in memo]:
            if len(memo) + len(fresh) > MEMO:
                memo.clear()
                fresh = segments
            memo.update(zip(fresh, self.whole(fresh), strict=True))
        each = np.fromiter((memo[s] for s in segments), np.int64, len(segments))[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens for every row of ``docs``; ``tokenizer`` is a path on every executor.

    No shuffle: each row is counted where it is read, in slices of bounded size, and a lost
    executor costs only its own tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                n_bytes = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), n_bytes, pa.array(counter.counts(texts))], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
