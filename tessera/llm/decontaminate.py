"""Benchmark decontamination by q-gram lemma filtering (operator 5).

A document is contaminated by an item when some WINDOW characters of the item occur in it
within EDITS edits. Two strings of that kind share at least WINDOW + 1 - Q * (EDITS + 1)
character q-grams, and all of them lie on diagonals at most EDITS apart. So shared q-grams are
counted in overlapping diagonal bands; regions whose count meets that bound are retained and
verified by banded alignment, which is exact. This goes by rising number of edits, each with its own
bound, and a pair of a text and an item leaves when it has a match.

Texts are compared in lower case with every run of characters other than letters and digits
as one space. Items shorter than WINDOW are windows as a whole, with edits in proportion;
items of fewer than SHORTEST characters are found without edits and between word boundaries
only, and items of fewer than Q, which have no q-gram, only where they are a document's whole text.

Work and memory don't grow with the square of a repetition: where places and occurrences of
q-grams meet often, only the first of equal stretches of a text (and of equal windows of an item) is
looked at, since equal ones have equal results; pairs with a window in common are settled by
runs of shared q-grams on one diagonal, without alignment; and hits come HITS at a time, long
texts in pieces that overlap by a window and its edits.

Documents stream past an index of items: no shuffle, memory bounded by a slice and a block of
items. Items of equal text are indexed once, in blocks of at most about BLOCK_CHARS characters
(checked by an aggregate). Blocks are broadcast one after another, each let go when the table of
its finds is written, so however large the benchmark is, one block is held at a time.

Nulls count as empty texts and match nothing; repeated rows of documents are reported
repeatedly, items of equal text each; an empty table gives an empty result; ids have any type;
other columns aren't read (``decontaminated`` carries them along).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import mixed, slices, written

#: Characters of a window, edits allowed in it, characters of a q-gram, of the shortest item found with edits, and of a block of items.
WINDOW, EDITS, Q, SHORTEST, BLOCK_CHARS = 50, 3, 10, 30, 8_000_000
#: Characters of a piece of a long text, hits looked at together, and hits for each place from which on repetitions are sought.
PIECE, HITS, OFTEN = 1 << 19, 500_000, 4

_PRIME = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
#: Diagonals between the starts of two bands; a band also holds the EDITS diagonals after them.
_BAND = 16
_ALIGNED_AT_ONCE = 20_000

Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@functools.cache
def _words() -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    planes = 0x40000  # no letters beyond
    return np.concatenate([np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(planes)]), np.zeros(0x110000 - planes, bool)])


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in a row, and where each text begins (and the end)."""
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])


def compared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as they are compared, as ``_codes`` gives them."""
    codes, first = _codes(pc.utf8_lower(pc.fill_null(texts, "")))
    word = _words()[codes]
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    before[first[:-1][first[:-1] < len(word)]] = False
    keep = word | before  # words and the first character after each
    text = np.repeat(np.arange(len(texts)), np.diff(first))[keep]
    codes = np.where(word[keep], codes[keep], np.uint32(32))
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else keep
    inside = ~(last & (codes == 32))
    return codes[inside], np.concatenate([[0], np.cumsum(np.bincount(text[inside], minlength=len(texts)))])


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    powers, p = {1: codes.astype(np.uint64)}, {1: _PRIME}
    n = 1
    while 2 * n <= q:
        powers[2 * n] = powers[n][: len(powers[n]) - n] * np.uint64(p[n]) + powers[n][n:]
        p[2 * n] = p[n] * p[n] & _WRAP
        n *= 2
    out, done = powers[n], n
    for bit in sorted((b for b in powers if b & (q - n)), reverse=True):
        rest = powers[bit][done:]
        out = out[: len(rest)] * np.uint64(p[bit]) + rest
        done += bit
    return out


def _in_first(codes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """The places in the first of equal strings of ``length`` characters of each text, and in its end, where no such string begins."""
    grams = mixed(_grams(codes, length))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(codes), bool)
    whole = np.flatnonzero(np.arange(len(codes)) + length <= first[text + 1])
    named = grams[whole] ^ mixed(text[whole].astype(np.uint64))
    new[whole] = False
    new[whole[np.unique(named, return_index=True)[1]]] = True
    at = np.flatnonzero(new)
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + length, first[text[at] + 1]), -1)
    return np.cumsum(cover[:-1]) > 0


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... for ``n`` places each, all in a row."""
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _fewest(found: Found) -> Found:
    """Of each (text, item) the fewest edits and the first place with them."""
    text, item, edits, where = found
    order = np.lexsort((where, edits, item, text))
    text, item, edits, where = (x[order] for x in (text, item, edits, where))
    head = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]) if len(text) else np.zeros(0, bool)
    return text[head], item[head], edits[head], where[head]


class Items:
    """An index of benchmark items, given in their compared form, by their q-grams."""

    def __init__(self, texts: list[str], window: int = WINDOW, edits: int = EDITS, q: int = Q) -> None:
        self.window, self.edits, self.q, self.texts = window, edits, q, texts
        self.codes, self.first = _codes(pa.array(texts, pa.string()))
        self.length = np.diff(self.first)
        self.windows = np.minimum(self.length, window)
        self.allowed = np.minimum(edits, self.windows * edits // window)
        self.tiny = {x: i for i, x in enumerate(texts) if 0 < len(x) < q}
        grams = _grams(self.codes, q)
        item = np.repeat(np.arange(len(texts), dtype=np.int32), self.length)[: len(grams)]
        at = (np.arange(len(grams)) - self.first[item]).astype(np.int32)
        own = (at + q <= self.length[item]) & _in_first(self.codes, self.first, window)[: len(grams)]
        grams, item, at = grams[own], item[own], at[own]
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.at = grams[order], item[order], at[order]
        self.bits = min(26, max(16, int(8 * len(grams)).bit_length()))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._slot(self.grams)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - self.bits)

    def found(self, texts: pa.Array) -> Found:
        """``scan`` of texts that are in their compared form."""
        return self.scan(*_codes(texts))

    def scan(self, codes: np.ndarray, first: np.ndarray) -> Found:
        """Text, item, fewest edits and the first place where a window with them ends, for each contaminated (text, item)."""
        out = []
        for t in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < self.q)) if self.tiny else ():
            if (i := self.tiny.get(_string(codes[first[t] : first[t + 1]]))) is not None:
                out.append((t, i, 0, int(first[t + 1] - first[t])))
        found = [tuple(np.array(out, np.int64).reshape(-1, 4).T)]
        reach = self.window + self.edits
        t = 0
        while t < len(first) - 1:
            end = max(t + 1, int(np.searchsorted(first, first[t] + PIECE, "right")) - 1)
            size = int(first[end] - first[t])
            for at in range(0, max(1, size - reach), PIECE) if end == t + 1 else (0,):
                last = min(at + PIECE + reach, size) if end == t + 1 else size
                bounds = np.array([0, last - at]) if end == t + 1 else first[t : end + 1] - first[t]
                text, item, edits, where = self._piece(codes[first[t] + at : first[t] + last], bounds)
                found.append((text + t, item, edits, where + at))
            t = end
        text, item, edits, where = _fewest(tuple(map(np.concatenate, zip(*found, strict=True))))
        short = self.length[item] < SHORTEST
        exact = self._exact(codes, first, text[short], item[short])
        return tuple(np.concatenate([x, y]) for x, y in zip((text[~short], item[~short], edits[~short], where[~short]), exact, strict=True))

    def _exact(self, codes: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray) -> Found:
        """Those of the candidates whose short item stands in the text word for word."""
        out = []
        for t, i in zip(text.tolist(), item.tolist(), strict=True):
            at = f" {_string(codes[first[t] : first[t + 1]])} ".find(f" {self.texts[i]} ")
            if at >= 0:
                out.append((t, i, 0, at + len(self.texts[i])))
        return tuple(np.array(out, np.int64).reshape(-1, 4).T)

    def _piece(self, codes: np.ndarray, first: np.ndarray) -> Found:
        grams = _grams(codes, self.q)
        place = np.flatnonzero(self.filter[self._slot(grams)])
        text = np.searchsorted(first, place, "right") - 1
        place = place[place + self.q <= first[text + 1]]
        low, high = np.searchsorted(self.grams, grams[place], "left"), np.searchsorted(self.grams, grams[place], "right")
        n = high - low
        place, low, n = place[n > 0], low[n > 0], n[n > 0]
        reach = self.window + self.edits
        if n.sum() > OFTEN * len(codes):
            own = _in_first(codes, first, reach)[place]
            place, low, n = place[own], low[own], n[own]
        out, a, ends = [], 0, np.cumsum(n)
        while a < len(place):
            # hits of every stretch of ``reach`` characters come together in one of the runs
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, "right")), int(np.searchsorted(place, place[a] + 2 * reach)))
            out.append(self._hits(codes, first, np.repeat(place[a:b], n[a:b]), _spread(low[a:b], n[a:b])))
            a = b if b >= len(place) else int(np.searchsorted(place, place[b] - reach))
        return _fewest(tuple(map(np.concatenate, zip(*out, strict=True)))) if out else tuple(np.empty((4, 0), np.int64))

    def _hits(self, codes: np.ndarray, first: np.ndarray, where: np.ndarray, index: np.ndarray) -> Found:
        """``scan`` of the text places ``where`` and entries of the index that share a q-gram."""
        text = np.searchsorted(first, where, "right") - 1
        place, item, at = where - first[text], self.item[index].astype(np.int64), self.at[index].astype(np.int64)
        pair = text * len(self.length) + item
        shift = int(self.length.max(initial=0))
        diagonal = place - at + shift
        settled = self._runs(pair, diagonal, place)
        short = np.unique(pair[self.length[item] < SHORTEST])  # for _exact to tell
        settled.append((short, np.full(len(short), self.edits), np.zeros(len(short), np.int64)))
        left = ~np.isin(pair, np.concatenate([x[0] for x in settled]))
        pair, diagonal, place, at = pair[left], diagonal[left], place[left], at[left]
        band = diagonal // _BAND
        again = (diagonal % _BAND < self.edits) & (band > 0)
        bands = int(band.max(initial=0)) + 1
        key = np.concatenate([pair * bands + band, (pair * bands + band - 1)[again]])
        place, at = np.concatenate([place, place[again]]), np.concatenate([at, at[again]])
        order = np.lexsort((place, key))
        key, place, at = key[order], place[order], at[order]
        items = max(1, len(self.length))
        for edits in range(1, self.edits + 1):  # pairs with a match of fewer edits need no look at those with more
            item = key // bands % items
            open_ = self.allowed[item] >= edits
            if edits > 1:
                open_ &= ~np.isin(key // bands, settled[-1][0])
            key, place, at, item = key[open_], place[open_], at[open_], item[open_]
            if not len(key):
                break
            end = np.arange(len(key)) + np.maximum(1, self.windows[item] + 1 - self.q * (edits + 1)) - 1
            inside = end < len(key)
            end = np.minimum(end, len(key) - 1)
            s = np.flatnonzero(inside & (key[end] == key) & (place[end] - place <= self.windows[item] - self.q + edits))
            # every window start that can hold a retained group of hits
            lo = np.maximum(0, np.minimum(at[s], at[end[s]]) + self.q - self.windows[item[s]] - edits)
            hi = np.minimum(self.length[item[s]] - self.windows[item[s]], np.maximum(at[s], at[end[s]]) + edits)
            settled.append(self._tried(codes, first, *_merged(key[s], lo, hi), bands, shift, edits))
        pair, edits, where = map(np.concatenate, zip(*settled, strict=True))
        return pair // items, pair % items, edits, where

    def _runs(self, pair: np.ndarray, diagonal: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs with a whole window in common: as many q-grams in a row on one diagonal as it has."""
        order = np.lexsort((place, diagonal, pair))
        pair, diagonal, place = pair[order], diagonal[order], place[order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)]) if len(pair) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        run = np.diff(np.append(head, len(pair)))
        window = self.windows[pair[head] % max(1, len(self.length))]
        head, window = head[run >= window - self.q + 1], window[run >= window - self.q + 1]
        pair, where = pair[head], place[head] + window
        order = np.lexsort((where, pair))
        pair, at = np.unique(pair[order], return_index=True)
        return [(pair, np.zeros(len(pair), np.int64), where[order][at])]

    def _tried(self, codes: np.ndarray, first: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, bands: int, shift: int, allowed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, edits and place of the windows lo to hi of each key that verify with ``allowed`` edits."""
        ends = np.cumsum(hi - lo + 1)
        out = [np.empty((3, 0), np.int64)]
        for i in range(0, int(ends[-1]) if len(ends) else 0, _ALIGNED_AT_ONCE):
            number = np.arange(i, min(i + _ALIGNED_AT_ONCE, int(ends[-1])))
            of = np.searchsorted(ends, number, "right")
            start = hi[of] + 1 - (ends[of] - number)
            pair = key[of] // bands
            edits, where = self._aligned(codes, first, pair, start, key[of] % bands * _BAND - shift)
            good = edits <= allowed
            out.append(np.stack([pair[good], edits[good], where[good]]))
        return tuple(np.concatenate(out, 1))

    def _aligned(self, codes: np.ndarray, first: np.ndarray, pair: np.ndarray, start: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits between item windows and what begins in a band of the text, and where that ends."""
        text, item = pair // len(self.length), pair % len(self.length)
        width = _BAND + 3 * self.edits + 1
        across = np.arange(width)
        low = first[text] + start + base - self.edits  # the band's first place in codes, for the window's first character
        lo, hi = first[text][:, None], first[text + 1][:, None]
        here = low[:, None] + across
        far = np.int64(1 << 20)
        cost = np.where((here >= lo) & (here <= hi), 0, far)
        size = self.windows[item]
        best, ends = np.full(len(pair), far), np.zeros(len(pair), np.int64)
        for i in range(int(size.max(initial=0)) + 1):
            done = size == i
            if done.any():
                last = cost[done].argmin(1)
                best[done], ends[done] = cost[done, last], (here[done, last] - first[text[done]])
            if i == int(size.max(initial=0)):
                break
            own = self.codes[np.minimum(self.first[item] + start + i, len(self.codes) - 1)]
            legal = (here >= lo) & (here < hi)
            other = codes[np.clip(here, 0, len(codes) - 1)]
            step = np.where(legal, cost + (other != own[:, None]), far)
            skip = np.concatenate([cost[:, 1:], np.full((len(pair), 1), far)], 1) + 1
            cost = np.minimum(step, skip)
            here = here + 1
            cost = np.minimum.accumulate(np.where(here <= hi, cost, far) - across, 1) + across
            cost = np.where((here >= lo) & (here <= hi), cost, far)
        return best, ends


def _merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the ranges lo to hi of each key, as ranges apart from each other."""
    own = hi >= lo
    order = np.lexsort((lo[own], key[own]))
    key, lo, hi = key[own][order], lo[own][order], hi[own][order]
    if not len(key):
        return key, lo, hi
    rank = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    wide = int(hi.max()) + 2
    reached = np.maximum.accumulate(rank * wide + hi)
    new = np.flatnonzero(np.concatenate([[True], rank[1:] * wide + lo[1:] > reached[:-1] + 1]))
    last = np.append(new[1:], len(key)) - 1
    return key[new], lo[new], reached[last] - rank[last] * wide


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """item, text and key, which names the text."""
    text = F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))
    return benchmark.select(F.col(item_col).alias("item"), text.alias("text"), F.sha2(text, 256).alias("key"))


def _blocks(items: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcasts of (distinct compared texts, keys of each) of at most about BLOCK_CHARS characters each, one at a time; whether it is the last."""
    texts = items.select("text", "key").distinct()
    told = texts.agg(F.sum(F.length("text")), F.count("*")).first()
    blocks = -(-(told[0] or 0) // BLOCK_CHARS) or 1
    of = lambda n: F.pmod(F.xxhash64("text"), F.lit(n))
    while 1 < blocks < told[1] and texts.groupBy(of(blocks)).agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] > 2 * BLOCK_CHARS:
        blocks *= 2
    for block in range(blocks):
        rows = texts.where(of(blocks) == block).collect()
        keys: dict[str, list] = {}
        codes, first = compared(pa.array([r.text for r in rows], pa.string()))
        for i, row in enumerate(rows):
            if first[i + 1] > first[i]:
                keys.setdefault(_string(codes[first[i] : first[i + 1]]), []).append(row.key)
        held = items.sparkSession.sparkContext.broadcast((list(keys), list(keys.values())))
        yield held, block == blocks - 1
        if block < blocks - 1:
            held.unpersist()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col``, ``item_col``, edits, ends_at: one row for each row of ``docs`` and item found in it.

    ``ends_at`` is the place in the compared form of the text where the first best window ends.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), T.StructField("key", T.StringType()), T.StructField("edits", T.IntegerType()), T.StructField("ends_at", T.LongType())])

    def scanned(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, keys = held.value
            index = Items(texts) if texts else None
            for batch in batches if index else ():
                for part in slices(batch, "text", 1 << 19):
                    text, item, edits, ends = index.scan(*compared(part.column("text")))
                    n = np.array([len(keys[i]) for i in item], np.int64)
                    names = [x for i in item for x in keys[i]]
                    id_ = part.column("id").take(pa.array(np.repeat(text, n)))
                    yield pa.RecordBatch.from_arrays([id_, pa.array(names, pa.string()), pa.array(np.repeat(edits, n), pa.int32()), pa.array(np.repeat(ends, n), pa.int64())], schema.names)

        return read.mapInArrow(run, schema)

    every = reduce(DataFrame.unionByName, [scanned(held) if last else written(scanned(held), "leaks") for held, last in _blocks(items)])
    named = every.join(items.select("key", "item"), "key")
    return named.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "ends_at")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; nothing is shuffled."""
    for held, last in _blocks(_items(benchmark, item_col, item_text_col)):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            texts, _ = held.value
            index = Items(texts) if texts else None
            for batch in batches:
                for part in slices(batch, text_col, 1 << 19):
                    clean = np.ones(part.num_rows, bool)
                    if index:
                        clean[index.scan(*compared(part.column(text_col)))[0]] = False
                    yield part.filter(pa.array(clean))

        kept = docs.mapInArrow(run, docs.schema)
        docs = kept if last else written(kept, "clean")
    return docs
