"""Removal of long repeated byte strings by longest previous factors (operator 7).

Every start of a LENGTH-byte string is a suffix, ordered by its first LENGTH bytes (ties in text
order), with the length that neighbours in that order have in common. The longest previous factor
at a place is the longer common length with the nearest suffixes before and after it in that order
whose places are smaller (previous and next smaller positions); the longest next factor is the same
with greater places. With keep="first" a byte goes if the previous factor of a string over it has
LENGTH bytes, so the first copy stays; with keep="none" if the previous or the next one has.

One suffix array of a whole corpus fits no machine, so the suffixes are dealt out such that all
with a common prefix of LENGTH bytes meet: a string belongs to the GRAM bytes in it whose hash
is least (leftmost of equals), its anchor. Consecutive strings with the same anchor form a
segment. Only anchors, hashes and places are shuffled at first; three cases follow:

* an anchor that occurs once: nothing in its segment repeats;
* equal segments: all their strings repeat; one of them stands for all from here on, and a task
  collapses equal segments before they are shuffled at all, over all that it reads;
* unequal segments of one anchor: their bytes are fetched, their suffixes ordered, and the
  factors decide. Strings without an equal by hash are left out of the sort.
  The strings of an anchor with more than WIDE segments are dealt out by hash, and equal ones
  decide by their order in the text.

Matches never cross documents. Null texts count as empty, rows that repeat are copies of each
other, an empty table gives an empty result, and only the id and the text are read, so other names
can't clash. Very long texts go in pieces of PIECE bytes. Texts are stored in buckets of about
BUCKET_BYTES. A task holds at most GROUP_BYTES of segments at
a time or WIDE segments of one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mixed, slices, written
from tessera.sources.shared import fresh_path, undo_later

#: Bytes of a repeated string, of an anchor, of a piece of a long text, and of the segments a task orders at a time.
LENGTH, GRAM, PIECE, GROUP_BYTES = 200, 64, 1 << 19, 1 << 20
#: Bytes of text in a bucket of the stored texts, and bits of a place in a task's table of segments.
BUCKET_BYTES, SLOT_BITS = 256 << 20, 18
#: Segments of an anchor beyond which its strings are dealt out by hash instead.
WIDE = 20_000
#: Strings that are laid out as rows of bytes and sorted at a time (or those equal by hash).
SORTED_AT_ONCE = 50_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = 20
_ODD = pow(int(_BASE), -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(int(_BASE), (1 << _PLACE_BITS) + 1), _powers(_ODD, (1 << _PLACE_BITS) + 1)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


class Hashes:
    """Hashes of the substrings of at most 2**_PLACE_BITS bytes, from prefix sums of a polynomial in bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _UP[: len(data)], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * _DOWN[first])

    def grams(self, n: int) -> np.ndarray:
        return mixed((self.sums[n:] - self.sums[:-n]) * _DOWN[: len(self.sums) - n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def segments(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first string, strings, anchor and content hash of every segment of the texts data[first:last]."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(data)
    grams = hashes.grams(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    anchor_at = (_least((grams >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS) | place, length - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(first)), np.maximum(last - first - length + 1, 0))
    n = np.maximum(last - first - length + 1, 0)
    string = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(string):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    own = anchor_at[string]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(new, len(string)))
    start = string[new]
    return text[new], start, count, grams[own[new]], hashes.of(start, start + count + length - 1) ^ mixed(count.astype(np.uint64))


def suffix_order(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, given in text order as rows of their first bytes (equal ones stay in text order), and the length of what each has in common with the one before it."""
    length = strings.shape[1]
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{length}").ravel(), kind="stable")
    differ = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), length)
    return order, np.concatenate([[0], common])[: len(order)]


def _nearest_smaller(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What each suffix has in common with the nearest one before it in suffix order that has a smaller value (0 without one).

    All suffixes jump at once: between a suffix and the one it points to all values are greater, so
    it may go on to where that one points, and the least common length on the way is kept.
    """
    to, least = np.arange(len(value)) - 1, common.copy()
    live = np.flatnonzero((to >= 0) & (value[to] > value))
    while len(live):
        by = to[live]
        least[live] = np.minimum(least[live], least[by])
        to[live] = to[by]
        live = live[(to[live] >= 0) & (value[to[live]] > value[live])]
    least[to < 0] = 0
    return least


def factors(order: np.ndarray, common: np.ndarray, before: bool = True) -> np.ndarray:
    """The longest previous factor at each place of the text (the longest next one if not ``before``): the longer of what its suffix has in common with the previous and the next one in suffix order whose place is smaller (greater)."""
    value = order if before else -order
    previous = _nearest_smaller(value, common)
    after = _nearest_smaller(value[::-1], np.concatenate([[0], common[:0:-1]])[: len(order)])[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(previous, after)
    return out


def repeats(strings: np.ndarray, length: int, keep: str) -> np.ndarray:
    """Which of the strings (rows of bytes in text order) have an earlier match ("first") or any ("none")."""
    order, common = suffix_order(strings)
    longest = factors(order, common)
    return (longest if keep == "first" else np.maximum(longest, factors(order, common, before=False))) >= length


def _stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, data of every document, written in buckets by row so that later joins don't shuffle the texts."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("data"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    path = fresh_path(spark, "texts")
    name = path.rpartition("/")[2].replace("-", "_")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(max(100_000, buckets)))
    rows.repartition(buckets, "row").write.bucketBy(buckets, "row").option("path", path).option("compression", "zstd").saveAsTable(name)
    undo_later(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    return spark.table(name)


class Met:
    """The segments (anchor and content) that a task has met, in a table of 2**SLOT_BITS places.

    A segment that came twice keeps its place, one that came once gives way to others, so what
    recurs in a task stays known in bounded memory, whatever else it reads.
    """

    def __init__(self) -> None:
        self.anchor, self.content, self.times = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint8)

    def add(self, anchor: np.ndarray, content: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Which of these distinct segments had come twice before."""
        slot = (mixed(anchor ^ content) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = (self.anchor[slot] == anchor) & (self.content[slot] == content) & (self.times[slot] > 0)
        twice = known & (self.times[slot] > 1)
        free = known | (self.times[slot] < 2)
        to = slot[free]
        self.times[to] = np.minimum(np.where(known, self.times[slot], 0)[free] + np.minimum(copies[free], 2), 2)
        self.anchor[to], self.content[to] = anchor[free], content[free]
        return twice


_SEGMENT = "anchor long, content long, row long, start long, n long, copies int"


def _segmented(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments, equal ones of a slice as one with its copies; those copies themselves as marks (copies 0), and so all that a task has met twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in batches:
            for part in slices(batch, "data", PIECE):
                yield from pieces(part, met)

    def pieces(part: pa.RecordBatch, met: Met) -> Iterator[pa.RecordBatch]:
        row = part.column("row").to_numpy()
        data = part.column("data").cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        whole = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if data.buffers()[2] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        step = PIECE - length + 1
        if len(whole) <= PIECE:
            yield found(met, row, np.zeros(len(row), np.int64), whole, offsets[:-1], offsets[1:])
        else:  # a slice over PIECE is one long text: pieces share length - 1 bytes, so each string is in one
            for at in range(0, max(1, len(whole) - length + 1), step):
                piece = whole[at : at + PIECE]
                yield found(met, row, np.array([at]), piece, np.array([0]), np.array([len(piece)]))

    def found(met: Met, row: np.ndarray, shift: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        text, start, n, anchor, content = segments(data, first, last, length, gram)
        _, head, of, copies = np.unique(np.stack([anchor, content], 1), axis=0, return_index=True, return_inverse=True, return_counts=True) if len(text) else (0, text, text, text)
        start = start - first[text] + shift[text]
        row = row[text]
        copies = copies[of.ravel()] if len(text) else text
        # copies of a segment count at its first place, and nowhere if two of an earlier slice stand for it
        first_of = np.zeros(len(text), bool)
        if len(text):
            first_of[head[~met.add(anchor[head], content[head], copies[head])]] = True
        copies = np.where(first_of, copies, 0)
        # marks of segments that follow each other become one
        mark = copies == 0
        after = np.concatenate([[False], mark[1:] & mark[:-1] & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + n[:-1])]) if len(row) else mark
        head = np.flatnonzero(~after)
        n = np.add.reduceat(n, head) if len(head) else n
        row, start, anchor, content, copies = (x[head] for x in (row, start, anchor, content, copies))
        anchor = np.where(copies > 0, anchor, mixed(row.astype(np.uint64) + start.astype(np.uint64)))
        columns = [anchor.view(np.int64), content.view(np.int64), row, start, n, copies.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "content", "row", "start", "n", "copies"])

    return texts.select("row", "data").mapInArrow(run, _SEGMENT)


def _by_anchor(batches: Iterator[pa.RecordBatch], enough: int, weight: str | None = None) -> Iterator[pa.Table]:
    """The sorted rows in tables of whole anchors, of ``enough`` rows (or of so much ``weight``) or one anchor's."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        anchor = batch.column("anchor").to_numpy()
        held.append(batch)
        size += batch.num_rows if weight is None else batch.column(weight).nbytes
        if size >= enough and batch.num_rows:
            cut = int(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[-1])
            before = held[-2].column("anchor")[held[-2].num_rows - 1].as_py() if len(held) > 1 else None
            if cut or (before is not None and before != anchor[0]):
                table = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
                size = held[0].num_rows if weight is None else held[0].column(weight).nbytes
                yield table
    if held:
        yield pa.Table.from_batches(held)


def _resolved(found: DataFrame, keep: str) -> DataFrame:
    """Marks (copies 0) for what repeats as a whole, and segments whose strings must be ordered (copies 1, or 2 if marked too).

    Rows stream through sorted by anchor and content. Of an anchor only the first row of the
    content in hand is held, so an anchor of any number of rows takes no memory.
    """
    names = ["anchor", "content", "row", "start", "n", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, later = None, False  # the first row of the last content, with its copies so far; whether its anchor had another before
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], 1)
            yield out(rows[rows[:, 5] == 0], 0)
            rows = rows[rows[:, 5] > 0]
            if not len(rows):
                continue
            if held is not None:
                rows = np.concatenate([held[None], rows])
            first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
            total = np.add.reduceat(rows[:, 5], first)
            same = rows[first[1:], 0] == rows[first[:-1], 0]
            before = np.concatenate([[later], same])
            others = np.ones(len(rows), bool)
            others[first] = False
            yield out(rows[others], 0)
            yield from told(rows[first[:-1]], total[:-1], before[:-1] | same)
            held, later = rows[first[-1]].copy(), bool(before[-1])
            held[5] = total[-1]
        if held is not None:
            yield from told(held[None], held[5:], np.array([later]))

    def told(rows: np.ndarray, total: np.ndarray, mixed_anchor: np.ndarray) -> Iterator[pa.RecordBatch]:
        if keep == "none":
            yield out(rows[total >= 2], 0)
        yield out(rows[mixed_anchor], np.where(total[mixed_anchor] >= 2, 2, 1))

    def out(rows: np.ndarray, copies: np.ndarray | int) -> pa.RecordBatch:
        columns = [pa.array(rows[:, i]) for i in (0, 2, 3, 4)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.broadcast_to(np.asarray(copies, np.int32), len(rows)).copy())], ["anchor", "row", "start", "n", "copies"])

    in_order = found.repartition("anchor").sortWithinPartitions("anchor", "content", "row", "start")
    return in_order.mapInArrow(run, "anchor long, row long, start long, n long, copies int")


def _dealt(fetched: DataFrame, length: int, keep: str) -> DataFrame:
    """What ``_ordered`` finds, for anchors with more segments than a task should order.

    Their strings are grouped by 128 bits of hash (of the whole string and of its halves), with
    partial sums before the shuffle, so that only equal strings meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data", PIECE):
                row, start, n, copies = (part.column(c).to_numpy() for c in ("row", "start", "n", "copies"))
                data = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8)
                first = np.cumsum(n + length - 1) - (n + length - 1)
                of = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(first, n) + step
                half = length // 2
                two = mixed(_hashed(data, at, half) * _BASE + _hashed(data, at + half, length - half))
                columns = [_hashed(data, at, length).view(np.int64), two.view(np.int64), row[of], start[of] + step, copies[of]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "row", "start", "copies"])

    strings = fetched.mapInArrow(run, "one long, two long, row long, start long, copies int")
    groups = strings.groupBy("one", "two").agg(F.count("*").alias("m"), F.min(F.struct("row", "start")).alias("earliest")).where("m > 1")
    met = strings.join(groups, ["one", "two"])
    gone = F.col("copies") < 2 if keep == "none" else F.struct("row", "start") != F.col("earliest")
    return met.where(gone).select("row", "start", F.lit(1).cast("long").alias("n"))


def _ordered(fetched: DataFrame, length: int, keep: str) -> DataFrame:
    """row, start, n: runs of repeated strings of segments (anchor, row, start, n, copies, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_anchor((b for b in batches if b.num_rows), GROUP_BYTES, "data"):
            yield from marks(table.combine_chunks())

    def marks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, row, start, n, copies = (table[c].to_numpy() for c in ("anchor", "row", "start", "n", "copies"))
        data = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8)
        first = np.cumsum(n + length - 1) - (n + length - 1)
        of = np.repeat(np.arange(len(n)), n)
        at = np.repeat(first, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        # a string of an equal segment elsewhere counts as repeated already
        lone = _hashed(data, at, length) ^ mixed(anchor.astype(np.int64).view(np.uint64))[of]
        _, back, times = np.unique(lone, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[back] > 1)
        repeated = np.zeros(len(of), bool)
        order = some[np.argsort(back[some], kind="stable")]
        if len(order):
            heads = np.flatnonzero(np.concatenate([[True], back[order][1:] != back[order][:-1]]))
            limits = np.unique(np.append(heads[np.searchsorted(heads, np.arange(0, len(order), SORTED_AT_ONCE), "right") - 1], len(order)))
        for i, j in zip(limits[:-1], limits[1:], strict=True) if len(order) else ():
            own = np.sort(order[i:j])
            text_order = own[np.lexsort((at[own] - first[of[own]] + start[of[own]], row[of[own]]))]
            repeated[text_order] = repeats(data[at[text_order][:, None] + np.arange(length)], length, keep)
        if keep == "none":
            repeated &= copies[of] < 2  # those are marked as a whole
        hit = np.flatnonzero(repeated)
        if len(hit):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (of[hit][1:] != of[hit][:-1])]))
            head = hit[new]
            yield pa.RecordBatch.from_arrays([pa.array(row[of[head]]), pa.array(start[of[head]] + at[head] - first[of[head]]), pa.array(np.diff(np.append(new, len(hit))))], ["row", "start", "n"])

    in_order = fetched.repartition("anchor").sortWithinPartitions("anchor", "row", "start")
    return in_order.mapInArrow(run, "row long, start long, n long")


def _hashed(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings that begin at the (increasing) places ``at``, in runs that the prefix sums can hold."""
    out, done = np.empty(len(at), np.uint64), 0
    while done < len(at):
        base = at[done]
        until = int(np.searchsorted(at, base + (1 << _PLACE_BITS) - length, "right"))
        hashes = Hashes(data[base : base + (1 << _PLACE_BITS)])
        out[done:until] = hashes.of(at[done:until] - base, at[done:until] - base + length)
        done = until
    return out


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans, and the spans merged."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    at, kept = 0, []
    for a, b in merged:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in merged]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "first", gram: int | None = None) -> DataFrame:
    """``id_col``, data, spans, kept: each text's bytes, its removed ranges (maximal) and what is left."""
    if keep not in ("first", "none"):
        raise ValueError(f"keep is {keep!r}")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = _stored(docs, id_col, text_col)
    resolved = written(_resolved(_segmented(texts, length, gram or min(GRAM, length // 2)), keep), "repeat-segments")
    asked = resolved.where("copies > 0")
    here = (F.col("start") + 1).cast("int"), (F.col("n") + (length - 1)).cast("int")
    wide = written(asked.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > WIDE).select("anchor"), "repeat-wide")

    def fetched(rows: DataFrame) -> DataFrame:
        return rows.join(texts.select("row", "data"), "row").select("anchor", "row", "start", "n", "copies", F.substring("data", *here).alias("data"))

    marks = resolved.where("copies = 0").select("row", "start", "n")
    if wide.isEmpty():
        marks = marks.unionByName(_ordered(fetched(asked), length, keep))
    else:
        few, many = asked.join(wide, "anchor", "left_anti"), asked.join(wide, "anchor", "left_semi")
        marks = marks.unionByName(_ordered(fetched(few), length, keep)).unionByName(_dealt(fetched(many), length, keep))
    by_row = marks.groupBy("row").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (length - 1)).alias("end"))).alias("marks"))
    joined = texts.join(by_row, "row", "left").select("id", "data", "marks")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data", 4 << 20):
                kept, spans = [], []
                for data, marked in zip(part.column("data").to_pylist(), part.column("marks").to_pylist(), strict=True):
                    left, merged = _cut(data, [(m["start"], m["end"]) for m in marked or ()])
                    kept.append(left)
                    spans.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("data"), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "data", "spans", "kept"])

    return joined.mapInArrow(run, f"id {kind}, data binary, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)
