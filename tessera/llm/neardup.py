"""Near-duplicate documents by DartMinHash (operator 2).

Each document is a weighted set of shingles of five words. Darts fall on every element's
weight region in order of rank, by hashing alone, so equal regions of different documents get
equal darts. A document takes darts up to the rank at which k ln k + 2k of them are expected;
each dart hits one of k coordinates and the earliest on each is the signature (a document
with an empty coordinate takes darts further). Two signatures agree on a coordinate with the
probability of their weighted Jaccard similarity.

Signatures are cut into bands; documents that agree on a whole band are in one group and
candidates, and each candidate pair is verified exactly on its shingles. With 30 bands of 5
coordinates a pair at 0.8 is missed with a probability below 1e-5. Words are what white space
separates, in lower case; a text of fewer than five words is one shingle.

No pairs of a group are emitted:

* equal word sequences are one node from the start, and so are all texts without words;
* every node is first held against the smallest node of one of its groups, and links that
  verify join components;
* in TURNS rounds, one node of each component in a group is held against one of the group's largest
  component, signatures first;
* a group whose nodes still lie in several components is settled in blocks: each pair to settle has a
  node outside of the group's largest component, so those nodes (few, as a rule) are dealt to
  blocks and meet all nodes of the group, dealt to blocks of about BLOCK nodes or SHINGLES
  shingles. A task that meets two blocks first looks at sizes and signatures alone: it skips
  pairs that lie in one component, were verified, or share an earlier band (they meet in that
  group), and those whose sizes or signatures rule out the similarity. Only nodes that are left in
  some pair get their texts; the task then verifies from the likeliest pair on, and emits a link
  only where that joins two components.

So the work on a group is the size of its largest component times the number of nodes outside of
it; groups don't add up to families that grow with the corpus.

A document's class is the smallest id in its component (null ids stand only where a class
has no other). Very long texts are read in slices, and one that exceeds a block is a block of its
own. Repeated rows are copies; null texts count as empty; an empty table gives an empty result;
other columns aren't read (``deduplicated`` carries them along under any names).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import hashed_words, mixed, packed, slices, written
from tessera.llm.components import components

#: Words of a shingle, similarity of a link, bands, coordinates of a band.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 30, 5

#: Nodes and shingles of a block, pairs verified at a time, and standard deviations below the similarity at which a signature rules a pair out.
BLOCK, SHINGLES, AT_ONCE, SURE = 512, 400_000, 2000, 5.5
#: Rounds in which parts of a group are held against its largest part by one node each.
TURNS = 1

#: Bits of a shingle's hash; the rest of a 64-bit key holds the row in its slice.
_BITS = 44
_STEP, _COORDINATE, _HEIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_UNIT = 1.0 / (1 << 53)


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text; a null text has none."""
    words = pc.split_pattern_regex(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))), r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+")
    empty = pc.equal(pc.list_value_length(words), 1)
    none = pc.and_(empty, pc.equal(pc.list_element(words, 0), ""))
    return pc.if_else(none, pa.scalar([], words.type), words) if pc.any(none).as_py() else words


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash (of _BITS bits) and count of each distinct shingle of each text, ordered by row."""
    lists = word_lists(texts)
    flat = lists.flatten().dictionary_encode()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = np.concatenate([hashed_words(flat.dictionary)[flat.indices.to_numpy()], np.zeros(words, np.uint64)])
    n = np.where(length >= words, length - words + 1, np.minimum(length, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = np.repeat(np.cumsum(length) - length, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    inside = np.minimum(length, words)[row]
    value = np.zeros(len(row), np.uint64)
    for j in range(words):
        value = np.where(j < inside, mixed(value * _STEP + word[first + j]), value)
    key = (row.astype(np.uint64) << np.uint64(_BITS)) | (value >> np.uint64(64 - _BITS))
    key.sort()
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> np.uint64(_BITS)).astype(np.int64), key & np.uint64((1 << _BITS) - 1), np.diff(np.append(at, len(new)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def _throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, most: np.ndarray, k: int, at_once: int, rank: np.ndarray, best: np.ndarray) -> None:
    """Darts of each element in order of rank, up to ``most`` of its row; the earliest and its name per row and coordinate."""
    slabs = np.ceil(weight).astype(np.int64)  # a region is cut into slabs of height 1, of which the last is partly kept
    of = np.repeat(np.arange(len(row)), slabs)
    slab = (np.arange(len(of)) - np.repeat(np.cumsum(slabs) - slabs, slabs)).astype(np.float64)
    row, weight, most = row[of], weight[of], most[row[of]]
    name = mixed(element[of] + mixed(slab.astype(np.uint64) + _STEP))
    last, n = np.zeros(len(row)), 0
    while len(row):
        number = np.arange(n, n + at_once, dtype=np.uint64)
        dart = mixed(name[:, None] + number[None, :] * _STEP)
        ranks = -np.log(_uniform(dart))
        ranks[:, 0] += last
        ranks = np.cumsum(ranks, 1)
        hit = (ranks < most[:, None]) & (slab[:, None] + _uniform(mixed(dart ^ _HEIGHT)) < weight[:, None])
        i, _ = np.nonzero(hit)
        dart = mixed(dart[hit] ^ _COORDINATE)
        cell = row[i] * k + (dart % np.uint64(k)).astype(np.int64)
        own = ranks[hit]
        before = rank.copy() if len(cell) * 4 > len(rank) else None
        np.minimum.at(rank, cell, own)
        won = own == rank[cell]
        if before is not None:
            won &= own < before[cell]
        best[cell[won]] = dart[won]
        go = ranks[:, -1] < most
        row, weight, most, name, slab, last = row[go], weight[go], most[go], name[go], slab[go], ranks[go, -1]
        n += at_once


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """DartMinHash signatures (n_rows by k) of weighted sets given as (row, element, weight > 0) triples; empty sets get zeros."""
    total = np.bincount(row, weight, n_rows)
    rank, best = np.full(n_rows * k, np.inf), np.zeros(n_rows * k, np.uint64)
    darts, open_ = k * np.log(k) + 2 * k, total > 0
    while open_.any():
        most = np.where(open_, darts / np.maximum(total, 1e-300), 0)
        for few, at_once in ((True, 1), (False, 16)):
            own = open_[row] & ((most[row] < 2) == few)
            _throw(row[own], element[own], weight[own], most, k, at_once, rank, best)
        open_ &= ~np.isfinite(rank.reshape(n_rows, k)).all(1)
        darts *= 2
    return best.reshape(n_rows, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each row and band."""
    cut = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    for j in range(rows):
        key = mixed(key * _STEP + cut[:, :, j])
    return key.view(np.int64)


def _names(texts: pa.Array) -> list[bytes]:
    """128-bit names of the word sequences of the texts."""
    import xxhash

    joined = pc.binary_join(word_lists(texts), "\n")
    return [xxhash.xxh3_128_digest(x) for x in joined.cast(pa.binary()).to_pylist()]


def _signed(docs: DataFrame, bands: int, rows: int, words: int, counted: bool) -> DataFrame:
    """id, name, n_shingles (their weights), bands, sketch (a byte per coordinate) of each row; all but id and name only where a task meets a word sequence first."""
    kinds = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                names = _names(texts)
                fresh = [i for i, x in enumerate(names) if not (x in met or met.add(x))]
                row, element, count = shingles(texts.take(pa.array(fresh, pa.int64())), words)
                weight = count.astype(np.float64) if counted else np.ones(len(row))
                size = np.bincount(row, weight, len(fresh)).astype(np.int64)
                signature = signatures(row, element, weight, len(fresh), bands * rows)
                keys, sketch = band_keys(signature, bands, rows), (signature >> np.uint64(56)).astype(np.uint8)
                wide: list = [None] * len(names)
                n: list = [None] * len(names)
                short: list = [None] * len(names)
                for i, k, s, x in zip(fresh, keys.tolist(), size.tolist(), sketch, strict=True):
                    wide[i], n[i], short[i] = (k if s else []), s, x.tobytes()
                columns = [part.column("id"), pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(wide, kinds), pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "name", "n_shingles", "bands", "sketch"])

    fields = [T.StructField("name", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([docs.schema["id"], *fields]))


def _texts(docs: DataFrame) -> DataFrame:
    """name, text: each word sequence once for each task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                names = _names(part.column("text"))
                fresh = pa.array([i for i, x in enumerate(names) if not (x in met or met.add(x))], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).take(fresh), part.column("text").take(fresh)], ["name", "text"])

    return docs.select("text").mapInArrow(run, "name binary, text string")


def similarities(row: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The (weighted) Jaccard similarity of the sets i and j, of ``n`` sets given by rows in order."""
    ends = np.searchsorted(row, np.arange(n + 1))
    total = np.bincount(row, count, n)

    def side(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends[of + 1] - ends[of]
        at = np.repeat(ends[of], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return (np.repeat(np.arange(len(of)), size).astype(np.uint64) << np.uint64(_BITS)) | element[at], count[at]

    (a, n_a), (b, n_b) = side(i), side(j)
    both, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.bincount((both >> np.uint64(_BITS)).astype(np.int64), np.minimum(n_a[x], n_b[y]), len(i))
    return shared / np.maximum(total[i] + total[j] - shared, 1)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int, counted: bool) -> DataFrame:
    """The pairs (a, b) whose exact (weighted) Jaccard similarity reaches ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (piece for run in slices(batch, "x", 1 << 20) for piece in slices(run, "y", 1 << 20)):
                n = part.num_rows
                row, element, count = shingles(pa.concat_arrays([part.column("x"), part.column("y")]), words)
                count = count if counted else np.ones_like(count)
                keep = pa.array(similarities(row, element, count, 2 * n, np.arange(n), np.arange(n) + n) >= similarity - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _pairs(block: pa.Table, similarity: float) -> np.ndarray:
    """The pairs to settle of two blocks of a group: (one of the few, any other, how alike the signatures are) as rows of ``block``."""
    few, every = np.flatnonzero(block["few"].to_numpy()), np.flatnonzero(~block["few"].to_numpy())
    part, size, node, star, apart = (block[c].to_numpy() for c in ("part", "n", "node", "star", "apart"))
    keys = block["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    sketch = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
    spread = SURE * np.sqrt(similarity * (1 - similarity) / sketch.shape[1])
    band = int((keys[0] == block["key"][0].as_py()).argmax())
    found = [np.empty((0, 3), np.int64)]
    for at in range(0, len(few), 32):  # 32 rows of the matrix of pairs at a time
        rows = few[at : at + 32]
        hit = (part[rows][:, None] != part[every]) & (star[rows][:, None] != node[every]) & (node[rows][:, None] != star[every])
        hit &= ~apart[every] | (node[rows][:, None] < node[every])  # two of the few meet twice
        hit &= np.minimum(size[rows][:, None], size[every]) >= (similarity - 1e-9) * np.maximum(size[rows][:, None], size[every])
        x, y = np.nonzero(hit)
        x, y = rows[x], every[y]
        keep = (keys[x] == keys[y]).argmax(1) == band
        x, y = x[keep], y[keep]
        like = (sketch[x] == sketch[y]).mean(1)
        keep = like >= similarity - spread
        found.append(np.stack([x[keep], y[keep], (like[keep] * 1e6).astype(np.int64)], 1))
    return np.concatenate(found)


def _joining(block: pa.Table, similarity: float, words: int, counted: bool) -> pa.Table:
    """a, b: links of ``similarity`` between two blocks of a group that join components."""
    pairs = _pairs(block, similarity)
    part, node = np.unique(block["part"].to_numpy(), return_inverse=True)[1], block["node"].to_numpy()
    row, element, count = shingles(block["text"].combine_chunks(), words)
    count = count if counted else np.ones_like(count)
    pairs = pairs[np.argsort(-pairs[:, 2], kind="stable")]
    links = np.empty((0, 2), np.int64)
    while len(pairs):
        now, pairs = pairs[:AT_ONCE], pairs[AT_ONCE:]
        good = now[similarities(row, element, count, len(node), now[:, 0], now[:, 1]) >= similarity - 1e-9]
        for a, b, _ in good.tolist():
            if part[a] != part[b]:
                part[part == part[b]] = part[a]
                links = np.append(links, [[a, b]], 0)
        pairs = pairs[part[pairs[:, 0]] != part[pairs[:, 1]]]
    ends = np.sort(node[links], 1) if len(links) else links
    return pa.table([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


_MET = ("key", "low", "high")


def _by_group(work: Callable[[pa.Table], pa.Table | None]) -> Callable:
    """A function for mapInArrow that applies ``work`` to the rows of each (key, low, high), which come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in _MET], 1)
            limits = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for i, j in zip(limits, limits[1:], strict=False):
                if held and tuple(key[i]) != at:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(i, j - i))
                at = tuple(key[i])
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return run


def _settled(rows: DataFrame, texts: DataFrame, similarity: float, words: int, counted: bool) -> DataFrame:
    """a, b: joining links of the groups in ``rows`` (key, low, high, few, apart, node, part, star, n, bands, sketch)."""

    def likely(block: pa.Table) -> pa.Table:
        return block.take(pa.array(np.unique(_pairs(block, similarity)[:, :2])))

    def in_order(frame: DataFrame) -> DataFrame:
        return frame.repartition(*_MET).sortWithinPartitions(*_MET, "node", "few")

    left = written(in_order(rows).mapInArrow(_by_group(likely), rows.schema), "near-likely")
    named = left.join(texts, "node").select(*rows.columns, "text")
    return in_order(named).mapInArrow(_by_group(lambda block: _joining(block, similarity, words, counted)), "a long, b long")


def _placed(member: DataFrame, links: DataFrame) -> DataFrame:
    """key, node, n, part (component so far) of every node of a group."""
    own = components(links, "near-parts")
    joined = member.select("key", "node", "n").join(own, "node", "left")
    return written(joined.select("key", "node", "n", F.coalesce("component", "node").alias("part")), "near-placed")


def _parts(placed: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """key, part, m, w (nodes and shingles), node (one of them, by hash), and key, m, w, top (the largest part) of the groups that have several parts."""
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
    groups = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.max(F.struct("m", "part", "w", "node")).alias("top"))
    return sizes, groups.where("parts > 1").drop("parts")


def _represented(placed: DataFrame, turn: int, nodes: DataFrame, texts: DataFrame, similarity: float, words: int, counted: bool) -> DataFrame:
    """Links between one node of each part of a group and one of its largest part: a pair a part, looked at by signatures first."""
    sizes, groups = _parts(placed, turn)
    met = sizes.join(groups.select("key", F.col("top.part").alias("most"), F.col("top.node").alias("other")), "key").where("part <> most")
    pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                spread = SURE * np.sqrt(similarity * (1 - similarity) / x.shape[1])
                keep = (np.minimum(n_a, n_b) >= (similarity - 1e-9) * np.maximum(n_a, n_b)) & ((x == y).mean(1) >= similarity - spread)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    likely = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")
    return written(_verified(written(likely, "near-pairs"), texts, similarity, words, counted), "near-represented")


def _unsettled(placed: DataFrame, starred: DataFrame, nodes: DataFrame) -> DataFrame:
    """What ``_settled`` reads, of all groups whose nodes lie in several parts."""
    _, groups = _parts(placed, 0)
    blocks = lambda m, w: F.greatest(F.ceil(m / F.lit(BLOCK)), F.ceil(w / F.lit(SHINGLES)), F.lit(1)).cast("int")
    told = groups.select("key", F.col("top.part").alias("most"), blocks(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("lows"), blocks(F.col("m"), F.col("w")).alias("highs"))
    dealt = placed.join(told, "key").withColumn("apart", F.col("part") != F.col("most"))
    of = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("lows") - 1)).alias("low"), of("highs", 0).alias("high"), F.lit(False).alias("few"))
    few = dealt.where("apart").select("*", of("lows", 1).alias("low"), F.explode(F.sequence(F.lit(0), F.col("highs") - 1)).alias("high"), F.lit(True).alias("few"))
    met = written(every.unionByName(few).select(*_MET, "few", "apart", "node", "part", "n"), "near-unsettled")
    stars = starred.select(F.col("b").alias("node"), F.col("a").alias("star"))
    signed = met.join(nodes.select("node", "bands", "sketch"), "node").join(stars, "node", "left")
    return signed.select(*_MET, "few", "apart", "node", "part", F.coalesce("star", "node").alias("star"), "n", "bands", "sketch")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weights: str = "count") -> DataFrame:
    """``id_col``, name, class_id, component, one row per document.

    Documents of one component are joined by links of ``similarity`` or more; class_id is its
    smallest id, and name identifies the document's word sequence. ``weights``: "count" (a shingle
    weighs its number of occurrences) or "set" (every one weighs 1).
    """
    counted = {"set": False, "count": True}[weights]
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(_signed(read, bands, rows, words, counted), "near-signed")
    alike = signed.groupBy("name").agg(F.min("id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("bands", ignorenulls=True).alias("bands"), F.first("sketch", ignorenulls=True).alias("sketch"))
    nodes = written(alike.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("m")).where("m > 1").select("key", "centre")
    member = written(keyed.join(groups, "key"), "near-members")
    starred = written(member.where("node <> centre").groupBy(F.col("node").alias("b")).agg(F.min("centre").alias("a")).select("a", "b"), "near-starred")
    needed = member.select("node").distinct().join(nodes.select("node", "name"), "node")
    texts = written(_texts(read).join(needed, "name").dropDuplicates(["node"]).select("node", "text"), "near-texts")
    first = written(_verified(starred, texts, similarity, words, counted), "near-first")
    links = first
    for turn in range(TURNS):
        links = links.unionByName(_represented(_placed(member, links), turn, nodes, texts, similarity, words, counted))
    rest = _settled(_unsettled(_placed(member, links), starred, nodes), texts, similarity, words, counted)
    links = written(links.unionByName(rest), "near-links")

    parts = components(links, "near")
    labelled = nodes.select("node", "name", "first_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a table of its own, so that the join on components can split the rows of a large one
    classes = written(labelled.groupBy("component").agg(F.min("first_id").alias("class_id")), "near-classes")
    named = labelled.join(classes, "component").select("name", "class_id", "component")
    return signed.select("id", "name").join(named, "name").select(F.col("id").alias(id_col), "name", "class_id", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``: that of the smallest id (nulls last), with its smallest name; of rows that are equal in both one stays."""
    found = near_duplicates(docs, id_col, text_col, **options)
    each = found.select("component", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "name").alias("own")).groupBy("component", "own").agg(F.count("*").alias("copies"))
    best = each.groupBy("component").agg(F.min(F.struct("own", "copies")).alias("best"))
    keep = written(best.select(F.col("best.own.id").alias("keep_id"), F.col("best.own.name").alias("keep_name"), "best.copies"), "near-kept")
    pack = packed(docs, id=id_col, text=text_col)
    schema = T.StructType([*pack.frame.schema.fields, T.StructField("name", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_names(part.column("text").cast(pa.string())), pa.binary())], schema.names)

    named = pack.frame.mapInArrow(run, schema)
    kept = named.join(keep, (F.col("name") == F.col("keep_name")) & F.col("id").eqNullSafe(F.col("keep_id")))
    if not keep.where("copies > 1").isEmpty():  # rows that are equal in id and text
        kept = kept.where("copies = 1").unionByName(kept.where("copies > 1").dropDuplicates(["name"]))
    return pack.restored(kept)
