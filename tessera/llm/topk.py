"""Exact top-k inner products by block-at-a-time pruning (operator 1).

Vectors are put in an order that keeps like vectors together and cut into ranges. A range
holds blocks, and a block holds its vectors (a forward index) and, for each component and
sign, the largest value (the term maxima). A query's bound on a block is the sum of its
component sizes times the block's maxima for its signs. Per range, a query takes blocks by
falling bound, scores them through their forward indexes and stops when the next bound can't
change its k best: below the kth score, or equal to it with no smaller id in the block.

Ranges are pruned in the same way before anything is sent to them. A range's own term maxima are
kept as one row. Every query starts from a threshold, its kth score in the range that holds its
own vector, and bounds every range from the rows of maxima alone. It first goes to the PROBES
ranges of the highest bounds; the kth best score from there raises its threshold, and all ranges whose
bound still reaches that are visited then (those PROBES again, as its block may meet them for others).
First, the queries that chose a range are sent to it,
BLOCKS * BLOCK at a time. Then a block of queries from neighbouring ranges meets a part of the ranges
that any of it chose, so that each vector is sent once a block and each query once a part; ranges
that a query didn't choose are passed over there by the same bound, and the part returns only its k
best, however many of its ranges reach the threshold. Choices are streamed, and a task holds queries
and GROUP rows of maxima, or one block and one part, each of about COMPONENTS components at most,
whatever the size of the table and however little is pruned. A range holds about RANGE vectors,
however the table is partitioned.

Pivots (PIVOTS vectors, chosen by hash) only order the vectors: a vector's cell is its two
nearest pivots, small cells share a range and large ones are dealt to several, so a vector that
most rows hold fills ranges of its own. Every row is indexed and results are exact for any pivots.

Vectors that are null, or hold null or non-finite components, take no part; shorter vectors
count as padded with zeros; rows with equal ids are separate candidates, and a query's own id
never is one; query rows of one id are ranked together, as one query whose candidates score once
for each of them; ties go to smaller ids; null ids take no part. An empty table gives an empty
result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Vectors of a block and of a range, vectors that fix the order, and blocks scored between two looks at the bounds.
BLOCK, RANGE, PIVOTS, STEP = 128, 2048, 64, 4
#: Ranges a query visits first, rows of maxima that a task looks at together, and blocks of BLOCK queries that are scored together.
PROBES, GROUP, BLOCKS = 2, 8192, 16
#: Components of the queries, maxima or vectors that a task holds, and choices that it returns together.
COMPONENTS, CHOICES = 1 << 22, 1 << 19

#: What no score reaches, as its negative exists, and what no id exceeds.
_LOW, _FAR = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<long> column padded with zeros to ``width``."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    length = np.diff(offsets)
    out = np.zeros((len(length), width), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = values[offsets[0] : offsets[-1]]
    return out


def _exact(a: np.ndarray, *others: np.ndarray) -> type:
    """The fastest type in which every partial sum of a @ b.T is exact, for each b of others."""
    most = max(float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0 for b in others)
    return np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in the type of both."""
    return a @ b.T


def _bound(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest score that each query can have with vectors of these term maxima, in an exact type."""
    kind = _exact(q, most, least)
    q, most, least = q.astype(kind), most.astype(kind), least.astype(kind)
    return _product(np.maximum(q, 0), most) + _product(np.minimum(q, 0), least)


class Found:
    """Queries with their k best so far, and the score (kth) that further ones have to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, at_least: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.kth = ids, vectors, at_least.copy()
        self.top_s, self.top_i = np.full((len(ids), k), _LOW), np.full((len(ids), k), _FAR)

    def add(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take ids with their scores for the queries of the numbers ``who``."""
        k = self.top_s.shape[1]
        order = np.argsort(who, kind="stable")
        rows, first, count = np.unique(who[order], return_index=True, return_counts=True)
        if not len(rows):
            return
        at = np.repeat(np.arange(len(rows)), count), k + np.arange(len(who)) - np.repeat(first, count)
        s, i = (np.concatenate([top[rows], np.full((len(rows), count.max()), none)], 1) for top, none in ((self.top_s, _LOW), (self.top_i, _FAR)))
        s[at], i[at] = score[order], ids[order]
        keep = np.lexsort((i, -s), axis=1)[:, :k]
        self.top_s[rows], self.top_i[rows] = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
        self.kth[rows] = np.maximum(self.kth[rows], self.top_s[rows, -1])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of what was found."""
        at = np.nonzero(self.top_s > _LOW)
        return at[0], self.top_i[at], self.top_s[at]


class Range:
    """Blocks of a range of vectors, with their term maxima."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int | None = None) -> None:
        block = block or BLOCK
        self.ids, self.vectors = ids, vectors
        self.first = np.arange(0, len(ids), block)
        self.last = np.minimum(self.first + block, len(ids))
        self.most = np.maximum.reduceat(vectors, self.first, axis=0)
        self.least = np.minimum.reduceat(vectors, self.first, axis=0)
        self.min_id = np.minimum.reduceat(ids, self.first)

    def best(self, q_ids: np.ndarray, q: np.ndarray, at_least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of the k best of each query, of those that reach at_least."""
        found = Found(q_ids, q, at_least, k)
        self.scan(found, np.arange(len(q)))
        return found.best()

    def scan(self, found: Found, live: np.ndarray) -> None:
        """Add to ``found``, for the queries of the numbers ``live``, what can be among their k best."""
        bound = _bound(found.vectors[live], self.most, self.least)
        order = np.argsort(-bound, axis=1, kind="stable")
        kind = _exact(found.vectors[live], self.vectors)
        q, vectors, at = found.vectors[live].astype(kind), self.vectors.astype(kind), np.arange(len(live))
        for step in range(0, len(self.first), STEP):
            picked = order[at, step : step + STEP]
            ahead, kth = np.take_along_axis(bound[at], picked, 1), found.kth[live[at], None]
            # a block of equal bound can still give a smaller id, until the kth is smaller than all of its ids
            useful = (ahead > kth) | ((ahead == kth) & (self.min_id[picked] <= found.top_i[live[at], -1][:, None]))
            # bounds fall along the order: nothing is left for a query whose next bound is below its kth
            go = ahead[:, 0] >= kth[:, 0]
            at, picked, useful = at[go], picked[go], useful[go]
            if not len(at):
                break
            chosen = np.zeros((len(at), len(self.first)), bool)
            np.put_along_axis(chosen, picked, useful, 1)
            hits = []
            for b in np.flatnonzero(chosen.any(0)):
                rows, ids = at[chosen[:, b]], self.ids[self.first[b] : self.last[b]]
                scores = _product(q[rows], vectors[self.first[b] : self.last[b]])
                rows = live[rows]
                # a kth that this type rounds is beyond all of these scores, on the same side
                row, place = np.divmod(np.flatnonzero(scores >= found.kth[rows, None].astype(kind)), len(ids))
                other = ids[place] != found.ids[rows[row]]
                row, place = row[other], place[other]
                hits.append((rows[row], ids[place], scores[row, place].astype(np.int64)))
            if hits:
                found.add(*map(np.concatenate, zip(*hits, strict=True)))


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    both = df.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"))
    return both.where(F.col("id").isNotNull() & F.col("v").isNotNull())


def _dealt(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(cell, first range, ranges) of each cell: small ones in order share a range of about RANGE vectors, large ones have several."""
    out, no, held = [], 0, 0
    for cell, n in sorted(counts.items()):
        if held and held + n > RANGE:
            no, held = no + 1, 0
        parts = -(-n // RANGE)
        out.append((cell, no, parts))
        held += n
        if parts > 1:
            no, held = no + parts, 0
    return out


def _indexed(vectors: DataFrame, every: int, k: int) -> tuple[DataFrame, int]:
    """``vectors`` in ranges, and their number: range_no, id, v, at_least (a query's threshold, else null); rows with ``least`` hold a range's term maxima."""
    spark = vectors.sparkSession
    pivots = [r.v for r in vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
    width = max([0, *map(len, pivots)])
    centre = np.array([v + [0] * (width - len(v)) for v in pivots], np.float64).reshape(len(pivots), width)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = max([width, *np.diff(batch.column("v").offsets.to_numpy())]) if batch.num_rows else width
            like = _matrix(batch.column("v"), own)[:, :width].astype(np.float64) @ centre.T
            two = np.argsort(-like, 1, kind="stable")[:, :2] if len(centre) else np.zeros((batch.num_rows, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((two[:, 0] * PIVOTS + two[:, -1]).astype(np.int32)), *batch.columns], ["cell", "id", "v"])

    coded = written(vectors.mapInArrow(near, "cell int, id long, v array<long>").withColumn("number", F.monotonically_increasing_id()), "op1-coded")
    deal = _dealt({r.cell: r["count"] for r in coded.groupBy("cell").count().collect()})  # PIVOTS * PIVOTS rows at most
    n_ranges = deal[-1][1] + deal[-1][2] if deal else 0
    placed = coded.join(F.broadcast(spark.createDataFrame(deal, "cell int, no int, parts int")), "cell")
    rows = placed.select((F.col("no") + F.pmod(F.xxhash64("number"), F.col("parts"))).cast("long").alias("range_no"), "id", "v")

    def ranged(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, v = table["id"].combine_chunks(), table["v"].combine_chunks()
        number, own = ids.to_numpy(), _matrix(v, int(np.diff(v.offsets.to_numpy()).max()))
        asked = np.flatnonzero(number % every == 0)
        at_least = np.full(len(asked), np.iinfo(np.int64).min)
        who, _, score = Range(number, own).best(number[asked], own[asked], at_least, k)
        full = np.bincount(who, minlength=len(asked)) == k
        lowest = np.full(len(asked), np.iinfo(np.int64).max)
        np.minimum.at(lowest, who, score)
        threshold, mask = np.full(len(number), np.iinfo(np.int64).min), np.ones(len(number), bool)
        threshold[asked[full]], mask[asked] = lowest[full], False
        kind = pa.list_(pa.int64())
        first = [pa.array([key[0].as_py()] * (len(number) + 1), pa.int64()), pa.concat_arrays([ids, pa.array([None], pa.int64())])]
        values = [pa.concat_arrays([v.cast(kind), pa.array([own.max(0).tolist()], kind)]), pa.array([*[None] * len(number), own.min(0).tolist()], kind)]
        return pa.table([*first, *values, pa.array(np.append(threshold, 0), mask=np.append(mask, True))], ["range_no", "id", "v", "least", "at_least"])

    return written(rows.groupBy("range_no").applyInArrow(ranged, "range_no long, id long, v array<long>, least array<long>, at_least long"), "op1-ranges"), n_ranges


def _chosen(asked: DataFrame, maxima: DataFrame, n_groups: int, pieces: int, last: int | None = None) -> DataFrame:
    """block, range_no, id, and v, at_least if there is a last place: the ranges that may hold what reaches a query's threshold, up to place ``last`` by falling bound in each group of maxima. Blocks are looked at in ``pieces``."""
    groups = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    left = asked.select("block", groups.alias("part"), F.pmod(F.xxhash64("id"), F.lit(pieces)).alias("piece"), "id", "v", "at_least")
    right = maxima.join(left.select("block", "part", "piece").distinct(), "part").select("block", "part", "piece", "v", "range_no", "least")
    names, together = ["block", "range_no", "id", *["v", "at_least"] * (last is not None)], BLOCKS * BLOCK

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        left, right = table.filter(pc.is_null(table["range_no"])).combine_chunks(), table.filter(pc.is_valid(table["range_no"])).sort_by("range_no").combine_chunks()
        del table
        if not left.num_rows or not right.num_rows:
            return
        q, most, least = (t[c].combine_chunks() for t, c in ((left, "v"), (right, "v"), (right, "least")))
        width = int(max(np.diff(x.offsets.to_numpy()).max() for x in (q, most)))
        most, least, at_least, no = _matrix(most, width), _matrix(least, width), left["at_least"].to_numpy(), right["range_no"].to_numpy()
        left, some = left.select(names), max(1, min(together, CHOICES // len(no)))
        for i in range(0, left.num_rows, some):
            bound = _bound(_matrix(q.slice(i, some), width), most, least)
            order = np.argsort(-bound, 1, kind="stable")[:, :last]
            row, place = np.nonzero(np.take_along_axis(bound, order, 1) >= at_least[i : i + some, None])
            took = left.slice(i, some).take(pa.array(row)).combine_chunks()
            took = took.set_column(took.schema.get_field_index("range_no"), "range_no", pa.array(no[order[row, place]], pa.int64()))
            yield from took.to_batches()

    both = left.unionByName(right, allowMissingColumns=True).groupBy("block", "part", "piece")
    kinds = {"v": "array<long>"}
    return both.applyInArrow(bounded, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def _searched(chosen: DataFrame, index: DataFrame, k: int, name: str, whole: DataFrame | None = None, span: int = 1) -> DataFrame:
    """query_id, id, score: the k best of each query in the ranges that it chose, of those that reach its threshold.

    Without ``whole``, the choices hold the queries and go to their range, BLOCKS * BLOCK at a time; else the blocks of
    ``whole`` go to every ``span`` ranges that any of their queries chose.
    """
    together = BLOCKS * BLOCK
    if whole is None:
        sent = written(chosen, f"{name}-sent").withColumn("number", F.monotonically_increasing_id())
        chunks = sent.groupBy("range_no").agg(F.ceil(F.count("*") / together).alias("chunks"))
        left = sent.drop("block").join(chunks, "range_no").select(F.pmod(F.xxhash64("number"), F.col("chunks")).alias("block"), F.col("range_no").alias("part"), "id", "v", "at_least")
        needed = chunks.select("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("block"), F.col("range_no").alias("part"))
    else:
        needed = written(chosen.select("block", "range_no").distinct(), f"{name}-needed").withColumn("part", F.floor(F.col("range_no") / span))
        left = whole.join(needed.select("block", "part").distinct(), "block").select("block", "part", "id", "v", "at_least")
    held = index.where("least IS NULL").join(needed, "range_no").select(F.col("block").alias("for_block"), F.col("part").alias("of_part"), "range_no", F.col("id").alias("held_id"), F.col("v").alias("held_v"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty((3, 0), np.int64)]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("range_no", "ascending"), ("held_id", "ascending")]).combine_chunks()
            a, b = left["v"].combine_chunks(), right["held_v"].combine_chunks()
            width = int(max(np.diff(a.offsets.to_numpy()).max(), np.diff(b.offsets.to_numpy()).max()))
            q_ids, at_least, ids = left["id"].to_numpy(), left["at_least"].to_numpy(), right["held_id"].to_numpy()
            edges = [0, *np.flatnonzero(np.diff(right["range_no"].to_numpy())) + 1, len(ids)]
            ranges = [Range(ids[i:j], _matrix(b.slice(i, j - i), width)) for i, j in zip(edges, edges[1:], strict=False)]
            most, least = np.stack([r.most.max(0) for r in ranges]), np.stack([r.least.min(0) for r in ranges])
            for i in range(0, len(q_ids), together):
                found = Found(q_ids[i : i + together], _matrix(a.slice(i, together), width), at_least[i : i + together], k)
                bound = _bound(found.vectors, most, least)
                for n in np.argsort(-bound.max(0), kind="stable"):
                    live = np.flatnonzero(bound[:, n] >= found.kth)
                    if len(live):
                        ranges[n].scan(found, live)
                who, there, score = found.best()
                out.append(np.stack([found.ids[who], there, score]))
        return pa.table([pa.array(x) for x in np.concatenate(out, 1)], ["query_id", "id", "score"])

    pairs = left.groupBy("block", "part").cogroup(held.groupBy("for_block", "of_part"))
    return pairs.applyInArrow(search, "query_id long, id long, score long")


def _blocks(queries: DataFrame, per: int, room: int) -> DataFrame:
    """block, id, v, at_least: queries in blocks of about ``room`` at most, from ``per`` neighbouring ranges each."""
    numbered = queries.select(F.floor(F.col("range_no") / per).alias("wide"), F.monotonically_increasing_id().alias("number"), "id", "v", "at_least")
    parts = numbered.groupBy("wide").agg(F.ceil(F.count("*") / room).alias("parts"))
    block = F.col("wide") * 2**24 + F.pmod(F.xxhash64("number"), F.col("parts"))
    return written(numbered.join(parts, "wide").select(block.alias("block"), "id", "v", "at_least"), "op1-asked")


def top_k(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, ``id_col``, score: the k best of all other rows for each row whose id is divisible by ``every``."""
    index, n_ranges = _indexed(_vectors(df, id_col, vector_col), every, k)
    n_queries, width = index.agg(F.count("at_least"), F.max(F.size("least"))).first()
    room = max(BLOCK, COMPONENTS // max(1, width or 0))
    n_groups = max(1, -(-n_ranges // min(GROUP, room)))
    maxima = index.where("least IS NOT NULL").select(F.pmod(F.xxhash64("range_no"), F.lit(n_groups)).cast("int").alias("part"), "range_no", "v", "least")
    per = max(1, room * n_ranges // max(1, n_queries))
    pieces = max(1, -(-min(room, n_queries) // (BLOCKS * BLOCK)))
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    span = max(1, min(room // RANGE, n_ranges * -(-n_ranges // per) // tasks))
    asked = _blocks(index.where("at_least IS NOT NULL"), per, room)

    best = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")).where(F.col("rank") <= k)
    first = best(_searched(_chosen(asked, maxima, n_groups, pieces, PROBES), index, k, "op1-first"))
    kth = written(first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth")), "op1-kth")
    raised = asked.join(kth, "id", "left").select("block", "id", "v", F.greatest("at_least", "kth").alias("at_least"))
    found = best(_searched(_chosen(raised, maxima, n_groups, pieces), index, k, "op1-rest", raised, span))
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
