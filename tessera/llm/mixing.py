"""Mixing sources to target weights by iterative proportional fitting (operator 4).

Token counts are summed once per cell (source, language, topic). Raking then finds a factor for
each source, language and topic such that documents, kept with the probability min(1, product of
the factors of their cell), meet the source, language and topic marginals in expected tokens.
The bound at 1 is part of the fit: cells that reach it count whole, and the factors of the others
make up for them. Documents are sampled by a hash of their row: no random state, so a lost
executor repeats the same choice.

The marginals wanted are the corpus's own shares raised to ``power`` and normalised (1 keeps
the mix, 0 makes it even), so rare sources, languages and topics gain; ``wanted`` sets shares
by name instead, and what it doesn't name there goes. ``kept`` of all tokens are wanted together,
or all that can stay if that is less. A source, language or topic can't give more tokens than it
has: what its share asks beyond that goes to the others in proportion. If the three marginals
still rule each other out, all three step back together towards the corpus's own mix, which can
always be met, a part of 1 / STEPS at a time until a fit meets them; a warning names how far the way
went.

Factors are found for all cells at once: the row of a source holds the tokens of its (language,
topic) pairs, its factor follows exactly from the factors of the pairs, and a round is one
aggregate that returns two numbers per pair to the driver. Every language label has a marginal
of its own, so there are at most TOPICS + 1 pairs a label: the driver's memory grows with the
number of labels, not with the corpus; sources stay distributed.

A document's topic is the nearest of TOPICS centres of word profiles: its distinct words hashed
into DIMENSIONS buckets, as a vector of length 1 without the mean of its language (labels hashed to
MEANS slots), which takes away the words that all texts of a language have. Centres begin as
SEEDS documents' profiles, chosen by hash, of which the farthest from each other are taken, and
move to the mean of their documents over the whole corpus, in whole numbers, MOVES times.

Whole texts are read in slices, so a long one takes memory in proportion to itself only. Null
texts have no tokens, null labels form a label of their own (""), documents without tokens weigh
nothing in the marginals and share their cell's probability, repeated rows are kept or dropped
together, and an empty table gives an empty result. All other columns are carried along under any
names; an input column with the name of an added one is replaced by it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import hashed_words, packed, slices, written

#: Topics, share of the tokens kept, and the power of the shares.
TOPICS, KEPT, POWER = 8, 0.8, 0.7
#: Buckets of a profile, slots of language means, profiles that centres begin from, moves of the centres, and the unit of profiles.
DIMENSIONS, MEANS, SEEDS, MOVES, UNIT = 64, 256, 512, 3, 4096
#: Largest distance from a marginal, in parts of it, rounds of a fit at most, and steps back to the corpus's own mix.
TOLERANCE, ROUNDS, STEPS = 5e-3, 20, 20
#: How far a round goes, in parts of what would meet the marginals alone.
STRIDE = 1.3

ADDED = ("topic", "n_tokens", "weight", "probability")
_FAR, _NEAR = 1e30, 1e-30


def profiled(frame: DataFrame) -> DataFrame:
    """``frame`` (with text) with n_tokens (words) and profile; no shuffle, of a batch only the text is looked at."""
    schema = T.StructType([*frame.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("profile", T.ArrayType(T.ShortType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(part.column("text"), "")), r"[^\p{L}\p{N}]+")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                words = lists.flatten().dictionary_encode()
                code = words.indices.to_numpy().astype(np.int64)
                real = pc.greater(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
                row, code = row[real], code[real]
                n = np.bincount(row, minlength=part.num_rows)
                bucket = (hashed_words(words.dictionary) % np.uint64(DIMENSIONS)).astype(np.int64)
                distinct = np.unique(row * max(1, len(bucket)) + code)
                cell = distinct // max(1, len(bucket)) * DIMENSIONS + bucket[distinct % max(1, len(bucket))] if len(distinct) else distinct
                seen = np.bincount(cell, minlength=part.num_rows * DIMENSIONS).reshape(-1, DIMENSIONS).astype(float)
                length = np.sqrt((seen**2).sum(1, keepdims=True))
                unit = np.rint(UNIT * seen / np.maximum(length, 1)).astype(np.int16)
                profile = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), DIMENSIONS).cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int64)), profile], schema.names)

    return frame.mapInArrow(run, schema)


def _matrix(profiles: pa.Array) -> np.ndarray:
    return profiles.flatten().to_numpy().astype(np.float64).reshape(-1, DIMENSIONS)


def _sums(rows: DataFrame, most: int, told: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """How many rows there are of each number below ``most``, and the sum of their vectors of whole numbers, as ``told`` gives both.

    A task gives at most ``most`` * (DIMENSIONS + 1) partial sums; as whole numbers they don't depend on the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(most, np.int64), np.zeros((most, DIMENSIONS))
        for batch in batches:
            number, vectors = told(batch)
            n += np.bincount(number, minlength=most)
            np.add.at(total, number, vectors)
        at = np.flatnonzero(n)
        parts = np.concatenate([n[at, None], total[at].astype(np.int64)], 1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, DIMENSIONS + 1)), pa.array(np.tile(np.arange(DIMENSIONS + 1), len(at))), pa.array(parts)], ["number", "place", "total"])

    out = np.zeros((most, DIMENSIONS + 1))
    for r in rows.mapInArrow(run, "number long, place long, total long").groupBy("number", "place").agg(F.sum("total").alias("total")).collect():
        out[r.number, r.place] = r.total
    return out[:, 0], out[:, 1:]


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(-1, keepdims=True)), 1e-12)


def with_topics(counted: DataFrame, topics: int = TOPICS) -> DataFrame:
    """``counted`` (n_tokens, profile, lang_label, key) with topic in place of the profile; -1 without words."""
    slotted = counted.withColumn("slot", F.pmod(F.xxhash64("lang_label"), F.lit(MEANS)).cast("int"))
    spoken = slotted.where("n_tokens > 0").select("key", "profile", "slot")
    n, total = _sums(spoken.select("profile", "slot"), MEANS, lambda batch: (batch.column("slot").to_numpy(), _matrix(batch.column("profile"))))
    mean = total / np.maximum(n, 1)[:, None]

    def own(profile: pa.Array, slot: pa.Array) -> np.ndarray:
        return _directions(_matrix(profile) - mean[slot.to_numpy()])

    def nearest(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.rint(vectors @ centre.T * (1 << 20)).argmax(1)

    seeds = spoken.orderBy("key", "profile").limit(SEEDS).toArrow().combine_chunks()
    first = own(seeds["profile"].combine_chunks(), seeds["slot"].combine_chunks()) if seeds.num_rows else np.zeros((1, DIMENSIONS))
    centre = first[:1]
    while len(centre) < min(topics, len(first)):
        centre = np.concatenate([centre, first[[int((first @ centre.T).max(1).argmin())]]])

    for _ in range(MOVES):

        def moved(batch: pa.RecordBatch, centre: np.ndarray = centre) -> tuple[np.ndarray, np.ndarray]:
            vectors = own(batch.column("profile"), batch.column("slot"))
            return nearest(vectors, centre), np.rint(vectors * UNIT)

        n, total = _sums(spoken.select("profile", "slot"), len(centre), moved)
        centre = np.where(n[:, None] > 0, _directions(total), centre)

    @F.arrow_udf(T.IntegerType())
    def topic(profile: pa.Array, slot: pa.Array, n_tokens: pa.Array) -> pa.Array:
        return pa.array(np.where(n_tokens.to_numpy() > 0, nearest(own(profile, slot), centre), -1).astype(np.int32))

    return slotted.withColumn("topic", topic("profile", "slot", "n_tokens")).drop("profile", "slot")


def _filled(held: np.ndarray, asked: np.ndarray, total: float) -> np.ndarray:
    """Targets in proportion to ``asked`` that sum to ``total`` and don't exceed ``held``."""
    out = np.zeros(len(held))
    open_ = asked > 0
    while open_.any():
        give = asked * (max(total - out[~open_].sum(), 0.0) / asked[open_].sum())
        full = open_ & (give >= held)
        if not full.any():
            out[open_] = give[open_]
            break
        out[full] = held[full]
        open_ &= ~full
    return out


def _doubles(values: np.ndarray) -> Column:
    """An array of numbers as one literal, however many there are."""
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _factor(given: Column) -> Column:
    """The factor f of a source (held, own, target) with sum of t * min(1, f * g) = target over its pairs."""
    falling = F.sort_array(F.transform("held", lambda x: F.struct((-F.get(given, x["i"])).alias("o"), x["t"].alias("t"))))

    def solved(pairs: Column) -> Column:
        whole = F.aggregate(pairs, F.lit(0.0), lambda a, x: a - x["t"] * x["o"])
        start = F.struct(F.lit(0.0).alias("cut"), whole.alias("rest"), F.lit(False).alias("done"))

        def step(a: Column, x: Column) -> Column:
            over = ~a["done"] & ((F.col("target") - a["cut"]) * -x["o"] > a["rest"])
            return F.struct((a["cut"] + F.when(over, x["t"]).otherwise(0.0)).alias("cut"), (a["rest"] + F.when(over, x["t"] * x["o"]).otherwise(0.0)).alias("rest"), (a["done"] | ~over).alias("done"))

        return _let(F.aggregate(pairs, start, step), lambda a: (F.col("target") - a["cut"]) / F.greatest(a["rest"], F.lit(_NEAR)))

    return F.when(F.col("own") <= 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("target") >= F.col("own") * (1 - 1e-12), _FAR).otherwise(_let(falling, solved))


def _chance(f: Column, g: Column) -> Column:
    return F.least(F.lit(1.0), f * g)


def calibrated(cells: DataFrame, kept: float = KEPT, power: float = POWER, wanted: Mapping[str, Mapping] | None = None) -> DataFrame:
    """source, lang, topic, weight, probability for every cell (source, lang, topic, tokens: one row each, no nulls).

    ``weight`` is the product of the cell's factors and ``probability`` the weight cut at 1;
    probability times tokens meets all three marginals.
    """
    wanted = wanted or {}
    share = lambda kind: F.create_map(*[x for k, v in wanted[kind].items() for x in (F.lit(k), F.lit(float(v)))])[F.col(kind)]
    asked_for = [F.coalesce(share(kind), F.lit(0.0)) > 0 for kind in wanted if wanted[kind]]
    every = written(cells.select("source", "lang", "topic", "tokens", reduce(and_, asked_for, F.lit(True)).alias("open")), "mix-cells")
    cells = every.where("open")
    whole = float(every.agg(F.sum("tokens")).first()[0] or 0)
    top = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("lang", "topic").collect()  # at most TOPICS + 1 rows a language
    pairs = [(r.lang, r.topic) for r in top]
    tokens = np.array([r.tokens for r in top], float)
    total = float(tokens.sum())
    langs, topics = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    lang_at, topic_at = {a: i for i, a in enumerate(langs)}, {b: i for i, b in enumerate(topics)}
    of_lang, of_topic = np.array([lang_at[a] for a, _ in pairs], int), np.array([topic_at[b] for _, b in pairs], int)

    def asked(held: np.ndarray, names: list, by: Mapping | None) -> np.ndarray:
        return np.where(held > 0, np.array([by.get(n, 0.0) for n in names], float) if by else np.power(held, power, where=held > 0, out=np.zeros(len(held))), 0)

    margins = [(of, np.bincount(of, tokens, len(names)), names, wanted.get(kind)) for kind, of, names in (("lang", of_lang, langs), ("topic", of_topic, topics))]
    sides = [(of, held, asked(held, names, by)) for of, held, names, by in margins]

    index = cells.sparkSession.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "lang string, topic int, i int")
    entry = F.struct("i", F.col("tokens").cast("double").alias("t"))
    rows = cells.join(index, ["lang", "topic"]).groupBy("source").agg(F.sort_array(F.collect_list(entry)).alias("held"), F.sum("tokens").cast("double").alias("own"))
    names = wanted.get("source")
    raw = share("source") if names else F.pow("own", F.lit(power))
    rows = written(rows.withColumn("asked", F.when(F.col("own") > 0, raw).otherwise(0.0)), "mix-sources")
    goal = min(kept * whole, total)
    own = goal / total if total else 0.0  # what every cell would be kept with for the corpus's own mix
    filled = [(of, held, _filled(held, ask, goal)) for of, held, ask in sides]
    wanted_rows = rows.withColumn("filled", F.least("own", F.col("asked") * F.lit(_level(rows, goal))))

    def fit(way: float) -> tuple[DataFrame, list[np.ndarray]] | None:
        """The rows with their targets and the factors of the two small marginals that meet them, ``way`` of the way from the corpus's own mix; None where rounds don't get nearer."""
        targets = [(of, way * fill + (1 - way) * own * held) for of, held, fill in filled]
        aimed = wanted_rows.withColumn("target", F.lit(way) * F.col("filled") + F.lit((1 - way) * own) * F.col("own"))
        factors, seen = [np.ones(len(target)) for _, target in targets], []
        while goal:
            given = _doubles(factors[0][of_lang] * factors[1][of_topic])
            told = lambda f: F.transform("held", lambda x: F.struct(x["i"].alias("i"), (x["t"] * _chance(f, F.get(given, x["i"]))).alias("m"), F.when(f * F.get(given, x["i"]) >= 1, x["t"]).otherwise(0.0).alias("c")))
            met, cut = np.zeros(len(pairs)), np.zeros(len(pairs))
            for r in aimed.select(F.inline(_let(_factor(given), told))).groupBy("i").agg(F.sum("m").alias("m"), F.sum("c").alias("c")).collect():
                met[r.i], cut[r.i] = r.m, r.c
            seen.append(max(float((np.abs(np.bincount(of, met, len(target)) - target) / np.maximum(target, 1e-9 * goal)).max()) for of, target in targets))
            if seen[-1] < TOLERANCE or not way:
                return aimed, factors
            if len(seen) == ROUNDS or (len(seen) > 2 and seen[-1] > 0.85 * seen[-3]):
                return None
            free, before = met - cut, [f.copy() for f in factors]
            for _ in range(20):  # the two small marginals, on the driver's table of pairs
                for side, (of, target) in enumerate(targets):
                    fixed, open_ = np.bincount(of, cut, len(target)), np.bincount(of, free, len(target))
                    scale = np.where(target > fixed, np.divide(target - fixed, open_, out=np.ones_like(target), where=open_ > 0), np.divide(target, fixed + open_, out=np.ones_like(target), where=fixed + open_ > 0))
                    new = np.clip(factors[side] * np.clip(scale, 0.1, 10.0), _NEAR, _FAR)
                    free *= (new / factors[side])[of]
                    factors[side] = new
            factors = [np.clip(old * (new / old) ** STRIDE, _NEAR, _FAR) for old, new in zip(before, factors, strict=True)]
        return aimed, factors  # nothing to keep

    ways = [i / STEPS for i in range(STEPS, -1, -1)] if goal else [0.0]
    way, (aimed, factors) = next((way, found) for way in ways if (found := fit(way)))
    if goal and way < 1:
        warnings.warn(f"the marginals rule each other out; those {way:.0%} of the way from the corpus's own mix are met", stacklevel=2)
    given = _doubles(factors[0][of_lang] * factors[1][of_topic])
    fitted = lambda f: F.transform("held", lambda x: F.struct(x["i"].alias("i"), F.least(F.lit(_FAR), f * F.get(given, x["i"])).alias("weight")))
    each = aimed.select("source", F.inline(_let(_factor(given), fitted))).join(index, "i")
    fits = each.select("source", "lang", "topic", "weight", F.least(F.lit(1.0), "weight").alias("probability"))
    others = every.where("NOT open").select("source", "lang", "topic", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    return written(fits.unionByName(others), "mix-fitted")


def _level(rows: DataFrame, goal: float) -> float:
    """The factor by which least(own, factor * asked) sums to ``goal``, found by narrowing in three aggregates."""
    low, high = 0.0, float(rows.where("asked > 0").agg(F.max(F.col("own") / F.col("asked"))).first()[0] or 0.0)
    for _ in range(4):
        tries = np.linspace(low, high, 65).tolist()
        sums = rows.agg(*[F.sum(F.least("own", F.col("asked") * t)).alias(f"s{i}") for i, t in enumerate(tries)]).first()
        at = min(max(int(np.searchsorted(np.array([x or 0.0 for x in sums]), goal * (1 - 1e-12))), 1), len(tries) - 1)
        low, high = tries[at - 1], tries[at]
        below, above = float(sums[at - 1] or 0.0), float(sums[at] or 0.0)
    return low + (high - low) * ((goal - below) / (above - below) if above > below else 1.0)


def mixed_sample(docs: DataFrame, kept: float = KEPT, power: float = POWER, wanted: Mapping[str, Mapping] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 0) -> DataFrame:
    """The sampled rows of ``docs`` with topic, n_tokens, weight and probability."""
    pack = packed(docs, id=id_col, text=text_col, source=source_col, lang=lang_col)
    labels = {f"{c}_label": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang")}
    told = pack.frame.withColumns(labels | {"text": F.col("text").cast("string"), "key": F.xxhash64("id", "text", F.lit(seed))})
    rows = with_topics(written(profiled(told), "mix-counted"))
    cells = rows.groupBy(F.col("source_label").alias("source"), F.col("lang_label").alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens"))
    fitted = calibrated(cells, kept, power, wanted).select(F.col("source").alias("source_label"), F.col("lang").alias("lang_label"), "topic", "weight", "probability")
    # Spark broadcasts the cells where their files are small; else it splits the partitions of a hot cell
    joined = rows.join(fitted, ["source_label", "lang_label", "topic"])
    draw = F.pmod(F.col("key"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return pack.restored(joined.where(draw < F.col("probability")), {c: F.col(c) for c in ADDED})
