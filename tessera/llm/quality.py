"""Quality classifier with hierarchical empirical Bayes (operator 3).

Two traits of a document are rated: poor quality and toxicity. A sparse logistic model, fitted
on at most SAMPLE labelled documents (those with the smallest hashes), gives each document's
own evidence as a log likelihood ratio. The documents' expected traits are then summed by host
and by path below it, and the rates shrink down the hierarchy: a path towards its host, a host
towards the corpus, each by a strength found from the spread of the rates (method of moments),
so that sparse sites stay near the global prior. A document's posterior odds are its evidence
times the odds of its path, from which it is itself left out.

Sums over sites cover all documents by grouped aggregation. Evidence looks at whole texts.

Null texts count as empty, null hosts and paths form a site of their own, null labels and
labels of unknown documents teach nothing, labels and labelled documents that repeat count once,
and without both kinds of labels the evidence is even. Whole texts are read in slices, and neither
texts nor all features reach the driver. An empty table gives an empty result. All other columns
are carried along under any names; an input column with the name of an added one is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices, written

#: Labelled documents that the model is fitted on, features it may use, documents a feature must be in.
SAMPLE, FEATURES, LEAST = 4000, 1500, 3
#: A document goes when either posterior reaches this.
REJECT = 0.5
#: Bounds of the strengths, in documents.
WEAKEST, STRONGEST = 1.0, 1e6

TRAITS = ("poor", "toxic")
ADDED = ("evidence_poor", "evidence_toxic", "p_poor", "p_toxic")

_SYMBOLS = re.compile(r"[^\w\s]{2,}$")
_EDGES = re.compile(r"^\W+|\W+$")
_LEVELS = (0.02, 0.05, 0.1, 0.2, 0.4)


def word_features(word: str) -> tuple[list[str], str]:
    """Features of a word (itself and its beginnings), and its shapes."""
    core = _EDGES.sub("", word).lower()
    shape = ("s" if _SYMBOLS.search(word) else "") + ("u" if len(core) > 2 and word.isupper() else "") + ("n" if not core else "")
    return ([core] if len(core) < 4 else [core, *(core[:n] + "*" for n in range(4, min(8, len(core))))]) if core else [], shape


def _levels(name: str, share: float) -> list[str]:
    return [f"<{name}>{x}" for x in _LEVELS if share >= x]


def shape_features(n: int, distinct: int, shapes: dict[str, int]) -> list[str]:
    """Features of a whole text: shares of words of each shape, of repeated words, and its length."""
    out = [f"<words<{x}>" for x in (5, 20) if n < x]
    if n:
        for s in "sun":
            out += _levels(s, shapes.get(s, 0) / n)
        out += [f"<repeats>{x}" for x in (0.5, 0.7, 0.8, 0.9) if n >= 20 and 1 - distinct / n >= x]
    return out


def text_features(text: str | None) -> set[str]:
    """All features of a text."""
    words = (text or "").split()
    out: set[str] = set()
    shapes: Counter = Counter()
    for word, n in Counter(words).items():
        features, shape = word_features(word)
        out.update(features)
        for s in shape:
            shapes[s] += n
    return out.union(shape_features(len(words), len(set(words)), shapes))


@dataclass
class Model:
    """Weights by feature and a bias for each trait; ``prior`` is the trait's share in the sample."""

    weights: dict[str, tuple[float, float]]
    bias: tuple[float, float]
    prior: tuple[float, float]

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Log likelihood ratios, a row per text and a column per trait."""
        lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+")
        offsets = lists.offsets.to_numpy()
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        flat = lists.flatten().dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int64)
        words = flat.dictionary.to_pylist()
        names: dict[str, int] = {}
        of_word, features, shaped = [], [], {s: np.zeros(len(words), bool) for s in "sun"}
        real = np.ones(len(words), bool)
        known = self.weights
        for i, word in enumerate(words):
            if not word:
                real[i] = False
                continue
            found, shape = word_features(word)
            for f in found:
                if f in known:
                    of_word.append(i)
                    features.append(names.setdefault(f, len(names)))
            for s in shape:
                shaped[s][i] = True
        keep = real[code] if len(code) else np.zeros(0, bool)
        row, code = row[keep], code[keep]
        n = np.bincount(row, minlength=len(lists))
        pairs = np.unique(row * max(1, len(words)) + code)
        row_of, code_of = pairs // max(1, len(words)), pairs % max(1, len(words))
        distinct = np.bincount(row_of, minlength=len(lists))
        # words by feature: each text counts a feature once
        first = np.searchsorted(np.array(of_word, np.int64), np.arange(len(words) + 1))
        count = np.diff(first)[code_of] if len(code_of) else code_of
        index = np.repeat(first[code_of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = np.unique(np.repeat(row_of, count) * max(1, len(names)) + np.array(features, np.int64)[index])
        table = np.array([known[f] for f in names]).reshape(-1, 2)
        out = np.tile(np.array(self.bias) - np.array([_logit(p) for p in self.prior]), (len(lists), 1))
        for t in range(2):
            out[:, t] += np.bincount(hit // max(1, len(names)), table[hit % max(1, len(names)), t] if len(hit) else None, len(lists))
        share = {s: np.bincount(row, shaped[s][code] if len(code) else None, len(lists)) for s in "sun"}
        for i in range(len(lists)):
            for f in shape_features(int(n[i]), int(distinct[i]), {s: share[s][i] for s in "sun"}):
                out[i] += known.get(f, (0.0, 0.0))
        return out


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _solved(row: np.ndarray, col: np.ndarray, n: int, width: int, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic model of ``y`` on sparse features (row, col), by Adam."""
    w, b, m_w, v_w = np.zeros(width), _logit(float(y.mean())), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, w[col], n)
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(col, g[row], width) + 0.5 * w, g.sum())
        m_w, v_w = 0.9 * m_w + 0.1 * grad, 0.999 * v_w + 0.001 * grad**2
        move = 0.1 * (m_w / (1 - 0.9**step)) / (np.sqrt(v_w / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _gain(have: Column, both: Column, n: int, p: float) -> Column:
    """How much a feature of ``have`` documents, ``both`` of them of the trait, tells about the trait of share ``p``."""

    def part(k: Column, m: Column) -> Column:
        q = F.greatest(F.least(k / F.greatest(m, F.lit(1)), F.lit(1 - 1e-12)), F.lit(1e-12))
        return k * F.log(q / p) + (m - k) * F.log((1 - q) / (1 - p))

    return part(both, have) + part(F.lit(round(n * p)) - both, F.lit(n) - have)


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, least: int = LEAST) -> Model:
    """A logistic model of each trait on the features that tell most about it, fitted on at most ``sample`` labelled documents: those whose ids hash lowest.

    Texts stay on the executors: features are counted there, and the driver gets ``features``
    names a trait and the sample's pairs of a document and such a feature.
    """
    told = labels.select(F.col(id_col).alias("id"), (1 - F.col(quality_col)).cast("int").alias("poor"), F.col(toxic_col).cast("int").alias("toxic")).dropna()
    chosen = told.distinct().orderBy(F.xxhash64("id"), "id", "poor", "toxic").limit(sample)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    named = written(read.select("id", "hash").join(F.broadcast(chosen), "id").distinct().orderBy(F.xxhash64("id"), "id", "hash", "poor", "toxic").limit(sample), "quality-sample")
    rows = named.orderBy(F.xxhash64("id"), "id", "hash", "poor", "toxic").select(F.struct("id", "hash").alias("key"), "poor", "toxic").collect()
    n, traits = len(rows), np.array([[r.poor, r.toxic] for r in rows], int).reshape(-1, len(TRAITS))
    prior = tuple(min(max(float(p), 1e-4), 1 - 1e-4) for p in traits.mean(0)) if n else (1e-4,) * len(TRAITS)
    bias, weights = [_logit(p) for p in prior], {}
    if not n:
        return Model(weights, tuple(bias), prior)
    schema = T.StructType([named.schema["id"], T.StructField("hash", T.LongType()), T.StructField("features", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                found = [sorted(text_features(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), pa.array(found, pa.list_(pa.string()))], schema.names)

    wanted = F.broadcast(named.select("id", "hash").distinct())
    featured = read.join(wanted, ["id", "hash"], "left_semi").select("id", "text", "hash").mapInArrow(run, schema)
    each = written(featured.groupBy("id", "hash").agg(F.first("features").alias("features")).join(F.broadcast(named), ["id", "hash"]), "quality-features")
    have = [F.count("*").alias("have"), *[F.sum(t).alias(t) for t in TRAITS]]
    counts = written(each.select(F.explode("features").alias("feature"), *TRAITS).groupBy("feature").agg(*have).where(F.col("have") >= least), "quality-counts")
    best: dict[str, list[str]] = {}
    for t, trait in enumerate(TRAITS):
        if 0 < traits[:, t].sum() < n:
            gained = counts.select("feature", _gain(F.col("have"), F.col(trait), n, float(traits[:, t].mean())).alias("gain")).where("gain > 4")
            best[trait] = [r.feature for r in gained.orderBy(F.desc("gain"), "feature").limit(features).select("feature").collect()]
    names = sorted({f for found in best.values() for f in found})
    if not names:
        return Model(weights, tuple(bias), prior)
    index = docs.sparkSession.createDataFrame(list(enumerate(names)), "col int, feature string")
    pairs = each.select("id", "hash", "poor", "toxic", F.explode("features").alias("feature")).join(F.broadcast(index), "feature")
    held = pairs.select(F.struct("id", "hash").alias("key"), "poor", "toxic", "col").groupBy("key", "poor", "toxic").agg(F.sort_array(F.collect_list("col")).alias("cols")).collect()
    cols = {(r.key, r.poor, r.toxic): r.cols for r in held}
    of = [cols.get((r.key, r.poor, r.toxic), []) for r in rows]
    row, col = np.repeat(np.arange(n), [len(c) for c in of]), np.concatenate([*(np.array(c, np.int64) for c in of), np.empty(0, np.int64)])
    for t, trait in enumerate(TRAITS):
        if trait in best:
            own = np.full(len(names), -1)
            own[np.searchsorted(names, sorted(best[trait]))] = np.arange(len(best[trait]))
            mine = own[col] >= 0
            w, bias[t] = _solved(row[mine], own[col[mine]], n, len(best[trait]), traits[:, t].astype(float))
            for f, x in zip(sorted(best[trait]), w.tolist(), strict=True):
                both = list(weights.get(f, (0.0,) * len(TRAITS)))
                both[t] = x
                weights[f] = tuple(both)
    return Model(weights, tuple(bias), prior)


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def _strength(n: Column, rate: Column, mean: Column) -> Column:
    """Documents that the level above counts for: mean * (1 - mean) / spread of the true rates - 1."""
    noise = F.sum(mean * (1 - mean)) / F.sum(n)
    spread = F.greatest(F.sum(n * (rate - mean) * (rate - mean)) / F.sum(n) - noise, F.lit(1e-12))
    return F.least(F.greatest(F.avg(mean * (1 - mean)) / spread - 1, F.lit(WEAKEST)), F.lit(STRONGEST))


def posteriors(scored: DataFrame, prior: tuple[float, float], host: Column, path: Column) -> DataFrame:
    """``scored`` (with evidence_poor and evidence_toxic) with p_poor and p_toxic."""
    plain = [f"`{c}`" for c in scored.columns if c not in ADDED[2:]]
    sited = scored.select(F.struct(*plain).alias("row"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), *[F.col(f"evidence_{t}") for t in TRAITS])
    own = {t: 1 / (1 + F.exp(-F.greatest(F.least(F.col(f"evidence_{t}") + _logit(p), F.lit(30.0)), F.lit(-30.0)))) for t, p in zip(TRAITS, prior, strict=True)}
    rows = sited.withColumns({f"own_{t}": x for t, x in own.items()})
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"own_{t}").alias(f"s_{t}") for t in TRAITS])
    paths = written(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in TRAITS])
    top = hosts.agg(F.sum("n_host").alias("n"), *[F.sum(f"h_{t}").alias(t) for t in TRAITS]).first()
    mean = {t: F.lit(min(max((top[t] or 0.0) / max(1, top.n or 0), 1e-4), 1 - 1e-4)) for t in TRAITS}
    of_hosts = hosts.agg(*[_strength(F.col("n_host"), F.col(f"h_{t}") / F.col("n_host"), mean[t]).alias(t) for t in TRAITS]).first()
    inside = paths.join(hosts, "host")
    host_rate = {t: F.greatest(F.least(F.col(f"h_{t}") / F.col("n_host"), F.lit(1 - 1e-4)), F.lit(1e-4)) for t in TRAITS}
    of_paths = inside.agg(*[_strength(F.col("n"), F.col(f"s_{t}") / F.col("n"), host_rate[t]).alias(t) for t in TRAITS]).first()
    sites = written(inside, "quality-sites")
    joined = rows.join(sites, ["host", "path"])
    out = {}
    for t in TRAITS:
        own, strong, strong_host = F.col(f"own_{t}"), F.lit(of_paths[t] or WEAKEST), F.lit(of_hosts[t] or WEAKEST)
        at_host = (F.col(f"h_{t}") - own + strong_host * mean[t]) / (F.col("n_host") - 1 + strong_host)
        at_path = (F.col(f"s_{t}") - own + strong * at_host) / (F.col("n") - 1 + strong)
        site = F.greatest(F.least(at_path, F.lit(1 - 1e-6)), F.lit(1e-6))
        z = F.greatest(F.least(F.col(f"evidence_{t}") + F.log(_odds(site)), F.lit(30.0)), F.lit(-30.0))
        out[f"p_{t}"] = 1 / (1 + F.exp(-z))
    return joined.select("row.*", *[x.alias(name) for name, x in out.items()])


def rated(docs: DataFrame, model: Model, host: Column, path: Column, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with evidence_poor, evidence_toxic, p_poor and p_toxic; without the text if not ``keep_text``."""
    carried = [f for f in docs.schema.fields if f.name not in ADDED and (keep_text or f.name != text_col)]
    schema = T.StructType([*carried, *[T.StructField(name, T.DoubleType()) for name in ADDED[:2]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                evidence = model.evidence(part.column(text_col).cast(pa.string()))
                kept = [part.column(f.name) for f in carried]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(evidence[:, 0]), pa.array(evidence[:, 1])], schema.names)

    read = docs.select(*[f"`{c}`" for c in docs.columns if c not in ADDED])
    scored = written(read.mapInArrow(run, schema), "quality-scored")
    return posteriors(scored, model.prior, host, path)


def accepted(rated_docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows whose posteriors both stay below ``reject``."""
    return rated_docs.where((F.col("p_poor") < reject) & (F.col("p_toxic") < reject))
