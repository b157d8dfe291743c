"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what it
keeps, with the columns of documents (the last one adds the shard). Outputs are written as
Parquet and read again as the next stage's documents. Columns beside doc_id, text, lang and source
may have any names and are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, neardup, quality, sharding
from tessera.llm.common import packed
from tessera.sources.shared import fresh_path, scratch
from tessera.sources.tables import load

#: Shards of the last stage.
SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds neither poor nor toxic."""
    pack = packed(docs, doc_id="doc_id", text="text", lang="lang", source="source")
    model = quality.trained(pack.frame, load(spark, sf_dir, "labels"))
    return pack.restored(quality.accepted(quality.rated(pack.frame, model, F.col("source"), F.col("lang"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked shares of sources, languages and topics."""
    pack = packed(docs, doc_id="doc_id", text="text", lang="lang", source="source")
    return pack.restored(mixing.mixed_sample(pack.frame))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its virtual slot and shard, by nearly equal bytes and a stored map."""
    slot = sharding.virtual_slot(F.col("doc_id"), F.col("text")).alias("virtual_slot")
    slots = sharding.slot_bytes(docs.select(slot, sharding.record_bytes(F.col("text")).alias("size")))
    return sharding.sharded(docs, sharding.kept_map(slots, SHARDS, fresh_path(spark, "pipeline-map")))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: SQL expresses neither signatures nor banded alignment; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what its predecessor wrote; a stage's own intermediates go when its output is there."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{i}")
        with scratch():
            kept = stage(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(path)
            schema = kept.schema
        docs = spark.read.schema(schema).parquet(path)
    return docs
