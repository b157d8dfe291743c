"""Queries of the operators in this folder, as registered with the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import chat, quality, sharding
from tessera.llm.common import written
from tessera.llm.decontaminate import contaminated
from tessera.llm.mixing import mixed_sample
from tessera.llm.neardup import near_duplicates
from tessera.llm.pii import pseudonymised
from tessera.llm.substrings import without_repeats
from tessera.llm.token_counts import token_counts
from tessera.llm.topk import top_k
from tessera.sources.shared import fresh_path
from tessera.sources.tables import load

#: The tokenizer of op10.
TOKENIZER = "byte_bpe_50k.json"


def op1_topk(spark, sf_dir):
    """The 20 best rows for every row whose vec_id is divisible by 20."""
    return top_k(load(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_near_duplicates(spark, sf_dir):
    """The class of every document; a class keeps the document of its id."""
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_kept"))


def op3_quality(spark, sf_dir):
    """The documents that the quality classifier keeps, with their evidence and posteriors; host: source, path: language within it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = quality.trained(docs, load(spark, sf_dir, "labels"))
    return quality.accepted(quality.rated(docs, model, F.col("source"), F.col("lang"), keep_text=False))


def op4_mixing(spark, sf_dir):
    """The documents sampled to raked source, language and topic marginals, with their probabilities."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed_sample(docs).drop("text")


def op5_decontamination(spark, sf_dir):
    """Every document with every benchmark item that it holds a passage of."""
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


#: Shards of op6.
SHARDS = 16


def op6_sharding(spark, sf_dir):
    """Every document in one of SHARDS shards of nearly equal bytes, by a stored map of virtual slots."""
    docs = load(spark, sf_dir, "documents")
    text = F.col("text")
    records = docs.select("doc_id", sharding.record_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string").alias("content"))
    slot = sharding.virtual_slot(F.col("doc_id"), F.col("content"), copy=F.col("copy"))
    narrow = written(sharding.spread(records).select("doc_id", "size", "text_crc32", slot.alias("virtual_slot")), "op6")
    slot_map = sharding.kept_map(sharding.slot_bytes(narrow), SHARDS, fresh_path(spark, "op6-map"))
    owned = narrow.join(F.broadcast(slot_map.drop("version")), "virtual_slot")
    law = F.lit("bytes").alias("law")
    return sharding.placed(owned, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_substrings(spark, sf_dir):
    """What is left of every document without the 200-byte strings that occur more than once."""
    cut = without_repeats(load(spark, sf_dir, "documents"), length=200, keep="none")
    n_bytes, n_kept = F.octet_length("data").cast("long"), F.octet_length("kept").cast("long")
    return cut.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - n_kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: What both turns of the query's own conversation -1 say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op8_chat(spark, sf_dir):
    """Every conversation, and conversation -1 of CONTROL, formatted and read back."""
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    chats = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.formatted(chats)).withColumnRenamed("conv", "conv_id")


#: The key of op9's surrogates where the session has none in tessera.surrogate.key; a deployment sets its own.
SURROGATE_KEY = "tessera"


def op9_pii(spark, sf_dir):
    """Every document with personal data and secrets replaced by surrogates."""
    return pseudonymised(load(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get("tessera.surrogate.key", SURROGATE_KEY))


def op10_token_counts(spark, sf_dir):
    """Tokens of every document by the library of TOKENIZER."""
    import public_tokenizers

    counted = token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {f.__name__: f for f in (op1_topk, op2_near_duplicates, op3_quality, op4_mixing, op5_decontamination, op6_sharding, op7_substrings, op8_chat, op9_pii, op10_token_counts)}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 20""",
    "op8_chat": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
        e AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
                replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS role_in, replace(replace(text, '\', '\\'), '<|', '<\|') AS text_in
            FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(role_in) + length(text_in) + length('<|im_start|><|im_end|>') + 2)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
