"""One query per operator over the tables of a folder, with equivalent SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import byte_bpe, chat, hard_negatives, neighbours, outliers, packing, prefix_trie, quality, simhash, suffix_dedup, token_counts, token_files, toxicity
from cohortloom.llm.common import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_cover_suffixes")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), length=50)
    removed = F.aggregate("repeats.spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return docs.select(
        "doc_id", "repeats.n_bytes", removed.alias("n_removed"), F.size("repeats.spans").cast("long").alias("n_spans"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


@query("op2_gray_simhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), size=3)


@query("op3_robust_outliers")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.document_verdicts(table(spark, folder, "documents"))


@query("op4_projection_forest")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0), k=20)


@query("op5_binary_pieces")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, folder, "documents"), path, longest=2048, end_id=1, with_ids=False)


OP6_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS body,
         replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS shown
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(shown) + length(body) + 23) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op6_chat_parts", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = rows.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    formatted = chat.format_conversations(turns)
    back = formatted.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op7_byte_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query("op8_attention_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, folder, "labels")), threshold=0.7)


@query("op9_plane_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    files = f"{scratch_folder(spark)}/token-files-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), files, end_id=0)
    return token_files.read_token_files(spark, files)


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024
    )


@query("op11_band_trie")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM pairs WHERE same) WHERE place <= 5
), negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS place
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE place <= 10
"""


@query("op12_sibling_range_negatives", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").filter(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return hard_negatives.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("vec")), F.col("vec_id") % 100 == 0)


@query("op13_chain_toxicity")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, folder, "labels")), threshold=0.3)
