"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.byte_pairs import encode_bytes
from quire.llm.centroids import cluster
from quire.llm.exact_dedup import exact_dedup
from quire.llm import oracles
from quire.llm.language import fit_language, language
from quire.llm.lattice import lattice_dedup
from quire.llm.packing import pack
from quire.llm.pieces import encode_pieces
from quire.llm.quality import fit_quality, quality
from quire.llm.sharding import shard
from quire.llm.simhash import simhash_dedup
from quire.llm.suffix_dedup import suffix_dedup
from quire.llm.turns import repair
from quire.llm.unit_dedup import unit_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unit_dedup(table(spark, sf_dir, "documents"), kind="line", least_words=1, whole=True)
    return found.select("doc_id", "n_units", "n_repeated", F.size("spans").alias("n_spans"), "spans", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language(docs, fit_language(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    found = encode_pieces(docs, path, carry=("text_sha256",), decode=True)
    again = F.sha2(F.col("decoded").cast("binary"), 256)
    return found.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), again.alias("decoded_sha256"), (again == F.col("text_sha256")).alias("round_trip"), "parity")


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup(table(spark, sf_dir, "embeddings"), least=0.93)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), words=3, distance=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), window=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, size=64, scale=256, salt="2")


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    found = encode_bytes(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), PATTERN, decode=True)
    ids = F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").cast("binary"), 256)
    return found.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language": op2_language,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_lattice": op4_lattice,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_centroids": op11_centroids,
    "op12_turns": op12_turns,
    "op13_byte_pairs": op13_byte_pairs,
}

ORACLES = {
    "op8_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(t) AS text_sha256
        FROM norm WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
    """,
    "op11_centroids": oracles.clustering(clusters=40, rounds=5, size=64, scale=256, salt="2"),
    "op12_turns": oracles.conversation_repair(),
}
