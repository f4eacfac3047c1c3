"""From raw documents to packed sequences: each stage works on all that the stage before it kept.

Every stage takes the columns of documents, any of them null, and leaves others out. Rows that repeat an id
are rows of their own, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import text_or_empty, written
from quire.llm.exact_dedup import exact_dedup
from quire.llm.near_dedup import MARKS, near_dedup, text_bits
from quire.llm.packing import pack
from quire.llm.quality import fit_quality, quality
from quire.llm.unit_dedup import unit_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]

#: Words of a shingle, and the similarity of shingle sets from which documents count as near duplicates.
NEAR_WORDS, NEAR_LEAST = 5, 0.8


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; a null text is judged as an empty one, and without labels of both kinds all have one score."""
    forest = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality(docs, forest, threshold=0.3, carry=REST).where("predicted = 1").select(*COLUMNS)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for blanks, null and empty ones being one group: the longest, then that of the least id, nulls last; of rows alike in all that exactly one."""
    return exact_dedup(docs, carry=REST).where("kept").select(*COLUMNS)


def distant(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: their five-word shingles alike to NEAR_LEAST, pair by pair.

    The least id stays, nulls last, then the least bits of the text. Texts without words are alike. Rows with
    one id, or none, are told apart by their texts; those alike in both stay or go together.
    """
    kept = near_dedup(docs, words=NEAR_WORDS, least=NEAR_LEAST).where("kept").select(*(F.col(m).alias(f"_{m}") for m in MARKS)).distinct()
    marked = docs.select(*COLUMNS, *text_bits(text_or_empty()))
    same = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARKS]
    return marked.join(kept.hint("shuffle_hash"), same, "left_semi").select(*COLUMNS)


def trimmed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and passages that an earlier document has, null becoming empty; documents of which nothing is left go, but not those that had no text."""
    found = unit_dedup(docs, kind="line", least_words=1, carry=("lang", "source"), whole=True)
    left = found.where((F.size("spans") == 0) | (F.trim("kept") != ""))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 2048 tokens; an empty or null text is its end mark alone."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", good), ("exact", unlike), ("near", distant), ("substring", trimmed), ("packing", packed)]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of `sf_dir`; every stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
