"""Exact dedup with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import HEAVY, carried, heavy_hitters, lookup, split_heavy, text_or_empty, written

BLANKS = r"[\x20\x09-\x0D]+"
RESULT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_chars of the original text, and the SHA-256 of the text without blanks; `_row` tells repeated rows apart."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row"),
        *([F.struct(*carried(carry, RESULT)).alias("_carried")] if carry else []),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = HEAVY, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and the columns `carry`.

    Texts are equal when they agree after blanks (space, tab to carriage return) are deleted; a null text
    counts as empty. Of equal texts the one with the most code points stays, then the smallest doc_id (null
    ids last), and of repeated rows with that id exactly one. An empty table gives no rows. Other columns of
    `docs` are left out, whatever their names; a carried one that has a result column's name is an error.

    Misra-Gries names the digests that may fill a task; their winners are found by partial aggregation over
    all their rows (the exact count and winner, not the counters' estimate) and broadcast, at most `counters`
    of them, so hot groups are decided on the map side. All other digests take the ordinary shuffle.
    """
    signed = written(signatures(docs, id_col, text_col, carry), "exact-signatures")
    heavy = written(heavy_hitters(signed, "text_sha256", counters), "exact-heavy")
    rank = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "_row")
    winners = [part.groupBy("text_sha256").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")) for part in split_heavy(signed, heavy, "text_sha256")]
    found = lookup(signed, winners[0].unionByName(winners[1]), heavy, "text_sha256")
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best._row") == F.col("_row")).alias("kept"), "text_sha256", *(F.col(f"_carried.{c}") for c in carry))
