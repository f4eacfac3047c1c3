"""Runs of a paragraph as text and as spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks in their canonical order.
MARKS = ("bold", "italic", "small_caps", "caps", "superscript", "subscript")


def plain_text(items: DataFrame) -> DataFrame:
    """items (pkg_id, index, item, kind, text, break_type, reference_id) -> a readable text for each paragraph."""
    shown = (
        F.when(F.col("kind") == "text", F.coalesce("text", F.lit("")))
        .when(F.col("kind") == "tab", "\t")
        .when((F.col("kind") == "break") & (F.col("break_type") == "line"), "\n")
        .when(F.col("kind") == "footnote_reference", F.concat(F.lit("[footnote:"), "reference_id", F.lit("]")))
        .when(F.col("kind") == "endnote_reference", F.concat(F.lit("[endnote:"), "reference_id", F.lit("]")))
        .when(F.col("kind") == "drawing", "[drawing]")
        .otherwise("")
    )
    ordered = F.array_sort(F.collect_list(F.struct("item", shown.alias("shown"))))
    return items.groupBy("pkg_id", "index").agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), "").alias("text"))


def spans(items: DataFrame) -> DataFrame:
    """Text items with marks, link, language and, if there is such a column, bibl -> spans: neighbours that agree in all of them are one; empty text goes."""
    order = Window.partitionBy("pkg_id", "index").orderBy("item")
    more = [c for c in ("bibl",) if c in items.columns]
    look = F.struct("kind", "marks", "link", "language", *more)
    fresh = ~((F.col("kind") == "text") & look.eqNullSafe(F.lag(look).over(order)))
    shown = items.where((F.col("kind") != "text") | (F.coalesce("text", F.lit("")) != "")).withColumn("span", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("item", F.coalesce("text", F.lit("")).alias("text"))))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "")
    return shown.groupBy("pkg_id", "index", "span").agg(F.first("kind").alias("kind"), F.first("marks").alias("marks"), F.first("link").alias("link"), F.first("language").alias("language"), *(F.first(c).alias(c) for c in more), text.alias("text"))


def marks(style_marks: Column, direct: dict[str, Column]) -> Column:
    """The style's marks, those set directly added and those unset directly removed, in canonical order."""
    kept = [F.when(F.coalesce(direct.get(name, F.lit(None).cast("boolean")), F.array_contains(F.coalesce(style_marks, F.array().cast("array<string>")), name)), F.lit(name)) for name in MARKS]
    return F.array_compact(F.array(*kept))
