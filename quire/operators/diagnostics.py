"""Diagnostics as rows: their order, severity, repeats, and what they let through."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Codes that do not stop a conversion, and codes reported once whatever they are about.
NOT_BLOCKING = ("comments_not_inspected", "headers_footers_not_inspected", "list_paragraph_without_numbering", "missing_numbering_level_assumed_zero")
ONCE = ("empty_metadata_suggestion", "multiple_docx_titles", "multiple_docx_subtitles", "metadata_style_not_initial")
KEY = ("origin", "code", "severity", "message", "index", "note_id", "part", "path")


def blocking(inspection: DataFrame) -> DataFrame:
    """Inspection issues as diagnostics: errors unless their code is one of the four that are not."""
    return inspection.withColumn("severity", F.when(F.col("code").isin(*NOT_BLOCKING), "warning").otherwise("error"))


def distinct_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """The first of each key by `sequence`; codes of ONCE have only origin and code as their key."""
    once = F.col("code").isin(*ONCE)
    key = [c if c in ("origin", "code") else F.when(~once, F.col(c)) for c in KEY if c in diagnostics.columns]
    rank = F.row_number().over(Window.partitionBy("pkg_id", *key).orderBy("sequence"))
    return diagnostics.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def converted(packages: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """packages that no error diagnostic stops."""
    return packages.join(diagnostics.where("severity = 'error'"), "pkg_id", "left_anti")
