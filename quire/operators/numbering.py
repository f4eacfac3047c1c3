"""Numbering of paragraphs: instance, definition, level and override, with the first hop that fails."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.identifiers import strict_number
from quire.staging import written

# Number formats of ordered lists, and what holds where a level says nothing.
ORDERED = ("decimal", "decimalZero", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "ordinal", "cardinalText", "ordinalText")
DEFAULT_FORMAT, DEFAULT_START = "decimal", 0


def list_kind(number_format: Column, picture: Column) -> Column:
    return F.when(picture.isNotNull(), "unsupported").when(number_format == "bullet", "bulleted").when(number_format == "none", "none").when(number_format.isin(*ORDERED), "ordered").otherwise("unsupported")


def numbering_parts(*tables: DataFrame) -> DataFrame:
    """pkg_id, high, low: 128 bits of all rows a package has in the tables, in any order; equal where these are equal."""
    found = []
    for i, table in enumerate(tables):
        columns = [c for c in table.columns if c != "pkg_id"]
        values = [*columns, *(F.col(c).isNull() for c in columns)]
        found.append(table.select("pkg_id", F.xxhash64(F.lit(i), *values).alias("a"), F.xxhash64(F.lit(-1 - i), *values).alias("b")))
    rows = functools.reduce(DataFrame.unionByName, found)
    sums = [F.sum(x) for c in ("a", "b") for x in (F.col(c).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(c, 32))]
    return rows.groupBy("pkg_id").agg(F.xxhash64(*sums).alias("high"), F.xxhash64(F.lit(1), *sums).alias("low"))


def resolved_numbering(paragraphs: DataFrame, instances: DataFrame, levels: DataFrame, overrides: DataFrame, once: bool = False) -> DataFrame:
    """Adds status, code (of the first hop that fails), level, number_format, start, kind.

    paragraphs: pkg_id, index, raw_id, raw_level; instances: pkg_id, num_id, abstract_id; levels: pkg_id,
    abstract_id, level, number_format, start, picture; overrides: pkg_id, num_id, level, start_override. Ids
    of the three tables are canonical numbers. The tables are small next to the paragraphs and of bounded
    size for each package, so the joins are left to the optimizer. Where levels have restart and legal, both are added,
    and overrides have these and number_format, start and picture: what an override's own level says goes before the
    definition's, field by field, and its start_override before both.

    `once`: packages with equal rows in all three tables, as copies of a template have them, share them (`numbering_parts`).
    Each paragraph then meets its package once, and its numbering among the different ones, which are written to the
    shared folder when this is called. The tables are read twice; where no two packages agree that is all it does.
    """
    key = ["pkg_id"]
    number, wanted = strict_number(F.col("raw_id")), strict_number(F.col("raw_level"))
    parsed = paragraphs.withColumns({"_id": number, "_level": wanted}).withColumns({"num_id": F.col("_id.canonical"), "_ok": F.col("_level.valid") & F.col("_level.canonical").between(0, 8)})
    if once:
        key = ["high", "low"]
        parts = written(numbering_parts(instances, levels, overrides), "numbering-parts")
        first = written(parts.groupBy(*key).agg(F.min("pkg_id").alias("pkg_id")), "numbering-first")
        instances, levels, overrides = (written(t.join(first, "pkg_id").drop("pkg_id"), "numbering-once") for t in (instances, levels, overrides))
        parsed = parsed.join(parts.hint("merge"), "pkg_id", "left")  # a small file can hold many packages
    hop1 = parsed.join(instances, [*key, "num_id"], "left")
    defined = levels.groupBy(*key, "abstract_id").agg(F.max((F.col("level") == 0).cast("int")).alias("_has_zero"))
    hop2 = hop1.join(defined, [*key, "abstract_id"], "left").withColumn("level", F.when(F.col("_ok"), F.col("_level.canonical")).when(F.col("_has_zero") == 1, 0).cast("int"))
    more = ["restart", "legal"] if "restart" in levels.columns else []
    over = {c: F.col(f"_{c}") for c in ("number_format", "start", "picture", *more)} if more else {}
    own = overrides.withColumnsRenamed({c: f"_{c}" for c in over})
    hop3 = hop2.join(levels, [*key, "abstract_id", "level"], "left").join(own, [*key, "num_id", "level"], "left").withColumns({c: F.coalesce(x, c) for c, x in over.items()})
    shaped = hop3.withColumn("_shape", F.coalesce(F.nullif("number_format", F.lit("")), F.lit(DEFAULT_FORMAT))).withColumn("_kind", list_kind(F.col("_shape"), F.col("picture")))
    code = (
        F.when(~F.col("_id.valid"), "invalid_numbering_identifier")
        .when(F.col("num_id") == 0, F.lit(None))
        .when(F.col("_level.present") & ~F.col("_ok"), "invalid_numbering_level")
        .when(F.col("abstract_id").isNull(), "missing_numbering_instance")
        .when(F.col("_has_zero").isNull(), "missing_abstract_numbering_definition")
        .when(F.col("number_format").isNull(), "missing_numbering_level_definition")
        .when(F.col("picture").isNotNull(), "picture_bullet_not_supported")
        .when(F.col("_kind") == "unsupported", "unsupported_numbering_format")
    )
    # A generated column: filters of what uses it stay behind it, and the code is found once a row. Put into every place that
    # names the status, it made one method of generated code beyond the 8,000 bytes up to which the JVM compiles.
    coded = shaped.select("*", F.explode_outer(F.array(code)).alias("code"))
    status = F.when(F.col("code").isin("picture_bullet_not_supported", "unsupported_numbering_format"), "unsupported").when(F.col("code").isNotNull(), "unresolved").when(F.col("num_id") == 0, "removed").otherwise("resolved")
    done = F.col("status").isin("resolved", "unsupported")
    return coded.withColumn("status", status).select(
        "pkg_id", "index", "status", "code",
        F.when(F.col("status") == "removed", F.lit(None)).otherwise(F.col("level")).cast("int").alias("level"),
        F.when(done, F.col("_shape")).alias("number_format"), F.when(done, F.coalesce("start_override", "start", F.lit(DEFAULT_START))).cast("int").alias("start"), F.when(done, F.col("_kind")).alias("kind"), *more,
    )


def inherited_numbering(styles: DataFrame, most: int = 512) -> DataFrame:
    """For each style (pkg_id, style_id, based_on, raw_id) the first one up its chain that sets a number, by rounds.

    outcome: set (with raw_id and depth), cycle, or none.
    """
    state = styles.select("pkg_id", "style_id", F.when(F.col("raw_id").isNull(), F.col("based_on")).alias("at"), "raw_id", F.array("style_id").alias("seen"), F.lit(False).alias("cycle"))
    parents = styles.select("pkg_id", F.col("style_id").alias("at"), F.col("based_on").alias("_up"), F.col("raw_id").alias("_raw"))
    for _ in range(most):
        joined = state.join(parents, ["pkg_id", "at"], "left")
        loop = F.coalesce(F.array_contains("seen", F.col("at")), F.lit(False))
        step = joined.select(
            "pkg_id", "style_id",
            F.when(~loop & F.col("_raw").isNull(), F.col("_up")).alias("at"), F.coalesce("raw_id", F.when(~loop, F.col("_raw"))).alias("raw_id"),
            F.when(F.col("at").isNotNull() & ~loop, F.array_append("seen", F.col("at"))).otherwise(F.col("seen")).alias("seen"), (F.col("cycle") | loop).alias("cycle"),
        )
        state = written(step, "style-chains")
        if state.where("at is not null").isEmpty():
            break
    else:
        raise RuntimeError(f"style chains did not settle in {most} rounds")
    outcome = F.when(F.col("cycle"), "cycle").when(F.col("raw_id").isNotNull(), "set").otherwise("none")
    return state.select("pkg_id", "style_id", outcome.alias("outcome"), "raw_id", (F.size("seen") - 1).alias("depth"))


def active(status: Column, raw_id: Column) -> Column:
    """Whether a paragraph is numbered: a resolution that was not removed, else a raw id other than 0."""
    return F.when(status.isNotNull(), status != "removed").otherwise(F.coalesce(raw_id != "0", F.lit(False)))


def refusal(role: Column, status: Column, kind: Column, origin: Column, legal: Column, restart: Column) -> Column:
    """Why a numbered paragraph is no list item, by the first reason that holds; null where it is one or its number was removed."""
    fine = (status == "resolved") & kind.isin("ordered", "bulleted")
    return (
        F.when(status.isNull() | (status == "removed"), None)
        .when(role != "paragraph", "numbered_nonparagraph_style_not_serializable")
        .when(restart.isNotNull(), "explicit_list_restart_not_serializable")
        .when(origin == "style", "style_based_numbering_not_serializable")
        .when(F.coalesce(legal, F.lit(False)), "legal_numbering_not_serializable")
        .when(kind == "none", "numbering_without_marker_not_serializable")
        .when(~F.coalesce(fine, F.lit(False)), "unsupported_numbering_not_serializable")
    )


def refused_numbering(resolved: DataFrame) -> DataFrame:
    """Numbered paragraphs that cannot be written as list items."""
    fine = (F.col("status") == "resolved") & F.col("kind").isin("ordered", "bulleted") & F.col("level").isNotNull()
    return resolved.where((F.col("status") != "removed") & ~F.coalesce(fine, F.lit(False))).select("pkg_id", "index", F.lit("numbered_paragraph_not_serializable").alias("code"), "status")
