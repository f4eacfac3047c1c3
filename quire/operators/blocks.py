"""Neighbouring paragraphs read as blocks, by windows over document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quire.operators.roles import BIBLIOGRAPHY

def in_order() -> WindowSpec:
    return Window.partitionBy("pkg_id").orderBy("index")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def behind() -> WindowSpec:
    return in_order().rowsBetween(1, Window.unboundedFollowing)


def blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == ""


def islands(rows: DataFrame, kind: str) -> DataFrame:
    """Adds island: one number for each run of neighbouring rows with one value of `kind`."""
    fresh = (~F.col(kind).eqNullSafe(F.lag(kind).over(in_order()))).cast("int")
    return rows.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(so_far())).drop("_new")


def runs(roled: DataFrame, role: str) -> DataFrame:
    """One row for each run of paragraphs of one role: pkg_id, start, n_paragraphs, n_chars."""
    found = islands(roled, "role").where(F.col("role") == role)
    return found.groupBy("pkg_id", "island").agg(F.min("index").alias("start"), F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("text")).cast("long").alias("n_chars")).drop("island")


def epigraph_runs(roled: DataFrame) -> DataFrame:
    """Runs of epigraphs and whether each stands where it may: first, or right behind a heading, blank paragraphs aside."""
    shown = F.when((F.col("role") != "paragraph") | ~blank(F.col("text")), F.col("role"))
    found = islands(roled, "role").withColumn("before", F.last(shown, ignorenulls=True).over(before())).where("role = 'epigraph'")
    first = F.min_by("before", "index")
    return found.groupBy("pkg_id", "island").agg(F.min("index").alias("start"), F.count(F.lit(1)).alias("n_paragraphs"), (first.isNull() | (first == "heading")).alias("allowed")).drop("island")


def signature_runs(roled: DataFrame, most: int = 2) -> DataFrame:
    """Runs of signatures: lines that are not blank, and why a run is refused (too_long, not_terminal), or null.

    A run is terminal when nothing follows but blank paragraphs, or next comes a heading of level 1 or 2.
    """
    shown = F.when(~blank(F.col("text")), F.struct("role", "level"))
    following = roled.withColumn("ahead", F.first(shown, ignorenulls=True).over(behind()))
    found = islands(following, "role").where("role = 'signature'")
    ahead = F.max_by("ahead", "index")
    terminal = ahead.isNull() | ((ahead["role"] == "heading") & (ahead["level"] <= 2))
    grouped = found.groupBy("pkg_id", "island").agg(F.min("index").alias("start"), F.count_if(~blank(F.col("text"))).alias("n_lines"), terminal.alias("terminal"))
    refused = F.when(F.col("n_lines") > most, "too_long").when(~F.col("terminal"), "not_terminal")
    return grouped.select("pkg_id", "start", "n_lines", refused.alias("refused"))


def heading_jumps(roled: DataFrame) -> DataFrame:
    """Headings more than one level below the heading before them."""
    heads = roled.where("role = 'heading'").withColumn("previous", F.lag("level").over(in_order()))
    return heads.where("level > previous + 1").select("pkg_id", "index", "level", "previous")


def sourced_quotes(roled: DataFrame, source_style: str = "TEIbiblreference") -> DataFrame:
    """Quote runs with the index of the source paragraph right behind them, and whether a second one follows."""
    style = F.coalesce(F.col("style_id") == source_style, F.lit(False))
    marked = roled.withColumn("next", F.lead(style).over(in_order())).withColumn("second", F.lead(style, 2).over(in_order()))
    found = islands(marked, "role").where("role in ('prose_quote', 'verse_quote')")
    last = F.max_by(F.struct("index", "next", "second"), "index")
    grouped = found.groupBy("pkg_id", "island", "role").agg(F.min("index").alias("start"), last.alias("last"))
    has = F.coalesce(F.col("last.next"), F.lit(False))
    return grouped.select("pkg_id", "role", "start", F.when(has, F.col("last.index") + 1).alias("source_index"), (has & F.coalesce(F.col("last.second"), F.lit(False))).alias("has_second"))


def bibliography_cut(roled: DataFrame, start_style: str = "TEIbiblstart", native: tuple[str, ...] = BIBLIOGRAPHY) -> DataFrame:
    """Per package the index where the final bibliography begins, and how many paragraphs behind it are no entries.

    It begins at the first start style; without one at the first native entry, or at the heading before it
    with only blank paragraphs in between.
    """
    entry = F.col("style_id").isin(*native)
    shown = F.when(~blank(F.col("text")), F.struct(F.col("index").alias("at"), F.col("role")))
    near = roled.withColumn("near", F.last(shown, ignorenulls=True).over(before()))
    first = near.groupBy("pkg_id").agg(F.min(F.when(F.col("style_id") == start_style, F.col("index"))).alias("marked"), F.min(F.when(entry, F.struct("index", "near"))).alias("native"))
    heading = F.when(F.col("native.near.role") == "heading", F.col("native.near.at"))
    cuts = first.select("pkg_id", F.coalesce("marked", heading, F.col("native.index")).alias("cut"), F.coalesce("marked", F.col("native.index")).alias("opens")).where("cut is not null")
    later = roled.join(cuts, "pkg_id").where("index >= opens")
    intruder = ~F.coalesce(entry | (F.col("style_id") == start_style), F.lit(False)) & ~blank(F.col("text"))
    return later.groupBy("pkg_id", "cut").agg(F.count_if(F.coalesce(entry, F.lit(False))).alias("n_entries"), F.count_if(intruder).alias("n_intruders"))


def contributions(roled: DataFrame) -> DataFrame:
    """Packages with two or more level-2 headings, cut before each: segment 0 comes before the first and is reported, not dropped."""
    numbered = roled.withColumn("segment", F.sum(F.when((F.col("role") == "heading") & (F.col("level") == 2), 1).otherwise(0)).over(so_far()))
    whole = Window.partitionBy("pkg_id")
    many = numbered.withColumn("segments", F.max("segment").over(whole)).where("segments >= 2")
    return many.groupBy("pkg_id", "segment").agg(F.min("index").alias("start"), F.count(F.lit(1)).alias("n_paragraphs"))


def collective_problems(roled: DataFrame, first: str = "index") -> DataFrame:
    """pkg_id, index, code, severity: what cannot be written of documents with two or more headings of level 2.

    A part (level 1) cannot hold several texts: one error a document. Paragraphs before the first text that are
    not blank have no place: a warning at the first of them. Order is that of the column `first`. Documents without
    rows, and those whose level-2 headings are fewer, give none; of rows with one place any may be named.
    """
    head, at = F.coalesce(F.col("role") == "heading", F.lit(False)), F.col(first)
    two = head & (F.col("level") == 2)
    lost = F.min(F.when((F.coalesce(F.col("role"), F.lit("")) != "bibliography") & ~blank(F.col("text")), F.struct(at.alias("at"), F.col("index"))))
    found = roled.groupBy("pkg_id").agg(F.count_if(two).alias("n"), F.min(F.when(two, at)).alias("begins"), F.bool_or(head & (F.col("level") == 1)).alias("parted"), lost.alias("lost")).where("n >= 2")
    part = F.when(F.col("parted"), F.struct(F.lit(None).cast("int").alias("index"), F.lit("part_with_collective_work_not_serializable").alias("code"), F.lit("error").alias("severity")))
    text = F.when(~F.col("parted") & (F.col("lost.at") < F.col("begins")), F.struct(F.col("lost.index").cast("int").alias("index"), F.lit("text_before_contributions_not_serialized").alias("code"), F.lit("warning").alias("severity")))
    return found.select("pkg_id", F.explode(F.array_compact(F.array(part, text))).alias("x")).select("pkg_id", "x.*")


def signature_suggestions(roled: DataFrame, most: int = 2) -> DataFrame:
    """pkg_id, start, name, affiliation: what the lines of each terminal run of signatures say.

    Every line of a run counts, blank ones too; a run of more than `most` lines says nothing. It is terminal when nothing
    follows, or right behind it a heading style of level 1 or 2. A blank line says null.
    """
    marked = roled.withColumn("_signs", F.coalesce(F.col("style_id") == "Signature", F.lit(False)))
    marked = marked.withColumn("_ahead", F.lead(F.struct(F.coalesce("style_id", F.lit("")).alias("style"))).over(in_order()))
    lines = islands(marked, "_signs").where("_signs")
    ahead = F.max_by("_ahead", "index")
    said = F.transform(F.array_sort(F.collect_list(F.struct("index", F.nullif(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")), F.lit("")).alias("text")))), lambda x: x["text"])
    runs_found = lines.groupBy("pkg_id", "island").agg(F.min("index").alias("start"), ahead.alias("ahead"), said.alias("said"))
    terminal = F.col("ahead").isNull() | F.col("ahead.style").isin("Heading1", "Heading2")
    return runs_found.where(terminal & (F.size("said") <= most)).select("pkg_id", "start", F.get("said", F.lit(0)).alias("name"), F.get("said", F.lit(1)).alias("affiliation"))


def opened(roled: DataFrame) -> DataFrame:
    """Adds `suggests` (a title or subtitle: a paragraph of either style) and `suggestion_code`, what is wrong with it.

    Only the first paragraphs of a document suggest anything, up to the first of another style, blank ones included. Of
    those with text the first of each style counts.
    """
    style, titled, full = F.col("style_id"), F.coalesce(F.col("style_id").isin("Title", "Subtitle"), F.lit(False)), ~blank(F.col("text"))
    rows = roled.withColumns({"suggests": titled, "_left": F.max((~titled).cast("int")).over(so_far())})
    again = lambda name: (style == name) & (F.count_if((style == name) & full & (F.col("_left") == 0)).over(so_far()) > 1)
    code = F.when(~titled, None).when(F.col("_left") == 1, "metadata_style_not_initial").when(~full, "empty_metadata_suggestion").when(again("Title"), "multiple_docx_titles").when(again("Subtitle"), "multiple_docx_subtitles")
    return rows.withColumn("suggestion_code", code).drop("_left")


def preamble(roled: DataFrame) -> DataFrame:
    """Paragraphs of the styles Title and Subtitle, each with what is wrong with it: null for the title and subtitle that a document begins with."""
    return opened(roled).where("suggests").select("pkg_id", "index", "style_id", F.col("suggestion_code").alias("code"))


def heading_paths(roled: DataFrame) -> DataFrame:
    """Headings with the index of the nearest heading above each at a lower level: the tree of divisions."""
    heads = roled.where("role = 'heading'")
    out = heads
    for level in range(1, 6):
        out = out.withColumn(f"_at{level}", F.last(F.when(F.col("level") == level, F.col("index")), ignorenulls=True).over(before()))
    parent = F.greatest(*(F.when(F.col("level") > level, F.col(f"_at{level}")) for level in range(1, 6)))
    return out.select("pkg_id", "index", "level", parent.alias("parent"))


def stanzas(lines: DataFrame) -> DataFrame:
    """Verse lines (pkg_id, index, line, text) -> stanzas: runs of lines that are not blank."""
    order = Window.partitionBy("pkg_id", "index").orderBy("line")
    marked = lines.withColumn("gap", blank(F.col("text")))
    numbered = marked.withColumn("stanza", F.sum(F.col("gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not gap")
    return numbered.groupBy("pkg_id", "index", "stanza").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines")).drop("stanza")


def summary(roled: DataFrame) -> DataFrame:
    """Per package: blocks by kind, neighbouring quotes, verses, epigraphs and floating texts counted as one block each."""
    grouped = F.col("role").isin("prose_quote", "verse_quote", "epigraph", "floating_text")
    opens = ~grouped | ~F.col("role").eqNullSafe(F.lag("role").over(in_order()))
    counted = roled.withColumn("opens", opens)
    kinds = ("heading", "paragraph", "prose_quote", "verse_quote", "epigraph", "floating_text", "signature", "unsupported")
    return counted.groupBy("pkg_id").agg(*(F.count_if((F.col("role") == k) & F.col("opens")).alias(f"n_{k}") for k in kinds), F.max("level").alias("deepest"))
