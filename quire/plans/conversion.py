"""Packages and their metadata converted to books, with all diagnostics in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.operators import blocks, diagnostics, figures, graphics, header, inline, lists, notes, numbering, record_rules, roles, tables, tei, tei_blocks, validation
from quire.sources import sink
from quire.sources.packages import body_paragraphs, decoded, exploded
from quire.staging import written

DIAGNOSTIC = ("pkg_id", "phase", "origin", "code", "severity", "index", "note_id", "part", "path")


def _row(frame: DataFrame, phase: int, origin: str, severity: str | None = None, **columns) -> DataFrame:
    given = {"index": F.lit(None).cast("int"), "note_id": F.lit(None).cast("string"), "part": F.lit(None).cast("string")}
    for name in given:
        if name in frame.columns:
            given[name] = F.col(name)
    given |= columns
    return frame.select("pkg_id", F.lit(phase).alias("phase"), F.lit(origin).alias("origin"), columns.get("code", F.col("code") if "code" in frame.columns else F.lit(None)).alias("code"), (F.lit(severity) if severity else F.col("severity")).alias("severity"), *(given[n].cast(t).alias(n) for n, t in (("index", "int"), ("note_id", "string"), ("part", "string"))), columns.get("path", F.lit(None)).cast("string").alias("path"))


def inspected(packages: DataFrame) -> DataFrame:
    """Issues of the decoder, and packages that could not be read, with the severity that decides over conversion."""
    issues = diagnostics.blocking(exploded(packages, "issues"))
    fatal = packages.where("error is not null").select("pkg_id", F.col("error").alias("code"), F.lit("error").alias("severity"))
    return _row(issues, 0, "inspection").unionByName(_row(fatal, 0, "inspection"))


def _first(rows: DataFrame, *key: str, order: str = "at") -> DataFrame:
    """Of rows with one key the first in document order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("pkg_id", *key).orderBy(order))).where("_rank = 1").drop("_rank", order)


def _numbered(packages: DataFrame, table: str) -> DataFrame:
    """A table's rows with `at`, their place in the document."""
    return packages.select("pkg_id", F.posexplode(table).alias("at", "_x")).select("pkg_id", "at", "_x.*")


def canonical(name: str):
    return F.when(F.col(name).rlike("^[0-9]+$"), F.col(name).try_cast("bigint"))


def numbering_tables(packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Instances, levels and overrides on canonical ids; of repeated ones the first counts."""
    instances = _numbered(packages, "instances").select("pkg_id", "at", canonical("num_id").alias("num_id"), canonical("abstract_id").alias("abstract_id")).where("num_id is not null")
    levels = _numbered(packages, "levels").select("pkg_id", "at", canonical("abstract_id").alias("abstract_id"), canonical("level").cast("int").alias("level"), F.coalesce("number_format", F.lit("")).alias("number_format"), canonical("start").cast("int").alias("start"), "picture", canonical("restart").cast("int").alias("restart"), "legal").where("abstract_id is not null and level is not null")
    overrides = _numbered(packages, "overrides").select("pkg_id", "at", canonical("num_id").alias("num_id"), canonical("level").cast("int").alias("level"), canonical("start_override").cast("int").alias("start_override"), "number_format", canonical("start").cast("int").alias("start"), "picture", canonical("restart").cast("int").alias("restart"), "legal").where("num_id is not null and level is not null")
    return _first(instances, "num_id"), _first(levels, "abstract_id", "level"), _first(overrides, "num_id", "level")


def repeated_numbering(packages: DataFrame) -> DataFrame:
    """Definitions behind the first of their canonical id, with a code for each kind."""
    found = []
    for table, key, code in (("instances", ("num_id",), "duplicate_numbering_instance"), ("levels", ("abstract_id", "level"), "duplicate_numbering_level")):
        rows = _numbered(packages, table).select("pkg_id", *(canonical(k).alias(k) for k in key)).dropna()
        found.append(rows.groupBy("pkg_id", *key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pkg_id", F.lit(code).alias("code")))
    return found[0].unionByName(found[1]).distinct()


def resolved(packages: DataFrame) -> DataFrame:
    """Numbering of body paragraphs with its origin: their own, or the one their style sets or inherits."""
    rows = exploded(packages, "paragraphs").where("part = 'word/document.xml' and not in_table").select("pkg_id", "index", "style_id", "has_numbering", "raw_id", "raw_level")
    styles = _first(_numbered(packages, "styles").select("pkg_id", "at", "style_id", "based_on", "raw_id"), "style_id")
    inherited = numbering.inherited_numbering(styles).where("outcome = 'set'").select("pkg_id", "style_id", F.col("raw_id").alias("_style_id"))
    joined = rows.join(inherited, ["pkg_id", "style_id"], "left").where("has_numbering or _style_id is not null")
    own = F.col("has_numbering")
    used = joined.select("pkg_id", "index", F.when(own, "direct").otherwise("style").alias("origin"), F.when(own, F.col("raw_id")).otherwise(F.col("_style_id")).alias("raw_id"), F.when(own, F.col("raw_level")).alias("raw_level"))
    found = numbering.resolved_numbering(used, *numbering_tables(packages))
    return found.join(used.select("pkg_id", "index", "origin", "raw_id"), ["pkg_id", "index"])


def with_own_styles(packages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Paragraphs whose localized style ids are replaced by the ids they stand for."""
    meant = roles.own_styles(_first(_numbered(packages, "styles").select("pkg_id", "at", "style_id", "name", "style_type", "is_custom"), "style_id"))
    return paragraphs.join(meant, ["pkg_id", "style_id"], "left").withColumn("style_id", F.coalesce("meant", "style_id")).drop("meant")


def body_blocks(packages: DataFrame, inner: bool = False) -> DataFrame:
    """Body paragraphs with the role each has among its neighbours, and what decides over it.

    Over the roles of `roles.with_roles`: bibliography (from the cut on), figure (an image), figure_text (its
    title, caption, credits), list_item (numbered, status resolved), bibl (a reference of its own or of the
    quotation before it) and empty (nothing but layout). `inner` blocks are those of notes (`note_view`), which have
    no bibliography. `continuation` says which list paragraphs may go on with an item (`roles.continuation`). The title and
    subtitle that a body begins with belong to its record: they are no blocks (`blocks.opened`).
    """
    roled = roles.with_roles(with_own_styles(packages, body_paragraphs(packages)))
    if not inner:
        roled = blocks.opened(roled).where("not suggests or suggestion_code is not null")
    items = exploded(packages, "items").where("part = 'word/document.xml' and not in_table")
    other = (F.col("kind") != "drawing") & ~((F.col("kind") == "text") & blocks.blank(F.col("text")))
    stats = items.groupBy("pkg_id", "index").agg(F.count_if(F.col("kind") == "drawing").alias("drawing_count"), F.bool_or(other).alias("has_other"), F.bool_or((F.col("kind") == "tab") | F.col("link").isNotNull() | F.col("anchor").isNotNull() | F.col("reference_id").isNotNull() | ((F.col("kind") == "break") & (F.col("break_type") != "line"))).alias("has_mark"))
    numbers = resolved(packages).select("pkg_id", "index", "status", "kind", "number_format", "start", "restart", "legal", F.col("level").alias("list_level"), "origin", F.col("raw_id").alias("number"))
    rows = roled.join(stats, ["pkg_id", "index"], "left").join(numbers, ["pkg_id", "index"], "left")
    rows = rows.withColumns({"drawing_count": F.coalesce("drawing_count", F.lit(0)), "numbered": numbering.active(F.col("status"), F.col("raw_id"))})
    cut = blocks.bibliography_cut(roled).where(F.lit(not inner)).select("pkg_id", "cut")
    around = figures.figures(rows).select("pkg_id", F.explode(F.array_compact(F.array("title", "caption", "credits"))).alias("index")).distinct().withColumn("_text_of_figure", F.lit(True))
    rows = rows.join(cut, "pkg_id", "left").join(around, ["pkg_id", "index"], "left")
    reference = roles.controlled_status(F.col("style_id"), F.col("style_name"), F.col("style_is_custom"), F.lit("paragraph"))
    empty = blocks.blank(F.col("text")) & ~F.coalesce("has_mark", F.lit(False)) & (F.size("bookmark_ids") == 0) & ~F.col("numbered")
    listed = (F.col("role") == "paragraph") & (F.col("status") == "resolved") & F.col("kind").isin("ordered", "bulleted") & (F.col("origin") == "direct") & F.col("restart").isNull() & ~F.coalesce("legal", F.lit(False))
    role = (
        F.when(F.col("index") >= F.col("cut"), "bibliography").when(F.col("drawing_count") > 0, "figure").when(F.col("_text_of_figure"), "figure_text").when(listed, "list_item")
        .when((F.col("style_id") == "TEIbiblreference") & (reference == "valid"), "bibl").when((F.col("role").isin("paragraph", "signature")) & empty, "empty").otherwise(F.col("role"))
    )
    goes_on = roles.continuation(F.col("role"), F.col("style_id"), F.col("style_is_custom"), F.col("has_numbering") | F.col("numbered"))
    return rows.withColumn("continuation", goes_on).withColumn("role", role).drop("_text_of_figure")


def _drawings(packages: DataFrame) -> DataFrame:
    rows = exploded(packages, "items").where("part = 'word/document.xml' and not in_table and kind = 'drawing'")
    return rows.select("pkg_id", "part", "index", F.coalesce("link", "anchor").alias("link"), "placement", "embedded", "linked", "cropped", "transformed", "invalid", "description")


def found_graphics(packages: DataFrame, body: DataFrame) -> DataFrame:
    relations = exploded(packages, "relations").select("pkg_id", "part", "relation_id", "sequence", "target", "type", "mode")
    return graphics.graphics(body.where("drawing_count > 0").select("pkg_id", "part", "index", "style_id", "style_is_custom", "numbered", "has_other"), _drawings(packages), relations, exploded(packages, "media"))


def found_lists(body: DataFrame) -> DataFrame:
    """What `lists.list_items` finds in the blocks, with each item's kind, number_format and start."""
    item = F.col("role") == "list_item"
    only = lambda c: F.when(item, F.col(c))
    empty = blocks.blank(F.col("text")) & ~F.coalesce("has_mark", F.lit(False)) & (F.col("drawing_count") == 0)
    rows = body.select("pkg_id", "index", "block", lists.block_class(F.col("role"), item, F.col("continuation")).alias("class"), F.when(item, canonical("number")).alias("num_id"), only("list_level").alias("level"), *(only(c).alias(c) for c in ("kind", "number_format", "start")), empty.alias("empty"))
    return lists.list_items(rows).join(rows.select("pkg_id", "index", "kind", "number_format", "start"), ["pkg_id", "index"])


def note_refs(packages: DataFrame) -> DataFrame:
    """pkg_id, owner (the note a reference stands in, null in the body), note_id (the one it names); both as kind:id."""
    owner = F.when(F.col("note_id").isNotNull(), F.concat(F.regexp_extract("part", "word/(.*)s[.]xml", 1), F.lit(":"), "note_id"))
    return exploded(packages, "items").where("reference_id is not null").select("pkg_id", owner.alias("owner"), F.concat(F.regexp_replace("kind", "_reference", ":"), "reference_id").alias("note_id"))


def known_notes(packages: DataFrame) -> DataFrame:
    return exploded(packages, "notes").select("pkg_id", F.concat("kind", F.lit(":"), "note_id").alias("note_id"))


def text_problems(packages: DataFrame, body: DataFrame, inner: bool = False) -> list[DataFrame]:
    """Whatever in a text cannot be written, in the body or (`inner`, over `note_view`) inside notes."""
    signatures = blocks.signature_runs(body.where("role not in ('empty', 'bibliography')")).where("refused is not null").select("pkg_id", F.col("start").alias("index"))
    tables_found = tables.table_problems(exploded(packages, "cells")).where("code is not null").select("pkg_id", F.col("block").alias("index"), "code")
    refusal = numbering.refusal(F.when(F.col("role") == "list_item", "paragraph").otherwise(F.col("role")), F.col("status"), F.col("kind"), F.col("origin"), F.col("legal"), F.col("restart"))
    numbers = body.where("role <> 'bibliography'").withColumn("code", refusal).where("code is not null")
    items = exploded(packages, "items").where("part = 'word/document.xml'")
    relation = exploded(packages, "relations").select("pkg_id", "part", F.col("relation_id").alias("link"), "mode").distinct()
    code = (
        F.when(F.col("kind") == "tab", "tab_not_serializable").when((F.col("kind") == "break") & (F.col("break_type") != "line"), "page_or_column_break_not_serializable")
        .when(F.col("link").isNotNull() & ~F.coalesce(F.col("mode") == "External", F.lit(False)), "unresolved_link_not_serializable").when(F.col("link").isNull() & F.col("anchor").isNotNull(), "internal_link_not_serializable")
        .when(F.col("in_table") & (F.col("kind") == "drawing"), "image_in_table_cell_not_serializable")
    )
    runs = items.join(relation, ["pkg_id", "part", "link"], "left").withColumn("code", code).where("code is not null").select("pkg_id", "index", "code")
    kept = body.where("role not in ('empty', 'bibliography')").select("pkg_id", "index").unionByName(items.where("in_table").select("pkg_id", "index").distinct())
    runs = runs.join(kept, ["pkg_id", "index"], "left_semi")
    at = lambda rows, role, code: rows.where(F.col("role") == role).select("pkg_id", "index", F.lit(code).alias("code"))
    blank = body.where(blocks.blank(F.col("text")))
    found = found_lists(body)
    own = "note" if inner else "body"
    only = {
        "body": [blocks.epigraph_runs(body.where("role <> 'empty'")).where("not allowed").select("pkg_id", F.col("start").alias("index"), F.lit("misplaced_epigraph_not_serializable").alias("code"))],
        "note": [at(body, "heading", "heading_in_note_not_serializable"), at(body, "epigraph", "misplaced_epigraph_not_serializable"), at(body, "floating_text", "floating_text_in_note_not_serializable"), at(body, "signature", "misplaced_signature_not_serializable"),
                 body.where("style_id = 'TEIbiblstart'").select("pkg_id", "index", F.lit("bibliography_in_note_not_serializable").alias("code"))],
    }
    texts = (
        at(blank.where("not coalesce(has_mark, false)"), "heading", "empty_heading"), *only[own],
        at(blank, "verse_quote", "ambiguous_empty_verse_block"),
        figures.orphans(body).select("pkg_id", "index", F.lit("orphan_figure_caption_not_serializable").alias("code")),
        blocks.sourced_quotes(body).where("has_second").select("pkg_id", F.col("start").alias("index"), F.lit("multiple_quotation_sources_not_serializable").alias("code")),
        at(body.where((F.col("index") > F.col("cut")) & ~F.coalesce(F.col("style_id").isin(*roles.BIBLIOGRAPHY, "TEIbiblreference", "TEIbiblstart"), F.lit(False)) & ~blocks.blank(F.col("text"))), "bibliography", "nonterminal_bibliography_not_serializable"),
        _behind_the_cut(packages, body), _cell_problems(packages), _run_problems(packages, body),
        found_graphics(packages, body).where("code is not null").select("pkg_id", "index", "code"),
        tables_found, runs, numbers.select("pkg_id", "index", "code"),
    )
    styled = body.where(~F.col("role").isin("bibliography", "figure", "figure_text", "list_item", "bibl", "empty", "ready"))
    unnumbered = body.where((F.col("style_id") == "ListParagraph") & F.col("status").isNull() & ~F.col("has_numbering"))
    return [
        _row(unnumbered, 0, "inspection", "warning", code=F.lit("list_paragraph_without_numbering")),
        _row(roles.style_diagnosis(styled), 3, "editorial"),
        *([] if inner else [_suggestions(body), _row(blocks.heading_jumps(body), 3, "editorial", "info", code=F.lit("heading_level_jump")), _row(signatures, 3, "editorial", "error", code=F.lit("misplaced_signature_not_serializable"))]),
        _row(at(body, "empty", "empty_paragraph_ignored"), 3, "editorial", "info"),
        _row(lists.list_problems(found), 3, "editorial"),
        *(_row(rows, 3, "editorial", "error") for rows in texts),
    ]


def _behind_the_cut(packages: DataFrame, body: DataFrame) -> DataFrame:
    """Tables behind the start of the bibliography: no entry, and nowhere to write them."""
    start = body.where("role = 'bibliography'").groupBy("pkg_id").agg(F.min("block").alias("_cut"))
    return exploded(packages, "cells").select("pkg_id", "block").distinct().join(start, "pkg_id").where("block > _cut").select("pkg_id", F.lit(None).cast("int").alias("index"), F.lit("nonterminal_bibliography_not_serializable").alias("code")).distinct()


def _lost_before(packages: DataFrame, body: DataFrame) -> DataFrame:
    """`blocks.collective_problems` of the written blocks, tables and images among them."""
    shown = F.lit("any").alias("text")
    tables_at = exploded(packages, "cells").select("pkg_id", "block").distinct().select("pkg_id", F.lit(None).cast("int").alias("index"), "block", F.lit("table").alias("role"), F.lit(None).cast("int").alias("level"), shown)
    return blocks.collective_problems(body.where("role <> 'empty'").select("pkg_id", "index", "block", "role", "level", shown).unionByName(tables_at), "block")


def _cell_problems(packages: DataFrame) -> DataFrame:
    """Written cells' paragraphs of a style that no cell has, of a role that no cell has, or numbered."""
    filled = exploded(packages, "cells").where("index is not null").select("pkg_id", "index")
    cells = exploded(packages, "paragraphs").where("part = 'word/document.xml' and in_table").join(filled, ["pkg_id", "index"], "left_semi")
    styles = _first(_numbered(packages, "styles").select("pkg_id", "at", "style_id", F.col("name").alias("style_name"), F.col("is_custom").alias("style_is_custom"), F.col("outline_level").alias("_outline")), "style_id")
    rows = with_own_styles(packages, cells.join(styles, ["pkg_id", "style_id"], "left").withColumn("outline_level", F.coalesce("outline_level", "_outline")))
    roled = roles.with_roles(rows)
    named = F.col("style_id"), F.col("style_name"), F.col("style_is_custom")
    controlled = F.coalesce((roles.controlled_status(*named, F.lit("paragraph")) == "valid") & (F.col("style_id") == "TEIcell"), F.lit(False))
    codes = F.array_compact(F.array(
        F.when(~roles.cell_style(*named), "unsupported_table_cell_style"),
        F.when(F.col("has_numbering") & (F.coalesce("raw_id", F.lit("")) != "0"), "numbered_table_cell_not_serializable"),
        F.when((F.col("role") != "paragraph") & ~controlled, "unsupported_table_cell_content"),
    ))
    return roled.select("pkg_id", F.col("block").alias("index"), F.explode(codes).alias("code"))


def with_character_styles(packages: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose localized character style is replaced by the one it stands for, with `reference`: whether the style is the one of references inside a paragraph (valid), or only like it (invalid)."""
    styles = _first(_numbered(packages, "styles").select("pkg_id", "at", "style_id", "name", "style_type", "is_custom"), "style_id")
    meant = roles.own_styles(styles).select("pkg_id", F.col("style_id").alias("char_style"), "meant")
    named = styles.select("pkg_id", F.col("style_id").alias("char_style"), F.struct("name", "is_custom", "style_type").alias("_style"))
    rows = items.join(named, ["pkg_id", "char_style"], "left").join(meant, ["pkg_id", "char_style"], "left")
    reference = roles.inline_reference(F.col("char_style"), F.col("_style.name"), F.col("_style.is_custom"), F.col("_style.style_type"))
    return rows.withColumn("reference", reference).withColumn("char_style", F.coalesce("meant", "char_style")).drop("meant", "_style")


def _run_problems(packages: DataFrame, body: DataFrame) -> DataFrame:
    """Runs of written paragraphs whose character style stands for no mark, and references inside a paragraph that cannot be."""
    items = exploded(packages, "items").where("part = 'word/document.xml' and char_style is not null").select("pkg_id", "index", "char_style", "in_table", (F.col("kind") == "drawing").alias("drawn")).distinct()
    role = body.select("pkg_id", "index", F.col("role").alias("_role"))
    rows = with_character_styles(packages, items).join(role, ["pkg_id", "index"], "left").where("in_table or _role <> 'empty'")
    valid = F.coalesce(F.col("reference") == "valid", F.lit(False))
    code = (
        F.when(F.col("reference") == "invalid", "invalid_bibliographic_reference_inline_style").when(valid & F.col("drawn"), "drawing_in_bibliographic_reference_inline_not_serializable")
        .when(valid & F.coalesce(F.col("_role").isin("bibl", "bibliography"), F.lit(False)), "nested_bibliographic_reference_not_serializable")
        .when(~valid & ~F.col("char_style").isin(*roles.CHARACTER_MARKS, *roles.NEUTRAL_CHARACTERS), "unsupported_character_style")
    )
    return rows.withColumn("code", code).where("code is not null").select("pkg_id", "index", "code")


def found_problems(packages: DataFrame, body: DataFrame, notes_found: DataFrame | None = None, note_blocks: DataFrame | None = None, most_media: int = graphics.MOST_USED) -> DataFrame:
    """Diagnostics of all phases, repeats removed: inspection, numbering, notes, and whatever in the text cannot be written.

    notes_found and note_blocks: `note_view` of the packages and its `body_blocks`; headings and the like inside notes
    count where the note is reached from the body. most_media: bytes of images that one document may use.
    """
    refs, known = note_refs(packages), known_notes(packages)
    repeated = known.groupBy("pkg_id", "note_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    body_refs, inner_refs = refs.where("owner is null").select("pkg_id", "note_id"), refs.where("owner is not null")
    reached, cyclic = notes.cycles(body_refs, inner_refs.select("pkg_id", F.col("owner").alias("note_id"), F.col("note_id").alias("target")), known)
    parts = [
        inspected(packages),
        _row(repeated_numbering(packages), 0, "inspection", "error"),
        _row(notes.missing_targets(refs, known), 2, "editorial", "error", code=F.lit("missing_note_target")),
        _row(notes.unreferenced(refs, known), 2, "editorial", "warning", code=F.lit("unreferenced_note")),
        _row(repeated, 2, "editorial", "error", code=F.lit("duplicate_note_id")),
        _row(cyclic, 4, "serialization", "error", code=F.lit("cyclic_note_reference")),
        _row(_lost_before(packages, body), 4, "serialization"),
        _row(known.distinct().join(reached, ["pkg_id", "note_id"], "left_anti"), 4, "serialization", "warning", code=F.lit("unreferenced_note_not_serialized")),
        *text_problems(packages, body),
    ]
    used = found_graphics(packages, body)
    if note_blocks is not None:
        used = used.unionByName(found_graphics(notes_found, note_blocks).withColumns(note_names()).join(reached, ["pkg_id", "note_id"], "left_semi").drop("note_id"))
        inside = reduce(DataFrame.unionByName, text_problems(notes_found, note_blocks, True))
        named = inside.withColumns(note_names()).where((F.col("code") != "heading_in_note_not_serializable") | F.col("note_id").isNotNull())
        headings = named.where("code = 'heading_in_note_not_serializable'").join(reached, ["pkg_id", "note_id"], "left_semi")
        parts.append(named.where("code <> 'heading_in_note_not_serializable'").unionByName(headings.select(*named.columns)))
    parts.append(_row(graphics.used_media(used, exploded(packages, "media"), most_media)[1], 4, "serialization", "error"))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.withColumn("sequence", F.struct("phase", "part", "note_id", "index", "code"))
    return diagnostics.distinct_diagnostics(rows).drop("sequence")


def body_spans(packages: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Items of body and cell paragraphs as spans with marks (direct ones over the character style's), external links, and a token where a note is referred to.

    languages: pkg_id, language of the documents; a run in another language than its document's carries it.
    """
    names = F.create_map(*(F.lit(x) for pair in roles.CHARACTER_MARKS.items() for x in pair))
    style_marks = F.when(names[F.col("char_style")].isNotNull(), F.array(names[F.col("char_style")]))
    direct = {n: F.col(n) for n in ("bold", "italic", "small_caps", "caps")} | {"superscript": F.when(F.col("vertical") == "superscript", True), "subscript": F.when(F.col("vertical") == "subscript", True)}
    links = _first(exploded(packages, "relations").where("mode = 'External'").select("pkg_id", "part", F.col("relation_id").alias("link"), F.col("target").alias("url"), "sequence"), "part", "link", order="sequence")
    items = exploded(packages, "items").where("part = 'word/document.xml' and kind in ('text', 'break', 'footnote_reference', 'endnote_reference')")
    items = with_character_styles(packages, items.where("kind <> 'break' or break_type = 'line'"))
    items = items.join(links, ["pkg_id", "part", "link"], "left")
    language = F.lit(None).cast("string")
    if languages is not None:
        items = items.join(languages.select("pkg_id", F.col("language").alias("_document")), "pkg_id", "left")
        language = F.when(ids.primary_language(F.col("language")) != ids.primary_language(F.col("_document")), F.col("language"))
    is_note = F.col("reference_id").isNotNull()
    kind, text = F.when(is_note, "note").otherwise(F.col("kind")), F.when(is_note, tei.note_token(F.concat(F.regexp_replace("kind", "_reference", ":"), "reference_id"))).otherwise(F.col("text"))
    shown = items.select("pkg_id", "index", (F.col("run") * 100_000 + F.col("item")).alias("item"), kind.alias("kind"), text.alias("text"), F.when(~is_note, inline.marks(style_marks, direct)).alias("marks"), F.when(~is_note, F.col("url")).alias("link"), F.when(~is_note, language).alias("language"), F.coalesce(F.col("reference") == "valid", F.lit(False)).alias("bibl"))
    return inline.spans(shown)


def body_pieces(packages: DataFrame, body: DataFrame, xml: DataFrame) -> DataFrame:
    """Lists, figures and tables as pieces at the blocks' places (`block` counts paragraphs and tables)."""
    place = body.select("pkg_id", "index", "block")
    items = tei_blocks.list_pieces(found_lists(body).where("path is not null").join(xml, ["pkg_id", "index"], "left"))
    images = tei_blocks.figure_pieces(figures.figures(body), found_graphics(packages, body), xml)
    gone = body.where("role in ('empty', 'bibliography', 'figure_text')").select("pkg_id", "index", F.lit("").alias("piece"))
    whole = items.unionByName(images).unionByName(gone).groupBy("pkg_id", "index").agg(F.max("piece").alias("piece")).join(place, ["pkg_id", "index"])
    cells = exploded(packages, "cells").join(xml, ["pkg_id", "index"], "left")
    return whole.select("pkg_id", "block", "piece").unionByName(tei_blocks.table_xml(cells)).withColumnRenamed("block", "index")


def bibliographies(body: DataFrame, xml: DataFrame) -> DataFrame:
    rows = body.where("role = 'bibliography'").join(xml, ["pkg_id", "index"], "left")
    entry = F.col("style_id").isin(*roles.BIBLIOGRAPHY, "TEIbiblreference")
    head = F.when(entry, "entry").when(F.col("index") == F.col("cut"), "head")
    return tei_blocks.bibliography_xml(rows.withColumn("part", head).where("part is not null").select("pkg_id", "index", "part", "xml"))


UNIT = "\x1f"


def note_names() -> dict:
    """pkg_id and note_id (kind:id) of a row of `note_view`, whose pkg_id names both."""
    name = F.substring_index("pkg_id", UNIT, -1)
    return {"pkg_id": F.substring("pkg_id", F.lit(1), F.length("pkg_id") - F.length(name) - 1), "note_id": name}


def note_view(packages: DataFrame) -> DataFrame:
    """The packages' notes as packages of their own, so that whatever reads bodies reads them: pkg_id is the package's id and the note's kind:id.

    A note brings the styles it uses, and its package's numbering, relations and media only if it has numbers,
    links or drawings. Styles that may inherit a number come with all others. Of notes of one id the first counts.
    """
    part, names = F.concat(F.lit("word/"), "kind", F.lit("s.xml")), {"part": F.lit("word/document.xml"), "note_id": F.lit(None).cast("string")}
    of = lambda table: exploded(packages, table).where("note_id is not null")
    kinds = {f.name: f.dataType for f in packages.schema.fields}

    def gathered(table: str) -> DataFrame:
        fields = [f.name for f in kinds[table].elementType.fields]
        return of(table).groupBy("pkg_id", F.col("part").alias("_part"), "note_id").agg(F.collect_list(F.struct(*(names[f].alias(f) if f in names else F.col(f) for f in fields))).cast(kinds[table]).alias(table))

    known = _first(_numbered(packages, "notes").select("pkg_id", "at", "kind", "note_id"), "kind", "note_id").withColumn("_part", part)
    rows = known.join(gathered("paragraphs"), ["pkg_id", "_part", "note_id"], "left").join(gathered("items"), ["pkg_id", "_part", "note_id"], "left")
    rows = rows.withColumns({t: F.coalesce(t, F.array().cast(kinds[t])) for t in ("paragraphs", "items")})
    shared = packages.select("pkg_id", "sha256", *(F.col(t).alias(f"_{t}") for t in ("styles", "instances", "levels", "overrides", "relations", "media")))
    rows = rows.join(shared, "pkg_id")
    used = F.array_distinct(F.array_compact(F.concat(F.transform("paragraphs", lambda p: p["style_id"]), F.transform("items", lambda i: i["char_style"]))))
    chained = F.exists("_styles", lambda s: s["raw_id"].isNotNull()) & F.exists("_styles", lambda s: F.array_contains("_used", s["style_id"]) & s["based_on"].isNotNull())
    rows = rows.withColumn("_used", used)
    numbered = F.exists("paragraphs", lambda p: p["has_numbering"]) | chained
    drawn, linked = F.exists("items", lambda i: i["kind"] == "drawing"), F.exists("items", lambda i: i["link"].isNotNull())
    given = {
        "styles": F.when(chained, F.col("_styles")).otherwise(F.filter("_styles", lambda s: F.array_contains("_used", s["style_id"]))),
        "relations": F.when(drawn | linked, F.transform(F.filter("_relations", lambda r: r["part"] == F.col("_part")), lambda r: r.withField("part", F.lit("word/document.xml")))),
        "media": F.when(drawn, F.col("_media")), **{t: F.when(numbered, F.col(f"_{t}")) for t in ("instances", "levels", "overrides")},
    }
    none = lambda t: F.array().cast(kinds[t])
    own = {t: F.coalesce(c.cast(kinds[t]), none(t)) for t, c in given.items()} | {t: none(t) for t in ("notes", "cells", "issues")}
    rows = rows.withColumns(own | {"pkg_id": F.concat("pkg_id", F.lit(UNIT), "kind", F.lit(":"), "note_id"), "error": F.lit(None).cast("string")})
    return rows.select(*packages.columns)


def note_texts(packages: DataFrame, view: DataFrame, body: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """pkg_id, note_id (kind:id), xml of each note with all notes inside it; notes in a cycle, and those that lead to one, are left out."""
    if languages is not None:
        units = view.select("pkg_id").withColumn("_unit", F.col("pkg_id")).withColumns(note_names())
        languages = units.join(languages.select("pkg_id", "language"), "pkg_id").select(F.col("_unit").alias("pkg_id"), "language")
    xml = written(tei.span_xml(body_spans(view, languages)), "note-spans")
    ready = body.join(xml, ["pkg_id", "index"], "left").withColumn("index", F.col("block"))
    inside = tei.content_xml(ready, "xml", body_pieces(view, body, xml))
    rows = view.select("pkg_id").join(inside, "pkg_id", "left").withColumns(note_names())
    place = F.when(F.col("note_id").startswith("footnote:"), "foot").otherwise("end")
    bare = written(rows.select("pkg_id", "note_id", tei.element("note", F.coalesce("content", F.lit("")), place=place).alias("xml")), "note-texts")
    refs = note_refs(packages).where("owner is not null").select("pkg_id", F.col("owner").alias("note_id"), F.col("note_id").alias("target"))
    return notes.nested(bare, refs, tei.note_token)


def _suggestions(body: DataFrame) -> DataFrame:
    """Titles and subtitles of bodies that say nothing to a record."""
    rows = body.where("suggestion_code is not null").select("pkg_id", F.col("suggestion_code").alias("code"), "index")
    severity = F.when(F.col("code").isin("metadata_style_not_initial", "empty_metadata_suggestion"), "error").otherwise("warning")
    return _row(rows.withColumn("severity", severity), 1, "metadata", path=F.concat(F.lit("paragraphs["), "index", F.lit("]")))


def suggested(packages: DataFrame) -> DataFrame:
    """pkg_id, file_name, sha256, title, subtitle, signatures: what packages themselves say of what their records say (`record_rules.inconsistencies`)."""
    rows = blocks.opened(with_own_styles(packages, body_paragraphs(packages)))
    said = lambda style: F.max(F.when(F.col("style_id") == style, record_rules.strip(F.col("text"))))
    titles = rows.where("suggests and suggestion_code is null").groupBy("pkg_id").agg(said("Title").alias("title"), said("Subtitle").alias("subtitle"))
    signed = blocks.signature_suggestions(rows).groupBy("pkg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]).alias("signatures"))
    own = packages.select("pkg_id", F.regexp_extract(F.replace("pkg_id", F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1).alias("file_name"), "sha256")
    return own.join(titles, "pkg_id", "left").join(signed, "pkg_id", "left")


def described(packages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pkg_id, language, abstracts of the records that may be used; their headers; diagnostics of all records of these packages).

    Diagnostics are the issues of reading, broken rules, what differs from the package, and what no header holds. An error
    among them refuses the package. One record for a package.
    """
    own = written(records.join(packages.select("pkg_id"), "pkg_id", "left_semi"), "records")
    usable, broken = record_rules.checked_records(own)
    found = (_row(rows, phase, "metadata", path=F.col("path")) for phase, rows in ((1, broken), (1, record_rules.inconsistencies(usable, suggested(packages))), (4, header.losses(usable))))
    return usable.select("pkg_id", F.col("document.language").alias("language"), "abstracts"), header.record_header(usable), reduce(DataFrame.unionByName, found)


def converted(packages: DataFrame, metadata: DataFrame, most_media: int = graphics.MOST_USED) -> tuple[DataFrame, DataFrame]:
    """(pkg_id, xml) of the packages without errors, and the diagnostics of all.

    metadata: records with pkg_id (`sources.records.decoded_records`), or columns that `tei.header_xml` takes. A package
    without metadata is refused (missing_metadata), with a record that breaks a rule or has no place in a header as well
    (`described`), and so is one whose XML breaks the profile. Packages are decoded once: what is read here is a written table, and
    so are their blocks. Notes are texts of their own, read like bodies, and stand wherever they are referred to. Every
    paragraph, item, image, list, table and note is written or has an error row, but for what stands before the first text
    of a collective volume, which has a warning.
    """
    books, problems, _ = _converted(packages, metadata, most_media)
    return books, problems


def _converted(packages: DataFrame, metadata: DataFrame, most_media: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    packages = written(packages, "packages")
    body = written(body_blocks(packages), "blocks")
    view = written(note_view(packages), "notes")
    inner = written(body_blocks(view, inner=True), "note-blocks")
    lacking = packages.select("pkg_id").join(metadata, "pkg_id", "left_anti")
    problems = written(found_problems(packages, body, view, inner, most_media).unionByName(_row(lacking, 4, "metadata", "error", code=F.lit("missing_metadata"))), "problems")
    if "source_document" in metadata.columns:
        metadata, headers, more = described(packages, metadata)
        problems = written(problems.unionByName(more), "all-problems")
    else:
        headers = tei.header_xml(metadata.join(packages.select("pkg_id"), "pkg_id", "left_semi"))
    inside = note_texts(packages, view, inner, metadata)
    refs = exploded(packages, "items").where("part = 'word/document.xml' and reference_id is not null").select("pkg_id", "index", F.concat(F.regexp_replace("kind", "_reference", ":"), "reference_id").alias("note_id"))
    xml = written(notes.filled(tei.span_xml(body_spans(packages, metadata)), refs, inside, ["pkg_id", "index"], tei.note_token), "spans")
    pieces = body_pieces(packages, body, xml)
    ready = body.join(xml, ["pkg_id", "index"], "left").withColumn("index", F.col("block"))
    fronts = metadata.select("pkg_id", tei_blocks.front_xml(F.col("abstracts")).alias("front")) if "abstracts" in metadata.columns else None
    books = written(tei.documents(headers, tei.text_xml(ready, "xml", pieces), problems, fronts, bibliographies(body, xml)), "books")
    invalid = written(validation.validated(books), "invalid")
    checked = _row(invalid.select("pkg_id").distinct(), 5, "validation", "error", code=F.lit("invalid_output"))
    books = books.join(invalid, "pkg_id", "left_anti")
    found = found_graphics(packages, body).unionByName(found_graphics(view, inner).withColumns(note_names()).drop("note_id"))
    assets = graphics.used_media(found, exploded(packages, "media"))[0]
    assets = assets.join(books, "pkg_id").where(F.contains("xml", "url")).drop("xml")
    return books, problems.unionByName(checked), assets


def convert_files(files: DataFrame, metadata: DataFrame, target: str, most_media: int = graphics.MOST_USED, id_col: str = "path", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Packages of `files` converted and written below `target` (`sink.write_books`): (outcome of each book, diagnostics of all packages).

    A fault of an image that shows only while books are written is a diagnostic as well. Refused packages leave no file.
    """
    books, problems, assets = _converted(decoded(files, id_col, content_col), metadata, most_media)
    books, assets = written(books, "valid"), written(assets, "used")
    outcome = sink.write_books(books, files, assets, target, id_col, content_col)
    return outcome, problems.unionByName(_row(outcome.where("code is not null"), 6, "writing", "error"))


def summary(packages: DataFrame) -> DataFrame:
    """Per package: paragraphs, styles used, notes by kind, breaks, links, drawings, tables, media."""
    n = lambda table, test: F.size(F.filter(table, test)).cast("long")
    return packages.select(
        "pkg_id", "error", n("paragraphs", lambda p: ~p["in_table"]).alias("n_paragraphs"), F.size(F.array_distinct(F.filter(F.transform("paragraphs", lambda p: p["style_id"]), lambda s: s.isNotNull()))).alias("n_styles"),
        n("paragraphs", lambda p: p["has_numbering"]).alias("n_numbered"), n("items", lambda i: i["kind"] == "break").alias("n_breaks"), n("items", lambda i: i["kind"] == "drawing").alias("n_drawings"),
        F.size(F.array_distinct(F.filter(F.transform("items", lambda i: i["link"]), lambda s: s.isNotNull()))).alias("n_links"), n("notes", lambda x: x["kind"] == "footnote").alias("n_footnotes"), n("notes", lambda x: x["kind"] == "endnote").alias("n_endnotes"),
        F.size(F.array_distinct(F.transform("cells", lambda c: c["block"]))).alias("n_tables"), F.size("media").alias("n_media"), F.size("issues").alias("n_issues"),
    )
