"""Registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.operators import blocks, diagnostics, figures, header, inline, lists, metadata, notes, numbering, record_rules, roles, tables, tei, validation
from quire.plans import adapters as a
from quire.plans.oracles import ORACLES
from quire.sources import records
from quire.staging import written

FLAGSHIP = "a02_editorial_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def roled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.with_roles(a.paragraphs(spark, sf_dir))


@query
def f01_paragraph_role(spark, sf_dir):
    return roled(spark, sf_dir).select("pkg_id", "index", "role", "level", "rendition")


@query
def e07_style_diagnosis(spark, sf_dir):
    return roles.style_diagnosis(roled(spark, sf_dir))


@query
def f07_controlled_style(spark, sf_dir):
    rows = a.paragraphs(spark, sf_dir)
    name = F.when(F.col("index") % 3 == 0, "TEI_bibl_reference").otherwise(F.lit("Other"))
    status = roles.controlled_status(F.col("style_id"), name, F.col("index") % 2 == 0, F.lit("paragraph"))
    return rows.groupBy("pkg_id", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def w02_prose_quote_groups(spark, sf_dir):
    return blocks.runs(roled(spark, sf_dir), "prose_quote")


@query
def w08_floating_text_groups(spark, sf_dir):
    return blocks.runs(roled(spark, sf_dir), "floating_text")


@query
def w02_turn_groups(spark, sf_dir):
    return blocks.runs(a.turns(spark, sf_dir), "assistant")


@query
def w05_epigraph_runs(spark, sf_dir):
    return blocks.epigraph_runs(roled(spark, sf_dir))


@query
def w06_signature_runs(spark, sf_dir):
    return blocks.signature_runs(roled(spark, sf_dir))


@query
def w10_heading_jumps(spark, sf_dir):
    return blocks.heading_jumps(roled(spark, sf_dir))


@query
def w11_sourced_quotes(spark, sf_dir):
    return blocks.sourced_quotes(roled(spark, sf_dir))


@query
def w14_bibliography_cut(spark, sf_dir):
    return blocks.bibliography_cut(roled(spark, sf_dir))


@query
def w19_contributions(spark, sf_dir):
    return blocks.contributions(roled(spark, sf_dir))


@query
def w20_preamble(spark, sf_dir):
    return blocks.preamble(roled(spark, sf_dir))


@query
def t06_heading_paths(spark, sf_dir):
    return blocks.heading_paths(roled(spark, sf_dir))


@query
def a02_editorial_summary(spark, sf_dir):
    return blocks.summary(roled(spark, sf_dir))


@query
def w04_stanzas(spark, sf_dir):
    docs = a.table(spark, sf_dir, "conversations")
    lines = docs.select(F.col("conv_id").alias("pkg_id"), F.col("turn").alias("index"), F.posexplode(F.split(F.regexp_replace("text", r"\. ", "\n\n"), "\n")).alias("line", "text"))
    return blocks.stanzas(lines)


@query
def j06_missing_note_targets(spark, sf_dir):
    return notes.missing_targets(a.note_references(spark, sf_dir), a.notes(spark, sf_dir))


@query
def j07_unreferenced_notes(spark, sf_dir):
    return notes.unreferenced(a.note_references(spark, sf_dir), a.notes(spark, sf_dir))


@query
def j09_reachable_notes(spark, sf_dir):
    lines = a.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("pkg_id"), F.col("o_orderkey").alias("note_id"))
    # rings of four notes; the body refers to the first of each
    target = F.col("note_id") + F.when(F.col("note_id") % 400 < 300, 100).otherwise(-300)
    body = lines.withColumn("note_id", F.col("note_id") - F.col("note_id") % 400 + F.col("note_id") % 100)
    return notes.reachable(body, lines.withColumn("target", target))


@query
def j10_affiliations_of_people(spark, sf_dir):
    return notes.affiliations_of(a.people(spark, sf_dir), a.affiliations(spark, sf_dir)).select("pkg_id", "person", F.col("position").cast("int").alias("position"), "affiliation_id", "name")


@query
def j11_unknown_affiliations(spark, sf_dir):
    return notes.unknown_affiliations(a.people(spark, sf_dir), a.affiliations(spark, sf_dir)).select("pkg_id", "person", "position", "affiliation_id")


@query
def j12_unused_affiliations(spark, sf_dir):
    return notes.unused_affiliations(a.people(spark, sf_dir), a.affiliations(spark, sf_dir)).select("pkg_id", "affiliation_id", "name")


@query
def j13_unmatched_signatures(spark, sf_dir):
    names = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ADA  "), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.upper("c_name")).otherwise(F.concat("c_name", F.lit("x")))
    signatures = a.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("pkg_id"), F.col("c_custkey").alias("at"), names.alias("name"))
    return metadata.unmatched_signatures(signatures, a.people(spark, sf_dir)).select("pkg_id", "at", "name")


@query
def j04_relation_lookup(spark, sf_dir):
    lines = a.table(spark, sf_dir, "lineitem")
    relations = lines.select((F.col("l_orderkey") % 50).alias("pkg_id"), F.lit("document").alias("part"), (F.col("l_suppkey") % 20).alias("relation_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"), F.col("l_partkey").alias("target")).groupBy("pkg_id", "part", "relation_id", "sequence").agg(F.min("target").alias("target"))
    uses = a.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("pkg_id"), F.lit("document").alias("part"), (F.col("o_custkey") % 25).alias("relation_id"), F.col("o_orderkey").alias("used_by"))
    return notes.resolved_relations(uses, relations).select("pkg_id", "relation_id", "used_by", "target", "duplicate")


@query
def j02_numbering(spark, sf_dir):
    rows = a.list_paragraphs(spark, sf_dir).where("raw_id is not null")
    return numbering.resolved_numbering(rows, *a.numbering_tables(spark, rows), once=True)


@query
def l10_refused_numbering(spark, sf_dir):
    return numbering.refused_numbering(j02_numbering(spark, sf_dir))


@query
def j03_style_chains(spark, sf_dir):
    parts = a.table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("pkg_id"), F.floor(F.col("p_partkey") / 20).alias("k"))
    up = F.when(F.col("k") % 9 == 0, F.lit(None)).when(F.col("k") % 13 == 1, F.col("k") + 1).otherwise(F.col("k") - 1)
    styles = parts.select("pkg_id", F.concat(F.lit("s"), "k").alias("style_id"), F.concat(F.lit("s"), up.cast("long")).alias("based_on"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("n"), "k")).alias("raw_id"))
    return numbering.inherited_numbering(styles).select("pkg_id", "style_id", "outcome", "raw_id")


@query
def l01_list_items(spark, sf_dir):
    """Line items as blocks of documents: items of a few numbers and levels, paragraphs that may continue them, figures, others, gaps."""
    found = lists.list_items(a.listed_blocks(spark, sf_dir))
    return found.select("pkg_id", "index", "list_id", "path", "part", F.array_join("codes", ",").alias("codes"), "reason")


@query
def a05_distinct_diagnostics(spark, sf_dir):
    found = a.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("pkg_id"), F.col("event_id").alias("sequence"), F.when(F.col("event_id") % 2 == 0, "inspection").otherwise("editorial").alias("origin"), F.when(F.col("event_type") == "error", "multiple_docx_titles").otherwise(F.col("event_type")).alias("code"), F.lit("warning").alias("severity"), (F.col("user_id") % 3).alias("index"))
    return diagnostics.distinct_diagnostics(found).select("pkg_id", "sequence", "origin", "code", "index")


@query
def f18_converted(spark, sf_dir):
    events = a.table(spark, sf_dir, "events")
    issues = events.select((F.col("user_id") % 2000).alias("pkg_id"), F.when(F.col("event_id") % 40 == 0, "unsupported_drawing").otherwise("comments_not_inspected").alias("code"))
    return diagnostics.converted(events.select((F.col("user_id") % 2000).alias("pkg_id")).distinct(), diagnostics.blocking(issues))


@query
def m09_identifiers(spark, sf_dir):
    return metadata.checked_identifiers(a.identifier_rows(spark, sf_dir)).select("pkg_id", "position", "type", "code")


@query
def a08_repeated_identifiers(spark, sf_dir):
    return metadata.repeated_identifiers(a.identifier_rows(spark, sf_dir))


@query
def m10_orcid(spark, sf_dir):
    return a.identifier_rows(spark, sf_dir).where("type = 'local'").select("position", ids.orcid(F.col("value")).alias("orcid"))


@query
def m11_doi(spark, sf_dir):
    return a.identifier_rows(spark, sf_dir).where("type = 'doi'").select("position", ids.doi(F.col("value")).alias("doi"))


@query
def m12_isbn(spark, sf_dir):
    return a.identifier_rows(spark, sf_dir).where("type like 'isbn%'").select("position", ids.isbn(F.col("value")).alias("isbn"))


@query
def m13_issn(spark, sf_dir):
    return a.identifier_rows(spark, sf_dir).where("type like '%issn'").select("position", ids.issn(F.col("value")).alias("issn"))


@query
def a07_repeated_ids(spark, sf_dir):
    rows = a.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("pkg_id"), F.concat(F.lit(" "), "c_mktsegment").alias("id"))
    return metadata.repeated_ids(rows, "id")


@query
def a09_similar_keywords(spark, sf_dir):
    word = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.regexp_replace("p_name", " ", "  "))
    rows = a.table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("pkg_id"), F.col("p_partkey").alias("position"), word.alias("keyword"))
    return metadata.similar_keywords(rows)


@query
def m14_licenses(spark, sf_dir):
    key = F.col("s_suppkey")
    names = F.get(F.array(*(F.lit(x[0]) for x in metadata.LICENSES), F.lit("MIT"), F.lit(None)), (key % 9).cast("int"))
    rows = a.table(spark, sf_dir, "supplier").select(key.alias("pkg_id"), names.alias("spdx_id"), F.when(key % 4 == 0, "CC BY 4.0").alias("name"), F.when(key % 5 == 0, "https://x.org").alias("url"))
    return metadata.resolved_licenses(rows)


@query
def m01_typed_json(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.col("props")).when(F.col("event_id") % 5 == 1, '{"k":"x"}').when(F.col("event_id") % 5 == 2, "{}").when(F.col("event_id") % 5 == 3, '{"k":true}').otherwise("{broken")
    return metadata.typed_fields(a.table(spark, sf_dir, "events").select("event_id", raw.alias("json")), "json", {"k": "BIGINT"})


@query
def m05_record_rules(spark, sf_dir):
    """Records read from JSON and judged by all rules."""
    k = F.col("s_suppkey")
    source = F.struct(F.lit("a.docx").alias("path"), F.when(k % 3 == 0, "x").otherwise(F.repeat(F.lit("0"), 64)).alias("sha256"))
    about = F.struct(F.when(k % 4 == 0, "f").otherwise("fr").alias("language"), F.when(k % 5 == 0, " ").otherwise(F.col("s_name")).alias("title"))
    nobody = F.array().cast("array<string>")
    record = F.struct(F.lit("2.0").alias("schema_version"), source.alias("source_document"), about.alias("document"), nobody.alias("contributors"), nobody.alias("affiliations"), F.struct((k % 7).alias("from"), F.lit(5).alias("to")).alias("pagination"))
    rows = a.dealt(a.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")).select(k.alias("pkg_id"), F.to_json(record).alias("json"))
    return record_rules.violations(records.decoded_records(rows)).select("pkg_id", "code", "severity", "path")


@query
def m23_partial_dates(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    text = F.when(F.col("event_id") % 5 == 0, F.substring(day, 1, 4)).when(F.col("event_id") % 5 == 1, F.substring(day, 1, 7)).when(F.col("event_id") % 5 == 2, day).when(F.col("event_id") % 5 == 3, F.concat(F.substring(day, 1, 5), F.lit("02-"), F.lpad((F.col("event_id") % 31 + 1).cast("string"), 2, "0"))).otherwise(F.concat(day, F.lit("T")))
    return a.table(spark, sf_dir, "events").select("event_id", text.alias("value"), ids.partial_date(text).alias("valid"))


@query
def m22_language_tags(spark, sf_dir):
    tag = F.when(F.col("doc_id") % 4 == 0, F.concat("lang", F.lit("-FR"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" "), "lang")).when(F.col("doc_id") % 4 == 2, F.concat("lang", F.lit("_x"))).otherwise(F.col("lang"))
    return a.table(spark, sf_dir, "documents").select("doc_id", ids.language_tag(tag).alias("valid"), ids.primary_language(tag).alias("primary"))


@query
def m30_web_addresses(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?:", "ftp:")).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "//.*", "//")).otherwise(F.concat(F.lit(" "), "url"))
    return a.table(spark, sf_dir, "pages").select("page_id", ids.web_address(url).alias("valid"))


@query
def p04_strict_numbers(spark, sf_dir):
    number = ids.strict_number(F.col("raw_id"))
    return a.list_paragraphs(spark, sf_dir).select("pkg_id", "index", number["present"].alias("present"), number["valid"].alias("valid"), number["canonical"].alias("canonical"))


@query
def p09_switches(spark, sf_dir):
    value = F.when(F.col("l_partkey") % 5 == 0, "FALSE").when(F.col("l_partkey") % 5 == 1, "0").when(F.col("l_partkey") % 5 == 2, "yes")
    rows = a.table(spark, sf_dir, "lineitem").select(F.col("l_partkey") % 7 == 0, ids.on_off(F.col("l_partkey") % 7 != 0, value).alias("on"))
    return rows.groupBy("on").agg(F.count(F.lit(1)).alias("n"))


@query
def p19_affiliation_text(spark, sf_dir):
    rows = a.table(spark, sf_dir, "nation").join(a.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, " ").otherwise("Unit").alias("unit"), F.when(F.col("n_nationkey") % 3 == 0, " Town ").alias("city"), F.col("r_name").alias("country"))
    return rows.select("n_nationkey", metadata.affiliation_text("name", "unit", "city", "country").alias("text"))


@query
def s26_distinct_content(spark, sf_dir):
    """Content-addressed storage: every distinct content once, with its size and how many documents use it."""
    docs = a.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.first("size").alias("size"), F.count(F.lit(1)).alias("uses"))


@query
def p01_plain_text(spark, sf_dir):
    words = a.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pkg_id"), F.col("turn").alias("index"), F.posexplode(F.split("text", " ")).alias("item", "text"))
    kinds = F.get(F.array(*(F.lit(k) for k in ("text", "tab", "text", "break", "text", "footnote_reference", "drawing"))), F.col("item") % 7)
    items = words.withColumns({"kind": kinds, "break_type": F.when(F.col("item") % 2 == 0, "line").otherwise("page"), "reference_id": F.col("item").cast("string")})
    return inline.plain_text(items)


@query
def w17_spans(spark, sf_dir):
    words = a.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pkg_id"), F.col("turn").alias("index"), F.posexplode(F.split("text", " ")).alias("item", "text"))
    bold = F.floor(F.col("item") / 3) % 2 == 0
    items = words.withColumns({"kind": F.when(F.col("item") % 10 == 9, "tab").otherwise("text"), "marks": F.when(bold, "bold").otherwise(""), "link": F.when(F.col("item") % 12 > 9, "x"), "language": F.lit("fr")})
    return inline.spans(items).select("pkg_id", "index", "kind", "marks", "link", "text")


@query
def s01_package_paragraphs(spark, sf_dir):
    """Documents written as packages and read again."""
    from quire.sources.packages import body_paragraphs, decoded

    # three tables of each package are read, so it is taken apart once and written
    packages = written(decoded(a.packages(spark, sf_dir)).select("pkg_id", "paragraphs", "items", "styles"), "packages")
    rows = roles.with_roles(body_paragraphs(packages))
    return rows.select(F.col("pkg_id").cast("long").alias("pkg_id"), "index", "text", "style_id", "role", "level")


@query
def t08_body_xml(spark, sf_dir):
    return tei.body_xml(roled(spark, sf_dir)).select("pkg_id", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), F.length("body").cast("long").alias("n_chars"))


@query
def t07_collective_texts(spark, sf_dir):
    """Documents as bodies or, of collective volumes, as groups of texts."""
    found = tei.text_xml(a.collective_lines(spark, sf_dir))
    return found.select("pkg_id", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), F.length("body").cast("long").alias("n_chars"))


@query
def t07_collective_problems(spark, sf_dir):
    return blocks.collective_problems(a.collective_lines(spark, sf_dir))


@query
def w21_signature_suggestions(spark, sf_dir):
    return blocks.signature_suggestions(a.signed_lines(spark, sf_dir))


@query
def m09_identifier_rules(spark, sf_dir):
    """All rules over the identifiers of each record: each by itself, then those that repeat an earlier one."""
    rows = a.identifier_rows(spark, sf_dir)
    each = rows.withColumn("pkg_id", F.floor(F.col("position") / 32)).groupBy("pkg_id").agg(F.array_sort(F.collect_list(F.struct("position", "type", "format", "value"))).alias("identifiers"))
    found = each.select("pkg_id", F.explode(record_rules.identifier_rules()).alias("_f"))
    return found.select("pkg_id", "_f.code", "_f.severity", "_f.path")


@query
def m24_inconsistencies(spark, sf_dir):
    """Where customers' records differ from what their packages say: documents of the same numbers, signed lines among them."""
    own = a.record_texts(spark, sf_dir)
    lines = blocks.opened(a.signed_lines(spark, sf_dir))
    signed = blocks.signature_suggestions(lines.withColumn("text", F.when(F.col("index") % 3 == 0, F.concat(F.lit("name  "), "pkg_id")).otherwise(F.col("text"))))
    names = signed.groupBy("pkg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]).alias("signatures"))
    k = F.col("doc_id")
    said = a.table(spark, sf_dir, "documents").select(
        k.alias("pkg_id"), F.when(k % 2 == 0, "a.docx").otherwise("b.docx").alias("file_name"), F.repeat(F.when(k % 3 == 0, "0").otherwise("1"), F.lit(64)).alias("sha256"),
        F.when(k % 5 == 0, "Title").alias("title"), F.when(k % 5 < 2, 'On "terms"').alias("subtitle"),
    )
    return record_rules.inconsistencies(records.decoded_records(own), said.join(names, "pkg_id", "left"))


@query
def t02_record_headers(spark, sf_dir):
    """Records read from JSON, each written as the header of its book."""
    return header.record_header(records.decoded_records(a.record_texts(spark, sf_dir)))


@query
def t02_header_losses(spark, sf_dir):
    """What records say and their headers do not, and what has no place there."""
    return header.losses(records.decoded_records(a.record_texts(spark, sf_dir)))


@query
def t01_document_xml(spark, sf_dir):
    """Whole documents of those whose paragraphs raise no error, with the problems the validator finds in them."""
    rows = roled(spark, sf_dir)
    docs = a.table(spark, sf_dir, "documents")
    nothing = {"subtitle": "string", "publisher": "string", "date": "string", "license_name": "string", "license_url": "string"}
    people = F.array(F.struct(F.lit("author").alias("role"), F.lit("Ada").alias("given_name"), F.col("source").alias("family_name"), F.lit(None).cast("string").alias("literal_name"), F.lit("0000-0002-1825-0097").alias("orcid")))
    numbers = F.array(F.struct(F.lit("doi").alias("type"), F.lit(None).cast("string").alias("format"), F.concat(F.lit("doi:10.1234/a"), "doc_id").alias("value")))
    about = docs.select(F.col("doc_id").alias("pkg_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("lang").alias("language"), people.alias("people"), numbers.alias("identifiers"), F.array("source").alias("keywords"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    errors = roles.style_diagnosis(rows)
    written_docs = tei.documents(tei.header_xml(about), tei.text_xml(rows), errors.unionByName(blocks.collective_problems(rows), allowMissingColumns=True))
    problems = validation.validated(written_docs).groupBy(F.col("pkg_id").cast("long").alias("pkg_id")).agg(F.count(F.lit(1)).alias("n_problems"))
    return written_docs.join(problems, "pkg_id", "left").select("pkg_id", "xml", F.coalesce("n_problems", F.lit(0)).alias("n_problems"))


@query
def t10_nested_notes(spark, sf_dir):
    """Every note with all notes inside it; those in a cycle, or that lead to one, are left out."""
    texts, inner, _ = a.nested_notes(spark, sf_dir)
    found = notes.nested(texts, inner, tei.note_token)
    return found.select("pkg_id", "note_id", F.sha2(F.col("xml").cast("binary"), 256).alias("sha256"), F.length("xml").cast("long").alias("n_chars"))


@query
def j19_note_cycles(spark, sf_dir):
    """Notes reached from bodies, and whether a cycle of notes is entered there."""
    texts, inner, body = a.nested_notes(spark, sf_dir)
    reached, entered = notes.cycles(body, inner, texts.select("pkg_id", "note_id"))
    return reached.join(entered.withColumn("entered", F.lit(True)), ["pkg_id", "note_id"], "left").select("pkg_id", "note_id", F.coalesce("entered", F.lit(False)).alias("entered"))


@query
def e03_table_problems(spark, sf_dir):
    lines = a.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pkg_id"), F.col("l_linenumber").cast("int").alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col")).agg(F.count(F.lit(1)).cast("int").alias("n_filled"), F.min("l_partkey").alias("p"))
    cells = lines.select("pkg_id", F.lit(0).alias("block"), "row", "col", "n_filled", F.when(F.col("p") % 23 == 0, 2).alias("grid_span"), (F.col("p") % 29 == 0).alias("merged"), (F.col("p") % 31 == 0).alias("nested"), (F.col("p") % 5 == 0).alias("header"))
    return tables.table_problems(cells)


@query
def w12_figures(spark, sf_dir):
    lines = a.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pkg_id"), F.posexplode(F.split("text", "\n")).alias("index", "text"))
    at, k = (F.col("pkg_id") + F.col("index")) % 6, F.col("pkg_id")
    style = F.when((at == 0) & (k % 3 == 0), "TEIfiguretitle").when(at == 2, F.when(k % 2 == 0, "Caption").otherwise("TEIfigurecaption")).when((at == 3) & (k % 5 > 0), "Caption").when((at == 4) | ((at == 3) & (k % 5 == 0)), "TEIfigurecredits")
    return figures.figures(lines.select("pkg_id", "index", style.alias("style_id"), (at == 1).cast("int").alias("drawing_count")))
