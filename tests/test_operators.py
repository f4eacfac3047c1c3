"""The library's own operators on small rows made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.functions.names import folded
from quire.operators import blocks, inline, lists, metadata, numbering, roles, tei, validation
from quire.sources.packages import body_paragraphs, decode, decoded, exploded

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def package(body="", **parts):
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, content in parts.items():
            archive.writestr(name.replace("__", "/") + ("" if name.startswith("word__media") else ".xml"), content)
    return file.getvalue()


def rows(spark, *made):
    return spark.createDataFrame([(1, i, *m) for i, m in enumerate(made)], "pkg_id long, index int, text string, style_id string, style_name string, style_is_custom boolean, outline_level int")


def styled(spark, *pairs):
    return roles.with_roles(rows(spark, *((text, style, None, None, None) for style, text in pairs)))


def test_role_ladder(spark):
    made = [("a", "Heading2", None, None, 0), ("b", "BodyText", None, True, None), ("c", "Corps", "Corps  de TEXTE", None, None), ("d", "BodyText2", "Body Text", None, None), ("e", "Own", None, True, 3), ("f", None, None, None, None), ("g", "Own", None, True, 7)]
    got = roles.with_roles(rows(spark, *made)).orderBy("index").collect()
    assert [(r.role, r.level, r.rendition) for r in got] == [("heading", 2, None), ("unsupported", None, None), ("paragraph", None, "consecutive"), ("unsupported", None, None), ("heading", 4, None), ("paragraph", None, None), ("unsupported", None, None)]
    aliased = roles.Convention().with_aliases({"Zitat": "Quote", "Normal": "Quote"})
    assert aliased.roles["Zitat"] == ("prose_quote", None) and aliased.roles["Normal"] == ("paragraph", None)


def test_signature_and_sources(spark):
    got = styled(spark, ("Normal", "x"), ("Signature", "A"), ("Signature", " "), ("Signature", "B"), ("Normal", ""), ("Heading1", "h"), ("Signature", "C"), ("Normal", "y"), ("Signature", "1"), ("Signature", "2"), ("Signature", "3"))
    assert [(r.start, r.n_lines, r.refused) for r in blocks.signature_runs(got).orderBy("start").collect()] == [(1, 2, None), (6, 1, "not_terminal"), (8, 3, "too_long")]
    got = styled(spark, ("Quote", "q"), ("Quote", "r"), ("TEIbiblreference", "s"), ("TEIbiblreference", "t"), ("IntenseQuote", "v"))
    assert [(r.start, r.source_index, r.has_second) for r in blocks.sourced_quotes(got).orderBy("start").collect()] == [(0, 2, True), (4, None, False)]


def test_bibliography_begins_at_the_heading_before_it(spark):
    got = styled(spark, ("Normal", "x"), ("Heading1", "Works"), ("Normal", " "), ("Bibliography", "b"), ("Normal", "intruder"), ("Bibliography", "c"))
    r = blocks.bibliography_cut(got).first()
    assert (r.cut, r.n_entries, r.n_intruders) == (1, 2, 1)


@pytest.mark.parametrize(("value", "orcid", "doi", "isbn", "issn"), [
    ("https://orcid.org/0000-0002-1825-0097", "0000-0002-1825-0097", None, None, None), ("0000-0002-1694-233X", "0000-0002-1694-233X", None, None, None), ("0000-0002-1825-0098", None, None, None, None),
    ("DOI:10.1234/ab", None, "10.1234/ab", None, None), ("https://dx.doi.org/10.12345/x", None, "10.12345/x", None, None), ("10.12/x", None, None, None, None),
    ("978-2-07-036024-6", None, None, "9782070360246", None), ("0-8044-2957-x", None, None, "080442957X", None), ("9782070360245", None, None, None, None), ("0317-8471", None, None, None, "0317-8471"), ("2434561x", None, None, None, "2434-561X"),
])
def test_check_digits(spark, value, orcid, doi, isbn, issn):
    v = F.col("v")
    r = spark.createDataFrame([(value,)], "v string").select(ids.orcid(v).alias("o"), ids.doi(v).alias("d"), ids.isbn(v).alias("b"), ids.issn(v).alias("s")).first()
    assert (r.o, r.d, r.b, r.s) == (orcid, doi, isbn, issn)


def test_small_values(spark):
    dates = ["2024", "2024-02", "2024-02-30", "2024-02-29", "2024-13", "24", None]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d string").select("i", ids.partial_date(F.col("d")).alias("ok")).orderBy("i")
    assert [r.ok for r in got.collect()] == [True, True, False, True, False, False, False]
    assert spark.createDataFrame([("  Straße  ÉTÉ æ",)], "s string").select(folded("s").alias("f")).first().f == "strasse ete æ"


def test_lists_stack_and_errors(spark):
    made = [(0, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 0), (5, 1, 0), (7, 2, 0), (8, 2, 2), (9, 2, 0), (11, 3, 1), (12, 3, 0)]
    got = listed(spark, [(i, "item", n, level) for i, n, level in made])
    assert [got[i][0] for i in (0, 1, 2, 3)] == ["1:1", "1:1.2:1", "1:1.2:2", "1:2"]
    again = "interrupted_list_continuation_not_serializable"
    assert [got[i][2] for i in (5, 7, 8, 9, 11, 12)] == [[again], [], ["list_level_jump_not_serializable", "list_root_level_normalized"], ["list_root_level_decrease_split"], ["list_root_level_normalized"], ["list_root_level_decrease_split"]]


def listed(spark, made):
    """made: block, class, number, level, and start and emptiness if not 1 and false."""
    rows = [("a", i, i, kind, n, level, *([None] * 3 if kind != "item" else ["ordered", "decimal", rest[0] if rest else 1]), bool(rest[1:] and rest[1])) for i, kind, n, level, *rest in made]
    frame = spark.createDataFrame(rows, "pkg_id string, index int, block int, class string, num_id long, level int, kind string, number_format string, start int, empty boolean")
    return {r["index"]: (r.path, r.part, r.codes, r.reason) for r in lists.list_items(frame).collect()}


def test_items_go_on_behind_list_paragraphs(spark):
    got = listed(spark, [(0, "item", 1, 0), (1, "candidate", None, None), (2, "candidate", None, None), (3, "item", 1, 0), (4, "item", 1, 1), (5, "item", 1, 0)])
    assert [got[i][:2] for i in range(6)] == [("1:1", 0), ("1:1", 1), ("1:1", 2), ("1:2", 0), ("1:2.2:1", 0), ("1:3", 0)] and all(not x[2] for x in got.values())
    item, more = (0, "item", 1, 0), (1, "candidate", None, None)
    after = {"end of sequence": [], "other number": [(2, "item", 2, 0)], "other level": [(2, "item", 1, 1)], "other signature": [(2, "item", 1, 0, 5)]}
    for reason, rest in after.items():
        got = listed(spark, [item, more, *rest])
        assert got[1] == (None, None, ["ambiguous_list_continuation_not_serializable"], reason)
    assert listed(spark, [item, more, (3, "item", 1, 0)])[1][3] == "end of sequence"  # a table between
    assert listed(spark, [item, more, (2, "quiet", None, None), (3, "item", 1, 0)])[1][3] == "end of sequence"
    assert listed(spark, [item, (1, "item", 1, 1), (2, "candidate", None, None), (3, "item", 1, 0)])[2][3] == "other level, behind an inner list"
    assert listed(spark, [item, (1, "rejected", None, None)])[1][3] == "custom style"
    assert 1 not in listed(spark, [(0, "other", None, None), more, (2, "item", 1, 0)])


def test_numbers_are_not_used_again(spark):
    again = "interrupted_list_continuation_not_serializable"
    got = listed(spark, [(0, "item", 1, 0), (1, "item", 2, 1), (2, "item", 1, 0), (3, "item", 2, 1)])  # an inner list closed and opened again
    assert got[3][2] == [again]
    got = listed(spark, [(0, "item", 1, 0), (1, "item", 2, 0), (2, "item", 1, 0)])  # a sibling between
    assert got[1][:3] == ("2:1", 0, []) and got[2][2] == [again]
    assert listed(spark, [(0, "item", 1, 0), (1, "quiet", None, None), (2, "item", 1, 0)])[2][2] == []
    assert listed(spark, [(0, "item", 1, 0), (1, "other", None, None), (2, "item", 1, 0)])[2][2] == [again]
    assert listed(spark, [(0, "item", 1, 0), (2, "item", 1, 0)])[2][2] == [again]


def test_empty_items(spark):
    got = listed(spark, [(0, "item", 1, 0, 1, True), (1, "item", 1, 1, 1, True), (2, "item", 1, 0, 1, True), (3, "candidate", None, None), (4, "item", 1, 0)])
    assert [got[i][2] for i in (0, 1, 2, 3, 4)] == [["empty_parent_list_item"], ["empty_list_item_not_serializable"], ["empty_list_item_not_serializable"], [], []]
    assert lists.list_problems(lists.list_items(spark.createDataFrame([], "pkg_id string, index int, block int, class string, num_id long, level int, kind string, number_format string, start int"))).count() == 0


def test_packages_share_equal_numbering_and_a_code_is_found_once(spark):
    rows = spark.createDataFrame([(pkg, i, raw, level) for pkg in (1, 2, 3, 4, 5, None) for i, (raw, level) in enumerate([("1", "0"), ("01", None), ("2", "1"), ("x", "0"), ("0", "0"), ("1", "12"), ("7", "0")])], "pkg_id long, index int, raw_id string, raw_level string")
    instances = spark.createDataFrame([(pkg, num, 10 * num) for pkg in (1, 2, 3, 4, None) for num in (1, 2)], "pkg_id long, num_id long, abstract_id long")
    first, second = ("decimal", None, "7"), ("decimal", 7, None)  # package 2 says the same in another order, 3 and 4 something else
    made = [(1, 10, 0, *first), (1, 20, 1, "", 2, None), (2, 20, 1, "", 2, None), (2, 10, 0, *first), (3, 10, 0, *second), (4, 10, 0, *first), (4, 10, 0, *first)]
    levels = spark.createDataFrame(made, "pkg_id long, abstract_id long, level int, number_format string, start int, picture string")
    overrides = spark.createDataFrame([(1, 1, 0, 5), (2, 1, 0, 5), (3, 1, 0, 5)], "pkg_id long, num_id long, level int, start_override int")
    tables = (instances, levels, overrides)
    plain, shared = (numbering.resolved_numbering(rows, *tables, once=once) for once in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, shared.collect()))
    assert plain.where("pkg_id = 4").count() == 10 and shared.where("pkg_id = 3 and index = 0").first().start == 5
    parts = {r.pkg_id: (r.high, r.low) for r in numbering.numbering_parts(*tables).collect()}
    assert parts[1] == parts[2] and len(set(parts.values())) == 4
    plan = numbering.refused_numbering(plain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("picture_bullet_not_supported AS") + plan.count("THEN picture_bullet_not_supported") == 1


def test_lists_are_found_in_one_sorted_pass(spark):
    kind = "pkg_id string, index int, block int, class string, num_id long, level int, kind string, number_format string, start int, empty boolean"
    rows = [(pkg, i, i, "item", 1, level, "ordered", "decimal", 1, empty) for pkg in (None, "a") for i, (level, empty) in enumerate([(0, True), (1, False), (0, True)])]
    found = lists.list_items(spark.createDataFrame(rows, kind))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1
    got = {(r.pkg_id, r["index"]): r.codes for r in found.collect()}
    for pkg in (None, "a"):  # what comes last in one document says nothing of the next
        assert [got[pkg, i] for i in range(3)] == [["empty_parent_list_item"], [], ["empty_list_item_not_serializable"]]


def test_spans_merge_and_marks(spark):
    items = spark.createDataFrame([(1, 0, 0, "text", "a", "b", None, "fr"), (1, 0, 1, "text", "", "", None, None), (1, 0, 2, "text", "c", "b", None, "fr"), (1, 0, 3, "text", "d", "b", None, "de"), (1, 0, 4, "tab", None, None, None, None)], "pkg_id long, index int, item int, kind string, text string, marks string, link string, language string")
    assert [(r.kind, r.text) for r in inline.spans(items).orderBy("span").collect()] == [("text", "ac"), ("text", "d"), ("tab", "")]
    got = spark.range(1).select(inline.marks(F.array(F.lit("italic"), F.lit("bold")), {"bold": F.lit(False), "caps": F.lit(True), "italic": F.lit(None).cast("boolean")}).alias("m")).first()
    assert got.m == ["italic", "caps"]


def test_profile_fills_blanks(spark):
    docs = spark.createDataFrame([(1, " ", "A"), (2, "P", None)], "pkg_id long, publisher string, place string")
    got = metadata.with_profile(docs, spark.createDataFrame([("House", "Town")], "publisher string, place string")).orderBy("pkg_id").collect()
    assert [(r.publisher, r.place) for r in got] == [("House", "A"), ("P", "Town")]


def test_decoding_a_package(spark):
    body = """<w:p><w:pPr><w:pStyle w:val="Quote"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="01"/></w:numPr></w:pPr><w:r><w:rPr><w:b/><w:i w:val="false"/></w:rPr><w:t>A</w:t><w:tab/><w:t>B</w:t><w:br/></w:r>
        <w:hyperlink r:id="r1"><w:r><w:t>link</w:t><w:footnoteReference w:id="2"/></w:r></w:hyperlink><w:fldSimple><w:r><w:t>, field</w:t></w:r></w:fldSimple></w:p>
        <w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"""
    notes = f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"/><w:footnote w:id="2"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:footnote></w:footnotes>'
    styles = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Quote"><w:name w:val="quote"/></w:style></w:styles>'
    media = b"\x89PNG\r\n\x1a\n..."
    made = package(body, word__footnotes=notes, word__styles=styles, word__comments="<x/>", **{"word__media__a.png": media})
    files = [("ok", made), ("zip", b"no zip"), ("dtd", package(word__styles="<!DOCTYPE x [<!ENTITY x 'boom'>]><x>&x;</x>")), ("bad", package("<broken")), ("null", None)]
    got = decoded(spark.createDataFrame(files, "path string, content binary")).cache()
    assert {r.pkg_id: r.error for r in got.collect()} == {"ok": None, "zip": "unreadable_file", "dtd": None, "bad": "malformed_xml_part", "null": "unreadable_file"}
    one = got.where("pkg_id = 'ok'")
    assert [(r["index"], r.text, r.style_name, r.raw_id) for r in body_paragraphs(one).orderBy("index").collect()] == [(0, "A\tB\nlink[footnote:2], field", "quote", "01"), (1, "", None, None)]
    bold = exploded(one, "items").where("text = 'A'").first()
    assert (bold.bold, bold.italic, bold.caps) == (True, False, None)
    assert exploded(one, "notes").first().text == "one\ntwo" and exploded(one, "cells").first().header
    assert exploded(one, "media").select(ids.image_type(F.col("head")).alias("t")).first().t == "image/png"
    assert [(r.pkg_id, r.code) for r in exploded(got, "issues").orderBy("pkg_id").collect()] == [("dtd", "malformed_xml_part"), ("ok", "comments_not_inspected")]
    assert decode("x", zip_without_document())["error"] == "missing_document_part"


def zip_without_document():
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as archive:
        archive.writestr("word/other.xml", "<x/>")
    return file.getvalue()


def test_body_nesting_and_validation(spark):
    got = styled(spark, ("Normal", "intro"), ("Heading2", "two & <more>"), ("Quote", "q1"), ("Quote", "q2"), ("BodyText", "on"), ("Heading1", "one"), ("IntenseQuote", "l1\nl2"))
    body = tei.body_xml(got).first().body
    assert body == (
        '<body><p>intro</p><div type="part"><div type="chapter"><head>two &amp; &lt;more&gt;</head><quote><p>q1</p><p>q2</p></quote><p rend="consecutive">on</p></div></div>'
        '<div type="part"><head>one</head><quote><lg><l>l1</l><l>l2</l></lg></quote></div></body>'
    )
    wrap = "<TEI><teiHeader><fileDesc><titleStmt><title>t</title></titleStmt><publicationStmt/><sourceDesc/></fileDesc></teiHeader><text>{}</text></TEI>"
    assert validation.problems(wrap.format(body)) == []
    assert [p[0] for p in validation.problems("<TEI>")] == ["xml"] and validation.problems('<!DOCTYPE x><TEI/>')[0][0] == "xml"
    assert any("lg without l" in m for _, m in validation.problems(wrap.format("<body><quote><lg/></quote></body>")))
    assert any("@rend" in m for _, m in validation.problems(wrap.format('<body><p rend="odd"/></body>')))


def test_stream_converts_each_content_once(spark, tmp_path):
    from quire.streaming.incremental import converted_stream, watched_packages

    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    made = package("<w:p><w:r><w:t>x</w:t></w:r></w:p>")
    (folder / "a.docx").write_bytes(made)
    (folder / "b.docx").write_bytes(made)
    run = lambda: converted_stream(watched_packages(spark, str(folder)), lambda d: d.select("sha256", F.size("paragraphs").alias("n")), target, str(tmp_path / "state")).awaitTermination()
    run()
    (folder / "c.docx").write_bytes(made)
    (folder / "d.docx").write_bytes(package("<w:p/><w:p/>"))
    run()
    assert sorted(r.n for r in spark.read.parquet(target).collect()) == [1, 2]


def test_conversion_of_packages(spark):
    from quire.plans.conversion import converted, summary

    fine = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>a &amp; b</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>l</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
    notes = f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:t>see &lt;it&gt;</w:t></w:r></w:p><w:p/></w:footnote></w:footnotes>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="https://x.org" TargetMode="External"/></Relationships>'
    odd = '<w:p><w:pPr><w:pStyle w:val="Own"/></w:pPr><w:r><w:t>x</w:t><w:footnoteReference w:id="9"/></w:r></w:p>'
    files = [("a", package(fine, word___rels__document_xml=rels, word__footnotes=notes)), ("b", package(odd)), ("c", b"-"), ("d", package(fine, word__footnotes=notes))]
    files[0] = ("a", renamed(files[0][1], "word/_rels/document_xml.xml", "word/_rels/document.xml.rels"))
    packages = decoded(spark.createDataFrame(files, "path string, content binary")).cache()
    about = spark.createDataFrame([(p, "T", None, "en", "House", "2024", None, None, [("doi", None, "10.1234/x")], [("author", "Ada", "L", None, None)], ["k"]) for p in "abc"], "pkg_id string, title string, subtitle string, language string, publisher string, date string, license_name string, license_url string, identifiers array<struct<type:string,format:string,value:string>>, people array<struct<role:string,given_name:string,family_name:string,literal_name:string,orcid:string>>, keywords array<string>")
    books, problems = converted(packages, about)
    got = {r.pkg_id: r.xml for r in books.collect()}
    assert list(got) == ["a"] and '<head>One</head><p><hi rend="bold">a &amp; b</hi><ref target="https://x.org">l</ref><note place="foot"><p>see &lt;it&gt;</p></note></p>' in got["a"]
    # an empty paragraph is no content in a note either, and is named
    assert [r["index"] for r in problems.where("pkg_id = 'a' and code = 'empty_paragraph_ignored' and note_id = 'footnote:2'").collect()] == [1]
    assert validation.problems(got["a"]) == []
    assert {(r.pkg_id, r.code) for r in problems.collect()} == {("a", "empty_paragraph_ignored"), ("d", "empty_paragraph_ignored"), ("b", "missing_note_target"), ("b", "unsupported_paragraph_style"), ("c", "unreadable_file"), ("d", "missing_metadata"), ("d", "unresolved_link_not_serializable")}
    assert summary(packages).where("pkg_id = 'a'").first().n_links == 1


def renamed(content, old, new):
    file = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as before, zipfile.ZipFile(file, "w") as after:
        for name in before.namelist():
            after.writestr(new if name == old else name, before.read(name))
    return file.getvalue()


def test_tables_and_figures(spark):
    from quire.operators.figures import figures, media_targets
    from quire.operators.tables import table_problems

    cell = "pkg_id long, block int, row int, col int, n_filled int, grid_span int, merged boolean, nested boolean, header boolean"
    cells = [(1, 0, r, c, 1, None, False, False, r == 0) for r in range(2) for c in range(2)] + [(1, 1, 0, 0, 1, 2, False, False, False)] + [(1, 2, 0, 0, 1, 1, False, False, False), (1, 2, 1, 0, 1, 1, False, False, False), (1, 2, 1, 1, 1, 1, False, False, False)] + [(1, 3, 0, 0, 1, 1, False, False, False), (1, 3, 1, 0, 2, 1, False, False, True)]
    got = {r.block: r.code for r in table_problems(spark.createDataFrame(cells, cell)).collect()}
    assert got == {0: None, 1: "merged_table_cells_not_serializable", 2: "irregular_table_not_serializable", 3: "invalid_table_header_not_serializable"}
    styles = ["TEIfiguretitle", None, "TEIfigurecaption", "TEIfigurecredits", None, "Caption", "Caption", "TEIfigurecredits", None, "Normal"]
    frame = spark.createDataFrame([(1, i, s, int(i in (1, 4, 8))) for i, s in enumerate(styles)], "pkg_id long, index int, style_id string, drawing_count int")
    assert [(r["index"], r.title, r.caption, r.credits) for r in figures(frame).orderBy("index").collect()] == [(1, 0, 2, 3), (4, 5, 6, 7), (8, None, None, None)]
    png = b"\x89PNG\r\n\x1a\n"
    drawings = spark.createDataFrame([(1, "d", i, f"r{i}") for i in range(6)], "pkg_id long, part string, index int, relation_id string")
    relations = spark.createDataFrame([(1, "d", "r0", 0, "media/a.png", None), (1, "d", "r1", 1, "../x.png", None), (1, "d", "r2", 2, "https://x.org/a.png", "External"), (1, "d", "r3", 3, "media/none.png", None), (1, "d", "r4", 4, "media/a.png", None), (1, "d", "r4", 5, "media/b.png", None)], "pkg_id long, part string, relation_id string, sequence int, target string, mode string")
    media = spark.createDataFrame([(1, "word/media/a.png", "ab", "image/png", png)], "pkg_id long, path string, sha256 string, declared_type string, head binary")
    got = [(r.url, r.code) for r in media_targets(drawings, relations, media).orderBy("index").collect()]
    assert got[0] == ("media/ab.png", None) and [c.split("_")[0] for _, c in got[1:]] == ["unsafe", "external", "missing", "duplicate", "missing"]
