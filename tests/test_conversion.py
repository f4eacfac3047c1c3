"""Whole packages converted: all that a document holds is written or refused, never lost."""

import hashlib
import json

import pytest

from quire.operators import validation
from quire.plans.conversion import converted
from quire.sources.packages import decoded
from quire.sources.records import decoded_records

from test_operators import W, package, renamed

WP = 'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
PNG = b"\x89PNG\r\n\x1a\n..."


def p(text="", style=None, props="", inner=""):
    style = f'<w:pStyle w:val="{style}"/>' if style else ""
    run = f"<w:r><w:t>{text}</w:t></w:r>" if text else ""
    return f"<w:p><w:pPr>{style}{props}</w:pPr>{run}{inner}</w:p>"


def number(level, num=1):
    return f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>'


def image(description="A tree", relation="r9"):
    return f'<w:r><w:drawing><wp:inline {WP}><wp:extent cx="5" cy="5"/><wp:docPr id="1" descr="{description}"/><a:blip r:embed="{relation}"/></wp:inline></w:drawing></w:r>'


TABLE = '<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc>{0}</w:tc><w:tc>{1}</w:tc></w:tr><w:tr><w:tc>{2}</w:tc><w:tc>{3}</w:tc></w:tr></w:tbl>'
NUMBERING = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="2"><w:start w:val="1"/><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
STYLES = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Titre1"><w:name w:val="Titre 1"/></w:style><w:style w:type="paragraph" w:customStyle="1" w:styleId="TEIbiblreference"><w:name w:val="TEI_bibl_reference"/></w:style><w:style w:type="character" w:customStyle="1" w:styleId="TEIbiblreference-inline"><w:name w:val="TEI_bibl_reference-inline"/></w:style></w:styles>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r9" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/a.png"/></Relationships>'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="png" ContentType="image/png"/></Types>'


def made(body, numbering=NUMBERING, **parts):
    content = package(body, word__numbering=numbering, word__styles=STYLES, word___rels__document_xml=RELS, types=TYPES, **{"word__media__a.png": PNG}, **parts)
    return renamed(renamed(content, "word/_rels/document_xml.xml", "word/_rels/document.xml.rels"), "types.xml", "[Content_Types].xml")


MC = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def overridden(level):
    """The numbering with one more instance, whose first level says something else."""
    return NUMBERING.replace("</w:numbering>", f'<w:num w:numId="7"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:lvl w:ilvl="0">{level}</w:lvl></w:lvlOverride></w:num></w:numbering>')


def run(text, look=""):
    return f"<w:r><w:rPr>{look}</w:rPr><w:t>{text}</w:t></w:r>"


def ref(note, kind="footnote"):
    return f'<w:r><w:{kind}Reference w:id="{note}"/></w:r>'


def footnotes(**texts):
    return f'<w:footnotes {W}>' + "".join(f'<w:footnote w:id="{k[1:]}">{x}</w:footnote>' for k, x in texts.items()) + "</w:footnotes>"


def with_notes(body, **texts):
    links = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/hyperlink" Target="https://x.org" TargetMode="External"/></Relationships>'
    content = made(body, word__footnotes=footnotes(**texts), word___rels__footnotes_xml=links)
    return renamed(content, "word/_rels/footnotes_xml.xml", "word/_rels/footnotes.xml.rels")


def listed(n, text, level=0, num=1):
    return p(text, "ListParagraph", number(level, num)) if n else p(text, "ListParagraph")


@pytest.fixture(scope="module")
def outcome(spark):
    whole = (
        p("Start", "Titre1") + p() + p("Said", "Quote") + p("By me", "TEIbiblreference") + p("one", props=number(0)) + p("inner", props=number(1)) + p("two", props=number(0))
        + TABLE.format(p("h1"), p("h2"), p("c"), p()) + p("", "Normal", inner=image()) + p("Its caption", "Caption")
        + p("x ", inner='<w:fldSimple><w:r><w:t>field</w:t></w:r></w:fldSimple>') + p("Ada L.", "Signature") + p("Sources", "Heading1") + p("A book", "Bibliography")
    )
    files = {
        "whole": made(whole),
        "empty": made(""),
        "tab": made(p("a", inner="<w:r><w:tab/><w:t>b</w:t></w:r>")),
        "page": made(p("a", inner='<w:r><w:br w:type="page"/></w:r>')),
        "link": made(p("a", inner='<w:hyperlink w:anchor="there"><w:r><w:t>b</w:t></w:r></w:hyperlink>')),
        "nested": made(TABLE.format(p("a"), p("b"), p("c"), p("d") + p("e"))),
        "plain_image": made(p(inner=image(description=""))),
        "pict": made(p("a", inner="<w:r><w:pict/></w:r>")),
        "twice": made(p("a", "Signature") + p("b", "Signature") + p("c", "Signature")),
        "caption": made(p("a", "Caption")),
        "styled": made(p("a", "Heading1", props=number(0))),
        "notes": with_notes(
            p("a", inner=ref(1) + ref(2) + ref(1)),
            n1=p(inner=run("it", "<w:i/>") + '<w:hyperlink r:id="r1" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:r><w:t>l</w:t></w:r></w:hyperlink>' + ref(3)) + p("Said", "Quote"),
            n2=p("one", props=number(0)) + p("two", props=number(0)), n3=p("deep &lt;", "FootnoteText", inner=ref(4)), n4="", n5=p("Alone", "Heading1"),
        ),
        "circle": with_notes(p("a", inner=ref(1)), n1=p("b", inner=ref(2)), n2=p("c", inner=ref(1)), n3=p("d", inner=ref(3))),
        "head_note": with_notes(p("a", inner=ref(1)), n1=p("b", "Heading2")),
        "tab_note": with_notes(p("a", inner=ref(1)), n1=p("b", inner="<w:r><w:tab/></w:r>")),
        "image_note": with_notes(p("a", inner=ref(1)), n1=p("b", inner=image())),
        "table_note": with_notes(p("a", inner=ref(1)), n1=TABLE.format(p("a"), p("b"), p("c"), p("d"))),
        "lost_note": with_notes(p("a", inner=ref(9)), n1=p("b")),
        "box": made(p("a", inner=f'<w:r><mc:AlternateContent {MC}><mc:Choice Requires="wps"><w:drawing><w:txbxContent>{p("boxed")}</w:txbxContent></w:drawing></mc:Choice></mc:AlternateContent></w:r>')),
        "choice": made(p(inner=image().replace("<w:drawing>", f'<mc:AlternateContent {MC}><mc:Choice Requires="x"><w:drawing>').replace("</w:drawing>", "</w:drawing></mc:Choice><mc:Fallback/></mc:AlternateContent>"))),
        "table_behind": made(p("a") + p("Sources", "Heading1") + p("A book", "Bibliography") + TABLE.format(p("a"), p("b"), p("c"), p("d"))),
        "cell_style": made(TABLE.format(p("a", "Heading1"), p("b"), p("c"), p("d"))),
        "cell_quote": made(TABLE.format(p("a", "Quote"), p("b"), p("c"), p("d"))),
        "cell_number": made(TABLE.format(p("a", props=number(0)), p("b"), p("c"), p("d"))),
        "odd_run": made(p("a", inner=run("b", '<w:rStyle w:val="Odd"/>'))),
        "cited": made(p("See ", inner=run("A ", '<w:rStyle w:val="TEIbiblreference-inline"/>') + run("B", '<w:rStyle w:val="TEIbiblreference-inline"/><w:i/>') + run(".") + run("C", '<w:rStyle w:val="TEIbiblreference-inline"/>'))),
        "cited_twice": made(p("By me", "TEIbiblreference", inner=run("A", '<w:rStyle w:val="TEIbiblreference-inline"/>'))),
        "goes_on": made(listed(1, "one") + listed(0, "more") + listed(1, "two") + listed(1, "inner", 1)),
        "goes_nowhere": made(listed(1, "one") + listed(0, "more") + p("end")),
        "again": made(listed(1, "one") + p("between") + listed(1, "two")),
        "jump": made(listed(1, "one") + listed(1, "two", 2)),
        "restart": made(listed(1, "one"), NUMBERING.replace('<w:start w:val="1"/>', '<w:start w:val="1"/><w:lvlRestart w:val="0"/>')),
        "legal": made(listed(1, "one"), NUMBERING.replace('<w:start w:val="1"/>', '<w:start w:val="1"/><w:isLgl/>')),
        "own_restart": made(listed(1, "one", num=7), overridden('<w:lvlRestart w:val="0"/>')),
        "own_format": made(listed(1, "one", num=7), overridden('<w:numFmt w:val="upperRoman"/><w:start w:val="4"/>')),
        "empty_item": made(listed(1, "one") + listed(1, "")),
        "volume": made(p("Preface") + p("One", "Heading2") + p("In", "Heading3") + p("x") + p("deep", "Heading5") + p("Said", "Quote") + p("A. B.", "Signature") + p("House", "Signature") + p("Two", "Heading2") + p("Said", "Quote") + p("Sources", "Heading1") + p("A book", "Bibliography")),
        "volume_table": made(TABLE.format(p("a"), p("b"), p("c"), p("d")) + p("One", "Heading2") + p("Two", "Heading2")),
        "volume_part": made(p("Part", "Heading1") + p("One", "Heading2") + p("x") + p("Two", "Heading2")),
        "chapter": made(p("One", "Heading2") + p("x")),
        "empty_parent": made(listed(1, "") + listed(1, "in", 1)),
    }
    packages = decoded(spark.createDataFrame(list(files.items()), "path string, content binary"))
    people = "array<struct<role:string,given_name:string,family_name:string,literal_name:string,orcid:string>>"
    about = spark.createDataFrame([(k, "T", None, "en", "House", "2024", None, None, [], [], ["k"]) for k in files], f"pkg_id string, title string, subtitle string, language string, publisher string, date string, license_name string, license_url string, identifiers array<struct<type:string,format:string,value:string>>, people {people}, keywords array<string>")
    books, problems = converted(packages, about)
    found = problems.collect()
    return {r.pkg_id: r.xml for r in books.collect()}, {(r.pkg_id, r.code) for r in found if r.severity == "error"}, {(r.pkg_id, r.code, r.note_id) for r in found}


def test_everything_is_written(outcome):
    xml, problems, _ = outcome
    assert {c for k, c in problems if k == "whole"} == set()
    body = xml["whole"].split("<text>")[1]
    assert body.startswith(
        '<body><div type="part"><head>Start</head><cit><quote><p>Said</p></quote><bibl>By me</bibl></cit>'
        '<list type="decimal" n="1"><item>one<list type="bulleted"><item>inner</item></list></item><item>two</item></list>'
        '<table rows="2" cols="2"><row role="label"><cell role="label">h1</cell><cell role="label">h2</cell></row><row><cell>c</cell><cell></cell></row></table><figure><graphic url="media/'
    )
    assert '<figDesc>A tree</figDesc><p rend="caption">Its caption</p></figure><p>x field</p><p>Ada L.</p></div></body>' in body
    assert body.endswith('<back><div type="bibliography"><head>Sources</head><listBibl><bibl>A book</bibl></listBibl></div></back></text></TEI>\n')
    assert validation.problems(xml["whole"]) == [] and "<body></body>" in xml["empty"]


@pytest.mark.parametrize(
    "package, code",
    [
        ("tab", "tab_not_serializable"), ("page", "page_or_column_break_not_serializable"), ("link", "internal_link_not_serializable"), ("nested", "multiple_paragraph_table_cell_not_serializable"),
        ("plain_image", "missing_figure_description"), ("pict", "mixed_text_and_image_not_serializable"), ("twice", "misplaced_signature_not_serializable"),
        ("caption", "orphan_figure_caption_not_serializable"), ("styled", "numbered_nonparagraph_style_not_serializable"),
        ("circle", "cyclic_note_reference"), ("head_note", "heading_in_note_not_serializable"), ("tab_note", "tab_not_serializable"), ("image_note", "mixed_text_and_image_not_serializable"), ("table_note", "table_in_note_not_serializable"),
        ("lost_note", "missing_note_target"), ("box", "textboxes_not_inspected"), ("table_behind", "nonterminal_bibliography_not_serializable"), ("cell_style", "unsupported_table_cell_style"), ("cell_quote", "unsupported_table_cell_content"),
        ("cell_number", "numbered_table_cell_not_serializable"), ("odd_run", "unsupported_character_style"), ("cited_twice", "nested_bibliographic_reference_not_serializable"), ("goes_nowhere", "ambiguous_list_continuation_not_serializable"),
        ("again", "interrupted_list_continuation_not_serializable"), ("jump", "list_level_jump_not_serializable"), ("empty_item", "empty_list_item_not_serializable"),
        ("volume_part", "part_with_collective_work_not_serializable"),
        ("restart", "explicit_list_restart_not_serializable"), ("legal", "legal_numbering_not_serializable"), ("own_restart", "explicit_list_restart_not_serializable"),
    ],
)
def test_what_cannot_be_written_stops_its_document(outcome, package, code):
    xml, problems, _ = outcome
    assert (package, code) in problems and package not in xml


def body(xml):
    return xml.split("<body>")[1].split("</body>")[0]


def test_notes_are_texts_of_their_own(outcome):
    xml, _, found = outcome
    inner = '<note place="foot"><p>deep &lt;<note place="foot"></note></p></note>'
    first = f'<note place="foot"><p><hi rend="italic">it</hi><ref target="https://x.org">l</ref>{inner}</p><quote><p>Said</p></quote></note>'
    second = '<note place="foot"><list type="decimal" n="1"><item>one</item><item>two</item></list></note>'
    assert body(xml["notes"]) == f"<p>a{first}{second}{first}</p>"
    about = {(code, note) for k, code, note in found if k == "notes"}
    assert about == {("unreferenced_note", "footnote:5"), ("unreferenced_note_not_serialized", "footnote:5")}  # its heading is never written
    assert {(code, note) for k, code, note in found if k == "circle"} == {("cyclic_note_reference", "footnote:1"), ("unreferenced_note_not_serialized", "footnote:3")}
    assert ("tab_note", "tab_not_serializable", "footnote:1") in found


def test_lists_and_references_inside_paragraphs(outcome):
    xml, _, found = outcome
    assert body(xml["goes_on"]) == '<list type="decimal" n="1"><item><p>one</p><p>more</p></item><item>two<list type="bulleted"><item>inner</item></list></item></list>'
    assert body(xml["cited"]) == '<p>See <bibl>A <hi rend="italic">B</hi></bibl>.<bibl>C</bibl></p>'
    assert body(xml["empty_parent"]) == '<list type="decimal" n="1"><item><list type="bulleted"><item>in</item></list></item></list>'
    assert ("empty_parent", "empty_parent_list_item", None) in found and ("goes_on", "list_paragraph_without_numbering", None) in found
    assert body(xml["own_format"]) == '<list type="upperRoman" n="4"><item>one</item></list>'
    assert "<figure>" in xml["choice"]
    assert all(validation.problems(x) == [] for x in xml.values())


def test_collective_volumes_are_groups_of_texts(outcome):
    xml, _, found = outcome
    page = '<text><front><div type="titlePage"><p rend="title-main">{}</p></div></front><body>'
    first = page.format("One") + '<div type="section1"><head>In</head><p>x</p><div><div type="section3"><head>deep</head><quote><p>Said</p></quote><p>A. B.</p><p>House</p></div></div></div></body></text>'
    second = page.format("Two") + "<quote><p>Said</p></quote></body></text>"
    assert xml["volume"].split("</teiHeader>")[1].startswith(f'<text><group type="article">{first}{second}</group><back>')
    assert ("volume", "text_before_contributions_not_serialized", None) in found and ("volume_table", "text_before_contributions_not_serialized", None) in found
    assert body(xml["chapter"]) == '<div><div type="chapter"><head>One</head><p>x</p></div></div>'
    assert all(validation.problems(xml[k]) == [] for k in ("volume", "volume_table", "chapter"))


def test_signatures_say_who(spark):
    from quire.operators import blocks

    def said(*lines):
        rows = spark.createDataFrame([("d", i, style, text) for i, (style, text) in enumerate(lines)], "pkg_id string, index int, style_id string, text string")
        return sorted((r.start, r.name, r.affiliation) for r in blocks.signature_suggestions(rows).collect())

    s = "Signature"
    assert said((s, " Ada "), (s, "House"), ("Heading2", "x"), (s, ""), (s, "b")) == [(0, "Ada", "House"), (3, None, "b")]
    assert said((s, "a"), (None, ""), ("Heading1", "x"), (s, "a"), ("Heading3", "y"), (s, "a"), (s, ""), (s, "b")) == []  # not terminal twice, too long
    assert said((s, None)) == [(0, None, None)] and said() == []


def test_images_of_a_document_have_a_limit(spark):
    from quire.operators import graphics

    found = spark.createDataFrame([("a", 0, "media/x.png", "x"), ("a", 3, "media/x.png", "x"), ("a", 4, "media/y.png", "y"), ("b", 0, None, None)], "pkg_id string, index int, url string, sha256 string")
    media = spark.createDataFrame([("a", "m/1", "x", 60), ("a", "m/2", "x", 60), ("a", "m/3", "y", 40), ("b", "m/1", "z", 500)], "pkg_id string, path string, sha256 string, size long")
    assets, over = graphics.used_media(found, media, most=99)
    assert sorted((r.path, r.size) for r in assets.collect()) == [("m/1", 60), ("m/3", 40)] and [tuple(r) for r in over.collect()] == [("a", 100, "used_media_too_large")]
    assert graphics.used_media(found, media, most=100)[1].count() == 0


def record(content, name="whole.docx", **changed):
    own = {
        "schema_version": "2.0", "source_document": {"path": f"in/{name}", "sha256": hashlib.sha256(content).hexdigest()}, "document": {"language": "fr", "title": "T", "subtitle": "S"},
        "contributors": [{"id": "c1", "role": "author", "given_name": "Ada", "family_name": "L.", "affiliations": ["a1"]}], "affiliations": [{"id": "a1", "name": "Institute", "city": "Lyon"}],
        "publication": {"publisher": {"name": "House"}}, "identifiers": [{"type": "doi", "value": "10.1234/x", "format": None}], "collection": {"title": "Series"}, "abstracts": [{"type": "summary", "language": "fr", "text": "In short"}],
    }
    return json.dumps(own | changed)


def margin(content):
    return f"<w:hdr {W}><w:p>{content}</w:p></w:hdr>"


@pytest.fixture(scope="module")
def described(spark):
    field = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    page = field("begin") + "<w:r><w:instrText>PAGE</w:instrText></w:r>" + field("separate") + "<w:r><w:t>7</w:t></w:r>" + field("end")
    titled = p("T", "Title") + p("S", "Subtitle") + p("Text") + p("ada  l.", "Signature")
    files = {
        "whole.docx": made(titled), "other.docx": made(p(" ", "Title") + p("Other", "Title") + p("Third", "Title") + p("Text") + p("Bob", "Signature")), "differs.docx": made(p("Other", "Title") + p("Text") + p("Bob", "Signature")),
        "broken.docx": made(p("a")), "unread.docx": made(p("b")), "none.docx": made(p("c")), "late.docx": made(p("a") + p("T", "Title")), "house.docx": made(p("d")),
        "said.docx": made(p("e"), word__header1=margin("<w:r><w:t>Draft</w:t></w:r>" + page)), "page.docx": made(p("f"), word__header1=margin(page + '<w:fldSimple w:instr="PAGE"><w:r><w:t>7</w:t></w:r></w:fldSimple>')),
    }
    texts = {k: record(c, k) for k, c in files.items() if k != "none.docx"}
    texts |= {"broken.docx": record(files["broken.docx"], "broken.docx", document={"language": "fr", "title": " "}), "unread.docx": "{", "house.docx": record(files["house.docx"], "house.docx", publication={}), "differs.docx": record(b"other", "moved.docx"), "nobody.docx": "{"}
    packages = decoded(spark.createDataFrame([(f"in/{k}", c) for k, c in files.items()], "path string, content binary"))
    records = decoded_records(spark.createDataFrame([(f"in/{k}", t) for k, t in texts.items()], "pkg_id string, json string"))
    books, problems = converted(packages, records)
    found = {}
    for r in problems.collect():
        found.setdefault(r.pkg_id.removeprefix("in/"), set()).add((r.code, r.severity, r.path))
    return {r.pkg_id.removeprefix("in/"): r.xml for r in books.collect()}, found


def test_books_have_their_records_headers(described):
    xml, found = described
    whole = xml["whole.docx"]
    assert "whole.docx" not in found and set(xml) == {"whole.docx", "differs.docx", "page.docx"}
    assert '<author role="aut"><persName><forename>Ada</forename><surname>L.</surname></persName><affiliation>Institute, Lyon</affiliation></author>' in whole
    assert '<publisher>House</publisher><idno type="DOI">10.1234/x</idno></publicationStmt>' in whole and "<series><title>Series</title></series>" in whole
    assert "<p>Conversion du fichier DOCX whole.docx.</p>" in whole and '<front><div type="abstract" xml:lang="fr"><p>In short</p></div></front><body><p>Text</p><p>ada  l.</p></body>' in whole
    assert validation.problems(whole) == []


def test_packages_and_records_that_differ(described):
    _, found = described
    assert found["differs.docx"] == {
        ("metadata_source_filename_changed", "warning", "source_document.path"), ("metadata_source_changed", "warning", "source_document.sha256"),
        ("metadata_title_differs_from_docx", "warning", "document.title"), ("signature_contributor_not_in_metadata", "warning", "signatures[0]"),
    }
    assert {("empty_metadata_suggestion", "error", "paragraphs[0]"), ("multiple_docx_titles", "warning", "paragraphs[2]"), ("metadata_title_differs_from_docx", "warning", "document.title")} <= found["other.docx"]


@pytest.mark.parametrize(
    ("package", "code", "path"),
    [("broken.docx", "missing_title", "document.title"), ("unread.docx", "invalid_json", None), ("none.docx", "missing_metadata", None), ("late.docx", "metadata_style_not_initial", "paragraphs[1]"),
     ("house.docx", "missing_publisher_for_publication_details", None), ("said.docx", "header_footer_text_not_serializable", None)],
)
def test_records_that_refuse(described, package, code, path):
    xml, found = described
    assert (code, "error", path) in found[package] and package not in xml and "nobody.docx" not in found


def test_a_page_number_is_no_text(described):
    assert {(c, s) for c, s, _ in described[1]["page.docx"]} == {("headers_footers_not_inspected", "warning")}
