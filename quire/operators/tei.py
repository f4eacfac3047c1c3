"""Documents written as XML books: one string for each, put together by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.operators.blocks import before, in_order, islands, so_far

# Types of divisions by level, and names the format has for roles, marks and identifiers.
DIVISIONS = {1: "part", 2: "chapter", 3: "section1", 4: "section2", 5: "section3", 6: "section4"}
PERSON_ROLES = {"author": "aut", "editor": "edt", "scientific_editor": "edt", "translator": "trl"}
RENDITIONS = {"bold": "bold", "italic": "italic", "small_caps": "small-caps", "caps": "uppercase", "superscript": "sup", "subscript": "sub"}
NAMESPACE = "http://www.tei-c.org/ns/1.0"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quoted(text: Column) -> Column:
    return F.replace(escaped(text), F.lit('"'), F.lit("&quot;"))


def element(name: str, content: Column, **attributes: Column) -> Column:
    """The element, or null without content; attributes that are null are left out."""
    marks = [F.coalesce(F.concat(F.lit(f' {key.rstrip("_")}="'), quoted(value), F.lit('"')), F.lit("")) for key, value in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *marks, F.lit(">"), content, F.lit(f"</{name}>"))


def span_xml(spans: DataFrame) -> DataFrame:
    """spans (pkg_id, index, span, kind, marks as an array, link, language, text) -> `xml` for each paragraph; the text of a `note` stays as it is.

    Neighbours with `bibl`, if there is such a column, are one reference inside the paragraph, whatever their marks.
    """
    kept = F.filter(F.coalesce("marks", F.array().cast("array<string>")), lambda m: m.isin(*RENDITIONS))
    names = F.create_map(*(F.lit(x) for pair in RENDITIONS.items() for x in pair))
    rend = F.array_join(F.transform(kept, lambda m: names[m]), " ")
    text = F.when(F.col("kind") == "break", "<lb/>").when(F.col("kind") == "note", F.col("text")).otherwise(F.coalesce(escaped(F.col("text")), F.lit("")))
    marked = F.when((F.size(kept) > 0) | F.col("language").isNotNull(), element("hi", text, rend=F.nullif(rend, F.lit("")), **{"xml:lang": F.col("language")})).otherwise(text)
    linked = F.when(F.col("link").isNotNull(), element("ref", marked, target=F.col("link"))).otherwise(marked)
    if "bibl" in spans.columns:
        order, own = Window.partitionBy("pkg_id", "index").orderBy("span"), F.coalesce("bibl", F.lit(False))
        beside = lambda look: F.coalesce(look("bibl").over(order), F.lit(False))
        spans = spans.withColumns({"_opens": own & ~beside(F.lag), "_closes": own & ~beside(F.lead)})
        linked = F.concat(F.when(F.col("_opens"), "<bibl>").otherwise(""), linked, F.when(F.col("_closes"), "</bibl>").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("span", linked.alias("xml"))))
    return spans.groupBy("pkg_id", "index").agg(F.array_join(F.transform(parts, lambda x: x["xml"]), "").alias("xml"))


def note_token(note: Column) -> Column:
    """What stands for the note (kind:id) until its text is known: in characters that no XML document can hold."""
    return F.concat(F.lit("\x01"), note, F.lit("\x02"))


def verse_xml(content: Column) -> Column:
    """Verse lines by line breaks; blank lines at the ends go, others part stanzas. Null without a line."""
    lines = F.transform(F.split(content, "\n|<lb/>"), lambda x: F.when(F.trim(x) != "", x).otherwise(""))
    whole = F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")
    stanza = lambda s: F.concat(F.lit("<lg>"), F.array_join(F.transform(F.split(s, "\n"), lambda line: F.concat(F.lit("<l>"), line, F.lit("</l>"))), ""), F.lit("</lg>"))
    return F.when(whole != "", F.array_join(F.transform(F.split(whole, r"\n{2,}"), stanza), ""))


#: Roles that `body_xml` writes; a paragraph of any other role needs a piece, or an error row that stops its document.
WRITTEN = ("heading", "paragraph", "prose_quote", "verse_quote", "epigraph", "floating_text", "signature", "bibl", "ready")


def content_xml(roled: DataFrame, xml: str | None = None, pieces: DataFrame | None = None, collective: bool = False) -> DataFrame:
    """pkg_id, content, and in_parts with `collective`: roled paragraphs nested into divisions, neighbours of one quotation, epigraph or aside together.

    A heading closes the divisions at its level and below and opens one for each level down to its own, so a
    skipped level gets a division without a head (and, with `collective`, without a type). `xml` names a column of ready inline XML; without it the
    text is escaped. Whatever a document leaves open is closed behind its last paragraph. Signatures are
    paragraphs. Right behind a quotation a paragraph of the role bibl is its source, and both are one `cit`.
    `pieces` (pkg_id, index, piece) are blocks that are XML already (`tei_blocks`); they stand for the
    paragraphs at their indices, and those at an index that no paragraph has stand between.

    With `collective` a document with two or more headings of level 2 is in parts: each such heading begins a text
    with a title page of its own, whose divisions begin anew below that level. What stands before the first is
    left out (`blocks.collective_problems` says so).
    """
    if pieces is not None:
        roled = roled.join(pieces, ["pkg_id", "index"], "full").withColumn("role", F.when(F.col("piece").isNotNull(), "ready").otherwise(F.col("role")))
    content = F.coalesce(F.col(xml) if xml else escaped(F.col("text")), F.lit(""))
    rows = islands(roled, "role").withColumn("_content", content)
    head = F.coalesce(F.col("role") == "heading", F.lit(False))
    starts = head & (F.col("level") == 2) if collective else F.lit(False)
    rows = rows.withColumns({"_parts": F.count_if(starts).over(Window.partitionBy("pkg_id")) if collective else F.lit(0), "_part": F.count_if(starts).over(so_far()) if collective else F.lit(0)})
    many = F.col("_parts") >= 2
    pivot = many & starts
    rows = rows.withColumn("_depth", F.coalesce(F.last(F.when(head, F.col("level")), ignorenulls=True).over(before()), F.lit(0)))
    rows = rows.withColumns({"_first": ~F.col("role").eqNullSafe(F.lag("role").over(in_order())), "_last": ~F.col("role").eqNullSafe(F.lead("role").over(in_order())), "_end": F.lead("index").over(in_order()).isNull()})
    quote = F.col("role").isin("prose_quote", "verse_quote")
    rows = rows.withColumns({"_source": F.when(quote & F.col("_last") & (F.lead("role").over(in_order()) == "bibl"), F.lead("_content").over(in_order())), "_taken": F.coalesce(F.lag("role").over(in_order()).isin("prose_quote", "verse_quote"), F.lit(False))})
    rows = rows.withColumn("_cited", F.max("_source").over(Window.partitionBy("pkg_id", "island")).isNotNull())
    types = F.create_map(*(F.lit(x) for pair in DIVISIONS.items() for x in pair))
    closing = F.repeat(F.lit("</div>"), F.greatest(F.col("_depth") - F.col("level") + 1, F.lit(0)))
    opened = F.when(F.col("level") > F.col("_depth"), F.sequence(F.col("_depth") + 1, F.col("level"))).otherwise(F.array(F.col("level")))
    opening = F.array_join(F.transform(opened, lambda n: F.when(F.lit(not collective) | (n == F.col("level")), F.concat(F.lit('<div type="'), types[n], F.lit('">'))).otherwise("<div>")), "")

    def group(start: str | Column, piece: Column, end: str | Column) -> Column:
        return F.concat(F.when(F.col("_first"), start).otherwise(""), piece, F.when(F.col("_last"), end).otherwise(""))

    p = element("p", F.col("_content"))
    verse = F.coalesce(verse_xml(F.col("_content")), F.lit(""))
    cited = F.when(F.col("_cited"), "<cit><quote>").otherwise("<quote>"), F.concat(F.lit("</quote>"), F.coalesce(F.concat(element("bibl", F.col("_source")), F.lit("</cit>")), F.lit("")))
    ends = lambda depth: F.concat(F.repeat(F.lit("</div>"), F.greatest(depth - 2, F.lit(0)).cast("int")), F.lit("</body></text>"))
    page = F.concat(F.when(F.col("_part") > 1, ends(F.col("_depth"))).otherwise(""), F.lit('<text><front><div type="titlePage"><p rend="title-main">'), F.col("_content"), F.lit("</p></div></front><body>"))
    piece = (
        F.when(many & (F.col("_part") == 0), "").when(pivot, page)
        .when(head, F.concat(closing, opening, element("head", F.col("_content"))))
        .when(F.col("role") == "prose_quote", group(cited[0], p, cited[1]))
        .when(F.col("role") == "verse_quote", group(cited[0], verse, cited[1]))
        .when(F.col("role") == "epigraph", group("<epigraph>", p, "</epigraph>"))
        .when(F.col("role") == "floating_text", group('<floatingText><body>', p, "</body></floatingText>"))
        .when(F.col("role") == "paragraph", element("p", F.col("_content"), rend=F.col("rendition")))
        .when(F.col("role") == "signature", F.when(F.trim("_content") != "", p))
        .when(F.col("role") == "bibl", F.when(~F.col("_taken"), element("bibl", F.col("_content"))))
        .when(F.col("role") == "ready", F.col("piece") if pieces is not None else F.lit(""))
    )
    depth = F.when(head, F.col("level")).otherwise(F.col("_depth"))
    end = F.when(many, ends(depth)).otherwise(F.repeat(F.lit("</div>"), depth.cast("int")))
    ended = F.concat(F.coalesce(piece, F.lit("")), F.when(F.col("_end"), end).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("index", ended.alias("xml"))))
    return rows.groupBy("pkg_id").agg(F.array_join(F.transform(parts, lambda x: x["xml"]), "").alias("content"), *([F.bool_or(many).alias("in_parts")] if collective else []))


def body_xml(roled: DataFrame, xml: str | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """pkg_id, body: `content_xml` as the body of a document."""
    return content_xml(roled, xml, pieces).select("pkg_id", F.concat(F.lit("<body>"), "content", F.lit("</body>")).alias("body"))


def text_xml(roled: DataFrame, xml: str | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """pkg_id, body: the body of a document, or of a collective volume the group of its texts."""
    content, whole = F.col("content"), content_xml(roled, xml, pieces, collective=True)
    group = F.concat(F.lit('<group type="article">'), content, F.lit("</group>"))
    return whole.select("pkg_id", F.when(F.col("in_parts"), group).otherwise(F.concat(F.lit("<body>"), content, F.lit("</body>"))).alias("body"))


def header_xml(metadata: DataFrame) -> DataFrame:
    """pkg_id, header. metadata: pkg_id, title, subtitle, language, publisher, date, license_name, license_url, identifiers
    (type, format, value), people (role, given_name, family_name, literal_name, orcid), keywords (text)."""
    person = lambda x: F.concat(F.coalesce(element("forename", escaped(x["given_name"])), F.lit("")), F.coalesce(element("surname", escaped(x["family_name"])), F.lit("")))
    roles = F.create_map(*(F.lit(v) for pair in PERSON_ROLES.items() for v in pair))

    def one(x: Column) -> Column:
        name = F.when(x["literal_name"].isNotNull(), element("persName", escaped(x["literal_name"]))).otherwise(element("persName", person(x)))
        orcid = F.coalesce(element("idno", ids.orcid(x["orcid"]), type=F.lit("ORCID")), F.lit(""))
        role = F.coalesce(roles[x["role"]], F.lit("ctb"))
        return F.when(x["role"] == "author", element("author", F.concat(name, orcid), role=role)).otherwise(element("editor", F.concat(name, orcid), role=role))

    def number(x: Column) -> Column:
        kind = F.when(x["type"] == "doi", "DOI").when(x["type"].startswith("isbn"), F.when(x["format"] == "print", "pISBN").otherwise("eISBN")).when(x["type"] == "issn", "pISSN").when(x["type"] == "eissn", "eISSN").otherwise("documentnumber")
        value = F.when(x["type"] == "doi", ids.doi(x["value"])).when(x["type"].isin("issn", "eissn"), ids.issn(x["value"])).otherwise(F.trim(x["value"]))
        return element("idno", escaped(value), type=kind)

    join = lambda column, make: F.array_join(F.transform(F.coalesce(F.col(column), F.array()), make), "")
    titles = F.concat(element("title", escaped(F.col("title")), type=F.lit("main")), F.coalesce(element("title", escaped(ids.optional_text(F.col("subtitle"))), type=F.lit("sub")), F.lit("")))
    availability = F.coalesce(element("availability", element("licence", escaped(F.col("license_name")), target=F.col("license_url"))), F.lit(""))
    publication = F.concat(F.coalesce(element("publisher", escaped(F.col("publisher"))), F.lit("")), join("identifiers", number), F.coalesce(element("date", escaped(F.col("date"))), F.lit("")), availability)
    file = F.concat(element("titleStmt", F.concat(titles, join("people", one))), element("publicationStmt", publication), F.lit("<sourceDesc><p/></sourceDesc>"))
    words = F.coalesce(element("textClass", element("keywords", element("list", F.nullif(join("keywords", lambda k: element("item", escaped(k))), F.lit(""))))), F.lit(""))
    profile = F.concat(element("langUsage", element("language", F.lit(""), ident=F.col("language"))), words)
    return metadata.select("pkg_id", element("teiHeader", F.concat(element("fileDesc", file), element("profileDesc", profile))).alias("header"))


def documents(headers: DataFrame, bodies: DataFrame, diagnostics: DataFrame, fronts: DataFrame | None = None, backs: DataFrame | None = None) -> DataFrame:
    """pkg_id, xml for the packages that no error diagnostic stops; one without paragraphs has an empty body."""
    from quire.operators.diagnostics import converted

    joined = converted(headers.join(bodies, "pkg_id", "left"), diagnostics)
    for name, more in (("front", fronts), ("back", backs)):
        joined = joined.withColumn(name, F.lit("")) if more is None else joined.join(more.select("pkg_id", name), "pkg_id", "left")
    empty = lambda name, text="": F.coalesce(F.col(name), F.lit(text))
    start = F.lit(f"<?xml version='1.0' encoding='UTF-8'?>\n<TEI xmlns=\"{NAMESPACE}\">")
    return joined.select("pkg_id", F.concat(start, "header", F.lit("<text>"), empty("front"), empty("body", "<body></body>"), empty("back"), F.lit("</text></TEI>\n")).alias("xml"))
