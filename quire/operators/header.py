"""The header of a book, written from its bibliographic record, and what of a record no header holds.

Both are column expressions over one record's arrays: a corpus of records is written in one pass, without a shuffle.
Records are those of `sources.records` that break no rule (`record_rules.checked_records`). One with null parts (its
JSON had issues) has neither header nor losses; empty and null lists say nothing; repeated rows are written as often as
they come; an affiliation that is not defined is left out, and of two with one id the last counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.operators.metadata import LICENSES
from quire.operators.record_rules import _each, _found, _path, strip
from quire.operators.tei import PERSON_ROLES, element, escaped


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _or_nothing(xml: Column) -> Column:
    return F.coalesce(xml, F.lit(""))


def _text(name: str, value: Column, **attributes: Column) -> Column:
    """The element of a value, or nothing where there is none."""
    return _or_nothing(element(name, escaped(_filled(value)), **attributes))


def _list(column: str) -> Column:
    return F.coalesce(F.col(column), F.array())


def _all(items: Column, one: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(items, one), "")


def _place(name: Column) -> Column:
    """The affiliation of an id, null if there is none."""
    return F.get(F.reverse(F.filter(_list("affiliations"), lambda p: p["id"] == name)), F.lit(0))


def _person(x: Column) -> Column:
    parts = F.concat(_text("forename", x["given_name"]), _text("surname", x["family_name"]))
    name = element("persName", F.coalesce(escaped(_filled(x["literal_name"])), parts))
    at = _all(F.coalesce(x["affiliations"], F.array()), lambda a: element("affiliation", escaped(F.concat_ws(", ", *(_filled(_place(a)[f]) for f in ("name", "unit", "city", "country"))))))
    inner = F.concat(name, _or_nothing(element("idno", ids.orcid(x["orcid"]), type=F.lit("ORCID"))), at)
    known = F.create_map(*(F.lit(v) for pair in PERSON_ROLES.items() for v in pair))
    role = F.coalesce(known[x["role"]], F.lit("ctb"))
    return F.when(x["role"] == "author", element("author", inner, role=role)).otherwise(element("editor", inner, role=role))


def _licence() -> tuple[Column, Column]:
    """Name and address of the licence, those of its identifier where the record has none."""
    own = F.col("rights.license")
    names, urls = (F.create_map(*(F.lit(v) for row in LICENSES for v in (row[0], row[k]))) for k in (1, 2))
    return F.coalesce(own["name"], names[own["spdx_id"]]), F.coalesce(own["url"], urls[own["spdx_id"]])


def _number(x: Column) -> Column:
    """An identifier as `idno`; nothing for one of no known type, and for an ISBN that is wrong or of no format."""
    kind, value = x["type"], x["value"]
    book = kind.isin("isbn-13", "isbn-10")
    name = F.when(kind == "doi", "DOI").when(book, F.when(x["format"] == "print", "pISBN").otherwise("eISBN")).when(kind == "issn", "pISSN").when(kind == "eissn", "eISSN").otherwise("documentnumber")
    shown = F.when(kind == "doi", ids.doi(value)).when(book, F.when(ids.isbn(value).isNotNull() & x["format"].isNotNull(), strip(value))).when(kind.isin("issn", "eissn"), ids.issn(value)).when(kind == "local", strip(value))
    return _or_nothing(element("idno", escaped(shown), type=name))


def _publication() -> Column:
    """Publisher first, then the details; without a publisher nothing (`losses` refuses the details)."""
    house, date, rights = F.col("publication.publisher"), F.col("publication.publication_date"), F.col("rights")
    name, url = _licence()
    terms = F.concat(_text("licence", name, target=_filled(url)), _text("p", rights["statement"]), _text("p", F.concat(F.lit("© "), _filled(rights["holder"]))))
    details = F.concat(
        _text("ref", house["url"], target=house["url"], type=F.lit("site")), _text("date", date, when=date, type=F.lit("publishing")),
        _all(_list("identifiers"), _number), _or_nothing(element("availability", _filled(terms))),
    )
    return element("publicationStmt", F.coalesce(F.concat(element("publisher", escaped(house["name"])), details), F.lit("<p></p>")))


def _source() -> Column:
    """Series and pages as a bibliographic source of their own, or nothing."""
    series, pages = F.col("collection"), F.col("pagination")
    inner = F.concat(_text("title", series["title"]), _text("editor", series["editor"]), _text("biblScope", series["volume"], unit=F.lit("volume")), _or_nothing(element("idno", ids.issn(series["issn"]), type=F.lit("pISSN"))))
    ranged = element("biblScope", F.concat(pages["from"].cast("string"), F.lit("-"), pages["to"].cast("string")), unit=F.lit("page"))
    held = F.concat(_or_nothing(F.when(series.isNotNull(), element("series", inner))), _or_nothing(ranged))
    return _or_nothing(element("sourceDesc", element("bibl", _filled(held))))


def record_header(records: DataFrame, id_col: str = "pkg_id") -> DataFrame:
    """id, header: titles, people with their affiliations, funders, publication, source, series and pages, language, keywords.

    The name of the source is the last part of the id, a path. A record without a publisher has an empty paragraph in
    the place of its publication.
    """
    doc = F.col("document")
    name = F.regexp_extract(F.replace(F.col(id_col).cast("string"), F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1)
    funder = lambda x: element("funder", F.concat(element("orgName", escaped(x["funder"])), _text("idno", x["grant_number"], type=F.lit("funder_registry"))))
    titles = F.concat(element("title", escaped(doc["title"]), type=F.lit("main")), _text("title", doc["subtitle"], type=F.lit("sub")), _all(_list("contributors"), _person), _all(_list("funding"), funder))
    source = element("sourceDesc", element("p", F.concat(F.lit("Conversion du fichier DOCX "), escaped(name), F.lit("."))))
    words = lambda g: element("keywords", element("list", _all(F.coalesce(g["items"], F.array()), lambda k: element("item", escaped(k)))), scheme=g["scheme"], **{"xml:lang": g["language"]})
    profile = F.concat(element("langUsage", element("language", escaped(doc["language"]), ident=doc["language"])), _or_nothing(element("textClass", _filled(_all(_list("keywords"), words)))))
    file = F.concat(element("titleStmt", titles), _publication(), source, _source())
    return records.where("document is not null").select(id_col, element("teiHeader", F.concat(element("fileDesc", file), element("profileDesc", profile))).alias("header"))


def losses(records: DataFrame, id_col: str = "pkg_id") -> DataFrame:
    """id, code, severity, path: what a record says and its header does not.

    Errors are details of a publication without a publisher, and identifiers that cannot be written; an affiliation's
    ROR is named once, where the affiliation is used.
    """
    zero, none = F.lit(0), F.lit(None).cast("string")
    used = F.flatten(F.transform(_list("contributors"), lambda x: F.coalesce(x["affiliations"], F.array())))
    person = lambda x, k: _found(k, (x["role"] == "other", "contributor_role_serialized_as_contributor", _path("contributors[", k, "].role")), (x["email"] != "", "contributor_email_not_serialized", _path("contributors[", k, "].email")), severity="info")
    place = lambda x, k: _found(k, ((x["ror"] != "") & F.array_contains(used, x["id"]), "ror_not_serialized", _path("affiliations[", k, "].ror")), (~F.array_contains(used, x["id"]), "unreferenced_affiliation_not_serialized", _path("affiliations[", k, "].id")), severity="warning")
    house, rights = F.col("publication.publisher"), F.col("rights")
    named, some = house["name"].isNotNull(), lambda c: F.coalesce(c != "", F.lit(False))
    details = (F.size(_list("identifiers")) > 0) | some(F.col("publication.publication_date")) | some(house["url"]) | some(_licence()[0]) | some(rights["statement"]) | some(rights["holder"])
    address = some(house["place"]) | F.coalesce(F.size(house["address"]) > 0, F.lit(False))

    def number(x: Column, k: Column) -> Column:
        book = x["type"].isin("isbn-13", "isbn-10")
        wrong = book & (ids.isbn(x["value"]).isNull() | x["format"].isNull())
        unknown = ~F.coalesce(x["type"].isin("doi", "isbn-13", "isbn-10", "issn", "eissn", "local"), F.lit(False))
        return _found(k, (named & wrong, "invalid_isbn", _path("identifiers[", k, "].value")), (named & unknown, "invalid_identifier_type", _path("identifiers[", k, "].type")))

    found = F.concat(
        _each(F.col("contributors"), person), _each(F.col("affiliations"), place),
        _found(zero, (~named & details, "missing_publisher_for_publication_details", none)), _found(zero, (named & address, "publisher_address_not_serialized", F.lit("publication.publisher")), severity="info"),
        _each(F.col("identifiers"), number), _found(zero, (F.col("pagination.extent").isNotNull(), "pagination_extent_not_serialized", F.lit("pagination.extent")), severity="warning"),
        _found(zero, (F.size(_list("editorial_responsibility")) > 0, "editorial_responsibility_not_serialized", F.lit("editorial_responsibility")), severity="info"),
    )
    return records.where("document is not null").select(id_col, F.explode(found).alias("_f")).select(id_col, "_f.code", "_f.severity", "_f.path")
