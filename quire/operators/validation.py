"""Checks of written XML: well-formed, and every element where the book profile allows it."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

# What the profile's elements may hold.
_BLOCKS = "p quote cit epigraph floatingText list figure table bibl signed"
_INLINE = "hi ref lb note bibl"
CHILDREN = {
    "TEI": "teiHeader text", "teiHeader": "fileDesc profileDesc", "fileDesc": "titleStmt publicationStmt sourceDesc", "titleStmt": "title author editor funder",
    "author": "persName idno affiliation", "editor": "persName idno affiliation", "persName": "forename surname", "publicationStmt": "publisher ref idno date availability p",
    "availability": "licence p", "sourceDesc": "p bibl", "series": "title editor biblScope idno", "funder": "orgName idno", "profileDesc": "langUsage textClass", "langUsage": "language", "textClass": "keywords", "keywords": "list",
    "text": "front body group back", "front": "div", "group": "text", "back": "div", "body": f"div head {_BLOCKS}", "div": f"div head listBibl {_BLOCKS}",
    "quote": "p lg", "cit": "quote bibl", "lg": "l lg", "epigraph": "p", "floatingText": "body", "list": "item head", "item": f"p list {_INLINE}", "p": _INLINE,
    "head": _INLINE, "l": _INLINE, "hi": _INLINE, "ref": _INLINE, "note": f"{_BLOCKS} {_INLINE}", "figure": "head graphic figDesc p", "table": "row head", "row": "cell", "cell": _INLINE, "listBibl": "head bibl", "bibl": f"series biblScope {_INLINE}",
}
REQUIRED = {"TEI": ("teiHeader", "text"), "fileDesc": ("titleStmt", "publicationStmt", "sourceDesc"), "titleStmt": ("title",), "lg": ("l",), "floatingText": ("body",)}
VALUES = {("div", "type"): ("part", "chapter", "section1", "section2", "section3", "section4", "bibliography", "titlePage", "abstract"), ("p", "rend"): ("break", "consecutive", "caption", "credits", "title-main", "title-sub"), ("note", "place"): ("foot", "end")}
_ALLOWED = {name: set(children.split()) for name, children in CHILDREN.items()}


def problems(xml: str | None) -> list[tuple[str, str]]:
    """(domain, message) of all that is wrong; a document type is refused before parsing."""
    if xml is None or "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        return [("xml", "no document, or one with a document type")]
    try:
        root = ET.fromstring(xml.encode())
    except ET.ParseError as broken:
        return [("xml", str(broken))]
    out = []
    for x in root.iter():
        name = x.tag.rpartition("}")[2]
        held = [c.tag.rpartition("}")[2] for c in x]
        out += [("schema", f"{c} in {name}") for c in held if c not in _ALLOWED.get(name, ())]
        out += [("schema", f"{name} without {c}") for c in REQUIRED.get(name, ()) if c not in held]
        out += [("schema", f"{name}/@{key} is {value}") for key, value in x.attrib.items() if value not in VALUES.get((name, key), (value,))]
    return out


def _checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([(p, domain, message) for p, xml in zip(frame["pkg_id"], frame["xml"], strict=True) for domain, message in problems(xml)], columns=["pkg_id", "domain", "message"])


def validated(documents: DataFrame) -> DataFrame:
    """documents (pkg_id, xml) -> a row for each problem; a valid document has none."""
    return documents.selectExpr("cast(pkg_id as string) pkg_id", "xml").mapInPandas(_checked, "pkg_id string, domain string, message string")
