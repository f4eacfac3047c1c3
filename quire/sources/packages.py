"""Word-processor packages (ZIP of XML parts) read into one nested row each, and its tables."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import accumulate
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces, limits and part names of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
TRUE, FALSE = ("1", "true", "on"), ("0", "false", "off")
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CT = "{http://schemas.openxmlformats.org/package/2006/content-types}"
MOST_XML, MOST_MEDIA = 16 << 20, 64 << 20
#: Packages decoded together.
TOGETHER = 32
IN_TABLES = 1_000_000_000
NOT_NOTES = ("separator", "continuationSeparator", "continuationNotice")

PARAGRAPH = "part string, note_id string, index int, block int, style_id string, outline_level int, has_numbering boolean, raw_id string, raw_level string, bookmark_ids array<string>, in_table boolean"
ITEM = "part string, note_id string, index int, run int, item int, kind string, text string, break_type string, reference_id string, relation_ids array<string>, placement string, embedded array<string>, linked array<string>, description string, cropped boolean, transformed boolean, invalid boolean, link string, anchor string, char_style string, bold boolean, italic boolean, small_caps boolean, caps boolean, vertical string, language string, in_table boolean"
STYLE = "style_id string, name string, style_type string, based_on string, is_custom boolean, outline_level int, raw_id string, raw_level string"
TABLES = {
    "paragraphs": PARAGRAPH,
    "items": ITEM,
    "styles": STYLE,
    "instances": "num_id string, abstract_id string",
    "levels": "abstract_id string, level string, number_format string, start string, level_text string, suffix string, picture string, restart string, legal boolean",
    "overrides": "num_id string, level string, start_override string, number_format string, start string, picture string, restart string, legal boolean",
    "relations": "part string, relation_id string, type string, target string, mode string, sequence int",
    "notes": "kind string, note_id string, text string",
    "cells": "block int, row int, col int, index int, text string, n_filled int, grid_span int, merged boolean, nested boolean, header boolean",
    "media": "path string, size long, declared_type string, sha256 string, head binary",
    "issues": "code string, severity string, part string, message string",
}
SCHEMA = "pkg_id string, sha256 string, error string, " + ", ".join(f"{name} array<struct<{re.sub(r'(^|, )(\w+) ', r'\1\2:', fields)}>>" for name, fields in TABLES.items())


class Refused(Exception):
    """A part, or the package, that cannot be read; the argument is the code."""


def parsed(archive: zipfile.ZipFile, name: str) -> ET.Element:
    """The part's root. A part that is too large by its declared size, holds a document type, or is no XML is refused."""
    if archive.getinfo(name).file_size > MOST_XML:
        raise Refused("xml_part_too_large")
    try:
        data = archive.read(name)
    except Exception as broken:
        raise Refused("unreadable_part") from broken
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise Refused("malformed_xml_part")
    try:
        return ET.fromstring(data)
    except (ET.ParseError, ValueError) as broken:
        raise Refused("malformed_xml_part") from broken


def _val(parent: ET.Element | None, name: str) -> str | None:
    child = parent.find(W + name) if parent is not None else None
    return None if child is None else child.get(W + "val")


def _switch(parent: ET.Element | None, name: str) -> bool | None:
    child = parent.find(W + name) if parent is not None else None
    return None if child is None else (child.get(W + "val") or "true").lower() not in ("0", "false", "off")


def _level(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch("[0-9]+", value) else None


def _within(top: ET.Element, link: tuple = (None, None)) -> Iterator[tuple[ET.Element, tuple]]:
    """Runs of a paragraph in order, with the link around each; paragraphs inside (text boxes) are not entered."""
    for child in top:
        if child.tag == W + "p":
            continue
        if child.tag == W + "r":
            yield child, link
        yield from _within(child, (child.get(R + "id"), child.get(W + "anchor")) if child.tag == W + "hyperlink" else link)


def _drawing(x: ET.Element) -> dict:
    """Placement, sources, alternative text, and what has been done to the picture."""
    box = next((c for c in x if c.tag in (WP + "inline", WP + "anchor")), None)
    about = x.find(f".//{WP}docPr")
    blips, frames = list(x.iter(A + "blip")), list(x.iter(A + "xfrm"))
    extent = box.find(WP + "extent") if box is not None else None
    sizes = [extent.get(k) for k in ("cx", "cy")] if extent is not None else []
    turns = [f.get("rot") for f in frames if f.get("rot") is not None]
    flips = [f.get(k) for f in frames for k in ("flipH", "flipV") if f.get(k) is not None]
    edges = [c.get(k) for c in x.iter(A + "srcRect") for k in "ltrb" if c.get(k) is not None]
    return {
        "placement": None if box is None else box.tag.removeprefix(WP), "relation_ids": [b.get(R + "embed") or b.get(R + "link") for b in blips],
        "embedded": [b.get(R + "embed") for b in blips if b.get(R + "embed")], "linked": [b.get(R + "link") for b in blips if b.get(R + "link")],
        "description": None if about is None else about.get("descr") or about.get("title"),
        "cropped": any(_integer(e) != 0 for e in edges), "transformed": any(_integer(t) != 0 for t in turns) or any(f in TRUE for f in flips),
        "invalid": any(_integer(v) is None for v in (*turns, *edges)) or any((_integer(s) or 0) <= 0 for s in sizes) or any(f not in (*TRUE, *FALSE) for f in flips),
    }


def _integer(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"[+-]?[0-9]+", value.strip()) else None


def _items(run: ET.Element) -> Iterator[dict]:
    for x in run:
        name = x.tag.removeprefix(W)
        if name == "t":
            yield {"kind": "text", "text": x.text or ""}
        elif name == "tab":
            yield {"kind": "tab"}
        elif name in ("br", "cr"):
            kind = x.get(W + "type") or "line"
            yield {"kind": "break", "break_type": "line" if kind == "textWrapping" else kind}
        elif name in ("footnoteReference", "endnoteReference"):
            yield {"kind": "footnote_reference" if name[0] == "f" else "endnote_reference", "reference_id": x.get(W + "id")}
        elif name == "drawing":
            yield {"kind": "drawing", **_drawing(x)}
        elif x.tag == MC + "AlternateContent":
            # the first choice stands for all of them; the fallback says the same for older readers
            for choice in (x.find(MC + "Choice"), x.find(MC + "Fallback")):
                if choice is not None:
                    yield from _items(choice)
                    break
        elif name in ("pict", "object"):
            yield {"kind": "drawing", "placement": "vml", "relation_ids": [], "embedded": [], "linked": []}


def _numbers(level: ET.Element | None) -> dict:
    """What a level, or the one inside an override, says about its numbers."""
    return {"number_format": _val(level, "numFmt"), "start": _val(level, "start"), "picture": _val(level, "lvlPicBulletId"), "restart": _val(level, "lvlRestart"), "legal": _switch(level, "isLgl")}


def _paragraph(p: ET.Element, where: dict, out: dict) -> str:
    """Adds the paragraph and its items; returns its text."""
    props = p.find(W + "pPr")
    numbering = props.find(W + "numPr") if props is not None else None
    out["paragraphs"].append(
        {**where, "style_id": _val(props, "pStyle"), "outline_level": _level(_val(props, "outlineLvl")), "has_numbering": numbering is not None, "raw_id": _val(numbering, "numId"), "raw_level": _val(numbering, "ilvl"),
         "bookmark_ids": [x.get(W + "id") for x in p.findall(W + "bookmarkStart")]}
    )
    text = []
    for number, (run, (link, anchor)) in enumerate(_within(p)):
        marks = run.find(W + "rPr")
        lang = marks.find(W + "lang") if marks is not None else None
        look = {
            "char_style": _val(marks, "rStyle"), "bold": _switch(marks, "b"), "italic": _switch(marks, "i"), "small_caps": _switch(marks, "smallCaps"), "caps": _switch(marks, "caps"),
            "vertical": _val(marks, "vertAlign"), "language": lang.get(W + "val") if lang is not None else None, "link": link, "anchor": anchor,
        }
        for place, item in enumerate(_items(run)):
            text.append({"text": item.get("text"), "tab": "\t", "break": "\n"}.get(item["kind"]) or "")
            out["items"].append({"part": where["part"], "note_id": where["note_id"], "index": where["index"], "in_table": where["in_table"], "run": number, "item": place, **look, **item})
    return "".join(text)


def _body(root: ET.Element, part: str, out: dict) -> None:
    """Direct paragraphs and tables of the body; `index` counts paragraphs, `block` both. Cells' paragraphs are counted on their own, from `IN_TABLES`."""
    body = root.find(W + "body")
    index, inner = 0, IN_TABLES
    for block, child in enumerate(x for x in (body if body is not None else ()) if x.tag in (W + "p", W + "tbl")):
        if child.tag == W + "p":
            _paragraph(child, {"part": part, "note_id": None, "index": index, "block": block, "in_table": False}, out)
            index += 1
            continue
        for r, row in enumerate(child.findall(W + "tr")):
            header = _switch(row.find(W + "trPr"), "tblHeader") or False
            for c, cell in enumerate(row.findall(W + "tc")):
                texts = []
                for p in cell.findall(W + "p"):
                    texts.append((inner, _paragraph(p, {"part": part, "note_id": None, "index": inner, "block": block, "in_table": True}, out)))
                    inner += 1
                filled = [k for k, t in texts if t.strip()]
                props = cell.find(W + "tcPr")
                merged = props is not None and any(props.find(W + m) is not None for m in ("vMerge", "hMerge"))
                out["cells"].append({"block": block, "row": r, "col": c, "index": filled[0] if filled else None, "text": "\n".join(t for _, t in texts), "n_filled": len(filled), "grid_span": _level(_val(props, "gridSpan")), "merged": merged, "nested": cell.find(W + "tbl") is not None, "header": header})


def _observed(root: ET.Element, part: str, out: dict) -> None:
    """Issues for what a part holds and nothing here reads: text boxes, tables in them or in notes, old images."""
    boxes = [x for x in root.iter(W + "txbxContent")]
    inside_notes = part != "word/document.xml"
    found = {
        "textboxes_not_inspected": bool(boxes), "table_in_note_not_serializable": inside_notes and next(root.iter(W + "tbl"), None) is not None,
        "table_in_textbox_not_serializable": any(next(b.iter(W + "tbl"), None) is not None for b in boxes), "vml_image_not_supported": next(root.iter(W + "pict"), None) is not None,
    }
    out["issues"] += [{"code": code, "severity": "info" if code == "textboxes_not_inspected" else "warning", "part": part, "message": part} for code, there in found.items() if there]


def _outside_fields(top: ET.Element) -> Iterator[ET.Element]:
    for child in top:
        if child.tag != W + "fldSimple":
            yield child
            yield from _outside_fields(child)


def _says_something(paragraph: ET.Element) -> bool:
    """Whether a paragraph has text of its own, and not only what fields (page numbers and the like) last showed."""
    in_field = False
    for x in _outside_fields(paragraph):
        if x.tag == W + "fldChar":
            in_field = {"begin": True, "separate": True, "end": False}.get(x.get(W + "fldCharType"), in_field)
        elif x.tag == W + "t" and not in_field and (x.text or "").strip():
            return True
    return False


def _note_paragraphs(top: ET.Element) -> Iterator[ET.Element]:
    for child in top:
        if child.tag == W + "p":
            yield child
        else:
            yield from _note_paragraphs(child)


def decode(pkg_id: str, content: bytes) -> dict:
    """One package as its tables. Nothing raises: what stops the whole package is in `error`, what costs a part in `issues`."""
    out: dict = {"pkg_id": pkg_id, "sha256": hashlib.sha256(content).hexdigest(), "error": None} | {t: [] for t in TABLES}
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        names = set(archive.namelist())
    except Exception:
        return out | {"error": "unreadable_file"}
    if "word/document.xml" not in names:
        return out | {"error": "missing_document_part"}

    def optional(name: str) -> ET.Element | None:
        if name not in names:
            return None
        try:
            return parsed(archive, name)
        except Refused as refused:
            out["issues"].append({"code": str(refused), "severity": "warning", "part": name, "message": name})
            return None

    try:
        root = parsed(archive, "word/document.xml")
        _body(root, "word/document.xml", out)
        _observed(root, "word/document.xml", out)
    except Refused as refused:
        return out | {"error": str(refused)} | {t: [] for t in TABLES}
    if (root := optional("word/styles.xml")) is not None:
        for s in root.findall(W + "style"):
            if s.get(W + "styleId"):
                props = s.find(W + "pPr")
                numbering = props.find(W + "numPr") if props is not None else None
                custom = s.get(W + "customStyle")
                out["styles"].append({"style_id": s.get(W + "styleId"), "name": _val(s, "name"), "style_type": s.get(W + "type"), "based_on": _val(s, "basedOn"), "is_custom": None if custom is None else custom.lower() not in ("0", "false", "off"), "outline_level": _level(_val(props, "outlineLvl")), "raw_id": _val(numbering, "numId"), "raw_level": _val(numbering, "ilvl")})
    if (root := optional("word/numbering.xml")) is not None:
        for d in root.findall(W + "abstractNum"):
            for x in d.findall(W + "lvl"):
                out["levels"].append({"abstract_id": d.get(W + "abstractNumId"), "level": x.get(W + "ilvl"), "level_text": _val(x, "lvlText"), "suffix": _val(x, "suff"), **_numbers(x)})
        for n in root.findall(W + "num"):
            out["instances"].append({"num_id": n.get(W + "numId"), "abstract_id": _val(n, "abstractNumId")})
            out["overrides"] += [{"num_id": n.get(W + "numId"), "level": o.get(W + "ilvl"), "start_override": _val(o, "startOverride"), **_numbers(o.find(W + "lvl"))} for o in n.findall(W + "lvlOverride")]
    for kind in ("footnote", "endnote"):
        part = f"word/{kind}s.xml"
        if (root := optional(part)) is not None:
            _observed(root, part, out)
            for note in root.findall(W + kind):
                if note.get(W + "id") is not None and note.get(W + "type") not in NOT_NOTES:
                    texts = [_paragraph(p, {"part": part, "note_id": note.get(W + "id"), "index": k, "block": k, "in_table": False}, out) for k, p in enumerate(_note_paragraphs(note))]
                    out["notes"].append({"kind": kind, "note_id": note.get(W + "id"), "text": "\n".join(texts)})
    for part in ("document", "footnotes", "endnotes"):
        if (root := optional(f"word/_rels/{part}.xml.rels")) is not None:
            for k, x in enumerate(root.findall(REL + "Relationship")):
                if x.get("Id") and x.get("Type") and x.get("Target"):
                    out["relations"].append({"part": f"word/{part}.xml", "relation_id": x.get("Id"), "type": x.get("Type"), "target": x.get("Target"), "mode": x.get("TargetMode"), "sequence": k})
    types: dict[str, str] = {}
    if (root := optional("[Content_Types].xml")) is not None:
        types = {x.get("Extension", "").lower(): x.get("ContentType") for x in root.findall(CT + "Default")} | {x.get("PartName", ""): x.get("ContentType") for x in root.findall(CT + "Override")}
    for name in sorted(n for n in names if n.startswith("word/media/") and not n.endswith("/")):
        size = archive.getinfo(name).file_size
        if size > MOST_MEDIA:
            out["issues"].append({"code": "image_media_too_large", "severity": "warning", "part": name, "message": name})
            continue
        try:
            data = archive.read(name)
        except Exception:
            out["issues"].append({"code": "unreadable_image_media", "severity": "warning", "part": name, "message": name})
            continue
        out["media"].append({"path": name, "size": size, "declared_type": types.get("/" + name) or types.get(name.rpartition(".")[2].lower()), "sha256": hashlib.sha256(data).hexdigest(), "head": data[:8]})
    if "word/comments.xml" in names:
        out["issues"].append({"code": "comments_not_inspected", "severity": "info", "part": "word/comments.xml", "message": "word/comments.xml"})
    for name in sorted(n for n in names if n.startswith(("word/header", "word/footer")) and n.endswith(".xml")):
        if (root := optional(name)) is not None:
            said = any(_says_something(p) for p in root.iter(W + "p"))
            code, severity = ("header_footer_text_not_serializable", "warning") if said else ("headers_footers_not_inspected", "info")
            out["issues"].append({"code": code, "severity": severity, "part": name, "message": name})
    return out


def _decoded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    fields = {t: [(f.split()[0], kinds[f.split()[1]]) for f in d.split(", ")] for t, d in TABLES.items()}

    def together(rows: list[dict]) -> pa.RecordBatch:
        """Column by column, which costs less than a dictionary for each item."""
        columns = [pa.array([r[c] for r in rows], pa.string()) for c in ("pkg_id", "sha256", "error")]
        for table, own in fields.items():
            flat = [x for r in rows for x in r[table]]
            offsets = pa.array([0, *accumulate(len(r[table]) for r in rows)], pa.int32())
            values = pa.StructArray.from_arrays([pa.array([x.get(f) for x in flat], kind) for f, kind in own], fields=[pa.field(f, kind) for f, kind in own])
            columns.append(pa.ListArray.from_arrays(offsets, values))
        return pa.RecordBatch.from_arrays(columns, names=["pkg_id", "sha256", "error", *fields])

    held: list[dict] = []
    for frame in frames:
        for pkg_id, content in zip(frame.column(0), frame.column(1), strict=True):
            held.append(decode(pkg_id.as_py(), content.as_py() or b""))
            if len(held) == TOGETHER:
                yield together(held)
                held = []
    if held:
        yield together(held)


def decoded(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """One nested row per package of `files`; a bad package is a row with its error, never a failed job."""
    return files.select(F.col(id_col).cast("string").alias("pkg_id"), F.col(content_col).alias("content")).mapInArrow(_decoded, SCHEMA)


def read_packages(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def exploded(packages: DataFrame, table: str) -> DataFrame:
    """One of TABLES as rows with pkg_id."""
    return packages.select("pkg_id", F.explode(table).alias("_x")).select("pkg_id", "_x.*")


def body_paragraphs(packages: DataFrame) -> DataFrame:
    """Body paragraphs as the block operators take them: text, style name and customness, and the style's outline level where the paragraph has none."""
    from quire.operators.inline import plain_text

    rows = exploded(packages, "paragraphs").where("part = 'word/document.xml' and not in_table")
    body = exploded(packages, "items").where("part = 'word/document.xml' and not in_table")
    text = plain_text(body.withColumn("item", F.col("run") * 100_000 + F.col("item")))
    styles = exploded(packages, "styles").select("pkg_id", "style_id", F.col("name").alias("style_name"), F.col("is_custom").alias("style_is_custom"), F.col("outline_level").alias("_outline"))
    joined = rows.join(text, ["pkg_id", "index"], "left").join(styles, ["pkg_id", "style_id"], "left")
    return joined.withColumn("outline_level", F.coalesce("outline_level", "_outline")).withColumn("text", F.coalesce("text", F.lit(""))).drop("_outline")
