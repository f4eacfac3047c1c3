"""Bibliographic records: JSON read strictly into one struct for each document, and written again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.staging import written

ISSUES = "array<struct<code:string,path:string>>"


@dataclass(frozen=True)
class Text:
    """A string; one that is not `required` may be absent or null."""

    required: bool = False


@dataclass(frozen=True)
class Whole:
    """An integer that may be absent or null; a truth value is none."""


@dataclass(frozen=True)
class Strings:
    """An array of strings. Absent is empty; null is an error unless `lenient`, and absent one if `required`."""

    required: bool = False
    lenient: bool = False


@dataclass(frozen=True)
class Object:
    fields: tuple[tuple[str, object], ...]
    required: bool = False


@dataclass(frozen=True)
class Array:
    of: Object
    required: bool = False


def _object(required: bool = False, **fields) -> Object:
    return Object(tuple((name.rstrip("_"), kind) for name, kind in fields.items()), required)


MUST, MAY = Text(True), Text()
# The shape of a record, in the order in which its parts are read.
PERSON = _object(id=MUST, role=MUST, given_name=MAY, family_name=MAY, literal_name=MAY, orcid=MAY, email=MAY, role_label=MAY, affiliations=Strings())
PLACE = _object(id=MUST, name=MUST, unit=MAY, city=MAY, country=MAY, ror=MAY)
PARTS = (
    ("contributors", Array(PERSON, True)),
    ("affiliations", Array(PLACE, True)),
    ("editorial_responsibility", Array(_object(responsibility=MUST, name=MUST))),
    ("identifiers", Array(_object(type=MUST, value=MUST, format=MAY))),
    ("abstracts", Array(_object(type=MUST, language=MUST, text=MUST))),
    ("keywords", Array(_object(scheme=MAY, language=MUST, items=Strings(True, True)))),
    ("publication", _object(publisher=_object(name=MAY, place=MAY, address=Strings(), url=MAY), publication_date=MAY)),
    ("rights", _object(holder=MAY, statement=MAY, license=_object(name=MAY, url=MAY, spdx_id=MAY))),
    ("collection", _object(title=MUST, issn=MAY, volume=MAY, editor=MAY)),
    ("pagination", _object(from_=Whole(), to=Whole(), extent=Whole())),
    ("funding", Array(_object(funder=MUST, grant_number=MAY))),
)
HEADS = (("source_document", _object(True, path=MUST, sha256=MUST)), ("document", _object(True, language=MUST, title=MUST, subtitle=MAY)))


def _issue(code: str, path: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"))


def _issues(*pairs: tuple[Column, str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), _issue(code, path)) for when, code, path in pairs))).cast(ISSUES)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _result(value: Column, issues: Column) -> Column:
    return F.struct(value.alias("value"), issues.alias("issues"))


def _unless(fine: Column, *pairs: tuple[Column, str, Column]) -> Column:
    """No issue where the value is fine; else those that hold."""
    return F.when(fine, _issues()).otherwise(_issues(*pairs))


def _items(value: Column) -> Column:
    """The elements of an array, null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def _fields(value: Column) -> Column:
    """The fields of an object, null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _read(value: Column, shape: object, path: Column) -> Column:
    """A struct of the typed value (null where it is not of its type), and what is wrong with it.

    The kind of an array or object is its whole schema, so it is asked for only of values that are not what they should be.
    """
    if isinstance(shape, Text):
        return _with(value, lambda v: _with(_kind(v), lambda kind: _text(v, kind, shape, path)))
    if isinstance(shape, Whole):
        right, void = lambda kind: kind == "BIGINT", lambda kind: kind.isin("ABSENT", "VOID")
        return _with(value, lambda v: _with(_kind(v), lambda kind: _result(F.when(right(kind), F.try_variant_get(v, "$", "bigint")), _issues((~right(kind) & ~void(kind), "invalid_field_type", path)))))
    if isinstance(shape, Strings):
        return _with(value, lambda v: _with(_items(v), lambda items: F.when(items.isNotNull(), _texts(items, path)).otherwise(_result(F.array().cast("array<string>"), _no_texts(v, shape, path)))))
    if isinstance(shape, Object):
        return _with(value, lambda v: _with(_fields(v), lambda fields: F.when(fields.isNotNull(), _parts(fields, shape, path)).otherwise(_result(F.lit(None), _not_of(_kind(v), shape, "invalid_metadata_structure", path)))))
    one = Object(shape.of.fields, True)
    each = lambda x, k: _read(F.coalesce(x, F.parse_json(F.lit("null"))), one, F.concat(path, F.lit("["), k, F.lit("]")))
    whole = lambda read: _result(F.transform(read, lambda r: r["value"]), F.flatten(F.transform(read, lambda r: r["issues"])))
    return _with(value, lambda v: _with(_items(v), lambda items: F.when(items.isNotNull(), _with(F.transform(items, each), whole)).otherwise(_result(F.lit(None), _not_of(_kind(v), shape, "invalid_field_type", path)))))


def _not_of(kind: Column, shape: Object | Array, code: str, path: Column) -> Column:
    """What is wrong with a value that is no object, or no array, where `shape` wants one."""
    wrong = F.lit(True) if shape.required else ~kind.isin("ABSENT", "VOID")
    return _issues(((kind == "ABSENT") & F.lit(shape.required), "missing_metadata_field", path), (wrong, code, path))


def _text(value: Column, kind: Column, shape: Text, path: Column) -> Column:
    right = kind == "STRING"
    missing = ((kind == "ABSENT") & F.lit(shape.required), "missing_metadata_field", path)
    fine = right if shape.required else kind.isin("STRING", "ABSENT", "VOID")
    return _result(F.when(right, F.try_variant_get(value, "$", "string")), _unless(fine, missing, (~fine, "invalid_field_type", path)))


def _texts(items: Column, path: Column) -> Column:
    text = lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
    wrong = lambda x, k: F.when(_kind(x) != "STRING", _issue("invalid_field_type", F.concat(path, F.lit("["), k, F.lit("]"))))
    return _result(F.filter(F.transform(items, text), lambda x: x.isNotNull()), F.filter(F.transform(items, wrong), lambda x: x.isNotNull()).cast(ISSUES))


def _no_texts(value: Column, shape: Strings, path: Column) -> Column:
    kind = _kind(value)
    absent = kind == "ABSENT"
    # a falsy value counts as no list where that is allowed
    empty = absent | (F.coalesce(kind.isin("ABSENT", "VOID") | F.to_json(value).isin('""', "0", "false", "{}", "0.0"), F.lit(False)) & F.lit(shape.lenient))
    return _issues((absent & F.lit(shape.required), "missing_metadata_field", path), (~empty, "invalid_field_type", path))


def _parts(fields: Column, shape: Object, path: Column) -> Column:
    read = F.struct(*(_read(fields[name], inner, F.concat(path, F.lit(f".{name}"))).alias(name) for name, inner in shape.fields))
    names = [name for name, _ in shape.fields]
    return _with(read, lambda r: _result(F.struct(*(r[n]["value"].alias(n) for n in names)), F.concat(*(r[n]["issues"] for n in names))))


def decoded_records(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """The other columns of `rows`, the parts of each record, and `issues` (code, path) in the order of reading.

    Types are strict, unknown names are ignored. A record with an issue has null parts; broken JSON gives
    invalid_json, a null text metadata_file_unreadable, and a root that is no object invalid_metadata_structure.

    Records are read when this is called and written to the shared folder: otherwise every filter of what uses them
    moves below the reading, and each part that it names is read, and the JSON parsed, anew.
    """
    kept = [c for c in rows.columns if c != json_col]
    parsed = rows.select(*kept, F.col(json_col).alias("_text"), F.try_parse_json(json_col).alias("_root"))
    root = F.col("_root")
    get = lambda name: F.try_variant_get(root, f"$.{name}", "variant")
    shapes = {"schema_version": MUST} | dict(HEADS) | dict(PARTS)
    read = {name: F.col(f"_read_{name}") for name in shapes}
    frame = parsed.withColumns({f"_read_{name}": _read(get(name), shape, F.lit(name)) for name, shape in shapes.items()})
    # first whether the required parts are there at all, then what is in the others, then the heads' own fields
    heads = [_read(get(name), Object((("_", MAY),), True), F.lit(name))["issues"] for name, _ in HEADS]
    lists = [_unless(_items(get(name)).isNotNull(), (_kind(get(name)) == "ABSENT", "missing_metadata_field", F.lit(name)), (F.lit(True), "invalid_field_type", F.lit(name))) for name in ("contributors", "affiliations")]
    frame = frame.withColumn("_first", F.concat(*heads, *lists)).withColumn("_second", F.concat(*(read[name]["issues"] for name, _ in PARTS)))
    frame = frame.withColumn("_third", F.concat(read["schema_version"]["issues"], *(read[name]["issues"] for name, _ in HEADS)))
    whole = _fields(root).isNotNull()
    one = lambda code: F.array(_issue(code, F.lit(None).cast("string"))).cast(ISSUES)
    issues = (
        F.when(F.col("_text").isNull(), one("metadata_file_unreadable")).when(root.isNull(), one("invalid_json")).when(~whole, one("invalid_metadata_structure"))
        .when(F.size("_first") > 0, F.col("_first")).when(F.size("_second") > 0, F.col("_second")).otherwise(F.col("_third"))
    )
    frame = frame.withColumn("issues", issues)
    good = F.size("issues") == 0
    columns = {name: got["value"] for name, got in read.items()}
    columns["keywords"] = F.transform(columns["keywords"], lambda g: g.withField("scheme", F.coalesce(g["scheme"], F.lit("keywords"))))
    out = frame.select(*kept, *(F.when(good, c).alias(n) for n, c in columns.items()), "issues")
    lists_of = [name for name, shape in PARTS if isinstance(shape, Array)]
    return written(out.withColumns({n: F.when(F.size("issues") == 0, F.coalesce(n, F.filter(F.array(F.get(n, F.lit(0))), lambda x: F.lit(False)))) for n in lists_of}), "records")


def read_records(spark: SparkSession, path: str, pattern: str = "*.metadata.json") -> DataFrame:
    """Files of records: path and the parts; the file's base name without the ending pairs a record with its package."""
    return decoded_records(spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")))


def record_path(package_path: Column) -> Column:
    """Where the record of a package stands: beside it, `.metadata.json` for the last ending."""
    return F.concat(F.regexp_replace(package_path, r"(?<=[^/])\.[^./]*$", ""), F.lit(".metadata.json"))


def paired(packages: DataFrame, records: DataFrame, path: str = "path") -> DataFrame:
    """packages and the records at the paths that theirs lead to; a package without one keeps nulls."""
    found = records.withColumnRenamed(path, "_record_path")
    return packages.join(found, record_path(F.col(path)) == F.col("_record_path"), "left").drop("_record_path")


def relative_source(package: Column, record: Column) -> Column:
    """A package's path relative to its record's folder, with slashes; both absolute on one file system."""
    parts = lambda p: F.filter(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    there, base = parts(package), parts(F.regexp_replace(record, r"[^/\\]*$", ""))
    common = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(base), F.lit(1))), lambda n: (n <= F.size(base)) & (n <= F.size(there)) & (F.slice(there, 1, n) == F.slice(base, 1, n))))
    up = F.array_repeat(F.lit(".."), F.size(base) - common)
    return F.array_join(F.concat(up, F.slice(there, common + 1, F.greatest(F.size(there) - common, F.lit(0)))), "/")


def resolved_source(source: Column, record: Column) -> Column:
    """The package a record names: an absolute path as it is, any other from the record's folder, `.` and `..` taken out."""
    absolute = source.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\)")
    steps = F.split(F.concat(F.regexp_replace(record, r"[^/]*$", ""), source), "/")
    walked = F.aggregate(F.filter(steps, lambda s: ~s.isin("", ".")), F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.when(absolute, source).otherwise(F.concat(F.lit("/"), F.array_join(walked, "/")))


def _json(value: Column) -> Column:
    """One value as JSON text; null as null."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _written(pairs: list[tuple[str, Column, bool]]) -> Column:
    """A JSON object of (name, JSON text, keep): a part that is null or an empty list or object goes unless kept."""
    shown = [F.when(F.lit(keep) | ~F.coalesce(text, F.lit("null")).isin("null", "[]", "{}"), F.concat(F.lit(f'"{name}":'), F.coalesce(text, F.lit("null")))) for name, text, keep in pairs]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*shown)), ","), F.lit("}"))


def _listed(column: str, one) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(F.col(column), F.array()), one), ","), F.lit("]"))


def encoded_records(records: DataFrame) -> DataFrame:
    """Adds `json`: names in a fixed order, groups that say nothing left out. Only records without issues are to be written (`record_rules`)."""
    many = lambda fields, keep: lambda x: _written([(f, _json(ids.orcid(x[f]) if f == "orcid" else x[f]), f in keep) for f in fields])
    publisher = _written([(f, _json(F.col(f"publication.publisher.{f}")), False) for f in ("name", "place", "address", "url")])
    license_ = _written([(f, _json(F.col(f"rights.license.{f}")), False) for f in ("name", "url", "spdx_id")])
    ranged = _written([(f, _json(F.col(f"pagination.{f}")), True) for f in ("from", "to")])
    pairs = [
        ("schema_version", _json(F.col("schema_version")), True),
        ("source_document", _written([(f, _json(F.col(f"source_document.{f}")), True) for f in ("path", "sha256")]), True),
        ("document", _written([(f, _json(F.col(f"document.{f}")), True) for f in ("language", "title", "subtitle")]), True),
        ("contributors", _listed("contributors", many(("id", "role", "role_label", "given_name", "family_name", "literal_name", "orcid", "email", "affiliations"), ("id", "role", "affiliations"))), True),
        ("affiliations", _listed("affiliations", many(("id", "name", "unit", "city", "country", "ror"), ("id", "name"))), True),
        ("editorial_responsibility", _listed("editorial_responsibility", many(("responsibility", "name"), ("responsibility", "name"))), False),
        ("publication", _written([("publisher", publisher, False), ("publication_date", _json(F.col("publication.publication_date")), False)]), False),
        ("identifiers", _listed("identifiers", many(("type", "value", "format"), ("type", "value", "format"))), False),
        ("rights", _written([("holder", _json(F.col("rights.holder")), False), ("statement", _json(F.col("rights.statement")), False), ("license", license_, False)]), False),
        ("abstracts", _listed("abstracts", many(("type", "language", "text"), ("type", "language", "text"))), False),
        ("keywords", _listed("keywords", many(("language", "scheme", "items"), ("language", "scheme", "items"))), False),
        ("collection", F.when(F.col("collection").isNotNull(), _written([(f, _json(F.col(f"collection.{f}")), f == "title") for f in ("title", "issn", "volume", "editor")])), False),
        ("pagination", F.when(F.col("pagination.extent").isNotNull(), _written([("extent", _json(F.col("pagination.extent")), True)])).when(F.col("pagination").isNotNull(), ranged), False),
        ("funding", _listed("funding", many(("funder", "grant_number"), ("funder",))), False),
    ]
    return records.withColumn("json", _written(pairs))


def decoded_profiles(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Institutions' defaults: the other columns of `rows`, profile_id, publisher, rights_holder, and `issues`; with an issue all else is null."""
    kept = [c for c in rows.columns if c != json_col]
    frame = rows.select(*kept, F.col(json_col).alias("_text"), F.try_parse_json(json_col).alias("_root"))
    root = F.col("_root")
    get = lambda name: F.try_variant_get(root, f"$.{name}", "variant")
    text = lambda name: F.try_variant_get(root, f"$.{name}", "string")
    is_text = lambda name: _kind(get(name)).isin("STRING", "VOID", "ABSENT")
    house = _kind(get("publisher"))
    lines = F.try_variant_get(root, "$.publisher.address", "array<variant>")
    listed = _kind(get("publisher.address"))
    address = (listed == "ABSENT") | (listed.startswith("ARRAY") & F.forall(lines, lambda x: _kind(x) == "STRING"))
    inner = ~house.startswith("OBJECT") & (house != "ABSENT")
    own = _issues(
        ((_kind(get("profile_id")) != "STRING") | (F.trim(text("profile_id")) == ""), "invalid_profile_id", F.lit("profile_id")),
        (inner, "invalid_profile_structure", F.lit("publisher")),
        (~inner & ~F.coalesce(address, F.lit(False)), "invalid_profile_structure", F.lit("publisher.address")),
        (~is_text("rights_holder"), "invalid_profile_structure", F.lit("rights_holder")),
        *((~inner & ~is_text(f"publisher.{k}"), "invalid_profile_structure", F.lit(f"publisher.{k}")) for k in ("name", "place", "url")),
    )
    one = lambda code: F.array(_issue(code, F.lit(None).cast("string"))).cast(ISSUES)
    issues = F.when(F.col("_text").isNull(), one("profile_file_unreadable")).when(root.isNull(), one("invalid_profile_json")).when(~_kind(root).startswith("OBJECT"), one("invalid_profile_structure")).otherwise(own)
    frame = frame.withColumn("issues", issues)
    publisher = F.struct(text("publisher.name").alias("name"), text("publisher.place").alias("place"), F.coalesce(F.try_variant_get(root, "$.publisher.address", "array<string>"), F.array().cast("array<string>")).alias("address"), text("publisher.url").alias("url"))
    good = F.size("issues") == 0
    return frame.select(*kept, F.when(good, F.trim(text("profile_id"))).alias("profile_id"), F.when(good, publisher).alias("publisher"), F.when(good, text("rights_holder")).alias("rights_holder"), "issues")


def with_institution(records: DataFrame, profile: DataFrame) -> DataFrame:
    """Records whose publisher and rights holder are filled in from the profile where absent; a record's own values stay.

    Without a row, or with one that has issues, records stay as they are; several profiles are an error.
    """
    rows = profile.where("profile_id is not null").select("publisher", "rights_holder").limit(2).collect()
    if len(rows) > 1:
        raise ValueError("one profile at most can fill in records")
    if not rows:
        return records
    house = rows[0]["publisher"]
    own = F.col("publication.publisher")
    lines = F.array(*(F.lit(x) for x in house["address"])).cast("array<string>")
    filled = F.struct(
        *(F.coalesce(own[k], F.lit(house[k])).alias(k) for k in ("name", "place")),
        F.when(F.coalesce(F.size(own["address"]), F.lit(0)) > 0, own["address"]).otherwise(lines).alias("address"),
        F.coalesce(own["url"], F.lit(house["url"])).alias("url"),
    )
    good = F.size("issues") == 0 if "issues" in records.columns else F.lit(True)
    rights = F.struct(F.coalesce(F.col("rights.holder"), F.lit(rows[0]["rights_holder"])).alias("holder"), F.col("rights.statement").alias("statement"), F.col("rights.license").alias("license"))
    return records.withColumns({"publication": F.when(good, F.struct(filled.alias("publisher"), F.col("publication.publication_date").alias("publication_date"))), "rights": F.when(good, rights)})
