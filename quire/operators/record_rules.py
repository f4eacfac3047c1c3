"""All rules over bibliographic records: what each record breaks, with code, severity and path.

Rules are column expressions over a record's arrays, so a corpus is judged in one pass without a shuffle;
only keywords alike but for accents are looked for row by row. Records are those of `sources.records`; a
record whose JSON had issues has no parts and breaks no rule here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.operators.metadata import IDENTIFIER_FORMATS, IDENTIFIER_TYPES, LICENSES, similar_keywords

# The version of the records, and vocabularies.
VERSION = "2.0"
ROLES = ("author", "editor", "translator", "scientific_editor", "other")
ABSTRACTS = ("summary", "abstract", "back-cover")
SHA256 = r"^[0-9a-fA-F]{64}$"
FOUND = "array<struct<item:int,code:string,severity:string,path:string>>"

Rule = tuple[Column, str, Column]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _path(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _found(item: Column, *rules: Rule, severity: str = "error") -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(item.cast("int").alias("item"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.alias("path"))) for when, code, path in rules))).cast(FOUND)


def _each(column: Column, rules: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform(F.coalesce(column, F.array()), rules)).cast(FOUND)


def language_rules(value: Column, path: Column) -> list[Rule]:
    return [(blank(value), "missing_language", path), (~blank(value) & ~ids.language_tag(value), "invalid_language", path)]


def spacing(value: Column, code: str, path: Column) -> list[Rule]:
    """An id with blanks around it, and one of blanks alone."""
    return [(~blank(value) & (strip(value) != value), code, path), (blank(value), code, path)]


def document_rules() -> Column:
    zero, source, doc = F.lit(0), F.col("source_document"), F.col("document")
    return _found(
        zero,
        (F.col("schema_version") != VERSION, "unsupported_schema_version", F.lit("schema_version")),
        (blank(doc["title"]), "missing_title", F.lit("document.title")),
        *language_rules(doc["language"], F.lit("document.language")),
        (blank(source["path"]), "invalid_source_path", F.lit("source_document.path")),
        (~F.coalesce(source["sha256"].rlike(SHA256), F.lit(False)), "invalid_source_sha256", F.lit("source_document.sha256")),
    )


def repeated(column: str, code: str) -> Column:
    """Trimmed ids that several elements have, in order, one finding for each."""
    names = F.filter(F.transform(F.coalesce(F.col(column), F.array()), lambda x: strip(x["id"])), lambda n: n != "")
    twice = F.array_sort(F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)))
    return F.transform(twice, lambda n: F.struct(F.lit(0).alias("item"), F.lit(code).alias("code"), F.lit("error").alias("severity"), F.lit(column).alias("path"))).cast(FOUND)


def contributor_rules() -> Column:
    known = F.transform(F.coalesce(F.col("affiliations"), F.array()), lambda a: strip(a["id"]))

    def one(x: Column, k: Column) -> Column:
        path = lambda name: _path("contributors[", k, f"].{name}")
        structured = ~blank(x["given_name"]) | ~blank(x["family_name"])
        own = _found(
            k,
            *spacing(x["id"], "invalid_contributor_id", path("id")),
            (~x["role"].isin(*ROLES), "invalid_contributor_role", path("role")),
            ((x["role"] == "other") & blank(x["role_label"]), "missing_contributor_role_label", path("role_label")),
            (~blank(x["literal_name"]) == structured, "invalid_contributor_name", _path("contributors[", k, "]")),
            ((x["orcid"] != "") & ids.orcid(x["orcid"]).isNull(), "invalid_orcid", path("orcid")),
            ((x["email"] != "") & ~strip(x["email"]).rlike(ids.EMAIL), "invalid_email", path("email")),
        )
        refs = _each(x["affiliations"], lambda a, _: _found(k, (blank(a) | (strip(a) != a), "invalid_affiliation_reference", path("affiliations")), (~blank(a) & (strip(a) == a) & ~F.array_contains(known, a), "unknown_affiliation_reference", path("affiliations"))))
        return F.concat(own, refs)

    return _each(F.col("contributors"), one)


def affiliation_rules() -> Column:
    def one(x: Column, k: Column) -> Column:
        path = lambda name: _path("affiliations[", k, f"].{name}")
        ror = x["ror"].rlike(r"^https://(www\.)?ror\.org/[^/?#;]+$")
        return _found(k, *spacing(x["id"], "invalid_affiliation_id", path("id")), (blank(x["name"]), "invalid_affiliation_name", path("name")), ((x["ror"] != "") & ~ror, "invalid_ror", path("ror")))

    return _each(F.col("affiliations"), one)


def responsibility_rules() -> Column:
    path = lambda k, name: _path("editorial_responsibility[", k, f"].{name}")
    return _each(F.col("editorial_responsibility"), lambda x, k: _found(k, (blank(x["responsibility"]), "invalid_responsibility", path(k, "responsibility")), (blank(x["name"]), "invalid_responsibility_name", path(k, "name"))))


def publication_rules() -> Column:
    house, date = F.col("publication.publisher"), F.col("publication.publication_date")
    own = _found(F.lit(0), (house["name"].isNotNull() & blank(house["name"]), "invalid_publisher_name", F.lit("publication.publisher.name")), ((house["url"] != "") & ~ids.web_address(strip(house["url"])), "invalid_publisher_url", F.lit("publication.publisher.url")))
    lines = _each(house["address"], lambda x, k: _found(k, (blank(x), "invalid_publisher_address", _path("publication.publisher.address[", k, "]"))))
    return F.concat(own, lines, _found(F.lit(0), (date.isNotNull() & ~ids.partial_date(date), "invalid_publication_date", F.lit("publication.publication_date"))))


def identifier_rules() -> Column:
    """Each identifier by itself, then those that repeat an earlier one's value, or its type and format."""
    every = F.coalesce(F.col("identifiers"), F.array())

    def one(x: Column, k: Column) -> Column:
        path = lambda name: _path("identifiers[", k, f"].{name}")
        kind, value, shape = x["type"], x["value"], x["format"]
        typed, filled = F.coalesce(kind.isin(*IDENTIFIER_TYPES), F.lit(False)), ~blank(value)
        compact = F.coalesce(F.length(ids.isbn(value)), F.lit(0))
        length = F.when(kind == "isbn-13", 13).when(kind == "isbn-10", 10)
        return _found(
            k,
            (~typed, "invalid_identifier_type", path("type")),
            (typed & shape.isNotNull() & ~shape.isin(*IDENTIFIER_FORMATS), "invalid_identifier_format", path("format")),
            (typed & ~filled, "invalid_identifier_value", path("value")),
            (filled & (kind == "doi") & ids.doi(value).isNull(), "invalid_doi", path("value")),
            (filled & (compact != length), "invalid_isbn", path("value")),
            (filled & (compact == length) & shape.isNull(), "missing_identifier_format", path("format")),
            (filled & kind.isin("issn", "eissn") & ids.issn(value).isNull(), "invalid_issn", path("value")),
        )

    def again(x: Column, k: Column) -> Column:
        earlier = F.slice(every, F.lit(1), k)
        value = F.lower(strip(x["value"]))
        same = (value != "") & F.exists(earlier, lambda y: (y["type"] == x["type"]) & (F.lower(strip(y["value"])) == value))
        alike = x["format"].isNotNull() & F.exists(earlier, lambda y: (y["type"] == x["type"]) & (y["format"] == x["format"]))
        return _found(F.lit(1_000_000) + k, (same, "duplicate_identifier_value", _path("identifiers[", k, "].value")), (alike, "duplicate_identifier_type_format", _path("identifiers[", k, "]")))

    return F.concat(_each(every, one), _each(every, again))


def rights_rules() -> Column:
    own, licence = F.col("rights"), F.col("rights.license")
    names = F.create_map(*(F.lit(x) for s, n, _ in LICENSES for x in (s, n)))
    urls = F.create_map(*(F.lit(x) for s, _, u in LICENSES for x in (s, u)))
    spdx, zero = licence["spdx_id"], F.lit(0)
    errors = _found(
        zero,
        (own["holder"].isNotNull() & blank(own["holder"]), "invalid_rights_holder", F.lit("rights.holder")),
        (own["statement"].isNotNull() & blank(own["statement"]), "invalid_rights_statement", F.lit("rights.statement")),
        (licence["name"].isNotNull() & blank(licence["name"]), "invalid_license_name", F.lit("rights.license.name")),
        ((licence["url"] != "") & ~ids.web_address(strip(licence["url"])), "invalid_license_url", F.lit("rights.license.url")),
        ((licence["url"] != "") & licence["name"].isNull() & spdx.isNull(), "missing_license_name", F.lit("rights.license.name")),
        (spdx.isNotNull() & names[spdx].isNull(), "invalid_license_spdx_id", F.lit("rights.license.spdx_id")),
    )
    warnings = _found(
        zero,
        (~blank(licence["name"]) & (strip(licence["name"]) != names[spdx]), "license_spdx_id_mismatch", F.lit("rights.license.name")),
        (~blank(licence["url"]) & (strip(licence["url"]) != urls[spdx]), "license_spdx_id_mismatch", F.lit("rights.license.url")),
        severity="warning",
    )
    return F.concat(errors, warnings)


def abstract_rules() -> Column:
    path = lambda k, name: _path("abstracts[", k, f"].{name}")
    return _each(F.col("abstracts"), lambda x, k: _found(k, (~x["type"].isin(*ABSTRACTS), "invalid_abstract_type", path(k, "type")), *language_rules(x["language"], path(k, "language")), (blank(x["text"]), "empty_abstract", path(k, "text"))))


def keyword_rules() -> Column:
    def one(x: Column, k: Column) -> Column:
        path = lambda name: _path("keywords[", k, f"].{name}")
        scheme = strip(x["scheme"])
        own = _found(k, *language_rules(x["language"], path("language")), ((scheme == "") | scheme.rlike(r"(?U)\s"), "invalid_keyword_scheme", path("scheme")), (F.size(x["items"]) == 0, "empty_keyword_group", path("items")))
        return F.concat(own, _each(x["items"], lambda w, n: _found(k, (blank(w), "invalid_keyword", _path("keywords[", k, "].items[", n, "]")))))

    return _each(F.col("keywords"), one)


def collection_rules() -> Column:
    x = F.col("collection")
    hollow = lambda name: x[name].isNotNull() & blank(x[name])
    return _found(F.lit(0), (x.isNotNull() & blank(x["title"]), "invalid_collection_title", F.lit("collection.title")), (x["issn"].isNotNull() & ids.issn(x["issn"]).isNull(), "invalid_issn", F.lit("collection.issn")), (hollow("volume"), "invalid_collection_volume", F.lit("collection.volume")), (hollow("editor"), "invalid_collection_editor", F.lit("collection.editor")))


def pagination_rules() -> Column:
    x = F.col("pagination")
    low, high, extent = x["from"], x["to"], x["extent"]
    bounded, half = low.isNotNull() | high.isNotNull(), low.isNull() | high.isNull()
    code = (
        F.when(x.isNull(), None).when(bounded & extent.isNotNull(), "conflicting_pagination").when(bounded & half, "incomplete_pagination").when(bounded & ((low < 1) | (high < low)), "invalid_pagination")
        .when(~bounded & extent.isNull(), "incomplete_pagination").when(~bounded & (extent < 1), "invalid_pagination")
    )
    at = F.when(bounded | extent.isNull(), "pagination").otherwise("pagination.extent")
    return F.filter(F.array(F.struct(F.lit(0).alias("item"), code.alias("code"), F.lit("error").alias("severity"), at.alias("path"))), lambda f: f["code"].isNotNull()).cast(FOUND)


def funding_rules() -> Column:
    path = lambda k, name: _path("funding[", k, f"].{name}")
    return _each(F.col("funding"), lambda x, k: _found(k, (blank(x["funder"]), "invalid_funder", path(k, "funder")), (x["grant_number"].isNotNull() & blank(x["grant_number"]), "invalid_grant_number", path(k, "grant_number"))))


GROUPS = (
    document_rules, lambda: repeated("contributors", "duplicate_contributor_id"), lambda: repeated("affiliations", "duplicate_affiliation_id"), contributor_rules, affiliation_rules,
    responsibility_rules, publication_rules, identifier_rules, rights_rules, abstract_rules, keyword_rules, collection_rules, pagination_rules, funding_rules,
)
KEYWORDS = GROUPS.index(keyword_rules)


def violations(records: DataFrame, id_col: str = "pkg_id") -> DataFrame:
    """id, group, item, place, code, severity, path of every rule a record breaks; in the order of the first columns they read as the rules are written."""
    good = records.where(F.size("issues") == 0) if "issues" in records.columns else records
    def numbered(group: int, found: Column) -> Column:
        return F.transform(found, lambda f, k: F.struct(F.lit(group).alias("group"), f["item"].alias("item"), k.alias("place"), f["code"].alias("code"), f["severity"].alias("severity"), f["path"].alias("path")))

    every = [numbered(g, rules()) for g, rules in enumerate(GROUPS)]
    found = good.select(id_col, F.explode(F.concat(*every)).alias("_f")).select(id_col, "_f.*")
    words = good.select(F.col(id_col).alias("pkg_id"), F.posexplode("keywords").alias("group", "_g")).select("pkg_id", "group", F.posexplode("_g.items").alias("position", "keyword"))
    alike = similar_keywords(words, ("group",)).select(F.col("pkg_id").alias(id_col), F.lit(KEYWORDS).alias("group"), F.col("group").alias("item"), (F.col("position") + 1_000_000).cast("int").alias("place"), F.lit("similar_keywords").alias("code"), F.lit("warning").alias("severity"), _path("keywords[", F.col("group"), "].items").alias("path"))
    return found.unionByName(alike)


def checked_records(records: DataFrame, id_col: str = "pkg_id") -> tuple[DataFrame, DataFrame]:
    """(records that may be used or written, all issues): JSON issues, then broken rules, as id, phase, group, item, place, code, severity, path."""
    broken = violations(records, id_col).withColumn("phase", F.lit(1))
    if "issues" in records.columns:
        unread = records.select(id_col, F.posexplode("issues").alias("place", "_i")).select(id_col, F.lit(0).alias("phase"), F.lit(0).alias("group"), F.lit(0).alias("item"), "place", "_i.code", F.lit("error").alias("severity"), "_i.path")
        broken = unread.unionByName(broken)
    return records.join(broken.where("severity = 'error'").select(id_col).distinct(), id_col, "left_anti"), broken


def issues_under(issues: DataFrame, path: str) -> DataFrame:
    """The errors of one field or group: those whose path begins with `path`."""
    return issues.where(F.col("path").startswith(path) & (F.col("severity") == "error"))


def inconsistencies(records: DataFrame, sources: DataFrame, id_col: str = "pkg_id") -> DataFrame:
    """Where a record and its package differ, all warnings: id, code, path.

    sources: id, file_name, sha256, title, subtitle (null where the package suggests none) and signatures
    (array of names, null for a line without one). The record is never changed.
    """
    x = records.join(sources.select(F.col(id_col), *(F.col(c).alias(f"_{c}") for c in ("file_name", "sha256", "title", "subtitle", "signatures"))), id_col)
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    names = F.flatten(F.transform(F.coalesce(F.col("contributors"), F.array()), lambda p: F.array_compact(F.array(plain(p["literal_name"]), plain(F.nullif(F.concat_ws(" ", F.nullif(p["given_name"], F.lit("")), F.nullif(p["family_name"], F.lit(""))), F.lit("")))))))
    recorded = F.regexp_extract(F.replace(F.col("source_document.path"), F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    own = _found(
        F.lit(0),
        (recorded != F.col("_file_name"), "metadata_source_filename_changed", F.lit("source_document.path")),
        (F.col("source_document.sha256") != F.col("_sha256"), "metadata_source_changed", F.lit("source_document.sha256")),
        (F.col("_title").isNotNull() & (F.col("_title") != F.col("document.title")), "metadata_title_differs_from_docx", F.lit("document.title")),
        (F.col("_subtitle").isNotNull() & ~F.col("_subtitle").eqNullSafe(F.col("document.subtitle")), "metadata_subtitle_differs_from_docx", F.lit("document.subtitle")),
        severity="warning",
    )
    signed = _each(F.col("_signatures"), lambda s, k: _found(k, (s.isNotNull() & ~F.array_contains(names, plain(s)), "signature_contributor_not_in_metadata", _path("signatures[", k, "]")), severity="warning"))
    return x.select(id_col, F.explode(F.concat(own, signed)).alias("_f")).select(id_col, "_f.code", "_f.severity", "_f.path")
