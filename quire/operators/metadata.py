"""Rules over bibliographic metadata, each finding a row with its code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import identifiers as ids
from quire.functions.names import folded, spaced

# Licences known by their identifier, and the vocabularies of identifiers.
LICENSES = (
    ("CC-BY-4.0", "CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "https://creativecommons.org/licenses/by-nd/4.0/"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "https://creativecommons.org/licenses/by-nc/4.0/"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("CC0-1.0", "CC0 1.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
)
IDENTIFIER_TYPES, IDENTIFIER_FORMATS = ("doi", "isbn-13", "isbn-10", "issn", "eissn", "local"), ("print", "pdf", "epub", "html")


def licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LICENSES), "spdx_id string, license_name string, license_url string")


def resolved_licenses(rights: DataFrame) -> DataFrame:
    """rights (pkg_id, spdx_id, name, url): name and url filled in from the identifier where missing; code for unknown ones and differences."""
    joined = rights.join(F.broadcast(licenses(rights.sparkSession)), "spdx_id", "left")
    code = F.when(F.col("spdx_id").isNotNull() & F.col("license_name").isNull(), "unknown_spdx_license").when(F.col("name") != F.col("license_name"), "license_name_differs_from_spdx").when(F.col("url") != F.col("license_url"), "license_url_differs_from_spdx")
    return joined.select("pkg_id", "spdx_id", F.coalesce("name", "license_name").alias("name"), F.coalesce("url", "license_url").alias("url"), code.alias("code"))


def checked_identifiers(rows: DataFrame) -> DataFrame:
    """rows (pkg_id, position, type, format, value): code of the first rule each breaks, null if none."""
    kind, value, shape = F.col("type"), F.col("value"), F.col("format")
    compact = ids.isbn(value)
    wanted, found = F.when(kind == "isbn-13", 13).when(kind == "isbn-10", 10), F.coalesce(F.length(compact), F.lit(0))
    code = F.when(~F.coalesce(kind.isin(*IDENTIFIER_TYPES), F.lit(False)), "invalid_identifier_type").when(shape.isNotNull() & ~shape.isin(*IDENTIFIER_FORMATS), "invalid_identifier_format").when(F.coalesce(F.trim(value), F.lit("")) == "", "invalid_identifier_value")
    code = code.when((kind == "doi") & ids.doi(value).isNull(), "invalid_doi").when(found != wanted, "invalid_isbn").when(wanted.isNotNull() & shape.isNull(), "missing_identifier_format").when(kind.isin("issn", "eissn") & ids.issn(value).isNull(), "invalid_issn")
    return rows.withColumn("code", code)


def repeated_identifiers(rows: DataFrame) -> DataFrame:
    """Every identifier after the first of its type and value, or of its type and format, within a package."""
    by_value = Window.partitionBy("pkg_id", "type", F.lower(F.trim("value"))).orderBy("position")
    by_format = Window.partitionBy("pkg_id", "type", "format").orderBy("position")
    ranked = rows.withColumns({"_v": F.row_number().over(by_value), "_f": F.row_number().over(by_format)})
    codes = F.array_compact(F.array(F.when(F.col("_v") > 1, "duplicate_identifier_value"), F.when((F.col("_f") > 1) & F.col("format").isNotNull(), "duplicate_identifier_type_format")))
    return ranked.select("pkg_id", "position", F.explode(codes).alias("code"))


def repeated_ids(rows: DataFrame, id_col: str) -> DataFrame:
    """Trimmed ids that several rows of a package have."""
    return rows.groupBy("pkg_id", F.trim(id_col).alias(id_col)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def similar_keywords(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """rows (pkg_id, position, keyword): later keywords that differ from the first of theirs that is equal but for case, accents and blanks."""
    w = Window.partitionBy("pkg_id", *within, "_fold").orderBy("position")
    named = rows.withColumn("_fold", folded(F.col("keyword")))
    return named.withColumn("first", F.first("keyword").over(w)).where("keyword <> first").select("pkg_id", *within, "position", "keyword", "first")


def affiliation_text(*parts: str):
    return F.concat_ws(", ", *(ids.optional_text(F.col(p)) for p in parts))


def typed_fields(rows: DataFrame, json_col: str, fields: dict[str, str]) -> DataFrame:
    """Strictly typed reading of JSON: for each field its value as text, and a code when it is missing or of another type.

    fields: name -> type as schema_of_variant names it. Broken JSON gives invalid_json for every field.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(json_col))
    out = []
    for name, wanted in fields.items():
        got = F.try_variant_get("_v", f"$.{name}", "variant")
        kind = F.schema_of_variant(got)
        wrong = ~kind.startswith("DECIMAL") if wanted == "DECIMAL" else kind != wanted
        code = F.when(F.col("_v").isNull(), "invalid_json").when(got.isNull() | (kind == "VOID"), "missing_metadata_field").when(wrong, "invalid_field_type")
        out.append(F.struct(F.lit(name).alias("field"), F.when(code.isNull(), F.try_variant_get("_v", f"$.{name}", "string")).alias("value"), code.alias("code")))
    return parsed.select(*rows.columns, F.explode(F.array(*out)).alias("_f")).select(*rows.columns, "_f.*").drop(json_col)


def unmatched_signatures(signatures: DataFrame, people: DataFrame) -> DataFrame:
    """signatures (pkg_id, name) that no contributor's literal or given and family name equals, case and spacing aside."""
    names = F.array_compact(F.array(F.col("literal_name"), F.concat_ws(" ", "given_name", "family_name")))
    known = people.select("pkg_id", F.explode(names).alias("_name")).select("pkg_id", spaced(F.col("_name")).alias("_key"))
    return signatures.withColumn("_key", spaced(F.col("name"))).join(known, ["pkg_id", "_key"], "left_anti").drop("_key")


def with_profile(documents: DataFrame, profile: DataFrame) -> DataFrame:
    """Publication columns of `documents`, a blank one filled in from the institution's profile; without a profile nothing changes, and more than one row is an error."""
    shared = [c for c in profile.columns if c in documents.columns]
    rows = profile.select(*shared).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("one profile at most can fill in documents")
    given = {c: F.lit(rows[0][c]) for c in shared} if rows else {}
    return documents.select(*(F.coalesce(ids.optional_text(F.col(c)), given[c]).alias(c) if c in given else F.col(c) for c in documents.columns))
