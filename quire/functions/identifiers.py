"""Identifiers and short coded values, checked by column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of metadata values that documents may hold.
LANGUAGE = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"
ORCID = r"^(https://orcid\.org/)?([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])$"
DOI = r"^10\.[0-9]{4,9}/\S+$"
DOI_PREFIX = r"(?i)^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/|doi:)"
ISSN = r"^[0-9]{4}-?[0-9]{3}[0-9Xx]$"
PARTIAL_DATE = r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _digit(text: Column, at: Column | int) -> Column:
    mark = F.substring(text, F.lit(at) if isinstance(at, int) else at, F.lit(1))
    return F.when(mark == "X", 10).otherwise(mark.try_cast("int"))


def _weighted(text: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for at, weight in enumerate(weights, 1):
        total = total + _digit(text, at) * weight
    return total


def orcid(value: Column) -> Column:
    """The bare form when the ISO 7064 mod 11-2 check holds, else null."""
    bare = F.regexp_extract(F.trim(value), ORCID, 2)
    digits = F.replace(bare, F.lit("-"))
    total = F.lit(0)
    for at in range(1, 16):
        total = (total + _digit(digits, at)) * 2
    wanted = (12 - total % 11) % 11
    return F.when((bare != "") & (_digit(digits, 16) == wanted), bare)


def doi(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(value), DOI_PREFIX, "")
    return F.when(bare.rlike(DOI), bare)


def isbn(value: Column) -> Column:
    """The 10 or 13 characters without hyphens and blanks when the check digit holds, else null."""
    compact = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    long = compact.rlike("^[0-9]{13}$") & (_weighted(compact, [1, 3] * 6 + [1]) % 10 == 0)
    short = compact.rlike("^[0-9]{9}[0-9X]$") & (_weighted(compact, list(range(10, 0, -1))) % 11 == 0)
    return F.when(long | short, compact)


def issn(value: Column) -> Column:
    compact = F.upper(F.replace(F.trim(value), F.lit("-")))
    valid = F.trim(value).rlike(ISSN) & (_weighted(compact, list(range(8, 0, -1))) % 11 == 0)
    return F.when(valid, F.concat(F.substring(compact, 1, 4), F.lit("-"), F.substring(compact, 5, 4)))


def language_tag(value: Column) -> Column:
    """Whether the raw value, untrimmed, is a well-formed tag."""
    return F.coalesce(value.rlike(LANGUAGE), F.lit(False))


def primary_language(value: Column) -> Column:
    return F.lower(F.substring_index(F.trim(value), "-", 1))


def partial_date(value: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD; a full date must be in the calendar."""
    full = F.length(value) == 10
    return F.coalesce(value.rlike(PARTIAL_DATE) & (~full | F.try_to_date(value, "yyyy-MM-dd").isNotNull()), F.lit(False))


def web_address(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def strict_number(value: Column) -> Column:
    """present, valid, canonical: ASCII digits alone are valid, and '01' is 1."""
    valid = value.isNotNull() & value.rlike("^[0-9]+$")
    return F.struct(value.isNotNull().alias("present"), F.coalesce(valid, F.lit(False)).alias("valid"), F.when(valid, value.try_cast("bigint")).alias("canonical"))


def on_off(present: Column, value: Column) -> Column:
    """A switch: absent is null, without a value true, 0, false and off false, anything else true."""
    return F.when(present, F.when(value.isNull(), True).otherwise(~F.lower(value).isin("0", "false", "off")))


def image_type(content: Column) -> Column:
    """From the first bytes: image/png, image/jpeg, or null."""
    png = F.substring(content, 1, 8) == F.lit(bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A]))
    jpeg = F.substring(content, 1, 3) == F.lit(bytes([0xFF, 0xD8, 0xFF]))
    return F.when(png, "image/png").when(jpeg, "image/jpeg")


def optional_text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))
