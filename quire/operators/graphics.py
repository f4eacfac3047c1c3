"""Images of paragraphs: the stored image's address, or the first of the reasons why it cannot be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.identifiers import image_type
from quire.operators.roles import FIGURE_CONTAINERS

# The type of an image's relation, and how many bytes of images one document may use.
IMAGE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
MOST_USED = 256 << 20


def container(style: Column, custom: Column) -> Column:
    """Whether a paragraph of this style may hold a figure: no style, or one of three that are not custom."""
    return style.isNull() | (style.isin(*FIGURE_CONTAINERS) & ~F.coalesce(custom, F.lit(False)))


def media_path(target: Column, folder: str = "word") -> Column:
    """The part that a relation's target names, `.` steps taken out; null if it is absolute, goes up, or leads out of word/media."""
    unsafe = target.startswith("/") | target.contains("\\") | target.rlike(r"(^|/)\.\.(/|$)") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    steps = F.filter(F.split(F.concat(F.lit(folder + "/"), target), "/"), lambda s: ~s.isin("", "."))
    path = F.array_join(steps, "/")
    return F.when(~unsafe & path.startswith("word/media/"), path)


def graphics(paragraphs: DataFrame, drawings: DataFrame, relations: DataFrame, media: DataFrame) -> DataFrame:
    """pkg_id, index, url, description, sha256, code: one row for each paragraph with drawings.

    paragraphs: pkg_id, part, index, style_id, style_is_custom, numbered, has_other (text or items besides
    drawings). drawings: pkg_id, part, index, link, placement, embedded, linked (arrays of relation ids),
    cropped, transformed, invalid, description. Reasons are looked for in a fixed order.
    """
    per = drawings.groupBy("pkg_id", "part", "index").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("link", "placement", "embedded", "linked", "cropped", "transformed", "invalid", "description")).alias("d"))
    rows = paragraphs.join(per, ["pkg_id", "part", "index"]).withColumn("relation_id", F.when(F.size("d.embedded") == 1, F.get("d.embedded", F.lit(0))))
    w = Window.partitionBy("pkg_id", "part", "relation_id")
    known = relations.withColumns({"_rank": F.row_number().over(w.orderBy("sequence")), "_many": F.count(F.lit(1)).over(w) > 1}).where("_rank = 1")
    known = known.select("pkg_id", "part", "relation_id", "target", "type", "mode", "_many")
    stored = media.select("pkg_id", "path", "sha256", "declared_type", image_type(F.col("head")).alias("sniffed"))
    joined = rows.join(known, ["pkg_id", "part", "relation_id"], "left").withColumn("path", media_path(F.col("target"))).join(stored, ["pkg_id", "path"], "left")
    d = F.col("d")
    yes = lambda c: F.coalesce(c, F.lit(False))
    code = (
        F.when(yes(F.col("numbered")), "numbered_figure_not_serializable")
        .when(~yes(container(F.col("style_id"), F.col("style_is_custom"))), "mixed_text_and_image_not_serializable")
        .when(F.col("n") > 1, "multiple_images_in_paragraph_not_serializable")
        .when(yes(F.col("has_other")), "mixed_text_and_image_not_serializable")
        .when(d["link"].isNotNull(), "hyperlinked_image_not_serializable")
        .when(yes(d["invalid"]), "invalid_drawing_property_not_serializable")
        .when(~yes(d["placement"] == "inline"), "floating_image_not_serializable")
        .when(yes(d["cropped"]), "cropped_image_not_serializable")
        .when(yes(d["transformed"]), "transformed_image_not_serializable")
        .when(yes(F.size(d["linked"]) > 0), "external_image_not_serializable")
        .when(F.col("relation_id").isNull(), "multiple_image_sources_not_serializable")
        .when(yes(F.col("_many")), "duplicate_image_relationship_not_serializable")
        .when(F.col("target").isNull(), "missing_image_relationship")
        .when(yes(F.col("mode") == "External"), "external_image_not_serializable")
        .when(~yes(F.col("type") == IMAGE), "unsupported_image_relationship")
        .when(F.col("path").isNull(), "unsafe_image_target")
        .when(F.col("sha256").isNull(), "missing_image_media_part")
        .when(~yes(F.col("declared_type").isin("image/png", "image/jpeg")), "unsupported_image_format")
        .when(~yes(F.col("sniffed") == F.col("declared_type")), "image_content_type_mismatch")
        .when(F.coalesce(F.trim(d["description"]), F.lit("")) == "", "missing_figure_description")
    )
    url = F.concat(F.lit("media/"), "sha256", F.when(F.col("sniffed") == "image/png", ".png").otherwise(".jpg"))
    return joined.select("pkg_id", "index", F.when(code.isNull(), url).alias("url"), d["description"].alias("description"), F.when(code.isNull(), F.col("sha256")).alias("sha256"), code.alias("code"))


def used_media(found: DataFrame, media: DataFrame, most: int = MOST_USED) -> tuple[DataFrame, DataFrame]:
    """(pkg_id, url, path, sha256, size of each image a document uses, once), and the documents whose images are together over `most` bytes."""
    uses = found.where("url is not null").select("pkg_id", "url", "sha256").distinct()
    stored = media.groupBy("pkg_id", "sha256").agg(F.min(F.struct("path", "size")).alias("_m"))
    assets = uses.join(stored, ["pkg_id", "sha256"]).select("pkg_id", "url", F.col("_m.path").alias("path"), "sha256", F.col("_m.size").alias("size"))
    over = assets.groupBy("pkg_id").agg(F.sum("size").alias("total")).where(F.col("total") > most)
    return assets, over.select("pkg_id", "total", F.lit("used_media_too_large").alias("code"))


def asset_code(url: Column, sha256: Column, content: Column) -> Column:
    """Why an image cannot be stored: its name, digest and first bytes must agree. Null if they do."""
    kind = image_type(content)
    expected = F.concat(F.lit("media/"), sha256, F.when(kind == "image/png", ".png").when(kind == "image/jpeg", ".jpg"))
    return (
        F.when(~url.startswith("media/") | url.contains(".."), "invalid_figure_media_url").when(~sha256.rlike("^[0-9a-f]{64}$"), "invalid_figure_sha256")
        .when(F.sha2(content, 256) != sha256, "figure_hash_mismatch").when(kind.isNull(), "unsupported_figure_media_type").when(url != expected, "invalid_figure_media_url")
    )


def asset_conflicts(assets: DataFrame) -> DataFrame:
    """pkg_id, url, code of assets whose address stands for two digests."""
    twice = assets.groupBy("url").agg(F.count_distinct("sha256").alias("n")).where("n > 1").select("url")
    return assets.join(twice, "url").select("pkg_id", "url", F.lit("conflicting_assets").alias("code")).distinct()


def asset_problems(assets: DataFrame, content: str = "content") -> DataFrame:
    """assets (pkg_id, url, sha256, content): those whose name, digest, or first bytes do not agree, and addresses with two contents."""
    own = assets.withColumn("code", asset_code(F.col("url"), F.col("sha256"), F.col(content))).where("code is not null").select("pkg_id", "url", "code")
    return own.unionByName(asset_conflicts(assets))
