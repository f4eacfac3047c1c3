"""Images with the title, caption and credits that stand around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.blocks import in_order

TITLE, CAPTION, CREDITS, NATIVE = "TEIfiguretitle", "TEIfigurecaption", "TEIfigurecredits", "Caption"


def figures(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (pkg_id, index, style_id, drawing_count) -> a row for each with one drawing: title, caption and credits indices.

    A title stands before, in the title style. Behind it one caption may stand, or two native captions, the
    first of which is the title when there is none yet; then one line of credits.
    """
    w = in_order()
    near = paragraphs.withColumns({f"_{k}": F.lead("style_id", k).over(w) if k > 0 else F.lag("style_id", -k).over(w) for k in (-1, 1, 2, 3)})
    one = near.where("drawing_count = 1")
    at = F.col("index")
    own, two = F.col("_-1") == TITLE, (F.col("_1") == NATIVE) & (F.col("_2") == NATIVE)
    pair = F.coalesce(two, F.lit(False)) & ~F.coalesce(own, F.lit(False))
    single = F.coalesce(F.col("_1").isin(CAPTION, NATIVE), F.lit(False)) & ~pair
    last = F.when(pair, 2).when(single, 1).otherwise(0)
    behind = F.when(last == 2, F.col("_3")).when(last == 1, F.col("_2")).otherwise(F.col("_1"))
    return one.select(
        "pkg_id", "index", F.when(own, at - 1).when(pair, at + 1).alias("title"), F.when(pair, at + 2).when(single, at + 1).alias("caption"), F.when(behind == CREDITS, at + last + 1).alias("credits")
    )


def orphans(paragraphs: DataFrame) -> DataFrame:
    """Titles, captions and credits that belong to no image: pkg_id, index."""
    used = figures(paragraphs).select("pkg_id", F.explode(F.array_compact(F.array("title", "caption", "credits"))).alias("index"))
    return paragraphs.where(F.col("style_id").isin(TITLE, CAPTION, CREDITS, NATIVE)).select("pkg_id", "index").join(used, ["pkg_id", "index"], "left_anti")


def media_targets(drawings: DataFrame, relations: DataFrame, media: DataFrame) -> DataFrame:
    """drawings (pkg_id, part, index, relation_id) -> the stored image's address by content, or the code of what is wrong.

    A relation must be there, once, lie inside the package and lead to an image whose bytes and declared
    type agree. Addresses go by digest, so an image used twice is stored once.
    """
    from quire.functions.identifiers import image_type
    from quire.operators.notes import resolved_relations

    found = resolved_relations(drawings, relations.select("pkg_id", "part", "relation_id", "sequence", "target", "mode"))
    unsafe = F.col("target").startswith("/") | F.col("target").contains("\\") | F.col("target").rlike(r"(^|/)\.\.(/|$)")
    placed = found.withColumn("path", F.when(~unsafe, F.concat(F.lit("word/"), F.regexp_replace("target", r"^(\./)+", ""))))
    joined = placed.join(media.select("pkg_id", "path", "sha256", "declared_type", image_type(F.col("head")).alias("kind")), ["pkg_id", "path"], "left")
    code = (
        F.when(F.col("target").isNull(), "missing_image_relationship_not_serializable")
        .when(F.col("duplicate"), "duplicate_image_relationship_not_serializable")
        .when(F.col("mode") == "External", "external_image_not_serializable")
        .when(F.coalesce(unsafe, F.lit(False)) | ~F.col("path").startswith("word/media/"), "unsafe_image_target_not_serializable")
        .when(F.col("sha256").isNull(), "missing_image_media_part")
        .when(F.col("kind").isNull(), "unsupported_image_type_not_serializable")
        .when(F.col("kind") != F.col("declared_type"), "image_content_type_mismatch")
    )
    address = F.concat(F.lit("media/"), "sha256", F.when(F.col("kind") == "image/png", ".png").otherwise(".jpg"))
    return joined.select("pkg_id", "part", "index", "relation_id", F.when(code.isNull(), address).alias("url"), code.alias("code"))
