"""Blocks of several paragraphs written as XML: lists, figures, tables, bibliographies.

Each function gives pieces (pkg_id, index, piece) that stand in a body where their paragraph stood;
paragraphs that became part of another block have an empty piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.tei import element, escaped, quoted


def list_pieces(items: DataFrame) -> DataFrame:
    """items (pkg_id, index, path, part, kind, number_format, start, xml): the item with the lists and items that open and close around it.

    `path` has list:item for each level, as `lists.list_items` gives it. A list opens with its first item.
    Behind an item close all lists that the next item is not in, and the items around them; an item with a
    child list stays open until that list has ended. Rows of a part above 0 go on with the item before them: it then has a `p`
    for each. Items without a path (errors) are left out.
    """
    order = Window.partitionBy("pkg_id").orderBy("index")
    rows = items.where("path is not null").withColumn("_own", F.split("path", r"\.")).withColumn("_next", F.lead("_own").over(order))
    lists = lambda c: F.transform(c, lambda x: F.substring_index(x, ":", 1))
    depth, ahead = F.size("_own"), F.coalesce(F.size("_next"), F.lit(0))
    ours, theirs = lists(F.col("_own")), lists(F.col("_next"))
    shared = F.when(F.col("_next").isNull(), 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), depth), lambda n: (n <= ahead) & (F.slice(ours, 1, n) == F.slice(theirs, 1, n)))))
    first = F.element_at("_own", -1).endswith(":1")
    kind = F.when(F.col("kind") == "bulleted", "bulleted").otherwise(F.col("number_format"))
    number = F.when(F.col("kind") == "ordered", F.concat(F.lit(' n="'), F.col("start").cast("string"), F.lit('"')))
    opening = F.when(first, F.concat(F.lit('<list type="'), quoted(kind), F.lit('"'), F.coalesce(number, F.lit("")), F.lit(">"))).otherwise("")
    lists_closed = F.concat(F.repeat(F.lit("</list></item>"), F.greatest(depth - shared - 1, F.lit(0))), F.when(depth > shared, "</list>").otherwise(""), F.when((depth > shared) & (shared > 0) & (ahead == shared), "</item>").otherwise(""))
    closing = F.when((ahead > depth) & (shared == depth), "").otherwise(F.concat(F.lit("</item>"), lists_closed))
    goes_on = F.coalesce((F.lead("path").over(order) == F.col("path")) & (F.lead("part").over(order) > 0), F.lit(False))
    p = F.concat(F.lit("<p>"), F.coalesce("xml", F.lit("")), F.lit("</p>"))
    start = F.when(F.col("part") > 0, p).otherwise(F.concat(opening, F.lit("<item>"), F.when(goes_on, p).otherwise(F.coalesce("xml", F.lit("")))))
    return rows.select("pkg_id", "index", F.concat(start, F.when(goes_on, "").otherwise(closing)).alias("piece"))


def figure_pieces(figures: DataFrame, graphics: DataFrame, texts: DataFrame) -> DataFrame:
    """figures (pkg_id, index, title, caption, credits), graphics (pkg_id, index, url, description), texts (pkg_id, index, xml)."""
    rows = figures.join(graphics.where("url is not null").select("pkg_id", "index", "url", "description"), ["pkg_id", "index"])
    for part in ("title", "caption", "credits"):
        rows = rows.join(texts.select("pkg_id", F.col("index").alias(part), F.col("xml").alias(f"_{part}")), ["pkg_id", part], "left")
    empty = lambda part: F.coalesce(F.col(f"_{part}"), F.lit(""))
    optional = lambda name, part, **marks: F.when(F.col(part).isNotNull(), element(name, empty(part), **marks)).otherwise("")
    inside = F.concat(
        optional("head", "title"), F.lit('<graphic url="'), quoted(F.col("url")), F.lit('"/>'), element("figDesc", escaped(F.col("description"))),
        optional("p", "caption", rend=F.lit("caption")), optional("p", "credits", rend=F.lit("credits")),
    )
    whole = rows.select("pkg_id", "index", element("figure", inside).alias("piece"))
    absorbed = rows.select("pkg_id", F.explode(F.array_compact(F.array("title", "caption", "credits"))).alias("index"), F.lit("").alias("piece"))
    return whole.unionByName(absorbed)


def table_xml(cells: DataFrame) -> DataFrame:
    """cells (pkg_id, block, row, col, header, xml) -> pkg_id, block, piece: the tables that have no problem."""
    role = lambda c: F.when(c, F.lit(' role="label"')).otherwise("")
    cell = F.concat(F.lit("<cell"), role(F.col("header")), F.lit(">"), F.coalesce("xml", F.lit("")), F.lit("</cell>"))
    rows = cells.groupBy("pkg_id", "block", "row").agg(F.bool_or("header").alias("header"), F.array_sort(F.collect_list(F.struct("col", cell.alias("xml")))).alias("_c"))
    row = F.concat(F.lit("<row"), role(F.col("header")), F.lit(">"), F.array_join(F.transform("_c", lambda x: x["xml"]), ""), F.lit("</row>"))
    tables = rows.groupBy("pkg_id", "block").agg(F.array_sort(F.collect_list(F.struct("row", row.alias("xml")))).alias("_r"), F.max(F.size("_c")).alias("_n"))
    start = F.concat(F.lit('<table rows="'), F.size("_r"), F.lit('" cols="'), F.col("_n"), F.lit('">'))
    return tables.select("pkg_id", "block", F.concat(start, F.array_join(F.transform("_r", lambda x: x["xml"]), ""), F.lit("</table>")).alias("piece"))


def bibliography_xml(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (pkg_id, index, part: head or entry, xml) -> pkg_id, back. Entries without text are left out; without an entry there is no bibliography."""
    parts = lambda kind: F.array_join(F.transform(F.filter(F.col("_p"), lambda x: x["part"] == kind), lambda x: x["xml"]), "")
    entry = F.when(F.col("part") == "entry", element("bibl", F.nullif(F.col("xml"), F.lit("")))).otherwise(element("head", F.nullif(F.col("xml"), F.lit(""))))
    rows = paragraphs.withColumn("_xml", entry).where("_xml is not null")
    whole = rows.groupBy("pkg_id").agg(F.array_sort(F.collect_list(F.struct("index", "part", F.col("_xml").alias("xml")))).alias("_p")).where(F.exists("_p", lambda x: x["part"] == "entry"))
    return whole.select("pkg_id", F.concat(F.lit('<back><div type="bibliography">'), parts("head"), F.lit("<listBibl>"), parts("entry"), F.lit("</listBibl></div></back>")).alias("back"))


def front_xml(abstracts: Column) -> Column:
    """abstracts: array of (type, language, text) -> the front with a division for each, a paragraph for each line that is not blank."""
    lines = lambda t: F.array_join(F.transform(F.filter(F.split(t, r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("<p>"), escaped(F.trim(x)), F.lit("</p>"))), "")
    one = lambda a: F.concat(F.lit('<div type="abstract"'), F.when(a["type"] == "back-cover", ' n="back-cover"').otherwise(""), F.lit(' xml:lang="'), quoted(a["language"]), F.lit('">'), lines(a["text"]), F.lit("</div>"))
    return F.when(F.size(abstracts) > 0, F.concat(F.lit("<front>"), F.array_join(F.transform(abstracts, one), ""), F.lit("</front>")))
