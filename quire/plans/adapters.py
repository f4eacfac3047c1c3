"""Canonical rows made from flat tables, so that the operators run, and can be compared with SQL, on any corpus."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quire.operators.roles import with_roles
from quire.staging import written

# Style of a paragraph by a number from its place; None is a paragraph without a style.
STYLES = ("Heading1", "Heading2", "Normal", "Quote", "Quote", "IntenseQuote", "BlockText", "Salutation", "Signature", None, "BodyText", "Heading3", "TEIbiblreference", "Custom1", "Title", "Bibliography")
# Line items of a task, where tasks go by the size of the table.
LINES_OF_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small file dealt over all tasks, where the work on each is heavy."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered_lines(spark: SparkSession, sf_dir: str, package: Column) -> DataFrame:
    """One row for each order and line number (pkg_id, l_orderkey, l_linenumber, s, p), dealt by package once for all that follows.

    A larger table is dealt over more tasks, so that the rows of a task stay the same unless a package has more.
    """
    lines = table(spark, sf_dir, "lineitem")
    tasks = lines.count() // LINES_OF_TASK
    rows = lines.select(package.alias("pkg_id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    most = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_package = rows.repartition(most, "pkg_id") if tasks > 1 else rows.repartition("pkg_id")
    return by_package.groupBy("pkg_id", "l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as styled paragraphs, two neighbours to a style."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pkg_id"), F.posexplode(F.split("text", "\n")).alias("index", "text"))
    number = (F.col("pkg_id") * 31 + F.floor(F.col("index") / 2) * 7) % 16
    style = F.get(F.array(*(F.lit(s) for s in STYLES)), number.cast("int"))
    return lines.withColumns({"style_id": style, "style_name": F.when(style == "Custom1", "Body  Text"), "style_is_custom": style == "Custom1", "outline_level": F.when((F.col("pkg_id") + F.col("index")) % 11 == 0, 2).cast("int")})


def collective_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with roles; in three documents of four no heading is a part, in each second of these it opens a text."""
    rows = with_roles(paragraphs(spark, sf_dir))
    key = F.col("pkg_id")
    part = (F.col("role") == "heading") & (F.col("level") == 1) & (key % 4 != 0)
    return rows.withColumn("level", F.when(part, (2 + key % 2).cast("int")).otherwise(F.col("level")))


def signed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, most of them signatures, and headings of three levels between."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pkg_id"), F.posexplode(F.split("text", "\n")).alias("index", "text"))
    at = (F.col("pkg_id") * 7 + F.col("index") * F.col("index") * 3) % 11
    return lines.withColumn("style_id", F.when(at < 5, "Signature").when(at < 7, "Heading1").when(at == 7, "Heading2").when(at == 8, "Heading3"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pkg_id"), F.col("turn").cast("int").alias("index"), "role", "text")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order defines a note; one order in seven under the next number, which few references have."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((key % 100).alias("pkg_id"), (key * 2 + F.when(key % 7 == 0, 1).otherwise(0)).alias("note_id"))


def note_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item refers to its order's note; one in three by the next number."""
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select((key % 100).alias("pkg_id"), (key * 2 + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)).alias("note_id"))


def nested_notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as notes that refer to notes: (notes with xml, references inside notes, references in bodies).

    The notes of a document are numbered; most refer to two further ones, some back to the one before them, some to themselves.
    """
    order = Window.partitionBy("pkg_id").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("pkg_id"), "o_orderkey", "o_orderpriority").withColumn("i", F.row_number().over(order) - 1)
    key, i = F.col("o_orderkey"), F.col("i")
    on = lambda test, number: F.when(test, number)
    targets = F.array_compact(F.array(on(key % 3 != 0, 2 * i + 1), on(key % 3 != 0, 2 * i + 2), on(key % 37 == 0, F.floor((i - 1) / 2)), on(key % 53 == 0, i)))
    name = lambda n: F.concat(F.lit("footnote:"), n.cast("string"))
    tokens = F.array_join(F.transform("targets", lambda t: F.concat(F.lit("\x01"), name(t), F.lit("\x02"))), "")
    rows = rows.withColumn("targets", targets)
    notes = rows.select("pkg_id", name(i).alias("note_id"), F.concat(F.lit('<note place="foot"><p>'), "o_orderpriority", tokens, F.lit("</p></note>")).alias("xml"))
    inner = rows.select("pkg_id", name(i).alias("note_id"), F.explode("targets").alias("t")).select("pkg_id", "note_id", name(F.col("t")).alias("target"))
    return notes, inner, rows.where(((i == 0) & (F.col("pkg_id") % 2 == 0)) | (i % 7 == 3)).select("pkg_id", name(i).alias("note_id"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("long")
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("pkg_id"), F.col("c_custkey").alias("person"), F.array(nation, (nation + 7) % 30).alias("affiliation_ids"), F.col("c_name").alias("literal_name"), F.lit("Ada").alias("given_name"), F.col("c_mktsegment").alias("family_name"))


def affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = spark.range(40).select(F.col("id").alias("pkg_id"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("affiliation_id"), F.col("n_name").alias("name"))
    return packages.crossJoin(F.broadcast(nations))


def identifier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text, kind = key.cast("string"), key % 8
    value = (
        F.when(kind == 0, F.concat(F.lit("978-"), F.lpad(text, 9, "0"), F.lit("-"), (key % 10).cast("string")))
        .when(kind == 1, F.concat(F.lpad(text, 9, "0"), F.when(key % 11 == 10, "X").otherwise((key % 11).cast("string"))))
        .when(kind.isin(2, 3), F.concat(F.lpad(F.expr("o_orderkey % 10000").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.expr("o_custkey % 1000").cast("string"), 3, "0"), (key % 10).cast("string")))
        .when(kind == 4, F.concat(F.lit("https://doi.org/10."), F.lpad(F.expr("o_custkey % 1000").cast("string"), 4, "1"), F.lit("/a"), text))
        .when(kind == 5, F.concat(F.lit(" doi:10.12/"), text))
        .when(kind == 6, F.concat(F.lit("0000-0001-"), F.lpad(F.expr("o_orderkey % 10000").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.expr("o_custkey % 1000").cast("string"), 3, "0"), (key % 10).cast("string")))
        .otherwise(" ")
    )
    types = F.array(*(F.lit(t) for t in ("isbn-13", "isbn-10", "issn", "eissn", "doi", "doi", "local", "ark")))
    shape = F.when(key % 3 == 0, "print").when(key % 3 == 1, "epub").when(key % 17 == 0, "scroll")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("pkg_id"), key.alias("position"), F.get(types, kind.cast("int")).alias("type"), shape.alias("format"), value.alias("value"))


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bibliographic records: pkg_id, json. What a record says goes by the customer's key."""
    k = F.col("c_custkey")
    on = lambda test, value: F.when(test, value if not isinstance(value, str) else F.lit(value))
    texts = lambda *values: F.array(*(F.lit(v) for v in values)).cast("array<string>")
    obj = lambda **fields: F.struct(*((F.lit(v) if isinstance(v, (str, int)) else v).alias(n) for n, v in fields.items()))

    def person(i):
        n = k + i
        return obj(
            id=F.concat(F.lit("c"), i), role=F.get(texts("author", "editor", "translator", "scientific_editor", "other"), (n % 5).cast("int")), role_label=on(n % 5 == 4, "reader"),
            literal_name=on(n % 2 == 0, F.concat(F.lit("Name "), n)), given_name=on((n % 2 == 1) & (n % 3 > 0), "Ada"), family_name=on(n % 2 == 1, F.concat(F.lit("F&"), n)),
            email=on(n % 4 == 0, "a@x.org"), orcid=on(n % 3 == 0, "https://orcid.org/0000-0002-1825-0097"), affiliations=F.when(n % 3 == 0, texts()).when(n % 3 == 1, texts("a0")).otherwise(texts("a1", "a0")),
        )

    places = F.array(
        obj(id="a0", name="Institute & Co", unit=F.lit(None).cast("string"), city="Lyon", country=F.lit(None).cast("string"), ror=on(k % 2 == 0, "https://ror.org/0a")),
        obj(id="a1", name="College", unit="Letters", city=F.lit(None).cast("string"), country="FR", ror=on(k % 3 == 0, "https://ror.org/1b")),
    )
    number = lambda kind, value, shape=None: obj(type=kind, value=value, format=F.lit(None).cast("string") if shape is None else shape)
    numbers = (
        F.when(k % 3 == 0, F.array(number("doi", F.concat(F.lit("doi:10.1234/a"), k)), number("issn", "0378-5955")))
        .when(k % 9 == 4, F.array(number("local", F.concat(F.lit(" L"), k)))).when(k % 3 == 1, F.array(number("isbn-13", "978-2-07-036822-8", on(k % 9 != 1, F.when(k % 2 == 1, "print").otherwise("epub")))))
    )
    words = lambda language, scheme, *items: obj(language=language, scheme=scheme, items=texts(*items))
    record = obj(
        schema_version="2.0", source_document=obj(path="a.docx", sha256=F.repeat(F.lit("0"), 64)),
        document=obj(language=F.when(k % 2 == 1, "fr").otherwise("en-GB"), title=F.concat("c_name", F.lit(" & <"), "c_mktsegment", F.lit(">")), subtitle=on(k % 3 == 0, 'On "terms"')),
        contributors=F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (k % 4).cast("int")), person), affiliations=places,
        editorial_responsibility=on(k % 11 == 0, F.array(obj(responsibility="R", name="N"))), identifiers=numbers, keywords=on(k % 4 == 1, F.array(words("fr", "keywords", "x & y", "z"), words("en", "s", "q"))),
        publication=obj(publisher=obj(name=on(k % 4 > 0, "House"), place=on(k % 6 == 0, "Paris"), url=on(k % 7 == 0, "https://x.org/?a=1&b=2")), publication_date=on(k % 3 == 1, "2024-05")),
        rights=obj(license=obj(spdx_id=on(k % 8 == 0, "CC-BY-4.0")), statement=on(k % 8 == 1, "All is free"), holder=on(k % 8 == 2, "Me")),
        collection=F.when(k % 10 == 0, obj(title="S", issn="0378-5955", volume="3", editor="E")).when(k % 10 == 1, obj(title="S", **{f: F.lit(None).cast("string") for f in ("issn", "volume", "editor")})),
        pagination=F.when(k % 6 == 1, obj(**{"from": 1, "to": k.cast("int"), "extent": F.lit(None).cast("int")})).when(k % 6 == 2, obj(**{"from": F.lit(None).cast("int"), "to": F.lit(None).cast("int"), "extent": 9})),
        funding=F.when(k % 5 == 0, F.array(obj(funder="Fund <A>", grant_number=F.concat(F.lit("G"), k)))).when(k % 5 == 1, F.array(obj(funder="B", grant_number=F.lit(None).cast("string")))),
    )
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select(k.alias("pkg_id"), F.to_json(record).alias("json"))


def list_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as paragraphs with raw numbering: one row for each order and line number."""
    lines = numbered_lines(spark, sf_dir, F.col("l_orderkey"))
    raw = F.when(F.col("s") % 9 == 8, "x1").when(F.col("s") % 9 == 7, F.lit(None)).otherwise(F.concat(F.when(F.col("p") % 2 == 0, "0").otherwise(""), (F.col("s") % 9).cast("string")))
    level = F.when(F.col("p") % 7 == 0, F.lit(None)).when(F.col("p") % 7 == 1, "12").otherwise((F.col("p") % 4).cast("string"))
    return lines.select("pkg_id", F.col("l_linenumber").cast("int").alias("index"), raw.alias("raw_id"), level.alias("raw_level"))


def listed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks of some hundred documents, with the class that decides over lists; one block in forty has no row."""
    lines = numbered_lines(spark, sf_dir, F.col("l_orderkey") % 499)
    order = Window.partitionBy("pkg_id").orderBy("l_orderkey", "l_linenumber")
    rows = lines.withColumn("index", F.row_number().over(order).cast("int"))
    p, s = F.col("p"), F.col("s")
    kind = F.when(p % 10 < 6, "item").when(p % 10 == 6, "candidate").when(p % 10 == 7, F.when(s % 2 == 0, "candidate").otherwise("rejected")).when(p % 10 == 8, "quiet").otherwise("other")
    number, level = F.floor(F.col("l_orderkey") / 499) % 5 + F.when(s % 7 == 0, 1).otherwise(0), (F.floor(p / 10) % 3 + F.when(s % 23 == 0, 2).otherwise(0)).cast("int")
    item = kind == "item"
    only = lambda c: F.when(item, c)
    form = F.when(level % 2 == 0, "ordered").otherwise("bulleted")
    return rows.where((s + p) % 40 != 0).select(
        "pkg_id", "index", F.col("index").alias("block"), kind.alias("class"), only(number).cast("long").alias("num_id"), only(level).alias("level"),
        only(form).alias("kind"), only(F.lit("decimal")).alias("number_format"), only(F.when(s % 11 == 0, 3).otherwise(1)).alias("start"), (s % 13 == 0).alias("empty"),
    )


def numbering_tables(spark: SparkSession, packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same instances, levels and overrides for every package."""
    each = written(packages.select("pkg_id").distinct(), "packages")
    instances = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 99), (5, 50)], "num_id long, abstract_id long")
    levels = spark.createDataFrame([(10, 0, "decimal", 1, None), (10, 1, "lowerLetter", None, None), (10, 2, "chicago", 1, None), (20, 0, "bullet", None, None), (20, 1, "bullet", None, "7"), (30, 1, "", 4, None), (30, 2, "none", 1, None), (50, 0, "upperRoman", 3, None), (50, 3, "ordinal", 1, None)], "abstract_id long, level int, number_format string, start int, picture string")
    overrides = spark.createDataFrame([(1, 0, 5), (5, 3, 9)], "num_id long, level int, start_override int")
    return tuple(each.crossJoin(F.broadcast(t)) for t in (instances, levels, overrides))


@F.pandas_udf(BinaryType())
def package_bytes(styles: pd.Series, texts: pd.Series) -> pd.Series:
    """A minimal package for each document: its paragraphs, their styles and a style sheet."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def made(styles, texts):
        body = "".join(f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in zip(styles, texts, strict=True))
        sheet = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"{" w:customStyle=" + chr(34) + "1" + chr(34) if s == "Custom1" else ""}><w:name w:val="{s}"/></w:style>' for s in sorted({s for s in styles if s}))
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w") as archive:
            archive.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
            archive.writestr("word/styles.xml", f"<w:styles {w}>{sheet}</w:styles>")
        return file.getvalue()

    return pd.Series([made(s, t) for s, t in zip(styles, texts, strict=True)])


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as package files: path, content."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "style_id", "text")))
    each = paragraphs(spark, sf_dir).groupBy("pkg_id").agg(ordered.alias("p"))
    return each.select(F.col("pkg_id").cast("string").alias("path"), package_bytes("p.style_id", "p.text").alias("content"))
