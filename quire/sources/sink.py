"""Books, their images and records as files: each whole or not at all, however often a task runs."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.graphics import asset_code, asset_conflicts
from quire.sources.packages import MOST_MEDIA
from quire.staging import written

#: Bytes of images that one Arrow batch may hold before it is sent on; a single image may be larger.
TOGETHER = 16 << 20


def put(place: fs.FileSystem, path: str, data: bytes) -> None:
    """`data` at `path`: a hidden file beside it is written first and moved there whole, and goes if that fails."""
    folder, _, name = path.rpartition("/")
    place.create_dir(folder, recursive=True)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with place.open_output_stream(aside) as out:
            out.write(data)
        place.move(aside, path)
    except OSError:
        if place.get_file_info(aside).type != fs.FileType.NotFound:
            place.delete_file(aside)
        raise


def _images(content: bytes, assets: list[dict]) -> Iterator[tuple[dict, bytes | None, str | None]]:
    """Each asset with its bytes, or with the reason why the package does not give them."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except Exception:
        yield from ((x, None, "unreadable_image_media") for x in assets)
        return
    for x in assets:
        try:
            large = archive.getinfo(x["path"]).file_size > MOST_MEDIA
        except KeyError:
            yield x, None, "missing_image_media_part"
            continue
        if large:
            yield x, None, "image_media_too_large"
            continue
        try:
            yield x, archive.read(x["path"]), None
        except Exception:
            yield x, None, "unreadable_image_media"


_FOUND = pa.schema([("pkg_id", pa.string()), ("url", pa.string()), ("sha256", pa.string()), ("content", pa.binary()), ("code", pa.string())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for pkg_id, content, assets in zip(*batch.columns, strict=True):
            for x, data, code in _images(content.as_py() or b"", assets.as_py()):
                held.append({"pkg_id": pkg_id.as_py(), "url": x["url"], "sha256": x["sha256"], "content": data, "code": code})
                size += len(data or b"")
                if size >= TOGETHER:
                    yield pa.RecordBatch.from_pylist(held, _FOUND)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _FOUND)


def _with_files(files: DataFrame, assets: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """A row per package with images: pkg_id, content, and its assets (as many as one package uses) in an array."""
    per = assets.groupBy("pkg_id").agg(F.array_sort(F.collect_list(F.struct("url", "path", "sha256"))).alias("assets"))
    return files.select(F.col(id_col).cast("string").alias("pkg_id"), F.col(content_col).alias("content")).join(per, "pkg_id").select("pkg_id", "content", "assets")


def extracted(files: DataFrame, assets: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """pkg_id, url, sha256, content, code of each image in `assets` (pkg_id, url, path, sha256), read again from its package.

    content is null where code says why it could not be read. A package that is not in `files` gives no rows; one with
    null content is unreadable.
    """
    return _with_files(files, assets, id_col, content_col).mapInArrow(_extracted, "pkg_id string, url string, sha256 string, content binary, code string")


def _standing(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    place, root = fs.FileSystem.from_uri(target)
    for batch in batches:
        there, same = [], []
        for url, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            there.append(place.get_file_info(f"{root}/{url}").type != fs.FileType.NotFound)
            digest = hashlib.sha256()
            if there[-1]:
                with place.open_input_stream(f"{root}/{url}") as given:
                    while data := given.read(1 << 20):
                        digest.update(data)
            same.append(digest.hexdigest() == name)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(there, pa.bool_()), pa.array(same, pa.bool_())], names=["url", "sha256", "there", "same"])


def _stored(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    place, root = fs.FileSystem.from_uri(target)
    for batch in batches:
        urls = []
        for pkg_id, content, assets in zip(*batch.columns, strict=True):
            for x, data, code in _images(content.as_py() or b"", assets.as_py()):
                if code or hashlib.sha256(data).hexdigest() != x["sha256"]:
                    raise ValueError(f"image_media_changed_during_conversion: {x['url']} of {pkg_id.as_py()}")
                put(place, f"{root}/{x['url']}", data)
                urls.append(x["url"])
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string())], names=["url"])


def _texts(batches: Iterator[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    place, root = fs.FileSystem.from_uri(target)
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            put(place, f"{root}/{name}", text.as_py().encode())
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])


def write_texts(rows: DataFrame, target: str) -> DataFrame:
    """Writes rows (name, text) as files below `target`; returns the names written. Names must differ and be relative."""
    return written(rows.select("name", "text").mapInArrow(lambda it: _texts(it, target), "name string"), "written")


def output_name(path, ending: str = ".xml"):
    """A package's base name with another ending; null if there is none."""
    base = F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", "")
    return F.when(base.rlike(r"[^.]"), F.concat(base, F.lit(ending)))


def write_books(books: DataFrame, files: DataFrame, assets: DataFrame, target: str, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Writes books (pkg_id, xml) with their images below `target`: pkg_id, name, media_written, media_reused, code of each.

    target: a folder that all executors see, as a path or an address pyarrow knows. assets: pkg_id, url, path, sha256 of
    the images each book uses (`graphics.used_media`), files: the packages. All images of all books are read and checked,
    with what stands at their addresses, before anything is written; a book with a fault gets no file and a code, and so do
    books that would have one name (output_name_taken) or none (no_output_name). Then images come, each once however many books use it, from
    the book with the smallest id, and texts last. An image has its digest as its name and every file is moved into place whole, so a task
    that runs again leaves the same files. A text that stands there already is replaced, an image is not.
    """
    named = books.select("pkg_id", output_name(F.col("pkg_id")).alias("name"))
    taken = named.groupBy("name").count().where("count > 1").select("name", F.lit(True).alias("taken"))
    named = named.join(taken, "name", "left").select("pkg_id", "name", F.when(F.col("name").isNull(), "no_output_name").when(F.col("taken"), "output_name_taken").alias("own_code"))
    used = assets.join(books.select("pkg_id"), "pkg_id", "left_semi").dropDuplicates(["pkg_id", "url"])
    seen = extracted(files, used, id_col, content_col)
    checked = written(seen.select("pkg_id", "url", "sha256", F.coalesce("code", asset_code(F.col("url"), F.col("sha256"), F.col("content"))).alias("code")), "assets")
    lost = used.join(checked, ["pkg_id", "url"], "left_anti").select("pkg_id", F.lit("missing_image_package").alias("code"))
    standing = written(checked.where("code is null").select("url", "sha256").distinct().mapInArrow(lambda it: _standing(it, target), "url string, sha256 string, there boolean, same boolean"), "standing")
    wrong = checked.join(standing.where("there and not same"), ["url", "sha256"], "left_semi").select("pkg_id", F.lit("existing_media_hash_mismatch").alias("code"))
    faults = checked.where("code is not null").select("pkg_id", "code").unionByName(wrong).unionByName(asset_conflicts(checked).select("pkg_id", "code")).unionByName(lost)
    first = faults.groupBy("pkg_id").agg(F.min("code").alias("fault"))
    outcome = named.join(first, "pkg_id", "left").select("pkg_id", "name", F.coalesce("fault", "own_code").alias("code"))
    outcome = written(outcome, "outcome")
    good = outcome.where("code is null").select("pkg_id", "name")
    owners = checked.join(good, "pkg_id", "left_semi").groupBy("url", "sha256").agg(F.min("pkg_id").alias("owner")).join(standing.select("url", "sha256", "there"), ["url", "sha256"])
    owners = written(owners, "owners")
    due = used.join(owners.where("not there").select(F.col("owner").alias("pkg_id"), "url"), ["pkg_id", "url"], "left_semi")
    written(_with_files(files, due, id_col, content_col).mapInArrow(lambda it: _stored(it, target), "url string"), "stored")
    write_texts(books.join(good, "pkg_id").select("name", F.col("xml").alias("text")), target)
    by = checked.join(owners.select("url", "owner", "there"), "url").groupBy("pkg_id").agg(F.count_if((F.col("owner") == F.col("pkg_id")) & ~F.col("there")).alias("new"), F.count(F.lit(1)).alias("n"))
    fine = F.col("code").isNull()
    counts = {"media_written": F.when(fine, F.coalesce("new", F.lit(0))).otherwise(0), "media_reused": F.when(fine, F.coalesce(F.col("n") - F.col("new"), F.lit(0))).otherwise(0)}
    return outcome.join(by, "pkg_id", "left").select("pkg_id", F.when(fine, F.col("name")).alias("name"), *(c.cast("long").alias(n) for n, c in counts.items()), "code")


def write_records(records: DataFrame, target: str, path: str = "path") -> DataFrame:
    """Writes the records of `records.encoded_records` (with the path of each) below `target` under the base names of their paths.

    Records with issues are left out. Of records with one base name none is written; the names written come back.
    """
    rows = records.where(F.size("issues") == 0) if "issues" in records.columns else records
    rows = rows.select(F.regexp_extract(F.col(path), r"[^/\\]*$", 0).alias("name"), F.col("json").alias("text")).where("name <> '' and text is not null")
    alone = rows.groupBy("name").count().where("count = 1").select("name")
    return write_texts(rows.join(alone, "name"), target)
