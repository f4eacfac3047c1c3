"""Books and images on disk: whole or not at all, and the same files however often they are written."""

import hashlib

import pytest
from pyarrow import fs

from quire.operators import graphics
from quire.plans.conversion import convert_files
from quire.sources import sink

from test_conversion import PNG, image, made, p

PEOPLE = "array<struct<role:string,given_name:string,family_name:string,literal_name:string,orcid:string>>"
NAME = f"media/{hashlib.sha256(PNG).hexdigest()}.png"


def files_below(folder):
    return {str(f.relative_to(folder)): f.read_bytes() for f in folder.rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def about(spark, names):
    return spark.createDataFrame([(k, "T", None, "en", "House", "2024", None, None, [], [], ["k"]) for k in names], f"pkg_id string, title string, subtitle string, language string, publisher string, date string, license_name string, license_url string, identifiers array<struct<type:string,format:string,value:string>>, people {PEOPLE}, keywords array<string>")


def test_conversion_leaves_whole_files_and_nothing_of_refused_packages(spark, tmp_path):
    given = {"in/a.docx": made(p("A") + p("", "Normal", inner=image())), "in/b.docx": made(p("B") + p("", "Normal", inner=image())), "in/plain.docx": made(p("P")), "in/tab.docx": made(p("a", inner="<w:r><w:tab/></w:r>") + p("", "Normal", inner=image())), "in/broken.docx": b"no"}
    files = spark.createDataFrame(list(given.items()), "path string, content binary")
    outcome, problems = convert_files(files, about(spark, given), str(tmp_path))
    found = {r.pkg_id: (r.name, r.media_written, r.media_reused, r.code) for r in outcome.collect()}
    assert found == {"in/a.docx": ("a.xml", 1, 0, None), "in/b.docx": ("b.xml", 0, 1, None), "in/plain.docx": ("plain.xml", 0, 0, None)}
    first = files_below(tmp_path)
    assert set(first) == {"a.xml", "b.xml", "plain.xml", NAME} and first[NAME] == PNG and NAME.encode() in first["a.xml"]
    assert {(r.pkg_id, r.code) for r in problems.collect() if r.severity == "error"} >= {("in/tab.docx", "tab_not_serializable"), ("in/broken.docx", "unreadable_file")}
    again, _ = convert_files(files, about(spark, given), str(tmp_path))
    assert {r.pkg_id: (r.media_written, r.media_reused) for r in again.collect()} == {"in/a.docx": (0, 1), "in/b.docx": (0, 1), "in/plain.docx": (0, 0)}
    assert files_below(tmp_path) == first


@pytest.fixture
def two(spark):
    files = spark.createDataFrame([("x/a.docx", made(p("A"))), ("y/a.docx", made(p("B"))), ("y/c.docx", made(p("C")))], "path string, content binary")
    books = spark.createDataFrame([("x/a.docx", "<a/>"), ("y/c.docx", "<c/>")], "pkg_id string, xml string")
    return files, books, lambda *rows: spark.createDataFrame(list(rows), "pkg_id string, url string, path string, sha256 string")


@pytest.mark.parametrize(
    "url, path, sha256, code",
    [
        (NAME, "word/media/none.png", NAME[6:70], "missing_image_media_part"), (NAME, "word/media/a.png", "0" * 64, "figure_hash_mismatch"), ("media/../x.png", "word/media/a.png", NAME[6:70], "invalid_figure_media_url"),
        (NAME.replace(".png", ".jpg"), "word/media/a.png", NAME[6:70], "invalid_figure_media_url"), (NAME, "word/media/a.png", "XY", "invalid_figure_sha256"),
    ],
)
def test_a_faulty_image_keeps_its_book_out(spark, tmp_path, two, url, path, sha256, code):
    files, books, assets = two
    outcome = sink.write_books(books, files, assets(("x/a.docx", url, path, sha256), ("y/c.docx", NAME, "word/media/a.png", NAME[6:70])), str(tmp_path))
    got = {r.pkg_id: (r.name, r.code) for r in outcome.collect()}
    if url == NAME and sha256 != NAME[6:70] and code != "missing_image_media_part":  # two digests at one address: neither is written
        assert got["x/a.docx"][0] is None and got["y/c.docx"] == (None, "conflicting_assets") and files_below(tmp_path) == {}
    else:
        assert got == {"x/a.docx": (None, code), "y/c.docx": ("c.xml", None)} and files_below(tmp_path) == {"c.xml": b"<c/>", NAME: PNG}


def test_another_image_at_the_address_is_not_replaced(spark, tmp_path, two):
    files, books, assets = two
    (tmp_path / "media").mkdir()
    (tmp_path / NAME).write_bytes(b"other")
    outcome = sink.write_books(books, files, assets(("y/c.docx", NAME, "word/media/a.png", NAME[6:70])), str(tmp_path))
    assert {(r.pkg_id, r.name, r.code) for r in outcome.collect()} == {("x/a.docx", "a.xml", None), ("y/c.docx", None, "existing_media_hash_mismatch")}
    assert files_below(tmp_path) == {"a.xml": b"<a/>", NAME: b"other"}


def test_names_missing_packages_and_no_books(spark, tmp_path, two):
    files, books, assets = two
    same = spark.createDataFrame([("x/a.docx", "<a/>"), ("y/a.docx", "<b/>"), ("z/", "<c/>"), ("gone.docx", "<d/>"), (".hidden", "<e/>")], "pkg_id string, xml string")
    outcome = sink.write_books(same, files, assets(("gone.docx", NAME, "word/media/a.png", NAME[6:70])), str(tmp_path))
    assert {(r.pkg_id, r.name, r.code) for r in outcome.collect()} == {("x/a.docx", None, "output_name_taken"), ("y/a.docx", None, "output_name_taken"), ("z/", None, "no_output_name"), ("gone.docx", None, "missing_image_package"), (".hidden", ".hidden.xml", None)}
    assert sink.write_books(books.limit(0), files, assets(("q", NAME, "m", "s")), str(tmp_path)).count() == 0


def test_a_write_that_fails_leaves_nothing(tmp_path):
    place = fs.LocalFileSystem()
    (tmp_path / "a.xml").mkdir()
    (tmp_path / "a.xml" / "inside").write_bytes(b"x")
    with pytest.raises(OSError):
        sink.put(place, f"{tmp_path}/a.xml", b"new")
    assert set(files_below(tmp_path)) == {"a.xml/inside"}


def test_tasks_that_run_twice_leave_the_same_files(spark, tmp_path, two):
    files, books, assets = two
    used = assets(("x/a.docx", NAME, "word/media/a.png", NAME[6:70]))
    due = sink._with_files(files, used, "path", "content")
    batches = due.toArrow().to_batches()
    for _ in range(2):
        assert [b.column(0).to_pylist() for b in sink._stored(iter(batches), str(tmp_path))] == [[NAME]]
    assert files_below(tmp_path) == {NAME: PNG}


def test_records_are_written_alone(spark, tmp_path):
    rows = spark.createDataFrame([("in/a.metadata.json", "{}", []), ("in/b.metadata.json", "{}", ["bad"]), ("x/c.json", "1", []), ("y/c.json", "2", [])], "path string, json string, issues array<string>")
    assert [r.name for r in sink.write_records(rows, str(tmp_path)).collect()] == ["a.metadata.json"] and files_below(tmp_path) == {"a.metadata.json": b"{}"}


def test_assets_are_checked(spark):
    rows = spark.createDataFrame([("d", NAME, NAME[6:70], PNG), ("e", NAME, NAME[6:70], b"?")], "pkg_id string, url string, sha256 string, content binary")
    assert [(r.pkg_id, r.code) for r in graphics.asset_problems(rows).collect()] == [("e", "figure_hash_mismatch")]
