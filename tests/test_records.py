"""Bibliographic records read strictly, judged and written again."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators.header import losses, record_header
from quire.operators.record_rules import checked_records, inconsistencies
from quire.plans.adapters import dealt
from quire.sources.records import decoded_profiles, decoded_records, encoded_records, record_path, relative_source, resolved_source, with_institution
from quire.staging import written

GOOD = {
    "schema_version": "2.0", "source_document": {"path": "a/b.docx", "sha256": "0" * 64}, "document": {"language": "fr", "title": "T", "subtitle": None},
    "contributors": [{"id": "c1", "role": "author", "given_name": "Ada", "orcid": "0000-0002-1825-0097", "affiliations": ["a1"]}], "affiliations": [{"id": "a1", "name": "N"}],
    "identifiers": [{"type": "doi", "value": "10.1234/x", "format": None}], "keywords": [{"language": "fr", "scheme": "keywords", "items": ["a", "b"]}], "pagination": {"from": 1, "to": 3},
}
BROKEN = {
    "structure": {"source_document": {"path": 1}, "document": [], "contributors": [3]},
    "types": {**GOOD, "contributors": [3, {"id": "c", "affiliations": [1, "x"]}], "pagination": {"from": True}, "keywords": [{"language": "fr"}], "publication": 4},
    "heads": {**GOOD, "document": {"language": 2, "title": None}},
    "rules": {**GOOD, "contributors": [{"id": " c", "role": "ghost", "email": "no", "literal_name": "X", "family_name": "Y", "affiliations": ["zz"]}], "identifiers": [{"type": "isbn-13", "value": "978-2-07-036822-8"}, {"type": "doi", "value": "x"}, {"type": "doi", "value": "X"}], "keywords": [{"language": "", "items": ["Été", "ete", " "]}], "pagination": {"from": 4, "to": 3}},
}


@pytest.fixture(scope="module")
def records(spark):
    rows = [("good", json.dumps(GOOD)), *((k, json.dumps(v)) for k, v in BROKEN.items()), ("json", "{oops"), ("null", None), ("list", "[1]")]
    return written(decoded_records(spark.createDataFrame(rows, "pkg_id string, json string")), "test-records")


def test_reading_is_strict(records):
    got = {r.pkg_id: [(i.code, i.path) for i in r.issues] for r in records.collect()}
    assert got["good"] == got["rules"] == []
    assert got["structure"] == [("invalid_metadata_structure", "document"), ("missing_metadata_field", "affiliations"), ("invalid_field_type", "affiliations")]
    assert got["types"] == [
        ("invalid_metadata_structure", "contributors[0]"), ("missing_metadata_field", "contributors[1].role"), ("invalid_field_type", "contributors[1].role"), ("invalid_field_type", "contributors[1].affiliations[0]"),
        ("missing_metadata_field", "keywords[0].items"), ("invalid_metadata_structure", "publication"), ("invalid_field_type", "pagination.from"),
    ]
    assert got["heads"] == [("invalid_field_type", "document.language"), ("invalid_field_type", "document.title")]
    assert [got[k][0][0] for k in ("json", "null", "list")] == ["invalid_json", "metadata_file_unreadable", "invalid_metadata_structure"]


def test_rules_and_writing(records):
    fine, issues = checked_records(records)
    found = [(r.code, r.path) for r in issues.where("pkg_id = 'rules'").orderBy("phase", "group", "item", "place").collect()]
    assert found == [
        ("invalid_contributor_id", "contributors[0].id"), ("invalid_contributor_role", "contributors[0].role"), ("invalid_contributor_name", "contributors[0]"), ("invalid_email", "contributors[0].email"),
        ("unknown_affiliation_reference", "contributors[0].affiliations"), ("missing_identifier_format", "identifiers[0].format"), ("invalid_doi", "identifiers[1].value"), ("invalid_doi", "identifiers[2].value"),
        ("duplicate_identifier_value", "identifiers[2].value"), ("missing_language", "keywords[0].language"), ("invalid_keyword", "keywords[0].items[2]"), ("similar_keywords", "keywords[0].items"), ("invalid_pagination", "pagination"),
    ]
    assert [r.pkg_id for r in fine.select("pkg_id").collect()] == ["good"]
    assert json.loads(encoded_records(fine).first().json) == GOOD


def test_profiles_and_sources(spark, records):
    house = decoded_profiles(spark.createDataFrame([('{"profile_id": "p", "publisher": {"name": "House", "address": ["x"]}, "rights_holder": "H"}',), ('{"profile_id": " ", "publisher": {"address": 3}}',)], "json string"))
    assert sorted([i.code for i in r.issues] for r in house.collect()) == [[], ["invalid_profile_id", "invalid_profile_structure"]]
    filled = with_institution(records.where("pkg_id = 'good'"), house).first()
    assert (filled.publication.publisher.name, filled.publication.publisher.address, filled.rights.holder) == ("House", ["x"], "H")
    assert with_institution(records, house.limit(0)).count() == records.count()
    source = spark.createDataFrame([("good", "c.docx", "0" * 64, "T", "Sub", ["Ada", "Bob", None])], "pkg_id string, file_name string, sha256 string, title string, subtitle string, signatures array<string>")
    assert {(r.code, r.path) for r in inconsistencies(records.where("pkg_id = 'good'"), source).collect()} == {("metadata_source_filename_changed", "source_document.path"), ("metadata_subtitle_differs_from_docx", "document.subtitle"), ("signature_contributor_not_in_metadata", "signatures[1]")}
    paths = spark.createDataFrame([("/x/y/b.docx", "/x/z/m.json")], "p string, m string").select(relative_source(F.col("p"), F.col("m")).alias("a"), resolved_source(F.lit("../q/./a.docx"), F.col("m")).alias("b"), record_path(F.col("p")).alias("c")).first()
    assert tuple(paths) == ("../y/b.docx", "/x/q/a.docx", "/x/y/b.metadata.json")


def test_headers_of_odd_records(spark, records):
    headers = {r.pkg_id: r.header for r in record_header(records).collect()}
    assert set(headers) == {"good", "rules"} and "<publicationStmt><p></p></publicationStmt>" in headers["good"]
    assert '<sourceDesc><bibl><biblScope unit="page">1-3</biblScope></bibl></sourceDesc>' in headers["good"]
    found = {(r.pkg_id, r.code, r.path) for r in losses(records).collect()}
    assert ("good", "missing_publisher_for_publication_details", None) in found and ("rules", "contributor_email_not_serialized", "contributors[0].email") in found
    twice = records.where("pkg_id = 'good'")
    assert record_header(twice.unionByName(twice)).count() == 2
    assert record_header(records.limit(0)).count() == losses(records.limit(0)).count() == 0


def test_records_are_read_once(spark):
    """Whatever uses records reads what was written; the JSON is parsed in no later plan, and a small file is dealt over all tasks."""
    rows = spark.createDataFrame([("good", json.dumps(GOOD))], "pkg_id string, json string")
    records = decoded_records(rows)
    for used in (record_header(records), losses(records), checked_records(records)[1]):
        assert "parse_json" not in used._jdf.queryExecution().optimizedPlan().toString()
    assert dealt(rows).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
