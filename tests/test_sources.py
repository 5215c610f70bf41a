import json

import pytest
from pyspark.sql import functions as F

from longview.sources import files

UUID = "0a1b2c3d-0000-4000-8000-000000000001"


@pytest.fixture
def bundles(tmp_path):
    good = {"resourceType": "Bundle", "entry": [
        {"resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1940-05-06"}},
        {"fullUrl": f"urn:uuid:{UUID}", "resource": {"resourceType": "Medication", "id": "m1", "code": {"coding": [{"code": "1", "display": "Aspirin"}]}}},
        {"resource": {"resourceType": "Observation", "status": "final", "effectiveDateTime": "2020-01-02T23:00:00-05:00", "code": {"text": "Weight"}, "valueQuantity": {"value": 70.5, "unit": "kg"}}},
        {"resource": {"resourceType": "MedicationRequest", "authoredOn": "2020-02-03", "medicationReference": {"reference": f"urn:uuid:{UUID}"}}},
    ]}
    (tmp_path / "in" / "skip").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text(json.dumps(good))
    (tmp_path / "in" / "bad.json").write_text("{\"resourceType\": ")
    (tmp_path / "in" / "skip" / "b.json").write_text(json.dumps(good))
    return str(tmp_path / "in")


def test_bundles_to_timeline(spark, bundles):
    rows, rejected = files.read_bundles(spark, bundles, ("skip",))
    r = files.resources(rows).cache()
    events = files.event_timeline(r, ("Observation", "MedicationRequest"))
    got = {tuple(x) for x in files.resolve_references(events, files.medication_names(r)).collect()}
    assert got == {
        ("p1", "Observation", "2020-01-02", "effectiveDateTime", "Weight", "70.5", "kg", "final"),
        ("p1", "MedicationRequest", "2020-02-03", "authoredOn", "Aspirin", "", "", ""),
    }
    assert rejected.count() == 1


def test_strings_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"], 'say "hi",\nthere'), ("b", [], None)], "k string, l array<string>, t string")
    files.write_strings(rows, str(tmp_path / "csv"))
    back = {tuple(r) for r in files.read_strings(spark, str(tmp_path / "csv"), ["k", "t"]).collect()}
    assert back == {("a", "x | y", 'say "hi",\nthere'), ("b", "", "")}
    with pytest.raises(ValueError):
        files.read_strings(spark, str(tmp_path / "csv"), ["absent"])


def test_lines_and_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    files.write_lines(rows, str(tmp_path / "l"))
    assert {tuple(r) for r in files.read_lines(spark, str(tmp_path / "l"), "a long, b string").collect()} == {(1, "x"), (2, None)}
    (tmp_path / "arr.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    assert files.read_array(spark, str(tmp_path / "arr.json"), "a long, b string").count() == 2


def test_xml(spark):
    text = '<?xml version="1.0"?><!DOCTYPE article [<!ENTITY x "y">]><article><title>A & B</title></article>'
    df = files.xml_fields(spark.createDataFrame([(text,)], ["t"]), "t", "title string")
    assert df.select("xml.title").first()[0] == "A & B"


def test_fingerprints_and_batches(spark, bundles):
    assert files.fingerprints(spark, bundles).count() == 3
    got = [r["ids"].split(",") for r in files.batches(spark.range(100), "id", 7).collect()]
    assert sorted(int(x) for b in got for x in b) == list(range(100)) and max(map(len, got)) <= 7
