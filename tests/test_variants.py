"""Resources of any depth against a recursive walk, and fields of every type."""

import json
import random

from pyspark.sql import functions as F

from longview.sources import variants


def plain(obj, path="$", depth=0):
    if isinstance(obj, dict):
        if obj.get("resourceType"):
            yield path, depth, obj["resourceType"]
        for k, x in obj.items():
            yield from plain(x, f"{path}.{k}", depth + 1)
    elif isinstance(obj, list):
        for i, x in enumerate(obj):
            yield from plain(x, f"{path}[{i}]", depth + 1)


def tangle(rng, depth=0):
    """Resources in lists in lists, contained ones, and objects that are none."""
    if depth > 6 or rng.random() < 0.25:
        return rng.choice([1, None, "x", True, {}, []])
    if rng.random() < 0.4:
        return [tangle(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    out = {f"k{i}": tangle(rng, depth + 1) for i in range(rng.randint(0, 3))}
    if rng.random() < 0.5:
        out["resourceType"] = rng.choice(["Patient", "Observation", "", None])
    return out


def test_walk_equals_recursion(spark, tmp_path):
    rng = random.Random(4)
    values = [tangle(rng) for _ in range(60)] + [{"resourceType": "Bundle", "entry": [{"fullUrl": "urn:1", "resource": {"resourceType": "Claim", "id": "c", "contained": [[{"resourceType": "Coverage"}]]}}]}]
    for i, x in enumerate(values):
        (tmp_path / "deep" / str(i % 3)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "deep" / str(i % 3) / f"{i}.json").write_text(json.dumps(x))
    (tmp_path / "deep" / "bad.json").write_text("{\"resourceType\": ")
    (tmp_path / "deep" / "0" / "skip").mkdir()
    (tmp_path / "deep" / "0" / "skip" / "z.json").write_text(json.dumps(values[-1]))
    files, rejected = variants.read_json(spark, str(tmp_path / "deep"), ("skip",))
    assert [r["file"].rsplit("/", 1)[1] for r in rejected.collect()] == ["bad.json"] and files.count() == len(values)
    rows = variants.walk(files).collect()
    got = sorted((r["file"].rsplit("/", 1)[1], r["path"], r["depth"], r["type"]) for r in rows)
    assert got == sorted((f"{i}.json", *x) for i, v in enumerate(values) for x in plain(v)) and len(got) > 30
    assert {(r["type"], r["full_url"]) for r in rows if r["file"].endswith("/60.json")} == {("Bundle", None), ("Claim", "urn:1"), ("Coverage", None)}
    assert variants.walk(files.limit(0)).count() == 0


def test_fields_of_every_type(spark):
    cases = [
        ({"resourceType": "Observation", "valueQuantity": {"value": 70.5, "code": "kg"}, "effectiveDateTime": "2020-01-02T10:00:00Z", "status": "final"}, ("", "70.5", "kg", "2020-01-02", "effectiveDateTime", "final")),
        ({"resourceType": "Observation", "code": {"text": "Smoker"}, "valueCodeableConcept": {"coding": [{"display": "never"}]}}, ("Smoker", "never", "", "", "", "")),
        ({"resourceType": "Observation", "valueBoolean": False, "issued": "2020-05-06"}, ("", "false", "", "2020-05-06", "issued", "")),
        ({"resourceType": "Observation", "valueInteger": 3}, ("", "3", "", "", "", "")),
        ({"resourceType": "Observation", "valueDateTime": "2021-01-01"}, ("", "2021-01-01", "", "", "", "")),
        ({"resourceType": "Observation", "valueString": "text", "valueInteger": 4}, ("", "text", "", "", "", "")),
        ({"resourceType": "Observation", "valueRange": {"low": {"value": 1, "unit": "mg"}, "high": {"value": 2}}}, ("", "1-2", "mg", "", "", "")),
        ({"resourceType": "Observation", "valueRange": {"high": {"value": 2}}}, ("", "-2", "", "", "", "")),
        ({"resourceType": "Observation", "valueRatio": {"numerator": {"value": 1, "unit": "g"}, "denominator": {"value": 4}}}, ("", "1/4", "g", "", "", "")),
        ({"resourceType": "Immunization", "vaccineCode": {"coding": [{"code": "140"}]}, "occurrenceDateTime": "2019-10-01"}, ("140", "", "", "2019-10-01", "occurrenceDateTime", "")),
        ({"resourceType": "Encounter", "type": [{"text": "Check"}], "period": {"start": "2018-03-04T01:02:03Z"}}, ("Check", "", "", "2018-03-04", "period.start", "")),
        ({"resourceType": "Procedure", "code": {"coding": [{"display": "Scan"}]}, "performedPeriod": {"start": "2017-01-01"}, "period": {"start": "2000-01-01"}}, ("Scan", "", "", "2017-01-01", "performedPeriod.start", "")),
        ({"resourceType": "DiagnosticReport", "effectivePeriod": {"start": "2016-01-01"}, "code": {"text": " "}}, ("", "", "", "2016-01-01", "effectivePeriod.start", "")),
        ({"resourceType": "MedicationRequest", "medicationReference": {"reference": "urn:uuid:1"}, "authoredOn": "2015-01-01"}, ("urn:uuid:1", "", "", "2015-01-01", "authoredOn", "")),
        ({"resourceType": "Condition", "code": "no object", "onsetDateTime": 5}, ("", "", "", "5", "onsetDateTime", "")),
    ]
    df = spark.createDataFrame([(f"{i:02d}", json.dumps([{"resourceType": "Patient", "id": f"p{i}"}, c])) for i, (c, _) in enumerate(cases)], "file string, text string")
    found = variants.walk(df.select("file", F.parse_json("text").alias("v")))
    rows = variants.timeline(found, tuple({c["resourceType"] for c, _ in cases})).orderBy("file").collect()
    got = [(r["code"], r["value"], r["unit"], r["event_date"], r["date_source"], r["status"]) for r in rows]
    assert got == [want for _, want in cases] and [r["patient_id"] for r in rows] == [f"p{i}" for i in range(len(cases))]
