"""Readers and writers of the formats that records come in: bundles, CSV, JSON lines, JSON arrays and XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import clean_string, is_uuid, reference_id

# a permissive schema: what isn't given is null, what isn't named is not read
CODING = "struct<code:string,display:string,system:string>"
CONCEPT = f"struct<text:string,coding:array<{CODING}>>"
RESOURCE = (
    "struct<resourceType:string,id:string,birthDate:string,gender:string,status:string,effectiveDateTime:string,onsetDateTime:string,recordedDate:string,"
    f"authoredOn:string,issued:string,period:struct<start:string,`end`:string>,code:{CONCEPT},medicationCodeableConcept:{CONCEPT},medicationReference:struct<reference:string,display:string>,"
    f"subject:struct<reference:string>,valueQuantity:struct<value:double,unit:string>,valueCodeableConcept:{CONCEPT},valueString:string,valueBoolean:boolean,"
    f"valueRange:struct<low:struct<value:double>,high:struct<value:double>>,ingredient:array<struct<itemCodeableConcept:{CONCEPT}>>>"
)
BUNDLE = f"resourceType string, entry array<struct<fullUrl:string,resource:{RESOURCE}>>, _corrupt string"


def read_bundles(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(bundles, rejected): files of one JSON bundle each, found at any depth; files that can't be parsed are set
    apart with their text, and paths with an excluded part are left out."""
    rows = (
        spark.read.schema(BUNDLE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_path"))
    )
    for part in excluded:
        rows = rows.filter(~F.col("file").contains(f"/{part}/"))
    return rows.filter("_corrupt is null").drop("_corrupt"), rows.filter("_corrupt is not null and entry is null").select("file", F.col("_corrupt").alias("text"))


def resources(bundles: DataFrame) -> DataFrame:
    """(file, patient_id, full_url, r): one row per resource, with the bundle's first patient."""
    patient = F.filter("entry", lambda e: e["resource"]["resourceType"] == "Patient")[0]["resource"]["id"]
    return bundles.select("file", patient.alias("patient_id"), F.explode("entry").alias("e")).select("file", "patient_id", F.col("e.fullUrl").alias("full_url"), F.col("e.resource").alias("r"))


def concept_name(c) -> object:
    """A concept's text, else its first coding's display or code."""
    return F.coalesce(clean_string(c["text"]), clean_string(c["coding"][0]["display"]), clean_string(c["coding"][0]["code"]))


def event_timeline(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Resources as flat events: patient_id, resource_type, event_date, date_source, code, value, unit, status."""
    r = lambda name: F.col(f"r.{name}")
    dates = {"effectiveDateTime": r("effectiveDateTime"), "onsetDateTime": r("onsetDateTime"), "authoredOn": r("authoredOn"), "period.start": r("period.start"), "recordedDate": r("recordedDate"), "issued": r("issued")}
    date = F.coalesce(*(F.when(clean_string(c).isNotNull(), F.struct(F.substring(c, 1, 10).alias("v"), F.lit(n).alias("n"))) for n, c in dates.items()))
    reference = F.coalesce(clean_string(r("medicationReference.display")), clean_string(reference_id(r("medicationReference.reference"))))
    code = F.coalesce(concept_name(F.col("r.code")), concept_name(F.col("r.medicationCodeableConcept")), reference, F.lit(""))
    ranged = F.when(r("valueRange.low.value").isNotNull(), F.concat_ws("-", r("valueRange.low.value").cast("string"), r("valueRange.high.value").cast("string")))
    value = F.coalesce(r("valueQuantity.value").cast("string"), concept_name(F.col("r.valueCodeableConcept")), r("valueString"), r("valueBoolean").cast("string"), ranged, F.lit(""))
    return rows.filter(r("resourceType").isin(*kinds)).select(
        "patient_id", r("resourceType").alias("resource_type"), F.coalesce(date["v"], F.lit("")).alias("event_date"), F.coalesce(date["n"], F.lit("")).alias("date_source"),
        code.alias("code"), value.alias("value"), F.coalesce(r("valueQuantity.unit"), F.lit("")).alias("unit"), F.coalesce(r("status"), F.lit("")).alias("status"),
    )


def medication_names(rows: DataFrame) -> DataFrame:
    """(ref, name) of medication resources by id and by full URL, one name each."""
    named = rows.filter("r.resourceType = 'Medication'")
    parts = F.array_join(F.filter(F.transform("r.ingredient", lambda i: concept_name(i["itemCodeableConcept"])), lambda x: x.isNotNull()), "; ")
    name = F.coalesce(concept_name(F.col("r.code")), F.when(parts != "", parts))
    keyed = named.select(name.alias("name"), F.explode(F.array(F.col("r.id"), reference_id(F.col("full_url")))).alias("ref"))
    return keyed.filter("ref is not null and name is not null").groupBy("ref").agg(F.min("name").alias("name"))


def resolve_references(events: DataFrame, names: DataFrame) -> DataFrame:
    """Events whose code is a UUID get the medication's name where it is known; rows and columns stay as they are."""
    hit = events.join(names, F.when(is_uuid(F.col("code")), F.col("code")) == F.col("ref"), "left")
    return hit.select(*(F.coalesce("name", "code").alias("code") if c == "code" else c for c in events.columns))


def read_strings(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV as strings with '' for what is missing; raises where a required column is absent."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    absent = sorted(set(required) - set(rows.columns))
    if absent:
        raise ValueError(f"columns missing: {', '.join(absent)}")
    return rows.fillna("")


def write_strings(rows: DataFrame, path: str) -> None:
    """A CSV whose lists are joined by ' | ' and whose structs and maps are JSON."""
    def cell(name: str, kind: str):
        if kind == "array<string>":
            return F.array_join(name, " | ").alias(name)
        return F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map")) else F.col(name)

    rows.select(*(cell(n, t) for n, t in rows.dtypes)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array of records each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def xml_fields(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed XML in `xml`, without a document type and with bare ampersands mended; null where it can't be read."""
    text = F.regexp_replace(F.regexp_replace(column, r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", ""), r"&(?!#?\w+;)", "&amp;")
    return rows.withColumn("xml", F.from_xml(text, schema, {"mode": "PERMISSIVE"}))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of every file under path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def batches(ids: DataFrame, column: str, size: int) -> DataFrame:
    """Ids in lists of up to size for a service that takes many at once: (batch, ids joined by commas).

    Ids are dealt to buckets first, so no task numbers them all.
    """
    from pyspark.sql import Window

    bucket = F.expr(f"pmod(xxhash64({column}), 64)")
    k = F.row_number().over(Window.partitionBy("bucket").orderBy(column))
    rows = ids.withColumn("bucket", bucket).withColumn("part", F.floor((k - 1) / size))
    return rows.groupBy("bucket", "part").agg(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ",").alias("ids")).select(F.concat_ws("-", "bucket", "part").alias("batch"), "ids")
