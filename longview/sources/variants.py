"""Resources of any depth in JSON of any shape, as VARIANT values, and their fields whatever type these have.

A file's value is gone through level by level, each level an explode of the one above, until nothing new appears; a resource is an
object with a resourceType, wherever it stands: an entry, a contained resource, a list in a list, or the file itself.
Fields are read by their path, so what a fixed schema doesn't name isn't lost.

Defined results: files that aren't JSON are set apart; a path whose value has another type than asked for counts as
missing; empty texts count as missing; numbers are written as they stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

# fixed values: where a resource's date stands, first found first; where its code stands, after its type's own place
DATES = ["effectiveDateTime", "effectivePeriod.start", "authoredOn", "performedDateTime", "performedPeriod.start", "occurrenceDateTime", "occurrencePeriod.start", "period.start", "onsetDateTime", "recordedDate", "issued"]
CONCEPTS = ["code", "medicationCodeableConcept", "vaccineCode", "type"]
OWN_CONCEPT = {"MedicationRequest": "medicationCodeableConcept", "MedicationAdministration": "medicationCodeableConcept", "Immunization": "vaccineCode", "Encounter": "type"}


def read_json(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((file, v), (file, text)): JSON files found at any depth as one VARIANT each, and files that aren't JSON with their text. A path with an
    excluded part is left out."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    for part in excluded:
        rows = rows.filter(~F.col("file").contains(f"/{part}/"))
    parsed = rows.withColumn("v", F.try_parse_json("text"))
    return parsed.filter("v is not null").select("file", "v"), parsed.filter("v is null").select("file", "text")


def text_at(v: Column, path: str) -> Column:
    """The text or number at a path, null where there is none or it is empty."""
    found = F.try_variant_get(v, f"$.{path}", "string")
    return F.when(F.btrim(found) != "", F.btrim(found))


def walk(files: DataFrame) -> DataFrame:
    """(file, path, depth, type, id, full_url, v): the resources in files (file, v). full_url is the one given beside a resource in its entry.

    As many rounds as the values are deep; a round explodes the objects and lists that the one before found."""
    spark = files.sparkSession
    # an object or a list is gone into once; its kind is the start of its schema
    inner = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<.")
    level = storage.written(files.select("file", F.lit("$").alias("path"), F.lit(None).cast("string").alias("beside"), "v").filter(inner), "level")
    found, depth = [], 0
    while not level.isEmpty():
        kind = text_at(F.col("v"), "resourceType")
        here = level.withColumn("type", kind).filter("type is not null")
        found.append(here.select("file", "path", F.lit(depth).alias("depth"), "type", text_at(F.col("v"), "id").alias("id"), F.col("beside").alias("full_url"), "v"))
        level.withColumn("url", text_at(F.col("v"), "fullUrl")).createOrReplaceTempView("_longview_level")
        below = spark.sql("select file, path, url, e.pos, e.key, e.value as v from _longview_level, lateral variant_explode(v) as e")
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        below = below.select("file", F.concat("path", step).alias("path"), F.when(F.col("key") == "resource", F.col("url")).alias("beside"), "v")
        level, depth = storage.written(below.filter(inner), "level"), depth + 1
    spark.catalog.dropTempView("_longview_level")
    if not found:
        return spark.createDataFrame([], "file string, path string, depth int, type string, id string, full_url string").withColumn("v", F.try_parse_json(F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, found)


def concept(v: Column, path: str) -> Column:
    """A concept's text, else its first coding's display or code; of a list of concepts the first's."""
    each = [text_at(v, f"{path}{at}.{name}") for at in ("", "[0]") for name in ("text", "coding[0].display", "coding[0].code")]
    return F.coalesce(*each)


def code_of(v: Column, kind: Column) -> Column:
    """What a resource is about: its type's own concept, a medication's reference, then any concept it has."""
    own = F.coalesce(*(F.when(kind == name, concept(v, path)) for name, path in OWN_CONCEPT.items()))
    reference = F.coalesce(text_at(v, "medicationReference.display"), text_at(v, "medicationReference.reference"))
    return F.coalesce(own, F.when(kind.startswith("Medication"), reference), *(concept(v, c) for c in CONCEPTS), reference, F.lit(""))


def value_of(v: Column) -> tuple[Column, Column]:
    """(value, unit) of whichever value[x] a resource has."""
    at = lambda path: text_at(v, path)
    unit = lambda path: F.coalesce(at(f"{path}.unit"), at(f"{path}.code"), F.lit(""))
    none = F.lit("")

    def pair(a: str, b: str, sign: str) -> Column:
        return F.when(at(a).isNotNull() | at(b).isNotNull(), F.concat(F.coalesce(at(a), none), F.lit(sign), F.coalesce(at(b), none)))

    forms = [
        (at("valueQuantity.value"), unit("valueQuantity")), (concept(v, "valueCodeableConcept"), none), (at("valueString"), none), (at("valueBoolean"), none), (at("valueInteger"), none),
        (at("valueDateTime"), none), (pair("valueRange.low.value", "valueRange.high.value", "-"), unit("valueRange.low")),
        (pair("valueRatio.numerator.value", "valueRatio.denominator.value", "/"), unit("valueRatio.numerator")),
    ]
    chosen = F.coalesce(*(F.when(value.isNotNull(), F.struct(value.alias("value"), u.alias("unit"))) for value, u in forms))
    return F.coalesce(chosen["value"], none), F.coalesce(chosen["unit"], none)


def date_of(v: Column) -> tuple[Column, Column]:
    """(the date's first ten characters, the field it stands in), empty where no field has one."""
    chosen = F.coalesce(*(F.when(text_at(v, path).isNotNull(), F.struct(F.substring(text_at(v, path), 1, 10).alias("date"), F.lit(path).alias("source"))) for path in DATES))
    return F.coalesce(chosen["date"], F.lit("")), F.coalesce(chosen["source"], F.lit(""))


def timeline(resources: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Resources of these types as flat events, with the id of their file's first patient (by path)."""
    patient = resources.filter("type = 'Patient' and id is not null").groupBy("file").agg(F.min(F.struct("depth", "path", "id"))["id"].alias("patient_id"))
    v = F.col("v")
    (date, source), (value, unit) = date_of(v), value_of(v)
    rows = resources.filter(F.col("type").isin(*kinds)).join(patient, "file", "left")
    return rows.select("file", "path", "patient_id", F.col("type").alias("resource_type"), date.alias("event_date"), source.alias("date_source"), code_of(v, F.col("type")).alias("code"), value.alias("value"), unit.alias("unit"), F.coalesce(text_at(v, "status"), F.lit("")).alias("status"))
