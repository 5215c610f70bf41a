"""Lenient readings of values, dates and references, null where they can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^(urn:uuid:)?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def clean_string(x: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def safe_float(x: Column, default: float = 0.0) -> Column:
    v = clean_string(x).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def safe_int(x: Column, default: int = 0) -> Column:
    """Through a double, as "3.0" is 3; out of range is the default."""
    v = safe_float(x, float("nan"))
    return F.when(F.isnan(v) | (F.abs(v) >= 2**62), F.lit(default).cast("long")).otherwise(v.cast("long"))


def local_date(x: Column) -> Column:
    """The date in the record's own offset: the first ten characters where they are one."""
    return F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd")


def utc_timestamp(x: Column) -> Column:
    return F.try_to_timestamp(F.trim(x))


def age(birth: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, birth) / 12)


def days_between(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(last, first))


def per_year(n: Column, days: Column) -> Column:
    return F.when(days > 0, F.round(n / (days / 365.25), 2)).otherwise(F.lit(0.0))


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike(UUID), F.lit(False))


def reference_id(x: Column) -> Column:
    """A reference's id: what follows the last slash, or urn:uuid:."""
    return F.regexp_replace(F.element_at(F.split(F.trim(x), "/"), -1), "^urn:uuid:", "")


def first_given(**columns: Column) -> Column:
    """The first column that is given, with its name: (value, source)."""
    return F.coalesce(*(F.when(clean_string(c).isNotNull(), F.struct(clean_string(c).alias("value"), F.lit(n).alias("source"))) for n, c in columns.items()))


def without_zeros(x: Column) -> Column:
    return F.regexp_replace(x, "^0+(?=.)", "")


def signature(columns: list[str]) -> Column:
    """sha256 of a row's values as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
