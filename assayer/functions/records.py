"""Checks of raw JSON records against a closed schema: what is malformed, unknown, missing or of a wrong type, by path.

Records are parsed to VARIANT once, so that a field the schema does not name is
seen and not dropped by the reader; every check is a column of the row, without
a shuffle or a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType


def _of_type(value: Column, kind: DataType) -> Column:
    """Whether a variant that is not null is of the type."""
    seen = F.schema_of_variant(value)
    if isinstance(kind, StructType):
        return seen.startswith("OBJECT<")
    if isinstance(kind, ArrayType):
        inner = F.expr("true") if not isinstance(kind.elementType, StringType) else seen.isin("ARRAY<STRING>", "ARRAY<VOID>")
        return seen.startswith("ARRAY<") & inner
    if isinstance(kind, BooleanType):
        return seen == "BOOLEAN"
    if isinstance(kind, (IntegerType, LongType)):
        return (seen == "BIGINT") & F.try_variant_get(value, "$", kind.simpleString()).isNotNull()
    if isinstance(kind, DoubleType):
        return seen.isin("BIGINT", "DOUBLE") | seen.startswith("DECIMAL")
    if isinstance(kind, TimestampType):
        return (seen == "STRING") & F.try_variant_get(value, "$", "timestamp").isNotNull()
    return seen == "STRING"


def _fault(path: str | Column, reason: str) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(reason).alias("reason"))


def _faults(value: Column, schema: StructType, path: str) -> Column:
    """Array of (path, reason) of an object under path; names are in the order of the schema, unknown ones by name."""
    fields = value.try_cast("map<string, variant>")
    keys = F.map_keys(fields)
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    out = [F.transform(F.array_sort(F.array_except(keys, known)), lambda k: _fault(F.concat(F.lit(f"{path}."), k), "unknown field")), F.transform(F.array_except(known, keys), lambda k: _fault(F.concat(F.lit(f"{path}."), k), "missing field"))]
    none = F.array().cast("array<struct<path: string, reason: string>>")
    for f in schema.fields:
        at = F.get(F.map_values(F.map_filter(fields, lambda k, _: k == F.lit(f.name))), 0)  # noqa: B023
        here = at.isNotNull() & ~F.is_variant_null(at)
        good = _of_type(at, f.dataType)
        out.append(F.when(here & ~good, F.array(_fault(f"{path}.{f.name}", "wrong type"))).otherwise(none))
        if isinstance(f.dataType, StructType):
            out.append(F.when(here & good, _faults(at, f.dataType, f"{path}.{f.name}")).otherwise(none))
    return F.concat(*out)


def record_faults(records: DataFrame, raw: str, schema: StructType) -> DataFrame:
    """The records with column faults: array of (path, reason), empty for a record that the schema allows. Null values are
    allowed anywhere; a null record is malformed, as is one with a field twice."""
    parsed = records.withColumn("_v", F.try_parse_json(raw))
    shaped = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT<"), F.lit(False))
    return parsed.withColumn("faults", F.when(shaped, _faults(F.col("_v"), schema, "$")).otherwise(F.array(_fault("$", "malformed")))).drop("_v")


def rejected(records: DataFrame, raw: str, schema: StructType, *keep: str) -> DataFrame:
    """keep, path, reason: a row for each fault."""
    return record_faults(records, raw, schema).select(*keep, F.inline("faults"))


def accepted(records: DataFrame, raw: str, schema: StructType, *keep: str) -> DataFrame:
    """keep and the fields of the schema, of the records without a fault."""
    sound = record_faults(records, raw, schema).where(F.size("faults") == 0)
    return sound.select(*keep, F.from_json(raw, schema, {"mode": "FAILFAST"}).alias("_r")).select(*keep, "_r.*")
