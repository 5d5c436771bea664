"""Explicit schemas of every table. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


IMAGE = _struct(url=S, alt_text=S, is_primary=B)
REFERENCE = _struct(reference_number=S, reference_type=S)
VEHICLE = _struct(
    make=S, model=S, year=I, submodel=S, engine=S, fuel_type=S, aspiration=S, qualifiers=T.ArrayType(S)
)
SPECS = T.MapType(S, S)

# A part as it appears in exports: the price is text there.
EXPORT_PART = _struct(
    sku=S, name=S, price=S, description=S, full_description=S, category=S, specifications=SPECS,
    images=T.ArrayType(IMAGE), manufacturer=S, in_stock=B, features=T.ArrayType(S), tech_notes=S, position=S,
    interchange_numbers=T.ArrayType(REFERENCE), compatibility=T.ArrayType(VEHICLE), scraped_at=S,
)
EXPORT_COMPAT = _struct(part_sku=S, sku=S, vehicles=T.ArrayType(VEHICLE), notes=S, scraped_at=S)
METADATA = _struct(
    export_date=S, total_parts=L, total_mappings=L, total_years=L, structure=S, version=S
)

# One file may be an envelope or a bare record; the reader takes whichever fields are there.
PARTS_DOCUMENT = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("parts", T.ArrayType(EXPORT_PART)),
        T.StructField("data", T.ArrayType(EXPORT_PART)),
        *EXPORT_PART.fields,
    ]
)
COMPAT_DOCUMENT = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("compatibility", T.ArrayType(EXPORT_COMPAT)),
        T.StructField("data", T.ArrayType(EXPORT_COMPAT)),
        *EXPORT_COMPAT.fields,
    ]
)
HIERARCHY_DOCUMENT = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("data", T.MapType(S, T.MapType(S, T.MapType(S, T.ArrayType(EXPORT_PART))))),
    ]
)

FITMENT = T.StructType([T.StructField("sku", S), *VEHICLE.fields])
CATALOG = _struct(
    id=L, sku=S, name=S, description=S, short_description=S, category=S, price=T.DecimalType(10, 2), manufacturer=S,
    in_stock=B, position=S, specifications=SPECS, features=T.ArrayType(S), tech_notes=S,
    images=T.ArrayType(IMAGE), interchange_numbers=T.ArrayType(REFERENCE), scraped_at=S, last_synced=TS,
    created_at=TS, updated_at=TS,
)
PAGE_STATE = _struct(url=S, hash=S)
MANIFEST = _struct(filename=S, source_hash=S, etag=S, synced=S, error=S)
FAILURE = _struct(phase=S, identifier=S, error_type=S, error_message=S, is_retryable=B)
IMPORT_LOG = _struct(filename=S, uploaded_at=TS, started_at=TS, completed_at=TS, parts_count=L)
APPLICATION = _struct(make_id=I, make=S, year_id=I, year=S, application_id=L, model=S)
