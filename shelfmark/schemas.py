"""Explicit table schemas; nothing in the library infers one."""

from pyspark.sql import types as T

EXTRACTION = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("text_checksum", T.StringType()),
        T.StructField("extractor", T.StringType()),
    ]
)

SOURCE_REF = T.StructType(
    [
        T.StructField("connector_id", T.StringType()),
        T.StructField("remote_id", T.StringType()),
        T.StructField("version", T.StringType()),
    ]
)

ENTRIES = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("entry_id", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("etag", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("extraction", EXTRACTION),
        T.StructField("source", SOURCE_REF),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("deleted_at", T.TimestampType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("entry_id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_locator", T.StringType()),
    ]
)

OBJECTS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("etag", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("last_modified", T.TimestampType()),
    ]
)

SOURCE_ITEMS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("locator", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("version", T.StringType()),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        *SOURCE_ITEMS.fields,
    ]
)

PAGE_TEXT = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_locator", T.StringType()),
    ]
)

# One row per (document, rung) tried. ``pages`` stays inside the row, so the
# winning text never needs a shuffle to be put back together.
ATTEMPT_RESULT = T.StructType(
    [
        T.StructField("rung", T.StringType()),
        T.StructField("rung_no", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("pages", T.ArrayType(PAGE_TEXT)),
        T.StructField("ocr_used", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("principal_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("delta_bytes", T.LongType()),
        T.StructField("delta_objects", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

GRANTS = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("principal_id", T.StringType()),
        T.StructField("namespace", T.StringType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
    ]
)

OCR_BLOCKS = T.StructType(
    [
        T.StructField("doc", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("row_index", T.IntegerType()),
        T.StructField("column_index", T.IntegerType()),
        T.StructField("entity_types", T.ArrayType(T.StringType())),
        T.StructField("selection_status", T.StringType()),
        T.StructField("child_ids", T.ArrayType(T.StringType())),
        T.StructField("value_ids", T.ArrayType(T.StringType())),
    ]
)

EXTRACTION_STATUSES = ("pending", "extracting", "extracted", "catalog_only")
EXTRACTION_REASONS = (
    "no_extractor",
    "empty_document",
    "parse_failed",
    "missing_dependency",
    "llm_misconfigured",
)
PRIMARY_KEY = ("tenant_id", "namespace", "path")
