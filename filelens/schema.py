"""Inventory schema: one row per file or directory (survey §1.4)."""

from pyspark.sql import types as T

ENTRY_FIELDS = [
    T.StructField("full_path", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("extension", T.StringType(), False),
    T.StructField("directory", T.StringType(), False),
    T.StructField("is_dir", T.BooleanType(), False),
    T.StructField("size", T.LongType(), True),
    T.StructField("modified", T.TimestampNTZType(), True),
    T.StructField("created", T.TimestampNTZType(), True),
    T.StructField("accessed", T.TimestampNTZType(), True),
    T.StructField("is_read_only", T.BooleanType(), False),
    T.StructField("is_hidden", T.BooleanType(), False),
    T.StructField("is_system", T.BooleanType(), False),
    T.StructField("is_link", T.BooleanType(), False),
    T.StructField("attributes", T.StringType(), False),
    T.StructField("accessible", T.BooleanType(), False),
]

ENTRY_SCHEMA = T.StructType(ENTRY_FIELDS)

DIGEST_SCHEMA = T.StructType([
    T.StructField("full_path", T.StringType(), False),
    T.StructField("size", T.LongType(), True),
    T.StructField("hash", T.StringType(), False),
    T.StructField("error", T.StringType(), True),
])

# Fixed values of the reference.
# Size limits in bytes.
HASH_LIMIT = 100 * 1024 * 1024          # the reference's upper bound for hashing; here only an optional argument
LARGE_LIMIT = 100 * 1024 * 1024         # large when size > this
PARTIAL_THRESHOLD = 1024 * 1024         # fast mode: partial digest from this size up
PARTIAL_CHUNK = 64 * 1024               # fast mode: chunk length
TEXT_PREVIEW_LIMIT = 1024 * 1024        # text preview only up to this size
IMAGE_PREVIEW_LIMIT = 10 * 1024 * 1024  # image preview only up to this size
TEXT_PREVIEW_CHARS = 10000
DISPLAY_LIMIT = 10000                   # rows shown in the grid
STAGING_FOLDER = "FileAnalysis_Staging"       # staging folder below the scanned root
EXPORT_PREFIX = "FileAnalysis_"               # stamped export name: prefix + yyyyMMdd_HHmmss
PRIMARY_MARKER = "★ PRIMARY FILE"
