"""Reports as tables, written by Spark (one writer task per partition).

``export_rows`` is the seven-column file listing; ``write_report`` writes a set of
named tables (summary, all_files, duplicates, extensions) in CSV, Parquet or JSON
under one run folder and publishes them together. CSV quotes every value and escapes embedded quotes (the
reference leaves them unescaped).
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.common import delete_path, path_exists, publish_text, read_text
from ..schema import EXPORT_PREFIX

FORMATS = ("csv", "parquet", "json")
# Fixed values of the reference: export column titles, in order.
EXPORT_HEADERS = ["Name", "Extension", "Size", "Path", "Modified", "Duplicate", "Primary File"]


def export_rows(marked: DataFrame) -> DataFrame:
    """B1/B2 'All Files': Name, Extension, Size (formatted), Path, Modified, Duplicate, Primary File."""
    cols = [F.col("name"), F.col("extension"), C.format_bytes("size"), F.col("full_path"),
            C.timestamp_text("modified"),
            F.when(F.col("is_duplicate"), F.lit("Yes")).otherwise(F.lit("No")),
            F.coalesce(F.col("primary_file_path"), F.lit(""))]
    return marked.select(*[c.alias(h) for c, h in zip(cols, EXPORT_HEADERS)])


def summary_rows(marked: DataFrame) -> DataFrame:
    """B2 'Summary': total files, formatted size, duplicate files."""
    return marked.agg(F.count(F.lit(1)).alias("Total Files"),
                      C.format_bytes(F.coalesce(F.sum("size"), F.lit(0))).alias("Total Size"),
                      F.count_if(F.col("is_duplicate")).alias("Duplicate Files"))


def format_for(path: str) -> str:
    """Format from the file name's extension (.csv, .parquet, .json; .xlsx → parquet tables)."""
    low = path.lower()
    if low.endswith(".csv"):
        return "csv"
    if low.endswith(".json"):
        return "json"
    return "parquet"


def run_folder(base: str, run_id: str | None = None) -> str:
    """Stamped output folder: <base>/<EXPORT_PREFIX><yyyyMMdd_HHmmss>."""
    stamp = run_id or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    return f"{base.rstrip('/')}/{EXPORT_PREFIX}{stamp}"


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    w = df.write.mode(mode)
    if fmt == "csv":
        # blanks at the ends of a value belong to it
        (w.option("header", True).option("quoteAll", True).option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


MANIFEST = "_report.json"


def write_report(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv", mode: str = "errorifexists") -> list[str]:
    """One folder per table; returns the written paths.

    All tables or none: they are written below a folder of this run in ``out_dir``, and a manifest that names them is published last, in one
    step. A report without a manifest isn't there (``read_report``), so a failure in any table leaves no report, or with
    ``mode="overwrite"`` the one before; what the failed run wrote is deleted. The manifest has each table's number of rows.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError("mode must be 'errorifexists' or 'overwrite'")
    spark = next(iter(tables.values())).sparkSession
    base = out_dir.rstrip("/")
    before = read_manifest(spark, base)
    if before and mode != "overwrite":
        raise FileExistsError(f"a report stands in {base} already")
    run = f"run-{uuid.uuid4().hex[:12]}"
    manifest = {"run": run, "format": fmt, "tables": {}}
    try:
        for name, df in tables.items():
            seen = Observation()
            write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{base}/{run}/{name}", fmt)
            manifest["tables"][name] = {"rows": seen.get["rows"]}
        publish_text(spark, f"{base}/{MANIFEST}", json.dumps(manifest))
    except BaseException:
        delete_path(spark, f"{base}/{run}")
        raise
    if before:
        delete_path(spark, f"{base}/{before['run']}")
    return [f"{base}/{run}/{name}" for name in tables]


def read_manifest(spark: SparkSession, out_dir: str) -> dict | None:
    """The manifest of the report in a folder; None when there is none."""
    path = f"{out_dir.rstrip('/')}/{MANIFEST}"
    return json.loads(read_text(spark, path)) if path_exists(spark, path) else None


def read_report(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of a finished report by name. CSV values come back as they were written, line breaks and quotes included."""
    manifest = read_manifest(spark, out_dir)
    if manifest is None:
        raise FileNotFoundError(f"no finished report in {out_dir}")
    reader = spark.read
    if manifest["format"] == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return {name: reader.format(manifest["format"]).load(f"{out_dir.rstrip('/')}/{manifest['run']}/{name}") for name in manifest["tables"]}
