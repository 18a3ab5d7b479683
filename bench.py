"""Headline timings: prints ONE JSON line.

Phases, like the reference's "scan, then analyse":

* scan + hash — the reference's own workload on a real folder tree (one file per document,
  written untimed before): list the tree in rounds, then hash the
  files that share a size and count duplicate groups; once more with ten files per document, outside of the total;

* ingest — derive the line-item inventory (600,000 files at sf0.1) and the document
  inventory (10,000 files) once and store them as path-range partitioned Parquet;
* queries — the duplicate pipeline on the documents (from the source table, as
  registered in ``__spark_entry__``, and from the stored inventory joined to its
  content) and the profile queries on the stored line-item inventory.

Runs at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``. Every query is forced in full with
Spark's ``noop`` sink (no collect to the driver). One warm-up query is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from filelens import catalog as K  # noqa: E402
from filelens import fixtures as X  # noqa: E402
from filelens.operators import duplicates as D  # noqa: E402
from filelens.operators import filters as FL  # noqa: E402
from filelens.operators import hierarchy as H  # noqa: E402
from filelens.operators import stats as S  # noqa: E402
from filelens.operators.common import delete_path, release_materialized  # noqa: E402
from filelens.sources import content as CT  # noqa: E402
from filelens.sources import inventory_source as A  # noqa: E402
from filelens.session import ensure_checkpoint_dir, get_session  # noqa: E402
from filelens.sinks.inventory_table import INVENTORY_COLUMNS, write_inventory  # noqa: E402


def ingest(spark, sf_dir: str, scratch: str):
    """Scan phase: derive each inventory once and store it."""
    paths, times = {}, {}
    t0 = time.perf_counter()
    paths["items"] = write_inventory(X.inv_items(spark, sf_dir), f"{scratch}/inv_items", derive=True)
    t1 = time.perf_counter()
    paths["docs"] = write_inventory(X.inv_docs(spark, sf_dir, with_content=False), f"{scratch}/inv_docs",
                                    keep=INVENTORY_COLUMNS + ["doc_id"], derive=True)
    t2 = time.perf_counter()
    times["ingest_items"] = round(t1 - t0, 3)
    times["ingest_docs"] = round(t2 - t1, 3)
    return paths, times


def _write_files(batches):
    """Executor side: one file per document (text as UTF-8) under the scratch tree."""
    import pandas as pd
    for pdf in batches:
        for path, text in zip(pdf["path"], pdf["text"]):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        yield pd.DataFrame({"n": [len(pdf)]})


def make_tree(spark, sf_dir: str, copies: int = 1) -> str:
    """A real folder tree with one file per document (untimed setup for the scan + hash phase). With ``copies``, so many files per
    document, of its first 2,000 characters; every second one differs in its end."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    text = F.col("text") if copies == 1 else F.concat(F.left("text", F.lit(2000)), F.when(F.col("copy") % 2 == 0, F.col("copy").cast("string")).otherwise(""))
    paths = docs.select(F.concat(F.lit(root + "/"), F.when(F.lit(copies > 1), F.concat(F.lit("c"), F.col("copy"), F.lit("/"))).otherwise(""),
                                 "source", F.lit("/"), "lang", F.lit("/doc_"),
                                 F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), text.alias("text"))
    paths.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_write_files, "n long") \
        .write.format("noop").mode("overwrite").save()
    return root


def scan_and_hash(spark, root: str) -> dict:
    """The reference's own workload: scan a folder tree, then hash size-sharing files for duplicates."""
    times = {}
    # warm-up of the Python data source and workers on one sub-folder: not timed
    first = sorted(os.listdir(root))[0]
    A.scan(spark, os.path.join(root, first))[0].write.format("noop").mode("overwrite").save()
    t0 = time.perf_counter()
    entries, _ = A.scan(spark, root)
    files = A.files_of(entries)  # the rounds are stored already
    times["files"] = files.count()
    times["fs_scan"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    digests = CT.file_digests(D.hash_candidates(files))
    D.duplicate_summary(D.duplicate_groups(D.digest_candidates(files, digests=digests))) \
        .write.format("noop").mode("overwrite").save()
    times["fs_hash"] = round(time.perf_counter() - t0, 3)
    return times


def docs_with_content(spark, sf_dir, inv_docs_path):
    """Stored document inventory joined to its content by key (content is never stored)."""
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    return spark.read.parquet(inv_docs_path).join(text, "doc_id")


def bench_queries(spark, sf_dir, paths):
    def items():
        return spark.read.parquet(paths["items"])

    reg = K.registry()
    return {
        # duplicates on the documents, as registered (source table → inventory → groups)
        "dup_summary": lambda: reg["duplicate_summary"](spark, sf_dir),
        "dup_fast": lambda: reg["duplicate_groups_fast"](spark, sf_dir),
        "marked_inventory": lambda: reg["marked_duplicates"](spark, sf_dir),
        "staging_plan": lambda: reg["staging_plan"](spark, sf_dir),
        # duplicates over the stored inventory + content joined by key
        "dup_groups_stored": lambda: D.duplicate_groups(
            D.digest_candidates(docs_with_content(spark, sf_dir, paths["docs"]))),
        # profile of the stored line-item inventory
        "items_totals": lambda: S.totals(items()),
        "items_median": lambda: S.median_size(items()),
        "items_extremes": lambda: S.extremes(items()),
        "items_extensions": lambda: S.extension_breakdown(items()),
        "items_histogram": lambda: S.size_histogram(items()),
        "items_dir_sizes": lambda: H.directory_sizes(items()),
        "items_search_page": lambda: FL.grid_page(items(), "all", "/s1", X.AS_OF),
        "items_candidates": lambda: D.hash_candidates(items()).select("full_path", "size"),
        "items_largest": lambda: S.largest(items(), 10),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, int(cpus) * 2), app_name="filelens-bench")
    # warm-up (JVM, code generation): not timed
    S.totals(X.inv_orders(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex[:8]}"
    paths, times = ingest(spark, sf_dir, scratch)
    found = scan_and_hash(spark, make_tree(spark, sf_dir))
    found.pop("files")
    times.update(found)
    for name, fn in bench_queries(spark, sf_dir, paths).items():
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    total = round(sum(times.values()), 3)
    # the next published point (100,000 files at sf0.1), outside of the total
    large = scan_and_hash(spark, make_tree(spark, sf_dir, copies=10))
    print(json.dumps({
        "metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf,
        "scan_and_hash_tenfold": large,
        "rows": {"documents": docs, "lineitem_files": items},
        "files_per_sec_dedup": round(docs / max(times["dup_summary"], 1e-9), 1),
        "files_per_sec_scan_and_hash": round(docs / max(times["fs_scan"] + times["fs_hash"], 1e-9), 1),
        "files_per_sec_ingest": round(items / max(times["ingest_items"], 1e-9), 1),
        "files_per_sec_profile": round(items / max(times["items_totals"], 1e-9), 1),
    }))
    release_materialized(spark)
    delete_path(spark, scratch)
    spark.stop()


if __name__ == "__main__":
    main()
