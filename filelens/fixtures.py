"""Inventories derived from the driver's tables (FIXTURES.md §3).

Each function reads the parquet tables with Spark and returns a DataFrame in the
inventory layout, so every query's work grows with the tables. The same rules
are kept as DuckDB text in ``filelens.oracle`` for the correctness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C

# Fixed test parameters (FIXTURES.md).
AS_OF = "2001-08-01 12:00:00"
DOCS_ROOT = "/lake"
MOVE_TARGET = "/dest"
LANGS = ["de", "en", "es", "fr", "it"]


def ext_sql(k: str) -> str:
    """EXT(k): the fixture's extension rule."""
    return (f"case {k} % 8 when 0 then '.txt' when 1 then '.TXT' when 2 then '.md' when 3 then '.log' "
            f"when 4 then '.json' when 5 then '' when 6 then '.png' else '.tar.gz' end")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attributes(ro: str, hidden: str, system: str) -> str:
    return (f"concat_ws(', ', if({ro}, 'ReadOnly', null), if({hidden}, 'Hidden', null), "
            f"if({system}, 'System', null), 'Archive')")


def with_path_parts(df: DataFrame) -> DataFrame:
    """Adds name, extension, directory from full_path."""
    return (df.withColumn("name", C.file_name("full_path"))
              .withColumn("directory", C.parent_directory("full_path"))
              .withColumn("extension", C.extension_of("name")))


def _finish(df: DataFrame) -> DataFrame:
    df = with_path_parts(df)
    for col, default in (("is_dir", F.lit(False)), ("accessed", F.lit(None).cast("timestamp_ntz")),
                         ("is_link", F.lit(False)), ("accessible", F.lit(True))):
        if col not in df.columns:
            df = df.withColumn(col, default)
    return df


def inv_docs(spark: SparkSession, sf_dir: str, with_content: bool = True) -> DataFrame:
    """3.1: one file per document; content is the text."""
    cols = [
        f"concat('{DOCS_ROOT}/', source, '/', lang, '/doc_', cast(doc_id as string), {ext_sql('doc_id')}) as full_path",
        "cast(octet_length(text) as bigint) as size",
        "timestampadd(MINUTE, cast((doc_id*7919) % 43200 as int), timestamp_ntz'2024-01-01 00:00:00') as modified",
        "timestampadd(MINUTE, cast((doc_id*104729) % 43200 as int), timestamp_ntz'2023-01-01 00:00:00') as created",
        "doc_id % 11 = 0 as is_read_only",
        "doc_id % 13 = 0 as is_hidden",
        "doc_id % 17 = 0 as is_system",
        "doc_id",
    ]
    if with_content:
        cols.append("text as content")
    df = table(spark, sf_dir, "documents").selectExpr(*cols)
    df = df.withColumn("attributes", F.expr(_attributes("is_read_only", "is_hidden", "is_system")))
    return _finish(df)


def inv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3.2: statistics, buckets, boundaries, presets."""
    size = ("case when o_orderkey % 97 = 0 then 0 when o_orderkey % 89 = 0 then 104857600 "
            "else (((o_orderkey*2654435761) % 1048576) "
            "* (case o_orderkey % 6 when 3 then 8 when 4 then 64 when 5 then 512 else 1 end)) "
            "div (case o_orderkey % 6 when 0 then 2048 when 1 then 32 else 1 end) end")
    df = table(spark, sf_dir, "orders").selectExpr(
        f"concat('/lake/orders/', o_orderstatus, '/', o_orderpriority, '/c', cast(o_custkey % 50 as string), "
        f"'/o_', cast(o_orderkey as string), {ext_sql('o_orderkey')}) as full_path",
        f"cast({size} as bigint) as size",
        "cast(timestampadd(MINUTE, cast(o_orderkey % 1440 as int), o_orderdate) as timestamp_ntz) as modified",
        "cast(timestampadd(MINUTE, -cast((o_orderkey*31) % 100000 as int), o_orderdate) as timestamp_ntz) as created",
        "o_orderkey % 11 = 0 as is_read_only",
        "o_orderkey % 13 = 0 as is_hidden",
        "o_orderkey % 17 = 0 as is_system",
    )
    df = df.withColumn("attributes", F.expr(_attributes("is_read_only", "is_hidden", "is_system")))
    return _finish(df)


def inv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3.3: the scale inventory (one file per line item)."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('/lake/items/', l_returnflag, l_linestatus, '/s', cast(l_suppkey as string), '/', "
        "cast(l_orderkey as string), '-', cast(l_partkey as string), '-', cast(l_linenumber as string), "
        f"{ext_sql('l_partkey')}) as full_path",
        "cast(l_quantity as bigint) * ((l_orderkey*2654435761 + l_partkey*97) % 4194304) as size",
        "cast(l_shipdate as timestamp_ntz) as modified",
        "cast(l_shipdate as timestamp_ntz) as created",
        "false as is_read_only", "false as is_hidden", "false as is_system",
        "'Archive' as attributes",
    )
    return _finish(df)


def inv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3.4: paths from URLs (a path list with edge cases, not a keyed inventory)."""
    df = table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "url",
        r"concat('/web/', regexp_replace(url, '^https?://([^?#]*).*$', '$1')) as full_path",
        "cast(octet_length(html) as bigint) as size",
    )
    return with_path_parts(df)


# ---- side tables (3.5) ---------------------------------------------------------------------------

def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected paths: documents with doc_id % 3 <> 1."""
    return inv_docs(spark, sf_dir, with_content=False).where("doc_id % 3 <> 1").select("full_path")


def plan_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to move or copy, with several sources per name (name = doc_<id % 50><EXT>) and related names: those of every seventh
    id also have a counter, so that they are candidates of the others."""
    docs = inv_docs(spark, sf_dir, with_content=False)
    return docs.select(
        "full_path", "size", "doc_id",
        F.expr("concat('doc_', cast(doc_id % 50 as string), if(doc_id % 7 = 3, concat('_', cast(1 + doc_id % 3 as string)), ''), "
               f"{ext_sql('doc_id')})").alias("name"),
    )


def occupied_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that stand in the move target already: the names of the plan input's first ten ids, their ``_1`` and ``_3``."""
    names = plan_input(spark, sf_dir).where("doc_id < 10").select("name")
    stem, ext = C.stem_of("name"), C.raw_extension("name")
    taken = names.select(F.explode(F.array(F.col("name"), F.concat(stem, F.lit("_1"), ext), F.concat(stem, F.lit("_3"), ext))).alias("n"))
    return taken.select(F.concat(F.lit(MOVE_TARGET + "/"), "n").alias("full_path")).distinct()


def expected_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source × (de, en, es, fr, it); the 'it' ones stay empty."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    langs = F.array(*[F.lit(x) for x in LANGS])
    pairs = sources.select("source", F.explode(langs).alias("lang"))
    return pairs.select(F.concat(F.lit(DOCS_ROOT + "/"), F.col("source"), F.lit("/"), F.col("lang")).alias("directory"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-delimited report: one line per document (6th field a backslash path), plus short lines from pages."""
    docs = inv_docs(spark, sf_dir, with_content=False).select(
        F.concat(F.lit("0|1|2|3|4|"), F.translate("full_path", "/", "\\"), F.lit("|6")).alias("value"))
    short = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page|"), F.col("page_id").cast("string")).alias("value"))
    return docs.unionByName(short)


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two decisions per document with doc_id % 5 = 0; the later one wins, of two at one time the one to keep."""
    docs = inv_docs(spark, sf_dir, with_content=False).where("doc_id % 5 = 0")
    first = docs.select("full_path", F.lit("mark").alias("decision"), F.col("modified").alias("decided_at"))
    second = docs.select("full_path",
                         F.when(F.col("doc_id") % 2 == 0, F.lit("keep")).otherwise(F.lit("mark")).alias("decision"),
                         F.expr("timestampadd(HOUR, 1, modified)").alias("decided_at"))
    tied = second.where(F.col("decision") == "keep").select("full_path", F.lit("mark").alias("decision"), "decided_at")
    return first.unionByName(second).unionByName(tied)
