"""Quality rules by cross-document line frequency.

Every line is normalised (A-Z lower-cased, white space collapsed) and hashed. A line is boilerplate on a
host when more distinct documents of that host hold it than ``max(min_docs, share * documents of the
host)``, or than ``most_docs``: a small host can lose a line, and a large one's allowance stops growing. Boilerplate lines are removed; a document that loses more than ``depleted`` of its words is
depleted and rejected, as is one that fails the base rules.

Plan: one pass over the texts writes a narrow table (figures, distinct line hashes with their words);
all counting is grouping over it, summed in the map tasks first, so a line that a third of all
documents hold arrives as a few partial counts. The removed lines join back on (host, line), an inner
join that adaptive execution may split.

Defined cases: a null text is empty (no words: base_failed); a null host is the host ''; repeated rows
count as documents of their own (more copies of a document than the limit lose their lines: remove copies first); other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import materialize
from .common import SPACE, raw_texts, schema_of

SYMBOLS = b"#*$%&|<>"
MIN_DOCS, SHARE, MOST_DOCS, DEPLETED = 5, 0.01, 1000, 0.5

_PROFILE = ("row_id long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, line array<long>, line_words array<long>")


def normalise(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(normalise(line))
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def text_figures(raw: bytes) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and words by distinct line hash."""
    words = raw.split()
    solid = raw.translate(None, SPACE)
    seen, again, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        n = len(line.split())
        if n:
            if line in seen:
                again += 1
            seen.add(line)
            h = line_hash(line)
            lines[h] = lines.get(h, 0) + n
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(solid.decode("utf-8", "replace")), symbols, again, repeated_words(words), lines


def _profile(batches):
    schema = schema_of(_PROFILE)
    for batch in batches:
        cols = [[] for _ in range(7)]
        for raw in raw_texts(batch.column(3)):
            *figures, lines = text_figures(raw)
            for col, x in zip(cols, [*figures, list(lines), list(lines.values())]):
                col.append(x)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *(pa.array(c, schema.field(i + 3).type) for i, c in enumerate(cols))], schema=schema)


def profile(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """The narrow table of all documents, written once to the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("long").alias("doc_id"),
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(_profile, _PROFILE))


def boilerplate_lines(table: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, line, n_docs) of the lines above their host's limit."""
    counts = table.select("host", F.explode("line").alias("line")).groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min(min_docs, most_docs))
    hosts = table.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    limit = F.least(F.greatest(F.lit(share) * F.col("host_docs"), F.lit(float(min_docs))), F.lit(float(most_docs)))
    return counts.join(hosts, "host").where(F.col("n_docs") > limit).drop("host_docs")


def verdicts(table: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE,
             depleted: float = DEPLETED, most_docs: int = MOST_DOCS) -> DataFrame:
    """One row per document: its figures, the removed lines' hashes and words, and the verdict."""
    lines = table.select("row_id", "host", F.explode(F.arrays_zip("line", "line_words")).alias("x")).select(
        "row_id", "host", F.col("x.line").alias("line"), F.col("x.line_words").alias("line_words"))
    removed = (lines.join(boilerplate_lines(table, min_docs, share, most_docs).select("host", "line"), ["host", "line"])
               .groupBy("row_id").agg(F.sum("line_words").alias("removed_words"),
                                      F.collect_list("line").alias("removed_lines")))  # at most a document's own lines
    out = table.drop("line", "line_words").join(removed, "row_id", "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("depleted", F.col("removed_words") > F.lit(depleted) * F.col("n_words")).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("depleted"))


def _without(batches):
    for batch in batches:
        out = []
        for raw, gone in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
            gone = set(gone or ())
            if gone:
                raw = b"\n".join(x for x in raw.split(b"\n") if not x.split() or line_hash(x) not in gone)
            out.append(raw.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def cleaned_texts(docs: DataFrame, verdict: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) of the kept documents without their boilerplate lines (doc_id must be unique here)."""
    kept = verdict.where("kept").select("doc_id", "removed_lines")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(kept, "doc_id")
    return rows.mapInArrow(_without, "doc_id long, text string")


def op1(docs: DataFrame) -> DataFrame:
    return verdicts(profile(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words", "depleted")
