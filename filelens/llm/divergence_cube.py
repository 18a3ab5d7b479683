"""Source divergence audit on a three-dimensional cube of cells.

The sources of a language are compared with each other by their smoothed term shares. Sources are dealt into blocks of ``GROUPS``, the
kept terms of a language into blocks of about ``TERMS`` by a hash. A task owns the cell (source block, source block, term block): it gets the two
blocks' slices of that term block, computes for every two sources the part of their divergence that lies in it, and the parts are summed along the
term axis. A slice is copied once for each block of sources; neither a large source nor a long vocabulary makes a larger cell, and a
term that no source of the cell has is counted, not stored.

All arithmetic is exact. Shares are p = 1 + floor(unit (count + 1) / (N + V)); a term adds floor((p - q)^2 / q) to the divergence of p from q.

Plan: one pass over the texts counts (lang, source, term) in the map tasks, so that a frequent term or a source with a third of all rows
arrives as a few partial sums. A language's terms in at least ``MIN_DOCS`` of its documents get a number; only counts of these are kept. Sums,
ranks and tops of single terms are grouping and windows whose hot groups are cut to ``TOP`` rows before the shuffle.

Defined cases: null text, lang or source is ''; a group without any kept term has equal shares for all terms; a language without a kept term has
pairs of value 0 and no term rows; a language with one source has no pairs; repeated rows count as documents of their own; an empty table gives no row;
a null doc_id and other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import materialize
from .common import raw_texts

UNIT, MIN_DOCS, TOP = 1_000_000_000, 3, 200
GROUPS, TERMS = 32, 8192  # sources of a block, terms of a block (about)
HELD = 1_000_000  # counts that a map task holds before it hands them on

# Runs of bytes that are letters A-Z a-z or belong to a code point beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_SLICE = "lang string, i int, j int, k int, grp long, block int, term long, p long, n_terms long"
_PART = "lang string, g long, h long, part long"


def _counted(batches):
    """(lang, source, term, n, docs) of a task's (lang, source, text) rows, handed on whenever ``HELD`` counts are held."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0
    for batch in batches:
        for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
            found = _TERM.findall(raw.lower())
            table = n[lang, source]
            held -= len(table)
            table.update(found)
            docs[lang, source].update(set(found))
            held += len(table)
            if held > HELD:
                yield from _count_rows(n, docs)
                held = 0
    yield from _count_rows(n, docs)


def _count_rows(n: dict, docs: dict):
    for (lang, source), table in n.items():
        terms = list(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(table), pa.string()), pa.array([source] * len(table), pa.string()),
             pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(table.values()), pa.int64()),
             pa.array(list(map(docs[lang, source].__getitem__, terms)), pa.int64())], names=["lang", "source", "term", "n", "docs"])
    n.clear()
    docs.clear()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(groups, counts): the occurring (lang, source) groups, and (lang, source, term, n, docs)."""
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return rows.select("lang", "source").distinct(), materialize(counts)


def share(count: Column, total: Column, unit: int = UNIT) -> Column:
    """1 + floor(unit * (count + 1) / total), exact for any counts."""
    n = F.lit(unit).cast("decimal(10,0)") * (count + F.lit(1)).cast("decimal(18,0)")
    return (F.lit(1) + F.call_function("div", n, total.cast("decimal(19,0)"))).cast("long")


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are below 2^31, so squares fit."""
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """Kept terms, groups and shares of a corpus; ``pairs`` and ``terms`` compare them."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", lang: str = "lang", source: str = "source",
                 groups: int = GROUPS, terms: int = TERMS):
        groups_seen, counts = term_counts(docs, text, lang, source)
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= min_docs)
        # numbers must not change: written with them
        self.kept = materialize(kept.select("lang", "term", "lang_n").withColumn("id", F.monotonically_increasing_id()))
        by_lang = materialize(self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")))
        self.counts = materialize(counts.join(self.kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "lang_n"))
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        zero = F.lit(0).cast("long")
        rows = (groups_seen.join(by_lang, "lang", "left").join(totals, ["lang", "source"], "left")
                .select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("lang_total", zero).alias("lang_total"),
                        F.coalesce("total", zero).alias("total")))
        rows = rows.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("total") + F.col("v"))).otherwise(F.lit(1)).cast("long"))
        order = Window.partitionBy("lang").orderBy("source")
        self.groups = materialize(rows.withColumn("grp", (F.row_number().over(order) - 1).cast("long")))  # a row per group
        self.block_groups, self.block_terms = groups, terms

    def _shares(self) -> DataFrame:
        g = self.groups.select("lang", "source", "grp", "v", "total", "lang_total")
        return self.counts.join(g, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total") + F.col("v")))

    def slices(self) -> DataFrame:
        """The cells' rows: a share per group and term that it has, and a row per group (term null) with its share of absent terms."""
        size, per = F.lit(self.block_groups), F.lit(self.block_terms)
        blocks = self.groups.groupBy("lang").agg((F.floor(F.max("grp") / size) + 1).cast("int").alias("n_blocks"),
                                                 F.greatest(F.lit(1), F.ceil(F.max("v") / per)).cast("int").alias("n_k"))
        held = (self.kept.join(blocks, "lang").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n_k")).cast("int"))
                .groupBy("lang", "k").agg(F.count(F.lit(1)).alias("n_terms")))
        some = (self._shares().select("lang", "grp", F.col("id").alias("term"), "p").join(blocks, "lang")
                .withColumn("k", F.pmod(F.xxhash64("term"), F.col("n_k")).cast("int")).withColumn("n_terms", F.lit(None).cast("long")))
        none = (self.groups.select("lang", "grp", F.lit(None).cast("long").alias("term"), F.col("p0").alias("p")).join(blocks, "lang")
                .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_k") - 1))).join(held, ["lang", "k"], "left")
                .withColumn("n_terms", F.coalesce("n_terms", F.lit(0))))
        both = some.unionByName(none.select(*some.columns)).withColumn("block", F.floor(F.col("grp") / size).cast("int"))
        # with every block, itself included; the smaller one first
        both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        return both.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "k", "grp", "block", "term", "p", "n_terms")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): every ordered two sources of a language."""
        cells = self.slices().groupBy("lang", "i", "j", "k").applyInArrow(_cell, _PART)
        sums = cells.groupBy("lang", "g", "h").agg(F.sum("part").alias("value"))
        one = self.groups.select("lang", F.col("grp").alias("g"), "source")
        two = self.groups.select("lang", F.col("grp").alias("h"), F.col("source").alias("item"))
        named = sums.join(one, ["lang", "g"]).join(two, ["lang", "h"])
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return named.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a source has more of than its language, at most ``top``."""
        rows = self._shares().withColumn("q", share(F.col("lang_n"), F.col("lang_total") + F.col("v"))).where(F.col("p") > F.col("q"))
        rows = rows.select("lang", "source", F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _cell(table: pa.Table) -> pa.Table:
    """Parts of the divergences of all ordered two groups of the cell, one from either block."""
    col = {n: table.column(n) for n in ("lang", "i", "j", "grp", "block", "term", "p", "n_terms")}
    lang, i, j = (col[n][0].as_py() for n in ("lang", "i", "j"))
    grp, block, p = (np.asarray(col[n].combine_chunks()) for n in ("grp", "block", "p"))
    is_group = np.asarray(col["term"].is_null().combine_chunks())
    n_terms = int(col["n_terms"].filter(pa.array(is_group))[0].as_py())
    ids = np.unique(grp)
    at = np.searchsorted(ids, grp)
    terms, column = np.unique(np.asarray(col["term"].filter(pa.array(~is_group)).combine_chunks(), dtype=np.int64), return_inverse=True)
    absent = np.zeros(len(ids), dtype=np.int64)
    absent[at[is_group]] = p[is_group]
    shares = np.repeat(absent[:, None], len(terms) + 1, axis=1)  # the last column stands for the terms that nobody here has
    shares[at[~is_group], column] = p[~is_group]
    weight = np.ones(len(terms) + 1, dtype=np.int64)
    weight[-1] = n_terms - len(terms)
    side = np.zeros(len(ids), dtype=np.int64)
    side[at] = block
    out: list[tuple] = []
    for h in range(len(ids)):
        mine = np.flatnonzero((side == (j if side[h] == i else i)) & (ids != ids[h]))
        if len(mine):
            q = shares[h]
            d = shares[mine] - q
            out += zip([lang] * len(mine), ids[mine].tolist(), [int(ids[h])] * len(mine), ((d * d // q) @ weight).tolist())
    cols = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["lang", "g", "h", "part"])


def op13(docs: DataFrame) -> DataFrame:
    audit = Audit(docs)
    out = audit.pairs().withColumn("part", F.lit("pair")).unionByName(audit.terms().withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


ORACLE = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
o as (select r, lang, source, unnest(terms) as term from d),
kept as (select lang, term, count(*) as lang_n from o group by lang, term having count(distinct r) >= 3),
v as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
c as (select lang, source, term, count(*) as n from o semi join kept using (lang, term) group by all),
g as (select lang, source, coalesce(v, 0) as v, coalesce(lang_total, 0) as lang_total, coalesce(total, 0) as total
      from (select distinct lang, source from d) left join v using (lang)
      left join (select lang, source, sum(n) as total from c group by all) using (lang, source)),
p as (select g.lang, g.source, term, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0) + 1)::hugeint) // (total + v) as p,
             1 + (1000000000 * (lang_n + 1)::hugeint) // (lang_total + v) as q
      from g join kept using (lang) left join c using (lang, source, term)),
s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
          left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
           from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 200
"""
