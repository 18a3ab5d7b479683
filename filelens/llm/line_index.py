"""Line dedup over a reversible index: sharded cuckoo filters backed by exact reference-count tables.

The index of a set of documents has three tables:

* ``docs``: each document's distinct line keys (128-bit digests), so that a document can be taken out again;
* ``refs``: exact reference counts, a row per key: holders, smallest and largest holding doc_id. A key whose two ids differ is shared;
* ``filters``: cuckoo filters by shard of the key (16-bit fingerprints, two buckets of four slots; a full filter gets a larger
  one beside it). The ``seen`` filter holds every key of ``refs``, the ``shared`` filter the shared ones.

``insert`` asks the ``seen`` filter first: a key that it has not seen is new for certain and needs no look-up in ``refs``; only the others
are joined with it. ``delete`` takes documents out: counts fall, the next smallest holder becomes the first, keys without a holder
leave both tables and the filter, and keys down to one document leave the ``shared`` filter. Insertion followed by deletion gives the same
reference counts, and so the same cleaned texts, as if the documents had never come. ``clean`` drops lines: those whose key is not in the
``shared`` filter stay without a look-up, the others are settled by the exact table.

Plan: texts are read once for keys and once more to be cut; keys are counted by (key) with partial sums, so a line that a third of all
documents hold arrives as a few rows. In ``clean`` keys with over 1 / ``HOT_SHARE`` of all references (at most ``HOT_SHARE`` of them, by their
number the only rows that are always broadcast) are settled in the map tasks; no other key has more rows than that in the join.
The shared filters are broadcast when their measured size is below ``FILTER_BYTES``; above it every line goes to the exact join.

Defined cases: a null or empty text is one empty line; keys of fewer than ``MIN_CHARS`` code points are never dropped; a null doc_id stands for
the largest of all ids; rows that share a doc_id are one document (each keeps or loses the same keys); a key repeated within one
document only is not shared; an empty table gives no row; other columns are ignored. Digests are taken as equal when their 128 bits are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import materialize
from .common import SPACE, raw_texts

MIN_CHARS = 10
SHARD_KEYS = 500_000  # keys of a shard when an index is begun (about)
HOT_SHARE = 1000
FILTER_BYTES = 32 << 20
NO_ID = (1 << 63) - 1

_SLOTS, _LOAD, _ROUNDS = 4, 0.9, 400
_DOCS = "doc long, hi array<long>, lo array<long>"
_REFS = "shard int, hi long, lo long, n_refs long, first_doc long, last_doc long"
_FILTERS = "shard int, kind string, gen int, n_items long, slots binary"
_STEP = _REFS + ", hit boolean, kind string, gen int, n_items long, slots binary"
_HIDE = np.uint64(0x9E3779B97F4A7C15)


# ---- lines ---------------------------------------------------------------------------------------------------------

def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # of bytes: A-Z only


def key_digest(line: bytes, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    """Digest of the line's key (two signed 64-bit halves); None for a short one."""
    key = line_key(line)
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    h = xxhash.xxh3_128_intdigest(key)
    hi, lo = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return hi - (1 << 64) if hi >> 63 else hi, lo - (1 << 64) if lo >> 63 else lo


def _keys_of(min_chars: int):
    def run(batches):
        for batch in batches:
            his, los = [], []
            for raw in raw_texts(batch.column(1)):
                got = {d for line in set(raw.split(b"\n")) if (d := key_digest(line, min_chars)) is not None}
                his.append([d[0] for d in got])
                los.append([d[1] for d in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(his, pa.list_(pa.int64())), pa.array(los, pa.list_(pa.int64()))],
                                             names=["doc", "hi", "lo"])
    return run


def document_keys(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, hi, lo): the distinct line keys of every row."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(_keys_of(min_chars), _DOCS)


# ---- cuckoo filters ------------------------------------------------------------------------------------------------

class Cuckoo:
    """A cuckoo filter of 64-bit hashes; whole arrays are inserted, looked up and deleted together."""

    def __init__(self, n_buckets: int, slots: bytes | None = None, n_items: int = 0):
        self.n = n_buckets
        self.table = (np.zeros((n_buckets, _SLOTS), dtype=np.uint16) if slots is None else
                      np.frombuffer(slots, dtype=np.uint16).reshape(n_buckets, _SLOTS).copy())
        self.items = n_items

    @staticmethod
    def for_items(n: int) -> Cuckoo:
        return Cuckoo(1 << max(2, int(np.ceil(np.log2(max(n, 1) / (_SLOTS * _LOAD))))))

    @property
    def room(self) -> int:
        return int(self.n * _SLOTS * _LOAD) - self.items

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.view(np.uint64)
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (h & np.uint64(self.n - 1)).astype(np.int64)

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (((fp.astype(np.uint64) * _HIDE) >> np.uint64(20)) & np.uint64(self.n - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        fp, b = self._places(hashes)
        return (self.table[b] == fp[:, None]).any(axis=1) | (self.table[self._other(fp, b)] == fp[:, None]).any(axis=1)

    def insert(self, hashes: np.ndarray) -> None:
        """Inserts all hashes (each once more if it is there). Raises when they don't find room; ``room`` leaves enough."""
        fp, b = self._places(hashes)
        dice = np.random.default_rng(len(hashes))
        self.items += len(hashes)
        for turn in range(_ROUNDS):
            if not len(fp):
                return
            order = np.argsort(b, kind="stable")
            fp, b = fp[order], b[order]
            start = np.concatenate(([True], b[1:] != b[:-1]))
            place = np.arange(len(b))
            rank = place - np.maximum.accumulate(np.where(start, place, 0))
            free = np.cumsum(self.table[b] == 0, axis=1)
            fits = rank < free[:, -1]
            slot = (free[fits] == rank[fits, None] + 1).argmax(axis=1)
            self.table[b[fits], slot] = fp[fits]
            first_out = rank[~fits] == free[~fits, -1]  # one of each full bucket
            fp, b = fp[~fits], b[~fits]
            if turn and len(fp):  # it takes the place of another, which goes to its other bucket
                at = np.flatnonzero(first_out)
                slot = dice.integers(0, _SLOTS, len(at))
                out = self.table[b[at], slot].copy()
                self.table[b[at], slot] = fp[at]
                fp[at] = out
            b = self._other(fp, b)
        if len(fp):
            raise RuntimeError("cuckoo filter overfull")

    def delete(self, hashes: np.ndarray) -> None:
        """Takes one copy of each hash out; only what was inserted may be deleted."""
        fp, b = self._places(hashes)
        self.items -= len(hashes)
        while len(fp):
            mine = self.table[b] == fp[:, None]
            other = self._other(fp, b)
            theirs = self.table[other] == fp[:, None]
            here = mine.any(axis=1)
            if not (here | theirs.any(axis=1)).all():
                raise KeyError("a hash that the filter doesn't hold")
            spot = np.where(here, b * _SLOTS + mine.argmax(axis=1), other * _SLOTS + theirs.argmax(axis=1))
            _, one = np.unique(spot, return_index=True)  # equal fingerprints of one bucket go one at a time
            self.table.reshape(-1)[spot[one]] = 0
            left = np.ones(len(fp), dtype=bool)
            left[one] = False
            fp, b = fp[left], b[left]


class Generations:
    """The filters of one shard and kind: a new, larger one is added when the last is full."""

    def __init__(self, parts: list[Cuckoo] | None = None):
        self.parts = parts or []

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=bool)
        for p in self.parts:
            out |= p.has(hashes)
        return out

    def insert(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        if not self.parts or self.parts[-1].room < len(hashes):
            before = sum(p.items for p in self.parts)
            self.parts.append(Cuckoo.for_items(max(before, len(hashes), 16)))
        self.parts[-1].insert(hashes)

    def delete(self, hashes: np.ndarray) -> None:
        """Out of the filters that hold them, the newest first."""
        for p in reversed(self.parts):
            held = p.has(hashes)
            p.delete(hashes[held])
            hashes = hashes[~held]
        if len(hashes):
            raise KeyError("a hash that no filter holds")
        self.parts = [p for p in self.parts if p.items]

    def rows(self, shard: int, kind: str) -> list[tuple]:
        return [(shard, kind, g, p.items, p.table.tobytes()) for g, p in enumerate(self.parts)]


def _generations(table: pa.Table) -> dict[str, Generations]:
    out = {"seen": Generations(), "shared": Generations()}
    for r in sorted(table.to_pylist(), key=lambda r: r["gen"]):
        out[r["kind"]].parts.append(Cuckoo(len(r["slots"]) // (2 * _SLOTS), r["slots"], r["n_items"]))
    return out


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks() if table.num_rows else [], dtype=np.int64)


def _filter_table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _FILTERS.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=names)


def _inserted(key, keys: pa.Table, filters: pa.Table) -> pa.Table:
    """One shard's new keys, each with whether the filter had seen it, and the filters with the new ones inserted. Keys not seen that
    two documents of the batch hold are shared at once; for the others the exact table has to say."""
    held = _generations(filters)
    hashes = _longs(keys, "lo")
    hit = held["seen"].has(hashes)
    shared = np.asarray(pc.not_equal(keys.column("first_doc"), keys.column("last_doc"))) if len(hashes) else hit
    held["seen"].insert(hashes[~hit])
    held["shared"].insert(hashes[~hit & shared])
    rows = _filter_table([r for kind, g in held.items() for r in g.rows(int(key[0].as_py()), kind)])
    return pa.concat_tables([keys.append_column("hit", pa.array(hit)), rows], promote_options="default").select(_STEP_NAMES)


_STEP_NAMES = [x.split()[0] for x in _STEP.split(", ")]


def _changed(key, changes: pa.Table, filters: pa.Table) -> pa.Table:
    """Filters with the given insertions and deletions (columns kind, lo, add)."""
    held = _generations(filters)
    for kind, g in held.items():
        mine = changes.filter(pc.equal(changes.column("kind"), kind)) if changes.num_rows else changes
        if mine.num_rows:
            hashes, add = _longs(mine, "lo"), np.asarray(mine.column("add"))
            g.delete(hashes[~add])
            g.insert(hashes[add])
    return _filter_table([r for kind, g in held.items() for r in g.rows(int(key[0].as_py()), kind)])


# ---- the index -----------------------------------------------------------------------------------------------------

@dataclass
class LineIndex:
    """The three tables (see above), stored; operations return a new index and leave the old one readable."""

    docs: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def begin(spark: SparkSession, expected_keys: int = 0, shard_keys: int = SHARD_KEYS) -> LineIndex:
        shards = max(8, -(-expected_keys // shard_keys))
        return LineIndex(*(spark.createDataFrame([], ddl) for ddl in (_DOCS, _REFS, _FILTERS)), shards)

    def save(self, folder: str) -> None:
        for name in ("docs", "refs", "filters"):
            getattr(self, name).write.parquet(f"{folder}/{name}")
        self.docs.sparkSession.createDataFrame([(self.shards,)], "shards int").write.parquet(f"{folder}/shards")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LineIndex:
        return LineIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("docs", "refs", "filters")),
                         spark.read.parquet(f"{folder}/shards").first()[0])

    def _shard(self):
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int").alias("shard")

    def _counted(self, docs: DataFrame) -> DataFrame:
        """Reference counts of the keys of ``docs``, summed in the map tasks first."""
        pairs = docs.select("doc", F.explode(F.arrays_zip("hi", "lo")).alias("k")).select("doc", "k.hi", "k.lo")
        return (pairs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_refs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
                .select(self._shard(), "hi", "lo", "n_refs", "first_doc", "last_doc"))

    def _filters_after(self, changes: DataFrame) -> DataFrame:
        """Filters after insertions and deletions (shard, kind, lo, add)."""
        return materialize(changes.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_changed, _FILTERS))

    def insert(self, keys: DataFrame) -> LineIndex:
        """The index with the documents of ``keys`` (from ``document_keys``) as well. Their ids must not be in it yet."""
        keys = keys.select("doc", "hi", "lo")
        step = materialize(self._counted(keys).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_inserted, _STEP))
        ref_names = self.refs.columns
        fresh = step.where("kind is null and not hit").select(*ref_names)
        hits = step.where("kind is null and hit").select("hi", "lo", *[F.col(c).alias(f"_{c}") for c in ("n_refs", "first_doc", "last_doc")])
        filters = step.where("kind is not null").select(*self.filters.columns)
        if self.refs.isEmpty():  # nothing to meet: no key can have been seen
            return LineIndex(keys, fresh, filters, self.shards)
        old = self.refs.withColumn("_old", F.lit(True)).join(hits, ["hi", "lo"], "full")
        merged = old.select(
            self._shard(), "hi", "lo", (F.coalesce("n_refs", F.lit(0)) + F.coalesce("_n_refs", F.lit(0))).alias("n_refs"),
            F.least("first_doc", "_first_doc").alias("first_doc"), F.greatest("last_doc", "_last_doc").alias("last_doc"),
            # seen only by the filter's error: not in it yet
            F.col("_old").isNull().alias("_new"), (F.col("first_doc") != F.col("last_doc")).alias("_was"),
            F.col("_n_refs").isNotNull().alias("_met"))
        merged = materialize(merged)
        now = F.col("first_doc") != F.col("last_doc")
        seen = merged.where("_new").select("shard", F.lit("seen").alias("kind"), "lo", F.lit(True).alias("add"))
        shared = merged.where(F.col("_met") & now & ~F.coalesce("_was", F.lit(False))).select(
            "shard", F.lit("shared").alias("kind"), "lo", F.lit(True).alias("add"))
        between = LineIndex(self.docs, self.refs, filters, self.shards)
        return LineIndex(self.docs.unionByName(keys), materialize(merged.select(*ref_names).unionByName(fresh)),
                         between._filters_after(seen.unionByName(shared)), self.shards)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> LineIndex:
        """The index without the documents of the given ids."""
        gone_ids = ids.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        stay = materialize(self.docs.join(gone_ids, "doc", "left_anti"))
        touched = materialize(self._counted(self.docs.join(gone_ids, "doc", "left_semi")).select("hi", "lo"))
        left = stay.select("doc", F.explode(F.arrays_zip("hi", "lo")).alias("k")).select("doc", "k.hi", "k.lo").join(
            touched, ["hi", "lo"], "left_semi")  # only of the keys whose counts change
        again = materialize(left.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_refs"), F.min("doc").alias("first_doc"),
                                                         F.max("doc").alias("last_doc")).select(self._shard(), "hi", "lo", "n_refs", "first_doc", "last_doc"))
        refs = materialize(self.refs.join(touched, ["hi", "lo"], "left_anti").unionByName(again))
        before = self.refs.join(touched, ["hi", "lo"], "left_semi").where("first_doc <> last_doc").select("shard", "hi", "lo")
        after = again.where("first_doc <> last_doc").select("hi", "lo")
        out = before.join(after, ["hi", "lo"], "left_anti").select("shard", F.lit("shared").alias("kind"), "lo", F.lit(False).alias("add"))
        none = touched.join(again, ["hi", "lo"], "left_anti").select(self._shard(), F.lit("seen").alias("kind"), "lo", F.lit(False).alias("add"))
        return LineIndex(stay, refs, self._filters_after(out.unionByName(none)), self.shards)

    def shared(self) -> DataFrame:
        """The keys that at least two documents hold."""
        return self.refs.where("first_doc <> last_doc")

    def drops(self, keys: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """(doc, lo_hi array<binary>): the keys that each document of ``keys`` loses."""
        spark = keys.sparkSession
        total = self.refs.agg(F.coalesce(F.sum("n_refs"), F.lit(0))).first()[0]
        hot = self.shared().where(F.col("n_refs") * F.lit(HOT_SHARE) > F.lit(total)).select("hi", "lo", "first_doc").collect()  # at most HOT_SHARE rows
        kept = self.filters.where("kind = 'shared'")
        size = kept.agg(F.coalesce(F.sum(F.length("slots")), F.lit(0))).first()[0]
        parts = [(r["shard"], r["n_items"], r["slots"]) for r in kept.collect()] if size <= filter_bytes else None
        known = spark.sparkContext.broadcast(({(r["hi"], r["lo"]): r["first_doc"] for r in hot}, parts))
        shards = self.shards

        def screen(batches):
            hot_keys, filter_rows = known.value
            filters: dict[int, Generations] = {}
            for shard, n, slots in filter_rows or []:
                filters.setdefault(shard, Generations()).parts.append(Cuckoo(len(slots) // (2 * _SLOTS), bytes(slots), n))
            for batch in batches:
                doc = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy())
                hi, lo = (batch.column(i).flatten().to_numpy() for i in (1, 2))
                if filter_rows is not None:
                    shard, ok = hi % shards, np.zeros(len(hi), dtype=bool)
                    for s in np.unique(shard):
                        if s in filters:
                            at = np.flatnonzero(shard == s)
                            ok[at] = filters[s].has(np.ascontiguousarray(lo[at]))
                    doc, hi, lo = doc[ok], hi[ok], lo[ok]
                first = [hot_keys.get(k) for k in zip(hi.tolist(), lo.tolist())] if hot_keys else [None] * len(hi)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(first, pa.int64())],
                                                 names=["doc", "hi", "lo", "first_doc"])

        asked = materialize(keys.select("doc", "hi", "lo").mapInArrow(screen, "doc long, hi long, lo long, first_doc long"))
        cold = self.shared().where(F.col("n_refs") * F.lit(HOT_SHARE) <= F.lit(total)).select("hi", "lo", "first_doc")
        settled = asked.where("first_doc is not null").unionByName(asked.where("first_doc is null").drop("first_doc").join(cold, ["hi", "lo"]))
        lost = settled.where("first_doc <> doc")
        return lost.groupBy("doc").agg(F.collect_set(F.concat(F.unhex(F.lpad(F.hex("hi"), 16, "0")), F.unhex(F.lpad(F.hex("lo"), 16, "0")))).alias("lost"))


def _cut(min_chars: int, texts: bool):
    def run(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for raw, lost in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                lines = raw.count(b"\n") + 1
                dropped = 0
                if lost:
                    lost = set(lost)
                    stay, verdict = [], {}
                    for line in raw.split(b"\n"):
                        gone = verdict.get(line)
                        if gone is None:
                            d = key_digest(line, min_chars)
                            gone = verdict[line] = d is not None and b"".join(x.to_bytes(8, "big", signed=True) for x in d) in lost
                        if not gone:
                            stay.append(line)
                    dropped = lines - len(stay)
                    raw = b"\n".join(stay)
                n_lines.append(lines)
                n_dropped.append(dropped)
                kept.append(raw.decode("utf-8") if texts else hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_lines", "n_dropped", "kept"])
    return run


def clean(index: LineIndex, docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, texts: bool = True,
          keys: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row's text without the lines that it loses; ``kept`` is the text, or with ``texts=False`` its
    sha256. ``keys`` are the rows' stored keys, if there are any."""
    keys = keys if keys is not None else document_keys(docs, text, key, min_chars)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"))
    return rows.join(index.drops(keys), "doc", "left").select("doc_id", "text", "lost").mapInArrow(
        _cut(min_chars, texts), "doc_id long, n_lines long, n_dropped long, kept string")


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> LineIndex:
    """The index of all documents."""
    keys = materialize(document_keys(docs, text, key, min_chars))
    n = keys.agg(F.coalesce(F.sum(F.size("lo")), F.lit(0))).first()[0]
    return LineIndex.begin(docs.sparkSession, n).insert(keys)


def op12(docs: DataFrame) -> DataFrame:
    index = build(docs)
    return clean(index, docs, texts=False, keys=index.docs).withColumnRenamed("kept", "kept_sha256")


ORACLE = """
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from d),
k as (select *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as first_doc from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, s.key is not null and k.doc_id <> s.first_doc as gone from k left join s using (key))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by r, doc_id
"""
