"""Exact removal of repeated byte strings by sampled suffixes and bucket-pointer refinement.

A byte is removed if a string of LENGTH bytes covers it that also starts anywhere else. Suffixes are put in q-gram buckets and
refined by the bucket identifiers of later offsets: an identifier of length 2l is made from those of length l at the
position and l further on, 8 -> 16 -> 32 -> 64 -> 128 -> 200 bytes, each level used again by the next. Identifiers are
64-bit digests of content, not ranks, so every document can be refined by itself and only comparing buckets needs a shuffle.

Few suffixes have to be compared: each string of LENGTH bytes is represented by its anchor, the suffix in it whose bucket of
ANCHOR bytes is the least. Equal strings have their anchor at the same place, so strings repeat only within an anchor's
bucket. The consecutive strings of one anchor make a run, about one in 50 positions.

1. anchor buckets with a single run are done (nothing repeats);
2. in the others, runs are refined by the identifiers of their first and last strings, which cover all of the run: equal
   runs repeat as a whole;
3. buckets that still hold different runs are refined to single strings: runs that stand alone, and one run of each set of equal ones,
   give the identifiers of all their strings; those found twice repeat. Strings found twice within a batch are settled there, and one
   carrier for each goes on, so a string that a third of all documents hold arrives once a batch.

Runs are told apart by 128 bits (identifiers of the anchor's bucket and of the run), strings by 96 (the string's and half of the bucket's, which
is content of the string too). A group of equal runs, however large,
is one count in the map tasks and one representative; no pairs are made.

Defined cases: a null text is empty; a text shorter than LENGTH loses nothing; rows that share a doc_id are told apart by their texts, and
rows that are the same in both are repeats of each other; a null doc_id counts as a document; texts of any length are handled in segments; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import materialize
from .common import chunks, discard, raw_texts, signed, written

LENGTH, ANCHOR = 200, 100
SEGMENT = 1 << 20  # string starts handled at a time

_U = np.uint64
_M1, _M2 = _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)
_PLACE_BITS = 24


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of two neighbouring stretches from theirs."""
    x = a * _M1
    x ^= x >> _U(32)
    x += b
    x *= _M2
    x ^= x >> _U(29)
    return x


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of ANCHOR and of LENGTH bytes at every position that has so many (data: LENGTH bytes or more)."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    ids = np.ascontiguousarray(words).view(_U).ravel()
    at = {8: ids}
    size = 8
    while size < 128:
        ids = _join(ids[:-size], ids[size:])
        size *= 2
        at[size] = ids
    anchor = _join(at[64][:len(at[64]) - (ANCHOR - 64)], at[64][ANCHOR - 64:])
    whole = _join(at[128][:len(at[128]) - (LENGTH - 128)], at[128][LENGTH - 128:])
    return anchor, whole


def _least(anchor: np.ndarray) -> np.ndarray:
    """For every string start, the place of the least anchor bucket in it (the first of equals)."""
    wide = LENGTH - ANCHOR + 1
    x = (anchor * _M1) & ~_U((1 << _PLACE_BITS) - 1)
    x |= np.arange(len(x), dtype=_U)
    size = 1
    while size * 2 <= wide:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    x = np.minimum(x[:len(x) - (wide - size)], x[wide - size:])
    return (x & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the texts that end at ``ends`` in ``data``: (text, first start, starts - 1, bucket, run identifier)."""
    out = []
    begin = 0
    for s in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
        part = data[s:s + SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            break
        anchor, whole = identifiers(part)
        place = _least(anchor)
        start = np.arange(len(place)) + s
        text = np.searchsorted(ends, start, side="right")
        good = start + LENGTH <= ends[text]
        start, text, place = start[good], text[good], place[good]
        if not len(start):
            continue
        new = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0) | (np.diff(start) != 1)) + 1
        first = np.concatenate(([0], new))
        last = np.concatenate((new, [len(start)])) - 1
        a, p, q = place[first], start[first] - s, start[last] - s
        run = _join(_join(whole[p], whole[q]), ((q - p) * 256 + (a - p)).astype(_U))
        out.append((text[first], start[first], q - p, anchor[a], run))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _runs(batches):
    for batch in batches:
        raws = raw_texts(batch.column(1))
        keys = batch.column(0).to_numpy()
        for i, j in chunks(raws):
            ends = np.cumsum([len(x) for x in raws[i:j]])
            text, start, more, bucket, run = runs(np.frombuffer(b"".join(raws[i:j]), dtype=np.uint8), ends)
            begin = np.concatenate(([0], ends[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(bucket)), pa.array(signed(run)), pa.array(keys[i:j][text]),
                                              pa.array((start - begin[text]) << 8 | more)], names=["h", "s", "k", "run"])


def _strings(batches):
    """Of (text, asks: bucket, run, alone, ask number): dup rows (ask) settled here, and carriers (h, w, ask)."""
    for batch in batches:
        h_all, w_all, ask_all = [], [], []
        for raw, asks in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
            for a in asks:
                first, more = a["run"] >> 8, a["run"] & 255
                _, whole = identifiers(np.frombuffer(raw, dtype=np.uint8)[first:first + more + LENGTH])
                h_all.append(np.full(more + 1, a["h"] & 0xFFFFFFFF, dtype=np.int64))
                w_all.append(whole)
                ask_all.append((a["no"] << 8) + np.arange(more + 1) if a["alone"] else np.full(more + 1, -1))
        if not h_all:
            continue
        h, w, ask = np.concatenate(h_all), np.concatenate(w_all), np.concatenate(ask_all).astype(np.int64)
        order = np.lexsort((w, h))
        h, w, ask = h[order], w[order], ask[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        group = np.cumsum(new) - 1
        twice = np.bincount(group)[group] > 1
        settled = ask[twice & (ask >= 0)]
        carry_ask = np.where(twice, -1, ask)[new]
        # what is settled meets nothing else: keys of its own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([settled, h[new]])), pa.array(np.concatenate([settled, signed(w[new])])),
             pa.array(np.concatenate([settled, carry_ask])), pa.array(np.arange(len(settled) + len(carry_ask)) < len(settled))],
            names=["h", "w", "ask", "settled"])


def _cut(batches):
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for raw, spans in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
            if spans:
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(edge, [x["first"] for x in spans], 1)
                np.add.at(edge, [x["stop"] for x in spans], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                n = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
            else:
                kept, n = raw, 0
            for col, x in zip(out, [len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept]):
                col.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _keyed(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, bool]:
    """(k, text) with the id as k; or, where ids are missing or repeated, (doc_id, text, k) with a hash of id and text. And which of the two."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bad = rows.select("doc_id").groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if bad:
        return rows.withColumn("k", F.xxhash64("doc_id", "text")), False
    # the same rows and columns wherever texts are joined: Spark shuffles them once for all these joins
    return rows.select(F.col("doc_id").alias("k"), "text").where("k is not null"), True


def repeated_spans(rows: DataFrame) -> DataFrame:
    """k and ``spans`` (first, stop): all repeated strings of the rows (k, text), runs of them as one."""
    found = rows.select("k", "text").mapInArrow(_runs, "h long, s long, k long, run long")
    # stored, so that joins with it may split a hot bucket's runs
    shared = materialize(found.groupBy("h").count().where("count > 1").select("h"))
    copies = [written()]
    found = materialize(found.join(shared, "h"))
    copies.append(written())
    equal = materialize(found.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "run")).alias("rep")))
    copies.append(written())
    mixed = materialize(equal.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h", F.lit(True).alias("mixed")))
    copies.append(written())
    equal = materialize(equal.join(mixed, "h", "left").where("n > 1 or mixed"))
    copies.append(written())
    found = materialize(found.join(equal, ["h", "s"]).select(
        "h", "k", "run", (F.col("n") == 1).alias("alone"),
        (F.col("mixed").isNotNull() & (F.struct("k", "run") == F.col("rep"))).alias("ask")))
    discard(rows.sparkSession, copies)  # all later steps read the last copy
    first = F.shiftright("run", 8)
    whole = found.where("not alone").select("k", first.alias("first"), (first + F.col("run").bitwiseAND(255) + LENGTH).alias("stop"))

    asks = materialize(found.where("ask").select("k", "h", "run", "alone", F.monotonically_increasing_id().alias("no")))
    # identical rows ask alike: texts by key once
    texts = rows.select("k", "text").join(asks.groupBy("k").agg(F.collect_list(F.struct("h", "run", "alone", "no")).alias("asks")), "k")
    strings = texts.select("text", "asks").mapInArrow(_strings, "h long, w long, ask long, settled boolean")
    times = F.count(F.lit(1)).over(Window.partitionBy("h", "w"))
    again = strings.withColumn("times", times).where("ask >= 0 and (settled or times > 1)").select("ask")
    single = again.select(F.shiftright("ask", 8).alias("no"), F.col("ask").bitwiseAND(255).alias("off")).join(
        asks.select("no", "k", "run"), "no").select("k", (F.shiftright("run", 8) + F.col("off")).alias("first"))
    single = single.select("k", "first", (F.col("first") + LENGTH).alias("stop"))
    return whole.union(single).groupBy("k").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))  # one document's spans


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes left) of every row."""
    rows, plain = _keyed(docs, text, key)
    return rows.join(repeated_spans(rows), "k", "left").select(F.col("k" if plain else "doc_id").alias("doc_id"), "text", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).drop("kept")
