"""Hard negatives by Kronecker-packed inner products.

A vector's components become the integers floor(256 x). Several candidates are packed into one row of wide integers: their components are
biased to be non-negative and put into separate bit fields, wide enough for a whole inner product with a (biased) anchor, so one
multiplication of an anchor component and one addition serve all fields, no field reaches the next, and unpacking and taking the bias
out again gives every candidate's exact score. Wide integers are the integers below 2^53 that a double holds exactly, so the products
run through the machine's matrix multiplication; the sum of any terms stays below 2^53 by the choice of the field width. Where a range
of components is too large for a field of 53 bits, Python's integers (any width) take the same fields.

Plan: rows are written once in packs (binary columns, a few thousand rows of one label run). Anchors and candidates meet in cells
(anchor slab, candidate salt): a cell holds a bounded number of either side, packs of one side are copied once for each slab or
salt of the other, and a label with a third of all rows is as many cells as any other rows. Two rounds: the best of an
anchor's own label (its positives), then, in each positive's score window, the best of other labels. A cell returns at most ``n_pos`` rows
an anchor, or ``n_neg`` a positive; the best of these over all cells are exact.

Defined cases: rows with a null id, label or vector, or with any null or non-finite component take no part; vectors of
unlike length meet as if the shorter one ended in zeros (an empty one scores 0); rows that share an id are rows of their own, an anchor's
row meets all rows with another id, and an id is an anchor once, with its smallest (label, vector); no positive, or no row inside the window: no row; an empty
table: no row; other columns are ignored. A score beyond 64 bits is an error, not a wrong number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import materialize

SCALE, LABELS, N_POS, N_NEG = 256, 10, 5, 3
EXACT_BITS = 53  # integers that a double holds without loss
WIDE_FIELDS = 32  # fields of one of Python's integers
PACK_ROWS = 2048  # rows of a pack
SLAB_NUMBERS, CELL_NUMBERS = 1 << 20, 1 << 22  # components of a slab's anchors and of a cell's candidates (about)
CHUNK = 2048  # candidates multiplied at a time
TILE = 1024  # anchors multiplied at a time

_PACK = "label_min long, label_max long, n long, dim int, small boolean, ids binary, labels binary, comps binary, extra binary"
_POS = "anchor_id long, positive_id long, positive_score long"
_NEG = "anchor_id long, positive_id long, pos_rank int, positive_score long, negative_id long, negative_score long"


# ---- integers ------------------------------------------------------------------------------------------------------

def quantise(values: np.ndarray, lengths: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of vectors that lie one after another, padded with zeros to one length: int64 where that holds them, else
    Python's integers."""
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = values
    if not out.size or np.abs(out).max() < 2.0 ** 52 / scale:
        return np.floor(out * scale).astype(np.int64)
    big = np.empty(out.shape, dtype=object)
    for at, x in np.ndenumerate(out):  # as exact fractions, also beyond 2^53
        n, d = float(x).as_integer_ratio()
        big[at] = n * scale // d
    return big


def field_bits(dim: int, most_a: int, most_b: int) -> int:
    """Bits of a field that holds any inner product of ``dim`` products up to most_a * most_b."""
    return max(1, (max(dim, 1) * int(most_a) * int(most_b)).bit_length())


def packed_scores(anchors: np.ndarray, cands: np.ndarray, exact_bits: int = EXACT_BITS) -> np.ndarray:
    """Exact inner products of all anchors (rows) with all candidates, several candidates a multiplication."""
    (na, dim), nc = anchors.shape, len(cands)
    if not na or not nc or not dim:
        return np.zeros((na, nc), dtype=np.int64)
    low_a, low_c = int(anchors.min()), int(cands.min())
    a, c = anchors - low_a, cands - low_c  # biased: nothing is negative
    width = field_bits(dim, int(a.max()), int(c.max()))
    wide = width > exact_bits
    fields = WIDE_FIELDS if wide else exact_bits // width
    groups = -(-nc // fields)
    filled = np.zeros((groups * fields, dim), dtype=object if wide else np.int64)
    filled[:nc] = c
    # field f of group g is candidate f * groups + g
    packed = sum((filled[f * groups:(f + 1) * groups] << (width * f) if not wide else
                  filled[f * groups:(f + 1) * groups] * (1 << (width * f))) for f in range(fields))
    if wide:
        product = a.astype(object) @ packed.T
    else:
        product = (a.astype(np.float64) @ packed.T.astype(np.float64)).astype(np.int64)
    mask = (1 << width) - 1
    parts = [(product >> (width * f)) & mask for f in range(fields)]
    scores = np.concatenate(parts, axis=1)[:, :nc]
    # (a + low_a)(c + low_c) summed: the biases are taken out again
    most = dim * max(abs(low_a), abs(int(anchors.max()))) * max(abs(low_c), abs(int(cands.max())))
    if most >= 1 << 61:  # these sums need more than 64 bits
        a, c, scores = a.astype(object), c.astype(object), scores.astype(object)
    return scores + low_a * c.sum(axis=1)[None, :] + low_c * a.sum(axis=1)[:, None] + dim * low_a * low_c


# ---- packs ---------------------------------------------------------------------------------------------------------

def _packs(batches, rows: int = PACK_ROWS):
    """Packs of (vec_id, label, vector) rows; a batch's rows are put in the order of their labels first."""
    for batch in batches:
        ids, labels = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        order = np.lexsort((ids, labels))
        out = []
        for at in range(0, len(order), rows):
            pick = order[at:at + rows]
            vectors = batch.column(2).take(pa.array(pick))
            comps = quantise(vectors.flatten().to_numpy(), pc.list_value_length(vectors).to_numpy().astype(np.int64))
            small = comps.dtype != object
            out.append((int(labels[pick].min()), int(labels[pick].max()), len(pick), comps.shape[1], small, ids[pick].tobytes(),
                        labels[pick].tobytes(), _narrow(comps) if small else b"", b"" if small else _text(comps)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _PACK_TYPES)], names=_PACK_NAMES)


_PACK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_PACK_NAMES = [x.split()[0] for x in _PACK.split(", ")]


def _narrow(comps: np.ndarray) -> bytes:
    """Integers in as few bytes as all of them need, the width first."""
    for kind in (np.int16, np.int32):
        if not comps.size or (comps.min() >= np.iinfo(kind).min and comps.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + comps.astype(kind).tobytes()
    return bytes([8]) + comps.tobytes()


def _text(comps: np.ndarray) -> bytes:
    return ",".join(str(x) for x in comps.ravel()).encode()


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, components) of all packs of a table, in ascending order of ids."""
    ids, labels, parts = [], [], []
    col = {n: table.column(n).to_pylist() for n in ("n", "dim", "small", "ids", "labels", "comps", "extra")}
    for n, dim, small, i, lab, comps, extra in zip(*col.values()):
        ids.append(np.frombuffer(i, dtype=np.int64))
        labels.append(np.frombuffer(lab, dtype=np.int64))
        if small:
            part = np.frombuffer(comps[1:], dtype=f"i{comps[0]}").reshape(n, dim)
        else:
            part = np.array([int(x) for x in extra.split(b",")] if extra else [], dtype=object).reshape(n, dim)
        parts.append(part)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    dim = max(p.shape[1] for p in parts)
    kind = object if any(p.dtype == object for p in parts) else np.int64
    comps = np.zeros((sum(map(len, parts)), dim), dtype=kind)
    at = 0
    for p in parts:
        comps[at:at + len(p), :p.shape[1]] = p
        at += len(p)
    ids, labels = np.concatenate(ids), np.concatenate(labels)
    order = np.argsort(ids, kind="stable")
    return ids[order], labels[order], comps[order]


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = max(a.shape[1], b.shape[1])
    return tuple(np.concatenate([x, np.zeros((len(x), dim - x.shape[1]), dtype=x.dtype)], axis=1) if x.shape[1] < dim else x for x in (a, b))


def _chunks(n: int, first: int = 128, most: int = CHUNK):
    """Growing ranges: after a short one the best found so far lets few later ones through."""
    at, size = 0, first
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(most, size * 2)


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best: higher score first, then smaller id."""
    if not len(owner):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((ids, -scores, owner))
    own = owner[order]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    return order[rank < k]


class _Top:
    """The k best (id, score) of each owner so far. Candidates come in ascending order of ids, so a later one must score more."""

    def __init__(self, n: int, k: int, scores_kind):
        self.k = k
        self.owner, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores = np.zeros(0, dtype=scores_kind)
        self.full = np.zeros(n, dtype=bool)
        self.least = np.zeros(n, dtype=scores_kind)

    def add(self, owner, ids, scores):
        owner, ids = np.concatenate([self.owner, owner]), np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores])
        keep = _best(owner, ids, scores, self.k)
        self.owner, self.ids, self.scores = owner[keep], ids[keep], scores[keep]
        last = np.flatnonzero(np.concatenate((self.owner[1:] != self.owner[:-1], [True]))) if len(keep) else keep
        count = np.bincount(self.owner, minlength=len(self.full))
        self.full = count >= self.k
        self.least[self.owner[last]] = self.scores[last]


def _long(scores) -> list[int]:
    out = [int(x) for x in scores]
    if any(not -(1 << 63) <= x < 1 << 63 for x in out):
        raise OverflowError("an inner product doesn't fit 64 bits")
    return out


def _positives(n_pos: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, a_labels, a_all = _unpack(left)
        c_ids, c_labels, c_all = _unpack(right)
        rows: list[tuple] = []
        if len(a_ids) and len(c_ids):
            a_all, c_all = _same_width(a_all, c_all)
            for label in np.unique(a_labels):  # only rows of one label are multiplied
                mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(c_labels == label)
                for t in range(0, len(mine), TILE):
                    rows += _positive_tile(a_ids[mine[t:t + TILE]], a_all[mine[t:t + TILE]], c_ids[theirs], c_all[theirs], n_pos)
        return _rows(rows, [pa.int64()] * 3, ["anchor_id", "positive_id", "positive_score"])
    return run


def _positive_tile(a_ids, a, c_ids, c, k):
    top = None
    for lo, hi in _chunks(len(c_ids)):
        s = packed_scores(a, c[lo:hi])
        top = top or _Top(len(a_ids), k, s.dtype if s.dtype == object else np.int64)
        if s.dtype == object and top.scores.dtype != object:
            top.scores, top.least = top.scores.astype(object), top.least.astype(object)
        ok = (~top.full[:, None] | (s > top.least[:, None])) & (a_ids[:, None] != c_ids[None, lo:hi])
        i, j = np.nonzero(ok.astype(bool))
        top.add(i, c_ids[lo:hi][j], s[i, j])
    if top is None:
        return []
    return list(zip(a_ids[top.owner].tolist(), top.ids.tolist(), _long(top.scores)))


def _negatives(n_neg: int, n_pos: int, low: int, high: int):
    """``low`` and ``high``: the window's ends in percent of the positive's score."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.filter(pc.is_valid(left.column("anchor_id")))
        a_ids, a_labels, a_all = _unpack(left.filter(pc.is_valid(left.column("ids"))))
        c_ids, c_labels, c_all = _unpack(right)
        rows: list[tuple] = []
        if len(a_ids) and len(c_ids) and len(asked):
            a_all, c_all = _same_width(a_all, c_all)
            at = np.searchsorted(a_ids, np.asarray(asked.column("anchor_id")))
            rank, pid = np.asarray(asked.column("pos_rank")), np.asarray(asked.column("positive_id"))
            score = np.asarray(asked.column("positive_score"))
            for t in range(0, len(a_ids), TILE):
                own = slice(t, t + TILE)
                n = len(a_ids[own])
                ps, ids = np.zeros((n, n_pos), dtype=np.int64), np.zeros((n, n_pos), dtype=np.int64)
                has = np.zeros((n, n_pos), dtype=bool)
                here = (at >= t) & (at < t + n)
                ps[at[here] - t, rank[here] - 1], ids[at[here] - t, rank[here] - 1] = score[here], pid[here]
                has[at[here] - t, rank[here] - 1] = True
                rows += _negative_tile(a_ids[own], a_labels[own], a_all[own], ps, ids, has, c_ids, c_labels, c_all, n_neg, low, high)
        return _rows(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], _NEG_NAMES)
    return run


_NEG_NAMES = [x.split()[0] for x in _NEG.split(", ")]


def _window(ps: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer n with low * p <= 100 * n <= high * p, without products beyond 64 bits."""
    q, r = np.divmod(ps, 100)
    return low * q - (-(low * r) // 100), high * q + (high * r) // 100


def _negative_tile(a_ids, a_labels, a, ps, pids, has, c_ids, c_labels, c, k, low, high):
    n, n_pos = ps.shape
    lows, highs = _window(ps, low, high)
    has = has & (lows <= highs)
    tops = [_Top(n, k, np.int64) for _ in range(n_pos)]
    for lo, hi in _chunks(len(c_ids)):
        s = packed_scores(a, c[lo:hi])
        # what any of the positives can still take
        floor = np.full(n, np.iinfo(np.int64).max)
        ceiling = np.full(n, np.iinfo(np.int64).min)
        for p, top in enumerate(tops):
            least = np.where(top.full, np.maximum(lows[:, p], top.least + 1), lows[:, p])
            floor = np.where(has[:, p], np.minimum(floor, least), floor)
            ceiling = np.where(has[:, p], np.maximum(ceiling, highs[:, p]), ceiling)
        ok = (s >= floor[:, None]) & (s <= ceiling[:, None]) & (a_labels[:, None] != c_labels[None, lo:hi])
        i, j = np.nonzero(ok.astype(bool))
        if not len(i):
            continue
        found, ids = np.asarray(s[i, j], dtype=np.int64), c_ids[lo:hi][j]
        for p, top in enumerate(tops):
            fits = has[i, p] & (found >= lows[i, p]) & (found <= highs[i, p]) & (~top.full[i] | (found > top.least[i]))
            if fits.any():
                top.add(i[fits], ids[fits], found[fits])
    out = []
    for p, top in enumerate(tops):
        o = top.owner
        out += zip(a_ids[o].tolist(), pids[o, p].tolist(), [p + 1] * len(o), ps[o, p].tolist(), top.ids.tolist(), top.scores.tolist())
    return out


def _rows(rows: list[tuple], types, names) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)


# ---- the search ----------------------------------------------------------------------------------------------------

def valid_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id long, label long, vector array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("vector")))


def _stored_packs(rows: DataFrame) -> DataFrame:
    """Packs with a number of their own, written to the shared folder (numbers must not change afterwards)."""
    packs = rows.select("vec_id", "label", "vector").mapInArrow(_packs, _PACK)
    return materialize(packs.withColumn("pack", F.monotonically_increasing_id()))


def mine(rows: DataFrame, anchors: DataFrame, n_pos: int = N_POS, n_neg: int = N_NEG, low: int = 50, high: int = 95,
         slab_numbers: int = SLAB_NUMBERS, cell_numbers: int = CELL_NUMBERS) -> DataFrame:
    """(anchor_id, positive_id, pos_rank, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` as from ``valid_rows``. An anchor's positives are its ``n_pos`` best rows of its own label; for each the ``n_neg`` best
    rows of other labels whose score lies within ``low`` to ``high`` percent of the positive's.
    """
    packs = _stored_packs(rows)
    # an id is an anchor once
    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    heads = _stored_packs(one)
    (n_packs, most), (_, most_heads) = (x.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") * F.col("dim")), F.lit(0))).first()
                                             for x in (packs, heads))
    slabs, salts = max(1, -(-most_heads // slab_numbers)), max(1, -(-most // cell_numbers))
    salts = max(salts, min(rows.sparkSession.sparkContext.defaultParallelism, n_packs))  # small inputs use all cores too

    def number(of: int):
        return F.pmod(F.xxhash64("pack"), F.lit(of)).cast("int")

    def every(of: int):
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    cands = packs.withColumn("salt", number(salts)).withColumn("slab", every(slabs))
    left = heads.withColumn("slab", number(slabs))
    keyed = left.withColumn("salt", every(salts))
    found = (keyed.groupBy("slab", "salt").cogroup(cands.groupBy("slab", "salt")).applyInArrow(_positives(n_pos), _POS))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = materialize(found.withColumn("pos_rank", F.row_number().over(first)).where(F.col("pos_rank") <= n_pos))

    # an anchor's positives go to the slab that has its vector
    homes = left.select("slab", "ids").mapInArrow(_homes, "anchor_id long, slab int")
    asked = positives.join(homes, "anchor_id").withColumn("salt", every(salts))
    both = keyed.unionByName(asked, allowMissingColumns=True)
    out = (both.groupBy("slab", "salt").cogroup(cands.groupBy("slab", "salt")).applyInArrow(_negatives(n_neg, n_pos, low, high), _NEG))
    best = Window.partitionBy("anchor_id", "positive_id", "pos_rank").orderBy(F.desc("negative_score"), "negative_id")
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_neg)
            .select("anchor_id", "positive_id", "pos_rank", "rank", "negative_id", "positive_score", "negative_score"))


def _homes(batches):
    for batch in batches:
        for slab, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = np.frombuffer(ids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.full(len(got), slab, dtype=np.int32))], names=["anchor_id", "slab"])


def op11(embeddings: DataFrame) -> DataFrame:
    rows = valid_rows(embeddings)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % F.lit(LABELS)).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mine(rows, rows.where(F.col("vec_id") % 50 == 0)).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
           from embeddings
           where label is not null and embedding is not null and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
             coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) as score
      from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score
      from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as integer) as rank,
       other_id as negative_id, cast(positive_score as bigint) as positive_score, cast(score as bigint) as negative_score
from s join p using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 3
"""
