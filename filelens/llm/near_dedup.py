"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct word shingles. Each set gets K MinHash samples; every R of them
form a band key, and all of them are folded into an odd sketch: a bitmap in which sample (j, value)
flips one bit. The XOR of two sketches keeps only the samples that differ, so its population count
gives a precise estimate of a high similarity; it screens candidates before the exact test on full sets.

Steps, none of which pairs up a whole group:

1. sets that are equal (128-bit signature and size) form a class; its smallest doc_id stands for it;
2. in each band bucket the member whose band buckets are the most popular is the hub; every other
   member is tested with the hub only, exactly and on whole texts. An original with thousands of edited copies is
   the hub of their buckets, so this is linear where "all pairs" is not. Links are joined to components;
3. members of one hub in different components may still be linked. Two sets that share ``LIMIT`` percent must share an
   element among the first n - ceil(n * LIMIT / 100) + 1 of each in any common order (prefix filter). The order taken
   has what the hub does not hold first: copies edited in different places then share nothing in front, and where two
   prefixes meet bounds what they can share (positional filter). Those whose prefix reaches into the hub's elements are paired only if their sizes and shares with the hub allow a link. Both are exact;
4. the pairs left pass the sketch screen (``SCREEN`` is five standard errors below the limit) and the exact test. After
   this no colliding pair of different components is left open, so components are those of all links.

A pair at the limit of 0.8 shares no band with probability (1 - 0.8^4)^24 < 4e-6.

Defined cases: a text without words (or null) has an empty set, is linked with nothing and kept; rows that
share a doc_id are one document: linked if any of their texts is; a null doc_id is linked with nothing
(component_id null, kept). Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import materialize
from .common import chunks, mix64, raw_texts, schema_of, signed, word_hashes
from .components import components

WIDTH, LIMIT = 4, 80
BANDS, ROWS, SKETCH_BITS = 24, 4, 512
K = BANDS * ROWS
SCREEN = LIMIT / 100 - 5 * math.sqrt(LIMIT / 100 * (1 - LIMIT / 100) / K)

_U = np.uint64
_MULT = mix64(np.arange(1, K + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
_STEP = _U(0xE7037ED1A0B428DB)
_SETS = "doc_id long, n_shingles long, sig_a long, sig_b long, band array<long>, sketch binary"


def shingles(raws: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; the whole sequence if it has fewer words."""
    words, bounds = word_hashes(raws)
    h = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        h = h * _STEP + words[k: k + len(h)]
    h = mix64(h)
    out = []
    for i, j in zip(bounds[:-1], bounds[1:]):
        if j - i >= width:
            out.append(np.unique(h[i: j - width + 1]))
        elif j > i:
            x = _U(j - i)
            for w in words[i:j]:
                x = mix64(x * _STEP + w)
            out.append(np.array([x], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _describe(sets: list[np.ndarray]) -> list:
    """Sizes, signatures, band keys and odd sketches of shingle sets."""
    n = np.array([len(s) for s in sets])
    filled = np.flatnonzero(n)
    sig_a, sig_b = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
    band: list = [None] * len(sets)
    sketch: list = [None] * len(sets)
    if len(filled):
        flat = np.concatenate([sets[i] for i in filled])
        start = np.cumsum(n[filled]) - n[filled]
        sig_a[filled] = np.add.reduceat(mix64(flat), start)
        sig_b[filled] = np.bitwise_xor.reduceat(mix64(flat ^ _STEP), start)
        least = np.empty((len(filled), K), dtype=np.uint64)
        for j in range(K):
            least[:, j] = np.minimum.reduceat(((flat * _MULT[j]) >> _U(32)).astype(np.uint32), start)
        sample = mix64(least + (np.arange(K, dtype=np.uint64) << _U(32)))
        keys = sample.reshape(len(filled), BANDS, ROWS)
        key = np.zeros((len(filled), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            key = mix64(key * _STEP + keys[:, :, r])
        bits = np.zeros((len(filled), SKETCH_BITS), dtype=np.uint8)
        np.add.at(bits, (np.repeat(np.arange(len(filled)), K), (sample.ravel() % _U(SKETCH_BITS)).astype(np.int64)), 1)
        packed = np.packbits(bits & 1, axis=1)
        for row, i in enumerate(filled):
            band[i] = signed(key[row])
            sketch[i] = packed[row].tobytes()
    return [pa.array(n, pa.int64()), pa.array(signed(sig_a)), pa.array(signed(sig_b)),
            pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]


def _sets(width: int):
    def run(batches):
        schema = schema_of(_SETS)
        for batch in batches:
            raws = raw_texts(batch.column(1))
            for i, j in chunks(raws):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_describe(shingles(raws[i:j], width))],
                                                 schema=schema)
    return run


def sketch_distance_limit(screen: float = SCREEN) -> int:
    """Largest XOR population count of two sketches whose estimated similarity reaches ``screen``."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * K * (1 - screen) / SKETCH_BITS)))


def _screened(most: int):
    def run(batches):
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
            b = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
            far = np.bitwise_count(a ^ b).sum(axis=1)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(far <= most))
    return run


def _cached_sets(width: int):
    last: dict[bytes, np.ndarray] = {}

    def of(raw: bytes) -> np.ndarray:
        if raw not in last:
            if len(last) > 64:
                last.clear()
            last[raw] = shingles([raw], width)[0]
        return last[raw]
    return of


def _passes(both: int, n: int, m: int, limit: int) -> bool:
    return both > 0 and 100 * both >= limit * (n + m - both)


def _linked(width: int, limit: int):
    def run(batches):
        of = _cached_sets(width)
        for batch in batches:
            keep = []
            for x, y in zip(raw_texts(batch.column(2)), raw_texts(batch.column(3))):
                s, t = of(x), of(y)
                keep.append(_passes(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), limit))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))
    return run


_RELATIVE = "hub long, doc_id long, linked boolean, n long, in_hub long, reach boolean, prefix array<long>"


def _relative(width: int, limit: int):
    """Of (hub, doc_id, hub's text, text): whether they are linked, and the document's prefix in the hub's order."""
    def run(batches):
        of = _cached_sets(width)
        schema = schema_of(_RELATIVE)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for x, y in zip(raw_texts(batch.column(2)), raw_texts(batch.column(3))):
                h, s = of(x), of(y)
                own = np.setdiff1d(s, h, assume_unique=True)
                both = len(s) - len(own)
                need = len(s) + limit * len(s) // -100 + 1
                for col, v in zip(out, [_passes(both, len(s), len(h), limit), len(s), both, len(own) < need, signed(own[:need])]):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, schema.field(i + 2).type) for i, c in enumerate(out))], schema=schema)
    return run


def _with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    """a, b and their texts. Sort-merge joins: a side's size is not known beforehand, and hot keys can be split."""
    return (pairs.join(texts.select(F.col("doc_id").alias(b), F.col("text").alias("tb")).hint("merge"), b)
            .join(texts.select(F.col("doc_id").alias(a), F.col("text").alias("ta")).hint("merge"), a).select(a, b, "ta", "tb"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
                    limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the signature of its set, per row of ``docs``. ``limit``: percent
    of the union that two linked sets share (bands and screen are made for 80 and more)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = materialize(docs.mapInArrow(_sets(width), _SETS))
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = materialize(filled.join(classes, ["sig_a", "sig_b", "n_shingles"]).where("doc_id = rep")
                       .select("doc_id", "sig_a", "sig_b", "sketch", "band").dropDuplicates(["doc_id", "sig_a", "sig_b"]))

    # buckets with their hubs
    rows = reps.select("doc_id", F.posexplode("band").alias("no", "value")).select(
        "doc_id", F.xxhash64("no", "value").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(rows.join(sizes, "bucket"))
    fame = shared.groupBy("doc_id").agg(F.sum("size").alias("fame"))
    famed = shared.join(fame, "doc_id")
    hubs = famed.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("doc_id")).alias("minus"))).alias("top")).select(
        "bucket", (-F.col("top.minus")).alias("hub"))
    star = materialize(shared.join(hubs, "bucket").where("doc_id <> hub").select("hub", "doc_id").distinct())
    ids = star.select("doc_id").union(star.select("hub")).distinct()
    texts = materialize(docs.join(ids.hint("merge"), "doc_id", "left_semi"))
    relative = materialize(_with_texts(star, texts, "hub", "doc_id").mapInArrow(_relative(width, limit), _RELATIVE))
    links = relative.where("linked").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))

    # members of a hub that lie in other components than the hub, with the hub's other members
    label = materialize(components(links))
    placed = relative.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(
        label.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub", "left")
    placed = placed.withColumn("label", F.coalesce("label", "doc_id")).withColumn("hub_label", F.coalesce("hub_label", "hub"))
    mixed = placed.where("label <> hub_label").select("hub").distinct()
    placed = materialize(placed.join(mixed, "hub", "left_semi"))
    odd = placed.where("label <> hub_label")
    pair = [F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")]
    # the first element that two prefixes share leaves both so much of their own: with the hub's part it must reach the limit
    mine = [F.col("n").alias("nx"), F.col("in_hub").alias("hx")]
    front = F.posexplode("prefix").alias("at", "s")
    apart = odd.select("hub", F.col("doc_id").alias("x"), F.col("label").alias("lx"), *mine, front).withColumnRenamed("at", "ax").join(
        placed.select("hub", "doc_id", "label", "n", "in_hub", front), ["hub", "s"])
    common = F.least("hx", "in_hub") + F.least(F.col("nx") - F.col("hx") - F.col("ax"), F.col("n") - F.col("in_hub") - F.col("at"))
    apart = apart.where((F.col("lx") != F.col("label")) & (100 * common >= limit * (F.col("nx") + F.col("n") - common))).select(*pair)
    within = odd.where("reach").select("hub", F.col("doc_id").alias("x"), F.col("label").alias("lx"), *mine)
    most = F.least("hx", "in_hub")
    within = within.join(placed.where("reach").select("hub", "doc_id", "label", "n", "in_hub"), "hub").where(
        (F.col("lx") != F.col("label")) & (100 * most >= limit * (F.col("nx") + F.col("n") - most))).select(*pair)
    rest = apart.union(within).distinct()
    sketches = reps.select("doc_id", "sketch")
    near = (rest.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(_screened(sketch_distance_limit()), "a long, b long"))
    more = materialize(_with_texts(materialize(near), texts, "a", "b").mapInArrow(_linked(width, limit), "a long, b long"))

    # later links join whole components
    late = more
    if key_shared := sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        same = filled.join(classes, ["sig_a", "sig_b", "n_shingles"]).where("doc_id <> rep")
        late = late.union(same.select("doc_id", "rep"))  # rows of one doc_id may lie in several classes
    for end in ("a", "b"):
        late = late.join(label.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(
            end, F.coalesce(f"l{end}", end)).drop(f"l{end}")
    upper = components(late).select(F.col("node").alias("first"), F.col("label").alias("upper"))
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "sig_a", "sig_b", "n_shingles", F.coalesce("label", "rep").alias("first")).join(upper, "first", "left").select(
        "sig_a", "sig_b", "n_shingles", F.coalesce("upper", "first").alias("label"))
    out = sets.drop("band", "sketch").join(named, ["sig_a", "sig_b", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "doc_id")))
    if key_shared:
        out = out.drop("component_id").join(out.where("doc_id is not null").groupBy("doc_id").agg(
            F.min("component_id").alias("component_id")), "doc_id", "left")
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


STAGE_WIDTH = 5  # words of a shingle in a filtering stage


def stage(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = STAGE_WIDTH) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each group of texts that share 0.8 of their ``width``-word shingles, with all their columns, whatever these are
    called. Rows that share the kept doc_id and their text are one document: one stays. Unrelated texts of the kept doc_id all stay."""
    free = "_".join([*docs.columns, "kept"])  # a name that no column has
    kept = materialize(near_duplicates(docs, text, key, width=width).where("kept and doc_id is not null").select(F.col("doc_id").alias(free)))
    out = docs.join(kept.distinct(), F.col(key).cast("long") == F.col(free), "left_semi")
    if kept.groupBy(free).count().where("count > 1").limit(1).count():
        out = out.withColumn(free, F.md5(F.col(text).cast("binary"))).dropDuplicates([key, free]).drop(free)
    return out.unionByName(docs.where(F.col(key).isNull()))
