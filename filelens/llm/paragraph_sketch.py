"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests (DataFrame functions only).

A text's paragraphs are its lines, cut further after sentence ends; each distinct one is a 64-bit digest. The fingerprint
is a table of CELLS cells: a digest is added to one cell of each of HASHES regions, and a cell keeps a count, the XOR
of its digests and the XOR of their checks. Subtracting two tables cancels what both texts share. What is left is peeled: a
cell with a single digest gives that digest, which is taken out of its other cells, until nothing remains; then the
differing digests of both sides are known exactly, and likeness is 2 x common / (all of both sides). If peeling gets stuck, the
pair is sketched again, larger: independent parts of PART_CELLS cells with about ``PART_LOAD`` digests each; a part that gets stuck is
sketched once more in RETRY_CELLS cells with new hashes; and pairs with a part that is still stuck go on to more and new parts.

Plan: a document's neighbour needs only its first characters and digests, so texts pass one shuffle, on the id, written once for both
joins, and these another.
Sketches, their difference and the peeling are expressions on a row's digest arrays: no row is multiplied and nothing is shuffled for
them. Parts have a bounded size, so a long text is many small parts. Only rows with a stuck side are read again.

Defined cases: a null text is empty; two texts without paragraphs are alike (1); the next of the last document is the first,
a single document is its own next; ids sort with nulls first, then by a text hash. Identical rows stand for one document in that
order and are answered once each; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import materialize
from ..operators.ranking import rank_within

HASHES, CELLS = 4, 16
PART_CELLS, PART_LOAD, RETRY_CELLS = 16, 7, 48
ROUNDS = 8  # of peeling; a table that needs more counts as stuck
_CUT = r"\n+|(?<=[.!?])\x20+"
_KEY = ["k", "th"]
_STATE = [("left", "array<struct<cell:int,n:bigint,x:bigint,y:bigint>>"), ("plus", "array<bigint>"), ("minus", "array<bigint>")]


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    parts = F.filter(F.split(text, _CUT), lambda x: F.length(F.trim(x)) > 0)
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x)))


def _places(u, cells: int, salt: int) -> Column:
    """A digest's cell in each region, as bits of a number."""
    region, h = cells // HASHES, F.xxhash64(u, F.lit(salt))
    bits = [F.call_function("shiftleft", F.lit(1 << r * region).cast("bigint"), F.pmod(
        F.shiftrightunsigned(h, 16 * r).bitwiseAND(F.lit(0xFFFF)), F.lit(region)).cast("int")) for r in range(HASHES)]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)


def _check(u) -> Column:
    return F.xxhash64(u, F.lit("check"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _filled(c: Column) -> Column:
    return (c["n"] != 0) | (c["x"] != 0) | (c["y"] != 0)


def _lies_in(i: Column, c: Column) -> Column:
    return F.getbit(i["at"], c) == 1


def _cell(items: Column, c: Column) -> Column:
    """One cell of an array of (u, sign, c, at)."""
    zero = F.lit(0).cast("bigint")
    return _let(F.filter(items, lambda i: _lies_in(i, c)), lambda mine: F.struct(
        c.alias("cell"), F.aggregate(mine, zero, lambda a, i: a + i["sign"]).alias("n"),
        F.aggregate(mine, zero, lambda a, i: a.bitwiseXOR(i["u"])).alias("x"),
        F.aggregate(mine, zero, lambda a, i: a.bitwiseXOR(i["c"])).alias("y")))


def _table(items: Column, size: int, salt: int) -> Column:
    """All cells (cell, n, x, y) of an array of (u, sign)."""
    placed = F.transform(items, lambda i: F.struct(i["u"].alias("u"), i["sign"].alias("sign"), _check(i["u"]).alias("c"),
                                                   _places(i["u"], size, salt).alias("at")))
    return _let(placed, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: _cell(all_, c)))


def sketch(units: Column) -> Column:
    """The table that is a text's fingerprint."""
    return _table(_signed(units, 1), CELLS, 0)


def _subtract(a: Column, b: Column) -> Column:
    """Table of the difference: what both hold cancels."""
    return F.zip_with(a, b, lambda p, q: F.struct(p["cell"].alias("cell"), (p["n"] - q["n"]).alias("n"),
                                                  p["x"].bitwiseXOR(q["x"]).alias("x"), p["y"].bitwiseXOR(q["y"]).alias("y")))


def _peel(cells: Column, size: int, salt: int) -> Column:
    """Peels a table; gives (left, plus, minus): unresolved cells and the digests found by side."""

    def pure(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (_check(c["x"]) == c["y"])

    def without(c: Column, found: Column) -> Column:
        """The cell after the found digests that lie in it are taken out."""
        return _let(F.filter(found, lambda p: _lies_in(p, c["cell"])), lambda mine: F.when(F.size(mine) == 0, c).otherwise(
            F.struct(c["cell"].alias("cell"),
                     F.aggregate(mine, c["n"], lambda a, p: a - p["n"]).alias("n"),
                     F.aggregate(mine, c["x"], lambda a, p: a.bitwiseXOR(p["x"])).alias("x"),
                     F.aggregate(mine, c["y"], lambda a, p: a.bitwiseXOR(p["y"])).alias("y"))))

    def named(x: Column, n: int) -> Column:
        return F.transform(x, lambda u: F.struct(u.alias("x"), F.lit(n).cast("bigint").alias("n"), _check(u).alias("y"),
                                                 _places(u, size, salt).alias("at")))

    def digests(p: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(p, lambda c: c["n"] == n), lambda c: c["x"]))

    def taken(state: Column, f: Column) -> Column:
        return _let(F.concat(named(f["plus"], 1), named(f["minus"], -1)), lambda found: F.struct(
            F.filter(F.transform(state["left"], lambda c: without(c, found)), _filled).alias("left"),
            F.concat(state["plus"], f["plus"]).alias("plus"), F.concat(state["minus"], f["minus"]).alias("minus")))

    def step(state: Column, _: Column) -> Column:
        return _let(F.filter(state["left"], pure), lambda p: F.when(F.size(p) == 0, state).otherwise(_let(
            F.struct(digests(p, 1).alias("plus"), digests(p, -1).alias("minus")), lambda f: taken(state, f))))

    none = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)),
                       F.struct(F.filter(cells, _filled).alias("left"), none.alias("plus"), none.alias("minus")), step)


def _signed(units: Column, sign: int) -> Column:
    return F.transform(units, lambda u: F.struct(u.alias("u"), F.lit(sign).alias("sign")))


def _outcome(r: Column) -> Column:
    return F.struct((F.size(r["left"]) > 0).alias("stuck"), r["plus"].alias("plus"), r["minus"].alias("minus"))


def _part(items: Column, n: int) -> Column:
    """A part's digests, in a small table or, when that is stuck, in a larger one."""
    return _let(_peel(_table(items, PART_CELLS, n), PART_CELLS, n), lambda r: F.when(F.size(r["left"]) == 0, r).otherwise(
        _peel(_table(items, RETRY_CELLS, -n), RETRY_CELLS, -n)))


def attempt(a: Column, b: Column, n: int) -> Column:
    """(stuck, plus, minus) of the difference of two digest arrays in parts, at the n-th size (from 1)."""
    load = max(2, PART_LOAD >> (n - 1))
    parts = F.greatest(F.ceil((F.size(a) + F.size(b)) / load).cast("int"), F.lit(1))
    width = F.ceil(F.sqrt(parts)).cast("int")  # parts are found by way of groups of so many: linear times a root

    def numbered(u: Column, sign: int) -> Column:
        return F.transform(u, lambda x: _let(F.pmod(F.xxhash64(x, F.lit(f"part{n}")), parts).cast("int"), lambda part: F.struct(
            x.alias("u"), F.lit(sign).alias("sign"), F.floor(part / width).cast("int").alias("group"), F.pmod(part, width).alias("place"))))

    def part(items: Column) -> Column:
        return F.when(F.size(items) == 0, F.struct(*[F.array().cast(t).alias(c) for c, t in _STATE])).otherwise(_part(items, n))

    def group(all_: Column, g: Column) -> Column:
        return _let(F.filter(all_, lambda i: i["group"] == g), lambda own: F.transform(
            F.sequence(F.lit(0), width - 1), lambda q: _let(F.filter(own, lambda i: i["place"] == q), part)))

    found = _let(F.concat(numbered(a, 1), numbered(b, -1)), lambda all_: F.flatten(F.transform(
        F.sequence(F.lit(0), width - 1), lambda g: group(all_, g))))
    return _let(found, lambda r: F.struct(
        F.exists(r, lambda x: F.size(x["left"]) > 0).alias("stuck"), F.flatten(F.transform(r, lambda x: x["plus"])).alias("plus"),
        F.flatten(F.transform(r, lambda x: x["minus"])).alias("minus")))


def by_tables(table_a: Column, table_b: Column) -> Column:
    """(stuck, plus, minus) of the difference by the fingerprints' tables alone."""
    return _let(_peel(_subtract(table_a, table_b), CELLS, 0), _outcome)


def by_parts(first: Column, a: Column, b: Column) -> Column:
    """That, or where it is stuck the first attempt by parts."""
    return F.when(first["stuck"], attempt(a, b, 1)).otherwise(first)


def differing(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of pairs (keys, a, b: digest arrays) the decoded difference: keys, plus (only in a), minus (only in b)."""
    pairs = pairs.withColumn("ta", sketch(F.col("a"))).withColumn("tb", sketch(F.col("b")))
    pairs = pairs.withColumn("r0", by_tables(F.col("ta"), F.col("tb")))
    got = materialize(pairs.select(*keys, "a", "b", by_parts(F.col("r0"), F.col("a"), F.col("b")).alias("r")))
    done, n = got.where("not r.stuck").select(*keys, "r.plus", "r.minus"), 2
    while got.where("r.stuck").limit(1).count():
        got = materialize(got.where("r.stuck").select(*keys, "a", "b", attempt(F.col("a"), F.col("b"), n).alias("r")))
        done, n = done.unionByName(got.where("not r.stuck").select(*keys, "r.plus", "r.minus")), n + 1
    return done


def fingerprint(table: Column) -> Column:
    """A sketch as text: its filled cells in order; '' for no paragraphs."""
    return F.array_join(F.transform(F.filter(table, _filled), lambda c: F.concat_ws(
        ".", F.lpad(F.hex(c["cell"]), 2, "0"), F.hex(c["n"]), F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["y"]), 16, "0"))), " ")


def likeness(size_a: Column, size_b: Column, n_differing: Column) -> Column:
    both = size_a + size_b
    return F.when(both == 0, F.lit(1.0)).otherwise((both - n_differing) / both)


def op9(docs: DataFrame) -> DataFrame:
    """Each document, its edited text (last quarter replaced by the beginning of the next document) and its likeness to both."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"k": F.coalesce("doc_id", F.lit(0)), "th": F.xxhash64("text", F.col("doc_id").isNull())})
    ids = base.groupBy("doc_id", *_KEY).agg(F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranked = materialize(rank_within(ids, [], ["doc_id", "th"], out="place"))
    total, rows = ranked.agg(F.count(F.lit(1)), F.sum("copies")).first()
    # to each document: who stands before it, and how many of its characters that one takes
    before = ranked.select(((F.col("place") + 1) % F.lit(max(total, 1))).alias("place"), F.col("doc_id").alias("prev_id"),
                           F.col("k").alias("prev_k"), F.col("th").alias("prev_th"), F.floor(F.col("n_chars") / 4).cast("int").alias("take"))
    asks = ranked.select("place", *_KEY).join(before, "place").drop("place")
    texts = base.select("text", *_KEY)  # the same columns for both joins, so that their exchange is written once
    gives = texts.join(asks.hint("merge"), _KEY).select(
        F.col("prev_id").alias("doc_id"), F.col("prev_k").alias("k"), F.col("prev_th").alias("th"),
        F.substring("text", F.lit(1), F.col("take")).alias("head"), paragraphs(F.col("text")).alias("next_units"))
    if rows != total:  # identical rows: one of them gives its head
        gives = gives.dropDuplicates(_KEY)
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head"))
    state = texts.join(gives.hint("merge"), _KEY).select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("units"), paragraphs(edited).alias("edited_units"), "next_units")
    sides = {"edited": "edited_units", "next": "next_units"}
    kept = [f"r_{s}" for s in sides]
    stuck = F.col("r_edited.stuck") | F.col("r_next.stuck")
    state = state.withColumns({f"t_{u}": sketch(F.col(u)) for u in ["units", *sides.values()]})
    state = state.withColumns({f"r0_{s}": by_tables(F.col("t_units"), F.col(f"t_{u}")) for s, u in sides.items()})
    state = state.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("t_units")).alias("fingerprint"),
                         fingerprint(F.col("t_edited_units")).alias("edited_fingerprint"), "units", *sides.values(),
                         *[by_parts(F.col(f"r0_{s}"), F.col("units"), F.col(u)).alias(f"r_{s}") for s, u in sides.items()])
    # digests are kept of rows that go on; the others need only their numbers
    state = state.withColumns({f"n_{u}": F.size(u) for u in ["units", *sides.values()]})
    slim = [F.struct(F.col(r).getField("stuck").alias("stuck"), (F.size(F.col(r).getField("plus")) + F.size(F.col(r).getField("minus"))).alias("d"))
            .alias(r) for r in kept]
    names = [c for c in state.columns if c not in kept]
    digests = ["units", *sides.values()]
    state = materialize(state.select(*[F.when(stuck, F.col(c)).alias(c) if c in digests else c for c in names], *slim))
    done, n_attempt = state.where(~stuck).drop(*digests), 2
    left = state.where(stuck)
    while left.limit(1).count():
        again = [F.when(F.col(f"r_{s}.stuck"), _let(attempt(F.col("units"), F.col(u), n_attempt), lambda r: F.struct(
            r["stuck"].alias("stuck"), (F.size(r["plus"]) + F.size(r["minus"])).alias("d")))).otherwise(F.col(f"r_{s}")).alias(f"r_{s}")
            for s, u in sides.items()]
        state = materialize(left.select(*names, *again))
        done, left, n_attempt = done.unionByName(state.where(~stuck).drop(*digests)), state.where(stuck), n_attempt + 1
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("n_units"), F.col("n_edited_units"), F.col("r_edited.d")).alias("near_edited"),
                       likeness(F.col("n_units"), F.col("n_next_units"), F.col("r_next.d")).alias("near_next"))
