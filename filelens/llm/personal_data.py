"""Personal data: fixed patterns, and weak supervision for spans that no pattern fixes (DataFrame functions only).

Base kinds are found by regular expressions, each leftmost and without overlap. The patterns here say the same as the plain
ones but start only where a match can start and never give back what they took, so long runs cost linear time.

Further candidates are runs of 8 and more key-like characters with a digit, outside base spans. Labelers vote on each (yes, no
or abstain): regular expressions on its shape, gazetteers of key prefixes and of cue words before it, and its context.
Expectation-maximisation over the counts of vote patterns (3^6 at most, the only rows that reach the driver) estimates every
labeler's reliability and each pattern's probability. These are the soft labels of the final span classifier, a naive Bayes model on
shape and context features, trained on sums by feature values (a bounded table). Candidates it accepts are spans of kind ``secret``.

Plan: one pass takes all matches and the lengths between them to a narrow table; positions are running sums of these per
document and kind. Texts are never shuffled by ``find``; ``redact`` joins spans back by two hashes of the text.

Defined cases: a null text is empty; no candidates: no model, base spans only; repeated rows are answered alike; other columns are
ignored (``redact`` keeps them); positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import materialize

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"
# Fixed patterns: what each kind's matches have to satisfy.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MARKS = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATE = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{8,}+"
#: Words that stand before a secret, and beginnings of well-known keys (gazetteers).
CUES = ["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "key", "bearer", "login", "pin", "ssn", "iban", "passport"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xox"]
CONTEXT = 24
ROUNDS = 60


def _luhn(digits: Column) -> Column:
    one = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(one, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.when(kind == "ip", value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"))
            .when(kind == "card", F.length(digits).between(16, 19) & _luhn(digits))
            .when(kind == "phone", F.length(digits).between(8, 15)).otherwise(F.lit(True)))


def _matches(text: str, kind: str) -> Column:
    """Array of (kind, value, gap, before): a match, the characters since the last one, and the end of these."""
    pattern = F.lit(PATTERNS.get(kind, CANDIDATE))
    gaps = F.split(F.col(text), PATTERNS.get(kind, CANDIDATE), -1)
    found = F.transform(F.arrays_zip(F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("v"), F.slice(gaps, 1, F.greatest(
        F.size(gaps) - 1, F.lit(0))).alias("g")), lambda z: F.struct(
            F.lit(kind).alias("kind"), z["v"].alias("value"), F.char_length(z["g"]).alias("gap"), F.right(z["g"], F.lit(CONTEXT)).alias("before")))
    none = F.array().cast("array<struct<kind:string,value:string,gap:int,before:string>>")
    return F.when(F.contains(F.col(text), F.lit(_MARKS[kind])), found).otherwise(none) if kind in _MARKS else found


def matches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Narrow table of all documents: row_id, doc_id, two hashes of the text, and all raw matches."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialize(rows.select("row_id", "doc_id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"),
                                   F.concat(*[_matches("text", k) for k in [*KINDS, SECRET]]).alias("found")))


def _located(table: DataFrame) -> DataFrame:
    """row_id, kind, start, end, value, before of every raw match."""
    rows = table.select("row_id", F.posexplode("found").alias("no", "m")).select("row_id", "no", "m.*")
    order = Window.partitionBy("row_id", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(order)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value")).drop("gap", "no")


def candidates(located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid base spans, and the candidates that overlap none of them."""
    base = located.where(F.col("kind") != SECRET).where(_valid(F.col("kind"), F.col("value")))
    maybe = located.where(F.col("kind") == SECRET)
    # latest end of a base span that starts at or before the candidate, earliest start after it: by order within the text
    both = base.select("row_id", "start", "end", F.lit(0).alias("mine"), F.lit("").alias("value"), F.lit("").alias("before")).unionByName(
        maybe.select("row_id", "start", "end", F.lit(1).alias("mine"), "value", "before"))
    by = Window.partitionBy("row_id").orderBy("start", "mine")
    last = F.max(F.when(F.col("mine") == 0, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.min(F.when(F.col("mine") == 0, F.col("start"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    free = both.withColumns({"last": last, "nxt": nxt}).where(
        (F.col("mine") == 1) & (F.coalesce("last", F.lit(0)) <= F.col("start")) & (F.coalesce("nxt", F.col("end")) >= F.col("end")))
    return base, free.select("row_id", "start", "end", "value", "before")


def _signals(spans: DataFrame) -> DataFrame:
    """Votes (1 yes, 0 no, -1 abstain) and features of each candidate."""
    v, before = F.col("value"), F.lower("before")
    changes = F.length(F.regexp_replace(v, "[A-Za-z][0-9]|[0-9][A-Za-z]", "#")) * -1 + F.length(v)
    digits = F.length(F.regexp_replace(v, "[^0-9]", "")) / F.length(v)
    cue = before.rlike("(?:" + "|".join(CUES) + r")[\s\"'=:]*$")
    lead = F.when(F.right("before", F.lit(1)).isin("=", ":"), "=").when(F.right("before", F.lit(1)).isin('"', "'"), '"').when(
        F.trim("before") == "", "").otherwise("w")
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    return spans.withColumns({
        "v_hex": vote(v.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$") & v.rlike("[A-Fa-f]"), F.length(v) < 10),
        "v_prefix": vote(v.rlike("^(?:" + "|".join(PREFIXES) + ")"), F.lit(False)),
        "v_cue": vote(cue, F.lit(False)),
        "v_context": vote(F.col("before").rlike("[=:]\\s*[\"']?$"), F.col("before").rlike("[A-Za-z,.]\\s+$")),
        "v_mixed": vote(changes >= 3, changes <= 1),
        "v_plain": vote(F.lit(False), v.rlike("^[0-9/-]+$") | v.rlike("^[a-z]+[0-9]{1,4}$")),
        "f_length": F.least(F.floor(F.log2(F.length(v).cast("double"))), F.lit(7)).cast("int"),
        "f_digits": F.floor(digits * 4).cast("int"),
        "f_changes": F.least(changes, F.lit(6)).cast("int"),
        "f_case": F.when(v == F.lower(v), 0).when(v == F.upper(v), 1).otherwise(2),
        "f_lead": lead,
        "f_cue": cue.cast("int"),
    })


_VOTES = ["v_hex", "v_prefix", "v_cue", "v_context", "v_mixed", "v_plain"]
_FEATURES = ["f_length", "f_digits", "f_changes", "f_case", "f_lead", "f_cue"]


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list]:
    """EM over vote patterns and their counts: each pattern's probability of yes, and every labeler's
    probabilities of its votes given no and yes. Starts from the share of yes among the votes cast."""
    p = {}
    for votes in patterns:
        cast = [v for v in votes if v >= 0]
        p[votes] = (sum(cast) + 0.5) / (len(cast) + 1)
    rates: list = []
    for _ in range(rounds):
        yes = sum(n * p[v] for v, n in patterns.items())
        total = sum(patterns.values())
        prior = (yes + 1) / (total + 2)
        rates = []
        for j in range(len(next(iter(patterns)))):
            rate = []
            for side in (0, 1):
                w = {x: 0.1 for x in (-1, 0, 1)}
                for v, n in patterns.items():
                    w[v[j]] += n * (p[v] if side else 1 - p[v])
                rate.append({x: y / sum(w.values()) for x, y in w.items()})
            rates.append(rate)
        for v in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(r[1][x] / r[0][x]) for r, x in zip(rates, v))
            p[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return p, rates


def _choice(keys: dict, column) -> Column:
    """The value of ``keys`` for the column's value, 0 for others."""
    out = F.lit(0.0)
    for k, w in sorted(keys.items(), key=str):
        out = F.when(F.col(column) == F.lit(k), F.lit(float(w))).otherwise(out)
    return out


def classify(spans: DataFrame) -> DataFrame:
    """The candidates with ``probability`` from the span classifier trained on the labelers' aggregate."""
    spans = materialize(_signals(spans))
    counts = spans.groupBy(*_VOTES).count().collect()  # 3^6 patterns at most
    if not counts:
        return spans.withColumn("probability", F.lit(0.0))
    soft, _ = estimate({tuple(r[v] for v in _VOTES): r["count"] for r in counts})
    yes = {}
    for r in spans.groupBy(*_VOTES, *_FEATURES).count().groupBy(*_VOTES, *_FEATURES).agg(F.sum("count").alias("n")).collect():  # bounded
        p = soft[tuple(r[v] for v in _VOTES)]
        for f in _FEATURES:
            cell = yes.setdefault((f, r[f]), [0.0, 0.0])
            cell[0] += r["n"] * (1 - p)
            cell[1] += r["n"] * p
    n = [sum(c[s] for (f, _), c in yes.items() if f == _FEATURES[0]) for s in (0, 1)]
    odds = F.lit(math.log((n[1] + 1) / (n[0] + 1)))
    for f in _FEATURES:
        values = {x: c for (g, x), c in yes.items() if g == f}
        odds = odds + _choice({x: math.log((c[1] + 0.5) / (n[1] + 0.5 * len(values))) - math.log((c[0] + 0.5) / (n[0] + 0.5 * len(values)))
                               for x, c in values.items()}, f)
    return spans.withColumn("probability", 1 / (1 + F.exp(-odds)))


def spans_of(table: DataFrame) -> DataFrame:
    """row_id, kind, start, end of all spans of ``matches``."""
    located = materialize(_located(table))
    base, maybe = candidates(located)
    added = classify(maybe).where("probability >= 0.5").select("row_id", F.lit(SECRET).alias("kind"), "start", "end")
    return base.select("row_id", "kind", "start", "end").unionByName(added)


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: row_id, doc_id, hashes of its text, and ``spans`` (kind, start, end) by kind as listed, then start."""
    table = matches(docs, text, key)
    rank = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, SECRET]]), F.col("kind"))
    spans = spans_of(table).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(
        rank.alias("rank"), "start", "end", "kind"))).alias("spans"))  # one document's spans
    return table.drop("found").join(spans, "row_id", "left").withColumn("spans", F.coalesce("spans", F.slice(F.array(F.struct(
        F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("kind"))), 1, 0)))


def op7(docs: DataFrame) -> DataFrame:
    found = find(docs)

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != SECRET)
    kind_is = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", kind_is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``<kind>`` (overlapping spans by the first one's); same columns."""
    found = find(docs, text, key).where(F.size("spans") > 0).dropDuplicates(["h1", "h2"])
    rows = found.select("h1", "h2", F.explode("spans").alias("s")).select("h1", "h2", "s.*")
    order = Window.partitionBy("h1", "h2").orderBy("start", "rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).withColumn("island", F.sum("fresh").over(order))
    rows = rows.groupBy("h1", "h2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "rank")).alias("kind"))
    cuts = rows.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    clash = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in clash.items()])
    t = F.coalesce(F.col(clash[text]), F.lit(""))
    out = plain.withColumns({"h1": F.xxhash64(t), "h2": F.hash(t)}).join(cuts, ["h1", "h2"], "left")
    last = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.element_at(F.col("cuts"), i.cast("int"))["end"])
    pieces = F.transform("cuts", lambda c, i: F.concat(F.substring(t, (last(i) + 1).cast("int"), (c["start"] - last(i)).cast("int")), F.lit("<"), c["kind"], F.lit(">")))
    end = F.element_at(F.col("cuts"), -1)["end"].cast("int")
    new = F.when(F.col("cuts").isNull(), F.col(clash[text])).otherwise(F.concat(F.array_join(pieces, ""), F.substring(t, end + 1, F.char_length(t))))
    return out.withColumn(clash[text], new).select(*[F.col(n).alias(c) for c, n in clash.items()])


def stage(docs: DataFrame) -> DataFrame:
    """Redacted documents, same columns; ``n_chars`` follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
