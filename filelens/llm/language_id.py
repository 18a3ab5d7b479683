"""Language ID by words first, with backoff to shorter and shorter character n-grams.

A known word scores its smoothed log frequency in each language. An unseen word is looked up by its n-grams
(with ends marked) of length 5; if none of them is known, of length 4, and so on down to 1; it scores the mean of
those found. A text's language is the one with the highest sum over its words; ``score`` is that
language's posterior under equal priors (summed log likelihoods, softmax).

The classifier is fitted on a bounded sample of each language: rows are counted by language, and those of a language
with more than its share of ``MAX_TRAIN`` documents are thinned by a hash of their id to that share, which is
``LEAST_TRAIN`` at least. A language with fewer rows is learned whole, however large the others are. The model's
size follows the number of languages, not the corpus, and it can be broadcast. Prediction covers every whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a language, an id
or a text aren't learned from; no training rows at all: everything is ``und``; ties go to the first language
in the order of names; other columns are ignored and repeated rows answered alike. Of a text with letters but without any
known n-gram the score is 1 / languages, which says nothing: ``stage`` keeps it.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 6000
LEAST_TRAIN = 100  # of each language, if it has as many
MIN_COUNT = 2
LONGEST = 5
MEMO_WORDS = 300_000
ROWS = 512  # texts taken out of an Arrow batch at a time

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams(word: str, n: int) -> list[str]:
    if n > 1:
        word = f"^{word}$"
    return [word[i:i + n] for i in range(len(word) - n + 1)]


def _counted(batches):
    for batch in batches:
        seen: Counter = Counter()
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in words_of(text):
                seen[lang, w] += 1
        table: Counter = Counter()
        for (lang, w), c in seen.items():
            table[lang, 0, w] += c
            for n in range(1, LONGEST + 1):
                for g in grams(w, n):
                    table[lang, n, g] += c
        keys = list(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.string()), pa.array(list(table.values()), pa.int64())],
            names=["lang", "kind", "gram", "n"])


def _gram_hash(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"))


class Model:
    """Log frequencies by gram kind (0: words; 1 to LONGEST: n-grams) and language. Grams are held as sorted 64-bit hashes, so that a worker needs a
    few bytes for each."""

    def __init__(self, counts):
        """counts: rows (lang, kind, gram, n)."""
        self.langs = sorted({r[0] for r in counts})
        at = {x: i for i, x in enumerate(self.langs)}
        self.rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]  # the grams themselves stay on the driver
        rows = self.rows
        for _, kind, gram, _ in counts:
            rows[kind].setdefault(gram, len(rows[kind]))
        self.keys, self.logs = [], []
        for kind in range(LONGEST + 1):
            table = np.zeros((len(rows[kind]), len(self.langs)))
            for lang, k, gram, n in counts:
                if k == kind:
                    table[rows[kind][gram], at[lang]] += n
            table = (table + 0.5) / (table.sum(axis=0) + 0.5 * (len(table) + 1))
            keys = np.fromiter(map(_gram_hash, rows[kind]), dtype=np.uint64, count=len(rows[kind]))
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.logs.append(np.log(table).astype(np.float32)[order])
        self.memo: dict[str, int] = {}
        self.known = np.zeros((1024, len(self.langs)), dtype=np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "known", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state, memo={}, known=np.zeros((1024, len(state["langs"])), dtype=np.float32))

    def _look(self, kind: int, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each gram, and which of them are known."""
        keys = self.keys[kind]
        if not len(keys):
            return np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=bool)
        h = np.fromiter(map(_gram_hash, found), dtype=np.uint64, count=len(found))
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return i, keys[i] == h

    def scores_of(self, words: list[str]) -> np.ndarray:
        """Scores of many words, looked up together: known words first, the others by their longest known grams."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        row, ok = self._look(0, words)
        out[ok] = self.logs[0][row[ok]]
        left = np.flatnonzero(~ok)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            lists = [grams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
            row, ok = self._look(n, list(itertools.chain.from_iterable(lists)))
            owner, logs = owner[ok], self.logs[n][row[ok]]
            times = np.bincount(owner, minlength=len(left))
            hit = times > 0
            for j in range(len(self.langs)):
                out[left[hit], j] = (np.bincount(owner, weights=logs[:, j], minlength=len(left))[hit] / times[hit])
            left = left[~hit]
        return out

    def word_scores(self, word: str) -> np.ndarray:
        return self.scores_of([word])[0]

    def _learn(self, words: list[str]) -> None:
        """Adds new words to the memo."""
        at, stop = len(self.memo), len(self.memo) + len(words)
        while stop > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[at:stop] = self.scores_of(words)
        self.memo.update(zip(words, range(at, stop)))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its posterior, and whether these rest on the text: it has known grams, or no letter at all."""
        words = words_of(text or "")
        letters = has_letter(words)
        if not self.langs or not letters:
            return "und", 0.0, not letters
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if new := list(dict.fromkeys(w for w in words if w not in self.memo)):
            self._learn(new)
        rows = list(map(self.memo.__getitem__, words))
        total = self.known.take(rows, axis=0).sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum()), bool(total.any())


def quota(sizes: list[int], max_train: int, least: int) -> int:
    """Rows to take of each language: as many as let all together be ``max_train`` at most, but not below ``least``."""
    left, most = max_train, 0
    for k, n in enumerate(sorted(sizes)):
        most = left // (len(sizes) - k)
        if n > most:
            break
        left, most = left - n, n
    return max(least, most)


def fit(rows: DataFrame, max_train: int = MAX_TRAIN, min_count: int = MIN_COUNT, least: int = LEAST_TRAIN) -> Model:
    """rows: doc_id, text, lang of the training documents, of which about ``quota`` of each language are used."""
    rows = rows.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    most = quota(list(sizes.values()), max_train, least)
    limits = [(lang, int(min(1.0, most / n) * (1 << 30))) for lang, n in sorted(sizes.items())]
    limits = rows.sparkSession.createDataFrame(limits, "lang string, below long")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30))
    picked = rows.join(F.broadcast(limits), "lang").where(place < F.col("below"))
    counts = (picked.select("text", "lang").mapInArrow(_counted, "lang string, kind int, gram string, n long")
              .groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))
    held = counts.groupBy("kind", "gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    held = held.where(F.col("total") >= min_count).orderBy("kind", "gram").toArrow()  # bounded by the sample
    out = []
    for kind, gram, by in zip(held["kind"].to_pylist(), held["gram"].to_pylist(), held["by"].to_pylist()):
        out += [(x["lang"], kind, gram, x["n"]) for x in by]
    return Model(out)


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score`` and ``judged`` (as ``Model.predict`` says) in the place of the text, or with
    ``keep_text`` after it. A text passes to Python once, and back at most once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score", "judged")]
    kept = [text, *rest] if keep_text else rest
    from pyspark.sql import types as T
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("judged", T.BooleanType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            got = [model.predict(t) for lo in range(0, batch.num_rows, ROWS) for t in batch.column(0).slice(lo, ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[0 if keep_text else 1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=[*kept, "lang_pred", "score", "judged"])

    return docs.select(text, *rest).mapInArrow(run, schema)


def remainder(key, of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)) % of


def op6(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    rows = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def stage(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Takes out texts without letters, and those whose known n-grams leave the language open (a posterior below ``least_score``).
    A text that the model knows nothing of stays: nothing speaks against it. All columns stay."""
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    out = predict(rows, model, names["text"], keep_text=True).where(~F.col("judged") | ((F.col("lang_pred") != "und") & (F.col("score") >= least_score)))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
