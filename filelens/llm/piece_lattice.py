"""SentencePiece encoding and decoding by N-best search over the piece lattice.

A text is its characters with spaces as U+2581; edges are the pieces of the vocabulary, and for a character that no piece is,
its UTF-8 bytes as byte pieces. A forward Viterbi pass gives every position's best score from the start; a backward A* search
from the end uses these scores as exact heuristics, so it pops segmentations in order of their scores and touches only what
the N best need. Merge-rank vocabularies carry no probabilities; a piece of rank r scores as Zipf's law has it, log(1 / (r + 2.7)).

No piece crosses certain places (checked from the pieces' own character pairs), so a text is cut there and each distinct cut is searched
once per worker (bounded memo). Forward and backward Viterbi scores of many cuts are computed together, position by position; they give each
cut's best segmentation, and its loss by the second best one: the best score through an edge outside the best path. The N best of a text are the
N best sums over its cuts, and only the N - 1 cuts with the smallest losses can differ from their best: A* searches those.

Decoding joins the pieces' bytes; it gives back every text exactly: a U+2581 of the text itself goes as byte pieces, nothing
is normalised, and no space is put in front.

Defined cases: a null text is empty: no pieces, one segmentation with score 0; white space alone, control characters and any
length are encoded like other text; other columns are ignored and repeated rows answered alike.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES

N_BEST = 3
MEMO_CUTS = 500_000
MEMO_SEARCHES = 50_000
LEARN_CUTS = 20_000
TOGETHER = 64  # longer cuts are searched one by one
_CUT = re.compile("▁*[^▁\n]+|▁+|\n")
_STEP = 0x9E3779B97F4A7C15
_OWN = "\ud800"  # stands for a U+2581 of the text itself; no text holds a lone surrogate, no piece either


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.cache
def surfaces(path: str) -> list[bytes]:
    """The bytes of every piece: all that decoding needs."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        hidden = sp.is_control(i) or sp.is_unknown(i)
        out.append(bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if hidden else p.replace("▁", " ").encode())
    return out


def joined(surface: list[bytes], ids) -> str:
    return b"".join(map(surface.__getitem__, ids)).decode("utf-8")


class Lattice:
    def __init__(self, path: str, n_best: int = N_BEST):
        if n_best < 2:
            raise ValueError("n_best is 2 at least")
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids: dict[int, int] = {}
        self.surface = surfaces(path)
        order = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                order.append((-sp.get_score(i), i, p))
        for rank, (_, i, p) in enumerate(sorted(order)):
            self.pieces[p] = (i, -math.log(rank + 2.7))
        # every beginning of a piece, so that a search ends where no piece goes on
        self.starts: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.starts.update(self.pieces)
        self.byte_score = -math.log(len(order) + 2.7) - 1
        self.pairs = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        if any(b == "▁" != a or "\n" in (a, b) for a, b in self.pairs):
            raise ValueError("this vocabulary has pieces across words")
        self.searched: dict[str, list] = {}
        self.memo: dict[str, int] = {}
        self.best: list[bytes] = []
        self.scores = np.empty((1024, 2))  # best score, and loss by the second best
        # tables for many cuts at once: which characters are pieces; beginnings of pieces by length, hashed
        self.single = np.zeros(0x110000, dtype=bool)
        self.single[[ord(p) for p in self.pieces if len(p) == 1]] = True
        by_length: dict[int, list] = {}
        for p in self.starts:
            h = 0
            for c in p:
                h = (h * _STEP + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            by_length.setdefault(len(p), []).append((h, *(self.starts[p] or (-1, 0.0))))
        self.tables = []
        for k in sorted(by_length):
            rows = sorted(by_length[k])
            self.tables.append((np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))

    def _edges(self, s: str) -> list[list[tuple]]:
        """By end position: (start, id or ids, score)."""
        out: list[list] = [[] for _ in range(len(s) + 1)]
        starts = self.starts
        n = len(s)
        for i in range(n):
            j = i + 1
            while j <= n:
                sub = s[i:j]
                if sub not in starts:
                    break
                p = starts[sub]
                if p is not None:
                    out[j].append((i, p[0], p[1]))
                j += 1
            if self.pieces.get(s[i]) is None:
                raw = b"\xe2\x96\x81" if s[i] == _OWN else s[i].encode()
                out[i + 1].append((i, tuple(self.byte_ids[b] for b in raw), self.byte_score * len(raw)))
        return out

    def _search(self, s: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations of one stretch that pieces do not cross."""
        edges = self._edges(s)
        n = len(s)
        front = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best = -math.inf
            for i, _, w in edges[j]:
                w += front[i]
                if w > best:
                    best = w
            front[j] = best
        found, tie = [], 0
        heap = [(-front[n], 0, n, 0.0, None)]
        push, pop = heapq.heappush, heapq.heappop
        while heap and len(found) < self.n_best:
            _, _, j, done, tail = pop(heap)
            if j == 0:
                ids: list[int] = []
                while tail is not None:
                    if isinstance(tail[0], int):
                        ids.append(tail[0])
                    else:
                        ids += tail[0]
                    tail = tail[1]
                found.append((done, tuple(ids)))
                continue
            for i, ids_, w in edges[j]:
                tie += 1
                push(heap, (-(front[i] + w + done), tie, i, w + done, (ids_, tail)))
        return found

    def _stretches(self, s: str) -> list[str]:
        cut = [0, *(k for k in range(1, len(s)) if s[k - 1:k + 1] not in self.pairs), len(s)]
        return [s[a:b] for a, b in zip(cut, cut[1:])]

    def _combine(self, parts: list[list[tuple[float, tuple[int, ...]]]]) -> list[tuple[float, tuple[int, ...]]]:
        if len(parts) == 1:
            return parts[0]
        out = [(0.0, ())]
        for part in parts:
            both = [(a + b, x + y) for a, x in out for b, y in part] if len(out) * len(part) > 1 else [
                (out[0][0] + part[0][0], out[0][1] + part[0][1])]
            out = heapq.nlargest(self.n_best, both, key=lambda t: t[0]) if len(both) > 1 else both
        return out

    def search(self, s: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best (score, ids) of a prepared string, best first."""
        if len(s) < 64:
            return self._combine([self._search(x) for x in self._stretches(s)])
        out: list = [(0.0, [])]  # a long run: append to lists, with ties to few alternatives
        best_ids: list[int] = []
        score, losses = 0.0, []
        for x in self._stretches(s):
            got = self._search(x)
            losses += [(got[0][0] - g[0], len(best_ids), len(got[0][1]), g[1]) for g in got[1:]]
            best_ids += got[0][1]
            score += got[0][0]
        out = [(score, tuple(best_ids))]
        for loss, swaps in swaps_by_loss([(x[0], x[1], x) for x in losses], self.n_best):
            ids: list[int] = []
            at = 0
            for _, _, (_, place, size, other) in sorted(swaps, key=lambda t: t[1]):
                ids += best_ids[at:place] + list(other)
                at = place + size
            out.append((score - loss, tuple(ids + best_ids[at:])))
        return out

    def _viterbi(self, cuts: list[str], flat: np.ndarray, length: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Best ids, and (best score, loss by the second best), of many cuts at once. Every character is a piece."""
        n = len(cuts)
        begin = np.cumsum(length) - length
        cut = np.repeat(np.arange(n), length)
        stop = np.repeat(begin + length, length)
        # edges: beginnings of pieces are followed from every character as long as some piece goes on
        found = []
        alive, h = np.arange(len(flat)), np.zeros(len(flat), dtype=np.uint64)
        code = flat.astype(np.uint64) + np.uint64(1)
        for k, (hashes, ids, scores) in enumerate(self.tables, 1):
            inside = alive + k <= stop[alive]
            alive, h = alive[inside], h[inside]
            if not len(alive):
                break
            h = h * np.uint64(_STEP) + code[alive + (k - 1)]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            alive, h, at = alive[hit], h[hit], at[hit]
            piece = ids[at] >= 0
            found.append((alive[piece], np.full(int(piece.sum()), k), ids[at[piece]], scores[at[piece]]))
        char, size, ids, w = (np.concatenate(x) for x in zip(*found))
        node = char + cut[char]  # a cut of m characters has m + 1 nodes
        place = char - begin[cut[char]]
        first, last = begin + np.arange(n), begin + length + np.arange(n)

        order = np.lexsort((place, node + size, place + size))
        source, target, ids, w, of = node[order], (node + size)[order], ids[order], w[order], cut[char[order]]
        front = np.full(len(flat) + n, -np.inf)
        front[first] = 0
        into = np.zeros(len(front), dtype=np.int64)
        bounds = np.searchsorted((place + size)[order], np.arange(1, int(length.max()) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            got = front[source[a:b]] + w[a:b]
            head = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            most = np.maximum.reduceat(got, head)
            front[target[a:b][head]] = most
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, b - a)))
            top = np.flatnonzero(got == most[group])
            top = top[np.diff(group[top], prepend=-1) != 0]  # of equals the one that starts first
            into[target[a:b][head]] = a + top
        back = np.full(len(front), -np.inf)
        back[last] = 0
        turn = np.lexsort((source, (place)[order]))
        bounds = np.searchsorted(place[order][turn], np.arange(int(length.max()) + 1))
        for a, b in reversed(list(zip(bounds[:-1], bounds[1:]))):
            e = turn[a:b]
            head = np.flatnonzero(np.diff(source[e], prepend=-1))
            back[source[e][head]] = np.maximum.reduceat(w[e] + back[target[e]], head)

        at, going, path = last.copy(), np.arange(n), []
        while len(going):
            e = into[at[going]]
            path.append((going, e))
            at[going] = source[e]
            going = going[at[going] != first[going]]
        step = np.repeat(np.arange(len(path)), [len(p[0]) for p in path])
        owner, edge = np.concatenate([p[0] for p in path]), np.concatenate([p[1] for p in path])
        forward = np.lexsort((-step, owner))
        raw = ids[edge[forward]].astype("<i4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=n))
        through = front[source] + w + back[target]
        through[edge] = -np.inf
        second = np.full(n, -np.inf)
        np.maximum.at(second, of, through)
        best = front[last]
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], np.stack([best, np.maximum(best - second, 0)], axis=1)

    def _learn(self, cuts: list[str]) -> None:
        """Adds cuts to the memo."""
        flat = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        length = np.array([len(c) for c in cuts])
        odd = np.maximum.reduceat(~self.single[flat], np.cumsum(length) - length) | (length > TOGETHER)
        alone = [c for c, x in zip(cuts, odd.tolist()) if x]
        got = [self._n_best(c) for c in alone]
        best = [array("i", g[0][1]).tobytes() for g in got]
        scores = np.array([[g[0][0], g[0][0] - g[1][0] if len(g) > 1 else np.inf] for g in got]).reshape(-1, 2)
        if len(alone) < len(cuts):
            rest = [c for c, x in zip(cuts, odd.tolist()) if not x]
            more, figures = self._viterbi(rest, flat[~np.repeat(odd, length)], length[~odd])
            alone, best, scores = alone + rest, best + more, np.concatenate([scores, figures])
        at = len(self.best)
        self.memo.update(zip(alone, range(at, at + len(alone))))
        self.best += best
        if len(self.best) > len(self.scores):
            self.scores = np.concatenate([self.scores[:at], np.empty((2 * len(self.best) - at, 2))])
        self.scores[at:len(self.best)] = scores

    def _n_best(self, s: str) -> list[tuple[float, tuple[int, ...]]]:
        """A* result of a cut, remembered."""
        if s not in self.searched:
            if len(self.searched) > MEMO_SEARCHES:
                self.searched.clear()
            self.searched[s] = self.search(s)
        return self.searched[s]

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, list[float], list[bytes]]]:
        """Of each text the ids of the best segmentation (little-endian 32-bit), the scores of the N best, and the ids of the others."""
        if len(self.memo) > MEMO_CUTS:  # rows are numbered in order: what came first is the most frequent part
            self.memo = dict(itertools.islice(self.memo.items(), MEMO_CUTS // 2))
            del self.best[MEMO_CUTS // 2:]
        cuts = [_CUT.findall(prepared(t)) for t in texts]
        missing = list(set(itertools.chain.from_iterable(cuts)) - self.memo.keys())
        for i in range(0, len(missing), LEARN_CUTS):
            self._learn(missing[i:i + LEARN_CUTS])
        return [self._summed(c) for c in cuts]

    def _summed(self, cuts: list[str]) -> tuple[bytes, list[float], list[bytes]]:
        rows = list(map(self.memo.__getitem__, cuts))
        scores = self.scores.take(np.array(rows, dtype=np.int64), axis=0)
        best, loss = float(scores[:, 0].sum()), scores[:, 1]
        n = self.n_best
        near = np.argpartition(loss, n - 2)[:n - 1].tolist() if len(rows) >= n else range(len(rows))
        parts = list(map(self.best.__getitem__, rows))
        choices = []
        for k in near:
            if np.isfinite(loss[k]):
                got = self._n_best(cuts[k])
                other = [(got[0][0] - g[0], k, array("i", g[1]).tobytes()) for g in got]
                choices += [c for c in other if c[2] != parts[k]][:n - 1]  # of equals, the best kept may be another one
        swaps = swaps_by_loss(choices, n)
        return b"".join(parts), [best, *(best - x for x, _ in swaps)], [_swapped(parts, changed) for _, changed in swaps]

    def encode(self, text: str) -> tuple[bytes, list[float]]:
        return self.encode_many([text])[0][:2]

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best (score, ids) of a text, best first."""
        best, scores, others = self.encode_many([text])[0]
        return [(x, np.frombuffer(ids, dtype="<i4").tolist()) for x, ids in zip(scores, [best, *others])]

    def decode(self, ids) -> str:
        return joined(self.surface, ids)


def prepared(text: str) -> str:
    return text.replace("\u2581", _OWN).replace(" ", "\u2581")


def _swapped(parts: list[bytes], changed: list[tuple]) -> bytes:
    """A segmentation that differs from the best one in a few cuts."""
    out = parts.copy()
    for _, k, ids in changed:
        out[k] = ids
    return b"".join(out)


def _lists(raws: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in raws)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), dtype=np.int32)))


def swaps_by_loss(choices: list[tuple], n: int) -> list[tuple[float, list]]:
    """The n - 1 cheapest non-empty sets of choices (loss, place, ...), at most one of each place, with their losses."""
    places: dict[int, list] = {}
    for c in choices:
        places.setdefault(c[1], []).append(c)
    few = heapq.nsmallest(n - 1, places.values(), key=lambda v: min(c[0] for c in v))
    sums: list[tuple[float, list]] = [(0.0, [])]
    for v in few:
        sums = heapq.nsmallest(n, [(a + b[0], [*x, b]) for a, x in sums for b in v] + sums, key=lambda t: t[0])
    return sorted((s for s in sums if s[1]), key=lambda t: t[0])[:n - 1]


@functools.cache
def lattice(path: str, n_best: int) -> Lattice:
    return Lattice(path, n_best)


def _encoded(path: str, n_best: int, decoded: bool):
    def run(batches):
        lat = lattice(path, n_best)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, total = start, 0
                while stop < len(texts) and (stop == start or total < CHUNK_BYTES):
                    total += len(texts[stop] or "")
                    stop += 1
                got = lat.encode_many([t or "" for t in texts[start:stop]])
                others = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(g[2]) for g in got)]).astype(np.int32)), _lists([x for g in got for x in g[2]]))
                cols = [*(c.slice(start, stop - start) for c in batch.columns), _lists([g[0] for g in got]),
                        pa.array([g[1] for g in got], pa.list_(pa.float64())), others]
                if decoded:
                    back = [joined(lat.surface, np.frombuffer(g[0], dtype=np.int32).tolist()) for g in got]
                    cols.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "ids", "scores", "others", "decoded"][:len(cols)])
                start = stop
    return run


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, n_best: int = N_BEST,
           decoded: bool = False) -> DataFrame:
    """doc_id, text, ids (best segmentation), scores (of the N best), others (ids of the second to the N-th best), and with ``decoded`` the text of the ids, decoded in the same pass
    (one Python worker a core, not two)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoded(vocabulary or vocabulary_path(), n_best, decoded),
                           "doc_id long, text string, ids array<int>, scores array<double>, others array<array<int>>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        surface = surfaces(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            back = [joined(surface, values[i:j].tolist()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql import types as T
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def op8(docs: DataFrame) -> DataFrame:
    out = encode(docs, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"),
                      F.round(F.element_at("scores", 1), 6).alias("score"),
                      F.round(F.try_element_at("scores", F.lit(2)), 6).alias("second_score"),
                      F.size("scores").alias("n_best"), F.xxhash64("ids").alias("ids_hash"),
                      F.xxhash64("others").alias("others_hash"),
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
