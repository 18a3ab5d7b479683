import random
import re

import edge
from filelens.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=4):
    sets = []
    for i, text, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            same = rows[x][0] is not None and rows[x][0] == rows[y][0]
            if same or both and 100 * both >= 80 * len(sets[x] | sets[y]) and None not in (rows[x][0], rows[y][0]):
                parent[root(x)] = root(y)
    low = {}
    for x, r in enumerate(rows):
        if r[0] is not None:
            low[root(x)] = min(low.get(root(x), r[0]), r[0])
    return sorted(((r[0], len(sets[x]), None if r[0] is None else low[root(x)]) for x, r in enumerate(rows)), key=str)


def run(spark, rows):
    out = N.near_duplicates(edge.frame(spark, rows)).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def test_equals_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_chains_and_stars(spark):
    """Copies whose links run only through an original or a chain; members that no hub is linked with."""
    rnd = random.Random(5)
    rows, n = [], 0
    for g in range(12):
        base = [f"g{g}w{rnd.randrange(9999)}" for _ in range(120)]
        for _ in range(14):
            w = list(base)
            if g % 3 == 0:  # star: each copy has edits of its own
                for _ in range(2):
                    w[rnd.randrange(len(w))] = f"e{rnd.random()}"
            elif g % 3 == 1:  # chain: each copy is an edit of the last one
                for _ in range(2):
                    base[rnd.randrange(len(w))] = f"e{rnd.random()}"
            else:  # about the limit
                for _ in range(rnd.randrange(5)):
                    w[rnd.randrange(len(w))] = f"e{rnd.random()}"
            rows.append((n, " ".join(w), "en", "s"))
            n += 1
    rnd.shuffle(rows)
    got, want = run(spark, rows), brute(rows)
    assert len({r[2] for r in want}) > 12 and got == want


def test_cases(spark):
    rows = edge.CASES + [edge.CASES[4], (None, "one two three four five", "en", "s0"), (6, "other text of the same id", "en", "s")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_sketch_estimates_high_similarity():
    import numpy as np
    rnd = random.Random(1)
    pool = [f"w{i}" for i in range(4000)]
    a = [rnd.choice(pool) for _ in range(900)]
    for edits in (0, 5, 20, 45):
        b = list(a)
        for _ in range(edits):
            b[rnd.randrange(900)] = "changed"
        s, t = N.shingles([" ".join(a).encode(), " ".join(b).encode()])
        exact = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
        *_, sketch = N._describe([s, t])
        x, y = (np.frombuffer(v, np.uint8) for v in sketch.to_pylist())
        z = int(np.bitwise_count(x ^ y).sum())
        guess = 1 + N.SKETCH_BITS / (4 * N.K) * np.log(max(1e-9, 1 - 2 * z / N.SKETCH_BITS))
        assert abs(guess - exact) < 0.15
    assert N.sketch_distance_limit(1.0) == 0
