import hashlib
import random

import edge
import pytest
from filelens.llm import repeated_bytes as R


def brute(rows):
    seen = {}
    raws = [(t or "").encode() for _, t, *_ in rows]
    for d, raw in enumerate(raws):
        for p in range(len(raw) - R.LENGTH + 1):
            seen.setdefault(raw[p:p + R.LENGTH], []).append((d, p))
    gone = [bytearray(len(x)) for x in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p:p + R.LENGTH] = b"\x01" * R.LENGTH
    out = []
    for (i, *_), raw, g in zip(rows, raws, gone):
        kept = bytes(b for b, x in zip(raw, g) if not x)
        out.append((i, len(raw), sum(g), sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in R.op5(edge.frame(spark, rows)).collect()), key=str)


def test_equals_brute_force(spark, rows):
    want = brute(rows)
    assert sum(r[2] for r in want) > 10_000
    assert run(spark, rows) == want


@pytest.mark.parametrize("segment", [1 << 20, 700])
def test_passages_at_every_length_and_place(spark, segment, monkeypatch):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = [word(n) for n in (199, 200, 201, 230, 260, 340, 900)]
    rows = []
    for i in range(90):
        parts = [word(rnd.randrange(0, 150))]
        for _ in range(rnd.randrange(0, 4)):
            x = rnd.choice(shared)
            cut = rnd.randrange(0, 40)
            parts += [x[cut:] if rnd.random() < 0.4 else x[:len(x) - cut], word(rnd.randrange(0, 120))]
        rows.append((i, "".join(parts), "en", "s"))
    rows += [(200, "ab" * 400, "en", "s"), (201, "a" * 199, "en", "s"), (202, "a" * 200, "en", "s"), (203, "b" * 201, "en", "s"),
             (204, "xyz" * 70, "en", "s"), (205, shared[6] + "é" * 200, "en", "s")]
    if segment != 1 << 20:  # segments are a matter of the worker; compare runs directly
        import numpy as np
        data = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8)
        ends = np.cumsum([len(r[1].encode()) for r in rows])
        whole = R.runs(data, ends)
        monkeypatch.setattr(R, "SEGMENT", segment)
        parts = R.runs(data, ends)
        count = lambda x: int((x[2] + 1).sum())
        assert count(whole) == count(parts) and set(whole[3]) == set(parts[3])
        return
    assert run(spark, rows) == brute(rows)


def test_cases(spark):
    rows = [c for c in edge.CASES if c[0] not in (6, 7, 8)] + [edge.CASES[4], (None, "one two three four five", "en", "s0")]
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(900))
    rows += [(6, long, "en", "s"), (7, long, "en", "s"), (8, "a" * 3000, "fr", "s"), (30, long + "x", "en", "s"), (30, long + "x", "en", "s"),
             (30, "short", "en", "s"), (None, "c" * 250, "en", "s")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
