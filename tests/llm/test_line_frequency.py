import re
from collections import Counter, defaultdict

import edge
from filelens.llm import line_frequency as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_docs, share, depleted):
    norm = lambda x: " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(x))
    per_host, docs = defaultdict(Counter), Counter()
    for _, text, _, host in rows:
        docs[host or ""] += 1
        per_host[host or ""].update({norm(x) for x in (text or "").split("\n")} - {""})
    out = []
    for i, text, _, host in rows:
        text, c, n = text or "", per_host[host or ""], docs[host or ""]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        win = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        cover = {k + d for k, w in enumerate(win) if win.count(w) > 1 for d in range(3)} if len(win) < 3000 else None
        gone = sum(len(WORD.findall(x)) for x in lines if c[norm(x)] > max(min_docs, share * n))
        failed = len(words) < 50 or (cover is not None and 100 * len(cover) > 50 * len(words))
        out.append((i, len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)),
                    None if cover is None else len(cover), gone, failed, not failed and gone <= depleted * len(words)))
    return out


def run(docs, min_docs, share, depleted):
    v = L.verdicts(L.profile(docs), min_docs, share, depleted)
    return [tuple(r) for r in v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                       "removed_words", "base_failed", "kept").collect()]


def test_equals_brute_force(spark, rows):
    got, want = run(edge.frame(spark, rows), 1, 0.05, 0.3), brute(rows, 1, 0.05, 0.3)
    assert any(r[6] for r in want) and any(not r[8] and not r[7] for r in want)
    short = {r[0]: r for r in want}
    assert len(got) == len(want)
    for r in got:
        w = short[r[0]]
        assert r[:5] == w[:5] and r[6] == w[6]
        if w[5] is not None:
            assert r == w


def test_cases(spark):
    got = run(edge.cases(spark), 1, 0.0, 0.5)
    assert len(got) == len(edge.CASES) + 2
    by = {r[0]: r for r in got}
    assert by[1][1:6] == (0, 0, 0, 0, 0) and by[1][7] and by[2][7] and by[3][1] == 0
    assert by[4][6] == 1  # "one" is in three documents of the host ''
    assert not by[6][7] and by[9][4] == 1 and by[8][2] == 70_000 and by[10][1] == 3
    assert run(edge.empty(spark), 1, 0.0, 0.5) == []


def test_lines_leave_the_text(spark):
    body = {i: "\n".join(" ".join(f"d{i}u{j}q{k}" for k in range(60)) for j in range(2)) for i in range(4)}
    docs = edge.frame(spark, [(i, f"Buy   NOW\n{body[i]}\n\nbuy now", "en", "h") for i in range(4)])
    v = L.verdicts(L.profile(docs), 3, 0.5, 0.5)
    got = {r["doc_id"]: r["text"] for r in L.cleaned_texts(docs, v).collect()}
    assert got == {i: f"{body[i]}\n" for i in range(4)}
