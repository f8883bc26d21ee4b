import random
import re
from collections import Counter

import pytest

from receptory.llm import line_dedup

SCHEMA = "doc_id long, text string, n_chars int, removed_chars string, text2 string"
FIRST = ("alphabet", "bring", "silver,", "mount", "long", "the", "of", "brood", "großen", "winter")


def sentence(r, n, vocabulary=5000):
    return " ".join(r.choice(FIRST) if r.random() < 0.3 else f"w{r.randrange(vocabulary)}{r.choice('adr')}" for _ in range(n)).capitalize() + r.choice(".!?")


def prose(r, n):
    out = []
    while n > 0:
        out.append(sentence(r, min(n, r.randrange(5, 16))))
        n -= len(out[-1].split())
    return " ".join(out)


def run(spark, rows):
    table = spark.createDataFrame([(i, t, None if t is None else len(t), "clash", "kept") for i, t in rows], SCHEMA).repartition(3)
    return line_dedup.dedup_lines(table).collect()


def cut_lines(t):
    return [m.group() for m in re.finditer(line_dedup.WIDE_PATTERN if len(t.encode()) * 2 > len(t) * 3 else line_dedup.LINE_PATTERN, t)]


def brute_force(rows):
    """Kept text by (doc_id, text); ids must differ or texts be equal."""
    docs = []
    for i, t in sorted({(1 << 63 if i is None else i, t or "") for i, t in rows}):
        lines = cut_lines(t)
        h = [0, *(len(u.encode()) for u in lines)]
        roll = [(a * 331 + b) * 40503 % 65521 for a, b in zip(h, h[1:])]
        starts = [k for k in range(len(lines)) if not k or (2 <= k < len(lines) - 1 and roll[k] < roll[k - 1] and roll[k] <= roll[k + 1])]
        docs.append((i, t, lines, list(zip(starts, [*starts[1:], len(lines)]))))
    bare = lambda u: u.rstrip(" \n")
    first, out = {}, {}
    for d, (i, t, lines, chunks) in enumerate(docs):
        cut = set()
        for k, (s, e) in enumerate(chunks):
            body = "".join(lines[s : e - 1]) + bare(lines[e - 1])
            if e - s < 2 or len("".join(lines[s : s + 2]).encode()) < line_dedup.SEED_BYTES:
                continue
            if body not in first:
                first[body] = (d, k)
                continue
            d2, k2 = first[body]
            other, (s2, e2) = docs[d2], docs[d2][3][k2]
            low, low2 = chunks[k - 1][0] if k else 0, other[3][k2 - 1][0] if k2 else 0
            top, top2 = chunks[k + 1][1] if k + 1 < len(chunks) else len(lines), other[3][k2 + 1][1] if k2 + 1 < len(other[3]) else len(other[2])
            cut |= set(range(s, e))
            a, b = s, s2
            while a > low and b > low2 and bare(lines[a - 1]) == bare(other[2][b - 1]):
                a, b = a - 1, b - 1
                cut.add(a)
            a, b = e, e2
            while a < top and b < top2 and bare(lines[a]) == bare(other[2][b]):
                cut.add(a)
                a, b = a + 1, b + 1
        gone = set()
        for k in cut:
            if k - 1 in cut:
                continue
            end = k
            while end in cut:
                end += 1
            if len("".join(lines[k:end])) >= line_dedup.MIN_CHARS:
                gone |= set(range(k, end))
        out[(i, t)] = "".join(u for k, u in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize(("hot", "share"), [(4000, 1000), (6, 2), (1, 1)])
def test_line_dedup_by_brute_force(spark, monkeypatch, hot, share):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "SHARE", share)
    r = random.Random(7)
    passages = [prose(r, n) for n in (20, 51, 60, 90, 200)]
    rows = [(None, None), (500, ""), (501, "x"), (502, "same line. " * 40), (503, "same line. " * 40)]
    for i in range(60):
        parts = [prose(r, r.randrange(0, 80)) for _ in range(3)]
        glue = r.choice([" ", "\n", "\n\n"])
        rows.append((i, glue.join([parts[0], r.choice(passages), parts[1], r.choice(passages), parts[2]])))
    wide = "".join(r.choice("的一是不了人。，他这中大г") for _ in range(400))
    rows += [(600, "前言" + wide), (601, wide), (602, "слово " * 5 + passages[1])]
    rows += [(None, rows[8][1]), (7, dict(rows)[7]), (7, dict(rows)[7])]
    want = brute_force(rows)
    got = run(spark, rows)
    assert len(got) == len(rows) and any(x.removed_chunks for x in got)
    kept = Counter((1 << 63 if i is None else i, want[(1 << 63 if i is None else i, t or "")]) for i, t in rows)
    assert Counter((1 << 63 if x.doc_id is None else x.doc_id, x.text or "") for x in got) == kept
    assert all((x.n_chars == len(x.text) if x.text is not None else x.n_chars is None) and x.text2 == "kept" for x in got)
    assert sorted(got[0].asDict()) == ["doc_id", "n_chars", "removed_chars", "removed_chunks", "text", "text2"]


def test_text_that_occurs_once_is_never_cut(spark):
    """Rows of one doc_id, or of none, with different texts are decided apart."""
    r = random.Random(9)
    p, q, s = (prose(r, 120) for _ in range(3))
    rows = [(1, p), (5, p), (5, q), (None, s), (None, q + "\n" + s), (None, s), (6, s)]
    texts = Counter(x.text for x in run(spark, rows))
    assert texts[p] == 1 and texts[q] + texts[q + "\n" + s] + texts[q + "\n"] >= 1 and texts[s] >= 1
    kept = "\n".join(texts)
    for line in cut_lines(f"{p}\n{q}\n{s}"):
        assert line.rstrip() in kept


@pytest.mark.parametrize("glue", [" ", "\n"])
def test_passages_of_over_fifty_words_go(spark, glue):
    r = random.Random(10)
    rows, passages = [], []
    for i in range(60):
        passages.append(prose(r, 55))
        rows += [(2 * i + k, glue.join([prose(r, 60), passages[-1], prose(r, 60)])) for k in (0, 1)]
    got = {x.doc_id: x for x in run(spark, rows)}
    assert all(got[2 * i].removed_chars == "0" or got[2 * i].removed_chars == 0 for i in range(60))
    gone = [min(int(got[2 * i + 1].removed_chars), len(p)) / len(p) for i, p in enumerate(passages)]
    assert sum(x > 0 for x in gone) >= 57 and sum(gone) / 60 > 0.85


def test_line_dedup_of_no_rows(spark):
    assert run(spark, []) == []
