import random
import zlib

import pytest

from receptory.llm import katz


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def _good_turing(counts):
    """Katz's discounts of counts 1 to 5, from the counts of all items."""
    from collections import Counter

    n, d = Counter(counts), {}
    for r in range(1, 6):
        if not n[1] or not n[r] or 6 * n[6] >= n[1]:
            continue
        x = ((r + 1) * n[r + 1] / n[r] / r - 6 * n[6] / n[1]) / (1 - 6 * n[6] / n[1])
        if 0.01 < x < 1:
            d[r] = x
    return d


@pytest.mark.parametrize(("order", "bucket_tokens", "least_dealt"), [(2, 800, 10_000), (2, 300, 5), (3, 500, 5), (4, 10**6, 10_000)])
def test_katz_by_brute_force(spark, order, bucket_tokens, least_dealt):
    import math
    import re
    from collections import Counter, defaultdict

    r = random.Random(3)
    texts = [words(r, r.randrange(0, 80), 60) for _ in range(100)] + [None, "", "w1", "W1 w1"] + [" ".join(["the", f"w{r.randrange(30)}"] * 20) for _ in range(20)]
    rows = [(None if i == 7 else i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored, tables = katz.score(table, order, bucket_tokens, 300, least_dealt)
    got = {x.doc_id: x for x in scored.collect()}
    token = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\0"] for i, t in rows}
    train = [i for i in token if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    grams = {m: Counter() for m in range(1, order + 1)}
    heads = Counter()
    for i in train:
        padded = ["\1"] * (order - 1) + token[i]
        for at in range(order - 1, len(padded)):
            for m in grams:
                grams[m][tuple(padded[at - m + 1 : at + 1])] += 1
                heads[tuple(padded[at - m + 1 : at])] += 1
    total = sum(grams[1].values())
    d = {m: _good_turing(x.values()) for m, x in grams.items()}
    seen = defaultdict(list)
    for m in range(2, order + 1):
        for g in grams[m]:
            seen[g[:-1]].append(g[-1])
    own = lambda g: d[len(g)].get(grams[len(g)][g], 1) * grams[len(g)][g] / (heads[g[:-1]] + 1)
    unknown = 1 - sum(own((w,)) for (w,) in grams[1])
    alpha = {}

    def p(h, w):
        if not h:
            return own((w,)) if (w,) in grams[1] else unknown
        if (*h, w) in grams[len(h) + 1]:
            return own((*h, w))
        if h not in seen:
            return p(h[1:], w)
        if h not in alpha:
            alpha[h] = (1 - sum(own((*h, x)) for x in seen[h])) / (1 - sum(p(h[1:], x) for x in seen[h]))
        return alpha[h] * p(h[1:], w)

    for h in list(seen)[:6]:
        assert sum(p(h, w) for (w,) in grams[1]) + p(h, "never seen") == pytest.approx(1)
    for i, x in token.items():
        assert got[i].n_tokens == len(x) and got[i].n_known == sum((w,) in grams[1] for w in x) and got[i].train_tokens == total
        padded = ["\1"] * (order - 1) + x
        want = sum(math.log10(p(tuple(padded[at : at + order - 1]), padded[at + order - 1])) for at in range(len(x)))
        assert got[i].score == pytest.approx(want, rel=1e-9)
        assert got[i].base_score == pytest.approx(sum(math.log10((grams[1][(w,)] + 1) / (total + len(grams[1]) + 1)) for w in x))
    for m, x in tables.items():
        assert sorted(y["count"] for y in x.collect()) == sorted(grams[m].values())


def test_katz_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(none)[0].count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string"))[0].collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0)
