import random

import pytest

from receptory.llm import ngram_jaccard


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def _components(texts, size, link):
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and link[1] * len(sets[i] & sets[j]) >= link[0] * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [len(x) for x in sets], root


@pytest.mark.parametrize(("size", "link"), [(3, (90, 100)), (5, (80, 100))])
def test_ngram_jaccard_by_brute_force(spark, size, link):
    r = random.Random(5)
    texts = ["", None, "one", "one two", "one two", "ONE two"]
    for _ in range(6):
        base = words(r, r.choice([12, 40, 120])).split()
        for k in (0, 1, 2, 3, 4, 6):
            own = list(base)
            for _ in range(k):
                own[r.randrange(len(own))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(own))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sizes, root = _components(texts, size, link)
    got = {x.doc_id: x for x in ngram_jaccard.near_duplicates(rows, link, size).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == root


def _copies(r, sizes, edits, vocabulary=400):
    out = []
    for n in sizes:
        base = words(r, n, vocabulary).split()
        for k in edits:
            own = list(base)
            for _ in range(k):
                own[r.randrange(len(own))] = f"z{r.randrange(10**6)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("size", "link"), [(3, (90, 100)), (5, (80, 100))])
def test_ngram_jaccard_with_hot_keys_and_tiles(spark, monkeypatch, size, link):
    for name, value in (("HOT", 3), ("TILE_BYTES", 3000), ("LEADER_SHARE", 2)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    r = random.Random(16)
    passage = words(r, 60, 10**6)
    texts = [f"{words(r, 25, 10**6)} {passage} {words(r, 25, 10**6)}" for _ in range(25)]
    texts += _copies(r, [150, 150, 700], [0, *range(1, 9), 12, 15, 20, 25, 30])
    r.shuffle(texts)
    sizes, root = _components(texts, size, link)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in ngram_jaccard.near_duplicates(rows, link, size).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root and [got[i].n_shingles for i in got] == [sizes[i] for i in got]


def test_tiles_of_a_family(spark, monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(ngram_jaccard, "TILE_BYTES", 9000)
    texts = _copies(r, [300], [0, *range(14)], 10**6)
    sizes, want = _components(texts, 3, (90, 100))
    members = spark.createDataFrame([(1, i, i) for i in range(len(texts))], "family long, set_id long, label long")
    root = list(range(len(texts)))
    for x in ngram_jaccard.tiled_links(members, spark.createDataFrame(list(enumerate(texts)), "set_id long, text string")).collect():
        assert _components([texts[x.a], texts[x.b]], 3, (90, 100))[1] == [0, 0]
        a, b = root[x.a], root[x.b]
        root = [min(a, b) if y in (a, b) else y for y in root]
    assert root == want


def test_one_row_of_each_component_stays(spark):
    r = random.Random(17)
    a, c, d = (words(r, 80, 10**6) for _ in range(3))
    near = " ".join([*a.split()[:79], "other"])
    rows = [(1, a, "x", 1), (1, a, "y", 2), (2, near, None, 3), (3, near, "x", 4), (3, c, "x", 5), (None, d, "x", 6), (None, d.upper(), "x", 7), (9, d, "x", 8), (None, "", "x", 9), (None, "", "x", 9), (4, None, "x", 10), (None, c + " " + a, "x", 11), (None, c + " " + a, "x", 11)]
    table = spark.createDataFrame(rows, "doc_id int, text string, set_id string, doc_number int")
    got = ngram_jaccard.one_of_each(table, (80, 100), 5)
    assert got.schema == table.schema
    kept = sorted(x.doc_number for x in got.collect())
    assert kept in ([1, 5, 8, 9, 9, 10, 11], [2, 5, 8, 9, 9, 10, 11])
    assert ngram_jaccard.one_of_each(table.limit(0), (80, 100), 5).count() == 0
