import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from receptory.llm import decontaminate, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, vocabulary=3000):
    out = []
    while n > 0:
        k = min(n, r.randrange(6, 15))
        out.append(" ".join(f"w{r.randrange(vocabulary)}{r.choice('agbd')}" for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean texts, toxic ones, near and exact copies, a shared passage, a benchmark passage, and edge rows."""
    r = random.Random(31)
    path = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(360):
        text, bad = prose(r, 60), i % 4 == 0
        if bad:
            w = text.split()
            w[20:20] = w[40:40] = "you vile idiot scum".split()
            text = " ".join(w)
        rows.append((i, text))
        if i < 300:
            labels.append((i, 1, int(bad)))
    base, item, passage = prose(r, 80), " ".join(f"q{k}" for k in range(14)), prose(r, 70)
    near = base.split()
    near[40] = "changed"
    rows += [(400, base), (401, base), (402, " ".join(near)), (403, base), (403, base)]
    rows += [(410, f"{prose(r, 30)} {item} {prose(r, 30)}"), (411, f"{prose(r, 40)}\n{passage}\n{prose(r, 40)}"), (412, f"{prose(r, 40)}\n{passage}\n{prose(r, 40)}")]
    rows += [(420, None), (421, ""), (None, prose(r, 50)), (None, prose(r, 50)), (422, "one")]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def run_stages(spark, path):
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, path), name)
        out.append((name, before, docs))
    return out


def test_every_stage_by_brute_force(spark, tables):
    path, rows = tables
    stages = {name: (before, after) for name, before, after in run_stages(spark, path)}
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard", "decontaminate", "bpe"]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    texts = lambda df: Counter((x.doc_id, x.text) for x in df.collect())

    before, after = stages["toxicity"]
    model = toxicity.fit_toxicity(before, spark.read.parquet(f"{path}/labels.parquet"))
    toxic = {(x.doc_id, x.text) for x in before.collect() if model.scores(pa.array([x.text or ""]))[0] >= 0.5}
    assert texts(after) == Counter({k: n for k, n in texts(before).items() if k not in toxic}) and after.columns == names
    assert {i for i, _ in toxic} >= {i for i in range(300, 360) if i % 4 == 0} and len(toxic) == 90

    before, after = stages["line_dedup"]
    from tests.llm.test_line_dedup import brute_force

    want = brute_force([(x.doc_id, x.text) for x in before.collect()])
    kept = Counter((i, want[((1 << 63) if i is None else i, t or "")] if t else t) for (i, t), n in texts(before).items() for _ in range(n))
    assert texts(after) == kept and all(x.n_chars == (None if x.text is None else len(x.text)) for x in after.collect()) and after.columns == names

    before, after = stages["ngram_jaccard"]
    from tests.llm.test_ngram_jaccard import _components

    own = [(x.doc_id, x.text) for x in before.collect()]
    _, root = _components([t for _, t in own], *[corpus_pipeline.SHINGLE, corpus_pipeline.LINK])
    groups = Counter(root[k] for k, (_, t) in enumerate(own) if t and t.split())
    assert after.count() == sum(1 for _, t in own if not (t and t.split())) + len(groups) and after.columns == names
    for x in after.collect():
        if x.text and x.text.split():
            mates = [own[k][0] for k in range(len(own)) if root[k] == root[own.index((x.doc_id, x.text))]]
            assert x.doc_id == min(mates, key=lambda i: (i is None, i or 0))

    before, after = stages["decontaminate"]
    grams = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    item = [f"q{k}" for k in range(14)]
    windows = {tuple(item[k : k + decontaminate.WINDOW]) for k in range(5)}
    clean = {k: n for k, n in texts(before).items() if not any(tuple(grams(k[1])[j : j + 10]) in windows for j in range(len(grams(k[1]))))}
    assert texts(after) == Counter(clean) and 410 not in {i for i, _ in clean} and after.columns == names

    before, after = stages["bpe"]
    assert Counter((x.doc_id, x.decoded_sha256) for x in after.collect()) == Counter((x.doc_id, hashlib.sha256((x.text or "").encode()).hexdigest()) for x in before.collect())
    final = {x.doc_id for x in after.collect()}
    assert final >= {i for i in range(360) if i % 4} | {400, 411, 412, 420, 421, 422, None} and 410 not in final
    assert Counter(tuple(x) for x in corpus_pipeline.run(spark, path).collect()) == Counter(tuple(x) for x in after.collect())


def test_stages_with_clashing_columns_and_no_rows(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, x in (("removed_chunks", 1), ("set_id", 2), ("score", 3), ("row", 4), ("perhaps", 5), ("key", 6)):
        docs = docs.selectExpr("*", f"{x} as {k}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, path), "clash")
        assert out.columns == docs.columns or set(out.columns) == set(docs.columns)
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count() > 100
    assert {tuple(x) for x in docs.select("set_id", "score", "row", "perhaps", "key").collect()} == {(2, 3, 4, 5, 6)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars"), path).count() == 0
