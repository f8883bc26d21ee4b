"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words are read by their own vector (frequent words of the sample) and by the
mean of their byte trigrams' vectors, so new words are seen by their spelling.
Two gated recurrent layers read each window of WIDTH words in both directions,
attention pools their states, and a linear layer gives the window's logit.
All overlapping windows of a whole text are scored; a document is as toxic as
its worst window.  Windows of toxic documents are learnt as a bag: after the
first epochs only the worst window of each counts as toxic.

The network is fit on a bounded sample of labelled rows (FIT_DOCUMENTS), on all
windows of their whole texts, and has a fixed size; the sample goes by the
hashes of doc_ids, so the same rows give the same network however they are laid
out.  doc_id is an integer column.

Edge cases: null and empty texts and texts without words have no window and
get the score of the least toxic sampled document; without labels, or with one
class, all scores are that class's smoothed share; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receptory.llm.common import ALPHANUMERIC, BYTE_WEIGHT, LOWER, U64, fold, mix, prefix_hashes, row_starts, slices, span_hashes, spread, table, text_bytes, text_column, word_spans
from receptory.llm.labels import FOLDS, labelled_sample
from receptory.llm.quality import logistic_fit

#: Words of a window and from one window to the next.
WIDTH, STRIDE = 32, 24
#: Sizes: known words, trigram buckets, their vectors, hidden units of a direction, attention units.
WORDS, TRIGRAMS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 2048, 4096, 8, 12, 12, 8
FIT_DOCUMENTS = 4000
#: Windows that run through the network at once.
CHUNK = 1024


@dataclass
class Tokens:
    """Distinct words of some rows: hashes and trigram buckets; each token's distinct word; each row's number of tokens."""

    hashes: np.ndarray
    trigrams: np.ndarray
    trigram_starts: np.ndarray
    token: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, array: pa.Array) -> Tokens:
        data, offsets = text_bytes(array)
        low = LOWER[data]
        starts, ends, counts = word_spans(low, offsets, ALPHANUMERIC)
        hashes = span_hashes(prefix_hashes(BYTE_WEIGHT[low]), starts, ends)
        distinct, first, token = np.unique(hashes, return_index=True, return_inverse=True)
        a, size = starts[first], ends[first] - starts[first]
        at = np.repeat(a, size) + spread(size)
        left = np.where(spread(size) == 0, 1, low[np.maximum(at - 1, 0)]) if len(at) else np.zeros(0)
        right = np.where(spread(size) == np.repeat(size, size) - 1, 2, low[np.minimum(at + 1, len(low) - 1)]) if len(at) else np.zeros(0)
        code = left.astype(U64) << U64(16) | low[at].astype(U64) << U64(8) | right.astype(U64)
        return cls(distinct, (mix(code) >> U64(52)).astype(np.int64), row_starts(size), token.ravel(), counts)

    @classmethod
    def of_parts(cls, texts: pa.Array, limit: int = 1 << 18) -> Tokens:
        """The same of many texts, read about limit bytes at a time, so memory is bounded by the parts."""
        parts = [cls.of(x.column(0)) for x in slices([pa.RecordBatch.from_arrays([texts], ["text"])], limit=limit)]
        hashes, first, place = np.unique(np.concatenate([x.hashes for x in parts]), return_index=True, return_inverse=True)
        size = np.concatenate([np.diff(x.trigram_starts) for x in parts])
        base = row_starts(size)[first]
        grams = np.concatenate([x.trigrams for x in parts])[np.repeat(base, size[first]) + spread(size[first])]
        shift = row_starts(np.array([len(x.hashes) for x in parts]))
        token = np.concatenate([place[x.token + at] for x, at in zip(parts, shift[:-1], strict=True)])
        return cls(hashes, grams, row_starts(size[first]), token, np.concatenate([x.counts for x in parts]))

    def windows(self, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all overlapping windows: row, first token, length."""
        number = np.where(self.counts > 0, 1 + np.maximum(0, -(-(self.counts - width) // stride)), 0)
        row = np.repeat(np.arange(len(self.counts)), number)
        begin = spread(number) * stride
        return row, np.repeat(row_starts(self.counts)[:-1], number) + begin, np.minimum(width, self.counts[row] - begin)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def sums_by(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by key."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        cuts = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
        out[sorted_keys[cuts]] = np.add.reduceat(values[order], cuts, axis=0)
    return out


@dataclass
class BiGru:
    """Parameters by name, the hashes of known words, and the score's slope and offset."""

    p: dict[str, np.ndarray]
    known: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    empty: float = -4.0
    constant: float | None = None

    @classmethod
    def start(cls, known: np.ndarray, seed: int = 11) -> BiGru:
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        draw = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
        p = {"word": draw(len(known) + 1, WORD_DIM, scale=0.3), "char": draw(TRIGRAMS, CHAR_DIM, scale=0.5), "Wa": draw(2 * HIDDEN, ATTENTION, scale=0.3), "ba": draw(ATTENTION, scale=0), "va": draw(ATTENTION, scale=0.3), "wo": draw(2 * HIDDEN, scale=0.3), "bo": draw(1, scale=0)}
        for k in "fb":
            p |= {f"W{k}": draw(d, 3 * HIDDEN, scale=d**-0.5), f"b{k}": draw(3 * HIDDEN, scale=0), f"U{k}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{k}": draw(3 * HIDDEN, scale=0)}
        return cls(p, known)

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def inputs(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of the distinct words, a zero row for padding after them, and the words' numbers."""
        numbers = self.word_numbers(t.hashes)
        out = np.zeros((len(t.hashes) + 1, WORD_DIM + CHAR_DIM), np.float32)
        out[:-1, :WORD_DIM] = self.p["word"][numbers]
        if len(t.trigrams):
            sums = np.add.reduceat(self.p["char"][t.trigrams], t.trigram_starts[:-1], axis=0)
            out[:-1, WORD_DIM:] = sums / np.sqrt(np.diff(t.trigram_starts))[:, None]
        return out, numbers

    def grid(self, t: Tokens, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words by time and window, padding last, and the mask."""
        steps = np.arange(int(length.max()))[:, None]
        mask = steps < length[None, :]
        return np.where(mask, t.token[np.minimum(first[None, :] + steps, len(t.token) - 1)], len(t.hashes)), mask

    def layer(self, k: str, gates: np.ndarray, words: np.ndarray, mask: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States by time of one direction."""
        u, c = self.p[f"U{k}"], self.p[f"c{k}"]
        steps, n = words.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for s in range(steps) if k == "f" else range(steps - 1, -1, -1):
            g = gates[words[s]]
            own = h @ u + c
            zr = sigmoid(g[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            m = np.tanh(g[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            z = z * mask[s][:, None]
            if kept is not None:
                kept.append((s, h, z, r, m, own[:, 2 * HIDDEN :]))
            h = h + z * (m - h)
            out[s] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        u = np.tanh(states @ self.p["Wa"] + self.p["ba"])
        score = np.where(mask, u @ self.p["va"], np.float32(-1e9))
        a = np.exp(score - score.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return pooled @ self.p["wo"] + self.p["bo"][0], pooled, a, u

    def logits(self, t: Tokens, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logit of each window."""
        x, _ = self.inputs(t)
        gates = {k: x @ self.p[f"W{k}"] + self.p[f"b{k}"] for k in "fb"}
        out = np.empty(len(first), np.float32)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(first), CHUNK):
            own = order[at : at + CHUNK]
            words, mask = self.grid(t, first[own], length[own])
            out[own] = self.pool(np.concatenate([self.layer(k, gates[k], words, mask) for k in "fb"], axis=2), mask)[0]
        return out

    def gradients(self, t: Tokens, first: np.ndarray, length: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of some windows."""
        p, g = self.p, {}
        x, numbers = self.inputs(t)
        words, mask = self.grid(t, first, length)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.layer(k, x @ p[f"W{k}"] + p[f"b{k}"], words, mask, kept[k]) for k in "fb"], axis=2)
        logit, pooled, a, u = self.pool(states, mask)
        d = ((sigmoid(logit) - labels) * weights / len(labels)).astype(np.float32)
        g["bo"], g["wo"] = np.array([d.sum()]), pooled.T @ d
        d_pooled = d[:, None] * p["wo"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = a * (d_a - (a * d_a).sum(0))
        g["va"] = np.einsum("tn,tnk->k", d_score, u)
        d_u = d_score[:, :, None] * p["va"] * (1 - u * u)
        g["Wa"], g["ba"] = np.einsum("tnh,tnk->hk", states, d_u), d_u.sum((0, 1))
        d_states += d_u @ p["Wa"].T
        d_x = np.zeros_like(x)
        for i, k in enumerate("fb"):
            into = np.empty((*words.shape, 3 * HIDDEN), np.float32)
            g[f"U{k}"], g[f"c{k}"] = np.zeros_like(p[f"U{k}"]), np.zeros_like(p[f"c{k}"])
            d_h = np.zeros((len(first), HIDDEN), np.float32)
            for s, h, z, r, m, own in reversed(kept[k]):
                d_h = d_h + d_states[s, :, i * HIDDEN : (i + 1) * HIDDEN]
                d_m = d_h * z * (1 - m * m)
                d_z = d_h * (m - h) * z * (1 - z)
                d_r = d_m * own * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_m], axis=1) * mask[s][:, None]
                d_own = d_in.copy()
                d_own[:, 2 * HIDDEN :] *= r
                into[s] = d_in
                g[f"U{k}"] += h.T @ d_own
                g[f"c{k}"] += d_own.sum(0)
                d_h = d_h * (1 - z) + d_own @ p[f"U{k}"].T
            gate = sums_by(words.ravel(), into.reshape(-1, 3 * HIDDEN), len(x))
            g[f"W{k}"], g[f"b{k}"] = x.T @ gate, gate.sum(0)
            d_x += gate @ p[f"W{k}"].T
        size = np.diff(t.trigram_starts)
        g["word"] = sums_by(numbers, d_x[:-1, :WORD_DIM], len(p["word"]))
        g["char"] = sums_by(t.trigrams, np.repeat(d_x[:-1, WORD_DIM:] / np.sqrt(size)[:, None], size, axis=0), TRIGRAMS)
        return g

    def document_logits(self, array: pa.Array) -> np.ndarray:
        """Each row's worst window."""
        t = Tokens.of(array)
        out = np.full(len(array), self.empty, np.float64)
        row, first, length = t.windows()
        if len(row):
            cuts = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[cuts]] = np.maximum.reduceat(self.logits(t, first, length), cuts)
        return out

    def scores(self, array: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(array), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.document_logits(array) + self.offset, -30, 30)))


@dataclass
class Adam:
    rate: float
    step: int = 0
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, v in g.items():
            a = self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * v
            b = self.second[k] = 0.99 * self.second.get(k, 0) + 0.01 * v * v
            p[k] = (p[k] - self.rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.99**self.step)) + 1e-7)).astype(np.float32)


def fit(texts: list[str] | pa.Array, labels: np.ndarray, epochs: int = 14, batch: int = 192, seed: int = 3) -> BiGru:
    """Fit on all windows of labelled documents."""
    labels = labels.astype(np.float64)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    t = Tokens.of_parts(texts) if len(texts) else None
    used = t.counts > 0 if len(texts) else np.zeros(0, bool)
    if not used.any() or labels[used].min() == labels[used].max():
        n = len(labels)
        return BiGru({}, np.zeros(0, U64), constant=float((labels.sum() + 1) / (n + 2)) if n else 0.5)
    owner, first, length = t.windows()
    seen = np.bincount(np.unique(np.repeat(np.arange(len(texts)), t.counts) << 32 | t.token) & 0xFFFFFFFF, minlength=len(t.hashes))
    common = np.argsort(-seen, kind="stable")[:WORDS]
    model = BiGru.start(np.sort(t.hashes[common[seen[common] >= 5]]))
    rng, adam = np.random.default_rng(seed), Adam(0.012)
    target = labels[owner]
    live = np.arange(len(owner))

    def part(rows: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray]:
        size = length[rows]
        tokens = t.token[np.repeat(first[rows], size) + spread(size)]
        words, token = np.unique(tokens, return_inverse=True)
        letters = np.diff(t.trigram_starts)[words]
        grams = t.trigrams[np.repeat(t.trigram_starts[words], letters) + spread(letters)]
        return Tokens(t.hashes[words], grams, row_starts(letters), token, size), row_starts(size)[:-1], size

    for epoch in range(epochs):
        toxic, clean = live[target[live] == 1], live[target[live] == 0]
        if epoch >= 3:
            logit = model.logits(t, first, length)
            order = np.lexsort((-logit, owner))
            worst = order[np.unique(owner[order], return_index=True)[1]]
            toxic = worst[target[worst] == 1]
            hard = clean[np.argsort(-logit[clean])[: 2 * len(toxic)]]
            clean = np.concatenate([hard, rng.choice(clean, min(len(clean), 2 * len(toxic)), replace=False)])
        else:
            toxic = rng.choice(toxic, min(len(toxic), 2000), replace=False)
            clean = rng.choice(clean, min(len(clean), 2 * len(toxic)), replace=False)
        rows = rng.permutation(np.concatenate([toxic, clean]))
        adam.rate = 0.012 * (1 - 0.7 * epoch / epochs)
        for at in range(0, len(rows), batch):
            own = rows[at : at + batch]
            model_part = part(own)
            weights = np.where(target[own] == 1, 1.5, 0.75).astype(np.float32)
            adam.update(model.p, model.gradients(*model_part, target[own].astype(np.float32), weights))
    most = np.full(len(texts), -np.inf)
    np.maximum.at(most, owner, model.logits(t, first, length))
    model.slope, model.offset = logistic_fit(most[used], labels[used])
    model.empty = float(most[used].min())
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = FIT_DOCUMENTS) -> BiGru:
    """The driver gets the whole texts of at most limit labelled rows."""
    got = labelled_sample(docs, labels, label, limit).toArrow().sort_by("doc_id")
    return fit(got.column("text").combine_chunks(), got.column("label").to_numpy())


def score_toxicity(docs: DataFrame, model: BiGru, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1)))], ["doc_id", "score"])

    scored = docs.select("doc_id", text_column()).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: BiGru, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at)
            yield batch.filter(pa.array(sent.value.scores(texts.fill_null("") if texts.null_count else texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, scored by a network of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
