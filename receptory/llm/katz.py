"""LM scoring: a Katz back-off model of any order.

    P(w|h) = d(c(hw)) c(hw) / (c(h) + 1)          if hw was seen
           = alpha(h) P(w|h')                     if h was seen and hw was not
           = P(w|h')                              if h was not seen
    P(w)   = d(c(w)) c(w) / (N + 1)               of known words; all unknown ones share the rest

h' is the history h without its first word.  d are Good-Turing discounts of
each order's counts up to K (with Katz's correction), so the back-off weight
alpha(h), the mass left by seen words over the lower order's mass of the
unseen, normalises every history exactly.  The count of one in the
denominators leaves a mass even where no count is small.

The corpus is turned into blocks of tokens numbered by the block's own words.
Words are counted by ranges of their hashes, then each order's n-grams by
buckets of histories: a block sends a bucket each distinct n-gram once, with
its count in the block's training texts, and is sent its count in all.  So no
text is read twice and what is sent of a token shrinks with its repeats.  A
history with more than a bucket's share of all tokens is dealt over all
buckets by its next word; there are fewer of those than buckets, and their
weights are the only part of the model that every executor gets.  With all
counts of its n-grams and the figures of the histories where its held-out
texts may back off, a block evaluates the recursion token by token.

Counts stay in stored tables, partitioned by bucket of the history's hash: of
each word its hash, number and count, and of each history the numbers of the
words seen after it and their counts.

Edge cases: null and empty texts are one end token; repeated rows are learnt
and scored each; null ids fall in the fold of the empty text; doc_id is an
integer column; without training texts every token has the probability of the
unknown; words and histories are compared by 64-bit hashes; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from receptory.llm.common import BYTE_WEIGHT, LOWER, NOT_SPACE, U64, discard, fold, mix, prefix_hashes, release, row_starts, slices, small_batches, span_hashes, spread, stored, table, text_bytes, text_column, tidy, word_spans

#: Words of the longest n-gram.
ORDER = 2
#: Powers of two that counts can lie between.
LEVELS = 56
#: Counts up to K are discounted.
K = 5
#: Fold of crc32(doc_id) modulo FOLDS that is held out.
FOLDS, HELD = 7, 2
#: Text bytes of a block; tokens of a bucket; (block, word) pairs of a range of words.
BLOCK_BYTES, BUCKET_TOKENS, RANGE_PAIRS = 6 << 20, 1_000_000, 1_000_000
END = U64(0x2545F4914F6CDD1D)
_PAIR = U64(0xC2B2AE3D27D4EB4F)
BLOCKS = "block long, n_tokens long, n_words long, ids array<long>, words binary, tokens binary, sizes binary, train binary"
COUNTED = "kind string, bucket int, block long, counts binary, numbers binary, large binary, mass binary, history long, words array<long>, totals array<long>, stats array<long>, share double"


def enc(x: np.ndarray) -> bytes:
    """Unsigned numbers, deflated: how many bytes each has, then all numbers' lowest bytes, then all their next ones, and so on."""
    width = (int(x.max(initial=1)).bit_length() + 7) // 8
    deflate = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    return deflate.compress(bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()) + deflate.flush()


def dec(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


def hashes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing factors of counts 1..K from the numbers n[r] of items with count r; 1 where the estimate is no discount."""
    d = np.ones(K + 1)
    if n[1] > 0:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and common < 1:
                d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
    return np.where((d > 0.01) & (d < 1), d, 1.0)


@dataclass
class Model:
    """What all tasks know: N, V and the texts of training, the count above which histories are dealt, the unknown word's share, and by order the discounts and the weights of dealt histories."""

    tokens: int
    words: int
    documents: int
    share: int
    unknown: float = 1.0
    d: dict[int, np.ndarray] = field(default_factory=dict)
    dealt: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def seen(self, order: int, count: np.ndarray, history: np.ndarray | int) -> np.ndarray:
        """P of n-grams that were counted, from their count and their history's."""
        return self.d[order][np.where(count <= K, count, 0)] * count / (history + 1)

    def alpha(self, order: int, numbers: np.ndarray, large: np.ndarray, mass: np.ndarray, history: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The mass a history's seen words leave over the lower order's mass of the others; both are at least one count's share."""
        left = 1 - (large + numbers @ (self.d[order][1:] * np.arange(1, K + 1))) / (history + 1)
        return np.maximum(left, 1 / (history + 1)) / np.maximum(1 - mass, 1 / (lower + 1))


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, A-Z lower-cased, and each row's number of words."""
    data, offsets = text_bytes(array)
    low = LOWER[data]
    starts, ends, counts = word_spans(low, offsets, NOT_SPACE)
    return span_hashes(prefix_hashes(BYTE_WEIGHT[low]), starts, ends), counts


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of tokens: their documents, distinct words, tokens by number of word, tokens by document, training flags."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=BLOCK_BYTES):
            parts = [word_hashes(part.column(2)) for part in slices([batch], limit=1 << 20)]
            found, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = np.full(len(found) + len(counts), END)
            own[np.arange(len(found)) + np.repeat(np.arange(len(counts)), counts)] = found
            words, token, times = np.unique(own, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # small numbers for frequent words deflate better
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            words, token = words[order], place[token]
            row = [name, len(own), len(words), batch.column(0).to_pylist(), words.astype("<u8").tobytes(), enc(token), enc(counts + 1), enc(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])
            name += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) != HELD).alias("train"), text_column())
    return rows.mapInArrow(run, BLOCKS)


def _rows(columns: dict[str, list], n: int, schema: str = COUNTED) -> pa.RecordBatch:
    """A batch of the schema from some of its columns; the others are null."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([(columns[x] if isinstance(columns[x], pa.Array) else pa.array(columns[x], kinds[t])) if x in columns else pa.nulls(n, kinds[t]) for x, t in names], [x for x, _ in names])


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for the highest counts, one more for each halving; words are numbered level by level, range by range."""
    return LEVELS - 1 - np.frexp(counts.astype(np.float64))[1]


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int64)))


def _numbers(counts: np.ndarray) -> np.ndarray:
    """How many items have count 0, 1, ... and K + 2 or more."""
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)


def count_words(blocks: DataFrame, ranges: int) -> DataFrame:
    """By ranges of hashes: rows of the count table (kind word), each block's counts and numbers of its words (reply), and numbers of counts (numbers)."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                words, token, sizes, train = hashes(raw[0]), *map(dec, raw[1:])
                order = np.argsort(words)
                words, counts = words[order], np.bincount(token, np.repeat(train, sizes), len(words)).astype(np.int64)[order]
                cuts = np.searchsorted((words >> U64(32)) * U64(ranges) >> U64(32), np.arange(ranges + 1).astype(U64))
                some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield _rows({"bucket": [i for i, _, _ in some], "block": [block] * len(some), "words": [words[a:b].astype("<u8").tobytes() for _, a, b in some], "counts": [enc(counts[a:b]) for _, a, b in some]}, len(some), "bucket int, block long, words binary, counts binary")

    def total(part: pa.Table) -> pa.Table:
        names, blocks = [hashes(x) for x in part.column("words").to_pylist()], part.column("block").to_pylist()
        words, place = np.unique(np.concatenate(names), return_inverse=True)
        counts = np.bincount(place, np.concatenate([dec(x) for x in part.column("counts").to_pylist()]), len(words)).astype(np.int64)
        bucket, cuts = part.column("bucket")[0].as_py(), row_starts(np.array([len(x) for x in names]))
        level, seen = levels(counts), np.flatnonzero(counts)
        number, order = np.zeros(len(words), np.int64), np.argsort(level, kind="stable")
        number[order] = spread(np.bincount(level, minlength=LEVELS))
        own = [place[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = [_rows({"kind": ["reply"] * len(own), "bucket": [bucket] * len(own), "block": blocks, "counts": [enc(counts[x]) for x in own], "numbers": [enc(number[x]) for x in own]}, len(own))]
        out.append(_rows({"kind": ["word"] * len(seen), "bucket": [bucket] * len(seen), "history": words[seen].view(np.int64), "words": _lists(number[seen], np.arange(len(seen) + 1)), "totals": _lists(counts[seen], np.arange(len(seen) + 1))}, len(seen)))
        out.append(_rows({"kind": ["numbers"], "bucket": [bucket], "stats": [[*_numbers(counts).tolist(), len(seen), int(counts.sum()), *np.bincount(level, minlength=LEVELS).tolist()]]}, 1))
        return pa.Table.from_batches(out)

    return blocks.select("block", "words", "tokens", "sizes", "train").mapInArrow(deal, "bucket int, block long, words binary, counts binary").groupBy("bucket").applyInArrow(total, COUNTED)


class Block:
    """A block's tokens with what is known of them: by order a name and the training count of the n-gram that ends at each token.

    A single word's name is its number and one, that of a text's beginning 0,
    and those of longer n-grams are hashes.  Unknown words have any number, as
    no n-gram with them is asked for.
    """

    def __init__(self, row: dict, model: Model, buckets: int, known: int) -> None:
        self.model, self.buckets = model, buckets
        token = dec(row["tokens"])
        self.sizes, train = dec(row["sizes"]), dec(row["train"]).astype(bool)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train, self.first = train[self.doc], np.cumsum(self.sizes) - self.sizes
        self.number, count = dec(row["numbers"])[token], dec(row["counts"])[token]
        self.gram, self.count = {1: self.number.astype(U64) + U64(1)}, {1: count}
        self.alpha: dict[int, np.ndarray] = {}
        for order in range(2, known + 1):
            self.learn(order, sorted((x for x in row["replies"] if x["order"] == order), key=lambda x: x["bucket"]))

    def before(self, x: np.ndarray, at_start) -> np.ndarray:
        """Of each token what x has of the one before it, and at_start of a document's first."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = at_start
        return out

    def histories(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token its history's hash, count, shorter history's count, and whether the history is dealt over all buckets."""
        begin = np.zeros(1, U64)
        for _ in range(order - 2):
            begin = mix(begin * _PAIR)
        history, count = self.before(self.gram[order - 1], begin[0]), self.before(self.count[order - 1], self.model.documents)
        lower = self.before(self.count[order - 2], self.model.documents) if order > 2 else np.full(len(count), self.model.tokens)
        return history, count, lower, count > self.model.share

    def sent(self, order: int) -> tuple:
        """What the block asks of the buckets, by bucket: (token of each distinct n-gram, of each token asked its n-gram, its bucket, needed histories' tokens, their buckets)."""
        history, count, _, dealt = self.histories(order)
        gram = mix(history * _PAIR + self.gram[1])
        self.gram[order] = gram
        asked = np.flatnonzero(self.train | ((self.count[order - 1] > 0) & (count > 0)))
        distinct, first, inverse = np.unique(gram[asked], return_index=True, return_inverse=True)
        at = asked[first]
        bucket = self.bucket(np.where(dealt[at], distinct, history[at]))
        order_of = np.lexsort((history[at], bucket))
        rank = np.empty(len(at), np.int64)
        rank[order_of] = np.arange(len(at))
        needed = np.flatnonzero(~self.train & (count > 0) & ~dealt)
        needed = needed[np.unique(history[needed], return_index=True)[1]]
        need_bucket = self.bucket(history[needed])
        by = np.argsort(need_bucket, kind="stable")
        return asked, at[order_of], bucket[order_of], rank[inverse.ravel()], needed[by], need_bucket[by]

    def bucket(self, x: np.ndarray) -> np.ndarray:
        return ((mix(x) >> U64(32)) * U64(self.buckets) >> U64(32)).astype(np.int64)

    def learn(self, order: int, replies: list[dict]) -> None:
        """Take in the buckets' replies."""
        asked, _, _, place, needed, _ = self.sent(order)
        history, count, lower, dealt = self.histories(order)
        total = np.zeros(len(count), np.int64)
        if len(asked):
            total[asked] = np.concatenate([dec(x["counts"]) for x in replies])[place]
        self.count[order] = total
        if order not in self.model.dealt:
            return
        alpha = np.ones(len(count))
        if len(needed):
            numbers, large, mass = np.concatenate([dec(x["numbers"]) for x in replies]).reshape(-1, K), np.concatenate([dec(x["large"]) for x in replies]), np.concatenate([np.frombuffer(x["mass"], "<f8") for x in replies])
            names, found = history[needed], self.model.alpha(order, numbers, large, mass, count[needed], lower[needed])
            sort = np.argsort(names)
            places = np.flatnonzero(~self.train & (count > 0) & ~dealt)
            alpha[places] = found[sort][np.searchsorted(names[sort], history[places])]
        places = np.flatnonzero(~self.train & dealt)
        if len(places):
            names, weights = self.model.dealt[order]
            alpha[places] = weights[np.searchsorted(names, history[places])]
        self.alpha[order] = alpha

    def scores(self, order: int) -> np.ndarray:
        """log10 P of each token: the longest n-gram that was seen, and the weights of the histories backed off from."""
        known = self.count[1]
        score = np.log10(np.where(known > 0, self.model.seen(1, known, self.model.tokens), self.model.unknown))
        for m in range(2, order + 1):
            _, count, _, _ = self.histories(m)
            r = self.count[m]
            score = np.where(r > 0, np.log10(np.maximum(self.model.seen(m, r, count), 1e-300)), score + np.log10(np.where(count > 0, self.alpha[m], 1.0)))
        return score


NUMBERED = "block long, ids array<long>, tokens binary, sizes binary, train binary, numbers binary, counts binary"
SENT = "bucket int, block long, histories binary, totals binary, lowers binary, runs binary, words binary, unders binary, learnt binary, needed binary"


def send(model: Model, buckets: int, order: int):
    """From blocks: a row a bucket of their distinct n-grams, by history, and of the histories whose figures they need."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in batch.schema.names}
                block = Block(row, model, buckets, order - 1)
                history, count, lower, _ = block.histories(order)
                asked, at, bucket, place, needed, need_bucket = block.sent(order)
                learnt = np.bincount(place, block.train[asked], len(at)).astype(np.int64)
                cuts, needs = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(need_bucket, np.arange(buckets + 1))
                out = []
                for b in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(needs) > 0)):
                    own = at[cuts[b] : cuts[b + 1]]
                    new = np.flatnonzero(np.concatenate([[True], history[own[1:]] != history[own[:-1]]])) if len(own) else np.zeros(0, np.int64)
                    heads = own[new]
                    out.append((int(b), row["block"], enc(history[heads]), enc(count[heads]), enc(lower[heads]), enc(np.diff(np.append(new, len(own)))), enc(block.number[own]), enc(block.count[order - 1][own]), enc(learnt[cuts[b] : cuts[b + 1]]), enc(history[needed[needs[b] : needs[b + 1]]])))
                    if len(out) == 64:
                        yield _rows(dict(zip([x.split()[0] for x in SENT.split(", ")], zip(*out, strict=True), strict=True)), len(out), SENT)
                        out = []
                if out:
                    yield _rows(dict(zip([x.split()[0] for x in SENT.split(", ")], zip(*out, strict=True), strict=True)), len(out), SENT)
                del block, history, count, lower, asked, at, bucket, place, out
                release()

    return run


def count_grams(model: Model, buckets: int, order: int):
    """A bucket's rows of the count table (kind gram), its replies, partial figures of dealt histories (dealt), numbers of counts (numbers)."""

    def run(part: pa.Table) -> pa.Table:
        bucket, blocks = part.column("bucket")[0].as_py(), part.column("block").to_pylist()
        got = {x: part.column(x).to_pylist() for x in part.column_names if x not in ("bucket", "block")}
        runs = [dec(x) for x in got["runs"]]
        sizes = np.array([x.sum() for x in runs])
        every = lambda name: np.concatenate([dec(x) for x in got[name]])
        names = every("histories").view(U64)
        histories, first, number = np.unique(names, return_index=True, return_inverse=True)
        total, lower = every("totals")[first], every("lowers")[first]
        history = np.repeat(number, np.concatenate(runs))
        word, under = every("words"), every("unders")
        if len(histories) >> 23 or int(word.max(initial=0)) >> 40:
            raise OverflowError("more than 2**23 histories in a bucket, or 2**40 words")
        _, at, place = np.unique(history << 40 | word, return_index=True, return_inverse=True)
        c = np.bincount(place, every("learnt"), len(at)).astype(np.int64)
        h, word, under = history[at], word[at], under[at]
        n = np.stack([np.bincount(h[c == r], minlength=len(histories)) for r in range(1, K + 1)], axis=1)
        large = np.bincount(h, np.where(c > K, c, 0), len(histories)).astype(np.int64)
        mass = np.bincount(h, np.where(c > 0, model.seen(order - 1, under, lower[h]), 0.0), len(histories))
        cuts = row_starts(sizes)
        replies: dict[str, list] = {"counts": [], "numbers": [], "large": [], "mass": []}
        for i, needed in enumerate(map(dec, got["needed"])):
            own = np.searchsorted(histories, needed.view(U64))
            for name, x in (("counts", c[place[cuts[i] : cuts[i + 1]]]), ("numbers", n[own].ravel()), ("large", large[own])):
                replies[name].append(enc(x))
            replies["mass"].append(mass[own].astype("<f8").tobytes())
        out = [_rows({"kind": ["reply"] * len(blocks), "bucket": [bucket] * len(blocks), "block": blocks} | replies, len(blocks))]
        seen = np.flatnonzero(c)  # by history and word
        whose, heads = np.unique(h[seen], return_index=True)
        heads = np.append(heads, len(seen))
        out.append(_rows({"kind": ["gram"] * len(whose), "bucket": [bucket] * len(whose), "history": histories[whose].view(np.int64), "words": _lists(word[seen], heads), "totals": _lists(c[seen], heads)}, len(whose)))
        wide = np.flatnonzero(total > model.share)
        stats = np.concatenate([large[wide, None], n[wide], total[wide, None], lower[wide, None]], axis=1)
        out.append(_rows({"kind": ["dealt"] * len(wide), "bucket": [bucket] * len(wide), "history": histories[wide].view(np.int64), "stats": stats.tolist(), "share": mass[wide]}, len(wide)))
        out.append(_rows({"kind": ["numbers"], "bucket": [bucket], "stats": [_numbers(c).tolist()]}, 1))
        return pa.Table.from_batches(out)

    return run


def numbered(blocks: DataFrame, counted: DataFrame, starts: DataFrame) -> DataFrame:
    """Blocks with the numbers and counts of their words instead of the words themselves."""
    replies = counted.where("kind = 'reply'").join(starts, "bucket").groupBy("block").agg(F.collect_list(F.struct("bucket", "starts", "counts", "numbers")).alias("replies"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                order = np.argsort(hashes(batch.column("words")[i].as_py()))
                counts, numbers = [], []
                for x in sorted(batch.column("replies")[i].as_py(), key=lambda x: x["bucket"]):
                    counts.append(dec(x["counts"]))
                    numbers.append(dec(x["numbers"]) + np.array(x["starts"], np.int64)[levels(counts[-1])])
                own = [np.empty(len(order), np.int64) for _ in range(2)]
                own[0][order], own[1][order] = np.concatenate(numbers), np.concatenate(counts)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(x) for x in ("block", "ids", "tokens", "sizes", "train")), *(pa.array([enc(x)], pa.binary()) for x in own)], [x.split()[0] for x in NUMBERED.split(", ")])
                release()

    return blocks.join(replies, "block").mapInArrow(run, NUMBERED)


def with_replies(blocks: DataFrame, counted: dict[int, DataFrame]) -> DataFrame:
    """Blocks with their replies of all orders so far."""
    whole = None
    for m, x in counted.items():
        one = x.where("kind = 'reply'").select("block", F.struct(F.lit(m).alias("order"), "bucket", "counts", "numbers", "large", "mass").alias("reply"))
        whole = one if whole is None else whole.unionByName(one)
    if whole is None:
        return blocks.withColumn("replies", F.array())
    return blocks.join(whole.groupBy("block").agg(F.collect_list("reply").alias("replies")), "block", "left").withColumn("replies", F.coalesce("replies", F.array()))


def score(docs: DataFrame, order: int = ORDER, bucket_tokens: int = BUCKET_TOKENS, range_pairs: int = RANGE_PAIRS, least_dealt: int = 10_000) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Scores of all rows, and by order the tables (bucket, history, word, count); those of order one name the word's hash history."""
    blocks = stored(blocks_of(docs), "blocks")

    def trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(dec(x).sum()) for x in batch.column(0).to_pylist()], pa.int64())], ["n"])

    size = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    documents = blocks.select("train").mapInArrow(trained, "n long").agg(F.sum("n")).first()[0] or 0
    ranges, buckets = -(-(size.words or 1) // range_pairs), -(-(size.tokens or 1) // bucket_tokens)
    with small_batches(docs.sparkSession, 1):  # rows of blocks are of megabytes
        words_counted = stored(count_words(blocks, ranges), "words")
        tidy(docs.sparkSession)

        def numbers(frame: DataFrame, n: int) -> list[int]:
            return [int(x or 0) for x in frame.where("kind = 'numbers'").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"x{i}") for i in range(n)]).first()]

        *n, words, tokens = numbers(words_counted, K + 5)
        model = Model(tokens, words, documents, max(tokens // buckets, least_dealt))
        model.d[1] = discounts(np.array(n))
        model.unknown = (1 + sum((1 - model.d[1][r]) * r * n[r] for r in range(1, K + 1))) / (tokens + 1)
        # where each range's words of each level begin to be numbered
        sizes = words_counted.where("kind = 'numbers'").select("bucket", F.posexplode(F.slice("stats", K + 6, LEVELS)).alias("level", "n"))
        totals = {x.level: x.n for x in sizes.groupBy("level").agg(F.sum("n").alias("n")).collect()}  # one row a level
        bases = F.array(*[F.lit(sum(y for k, y in totals.items() if k < i)).cast("long") for i in range(LEVELS)])
        above = F.coalesce(F.sum("n").over(Window.partitionBy("level").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select("bucket", "level", (above + F.get(bases, F.col("level"))).alias("start")).groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "start"))), lambda x: x.start).alias("starts"))
        known = stored(numbered(blocks, words_counted, starts), "numbered")
        level = F.expr(f"cast({LEVELS - 1} - length(bin(totals[0])) as int)")
        tables = {1: stored(words_counted.where("kind = 'word'").join(starts, "bucket").select("bucket", "history", (F.get(F.col("words"), F.lit(0)) + F.get("starts", level)).alias("word"), F.get("totals", F.lit(0)).alias("count")), "unigrams")}
        discard(blocks, words_counted)
        tidy(docs.sparkSession)
        counted: dict[int, DataFrame] = {}
        for m in range(2, order + 1):
            sent = with_replies(known, counted).mapInArrow(send(model, buckets, m), SENT)
            counted[m] = stored(sent.groupBy("bucket").applyInArrow(count_grams(model, buckets, m), COUNTED), "grams")
            tables[m] = counted[m].where("kind = 'gram'").select("bucket", "history", F.explode(F.arrays_zip("words", "totals")).alias("x")).select("bucket", "history", F.col("x.words").alias("word"), F.col("x.totals").alias("count"))
            tidy(docs.sparkSession)
            model.d[m] = discounts(np.array(numbers(counted[m], K + 3)))
            sums = [F.sum(F.get("stats", F.lit(i))).alias(f"x{i}") for i in range(K + 1)] + [F.max(F.get("stats", F.lit(i))).alias(f"x{i}") for i in (K + 1, K + 2)]
            hot = counted[m].where("kind = 'dealt'").groupBy("history").agg(F.sum("share").alias("share"), *sums).collect()  # fewer than buckets
            x = np.array([[row[f"x{i}"] for i in range(K + 3)] for row in hot]).reshape(-1, K + 3)
            names = np.array([row.history for row in hot], np.int64).view(U64)
            by = np.argsort(names)
            model.dealt[m] = (names[by], model.alpha(m, x[:, 1 : K + 1], x[:, 0], np.array([row.share for row in hot]), x[:, K + 1], x[:, K + 2])[by])

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in batch.schema.names}
                block = Block(row, model, buckets, order)
                n, c = len(block.sizes), block.count[1]
                sums = [np.bincount(block.doc, x, n) for x in (c > 0, np.log10((c + 1) / (model.tokens + model.words + 1)), block.scores(order))]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(block.sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                del block, c, sums
                release()

    with small_batches(docs.sparkSession, 1):
        scored = stored(with_replies(known, counted).mapInArrow(final, "doc_id long, n_tokens long, n_known long, base_score double, score double"), "scores")
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long")), tables


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, learnt from all but the held-out fold."""
    scored, _ = score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
