"""Document fingerprints: Order MinHash.

A text's words are its symbols; of a word of more than SYMBOL_BYTES bytes, as
scripts without spaces have, every character is one.  Its k-mers are k consecutive symbols, each with the
number of its occurrence.  For each of SLOTS hash functions the PICKED k-mers
of least hash are selected, put back into text order, and hashed as a tuple.
Two fingerprints' likeness, the share of equal slots, estimates a similarity
that falls with the edit distance: it sees both which k-mers are shared and
whether they keep their order.

Edge cases: a null text counts as an empty one; a text of fewer than K symbols
has one k-mer of all of them; an empty text has a fingerprint of its own, equal
to that of other texts without symbols and to no other; repeated rows and equal
texts have equal fingerprints; null ids come last; rows of one doc_id, or of
none, follow each other by a hash of the text, then by the text; doc_id is an
integer column; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from receptory.llm.common import BYTE_WEIGHT, NOT_SPACE, U64, bounded_rows, mix, prefix_hashes, span_hashes, table, text_column, word_spans

#: Symbols of a k-mer, k-mers of a tuple, slots of a fingerprint.
K, PICKED, SLOTS = 5, 2, 64
#: The longest word that is one symbol.
SYMBOL_BYTES = 24
#: Rows of a run of documents that follow each other, about; runs of one table at most.
RUN_ROWS, MOST_RUNS = 10_000, 1 << 16
_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_CELLS = 1 << 18


def symbols(text: bytes) -> np.ndarray:
    """Hashes of the text's symbols in order."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), NOT_SPACE)
    wide = np.flatnonzero(ends - starts > SYMBOL_BYTES)
    if len(wide):
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, starts[wide], 1)
        np.add.at(inside, ends[wide], -1)
        cuts = np.flatnonzero((np.cumsum(inside)[:-1] > 0) & (data & 0xC0 != 0x80))  # first bytes of characters
        begins = np.union1d(starts, cuts)
        last = np.searchsorted(begins, begins, "right")
        following = np.append(begins, len(data))[last]
        owner = np.searchsorted(starts, begins, "right") - 1
        starts, ends = begins, np.minimum(following, ends[owner])
    return span_hashes(prefix_hashes(BYTE_WEIGHT[data]), starts, ends)


def numbered_kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, number of its occurrence so far), in text order."""
    n = len(words)
    if n == 0:
        return words
    k = min(K, n)
    kmers = np.zeros(n - k + 1, U64)
    for i in range(k):
        kmers = kmers * U64(0xC2B2AE3D27D4EB4F) + words[i : n - k + 1 + i]
    kmers = mix(kmers + U64(k))
    order = np.argsort(kmers, kind="stable")
    runs = kmers[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = runs[1:] != runs[:-1]
    at = np.arange(len(runs))
    number = np.empty(len(runs), U64)
    number[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(kmers + number * U64(0x9FB21C651E98DF25))


def signature(words: np.ndarray) -> np.ndarray:
    """SLOTS tuple hashes of 32 bits; all zero without symbols."""
    kmers = numbered_kmers(words)
    n = len(kmers)
    if n == 0:
        return np.zeros(SLOTS, np.uint32)
    picked = min(PICKED, n)
    values = np.empty((SLOTS, picked), U64)
    places = np.empty((SLOTS, picked), np.int64)
    step = max(1, _CELLS // n)
    for at in range(0, SLOTS, step):
        seeds = _SEEDS[at : at + step]
        cells = kmers[None, :] * seeds[:, None]
        every = np.arange(len(seeds))
        for j in range(picked):
            where = cells.argmin(1)
            places[at : at + step, j] = where
            values[at : at + step, j] = cells[every, where]
            cells[every, where] = ~U64(0)
    places.sort(1)
    chosen = kmers[places]
    tuples = np.zeros(SLOTS, U64)
    for j in range(picked):
        tuples = mix(tuples * U64(0xD1342543DE82EF95) + chosen[:, j] + U64(j + 1))
    return (tuples >> U64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many characters from the start of the following text, or by all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_circle(docs: DataFrame, run_rows: int) -> DataFrame:
    """Rows (run, last, doc_id, text): within a run by descending doc_id, each run closed by a copy of the row that follows it.

    Runs are ranges of doc_id between quantiles, so only ids are looked at to
    find them; an id of very many rows has runs of its own, by ranges of the
    text's hash.  The closing rows are one a run.  After the last run comes the
    first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column())
    runs = min(-(-rows.count() // run_rows), MOST_RUNS)
    large = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 4 * run_rows)
    large = {x.doc_id: min(-(-x.n // run_rows), MOST_RUNS) for x in bounded_rows(large, MOST_RUNS, "ids of many rows")} if runs > 1 else {}
    cuts = rows.select(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 10 * runs).alias("q")).first().q if runs > 1 else None
    # a row's range is how many cuts are above its id; a large id has its own range, as do rows without one
    cuts = sorted({*(cuts or []), *(x + y for x in large if x is not None for y in (0, 1) if x + y < 1 << 63)})
    known = F.lit(np.array(cuts, np.int64)) if cuts else F.array().cast("array<bigint>")
    steps = len(cuts).bit_length()
    search = f"aggregate(sequence(1, {max(steps, 1)}), named_struct('a', 0, 'b', size(cuts)), (s, i) -> if(s.a >= s.b, s, if(get(cuts, (s.a + s.b) div 2) <= doc_id, named_struct('a', cast((s.a + s.b) div 2 + 1 as int), 'b', s.b), named_struct('a', s.a, 'b', cast((s.a + s.b) div 2 as int)))), s -> size(cuts) - s.a)"
    parts = F.lit(1)
    for x, n in large.items():
        parts = F.when(F.col("doc_id").eqNullSafe(F.lit(x)), n).otherwise(parts)
    share = F.expr("cast(shiftrightunsigned(hash, 33) * parts div 2147483648 as int)")  # by ranges of the hash, read as unsigned
    rows = rows.withColumn("cuts", known).withColumn("hash", F.xxhash64("text")).withColumn("parts", parts)
    rows = rows.select(F.struct(F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.expr(search)).alias("range"), share.alias("share")).alias("run"), "doc_id", F.when(F.col("parts") > 1, F.expr("shiftrightunsigned(hash, 1)")).otherwise(0).alias("hash"), "text")
    order = F.struct(F.bitwise_not("doc_id").alias("falling"), "hash", "text")
    heads = rows.groupBy("run").agg(F.min(order).alias("head"))
    numbers = [tuple(x.run) for x in bounded_rows(heads.select("run"), 2 * MOST_RUNS + 2 * sum(large.values()), "runs")]
    if not numbers:
        return rows.select("run", F.lit(False).alias("last"), "doc_id", "hash", "text")
    numbers.sort()
    before = spark.createDataFrame([(x, numbers[i - 1]) for i, x in enumerate(numbers)], "run struct<range: int, share: int>, before struct<range: int, share: int>")
    closing = heads.join(F.broadcast(before), "run").select(F.col("before").alias("run"), F.lit(True).alias("last"), F.bitwise_not("head.falling").alias("doc_id"), "head.hash", "head.text")
    return rows.select("run", F.lit(False).alias("last"), "doc_id", "hash", "text").unionByName(closing)


def fingerprints(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Fingerprint every text and its edited text, with the likeness to the edited and to the following text."""
    ordered = in_circle(docs, run_rows).repartition("run").sortWithinPartitions(F.col("run"), F.col("last"), F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("text"))
    ordered = ordered.select(F.expr("cast(run.range as bigint) << 32 | run.share").alias("run"), "last", "doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for number, last, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = text.encode()
                    words = symbols(raw)
                    sign = signature(words)
                    if held is not None and held[0] == number:
                        _, h_id, h_text, h_sign = held
                        half = edited(h_text, text)
                        raw_half = half.encode()
                        sign_half = signature(symbols(raw_half))
                        out.append((h_id, len(h_text), hashlib.sha256(raw_half).hexdigest(), h_sign.astype(">u4").tobytes().hex(), sign_half.astype(">u4").tobytes().hex(), likeness(h_sign, sign_half), likeness(h_sign, sign)))
                    held = None if last else (number, doc_id, text, sign)
                if len(out) >= 512:
                    yield flush()
        if out:
            yield flush()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return fingerprints(table(spark, sf_dir, "documents"))
