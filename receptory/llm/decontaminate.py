"""Benchmark decontamination by suffix arrays over shards of the training texts.

Every slice of documents is a shard.  Its words are numbered by the
benchmark's vocabulary, a suffix array is built over all positions that can
match a test suffix at all (words unknown to the benchmark end every match),
and every suffix of every benchmark item is binary-searched in it, one word
of depth at a time.  The last range that is not empty holds the locations of
the suffix's longest verbatim match; the range at the depth of a window holds
all occurrences of that window.

Words are looked up by 64-bit hashes and then compared byte by byte, so a match
is verbatim.  The benchmark is taken to the executors in blocks of a bounded
number of bytes; each row passes all blocks one after another, within its task,
and is decided by itself: nothing is joined, grouped or shuffled.

Edge cases: null and empty texts have no words and no hits; an item without
words matches nothing; a shorter item than a window is one window; a null
item_id counts as an item with an empty name; repeated items count once;
repeated documents are each reported; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receptory.llm.common import ALPHANUMERIC, BYTE_WEIGHT, LOWER, prefix_hashes, row_starts, slices, span_hashes, spread, table, text_bytes, text_column, word_spans

#: Words of a window.
WINDOW = 10
#: Benchmark text bytes that are held and sent at once.
BLOCK_BYTES = 8 << 20


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all rows' words, A-Z lower-cased, and each row's number of words."""
    data, offsets = text_bytes(array)
    low = LOWER[data]
    starts, ends, counts = word_spans(low, offsets, ALPHANUMERIC)
    return span_hashes(prefix_hashes(BYTE_WEIGHT[low]), starts, ends), counts


def word_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all rows, A-Z lower-cased, and starts and ends of their words."""
    data, offsets = text_bytes(array)
    low = LOWER[data]
    starts, ends, _ = word_spans(low, offsets, ALPHANUMERIC)
    return low, starts, ends


def with_ends(words: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Rows' words with an end mark after each row."""
    at = np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)
    out = np.full(len(words) + len(counts), end, np.int32)
    out[at] = words
    return out


@dataclass
class Benchmark:
    """A block of items: sorted vocabulary of word hashes and the words' bytes, items' word numbers with end marks (-2), suffix starts, items."""

    vocabulary: np.ndarray
    letters: np.ndarray
    letter_starts: np.ndarray
    words: np.ndarray
    suffixes: np.ndarray
    item_of: np.ndarray
    left: np.ndarray
    names: list[str]
    window: int

    @classmethod
    def of(cls, names: list[str], texts: list[str], window: int) -> Benchmark:
        array = pa.array(texts, pa.string())
        hashes, counts = word_hashes(array)
        low, begin, end = word_bytes(array)
        vocabulary, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
        size = (end - begin)[first]
        letters = low[np.repeat(begin[first], size) + spread(size)]
        starts = row_starts(counts + 1)[:-1]
        out = cls(vocabulary, letters, row_starts(size), with_ends(numbers, counts, -2), np.repeat(starts, counts) + spread(counts), np.repeat(np.arange(len(names)), counts), np.repeat(counts, counts) - spread(counts), names, window)
        if (out.numbers(hashes, low, begin, end) < 0).any():
            raise ValueError("two words of the benchmark have one hash")
        return out

    def numbers(self, hashes: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of words, given by hash and bytes, in the vocabulary; -1 of others."""
        known = np.full(len(hashes), -1, np.int64)
        if len(self.vocabulary):
            near = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            size = end - begin
            known = np.where((self.vocabulary[near] == hashes) & (np.diff(self.letter_starts)[near] == size), near, -1)
            at = np.flatnonzero(known >= 0)
            inside = spread(size[at])
            differ = low[np.repeat(begin[at], size[at]) + inside] != self.letters[np.repeat(self.letter_starts[known[at]], size[at]) + inside]
            if differ.any():
                known[np.repeat(at, size[at])[differ]] = -1
        return known

    def lengths(self) -> np.ndarray:
        """Of each suffix the words of its window, 0 where none starts there."""
        whole = np.zeros(len(self.names), np.int64)
        np.maximum.at(whole, self.item_of, self.left)
        size = np.minimum(whole[self.item_of], self.window)
        return np.where(self.left >= size, size, 0)


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Positions of known words (number >= 0), sorted by what follows up to depth words or the first end mark (-1).

    Prefix doubling; in each round only positions are sorted again that still
    share their rank and have not met an end mark.
    """
    places = np.flatnonzero(sequence >= 0)
    rank = np.zeros(len(sequence) + 1, np.int64)
    first = np.concatenate([sequence[1:], [-1]])[places].astype(np.int64) + 1
    key = sequence[places].astype(np.int64) << 32 | first
    order = np.argsort(key)
    places, key = places[order], key[order]
    new = np.ones(len(places), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    group = starts[np.cumsum(new) - 1]
    rank[places] = group + 1
    size = np.diff(np.append(starts, len(places)))
    active = np.flatnonzero((np.repeat(size, size) > 1) & ((key & 0xFFFFFFFF) > 0))
    reach = 2
    while len(active) and reach < depth:
        follow = rank[np.minimum(places[active] + reach, len(sequence))]
        order = np.lexsort((follow, group[active]))
        inside, follow = places[active][order], follow[order]
        slots = active  # groups are whole or end-marked throughout, so their slots stay theirs
        own = group[active]
        places[slots] = inside
        new = np.ones(len(slots), bool)
        new[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])
        starts = np.flatnonzero(new)
        group[slots] = slots[starts][np.cumsum(new) - 1]
        rank[inside] = group[slots] + 1
        size = np.diff(np.append(starts, len(slots)))
        active = slots[(np.repeat(size, size) > 1) & (follow > 0)]
        reach *= 2
    return places


def narrow(sequence: np.ndarray, suffixes: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each range [low, high) of the suffix array, those whose word at depth is the wanted one."""

    def bound(after: int) -> np.ndarray:
        a, b = low.copy(), high.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            middle = (a[live] + b[live]) >> 1
            right = sequence[np.minimum(suffixes[middle] + depth, len(sequence) - 1)] < wanted[live] + after
            a[live[right]] = middle[right] + 1
            b[live[~right]] = middle[~right]
            live = live[a[live] < b[live]]
        return a

    return bound(0), bound(1)


@dataclass
class Matches:
    """Of one shard: its words by number, hit marks a word, (row, item) pairs of windows that occur, and longest matches of suffixes."""

    sequence: np.ndarray
    counts: np.ndarray
    hit: np.ndarray
    pair_rows: np.ndarray
    pair_items: np.ndarray
    suffix: np.ndarray
    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    places: np.ndarray


def search(bench: Benchmark, texts: pa.Array) -> Matches:
    """Binary-search every test suffix in the shard's suffix array."""
    hashes, counts = word_hashes(texts)
    sequence = with_ends(bench.numbers(hashes, *word_bytes(texts)), counts, -1)
    places = suffix_array(sequence, int(bench.left.max(initial=0)))
    n = len(bench.suffixes)
    low, high = np.zeros(n, np.int64), np.full(n, len(places))
    length, last_low, last_high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = bench.lengths()
    edges = np.zeros(len(sequence) + 1, np.int64)
    row_of = np.repeat(np.arange(len(counts)), counts + 1)
    pair_keys = [np.zeros(0, np.int64)]
    live, depth = np.arange(n), 0
    while len(live):
        live = live[bench.left[live] > depth]
        a, b = narrow(sequence, places, low[live], high[live], depth, bench.words[bench.suffixes[live] + depth])
        found = a < b
        live, a, b = live[found], a[found], b[found]
        low[live], high[live] = a, b
        depth += 1
        length[live], last_low[live], last_high[live] = depth, a, b
        whole = live[size[live] == depth]
        if len(whole):
            ranges, which = np.unique(np.stack([low[whole], high[whole]]), axis=1, return_inverse=True)
            wide = ranges[1] - ranges[0]
            at = places[np.repeat(ranges[0], wide) + spread(wide)]
            edges += np.bincount(at, minlength=len(edges)) - np.bincount(at + depth, minlength=len(edges))
            for_range = np.unique(np.repeat(np.arange(len(wide)), wide) << 32 | row_of[at])
            cuts = np.searchsorted(for_range >> 32, np.arange(len(wide) + 1))
            rows_in = np.diff(cuts)
            of = np.unique(which.ravel().astype(np.int64) << 32 | bench.item_of[whole])
            spans = rows_in[of >> 32]
            rows = for_range[np.repeat(cuts[:-1][of >> 32], spans) + spread(spans)] & 0xFFFFFFFF
            pair_keys.append(np.unique(rows << 32 | np.repeat(of & 0xFFFFFFFF, spans)))
    pairs = np.unique(np.concatenate(pair_keys))
    matched = np.flatnonzero(length)
    return Matches(sequence, counts, np.cumsum(edges)[:-1] > 0, pairs >> 32, pairs & 0xFFFFFFFF, matched, length[matched], last_low[matched], last_high[matched], places)


def blocks_of(benchmark: DataFrame, id_column: str, text: str, window: int, limit: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about limit bytes of text; the driver holds one at a time."""
    names, texts, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"), text_column(text)).toLocalIterator():
        names.append(row.name)
        texts.append(row.text)
        size += len(row.text.encode())
        if size >= limit:
            yield Benchmark.of(names, texts, window)
            names, texts, size = [], [], 0
    if names or not size:
        yield Benchmark.of(names, texts, window)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least_words: int = WINDOW, id_column: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each benchmark suffix's longest verbatim matches of least_words or more in each shard, with all their locations.

    Matches that begin inside a longer one, at the word after another's, are left out.
    """
    kind, out = docs.schema[id_column].dataType.simpleString(), None
    source = docs.select(F.col(id_column), text_column())
    for bench in blocks_of(benchmark, "item_id", "text", WINDOW, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value
            own = bench.suffixes - row_starts(np.bincount(bench.item_of, minlength=len(bench.names)) + 1)[bench.item_of]
            for batch in slices(batches):
                found = search(bench, batch.column(1))
                wide = found.high - found.low
                at = found.places[np.repeat(found.low, wide) + spread(wide)]
                suffix, words = np.repeat(found.suffix, wide), np.repeat(found.length, wide)
                before = bench.words[np.maximum(bench.suffixes[suffix] - 1, 0)]
                inside = (own[suffix] > 0) & (at > 0) & (found.sequence[np.maximum(at - 1, 0)] == before)
                keep = (words >= least_words) & ~inside
                at, suffix, words = at[keep], suffix[keep], words[keep]
                base = row_starts(found.counts + 1)
                row = np.searchsorted(base, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([bench.names[i] for i in bench.item_of[suffix]], pa.string()), pa.array(own[suffix]), pa.array(at - base[row]), pa.array(words)], [id_column, "item_id", "item_word", "doc_word", "n_words"])

        one = source.mapInArrow(run, f"`{id_column}` {kind}, item_id string, item_word long, doc_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def _joined(old: pa.Array, rows: np.ndarray, values: pa.Array) -> pa.Array:
    """The lists of each row with further values, given by row, behind them."""
    n = len(old)
    sizes = np.array([len(x) for x in old.to_pylist()], np.int64) if n else np.zeros(0, np.int64)
    whole = np.concatenate([np.repeat(np.arange(n), sizes), rows])
    order = np.argsort(whole, kind="stable")
    cuts = np.searchsorted(whole[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.concat_arrays([old.flatten(), values]).take(pa.array(order)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: n_words, spans of hit words as [start, end) structs, items whose windows occur (each name once, sorted), n_hit."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("key"), text_column(), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for bench in blocks_of(benchmark, "item_id", "text", window, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(bench)  # at most a block and what its words need

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = search(sent.value, batch.column(1))
                base = row_starts(found.counts + 1)
                step = np.diff(found.hit.astype(np.int8), prepend=0, append=0)
                first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                row = np.searchsorted(base, first, "right") - 1
                spans = _joined(batch.column(3), row, pa.array((first - base[row]) << 32 | (last - base[row])))
                items = _joined(batch.column(4), found.pair_rows, pa.array([sent.value.names[i] for i in found.pair_items], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.counts), spans, items], ["key", "text", "n_words", "spans", "items"])

        rows = rows.mapInArrow(run, f"key {kind}, text string, n_words long, spans array<long>, items array<string>")
    union = F.expr(
        "aggregate(array_sort(transform(spans, x -> struct(shiftright(x, 32) as a, (x & 4294967295) as b))), "
        "named_struct('n', 0L, 'reach', 0L), "
        "(s, x) -> named_struct('n', s.n + greatest(0L, x.b - greatest(x.a, s.reach)), 'reach', greatest(s.reach, x.b)), s -> s.n)"
    )
    return rows.select(
        F.col("key").alias(id_column),
        "n_words",
        union.alias("n_hit"),
        F.expr("array_sort(transform(spans, x -> struct(shiftright(x, 32) as first, (x & 4294967295) as last)))").alias("spans"),
        F.array_sort(F.array_distinct("items")).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id") -> DataFrame:
    """docs without the rows in whose text a benchmark window occurs; clean rows and their columns stay as they are.

    One pass over the rows: the decision is made in place and nothing is joined.
    Benchmarks of several blocks take one pass a block.
    """
    for bench in blocks_of(benchmark, "item_id", "text", window, BLOCK_BYTES):
        sent = docs.sparkSession.sparkContext.broadcast(bench)
        at = docs.columns.index("text")

        def run(batches: Iterable[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = batch.column(at)
                filled = texts.fill_null("") if texts.null_count else texts
                found = search(sent.value, filled)
                keep = np.ones(batch.num_rows, bool)
                keep[found.pair_rows] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table against all benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
with lowered as (
  select doc_id, row_number() over () as rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select coalesce(cast(item_id as varchar), '') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from items where len(w) > 0)),
sizes as (select distinct size from windows),
grams as (
  select rid, size, p, array_to_string(w[p : p + size - 1], ' ') as gram
  from (select rid, w, size, unnest(range(1, len(w) - size + 2)) as p from lowered, sizes where len(w) >= size)),
found as (select rid, p, g.size, item_id from grams g join windows using (size, gram)),
hits as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + size)) as q from found) group by rid),
named as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct rid, item_id from found) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lowered left join hits using (rid) left join named using (rid)
"""
