"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles.  Sizes from one power of two to the
next form a band.  In its band a set is XOR-hashed into a bit sketch of blocks,
more of them than the largest symmetric difference that a linked pair there can
have.  A differing token flips one bit, so the sketches' Hamming distance is at
most the symmetric difference, and the other blocks are equal (pigeonhole).
Blocks are put in one order for all sets, those of many tokens first; linked
sets then already share a block, and a few more to spare, among as many of
their first blocks as may differ, and only those become join keys.  A set whose
linked partners can lie in the next band is given keys there too.

Equal sets are one class from the start: one document of each makes keys.  Of a
key's sets the least leads and is compared with the others; where a key's sets
are then still in different components, those whose sketches are near enough
are brought together and compared.  A pair is compared by a second sketch of
two to four bits a shingle first, whose Hamming distance is a lower bound as
well; only texts of pairs that pass it are moved, made sets again and verified
by their exact intersection.

A key of more than HOT sets is left out for a set that has no more of those
keys than the blocks to spare: each of its links has another key.

Edge cases: null and empty texts and texts without words have an empty set,
link with nothing, and are their own component; a text of fewer words than a
shingle has one shingle of all of them; repeated rows are linked as copies; a
null doc_id is reported as such and is never the smallest of a component with
other ids; other columns are not read, or passed on by one_of_each.  doc_id is
an integer column: other text in it is an error.  Sets are compared by 64-bit
hashes of their shingles, classes by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from receptory.llm.bits import bitmap, marked
from receptory.llm.common import BYTE_WEIGHT, LOWER, NOT_SPACE, U64, discard, mix, prefix_hashes, row_starts, slices, small_batches, span_hashes, spread, stored, table, text_bytes, text_column, tidy, word_spans
from receptory.llm.components import components

#: Words of a shingle; a pair links when LINK[1] * intersection >= LINK[0] * union.
SHINGLE, LINK = 3, (90, 100)
#: Bytes of a part of a family, or of a key's sketches, that is compared at once.
TILE_BYTES = 4 << 20
#: Most bits of the bitmaps that spare rows work; they never decide a result.
FILTER_BITS = 28
#: Members that one copy of a leader's text is compared with; sets above which a key is hot.
LEADER_SHARE, HOT = 1000, 1000
#: Text bytes that are made shingles at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class Bands:
    """Band k holds sizes from 2**k; blocks[k] are the sketch's blocks there, spare[k] the equal blocks beyond the first."""

    link: tuple[int, int]
    blocks: np.ndarray
    spare: np.ndarray

    @classmethod
    def of(cls, link: tuple[int, int], bands: int = 40) -> Bands:
        start = np.int64(1) << np.arange(bands)
        spare = np.minimum(8, start // 64)
        apart = cls(link, start, spare).apart(2 * start - 1)
        return cls(link, np.where(apart > 0, (5 * (apart + 1 + spare) + 3) // 4, 1), np.where(apart > 0, spare, 0))

    def apart(self, sizes: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of a set of this size and one it links with."""
        low, high = self.link
        return (high - low) * (sizes + sizes * high // low) // (high + low)

    @staticmethod
    def own(sizes: np.ndarray) -> np.ndarray:
        return np.frexp(np.maximum(sizes, 1).astype(np.float64))[1].astype(np.int64) - 1


def shingle_sets(array: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the rows' distinct shingles, sorted by row and hash."""
    data, offsets = text_bytes(array)
    low = LOWER[data]
    starts, ends, counts = word_spans(low, offsets, NOT_SPACE)
    words = span_hashes(prefix_hashes(BYTE_WEIGHT[low]), starts, ends)
    size = np.minimum(counts, shingle)
    n = np.maximum(counts - size + 1, 0) * (counts > 0)
    rows = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(row_starts(counts)[:-1], n) + spread(n)
    value = np.zeros(len(first), U64)
    for i in range(shingle):
        inside = i < size[rows]
        value = np.where(inside, mix(value * U64(0xC2B2AE3D27D4EB4F) + words[np.minimum(first + i, max(len(words) - 1, 0))]), value) if len(words) else value
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    return rows[fresh], value[fresh]


def set_hashes(rows: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and order-free 64-bit hash of each row's set."""
    sizes = np.bincount(rows, minlength=n)
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(mix(value + U64(0x9E3779B97F4A7C15)), out=total[1:])
    cuts = row_starts(sizes)
    return sizes, mix(total[cuts[1:]] - total[cuts[:-1]] + sizes.astype(U64)).view(np.int64)


def xor_at(slots: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """XOR of the values of each slot; slots are sorted."""
    out = np.zeros(n, U64)
    new = np.flatnonzero(np.diff(slots, prepend=-1))
    if len(new):
        out[slots[new]] = np.bitwise_xor.reduceat(values, new)
    return out


def block_keys(rows: np.ndarray, value: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit join keys of the first sketch blocks, in the own band and, where a partner can lie there, in the next.

    A key names band, block, the block's parity bits and the XOR of its tokens;
    both are equal wherever the symmetric difference misses the block.
    """
    found_rows, found_keys = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    own, apart = bands.own(sizes), bands.apart(sizes)
    for up in (0, 1):
        band = own + up
        can = (sizes > 0) if not up else (sizes > 0) & (sizes * bands.link[1] // bands.link[0] >= np.int64(1) << band)
        count = np.where(can, bands.blocks[band], 0)
        wanted = np.minimum(apart + 1 + bands.spare[band], bands.blocks[band])
        base = row_starts(count)
        use = count[rows] > 0
        r, h = rows[use], mix(value[use] + band[rows[use]].astype(U64) * U64(0xD1342543DE82EF95))
        slot = base[r] + ((h >> U64(32)) * count[r].astype(U64) >> U64(32)).astype(np.int64)
        tokens = np.bincount(slot, minlength=base[-1])
        order = np.argsort(slot)
        slot, h = slot[order], h[order]
        parity, sums = xor_at(slot, U64(1) << (h & U64(63)), base[-1]), xor_at(slot, h, base[-1])
        row = np.repeat(np.arange(len(sizes)), count)
        key = mix(mix(parity ^ mix(sums)) + (band[row].astype(U64) << U64(32) | spread(count).astype(U64)))
        order = np.lexsort((key, -tokens, row))
        picked = order[spread(count) < wanted[row]]
        found_rows.append(row[picked])
        found_keys.append(key[picked])
    return np.concatenate(found_rows), np.concatenate(found_keys)


def sketches(rows: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the rows' parity sketches of two to four bits a shingle, 64 at least, and each row's number of words."""
    words = np.where(sizes > 0, np.maximum(1, np.int64(1) << np.maximum(Bands.own(sizes) - 4, 0)), 0)
    place = value & (words[rows].astype(U64) * U64(64) - U64(1))
    slot = row_starts(words)[rows] + (place >> U64(6)).astype(np.int64)
    order = np.argsort(slot)
    return xor_at(slot[order], (U64(1) << (place & U64(63)))[order], int(words.sum())), words


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A sketch brought to n words: the sketch the set has at that width."""
    return words if len(words) == n else np.bitwise_xor.reduce(words.reshape(-1, n), axis=0)


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    raw = values.astype("<u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32).tobytes()), pa.py_buffer(raw)])


def sized(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            rows, value = shingle_sets(batch.column(1), shingle)
            sizes, ids = set_hashes(rows, value, batch.num_rows)
            words, n = sketches(rows, value, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(ids), _binaries(words, row_starts(n))], ["doc_id", "n_shingles", "set_id", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).mapInArrow(run, "doc_id long, n_shingles long, set_id long, sketch binary")


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    h = mix(values.view(U64)) >> U64(64 - int(len(bits) * 64).bit_length() + 1)
    return (bits[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1


def bitmap_of(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the long values, null as 0: 16 bits a value, up to 2**FILTER_BITS; each task sends its own bits only."""
    size = min(FILTER_BITS, max(16, (16 * values.count()).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mix(batch.column(0).to_numpy().view(U64)) >> U64(64 - size)
            word = (h >> U64(6)).astype(np.int32)
            order = np.argsort(word)
            word, bit = word[order], (U64(1) << (h & U64(63)))[order]
            new = np.flatnonzero(np.diff(word, prepend=-1))
            if len(new):
                yield pa.RecordBatch.from_arrays([pa.array(word[new]), pa.array(np.bitwise_or.reduceat(bit, new).view(np.int64))], ["word", "bits"])

    got = values.select(F.coalesce(column, F.lit(0)).alias("v")).mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), U64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U64)
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def sketched(docs: DataFrame, link: tuple[int, int], shingle: int, holders: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, set_id) of the blocks of rows whose doc_id may hold a set; all keys, or those that may be wanted."""
    bands = Bands.of(link)
    sent = docs.sparkSession.sparkContext.broadcast((holders, wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keep_keys = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(own, _ids(batch.column(0)))))
            for part in slices([batch], limit=SLICE):
                rows, value = shingle_sets(part.column(1), shingle)
                sizes, ids = set_hashes(rows, value, part.num_rows)
                row, keys = block_keys(rows, value, sizes, bands)
                if keep_keys is not None:
                    keep = in_bitmap(keep_keys, keys)
                    row, keys = row[keep], keys[keep]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[row])], ["key", "set_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).mapInArrow(run, "key long, set_id long")


def texts_of(docs: DataFrame, wanted: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """(set_id, text) of each wanted set_id, from one document that has it; other documents are not even split into words."""
    held = stored(sets.select("set_id", "holder").join(wanted.distinct(), "set_id", "left_semi"), "held")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(held, "holder"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(sent.value, _ids(batch.column(0)))))
            for part in slices([batch], limit=SLICE):
                rows, value = shingle_sets(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(set_hashes(rows, value, part.num_rows)[1]), part.column(1)], ["doc_id", "set_id", "text"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).mapInArrow(run, "doc_id long, set_id long, text string").alias("m")
    joined = made.join(held.alias("h"), (F.col("m.set_id") == F.col("h.set_id")) & F.col("m.doc_id").eqNullSafe(F.col("h.holder")))
    out = stored(joined.groupBy("m.set_id").agg(F.min("m.text").alias("text")), "texts")
    discard(held)
    return out


def near(pairs: DataFrame, sets: DataFrame, link: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    low, high = link

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = high * np.minimum(m, n) >= low * np.maximum(m, n)
            limit = (high - low) * (m + n) // (high + low)
            for i in np.flatnonzero(keep):
                x, y = (np.frombuffer(batch.column(j)[int(i)].as_buffer(), "<u8") for j in (4, 5))
                width = min(len(x), len(y))
                keep[i] = np.bitwise_count(folded(x, width) ^ folded(y, width)).sum() <= limit[i]
            yield batch.select([0, 1]).filter(pa.array(keep))

    side = lambda k: sets.select(F.col("set_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def links_within(left: np.ndarray, right: np.ndarray, link: tuple[int, int]) -> bool:
    """Whether two sorted sets link."""
    small, big = (left, right) if len(left) <= len(right) else (right, left)
    if link[1] * len(small) < link[0] * len(big):
        return False
    at = np.minimum(np.searchsorted(big, small), len(big) - 1)
    shared = int((big[at] == small).sum())
    return link[1] * shared >= link[0] * (len(small) + len(big) - shared)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, link: tuple[int, int] = LINK, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of set ids that link.

    A leader's text and its members' texts meet in one partition, one after
    another; leaders of many members are dealt to several, each with a copy of
    the leader's text.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_SHARE).cast("int").alias("shares"))
    members = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.col("b").alias("set_id"))
    leaders = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("set_id"))
    need = stored(members.unionByName(leaders), "need")
    texts = texts_of(docs, need.select("set_id"), sets, shingle)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, U64)
        for batch in slices(batches, "text", SLICE):
            rows, value = shingle_sets(batch.column(2), shingle)
            cuts, out = np.searchsorted(rows, np.arange(batch.num_rows + 1)), []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                this = value[cuts[i] : cuts[i + 1]]
                if a == b:
                    leader, own = a, this
                elif a == leader and links_within(own, this, link):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    dealt = need.join(texts, "set_id").repartition("a", "share").sortWithinPartitions("a", "share", F.col("set_id") != F.col("a")).select("a", "set_id", "text")
    found = stored(dealt.mapInArrow(run, "a long, b long"), "links")
    discard(need, texts)
    return found


def local_links(part: np.ndarray | None, label: np.ndarray, size: np.ndarray, bits: np.ndarray, link: tuple[int, int], test) -> list[tuple[int, int]]:
    """Pairs of places in different labels whose sizes and sketches allow a link and that pass the test; each makes their labels one.

    part, if given, holds 0 or 1 of two parts: pairs are then taken across them only.
    """
    order = np.argsort(size, kind="stable")
    size, bits, label = size[order], bits[order], np.unique(label[order], return_inverse=True)[1]
    side = None if part is None else part[order]
    top, out = np.searchsorted(size, size * link[1] // link[0], "right"), []
    for i in range(len(size)):
        at = np.arange(i + 1, top[i])
        at = at[label[at] != label[i]]
        if side is not None:
            at = at[side[at] != side[i]]
        if not len(at):
            continue
        at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(1) <= (link[1] - link[0]) * (size[at] + size[i]) // (link[1] + link[0])]
        for j in at:
            if label[i] != label[j] and test(order[i], order[j]):
                out.append((order[i], order[j]))
                label[label == label[j]] = label[i]
    return out


def tiled(rows: DataFrame, group: str, weight) -> DataFrame:
    """Rows of each group cut into parts of TILE_BYTES; a row goes to each tile (x, y) of two parts that its own is one of."""
    parts = rows.groupBy(group).agg(F.ceil(F.sum(weight) / TILE_BYTES).cast("int").alias("parts"))
    rows = rows.join(parts, group).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    return rows.withColumn("with", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("x", F.least("part", "with")).withColumn("y", F.greatest("part", "with")).drop("parts", "with")


def _edges(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def candidate_forest(members: DataFrame, sets: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Edges (a, b) that hold together, within each key, the sets of different labels whose sketches allow a link.

    Of a key's allowed pairs only a spanning forest is returned.  Keys with the
    same members are looked at once.
    """
    same = members.groupBy("key").agg(F.bit_xor(F.xxhash64("set_id")).alias("sum"), F.count("*").alias("n")).groupBy("sum", "n").agg(F.min("key").alias("key"))
    rows = members.join(same.select("key"), "key").join(sets.select("set_id", "n_shingles", "sketch"), "set_id").select("key", "set_id", "label", "n_shingles", "sketch")
    tiles = tiled(rows, "key", F.length("sketch") + 64).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").select("key", "x", "y", "part", "set_id", "label", "n_shingles", "sketch")

    def compared(x: int, y: int, tile: pa.Table) -> list[tuple]:
        raw = [np.frombuffer(v.as_buffer(), "<u8") for v in tile.column("sketch").combine_chunks()]
        width = min(map(len, raw))
        ids, part = tile.column("set_id").to_numpy(), tile.column("part").to_numpy()
        pairs = local_links(None if x == y else (part == y).astype(int), tile.column("label").to_numpy(), tile.column("n_shingles").to_numpy(), np.stack([folded(v, width) for v in raw]), link, lambda i, j: True)
        return [(ids[i], ids[j]) for i, j in pairs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            names = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(0)])) if batch.num_rows else np.zeros(0, int)
            out = []
            for at, end in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=False):
                own = tuple(names[:, at].tolist())
                if own != name and held:
                    out += compared(*name[1:], pa.Table.from_batches(held))
                    held = []
                name = own
                held.append(batch.slice(at, end - at))
            yield _edges(out)
        if held:
            yield _edges(compared(*name[1:], pa.Table.from_batches(held)))

    return tiles.mapInArrow(run, "a long, b long")


def tiled_links(members: DataFrame, texts: DataFrame, link: tuple[int, int] = LINK, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) that join the labels within each family of (family, set_id, label).

    Each pair of a family's parts is one task's work; there pairs of different
    labels whose sketches allow it are verified, and a link makes their labels
    one.  So a task returns fewer links than it has sets.
    """
    tiles = tiled(members.join(texts, "set_id"), "family", F.length("text") + 512).select("family", "x", "y", "part", "set_id", "label", "text")

    def run(tile: pa.Table) -> pa.Table:
        x, y = tile.column("x")[0].as_py(), tile.column("y")[0].as_py()
        text = tile.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        rows, value = shingle_sets(text, shingle)
        size = np.bincount(rows, minlength=len(text))
        cuts, ids = row_starts(size), tile.column("set_id").to_numpy()
        sets = [value[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        width = 1 << max(5, min(7, int(size.max(initial=1)).bit_length() - 5))
        place = value & U64(width * 64 - 1)
        slot = rows * width + (place >> U64(6)).astype(np.int64)
        order = np.argsort(slot)
        bits = xor_at(slot[order], (U64(1) << (place & U64(63)))[order], len(size) * width).reshape(-1, width)
        side = None if x == y else (tile.column("part").to_numpy() == y).astype(int)
        pairs = local_links(side, tile.column("label").to_numpy(), size, bits, link, lambda i, j: links_within(sets[i], sets[j], link))
        return pa.Table.from_batches([_edges([(ids[i], ids[j]) for i, j in pairs])])

    return tiles.groupBy("family", "x", "y").applyInArrow(run, "a long, b long")


def set_links(docs: DataFrame, sets: DataFrame, link: tuple[int, int] = LINK, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) over set ids that are linked with another set."""
    holders = bitmap_of(sets, "holder")
    keys = sketched(docs, link, shingle, holders)
    shared = stored(keys.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"), F.count("*").alias("n")).where("low <> high"), "keys")
    many = shared.where("n > 2").select("key", "n")
    found = sketched(docs, link, shingle, holders, bitmap_of(many, "key")).distinct().join(many, "key")
    found = stored(found.select("key", "set_id", "n"), "members")
    members = found
    hot = found.where(F.col("n") > HOT).groupBy("set_id").agg(F.count("*").alias("hot"))
    if hot.limit(1).count():
        spare = F.expr("least(8L, shiftleft(1L, length(bin(n_shingles)) - 1) div 64L)")  # as in Bands, of the set's own band
        bare = hot.join(sets.select("set_id", "n_shingles"), "set_id").where(F.col("hot") <= spare).select("set_id")
        members = found.where(F.col("n") <= HOT).unionByName(found.where(F.col("n") > HOT).join(bare, "set_id", "left_anti"))
    members = members.select("key", "set_id")
    leader = members.groupBy("key").agg(F.min("set_id").alias("leader"))
    led = members.join(leader, "key").where("set_id <> leader").select(F.col("leader").alias("a"), F.col("set_id").alias("b"))
    pairs = stored(near(shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(led).distinct(), sets, link), "pairs")
    links = verified(pairs, docs, sets, link, shingle)
    labels = stored(components(links), "labels")
    discard(shared, pairs)
    labelled = members.join(labels, F.col("set_id") == F.col("node"), "left").select("key", "set_id", F.coalesce("component", "set_id").alias("label"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    rest = stored(labelled.join(apart, "key"), "apart")
    forest = stored(candidate_forest(rest, sets, link), "forest")
    if not forest.limit(1).count():
        discard(found, links, rest, forest)
        return labels
    own = rest.select("set_id", "label").distinct()
    family = components(forest.unionByName(own.select(F.col("set_id").alias("a"), F.col("label").alias("b"))))
    whole = family.join(forest.select(F.col("a").alias("node")).distinct(), "node").select("component").distinct()
    kin = own.join(family.join(whole, "component"), F.col("set_id") == F.col("node")).select(F.col("component").alias("family"), "set_id", "label")
    kin = stored(kin, "families")
    texts = texts_of(docs, kin.select("set_id"), sets, shingle)
    more = stored(tiled_links(kin, texts, link, shingle), "more")
    joined = stored(components(links.unionByName(more)), "labels")
    discard(found, links, rest, forest, labels, kin, texts, more)
    return joined


def set_components(docs: DataFrame, link: tuple[int, int], shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, label) of every row; rows of linked sets share a label."""
    with small_batches(docs.sparkSession):
        known = stored(sized(docs, shingle), "sizes")
        sets = stored(known.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("holder"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")), "sets")
        labels = set_links(docs, sets, link, shingle)
        discard(sets)
        tidy(docs.sparkSession)
    return known.join(labels, F.col("set_id") == F.col("node"), "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component", "set_id").alias("label"))


def near_duplicates(docs: DataFrame, link: tuple[int, int] = LINK, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    rows = set_components(docs, link, shingle)
    least = rows.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("label").alias("group"), "least")
    joined = rows.join(least, (F.col("label") == F.col("group")) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, link: tuple[int, int] = LINK, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, and of the least set and row among equal ids.

    Decided by row, not by doc_id alone: rows of one id with different texts
    stay or go on their own, and of rows that are repeated one stays.  A null
    doc_id comes last.  Rows without words all stay.
    """
    rows = set_components(docs, link, shingle).where("n_shingles > 0").groupBy("label", "doc_id", "set_id").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id")
    best = rows.groupBy("label").agg(F.min(rank).alias("best"))
    judged = stored(rows.join(best, "label").select("doc_id", "set_id", (rank == F.col("best")).alias("stays"), "n").where("not stays or n > 1"), "judged")
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns])
    source = marked(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_column()), "doc_id", bitmap(judged, "doc_id"))

    def with_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            ids = set_hashes(*shingle_sets(batch.column(2), shingle), batch.num_rows)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids)], ["row", "doc_id", "set_id"])

    some = source.where("perhaps").select("row", "doc_id", "text")
    kind = StructType([some.schema["row"], some.schema["doc_id"], StructField("set_id", LongType())])
    with small_batches(docs.sparkSession):
        tried = stored(some.mapInArrow(with_sets, kind), "perhaps")
    told = judged.select(F.col("doc_id").alias("j_doc"), F.col("set_id").alias("j_set"), "stays")
    tried = tried.join(told, F.col("doc_id").eqNullSafe(F.col("j_doc")) & (F.col("set_id") == F.col("j_set")), "left")
    single = tried.where("stays is null").select("row")
    first = tried.where("stays").groupBy("doc_id", "set_id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return source.where("not perhaps").select("row").unionByName(single).unionByName(first).select("row.*")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive w as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct rid, hash(array_to_string(w[p : p + least(len(w), 3) - 1], ' ')) as g
  from (select rid, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) as p from w where len(w) > 0)),
n as (select rid, count(*) as n from s group by rid),
pairs as (
  select a.rid as a, b.rid as b, count(*) as shared from s a join s b on a.g = b.g and a.rid <> b.rid group by a.rid, b.rid),
links as (
  select a, b from pairs join n x on x.rid = a join n y on y.rid = b where 100 * shared >= 90 * (x.n + y.n - shared)),
reach as (
  select rid as root, rid as node from w
  union
  select root, b from reach join links on node = a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least_id as component_id
from w left join n using (rid) join (select root, min(d.doc_id) as least_id from reach join w d on d.rid = node group by root) r on r.root = w.rid
"""
