"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are split by the tokenizer's pattern.  The distinct pieces of a slice
are put, by length, into padded matrices of token ids, one row a piece.  In
every round each row merges its leftmost pair of least rank; pairs are found
in an open-addressing hash table.  Each live row loses exactly one column a
round, so the matrix is compacted by one reshape; finished rows leave it.  A
piece of more than LONG bytes is a matrix of its own, cut into rows of BLOCK
pairs with the least rank of each: a round looks at the rows' least ranks and at
one row, links over what was merged, and compaction comes once, at the end.  So
a round costs far less than the piece's length, and a piece of a megabyte, which
has up to a million rounds, some ten seconds.

Edge cases: a null or empty text has no tokens and decodes to no bytes;
repeated rows are encoded each; the id column may have any type; other columns
of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receptory.llm.common import release, row_starts, slices, spread, table, text_column

NONE = np.iinfo(np.int32).max
#: Distinct pieces kept by a worker before its memory of them is emptied.
KEPT_PIECES = 200_000
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 18
#: Bytes of a piece above which it is merged by itself; pairs in a row of it.
LONG, BLOCK = 2048, 512


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class ByteBpe:
    """Encoder and decoder for one set of ranks; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        self._build(np.array(keys, np.int64), np.array(merged, np.int32))
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_starts = row_starts(np.array([len(x) for x in tokens], np.int64))
        self.ids: dict[str, int] = {}
        self.kept: list[np.ndarray] = []
        self.filled = 0
        self._flat()

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table_keys = np.full(1 << bits, -1, np.int64)
        self.table_values = np.full(1 << bits, NONE, np.int32)
        self.probes = 0
        left = np.arange(len(keys))
        while len(left):
            slots = (self._slot(keys[left]) + self.probes) & self.mask
            free = self.table_keys[slots] == -1
            _, winners = np.unique(np.where(free, slots, -1 - left), return_index=True)
            winners = winners[free[winners]]
            self.table_keys[slots[winners]] = keys[left[winners]]
            self.table_values[slots[winners]] = values[left[winners]]
            left = np.delete(left, winners)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none or a side is padding (-1)."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys = np.where((a < 0) | (b < 0), -2, keys).ravel()
        out = np.full(keys.shape, NONE, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        for probe in range(self.probes):
            at = (slots[left] + probe) & self.mask
            found = self.table_keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.table_values[at[hit]]
            left = left[~hit & (found != -1)]
            if not len(left):
                break
        return out.reshape(a.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        order = np.argsort(lengths, kind="stable")
        for i in order[lengths[order] > LONG]:
            out[i] = self._merge_long(pieces[i])
        order = order[(lengths[order] > 0) & (lengths[order] <= LONG)]
        bucket = np.ceil(np.log2(np.maximum(lengths[order], 1))).astype(int)
        for group in np.split(order, np.flatnonzero(np.diff(bucket)) + 1) if len(order) else []:
            rows = max(1, MATRIX_CELLS // int(lengths[group[-1]]))
            for at in range(0, len(group), rows):
                self._merge(group[at : at + rows], lengths, pieces, out)
        return out

    def _merge(self, rows: np.ndarray, lengths: np.ndarray, pieces: list[bytes], out: list[np.ndarray]) -> None:
        own = lengths[rows]
        matrix = np.full((len(rows), int(own.max())), -1, np.int32)
        matrix[np.arange(matrix.shape[1]) < own[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        ranks = self.pair_ranks(matrix[:, :-1], matrix[:, 1:])
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                done = best == NONE
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                for i, ids in zip(rows[done], matrix[done], strict=True):
                    out[i] = ids[ids >= 0].copy()
                if done.all():
                    return
                rows, matrix, ranks, at, best = rows[~done], matrix[~done], ranks[~done], at[~done], best[~done]
            n, width = matrix.shape
            every = np.arange(n)
            matrix[every, at] = best
            keep = np.ones((n, width), bool)
            keep[every, at + 1] = False
            matrix = matrix[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            before, after = at > 0, at < width - 2
            ranks[every[before], at[before] - 1] = self.pair_ranks(matrix[every[before], at[before] - 1], best[before])
            ranks[every[after], at[after]] = self.pair_ranks(best[after], matrix[every[after], at[after] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        ranks = np.full(-(-n // BLOCK) * BLOCK, NONE, np.int32)
        ranks[: n - 1] = self.pair_ranks(ids[:-1], ids[1:])
        rows = ranks.reshape(-1, BLOCK)
        least = rows.min(1)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            row = int(least.argmin())
            best = least[row]
            if best == NONE:
                return ids[ids >= 0]
            i = row * BLOCK + int(rows[row].argmin())
            j, h = following[i], before[i]
            k = following[j]
            ids[i], ids[j], ranks[j], following[i] = best, -1, NONE, k
            touched = {row, j // BLOCK}
            if k < n:
                before[k] = i
            left, right = ids[[h, i]], ids[[i, k if k < n else i]]
            found = self.pair_ranks(left, right)
            ranks[i] = found[1] if k < n else NONE
            if h >= 0:
                ranks[h] = found[0]
                touched.add(h // BLOCK)
            for x in touched:
                least[x] = rows[x].min()

    def _flat(self) -> None:
        self.piece_starts = row_starts(np.fromiter(map(len, self.kept), np.int64, len(self.kept)))
        self.piece_ids = np.concatenate([np.zeros(0, np.int32), *self.kept])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the texts' offsets in them."""
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.split(text)
            counts[i] = len(found)
            pieces += found
        if len(self.ids) > KEPT_PIECES:
            self.forget()
        fresh = list(set(pieces) - self.ids.keys())
        if fresh:
            self.ids.update(zip(fresh, range(len(self.ids), len(self.ids) + len(fresh)), strict=True))
            self.kept += self.encode_pieces([x.encode() for x in fresh])
            self._flat()
        numbers = np.fromiter(map(self.ids.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.piece_starts[numbers + 1] - self.piece_starts[numbers]
        ids = self.piece_ids[np.repeat(self.piece_starts[numbers], lengths) + spread(lengths)]
        return ids, row_starts(lengths)[row_starts(counts)]

    def forget(self) -> None:
        """Empty the memory of pieces: a worker stays for other tasks."""
        self.ids, self.kept = {}, []
        self._flat()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after another, and the ids' offsets in them."""
        lengths = self.token_starts[ids + 1] - self.token_starts[ids]
        return self.token_bytes[np.repeat(self.token_starts[ids], lengths) + spread(lengths)], row_starts(lengths)


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's own coder for this vocabulary, built once."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a document: id, n_tokens, ids (little-endian unsigned 32-bit; left out without with_ids), ids_sha256, decoded_sha256."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        for batch in slices(batches):
            ids, cuts = own.encode(batch.column(1).to_pylist())
            back, bytes_at = own.decode(ids)
            raw, plain = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            where = bytes_at.tolist() if len(bytes_at) < 1 << 16 else bytes_at
            columns = [batch.column(0), pa.array(np.diff(cuts)), pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]), pa.array([hashlib.sha256(plain[int(where[a]) : int(where[b])]).hexdigest() for a, b in spans])]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([bytes(raw[4 * a : 4 * b]) for a, b in spans], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        own.forget()
        release()

    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_column), text_column(text)).mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table by the public 50k byte-level vocabulary."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
