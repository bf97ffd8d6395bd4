"""Token-id files: a wavelet matrix per shard.

A shard holds the ids of consecutive documents, each closed by an end id.  Its
bytes are a header, one bit-plane per bit of the largest id, most significant
first, and a plane that marks the last id of each document, as an end id may occur
inside texts as well.  Each plane of ids has the bits of the ids in that plane's
order (zeros of the plane above before its ones).  Every plane has for each 512
bits the count of ones before them, so that access, counting (rank), finding
(select) and the bounds of documents read the compressed bytes alone.

Layout, little-endian: b"WVM2", u32 number of planes, u64 number of ids, u64 number of
documents; for each plane, and last for the document ends: u64 number of zeros, u32 counts
of ones, bits padded to 64 bytes; then the document ids, packed by zlib: i64 each, and
a byte each that is 1 for a NULL.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_batches
from .tokens import crc_of, encoded

MAGIC = b"WVM2"
BLOCK = 512
#: Ids after which a shard is closed; bounds the memory of writers and readers.
SHARD_IDS = 1 << 21
#: Text that a writer encodes at once, and pre-tokens that it remembers.
ENCODED_BYTES, REMEMBERED = 4 << 20, 500_000
#: Ids of a plane that are moved at once, so that their places stay in the processor's cache.
STRETCH = 1 << 15
_HEADER = "<4sIQQ"


def _plane(bit: np.ndarray) -> tuple[int, list[bytes]]:
    """The number of zeros and the bytes of a plane."""
    packed = np.packbits(bit, bitorder="little")
    packed = np.concatenate([packed, np.zeros(-len(packed) % 64, np.uint8)])
    ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, 8).sum(axis=1, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else np.zeros(0, np.int64)
    zeros = len(bit) - int(ones.sum())
    return zeros, [struct.pack("<Q", zeros), before.astype("<u4").tobytes(), packed.tobytes()]


def pack(ids: np.ndarray, sizes: np.ndarray | None = None, names: list | None = None) -> bytes:
    """The bytes of a shard: ``ids`` of documents one after another, their ``sizes`` (none is 0) and ids ``names``."""
    v = np.ascontiguousarray(ids, np.uint32)
    sizes = np.zeros(0, np.int64) if sizes is None else np.asarray(sizes, np.int64)
    planes = max(1, int(v.max()).bit_length()) if len(v) else 1
    v = v.astype(np.uint16) if planes <= 16 else v
    out = [struct.pack(_HEADER, MAGIC, planes, len(v), len(sizes))]
    last = np.zeros(len(v), bool)
    last[np.cumsum(sizes) - 1] = True
    for level in range(planes - 1, -1, -1):
        bit = ((v >> level) & 1).astype(bool)
        out += _plane(bit)[1]
        each = [(v[a : a + STRETCH], bit[a : a + STRETCH]) for a in range(0, len(v), STRETCH)]
        v = np.concatenate([*(x.compress(~b) for x, b in each), *(x.compress(b) for x, b in each), v[:0]])
    out += _plane(last)[1]
    names = [None] * len(sizes) if names is None else names
    return b"".join([*out, zlib.compress(np.array([n or 0 for n in names], "<i8").tobytes() + bytes(n is None for n in names), 1)])


class WaveletMatrix:
    """Reads a shard's bytes: ``access``, ``rank``, ``select``, ``ids``; ``document``, ``sizes``, ``names``."""

    def __init__(self, data: bytes):
        magic, planes, self.n, self.documents = struct.unpack_from(_HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, blocks = struct.calcsize(_HEADER), -(-self.n // BLOCK)
        self.planes = []
        for _ in range(planes + 1):
            (zeros,) = struct.unpack_from("<Q", data, at)
            before = np.frombuffer(data, "<u4", blocks, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * 64, at + 8 + 4 * blocks)
            self.planes.append((zeros, before, bits))
            at += 8 + 68 * blocks
        self.ends = self.planes.pop()
        self._names = memoryview(data)[at:]

    def names(self) -> list:
        """The ids of the documents."""
        data = zlib.decompress(self._names)
        return [None if null else n for n, null in zip(np.frombuffer(data, "<i8", self.documents).tolist(), data[8 * self.documents :], strict=True)]

    def _end(self, k: int) -> int:
        """Where the k-th document ends (after its last id), from the counts of its plane and one block's bits."""
        _, before, bits = self.ends
        block = int(np.searchsorted(before, k, "right")) - 1
        ones = np.flatnonzero(np.unpackbits(bits[block * 64 : block * 64 + 64], bitorder="little"))
        return block * BLOCK + int(ones[k - int(before[block])]) + 1

    def document(self, k: int) -> tuple[int, int]:
        """Where the k-th document begins and ends."""
        if not 0 <= k < self.documents:
            raise IndexError(k)
        return self._end(k - 1) if k else 0, self._end(k)

    def sizes(self) -> np.ndarray:
        """The sizes of all documents."""
        return np.diff(np.flatnonzero(np.unpackbits(self.ends[2], bitorder="little", count=self.n)) + 1, prepend=0)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        _, before, bits = self.planes[plane]
        if i >= self.n:
            return self.n - self.planes[plane][0]
        block, rest = divmod(i, BLOCK)
        count = int(before[block]) + int(np.bitwise_count(bits[block * 64 : block * 64 + rest // 8]).sum())
        return count + (int(bits[i // 8]) & ((1 << (rest % 8)) - 1)).bit_count()

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, (zeros, _, bits) in enumerate(self.planes):
            bit = bits[i // 8] >> (i % 8) & 1
            ones = self._ones(p, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` occurs among the first ``end`` ids."""
        a, b = self._range(token, min(end, self.n))
        return b - a

    def _range(self, token: int, end: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        a, b = 0, end
        for p, (zeros, _, _) in enumerate(self.planes):
            if token >> (len(self.planes) - 1 - p) & 1:
                a, b = zeros + self._ones(p, a), zeros + self._ones(p, b)
            else:
                a, b = a - self._ones(p, a), b - self._ones(p, b)
        return a, b

    def select(self, token: int, k: int) -> int:
        """Where ``token`` occurs for the k-th time, from 0; -1 if it occurs less often."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for p in range(len(self.planes) - 1, -1, -1):
            zeros = self.planes[p][0]
            one = token >> (len(self.planes) - 1 - p) & 1
            want = i - zeros if one else i
            lo, hi = 0, self.n - 1  # the last place with ``want`` such bits before it
            while lo < hi:
                mid = (lo + hi + 1) // 2
                ones = self._ones(p, mid)
                lo, hi = (mid, hi) if (ones if one else mid - ones) <= want else (lo, mid - 1)
            i = lo
        return i

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        order = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for p in range(len(self.planes) - 1, -1, -1):
            zeros, _, bits = self.planes[p]
            bit = np.unpackbits(bits, bitorder="little", count=self.n).astype(bool)
            order[zeros:] |= order.dtype.type(1 << (len(self.planes) - 1 - p))
            above, low, high = np.empty_like(order), 0, zeros
            for a in range(0, self.n, STRETCH):
                at, own = bit[a : a + STRETCH], above[a : a + STRETCH]
                zero, one = np.flatnonzero(~at), np.flatnonzero(at)
                own[zero], own[one] = order[low : low + len(zero)], order[high : high + len(one)]
                low, high = low + len(zero), high + len(one)
            order = above
        return order


_SHARD = "part int, shard int, n_ids long, matrix binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, close it with ``end_id`` and write shards in ascending id order to ``path``.

    NULL texts are empty; NULL ids come first; rows that repeat an id stay
    neighbours.  One range shuffle by id (and text, so that a repeated id can go to several
    tasks); a task writes its shards one by one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", F.octet_length("text"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard
            names = [x for h in held for x in h[0]]
            sizes = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            held.clear()
            shard += 1
            cols = [pa.array([part], pa.int32()), pa.array([shard - 1], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, sizes, names)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "shard", "n_ids", "matrix"])

        waiting = 0
        for batch, ids, bounds in encoded(batches, tokenizer, most=ENCODED_BYTES, remembered=REMEMBERED):
            ends = np.insert(ids, bounds[1:], end_id)
            sizes = np.diff(bounds) + 1
            names = batch.column("doc_id").to_pylist()
            upto = np.cumsum(sizes)
            a = 0
            while a < len(sizes):
                done = upto[a - 1] if a else 0
                b = int(np.searchsorted(upto, done + max(shard_ids - waiting, 1), "right"))
                b = max(b, a + (not waiting))
                if b > a:
                    held.append((names[a:b], sizes[a:b], ends[done : upto[b - 1]]))
                    waiting += int(upto[b - 1] - done)
                if b < len(sizes) or waiting >= shard_ids:
                    yield flush()
                    waiting = 0
                a = b
        if held:
            yield flush()

    with small_batches(docs.sparkSession):
        rows.mapInArrow(shards, _SHARD).write.parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, decoded from the shards."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_sum"))  # a row per writing task
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("_part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", "n_ids").withColumn("_shard_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    starts = starts.join(parts, "part").select("part", "shard", (F.col("_part_start") + F.col("_shard_start")).alias("_base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = WaveletMatrix(batch.column("matrix")[i].as_py())
                ids, sizes = shard.ids(), shard.sizes()
                ends = np.cumsum(sizes)
                n = len(sizes)
                cols = [
                    pa.array(np.full(n, batch.column("part")[i].as_py()), pa.int32()),
                    pa.array(np.full(n, batch.column("shard")[i].as_py()), pa.int32()),
                    pa.array(shard.names(), pa.int64()),
                    pa.array(ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([crc_of(ids[e - s : e]) for s, e in zip(sizes, ends, strict=True)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["part", "shard", "doc_id", "_at", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(documents, "part int, shard int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, **columns) -> DataFrame:
    """Write the shards of ``docs`` to ``path``, and return what reading them back gives.

    An empty table writes no shard and gives an empty result; an empty text is
    its end id alone; other columns of ``docs`` are ignored.
    """
    write_shards(docs, path, tokenizer, end_id, **columns)
    return read_shards(docs.sparkSession.read.schema(_SHARD).parquet(path))
