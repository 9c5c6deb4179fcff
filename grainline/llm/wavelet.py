"""Token ids as a wavelet matrix in one compressed file per shard.

A shard holds the ids of a run of documents in ascending doc_id order. The ids are split into
bit-planes, most significant first; before each next plane the ids are stably parted by the bit
just stored. Planes are cut into blocks of 2^16 bits; a block is stored as it is, or by zstandard
where that is smaller, and the directory keeps each block's place and the ones before it, so that
access, rank (counting) and select (occurrence lookup) unpack one block of each plane.

File: b"GLWM1\\0", six little-endian u64 (ids, bits, documents, length of each of the three
directories), the directories (documents: id and length; zeros of each plane; blocks: offset,
ones before), then the blocks.

Cases: null text counts as empty; each document has its end id, so it has one id at least; a null
doc_id comes first; documents with the same doc_id keep all their rows, in order of their texts' hashes; an
empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Output, make_dir, open_in, scratch, stored, table
from .packing import default_vocabulary
from .tokens import encoder, slices

MAGIC = b"GLWM1\0"
BLOCK = 1 << 16
#: A task starts another shard beyond so many ids.
SHARD_IDS = 8_000_000
END = 0


def build(ids: np.ndarray, docs: list[tuple[int | None, int]]) -> bytes:
    """The file's bytes; docs: id and number of ids, in order."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    n, bits = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    zeros, offsets, before, body, at = [], [], [], [], 0
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits - 1, -1, -1):
        bit = (cur >> level & 1).astype(bool)
        ones = 0
        for a in range(0, n, BLOCK):
            part = bit[a : a + BLOCK]
            raw = np.packbits(part, bitorder="little").tobytes()
            small = pack.compress(raw)
            raw = b"\1" + small if len(small) < 0.95 * len(raw) else b"\0" + raw
            offsets.append(at)
            before.append(ones)
            body.append(raw)
            at += len(raw)
            ones += int(np.count_nonzero(part))
        zeros.append(n - ones)
        cur = np.concatenate([cur[np.flatnonzero(~bit)], cur[np.flatnonzero(bit)]])
    offsets.append(at)
    before.append(0)
    flags = bytes(d[0] is None for d in docs)
    table = np.array([[d[0] or 0, d[1]] for d in docs], "<i8").reshape(-1, 2).tobytes() + flags
    plane = np.array(zeros, "<u8").tobytes()
    blocks = np.array([offsets, before], "<u8").T.tobytes()
    head = MAGIC + struct.pack("<6Q", n, bits, len(docs), len(table), len(plane), len(blocks))
    return b"".join([head, table, plane, blocks, *body])


class WaveletMatrix:
    """Reads one shard from a seekable file; only the directories stay in memory."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        head = f.read(len(MAGIC) + 48)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.n, self.bits, d, a, b, c = struct.unpack("<6Q", head[len(MAGIC) :])
        raw = f.read(a)
        t = np.frombuffer(raw[: 16 * d], "<i8").reshape(-1, 2)
        self.docs = [(None if raw[16 * d + i] else int(x), int(n)) for i, (x, n) in enumerate(t)]
        self.zeros = np.frombuffer(f.read(b), "<u8").astype(np.int64)
        blocks = np.frombuffer(f.read(c), "<u8").reshape(-1, 2)
        self.offsets, self.before = blocks[:, 0].astype(np.int64), blocks[:, 1].astype(np.int64)
        self.start, self.per = f.tell(), -(-self.n // BLOCK)
        self.kept: dict[int, np.ndarray] = {}

    def _block(self, plane: int, k: int) -> np.ndarray:
        import zstandard

        i = plane * self.per + k
        if i not in self.kept:
            self.f.seek(self.start + int(self.offsets[i]))
            raw = self.f.read(int(self.offsets[i + 1] - self.offsets[i]))
            data = zstandard.ZstdDecompressor().decompress(raw[1:]) if raw[0] else raw[1:]
            size = min(BLOCK, self.n - k * BLOCK)
            if len(self.kept) > 64:
                self.kept.clear()
            self.kept[i] = np.unpackbits(np.frombuffer(data, np.uint8), count=size, bitorder="little")
        return self.kept[i]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0:
            return 0
        k, rest = divmod(i, BLOCK)
        if k == self.per:
            return self.n - int(self.zeros[plane])
        return int(self.before[plane * self.per + k]) + (int(self._block(plane, k)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for p in range(self.bits):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK])
            ones = self._rank1(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            v = v << 1 | bit
        return v

    def _span(self, value: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        for p in range(self.bits):
            x, y = self._rank1(p, a), self._rank1(p, b)
            if value >> (self.bits - 1 - p) & 1:
                a, b = int(self.zeros[p]) + x, int(self.zeros[p]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, value: int, end: int | None = None) -> int:
        """How often a value occurs before place ``end``."""
        end = self.n if end is None else end
        if value < 0 or value >> self.bits:
            return 0
        a, b = self._span(value, end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a value."""
        if k < 0 or self.rank(value) <= k:
            raise IndexError(k)
        i = self._span(value, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - p) & 1
            want = i - int(self.zeros[p]) if bit else i
            i = self._select(p, bit, want)
        return i

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th bit of that value in a plane."""
        ones = self.before[plane * self.per : (plane + 1) * self.per]
        have = ones if bit else np.arange(self.per) * BLOCK - ones
        b = int(np.searchsorted(have, k, side="right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._block(plane, b) == bit)[k - int(have[b])])

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        vals = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self._block(p, k) for k in range(self.per)] or [np.zeros(0, np.uint8)]).astype(bool)
            back = np.empty_like(vals)
            z = int(self.zeros[p])
            back[np.flatnonzero(~bit)] = vals[:z]
            back[np.flatnonzero(bit)] = vals[z:] | (1 << (self.bits - 1 - p))
            vals = back
        return vals


SHARD = "shard int, piece int, path string, n_docs long, n_ids long"
DOC = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, path: str, out_dir: str, end_id: int = END, spaced: bool = True) -> DataFrame:
    """Writes the rows of (doc_id, text) as shards; one row for each shard, written to a table."""
    spark = docs.sparkSession
    make_dir(out_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path, spaced)
        part = TaskContext.get().partitionId()
        ids, own, held, piece = [], [], 0, 0

        def flush():
            nonlocal ids, own, held, piece
            where = f"{out_dir}/shard-{part:06d}-{piece:04d}.glwm"
            data = build(np.concatenate(ids), own)
            with Output(where) as f:
                f.write(data)
            row = pa.RecordBatch.from_pylist(
                [{"shard": part, "piece": piece, "path": where, "n_docs": len(own), "n_ids": held}], schema=SHARD_ARROW
            )
            ids, own, held, piece = [], [], 0, piece + 1
            return row

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, k in slices(texts):
                got, counts = enc.encode(texts.slice(a, k))
                ends = np.cumsum(counts)
                ids.append(np.insert(got, ends, enc.kind(end_id)))
                own += zip(doc_ids[a : a + k], (counts + 1).tolist())
                held += len(got) + len(counts)
                if held >= SHARD_IDS:
                    yield flush()
        if own:
            yield flush()

    # rows of one doc_id (or none) spread over tasks by the hash of their text, equal rows by their place
    key = ["doc_id", "_gl_hash", "_gl_at"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_gl_hash"), F.monotonically_increasing_id().alias("_gl_at"))
    rows = rows.repartitionByRange(n, *key).sortWithinPartitions("doc_id", "_gl_hash", "text")
    return stored(rows.mapInArrow(run, SHARD), "wavelet-shards")


SHARD_ARROW = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document what the files hold: its place, first id, number of ids and their crc32.
    ``shards`` has begins, the number of ids before each shard."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with open_in(r["path"]) as f:
                    m = WaveletMatrix(f)
                    ids = m.decode()
                    sizes = np.array([n for _, n in m.docs], np.int64)
                    starts = np.cumsum(sizes) - sizes
                    crc = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in m.docs], pa.int64()), pa.array(starts + r["begins"]), pa.array(sizes), pa.array(crc, pa.int64())],
                        names=[x.split()[0] for x in DOC.split(", ")],
                    )

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("path", "begins").repartition(n, "path").mapInArrow(run, DOC)


def op10_token_shards(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    out = scratch(spark, "wavelet")
    shards = write_shards(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary("byte_bpe_50k.json"), out)
    # where each shard starts: one row a shard, so a single running sum is small
    w = Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return read_shards(shards.withColumn("begins", F.coalesce(F.sum("n_ids").over(w), F.lit(0))))
