"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes (h = 2 h + G[byte], a window of ``WINDOW`` bytes). A chunk ends
after a word whose hash is the smallest among the ``REACH`` words on either side, so chunks have
four words at least and seven in the mean, and an insertion moves only the cuts next to it.
Chunks are named by a 128-bit digest of their words. The occurrence with the smallest (doc_id,
place) keeps a chunk; the others are duplicates. What is removed are runs of duplicate chunks of
``MIN_WORDS`` words or more: single chunks may recur by chance, such runs do not.

Digests are pre-aggregated before the shuffle, and the occurrences are joined with the repeated digests
only; adaptive execution splits hot digests. Nothing is gathered but the duplicate chunks of one document.

Cases: null text counts as empty; texts without words have no chunk and stay as they are; rows that
agree in doc_id and text are one document and get the same result; passages repeated within a
document lose their later occurrences; an empty table gives no rows; other columns pass through
``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import mix64
from .tokens import release, slices
from .words import word_table

#: Texts, and bytes of them, that are chunked together.
SLICE, SLICE_BYTES = 300, 1_500_000
WINDOW = 16
REACH = 3
MIN_WORDS = 20
GEAR = np.random.default_rng(1021).integers(0, 1 << 32, 256, np.uint32)
GAP = b" " * WINDOW
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Chunks:
    """The words and chunks of several texts. word_start, word_end: bytes in ``data``; word_doc: the text
    of each word; first: the first word of each chunk; chunk_doc: its text."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        # a window of spaces before each text, so that no hash reaches into the text before
        self.data = np.frombuffer(b"".join(x for t in raw for x in (GAP, t)) + b" ", np.uint8)
        sizes = np.array([len(x) for x in raw], np.int64)
        self.begin = np.cumsum(sizes + WINDOW) - sizes
        self.end = self.begin + sizes
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = np.concatenate([[0], edge]) if not space[0] else edge
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        self.word_doc = np.searchsorted(self.begin, self.word_start, side="right") - 1
        n = len(self.word_start)
        h = GEAR[self.data]
        w = 1
        while w < WINDOW:
            h[w:] += h[:-w] << np.uint32(w)
            w *= 2
        value = mix64(h[self.word_end - 1].astype(np.uint64))
        # the last word of a chunk: smaller than REACH words before, not larger than REACH after it
        cut = np.ones(n, bool)
        for j in range(1, REACH + 1):
            if n > j:
                same = self.word_doc[j:] == self.word_doc[:-j]
                less = value[j:] < value[:-j]
                cut[j:] &= ~same | less
                cut[:-j] &= ~same | ~less
        last = np.ones(n, bool)
        if n:
            last[:-1] = self.word_doc[1:] != self.word_doc[:-1]
        ends = np.flatnonzero(cut | last)
        self.first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if n else np.zeros(0, np.int64)
        self.words = np.diff(np.append(self.first, n))
        self.chunk_doc = self.word_doc[self.first]
        per = np.bincount(self.chunk_doc, minlength=len(texts))
        self.doc_first = np.cumsum(per) - per
        self.per = per

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.word_start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, hashes, idx, _ = word_table(pa.array(self.texts, pa.string()), lower=False)
        x = hashes[idx]
        at = (np.arange(n) - np.repeat(self.first, self.words)).astype(np.uint64)
        a = np.add.reduceat(mix64(x + at * np.uint64(0x9E3779B97F4A7C15)), self.first)
        b = np.add.reduceat(mix64((x ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD) + at * np.uint64(0xC2B2AE3D27D4EB4F)), self.first)
        return a.view(np.int64), b.view(np.int64)


PLACES = "d1 long, d2 long, doc long, h long, place int"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the document's key (_gl_doc, _gl_h): its id, and the text's hash if any id has several texts."""
    d = docs.withColumn("_gl_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    h = F.xxhash64("text")
    several = d.groupBy("_gl_doc").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").limit(1).count()
    # a constant costs little in the shuffles of chunks
    return d.withColumn("_gl_h", h if several else F.lit(0).cast("long"))


def occurrences(docs: DataFrame) -> DataFrame:
    """The digest, document and number of every chunk."""

    def run(batches):
        release()
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, k in slices(batch.column(2), SLICE_BYTES, SLICE):
                c = Chunks(batch.column(2).slice(a, k).to_pylist())
                d1, d2 = c.digests()
                place = (np.arange(len(d1)) - c.doc_first[c.chunk_doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1), pa.array(d2), pa.array(ids[a:][c.chunk_doc]), pa.array(hs[a:][c.chunk_doc]), pa.array(place)],
                    names=["d1", "d2", "doc", "h", "place"],
                )

    return docs.select("_gl_doc", "_gl_h", "text").mapInArrow(run, PLACES)


def duplicates(docs: DataFrame) -> DataFrame:
    """(_gl_d, _gl_x, _gl_dups): the numbers of each document's chunks that another place keeps."""
    occ = occurrences(docs)
    at = F.struct("doc", "h", "place")
    # rows that agree in doc and text occur once
    kept = occ.groupBy("d1", "d2").agg(F.min(at).alias("k"), F.max(at).alias("l")).where("k <> l")
    kept = kept.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("k.doc").alias("kd"), F.col("k.h").alias("kh"), F.col("k.place").alias("kp"))
    dup = occ.join(kept, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).where("doc <> kd or h <> kh or place <> kp")
    dup = dup.select(F.col("doc").alias("_gl_d"), F.col("h").alias("_gl_x"), F.col("place").alias("n"))
    return dup.groupBy("_gl_d", "_gl_x").agg(F.collect_set("n").alias("_gl_dups"))


def _runs(dup: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of duplicate chunks, as (first, last + 1), of so many words at least."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], dup.astype(np.int8), [0]])))
    upto = np.concatenate([[0], np.cumsum(words)])
    return [(a, b) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()) if upto[b] - upto[a] >= least]


RESULT = "n_chunks long, n_dup_chunks long, n_words long, removed_words long, spans array<struct<start:long,end:long>>, clean_text string"


def mark(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with counts, the removed spans (words, end exclusive) and the text without them; columns of
    docs that have these names are replaced."""
    d = _marked(docs, min_words)
    return d.select(*[c for c in docs.columns if c not in NAMES], *[F.col("_gl_" + c).alias(c) for c in NAMES])


NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _marked(docs: DataFrame, min_words: int) -> DataFrame:
    k = _keyed(docs)
    d = duplicates(k)
    on = (F.col("_gl_doc") == F.col("_gl_d")) & (F.col("_gl_h") == F.col("_gl_x"))
    joined = k.join(d, on, "left").select(*[k[c] for c in docs.columns], "_gl_dups")
    names = docs.columns
    at, n = names.index("text"), len(names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + ", ".join("_gl_" + c for c in RESULT.split(", "))

    def run(batches):
        release()
        for batch in batches:
            for a, k in slices(batch.column(at), SLICE_BYTES, SLICE):
                part = batch.slice(a, k)
                texts, dups = part.column(at).to_pylist(), part.column(n).to_pylist()
                c = Chunks(texts)
                word_doc_first = np.searchsorted(c.word_doc, np.arange(len(texts)))
                word_doc_end = np.searchsorted(c.word_doc, np.arange(len(texts)), side="right")
                out = []
                for i, text in enumerate(texts):
                    m, lo = int(c.per[i]), int(c.doc_first[i])
                    total = int(word_doc_end[i] - word_doc_first[i])
                    if not dups[i]:
                        out.append((m, 0, total, 0, [], text))
                        continue
                    flag = np.zeros(m, bool)
                    flag[dups[i]] = True
                    spans, pieces, upto, w0 = [], [], int(c.begin[i]), int(word_doc_first[i])
                    for x, y in _runs(flag, c.words[lo : lo + m], min_words):
                        s = int(c.first[lo + x])
                        e = int(c.first[lo + y]) if y < m else int(word_doc_end[i])
                        spans.append({"start": s - w0, "end": e - w0})
                        pieces.append(c.data[upto : int(c.word_start[s])].tobytes())
                        upto = int(c.word_end[e - 1])
                    pieces.append(c.data[upto : int(c.end[i])].tobytes())
                    clean = b"".join(pieces).decode("utf-8", "surrogatepass") if spans else text
                    out.append((m, int(flag.sum()), total, sum(x["end"] - x["start"] for x in spans), spans, clean))
                cols = list(zip(*out)) if out else [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], *[pa.array(x, t) for x, t in zip(cols, kinds)]],
                    names=[*names, *["_gl_" + c for c in NAMES]],
                )

    return joined.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut out of text; a document of nothing else goes."""
    d = _marked(docs, min_words).where("_gl_removed_words = 0 or _gl_removed_words < _gl_n_words")
    return d.select(*[F.col("_gl_clean_text").alias("text") if c == "text" else c for c in docs.columns])


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_chunks", "n_dup_chunks", "n_words", "removed_words", "spans", F.md5("clean_text").alias("clean_md5"))
