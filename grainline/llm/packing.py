"""Packing token sequences by minimum bin slack.

Documents become token ids plus an end id. What fills whole windows of ``capacity`` ids is cut
off first; the remainders wait in a pool of bounded size. Each window is opened by the longest
waiting remainder, and a subset-sum dynamic program over the multiset of the other remaining
lengths, held as a bitset in one integer, finds the fill closest to the capacity; the chosen
multiset is backtracked as counts of each length. What is left at the end of a partition is cut
at powers of two, where sequences need no padding.

The pool is one partition's own, so there is no shuffle and memory depends on ``POOL_IDS``, ``POOL_PIECES``
and the encoder's byte bounds only.
A recomputed task meets the same rows in the same order and packs them alike.

Cases: null text counts as empty and holds the end id alone; a text longer than a window is cut;
repeated rows are packed once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import encoder, slices

CAPACITY = 2048
#: Ids that wait in the pool of a task before windows are filled.
POOL_IDS = 3_000_000
#: Pieces that wait there at most, some 250 bytes each besides their ids.
POOL_PIECES = 200_000
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``, as counts.

    reach is a bitset of attainable sums; bounded counts enter in binary parts (1, 2, 4 and so
    on copies). The program stops as soon as ``room`` itself is reached.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in order:
        left = min(counts[length], room // length) if length <= room else 0
        copies = 1
        while left > 0:
            n = min(copies, left)
            grown = (reach | reach << (n * length)) & full
            if grown != reach:
                steps.append((length, n, reach))
                reach = grown
            left -= n
            copies *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + n
            at -= n * length
    return chosen


def fill_windows(lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Item numbers of each full window, and those that wait on: the items of windows with slack wait for later ones."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        by[n].append(i)
    counts = {n: len(x) for n, x in by.items()}
    order = sorted(counts, reverse=True)
    windows, waiting = [], []
    while order:
        head = order[0]
        take = [by[head].pop()]
        counts[head] -= 1
        chosen = best_fill(counts, order, capacity - head) if head < capacity else {}
        total = head + sum(n * k for n, k in chosen.items())
        if total == capacity:
            for n, k in chosen.items():
                counts[n] -= k
                for _ in range(k):
                    take.append(by[n].pop())
            windows.append(take)
        else:
            waiting += take
        order = [n for n in order if counts[n]] if any(not counts[n] for n in (head, *chosen)) else order
    return windows, waiting


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, spaced: bool = False) -> DataFrame:
    """One row for each piece of the rows of (doc_id, text)."""

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path, spaced)
        end = enc.kind(end_id)
        part = TaskContext.get().partitionId()
        seq = part << 40
        pool: list[tuple[int, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        held = 0
        out: list[tuple] = []

        def emit(doc, start, ids, total, sequence, offset):
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

        def close(final):
            nonlocal pool, held, seq
            windows, waiting = fill_windows([len(x[2]) for x in pool], capacity)
            for w in windows:
                offset = 0
                for i in w:
                    emit(*pool[i][:3], pool[i][3], seq, offset)
                    offset += len(pool[i][2])
                seq += 1
            pool = [pool[i] for i in waiting]
            held = sum(len(x[2]) for x in pool)
            if final and pool:
                finish()

        def finish():
            """The rest, end to end: whole windows, then powers of two."""
            nonlocal pool, held, seq
            left, room, offset = held, 0, 0
            for doc, start, ids, total in pool:
                at = 0
                while at < len(ids):
                    if room == 0:
                        room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                        offset, seq = 0, seq + 1
                    n = min(room, len(ids) - at)
                    emit(doc, start + at, ids[at : at + n], total, seq, offset)
                    at, offset, room, left = at + n, offset + n, room - n, left - n
            pool, held = [], 0
            seq += 1

        def rows():
            cols = list(zip(*out)) if out else [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=NAMES)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, k in slices(texts):
                ids, counts = enc.encode(texts.slice(a, k))
                at = 0
                for doc, n in zip(doc_ids[a : a + k], counts.tolist()):
                    own = np.append(ids[at : at + n], end)
                    at += n
                    total, start = len(own), 0
                    while total - start >= capacity:
                        emit(doc, start, own[start : start + capacity], total, seq, 0)
                        start, seq = start + capacity, seq + 1
                    if start < total:
                        pool.append((doc, start, own[start:].copy() if start else own, total))
                        held += total - start
                if held >= POOL_IDS or len(pool) >= POOL_PIECES:
                    close(False)
                if len(out) > 20_000:
                    yield rows()
        close(True)
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def op6_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary("word_bpe_49k.json"))


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
