"""Katz backoff bigram scores of whole texts.

Counts are discounted by Good-Turing up to count ``CUT``; the mass taken from a history's bigrams goes to
its unseen words in proportion to their unigram probability, by a backoff weight normalised exactly:

    P(w | v) = d(c(v, w)) c(v, w) / c(v)                       where c(v, w) > 0
    P(w | v) = alpha(v) P(w)                                   else
    alpha(v) = (1 - sum of the first over v's words) / (1 - sum of P(w) over the same words)

and P(w) backs off alike from discounted unigram counts to one unknown word. A text starts after an end
mark and closes with one. Neither the vocabulary nor the bigrams are ever in one place. Tasks split their
rows into batches of ``TOKENS`` tokens, kept as files in the shared folder, and ask tables for what a batch
needs, each distinct word and bigram once:

1. words with their counts go to parts by word; each part sums them and answers every batch;
2. bigrams go to parts by history; each part sums them, and answers each with its count and each history
   with the counts of its counts and the unigram mass of its words. Histories that are frequent enough to
   weigh down a part are split over several by the following word, and their answers are added;
3. batches read the answers and score their texts token by token, from bigram to backoff to unigram.

The answers are written tables partitioned by batch; what reaches the driver are a few sums.

Cases: null and empty texts have one token, the end; words never seen in training are unknown; without
training rows all words are unknown and scores are those of the one unknown word; repeated rows score
alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Output, make_dir, open_in, partitions, remainder, scratch, stored, table
from .language_id import mix64
from .words import word_table

CUT = 5
#: Tokens of a batch.
TOKENS = 2_000_000
#: Training tokens whose bigrams are counted in one task.
PART_TOKENS = 4_000_000
#: A history is split where it holds more than this share of a part's mean load.
HOT = 0.5
END = np.uint64(0x3C656E643E)
SALT = np.uint64(0x9E3779B97F4A7C15)


def _save(uri: str, data: dict) -> None:
    import zstandard

    with Output(uri) as f, zstandard.ZstdCompressor(level=1).stream_writer(f, closefd=False) as z:
        pickle.dump(data, z, protocol=5)


def _load(uri: str) -> dict:
    import zstandard

    with open_in(uri) as f, zstandard.ZstdDecompressor().stream_reader(f) as z:
        return pickle.load(z)


def squeeze(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on as planes of bytes, lowest first, as many as the largest needs; planes of small
    numbers are mostly zero and cost little once compressed."""
    a = np.ascontiguousarray(a, "<u8")
    k = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + a.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def spread(b: bytes) -> np.ndarray:
    """The numbers of ``squeeze``, as 64-bit integers."""
    if not b:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<i8").ravel()


def discounts(n: list[float]) -> np.ndarray:
    """d for counts 0 to CUT (1 beyond) from n[r], the number of grams with count r, r up to CUT + 1.

    Good-Turing as Katz has it; where the counts of counts give no valid discounts (small or odd
    corpora), one absolute discount for all counts up to CUT."""
    d = np.ones(CUT + 1)
    if n[1] > 0:
        a = (CUT + 1) * n[CUT + 1] / n[1]
        if all(n[r] > 0 for r in range(1, CUT + 1)) and a < 1:
            for r in range(1, CUT + 1):
                d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
            if (d[1:] > 0.01).all() and (d[1:] < 1).all():
                return d
    b = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
    return np.array([1.0] + [1 - b / r for r in range(1, CUT + 1)])


class Unigrams:
    """P(w) by count. n[r]: words with count r; total: training tokens; kinds: distinct words."""

    def __init__(self, n: list[float], total: int, kinds: int):
        self.total, self.kinds = total, kinds
        self.d = discounts(n)
        r = np.arange(CUT + 1)
        mass = (np.array(n[: CUT + 1]) * r * (1 - self.d))[1:].sum() / total if total else 1.0
        self.keep = 1.0
        if mass <= 1e-12:  # no small counts to take from: one more unit for the unknown word
            self.keep, mass = total / (total + 1), 1 / (total + 1)
        self.unknown = mass

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= CUT, self.d[np.minimum(c, CUT)], 1.0) * self.keep
        return np.where(c > 0, d * c / max(1, self.total), self.unknown)


def _part(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(n)).astype(np.int64)


# batches ------------------------------------------------------------------------------------------------


def batches(docs: DataFrame, base: str, n: int) -> DataFrame:
    """Writes the batches of (doc_id, text, held) and asks for their words: a row for each part."""
    make_dir(base)

    def run(it):
        from pyspark import TaskContext

        task, seq, held_back, tokens = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held_back, tokens
            batch, held_back_now = task << 20 | seq, held_back
            held_back, tokens, seq = [], 0, seq + 1
            # one vocabulary, ordered by part and hash
            every = np.concatenate([np.array([END])] + [x[0] for x in held_back_now])
            vocab = np.unique(every)
            part = _part(vocab, n)
            order = np.argsort(part, kind="stable")
            vocab, part = vocab[order], part[order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sorted_vocab = vocab[place]

            def at(h):
                return place[np.searchsorted(sorted_vocab, h)]

            end = int(at(np.array([END]))[0])
            idx, sizes = [], []
            for hashes, words, off in ((x[0], x[1], x[2]) for x in held_back_now):
                w = at(hashes)[words] if len(hashes) else words
                idx.append(np.insert(w, off[1:], end))
                sizes.append(np.diff(off) + 1)
            idx, sizes = np.concatenate(idx).astype(np.int32), np.concatenate(sizes)
            held = np.concatenate([x[4] for x in held_back_now])
            ids = [d for x in held_back_now for d in x[3]]
            train = np.repeat(~held, sizes)
            counts = np.bincount(idx[train], minlength=len(vocab))
            _save(f"{base}/{batch}.tokens", {"vocab": vocab, "idx": idx, "sizes": sizes, "held": held, "ids": ids, "end": end})
            edge = np.searchsorted(part, np.arange(n + 1))
            rows = [(p, batch, vocab[a:b].tobytes(), squeeze(counts[a:b])) for p, a, b in zip(range(n), edge[:-1].tolist(), edge[1:].tolist()) if b > a]
            return _rows(rows, "part int, batch long, w binary, c binary")

        for b in it:
            for a in range(0, b.num_rows, 1000):
                x = b.slice(a, 1000)
                _, hashes, idx, off = word_table(x.column(1))
                held_back.append((hashes, idx, off, x.column(0).to_pylist(), x.column(2).to_numpy(zero_copy_only=False)))
                tokens += len(idx) + x.num_rows
                if tokens >= TOKENS:
                    yield flush()
        if held_back:
            yield flush()

    return docs.mapInArrow(run, "part int, batch long, w binary, c binary")


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields)], names=[f for f, _ in fields])


def _groups(it, key: int):
    """Rows of each key, from a stream sorted by it."""
    now, rows = None, []
    for b in it:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if rows and r[key] != now:
                yield now, rows
                rows = []
            now = r[key]
            rows.append(r)
    if rows:
        yield now, rows


def _by(df: DataFrame, n: int, key: str) -> DataFrame:
    # parts are numbers from 0 on: each gets a task of its own
    d = df.repartitionById(n, F.col("part").cast("int")) if key == "part" else df.repartition(n, key)
    return d.sortWithinPartitions(key)


WORDS = "batch long, part int, c binary, kinds long, total long, n binary"


def _sum(at: np.ndarray, counts: list[np.ndarray], n: int) -> np.ndarray:
    """Whole sums of counts by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, np.concatenate(counts) if counts else np.zeros(0, np.int64))
    return out


def answer_words(asked: DataFrame, n: int) -> DataFrame:
    """Each part's counts for each batch; one row with batch -1 a part holds its sums."""

    def run(it):
        for part, rows in _groups(it, 0):
            ws = [np.frombuffer(r[2], np.uint64) for r in rows]
            u, inv = np.unique(np.concatenate(ws), return_inverse=True)
            total = _sum(inv, [spread(r[3]) for r in rows], len(u))
            edge = np.cumsum([0] + [len(w) for w in ws])
            of_count = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3).astype(np.int64)
            out = [(r[1], part, squeeze(total[inv[a:b]]), 0, 0, b"") for r, a, b in zip(rows, edge[:-1], edge[1:])]
            out.append((-1, part, b"", int((total > 0).sum()), int(total.sum()), of_count.tobytes()))
            yield _rows(out, WORDS)

    return _by(asked, n, "part").mapInArrow(run, WORDS)


def _sums(answers: DataFrame) -> tuple[list[float], int, int]:
    """Counts of counts, tokens and kinds over all parts: sums of a fixed number of numbers a part."""
    n, total, kinds = np.zeros(CUT + 3), 0, 0
    for r in answers.where("batch = -1").select("n", "total", "kinds").toLocalIterator():
        n += np.frombuffer(r["n"], np.int64)
        total, kinds = total + r["total"], kinds + r["kinds"]
    return n.tolist(), total, kinds


class Batch:
    """A batch with its words' counts, and the order in which its bigrams and histories are asked."""

    def __init__(self, uri: str, counts: np.ndarray, uni: Unigrams, n: int):
        x = _load(uri)
        self.__dict__ |= x
        self.c = counts.astype(np.int64)
        idx, sizes = self.idx.astype(np.int64), self.sizes
        first = np.cumsum(sizes) - sizes
        prev = np.empty_like(idx)
        prev[1:] = idx[:-1]
        prev[first] = self.end
        self.prev = prev
        code, self.item = np.unique(prev * len(self.vocab) + idx, return_inverse=True)
        self.v, self.w = np.divmod(code, len(self.vocab))
        train = np.repeat(~self.held, sizes)
        self.seen_here = np.bincount(self.item[train], minlength=len(code))
        # a header for each history with a count, for each part of it
        load = max(1.0, HOT * uni.total / n)
        split = np.where(self.c > 0, np.ceil(self.c / load), 0).astype(np.int64)
        self.split = np.minimum(split, n)
        self.h0 = np.cumsum(self.split) - self.split
        total = int(self.split.sum())
        self.h_word = np.repeat(np.arange(len(split)), self.split)
        salt = np.arange(total) - np.repeat(self.h0, self.split)
        hv = self.vocab[self.h_word] + salt.astype(np.uint64) * SALT
        part = _part(hv, n)
        order = np.lexsort((hv, part))
        self.order, self.hv, self.part = order, hv[order], part[order]
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        # only bigrams of two known words can have a count
        self.asked = np.flatnonzero((self.c[self.v] > 0) & (self.c[self.w] > 0))
        v, w = self.v[self.asked], self.w[self.asked]
        tail = self.vocab[w] >> np.uint64(16)
        head = place[self.h0[v] + (tail % self.split[v].astype(np.uint64)).astype(np.int64)]
        by = np.argsort(head, kind="stable")
        self.asked, self.tail, self.head = self.asked[by], tail[by], head[by]
        self.per = np.bincount(self.head, minlength=total)


ASK = "part int, batch long, v binary, k binary, w binary, c binary, cw binary"


def ask_bigrams(answers: DataFrame, base: str, uni: Unigrams, n: int) -> DataFrame:
    def run(it):
        for batch, rows in _groups(it, 0):
            counts = np.concatenate([spread(r[2]) for r in sorted(rows, key=lambda r: r[1])])
            _save(f"{base}/{batch}.counts", {"counts": counts})
            b = Batch(f"{base}/{batch}.tokens", counts, uni, n)
            edge = np.searchsorted(b.part, np.arange(n + 1))
            upto = np.concatenate([[0], np.cumsum(b.per)])
            tail = np.zeros((len(b.tail), 6), np.uint8)
            tail[:] = b.tail.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            here, cw, per = b.seen_here[b.asked], b.c[b.w[b.asked]], b.per
            out = []
            for p in range(n):
                i, j = int(edge[p]), int(edge[p + 1])
                if j > i:
                    s, e = int(upto[i]), int(upto[j])
                    out.append((p, batch, b.hv[i:j].tobytes(), squeeze(per[i:j]), tail[s:e].T.tobytes(), squeeze(here[s:e]), squeeze(cw[s:e])))
                if len(out) >= 16:
                    yield _rows(out, ASK)
                    out = []
            yield _rows(out, ASK)

    d = answers.where("batch >= 0").select("batch", "part", "c")
    return _by(d, n, "batch").mapInArrow(run, ASK)


PAIRS = "batch long, part int, c binary, of binary, mass binary, total long, kinds long, n binary"


def answer_bigrams(asked: DataFrame, uni: Unigrams, n: int) -> DataFrame:
    """Each part's counts of bigrams, and for each history the numbers of bigrams with count 1 to CUT, the
    tokens in larger ones, and the unigram mass of all."""

    def run(it):
        for part, rows in _groups(it, 0):
            vs = [np.frombuffer(r[2], np.uint64) for r in rows]
            ks = [spread(r[3]) for r in rows]
            hist, hinv = np.unique(np.concatenate(vs), return_inverse=True)
            tails = np.zeros((sum(len(r[4]) for r in rows) // 6, 8), np.uint8)
            tails[:, :6] = np.concatenate([np.frombuffer(r[4], np.uint8).reshape(6, -1).T for r in rows])
            w = tails.view("<u8").ravel()
            v = np.repeat(hinv, np.concatenate(ks)).astype(np.uint64)
            u, first, inv = np.unique(mix64(mix64(v + np.uint64(1)) ^ w), return_index=True, return_inverse=True)
            c = _sum(inv, [spread(r[5]) for r in rows], len(u))
            cw = np.concatenate([spread(r[6]) for r in rows])[first]
            uv = v[first].astype(np.int64)
            seen = c > 0
            of = np.zeros((CUT + 1, len(hist)), np.int64)
            for r in range(1, CUT + 1):
                of[r - 1] = np.bincount(uv[c == r], minlength=len(hist))
            of[CUT] = _sum(uv[c > CUT], [c[c > CUT]], len(hist))
            mass = np.bincount(uv[seen], uni.p(cw[seen]), len(hist))
            he, ie = np.cumsum([0] + [len(x) for x in vs]), np.cumsum([0] + [len(r[4]) // 6 for r in rows])
            got = c[inv]
            out = []
            for k, r in enumerate(rows):
                h = hinv[he[k] : he[k + 1]]
                out.append((r[1], part, squeeze(got[ie[k] : ie[k + 1]]), pickle.dumps([squeeze(x[h]) for x in of]), mass[h].astype("<f8").tobytes(), 0, 0, b""))
            of_count = np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3).astype(np.int64)
            out.append((-1, part, b"", b"", b"", int(c.sum()), int(seen.sum()), of_count.tobytes()))
            for a in range(0, len(out), 16):
                yield _rows(out[a : a + 16], PAIRS)

    return _by(asked, n, "part").mapInArrow(run, PAIRS)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def backoff(c: np.ndarray, of: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor of the seen bigrams, alpha) of histories with count c."""
    r = np.arange(1, CUT + 1)
    kept = (of[:, :CUT] * (r * d[1:])).sum(1) + of[:, CUT]
    left = 1 - kept / np.maximum(c, 1)
    none = left <= 1e-12  # all bigrams are frequent: one more unit for the unseen
    keep = np.where(none, c / (c + 1), 1.0)
    left = np.where(none, 1 / (c + 1), left)
    return keep, left / np.maximum(1 - mass, 1e-300)


def score_batches(answers: DataFrame, base: str, uni: Unigrams, d: np.ndarray, n: int) -> DataFrame:
    def run(it):
        for batch, rows in _groups(it, 0):
            b = Batch(f"{base}/{batch}.tokens", _load(f"{base}/{batch}.counts")["counts"], uni, n)
            rows = sorted(rows, key=lambda r: r[1])
            got = np.concatenate([spread(r[2]) for r in rows])
            of = np.concatenate([np.stack([spread(x) for x in pickle.loads(r[3])], 1) for r in rows])
            mass = np.concatenate([np.frombuffer(r[4], "<f8") for r in rows])
            # the parts of a history together
            word, k = b.h_word[b.order], len(b.vocab)
            of = np.stack([_sum(word, [of[:, j]], k) for j in range(CUT + 1)], 1)
            keep, alpha = backoff(b.c, of, np.bincount(word, mass, k), d)
            count = np.zeros(len(b.v), np.int64)
            count[b.asked] = got
            v, p1 = b.v, uni.p(b.c[b.w])
            first = np.where(count <= CUT, d[np.minimum(count, CUT)], 1.0) * count * keep[v] / np.maximum(b.c[v], 1)
            p = np.where(count > 0, first, np.where(b.c[v] > 0, alpha[v], 1.0) * p1)
            logs = np.log10(p)[b.item]
            base_p = np.log10((b.c + 0.5) / (uni.total + 0.5 * (uni.kinds + 1)))[b.idx]
            begin = np.cumsum(b.sizes) - b.sizes
            m = len(b.sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.sizes.astype(np.int64)),
                    pa.array(np.add.reduceat((b.c[b.idx] > 0).astype(np.int64), begin)), pa.array(np.full(m, uni.total, np.int64)),
                    pa.array(np.add.reduceat(base_p, begin)), pa.array(np.add.reduceat(logs, begin)),
                ],
                names=[f.split()[0] for f in RESULT.split(", ")],
            )

    d_ = answers.where("batch >= 0").select("batch", "part", "c", "of", "mass")
    return _by(d_, n, "batch").mapInArrow(run, RESULT)


def score(docs: DataFrame) -> DataFrame:
    """Scores of the rows of (doc_id, text, held); rows with held false are learnt from."""
    spark = docs.sparkSession
    base, n = scratch(spark, "katz"), partitions(spark)
    words = stored(answer_words(batches(docs.select("doc_id", "text", "held"), base, n), n), "katz-words")
    counts, total, kinds = _sums(words)
    uni = Unigrams(counts, total, kinds)
    # a part of the bigrams is in one task's memory: their number grows with the tokens
    parts = max(n, -(-total // PART_TOKENS))
    pairs = stored(answer_bigrams(ask_bigrams(words, base, uni, parts), uni, parts), "katz-bigrams")
    d = discounts(_sums(pairs)[0])
    return score_batches(pairs, base, uni, d, parts)


def op2_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (remainder(5) == 1).alias("held")))
