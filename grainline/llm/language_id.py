"""Language identification by interpolated Kneser-Ney character models.

One model a language: character n-grams up to order 4 over lower-cased letters (all else is a
space, runs of it once), absolute discounts from the counts of counts, continuation counts below
the highest order, a uniform floor at the end. Grams are packed into integers, mixed by a
bijective 64-bit hash and kept as sorted arrays; a lookup is a binary search. A text gets the
language with the lowest cross-entropy per character. Rejection is calibrated on sample documents
kept out of the counts: a text is rejected if its cross-entropy lies ``REJECT`` standard deviations
above its language's, with more allowance for short texts.

The sample is bounded: ``SAMPLE_DOCS`` documents of a language and ``SAMPLE_TOTAL`` characters of all
languages, picked by a hash of the row among those of at most ``SAMPLE_CHARS`` characters (of a language
that has none so short, its shortest), so the models' size is bounded too. The same rows give the same
sample. Prediction reads the whole text, looks at nothing else, and needs no shuffle.

Cases: null text or text without a letter gives ``und``, score 0, rejected; a table without
labelled rows gives ``und`` for all; languages whose sample has no letter are not learnt; repeated rows give repeated results; ties go to the first
language by name; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table
from .tokens import release

ORDER = 4
SAMPLE_DOCS = 600
#: Longer documents are not sampled for fitting (they are predicted as all others).
SAMPLE_CHARS = 100_000
#: Characters of the whole sample, shared evenly by the languages.
SAMPLE_TOTAL = 40_000_000
REJECT = 10.0
UND = "und"
#: Characters scored at a time by a task.
CHUNK = 1_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER: np.ndarray | None = None


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (three 0 before each text, then letters and single spaces), the
    text of each symbol, and each text's number of letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    low = ["\0\0\0" + (t or "").replace("\0", " ").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(low)), [len(x) for x in low])
    high = codes > 0xFFFF
    if high.any():
        letters = {c: chr(c).isalpha() for c in np.unique(codes[high]).tolist()}
        codes = codes.copy()
        codes[high] = [0xFFFF if letters[c] else 0x20 for c in codes[high].tolist()]
    letter = _LETTER[codes] | (codes == 0xFFFF)
    begin = codes == 0
    n_letters = np.bincount(own[letter], minlength=len(low))
    s = np.where(letter | begin, codes, 0x20)
    space = s == 0x20
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    return s[keep], own[keep], n_letters


class Models:
    """Kneser-Ney models of several languages over one alphabet."""

    def __init__(self, sample: list[tuple[str, str]]):
        """sample: pairs of language and text; every fifth of a language only calibrates."""
        by: dict[str, list[str]] = {}
        for lang, text in sample:
            by.setdefault(lang, []).append(text)
        fit = {k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in by.items()}
        self.langs = sorted(k for k, v in fit.items() if any(c.isalpha() for t in v for c in t))
        points = [symbols(fit[k])[0] for k in self.langs]
        # 0 begins a text, 1 stands for symbols that were not learnt
        self.alphabet = np.unique(np.concatenate(points)) if points else np.zeros(0, np.uint32)
        self.alphabet = self.alphabet[self.alphabet > 0]
        self.bits = max(1, int(len(self.alphabet) + 2).bit_length())
        self.tables = [self._fit(self._map(p)) for p in points]
        self.mean, self.sd = np.ones(len(self.langs)), np.full(len(self.langs), 0.1)
        self.slope = 1.0
        self._calibrate(by)

    def _map(self, points: np.ndarray) -> np.ndarray:
        lut = np.ones(0x10000, np.uint64)
        lut[self.alphabet] = np.arange(2, len(self.alphabet) + 2)
        lut[0] = 0
        return lut[points]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The gram of highest order that ends at each symbol."""
        k = s.copy()
        for j in range(1, ORDER):
            k[j:] |= s[:-j] << np.uint64(j * self.bits)
        return k

    def _fit(self, s: np.ndarray) -> list[tuple]:
        """For each order: sorted hashes of grams with their discounted shares, and of contexts with
        the weight of the lower order."""
        b = np.uint64(self.bits)
        grams, counts = np.unique(self.keys(s)[s > 0], return_counts=True)
        out = []
        for n in range(ORDER, 0, -1):
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            d = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9))
            context = grams >> b
            c, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, counts)
            share = (counts - d) / total[at]
            back = d * np.bincount(at) / total
            g, h = mix64(grams), mix64(c)
            i, j = np.argsort(g), np.argsort(h)
            out.append((g[i], share[i], h[j], back[j]))
            # below: in how many contexts a shorter gram was seen
            mask = (np.uint64(1) << np.uint64((n - 1) * self.bits)) - np.uint64(1)
            grams, counts = np.unique(grams & mask, return_counts=True)
        return out[::-1]

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of the last symbol of each gram, a column a language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        for li, orders in enumerate(self.tables):
            p = np.full(len(keys), 1.0 / (len(self.alphabet) + 2))
            for n, (g, share, h, back) in enumerate(orders, 1):
                mask = (np.uint64(1) << np.uint64(n * self.bits)) - np.uint64(1) if n * self.bits < 64 else np.uint64(2**64 - 1)
                k = keys & mask
                p = _find(g, share, mix64(k), 0.0) + _find(h, back, mix64(k >> np.uint64(self.bits)), 1.0) * p
            out[:, li] = np.log(p)
        return out

    def entropies(self, texts: list[str | None], memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts x languages), letters and symbols of each text."""
        points, own, letters = symbols(texts)
        s = self._map(points)
        keys, real = self.keys(s), s > 0
        keys, own = keys[real], own[real]
        if ORDER * self.bits <= 24:
            # each gram is looked up once a worker
            if not memo:
                memo["at"] = np.full(1 << (ORDER * self.bits), -1, np.int32)
                memo["rows"] = np.zeros((0, len(self.langs)), np.float32)
            at = memo["at"][keys]
            if (at < 0).any():
                new = np.unique(keys[at < 0])
                memo["at"][new] = len(memo["rows"]) + np.arange(len(new))
                memo["rows"] = np.concatenate([memo["rows"], self.log_probs(new)])
                at = memo["at"][keys]
            rows = memo["rows"]
        else:
            new, at = np.unique(keys, return_inverse=True)
            rows = self.log_probs(new)
        n = np.bincount(own, minlength=len(texts))
        sums = np.stack([np.bincount(own, rows[at, j], len(texts)) for j in range(len(self.langs))], 1)
        return -sums / np.maximum(n, 1)[:, None], letters, n

    def _calibrate(self, by: dict[str, list[str]]) -> None:
        hs, ns, true = [], [], []
        for li, k in enumerate(self.langs):
            held = [t for i, t in enumerate(by[k]) if not i % 5] if len(by[k]) >= 5 else by[k]
            h, letters, n = self.entropies(held, {})
            ok = letters > 0
            x = h[ok, li]
            if len(x):
                self.mean[li] = np.median(x)
                self.sd[li] = max(0.1, 1.4826 * float(np.median(np.abs(x - self.mean[li]))))
            hs.append(h[ok]), ns.append(n[ok]), true.append(np.full(int(ok.sum()), li))
        if hs and sum(map(len, hs)):
            h, n, t = np.concatenate(hs), np.concatenate(ns), np.concatenate(true)
            grid = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
            loss = [-np.log(np.maximum(self._posterior(h, n, a)[np.arange(len(t)), t], 1e-12)).mean() for a in grid]
            self.slope = grid[int(np.argmin(loss))]

    def _posterior(self, h: np.ndarray, n: np.ndarray, slope: float) -> np.ndarray:
        x = -h * (slope * np.sqrt(np.maximum(n, 1)))[:, None]
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None], memo: dict) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, calibrated score, cross-entropy and rejection of each text."""
        if not self.langs:
            z = np.zeros(len(texts))
            return [UND] * len(texts), z, z, z == 0
        h, letters, n = self.entropies(texts, memo)
        best = h.argmin(1)
        i = np.arange(len(texts))
        p, low = self._posterior(h, n, self.slope)[i, best], h[i, best]
        none = letters == 0
        z = (low - self.mean[best]) / (self.sd[best] * np.sqrt(1 + 400 / np.maximum(n, 1)))
        langs = [UND if x else self.langs[b] for x, b in zip(none.tolist(), best.tolist())]
        return langs, np.where(none, 0.0, p), np.where(none, 0.0, low), none | (z > REJECT)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def fit(labelled: DataFrame) -> Models:
    """Models of a bounded sample of the rows (doc_id, text, lang)."""
    d = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"), F.length("text").alias("_n"))
    short = F.col("_n") <= SAMPLE_CHARS
    parts = 1 << 30
    place = F.pmod(F.col("_h"), F.lit(parts))
    sums = [F.count_if(short).alias("n"), F.sum(F.when(short, F.col("_n"))).alias("chars"), F.min("_n").alias("least"), F.min(F.when(short, place)).alias("first")]
    counts = {r["lang"]: r for r in d.groupBy("lang").agg(*sums).collect()}
    if not counts:
        return Models([])
    share = SAMPLE_TOTAL / len(counts)
    # how far hashes reach, so that so many rows and characters are expected
    most = {k: min(1.0, SAMPLE_DOCS / r["n"], share / max(1, r["chars"])) if r["n"] else 0.0 for k, r in counts.items()}
    # the row of a language's smallest hash is always among them; a language of long rows only has its shortest
    reach = F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(max(int(parts * v), counts[k]["first"] or 0) + 1))])
    least = F.create_map(*[x for k, r in counts.items() for x in (F.lit(k), F.lit(-1 if r["n"] else r["least"]))])
    picked = short & (place < F.element_at(reach, F.col("lang"))) | (F.col("_n") == F.element_at(least, F.col("lang")))
    # equal rows count once; of a language without short rows one text is left
    key = F.when(short, F.col("_h")).otherwise(F.lit(0).cast("long"))
    got = d.where(picked).groupBy("lang", key.alias("_k")).agg(F.min("text").alias("text")).collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["_k"] % parts, r["text"])):
        by.setdefault(r["lang"], []).append((r["lang"], r["text"]))
    return Models([x for rows in by.values() for x in rows[:SAMPLE_DOCS]])


RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


def identify(docs: DataFrame, models: Models, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected, all named with the prefix."""
    own = [prefix + c.split()[0] for c in RESULT.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = docs.columns
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + ", ".join(prefix + c for c in RESULT.split(", "))

    def run(batches):
        release()
        m, memo = shared.value, {}
        for batch in batches:
            texts = batch.column(at).to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size < CHUNK):
                    size += len(texts[b] or "")
                    b += 1
                langs, score, low, no = m.predict(texts[a:b], memo)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(no)],
                    names=[*names, *own],
                )
                a = b

    return docs.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(5) == 0
    models = fit(docs.where(~held).select("doc_id", "text", "lang"))
    d = docs.select("doc_id", held.alias("held_out"), "text")
    return identify(d, models).drop("text")
