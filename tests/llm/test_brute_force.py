"""Queries held against plain Python, and the cases that every operator has to take."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainline.llm import cap_filters, chunk_dedup, common, components, katz_lm, language_id, lsh_forest, mixing, packing, quality_rules, tokens, warc, wavelet

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


def _library(name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_vocabulary(name))
    return lambda t: model.encode(t or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_shards_hold_the_library_ids(spark, sf, rows):
    encode, start, want = _library("byte_bpe_50k.json"), 0, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*encode(r["text"]), 0]
        want[r["doc_id"]] = (start, len(ids), _crc(ids))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.op10_token_shards(spark, sf).collect()}
    assert got == want


def test_packing_query_round_trip(spark, sf, rows):
    encode = _library("word_bpe_49k.json")
    want = {r["doc_id"]: [*encode(r["text"]), 1] for r in rows}
    got, sequences, pieces = defaultdict(list), defaultdict(list), packing.op6_packing(spark, sf).collect()
    for r in pieces:
        own = want[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == _crc(own[r["start"] : r["start"] + r["length"]])
        got[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in want.items():
        at = 0
        for start, n in sorted(got[d]):
            assert start == at
            at += n
        assert at == len(own)
    padding = 0
    for x in sequences.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.001 * sum(map(len, want.values()))


def _kneser_ney(texts, alphabet):
    """Plain interpolated Kneser-Ney over strings: a function of (context of up to three, symbol)."""
    grams = Counter()
    for t in texts:
        s = "\0\0\0" + t
        grams.update(s[i - 3 : i + 1] for i in range(3, len(s)))
    orders = []
    for n in range(4, 0, -1):
        n1, n2 = (sum(c == k for c in grams.values()) for k in (1, 2))
        d = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
        total, kinds = Counter(), Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        orders.append((n, d, dict(grams), total, kinds))
        grams = Counter(g[1:] for g in grams)

    def p(gram):
        out = 1.0 / (alphabet + 2)
        for n, d, counts, total, kinds in orders[::-1]:
            g = gram[4 - n :]
            h = g[:-1]
            if total[h]:
                out = max(0.0, counts.get(g, 0) - d) / total[h] + d * kinds[h] / total[h] * out
        return out

    return p


def test_language_models_against_plain_python():
    sample = [("en", f"The cat sat on mat number {'abc'[i % 3]} and ran") for i in range(10)] + [("de", f"Der Hund und die Katze {'xyz'[i % 3]} schlafen") for i in range(10)]
    m = language_id.Models(sample)
    clean = lambda t: re.sub("[^a-z]+", " ", t.lower())
    fits = {k: [clean(t) for i, t in enumerate(x for lang, x in sample if lang == k) if i % 5] for k in ("de", "en")}
    alphabet = len({c for v in fits.values() for t in v for c in t})
    text = "the katze sat und slept on qq"
    s = "\0\0\0" + "".join(c if any(c in t for v in fits.values() for t in v) else "\1" for c in clean(text))
    h = m.entropies([text], {})[0][0]
    for li, k in enumerate(m.langs):
        p = _kneser_ney(fits[k], alphabet)
        assert h[li] == pytest.approx(-sum(math.log(p(s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3), rel=1e-4)


def test_language_without_letters_is_not_learnt(spark):
    m = language_id.Models([("en", "some words here"), ("xx", ""), ("yy", "123 !!")])
    assert m.langs == ["en"] and m.predict(["word", "", None], {})[0] == ["en", "und", "und"]
    long = [(i, "ab " * 60_000 + str(i), "zz", "x") for i in range(2)]
    d = spark.createDataFrame([(i, "only some words", "en", "x") for i in range(30)] + [(1, "only some words", "en", "x")] * 30 + long + [(7, "", "xx", "x"), (8, None, "en", "x"), (9, "none", None, "x")], "doc_id long, text string, lang string, lang_pred string")
    a, b = (language_id.fit(d.repartition(k)) for k in (1, 5))
    assert a.langs == b.langs == ["en", "zz"]  # a language of long texts only is learnt from its shortest
    assert a.predict(["only words"], {})[2].tolist() == b.predict(["only words"], {})[2].tolist()
    assert language_id.identify(d.limit(0), a, "_gl_").count() == 0


def test_mixing_against_the_water_level(spark, sf, rows):
    d = mixing.op8_mixing(spark, sf).collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_, target = Fraction(3, 2) * sum(size.values()), set(names), {}
    while True:
        level = goal / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = Fraction(2 * size[s])
            goal -= target[s]
            open_.remove(s)
    of = {r["doc_id"]: r["source"] for r in rows}
    taken, text = Counter(), {r["doc_id"]: r["text"] for r in rows}
    for r in d:
        s = of[r["doc_id"]]
        assert r["size"] == len(WORD.findall(text[r["doc_id"]] or "")) and r["source_size"] == size[s] and r["target"] == pytest.approx(float(target[s]))
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    longest = max(r["size"] for r in d)
    assert all(abs(taken[s] - float(target[s])) <= max(0.05 * float(target[s]), 0.5 * longest) for s in names)


def _chunks(text):
    """Chunk ends by the rule in words: a gear hash over the 16 bytes up to each word's end, smallest of its neighbours."""
    raw = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    padded, value = b" " * 16 + raw, []
    for _, e in found:
        h = 0
        for byte in padded[e : e + 16]:
            h = (2 * h + int(chunk_dedup.GEAR[byte])) & 0xFFFFFFFF
        value.append(int(language_id.mix64(np.array([h], np.uint64))[0]))
    out, start = [], 0
    for i in range(len(found)):
        last = i == len(found) - 1
        if last or all(value[i] < v for v in value[max(0, i - 3) : i]) and all(value[i] <= v for v in value[i + 1 : i + 4]):
            out.append((start, i + 1, tuple(raw[a:b] for a, b in found[start : i + 1])))
            start = i + 1
    return out


def test_chunk_dedup_against_plain_sets(spark):
    rng = np.random.default_rng(12)
    vocab = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(500)]
    passage = " ".join(rng.choice(vocab, 70))
    rows = [(i, "\n ".join([" ".join(rng.choice(vocab, 40)), passage if i % 3 else "", " ".join(rng.choice(vocab, 30))])) for i in range(12)]
    rows += [(20, passage + " " + passage), (21, None), (22, " \t"), (23, "x" * 200_000), (24, "é ñ"), (None, rows[1][1])]
    got = {r["doc_id"]: r for r in chunk_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first: dict = {}
    order = sorted(range(len(rows)), key=lambda i: -math.inf if rows[i][0] is None else rows[i][0])
    for i in order:
        for k, (_, _, words) in enumerate(_chunks(rows[i][1])):
            first.setdefault(words, (i, k))
    for i in order:
        chunks = _chunks(rows[i][1])
        dup = [first[w] != (i, k) for k, (_, _, w) in enumerate(chunks)]
        spans, k = [], 0
        while k < len(chunks):
            if dup[k]:
                j = k
                while j < len(chunks) and dup[j]:
                    j += 1
                if chunks[j - 1][1] - chunks[k][0] >= chunk_dedup.MIN_WORDS:
                    spans.append((chunks[k][0], chunks[j - 1][1]))
                k = j
            else:
                k += 1
        r = got[rows[i][0]]
        assert (r["n_chunks"], r["n_dup_chunks"], [tuple(s) for s in r["spans"]]) == (len(chunks), sum(dup), spans)


def test_forest_against_clashes_and_its_own_floor(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocab, 120).tolist() for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base[i % 12])
        for j in rng.choice(120, i % 5, replace=False):
            w[j] = "changed" + str(rng.integers(5))
        rows.append((i % 140 if i % 7 else None, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: sorted(map(repr, x.select("doc_id", "class_id", "n_links", "kept").collect()))
    full = lsh_forest.near_duplicates(d)
    # with six bits for the first half most texts clash, and the second half keeps them apart
    assert key(lsh_forest.near_duplicates(d, bits=6)) == key(full)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert sum(r["n_links"] for r in full.collect()) == 2 * want
    stops = Counter(r["stop"] for r in full.collect())
    assert set(stops) <= {None, 8, 9} and stops[9] > 0  # close copies stop early, but not before pairs at the threshold are found
    assert lsh_forest.level() == 8 and lsh_forest.level(recall=lsh_forest.LEAST) == lsh_forest.DEPTH == 9 and lsh_forest.matches() == 6
    assert lsh_forest.near_duplicates(d.limit(0)).count() == 0


def test_forest_finds_links_at_the_threshold(spark):
    """Pairs of a similarity of exactly 0.8 are linked, alone, with a copy on one side and with copies on both."""
    rng, rows, want, kinds = np.random.default_rng(6), [], {}, {}
    for i in range(450):
        w = rng.integers(0, 10**9, 364).astype(str)
        cut = w.copy()
        cut[[40, 80, 120, 160, 200, 240, 280, 320]] = "x"  # 40 of 360 runs change: 320 / 400
        texts = [[*w], [*cut], [*w, "end"], [*cut, "end"]][: 2 + i % 3]
        sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
        for k, t in enumerate(texts):
            rows.append((4 * i + k, " ".join(t)))
            want[4 * i + k] = sum(10 * len(sets[k] & s) >= 8 * len(sets[k] | s) for s in sets) - 1
            kinds[4 * i + k] = i % 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in lsh_forest.near_duplicates(d).collect()}
    assert all(got[i] <= n for i, n in want.items())
    for kind in range(3):
        assert np.mean([got[i] == n for i, n in want.items() if kinds[i] == kind]) >= 0.985, kind


def test_counts_of_any_size_round_trip():
    for a in ([], [0], [1, 255, 256], [2**32 + 5, 0, 7], [2**40]):
        assert katz_lm.spread(katz_lm.squeeze(np.array(a, np.int64))).tolist() == a
    assert katz_lm._sum(np.array([0, 0, 1]), [np.array([2**33, 1, 2**53 + 1])], 2).tolist() == [2**33 + 1, 2**53 + 1]


def test_components_of_long_chains(spark):
    n = 130  # more than any fixed number of rounds would do along a chain
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}


def test_wide_ids_and_memory_bounds(monkeypatch):
    texts = [f"Word{i} and, more\nwords{i % 7}." for i in range(300)] + ["", None, "x" * 5000]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        encode = _library(name)
        monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)  # the cache starts again many times
        e = tokens.Encoder(packing.default_vocabulary(name), spaced)
        e.kind = np.uint32
        e._reset()
        out = []
        for a, k in tokens.slices(pa.array(texts), 2000):
            ids, n = e.encode(pa.array(texts).slice(a, k))
            assert ids.dtype == np.uint32
            out += np.split(ids, np.cumsum(n)[:-1])
        assert [x.tolist() for x in out] == [encode(t) for t in texts]
        assert e.held < 400_000
    ids = np.array([70_000, 3, 70_000, 65_536])
    import io

    assert wavelet.WaveletMatrix(io.BytesIO(wavelet.build(ids, [(1, 4)]))).decode().tolist() == ids.tolist()


CASES = [(None, None), (None, ""), (1, " \n"), (1, "same text twice"), (1, "same text twice"), (2, "y" * 250_000), (3, "| a | b |\nClick here"), (None, "no id " * 40)]


def test_every_operator_on_odd_rows_and_none(spark, tmp_path):
    text = spark.createDataFrame([(d, t, "own", i) for i, (d, t) in enumerate(CASES)], "doc_id long, text string, kept string, place int")
    pages = spark.createDataFrame([(None, None, None), (None, "u", "z" * 2000), (4, "u", "z" * 2000), (4, "u", "z" * 2000), (5, "v", ""), (6, None, "w" * 300_000)], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(1, [], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, None, None)], "vec_id long, embedding array<double>, label int")
    path = packing.default_vocabulary("byte_bpe_50k.json")
    held = lambda d: d.withColumn("held", F.col("place") % 2 == 0)

    def shards(d):
        return wavelet.read_shards(wavelet.write_shards(d, path, common.scratch(spark, "t")).withColumn("begins", F.lit(0).cast("long")))

    def archives(d):
        return warc.read(warc.normalise(warc.write(warc.plan(d), common.scratch(spark, "a")), common.scratch(spark, "b")))

    runs = (
        (text, quality_rules.clean), (text, lambda d: katz_lm.score(held(d))), (text, lsh_forest.near_duplicates), (text, chunk_dedup.mark),
        (text, shards), (pages, archives), (vectors, cap_filters.near_duplicates),
    )
    out = {}
    for d, run in runs:
        assert run(d.limit(0)).count() == 0
        out[run] = run(d).collect()
        assert len(out[run]) == d.count()
    clean, scored, near, marked, read, archived, linked = (out[r] for _, r in runs)
    assert [r["place"] for r in clean] == list(range(8)) and "place" in quality_rules.clean(text).columns
    assert all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in scored)
    assert sorted(r["n_links"] for r in near) == [0, 0, 0, 0, 0, 0, 1, 1]
    assert {r["n_words"] for r in marked} >= {0, 3, 1}
    encode = _library("byte_bpe_50k.json")
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in read) == sorted((len(i), _crc(i)) for i in ([*encode(t), 0] for _, t in CASES))
    assert Counter((r["record_type"], r["refers_to"]) for r in archived) == {("response", None): 5, ("revisit", 4): 1}
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in linked) == [(0, 3), (1, 0), (1, 3), (1, 3), (2, 3), (3, 0), (4, 0)]


def test_pipeline_stages_on_a_small_table(spark, sf, docs):
    import corpus_pipeline as cp

    known = cp.identify(spark, docs, sf)
    ids = {r["doc_id"] for r in known.select("doc_id").collect()}
    judged = language_id.identify(docs, language_id.fit(docs.where(common.remainder(5) != 0).select("doc_id", "text", "lang"))).collect()
    assert ids == {r["doc_id"] for r in judged if not r["rejected"]}
    kept = cp.near_duplicates(spark, docs, sf).collect()
    classes = lsh_forest.near_duplicates(docs).where("component is not null").select("doc_id", "component").collect()
    least = {}
    for r in classes:
        least[r["component"]] = min(r["doc_id"], least.get(r["component"], r["doc_id"]))
    words = [r["doc_id"] for r in docs.collect() if not WORD.search(r["text"] or "")]
    assert sorted(r["doc_id"] for r in kept) == sorted([*least.values(), *words])
    mixed = Counter(r["doc_id"] for r in cp.mix(spark, docs, sf).collect())
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.op8_mixing(spark, sf).collect() if r["taken"]}
    assert mixed == want
