import io
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from grainline.llm import cap_filters, chunk_dedup, katz_lm, language_id, lsh_forest, mixing, packing, quality_rules, tokens, warc, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long, dups string, node long"
LONG = " ".join(f"word{i}" for i in range(120))
EDGE = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, " \n\t", "en", "a", 3, "x", 1), (4, "one two", "en", "a", 7, "x", 1),
    (5, LONG, "en", "b", 9, "x", 1), (6, LONG + " more", "en", "b", 9, "x", 1), (7, LONG, "fr", None, 9, "x", 1), (7, LONG, "fr", None, 9, "x", 1),
    (8, "x" * 300_000, "fr", "b", 1, "x", 1), (None, "no id here", "fr", "b", 1, "x", 1), (9, "a  b\n\n c <|endoftext|> d", "fr", "b", 1, "x", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _same(spark_rows, sql, sf, tables=("documents", "pages")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    b = con.sql(sql).df()
    a = spark_rows.toPandas()[b.columns]
    key = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).values.tolist()))
    assert key(a) == key(b)


def test_quality_rules_against_sql(spark, sf):
    _same(quality_rules.op1_quality_rules(spark, sf), quality_rules.ORACLE, sf)


def test_quality_rules_edges(edge):
    r = {x["doc_id"]: x for x in quality_rules.clean(edge).collect()}
    assert r[1]["n_words"] == 0 and r[1]["base_failed"] and not r[1]["kept"]
    assert r[5]["n_words"] == 120 and r[5]["n_repeat_words"] == 0 and not r[5]["base_failed"]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    texts = [x[1] for x in EDGE] + ["ΣΑΣ ñ  x", "it's 3,5. ", "aİ.\nb क़. ΑΣ,\nΣΑΣ.", "a.\nb c²..\nd e.'s", "é ́ a", "a ​ b\x1c c"]
    import pyarrow as pa

    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = packing.default_vocabulary(name)
        model = Tokenizer.from_file(path)
        ids, n = tokens.Encoder(path, spaced).encode(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(n)])
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == model.encode(t or "", add_special_tokens=False).ids, t


def test_packing_round_trip(edge):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = packing.pack(edge, path, capacity=256).collect()
    texts = {x[0]: x[1] for x in EDGE}
    by, seq = Counter(), {}
    for r in rows:
        ids = (model.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1])[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        by[r["doc_id"]] += r["length"]
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(by[d] == (2 if d == 7 else 1) * (len(model.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in texts.items())
    for x in seq.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 256


def test_best_fill_is_closest():
    from itertools import product

    for lengths, room in (([5, 5, 7, 11], 16), ([9, 4, 4, 3], 14), ([6], 5)):
        c = Counter(lengths)
        got = packing.best_fill(dict(c), sorted(c, reverse=True), room)
        assert all(got[k] <= c[k] for k in got)
        best = max(s for k in product(*[range(c[x] + 1) for x in c]) if (s := sum(a * b for a, b in zip(k, c))) <= room)
        assert sum(k * n for k, n in got.items()) == best


def test_wavelet_matrix():
    a = np.random.default_rng(1).integers(0, 700, 150_000)
    w = wavelet.WaveletMatrix(io.BytesIO(wavelet.build(a, [(3, 100_000), (None, 50_000)])))
    assert (w.decode() == a).all() and w.docs == [(3, 100_000), (None, 50_000)]
    for i in (0, 65_535, 65_536, 149_999):
        assert w.access(i) == a[i]
    assert w.rank(5, 90_000) == (a[:90_000] == 5).sum() and w.rank(9999) == 0
    assert w.select(5, 40) == np.flatnonzero(a == 5)[40]
    with pytest.raises(IndexError):
        w.select(5, 10**6)


def test_token_shards(spark, sf, docs):
    got = wavelet.op10_token_shards(spark, sf).orderBy("doc_id").collect()
    assert len(got) == docs.count()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_mixing_totals(spark, sf):
    d = mixing.op8_mixing(spark, sf).toPandas()
    assert (d.taken <= 2 * d["size"]).all()
    again = mixing.op8_mixing(spark, sf).toPandas()
    assert sorted(map(tuple, d.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    assert abs(d.taken.sum() - 1.5 * d["size"].sum()) < 0.05 * 1.5 * d["size"].sum()


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(1, 900, 400).astype(float), np.ones(400)], 1)
    p = np.full(400, 0.37)
    q = mixing.flight(x, p)
    assert ((q > 0) & (q < 1)).sum() <= 2 and np.allclose(x.T @ q, x.T @ p)


def test_mixing_edges(edge, spark):
    d = mixing.decide(edge).collect()
    assert sum(r["n"] for r in d) == len(EDGE) and all(r["total"] <= 2 * r["n"] for r in d)
    assert mixing.decide(edge.limit(0)).count() == 0
    assert mixing.mix(edge).columns == edge.columns


def test_language_id(spark, sf, docs):
    r = language_id.op4_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = r[r.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and r.score.between(0, 1).all() and r.rejected.mean() < 0.05


def test_language_id_edges(edge):
    m = language_id.fit(edge.select("doc_id", "text", "lang"))
    r = {x["doc_id"]: x for x in language_id.identify(edge.select("doc_id", "text"), m).collect()}
    assert r[1]["lang_pred"] == r[2]["lang_pred"] == "und" and r[5]["lang_pred"] in ("en", "fr")
    assert language_id.Models([]).predict(["abc"], {})[0] == ["und"]


def test_language_models_sum_to_one():
    m = language_id.Models([("en", "the cat sat on the mat and the rat"), ("de", "der hund und die katze")] * 5)
    s = m.keys(m._map(language_id.symbols(["the ca"])[0]))[-1:]
    b = np.uint64(m.bits)
    every = (s >> b << b) + np.arange(1, len(m.alphabet) + 2, dtype=np.uint64)
    total = np.exp(m.log_probs(every).astype(float)).sum(0)
    assert ((total > 0.9) & (total < 1.01)).all()


def test_warc_against_sql(spark, sf):
    _same(warc.op5_warc(spark, sf), warc.ORACLE, sf)


def test_warc_revisits(spark, tmp_path):
    big = "y" * 1500
    rows = [(1, "u", big, 0), (2, "u\r\nx", big, 0), (3, None, None, 0), (4, "u", "short", 0), (5, "u", "short", 0)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    out = warc.read(warc.normalise(warc.write(warc.plan(p), f"file://{tmp_path}/a"), f"file://{tmp_path}/b")).orderBy("page_id").collect()
    assert [(r["record_type"], r["refers_to"]) for r in out] == [("revisit", 2), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert [r["payload_bytes"] for r in out] == [1500, 1500, 0, 5, 5]


def test_cap_filters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 64))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(64) * rng.choice([0.05, 0.25, 0.4])
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(400, None, 1), (401, [0.0] * 64, 1), (402, [float("nan")] * 64, 1), (403, rows[0][1], 0), (404, rows[0][1], None)]
    got = {r["vec_id"]: r for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    n, want = 0, 0
    for i, v, label in rows:
        if i in (400, 401, 402, 404):
            assert got[i]["n_links"] == 0 and got[i]["component_id"] == i
            continue
        links = 0
        for j, w, other in rows:
            if j != i and other == label and w is not None and j < 404 and j not in (401, 402):
                links += np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93
        assert got[i]["n_links"] <= links
        n, want = n + got[i]["n_links"], want + links
    assert want > 0 and n >= 0.9 * want


@pytest.mark.parametrize("n, dims", [(2000, 64), (100_000, 64), (1_000_000, 64), (100_000, 4), (3000, 2), (100_000, 9), (100_000, 300)])
def test_cap_filters_meet_at_the_cosine(n, dims):
    b, least, number = cap_filters.tune(n, dims)
    x, y = cap_filters.pairs_at(dims, 3000, 0.93, np.random.default_rng(77))
    hit = np.zeros(3000, bool)
    for k in range(number):
        hit |= cap_filters.meet(cap_filters.code(dims, b, least, k), x, y)
    assert hit.mean() >= 0.994


def test_cap_filters_in_few_dimensions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.standard_normal(4)], 1) for i in range(2000)] + [(2000, [2.0], 1), (2001, [3.0], 1), (2002, [-1.0], 1)]
    got = {r["vec_id"]: r["n_links"] for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([v for _, v, _ in rows[:2000]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(1) - 1
    assert sum(got[i] for i in range(2000)) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in range(2000))
    assert [got[i] for i in (2000, 2001, 2002)] == [1, 1, 0]


def test_jaccard_join_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(10_001, None), (10_002, ""), (10_003, LONG), (10_004, LONG + " tail"), (10_004, LONG + " tail")]
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sets = []
    for _, t in rows:
        w = _words(t)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    links, up = Counter(), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))
    assert sorted(zip(got.doc_id, got.class_id, got.n_links)) == want


def test_chunks_resist_insertions(spark):
    rng = np.random.default_rng(2)
    vocab = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choice(vocab, n))
    passage = make(90)
    rows = [(i, f"{make(60)} {passage} {make(60)}" if i % 2 else make(200)) for i in range(20)] + [(50, None), (51, ""), (52, "word")]
    r = {x["doc_id"]: x for x in chunk_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert r[1]["removed_words"] == 0 and all(r[i]["removed_words"] >= 60 for i in range(3, 20, 2))
    assert all(r[i]["removed_words"] == 0 and r[i]["clean_text"] == rows[i][1] for i in range(0, 20, 2))
    assert r[50]["clean_text"] is None and r[51]["n_chunks"] == 0


def test_chunks_of_texts_that_share_an_id(spark):
    from pyspark.sql import functions as F

    # two copies of a passage under no id, in texts whose hashes agree in 24 bits: one of them is cut
    words = " ".join(f"w{i}" for i in range(60))
    d = spark.range(16_000).select(F.concat(F.lit(words + " end"), "id").alias("s"))
    d = d.withColumn("x", F.pmod(F.xxhash64("s"), F.lit(1 << 24)))
    a, b = d.groupBy("x").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("a", "b").first()
    r = chunk_dedup.mark(spark.createDataFrame([(None, a), (None, b), (1, "other")], "doc_id long, text string")).collect()
    assert sorted(x["removed_words"] > 0 for x in r) == [False, False, True]


def test_katz_scores(spark):
    rows = [(i, t, i % 4 == 3) for i, t in enumerate(["the cat sat", "the cat ran", "The dog sat down", "the unseen cat", None, "", "cat cat cat", "dog the cat"])]
    got = {r["doc_id"]: r for r in katz_lm.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean")).collect()}
    train = [[*_words(t), "</s>"] for _, t, h in rows if not h]
    uni = Counter(w for t in train for w in t)
    big = Counter(p for t in train for p in zip(["</s>", *t[:-1]], t))
    n = [Counter(uni.values())[r] for r in range(8)]
    u, d = katz_lm.Unigrams([0, *n[1:]], sum(uni.values()), len(uni)), katz_lm.discounts([0, *[Counter(big.values())[r] for r in range(1, 8)]])
    p1 = lambda w: float(u.p(np.array([uni[w]]))[0])

    def p(v, w):
        if not uni[v]:
            return p1(w)
        seen = {x: c for (a, x), c in big.items() if a == v}
        keep, left = 1.0, 1 - sum((d[c] if c <= 5 else 1) * c for c in seen.values()) / uni[v]
        if left <= 1e-12:
            keep, left = uni[v] / (uni[v] + 1), 1 / (uni[v] + 1)
        if w in seen:
            return keep * (d[seen[w]] if seen[w] <= 5 else 1) * seen[w] / uni[v]
        return left / (1 - sum(p1(x) for x in seen)) * p1(w)

    for i, t, _ in rows:
        w = [*_words(t), "</s>"]
        assert got[i]["score"] == pytest.approx(sum(np.log10(p(a, b)) for a, b in zip(["</s>", *w[:-1]], w)))
    for v in ("the", "cat", "</s>"):
        assert sum(p(v, w) for w in uni) + p(v, "never") == pytest.approx(1)


def test_pipeline_on_edges(spark, edge):
    import corpus_pipeline as cp

    d = edge
    for _, stage in cp.STAGES:
        cols = d.columns
        d = stage(spark, d, "")
        if stage is not cp.STAGES[-1][1]:
            assert d.columns == cols
    assert d.count() > 0
    empty = edge.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_pipeline_keeps_one_document_of_each_group(spark):
    import corpus_pipeline as cp

    make = lambda k: " ".join(f"{k}word{i}" for i in range(60))
    rows = [(None, make("a")), (None, make("b")), (7, make("c")), (7, make("d")), (7, make("d")), (8, make("d") + " tail"), (None, make("c") + " tail"), (9, None), (None, ""), (None, " ")]
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [rows[i] for i in (0, 1, 2, 3, 7, 8, 9)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
