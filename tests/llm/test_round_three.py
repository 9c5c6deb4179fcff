import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainline.llm import cap_filters, conversation_repair, language_id, merkle, mixing, packing, permutation_index, quality_rules, tokens, warc
from grainline.llm.queries import ORACLES
from test_llm import _same

WORDLESS = " \t\n\x0b\x0c\r"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(rows, fan=16):
    """root, and of each leaf (group, leaf): subroot and siblings; rows: (group, leaf) in order."""
    by = defaultdict(list)
    for g, x in rows:
        by[g].append(x)

    def up(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                a = i // fan * fan
                paths[k].append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fan])))
            nodes = [sha(*nodes[a : a + fan]) for a in range(0, len(nodes), fan)]
            at = [i // fan for i in at]
        return nodes[0], paths

    names = sorted(by)
    subs = {g: up(by[g]) for g in names}
    root, over = up([subs[g][0] for g in names])
    return root, {g: (subs[g][0], [p + over[i] for p in subs[g][1]]) for i, g in enumerate(names)}


@pytest.mark.parametrize("query", ["op11_merkle_manifest", "op13_conversation_repair"])
def test_against_sql(spark, sf, query):
    from grainline.llm.queries import QUERIES

    _same(QUERIES[query](spark, sf), ORACLES[query], sf, ("documents", "pages", "conversations"))


def test_manifest_over_several_rounds(spark):
    """Blocks of 16 leaves make a tree of four rounds; a third of the rows in one source, many tiny ones, one null."""
    rows = [("=hot", i, f"h{i}") for i in range(1500)] + [(f"=s{i % 300:03}", i, f"t{i}") for i in range(900)] + [("", None, "n"), ("", None, "n"), ("=one", 7, "o")]
    d = spark.createDataFrame([(g, i, hashlib.sha256(x.encode()).digest()) for g, i, x in rows], "grp string, doc_id long, leaf binary")
    d = d.withColumn("altered", F.when(F.col("doc_id") % 10 == 0, F.unhex(F.sha2("leaf", 256))))
    got = merkle.manifest(d, block=16).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, sha(r[2])))
    root, want = plain_tree([(g, sha(x)) for g, _, x in order])
    seen = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["grp"], r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"])):
        seen[r["grp"]].append(r)
    assert len(got) == len(rows) and {r["root"] for r in got} == {root}
    for g, some in seen.items():
        sub, paths = want[g]
        for r, p in zip(some, paths):
            assert r["subroot"] == sub and r["proof_sha256"] == sha(*[x for both in p for x in both])
            assert r["verified"] == (r["doc_id"] is None or r["doc_id"] % 10 != 0) == (r["folded_root"] == root)
    assert merkle.manifest(d.limit(0)).count() == 0


def test_manifest_leaves_hold_lengths(spark):
    d = spark.createDataFrame([(1, None, "é", None, ""), (None, "s", None, 3, "Aé")], "doc_id long, source string, lang string, n_chars long, text string")
    got = d.select(merkle.leaf(*[F.col(c) for c in merkle.FIELDS]).alias("x"), merkle.tampered(F.col("text")).alias("t")).collect()
    assert got[0]["x"] == sha("1:1", "-", "2:é", "-", "0:") and got[1]["x"] == sha("-", "1:s", "-", "1:3", "3:Aé")
    assert [r["t"] for r in got] == ["", "aé"]


def neighbours(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        score = x @ q
        order = sorted((-s, j) for s, j in zip(score, ids) if j != i)
        out[i] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("n,dims,scale", [(3000, 64, 0.0), (1500, 8, 1.0), (12, 5, 1.0)])
def test_permutation_index_recall(spark, n, dims, scale):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, dims))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(scale * rng.standard_normal((n, 1)) * 0.5)  # unequal lengths count in products
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = permutation_index.nearest(d, F.col("vec_id") % 20 == 0, vectors_a_block=40, queries_a_block=20).collect()
    want, by = neighbours(list(range(n)), x), defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
    assert set(by) == set(range(0, n, 20)) and {len(v) for v in by.values()} == {min(20, n - 1)}
    for q, some in by.items():
        assert [r["rank"] for r in some] == list(range(1, len(some) + 1))
        assert [(-r["score"], r["vec_id"]) for r in some] == sorted((-r["score"], r["vec_id"]) for r in some)
    assert np.mean([len({r["vec_id"] for r in v} & set(want[q])) / len(v) for q, v in by.items()]) >= 0.9


def test_permutation_index_on_odd_vectors(spark):
    rows = [(20, [1.0, 0.0], 0), (21, [1.0, 0.0], 0), (22, [1.0, 0.0], 0), (23, [0.5, 0.5], 0), (23, [0.5, 0.5], 0), (24, [-1.0, 0.0], 0), (40, [1.0, 0.0, 0.0], 0), (60, None, 0), (80, [], 0)]
    rows += [(100, [0.0, 0.0], 0), (120, [float("nan"), 1.0], 0), (140, [None, 1.0], 0), (None, [1.0, 0.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = permutation_index.nearest(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(20, 1, 21, 1.0), (20, 2, 22, 1.0), (20, 3, 23, 0.5), (20, 4, 24, -1.0)]
    assert permutation_index.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    # a third of all rows equal: the smallest ids of them win, and no more are indexed than can be answers
    hot = spark.range(600).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.rand(1), F.rand(2))).alias("embedding"))
    first = [r["vec_id"] for r in permutation_index.nearest(hot, F.col("vec_id") == 60, k=5).orderBy("rank").collect()]
    assert first == [0, 3, 6, 9, 12]


def test_footrule_by_inverted_lists():
    rng = np.random.default_rng(2)
    perms = np.argsort(rng.random((30, 12)), axis=1)[:, :5]
    w = permutation_index.overlap(perms[:7], perms, 12)
    for i in range(7):
        for j in range(30):
            at = [{p: k for k, p in enumerate(x)} for x in (perms[i].tolist(), perms[j].tolist())]
            distance = sum(abs(at[0].get(p, 5) - at[1].get(p, 5)) for p in set(at[0]) | set(at[1]))
            assert distance == 5 * 6 - 2 * w[i, j]


def plain_repair(rows):
    """One conversation's rows (turn, role, text) after damage: what the contract says, by exhaustive search in cost order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(WORDLESS)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            done = (cost, audit, out)
            break
        word = {"u": "user", "a": "assistant"}
        for r in step[state].replace("s", ""):
            if len(audit) < 3 * len(rows) + 4:
                heapq.heappush(heap, (cost + 2, audit + "I", i, r, (*out, f"{word[r]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                extra = faults[i] == "truncated"
                if role[:1] and role[:1] in step[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for r in step[state].replace("s", ""):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, r, (*out, f"{word[r]}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, done[0], done[1], sha("\n".join(done[2])))


def test_repair_against_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    said = ["Fine.", "Fine. ", "cut", "", " \n", "Ends?\x0b", "x. ", "one two"]
    rows, by = [], defaultdict(list)
    for c in [None, *range(160)]:
        for _ in range(rng.integers(1, 7)):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 6))
            r = (turn, str(rng.choice(["user", "assistant", "system", "tool", ""], p=[0.4, 0.35, 0.15, 0.05, 0.05])), str(rng.choice(said)))
            rows.append((c, *r))
            by[c].append(r)
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies long")
    d = d.withColumn("digest", F.unhex(F.sha2("text", 256)))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for block in (2, 2000):  # blocks of two rows chain
        got = {r["conv_id"]: tuple(r[c] for c in names) for r in conversation_repair.repair(d, block=block).collect()}
        assert got == {c: plain_repair(r) for c, r in by.items()}


def test_repair_of_one_long_conversation(spark):
    """A conversation over many ranges and blocks equals one block's search; a row repeated 500 times is one lattice step."""
    d = spark.range(3000).select(
        F.lit(1).cast("long").alias("conv_id"), (F.col("id") * 2).alias("turn"), F.when(F.col("id") % 7 < 4, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, "").otherwise(".")).alias("text"), F.when(F.col("id") == 77, 500).otherwise(1).cast("long").alias("copies"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    a, b = (conversation_repair.repair(d, block=n).collect() for n in (100, 10_000))
    assert a == b and a[0]["duplicate"] == 499 and a[0]["truncated"] == 600 and a[0]["gaps"] == 2999


def test_damage_and_empty_conversations(spark):
    rows = [(c, t, r, x) for c in range(60) for t, r, x in ((0, "user", "Hi. There!"), (1, "assistant", "Yes?"), (None, None, None))] + [(None, 1, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(repr, (tuple(r)[:4] + (r["copies"],) for r in conversation_repair.damaged(d).collect())))
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        x = "" if k == 1 else x.translate({ord(y): None for y in ".!?"}) if k == 2 else x
        if k:
            want.append((c, t, "user" if k == 4 else r, x, 2 if k == 3 else 1))
    assert got == sorted(map(repr, want))
    assert conversation_repair.repair(conversation_repair.damaged(d.limit(0))).count() == 0


def test_line_rules_leave_prose_alone(spark):
    body = "Plain words fill this line so that the whole document stays long enough to pass. "
    lines = {
        "Home | Products | About us | Contact.": False, "Start » News » Today.": False, "A › B › C.": False, "one · two · three.": False,
        "Il a dit « oui », puis « non », puis « peut-être ».": True, "»Ja«, sagte er, »nein«, sagte sie.": True, "La col·lecció paral·lela és bona.": True,
        "x > y, y > z and so x > z holds for all of the numbers that we have looked at in this long chapter so far.": True,
        "Read more about us.": False, "Alle Rechte vorbehalten.": False, "CLIQUEZ ICI!": False, "POLÍTICA DE PRIVACIDAD.": False,
        "He would read more if only the library stayed open after work, but the city, short of money as always, closes it at five on every day of the week and all weekend.": True,
        "No mark at its end": False,
    }
    d = spark.createDataFrame([(i, f"{body}\n{line}") for i, line in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_kept_lines"] == 2 for r in quality_rules.clean(d).collect()}
    assert got == dict(enumerate(lines.values()))


def test_long_runs_of_equal_rows(spark):
    d = spark.createDataFrame([("a", 3), ("b", 9000), ("c", 4096), ("d", 1)], "k string, n long")
    got = mixing.repeated(d, "n", "at").groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("at").alias("u"), F.min("at").alias("a"), F.max("at").alias("b")).collect()
    assert {tuple(r) for r in got} == {("a", 3, 3, 0, 2), ("b", 9000, 9000, 0, 8999), ("c", 4096, 4096, 0, 4095), ("d", 1, 1, 0, 0)}


def test_vectors_that_clash_in_one_half_stay_apart(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 6))
    rows = [(i, (x[i % 50] + (0.01 if i >= 50 else 0)).tolist(), 1) for i in range(60)]
    d = spark.createDataFrame(rows + [(100, rows[0][1], 1)], "vec_id long, embedding array<double>, label int")
    key = lambda r: sorted(map(tuple, r.collect()))
    assert key(cap_filters.near_duplicates(d, bits=2)) == key(cap_filters.near_duplicates(d))


def test_every_language_keeps_a_row(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL", 4000)
    words = ["".join(chr(97 + (i * 7 + j) % 26) for j in range(6)) for i in range(40)]
    d = spark.createDataFrame([(i, " ".join([w] * 30), f"l{i:02}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    assert sorted(language_id.fit(d).langs) == [f"l{i:02}" for i in range(40)]


def test_revisits_name_a_record(spark, tmp_path):
    import gzip

    d = spark.createDataFrame([(1, "u", "z" * 1500), (9, "v", "z" * 1500), (None, "w", "short"), (None, "w", "short"), (3, "x", "y" * 1500)], "page_id long, url string, html string")
    warc.write(warc.plan(d), str(tmp_path))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*.warc.gz")).decode()
    ids, refs = (re.findall(rf"WARC-{k}: (\S+)", text) for k in ("Record-ID", "Refers-To"))
    assert len(set(ids)) == len(ids) == 5 and len(refs) == 1 and refs[0] in ids


def test_marks_compose_before_folding():
    """Capitals before a combining mark, alone and in words, and random texts of letters and marks."""
    import random

    from tokenizers import Tokenizer

    pick = random.Random(5)
    marks = [chr(i) for i in (*range(0x300, 0x370), 0x1DC2, 0x1AB0, 0x20D0, 0x5B0, 0x93C)]
    parts = [*"abthwyjTHWYJXÉß. '\n0«", "the ", "<|", "각", "İ", "Σ"]
    texts = ["T̈ H̱ W̊ Y̊ J̌", "The H̱amas", "Ḥasan H̱aṭat", "J̣̌"]
    texts += ["".join(pick.choice(marks if pick.random() < 0.25 else parts) for _ in range(pick.randint(1, 12))) for _ in range(5000)]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = packing.default_vocabulary(name)
        ids, n = tokens.Encoder(path, spaced).encode(pa.array(texts))
        want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.ids for x in want]


def test_many_short_texts_wait_in_bounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL_PIECES", 50)
    d = spark.createDataFrame([(i, None if i % 3 else "one") for i in range(700)], "doc_id long, text string")
    rows = packing.pack(d.coalesce(1), packing.default_vocabulary("word_bpe_49k.json"), capacity=64).collect()
    assert sum(r["length"] for r in rows) == sum(1 if i % 3 else 2 for i in range(700))
    full = Counter()
    for r in rows:
        full[r["sequence_id"]] += r["length"]
    assert all(n == 64 or n & (n - 1) == 0 for n in full.values())
