"""Near-duplicate texts by a MinHash LSH forest and exact verification.

Sets are runs of five words (A-Z lower-cased, words parted by white space). A text's MinHash signature in
each of ``TREES`` trees has ``DEPTH`` values, a byte of each minimum; sorted, the signatures of a tree are a
prefix trie, and texts meet in the trie nodes they share. The prefixes of a text begin at the full depth and
are shortened value by value until the target recall: a text that shares a prefix with others in a share r of
the trees finds such a neighbour with chance 1 - (1 - r) ** TREES, so it stops at the longest prefix where the
measured r makes that ``RECALL`` (``matches`` trees). Texts without close neighbours go on to the floor, where
a pair at the wanted similarity itself reaches the recall (``level``). What a text shares tells of its closest
neighbours only, so prefixes begin no longer than where a pair at the wanted similarity itself is found with ``LEAST``
(9 values, 8 at the floor): a text with copies stops early, and still finds a neighbour at the threshold with that
chance. A node in which any text has stopped links all its members to the smallest one.

The components of the links are the candidate groups. Inside a group every pair is verified exactly by the
shingles themselves, in blocks bounded by rows and bytes. Links are counted there and a spanning forest of
them gives the final classes; pairs are never emitted. Work grows with the square of a candidate group.

Equal texts (by 128 bits of hash) are one node first, with their number of copies. Trie nodes that hold one text
are dropped by an aggregate before anything else; hot nodes are pre-aggregated and their joins split.

Cases: texts without words (null, empty, white space) link with nothing, each row is its own class; texts
of one to four words have one run, the whole; rows with equal doc_id are copies if their texts are
equal, else nodes of their own; a null doc_id is never a class id where another exists; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table
from .components import block_pairs, blocks, components, numbered, spanning
from .tokens import release, slices
from .words import hashed_words, shingles

WORDS = 5
SIMILARITY = 0.8
TREES = 40
DEPTH = 9
RECALL = 0.998
#: Recall of a pair at the wanted similarity at the full depth, where texts with close neighbours stop.
LEAST = 0.996
SEED = 7
#: Texts of a block of a group that is verified in pieces, at most and at least; and bytes of a block.
BLOCK, LEAST_BLOCK, BLOCK_BYTES = 2000, 250, 4_000_000
#: Texts, and bytes of them, that get their signatures together.
SLICE, SLICE_BYTES = 500, 2_000_000


def level(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The floor: the longest prefix at which pairs of that similarity match in some tree with the wanted recall."""
    k = depth
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


def matches(trees: int = TREES, recall: float = RECALL) -> int:
    """In how many trees a text must share its prefix, so that such a neighbour is found with that recall."""
    return int(np.ceil(trees * (1 - (1 - recall) ** (1 / trees))))


SIGNED = "doc_id long, h1 long, h2 long, runs long, bytes long, signature array<binary>"


def hashes(text, bits: int = 64):
    """The two halves of a text's identity, as columns; ``bits`` of the first (fewer only to try clashes out)."""
    h1 = F.xxhash64(text)
    return F.shiftrightunsigned(h1, 64 - bits) if bits < 64 else h1, F.xxhash64(text, F.lit(1))


def signatures(docs: DataFrame, trees: int = TREES, depth: int = DEPTH, words: int = WORDS, bits: int = 64) -> DataFrame:
    """doc_id, identity of the text, its number of runs and bytes, and its signature in every tree."""
    rng = np.random.default_rng(SEED)
    mul = rng.integers(0, 1 << 31, (trees, depth), np.uint32) * 2 + 1
    add = rng.integers(0, 1 << 32, (trees, depth), np.uint32)

    def run(batches):
        release()
        for batch in batches:
            for a, k in slices(batch.column(1), SLICE_BYTES, SLICE):
                part = batch.slice(a, k)
                texts = part.column(1)
                h, off = shingles(*hashed_words(texts), words)
                n = np.diff(off)
                full = np.flatnonzero(n)
                h32, starts = (h >> np.uint64(32)).astype(np.uint32), off[:-1][full]
                values = np.zeros((len(full), trees, depth), np.uint8)
                if len(full):
                    for t in range(trees):
                        for j in range(depth):
                            # the low bits of a minimum depend on the set as a whole, the high ones on its size
                            values[:, t, j] = np.minimum.reduceat(h32 * mul[t, j] + add[t, j], starts) * np.uint32(0x9E3779B1) >> np.uint32(24)
                lists = np.zeros(len(n) + 1, np.int32)
                lists[1:] = np.cumsum(np.where(n > 0, trees, 0))
                cuts = np.arange(0, values.size + 1, depth, dtype=np.int32)
                signs = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in (0, 2, 3)), pa.array(n, pa.int64()), part.column(4), pa.ListArray.from_arrays(pa.array(lists), signs)],
                    names=["doc_id", "h1", "h2", "runs", "bytes", "signature"],
                )

    h1, h2 = hashes(F.col("text"), bits)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), size.alias("bytes")).mapInArrow(run, SIGNED)


def nodes_of(signed: DataFrame) -> DataFrame:
    """One row for each text: node (a number of its own), h1, h2, least doc_id, copies, bytes and signature."""
    one = signed.where("runs > 0").groupBy("h1", "h2")
    nodes = stored(one.agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"), F.first("signature").alias("signature")), "forest-nodes")
    return numbered(nodes, "forest-nodes")


def forest(nodes: DataFrame, trees: int = TREES, top: int = DEPTH, floor: int | None = None, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(links: node, first; stops: node, stop): which texts share a trie node at the prefixes that were reached,
    and the length at which each text with candidates stopped."""
    floor, least = level(trees=trees, recall=recall) if floor is None else floor, matches(trees, recall)
    at = nodes.select("node", F.posexplode("signature").alias("tree", "s")).select("node", "tree", "s", F.substring("s", 1, floor).alias("p"))
    # nodes of the floor with more than one text; the others match nobody at any length
    tries = at.groupBy("tree", "p").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a < _b").select("tree", "p")
    rows = stored(at.join(tries, ["tree", "p"]).select("node", "tree", "s"), "forest-tries")
    lengths = F.explode(F.array(*[F.lit(k) for k in range(top, floor - 1, -1)]))
    rows = rows.withColumn("k", lengths).select("node", "tree", "k", F.expr("substring(s, 1, k)").alias("p"))
    key = ["tree", "k", "p"]
    shared = rows.groupBy(*key).agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last")
    met = stored(rows.join(shared, key), "forest-met")
    # the longest prefix that a text shares in enough trees
    counts = [F.count_if(F.col("k") == k).alias(f"_{k}") for k in range(top, floor, -1)]
    stops = met.groupBy("node").agg(*counts) if counts else met.select("node").distinct()
    stop = F.coalesce(*[F.when(F.col(f"_{k}") >= least, k) for k in range(top, floor, -1)], F.lit(floor))
    stops = stored(stops.select("node", stop.alias("stop")), "forest-stops")
    open_ = met.join(stops, "node").where("k = stop").select(*key).distinct()
    links = met.join(open_, key, "left_semi").where("node <> first").select("node", "first").distinct()
    return links, stops


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of a 0/1 matrix over the runs that are shared."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    runs = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    _, col, df = np.unique(runs, return_inverse=True, return_counts=True)
    shared = df[col] > 1
    used, col = np.unique(col[shared], return_inverse=True)
    doc, out = doc[shared], np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    col, doc = col[order], doc[order]
    for a in range(0, len(used), 2048):
        i, j = np.searchsorted(col, [a, a + 2048])
        m = np.zeros((n, min(2048, len(used) - a)), np.float32)
        m[doc[i:j], col[i:j] - a] = 1
        out += m @ m.T
    return out


def _near(texts: list[str], similarity: float, words: int) -> np.ndarray:
    h, off = shingles(*hashed_words(pa.array(texts, pa.string())), words)
    sets = [np.unique(h[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    both = _intersections(sets)
    size = np.array([len(x) for x in sets], np.float32)
    near = both >= np.float32(similarity) * (size[:, None] + size[None, :] - both) - 1e-4 * (both > 0)
    np.fill_diagonal(near, False)
    return near & (both > 0)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, bits: int = 64) -> DataFrame:
    """doc_id, h1 and h2 (``hashes`` of the text), component (smallest node of the class, null without words),
    class_id, n_links (other rows linked directly), kept and stop (the prefix length at which the text's search
    ended; null if none met it) for each row of (doc_id, text)."""
    spark = docs.sparkSession
    s = stored(signatures(docs, words=words, bits=bits), "forest-signatures")
    nodes = nodes_of(s)
    links, stops = forest(nodes, top=level(similarity, recall=LEAST), floor=level(similarity, recall=recall), recall=recall)
    cand = stored(components(links.select(F.col("node").alias("a"), F.col("first").alias("b"))), "forest-candidates")
    inside = cand.withColumnRenamed("id", "node").join(nodes.drop("signature"), "node")
    sizes = inside.groupBy("component").agg(F.count("*").alias("_size"), F.sum("bytes").alias("_bytes"))
    n = F.greatest(blocks(spark, F.col("_size"), BLOCK, LEAST_BLOCK), F.ceil(F.col("_bytes") / BLOCK_BYTES))
    wanted = inside.join(sizes.select("component", n.alias("_n")), "component")
    # one text for each candidate node, that of its smallest doc_id
    h1, h2 = hashes(F.col("text"), bits)
    t = docs.select("doc_id", "text", h1.alias("_h1"), h2.alias("_h2"))
    texts = t.join(wanted, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["_h1", "_h2"])
    rows = block_pairs(texts.select("component", "node", "copies", "_n", "text"), F.col("_n"), F.col("node"))

    def verify(_, t):
        release()
        b, i, j = t["_b"].to_numpy(), t["_i"][0].as_py(), t["_j"][0].as_py()
        near = _near(t["text"].to_pylist(), similarity, words)
        if i != j:
            near &= (b == i)[:, None] ^ (b == i)[None, :]
        n = (near @ t["copies"].to_numpy()).astype(np.int64)
        ids = t["node"].to_numpy()
        up = np.arange(len(ids))
        for x, y in spanning(near):
            up[y] = x
        return pa.table({"node": ids, "n": n, "up": ids[up]})

    found = stored(rows.groupBy("component", "_i", "_j").applyInArrow(verify, "node long, n long, up long"), "forest-links")
    discard(cand)
    links = found.groupBy("node").agg(F.sum("n").alias("_links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("up").alias("b"))).withColumnRenamed("id", "node")
    per = nodes.select("node", "h1", "h2", "least", "copies").join(links, "node", "left").join(comp, "node", "left").join(stops, "node", "left")
    per = stored(
        per.select("h1", "h2", "least", "stop", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "node").alias("_c")),
        "forest-classes",
    )
    least = per.groupBy("_c").agg(F.min("least").alias("_class"))
    per = per.join(least, "_c").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "_links", "_class", "_c", "stop")
    d = s.select("doc_id", "h1", "h2", "runs").join(per, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("runs") > 0), "left")
    class_id = F.when(F.col("_h1").isNull(), F.col("doc_id")).otherwise(F.col("_class"))
    return d.select(
        "doc_id", "h1", "h2", F.col("_c").alias("component"), class_id.alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        class_id.eqNullSafe(F.col("doc_id")).alias("kept"), "stop",
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("h1", "h2", "component")
