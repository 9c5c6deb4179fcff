"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured random product codes: the coordinates are turned at random and halved,
each half has ``b`` random unit vectors, and a direction is one of each, b * b in all (below 8
dimensions the directions are plain random vectors). A vector is list-decoded to every direction whose inner
product exceeds the threshold: only combinations of half scores that can reach it are looked at.
Vectors of a label that share a filter are compared in double precision.

Hits of one code come in clusters, so several codes are used, turned independently: a pair then misses
them all with the product of the single chances, wherever it lies. The threshold follows from the true cap
probabilities of the dimension and the largest label of that dimension; codes are added until, of
``PAIRS`` random pairs at the cosine, at most the share ``MISS`` meets in no filter of any code.

Equal vectors are one node first, by 128 bits of hash. Buckets emit a spanning forest of their links, never all pairs;
links are counted afterwards inside the connected components, in blocks, where every link lies.

Cases: vectors that are null, empty, zero, or hold nulls or values that are not finite link with nothing,
as do null labels; vectors of unequal lengths never link; rows with equal vec_id are one vector if they are
equal, else compared as if they had ids of their own; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite_vector, stored, table
from .components import block_pairs, blocks, components, numbered, spanning

COSINE = 0.93
#: Share of the pairs at the cosine that may meet in no filter, and the pairs it is measured on.
MISS = 0.002
PAIRS = 4000
#: Comparisons that cost as much as one more row of a bucket.
COMPARED = 300
#: Filters of one code that two vectors at the cosine share in the mean.
SHARED = 0.7
#: Below so many dimensions directions are not products.
PLAIN = 8
SEED = 20240501
#: Rows of one block of a group that is compared in pieces, at most and at least.
BLOCK, LEAST_BLOCK = 1500, 200


def _angles(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of the unit sphere within each of them from a direction."""
    a = np.linspace(0, math.pi, 20001)
    if dims == 1:
        return a, np.where(a < math.pi, 0.5, 1.0)
    f = np.sin(a) ** (dims - 2)
    c = np.concatenate([[0], np.cumsum(f[1:] + f[:-1])])
    return a, c / c[-1]


def _cap(angles, least):
    """P(u x >= least) of a random unit vector u."""
    return np.interp(np.arccos(np.clip(least, -1, 1)), *angles)


def _both(dims: int, least: float, cosine: float, below) -> float:
    """P(u y >= least | u x >= least) of two unit vectors at that cosine; ``below``: angles of one dimension less."""
    a = np.linspace(0, math.acos(least), 1002)[1:]
    w, z = np.sin(a) ** (dims - 2), np.cos(a)
    q = (least - cosine * z) / (math.sqrt(1 - cosine * cosine) * np.sin(a))
    # beyond the unit interval all or none of the circle around x lies in the cap
    hit = np.where(q > 1, 0.0, _cap(below, q))
    return float((w * hit).sum() / w.sum())


class Code:
    def __init__(self, dims: int, b: int, least: float, number: int = 0):
        rng = np.random.default_rng([SEED, dims, b, number])
        self.b, self.least = b, least * math.sqrt(2)
        if dims < PLAIN:
            a = rng.standard_normal((dims, b)) if dims > 1 else np.array([[1.0, -1.0]])
            self.a, self.c = a * math.sqrt(2) / np.linalg.norm(a, axis=0), np.zeros((dims, 1))
            return
        # the coordinates are turned at random first, so that no half is special
        turn, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        turn *= np.sign(np.diag(r))
        half = (dims + 1) // 2
        a, c = rng.standard_normal((half, b)), rng.standard_normal((dims - half, b))
        self.a, self.c = turn[:, :half] @ (a / np.linalg.norm(a, axis=0)), turn[:, half:] @ (c / np.linalg.norm(c, axis=0))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter that a unit vector exceeds, by rows."""
        s, q = x @ self.a, x @ self.c
        row, col = np.nonzero(q >= (self.least - s.max(1))[:, None])
        # one ascending list: rows are 8 apart, scores of a row fall
        key = row * 8.0 - q[row, col]
        order = np.argsort(key, kind="stable")
        key, col = key[order], col[order]
        start = np.searchsorted(row, np.arange(len(x)))
        at, can = np.nonzero(s >= (self.least - q.max(1))[:, None])
        k = np.maximum(0, np.searchsorted(key, at * 8.0 + (s[at, can] - self.least), side="right") - start[at])
        i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        return np.repeat(at, k), np.repeat(can, k) * self.b + col[np.repeat(start[at], k) + i]


@functools.lru_cache(64)
def code(dims: int, b: int, least: float, number: int) -> Code:
    return Code(dims, b, least, number)


def pairs_at(dims: int, n: int, cosine: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at that cosine, as two matrices."""
    x, y = rng.standard_normal((2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y


def meet(c: Code, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of x and y share a filter."""
    hit = np.zeros(len(x), bool)
    for a in range(0, len(x), 500):
        (r, f), (u, g) = c.decode(x[a : a + 500]), c.decode(y[a : a + 500])
        both = np.intersect1d(r * (c.b * c.b) + f, u * (c.b * c.b) + g)
        hit[a + both // (c.b * c.b)] = True
    return hit


def tune(n: int, dims: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, float, int]:
    """(vectors a half, threshold, number of codes) for n vectors of a label."""
    if dims == 1:
        return 2, 0.5, 1
    cosine = min(cosine, 0.9999)
    angles, below = _angles(dims), _angles(dims - 1)
    least = np.linspace(0.01, 0.99, 99)
    p = _cap(angles, least)
    both = np.array([_both(dims, v, cosine, below) for v in least])
    i = int(np.argmin((1 + n * p / COMPARED) / np.maximum(both, 1e-12)))
    lists = SHARED / both[i] / p[i]
    b, v = max(4, math.ceil(lists if dims < PLAIN else math.sqrt(lists))), float(least[i])
    x, y = pairs_at(dims, PAIRS, cosine, np.random.default_rng([SEED, dims]))
    number = 0
    while len(x) > miss * PAIRS:
        left = ~meet(Code(dims, b, v, number), x, y)
        x, y, number = x[left], y[left], number + 1
    return b, v, number


def _packed(x: np.ndarray) -> bytes:
    """Single precision where that is exact."""
    with np.errstate(over="ignore"):
        f = x.astype("<f4")
    return f.tobytes() if (f == x).all() else x.tobytes()


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first: squares of very large or small components stay finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(blobs, dims: int) -> np.ndarray:
    return _unit(np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * dims else "<f8") for b in blobs]).astype("<f8"))


def classes(vectors: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, h1, h2; nodes: h1, h2, label, dims, copies, e): h1 and h2, null where a vector takes no part, are the
    halves of the identity of label and vector; ``bits`` of the first (fewer only to try clashes out)."""
    d = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    h1 = F.xxhash64("label", "e")
    h1, h2 = F.shiftrightunsigned(h1, 64 - bits) if bits < 64 else h1, F.xxhash64(F.lit(1), "label", "e")
    ok = F.col("label").isNotNull() & finite_vector(F.col("e"))
    d = d.withColumns({"h1": F.when(ok, h1), "h2": F.when(ok, h2)})
    nodes = d.where("h1 is not null").groupBy("h1", "h2", "label", "e").agg(F.count("*").alias("copies"))
    return d.select("vec_id", "h1", "h2"), nodes.select("h1", "h2", "label", F.size("e").alias("dims"), "copies", "e")


BUCKETS = "node long, label string, dims int, filter long, v binary"


def buckets(nodes: DataFrame, plans: dict[int, tuple[int, float, int]]) -> DataFrame:
    """A row for each node and filter it exceeds; plans: what ``tune`` gives, by dimension."""

    def run(batches):
        for batch in batches:
            ids, labels, dims, es = (batch.column(k).to_pylist() for k in range(4))
            for a in range(0, len(ids), 1000):
                for dim in sorted(set(dims[a : a + 1000])):
                    at = [i for i in range(a, min(a + 1000, len(ids))) if dims[i] == dim]
                    x = np.array([es[i] for i in at], "<f8")
                    unit, packed = _unit(x), [_packed(v) for v in x]
                    b, least, number = plans[dim]
                    for k in range(number):
                        rows, filters = code(dim, b, least, k).decode(unit)
                        rl = rows.tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([ids[at[i]] for i in rl], pa.int64()), pa.array([labels[at[i]] for i in rl], pa.string()),
                                pa.array([dim] * len(rl), pa.int32()), pa.array(filters + k * b * b, pa.int64()), pa.array([packed[i] for i in rl], pa.binary()),
                            ],
                            names=["node", "label", "dims", "filter", "v"],
                        )

    return nodes.select("node", F.col("label").cast("string"), "dims", "e").mapInArrow(run, BUCKETS)


def _linked(cosine: float):
    """Links of a block as a spanning forest and as counts weighted with copies."""

    def run(t):
        # both parts of a block pair, or one block
        b, i, j = t["_b"].to_numpy(), t["_i"][0].as_py(), t["_j"][0].as_py()
        x = _matrix(t["v"].to_pylist(), t["dims"][0].as_py())
        near = np.zeros((len(x), len(x)), bool)
        for a in range(0, len(x), 512):
            near[a : a + 512] = x[a : a + 512] @ x.T >= cosine
        np.fill_diagonal(near, False)
        if i != j:
            near &= (b == i)[:, None] ^ (b == i)[None, :]
        return near

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, bits: int = 64) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows, nodes = classes(vectors, bits)
    nodes = numbered(stored(nodes, "cap-nodes"), "cap-nodes")
    sizes = nodes.groupBy("label", "dims").count().groupBy("dims").agg(F.max("count")).collect()
    plans = {dims: tune(n, dims, cosine) for dims, n in sizes}
    find = _linked(cosine)
    d = stored(buckets(nodes, plans), "cap-filters")  # decoded once, read twice
    key = ["label", "dims", "filter"]
    # only filters with very many vectors are named here; the others are one block each
    hot = d.select(*key).groupBy(*key).agg(F.count("*").alias("_size")).where(F.col("_size") > BLOCK)
    d = block_pairs(d.join(hot, key, "left").fillna({"_size": 1}), blocks(spark, F.col("_size"), BLOCK, BLOCK), F.col("node"))

    def forest(_, t):
        if t.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids = t["node"].to_pylist()
        pairs = spanning(find(t))
        return pa.table({"a": pa.array([ids[x] for x, _ in pairs], pa.int64()), "b": pa.array([ids[y] for _, y in pairs], pa.int64())})

    edges = d.groupBy(*key, "_i", "_j").applyInArrow(forest, "a long, b long")
    comp = stored(components(edges), "cap-components")
    # links are counted where they are: inside components
    sizes = comp.groupBy("component").agg(F.count("*").alias("_size"))
    members = nodes.join(comp, nodes["node"] == comp["id"]).join(sizes, "component").select("component", "node", "copies", "dims", "e", "_size")
    members = block_pairs(members, blocks(spark, F.col("_size"), BLOCK, LEAST_BLOCK), F.col("node"))

    def count(_, t):
        x = np.array(t["e"].to_pylist(), "<f8")
        t = t.append_column("v", pa.array([u.tobytes() for u in x], pa.binary()))
        n = (find(t) @ t["copies"].to_numpy()).astype(np.int64)
        return pa.table({"node": t["node"], "n": pa.array(n, pa.int64())})

    links = members.groupBy("component", "_i", "_j").applyInArrow(count, "node long, n long")
    links = links.groupBy("node").agg(F.sum("n").alias("_links"))
    per = nodes.select("node", "h1", "h2", "copies").join(links, "node", "left").join(comp.withColumnRenamed("id", "node"), "node", "left")
    per = per.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "node").alias("_c"))
    d = stored(rows.join(per, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left"), "cap-rows")
    least = d.where("_c is not null").groupBy("_c").agg(F.min("vec_id").alias("_m")).withColumnRenamed("_c", "_k")
    d = d.join(least, F.col("_c") == F.col("_k"), "left")
    return d.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_m", "vec_id").alias("component_id"),
        F.coalesce("_m", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
