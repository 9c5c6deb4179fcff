"""Approximate nearest neighbours by inner product over a permutation index.

A vector is represented by its nearest pivots in their order: of ``PIVOTS`` pivots, vectors of a bounded sample,
the first ``PREFIX``. The index is a table with a row for each vector, in the file of its nearest pivot. A query
reads the files of its own nearest pivots, as many as are needed. In a file the vectors are posted under the
pivots of their permutations, and the lists of a query's pivots add up to the footrule distance of the two
permutations: with w = PREFIX - place for a pivot's place from 0, it is PREFIX * (PREFIX + 1) less twice the sum over common
pivots of the smaller w. Vectors within a limit of that distance, and the ``k`` first in any case, are compared exactly.

The number of files and the limit are fitted on the sample, so that its own queries find ``TARGET`` of their
nearest vectors; with more rows the nearest are nearer, and more of them are found. The k-th best score of those
that a query finds of the sample is a bound that its answers cannot fall below, so files return only what reaches it.

Lengths: x becomes (x / M, sqrt(1 - |x / M| ** 2)) with M the longest length, and a query (q / |q|, 0), which orders by
inner product what is then ordered by angle. Files are dealt into blocks of vectors and of queries, and each pair of
them is a task of bounded size, so a crowded file is spread. Of equal vectors only the k + 1 with the
smallest vec_id can be among a query's answers, and only these are indexed.

Cases: vectors that are null, empty, zero, or hold nulls or values that are not finite take no part, nor do rows
without vec_id; of rows with one vec_id that with the least vector counts; vectors meet those of their own length
only; a query with fewer than k candidates gets all of them; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import finite_vector, stored, table

K = 20
PIVOTS, PREFIX = 256, 64
#: Vectors of the sample that pivots, limits and bounds are fitted on, and its queries.
SAMPLE, PROBES = 4000, 300
#: Share of the sample's nearest vectors that its queries must find.
TARGET = 0.96
#: Vectors and queries of one block, and pairs compared at a time.
VECTORS, QUERIES, PAIRS = 4000, 2000, 100_000
NEAREST = "query_id long, vec_id long, score double"


@dataclass
class Plan:
    """What the sample of one dimension gives."""

    pivots: np.ndarray
    longest: float
    files: int = 1
    least: int = 0
    #: The sample's vec_ids, vectors and pivots in order.
    ids: np.ndarray | None = None
    sample: np.ndarray | None = None
    placed: np.ndarray | None = None

    @property
    def prefix(self) -> int:
        return min(PREFIX, len(self.pivots))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors as points of the unit sphere with one more coordinate."""
        x = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]])

    def orders(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """Each row's pivots, nearest first."""
        if queries:
            x = x / np.abs(x).max(1, keepdims=True)
            near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.pivots[:, :-1].T
        else:
            near = self.lifted(x) @ self.pivots.T
        return np.argsort(-near, axis=1, kind="stable")


def overlap(q: np.ndarray, x: np.ndarray, pivots: int) -> np.ndarray:
    """For permutations q and x (rows of pivots in order) the sum over common pivots of the smaller weight, by
    inverted files: every pivot's list of rows and weights on both sides."""
    k = x.shape[1]
    out = np.zeros((len(q), len(x)), np.int32)

    def lists(p: np.ndarray):
        order = np.argsort(p.ravel(), kind="stable")
        return order // k, (k - order % k).astype(np.int32), np.searchsorted(p.ravel()[order], np.arange(pivots + 1))

    (qr, qw, qe), (xr, xw, xe) = lists(q), lists(x)
    for p in range(pivots):
        a, b, c, d = qe[p], qe[p + 1], xe[p], xe[p + 1]
        if a < b and c < d:
            out[qr[a:b, None], xr[None, c:d]] += np.minimum(qw[a:b, None], xw[None, c:d])
    return out


def fit(ids: np.ndarray, x: np.ndarray, longest: float, k: int = K, target: float = TARGET) -> Plan:
    """Pivots, files and limit from a sample in random order."""
    plan = Plan(np.zeros((0, 0)), longest)
    _, first = np.unique(x, axis=0, return_index=True)
    plan.pivots = plan.lifted(x[np.sort(first)[:PIVOTS]])
    plan.ids, plan.sample = ids, x
    n, m = len(x), min(PROBES, len(x))
    plan.files, plan.placed = len(plan.pivots), plan.orders(x, False)
    if n < 2:
        return plan
    scores = x[:m] @ x.T
    scores[np.arange(m), np.arange(m)] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, n - 1)]
    orders, own = plan.placed, plan.orders(x[:m], True)
    place = np.argsort(own, axis=1)
    miss = (1.0 - target) / 2
    reach = np.take_along_axis(place, orders[near, 0], 1)
    plan.files = int(np.quantile(reach, 1.0 - miss, method="higher")) + 1
    w = overlap(own[:, : plan.prefix], orders[:, : plan.prefix], len(plan.pivots))
    plan.least = int(np.quantile(np.take_along_axis(w, near, 1), miss, method="lower"))
    return plan


def _packed(x: np.ndarray) -> list[bytes]:
    """Single precision where that is exact."""
    with np.errstate(over="ignore"):
        f = x.astype("<f4")
    return [a.tobytes() if (a == b).all() else b.tobytes() for a, b in zip(f, x)]


def _matrix(column, dims: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * dims else "<f8") for b in column.to_pylist()]).astype("<f8")


def _vectors(batch: pa.RecordBatch, plans: dict[int, Plan]):
    """(ids, vectors) of a batch (vec_id, e), by dimension and some hundred at a time."""
    ids, es = batch.column("vec_id").to_numpy(), batch.column("e").to_pylist()
    for dims, plan in plans.items():
        at = [i for i, e in enumerate(es) if len(e) == dims]
        for a in range(0, len(at), 500):
            yield dims, plan, ids[at[a : a + 500]], np.array([es[i] for i in at[a : a + 500]], "<f8")


INDEX = "dims int, file int, vec_id long, v binary, permutation binary"


def index(rows: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """A row for each vector: the file of its nearest pivot, and its permutation's first pivots, two bytes each."""

    def run(batches):
        for batch in batches:
            for dims, plan, ids, x in _vectors(batch, plans):
                order = plan.orders(x, False)[:, : plan.prefix].astype("<u2")
                yield pa.RecordBatch.from_pydict({
                    "dims": pa.array([dims] * len(ids), pa.int32()), "file": pa.array(order[:, 0].astype(np.int32)), "vec_id": pa.array(ids),
                    "v": pa.array(_packed(x), pa.binary()), "permutation": pa.array([p.tobytes() for p in order], pa.binary()),
                })

    return rows.select("vec_id", "e").mapInArrow(run, INDEX)


def routes(queries: DataFrame, plans: dict[int, Plan], sizes: dict[tuple[int, int], int], k: int, whole: bool) -> DataFrame:
    """A row for each query and file it reads, with the bound of its scores; ``whole``: with the vector. sizes: the
    files' rows; a query reads on until it has seen k candidates."""
    held = {d: np.array([sizes.get((d, f), 0) for f in range(len(p.pivots))]) for d, p in plans.items()}

    def run(batches):
        for batch in batches:
            for dims, plan, ids, x in _vectors(batch, plans):
                order = plan.orders(x, True)
                seen = np.cumsum(held[dims][order], axis=1)
                # the query itself may be among them
                files = np.maximum(plan.files, (seen < k + 1).sum(1) + 1)
                score = x @ plan.sample.T
                # only what the index finds of the sample counts
                reached = np.take_along_axis(np.argsort(order, axis=1), np.broadcast_to(plan.placed[:, 0], score.shape), 1) < files[:, None]
                near = overlap(order[:, : plan.prefix], plan.placed[:, : plan.prefix], order.shape[1]) >= plan.least
                score[~reached | ~near | (ids[:, None] == plan.ids[None, :])] = -np.inf
                bound = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(x), -np.inf)
                bound = bound - 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0.0))
                rows, at = np.nonzero(np.arange(order.shape[1])[None, :] < files[:, None])
                found = order[rows, at]
                full = held[dims][found] > 0
                rows, found = rows[full], found[full]
                packed = pa.array(_packed(x) if whole else [b""] * len(x), pa.binary())
                for a in range(0, len(rows), 20_000):
                    r = pa.array(rows[a : a + 20_000])
                    yield pa.RecordBatch.from_pydict({
                        "dims": pa.array([dims] * len(r), pa.int32()), "file": pa.array(found[a : a + 20_000].astype(np.int32)), "query_id": pa.array(ids).take(r),
                        "v": packed.take(r), "bound": pa.array(bound).take(r),
                    })

    return queries.select("vec_id", "e").mapInArrow(run, "dims int, file int, query_id long, v binary, bound double")


def search(plans: dict[int, Plan], k: int):
    """The k best of a block of vectors for each query of a block."""

    def run(key: tuple, v: pa.Table, q: pa.Table) -> pa.Table:
        ids, own, best = v["vec_id"].to_numpy(), q["query_id"].to_numpy(), []
        if len(ids) and len(own):
            dims = key[0].as_py()
            plan, x, y = plans[dims], _matrix(v["v"], dims), _matrix(q["v"], dims)
            perm = np.stack([np.frombuffer(b, "<u2") for b in v["permutation"].to_pylist()])
            mine, bound = plan.orders(y, True)[:, : plan.prefix], q["bound"].to_numpy()
            for a in range(0, len(own), 500):
                w = overlap(mine[a : a + 500], perm, len(plan.pivots))
                # those without a common pivot are ranked too, as equally far
                last = np.partition(w, -k, axis=1)[:, -k] if len(ids) > k else np.zeros(len(w), np.int32)
                rows, cols = np.nonzero(w >= np.minimum(plan.least, last)[:, None])
                fine = ids[cols] != own[a + rows]
                rows, cols = rows[fine] + a, cols[fine]
                for c in range(0, len(rows), PAIRS):
                    r, s = rows[c : c + PAIRS], cols[c : c + PAIRS]
                    score = np.einsum("ij,ij->i", y[r], x[s])
                    fine = score >= bound[r]
                    best.append((r[fine], ids[s[fine]], score[fine]))
        if not best:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        r, i, s = (np.concatenate(c) for c in zip(*best))
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        top = rank < k
        return pa.table({"query_id": own[r[top]], "vec_id": i[top], "score": s[top]})

    return run


def usable(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and e of the vectors that take part, one for each vec_id."""
    e = F.col(embedding).cast("array<double>")
    d = vectors.select(F.col(id).cast("long").alias("vec_id"), e.alias("e")).where(F.col("vec_id").isNotNull() & finite_vector(F.col("e")))
    return d.groupBy("vec_id").agg(F.min("e").alias("e"))


def nearest(vectors: DataFrame, queries: Column, k: int = K, target: float = TARGET, vectors_a_block: int = VECTORS, queries_a_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for the rows of (vec_id, embedding) that ``queries``,
    a condition on vec_id, holds for."""
    rows = stored(usable(vectors), "permutation-rows")
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, b: a + b * b))
    stats = rows.groupBy(F.size("e").alias("dims")).agg(F.count("*").alias("n"), F.max(length).alias("longest")).collect()
    plans = {}
    for dims, n, longest in stats:
        # a little more than the sample, by hash, of which the first are taken
        part = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30))
        some = rows.where((F.size("e") == dims) & (part < min(1 << 30, math.ceil((1 << 30) * 1.5 * SAMPLE / n))))
        got = some.orderBy(part, "vec_id").limit(SAMPLE).select("vec_id", "e").collect()
        plans[dims] = fit(np.array([r[0] for r in got]), np.array([r[1] for r in got], "<f8"), min(longest, np.finfo(float).max), k, target)
    if not plans:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    posted = stored(index(rows.withColumn("_r", first).where(F.col("_r") <= k + 1), plans), "permutation-index")
    asked = rows.where(queries)
    # what is collected: a row for each pivot at most
    sizes = {(r[0], r[1]): r[2] for r in posted.groupBy("dims", "file").count().collect()}
    loads = {(r[0], r[1]): r[2] for r in routes(asked, plans, sizes, k, False).groupBy("dims", "file").count().collect()}
    blocks = [(d, f, math.ceil(n / vectors_a_block), math.ceil(loads.get((d, f), 1) / queries_a_block)) for (d, f), n in sizes.items()]
    grid = F.broadcast(rows.sparkSession.createDataFrame(blocks, "dims int, file int, nv long, nq long"))

    def dealt(d: DataFrame, id: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(id, F.lit(11)), F.col(f"n{own}"))
        d = d.join(grid, ["dims", "file"]).withColumn(f"b{own}", mine)
        return d.withColumn(f"b{other}", F.explode(F.expr(f"sequence(0L, n{other} - 1)"))).drop("nv", "nq")

    key = ["dims", "file", "bv", "bq"]
    v, q = dealt(posted, "vec_id", "v", "q"), dealt(routes(asked, plans, sizes, k, True), "query_id", "q", "v")
    found = v.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(search(plans, k), NEAREST)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
