"""Mixing sources to target weights by the cube method.

The size of a document is its number of words. Sources share ``share`` of all sizes by weight; a
source's target stops at ``most`` times its size, and the excess is shared again by weight among
the others. That is a water level L with target = min(most * size, L * weight), found by running
sums over the sources in the order of most * size / weight.

A source then takes each document floor(r) times, r = target / size of the source, and once more
with probability r - floor(r). Which documents get the extra copy is balanced sampling: the flight
phase moves three fractional probabilities at a time along the null space of the two constraints
(words and documents of the source) until one is 0 or 1, so both totals stay as expected. It runs
in blocks of bounded size, then over what the blocks leave (two at most from each), and again,
until one block a source remains; only its two last probabilities and the ten smallest
documents' are rounded, to the combination nearest to the expected totals (landing).

Blocks are dealt by a hash of the document, not by partitions, and all choices are seeded by it:
reruns agree on any number of executors. Equal rows are one unit with a multiplicity.

Cases: null text has size 0 and is never taken; a source of null is a source of its own, last;
n repeated rows share ceil or floor of n times the rate evenly; all sizes 0: targets are 0; an empty table gives no rows;
other columns pass through ``mix``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096
#: The smallest documents of a source that stay out of the last flight and are rounded with its two last.
LAND = 10


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs and target; one row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # code points and UTF-8 bytes sort alike; null comes last
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)) + 1)
    per = per.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    d = per.withColumn("goal", share * F.sum("source_size").over(everything)).withColumn("nth", F.row_number().over(by_ratio))
    d = d.withColumn("full", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    d = d.withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    # the level if this and all later sources stay below their caps; the first that does so sets it
    d = d.withColumn("level", (F.col("goal") - F.col("full")) / F.col("open_w"))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    d = d.withColumn("l", F.min_by("level", F.when(fits, F.col("nth"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("l") * F.col("w"), F.col("cap")))
    return d.select("source", "source_size", "n_docs", target.alias("target"))


def flight(x: np.ndarray, p: np.ndarray, seed: int = 0) -> np.ndarray:
    """Flight phase for rows of balancing values x (n, 2) and probabilities p; two stay fractional at most.

    Three open units are moved at a time. The direction solves two equations in three unknowns
    (the cross product of the two constraint rows); of both ways the one to the nearer side of
    the martingale is picked by a fixed hash sequence; the seed comes from the units' keys.
    """
    p = p.copy()
    rnd = np.random.default_rng([len(p), seed]).random(2 * len(p) + 4)
    sizes, out, k = x[:, 0].tolist(), p.tolist(), 0
    open_: list[int] = []
    for i in range(len(out)):
        if not 1e-12 < out[i] < 1 - 1e-12:
            out[i] = round(out[i])
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])  # sum u = 0, sum u * size = 0
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for j, v in zip(open_, u):
                if v > 0:
                    up, down = min(up, (1 - out[j]) / v), min(down, out[j] / v)
                elif v < 0:
                    up, down = min(up, out[j] / -v), min(down, (1 - out[j]) / -v)
            step = up if rnd[k] < down / (up + down) else -down
            k += 1
            left = []
            for j, v in zip(open_, u):
                out[j] += step * v
                if out[j] < 1e-9:
                    out[j] = 0.0
                elif out[j] > 1 - 1e-9:
                    out[j] = 1.0
                else:
                    left.append(j)
            open_ = left
    return np.array(out)


def landing(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The small rest: of all roundings the one whose words, then documents, are nearest to expected."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    k, out = len(open_), p.copy()
    if k:
        picks = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(float)
        words = np.abs(picks @ x[open_, 0] - (x[open_, 0] * p[open_]).sum())
        docs = np.abs(picks.sum(1) - p[open_].sum())
        out[open_] = picks[np.lexsort((docs, words))[0]]
    return out


UNIT = "doc_id long, source string, size long, _text long, _key long, n long, source_size long, target double, _least long, _blocks long, _p double"
NAMES = [c.split()[0] for c in UNIT.split(", ")]


def _flights(units: DataFrame) -> DataFrame:
    """One round of flights, a block at a time; where a source fits into one block it also lands."""

    def run(key, t):
        # large documents move first, so that small ones are left to land
        t = t.take(pa.array(np.lexsort((t["_key"].to_numpy(), -t["size"].to_numpy()))))
        size = t["size"].to_numpy().astype(float)
        x = np.stack([size, np.ones(len(size))], 1)
        p, last = t["_p"].to_numpy().copy(), t["_blocks"][0].as_py() == 1
        moving = max(0, len(p) - LAND) if last else len(p)
        seed = int(np.bitwise_xor.reduce(t["_key"].to_numpy())) & (1 << 63) - 1
        p[:moving] = flight(x[:moving], p[:moving], seed)
        if last:
            p = landing(x, p)
        return t.set_column(t.column_names.index("_p"), "_p", pa.array(p)).select(NAMES)

    named = units.select(*NAMES, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"))
    named = named.withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")))
    return named.groupBy("_s", "_block").applyInArrow(run, UNIT)


def decide(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For each distinct (doc_id, source, size, text) of docs: n, its number of rows; source_size,
    target; and total, how often the mix takes the text over all its rows."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    d = stored(d.groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("n")), "mix-sizes")
    goal = stored(targets(d.select("source", (F.col("size") * F.col("n")).alias("size"), "n"), weights, share, most), "mix-targets")
    n_sources, largest = goal.agg(F.count("*"), F.max("n_docs")).first()
    side = F.broadcast(goal) if n_sources <= BROADCAST_SOURCES else goal
    u = d.join(side, d["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # n equal rows together: whole copies, and one fractional unit for the rest
    want = F.when(F.col("size") > 0, rate * F.col("n")).otherwise(F.lit(0.0))
    u = u.withColumn("_least", F.floor(want + 1e-9)).withColumn("_p", F.greatest(F.lit(0.0), want - F.col("_least")))
    u = u.withColumn("_p", F.when(F.col("_p") < 1e-9, 0.0).otherwise(F.col("_p")))
    u = u.withColumn("_key", F.xxhash64("doc_id", "source", "size", "_text"))
    u = u.withColumn("_blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / BLOCK))).select(*NAMES)
    settled = u.where("_p = 0")
    open_ = u.where("_p > 0")
    while True:
        moved = stored(_flights(open_), "mix-flights")
        settled = settled.unionByName(moved.where("_p = 0 or _p = 1"))
        blocks = -(-(largest or 0) // BLOCK)
        if blocks <= 1:
            break
        largest = 2 * blocks
        fewer = F.greatest(F.lit(1).cast("long"), F.ceil(2 * F.col("_blocks") / BLOCK))
        open_ = moved.where("_p > 0 and _p < 1").withColumn("_blocks", fewer)
    return settled.withColumn("total", F.col("_least") + F.col("_p").cast("long")).drop("_p", "_least", "_blocks", "_key")


#: Rows that one row becomes at a time.
CHUNK = 4096


def repeated(d: DataFrame, n: str, at: str) -> DataFrame:
    """Each row n times, numbered from 0 in ``at``: long runs are dealt over the tasks as chunks first, so that no
    task writes all copies of one row."""
    few, many = d.where(F.col(n) <= CHUNK), d.where(F.col(n) > CHUNK)
    chunk = F.explode(F.expr(f"sequence(0L, ({n} - 1) div {CHUNK})"))
    many = many.withColumn(at, chunk).withColumn(at, F.col(at) * CHUNK).repartition(n, at).withColumn(at, F.explode(F.expr(f"sequence({at}, least({at} + {CHUNK}, {n}) - 1)")))
    return few.withColumn(at, F.explode(F.expr(f"sequence(0L, {n} - 1)"))).unionAll(many)


#: The per-source table is broadcast up to this many rows, about 1 MB; else it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of the mix: each document's row as often as it is taken, with the columns of docs."""
    d = decide(docs, weights, share, most).where("total > 0")
    d = d.select(F.col("doc_id").alias("_gl_d"), F.col("source").alias("_gl_s"), F.col("_text").alias("_gl_x"), F.col("total").alias("_gl_n"))
    t = docs.withColumn("_gl_text", F.xxhash64("text"))
    on = t["doc_id"].eqNullSafe(d["_gl_d"]) & t["source"].eqNullSafe(d["_gl_s"]) & (t["_gl_text"] == d["_gl_x"])
    one = t.join(d, on).dropDuplicates(["_gl_d", "_gl_s", "_gl_x"])
    return repeated(one, "_gl_n", "_gl_copy").select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    d = repeated(d, "n", "_i")
    copies = F.floor(F.col("total") / F.col("n")) + (F.col("_i") < F.col("total") % F.col("n")).cast("long")
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))
