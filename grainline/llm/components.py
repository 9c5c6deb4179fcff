"""Connected components of an edge table, and group work in bounded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, stored

#: A node with at least this part of the edges is a hub: there are no more of them than this.
HUBS = 1000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of the edges (a, b): component is the smallest id connected.

    Alternating large-star and small-star steps, each an aggregate and a join on the node; every
    round ends in a written table, which replaces the one before, and only two numbers of it reach the driver;
    the rounds end when nothing changes. Nodes are pre-aggregated; those that hold 1 / ``HUBS`` of all edges, of
    which there are ``HUBS`` at most, are broadcast, so that their edges stay where they are.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, seen = stored(e, "edges"), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen, old = tuple(mark), e
        # large star: all larger neighbours of a node point to the smallest of its neighbourhood
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        hubs = e.groupBy("v").count().where(F.col("count") * HUBS >= mark[0]).select(F.col("v").alias("h"))
        hubs = F.broadcast(hubs.join(least, F.col("h") == F.col("n"), "left").select("h", F.coalesce("m", "h").alias("hm")))
        at_hub = e.join(hubs, F.col("v") == F.col("h")).select("u", F.col("hm").alias("v"))
        rest = e.join(hubs, F.col("v") == F.col("h"), "left_anti").join(least, F.col("v") == F.col("n"), "left").select("u", F.coalesce("m", "v").alias("v"))
        big = at_hub.unionAll(rest).distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        hung = big.join(low, F.col("u") == F.col("n"))
        e = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
        before, e = old, stored(e.where("u <> v").distinct(), "edges")
        discard(before)
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return stars.unionAll(stars.select(F.col("component").alias("id"), "component").distinct())


def numbered(nodes: DataFrame, name: str) -> DataFrame:
    """stored nodes (h1, h2: the halves of an identity of 128 bits) with ``node``, a number of each: h1, but for those
    that agree in it, of which all but one are named by both halves."""
    clash = nodes.groupBy("h1").agg(F.min("h2").alias("_keep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if not clash.limit(1).count():
        return nodes.withColumn("node", F.col("h1"))
    named = nodes.join(clash, "h1", "left").withColumn("node", F.when(F.col("h2") != F.col("_keep"), F.xxhash64("h1", "h2")).otherwise(F.col("h1")))
    return stored(named.drop("_keep"), name)


def blocks(spark, size, most: int, least: int):
    """The number of blocks of a group of ``size`` rows: of ``most`` rows at most, and down to ``least`` where that
    gives every task a pair of blocks."""
    wide = max(1, int((2 * partitions(spark)) ** 0.5))
    n = F.greatest(F.ceil(size / most), F.least(F.ceil(size / least), F.lit(wide)))
    return F.greatest(F.lit(1).cast("long"), n.cast("long"))


def block_pairs(rows: DataFrame, n, by) -> DataFrame:
    """rows with _i <= _j, so that all pairs of a group dealt into ``n`` blocks meet in the block pairs
    (group, _i, _j). Pairs within block _i meet in (_i, _i)."""
    d = rows.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(by, F.lit(7)), F.col("_n")))
    d = d.withColumn("_p", F.explode(F.expr("sequence(0L, _n - 1)")))
    return d.withColumns({"_i": F.least("_b", "_p"), "_j": F.greatest("_b", "_p")}).drop("_n", "_p")


class Forest:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def spanning(adj) -> list[tuple[int, int]]:
    """A spanning forest of a square boolean matrix, breadth first; edges as pairs of row numbers."""
    import numpy as np

    n = len(adj)
    todo, out = np.ones(n, bool), []
    for s in range(n):
        if not todo[s]:
            continue
        todo[s] = False
        front = [s]
        while front:
            x = front.pop()
            new = np.flatnonzero(adj[x] & todo)
            if len(new):
                todo[new] = False
                out += [(x, y) for y in new.tolist()]
                front += new.tolist()
    return out
