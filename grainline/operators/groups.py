"""Near-duplicate groups, bursts and their numbering."""

from __future__ import annotations

import tempfile
import uuid
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hamming
from ..types import BURST_GAP_SECONDS, DUPLICATE_DISTANCE
from . import near

#: Edges that are united in one task; more contract in rounds of tables.
FEW_EDGES = 200_000
#: Groups that are numbered in one task.
FEW_GROUPS = 100_000


#: Blocks that photos are dealt to where all pairs are compared: one up to ``LEAST_BLOCK`` photos, else always as many, so that a
#: photo is sent to as many tasks whatever the number of photos, until a block would have more than ``MOST_BLOCK``.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 12, 4096, 1 << 17
#: Pairs that are compared at once rather than searched for by bands.
FEW_PAIRS = 1 << 34
#: Pairs that are compared in the time that one row takes to be sent and joined.
ROW_COST = 200
#: Rows of one batch out of a task.
BATCH = 1 << 16


def _blocks(n: int, least: int) -> int:
    return 1 if n <= least else max(BLOCKS, -(-n // MOST_BLOCK))


def _met(rows: DataFrame, n: int, least: int = 0) -> DataFrame:
    """rows, each in block ``_b`` of n, in the tasks of the pairs of blocks i <= j (i < j where ``least`` is 1), one pair a task:
    ``_side`` is 0 for block i and 1 for block j."""
    d = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.abs(F.col("_b") - F.col("_p")) >= least)
    i, j = F.least("_b", "_p"), F.greatest("_b", "_p")
    d = d.select(*rows.columns, (F.col("_b") > i).cast("int").alias("_side"), (F.shiftright(i * (2 * n - 1 - i), 1) + j).alias("_t"))
    return d.repartitionById(n * (n + 1) // 2, "_t").drop("_t")


def _in_block(id: str, n: int):
    return F.pmod(F.xxhash64(id), F.lit(n)).cast("int").alias("_b")


def _sides(batches, id: str, value: str):
    """The rows of a task as (table, unsigned hashes) of either side, each in the order of ids."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = list(batches)
    if not held:
        return None
    t = pa.Table.from_batches(held)
    t = t.take(pc.sort_indices(t, [(id, "ascending")])).combine_chunks()
    out = []
    for side in (0, 1):
        own = t.filter(pc.equal(t["_side"], side)).combine_chunks()
        out.append((own, own[value].to_numpy().astype(np.int64).view(np.uint64)))
    return out


def similar_pairs(photos: DataFrame, most: int = DUPLICATE_DISTANCE, key: str = "id", value: str = "phash", bands: bool | None = None) -> DataFrame:
    """(a, b, distance) for all pairs a < b within a Hamming distance, exactly.

    Photos are dealt to a fixed number of blocks, and each two blocks meet in a task, which compares all their hashes or, with
    ``bands``, looks them up: 64 bits are four bands, some band differs in most // 4 bits at most, and all values that near are
    looked up among the other block's. What is sent grows with the photos; pairs leave a task as they are found.
    n equal hashes are n * (n - 1) / 2 pairs; ``links`` has them once."""
    import pyarrow as pa

    p = photos.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    p = written(p)
    n, kind = _blocks(p.count(), LEAST_BLOCK), p.schema["k"].dataType.simpleString()
    search = near.banded if bands else near.compared

    def run(batches):
        import numpy as np

        sides = _sides(batches, "k", "v")
        if sides is None:
            return
        (left, v), (right, u) = sides
        if not len(u):  # a block with itself
            right, u, same = left, v, True
        else:
            same = False
        found, size = [], 0

        def batch():
            i, j, d = (np.concatenate(c) for c in zip(*found))
            found.clear()
            x, y = left["k"].take(pa.array(i)).combine_chunks(), right["k"].take(pa.array(j)).combine_chunks()
            return pa.RecordBatch.from_arrays([x, y, pa.array(d.astype(np.int32))], ["x", "y", "distance"])

        for rows in search(v, u, most, same):
            found.append(rows)
            size += len(rows[0])
            if size >= BATCH:
                yield batch()
                size = 0
        if found:
            yield batch()

    d = _met(p.select("k", "v", _in_block("k", n)), n).select("k", "v", "_side").mapInArrow(run, f"x {kind}, y {kind}, distance int")
    return d.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def _parts(hashes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """What hashes (id, v), all different, connect: (id, v, part), the smallest id connected within a block, and (a, b),
    the fewest parts that connect blocks. A block's pairs stay in its task: no more than its photos leave it."""
    import pyarrow as pa

    n, kind = _blocks(hashes.count(), LEAST_BLOCK), hashes.schema["id"].dataType.simpleString()

    def inner(batches):
        import numpy as np

        sides = _sides(batches, "id", "v")
        if sides is None:
            return
        t, v = sides[0]
        root, _ = near.united(np.arange(len(v)), near.compared(v, v, most, True))
        yield from t.select(["id", "v", "_b"]).append_column("part", t["id"].take(pa.array(root))).combine_chunks().to_batches(BATCH)

    def outer(batches):
        import numpy as np

        sides = _sides(batches, "part", "v")
        if sides is None or not all(len(v) for _, v in sides):
            return
        (left, v), (right, u) = sides
        names = pa.chunked_array([*left["part"].chunks, *right["part"].chunks]).combine_chunks().dictionary_encode()
        part = names.indices.to_numpy()
        _, edges = near.united(part, ((i, j + len(v), d) for i, j, d in near.compared(v, u, most)))
        for at in range(0, len(edges), BATCH):
            some = np.array(edges[at : at + BATCH])
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(some[:, c])) for c in (0, 1)], ["a", "b"])

    dealt = hashes.select("id", "v", _in_block("id", n)).repartitionById(n, "_b").withColumn("_side", F.lit(0))
    own = written(dealt.mapInArrow(inner, f"id {kind}, v long, _b int, part {kind}"))
    between = _met(own.select("part", "v", "_b"), n, 1).select("part", "v", "_side").mapInArrow(outer, f"a {kind}, b {kind}")
    return own.drop("_b"), between


def _hashes(photos: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """photos (id, v), and the smallest id of each hash with the number of its photos."""
    p = photos.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(value).alias("v"))
    return p, written(p.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))


def links(photos: DataFrame, most: int = DUPLICATE_DISTANCE, key: str = "id", value: str = "phash") -> DataFrame:
    """(a, b) that connect what is similar, not all of its pairs: equal hashes hang on the smallest id, and only those are compared."""
    p, least = _hashes(photos, key, value)
    same = p.join(least.where("n > 1").select("v", F.col("id").alias("a")), "v").where("id <> a").select("a", F.col("id").alias("b"))
    own, between = _parts(least.select("id", "v"), most)
    return own.where("part <> id").select(F.col("part").alias("a"), F.col("id").alias("b")).unionAll(between).unionAll(same)


def nearest(photos: DataFrame, key: str = "id", value: str = "phash", bands: int | None = None, block: int = 4096, few: int = FEW_PAIRS) -> DataFrame:
    """The nearest other photo of each (a, nearest, distance); of equally near ones the smallest id.

    Equal hashes are nearest to each other, and only one of them is searched for further. The search grows by the bits that a band may
    differ in: after radius r every photo has met all others with some band that near, and what it has not met
    differs by bands * (r + 1) bits at least; a photo whose best is nearer than that is done. A radius joins the
    open photos' band values, with every choice of r bits turned, to all photos' bands. Where that is more work
    for a photo than to compare it with all, or no more than ``few`` pairs are left, the rest is compared in blocks, one of them
    up to ``block`` photos. ``bands`` follows from the number of hashes."""
    p = photos.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    per = written(p.groupBy("v").agg(F.min("k").alias("k"), F.count("*").alias("n")))
    second = p.join(per.where("n > 1").select("v", F.col("k").alias("first")), "v")
    other = second.where("k <> first").groupBy("v").agg(F.min("k").alias("next"))
    same = second.join(other, "v").select(F.col("k").alias("a"), F.when(F.col("k") == F.col("first"), F.col("next")).otherwise(F.col("first")).alias("nearest"), F.lit(0).alias("distance"))
    total, alone = per.agg(F.count("*"), F.count_if(F.col("n") == 1)).first()
    if not alone or total < 2:
        return same
    bands = bands or max(2, min(4, 64 // max(1, total.bit_length())))
    cuts = [64 * i // bands for i in range(bands + 1)]
    parts = [(i, lo, hi - lo, (1 << hi - lo) - 1) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("v", lo).bitwiseAND(F.lit(m).cast("long")).alias("w")) for i, lo, _, m in parts]))
    far = per.select(F.col("k").alias("b"), F.col("v").alias("vb"), every.alias("s")).select("b", "vb", "s.i", "s.w")
    open_ = alone
    rest, best, radius, out, crowd = per.where("n = 1").select(F.col("k").alias("a"), F.col("v").alias("va")), None, 0, [], None
    while True:
        masks = [[sum(1 << x for x in c) for c in combinations(range(width), radius)] for _, _, width, _ in parts] if sum(comb(w, radius) for _, _, w, _ in parts) <= MOST_MASKS else None
        if masks is not None and open_ * total > few and crowd is None:  # what a photo's band value has in common with others, which common values raise
            crowd = far.groupBy("i", "w").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] / (bands * total)
        if masks is None or open_ * total <= few or sum(map(len, masks)) * (1 + crowd) * ROW_COST >= total:
            out.append(_against_all(rest, per, block))
            break
        turned = [_turned(i, lo, m, own) for own, (i, lo, _, m) in zip(masks, parts)]
        close = rest.select("a", "va", F.explode(F.concat(*turned)).alias("s")).select("a", "va", "s.i", "s.w")
        # the turned values are many more than Spark reckons: never to be broadcast
        met = close.hint("merge").join(far, ["i", "w"]).where("a <> b").groupBy("a").agg(F.min(F.struct(hamming(F.col("va"), F.col("vb")).alias("d"), "b")).alias("m"))
        met = met if best is None else met.unionAll(best).groupBy("a").agg(F.min("m").alias("m"))
        best = written(met)
        done = best.where(F.col("m.d") < bands * (radius + 1))
        out.append(done)
        rest = written(rest.join(done, "a", "left_anti"))
        best, radius = written(best.join(done.select("a"), "a", "left_anti")), radius + 1
        open_ = rest.count()
        if not open_:
            break
    found = out[0]
    for d in out[1:]:
        found = found.unionAll(d)
    return same.unionAll(found.select("a", F.col("m.b").alias("nearest"), F.col("m.d").alias("distance")))


#: Masks of one radius up to which bands are tried: rows that a photo becomes.
MOST_MASKS = 128


def _turned(i: int, low: int, mask: int, masks: list[int]):
    """An array of the band i of ``va`` with the bits of each mask turned."""
    every = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")
    band = F.shiftrightunsigned("va", low).bitwiseAND(F.lit(mask).cast("long"))
    return F.transform(every, lambda x: F.struct(F.lit(i).alias("i"), band.bitwiseXOR(x).alias("w")))


def _against_all(rest: DataFrame, per: DataFrame, block: int) -> DataFrame:
    """(a, m: d and b) of the nearest for rows (a, va), alone with their hashes, among all (k, v): every block of the one side meets
    every block of the other in a task of its own, and gives a row for each photo."""
    n, every = (_blocks(d.count(), block) for d in (rest, per))
    deal = lambda id, own, other, task: (F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("_p"), _in_block(id, own), F.lit(task).alias("_side"))
    left = rest.select(F.col("a").alias("k"), F.col("va").alias("v"), *deal("a", n, every, 0))
    right = per.select("k", "v", *deal("k", every, n, 1))
    task = F.when(F.col("_side") == 0, F.col("_b") * every + F.col("_p")).otherwise(F.col("_p") * every + F.col("_b"))
    met = left.unionAll(right).withColumn("_t", task).repartitionById(n * every, "_t").select("k", "v", "_side")
    kind = per.schema["k"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        sides = _sides(batches, "k", "v")
        if sides is None or not all(len(v) for _, v in sides):
            return
        (left, v), (right, u) = sides
        d, at = near.nearest(v, u)
        t = pa.table({"a": left["k"], "d": pa.array(d.astype("int32")), "b": right["k"].take(pa.array(at))})
        yield from t.filter(pa.array(d <= 64)).combine_chunks().to_batches(BATCH)

    return met.mapInArrow(run, f"a {kind}, d int, b {kind}").groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"))


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the folder of spark.checkpoint.dir (a temporary one where that is unset)."""
    spark = df.sparkSession
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="grainline-"))
    path = f"{where}/groups-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OWN: dict[str, str] = {}


def _united(pdf):
    """The smallest member of the component of every end of the edges (u, v)."""
    import pandas as pd

    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(pdf.u.tolist(), pdf.v.tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pd.DataFrame({"u": list(up), "g": [find(x) for x in list(up)]})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, group): the smallest id connected, for every node.

    Neighbourhoods contract to stars: larger neighbours move to the smallest of a node's neighbourhood, then
    smaller ones do, until the edge table stays the same. Every round is a written table. Up to ``FEW_EDGES``
    edges are united in one task instead."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if e.count() <= FEW_EDGES:
        kind = e.schema["u"].dataType.simpleString()
        stars = e.groupBy(F.lit(0).alias("_one")).applyInPandas(_united, f"u {kind}, g {kind}")
        return nodes.join(stars, F.col("id") == F.col("u"), "left").select("id", F.coalesce("g", "id").alias("group"))
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
        e = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        hung = e.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(hung.unionAll(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
    stars = e.groupBy("u").agg(F.min("v").alias("g"))
    return nodes.join(stars, F.col("id") == F.col("u"), "left").select("id", F.coalesce("g", "id").alias("group"))


def clusters(photos: DataFrame, most: int = DUPLICATE_DISTANCE, key: str = "id", value: str = "phash") -> DataFrame:
    """(id, group): the smallest id that is connected by similar hashes, for every photo.

    Equal hashes are one node, and what a block connects is one, too: only what connects parts of two blocks is an edge."""
    _, least = _hashes(photos, key, value)
    own, between = _parts(least.select("id", "v"), most)
    group = components(own.select(F.col("part").alias("id")).distinct(), between).withColumnRenamed("id", "part")
    of = own.join(group, "part").select(F.col("v").alias("_v"), "group")
    every = photos.select(F.col(key).alias("id"), F.col(value).alias("_h"))
    return every.join(of, F.col("_h") == F.col("_v"), "left").select("id", F.coalesce("group", "id").alias("group"))


def bursts(frames: DataFrame, gap: int = BURST_GAP_SECONDS, key: str = "id", ts: str = "ts") -> DataFrame:
    """frames with burst: 1.. in time order; a burst goes on while the whole seconds since the frame
    before are ``gap`` at most; untimed frames follow, each alone, in no order that means anything.

    Hours are windows of their own, and untimed frames are dealt to many; what crosses an hour comes from one
    row an hour (first and last frame, number of breaks), so that only the hours' table is ever in one task."""
    untimed = F.col(ts).isNull()
    part = F.struct(F.date_trunc("hour", ts).alias("hour"), F.when(untimed, F.pmod(F.xxhash64(key), F.lit(UNTIMED_PARTS))).otherwise(0).alias("n"))
    d = frames.withColumn("_part", part)
    w = Window.partitionBy("_part").orderBy(F.col(ts), F.col(key))
    step = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts))
    d = d.withColumn("_new", F.when(untimed, 1).when(F.lag(ts).over(w).isNull(), 0).otherwise((step > gap).cast("int")))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = d.groupBy("_part").agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.sum("_new").alias("breaks"))
    o = Window.orderBy(F.col("_part.hour").asc_nulls_last(), F.col("_part.n"))
    before = F.lag("hi").over(o)
    opens = F.when(F.col("lo").isNull(), 0).when(before.isNull(), 1).otherwise((F.timestamp_diff("SECOND", before, F.col("lo")) > gap).cast("int"))
    parts = parts.withColumn("opens", opens)
    parts = parts.withColumn("_base", F.sum(F.col("opens") + F.col("breaks")).over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col("breaks"))
    parts = parts.select(F.col("_part").alias("_p"), "_base")
    return d.join(parts, d["_part"].eqNullSafe(parts["_p"])).withColumn("burst", (F.col("_base") + F.col("_run")).cast("long")).drop("_part", "_new", "_run", "_p", "_base")


#: Windows that untimed frames are dealt to.
UNTIMED_PARTS = 256


def number_groups(rows: DataFrame, group: str, out: str, few: int = FEW_GROUPS) -> DataFrame:
    """rows with ``out``: 1.. for groups of two or more, by the groups' own order, null for single ones.

    Up to ``few`` groups are numbered in one task; more are sorted in ranges, and only the number of groups in
    each range meets in one task."""
    sizes = written(rows.groupBy(group).count().where("count > 1").select(F.col(group).alias("_g")))
    if sizes.count() <= few:
        n = sizes.select("_g", F.row_number().over(Window.orderBy("_g")).cast("long").alias(out))
    else:
        # the high bits of the id are the range, the low ones the place in it
        ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        at = written(sizes.repartitionByRange(ranges, "_g").sortWithinPartitions("_g").withColumn("_at", F.monotonically_increasing_id()))
        at = at.select("_g", F.shiftright("_at", 33).alias("_r"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_p"))
        held = at.groupBy("_r").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        n = at.join(F.broadcast(held.select("_r", before.alias("_b"))), "_r").select("_g", (F.col("_b") + F.col("_p") + 1).alias(out))
    return rows.join(n, F.col(group) == F.col("_g"), "left").drop("_g")
