"""Merkle manifest of a table: a digest for every row, every source and the whole, with proofs for every row.

Rows are leaves, ordered within their source; every 16 consecutive nodes become one until one is left, the
subroot; the subroots, ordered by source, become the root in the same way. A source is cut into aligned blocks
of 16 * 16 * 16 leaves, so that the root of a block is a node of the tree. A block is walked in postorder: the
walk returns the subtree's digest and, while it unwinds, appends the siblings of each child to all leaves
that the child holds. The roots of the blocks are the nodes of the next walk, distributed in the same way, until
each source has one node, and the subroots are walked likewise. On the way back each block is given the
siblings above its root, and its leaves are folded up to the root of the whole.

Ranks come from a sort by ranges: what earlier ranges hold of the source that a range begins with is broadcast,
one number a range. So a source may hold any share of the rows, and sources may be any number.

Cases: a null source is a source of its own and comes first; a null doc_id comes first in its source and is never
tampered with; equal doc_ids are ordered by their leaves, and equal rows are equal leaves, each of them in the
tree; null and empty texts differ (``-`` and ``0:``); an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

FAN = 16
#: Levels of the tree that one walk covers.
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

RANKED = "grp string, pid int, leading boolean, run long, sub string, doc_id long, leaf binary, altered binary"
NODES = "grp string, block long, digest binary"
#: Siblings above a node, level by level: what stands left and right of it.
ABOVE = "array<struct<l:binary,r:binary>>"


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field's UTF-8 length and text, or a dash for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def walk(leaves: list[str], width: int, upto: list[list[tuple[str, str]]] | None = None) -> str:
    """The digest over a block's leaves, in a tree of room for ``width``; ``upto`` gets each leaf's siblings from the bottom up."""

    def node(a: int, b: int, width: int) -> str:
        if width == 1:
            return leaves[a]
        step = width // FAN
        ends = [(x, min(x + step, b)) for x in range(a, b, step)]
        below = [node(x, y, step) for x, y in ends]
        if upto is not None:
            for i, (x, y) in enumerate(ends):
                both = "".join(below[:i]), "".join(below[i + 1 :])
                for k in range(x, y):
                    upto[k].append(both)
        return digest(below)

    return node(0, len(leaves), width)


def width_of(n: int, number: int, block: int) -> int:
    """The room of a block's tree: a first block that is not full is the only one and as low as it can be, a lone
    node its own root; all others are as high as full ones."""
    w = block if number else 1
    while w < n:
        w *= FAN
    return w


def fold(own: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        own = digest([left, own, right])
    return own


def ranked(nodes: DataFrame, name: str) -> DataFrame:
    """nodes (grp, sub, doc_id, leaf, altered), stored, with ``rank`` from 0 within grp in the order of sub, doc_id and leaf."""
    order = [F.col("grp"), F.col("sub"), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    d = nodes.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, last, n = TaskContext.get().partitionId(), None, None, 0
        for b in batches:
            groups, leading, runs = b.column("grp").to_pylist(), [], []
            for g in groups:
                first = g if first is None else first
                n = n + 1 if g == last else 0
                last = g
                leading.append(g == first)
                runs.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("grp"), pa.array([pid] * len(groups), pa.int32()), pa.array(leading, pa.bool_()), pa.array(runs, pa.int64()), *[b.column(c) for c in ("sub", "doc_id", "leaf", "altered")]],
                names=[c.split()[0] for c in RANKED.split(", ")],
            )

    d = stored(d.select("grp", "sub", "doc_id", "leaf", "altered").mapInArrow(run, RANKED), name)
    # what earlier ranges hold of the group that a range begins with: one number a range
    held = d.groupBy("pid", "grp").agg(F.count("*").alias("n"), F.max("leading").alias("leading"))
    earlier = Window.partitionBy("grp").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("before", F.sum("n").over(earlier)).where("leading").select(F.col("pid").alias("at"), "before")
    d = d.join(F.broadcast(before), F.when(F.col("leading"), F.col("pid")) == F.col("at"), "left")
    return d.select("grp", "sub", "doc_id", "leaf", "altered", (F.col("run") + F.coalesce("before", F.lit(0))).alias("rank"))


def _roots(key: tuple, t: pa.Table, block: int) -> pa.Table:
    t = t.sort_by("rank")
    root = walk([x.hex() for x in t["leaf"].to_pylist()], width_of(t.num_rows, key[1].as_py(), block))
    return pa.table({"grp": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int64()), "digest": pa.array([bytes.fromhex(root)], pa.binary())})


def _paths(t: pa.Table, above: pa.Table, number: int, block: int) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """Leaves by rank, and their siblings up to the root that ``above`` leads to."""
    leaves = [x.hex() for x in t["leaf"].to_pylist()]
    paths: list = [[] for _ in leaves]
    walk(leaves, width_of(len(leaves), number, block), paths)
    top = [(x["l"].decode(), x["r"].decode()) for x in above["above"][0].as_py()]
    return leaves, [p + top for p in paths]


def _climb(nodes: DataFrame, name: str, block: int) -> tuple[list[DataFrame], DataFrame]:
    """(each round's nodes with rank and block, the groups' roots) of ranked nodes (grp, rank, leaf)."""
    rounds, d = [], nodes
    while True:
        d = d.withColumn("block", F.floor(F.col("rank") / block))
        rounds.append(d)
        up = stored(d.select("grp", "block", "rank", "leaf").groupBy("grp", "block").applyInArrow(lambda k, t: _roots(k, t, block), NODES), name)
        if not up.where("block > 0").head(1):
            return rounds, up.select("grp", F.col("digest").alias("root"))
        d = up.select("grp", F.col("block").alias("rank"), F.col("digest").alias("leaf"))


def _descend(rounds: list[DataFrame], above: DataFrame, name: str, block: int) -> DataFrame:
    """Of the lowest round's blocks (grp, block) what stands above them, from that above the groups' roots."""
    above = above.select("grp", F.lit(0).cast("long").alias("block"), "above")
    for d in reversed(rounds[1:]):

        def run(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
            t = t.sort_by("rank")
            _, paths = _paths(t, a, key[1].as_py(), block)
            both = [[{"l": x.encode(), "r": y.encode()} for x, y in p] for p in paths]
            kind = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))
            return pa.table({"grp": t["grp"], "block": t["rank"], "above": pa.array(both, kind)})

        left = d.select("grp", "block", "rank", "leaf").groupBy("grp", "block")
        above = stored(left.cogroup(above.groupBy("grp", "block")).applyInArrow(run, f"grp string, block long, above {ABOVE}"), name)
    return above


def manifest(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified of rows (grp, doc_id, leaf,
    altered): digests as binary; ``altered`` is the leaf to be verified where it is not the row's own. grp is a text
    that orders the sources."""
    none = F.lit(None)
    base = ranked(rows.withColumn("sub", none.cast("string")), "merkle-leaves")
    rounds, subroots = _climb(base, "merkle-roots", block)
    subroots = stored(subroots, "merkle-subroots")
    nodes = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("sub"), none.cast("long").alias("doc_id"), F.col("root").alias("leaf"), none.cast("binary").alias("altered"))
    top = ranked(nodes, "merkle-top")
    upper, root = _climb(top, "merkle-upper", block)
    over = _descend(upper, root.select("grp", F.array().cast(ABOVE).alias("above")), "merkle-above", block)

    def paths(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        _, found = _paths(t, a, key[1].as_py(), block)
        both = [[{"l": x.encode(), "r": y.encode()} for x, y in p] for p in found]
        return pa.table({"grp": t["sub"], "above": pa.array(both, pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())])))})

    subs = upper[0].select("grp", "block", "rank", "leaf", "sub").groupBy("grp", "block")
    over = stored(subs.cogroup(over.groupBy("grp", "block")).applyInArrow(paths, f"grp string, above {ABOVE}"), "merkle-above")
    over = _descend(rounds, over, "merkle-above", block).withColumnRenamed("grp", "g").withColumnRenamed("block", "b")
    # each block gets its source's subroot and the root, both next to what stands above it
    over = over.join(subroots.withColumnRenamed("root", "subroot"), F.col("g") == F.col("grp")).drop("grp").crossJoin(F.broadcast(root.select("root")))

    def prove(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        leaves, found = _paths(t, a, key[1].as_py(), block)
        root, subroot = a["root"][0].as_py().hex(), a["subroot"][0].as_py().hex()
        proofs, folded = [], []
        for own, other, path in zip(leaves, t["altered"].to_pylist(), found):
            proofs.append(digest([x for both in path for x in both]))
            folded.append(fold(own if other is None else other.hex(), path))
        n = len(leaves)
        return pa.table({
            "grp": t["grp"], "doc_id": t["doc_id"], "leaf": leaves, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs,
            "folded_root": folded, "verified": [x == root for x in folded],
        })

    left = rounds[0].select("grp", "block", "rank", "doc_id", "leaf", "altered").groupBy("grp", "block")
    kind = "grp string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return left.cogroup(over.groupBy("g", "b")).applyInArrow(prove, kind)


def source_key(source: Column) -> Column:
    """A text that is never null and orders as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def tampered(text: Column) -> Column:
    """A text with its A to Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = F.when(hit, F.unhex(leaf(*own[:-1], tampered(F.col("text")))))
    rows = docs.select(source_key(F.col("source")).alias("grp"), "doc_id", F.unhex(leaf(*own)).alias("leaf"), altered.alias("altered"))
    return manifest(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Levels by recursion, proofs and folds by the row's place on each level; crc32 bit by bit.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, (lang IS NULL)::INT AS z,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(
      list_concat([4294967295], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(substr(doc_id::VARCHAR, i::INT, 1)) >> b::INT) & 1)))),
      lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc
  FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0
      THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
  FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l),
-- the trees of the sources: nodes of every level
t AS (
  SELECT coalesce('=' || source, '') AS grp, 0 AS level, rank, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM o
  UNION ALL
  SELECT grp, level + 1, rank // 16, sha256(string_agg(node, '' ORDER BY rank)), (max(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY grp, level, rank // 16),
subs AS (SELECT grp, level AS height, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS srank FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, srank AS rank, subroot AS node, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, rank // 16, sha256(string_agg(node, '' ORDER BY rank)), (max(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY level, rank // 16),
top AS (SELECT node AS root, level AS uheight FROM u WHERE n = 1),
-- one row for each leaf and level with what stands left and right
sib AS (
  SELECT a.grp, a.level, a.rank, coalesce(string_agg(b.node, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS lhs,
    coalesce(string_agg(b.node, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS rhs
  FROM t a JOIN t b ON a.grp = b.grp AND a.level = b.level AND a.rank // 16 = b.rank // 16 WHERE a.n > 1 GROUP BY ALL),
usib AS (
  SELECT a.level, a.rank, coalesce(string_agg(b.node, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS lhs,
    coalesce(string_agg(b.node, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS rhs
  FROM u a JOIN u b ON a.level = b.level AND a.rank // 16 = b.rank // 16 WHERE a.n > 1 GROUP BY ALL),
f AS (
  SELECT o.doc_id, o.leaf, s.grp, s.subroot, s.height, s.srank, o.rank, 0 AS step, coalesce(o.altered, o.leaf) AS own, '' AS proof
  FROM o JOIN subs s ON s.grp = coalesce('=' || o.source, '')
  UNION ALL
  SELECT f.doc_id, f.leaf, f.grp, f.subroot, f.height, f.srank, f.rank, step + 1,
    sha256(coalesce(a.lhs, b.lhs) || own || coalesce(a.rhs, b.rhs)), proof || coalesce(a.lhs, b.lhs) || coalesce(a.rhs, b.rhs)
  FROM f CROSS JOIN top
    LEFT JOIN sib a ON step < height AND a.grp = f.grp AND a.level = step AND a.rank = f.rank // power(16, step)::BIGINT
    LEFT JOIN usib b ON step >= height AND b.level = step - height AND b.rank = srank // power(16, greatest(step - height, 0))::BIGINT
  WHERE step < height + uheight)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified
FROM f CROSS JOIN top WHERE step = height + uheight
"""
