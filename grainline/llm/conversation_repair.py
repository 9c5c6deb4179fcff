"""Repair of conversation structure by A* on the edit lattice.

A node of the lattice is (rows consumed, role of the last message given out). Edits lead on: Keep (0), Rerole to
user or assistant (2), Delete (3, the only edit of a blank or repeated row), Insert an empty user or assistant
message (2); a truncated row that stays costs 1 more. The roles given out must read ``(s?(ua)+)?``. The search takes nodes in
the order of (cost + heuristic, edits so far); the heuristic is a suffix sum over the rows left: 3 for each deletion
that is mandatory, 1 for each truncated row, whose charge cannot be avoided, as deleting it costs more. It is consistent, so a
node is settled when it is first taken. Two ways to a node of equal cost have different edits of which neither begins with the other
(the rest would be inserts, which cost), so the first taken is also the ASCII-least, whatever follows.

Conversations may have any length: rows, without their texts, are sorted in ranges by conversation, turn, role and digest of the
text, and cut into blocks. A block that may not be a whole conversation is searched from each role to each role; the
blocks of a conversation then chain by their costs and edits. Texts meet the edits in one sorted pass that streams
them through the digest: SHA-256 is sequential, so that pass, and the edits of one conversation (a byte a row),
are with one task, but never its texts or rows at once.

Cases: nulls in role, text and the damage key count as one space, so a null text is blank; a null conv_id is a conversation
of its own; rows of equal turn are ordered by role, then by the SHA-256 of their text; repeated rows are all there and duplicates of the first; a
role other than user, assistant or system keeps its own initial, which only s, u and a can be legal, and an empty one has none, is illegal
and cannot be kept; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of one block.
BLOCK = 2000
#: What was given out last: nothing, a system message, a user message, an assistant message.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: From a state on, the state after a message of that initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: From a state on, the only message that may be inserted or made.
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
DONE = (START, ASSISTANT)
FINE, CUT, GONE = range(3)


def search(rows: list[tuple[str, int, int]], start: int, goals: tuple[int, ...], each: bool = False) -> list[tuple[int, int, str]]:
    """(goal, cost, edits) of the cheapest edits from ``start`` over rows (initial, FINE, CUT or GONE, copies) to one of
    ``goals``, or to ``each`` of them. Copies after the first are mandatory deletions at once."""
    n = len(rows)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        _, fault, copies = rows[i]
        left[i] = left[i + 1] + DELETE * (copies - 1) + (DELETE if fault == GONE else TRUNCATED if fault == CUT else 0)
    heap, settled, found, open_goals = [(left[0], "", 0, start)], set(), [], set(goals)
    while heap and open_goals:
        f, edits, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        cost = f - left[i]
        if i == n and state in open_goals:
            found.append((state, cost, edits))
            open_goals = open_goals - {state} if each else set()
        made = MADE[state]
        heapq.heappush(heap, (f + INSERT, edits + "I", i, made))
        if i == n:
            continue
        initial, fault, copies = rows[i]
        more, rest = "D" * (copies - 1), left[i + 1] + DELETE * (copies - 1)
        heapq.heappush(heap, (cost + DELETE + rest, edits + "D" + more, i + 1, state))
        if fault != GONE:
            charge = TRUNCATED if fault == CUT else 0
            kept = NEXT.get((state, initial))
            if kept is not None:
                heapq.heappush(heap, (cost + KEEP + charge + rest, edits + "K" + more, i + 1, kept))
            heapq.heappush(heap, (cost + REROLE + charge + rest, edits + "R" + more, i + 1, made))
    return found


def states(edits: str, start: int, initials: list[tuple[str, int]]) -> list[tuple[list[str], str | None]]:
    """For each row (initial, copies) the roles inserted before it and its own new role (None: deleted; empty: its
    own), and at last the roles inserted after all."""
    out: list[tuple[list[str], str | None]] = []
    state, inserted, row, copy = start, [], 0, 0
    for e in edits:
        if e == "I":
            state = MADE[state]
            inserted.append(ROLES[state])
            continue
        if copy == 0:
            if e == "K":
                state, own = NEXT[state, initials[row][0]], ""
            elif e == "R":
                state = MADE[state]
                own = ROLES[state]
            else:
                own = None
            out.append((inserted, own))
            inserted = []
        copy += 1
        if copy == initials[row][1]:
            row, copy = row + 1, 0
    out.append((inserted, None))
    return out


def damaged(conversations: DataFrame, id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text, digest and copies of the rows after the damage that crc32 of ``conv_id:turn`` chooses."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", blank(id), blank("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(k == 4, "user").otherwise(blank("role"))
    d = conversations.select(F.col(id).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), k.alias("_k"))
    return d.where("_k <> 0").select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(F.col("_k") == 3, 2).otherwise(1).cast("long").alias("copies"))


SEARCHED = (
    "conv_id long, pid int, k long, turns array<long>, roles array<string>, digests array<binary>, copies array<long>, first_turn long, last_turn long, "
    "distinct_turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, whole boolean, ways array<struct<s:int,e:int,c:long,w:string>>"
)
LEGAL = {"su", "ua", "au"}


class _Block:
    """Rows of one conversation, as many as a block holds, and what is known of its neighbours."""

    def __init__(self, conv, k: int):
        self.conv, self.k, self.rows = conv, k, []

    def record(self, pid: int, opens: bool, closes: bool) -> dict:
        """opens, closes: whether the conversation surely begins or ends with this block."""
        lattice, illegal, last = [], 0, None
        for turn, role, digest, copies, blank, cut, again in self.rows:
            initial = role[:1]
            lattice.append((initial, GONE if blank or again else CUT if cut else FINE, copies))
            illegal += (last is not None and last + initial not in LEGAL) + copies - 1
            last = initial
        ways = []
        for s in (START,) if opens else (START, SYSTEM, USER, ASSISTANT):
            for e, c, w in search(lattice, s, DONE if closes else (START, SYSTEM, USER, ASSISTANT), each=not closes):
                ways.append({"s": s, "e": e, "c": c, "w": w})
        turns = [r[0] for r in self.rows]
        known = [t for t in turns if t is not None]
        n = [0, 0, 0]
        for _, _, _, copies, blank, cut, again in self.rows:
            if blank:
                n[0] += copies
            else:
                n[1] += copies if again else copies - 1
                n[2] += bool(cut and not again)
        return {
            "conv_id": self.conv, "pid": pid, "k": self.k, "turns": turns, "roles": [r[1] for r in self.rows], "digests": [r[2] for r in self.rows],
            "copies": [r[3] for r in self.rows], "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
            "distinct_turns": len(set(known)), "blank": n[0], "duplicate": n[1], "truncated": n[2], "illegal": illegal,
            "first_initial": self.rows[0][1][:1], "last_initial": self.rows[-1][1][:1], "whole": opens and closes, "ways": ways,
        }


def _searched(block: int, schema: pa.Schema):
    """Cuts sorted rows into blocks and searches them; a range's first and last conversation may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, now, first, out, size = TaskContext.get().partitionId(), None, True, [], 0
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "copies", "blank", "cut", "again"))):
                other = now is not None and conv != now.conv
                if other or now is not None and len(now.rows) == block:
                    out.append(now.record(pid, now.k == 0 and not first, other))
                    size += len(now.rows)
                    first, now = first and not other, _Block(conv, 0 if other else now.k + 1)
                if now is None:
                    now = _Block(conv, 0)
                now.rows.append(tuple(row))
                if size > 4 * block:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if now is not None:
            out.append(now.record(pid, now.k == 0 and not first, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


CHAINED = "conv_id long, pid int, k long, start int, edits string, blocks long, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _chained(key: tuple, t: pa.Table) -> pa.Table:
    """The blocks of one conversation in order: for each its role before and its edits, and totals with each."""
    blocks = sorted(t.to_pylist(), key=lambda b: (b["pid"], b["k"]))
    # at each role the least cost, the edits so far, and where from
    best = {START: (0, "", ())}
    for b in blocks:
        after: dict = {}
        for w in b["ways"]:
            if w["s"] in best:
                cost, edits, path = best[w["s"]]
                way = (cost + w["c"], edits + w["w"], (path, w["s"], w["w"]))
                if w["e"] not in after or way[:2] < after[w["e"]][:2]:
                    after[w["e"]] = way
        best = after
    cost, _, path = min((best[s] for s in DONE if s in best), key=lambda x: x[:2])
    steps = []
    while path:
        path, start, edits = path
        steps.append((start, edits))
    steps.reverse()
    total = {c: sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated", "illegal")}
    turns, last, known = 0, None, [b for b in blocks if b["first_turn"] is not None]
    for b in known:
        turns += b["distinct_turns"] - (b["first_turn"] == last)
        last = b["last_turn"]
    gaps = last - known[0]["first_turn"] + 1 - turns if known else 0
    for a, b in zip(blocks, blocks[1:]):
        total["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    n = len(blocks)
    return pa.table({
        "conv_id": pa.array([blocks[0]["conv_id"]] * n, pa.int64()), "pid": pa.array([b["pid"] for b in blocks], pa.int32()), "k": pa.array([b["k"] for b in blocks], pa.int64()),
        "start": pa.array([s for s, _ in steps], pa.int32()), "edits": [w for _, w in steps], "blocks": pa.array([n] * n, pa.int64()), "cost": pa.array([cost] * n, pa.int64()),
        "gaps": pa.array([gaps] * n, pa.int64()), **{c: pa.array([v] * n, pa.int64()) for c, v in total.items()},
    })


DECIDED = "conv_id long, part int, at long, turn long, role string, digest binary, before array<string>, own string, text string, totals string"


def _decided(schema: pa.Schema):
    """A row for each edit that gives something out, one at the end of each block for what is inserted there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                out = []
                steps = states(b["edits"], b["start"], [(r[:1], n) for r, n in zip(b["roles"], b["copies"])])
                for (before, own), turn, role, digest in zip(steps, b["turns"], b["roles"], b["digests"]):
                    if before or own is not None:
                        out.append({"conv_id": b["conv_id"], "part": 0, "turn": turn, "role": role, "digest": digest, "before": before, "own": own})
                if steps[-1][0]:
                    out.append({"conv_id": b["conv_id"], "part": 1, "turn": b["turns"][-1], "role": b["roles"][-1], "digest": b["digests"][-1], "before": steps[-1][0]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's repaired lines, from its edits and texts in one order."""
    conv, now, lines, out = None, None, 0, []

    def line(text: str) -> None:
        nonlocal lines
        now.update(("\n" if lines else "").encode() + text.encode())
        lines += 1

    for batch in batches:
        for c, part, role, before, own, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "role", "before", "own", "text"))):
            if now is None or c != conv:
                if now is not None:
                    out.append((conv, now.hexdigest()))
                conv, now, lines, due = c, hashlib.sha256(), 0, None
            if part == 2:  # the text of the row just decided; it may be there more than once
                if due is not None:
                    line(f"{due or role}:{text}")
                due = None
            else:
                for r in before:
                    line(f"{r}:")
                due = own if part == 0 else None
        if len(out) > 5000:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([x for x, _ in out], pa.int64()), "repaired_sha256": [x for _, x in out]})
            out = []
    if now is not None:
        out.append((conv, now.hexdigest()))
    yield pa.RecordBatch.from_pydict({"conv_id": pa.array([x for x, _ in out], pa.int64()), "repaired_sha256": pa.array([x for _, x in out], pa.string())})


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the conversations of rows
    (conv_id, turn, role, text, digest, copies); what ``damaged`` gives, or undamaged rows in that form."""
    blank = F.col("text").rlike(WORD)
    cut = ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    # repeated rows are one with their copies, before anything is shuffled
    key = ["conv_id", "turn", "role", "digest"]
    marks = rows.groupBy(*key).agg(F.sum("copies").alias("copies"), F.first(~blank).alias("blank"), F.first(cut).alias("cut"))
    # a row of an earlier turn with the same role and text: the first of them is no repetition
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    marks = stored(marks.withColumn("again", first > 1), "repair-marks")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = marks.repartitionByRange(*order).sortWithinPartitions(*order).select(*key, "copies", "blank", "cut", "again")
    spark = rows.sparkSession
    schema = _arrow(spark.createDataFrame([], SEARCHED))
    found = stored(placed.mapInArrow(_searched(block, schema), SEARCHED), "repair-blocks")
    heads = found.drop("turns", "roles", "digests", "copies")
    # a conversation that is one block has nothing to chain
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct_turns"), F.lit(0)).alias("gaps")
    way = F.element_at("ways", 1)
    one = heads.where("whole").select("conv_id", "pid", "k", way["s"].alias("start"), way["w"].alias("edits"), F.lit(1).cast("long").alias("blocks"), way["c"].alias("cost"), gaps, "blank", "duplicate", "truncated", "illegal")
    several = heads.where("not whole").drop("whole").groupBy("conv_id").applyInArrow(_chained, CHAINED)
    chained = stored(one.unionByName(several), "repair-chained")
    at = found["conv_id"].eqNullSafe(chained["conv_id"]) & (found["pid"] == chained["pid"]) & (found["k"] == chained["k"])
    decided = found.join(chained, at).select(found["conv_id"], "turns", "roles", "digests", "copies", "start", "edits")
    schema = _arrow(spark.createDataFrame([], DECIDED))
    edits = decided.mapInArrow(_decided(schema), DECIDED).select("conv_id", "part", "turn", "role", "digest", "before", "own", "text")
    none = F.lit(None)
    texts = rows.select("conv_id", F.lit(2).alias("part"), "turn", "role", "digest", none.cast("array<string>").alias("before"), none.cast("string").alias("own"), "text")
    # what a block inserts at its end comes after all texts of its last row
    last = F.when(F.col("part") == 1, 3).otherwise(F.col("part"))
    lines = edits.unionAll(texts).repartition("conv_id").sortWithinPartitions(*order, last)
    hashed = lines.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    # the edits of all blocks of a conversation
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "k", "edits"))), lambda s: s["edits"]), "")
    totals = [F.first(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    whole = chained.groupBy("conv_id").agg(*totals, audit.alias("audit"))
    h = hashed.withColumnRenamed("conv_id", "_c")
    return whole.join(h, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    done = repair(damaged(c)).withColumnRenamed("conv_id", "_c")
    d = c.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(done, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return d.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: The same lattice as a forward recursion: at each row and state the least (cost, edits), inserts closed over twice.
ORACLE = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
k AS (
  SELECT *, xor(list_reduce(
      list_concat([4294967295], flatten(list_transform(range(1, length(key) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(substr(key, i::INT, 1)) >> b::INT) & 1)))),
      lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS k
  FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k CROSS JOIN (VALUES (1), (2)) n(copy) WHERE k <> 0 AND (copy = 1 OR k = 3)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d)),
m AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS r,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o),
-- states: n nothing, s, u, a; what may be inserted or made from each
made(s, t, word) AS (VALUES ('n', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
kept(s, r, t) AS (VALUES ('n', 's', 's'), ('n', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
edge AS (
  SELECT conv_id, i, s, s AS t, 3 AS cost, 'D' AS edit, '' AS line FROM m, (VALUES ('n'), ('s'), ('u'), ('a')) v(s)
  UNION ALL
  SELECT conv_id, i, s, t, (fault = 'truncated')::INT, 'K', chr(10) || role || ':' || text FROM m JOIN kept USING (r) WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, i, s, t, 2 + (fault = 'truncated')::INT, 'R', chr(10) || word || ':' || text FROM m, made WHERE fault IN ('', 'truncated')),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 'n' AS s, {'c': 0::BIGINT, 'w': '', 't': ''} AS way FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL
  SELECT conv_id, i, t, min({'c': c, 'w': w, 't': txt}) FROM (
    WITH step AS (
      SELECT p.conv_id, p.i + 1 AS i, e.t, p.way.c + extra + e.cost AS c, p.way.w || ins || e.edit AS w, p.way.t || put || e.line AS txt
      FROM (
        SELECT conv_id, i, s, way, 0 AS extra, '' AS ins, '' AS put FROM dp
        UNION ALL
        SELECT conv_id, i, x.t, way, 2, 'I', chr(10) || x.word || ':' FROM dp JOIN made x ON dp.s = x.s
        UNION ALL
        SELECT conv_id, i, y.t, way, 4, 'II', chr(10) || x.word || ':' || chr(10) || y.word || ':' FROM dp JOIN made x ON dp.s = x.s JOIN made y ON x.t = y.s) p
      JOIN edge e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.s = p.s)
    SELECT * FROM step) GROUP BY conv_id, i, t),
ends AS (
  SELECT conv_id, s, way FROM dp WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM m GROUP BY conv_id)),
goal AS (
  SELECT conv_id, min(way) AS way FROM (
    SELECT conv_id, way FROM ends WHERE s IN ('n', 'a')
    UNION ALL SELECT conv_id, {'c': way.c + 2, 'w': way.w || 'I', 't': way.t || chr(10) || 'assistant:'} FROM ends WHERE s = 'u'
    UNION ALL SELECT conv_id, {'c': way.c + 4, 'w': way.w || 'II', 't': way.t || chr(10) || 'user:' || chr(10) || 'assistant:'} FROM ends WHERE s = 's')
  GROUP BY conv_id),
tot AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.w, '') AS audit, sha256(substr(coalesce(way.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN tot ON tot.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN goal ON goal.conv_id IS NOT DISTINCT FROM a.conv_id
"""
