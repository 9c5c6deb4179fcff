"""Web archives: writing, normalising monolithic gzip streams, and reading back by index.

``write`` stores one record a page in archives that are a single gzip stream each. ``normalise``
inflates each archive once from end to end, rewrites every record as a gzip member of its own and
writes a sidecar index of the members' offsets. ``read`` opens members by that index.

Of records with equal payloads of at least ``LEAST`` bytes the one with the largest page_id is the
response and the others revisit it. The response is found by an aggregate per digest, joined back
on the digest; adaptive execution splits a hot digest's rows, of which nothing is gathered.

Cases: null html is an empty payload; null urls are written empty; a null page_id never is the
response of others with an id, and rows with equal page_id and payload are all of the same type;
archives are inflated in pieces, of which one whole record at a time is in memory; an empty table writes no
archive; other columns are not read. a record id names page_id and
payload, so rows that repeat both are one record stored again; WARC-Refers-To is the response's record id.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Output, make_dir, open_in, scratch, stored, table

LEAST = 1000
#: Bytes of records after which a task starts another archive.
ARCHIVE = 64 << 20
LEVEL = 6
FILES = "path string, records long"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary), digest (hex), record_type and refers_to of each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long_ = F.when(F.length("payload") >= least, F.col("digest"))
    shared = p.select("page_id", long_.alias("_d")).where("_d is not null").groupBy("_d")
    shared = shared.agg(F.max("page_id").alias("_m"), F.count("*").alias("_n")).where("_n > 1 and _m is not null").drop("_n")
    # short pages match nothing: keys of their own spread them over all tasks
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", F.monotonically_increasing_id()).cast("string"))
    d = p.withColumn("_k", F.coalesce(long_, alone)).join(shared, F.col("_k") == F.col("_d"), "left")
    revisit = F.col("_m").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_m"))
    return d.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_m")).alias("refers_to"),
    )


def record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to, name: str = "0") -> bytes:
    """A record. Its id names page and payload, so that a revisit can name its response; ``name`` parts records without page_id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}:{name if page_id is None else digest}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.translate(_ONE_LINE)}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


_ONE_LINE = {13: " ", 10: " "}


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def write(planned: DataFrame, out_dir: str) -> DataFrame:
    """Archives of one gzip stream each; a row (path, records) for each archive."""
    make_dir(out_dir)

    def run(batches):
        from pyspark import TaskContext

        part, k, rows = TaskContext.get().partitionId(), 0, (r for b in batches for r in _rows(b))
        r = next(rows, None)
        while r is not None:
            path, size, n = f"{out_dir}/{part:06d}-{k:04d}.warc.gz", 0, 0
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            with Output(path) as f:
                while r is not None and size < ARCHIVE:
                    raw = record(*r, f"{part}-{k}-{n}")
                    f.write(z.compress(raw))
                    size, n = size + len(raw), n + 1
                    r = next(rows, None)
                f.write(z.flush())
            k += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return stored(planned.mapInArrow(run, FILES), "warc-files")


def _rows(batch):
    cols = [c.to_pylist() for c in batch.columns]
    return zip(*cols)


def records(f):
    """Whole records of a gzip file, inflated in pieces; a stream may have one member or many."""
    z, buf, raw = zlib.decompressobj(31), bytearray(), b""
    need = None

    def more() -> bool:
        nonlocal z, raw
        raw = raw or f.read(1 << 20)
        if not raw:
            return False
        buf.extend(z.decompress(raw, 4 << 20))
        raw = z.unused_data if z.eof else z.unconsumed_tail
        if z.eof:
            z = zlib.decompressobj(31)
        return True

    while True:
        if need is None:
            end = buf.find(b"\r\n\r\n")
            if end < 0:
                if not more():
                    break
                continue
            need = end + 4 + int(parse(bytes(buf[:end]))["content-length"]) + 4
        if len(buf) < need:
            if not more():
                raise ValueError("truncated record")
            continue
        yield bytes(buf[:need])
        del buf[:need]
        need = None
    if buf:
        raise ValueError("truncated record")


def normalise(files: DataFrame, out_dir: str) -> DataFrame:
    """Rewrites archives record by record with a sidecar index; a row (path, records) for each."""
    make_dir(out_dir)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{out_dir}/{path.rsplit('/', 1)[1]}"
                index, at = [], 0
                with open_in(path) as src, Output(name) as f:
                    for raw in records(src):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        f.write(member)
                        h = parse(raw[: raw.find(b"\r\n\r\n")])
                        index.append({"offset": at, "length": len(member), "id": h["warc-record-id"], "type": h["warc-type"]})
                        at += len(member)
                with Output(f"{name}.idx") as f:
                    f.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([len(index)], pa.int64())})

    return stored(_spread(files).mapInArrow(run, FILES), "warc-normal")


def _spread(files: DataFrame) -> DataFrame:
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(n, "path")


def read(files: DataFrame) -> DataFrame:
    """One row for each record of normalised archives, members fetched by the index's offsets."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_in(f"{path}.idx") as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                out = []
                with open_in(path) as f:
                    for x in index:
                        f.seek(x["offset"])
                        raw = zlib.decompress(f.read(x["length"]), 31)
                        end = raw.find(b"\r\n\r\n")
                        h = parse(raw[:end])
                        block = raw[end + 4 : end + 4 + int(h["content-length"])]
                        if h["warc-type"] == "response":
                            payload = block[block.find(b"\r\n\r\n") + 4 :]
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size = int(h["warc-payload-length"])
                            digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        out.append((_page(h["warc-record-id"]), size, digest, h["warc-type"], _page(h.get("warc-refers-to", ""))))
                cols = list(zip(*out)) if out else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in OUT.split(", ")])

    return _spread(files).mapInArrow(run, OUT)


def _page(urn: str):
    x = urn.removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return int(x) if x not in ("", "None") else None


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "warc")
    files = write(plan(table(spark, sf_dir, "pages")), f"{base}/mono")
    return read(normalise(files, f"{base}/normal"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT d, max(page_id) AS m, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""
