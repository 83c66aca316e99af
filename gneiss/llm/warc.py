"""Merkle fixity audit of WARC records.

``records`` lays pages out as WARC/1.1 response records in files, each with its offset and length. Files hold ranges of
the records' key hashes, and a file's records lie in order of these hashes, so that every node of the tree, a prefix of
the hash, is one ordered range of offsets. ``merkle`` hashes records and, level by level, the ranges of ``fanout``
children, where a node's hash covers the lengths and hashes below it in their order: a file's root stands for all of its bytes.
``audit`` compares the roots of two replicas and descends, a join a level, only into nodes that differ. A lost or added record
shifts the offsets behind it but changes its own branch only; below a leaf that differs records meet by key.

No file grows with the input: there are as many as ``files_for`` says, some ``per_file`` records in each.

Files that lie in any other order, such as that of a crawl, are read by ``read_warc`` and given to the audit by ``scanned``: there the leaves of the
tree are ranges of offsets. Rot changes one branch; a lost or added record shifts what lies behind it in its file, whose
branches are then opened too, and the records in them still cancel out by key and digest.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.common import hash_long, materialise, release

#: Key hashes are of 60 bits; a file's range is cut in ``FANOUT`` parts, each of these again, ``DEPTH`` times.
HASHES, FANOUT, DEPTH = 1 << 60, 16, 2
DATE = "2020-01-01T00:00:00Z"


def payload(key: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A response record without its last two line ends; null url or body count as empty. The record id is of the key and the url."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    h = F.md5(F.concat_ws(" ", F.lit("record"), F.coalesce(key.cast("string"), F.lit("")), url))
    part = lambda a, n: F.substring(h, a, n)
    name = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), name, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(url, "[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


END = "\r\n\r\n"


def laid_out(pages: DataFrame, files: int, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, raw, sha256, place_hash, file, bucket) of each row: the record, and where its key's hash puts it.

    A row of null key goes by its record's digest. Other columns are ignored.
    """
    raw = payload(pages[key], pages[url].cast("string"), pages[body].cast("string"))
    width, buckets = -(-HASHES // files), FANOUT**DEPTH
    r = pages.select(pages[key].cast("long").alias("key"), raw.alias("raw"), F.sha2(F.concat(raw, F.lit(END)).cast("binary"), 256).alias("sha256"))
    r = r.withColumn("place_hash", hash_long(F.lit("file"), F.coalesce(F.col("key").cast("string"), F.col("sha256"))))
    r = r.withColumn("file", F.expr(f"place_hash div {width}"))
    return r.withColumn("bucket", F.least(F.expr(f"(place_hash % {width}) div {-(-width // buckets)}"), F.lit(buckets - 1)))


def records(pages: DataFrame, files: int, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(file, bucket, key, place, offset, length, sha256): the records of each file in order of their keys' hashes.

    Repeated rows are records of their own; an empty table has no records. Only hashes and lengths are
    shuffled, not the bodies. Rows that share a key share a file.
    """
    r = laid_out(pages, files, key, url, body)
    r = r.select("file", "bucket", "key", "place_hash", (F.octet_length("raw") + len(END)).cast("long").alias("length"), "sha256")
    order = Window.partitionBy("file").orderBy("place_hash", "key", "sha256")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return r.select("file", "bucket", "key", (F.row_number().over(order) - 1).cast("long").alias("place"), before.alias("offset"), "length", "sha256")


def files_for(pages: DataFrame, per_file: int = 1024) -> int:
    """Files for the rows of ``pages``; both replicas of an audit must use the same number."""
    return max(1, math.ceil(pages.count() / per_file))


def scanned(read: DataFrame, root: str, width: int = 1 << 20) -> DataFrame:
    """(file, bucket, key, place, offset, length, sha256) of the records that ``read_warc`` has read, for ``audit``.

    A file goes by its path below ``root``, a record by its id, else its URI, else its digest; a bucket is a range of ``width`` bytes of
    offsets, the same for both replicas. What is broken is one record up to its file's end. Bodies are not shuffled; a file
    of many records is ordered in one task, with some hundred bytes for each.
    """
    at = F.locate(root.rstrip("/") + "/", F.col("path"))
    file = F.when(at > 0, F.substr("path", at + len(root.rstrip("/")) + 1, F.length("path"))).otherwise(F.col("path"))
    r = read.select(file.alias("file"), F.expr(f"offset div {int(width)}").alias("bucket"), F.coalesce("record_id", "uri", "sha256").alias("key"), "offset", "length", "sha256")
    place = (F.row_number().over(Window.partitionBy("file").orderBy("offset")) - 1).cast("long")
    return r.select("file", "bucket", "key", place.alias("place"), "offset", "length", "sha256")


def depth_of(*leaves: DataFrame) -> int:
    """Levels above the buckets until each file has one root, the same for both replicas."""
    most = max((t.agg(F.max("bucket")).first()[0] or 0) for t in leaves)
    depth = 1
    while FANOUT**depth <= most:
        depth += 1
    return depth


def merkle(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(file, level, node, offset, length, sha256) of every range: level 1 holds the buckets, level ``depth`` + 1 a root for each file."""
    below = F.sort_array(F.collect_list(F.struct("place", "length", "sha256", "offset")))
    level = leaves.groupBy("file", F.col("bucket").alias("node")).agg(below.alias("b"))
    out = []
    for k in range(1, depth + 2):
        told = F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["length"].cast("string"), x["sha256"])), "\n")
        total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["length"])
        level = level.select("file", F.lit(k).alias("level"), "node", F.element_at("b", 1)["offset"].alias("offset"), total.alias("length"), F.sha2(told, 256).alias("sha256"))
        out.append(level)
        children = F.sort_array(F.collect_list(F.struct(F.col("node").alias("place"), "length", "sha256", "offset")))
        level = level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("node")).agg(children.alias("b"))
    tree = out[0]
    for x in out[1:]:
        tree = tree.union(x)
    return tree


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, key, state, place, offset, length, sha256, their_*): the records in which two replicas differ.

    ``ours`` and ``theirs`` are ``records`` of the same number of files, or ``scanned`` with the same width; two empty tables have no differences. state: ``changed``, or where only one
    has a record of this key ``missing`` (theirs lacks it) or ``surplus``. Equal roots end a file's audit; below
    a root that differs, only differing nodes are opened. In a bucket that differs equal records cancel out, as often as both have
    them, and what is left meets by key; of several records of a key the k-th by digest meets the k-th.
    """
    a, b = materialise(ours, "ours"), materialise(theirs, "theirs")
    depth = depth_of(a, b)
    ta, tb = materialise(merkle(a, depth), "tree"), materialise(merkle(b, depth), "tree")
    suspect = None
    for k in range(depth + 1, 0, -1):
        x = ta.where(F.col("level") == k).select("file", "node", "sha256")
        y = tb.where(F.col("level") == k).select("file", "node", F.col("sha256").alias("h"))
        if suspect is not None:
            below = suspect.select("file", F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
            x, y = x.join(below, ["file", "node"], "left_semi"), y.join(below, ["file", "node"], "left_semi")
        differ = materialise(x.join(y, ["file", "node"], "full").where("not (sha256 <=> h)").select("file", "node"), "suspect")
        release(suspect) if suspect is not None else None
        suspect = differ
    release(ta, tb)
    at = suspect.withColumnRenamed("node", "bucket")
    nth = Window.partitionBy("file", "key", "sha256").orderBy("place")
    side = lambda t: t.join(at, ["file", "bucket"], "left_semi").withColumn("nth", F.row_number().over(nth))
    x, y = materialise(side(a), "ours-open"), materialise(side(b), "theirs-open")
    release(a, b, suspect)
    same = (x.file == y.file) & x.key.eqNullSafe(y.key) & (x.sha256 == y.sha256) & (x.nth == y.nth)
    turn = Window.partitionBy("file", "key").orderBy("sha256", "nth")
    mine = x.join(y, same, "left_anti").withColumn("turn", F.row_number().over(turn)).drop("bucket", "nth")
    other = y.join(x, same, "left_anti").withColumn("turn", F.row_number().over(turn))
    other = other.select(F.col("file").alias("f"), F.col("key").alias("k"), F.col("turn").alias("t"), F.col("place").alias("their_place"), F.col("offset").alias("their_offset"), F.col("length").alias("their_length"), F.col("sha256").alias("their_sha256"))
    state = F.when(F.col("sha256").isNull(), "surplus").when(F.col("their_sha256").isNull(), "missing").otherwise("changed")
    both = mine.join(other, (mine.file == other.f) & mine.key.eqNullSafe(other.k) & (mine.turn == other.t), "full")
    return both.select(F.coalesce("file", "f").alias("file"), F.coalesce("key", "k").alias("key"), state.alias("state"), "place", "offset", "length", "sha256", "their_place", "their_offset", "their_length", "their_sha256")


def write_warc(pages: DataFrame, path: str, files: int, key: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Write ``pages`` as WARC files below ``path``, a folder for each, as ``records`` lays them out."""
    r = laid_out(pages, files, key, url, body)
    out = r.repartition(files, "file").sortWithinPartitions("file", "place_hash", "key", "sha256")
    out.select("file", F.col("raw").alias("value")).write.partitionBy("file").option("lineSep", END).mode("overwrite").text(path)


_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r\n", re.M)


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of the records of a WARC file; header names are in lower case. What follows
    a record that does not end as its length says is one last record of type ``broken``."""
    at = 0
    while at < len(data):
        head = data.find(END.encode(), at)
        found = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(data[at : head + 2])} if head >= 0 else {}
        size = found.get("content-length", "")
        stop = head + len(END) + int(size) if size.isdigit() else -1
        if not data.startswith(b"WARC/", at) or stop < 0 or data[stop : stop + len(END)] != END.encode():
            yield at, len(data) - at, {"warc-type": "broken"}, data[at:]
            return
        yield at, stop + len(END) - at, found, data[head + len(END) : stop]
        at = stop + len(END)


def unzipped(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """(offset, length, headers, body, record) of a file whose records are gzip members one after the other; offsets and lengths are those of
    the members, the record is what they hold. What is no whole member, to the end of the file, is one record of type ``broken``."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            raw = member.decompress(data[at:] if at else data)
        except zlib.error:
            raw = None
        if raw is None or not member.eof:
            yield at, len(data) - at, {"warc-type": "broken"}, data[at:], data[at:]
            return
        size = len(data) - at - len(member.unused_data)
        for _, _, headers, body in parsed(raw):
            yield at, size, headers, body, raw
            break
        at += size


def records_of(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """(offset, length, headers, body, record) of a WARC file, plain or of gzip members."""
    if data.startswith(b"\x1f\x8b"):
        yield from unzipped(data)
    else:
        for at, n, headers, body in parsed(data):
            yield at, n, headers, body, data[at : at + n]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, type, uri, date, record_id, body, sha256) of the records of all files below ``path``, plain or of gzip members; the
    digest is of the record as it is unzipped. A file is read whole by one task, so files should be of the usual size of an archive's, a
    gigabyte at most."""
    import hashlib

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(p, at, n, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-record-id"), b.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest()) for at, n, h, b, raw in records_of(content)]
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + 256]], schema)

    names = ["path", "offset", "length", "type", "uri", "date", "record_id", "body", "sha256"]
    schema = pa.schema([(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in names])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, length long, type string, uri string, date string, record_id string, body string, sha256 string")
