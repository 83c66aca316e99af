"""Query op8: the fixity audit of all pages against a replica in which records have rotted, gone and come."""

from pyspark.sql import functions as F

from gneiss.llm.common import table
from gneiss.llm.warc import DATE, audit, files_for, records


def op8_warc_fixity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotten = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substr("html", F.lit(2), F.length("html")))).otherwise(F.col("html"))
    replica = pages.where("not (page_id % 193 <=> 7)").withColumn("html", rotten)
    added = pages.where("page_id % 389 = 11").select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    files = files_for(pages)
    found = audit(records(pages, files), records(replica.union(added), files))
    return found.select(F.col("key").alias("page_id"), "file", "state", "place", "offset", "length", "sha256", "their_offset", "their_length", "their_sha256")


QUERIES = {"op8_warc_fixity": op8_warc_fixity}

_ID = "md5('record ' || page_id || ' ' || url)"
_RAW = f"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
 || substring({_ID}, 1, 8) || '-' || substring({_ID}, 9, 4) || '-' || substring({_ID}, 13, 4) || '-' || substring({_ID}, 17, 4) || '-' || substring({_ID}, 21, 12) || '>' || chr(13) || chr(10)
 || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
 || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"""
_LAID = """SELECT *, row_number() OVER w - 1 AS place, CAST(sum(strlen(raw)) OVER w - strlen(raw) AS BIGINT) AS "offset", strlen(raw) AS length, sha256(raw) AS sha256
  FROM (SELECT *, h // width AS file FROM (SELECT page_id, CAST('0x' || substring(md5('file:' || page_id), 1, 15) AS BIGINT) AS h, {0} AS raw FROM {1}), n)
  WINDOW w AS (PARTITION BY file ORDER BY h, page_id ROWS UNBOUNDED PRECEDING)"""

ORACLES = {
    "op8_warc_fixity": f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), n AS (
  SELECT (1152921504606846976 + files - 1) // files AS width FROM (SELECT greatest(1, CAST(ceil(count(*) / 1024.0) AS BIGINT)) AS files FROM pages)
), q AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN '#' || substring(html, 2) ELSE html END AS html FROM p WHERE page_id % 193 <> 7
  UNION ALL SELECT -1 - page_id, url, html FROM p WHERE page_id % 389 = 11
), a AS ({_LAID.format(_RAW, "p")}), b AS ({_LAID.format(_RAW, "q")})
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file, b.file) AS file, CASE WHEN a.page_id IS NULL THEN 'surplus' WHEN b.page_id IS NULL THEN 'missing' ELSE 'changed' END AS state,
       a.place, a."offset", a.length, a.sha256, b."offset" AS their_offset, b.length AS their_length, b.sha256 AS their_sha256
FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.sha256 IS DISTINCT FROM b.sha256
"""
}
