"""WARC archives with revisit records.

1. Each page becomes a header row: id, payload length, SHA-256 digest, row number. Headers, not payloads, are
   shuffled by digest: a digest of at least ``MIN_PAYLOAD`` bytes keeps the least id as original.
2. Headers join the originals' digests; a page whose digest has another original is a revisit of it.
3. Payloads move once: they are dealt by id and digest to as many partitions as there will be archives, what is known of
   revisits is dealt alike and hashed beside them, and each partition is written as one archive by Spark's text writer. A WARC
   record ends with two line breaks, which is the writer's line separator, so archives reach any store that Spark reaches.
   Rows of one id and one payload that are over a thousandth of all (fewer than a thousand such keys, broadcast) are dealt by number.
4. ``read_archives`` reads whole archive files (small by 3.) and walks them by Content-Length, so
   payloads may hold any line breaks. ``resolve`` joins revisits to the payload of their original.

Archives are gzip streams, which take a fraction of the disk; written with ``compression="none"`` a record can be read alone at
its ``offset`` and ``length`` (Spark's text writer makes one stream a file, not one a record). A response's block is an HTTP
head and the payload, a revisit's the head alone. Record ids are unique: id, digest, and for each further row of both a row number. For
those the pages are read twice and must come in the same partitions, as files do.

Defined results: a null payload is empty; a null url writes no target header; equal ids with equal
payloads tie to the same original and each row keeps its record; pages with a null id are written
with an empty id and refer or are referred to by none; an empty table writes no record and reads as
no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common

MIN_PAYLOAD = 100
#: Bytes of an archive; small inputs make smaller ones, down to ``LEAST_BYTES``, to keep all cores at work.
ARCHIVE_BYTES, LEAST_BYTES = 32_000_000, 2_000_000
#: The capture time of fresh headers: a fixed one, so that a run repeated gives the same archives.
WARC_DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, payload string, record_id string, archive string, offset long, length long"
KEY = ["page_id", "payload_digest"]


def headers(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest)`` of every row."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )


def revisits(head: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``(page_id, payload_digest, refers_to)``: the headers ``(page_id, payload_bytes, payload_digest)`` that revisit another."""
    large = head.where((F.col("payload_bytes") >= min_payload) & F.col("page_id").isNotNull())
    # Only digests seen twice or more move on; hot digests are summed up before they move.
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = common.cut(first.select("payload_digest", "first"), "originals")
    found = large.join(first, "payload_digest").where("page_id <> first")
    return found.select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct()


def repeats(head: DataFrame) -> DataFrame:
    """``(page_id, payload_digest, first_row)``: the least ``row`` of the headers that share both."""
    return head.groupBy(*KEY).agg(F.min("row").alias("first_row"), F.count("*").alias("n")).where("n > 1 and page_id is not null").drop("n")


def records(full: DataFrame) -> DataFrame:
    """The text ``record`` of each row up to its closing line breaks."""
    uid = lambda i, more: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), F.substring("payload_digest", 1, 16), more, F.lit(">"))
    visit = F.col("refers_to").isNotNull()
    further = F.col("page_id").isNull() | F.coalesce(F.col("row") != F.col("first_row"), F.lit(False))
    # Header lines cannot hold line breaks: those of a URL are percent-encoded.
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.concat(http, F.when(visit, "").otherwise(F.col("payload")))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(visit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), uid(F.col("page_id"), F.when(further, F.concat(F.lit(":"), F.col("row").cast("string"))).otherwise(""))),
        F.lit(f"WARC-Date: {WARC_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(visit, F.concat(F.lit("WARC-Refers-To: "), uid(F.col("refers_to"), F.lit("")))),
        F.when(visit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    return full.select(F.concat(lines, F.lit(END), body).alias("record"))


def dealt_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """The headers and payloads of all rows with ``refers_to`` and ``first_row``, one partition an archive."""
    spark = pages.sparkSession
    whole = headers(pages, id_col, payload_col, url_col).withColumn("row", F.monotonically_increasing_id())
    head = common.cut(whole.select(*KEY, "payload_bytes", "row"), "headers")
    known = common.cut(revisits(head, min_payload).join(repeats(head), KEY, "full"), "revisits")
    rows, size = head.agg(F.count("*"), F.sum(F.col("payload_bytes") + 500)).first()
    n = max(1, -(-int(size or 0) // ARCHIVE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size or 0) // LEAST_BYTES))
    hot = head.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") * 1000 > F.greatest(F.lit(rows), F.lit(100_000))).drop("n")
    hot = common.cut(hot.join(known, KEY, "left").select(*KEY, F.col("refers_to").alias("hot_refers"), F.col("first_row").alias("hot_first"), F.lit(True).alias("hot")), "hot")
    same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & (a["payload_digest"] == b["payload_digest"])
    whole = whole.join(F.broadcast(hot), same(whole, hot), "left").drop(hot["page_id"]).drop(hot["payload_digest"])
    salt = F.when(F.col("hot"), F.pmod("row", F.lit(n))).otherwise(F.lit(0).cast("long"))
    dealt = whole.withColumn("salt", salt).repartition(n, *KEY, "salt")
    beside = known.withColumn("salt", F.lit(0).cast("long")).repartition(n, *KEY, "salt").hint("shuffle_hash")
    full = dealt.join(beside, [*KEY, "salt"], "left")
    return full.withColumns({"refers_to": F.coalesce("hot_refers", "refers_to"), "first_row": F.coalesce("hot_first", "first_row")})


def write_archives(
    pages: DataFrame, to: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_payload: int = MIN_PAYLOAD,
    compression: str = "gzip",
) -> None:
    """Writes one record a row under the folder ``to``, revisits without their payload."""
    full = dealt_pages(pages, id_col, payload_col, url_col, min_payload)
    records(full).write.option("lineSep", END).option("compression", compression).text(to)


def parse(raw: bytes) -> Iterator[dict]:
    """The records of one archive's bytes, walked by Content-Length."""
    at = 0
    while at < len(raw):
        split = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:split].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        start = split + 4
        end = start + int(head["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end at byte {end}")
        body = raw.index(b"\r\n\r\n", start) + 4
        http = dict(line.split(": ", 1) for line in raw[start : body - 4].decode("utf-8").split("\r\n")[1:])
        number = lambda k: int(x) if k in head and (x := head[k].split(":")[2]) else None
        yield {
            "page_id": number("WARC-Record-ID"),
            "record_type": head["WARC-Type"],
            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
            "payload_bytes": int(http["Content-Length"]),
            "refers_to": number("WARC-Refers-To"),
            "url": head.get("WARC-Target-URI"),
            "payload": raw[body:end].decode("utf-8"),
            "record_id": head["WARC-Record-ID"],
            "offset": at,
            "length": end + 4 - at,
        }
        at = end + 4


def read_archives(spark: SparkSession, at: str) -> DataFrame:
    """One row a record of the archives in a folder, plain or gzip; a revisit's payload is empty. Offsets count plain bytes."""
    common.small_batches(spark)
    types = {"string": pa.string(), "long": pa.int64()}
    arrow = pa.schema([(name, types[t]) for name, t in (x.split(" ") for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, some = content.as_py(), []
                for r in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    some.append(r | {"archive": path})
                    if len(some) >= common.ARROW_ROWS:
                        yield pa.RecordBatch.from_pylist(some, schema=arrow)
                        some = []
                yield pa.RecordBatch.from_pylist(some, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at)
    return files.select("path", "content").mapInArrow(run, RECORD)


def resolve(found: DataFrame) -> DataFrame:
    """Records with the payload of a revisit taken from the response that it refers to."""
    origin = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("original"), F.col("payload_digest"))
    wanted = found.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    origin = common.cut(origin.join(wanted, ["refers_to", "payload_digest"]).dropDuplicates(["refers_to", "payload_digest"]), "resolved")
    return (
        found.join(origin, ["refers_to", "payload_digest"], "left")
        .withColumn("payload", F.coalesce("original", "payload"))
        .drop("original")
    )


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its archive."""
    at = common.scratch(spark, "archives")
    write_archives(common.read(spark, sf_dir, "pages"), at)
    return read_archives(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc_revisits": op6_warc_revisits}
ORACLE = {
    "op6_warc_revisits": """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS body, octet_length(encode(COALESCE(html, ''))) AS payload_bytes,
         sha256(COALESCE(html, '')) AS payload_digest
  FROM pages
), f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
}
