"""WARC archives: written by Spark, read back by verified chains of record boundaries.

Writing: a row of text for each record, separated by the blank lines that end a WARC record, so each part
file is an archive. Reading: files are split at the version line wherever it occurs, payloads included.
Each piece is a candidate record and names its successor's offset, from its own Content-Length. Pointer
jumping from offset 0 of every file then keeps the candidates that are reachable; all others lie in payloads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, scratch_dir, table

MAGIC, GAP = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
#: Most revisits (two longs each) that are broadcast to the pages, which then aren't shuffled; more are joined by a shuffle.
BROADCAST_REVISITS = 500_000
#: Most hashes of pieces inside payloads that look like records that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_PIECES = 50_000
DATE = "2024-01-01T00:00:00Z"


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, refers_to): pages whose payload another page with a larger id has too.

    Digests are counted before pages are joined to them, so a payload shared by very many pages is one row.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.select(F.col("page_id").cast("long"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size")).filter(F.col("size") >= least)
    marked = materialize(marked.filter("page_id IS NOT NULL"), "warc-digests")
    shared = marked.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least_id")).filter("refers_to > least_id")
    return marked.join(shared.drop("least_id"), ["digest", "size"]).filter("page_id < refers_to").select("page_id", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Writes a record for each row of pages (page_id, url, html) to archives under path.

    A null html is an empty payload; of equal payloads of at least `least` bytes all but those with the
    largest page_id become revisits without payload; line ends in a url are dropped, and a null url becomes
    a urn; rows with a null page_id are responses of their own; repeated rows are records each (of the largest
    page_id all are responses); empty tables give an empty archive; further columns are ignored.
    """
    later = materialize(revisits(pages, least).withColumnRenamed("page_id", "r_page_id"), "warc-revisits")
    if later.count() <= BROADCAST_REVISITS:
        later = F.broadcast(later)
    html = F.coalesce("html", F.lit(""))
    page = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit(""))
    first = F.col("refers_to").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(GAP))
    block = F.when(first, F.concat(http, html)).otherwise(http)
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(first, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "),
        F.coalesce(F.translate("url", "\r\n", ""), F.concat(F.lit("urn:page:"), page)),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1(html.cast("binary")),
        F.when(first, "").otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(GAP),
    )
    rows = pages.select("page_id", "url", "html").join(later, F.col("page_id") == F.col("r_page_id"), "left")
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", GAP).text(path)


def _reachable(links: DataFrame) -> DataFrame:
    """(file, at) reachable from offset 0 of each file over links (file, at, next), by pointer jumping.

    Round k adds what lies 2**k steps from what was reached, then squares the jumps; it ends when a round adds nothing.
    """
    jumps = links.filter(F.col("next") > F.col("at"))
    reached = links.filter("at = 0").select("file", "at").distinct()
    n = reached.count()
    while True:
        more = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        exists = links.select("file", "at")
        reached = materialize(reached.union(more).distinct().join(exists, ["file", "at"], "left_semi"), "warc-reached")
        before, n = n, reached.count()
        if n == before:
            return reached
        far = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jumps = materialize(jumps.join(far, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "warc-jumps")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives under path.

    Pieces are numbered as they lie in their split; offsets are the running sums of the pieces' lengths. A
    record whose payload holds the version line covers several pieces, which are put together again; an archive's
    pieces are ordered in one task, by offsets alone. How files are split need not be the same each time that
    they are read. Page ids may be negative or missing (null); repeated records are returned each; an empty
    folder gives an empty result.
    """
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("k"), "value"
    )
    head = F.substring_index("value", GAP, 1)
    field = lambda name: F.regexp_extract("h", rf"(?m)(?:^|\n){name}: ([^\r\n]*)", 1)
    start = F.octet_length("h") + len(GAP)
    raw = F.col("value").cast("binary")
    whole = pieces.withColumn("h", head).withColumn("size", F.octet_length("value"))
    whole = whole.withColumn("length", field("Content-Length").try_cast("long")).withColumn("complete", F.col("size") >= start + F.col("length"))
    block = F.when(F.col("complete"), F.substring(raw, (start + 1).cast("int"), F.col("length").cast("int")))
    light = whole.select(
        "file", "split", "k", "size", (start + F.col("length") + len(GAP)).alias("span"), "complete",
        F.regexp_extract("h", r"WARC-Record-ID: <urn:page:(-?\d*)>", 1).try_cast("long").alias("page_id"), field("WARC-Type").alias("record_type"),
        F.regexp_extract("h", r"WARC-Refers-To: <urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"), F.regexp_extract("h", r"WARC-Payload-Digest: sha1:(\w+)", 1).alias("said"),
        F.when(F.col("complete"), F.struct(*_payload(block))).alias("p"), F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2"),
        # A piece that isn't just one record may be part of one; its text stays at hand.
        F.when(~F.coalesce(F.col("size") == start + F.col("length") + len(GAP), F.lit(False)), F.col("value")).alias("text"),
    )
    light = materialize(light, "warc-pieces")
    in_file = Window.partitionBy("file").orderBy("split", "k")
    # The piece before the first version line is empty; a candidate begins one version line before its piece.
    placed = light.withColumn("at", F.sum(F.col("size") + len(MAGIC)).over(in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") - 2 * len(MAGIC))
    placed = materialize(placed.filter("at >= 0").withColumn("next", F.col("at") + len(MAGIC) + F.col("span")), "warc-candidates")
    reached = _reachable(placed.select("file", "at", "next"))
    kept = placed.join(reached, ["file", "at"])
    simple = kept.filter("complete")
    spread = kept.filter("NOT complete OR complete IS NULL").select(F.col("file").alias("r_file"), F.col("at").alias("record"), "next", "page_id", "record_type", "refers_to", "said")
    rest = _spread(placed.select("file", "at", "h1", "h2", "text"), pieces.select("value"), spread, field)
    fields = ["page_id", "record_type", "refers_to", "said", "p"]
    out = simple.select(fields).union(rest.select(fields))
    bytes_, digest = F.col("p.bytes"), F.when(F.col("record_type") == "revisit", F.col("said")).otherwise(F.col("p.digest"))
    return out.select("page_id", bytes_.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def _payload(block) -> list:
    """Length (as the HTTP head has it, so that revisits tell it too) and SHA-1 of the payload in a record's block of bytes."""
    head = F.substring_index(block.cast("string"), GAP, 1)
    body = F.substring(block, (F.octet_length(head) + len(GAP) + 1).cast("int"), F.octet_length(block))
    return [F.regexp_extract(head, r"Content-Length: (\d+)", 1).try_cast("long").alias("bytes"), F.sha1(body).alias("digest")]


def _spread(placed: DataFrame, pieces: DataFrame, records: DataFrame, field) -> DataFrame:
    """The records that cover several pieces, with their payload's length and digest."""
    owner = placed.join(records, (F.col("file") == F.col("r_file")) & (F.col("at") >= F.col("record")) & (F.col("at") < F.col("next")))
    parts = materialize(owner.select("file", "at", "record", "page_id", "record_type", "refers_to", "said", "h1", "h2", "text"), "warc-parts")
    # Pieces that look like records have only hashes of their texts, which are found again in the archives
    # wherever these are split now. All text is shuffled only where very many pieces are missing.
    wanted = materialize(parts.filter("text IS NULL").select("h1", "h2").distinct(), "warc-wanted")
    n = wanted.count()
    again = pieces.select(F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2"), "value").join(F.broadcast(wanted) if n <= BROADCAST_PIECES else wanted, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    found = parts.filter("text IS NULL").drop("text").join(again, ["h1", "h2"]) if n else parts.limit(0).withColumnRenamed("text", "value")
    columns = ["file", "at", "record", "page_id", "record_type", "refers_to", "said", "value"]
    texts = parts.filter("text IS NOT NULL").withColumnRenamed("text", "value").select(columns).unionByName(found.select(columns))
    whole = texts.groupBy("file", "record", "page_id", "record_type", "refers_to", "said").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
    whole = whole.select("page_id", "record_type", "refers_to", "said", F.array_join(F.transform("v", lambda x: x["value"]), MAGIC).alias("value"))
    h = whole.withColumn("h", F.substring_index("value", GAP, 1)).withColumn("length", field("Content-Length").cast("int"))
    block = F.substring(F.col("value").cast("binary"), F.octet_length("h") + len(GAP) + 1, F.col("length"))
    return h.select("page_id", "record_type", "refers_to", "said", F.struct(*_payload(block)).alias("p"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN k.keeper > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper > p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k USING (html)
"""
