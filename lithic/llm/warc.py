r"""WARC archives: written by Spark's text writer, read back by boundary chains.

Writing. Each page becomes one record; the writer's line separator is the blank
line that ends a record, so the files are plain WARC on any file system. Of
pages with equal payloads of ``least`` bytes or more the one with the smallest
page_id is a response and the others are revisits without payload.

Reading. The text reader cuts files of any size into pieces at the magic
``WARC/1.1\r\n`` and deals them to tasks by byte ranges. Lengths add up to
offsets. Each piece is a candidate record; its header's Content-Length gives
the offset of its successor. Magic inside a payload makes candidates too, even
with well-formed headers; pointer jumping from the start of each file finds the
records that the chain of successors reaches, in a number of rounds that grows
with the logarithm of the records in a file. All others are payload. A record
in one piece is digested where it was read; only records that magic has cut are
put together again.

Defined results: a null html is the empty payload; equal rows with the least
page_id of a payload are all responses; a null page_id is never referred to and
stays null; control characters and blanks in a url are percent-encoded; extra
columns are ignored; an empty table gives an empty archive and result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.llm.common import drop_saved, new_path, save, table

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base 32 of 40 hexadecimal digits: five of them give four letters."""
    chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexadecimal, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.when(hexadecimal.isNotNull(), F.array_join(F.transform(chunks, lambda v: F.concat(*(letter(v, shift) for shift in (15, 10, 5, 0)))), ""))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record for every row of pages(page_id, url, html) as files under ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"sha": F.sha1("html"), "bytes": F.octet_length("html").cast("long")}).withColumn("digest", base32(F.col("sha")))
    firsts = save(rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first"), "firsts")
    rows = rows.join(firsts, (F.col("digest") == F.col("same")) & (F.col("bytes") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(revisit, F.lit(HTTP + BREAK)).otherwise(F.concat(F.lit(HTTP + BREAK), F.col("html")))
    head = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), page(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), page(F.col("first")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    rows.select(F.concat(F.lit(MAGIC), head, F.lit(BREAK), block).alias("value")).write.option("lineSep", BREAK).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """value, place (file, block, id) and key of everything between two magics; only the key is the same in every scan."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    key = F.struct(F.xxhash64("value"), F.crc32(F.col("value")), F.octet_length("value"))
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), key.alias("key"))


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _digested(records: DataFrame) -> DataFrame:
    """records(whole, head, length) with payload_bytes and payload_digest instead of whole."""
    block = records.withColumn("block_", F.expr("substring(cast(whole as binary), octet_length(head) + 5, cast(length as int))"))
    payload = block.withColumn("payload", F.expr("substring(block_, octet_length(substring_index(cast(block_ as string), '\\r\\n\\r\\n', 1)) + 5)"))
    whole = F.col("whole").isNotNull()
    hashed = payload.withColumns({"payload_bytes": F.when(whole, F.octet_length("payload").cast("long")), "sha": F.when(whole, F.sha1("payload"))})
    return hashed.withColumn("payload_digest", base32(F.col("sha"))).drop("whole", "block_", "payload", "sha")


def _reachable(candidates: DataFrame) -> DataFrame:
    """(file, at) of the records that the chain from each file's start reaches; candidates(file, at, next)."""
    jump = save(candidates.where("next is not null").select("file", "at", F.col("next").alias("to")), "jumps")
    starts = candidates.where("at = 0").select("file", "at")
    reached = save(starts, "reached")
    count = reached.count()
    while True:
        there = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        more = save(reached.union(there).distinct(), "reached")
        now = more.count()
        drop_saved(reached)
        reached = more
        if now == count:
            return reached
        count = now
        twice = jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("end")), ["file", "to"]).select("file", "at", F.col("end").alias("to"))
        further = save(twice, "jumps")
        drop_saved(jump)
        jump = further


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record under ``path``."""
    pieces = _pieces(spark, path)
    size = F.octet_length("value")
    head = F.when(F.contains("value", F.lit(BREAK)), F.substring_index("value", BREAK, 1))
    parsed = pieces.withColumns({"size": size, "head": head})
    parsed = parsed.withColumn("length", F.expr("try_cast(nullif(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)[ \\t]*(?:\\r\\n|$)', 1), '') as long)"))
    whole = F.col("size") >= F.octet_length("head") + 4 + F.col("length")
    parsed = parsed.withColumn("whole", F.when(whole, F.col("value"))).drop("value")
    small = save(_digested(parsed), "candidates")

    by_file = W.partitionBy("file").orderBy("block", "id")
    before = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(by_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = small.withColumn("at", before - len(MAGIC)).withColumn("next", F.col("at") + len(MAGIC) + F.octet_length("head") + 4 + F.col("length") + len(BREAK))
    placed = save(placed, "placed")
    found = _reachable(placed.where("length is not null").select("file", "at", "next"))
    marked = placed.join(found.withColumn("record", F.lit(True)), ["file", "at"], "left")
    # records that magic cut: all pieces up to the next record belong to them
    owner = F.last(F.when(F.col("record"), F.col("at")), ignorenulls=True).over(by_file)
    marked = save(marked.withColumn("owner", owner), "marked")
    records = marked.where("record")
    cut = records.where("payload_digest is null").select("file", F.col("at").alias("owner"), F.col("head").alias("head_"), F.col("length").alias("length_"))
    parts = save(marked.join(cut, ["file", "owner"]).select("file", "block", "id", "owner", "head_", "length_", "key"), "parts")
    # a second scan may cut the files into other stretches, so texts are found again by what they are
    texts = pieces.select("file", "key", "value").join(parts.select("file", "key").distinct(), ["file", "key"], "left_semi").groupBy("file", "key").agg(F.first("value").alias("value"))
    parts = parts.join(texts, ["file", "key"])
    joined = parts.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda p: p["value"]), MAGIC).alias("whole"), F.first("head_").alias("head"), F.first("length_").alias("length"))
    columns = ["head", "payload_bytes", "payload_digest"]
    every = records.where("payload_digest is not null").select(columns).unionByName(_digested(joined).select(columns))
    number = lambda name: F.expr(f"try_cast(nullif(regexp_extract(head, '(?i)(?:^|\\r\\n){name}:[ \\t]*<urn:page:(-?[0-9]*)>', 1), '') as long)")
    records = save(
        every.select(
            number("WARC-Record-ID").alias("page_id"),
            _field("WARC-Target-URI").alias("url"),
            "payload_bytes",
            F.when(_field("WARC-Type") == "revisit", F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
            _field("WARC-Type").alias("record_type"),
            number("WARC-Refers-To").alias("refers_to"),
        ),
        "records",
    )
    # a revisit has the length of the response it refers to
    sizes = save(records.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("full_bytes")), "sizes")
    revisits = records.where("record_type = 'revisit'").join(sizes.withColumnRenamed("page_id", "refers_to"), ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("full_bytes"))
    out = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type <> 'revisit'").select(out).unionByName(revisits.select(out))


def op5_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """All pages into archives and back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url")
