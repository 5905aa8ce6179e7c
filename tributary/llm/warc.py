"""WARC archives: written as text files of records, read back by following record chains.

Writing: one record per page; of equal payloads the smallest page id is a
response, the others revisit it. Reading: each task splits its part of a file at
the record magic and gives, for every candidate, its offset and the offset where
its own length says the next record begins. Only candidates that the chain from
the file's start reaches are records; magic inside a payload starts none. Chains
are followed by pointer jumping over runs of candidates that point at each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import discard, fresh_path, prepare, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Repeats up to which the list of them is sent to every task (two ids and a hash, some 120 bytes each), so that no payload moves; more are joined by a shuffle, with the same rows.
SENT_REPEATS = 200_000


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 32 digits, taken 60, 60 and 40 bits at a time."""
    digits = F.sha1(data)
    part = lambda at, n: F.lpad(F.conv(F.substring(digits, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write one record per row under ``path``.

    Null payloads are empty payloads, null urls empty. Rows without an id are
    always responses (nothing can refer to them) and no other row refers to
    them; rows that repeat an id and payload are records of their own, all
    responses or all revisits. An empty table writes no record.
    """
    spark = prepare(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit(""))
    marks = pages.select(F.col(id_col).alias("id"), F.sha2(payload.cast("binary"), 256).alias("sha")).filter(F.octet_length(payload) >= least_bytes)
    firsts = marks.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeats = stored(marks.join(firsts, "sha").filter("id <> first").select(F.col("id").alias("rid"), "first", F.col("sha").alias("rsha")).distinct(), "repeats")
    few = repeats.limit(SENT_REPEATS + 1).count() <= SENT_REPEATS
    row = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("sha"))
    own = row.join(F.broadcast(repeats) if few else repeats, (F.col("id") == F.col("rid")) & (F.col("sha") == F.col("rsha")), "left")
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload").cast("binary")))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", urn(F.col("first"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    own.select(record.alias("value")).write.option("lineSep", END).text(path)
    discard(repeats)


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics: (file, block, at, length, header, value); a file's first row is what precedes its first magic."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    head = F.substring_index("value", END, 1)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.octet_length("value").cast("long").alias("length"),
        F.when(F.contains("value", F.lit(END)), head).alias("header"),
        "value",
    )


def _parsed(rows: DataFrame) -> DataFrame:
    """Narrow rows: what a record at this candidate would say of itself, and of its payload where the row is the whole record."""
    size = F.octet_length("header").cast("long") + len(END)
    told = F.try_to_number(F.nullif(_field("Content-Length"), F.lit("")), F.lit("999999999999999999")).cast("long")
    rows = rows.withColumns({"head": size, "told": told})
    whole = F.col("length") == F.col("head") + F.col("told") + len(END)
    data = F.col("value").cast("binary")
    body = F.substring(F.col("value"), F.char_length("header") + len(END) + 1, F.lit(2**31 - 1))
    http = F.substring_index(body, END, 1)
    payload = F.substring(data, (F.col("head") + F.octet_length(http) + len(END) + 1).cast("int"), (F.col("told") - F.octet_length(http) - len(END)).cast("int"))
    return rows.select(
        "file", "block", "at", "length", "head", "told", F.coalesce(whole, F.lit(False)).alias("whole"),
        F.when(whole, F.struct(base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"), F.regexp_extract(http, r"(?i)(?:^|\r\n)Content-Length: *(\d+)", 1).alias("http_length"))).alias("body"),
        _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("record"), _field("WARC-Refers-To").alias("refers"), _field("WARC-Payload-Digest").alias("digest"), _field("WARC-Target-URI").alias("url"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Adds ``s``, the byte where a candidate's magic begins (the file's start has -len(MAGIC)), and ``next``, where it ends by its own length."""
    m = len(MAGIC)
    sums = rows.groupBy("file", "block").agg(F.sum(F.col("length") + m).alias("all"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", "block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    s = F.col("base") + F.coalesce(F.sum(F.col("length") + m).over(inside), F.lit(0)) - m
    placed = rows.join(bases, ["file", "block"]).withColumn("s", s).drop("base")
    following = F.when(F.col("s") < 0, F.when(F.col("length") == 0, F.lit(0))).otherwise(F.col("s") + m + F.col("head") + F.col("told") + len(END))
    return placed.withColumn("next", following)


def _reached(rows: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start reaches, by pointer jumping.

    Candidates that each point at the following one form a run, which is
    followed as one; a run has one exit, so a run is entered once at most and
    all its candidates from the entry on are records. Runs are cut at block
    ends, so no step holds more than a block's candidates together.
    """
    order = Window.partitionBy("file", "block").orderBy("at")
    broken = F.coalesce(F.lag("next").over(order) != F.col("s"), F.lit(True)).cast("int")
    runs = rows.withColumn("broken", broken).withColumn("run", F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("broken")
    runs = stored(runs, "runs")
    ends = runs.groupBy("file", "block", "run").agg(F.max_by("next", "at").alias("exit"), F.min("s").alias("low"))
    at = runs.select("file", F.col("s").alias("exit"), F.col("block").alias("b2"), F.col("run").alias("r2"))
    jump = stored(ends.join(at, ["file", "exit"]).select("file", "block", "run", "b2", "r2", F.col("exit").alias("entry")), "jump")
    seen = stored(ends.filter("low < 0").select("file", "block", "run", F.col("low").alias("entry")), "seen")
    known, counted = seen.count(), -1
    while known != counted:
        counted = known
        far = seen.select("file", "block", "run").join(jump, ["file", "block", "run"]).select("file", F.col("b2").alias("block"), F.col("r2").alias("run"), "entry")
        more = stored(seen.unionByName(far).groupBy("file", "block", "run").agg(F.min("entry").alias("entry")), "seen")
        step = jump.select("file", "block", "run", F.col("b2").alias("mb"), F.col("r2").alias("mr"))
        again = jump.select("file", F.col("block").alias("mb"), F.col("run").alias("mr"), "b2", "r2", "entry")
        ahead = stored(step.join(again, ["file", "mb", "mr"]).select("file", "block", "run", "b2", "r2", "entry"), "jump")
        discard(seen)
        discard(jump)
        seen, jump = more, ahead
        known = seen.count()
    return runs.join(seen, ["file", "block", "run"]).withColumn("record_here", F.col("s") >= F.col("entry"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record, type, url, refers, digest, payload_digest, payload_bytes) of each record.

    ``payload_digest`` and ``payload_bytes`` are taken from the payload that was
    read; a revisit, which has none, gives what its headers say of the payload.
    """
    prepare(spark)
    rows = _placed(stored(_parsed(candidates(spark, path)), "candidates"))
    reached = _reached(stored(rows, "placed"))
    records = stored(reached.filter("record_here and s >= 0").select("file", "s", "next", "head", "told", "whole", "body", "type", "record", "refers", "digest", "url"), "records")
    torn = records.filter("not whole")
    if not torn.isEmpty():
        # Magic inside these payloads: gather what stands between the record and the next, in order, from their files only.
        files = torn.select("file").distinct()
        again = candidates(spark, path).join(files, "file", "left_semi").withColumn("told", F.lit(None).cast("long")).withColumn("head", F.lit(None).cast("long"))
        parts = _placed(again).filter("s >= 0").select("file", F.col("s").alias("ps"), "value")
        heads = records.join(files, "file", "left_semi").select("file", F.col("s").alias("hs"), "whole")
        w = Window.partitionBy("file").orderBy("ps").rowsBetween(Window.unboundedPreceding, 0)
        own = parts.join(heads, (parts["file"] == heads["file"]) & (F.col("ps") == F.col("hs")), "left").select(parts["file"], "ps", "value", "hs", "whole")
        owned = own.withColumns({"s": F.last("hs", ignorenulls=True).over(w), "w": F.last("whole", ignorenulls=True).over(w)}).filter("not w").withColumnRenamed("value", "part")
        joined = owned.groupBy("file", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ps", "part"))), lambda x: x["part"]), MAGIC).alias("text"))
        full = torn.drop("body").join(joined, ["file", "s"]).withColumn("block_data", F.substring(F.col("text").cast("binary"), (F.col("head") + 1).cast("int"), F.col("told").cast("int")))
        http = F.substring_index(F.col("block_data").cast("string"), END, 1)
        payload = F.substring("block_data", F.octet_length(http) + len(END) + 1, F.lit(2**31 - 1))
        body = F.struct(base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"), F.regexp_extract(http, r"(?i)(?:^|\r\n)Content-Length: *(\d+)", 1).alias("http_length"))
        records = records.filter("whole").unionByName(full.withColumn("body", body).select(*records.columns))
    revisit = F.col("type") == "revisit"
    return records.select(
        "record", "type", "url", "refers", "digest",
        F.when(revisit, F.regexp_replace("digest", "^sha1:", "")).otherwise(F.col("body.sha1")).alias("payload_digest"),
        F.when(revisit, F.expr("try_cast(body.http_length as long)")).otherwise(F.col("body.bytes")).alias("payload_bytes"),
    )


def page_number(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")


def warc_report(pages: DataFrame) -> DataFrame:
    """The contract's columns: the archives are written to the shared folder and read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    back = read_warc(spark, path)
    return back.select(page_number(F.col("record")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_number(F.col("refers")).alias("refers_to"))
