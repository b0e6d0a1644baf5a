"""WARC archives: written by Spark's text writer, read back by splits.

Writing: a record is one string value, the writer's line separator is the blank
line pair that ends a record.  Reading: splits are cut at the magic string, so
each task emits candidate records with their offset and their successor's offset
(header and Content-Length).  A magic string may also stand inside a payload;
only candidates reachable from the file's start are records.  Reachability is
pointer jumping over the candidates that don't simply follow one another: runs
of candidates, each the successor of the one before, are contracted first, so
the jumps work on one node per file, split and false candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import HOT, materialise, scratch

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Repeated payloads' digests that are sent to all tasks at most, about 20 MB.
MOST_BROADCAST = 200_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 5 hex digits are 4 base-32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def header_value(text: Column) -> Column:
    """A text that is safe as a header value: line ends and the percent sign are escaped."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Writes one record per row of ``pages`` to WARC files under ``path``.

    The payload is ``html`` in UTF-8, null as empty.  Of records with equal
    payloads of at least ``min_bytes`` bytes, the one with the smallest ``key`` is
    a response and the others are revisits that refer to it; rows that repeat that
    very key are responses too, and so are rows with null keys.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload")})
    first = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = materialise(first.where("copies > 1 and first is not null").select("digest", "first", "copies"), "repeated")
    # payloads stay where they are while the repeated digests are few; else both sides are dealt out by digest
    if first.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(first.drop("copies")), "digest", "left")
    else:
        total = rows.count()
        hot = F.broadcast(first.where(F.col("copies") * HOT > total).drop("copies"))  # fewer than HOT
        cold = rows.join(hot, "digest", "left_anti").join(first.where(F.col("copies") * HOT <= total).drop("copies"), "digest", "left")
        rows = rows.join(hot, "digest").unionByName(cold)
    revisit = F.coalesce(F.col("first") < F.col("id"), F.lit(False))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", header_value(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("first")))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    # a binary cast to string keeps its bytes; the text writer puts them out as they are
    rows.withColumn("block", block).select(F.concat(header.cast("binary"), F.col("block")).cast("string").alias("value")).write.option("lineSep", END).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The files' text between magic strings: ``file, split, at`` (rank in the split), ``data`` binary."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("data"))
    return lines


def parsed(data: Column) -> dict[str, Column]:
    """Header fields of a candidate: its text up to the first blank line."""
    text = data.cast("string")
    head = F.substring_index(text, END, 1)
    size = F.when(F.octet_length(head) < F.octet_length(data), F.octet_length(head) + 4)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))

    return {
        "header_bytes": size,
        "block_bytes": field("Content-Length").try_cast("long"),
        "record_type": field("WARC-Type"),
        "record_id": field("WARC-Record-ID"),
        "url": field("WARC-Target-URI"),
        "declared": field("WARC-Payload-Digest"),
        "refers": field("WARC-Refers-To"),
    }


def located(found: DataFrame) -> DataFrame:
    """Adds each segment's ``begin``, the offset of its magic string, from the lengths in its file.

    Lengths are summed within a split, whose rows a reader task bounds, and over
    the splits of a file; payloads are not needed for it.
    """
    own = Window.partitionBy("file", "split").orderBy("at")
    sums = found.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("all"))
    before = sums.withColumn("before", F.coalesce(F.sum("all").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    inside = F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("inside", inside).join(before, ["file", "split"]).withColumn("begin", F.col("inside") + F.col("before") - len(MAGIC)).drop("inside", "before")


def reachable(candidates: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Of ``candidates(file, split, begin, next)``, those on the chain of successors from offset 0.

    ``next`` may be null (no readable header: the chain ends there).  Contraction:
    within a split a candidate continues its run if the one before names it as
    successor and nothing else jumps to it; the heads' pointers are then doubled
    with their marks, in about log2(heads of a file) joins of small rows.
    """
    order = Window.partitionBy("file", "split").orderBy("begin")
    rows = candidates.select("file", "split", "begin", "next").withColumns({"prior": F.lag("next").over(order), "later": F.lead("begin").over(order)})
    jumps = rows.where("next is not null and (later is null or later <> next)").select("file", F.col("next").alias("begin")).distinct().withColumn("jumped", F.lit(True))
    rows = rows.join(jumps, ["file", "begin"], "left")
    starts = F.col("prior").isNull() | (F.col("prior") != F.col("begin")) | F.coalesce("jumped", F.lit(False))
    rows = rows.withColumn("head", F.max(F.when(starts, F.col("begin"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = materialise(rows.select("file", "begin", "next", "head"), "runs")
    spark = candidates.sparkSession
    tails = rows.groupBy("file", "head").agg(F.max_by("next", "begin").alias("to"))
    tails = tails.withColumn("mark", F.col("head") == 0)
    heads = materialise(tails, "heads")
    for _ in range(max_rounds):
        on = heads.where("mark and to is not null").select("file", F.col("to").alias("head")).distinct().withColumn("reached", F.lit(True))
        far = heads.select("file", F.col("head").alias("to"), F.col("to").alias("to2"))
        step = heads.join(on, ["file", "head"], "left").join(far, ["file", "to"], "left")
        step = step.select("file", "head", F.col("to2").alias("to"), (F.col("mark") | F.coalesce("reached", F.lit(False))).alias("mark"))
        heads = materialise(step, "heads")
        if heads.where("to is not null").isEmpty():
            break
    else:
        raise RuntimeError("the chain of records did not end")
    return rows.join(heads.where("mark").select("file", "head"), ["file", "head"]).select("file", "begin", "next")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``: ``file, begin, next``, header fields,
    ``payload_bytes`` and ``payload_digest`` of the stored payload, ``http_bytes`` as the HTTP header declares."""
    raw = segments(spark, path)
    fields = parsed(F.col("data"))
    whole = F.octet_length("data") == F.col("header_bytes") + F.col("block_bytes") + 4
    block = F.substring(F.col("data"), F.col("header_bytes") + 1, F.col("block_bytes").cast("int"))
    seen = raw.withColumns(fields).withColumns({"bytes": F.octet_length("data"), "whole": F.coalesce(whole, F.lit(False))})
    seen = seen.withColumns(payload_fields(F.when(F.col("whole"), block))).drop("data")
    placed = materialise(located(seen), "candidates")
    here = placed.where("begin >= 0").withColumn("next", F.col("begin") + len(MAGIC) + F.col("header_bytes") + F.col("block_bytes") + 4)
    chain = reachable(here.select("file", "split", "begin", "next"))
    records = materialise(here.drop("split", "at", "bytes").join(chain.select("file", "begin"), ["file", "begin"]), "records")
    torn = records.where("not whole and next is not null").select("file", F.col("begin").alias("record"), "next", F.col("header_bytes").alias("head"), F.col("block_bytes").alias("block"))
    if torn.isEmpty():
        return records
    # records with the magic inside: their segments are read again and joined in file order
    torn = materialise(torn, "torn")
    inner = covered(placed.select("file", "split", "begin"), torn)
    again = located(raw.join(torn.select("file").distinct(), "file", "left_semi").withColumn("bytes", F.octet_length("data")))
    parts = again.select("file", "begin", "data").join(inner.drop("split"), ["file", "begin"])
    joined = parts.groupBy("file", "record", "next", "head", "block").agg(F.array_sort(F.collect_list(F.struct("begin", F.hex("data").alias("data")))).alias("parts"))
    data = F.unhex(F.array_join(F.transform("parts", lambda p: p["data"]), "".join(f"{ord(c):02X}" for c in MAGIC)))
    body = joined.withColumn("whole_data", data)
    body = body.withColumns(payload_fields(F.substring(F.col("whole_data"), F.col("head") + 1, F.col("block").cast("int"))))
    body = body.select("file", F.col("record").alias("begin"), *[F.col(c).alias("own_" + c) for c in ("payload_bytes", "payload_digest", "http_bytes")])
    out = records.join(materialise(body, "torn"), ["file", "begin"], "left")
    return out.withColumns({c: F.coalesce("own_" + c, c) for c in ("payload_bytes", "payload_digest", "http_bytes")}).drop("own_payload_bytes", "own_payload_digest", "own_http_bytes")


def covered(segments: DataFrame, torn: DataFrame) -> DataFrame:
    """Each of ``segments(file, split, begin)`` that is a part of one of ``torn(file, record, next, ...)``,
    with that record: the last one that starts at or before it, which records of a chain, one
    after another, leave as the only choice.  It is carried on within a split, and
    from the splits of a file before by one row a split."""
    whole = F.struct("record", "next", "head", "block")
    marked = segments.join(torn.withColumn("begin", F.col("record")).withColumn("own", whole).select("file", "begin", "own"), ["file", "begin"], "left")
    last = marked.where("own is not null").groupBy("file", "split").agg(F.max("own").alias("last"))
    splits = segments.select("file", "split").distinct().join(last, ["file", "split"], "left")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "split", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("file", "split").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.withColumn("inside", F.last("own", ignorenulls=True).over(inside)).join(carried, ["file", "split"])
    found = found.withColumn("r", F.coalesce("inside", "carried")).where("begin < r.next")
    return found.select("file", "split", "begin", "r.record", "r.next", "r.head", "r.block")


def check_revisits(records: DataFrame) -> None:
    """Raises unless each revisit's digest and length are those of the payload of a response
    with the id that it refers to.  Counts by id, digest and length, so no task gathers a response's revisits."""
    revisit = F.col("record_type") == "revisit"
    rows = records.select(
        F.when(revisit, F.col("refers")).otherwise(F.col("record_id")).alias("id"),
        F.when(revisit, F.regexp_replace("declared", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("digest"),
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("payload_bytes")).alias("n"),
        revisit.cast("int").alias("revisit"),
    )
    lost = rows.groupBy("id", "digest", "n").agg(F.min("revisit").alias("lost"), F.sum("revisit").alias("n_revisits")).where("lost = 1")
    if (first := lost.first()) is not None:
        raise ValueError(f"revisits of {first['id']} agree with no response's payload")


def payload_fields(block: Column) -> dict[str, Column]:
    """Payload of an HTTP response block: what follows its header."""
    head = F.substring_index(block.cast("string"), END, 1)
    size = F.octet_length(head) + 4
    payload = F.substring(block, size + 1, F.greatest(F.octet_length(block) - size, F.lit(0)))
    return {
        "payload_bytes": F.octet_length(payload).cast("long"),
        "payload_digest": base32_sha1(payload),
        "http_bytes": F.regexp_extract(head, r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).try_cast("long"),
    }


def page_records(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Per record: ``key, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit's payload is its response's: length and digest are those its own
    headers declare, which ``check_revisits`` holds against the response's bytes.
    """

    def page(column: str) -> Column:
        return F.nullif(F.regexp_extract(F.col(column), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")

    revisit = F.col("record_type") == "revisit"
    return records.select(
        page("record_id").alias(key),
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page("refers")).alias("refers_to"),
    )


def warc_round_trip(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as WARC files and returns what reading them back gives, one row per page.

    Null and empty html have an empty payload, the first of which is a response (at the
    default ``min_bytes``); null and repeated keys are kept, as responses; payloads of any
    length that one value can have are written whole, with the magic string in them or not; an
    empty table gives no record; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(pages, path, key, url, html, min_bytes)
    records = read_warc(spark, path)
    check_revisits(records)
    return page_records(records, key)
