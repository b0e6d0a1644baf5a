"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the ascending array of the k least 64-bit hashes of a text's
distinct shingles.  The least k of two sketches' union is the sketch of the
texts' union, so sketches of parts merge; from two sketches follow the
resemblance, the containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import HOT, materialise

#: Hashes in a sketch: the standard error of a resemblance near 0.5 is 0.044.
K = 128
WIDTH = 5
#: Text in a range of neighbouring documents, and cells that keys are counted by at most: past 137 GB
#: ranges grow, to 1.5 GB of text at 100 TB.
RANGE_BYTES = 2 << 20
CELLS = 1 << 16


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space; none for null."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for c in "\n\t\r\f\v":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text's shingles of ``width`` words; a text with fewer
    words, but one, is a single shingle; the empty text's sketch is empty."""

    def hashes(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(let(F.transform(words(text), lambda w: F.xxhash64(w)), hashes))), 1, k)


def fingerprint_text(s: Column) -> Column:
    """A sketch as hex digits, 16 a hash."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity (0 to 1): the share of the union's sketch that both
    have.  Exact where the union has no more than k shingles; two empty sketches are alike."""
    both = let(merged(a, b, k), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.greatest(F.size(u), F.lit(1)).cast("double"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.element_at(s, -1).cast("double") + F.lit(2.0**63) + 1.0) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share (0 to 1) of a's shingles that b has; 1 for an empty a."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    share = j / (1 + j) * (na + nb) / F.greatest(na, F.lit(1.0))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def merge_groups(df: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch a group: ``by`` and ``column``.  The least k of a group are ranked with a
    limit before the shuffle, so no group is gathered; groups of empty sketches only are absent."""
    each = df.select(*by, F.explode(column).alias("_h")).distinct()
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def ranges(meta: DataFrame) -> dict[str, Column]:
    """Columns over ``key``, ``h`` and what ``with_next`` derives of them that place rows in ranges of
    about ``RANGE_BYTES``: a struct that grows with the order of the rows.

    ``meta(key, h, bytes)`` is counted by cells of equal width between the least and the
    largest key, ``CELLS`` at most; cells are cut into ranges of equal width by their bytes, so a
    row is placed by one look into an array.  A key that is a range's size by itself, or null,
    is cut by the hash of the text.
    """
    n, size, low, high, blank = meta.agg(F.count("key"), F.sum("bytes"), F.min("key"), F.max("key"), F.sum(F.when(F.col("key").isNull(), F.col("bytes")))).first()
    target = max(RANGE_BYTES, (size or 0) // CELLS)
    parts = F.lit(-(-(blank or 0) // target) or 1)
    cell = sub = F.lit(0).cast("long")
    if n and size > target and high > low:
        cells = min(CELLS, max(4, 4 * size // target))
        width = (high - low) // cells + 1
        cell = F.expr(f"(key div {width}L) - if(key < 0 and key % {width}L <> 0, 1L, 0L)") - F.lit(low // width)
        counted = {k: v for k, v in meta.where("key is not null").groupBy(cell.alias("cell")).agg(F.sum("bytes")).collect()}  # CELLS rows
        slices = [-(-width // max(1, -(-counted.get(k, 0) // target))) for k in range(max(counted) + 1)]
        sub = F.expr(f"pmod(key, {width}L)") / F.get(F.split(F.lit(",".join(map(str, slices))), ",").cast("array<bigint>"), cell.cast("int"))
        sub = F.floor(sub).cast("long")
        heavy = [k for k, v in counted.items() if v > max(2 * target, size // HOT)]  # fewer than HOT
        crowded = meta.where(cell.isin(heavy)) if heavy else None
    else:
        crowded = meta.where("key is not null") if n and size > target else None
    if crowded is not None:
        hot = crowded.groupBy("key").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > max(2 * target, size // HOT)).collect()  # fewer than HOT
        if hot:
            own = F.get(F.array(*[F.lit(-(-r["bytes"] // target)) for r in hot]), (F.array_position(F.array(*[F.lit(r["key"]).cast("long") for r in hot]), F.col("key")) - 1).cast("int"))
            parts = F.when(F.col("key").isNull(), parts).otherwise(F.coalesce(own, F.lit(1)))
        else:
            parts = F.when(F.col("key").isNull(), parts).otherwise(F.lit(1))
    else:
        parts = F.when(F.col("key").isNull(), parts).otherwise(F.lit(1))
    part = F.shiftright(F.col("u") * parts.cast("long"), 31)
    null = F.col("key").isNull()
    return {"range": F.struct(F.when(null, -1).otherwise(cell).cast("long").alias("cell"), F.when(null, 0).otherwise(sub).cast("long").alias("sub"), part.alias("part"))}


def with_next(docs: DataFrame, key: str, text: str, then: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """``then`` over ``(key, text, range, edge, next_text)`` and the window it may go on with.

    The next document is the one with the next smaller key (of equal keys, by the hash of
    the text descending; null keys last); after the last comes the first.  Rows are dealt
    out once, by range; each range also gets the first row of the range below, handed over by a
    table of a few numbers a range, ``2 * CELLS + HOT`` rows at most, that is broadcast.
    """
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("h", h)
    meta = materialise(rows.select("key", "h", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")), "keys")
    place = ranges(meta)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("u", F.shiftright("h", 33) + F.lit(1 << 30))
        order = F.coalesce(F.col("key").cast("decimal(20,0)") * F.lit(1 << 31), F.lit(str(-(10**30))).cast("decimal(32,0)")).cast("decimal(32,0)") + F.col("u")
        return df.withColumns({**place, "order": order.cast("decimal(38,0)")})

    everything = Window.orderBy("range")
    tops = placed(meta).groupBy("range").agg(F.max("order").alias("top"))
    tops = tops.select(F.col("range").alias("own"), "top", F.coalesce(F.lead("range").over(everything), F.min("range").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("above"))
    tops = F.broadcast(materialise(tops, "tops"))
    rows = placed(rows)
    rows = rows.join(tops, (F.col("range") == F.col("own")) & (F.col("order") == F.col("top")), "left")
    here, over = F.struct("range", F.lit(False).alias("edge")), F.struct(F.col("above").alias("range"), F.lit(True).alias("edge"))
    rows = rows.select("key", "text", "h", "order", F.explode(F.when(F.col("own").isNull(), F.array(here)).otherwise(F.array(here, over))).alias("at")).select("key", "text", "h", "order", "at.range", "at.edge")
    window = Window.partitionBy("range").orderBy("edge", F.desc("order"), F.desc("h"))
    return then(rows.withColumn("next_text", F.lead("text").over(window)), window)


def document_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each document and of its edited text.

    Edited: the last floor(n/3) of the n code points replaced by the first as many
    (or all) of the next document's (see ``with_next``).  Columns: ``key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    shingles, contained_in_edited``.  Null texts count as empty; rows with equal
    keys are kept; of an empty table nothing comes out.
    """

    def then(df: DataFrame, window) -> DataFrame:
        own, other = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
        n = F.char_length(own)
        third = F.floor(n / 3).cast("int")
        df = df.select("key", "range", "edge", "order", "h", "text", n.cast("long").alias("n_chars"), F.concat(F.left(own, n - third), F.left(other, third)).alias("edited"))
        df = df.select("key", "range", "edge", "order", "h", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k, width).alias("own"), sketch(F.when(~F.col("edge"), F.col("edited")), k, width).alias("changed"))
        df = df.withColumn("next", F.lead("own").over(window)).where("not edge")
        return df.select(
            F.col("key").alias(key),
            "n_chars",
            "edited_sha256",
            fingerprint_text(F.col("own")).alias("fingerprint"),
            fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
            resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
            resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
            distinct_shingles(F.col("own"), k).alias("shingles"),
            containment(F.col("own"), F.col("changed"), k).alias("contained_in_edited"),
        )

    return with_next(docs, key, text, then)
