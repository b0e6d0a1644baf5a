"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences.  Karp-Rabin hashes of ``width``
words give the seeds; documents' seeds that pass a bit filter of the benchmark's,
of bounded size, are joined to the benchmark's seed table, so that neither side is
gathered anywhere.  For each document and item that share seeds, those that go on
along a diagonal are one match; again and again the longest match whose words are
free in both texts is marked as a tile, what is left of overlapped matches staying in
the game while it has ``width`` words.  An item is leaked where the tiles cover enough
of its words, in whatever order its parts stand in the document.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import materialise, trimmed

WIDTH = 5
COVERAGE = 0.8
#: Bits of the filter at least and at most (8 MB), as powers of two; 32 bits a seed, of which its two
#: hashes set two, where they suffice.
#: With more seeds than that the filter lets more through, which the join sorts out.
LEAST_BITS, MOST_BITS = 12, 26
#: Distinct words whose codes a task remembers.
MEMORY = 200_000
BASE, CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Scripts without spaces between words: each character is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def tiles(pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of seeds ``(place in item, place in document)``: the tiles as
    ``(item place, document place, words)``, longest first, ties by place."""
    heap: list[tuple[int, int, int]] = []
    begin = before = None
    for d, p in sorted((q - p, p) for p, q in set(pairs)):
        if before != (d, p - 1):
            if begin:
                heap.append((-(before[1] - begin[1] + width), begin[1], begin[1] + begin[0]))
            begin = (d, p)
        before = (d, p)
    if begin:
        heap.append((-(before[1] - begin[1] + width), begin[1], begin[1] + begin[0]))
    heapq.heapify(heap)
    in_item: set[int] = set()
    in_doc: set[int] = set()
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        free = [k for k in range(-n) if p + k not in in_item and q + k not in in_doc]
        if len(free) == -n:
            in_item.update(range(p, p - n))
            in_doc.update(range(q, q - n))
            out.append((p, q, -n))
            continue
        first = last = None
        for k in [*free, None]:
            if first is not None and (k is None or k != last + 1):
                if last - first + 1 >= width:
                    heapq.heappush(heap, (-(last - first + 1), p + first, q + first))
                first = k
            elif first is None:
                first = k
            last = k
    return out


class Codes(dict):
    """Words' 64-bit codes."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def coded(texts: list[str | None], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the texts' words, one text after another, and each text's first place, and the end."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    first = np.cumsum([0, *map(len, words)])
    return np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.uint64, int(first[-1])), first


def rolling(codes: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` codes, modulo 2**64."""
    n = max(0, len(codes) - width + 1)
    return reduce(lambda h, j: h * base + codes[j : j + n], range(width), np.zeros(n, np.uint64))


def benchmark_seeds(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """``(item, item_id, words, width, hash, check, place)`` of each seed; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                own, _ = coded(row.column(2).to_pylist(), codes)
                if not len(own):
                    continue
                w = min(width, len(own))
                hashes, check = rolling(own, w), rolling(own, w, CHECK)
                n = len(hashes)
                columns = [pa.array(np.repeat(row.column(0).to_numpy(), n)), pa.array(row.column(1).to_pylist() * n, pa.int64()), pa.array(np.full(n, len(own), np.int32)), pa.array(np.full(n, w, np.int32))]
                yield pa.record_batch([*columns, pa.array(hashes.view(np.int64)), pa.array(check.view(np.int64)), pa.array(np.arange(n, dtype=np.int32))], names=["item", "item_id", "words", "width", "hash", "check", "place"])

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item).cast("long").alias("item_id"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(trimmed(run), "item long, item_id long, words int, width int, hash long, check long, place int"), "seeds")


def seed_filter(seeds: DataFrame, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int, list[int]]:
    """The filter's bits as 64-bit numbers, their number as a power of two, and the seeds' widths."""
    n = seeds.count()
    bits = min(most_bits, max(LEAST_BITS, (32 * n).bit_length()))
    place = seeds.select(F.explode(F.array("hash", "check")).alias("h")).select(F.shiftrightunsigned("h", 64 - bits).alias("p"))
    parts = place.groupBy(F.shiftright("p", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    out = np.zeros(1 << max(0, bits - 6), np.uint64)
    for k, b in parts.collect():  # 2**20 rows at most
        out[k] = np.uint64(b & (1 << 64) - 1)
    return out, bits, sorted(r[0] for r in seeds.select("width").distinct().collect())  # ``WIDTH`` numbers at most


def document_hits(docs: DataFrame, seeds: DataFrame, text: str, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """``(row, key, text_hash, width, hash, check, places)``: seeds of documents that pass the filter."""
    members, bits, widths = seed_filter(seeds, most_bits)
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()

        def member(hashes: np.ndarray) -> np.ndarray:
            place = hashes >> np.uint64(64 - bits)
            return (members.take(place >> np.uint64(6)) >> (place & np.uint64(63))) & np.uint64(1) > 0

        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                some = batch.slice(start, 250)
                own, first = coded(some.column(3).to_pylist(), codes)
                for width in widths:
                    hashes = rolling(own, width)
                    at = np.flatnonzero(member(hashes))
                    check = reduce(lambda h, j: h * CHECK + own[at + j], range(width), np.zeros(len(at), np.uint64))
                    doc = np.searchsorted(first, at, "right") - 1
                    passed = member(check) & (at + width <= first[doc + 1])  # no seed spans two documents
                    at, doc, check = at[passed], doc[passed], check[passed]
                    if not len(at):
                        continue
                    found = hashes[at]
                    order = np.lexsort((at, check, found, doc))
                    at, doc, found, check = at[order], doc[order], found[order], check[order]
                    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (found[1:] != found[:-1]) | (check[1:] != check[:-1])]))
                    places = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)).astype(np.int32)), pa.array((at - first[doc]).astype(np.int32)))
                    rows = pa.array(doc[cut])
                    yield pa.record_batch([*(some.column(i).take(rows) for i in range(3)), pa.array(np.full(len(cut), width, np.int32)), pa.array(found[cut].view(np.int64)), pa.array(check[cut].view(np.int64)), places], names=["row", "key", "text_hash", "width", "hash", "check", "places"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(trimmed(run), f"row long, key {kind}, text_hash long, width int, hash long, check long, places array<int>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, width: int = WIDTH, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """``(row, key, text_hash, item_id, coverage, tiles)`` for each leaked item of each row of ``docs``.

    Words are runs of letters and digits in lower case; characters of scripts that don't
    space words are words.  An item of fewer than ``width`` words is leaked where a document
    has the whole of it; items without a word never are.  Null and empty texts have no
    leaks; texts of any length are searched whole; repeated items and rows count each; null keys are
    kept; an empty benchmark or table gives no row.  Of matches of equal length the first
    in the item, then in the document, is marked first.
    """
    seeds = benchmark_seeds(benchmark, item, item_text, width)
    hits = materialise(document_hits(docs, seeds, text, key, most_bits), "hits")
    both = hits.join(seeds, ["width", "hash", "check"])
    # what the seeds cover of an item bounds what tiles can
    pairs = both.groupBy("row", "item").agg(*[F.first(c).alias(c) for c in ("key", "text_hash", "item_id", "words", "width")], F.collect_list(F.struct("place", "places")).alias("seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "key", "text_hash", "item_id", "words", "width", "seeds"]
        for batch in batches:
            keep, found = [], []
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names[3:], 3)}
                covered = np.zeros(row["words"], bool)
                for seed in row["seeds"]:
                    covered[seed["place"] : seed["place"] + row["width"]] = True
                if covered.sum() < coverage * row["words"]:
                    continue
                got = tiles([(s["place"], q) for s in row["seeds"] for q in s["places"]], row["width"])
                share = sum(n for _, _, n in got) / row["words"]
                if share >= coverage:
                    keep.append(i)
                    found.append((share, len(got)))
            columns = [batch.column(k).take(pa.array(keep, pa.int64())) for k in range(4)]
            yield pa.record_batch([*columns, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())], names=["row", "key", "text_hash", "item_id", "coverage", "tiles"])

    kind = hits.schema["key"].dataType.simpleString()
    pairs = pairs.select("row", "key", "text_hash", "item_id", "words", "width", "seeds")
    return pairs.mapInArrow(trimmed(run), f"row long, key {kind}, text_hash long, item_id long, coverage double, tiles int")


def leaked_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row for each document with leaked items: ``key, n_items, item_ids, coverage`` (the highest);
    see ``find_leaks``."""
    found = find_leaks(docs, benchmark, key=key, **options)
    rows = found.groupBy("row", "key").agg(F.count(F.lit(1)).cast("int").alias("n_items"), F.transform(F.sort_array(F.collect_list(F.struct("item_id"))), lambda v: v["item_id"]).alias("item_ids"), F.max("coverage").alias("coverage"))
    return rows.select(F.col("key").alias(key), "n_items", "item_ids", "coverage")


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without leaked items, with all their columns; see ``find_leaks``."""
    found = find_leaks(docs, benchmark, key=key, text=text, **options)
    gone = materialise(found.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")).distinct(), "leaked")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_own"), F.xxhash64(F.col(f"`{text}`")).alias("_text"))
    return packed.join(gone, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_text") == F.col("_hash")), "left_anti").select("_row.*")
