"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most ``d`` < 8 bits share at least
``8 - d`` of their 8 positional bytes.  Posting keys are groups of positional
bytes (three at a time for d = 4: 20 triples such that any four positions
contain one), so a qualifying pair meets in some list; within a list the shared
positional bytes of each pair are tallied, pairs with fewer than the guaranteed
minimum go, and the rest is verified bit by bit.

Equal fingerprints are one node from the start, so copies never make pairs.
A list longer than ``LIST_LIMIT`` (many different fingerprints in one small
region) is handled without pairs: fingerprints within d bits have a common
neighbour halfway, and conversely, so linking all fingerprints of a neighbour to
one of them gives the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import components, hot_join, materialise, trimmed

#: Longest posting list that is compared pair by pair.
LIST_LIMIT = 4096
#: Posting lists up to this length emit their links; longer ones a spanning forest of them.
SHORT_LIST = 8
SEED = 42


def position_groups() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions, one within every four positions:
    three classes of positions; triples in a class, and two of a class with one of the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for c in classes if len(c) == 3]
    for i, c in enumerate(classes):
        out += [(*two, one) for two in combinations(c, 2) for one in classes[(i + 1) % 3]]
    assert all(any(set(t) <= set(four) for t in out) for four in combinations(range(8), 4))
    return [tuple(sorted(t)) for t in out]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only, and white space as in ASCII
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends)), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, fp)``, fp being the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                bits = np.array([fingerprint(x) for x in some.column(1).to_pylist()], np.uint64)
                yield pa.record_batch([some.column(0), pa.array(bits.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"key {kind}, fp long").withColumnRenamed("key", key)


def tally(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether each pair shares the guaranteed minimum of positional bytes and is within ``bits``."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)
    good = shared >= 8 - bits
    good[good] = np.bitwise_count(x[good]) <= bits
    return good


def links_of_lists(fp: np.ndarray, which: np.ndarray, bits: int, short: int = SHORT_LIST) -> tuple[np.ndarray, np.ndarray]:
    """Links within posting lists: ``which`` numbers the lists, in runs.  Short lists give their
    links, longer ones a forest with the same components."""
    cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    sizes = np.diff(np.append(cut, len(fp)))
    size = np.repeat(sizes, sizes)
    left, right = [], []
    alive = np.flatnonzero(size <= short)
    for d in range(1, short):
        alive = alive[alive + d < len(fp)]
        alive = alive[which[alive + d] == which[alive]]
        if not len(alive):
            break
        a, b = fp[alive], fp[alive + d]
        good = tally(a, b, bits)
        left.append(a[good])
        right.append(b[good])
    for at, n in zip(cut[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
        own = fp[at : at + n]
        near = np.concatenate([tally(own[i : i + 256, None], own[None, :], bits) for i in range(0, n, 256)])
        todo = np.ones(n, bool)
        for seed in range(n):
            if not todo[seed]:
                continue
            todo[seed] = False
            front = np.array([seed])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & todo)
                todo[front] = False
                left.append(own[front])
                right.append(np.repeat(own[seed], len(front)))
    empty = np.empty(0, fp.dtype)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def near_links(nodes: DataFrame, bits: int = 4, limit: int = LIST_LIMIT) -> DataFrame:
    """Links ``(u, v)`` with the same components as all pairs of the distinct
    ``nodes(fp)`` that differ in at most ``bits`` bits (4 or fewer)."""
    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4")
    masks = [signed(reduce(lambda m, p: m | 0xFF << 8 * p, group, 0)) for group in position_groups()]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])
    postings = nodes.select("fp", F.explode(slots).alias("p")).select("p.slot", "p.bytes", "fp")
    # one aggregate finds the lists that matter; single postings, nearly all, are not moved again
    lists = materialise(postings.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    cold = postings.join(lists.where(F.col("n") <= limit), ["slot", "bytes"]).select("slot", "bytes", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(table):
            slot, key, fp = (table.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.concatenate([[True], (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])])
            u, v = links_of_lists(fp.view(np.uint64), np.cumsum(new), bits)
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0).view(np.int64)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            table = pa.concat_batches([held, batch]) if held is not None else batch
            slot, key = table.column(0).to_numpy(), table.column(1).to_numpy()
            last = np.flatnonzero((slot != slot[-1]) | (key != key[-1])) if table.num_rows else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last list may go on in the next batch
            if cut:
                yield links(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)

    found = cold.repartition("slot", "bytes").sortWithinPartitions("slot", "bytes", "fp").mapInArrow(trimmed(run), "u long, v long")
    if lists.where(F.col("n") > limit).isEmpty():
        return found

    # a pair within ``bits`` has a place within ``low`` of one and ``high`` of the other; conversely all
    # fingerprints within ``high`` of a place are within ``bits`` of each that is within ``low`` of it
    low, high = bits // 2, bits - bits // 2
    flips = [sum(1 << b for b in chosen) for k in range(high + 1) for chosen in combinations(range(64), k)]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = np.array(flips, np.uint64)
        close = np.bitwise_count(offsets) <= low
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 64):
                part = fp[at : at + 64]
                columns = [pa.array((part[:, None] ^ offsets).ravel().view(np.int64)), pa.array(np.repeat(part, len(offsets)).view(np.int64)), pa.array(np.tile(close, len(part)))]
                yield pa.record_batch(columns, names=["place", "fp", "close"])

    hot = postings.join(lists.where(F.col("n") > limit), ["slot", "bytes"], "left_semi").select("fp").distinct()
    places = hot.mapInArrow(trimmed(neighbours), "place long, fp long, close boolean")
    least = places.groupBy("place").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1 and v is not null").drop("n")
    dense = places.join(least, "place").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return found.unionByName(dense)


def simhash_components(docs: DataFrame, bits: int = 4, text: str = "text", key: str = "doc_id", limit: int = LIST_LIMIT) -> DataFrame:
    """``(key, fingerprint, component_id)`` for each row of ``docs``.

    ``component_id`` is the least non-null key reachable over links of at most
    ``bits`` differing bits.  Null and empty texts have fingerprint zero and
    link like any other; rows with null keys take part and get their
    component's id (null where it has no other key).  Repeated rows are kept, texts of any
    length are read whole, a bit that exactly half the shingles set is 0, an empty table
    gives no row, and other columns are not read.
    """
    prints = materialise(fingerprints(docs, text, key), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    labels = components(near_links(nodes.select("fp"), bits, limit))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialise(named, "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    rows, different = named.agg(F.sum("n"), F.count(F.lit(1))).first()
    ids = hot_join(named.select("component", "fp", F.col("n").alias("rows")), ids, "component", different).select("fp", "component_id", F.col("rows").alias("n"))
    return hot_join(prints, materialise(ids, "ids"), "fp", rows or 0).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
