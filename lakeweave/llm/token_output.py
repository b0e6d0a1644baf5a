"""Token ids in grammar-compressed blocks, written in document order.

Documents are ranged by id and sorted within a range; a task encodes its range
and writes blocks (see ``repair``) as rows of Parquet files in the shared folder,
so a lost task leaves nothing behind and any store that Spark writes will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import repair
from lakeweave.llm.common import materialise, scratch, small_batches, trimmed

#: Characters of a block's texts, but for a longer last document.
BLOCK_CHARS = 4_000_000
#: Distinct chunks that a worker remembers with their ids; past it those go that were seen least, which changes no id.
MEMORY = 400_000


#: Chunks of small letters from ASCII and Latin-1: lower case and composed as they are, and all ``\p{L}``.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Steps that leave a plain chunk whole, but for the names of its bytes.
KEEPS_PLAIN = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def plain_tokenizer(tokenizer, spec: dict):
    """The model of a tokenizer of the file ``spec`` behind a cut at spaces alone, which gives plain chunks the same ids; None where
    the file has other steps than ``KEEPS_PLAIN`` or an added token that a plain chunk may hold."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps = {"normalizer": (spec["normalizer"] or {}).get("normalizers"), "pre_tokenizer": (spec["pre_tokenizer"] or {}).get("pretokenizers")}
    if steps != KEEPS_PLAIN or spec["truncation"] or spec["padding"] or any(PLAIN.fullmatch(t["content"].encode()) for t in spec["added_tokens"]):
        return None
    quick = Tokenizer(tokenizer.model)
    quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return quick


class Numbered(dict):
    """Numbers the keys that it is asked for, from 0."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids under a BPE file of the tokenizers library whose tokens never span white space.

    Texts are cut at ASCII white space, and each distinct chunk is encoded by the
    library once, all new chunks of a block in one call, separated by spaces; the
    block's ids are gathered.  Chunks are told apart by their bytes.  Where the file
    makes small letters of capitals, texts are lowered first, so that there are fewer
    chunks; where it cuts between a letter and a following mark, so is the chunk.
    Plain chunks go to the file's model without its other steps (``plain_tokenizer``).
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.terminals = max(self.tokenizer.get_vocab().values()) + 1
        self.kind = np.uint16 if self.terminals < 60_000 else np.uint32
        capitals, small = (bytes(range(a, a + 26)).decode() for a in (65, 97))
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lowers = normalizer is not None and normalizer.normalize_str(capitals) == small
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

        def cuts(mark: str) -> bool:
            probes = [(x, mark + z) for x in small for z in ("", mark, small, f" {small}")]
            return not any(mark.encode() in x[1:] for x in self.special) and all([p for p, _ in cutter.pre_tokenize_str(x + y)] == [x, *(p for p, _ in cutter.pre_tokenize_str(y))] for x, y in probes)

        spec = json.loads(self.tokenizer.to_str())
        self.quick = plain_tokenizer(self.tokenizer, spec)
        self.last = np.zeros(self.terminals, bool)
        if suffix := spec["model"].get("end_of_word_suffix"):  # tokens that end a word, where the file marks them
            self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self.marks = np.zeros(256, bool)
        if cutter is not None and self.lowers:
            self.marks[[y for y in range(33, 127) if not chr(y).isalnum() and cuts(chr(y))]] = True
        spaced = (self.ids(x) for x in ("a b", "a. b", "a \n b\t"))
        if [list(x) for x in spaced] != [[*self.ids("a"), *self.ids("b")], [*self.ids("a."), *self.ids("b")], [*self.ids("a"), *self.ids("b")]]:
            raise ValueError("the file's tokens hold white space")
        self.chunks, self.pool, self.begin, self.seen = Numbered(), np.empty(0, self.kind), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        """Keeps the chunks that were seen more than once, half of ``memory`` at most."""
        often = np.flatnonzero(self.seen > 1)
        if len(often) > self.memory // 2:
            often = np.sort(often[np.argsort(-self.seen[often], kind="stable")[: self.memory // 2]])
        keep = np.zeros(len(self.seen), bool)
        keep[often] = True
        self.chunks = Numbered((k, i) for i, k in enumerate(compress(self.chunks, keep.tolist())))
        n = np.diff(self.begin)
        self.pool = self.pool[np.repeat(keep, n)]
        self.begin = np.concatenate([[0], np.cumsum(n[keep])])
        self.seen = self.seen[keep] // 2

    def split(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
        """The texts' chunks, and how many each text has."""
        data = [(x or "").encode("utf-8", "replace") for x in texts]
        firsts = np.cumsum([0, *(len(x) + 1 for x in data)])[:-1]
        joined = b"\n".join([*data, b""])
        if self.lowers:
            lower = joined.lower()
            if any(x in lower for x in self.special):  # these are themselves in small letters only
                lower = b"\n".join([*(x if any(y in x.lower() for y in self.special) else x.lower() for x in data), b""])
            joined = lower
        buffer = np.frombuffer(joined, np.uint8)
        blank = (buffer == 32) | (buffer - np.uint8(9) < 5)
        first = ~blank
        first[1:] &= blank[:-1]
        if self.marks.any():
            mark = self.marks.take(buffer[1:])
            at = np.flatnonzero(mark & (buffer[:-1] - np.uint8(97) < 26)) + 1
            if self.quick is not None:  # there, letters of Latin-1 are as those of ASCII
                accented = np.flatnonzero(mark[1:] & (buffer[:-2] == 0xC3)) + 2
                before = buffer[accented - 1]
                at = np.sort(np.concatenate([at, accented[(before != 0x97) & (before != 0xB7)]]))  # no signs of times and division
            first[at] = True
            joined = np.insert(buffer, at, 32).tobytes()
        return joined.split(), np.add.reduceat(first, firsts, dtype=np.int64)

    def learn(self) -> None:
        """Encodes the chunks that have a number and no ids yet."""
        new = list(islice(self.chunks, len(self.begin) - 1, None))
        if not new:
            return
        plain = np.fromiter((self.quick is not None and PLAIN.fullmatch(x) is not None for x in new), bool, len(new))
        sizes = np.empty(len(new), np.int64)
        ids, sizes[plain] = self.learn_plain(list(compress(new, plain.tolist())))
        others, sizes[~plain] = self.learn_others(list(compress(new, (~plain).tolist())))
        of_plain = np.repeat(plain, sizes)
        both = np.empty(len(of_plain), self.kind)
        both[of_plain], both[~of_plain] = ids, others
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(sizes)])
        self.pool = np.concatenate([self.pool, both])

    def learn_plain(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain chunks, and how many each has: a chunk is a word of the encoding, whose last token tells its end."""
        if not chunks:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        text = b" ".join(chunks).decode()
        ids = np.array(self.quick.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        if len(ids) and self.last[ids[-1]] and len(ends := np.flatnonzero(self.last[ids])) == len(chunks):
            return ids, np.diff(ends, prepend=-1)
        encoding = self.quick.encode(text, add_special_tokens=False)
        return np.array(encoding.ids, self.kind), np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(chunks))

    def learn_others(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of any chunks, and how many each has: those whose offsets are within it."""
        if not chunks:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        texts = [x.decode() for x in chunks]
        encoding = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(encoding.ids, self.kind)
        at = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(ids))[::2]
        starts = np.cumsum([0, *(len(x) + 1 for x in texts)])[1:]  # a token at or past it is of a later chunk
        return ids, np.diff(np.searchsorted(at, starts), prepend=0)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and the place past each text's end id."""
        if len(self.chunks) > self.memory:
            self.forget()
        if not texts:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        words, many = self.split(texts)
        which = np.fromiter(map(self.chunks.__getitem__, words), np.int32, len(words))
        self.learn()
        self.seen = np.bincount(which, minlength=len(self.chunks)) + np.pad(self.seen, (0, len(self.chunks) - len(self.seen)))
        first = self.begin[which]
        n = self.begin[which + 1] - first
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.pool[np.arange(total) + np.repeat(first - (stop - n), n)]
        ends = np.append(0, stop)[np.cumsum(many)] + np.arange(1, len(texts) + 1)
        out = np.empty(int(ends[-1]), self.kind)
        free = np.ones(len(out), bool)
        free[ends - 1] = False
        out[free], out[ends - 1] = ids, end_id
        return out, ends


def encoder(path: str) -> Encoder:
    """The worker process's encoder of a file; it outlives the task."""
    import sys
    import types

    kept = sys.modules.setdefault("_lakeweave_worker", types.ModuleType("_lakeweave_worker")).__dict__.setdefault("word_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> None:
    """Writes blocks of ``docs`` to ``path``, in ascending order of the integer ``key``.

    Null texts are empty documents (the end id alone); null keys come first;
    rows with equal keys are kept, ordered by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_path)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        keys, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, keys, texts, held
            ids, ends = own.encode(texts, end_id)
            texts = []
            packed = repair.compress(ids, ends, end_id, own.terminals)
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                names=["part", "block", "start", "n_tokens", "keys", "data"],
            )
            block, start = block + 1, start + len(ids)
            keys, held = [], 0
            return row

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                texts.append(x)
                held += len(x or "")
                if held >= block_chars:
                    yield flush()
        if keys:
            yield flush()

    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    blocks = ordered.mapInArrow(trimmed(run), "part int, block int, start long, n_tokens long, keys array<bigint>, data binary")
    with small_batches(docs.sparkSession):
        blocks.write.parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of each document, decoded from the blocks.

    ``start`` adds the tokens of the parts before (one number a part), of the
    part's blocks before, and of the block's documents before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block = repair.Block(row["data"])
                sizes = block.sizes()
                stop = np.cumsum(sizes)
                ids = block.decode(0, len(sizes)).astype("<u4").tobytes()
                sums = [zlib.crc32(memoryview(ids)[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(row["keys"], pa.int64()), pa.array(stop - sizes + row["start"] + row["before"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    names=["key", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema("part int, block int, start long, n_tokens long, keys array<bigint>, data binary").parquet(path)
    totals = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, sums = 0, []
    for part, n in totals:
        sums.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(sums, "part int, before long"))  # two numbers a part
    return blocks.join(offsets, "part").mapInArrow(trimmed(run), "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Writes ``docs`` as token blocks and reads them back; see ``write_tokens`` and ``read_tokens``.

    Null and empty texts are the end id alone; null keys come first, rows with equal keys
    are kept in the order of their texts; a text of any length is one document of one block;
    an empty table gives no block and no row; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, tokenizer_path, path, end_id, text, key)
    return materialise(read_tokens(spark, path, key), "places")
