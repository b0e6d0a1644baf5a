"""Token counts without materialised ids.

A byte-level BPE never merges across its pre-tokens, so the pieces of a text
are the sum over its pre-tokens.  Pre-tokens here are the text's parts between
spaces that stand alone (each keeps its leading space; white space runs stay
inside a part); pieces are counted once for each distinct pre-token and task, joined
to the document's pre-token frequencies, and summed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens a task remembers; past it the table is begun anew, which costs time and changes no count.
TABLE_ENTRIES = 400_000
#: Characters of text handled at a time in a task.
SLICE_CHARS = 1_000_000


class PieceCounts:
    """Pieces of texts under a byte-level BPE file of the tokenizers library.

    Cutting before a space is exact where the space has no white space on at
    least one side, and so a text is cut at all its spaces if none has white space on
    both, else at those with none on either.  Special tokens' strings hold no space, so
    they stand whole within a pre-token, which the library handles.
    """

    def __init__(self, path: str, table_entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any(" " in t.content for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("a special token holds a space")
        self.near = re.compile(r" \s")
        self.inside = re.compile(r"\s \s")
        self.alone = re.compile(r"(?<!\s) (?!\s)")
        self.table_entries = table_entries
        self.table: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str]:
        """The text's pre-tokens, but for the space that all after the first begin with."""
        if self.near.search(text) and self.inside.search(text):
            return self.alone.split(text)
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        first, frequencies = [], {}
        for i, text in enumerate(texts):
            if not text:
                continue
            head, *rest = self.split(text)
            first.append((i, head))
            frequencies[i] = Counter(rest)
        new = set().union(*frequencies.values()).difference(self.table)
        if len(self.table) + len(new) > self.table_entries:
            self.table = {}
            new = set().union(*frequencies.values())
        new = list(new)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.table.update(zip(part, self.whole([" " + x for x in part]), strict=True))
        for i, n in zip([i for i, _ in first], self.whole([x for _, x in first]), strict=True):
            out[i] = n
        table = self.table
        for i, frequency in frequencies.items():
            out[i] += sum(table[x] * n for x, n in frequency.items())
        return out


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``chars`` characters each."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for each row of ``docs``.

    Null texts count as empty (0 tokens).  Null and repeated keys are kept,
    one row each; other columns are not read; an empty table gives no row.  Whole texts
    of any length are counted; a task holds one slice of texts and its bounded piece table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = PieceCounts(tokenizer_path)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for at in range(0, len(column), 256):
                texts = [x or "" for x in column.slice(at, 256).to_pylist()]
                got = [n for a, b in slices(texts) for n in pieces.counts(texts[a:b])]
                yield pa.record_batch([keys.slice(at, 256), pa.array(got, pa.int64())], names=["key", "n_tokens"])

    key_type = docs.schema[key].dataType.simpleString()
    sizes = docs.select(F.struct(F.col(key).alias("k"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("b")).alias("key"), F.col(text).alias("text"))
    counted = sizes.mapInArrow(run, f"key struct<k:{key_type},b:bigint>, n_tokens bigint")
    return counted.select(
        F.col("key.k").alias(key),
        F.col("key.b").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > F.lit(limit)).alias("over_limit"),
    )
