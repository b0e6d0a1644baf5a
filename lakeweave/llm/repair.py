"""Re-Pair grammar compression of token ids.

A block is a run of documents.  Frequent pairs of neighbouring symbols are
replaced by nonterminals, again and again, until none is left; no rule spans the
end of a document, so each begins at a symbol of its own and can be decoded alone.

Block layout, little-endian: magic ``RPB1``, symbol bytes (2 or 4), number of
terminals, rules, documents and symbols (five u32); the rules' pairs; the rules'
expansion lengths (u32); each document's first symbol, plus the end (u32); the
symbols.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"RPB1"
SLOT_BITS = 20


def slots(keys: np.ndarray) -> np.ndarray:
    """Places of pairs in a hash table."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, end_id: int, terminals: int, min_count: int = 12) -> bytes:
    """``ids`` of whole documents, each ending in ``end_id``; ``ends``: index past each document's end token.

    A round counts the pairs and takes the frequent ones, the most frequent first, so
    that no symbol is the left of one pair and the right of another: the replaced
    occurrences then can't overlap.  Pairs of equal symbols are replaced from the left
    of a run.  Rounds go on until no pair occurs ``min_count`` times; symbols have four
    bytes where two don't hold them.

    A pair of old symbols never gains occurrences, so a place whose pair was rare is
    counted again only when a symbol of it is new.
    """
    seq = ids.astype(np.uint32)
    firsts = np.concatenate([[0], ends]).astype(np.int64)
    pairs, lengths = [], np.ones(terminals, np.uint32)
    live = np.ones(len(seq), bool)  # places whose pair may be frequent
    while len(seq) > 1:
        live[firsts[1:] - 1] = False  # no pair spans a document's end
        at = np.flatnonzero(live)
        left, right = seq[at], seq[at + 1]
        same = np.flatnonzero(left == right)
        if len(same):  # every other place of a run counts
            here, nth = at[same], np.arange(len(same))
            begin = np.concatenate([[True], here[1:] != here[:-1] + 1])
            odd = same[(nth - np.maximum.accumulate(np.where(begin, nth, 0))) % 2 == 1]
            between = at[odd]
            even = np.ones(len(at), bool)
            even[odd] = False
            even = np.flatnonzero(even)
            at, left, right = at.take(even), left.take(even), right.take(even)
        bits = (len(lengths) - 1).bit_length()
        kind = np.uint32 if bits <= 16 else np.uint64
        keys = left.astype(kind) << kind(bits) | right.astype(kind)
        ordered = np.sort(keys)
        cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
        counts = np.diff(np.append(cut, len(ordered)))
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        frequent = ordered[cut[often]]
        ranked = frequent[np.argsort(-counts[often], kind="stable")]
        lefts, rights, chosen = set(), set(), []
        for a, b in zip((ranked >> kind(bits)).tolist(), (ranked & kind((1 << bits) - 1)).tolist(), strict=True):
            if a not in rights and b not in lefts:
                lefts.add(a)
                rights.add(b)
                chosen.append((a, b))
        chosen = np.array(chosen, np.int64)
        # pairs are found by hash; those whose place another pair took, by search
        table = np.full(1 << SLOT_BITS, -1, np.int32)
        table[slots(frequent)] = np.arange(len(frequent))
        order = table.take(slots(keys))
        near = np.flatnonzero(order >= 0)
        order, at, keys = order.take(near), at.take(near), keys.take(near)
        other = np.flatnonzero(frequent.take(order) != keys)
        order[other] = np.minimum(np.searchsorted(frequent, keys[other]), len(frequent) - 1)
        found = np.ones(len(order), bool)
        found[other] = frequent[order[other]] == keys[other]
        found = np.flatnonzero(found)
        at, order = at.take(found), order.take(found)
        live[:] = False
        live[at] = True
        if len(same):  # these come to count when the run's first symbol goes
            live[between] = True
        rule = np.full(len(frequent), -1, np.int64)
        rule[np.searchsorted(frequent, chosen[:, 0].astype(kind) << kind(bits) | chosen[:, 1].astype(kind))] = np.arange(len(chosen)) + len(lengths)
        new = rule.take(order)
        taken = np.flatnonzero(new >= 0)
        where, new = at.take(taken), new.take(taken)
        seq[where] = new
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        firsts = firsts - np.searchsorted(where + 1, firsts)
        live[where] = True
        moved = where - np.arange(len(where))  # the new symbols' places
        stay = np.flatnonzero(stay)
        seq, live = seq.take(stay), live.take(stay)
        live[np.maximum(moved - 1, 0)] = True
        pairs.append(chosen)
        lengths = np.concatenate([lengths, lengths[chosen[:, 0]] + lengths[chosen[:, 1]]])
    wide = np.uint16 if len(lengths) <= 1 << 16 else np.uint32
    seq = seq.astype(wide)
    rules = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    head = np.array([np.dtype(wide).itemsize, terminals, len(rules), len(firsts) - 1, len(seq)], "<u4")
    return b"".join([MAGIC, head.tobytes(), rules.astype(wide).tobytes(), lengths[terminals:].astype("<u4").tobytes(), firsts.astype("<u4").tobytes(), seq.tobytes()])


class Block:
    """A compressed block; documents decode alone, from the rules' expansions."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        size, self.terminals, rules, docs, symbols = (int(x) for x in np.frombuffer(data, "<u4", 5, 4))
        kind, at = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[size], 24
        self.rules = np.frombuffer(data, kind, 2 * rules, at).reshape(-1, 2).astype(np.int64)
        at += 2 * rules * size
        lengths = np.frombuffer(data, "<u4", rules, at)
        at += 4 * rules
        self.firsts = np.frombuffer(data, "<u4", docs + 1, at).astype(np.int64)
        self.symbols = np.frombuffer(data, kind, symbols, at + 4 * (docs + 1))
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), lengths])
        begin = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        flat = self.rules.ravel()  # all rules' expansions, one after another, a level deeper each time
        while len(inner := np.flatnonzero(flat >= self.terminals)):
            times = np.ones(len(flat), np.int64)
            times[inner] = 2
            first = (np.cumsum(times) - times)[inner]
            pairs = self.rules[flat[inner] - self.terminals]
            flat = np.repeat(flat, times)
            flat[first], flat[first + 1] = pairs[:, 0], pairs[:, 1]
        #: every symbol's expansion is pool[offset : offset + length]
        self.pool = np.concatenate([np.arange(self.terminals), flat]).astype(np.uint32)
        self.offset = np.concatenate([np.arange(self.terminals), begin[:-1] + self.terminals]).astype(np.int64)

    def sizes(self) -> np.ndarray:
        """Tokens of each document, from the expansion lengths alone."""
        total = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        return np.diff(total[self.firsts])

    def decode(self, begin: int, end: int) -> np.ndarray:
        """Token ids (u32) of the documents from ``begin`` up to ``end``."""
        symbols = self.symbols[self.firsts[begin] : self.firsts[end]]
        n = self.lengths[symbols]
        stop = np.cumsum(n)
        if not len(stop):
            return np.empty(0, np.uint32)
        index = np.arange(int(stop[-1])) + np.repeat(self.offset[symbols] - (stop - n), n)
        return self.pool[index]
