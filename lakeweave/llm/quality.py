"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time, fitted cyclically to the log-loss
gradient, add up to one lookup table a feature; then shallow trees on two
features fit what is left, for the pairs with the largest gain.  A score is the
logistic of the sum of a document's table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import small_batches

#: Labelled rows that are fitted at most, chosen by a hash of their id.
MAX_LABELLED = 20_000
FEATURES = (
    "log_words", "word_length", "unique_words", "repeated_neighbours", "top_line_share", "unique_lines", "line_length", "upper", "digits",
    "exclamation", "pipes", "symbols", "stops", "commas", "other_punctuation", "non_ascii", "short_words", "long_words", "spaces",
)


def features(text: str | None) -> list[float]:
    """Features of a whole text; zeros for an empty one."""
    if not text or not (words := text.split()):
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = len(data), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, w)

    def share(chars: str) -> float:
        return float(counts[list(chars.encode())].sum()) / w

    letters = counts[65:91].sum() + counts[97:123].sum()
    return [
        float(np.log1p(w)),
        float(lengths.mean()),
        len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w,
        max(map(len, lines)) / len(text),
        len(set(lines)) / len(lines),
        float(np.log1p(len(text) / len(lines))),
        float(counts[65:91].sum() / max(1, letters)),
        float(counts[48:58].sum()) / w,
        share("!"),
        share("|"),
        share("#$%&*+=<>@^_~\\/{}[]"),
        share(".?"),
        share(","),
        share("\"'();:-`"),
        float(counts[128:].sum()) / n,
        float((lengths <= 2).mean()),
        float((lengths >= 14).mean()),
        float(counts[[9, 10, 13, 32]].sum()) / n,
    ]


@dataclass
class Additive:
    """Lookup tables: one over each feature's bins, and one over the coarse bins of each chosen pair."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equally many values, midway between neighbouring values."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="midpoint"))


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3, least: int = 8) -> np.ndarray:
    """Values by bin of a tree with up to ``leaves`` leaves on one feature's gradient histogram."""
    spans, G, H, N = [(0, len(g))], np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h)), np.append(0, np.cumsum(n))
    while len(spans) < leaves:
        best = (1e-6, None, None)
        for span in spans:
            a, b = span
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gains = gain(G[at] - G[a], H[at] - H[a]) + gain(G[b] - G[at], H[b] - H[at]) - gain(G[b] - G[a], H[b] - H[a])
            gains[(N[at] - N[a] < least) | (N[b] - N[at] < least)] = 0
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (gains[k], span, int(at[k]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = leaf(G[b] - G[a], H[b] - H[a])
    return out


def quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int = 8) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain, and its values by cell."""
    sums = []
    for x in (g, h, n):
        c = np.cumsum(np.cumsum(x, 0), 1)
        low = c[:-1, :-1]
        sums.append((low, c[:-1, -1:] - low, c[-1:, :-1] - low, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + low))
    if not sums[0][0].size:
        return 0.0, np.zeros_like(g)
    gains = sum(gain(a, b) for a, b in zip(sums[0], sums[1], strict=True)) - gain(g.sum(), h.sum())
    gains[(np.minimum.reduce(sums[2]) < least)] = 0
    i, j = np.unravel_index(np.argmax(gains), gains.shape)
    out, values = np.zeros_like(g), [leaf(a[i, j], b[i, j]) for a, b in zip(sums[0], sums[1], strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, inner: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, patience: int = 20) -> Additive:
    """Fits on the rows that are not ``inner``; those tell when to stop."""
    model = Additive([quantile_cuts(x[:, f], bins) for f in range(x.shape[1])], [quantile_cuts(x[:, f], coarse) for f in range(x.shape[1])])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(y):
        return model
    if inner.all() or not inner.any():
        inner = np.zeros(len(y), bool)
    train = ~inner
    mean = np.clip(y[train].mean(), 0.01, 0.99)
    model.intercept = float(np.log(mean / (1 - mean)))
    fine = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.coarse)]
    total = np.full(len(y), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return (y - p) * train, p * (1 - p) * train

    def loss() -> float:
        rows = inner if inner.any() else train
        return float(np.logaddexp(0, np.where(y[rows] > 0, -total[rows], total[rows])).mean())

    def cycle(tables: list[np.ndarray], step, rounds: int) -> None:
        """Cycles over the tables until the inner rows' loss no longer falls, then takes the best."""
        nonlocal total
        best, kept, kept_total, since = loss(), [t.copy() for t in tables], total.copy(), 0
        for _ in range(rounds):
            for k, table in enumerate(tables):
                own, cell = step(k, *gradient())
                table += rate * own
                total = total + rate * own.ravel()[cell]
            since += 1
            if (now := loss()) < best - 1e-5:
                best, kept, kept_total, since = now, [t.copy() for t in tables], total.copy(), 0
            elif since >= patience:
                break
        for table, good in zip(tables, kept, strict=True):
            table[:] = good
        total = kept_total

    def hist(cell: np.ndarray, size: int, *weights: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(cell, v, size) for v in weights]

    def single(f: int, g: np.ndarray, h: np.ndarray):
        return shallow_tree(*hist(fine[f], len(model.tables[f]), g, h, train.astype(float))), fine[f]

    cycle(model.tables, single, rounds)
    shape = [len(c) + 1 for c in model.coarse]
    cells = {(i, j): rough[i] * shape[j] + rough[j] for i in range(x.shape[1]) for j in range(i)}

    def double(pair: tuple[int, int], g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        size = (shape[pair[0]], shape[pair[1]])
        return quadrants(*[v.reshape(size) for v in hist(cells[pair], size[0] * size[1], g, h, train.astype(float))])

    g, h = gradient()
    ranked = sorted(((double(pair, g, h)[0], pair) for pair in cells), key=lambda v: (-v[0], v[1]))
    chosen = [pair for value, pair in ranked[:pairs] if value > 0]
    tables = [np.zeros((shape[i], shape[j])) for i, j in chosen]
    cycle(tables, lambda k, g, h: (double(chosen[k], g, h)[1], cells[chosen[k]]), pair_rounds)
    model.pairs = [(i, j, table) for (i, j), table in zip(chosen, tables, strict=True)]
    return model


def fold(key: str) -> "F.Column":
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def labelled_sample(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """Up to ``most`` labelled rows outside the held-out fold, by the hash of their id."""
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), fold(key).alias("fold"))
    rows = rows.where("key is not null and label is not null and fold <> 0").groupBy("key", "fold").agg(F.round(F.avg("label")).alias("label"))
    return rows.orderBy(F.xxhash64("key"), "key").limit(most)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = MAX_LABELLED) -> Additive:
    """Fits the model; only ``most`` labelled rows' features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                got = [features(x) for x in some.column(3).to_pylist()]
                yield pa.record_batch([*some.columns[:3], pa.array(got, pa.list_(pa.float64()))], names=["hash", "fold", "label", "x"])

    chosen = F.broadcast(labelled_sample(labels, key, label, most))  # at most ``most`` rows of an id and two numbers
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    rows = rows.select(F.xxhash64("key", "text").alias("hash"), "fold", "label", "text").mapInArrow(run, "hash long, fold long, label double, x array<double>")
    with small_batches(docs.sparkSession):
        got = rows.orderBy("hash", "x").limit(most).collect()  # more only where rows repeat an id
    got.sort(key=lambda r: (r["fold"], r["label"], r["x"]))
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    y, folds = np.array([r["label"] for r in got], float), np.array([r["fold"] for r in got], int)
    return fit(x, y, folds == 1)


def score_quality(docs: DataFrame, model: Additive, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, score)`` for each row; null texts score as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                x = np.array([features(t) for t in some.column(1).to_pylist()]).reshape(some.num_rows, len(FEATURES))
                yield pa.record_batch([some.column(0), pa.array(model.score(x))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """``(key, held_out, score, predicted)`` for each row of ``docs``.

    Null and empty texts score as any text whose features are 0; texts of any length are
    read whole; repeated rows score alike, each for itself; other columns are not read; an empty
    table gives no row.  Rows whose crc32 of the key as text leaves 0 when divided by 5 are held out of
    the fit.  Without a labelled row every score is 0.5.  Null keys are kept and
    never fitted; a key labelled more than once has its rounded mean label.
    """
    model = train(docs, labels, text, key, label, most)
    scored = score_quality(docs, model, text, key)
    return scored.select(key, (fold(key) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
