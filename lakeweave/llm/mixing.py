"""Mixing domains to target weights with soft membership, in DataFrame functions only.

A Bernoulli naive Bayes classifier, fitted on a labelled table, gives every
document a posterior over the domains from the presence of each word of the learned
vocabulary.  Nonnegative document rates are then fitted by projected gradient steps
of a least squares problem: the expected token total of each domain, the sum of
tokens x posterior x rate, is to match its target.

Texts are read once for their posteriors: their distinct words meet the vocabulary,
a broadcast table of bounded size, and the words' weights are summed up by document
where the text stands.  The steps run over posteriors and token counts, written
once.  The driver keeps one number a domain and step; rates are refolded from these.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.bottomk import let, words
from lakeweave.llm.common import materialise

#: Labelled documents that are fitted at most, chosen by a hash of their id.
MAX_LABELLED = 4_000
#: A word of the vocabulary is in so many labelled documents, or in one of so many of few.
MIN_SEEN, SEEN_IN = 5, 50
#: Words times domains of the vocabulary at most, the words that tell most first: 8 bytes each are broadcast.
MAX_CELLS = 1 << 19
STEPS = 30
#: Residuals at which the steps end, and beyond which a warning says so; shares of the token total.
TOLERANCE, MISSED = 1e-6, 0.01
#: Posteriors below this leave the steps' scaling, not their residuals.
LEAST = 1e-3


def labelled_sample(docs: DataFrame, labelled: DataFrame, domain: str, key: str, text: str, most: int) -> DataFrame:
    """``(id, domain, word list)`` of up to ``most`` documents that the labelled table names; of
    rows that repeat an id the least by domain and text's hash."""
    ids = labelled.select(F.col(key).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(key).alias("id"), F.col(domain).cast("string").alias("domain"), F.col(text).alias("text")).where("domain is not null")
    rows = rows.join(F.broadcast(ids), "id")  # ids: ``most`` rows
    rows = rows.groupBy("id").agg(F.min(F.struct("domain", F.xxhash64("text").alias("hash"), "text")).alias("r"))
    return rows.select("id", "r.domain", F.array_distinct(words(F.col("r.text"))).alias("words"))


def fit_classifier(sample: DataFrame, min_seen: int = MIN_SEEN, seen_in: int = SEEN_IN, max_cells: int = MAX_CELLS) -> dict:
    """Domains (as many as the sample has), ``base``, their logits without any word, and ``words``, a
    table of the vocabulary's hashes and what a word's presence adds to each domain's logit."""
    sample = materialise(sample, "labelled")
    sizes = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}  # bounded by the sample's rows
    domains = sorted(sizes)
    if not domains:
        return {"domains": [], "base": [], "words": None}
    total = sum(sizes.values())
    counted = sample.select("domain", F.explode("words").alias("word")).groupBy(F.xxhash64("word").alias("hash")).agg(*[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    n = {d: F.col(f"n{k}") for k, d in enumerate(domains)}
    seen = sum(n.values(), F.lit(0))
    tells = sum((n[d] * F.log((n[d] + 1) * (total + 2) / ((seen + 1) * (sizes[d] + 2))) for d in domains), F.lit(0.0))
    counted = counted.where(seen >= min(min_seen, -(-total // seen_in))).withColumn("tells", tells)
    counted = counted.orderBy(F.desc(F.round("tells", 6)), "hash").limit(max(1, max_cells // len(domains)))
    vocabulary = materialise(counted.select("hash", *[F.log((n[d] + 1) / (sizes[d] + 1 - n[d])).alias(f"w{k}") for k, d in enumerate(domains)], *[F.log((sizes[d] + 1 - n[d]) / F.lit(sizes[d] + 2.0)).alias(f"a{k}") for k, d in enumerate(domains)]), "vocabulary")
    absent = vocabulary.agg(*[F.sum(f"a{k}") for k in range(len(domains))]).first()
    base = [float(np.log(sizes[d] / total) + (a or 0.0)) for d, a in zip(domains, absent, strict=True)]
    return {"domains": domains, "base": base, "words": vocabulary.drop(*[f"a{k}" for k in range(len(domains))])}


def posteriors(docs: DataFrame, model: dict, text: str, key: str) -> DataFrame:
    """``(key, _hash, _tokens, _p)`` of each row: a hash of its text, its words, and P(domain | text)."""
    n = len(model["domains"])
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.monotonically_increasing_id().alias("_row"), words(F.col(f"`{text}`")).alias("_w"))
    each = rows.select("_key", "_hash", "_row", F.size("_w").cast("long").alias("_tokens"), F.explode_outer(F.array_distinct("_w")).alias("_x"))
    each = each.withColumn("hash", F.xxhash64("_x")).drop("_x").join(F.broadcast(model["words"]), "hash", "left")
    sums = each.groupBy("_row", "_key", "_hash", "_tokens").agg(*[F.sum(f"w{k}").alias(f"s{k}") for k in range(n)])
    logits = F.array(*[F.coalesce(F.round(f"s{k}", 9), F.lit(0.0)) + F.lit(b) for k, b in enumerate(model["base"])])
    share = let(logits, lambda z: let(F.array_max(z), lambda top: let(F.transform(z, lambda v: F.exp(v - top)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total)))))
    return sums.select(F.col("_key").alias(key), "_hash", "_tokens", share.alias("_p"))


def fit_rates(cells: DataFrame, model: dict, weights: dict[str, float] | None, budget: float | None, steps: int = STEPS) -> tuple[list[list[float]], dict]:
    """The steps over domains, and a report of totals.

    ``cells(_p, _tokens)``: documents' posteriors and tokens.  The gradient of the squared
    residuals goes through a document's posterior; a step takes r to max(0, r - posterior .
    step), the step being the residuals scaled by the inverse of the domains' Gram matrix over
    the documents with a positive rate, halved while it would not make the residuals smaller.
    """
    domains = model["domains"]
    history: list[list[float]] = []

    def rated(steps: list[list[float]]) -> DataFrame:
        return cells.select("_p", "_tokens", folded(F.col("_p"), steps).alias("_rate"))

    def totals(steps: list[list[float]]) -> np.ndarray:
        got = rated(steps).agg(*[F.sum(F.col("_tokens") * F.get("_p", F.lit(k)) * F.col("_rate")).alias(f"t{k}") for k in range(len(domains))]).first()
        return np.array([float(v or 0) for v in got])

    def gram() -> np.ndarray:
        entry = F.filter(F.transform("_p", lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda e: e["v"] >= LEAST)
        pairs = rated(history).where("_rate > 0").select("_tokens", entry.alias("e")).select("_tokens", "e", F.explode("e").alias("a")).select("_tokens", "a", F.explode("e").alias("b"))
        out = np.zeros((len(domains), len(domains)))
        for i, j, v in pairs.groupBy("a.k", F.col("b.k").alias("j")).agg(F.sum(F.col("_tokens") * F.col("a.v") * F.col("b.v"))).collect():  # a number a pair of domains
            out[i, j] = v
        return out

    mass = now = totals([])
    if not mass.sum():
        return [], {"mass": mass.tolist(), "target": mass.tolist(), "reached": mass.tolist()}
    weights = weights or {d: 1.0 for d in domains}
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    if not share.sum():
        raise ValueError("no target weight for any domain")
    share /= share.sum()
    # by default as many tokens as it takes for the domain with most of them to keep its own
    total = budget if budget is not None else max(m / s for m, s in zip(mass, share, strict=True) if s > 0)
    target = total * share
    while len(history) < steps and np.abs(now - target).max() > TOLERANCE * total:
        h = gram()
        step = np.linalg.lstsq(h + np.diag(1e-9 * mass), now - target, rcond=1e-12)[0]
        for _ in range(6):
            reached = totals([*history, step.tolist()])
            if np.abs(reached - target).sum() < np.abs(now - target).sum():
                break
            step = step / 2
        else:
            break
        history.append(step.tolist())
        now = reached
    if np.abs(now - target).max() > MISSED * total:
        warnings.warn(f"the mixture misses its targets: {dict(zip(domains, (now / total).round(4).tolist(), strict=True))}", stacklevel=2)
    return history, {"mass": mass.tolist(), "target": target.tolist(), "reached": now.tolist()}


def folded(p: Column, history: list[list[float]]) -> Column:
    """The rate of a posterior after the steps, from 1."""
    rate = F.lit(1.0)
    for h in history:
        step = let(F.array(*[F.lit(float(v)) for v in h]), lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))
        rate = F.greatest(F.lit(0.0), rate - step)
    return rate


def kept_domains(model: dict, weights: dict[str, float] | None, budget: float | None) -> list[str]:
    """Domains whose documents all stay: by default those with a weight, under a budget none."""
    return [d for d in model["domains"] if budget is None and (not weights or weights.get(d, 0.0) > 0)]


def with_mix(df: DataFrame, model: dict, history: list[list[float]], key: str, keep: list[str]) -> DataFrame:
    """``domain, tokens, rate, copies`` in place of ``_p, _tokens``; documents of the domains in ``keep`` have a copy at least."""
    place = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col("_hash"), F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    rated = df.withColumns({"domain": F.element_at(F.array(*[F.lit(d) for d in model["domains"]]), best), "rate": folded(F.col("_p"), history), "tokens": F.col("_tokens")})
    copies = F.greatest(F.floor(F.col("rate") + place).cast("int"), F.col("domain").isin(keep).cast("int"))
    return rated.select(key, "_hash", "domain", "tokens", "rate", copies.alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, budget: float | None = None, text: str = "text", key: str = "doc_id", most: int = MAX_LABELLED) -> tuple[DataFrame, dict]:
    """``(rates, report)``: ``key, _hash, domain, tokens, rate, copies`` of each row, ``_hash`` being its
    text's xxhash64, and the domains with their token totals before, as targeted and as reached.

    ``weights`` are target shares of the token total by domain (equal by default; a domain
    without a weight gets none), ``budget`` the total.  There may be any number of domains; each is
    a column of one aggregate.  Tokens are words.  ``copies`` is the rate rounded up or down by a
    hash of key and text, so that its mean is the rate; without a budget no document of a domain
    with a weight goes, though its rate may fall a little under 1.  Of domains that are equally
    probable the first counts.  Null and empty texts have no tokens, and the posterior of a
    text without a word of the vocabulary.  Null and repeated keys are kept, a row each.
    Without a labelled document every rate is 1 and the domain null; an empty table gives none.
    Targets that can't be met within ``MISSED`` give a warning.
    """
    model = fit_classifier(labelled_sample(docs, labelled, domain, key, text, most))
    if not model["domains"]:
        n = F.size(words(F.col(f"`{text}`"))).cast("long")
        rates = docs.select(F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.lit(None).cast("string").alias("domain"), n.alias("tokens"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
        return rates, {"domains": [], "mass": [], "target": [], "reached": []}
    rows = materialise(posteriors(docs, model, text, key), "posteriors")
    history, report = fit_rates(rows, model, weights, budget)
    return with_mix(rows, model, history, key, kept_domains(model, weights, budget)), {"domains": model["domains"], **report}


def document_rates(docs: DataFrame, labelled: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, budget: float | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, domain, tokens, rate, copies`` of each document; see ``mixed``."""
    return mixed(docs, labelled, domain, weights, budget, text, key)[0].drop("_hash")


def mixed_documents(docs: DataFrame, labelled: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, budget: float | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say: rates are joined by key and text's
    hash, of which rows that agree in both have one; see ``mixed``."""
    rates, _ = mixed(docs, labelled, domain, weights, budget, text, key)
    copies = rates.select(F.col(key).alias("_key"), F.col("_hash").alias("_h"), "copies").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.col(f"`{key}`").alias("_own"))
    counted = packed.join(copies, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_h"))).where("copies > 0").select("_row", "copies")
    return counted.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_row.*")
