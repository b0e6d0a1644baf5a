"""Linking requests to tables: texts, scores, selection rules and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators.similarity import Encoder, HashedTrigrams, cosine
from lakeweave.sources.shared import written

TEMPERATURE = 0.07


def flatten_samples(raw: DataFrame) -> DataFrame:
    """``project, query, query_related_table, table_relevance, column_relevance`` from ``project, samples``;
    samples without a query go, missing maps and lists are empty."""
    one = raw.select("project", F.explode("samples").alias("s")).where("s.query is not null")
    return one.select(
        "project",
        "s.query",
        F.coalesce("s.query_related_table", F.array().cast("array<string>")).alias("query_related_table"),
        F.coalesce("s.table_relevance", F.create_map().cast("map<string,int>")).alias("table_relevance"),
        F.coalesce("s.column_relevance", F.create_map().cast("map<string,map<string,int>>")).alias("column_relevance"),
    )


def label_violations(samples: DataFrame) -> DataFrame:
    """``project, query, table, violation``: a relevant table without a relevant column, a relevant column in an
    irrelevant table, or columns of a table that has no relevance."""
    tables = samples.select("project", "query", F.explode("table_relevance").alias("table", "relevant"))
    columns = samples.select("project", "query", F.explode("column_relevance").alias("table", "own"))
    columns = columns.select("project", "query", "table", F.coalesce(F.array_max(F.map_values("own")), F.lit(0)).alias("any"))
    both = tables.join(columns, ["project", "query", "table"], "full")
    kind = F.when(F.col("relevant").isNull(), "columns of an unlabelled table").when((F.col("relevant") == 1) & (F.coalesce("any", F.lit(0)) == 0), "relevant table without a relevant column").when((F.col("relevant") == 0) & (F.col("any") == 1), "relevant column in an irrelevant table")
    return both.select("project", "query", "table", kind.alias("violation")).where("violation is not null")


def candidate_text(query: Column, table: Column, columns: Column) -> Column:
    """query [TAB] table [COL] column ..., underscores as spaces."""
    names = F.array_join(F.transform(columns, lambda c: F.concat(F.lit(" [COL] "), c)), "")
    return F.replace(F.concat(query, F.lit(" [TAB] "), table, names), F.lit("_"), F.lit(" "))


def balanced(pairs: DataFrame, group: str = "query", label: str = "label", cap: int | None = None, seed: int = 42) -> DataFrame:
    """As many positives as negatives of each group, ``cap`` of each at most, by a seeded hash."""
    rest = [c for c in pairs.columns if c not in (group, label)]
    order = Window.partitionBy(group, label).orderBy(F.xxhash64(group, *rest, F.lit(seed)))
    counts = pairs.groupBy(group).agg(F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).alias("_k"))
    out = pairs.withColumn("_r", F.row_number().over(order)).join(counts, group)
    most = F.least("_k", F.lit(cap)) if cap is not None else F.col("_k")
    return out.where(F.col("_r") <= most).drop("_r", "_k")


def pair_score(pairs: DataFrame, encoder: Encoder | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """Adds ``cosine`` of ``query`` and ``text`` and ``prob``, its logistic value over the temperature."""
    encoder = encoder or HashedTrigrams()
    texts = pairs.select(F.col("query").alias("_s")).unionByName(pairs.select(F.col("text").alias("_s"))).distinct().withColumn("_v", encoder.encode(F.col("_s")))
    a, b = (texts.select(F.col("_s").alias(c), F.col("_v").alias(f"_{c}")) for c in ("query", "text"))
    scored = pairs.join(a, "query").join(b, "text").withColumn("cosine", cosine(F.col("_query"), F.col("_text")))
    return scored.withColumn("prob", 1 / (1 + F.exp(-F.col("cosine") / temperature))).drop("_query", "_text")


def calibrate(pairs: DataFrame, label: str = "label"):
    """A model of relevance on the cosine and the terms that query and text share, fitted on labelled pairs
    (``query, text, label``); returns a function that adds ``prob`` to pairs."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def features(df: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect(terms(F.col("query")), terms(F.col("text")))).cast("double")
        return pair_score(df).drop("prob").withColumn("shared_terms", shared)

    stages = [VectorAssembler(inputCols=["cosine", "shared_terms"], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", rawPredictionCol="_rp", predictionCol="_c", regParam=1e-3)]
    model = Pipeline(stages=stages).fit(written(features(pairs).withColumn("_y", F.col(label).cast("double")), "pairs"))
    return lambda df: model.transform(features(df)).withColumn("prob", vector_to_array("_p")[1]).drop("_x", "_p", "_rp", "_c")


def ranked(scores: DataFrame, group: str = "query", item: str = "table", score: str = "prob") -> DataFrame:
    """Adds ``rank`` within the group: score descending, ties by item."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), item)))


def above(scores: DataFrame, threshold: float, score: str = "prob") -> DataFrame:
    return scores.where(F.col(score) >= threshold)


def top_percent(scores: DataFrame, share: float = 0.5, group: str = "query", item: str = "table", score: str = "prob") -> DataFrame:
    """The first max(1, floor(n x share)) items of each group."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    rows = ranked(scores, group, item, score).withColumn("_n", n)
    return rows.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n")


def gain_prefix(scores: DataFrame, most: int = 20, ratio: float = 0.15, group: str = "query", item: str = "table", score: str = "prob") -> DataFrame:
    """The prefix of each ranking whose discounted gain, score / log2(rank + 1), is at least ``ratio`` of the first.

    The first item is always kept, ``most`` at most, and the first failure ends the
    prefix; where the first score isn't positive, the positive ones are kept (none).
    """
    order = Window.partitionBy(group).orderBy("rank")
    rows = ranked(scores, group, item, score).where(F.col("rank") <= most)
    rows = rows.withColumn("gain", F.col(score) / F.log2(F.col("rank") + 1))
    first = F.first("gain").over(order)
    fails = F.when(first <= 0, F.when(F.col(score) > 0, 0).otherwise(1)).when(F.col("rank") == 1, 0).when(F.col("gain") >= ratio * first, 0).otherwise(1)
    rows = rows.withColumn("_fails", fails)
    rows = rows.withColumn("_failed", F.max("_fails").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_failed = 0").drop("_fails", "_failed")


def threshold_sweep(scores: DataFrame, thresholds: list[float], group: str = "query", score: str = "prob", label: str = "label") -> DataFrame:
    """Mean precision, recall and F1 over groups at each threshold of a stated grid, in one pass."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    per = scores.select(group, score, label, grid.alias("threshold")).groupBy("threshold", group).agg(*confusion(F.col(score) >= F.col("threshold"), F.col(label) == 1))
    return prf(per).groupBy("threshold").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def confusion(chosen: Column, relevant: Column) -> list[Column]:
    return [F.count_if(chosen & relevant).alias("tp"), F.count_if(chosen & ~relevant).alias("fp"), F.count_if(~chosen & relevant).alias("fn")]


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 to ``tp, fp, fn``; 0 for divisions by 0."""
    zero = F.lit(0.0)
    out = counts.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def best_threshold(scores: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """One row: ``threshold, f1`` of the score that, as a threshold, gives the best F1 over all rows.

    Scores are aggregated first; running sums go by ranges of the score: sums of the
    ranges above, then running sums within a range, so no task takes all rows.
    """
    steps = scores.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = steps.withColumn("b", F.floor(F.col("s") * 1000))
    above_sums = steps.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    before = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    above_sums = above_sums.select("b", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("b").orderBy(F.desc("s"))
    total = steps.agg(F.sum("pos").alias("all"))
    run = steps.join(above_sums, "b").select("s", (F.col("p0") + F.sum("pos").over(inside)).alias("tp"), (F.col("n0") + F.sum("n").over(inside)).alias("chosen"))
    f1 = run.join(F.broadcast(total)).select("s", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("chosen") + F.col("all")), F.lit(0.0)).alias("f1"))
    return f1.agg(F.max_by(F.struct(F.col("s").alias("threshold"), "f1"), F.struct("f1", "s")).alias("best")).select("best.*")


def split_of(key: Column, shares: dict[str, float], seed: int = 42) -> Column:
    """The part a key belongs to, by a seeded hash: ``shares`` of the parts in order."""
    place, at, out = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000.0, 0.0, None
    for name, share in shares.items():
        at += share
        out = F.when(place < at, name) if out is None else out.when(place < at, name)
    return out.otherwise(list(shares)[-1])


def normalised_query(text: Column) -> Column:
    """Trimmed, lower case, white space runs as one space."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " +", " ")


def terms(text: Column, hints: list[str] = ()) -> Column:
    """Distinct identifiers of two characters and more, and the hint words that occur in the text."""
    low = F.lower(text)
    found = F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z_][a-z0-9_]+)"), F.lit(1)))
    if not hints:
        return found
    return F.array_union(found, F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(low, h)))


def join_labels(queries: DataFrame, labels: DataFrame, prefix: int = 100) -> tuple[DataFrame, DataFrame]:
    """Queries with their labels by normalised text, else by its first characters; and those without.

    Of labels with one key the last (``position``) counts.
    """
    rest = [c for c in labels.columns if c not in ("query", "position")]
    keyed = labels.withColumn("_k", normalised_query(F.col("query")))
    last = F.max_by(F.struct(*rest), F.col("position"))
    full = keyed.groupBy("_k").agg(last.alias("_full"))
    short = keyed.groupBy(F.left("_k", F.lit(prefix)).alias("_p")).agg(last.alias("_short"))
    q = queries.withColumn("_k", normalised_query(F.col("query"))).withColumn("_p", F.left("_k", F.lit(prefix)))
    joined = q.join(full, "_k", "left").join(short, "_p", "left").withColumn("_l", F.coalesce("_full", "_short"))
    return joined.where("_l is not null").select(*queries.columns, "_l.*"), joined.where("_l is null").select(*queries.columns)


def score_rows(details: DataFrame) -> DataFrame:
    """``query, table, prob`` from ``query, table_scores`` as a JSON text: a map, or a list of pairs."""
    as_map = F.from_json("table_scores", "map<string,double>")
    as_list = F.from_json("table_scores", "array<array<string>>")
    pairs = F.when(F.ltrim(F.col("table_scores")).startswith("{"), F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("table"), e["value"].alias("prob")))).otherwise(
        F.transform(as_list, lambda e: F.struct(e[0].alias("table"), e[1].try_cast("double").alias("prob")))
    )
    return details.select("query", F.explode(pairs).alias("s")).select("query", "s.*")
