"""Training and applying the join classifier on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.features import FEATURES


def split(samples: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of each label, by a seeded hash of the pair: stable under retries."""
    place = F.pmod(F.xxhash64("table1", "column1", "table2", "column2", F.lit(seed)), F.lit(1000))
    return samples.where(place < share * 1000), samples.where(place >= share * 1000)


def overlap_weight(x: Column, mean: float, spread: float) -> Column:
    """1 + 3 r**8 with r the containment's standard score clipped to 3, mapped to 0..1: high overlaps weigh more."""
    z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (x - mean) / (spread or 1.0)))
    return 1 + 3 * F.pow((z + 3) / 6, F.lit(8.0))


def weighted(train: DataFrame) -> DataFrame:
    """Adds ``weight``: negatives over positives on positives, times the overlap weight on all."""
    row = train.agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos"), F.avg("max_containment").alias("m"), F.coalesce(F.stddev_pop("max_containment"), F.lit(0.0)).alias("s")).first()
    positive = F.when(F.col("label") == 1, F.lit(row["neg"] / max(row["pos"], 1))).otherwise(F.lit(1.0))
    return train.withColumn("weight", positive * overlap_weight(F.col("max_containment"), row["m"] or 0.0, row["s"]))


class JoinClassifier:
    """A scaled feature vector and a weighted classifier; scores 0 without a model or for empty tables."""

    def __init__(self, kind: str = "logistic", model: PipelineModel | None = None):
        self.kind, self.model = kind, model

    def fit(self, samples: DataFrame) -> "JoinClassifier":
        train = weighted(samples.withColumn("label", F.col("label").cast("double")))
        stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
        common = {"featuresCol": "_x", "labelCol": "label", "weightCol": "weight", "predictionCol": "_prediction"}
        stages.append(GBTClassifier(**common, maxIter=30, seed=42) if self.kind == "trees" else LogisticRegression(**common, regParam=1e-3, probabilityCol="_p", rawPredictionCol="_rp"))
        if self.kind == "trees":
            stages[-1].setProbabilityCol("_p").setRawPredictionCol("_rp")
        self.model = Pipeline(stages=stages).fit(train)
        return self

    def score(self, features: DataFrame) -> DataFrame:
        if self.model is None:
            return features.withColumn("prob", F.lit(0.0))
        out = self.model.transform(features)
        prob = vector_to_array("_p")[1]
        usable = F.lit(True)
        if "n_rows1" in features.columns:
            usable = (F.col("n_rows1") > 0) & (F.col("n_rows2") > 0)
        return out.withColumn("prob", F.when(usable, prob).otherwise(F.lit(0.0))).drop("_raw", "_x", "_rp", "_p", "_prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, kind: str = "logistic") -> "JoinClassifier":
        return cls(kind, PipelineModel.load(path))


def cross_scored(samples: DataFrame, folds: int = 4, kind: str = "logistic", seed: int = 42) -> DataFrame:
    """Adds ``prob``, each row scored by a model fitted on the other folds, which a seeded hash of the pair
    makes; of metrics over it none is a training score."""
    place = F.pmod(F.xxhash64("table1", "column1", "table2", "column2", F.lit(seed)), F.lit(folds))
    out = None
    for k in range(folds):
        part = JoinClassifier(kind).fit(samples.where(place != k)).score(samples.where(place == k))
        out = part if out is None else out.unionByName(part)
    return out


def best_f1_model(train: DataFrame, valid: DataFrame, kinds: tuple[str, ...] = ("logistic", "trees")) -> tuple[JoinClassifier, str, float]:
    """Fits each kind and keeps the one with the best F1 on the validation rows: model, kind, F1; ties by order."""
    best = None
    for kind in kinds:
        model = JoinClassifier(kind).fit(train)
        f1 = evaluate(model.score(valid)).first()["f1"]
        if best is None or f1 > best[2]:
            best = (model, kind, f1)
    return best


class DualClassifier:
    """One model for N:1 and one for 1:1 pairs (``join_type``)."""

    def __init__(self, many: JoinClassifier, one: JoinClassifier):
        self.models = {"N:1": many, "1:1": one}

    def score(self, features: DataFrame) -> DataFrame:
        out = None
        for kind, model in self.models.items():
            part = model.score(features.where(F.col("join_type") == kind))
            out = part if out is None else out.unionByName(part)
        return out


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: ``tp, fp, fn, precision, recall, f1`` at a threshold."""
    hit = F.col("prob") >= threshold
    row = scored.agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    row = row.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    return row.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
