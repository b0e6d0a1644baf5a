"""A corpus pipeline of five stages, each over all that its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes the session, the documents
and the folder of the other tables.  All but the last return the columns of
``documents``; the last returns what reading the written token blocks gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import decontam, entries, mixing, quality, simhash, token_output
from lakeweave.llm.common import annotated, mark, materialise, release, remove, scratch

#: Documents that score less are rejected.
QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labelled ones, doesn't reject.

    Null and empty texts are scored as empty ones and texts of any length whole; repeated rows fare alike;
    null keys are scored and never fitted; a score of just ``QUALITY`` stays; an empty table gives an empty one.
    """
    import numpy as np

    labels = entries.table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)

    def make():
        return lambda texts: model.score(np.array([quality.features(t) for t in texts]).reshape(len(texts), len(quality.FEATURES)))

    scored = annotated(docs, "text", make, "double").where(F.col("value") >= QUALITY).select("row.*")
    return materialise(scored, "scored")  # executed here, in small Arrow batches


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each SimHash component; rows without an id stay.

    Rows that repeat an id are one document, which goes if one of them is in a component with
    a smaller id; of those that stay the row with the least hash is kept.  Null and empty texts are
    copies of one another; texts of any length are read whole; an empty table gives an empty one.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    groups = simhash.simhash_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("n")).where("least = doc_id")
    kept = docs.join(groups.where("n = 1"), "doc_id", "left_semi").select(columns)
    # partial aggregates, so that a hot id is no task's
    repeated = docs.join(groups.where("n > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return kept.unionByName(repeated.select("row.*")).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item is leaked; see ``decontam.find_leaks``.

    Null and empty texts and null keys stay; repeated rows fare alike; an empty table gives an empty one.
    """
    return decontam.decontaminated(docs, entries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of domains below their target weight, as the fitted rates say; see ``mixing.mixed``.

    No document of a domain with a weight goes, nor does one without words; rows that agree in id and text have
    equal copies; without a labelled document all have one; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs, entries.table(spark, sf_dir, "labels"), weights=entries.MIXTURE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token blocks and returns each document's place, length and checksum in them; see
    ``token_output.token_output`` for null, empty, long and repeated rows and an empty table."""
    return token_output.token_output(docs, entries.tokenizer_file(entries.WORD_BPE), end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_ids),
]

#: SQL has no expression for the classifier, SimHash, tiling or tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each result written as Parquet and read again."""
    docs, read = entries.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        if k < len(STAGES) - 1:
            path, since = scratch(spark, f"stage{k}"), mark()
            stage(spark, docs, sf_dir).write.parquet(path)
            release(spark, since)  # what the stage wrote for itself
            docs = spark.read.parquet(path)
        else:
            docs = stage(spark, docs, sf_dir)  # its blocks are written by now
        if read:
            remove(spark, read)
        read = path
    return docs
