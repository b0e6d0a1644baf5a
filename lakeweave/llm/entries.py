"""Queries of the corpus operators over the whole tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target shares of the token total in the queries' mixture.
MIXTURE = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.mixing import document_rates

    return document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weights=MIXTURE)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.decontam import leaked_documents

    return leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), end_id=2)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.html_text import page_text

    return page_text(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.bottomk import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeweave.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_mixing, op3_warc, op4_decontamination, op5_simhash, op6_token_output, op7_html_text, op8_licenses, op9_fingerprints, op10_token_counts)
}


def digit(place: str) -> str:
    return f"(instr('0123456789abcdef', substr(h, {place}, 1)) - 1)"


#: Five hex digits of the SHA-1 are four of base 32.
_GROUP = " + ".join(f"{digit(f'5 * g + {k + 1}')} * {16 ** (4 - k)}" for k in range(5))
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // {32**k}) % 32 + 1, 1)" for k in (3, 2, 1, 0))

ORACLE_SQL: dict[str, str] = {
    "op3_warc": f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT page_id, g, {_GROUP} AS v FROM p CROSS JOIN range(8) r(g)),
d AS (SELECT page_id, string_agg({_LETTERS}, '' ORDER BY g) AS payload_digest FROM g GROUP BY page_id)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = min(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS refers_to FROM p JOIN d USING (page_id)"""
}
