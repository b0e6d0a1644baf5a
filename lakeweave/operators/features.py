"""The feature vector of column pairs, as one DataFrame of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.names import jaccard, match_ratio, name_tokens, sorted_tokens
from lakeweave.functions.values import finite, ratio
from lakeweave.operators.overlap import containment, earth_mover, range_overlap, shared_values
from lakeweave.operators.similarity import Encoder, HashedTrigrams, cosine

#: The features in their fixed order.
FEATURES = (
    "token_sort_ratio", "edit_ratio",
    "content_similarity", "column_similarity", "table_similarity",
    "position1", "position2", "name_tokens1", "name_tokens2", "name_length1", "name_length2",
    "containment1", "containment2", "distinct_ratio1", "distinct_ratio2", "earth_mover", "range_overlap",
    "length_avg1", "length_avg2", "is_numeric1", "is_numeric2",
    "max_containment", "header_jaccard",
)


def candidate_pairs(profile: DataFrame, same_family: bool = False) -> DataFrame:
    """All column pairs of different tables, each once (``table1 < table2``).

    The frame is one row a column, so it depends on the lake's width, not its rows.
    """
    sides = [profile.select(*[F.col(c).alias(f"{c}{s}") for c in ("table", "column", "ordinal", "n_cols", "family", "n_rows", "n_nonnull", "n_distinct", "len_avg", "is_numeric", "num_min", "num_max", "n_numeric")]) for s in ("1", "2")]
    pairs = sides[0].join(sides[1], F.expr("table1 < table2 and n_rows1 > 0 and n_rows2 > 0"))
    return pairs.where("family1 = family2") if same_family else pairs


def name_features(pairs: DataFrame) -> DataFrame:
    """String likeness, on the distinct name pairs only."""
    names = pairs.select("column1", "column2").distinct()
    match = match_ratio()
    return names.select("column1", "column2", match(sorted_tokens(F.col("column1")), sorted_tokens(F.col("column2"))).alias("token_sort_ratio"), match(F.lower("column1"), F.lower("column2")).alias("edit_ratio"))


def header_features(profile: DataFrame) -> DataFrame:
    """``table1, table2, header_jaccard`` of all table pairs."""
    headers = profile.groupBy("table").agg(F.collect_set(F.lower("column")).alias("header"))
    a, b = (headers.select(*[F.col(c).alias(f"{c}{s}") for c in ("table", "header")]) for s in ("1", "2"))
    return a.join(b, F.expr("table1 < table2")).select("table1", "table2", jaccard(F.col("header1"), F.col("header2")).alias("header_jaccard"))


def name_frequency(columns: DataFrame) -> DataFrame:
    """Adds ``name_frequency``: how many columns of the lake have a column's name."""
    return columns.withColumn("name_frequency", F.count(F.lit(1)).over(Window.partitionBy("column")))


def pair_features(counts: DataFrame, profile: DataFrame, texts: DataFrame | None = None, encoder: Encoder | None = None, zero_content: bool = False, same_family: bool = False) -> DataFrame:
    """``table1, column1, table2, column2`` and ``FEATURES``; ``row_ratio`` and ``name_frequency`` besides.

    ``texts`` (``table, column, text``) are the column profiles for the content
    likeness; ``zero_content`` sets that to 0 as older models expect.  NaN, infinities
    and missing values are 0.
    """
    encoder = encoder or HashedTrigrams()
    keys = ["table1", "column1", "table2", "column2"]
    pairs = candidate_pairs(profile, same_family)
    held = containment(shared_values(counts), profile).select(*keys, "containment1", "containment2", "max_containment", "min_containment")
    # the index sorts a pair by name, as the candidates do
    pairs = pairs.join(held, keys, "left").join(name_features(pairs), ["column1", "column2"], "left").join(header_features(profile), ["table1", "table2"], "left")
    numeric = pairs.where("n_numeric1 > 0 and n_numeric2 > 0")
    pairs = pairs.join(earth_mover(counts, numeric), keys, "left").withColumnRenamed("emd", "earth_mover")
    pairs = range_overlap(pairs.withColumnsRenamed({"num_min1": "min1", "num_max1": "max1", "num_min2": "min2", "num_max2": "max2"}))
    content = encoder.encode(F.col("text")) if texts is not None else None
    encoded = profile.select("table", "column").withColumns({"_c": encoder.encode(F.concat_ws(".", "table", "column")), "_t": encoder.encode(F.col("table"))})
    if content is not None:
        encoded = encoded.join(texts.select("table", "column", content.alias("_x")), ["table", "column"], "left")
    for side in ("1", "2"):
        pairs = pairs.join(encoded.select(*[F.col(c).alias(f"{c}{side}") for c in encoded.columns]), [f"table{side}", f"column{side}"])
    alike = cosine(F.col("_x1"), F.col("_x2")) if content is not None and not zero_content else F.lit(0.0)
    frequency = name_frequency(profile).select("table", "column", "name_frequency")
    pairs = pairs.withColumns(
        {
            "content_similarity": alike,
            "column_similarity": cosine(F.col("_c1"), F.col("_c2")),
            "table_similarity": cosine(F.col("_t1"), F.col("_t2")),
            "row_ratio": ratio(F.col("n_rows1"), F.col("n_rows2")),
            **{f"position{s}": F.col(f"ordinal{s}") / F.col(f"n_cols{s}") for s in "12"},
            **{f"name_tokens{s}": F.size(name_tokens(F.col(f"column{s}"))).cast("double") for s in "12"},
            **{f"name_length{s}": F.length(f"column{s}").cast("double") for s in "12"},
            **{f"distinct_ratio{s}": ratio(F.col(f"n_distinct{s}"), F.col(f"n_rows{s}")) for s in "12"},
            **{f"length_avg{s}": F.col(f"len_avg{s}") for s in "12"},
            **{f"is_numeric{s}": F.col(f"is_numeric{s}").cast("double") for s in "12"},
        }
    )
    pairs = pairs.join(frequency.select(F.col("table").alias("table1"), F.col("column").alias("column1"), "name_frequency"), ["table1", "column1"])
    extra = ["min_containment", "row_ratio", "name_frequency", "n_rows1", "n_rows2", "family1", "family2"]
    return pairs.select(*keys, *[finite(F.col(c).cast("double")).alias(c) for c in FEATURES], *extra)


def fact_first(pairs: DataFrame, fact_rows: int = 1000) -> DataFrame:
    """Turns pairs so that the fact table, the one with ``fact_rows`` rows and more, is the first side;
    ``join_type`` is N:1 if exactly one side is a fact table, else 1:1."""
    one, two = F.col("n_rows1") >= fact_rows, F.col("n_rows2") >= fact_rows
    swap = two & ~one
    out = pairs.withColumn("join_type", F.when(one != two, "N:1").otherwise("1:1"))
    sided = [c[:-1] for c in out.columns if c.endswith("1") and c[:-1] + "2" in out.columns]
    turned = {}
    for c in sided:
        turned[c + "1"] = F.when(swap, F.col(c + "2")).otherwise(F.col(c + "1"))
        turned[c + "2"] = F.when(swap, F.col(c + "1")).otherwise(F.col(c + "2"))
    if "row_ratio" in out.columns:
        turned["row_ratio"] = ratio(F.greatest("n_rows1", "n_rows2"), F.least("n_rows1", "n_rows2"))
    return out.withColumns(turned)
