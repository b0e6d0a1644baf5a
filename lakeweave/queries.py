"""The reference operators as queries over the driver's tables, each with its SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions import keys, names, staging
from lakeweave.operators import candidates, classify, evaluation, features, graph, history, judge, overlap, profile, rank, similarity
from lakeweave.plans.joinplan import JoinEdge, join_all, tree_edges
from lakeweave.plans.repair import RepairSession
from lakeweave.sources.catalog import VersionedCatalog, latest_versions, table_info
from lakeweave.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- value overlap ---------------------------------------------------------------------

OVERLAPS = {
    "orders_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "lineitem_part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "lineitem_supplier": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "events_customer": ("events", "user_id", "customer", "c_custkey"),
    "labels_documents": ("labels", "doc_id", "documents", "doc_id"),
}


def overlap_query(t1: str, c1: str, t2: str, c2: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(overlap.overlap_coefficient(table(spark, sf_dir, t1), c1, table(spark, sf_dir, t2), c2), "overlap")

    sql = f"""WITH a AS (SELECT DISTINCT {c1} AS v FROM {t1} WHERE {c1} IS NOT NULL), b AS (SELECT DISTINCT {c2} AS v FROM {t2} WHERE {c2} IS NOT NULL),
n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b ON a.v = b.v) AS shared)
SELECT n_a, n_b, shared, round(coalesce(shared::DOUBLE / nullif(least(n_a, n_b), 0), 0), 6) AS overlap FROM n"""
    return run, sql


for _name, _args in OVERLAPS.items():
    QUERIES[f"overlap_coefficient_{_name}"], ORACLE_SQL[f"overlap_coefficient_{_name}"] = overlap_query(*_args)

KEYS = (
    ("customer", "c_custkey"), ("customer", "c_nationkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"),
    ("orders", "o_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("region", "r_regionkey"), ("supplier", "s_nationkey"), ("supplier", "s_suppkey"),
)


def key_lake(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables with their key columns only."""
    return {t: table(spark, sf_dir, t).select(*[c for u, c in KEYS if u == t]) for t in dict.fromkeys(t for t, _ in KEYS)}


VALUES_SQL = "vals AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::BIGINT AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in KEYS) + "), n AS (SELECT t, c, count(*) AS n FROM vals GROUP BY t, c)"
MATRIX_SQL = f"""WITH {VALUES_SQL},
shared AS (SELECT a.t AS table1, a.c AS column1, b.t AS table2, b.c AS column2, count(*) AS shared FROM vals a JOIN vals b ON a.v = b.v AND a.t < b.t GROUP BY 1, 2, 3, 4),
matrix AS (SELECT s.*, x.n AS n1, y.n AS n2, round(shared / x.n::DOUBLE, 6) AS containment1, round(shared / y.n::DOUBLE, 6) AS containment2,
  round(greatest(shared / x.n::DOUBLE, shared / y.n::DOUBLE), 6) AS max_containment, round(least(shared / x.n::DOUBLE, shared / y.n::DOUBLE), 6) AS min_containment, round(shared / least(x.n, y.n)::DOUBLE, 6) AS overlap
  FROM shared s JOIN n x ON s.table1 = x.t AND s.column1 = x.c JOIN n y ON s.table2 = y.t AND s.column2 = y.c)"""


def counted(lake: dict[str, DataFrame]) -> DataFrame:
    """The lake's value counts, which all set features start from, written so that they are made once."""
    return written(profile.lake_counts(lake), "counts")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counted(key_lake(spark, sf_dir))
    found = overlap.containment(overlap.shared_values(counts), profile.profiles(counts, top=0))
    return rounded(found, "containment1", "containment2", "max_containment", "min_containment", "overlap")


@query(f"{MATRIX_SQL} SELECT * FROM matrix")
def containment_matrix_keys(spark, sf_dir):
    return matrix(spark, sf_dir)


SCORED_SQL = f"{MATRIX_SQL}, scored AS (SELECT table1, column1, table2, column2, round(max_containment * min_containment, 6) AS prob FROM matrix)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select(*candidates.PAIR, F.round(F.col("max_containment") * F.col("min_containment"), 6).alias("prob"))


@query(f"{SCORED_SQL} SELECT table1, column1, table2, column2, prob, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY table1, table2 ORDER BY prob DESC, column1, column2) AS rank FROM scored WHERE prob > 0) WHERE rank <= 2")
def topk_per_table_pair(spark, sf_dir):
    return candidates.top_per_table_pair(scored(spark, sf_dir), 2)


@query(f"{SCORED_SQL} SELECT table1, column1, table2, column2, prob FROM scored ORDER BY prob DESC, table1, column1, table2, column2 LIMIT 10")
def topk_overall(spark, sf_dir):
    return candidates.top_overall(scored(spark, sf_dir), 10)


@query(f"{SCORED_SQL} SELECT table1, column1, table2, column2, prob FROM scored WHERE table1 = 'customer' AND table2 = 'orders' ORDER BY prob DESC LIMIT 1")
def best_pair_customer_orders(spark, sf_dir):
    return candidates.best_pair(scored(spark, sf_dir), "orders", "customer")


@query(f"{SCORED_SQL} SELECT table1, column1, table2, column2, prob FROM scored WHERE table1 = 'customer' AND column1 = 'c_custkey' AND table2 = 'orders' AND column2 = 'o_custkey'")
def pair_probability(spark, sf_dir):
    return candidates.pair_probability(scored(spark, sf_dir), "orders.o_custkey ↔ customer.c_custkey")


@query(f"{SCORED_SQL} SELECT table1, column1, table2, column2, CASE WHEN prob > 0 THEN round(abs(ln(prob)), 6) ELSE 100.0 END AS weight FROM scored")
def edge_weights_neglog(spark, sf_dir):
    return scored(spark, sf_dir).select(*candidates.PAIR, F.round(candidates.edge_weight(F.col("prob")), 6).alias("weight"))


@query(f"{SCORED_SQL} SELECT least(table1, table2) AS u, greatest(table1, table2) AS v, round(min(abs(ln(prob))), 6) AS weight FROM scored WHERE prob > 0 GROUP BY 1, 2")
def min_edge_collapse(spark, sf_dir):
    return rounded(graph.collapse(scored(spark, sf_dir)), "weight")


@query(
    f"""{SCORED_SQL}, e AS (SELECT *, CASE WHEN prob > 0 THEN round(abs(ln(prob)), 6) ELSE 100.0 END AS weight FROM scored)
SELECT table1, column1, table2, column2, weight FROM (SELECT *, row_number() OVER (PARTITION BY table1, column1 ORDER BY weight, table2, column2) AS r FROM e) WHERE r = 1"""
)
def fk_once(spark, sf_dir):
    return graph.fk_once(edge_weights_neglog(spark, sf_dir))


@query()
def steiner_tree(spark, sf_dir):
    """The tree that joins region, lineitem and part over the collapsed candidate edges, solved per project."""
    edges = written(graph.collapse(scored(spark, sf_dir)), "edges")  # a row a table pair, used five times
    ids = graph.table_ids(edges)
    numbered = edges.join(ids.select(F.col("id").alias("a"), F.col("table").alias("u")), "u").join(ids.select(F.col("id").alias("b"), F.col("table").alias("v")), "v")
    numbered = numbered.select(F.lit("tpch").alias("project"), F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"), "weight")
    wanted = ids.where(F.col("table").isin("region", "lineitem", "part")).select(F.lit("tpch").alias("project"), F.col("id").cast("long").alias("node"))
    tree = graph.steiner_by_project(numbered, wanted)
    named = [ids.select(F.col("id").alias(i), F.col("table").alias(t)) for i, t in (("u", "table1"), ("v", "table2"))]
    return rounded(tree.join(named[0], "u").join(named[1], "v").select("project", "table1", "table2", "weight"), "weight")


@query()
def join_candidates_scored(spark, sf_dir):
    """All feature columns of the key columns' pairs, scored by the rule scorer, the best six a table pair."""
    counts = counted(key_lake(spark, sf_dir))
    prof = profile.profiles(counts, top=0)
    texts = profile.column_text(prof, profile.frequent_values(counts))
    feats = features.pair_features(counts, prof, texts)
    return rounded(candidates.top_per_table_pair(candidates.RuleScorer().score(feats)), "prob").select(*candidates.PAIR, "prob", "rank")


FOREIGN_KEYS = (
    ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)
FK_SQL = "fk(table1, column1, table2, column2) AS (VALUES " + ", ".join(str(k) for k in FOREIGN_KEYS) + ")"


def foreign_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOREIGN_KEYS, candidates.PAIR)


@query(
    f"""WITH RECURSIVE {FK_SQL}, e AS (SELECT table1 || '.' || column1 AS a, table2 || '.' || column2 AS b FROM fk UNION SELECT table2 || '.' || column2, table1 || '.' || column1 FROM fk),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT DISTINCT split_part(a, '.', 1) AS table1, split_part(a, '.', 2) AS column1, split_part(b, '.', 1) AS table2, split_part(b, '.', 2) AS column2, 1 AS label FROM r WHERE split_part(a, '.', 1) < split_part(b, '.', 1)"""
)
def transitive_labels(spark, sf_dir):
    return candidates.transitive_labels(foreign_keys(spark))


@query()
def join_classifier(spark, sf_dir):
    """Fits the classifier on the foreign keys and drawn negatives, and scores each pair by a model that was
    fitted without its fold: precision, recall, F1."""
    counts = counted(key_lake(spark, sf_dir))
    prof = profile.profiles(counts, top=0)
    feats = features.pair_features(counts, prof)
    good = foreign_keys(spark)
    swapped = good.select(F.col("table2").alias("table1"), F.col("column2").alias("column1"), F.col("table1").alias("table2"), F.col("column1").alias("column2"))
    labels = good.unionByName(swapped).where("table1 < table2").withColumn("label", F.lit(1))
    drawn = candidates.negative_pairs(prof, good)
    samples = feats.join(labels.unionByName(drawn.select(*candidates.PAIR, "label")), candidates.PAIR)
    samples = written(samples, "samples")  # a row a column pair
    return rounded(classify.evaluate(classify.cross_scored(samples)), "precision", "recall", "f1")


PATH_EDGES = ((0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0), (2, 3, 8.0), (3, 4, 3.0), (5, 6, 1.0))


@query(
    "WITH RECURSIVE e(u, v, w) AS (VALUES " + ", ".join(str(x) for x in PATH_EDGES) + """), b AS (SELECT u, v, w::DOUBLE AS w FROM e UNION ALL SELECT v, u, w::DOUBLE FROM e),
walk(node, dist, hops) AS (SELECT 0, 0.0::DOUBLE, 0 UNION ALL SELECT b.v, walk.dist + b.w, hops + 1 FROM walk JOIN b ON b.u = walk.node WHERE hops < 6)
SELECT node::INTEGER AS node, min(dist) AS dist FROM walk GROUP BY 1"""
)
def shortest_path_recursive(spark, sf_dir):
    spark.createDataFrame(PATH_EDGES, "u int, v int, weight double").createOrReplaceTempView("edges")
    return spark.sql(graph.shortest_paths_sql(0))


# --- profiles --------------------------------------------------------------------------

PROFILED = {
    "customer": (("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text")),
    "part": (("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "number"), ("p_retailprice", "number")),
    "supplier": (("s_suppkey", "number"), ("s_name", "text"), ("s_nationkey", "number"), ("s_acctbal", "number")),
    "nation": (("n_nationkey", "number"), ("n_name", "text"), ("n_regionkey", "number")),
}


def profile_sql(t: str, c: str, i: int, n: int, kind: str) -> str:
    text = f"regexp_replace({c}::VARCHAR, '\\.0$', '')" if kind == "number" else c
    number = f"{c}::DOUBLE" if kind == "number" else f"try_cast({c} AS DOUBLE)"
    return f"""SELECT '{t}' AS "table", '{c}' AS "column", {i} AS ordinal, {n} AS n_cols, '{kind}' AS family, count(*) AS n_rows, count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_distinct, round(avg(length({text})), 6) AS len_avg,
min(length({text}))::INTEGER AS len_min, max(length({text}))::INTEGER AS len_max, min({number}) AS num_min, max({number}) AS num_max, {str(kind == "number").lower()} AS is_numeric FROM {t}"""


@query(" UNION ALL ".join(profile_sql(t, c, i, len(cs), kind) for t, cs in PROFILED.items() for i, (c, kind) in enumerate(cs)))
def column_profile(spark, sf_dir):
    found = profile.profile_lake({t: table(spark, sf_dir, t) for t in PROFILED}, top=0)
    return rounded(found, "len_avg").drop("n_numeric")


@query(
    """WITH c AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS freq FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY freq DESC, value) AS r FROM c),
u AS (SELECT *, sum(length(value) + 1) OVER (PARTITION BY "column" ORDER BY r) - 1 AS used FROM r)
SELECT 'part' AS "table", "column", r::INTEGER AS r, value, freq, used::BIGINT AS used FROM u WHERE used <= 512"""
)
def frequent_values_budget(spark, sf_dir):
    lake = {"part": table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name")}
    return profile.frequent_values(profile.value_counts(profile.lake_values(lake)), 512, lambda v: F.length(v))


RANGES = (("orders", "o_totalprice"), ("lineitem", "l_extendedprice"), ("customer", "c_acctbal"), ("supplier", "s_acctbal"), ("part", "p_retailprice"))


def range_lake(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t).select(c) for t, c in RANGES}


RANGE_SQL = "r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, min({c}) AS lo, max({c}) AS hi FROM {t}" for t, c in RANGES) + ")"


@query(
    f"""WITH {RANGE_SQL} SELECT a.t AS table1, a.c AS column1, b.t AS table2, b.c AS column2, round(CASE WHEN least(a.hi, b.hi) > greatest(a.lo, b.lo) THEN (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) ELSE 0 END, 6) AS range_overlap
FROM r a JOIN r b ON a.t < b.t"""
)
def range_overlap_pairs(spark, sf_dir):
    prof = profile.profile_lake(range_lake(spark, sf_dir), top=0)
    pairs = features.candidate_pairs(prof).withColumnsRenamed({"num_min1": "min1", "num_max1": "max1", "num_min2": "min2", "num_max2": "max2"})
    return rounded(overlap.range_overlap(pairs).select(*candidates.PAIR, "range_overlap"), "range_overlap")


NUMBERS_SQL = "v AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c} AS x FROM {t}" for t, c in RANGES) + "), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY t, c)"


@query(
    f"""WITH {NUMBERS_SQL}, p AS (SELECT a.t AS table1, a.c AS column1, b.t AS table2, b.c AS column2, a.n AS n1, b.n AS n2 FROM n a JOIN n b ON a.t < b.t),
m AS (SELECT table1, column1, table2, column2, x, sum(mass) AS mass FROM (SELECT p.table1, p.column1, p.table2, p.column2, v.x, 1.0::DOUBLE / p.n1 AS mass FROM p JOIN v ON v.t = p.table1 AND v.c = p.column1 UNION ALL SELECT p.table1, p.column1, p.table2, p.column2, v.x, -1.0::DOUBLE / p.n2 FROM p JOIN v ON v.t = p.table2 AND v.c = p.column2) GROUP BY ALL),
s AS (SELECT *, sum(mass) OVER w AS f, lead(x) OVER w - x AS dx FROM m WINDOW w AS (PARTITION BY table1, column1, table2, column2 ORDER BY x))
SELECT table1, column1, table2, column2, round(sum(abs(f) * dx), 3) AS emd FROM s GROUP BY ALL"""
)
def emd_pairs(spark, sf_dir):
    counts = counted(range_lake(spark, sf_dir))
    prof = profile.profiles(counts, top=0)
    return rounded(overlap.earth_mover(counts, features.candidate_pairs(prof)), "emd", places=3)


# --- names -----------------------------------------------------------------------------

NAMES = tuple(dict.fromkeys(c for t, c in KEYS)) + ("projectId", "ProjectID", "created_at", "orderLineNumber", "id", "country_code", "candidate")
NAMES_SQL = "names(name) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ")"


def name_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


@query(f"WITH {NAMES_SQL} SELECT name, array_to_string([x for x in string_split_regex(lower(trim(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))), ' +') if x <> ''], '|') AS tokens, length(name)::INTEGER AS n_chars FROM names")
def name_tokens(spark, sf_dir):
    return name_frame(spark).select("name", F.array_join(names.name_tokens(F.col("name")), "|").alias("tokens"), F.length("name").alias("n_chars"))


@query(f"WITH {NAMES_SQL} SELECT a.name AS name1, b.name AS name2, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE, 6) AS likeness FROM names a JOIN names b ON a.name < b.name")
def edit_distance_names(spark, sf_dir):
    a, b = (name_frame(spark).withColumnRenamed("name", f"name{s}") for s in ("1", "2"))
    return a.join(b, F.expr("name1 < name2")).select("name1", "name2", F.round(names.edit_likeness(F.col("name1"), F.col("name2")), 6).alias("likeness"))


@query()
def match_ratio_names(spark, sf_dir):
    """The matched-characters ratio, plain and on sorted tokens; there is no SQL function for it."""
    a, b = (name_frame(spark).withColumnRenamed("name", f"name{s}") for s in ("1", "2"))
    pairs = a.join(b, F.expr("name1 < name2"))
    ratio = names.match_ratio()
    return pairs.select("name1", "name2", F.round(ratio(F.lower("name1"), F.lower("name2")), 6).alias("edit_ratio"), F.round(ratio(names.sorted_tokens(F.col("name1")), names.sorted_tokens(F.col("name2"))), 6).alias("token_sort_ratio"))


@query(f"WITH {NAMES_SQL} SELECT name, regexp_matches(lower(name), '(id|code)$') AS likely FROM names")
def likely_keys(spark, sf_dir):
    return name_frame(spark).select("name", names.likely_key(F.col("name")).alias("likely"))


HEADERS = {t: tuple(c for c, _ in cs) for t, cs in PROFILED.items()} | {"buyers": ("c_custkey", "c_name", "c_phone"), "parts_old": ("p_partkey", "p_name", "p_size", "p_color")}
HEADERS_SQL = "h(t, c) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in HEADERS.items() for c in cs) + ")"


@query(
    f"""WITH {HEADERS_SQL}, n AS (SELECT t, count(*) AS n FROM h GROUP BY t), s AS (SELECT a.t AS table1, b.t AS table2, count(CASE WHEN a.c = b.c THEN 1 END) AS shared FROM h a JOIN h b ON a.t < b.t GROUP BY 1, 2)
SELECT table1, table2, round(shared / (x.n + y.n - shared)::DOUBLE, 6) AS header_jaccard FROM s JOIN n x ON x.t = table1 JOIN n y ON y.t = table2"""
)
def header_jaccard(spark, sf_dir):
    frame = spark.createDataFrame([(t, c) for t, cs in HEADERS.items() for c in cs], "table string, column string")
    return rounded(features.header_features(frame), "header_jaccard")


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query, neighbour, round(cosine, 5) AS cosine, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM s) WHERE rank <= 5"""
)
def embedding_cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(similarity.top_similar(vectors.where("id % 50 = 0"), vectors, 5), "cosine", places=5)


# --- ranking, selection, metrics ------------------------------------------------------------

SCORES_SQL = "s AS (SELECT source AS query, doc_id::VARCHAR AS \"table\", round(((doc_id * 7919) % 1009) / 1009.0::DOUBLE, 6) AS prob, CASE WHEN (doc_id * 31) % 7 < 2 THEN 1 ELSE 0 END AS label FROM documents)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("query"), F.col("doc_id").cast("string").alias("table"), F.round(((F.col("doc_id") * 7919) % 1009) / F.lit(1009.0), 6).alias("prob"), F.when((F.col("doc_id") * 31) % 7 < 2, 1).otherwise(0).alias("label"))


@query(
    f"""WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY prob DESC, "table") AS rank FROM s), g AS (SELECT *, prob / log2(rank + 1) AS gain FROM r WHERE rank <= 20),
f AS (SELECT *, max(CASE WHEN rank = 1 OR gain >= 0.15 * first THEN 0 ELSE 1 END) OVER (PARTITION BY query ORDER BY rank) AS failed FROM (SELECT *, first_value(gain) OVER (PARTITION BY query ORDER BY rank) AS first FROM g))
SELECT query, "table", prob, rank::INTEGER AS rank, round(gain, 6) AS gain FROM f WHERE failed = 0"""
)
def dcg_select(spark, sf_dir):
    return rounded(rank.gain_prefix(scores(spark, sf_dir)), "gain").select("query", "table", "prob", "rank", "gain")


@query(f"""WITH {SCORES_SQL} SELECT query, "table", prob, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY prob DESC, "table") AS rank, count(*) OVER (PARTITION BY query) AS n FROM s) WHERE rank <= greatest(1, floor(n * 0.5))""")
def topk_percent(spark, sf_dir):
    return rank.top_percent(scores(spark, sf_dir)).select("query", "table", "prob", "rank")


@query(f"""WITH {SCORES_SQL} SELECT query, "table", prob FROM s WHERE prob >= 0.8""")
def threshold_filter(spark, sf_dir):
    return rank.above(scores(spark, sf_dir), 0.8).select("query", "table", "prob")


PRF_SQL = "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1"
GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query(
    f"""WITH {SCORES_SQL}, g(threshold) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in GRID)}),
c AS (SELECT threshold, query, count(*) FILTER (prob >= threshold AND label = 1) AS tp, count(*) FILTER (prob >= threshold AND label = 0) AS fp, count(*) FILTER (prob < threshold AND label = 1) AS fn FROM s CROSS JOIN g GROUP BY 1, 2),
m AS (SELECT threshold, {PRF_SQL} FROM c) SELECT threshold, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM m GROUP BY 1"""
)
def threshold_sweep(spark, sf_dir):
    return rounded(rank.threshold_sweep(scores(spark, sf_dir), GRID), "precision", "recall", "f1")


@query(
    f"""WITH {SCORES_SQL}, t AS (SELECT DISTINCT prob AS threshold FROM s), c AS (SELECT threshold, count(*) FILTER (label = 1) AS tp, count(*) AS chosen FROM t JOIN s ON s.prob >= threshold GROUP BY 1)
SELECT threshold, round(2.0 * tp / (chosen + (SELECT count(*) FROM s WHERE label = 1)), 6) AS f1 FROM c ORDER BY f1 DESC, threshold DESC LIMIT 1"""
)
def best_f1_threshold(spark, sf_dir):
    return rounded(rank.best_threshold(scores(spark, sf_dir)), "f1")


@query(
    f"""WITH {SCORES_SQL}, c AS (SELECT query, count(*) FILTER (prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (prob >= 0.5 AND label = 0) AS fp, count(*) FILTER (prob < 0.5 AND label = 1) AS fn FROM s GROUP BY 1),
m AS (SELECT query, tp, fp, fn, {PRF_SQL} FROM c) SELECT query, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m"""
)
def prf_by_group(spark, sf_dir):
    s = scores(spark, sf_dir)
    return rounded(evaluation.set_metrics(s.where("prob >= 0.5"), s.where("label = 1")), "precision", "recall", "f1").drop("false_positives", "false_negatives")


@query(
    f"""WITH {SCORES_SQL}, c AS (SELECT query, count(*) FILTER (prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (prob >= 0.5 AND label = 0) AS fp, count(*) FILTER (prob < 0.5 AND label = 1) AS fn FROM s GROUP BY 1), m AS (SELECT {PRF_SQL} FROM c)
SELECT round(avg(precision), 6) AS precision_mean, round(stddev_pop(precision), 6) AS precision_std, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM m"""
)
def macro_metrics(spark, sf_dir):
    s = scores(spark, sf_dir)
    out = evaluation.macro(evaluation.set_metrics(s.where("prob >= 0.5"), s.where("label = 1")))
    return rounded(out, *out.columns)


@query(
    f"""WITH {SCORES_SQL}, t(stage, threshold) AS (VALUES (0, 0.2), (1, 0.5), (2, 0.8)), c AS (SELECT stage, query, count(*) FILTER (prob >= threshold AND label = 1) AS tp, count(*) FILTER (prob >= threshold AND label = 0) AS fp, count(*) FILTER (prob < threshold AND label = 1) AS fn FROM s CROSS JOIN t GROUP BY 1, 2),
m AS (SELECT stage, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM (SELECT stage, {PRF_SQL} FROM c) GROUP BY 1)
SELECT stage, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(precision - lag(precision) OVER (ORDER BY stage), 6) AS precision_delta, round(recall - lag(recall) OVER (ORDER BY stage), 6) AS recall_delta, round(f1 - lag(f1) OVER (ORDER BY stage), 6) AS f1_delta FROM m"""
)
def stage_deltas(spark, sf_dir):
    s, out = scores(spark, sf_dir), None
    for stage, t in enumerate((0.2, 0.5, 0.8)):
        means = evaluation.macro(evaluation.set_metrics(s.where(F.col("prob") >= t), s.where("label = 1")))
        part = means.select(F.lit(stage).alias("stage"), *[F.col(f"{m}_mean").alias(m) for m in ("precision", "recall", "f1")])
        out = part if out is None else out.unionByName(part)
    out = evaluation.stage_deltas(out)
    return rounded(out, *[c for c in out.columns if c != "stage"])


@query(f"""WITH {SCORES_SQL}, k AS (SELECT query, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS k FROM s GROUP BY 1) SELECT query, label, k AS n FROM k CROSS JOIN (VALUES (0), (1)) l(label) WHERE k > 0""")
def class_balance(spark, sf_dir):
    return rank.balanced(scores(spark, sf_dir)).groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))


TRUE_EDGES = (("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_partkey", "part", "p_partkey"))
PREDICTED_EDGES = (("customer", "c_custkey", "orders", "o_custkey"), ("nation", "n_regionkey", "customer", "c_nationkey"), ("region", "r_regionkey", "nation", "n_regionkey"))


@query("SELECT round(2 / 3.0, 6)::DOUBLE AS recall")
def edge_recall(spark, sf_dir):
    a, b = (spark.createDataFrame(e, candidates.PAIR) for e in (PREDICTED_EDGES, TRUE_EDGES))
    return rounded(evaluation.edge_recall(a, b), "recall")


@query("SELECT 1::BIGINT AS tp, 2::BIGINT AS fp, 2::BIGINT AS fn, round(1 / 3.0, 6)::DOUBLE AS precision, round(1 / 3.0, 6)::DOUBLE AS recall, round(1 / 3.0, 6)::DOUBLE AS f1")
def edge_f1(spark, sf_dir):
    a, b = (spark.createDataFrame(e, candidates.PAIR) for e in (PREDICTED_EDGES, TRUE_EDGES))
    return rounded(evaluation.edge_f1(a, b), "precision", "recall", "f1")


@query("""SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalised FROM conversations""")
def query_normalise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rank.normalised_query(F.col("text")).alias("normalised"))


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]+'), CASE WHEN contains(lower(text), 'tion') THEN ['tion'] ELSE [] END))), ' ') AS terms FROM benchmark""")
def term_extract(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(rank.terms(F.col("text"), ["tion"])), " ").alias("terms"))


@query("""WITH c(condition) AS (VALUES ('a.x = b.y AND a.z=c.w'), ('t1.id = t2.ref_id')), p AS (SELECT condition, unnest(string_split(condition, ' AND ')) AS p FROM c)
SELECT condition, regexp_extract(p, '(\\w+)\\.(\\w+)\\s*=\\s*(\\w+)\\.(\\w+)', 1) AS table1, regexp_extract(p, '(\\w+)\\.(\\w+)\\s*=\\s*(\\w+)\\.(\\w+)', 2) AS column1, regexp_extract(p, '(\\w+)\\.(\\w+)\\s*=\\s*(\\w+)\\.(\\w+)', 3) AS table2, regexp_extract(p, '(\\w+)\\.(\\w+)\\s*=\\s*(\\w+)\\.(\\w+)', 4) AS column2 FROM p""")
def join_conditions(spark, sf_dir):
    return evaluation.join_conditions(spark.createDataFrame([("a.x = b.y AND a.z=c.w",), ("t1.id = t2.ref_id",)], "condition string"))


@query("""SELECT item_id, len([x for x in string_split_regex(text, '\\s+') if x <> ''])::INTEGER AS tokens, 'request [TAB] order lines [COL] item id [COL] text' AS candidate FROM benchmark""")
def token_estimates(spark, sf_dir):
    text = rank.candidate_text(F.lit("request"), F.lit("order_lines"), F.array(F.lit("item_id"), F.lit("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", evaluation.token_estimate(F.col("text")).alias("tokens"), text.alias("candidate"))


@query("""WITH t(query, tbl, relevant) AS (VALUES ('q', 'a', 1), ('q', 'b', 0), ('q', 'c', 1), ('q', 'd', NULL)), c(query, tbl, mx) AS (VALUES ('q', 'a', 1), ('q', 'b', 1), ('q', 'c', 0), ('q', 'd', 1))
SELECT 'p' AS project, query, tbl AS "table", CASE WHEN relevant IS NULL THEN 'columns of an unlabelled table' WHEN relevant = 1 AND mx = 0 THEN 'relevant table without a relevant column' WHEN relevant = 0 AND mx = 1 THEN 'relevant column in an irrelevant table' END AS violation
FROM t JOIN c USING (query, tbl) WHERE relevant IS NULL OR relevant <> mx""")
def label_violations(spark, sf_dir):
    rows = [("p", [("q", ["a"], {"a": 1, "b": 0, "c": 1}, {"a": {"x": 1}, "b": {"x": 1}, "c": {"x": 0}, "d": {"x": 1}}), (None, None, None, None)])]
    raw = spark.createDataFrame(rows, "project string, samples array<struct<query:string,query_related_table:array<string>,table_relevance:map<string,int>,column_relevance:map<string,map<string,int>>>>")
    return rank.label_violations(rank.flatten_samples(raw))


# --- catalog -----------------------------------------------------------------------------


@query("SELECT 'campaign' AS base, 'campaign_10' AS latest")
def latest_version(spark, sf_dir):
    rows = [(n,) for n in ("campaign", "campaign_1", "Campaign_2", "campaign_10", "campaign_history_99", "campaign_x")]
    return latest_versions(spark.createDataFrame(rows, "name string"), "campaign")


@query("SELECT * FROM (VALUES ('item_id', 'bigint', true), ('text', 'string', true)) t(path, type, nullable)")
def table_columns(spark, sf_dir):
    return table_info(table(spark, sf_dir, "benchmark"))


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 20")
def sample_first_n(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy("p_partkey").limit(20)


# --- joins and relational constructs ----------------------------------------------------------


@query(
    """SELECT o_orderkey, c_custkey, c_name, n_name, r_name, o_totalprice FROM orders JOIN customer ON o_custkey::VARCHAR = c_custkey::VARCHAR JOIN nation ON c_nationkey::VARCHAR = n_nationkey::VARCHAR JOIN region ON n_regionkey::VARCHAR = r_regionkey::VARCHAR"""
)
def multi_join_text_keys(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")}
    edges = [JoinEdge("orders", "customer", (("o_custkey", "c_custkey"),)), JoinEdge("customer", "nation", (("c_nationkey", "n_nationkey"),)), JoinEdge("region", "nation", (("r_regionkey", "n_regionkey"),))]
    out = join_all(tables, edges)
    return out.select(*[F.col(c).alias(c.split("__")[1]) for c in ("orders__o_orderkey", "customer__c_custkey", "customer__c_name", "nation__n_name", "region__r_name", "orders__o_totalprice")])


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def cycle_join(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier", "nation")}
    edges = [JoinEdge("lineitem", "orders", (("l_orderkey", "o_orderkey"),)), JoinEdge("orders", "customer", (("o_custkey", "c_custkey"),)), JoinEdge("lineitem", "supplier", (("l_suppkey", "s_suppkey"),)), JoinEdge("customer", "supplier", (("c_nationkey", "s_nationkey"),)), JoinEdge("supplier", "nation", (("s_nationkey", "n_nationkey"),))]
    out = join_all(tables, edges, start="lineitem")
    revenue = F.sum(F.col("lineitem__l_extendedprice") * (1 - F.col("lineitem__l_discount")))
    return out.groupBy(F.col("nation__n_name").alias("n_name")).agg(F.round(revenue, 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def discovered_join_revenue(spark, sf_dir):
    """The flagship: finds how orders, customer and nation join, and sums revenue by nation over that join."""
    found = candidates.top_per_table_pair(candidates.RuleScorer().score(features.pair_features(*_key_counts(spark, sf_dir, ("orders", "customer", "nation")))), 1)
    rows = [tuple(r) for r in found.select(*candidates.PAIR, "prob").collect()]  # a row a table pair
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation")}
    out = join_all(tables, tree_edges(rows, list(tables)), start="orders")
    return out.groupBy(F.col("nation__n_name").alias("n_name")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("orders__o_totalprice"), 2).alias("revenue"))


def _key_counts(spark: SparkSession, sf_dir: str, only: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    lake = {t: df for t, df in key_lake(spark, sf_dir).items() if t in only}
    counts = counted(lake)
    return counts, profile.profiles(counts, top=0)


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2, 3")
def multi_key_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    counts = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("m"))
    own = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("k"))
    return own.join(counts, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("k") * F.col("m")).alias("n"))


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'none' WHEN n < 10 THEN 'few' ELSE 'many' END AS activity FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def left_join_case(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.when(F.col("n").isNull(), "none").when(F.col("n") < 10, "few").otherwise("many").alias("activity"))


@query("SELECT c_custkey AS key, c_name AS name, 'customer' AS source_relation FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def union_all_sources(spark, sf_dir):
    a = staging.staged(table(spark, sf_dir, "customer"), {"key": "c_custkey", "name": "c_name"})
    b = staging.staged(table(spark, sf_dir, "supplier"), {"key": "s_suppkey", "name": "s_name"})
    return staging.with_source({"customer": a, "supplier": b})


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return a.select(F.col("c_nationkey").alias("nationkey")).union(b.select("s_nationkey")).distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000)")
def semi_join_members(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where(F.col("o_totalprice").between(100000, 200000)).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join_unmatched(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def count_equi_join(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2")
def group_count_sum_avg(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT p_partkey, p_brand, nullif(regexp_extract(p_brand, '#(\\d+)$', 1), '') AS digits, try_cast(nullif(regexp_extract(p_brand, '#(\\d+)$', 1), '') AS INTEGER) AS number FROM part WHERE p_name LIKE '%ring' AND (p_size > 10 OR p_type = 'ECONOMY')")
def filter_extract_cast(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("lakeweave_part")
    return spark.sql(r"WITH x AS (SELECT *, nullif(regexp_extract(p_brand, '#(\\d+)$', 1), '') AS digits FROM lakeweave_part) SELECT p_partkey, p_brand, digits, try_cast(digits AS INT) AS number FROM x WHERE p_name LIKE '%ring' AND (p_size > 10 OR p_type = 'ECONOMY')")


# --- staging ------------------------------------------------------------------------------


@query("SELECT o_orderkey AS order_id, o_custkey::VARCHAR AS customer_id, o_orderdate::DATE AS ordered_on, o_totalprice AS amount FROM orders")
def stage_rename_cast(spark, sf_dir):
    return staging.staged(table(spark, sf_dir, "orders"), {"order_id": "o_orderkey", "customer_id": F.col("o_custkey").cast("string"), "ordered_on": F.to_date("o_orderdate"), "amount": "o_totalprice"})


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE NOT (l_returnflag = 'R')")
def soft_delete_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("deleted", F.col("l_returnflag") == "R")
    return staging.live(lines, "deleted").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, round(l_extendedprice * 1000000 / 1e6, 4) AS spend FROM lineitem")
def micros_to_currency(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.round(staging.from_micros(F.col("l_extendedprice") * 1000000), 4).alias("spend"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 2 = 1 AS odd FROM lineitem")
def boolean_recode(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", staging.flag(F.col("l_linenumber") % 2).alias("odd"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS url_host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS url_path, regexp_extract(url, '^[^?#]*') AS base_url, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    parts = staging.url_parts(url)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(parts["url_host"]).alias("url_host"), F.coalesce(parts["url_path"], F.lit("")).alias("url_path"), parts["base_url"].alias("base_url"), F.try_parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS prefix, split_part(c_name, '#', 2) AS code FROM customer")
def split_delimiter(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("prefix"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("code"))


@query("SELECT c_custkey, lower(c_mktsegment) || '.example.com' AS domain, split_part('[' || c_name || ', ' || c_mktsegment || ']', ', ', 1)[2:] AS first_element FROM customer")
def domain_and_list(spark, sf_dir):
    mail = F.concat(F.lit("a@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    listed = F.concat(F.lit("["), "c_name", F.lit(", "), "c_mktsegment", F.lit("]"))
    return table(spark, sf_dir, "customer").select("c_custkey", staging.email_domain(mail).alias("domain"), staging.first_of_list(listed).alias("first_element"))


@query("SELECT p_partkey, lower(p_type) AS type_key FROM part")
def lower_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", keys.cased(F.col("p_type")).alias("type_key"))


@query("SELECT event_id, strftime(ts, '%a') AS day_name, day(ts)::INTEGER AS day_of_month FROM events")
def day_parts(spark, sf_dir):
    parts = staging.day_parts(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, o_orderpriority) AS state FROM orders")
def coalesce_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), "o_orderpriority").alias("state"))


@query("SELECT o_orderkey, md5(coalesce(o_custkey::VARCHAR, '') || '-' || coalesce(o_orderstatus, '') || '-' || coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END, '')) AS key FROM orders")
def surrogate_md5(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", staging.surrogate_key(F.col("o_custkey"), F.col("o_orderstatus"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))).alias("key"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_scalar(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- history and reports ----------------------------------------------------------------------


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_most_recent_record FROM events")
def latest_record_flag(spark, sf_dir):
    return history.most_recent_flag(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "is_most_recent_record")


@query("SELECT event_id, user_id, event_type, latest_index::INTEGER AS latest_index FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS latest_index FROM events) WHERE latest_index = 1")
def latest_rows(spark, sf_dir):
    return history.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "latest_index")


@query("SELECT event_id, user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS valid_to FROM events")
def scd2_intervals(spark, sf_dir):
    return history.valid_intervals(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("event_id", "user_id", "event_type", "valid_from", "valid_to")


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_event_type, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_value FROM events")
def previous_event(spark, sf_dir):
    return history.previous(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"]).select("event_id", "previous_event_type", "previous_value")


@query("SELECT event_id, date_sub('minute', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS minutes FROM events")
def minutes_between_events(spark, sf_dir):
    later = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", history.minutes_between(F.col("ts"), later).alias("minutes"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS n_outer, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS n_inner FROM events")
def running_counters(spark, sf_dir):
    return history.running_counts(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], ["ts", "event_id"]).select("event_id", "n_outer", "n_inner")


@query("SELECT user_id, arg_min(event_type, ts) AS first_value, arg_max(event_type, ts) AS last_value, count(event_type) AS n_values, count(DISTINCT event_type) AS n_distinct FROM events GROUP BY 1")
def first_last_by_time(spark, sf_dir):
    return history.first_last(table(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), "event_type")


@query("SELECT l_suppkey, l_shipdate::DATE AS day, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2")
def daily_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def monthly_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_partkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END), 2) AS kept, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY 1")
def conditional_sums(spark, sf_dir):
    back = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.when(back, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("returned"), F.round(F.sum(F.when(~back, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("kept"), F.count_if(back).alias("n_returned"))


@query("SELECT l_suppkey, round(sum(l_tax) / nullif(sum(l_quantity), 0) * 1e6, 2) AS per_million FROM lineitem GROUP BY 1")
def per_million_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(staging.per_million(F.round(F.sum("l_tax"), 6), F.sum("l_quantity")).alias("per_million"))


AD_SQL = "a AS (SELECT event_type, user_id, count(*) FILTER (value > 20) AS clicks, count(*) AS impressions, round(sum(value), 2) AS spend FROM events GROUP BY 1, 2)"


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count_if(F.col("value") > 20).alias("clicks"), F.count(F.lit(1)).alias("impressions"), F.round(F.sum("value"), 2).alias("spend"))


@query(f"WITH {AD_SQL} SELECT event_type, user_id, clicks, impressions, spend, round(spend / nullif(clicks, 0), 6) AS cpc, round(spend * 1000 / nullif(impressions, 0), 6) AS cpm, (clicks // nullif(impressions, 0))::BIGINT AS ctr FROM a")
def ctr_cpc_cpm(spark, sf_dir):
    return ads(spark, sf_dir).select("event_type", "user_id", "clicks", "impressions", "spend", F.round(staging.cost_per_click(F.col("spend"), F.col("clicks")), 6).alias("cpc"), F.round(staging.cost_per_mille(F.col("spend"), F.col("impressions")), 6).alias("cpm"), staging.click_through(F.col("clicks"), F.col("impressions")).alias("ctr"))


@query(
    """WITH g AS (SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(r_name, n_name, c_mktsegment) AS id FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment), (c_mktsegment), ()))
SELECT r_name, n_name, c_mktsegment, n, total, CASE id WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 4 END::INTEGER AS grain FROM g"""
)
def report_grains(spark, sf_dir):
    joined = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    grains = [["r_name"], ["r_name", "n_name"], ["r_name", "n_name", "c_mktsegment"], ["c_mktsegment"], []]
    return history.report(joined, grains, {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)})


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, s_name, n_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey")
def dimension_enrichment(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return out.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "s_name", "n_name")


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def listagg_ordered(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("lakeweave_nation")
    return spark.sql("SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS nations FROM lakeweave_nation GROUP BY n_regionkey")


@query("SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN q END) AS A, max(CASE WHEN l_returnflag = 'N' THEN q END) AS N FROM (SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def pivot_fixed(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return history.pivot_fixed(sums, ["l_suppkey"], "l_returnflag", "q", ["A", "N"])


@query("SELECT s_suppkey, 'acctbal' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def unpivot_measures(spark, sf_dir):
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return history.unpivot(wide, ["s_suppkey"], ["acctbal", "nation"])


@query("SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}' AS object FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def map_from_kv(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return history.as_object(counts, ["user_id"], "event_type", "n").select("user_id", F.to_json("object").alias("object"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'P') AS n_partial FROM orders GROUP BY 1")
def status_buckets(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "n_done"), ("O", "n_open"), ("P", "n_partial"))])


@query("SELECT event_type, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM events GROUP BY 1")
def mean_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"))


@query("SELECT day, event_type, n, round(n / sum(n) OVER (PARTITION BY day), 6)::DOUBLE AS share FROM (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def percent_of_total(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rounded(history.share_of_total(counts, ["day"], "n"), "share")


@query("SELECT user_id, event_type, day, day = min(day) OVER (PARTITION BY user_id, event_type) AS is_first FROM (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events)")
def first_vs_return(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()
    return history.first_or_return(days, ["user_id", "event_type"], "day")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1")
def minmax_time(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS won, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS lost, count(*) FILTER (o_orderstatus = 'F') AS n_won FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def win_loss_sums(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(*[F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0)), 2).alias(n) for s, n in (("F", "won"), ("P", "lost"))], F.count_if(F.col("o_orderstatus") == "F").alias("n_won"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1998-12-31' - INTERVAL 30 DAY AND o_orderdate <= TIMESTAMP '1998-12-31' GROUP BY 1")
def rolling_30d_asof(spark, sf_dir):
    as_of = F.lit("1998-12-31").cast("timestamp_ntz")
    return history.since(table(spark, sf_dir, "orders"), "o_orderdate", as_of).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'overdrawn' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'fair' ELSE 'high' END AS status FROM customer")
def case_ladder(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(b.isNull(), "unknown").when(b < 0, "overdrawn").when(b < 1000, "low").when(b < 5000, "fair").otherwise("high").alias("status"))


@query(
    """WITH i AS (SELECT user_id, event_id AS error_id, ts AS f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS t FROM events WHERE event_type = 'error')
SELECT e.event_id, i.error_id FROM events e JOIN i ON e.user_id = i.user_id AND e.ts >= i.f AND (i.t IS NULL OR e.ts < i.t)"""
)
def interval_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    errors = history.valid_intervals(events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), "ts"), ["user_id"], "ts").select("user_id", "error_id", "valid_from", "valid_to")
    return history.interval_join(events.select("event_id", "user_id", "ts"), "ts", errors, "valid_from", "valid_to", ["user_id"]).select("event_id", "error_id")


@query("SELECT e.event_id, i.event_id AS error_id FROM events e JOIN events i ON i.event_type = 'error' AND e.ts >= i.ts AND e.ts < i.ts + INTERVAL 90 MINUTE")
def bucketed_error_intervals(spark, sf_dir):
    """Events within 90 minutes after an error, whoever's: every error opens an interval, which touches ten buckets."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("f"), (F.col("ts") + F.make_dt_interval(mins=F.lit(90))).alias("t"))
    return history.bucketed_interval_join(events.select("event_id", "ts"), "ts", errors, "f", "t", F.col("t"), seconds=600).select("event_id", "error_id")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, c_nationkey IS NOT NULL AS is_customer, s_nationkey IS NOT NULL AS is_supplier FROM (SELECT DISTINCT c_nationkey FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON c_nationkey = s_nationkey")
def full_outer_origin_flags(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return history.origin_flags(a, b, ["nationkey"], ("is_customer", "is_supplier"))


@query("SELECT a.c_custkey, a.c_name, b.c_name AS parent_name FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey // 10 AND a.c_custkey >= 10")
def self_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    parents = c.select(F.col("c_custkey").alias("parent"), F.col("c_name").alias("parent_name"))
    return c.withColumn("parent", F.when(F.col("c_custkey") >= 10, F.expr("c_custkey div 10"))).join(parents, "parent", "left").select("c_custkey", "c_name", "parent_name")


@query("SELECT o_orderkey, count(*) AS n, max(l_shipdate) AS last_ship, date_diff('day', min(o_orderdate)::DATE, max(l_shipdate)::DATE)::INTEGER AS days, round(sum(l_quantity), 2) AS scheduled, max(l_shipdate) > min(o_orderdate) + INTERVAL 90 DAY AS late FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def purchase_schedule(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.max("l_shipdate") > F.min("o_orderdate") + F.make_dt_interval(F.lit(90))
    return joined.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last_ship"), F.datediff(F.max("l_shipdate").cast("date"), F.min("o_orderdate").cast("date")).alias("days"), F.round(F.sum("l_quantity"), 2).alias("scheduled"), late.alias("late"))


# --- key repairs ----------------------------------------------------------------------------


@query("SELECT c_custkey, upper(c_mktsegment) AS upper_key, c_custkey::VARCHAR AS rest, 'X' AS prefix, c_custkey::VARCHAR AS plain, lpad(c_custkey::VARCHAR, 9, '0') AS padded FROM customer")
def key_clean_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    dirty = F.concat(F.lit("X"), F.col("c_custkey").cast("string"))
    rest, prefix = keys.split_prefix(dirty, "[A-Z]")
    padded = keys.with_zeros(F.col("c_custkey").cast("string"), 9)
    return c.select("c_custkey", keys.cased(F.col("c_mktsegment"), "upper").alias("upper_key"), rest.alias("rest"), prefix.alias("prefix"), keys.without_zeros(padded).alias("plain"), padded.alias("padded"))


@query("SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS german, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label, o_orderkey::VARCHAR AS text_key FROM orders")
def key_clean_dates_enums(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        keys.any_date(F.date_format(d, "yyyyMMdd")).alias("iso"),
        keys.any_date(F.date_format(d, "dd.MM.yyyy")).alias("german"),
        keys.mapped(F.col("o_orderstatus"), {"F": "done", "O": "open"}).alias("label"),
        keys.aligned(F.col("o_orderkey"), "string").alias("text_key"),
    )


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second, p_brand || '/' || p_type AS joined, p_size * 1000.0::DOUBLE AS grams FROM part")
def key_decompose(spark, sf_dir):
    first, second = keys.parts(F.col("p_name"), " ", 2)
    weight = F.concat(F.col("p_size").cast("string"), F.lit(" kg"))
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("first"), second.alias("second"), keys.joined(F.col("p_brand"), F.col("p_type"), by="/").alias("joined"), keys.in_unit(weight, {"kg": 1000.0, "g": 1.0}).alias("grams"))


@query("WITH o AS (SELECT count(DISTINCT o_custkey) AS a FROM orders), c AS (SELECT count(DISTINCT c_custkey) AS b FROM customer), s AS (SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey) SELECT step::INTEGER AS step, 'orders' AS base, version::INTEGER AS version, op, before::DOUBLE AS before, round(after, 6)::DOUBLE AS after, kept FROM (SELECT 1 AS step, 1 AS version, 'trim' AS op, 0 AS before, 0::DOUBLE AS after, false AS kept UNION ALL SELECT 2, 1, 'strip prefix', 0, n / least(a, b)::DOUBLE, true FROM o, c, s)")
def validate_join_before_after(spark, sf_dir):
    """Orders' customer keys as "CUST-n": trimming doesn't help and is rolled back, taking the prefix off does."""
    dirty = table(spark, sf_dir, "orders").withColumn("o_custkey", F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")))
    clean = table(spark, sf_dir, "customer").withColumn("c_custkey", F.col("c_custkey").cast("string"))
    session = RepairSession(VersionedCatalog(spark, {"orders": dirty, "customer": clean}))

    def strip(df: DataFrame) -> dict:
        rest, prefix = keys.split_prefix(F.col("o_custkey"), "CUST-")
        return {"o_custkey": rest, "o_custkey_prefix": prefix}

    session.validate("orders", "o_custkey", "customer", "c_custkey", [("trim", "orders", lambda df: {"o_custkey": keys.trimmed(F.col("o_custkey"))}), ("strip prefix", "orders", strip)])
    return rounded(session.log_frame(), "after")


@query()
def judged_tables(spark, sf_dir):
    """Keep and supplement steps with the lexical judge over the driver tables' columns."""
    columns = [(t, [c for c, _ in cs]) for t, cs in PROFILED.items()]
    requests = ["total c_acctbal by nation", "part brand and size"]
    frame = spark.createDataFrame([(q, t, c) for q in requests for t, c in columns], "query string, table string, columns array<string>")
    reviewer = judge.LexicalJudge(lambda q: rank.terms(q))
    kept = judge.keep_step(frame, reviewer)
    return judge.supplement_step(kept, frame, reviewer)


from lakeweave import queries_lake  # noqa: E402, F401  registers its queries beside these
