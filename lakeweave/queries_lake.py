"""More operators as queries over the driver's tables: CSV lakes and sinks, graphs of tables, reviews, features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import keys, values
from lakeweave.operators import candidates, classify, evaluation, features, graph, history, judge, profile, rank
from lakeweave.queries import FK_SQL, FOREIGN_KEYS, KEYS, MATRIX_SQL, PROFILED, SCORED_SQL, counted, foreign_keys, key_lake, matrix, query, rounded, scored, table
from lakeweave.sources import files, lake
from lakeweave.sources.catalog import run_sql
from lakeweave.sources.shared import shared_dir, written

# --- CSV lakes, links and sinks, written from the tables --------------------------------


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_of(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A folder with the tables as CSV, each a folder ``name.csv``."""
    out = folder(spark, "lake")
    for name in names:
        files.write_csv(table(spark, sf_dir, name), f"{out}/{name}.csv")
    return out


def as_before(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in like.schema])


@query("SELECT * FROM orders")
def csv_round_trip_orders(spark, sf_dir):
    """A table written as CSV and read with inferred types."""
    like = table(spark, sf_dir, "orders")
    return as_before(lake.read_csv(spark, f"{csv_of(spark, sf_dir, 'orders')}/orders.csv"), like)


@query("SELECT p_partkey, p_brand, p_retailprice FROM part")
def csv_projected_read(spark, sf_dir):
    like = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return as_before(lake.read_csv(spark, f"{csv_of(spark, sf_dir, 'part')}/part.csv", infer=False).select(like.columns), like)


LAKE = ("customer", "nation", "orders", "region", "supplier")
LAKE_SQL = f"cols AS (SELECT table_name AS t, column_name AS c, (ordinal_position - 1)::INTEGER AS ordinal FROM information_schema.columns WHERE table_name IN {LAKE})"


@query(f'WITH {LAKE_SQL} SELECT t AS "table", c AS "column", ordinal FROM cols')
def csv_lake_columns(spark, sf_dir):
    """Names and columns of all tables of a CSV folder."""
    tables, errors = lake.load_lake(spark, csv_of(spark, sf_dir, *LAKE), infer=False)
    assert not errors
    return lake.catalog_columns(tables)


@query("SELECT column_name AS \"column\", (ordinal_position - 1)::INTEGER AS ordinal FROM information_schema.columns WHERE table_name = 'lineitem'")
def csv_header(spark, sf_dir):
    names = lake.header(spark, f"{csv_of(spark, sf_dir, 'lineitem')}/lineitem.csv")
    return spark.createDataFrame(list(enumerate(names)), "ordinal int, column string").select("column", "ordinal")


#: Links as a list has them: good ones, unknown columns, an unknown table.
LINK_ROWS = (*[(a, c, b, d) for a, b, c, d in FOREIGN_KEYS if {a, c} <= set(LAKE)], ("orders", "customer", "o_nokey", "c_custkey"), ("supplier", "nation", "s_nationkey", "n_nokey"), ("ghost", "nation", "g_key", "n_nationkey"))
LINKS_SQL = f"WITH {LAKE_SQL}, l(t1, t2, c1, c2) AS (VALUES {', '.join(map(str, LINK_ROWS))}), firsts AS (SELECT t, arg_min(c, ordinal) AS first FROM cols GROUP BY t)"


def links(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    path = folder(spark, "links")
    spark.createDataFrame([(f"{a}.csv", b, f" {c}", d, "1") for a, b, c, d in LINK_ROWS], "a string, b string, c string, d string, e string").write.csv(path)
    return lake.read_links(spark, path, csv_lake_columns(spark, sf_dir), **options)


@query(f"{LINKS_SQL} SELECT t1 AS table1, c1 AS column1, t2 AS table2, c2 AS column2, 1 AS label FROM l WHERE (t1, c1) IN (SELECT t, c FROM cols) AND (t2, c2) IN (SELECT t, c FROM cols)")
def link_list(spark, sf_dir):
    return links(spark, sf_dir)


@query(f"{LINKS_SQL} SELECT t1 AS table1, CASE WHEN (t1, c1) IN (SELECT t, c FROM cols) THEN c1 ELSE a.first END AS column1, t2 AS table2, CASE WHEN (t2, c2) IN (SELECT t, c FROM cols) THEN c2 ELSE b.first END AS column2, 1 AS label FROM l JOIN firsts a ON a.t = t1 JOIN firsts b ON b.t = t2")
def link_list_lenient(spark, sf_dir):
    return links(spark, sf_dir, lenient=True)


@query(f"{LINKS_SQL} SELECT t1 AS table1, c1 AS column1, t2 AS table2, c2 AS column2, 0 AS label FROM l WHERE (t1, c1) IN (SELECT t, c FROM cols) AND (t2, c2) IN (SELECT t, c FROM cols)")
def link_list_negative(spark, sf_dir):
    return links(spark, sf_dir, label=0)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def jsonl_appended(spark, sf_dir):
    """Two appends to one folder of JSON lines."""
    path, like = folder(spark, "jsonl"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.append_jsonl(like.where("c_nationkey < 10"), path)
    files.append_jsonl(like.where("c_nationkey >= 10 or c_nationkey is null"), path)
    return spark.read.schema(like.schema).json(path)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sql_statement_to_csv(spark, sf_dir):
    """A statement run with a path as its output, read back."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_for_csv")
    path = run_sql(spark, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_for_csv GROUP BY 1", folder(spark, "sql"))
    return spark.read.option("header", True).schema("o_orderstatus string, n long, total double").csv(path)


@query("SELECT n_regionkey::BIGINT AS n_regionkey, CASE WHEN n_regionkey = 0 THEN 'removed' WHEN n_regionkey = 1 THEN 'changed' ELSE 'added' END AS change FROM nation WHERE n_regionkey IN (0, 1, 4) GROUP BY 1, 2")
def folder_changes(spark, sf_dir):
    """Differences by content between two states of a folder: a file a region."""
    nations, one, two = table(spark, sf_dir, "nation"), folder(spark, "state"), folder(spark, "state")
    before = nations.where("n_regionkey <> 4")
    after = nations.where("n_regionkey <> 0").withColumn("n_name", F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.col("n_name")))
    for df, path in ((before, one), (after, two)):
        df.select("n_regionkey", "n_name").sort("n_name").coalesce(1).write.partitionBy("n_regionkey").csv(path)
    region = F.regexp_extract("path", r"n_regionkey=(\d+)", 1)
    hashes = [files.content_hashes(spark, p).where(F.col("path").contains("part-")).withColumn("path", region) for p in (one, two)]
    return files.changed_files(*hashes).select(F.col("path").cast("long").alias("n_regionkey"), "change")


# --- graphs of tables ---------------------------------------------------------------------

COLLAPSED_SQL = f"{SCORED_SQL}, g AS (SELECT least(table1, table2) AS u, greatest(table1, table2) AS v, min(CASE WHEN prob > 0 THEN -ln(prob) END) AS w FROM scored WHERE prob > 0 GROUP BY 1, 2)"
#: A recursive prefix: walks of fewer steps than there are tables, over both directions of the collapsed edges.
WALK_SQL = COLLAPSED_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT u, v, w FROM g UNION ALL SELECT v, u, w FROM g),
walk(source, node, dist, seen) AS (SELECT DISTINCT u, u, 0::DOUBLE, [u] FROM b UNION ALL SELECT source, b.v, dist + b.w, list_append(seen, b.v) FROM walk JOIN b ON b.u = walk.node WHERE NOT list_contains(seen, b.v))"""


def numbered(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[graph.Edge]]:
    """The tables by number, and the collapsed candidate edges; a row a table pair."""
    rows = [(r.u, r.v, r.weight) for r in graph.collapse(scored(spark, sf_dir)).collect()]
    names = sorted({n for u, v, _ in rows for n in (u, v)})
    place = {n: i for i, n in enumerate(names)}
    return names, [(place[u], place[v], w) for u, v, w in rows]


@query(f"{WALK_SQL} SELECT source AS table1, node AS table2, round(min(dist), 5) AS dist FROM walk GROUP BY 1, 2")
def table_distances(spark, sf_dir):
    """Shortest paths from every table: the metric closure of the candidate graph."""
    names, edges = numbered(spark, sf_dir)
    near = graph.adjacency(edges)
    rows = [(names[i], names[j], d) for i in range(len(names)) for j, d in graph.shortest_paths(near, i)[0].items()]
    return rounded(spark.createDataFrame(rows, "table1 string, table2 string, dist double"), "dist", places=5)


@query(f"{WALK_SQL} SELECT node AS \"table\", round(min(dist), 5) AS dist FROM walk WHERE source = 'region' GROUP BY 1")
def table_paths_from_region(spark, sf_dir):
    """Paths restored from the predecessors: their edges add up to the distances."""
    names, edges = numbered(spark, sf_dir)
    start, near = names.index("region"), graph.adjacency(edges)
    dist, before = graph.shortest_paths(near, start)
    paths = {n: graph.path_to(before, start, n) for n in dist}
    rows = [(names[n], float(sum(near[a][b] for a, b in zip(path, path[1:], strict=False)))) for n, path in paths.items()]
    return rounded(spark.createDataFrame(rows, "table string, dist double"), "dist", places=5)


@query(
    COLLAPSED_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) AS i FROM g), b AS (SELECT i, u, v FROM e UNION ALL SELECT i, v, u FROM e),
r(i, node) AS (SELECT i, u FROM e UNION SELECT r.i, b.v FROM r JOIN b ON b.u = r.node AND b.i < r.i)
SELECT u AS table1, v AS table2, round(w, 5) AS weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.i = e.i AND r.node = e.v)"""
)
def spanning_forest_tables(spark, sf_dir):
    """An edge is in the minimum spanning forest if no lighter edges join its ends."""
    names, edges = numbered(spark, sf_dir)
    return rounded(spark.createDataFrame([(names[u], names[v], w) for u, v, w in graph.spanning_forest(edges)], "table1 string, table2 string, weight double"), "weight", places=5)


@query(f"{COLLAPSED_SQL} SELECT u, v, round(CASE WHEN u = 'customer' AND v = 'orders' THEN 0 ELSE w END, 5)::DOUBLE AS weight FROM g WHERE NOT (u = 'nation' AND v = 'supplier')")
def edges_after_review(spark, sf_dir):
    """One edge accepted, which weighs nothing then, and one rejected."""
    edges = graph.collapse(scored(spark, sf_dir))
    sides = "u string, v string"
    return rounded(graph.accept(graph.reject(edges, spark.createDataFrame([("supplier", "nation")], sides)), spark.createDataFrame([("orders", "customer")], sides)), "weight", places=5)


#: Foreign keys as directed edges, weighted by the share of the target's keys that are never used.
ARCS_SQL = "arcs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS u, '{b}' AS v, 0.1 + 1 - count(DISTINCT {c}) / (SELECT count(*) FROM {b})::DOUBLE AS w FROM {a}" for a, c, b, _ in FOREIGN_KEYS) + ")"


def arcs(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[graph.Edge]]:
    names = sorted({t for k in FOREIGN_KEYS for t in (k[0], k[2])})
    rows = []
    for a, c, b, _ in FOREIGN_KEYS:
        used = table(spark, sf_dir, a).agg(F.count_distinct(c)).first()[0]
        rows.append((names.index(a), names.index(b), 0.1 + 1 - used / table(spark, sf_dir, b).count()))
    return names, rows


def arc_frame(spark: SparkSession, names: list[str], tree: list[graph.Edge]) -> DataFrame:
    return rounded(spark.createDataFrame([(names[u], names[v], float(w)) for u, v, w in tree], "table1 string, table2 string, weight double"), "weight")


@query(f"WITH {ARCS_SQL} SELECT u AS table1, v AS table2, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY w, u) AS r FROM arcs) WHERE r = 1")
def arborescence_from_lineitem(spark, sf_dir):
    """The directed tree of least weight from the fact table; without cycles it takes each table's lightest edge."""
    names, edges = arcs(spark, sf_dir)
    return arc_frame(spark, names, graph.arborescence(edges, names.index("lineitem")))


@query(f"WITH {ARCS_SQL} SELECT u AS table1, v AS table2, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY w, u) AS r FROM arcs) WHERE r = 1 AND w < -ln(0.88)")
def k_arborescences_tables(spark, sf_dir):
    """A table joins only where that is lighter than the weight of not joining."""
    names, edges = arcs(spark, sf_dir)
    return arc_frame(spark, names, graph.k_arborescences(edges, range(len(names)), 0.88))


@query(f"WITH {ARCS_SQL}, t AS (SELECT u, v, w FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY w, u) AS r FROM arcs) WHERE r = 1) SELECT u AS table1, v AS table2, round(w, 6) AS weight FROM t UNION ALL SELECT u, v, round(w, 6) FROM arcs WHERE exp(-w) > 0.7 AND (u, v) NOT IN (SELECT u, v FROM t)")
def recalled_edges(spark, sf_dir):
    """The tree and the probable edges outside it."""
    import math

    names, edges = arcs(spark, sf_dir)
    return arc_frame(spark, names, graph.recalled([(u, v, math.exp(-w)) for u, v, w in edges], graph.arborescence(edges, names.index("lineitem")), 0.7))


# --- features of pairs and columns ---------------------------------------------------------

SIZES_SQL = "sizes AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in dict.fromkeys(t for t, _ in KEYS)) + "), kc(t, c) AS (VALUES " + ", ".join(map(str, KEYS)) + ")"


@query(
    f"""WITH {SIZES_SQL}, p AS (SELECT a.t AS t1, a.c AS c1, x.n AS n1, b.t AS t2, b.c AS c2, y.n AS n2, y.n >= 1000 AND x.n < 1000 AS swap FROM kc a JOIN kc b ON a.t < b.t JOIN sizes x ON x.t = a.t JOIN sizes y ON y.t = b.t)
SELECT CASE WHEN swap THEN t2 ELSE t1 END AS table1, CASE WHEN swap THEN c2 ELSE c1 END AS column1, CASE WHEN swap THEN t1 ELSE t2 END AS table2, CASE WHEN swap THEN c1 ELSE c2 END AS column2,
round(greatest(n1, n2) / least(n1, n2)::DOUBLE, 6) AS row_ratio, CASE WHEN (n1 >= 1000) <> (n2 >= 1000) THEN 'N:1' ELSE '1:1' END AS join_type FROM p"""
)
def fact_oriented_pairs(spark, sf_dir):
    """Pairs turned so that the fact table is first, with the row ratio and the join type."""
    prof = profile.profiles(counted(key_lake(spark, sf_dir)), top=0)
    pairs = features.candidate_pairs(prof).select(*candidates.PAIR, "n_rows1", "n_rows2", F.lit(0.0).alias("row_ratio"))
    return rounded(features.fact_first(pairs).select(*candidates.PAIR, "row_ratio", "join_type"), "row_ratio")


RATIOS_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS distinct_ratio, round({i} / {len(cs)}.0, 6)::DOUBLE AS position, length('{c}')::INTEGER AS name_length FROM {t}"""
    for t, cs in PROFILED.items()
    for i, (c, _) in enumerate(cs)
)


@query(RATIOS_SQL)
def column_ratios(spark, sf_dir):
    """Distinct ratio, place among the columns, and name length of each column."""
    prof = profile.profile_lake({t: table(spark, sf_dir, t) for t in PROFILED}, top=0)
    return rounded(prof.select("table", "column", values.ratio(F.col("n_distinct"), F.col("n_rows")).alias("distinct_ratio"), (F.col("ordinal") / F.col("n_cols")).alias("position"), F.length("column").alias("name_length")), "distinct_ratio", "position")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f'SELECT table_name AS "table", column_name AS "column", count(*) OVER (PARTITION BY column_name) AS name_frequency FROM information_schema.columns WHERE table_name IN {TABLES}')
def column_name_frequency(spark, sf_dir):
    """How many columns of the lake have a column's name, over all tables."""
    columns = lake.catalog_columns({t: table(spark, sf_dir, t) for t in TABLES})
    return features.name_frequency(columns).select("table", "column", "name_frequency")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE round(l_extendedprice / l_discount, 4) END AS scrubbed FROM lineitem")
def scrubbed_ratio(spark, sf_dir):
    """Infinities and NaN of a division are 0."""
    x = F.col("l_extendedprice").cast("double") / F.nullif(F.col("l_discount").cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(values.finite(F.coalesce(x, F.lit(float("inf")))), 4).alias("scrubbed"))


def text_sql(t: str, c: str) -> str:
    return f"""SELECT '{t}' AS "table", '{c}' AS "column", '{t}.{c} contains ' || count(*) || ' values (' || max(length(v)) || ', ' || min(length(v)) || ', ' || printf('%.1f', sum(length(v) * n) / sum(n)::DOUBLE) || '): ' || string_agg(v, ', ' ORDER BY n DESC, v) AS text FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"""


@query(" UNION ALL ".join(text_sql(*x) for x in (("region", "r_name"), ("nation", "n_regionkey"), ("nation", "n_name"), ("orders", "o_orderstatus"), ("customer", "c_mktsegment"), ("events", "event_type"))))
def column_sentences(spark, sf_dir):
    """Columns' profiles as sentences for an encoder."""
    tables = {t: table(spark, sf_dir, t).select(*cs) for t, cs in {"region": ["r_name"], "nation": ["n_regionkey", "n_name"], "orders": ["o_orderstatus"], "customer": ["c_mktsegment"], "events": ["event_type"]}.items()}
    counts = written(profile.lake_counts(tables), "counts")
    return profile.column_text(profile.profiles(counts, top=0), profile.frequent_values(counts))


# --- reviews and metrics --------------------------------------------------------------------

EXTENT_SQL = "extent AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, min({c}) AS lo, max({c}) AS hi, avg(length({c}::VARCHAR)) AS len FROM {t}" for t, c in KEYS) + ")"


@query(
    f"""{MATRIX_SQL}, {EXTENT_SQL}, p AS (SELECT a.t AS table1, a.c AS column1, b.t AS table2, b.c AS column2, least(a.len, b.len) / greatest(a.len, b.len) AS lengths, least(a.hi, b.hi) > greatest(a.lo, b.lo) AS in_range FROM extent a JOIN extent b ON a.t < b.t)
SELECT table1, column1, table2, column2, lengths >= 0.5 AND (coalesce(max_containment, 0) > 0 OR in_range) AS is_join FROM p LEFT JOIN matrix USING (table1, column1, table2, column2)"""
)
def edge_verdicts(spark, sf_dir):
    """The lexical judge's decision on every pair of key columns."""
    counts = counted(key_lake(spark, sf_dir))
    feats = features.pair_features(counts, profile.profiles(counts, top=0))
    return judge.LexicalJudge(rank.terms).edges(feats).select(*candidates.PAIR, "is_join")


@query(f"{MATRIX_SQL} SELECT table1, column1, table2, column2, CASE WHEN overlap > 0 AND max_containment >= 0.95 THEN 'INNER' WHEN overlap > 0 THEN 'LEFT' END AS join_type FROM matrix")
def join_types(spark, sf_dir):
    kind = judge.join_type(F.col("overlap"), F.col("containment1"), F.col("containment2"), F.lit(0.0))
    return matrix(spark, sf_dir).select(*candidates.PAIR, kind.alias("join_type"))


@query(f"{SCORED_SQL} SELECT table1, table2, count(*) AS n, string_agg(column1 || '=' || column2, ' ' ORDER BY column1, column2) AS pairs FROM scored WHERE prob >= 0.01 GROUP BY 1, 2")
def specs_by_table_pair(spark, sf_dir):
    """Column pairs grouped by table pair, though every other one is stored the other way round."""
    found = scored(spark, sf_dir).where("prob >= 0.01")
    turn = F.length("column1") % 2 == 0
    turned = found.select(*[F.when(turn, F.col(f"{c}{3 - s}")).otherwise(F.col(f"{c}{s}")).alias(f"{c}{s}") for s in (1, 2) for c in ("table", "column")])
    return judge.group_specs(turned).select("table1", "table2", F.size("pairs").cast("long").alias("n"), F.array_join(F.transform("pairs", lambda p: F.concat(p["column1"], F.lit("="), p["column2"])), " ").alias("pairs"))


LABELLED_SQL = f"{SCORED_SQL}, {FK_SQL}, labelled AS (SELECT s.*, m.max_containment, CASE WHEN (s.table1, s.column1, s.table2, s.column2) IN (SELECT table1, column1, table2, column2 FROM fk) OR (s.table2, s.column2, s.table1, s.column1) IN (SELECT table1, column1, table2, column2 FROM fk) THEN 1 ELSE 0 END AS label FROM scored s JOIN matrix m USING (table1, column1, table2, column2))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = foreign_keys(spark)
    turned = good.select(*[F.col(f"{c}{3 - s}").alias(f"{c}{s}") for s in (1, 2) for c in ("table", "column")])
    known = good.unionByName(turned).withColumn("known", F.lit(1))
    rows = matrix(spark, sf_dir).withColumn("prob", F.round(F.col("max_containment") * F.col("min_containment"), 6))
    return rows.join(F.broadcast(known), candidates.PAIR, "left").withColumn("label", F.coalesce("known", F.lit(0))).drop("known")


@query(f"{LABELLED_SQL}, c AS (SELECT count(*) FILTER (prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (prob >= 0.5 AND label = 0) AS fp, count(*) FILTER (prob < 0.5 AND label = 1) AS fn FROM labelled) SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c")
def containment_as_classifier(spark, sf_dir):
    """Precision, recall and F1 at 0.5 of the product of containments, against the foreign keys."""
    return rounded(classify.evaluate(labelled(spark, sf_dir)), "precision", "recall", "f1")


@query(
    f"""{LABELLED_SQL}, s AS (SELECT avg(max_containment) AS m, CASE WHEN stddev_pop(max_containment) = 0 THEN 1 ELSE stddev_pop(max_containment) END AS d, count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1)::DOUBLE AS ratio FROM labelled)
SELECT table1, column1, table2, column2, label, round((CASE WHEN label = 1 THEN ratio ELSE 1 END) * (1 + 3 * pow((greatest(-3, least(3, (max_containment - m) / d)) + 3) / 6, 8)), 5) AS weight FROM labelled, s"""
)
def sample_weights(spark, sf_dir):
    """Class weight times overlap weight of the labelled pairs."""
    return rounded(classify.weighted(labelled(spark, sf_dir)).select(*candidates.PAIR, "label", "weight"), "weight", places=5)


@query("SELECT p_partkey AS query, p_brand AS \"table\", p_size::DOUBLE AS prob FROM part")
def score_rows_from_json(spark, sf_dir):
    """Scores stored as a map or as a list of pairs."""
    brand, size = F.to_json(F.struct(F.col("p_brand").alias("b"))), F.col("p_size").cast("string")
    name = F.regexp_extract(brand, r'^\{"b":(.*)\}$', 1)
    as_map, as_list = F.concat(F.lit("{"), name, F.lit(": "), size, F.lit("}")), F.concat(F.lit("[["), name, F.lit(", "), size, F.lit("]]"))
    return rank.score_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), F.when(F.col("p_partkey") % 2 == 0, as_map).otherwise(as_list).alias("table_scores"))).select("query", "table", "prob")


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS forward, n_name AS back FROM nation")
def name_mappings(spark, sf_dir):
    """A mapping in both directions from texts of the form a-to-b."""
    texts = table(spark, sf_dir, "nation").agg(F.collect_list(F.concat("n_name", F.lit("-to-"), F.col("n_nationkey").cast("string"))).alias("texts"))  # 25 rows
    one, two = evaluation.name_mapping(F.col("texts"))
    rows = table(spark, sf_dir, "nation").crossJoin(F.broadcast(texts.select(one.alias("one"), two.alias("two"))))
    return rows.select(F.col("n_name").alias("name"), F.element_at("one", F.col("n_name")).alias("forward"), F.element_at("two", F.col("n_nationkey").cast("string")).alias("back"))


@query("SELECT event_type AS folder, count(*) AS n, round(avg(value), 4) AS average FROM events GROUP BY 1")
def means_by_folder(spark, sf_dir):
    return rounded(evaluation.folder_means(table(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), F.col("value").alias("f1"))), "average", places=4)


NORMAL_SQL = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"WITH l AS (SELECT {NORMAL_SQL} AS k, arg_max(conv_id, conv_id * 1000 + turn) AS last_conv FROM conversations WHERE turn = 0 GROUP BY 1) SELECT conv_id, turn, last_conv FROM conversations JOIN l ON l.k = {NORMAL_SQL} WHERE turn = 0")
def labels_by_normalised_query(spark, sf_dir):
    """Queries joined with labels by their normalised text; of labels with one key the last counts."""
    turns = table(spark, sf_dir, "conversations").where("turn = 0").withColumn("query", F.col("text"))
    last = turns.select(F.col("text").alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), F.col("conv_id").alias("last_conv"))
    return rank.join_labels(turns.select("conv_id", "turn", "query"), last)[0].select("conv_id", "turn", "last_conv")


# --- mappings and intervals -------------------------------------------------------------------


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def hierarchy_by_lookups(spark, sf_dir):
    """Supplier to nation to region by a chain of lookups."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = keys.rolled_up(table(spark, sf_dir, "supplier"), [("s_nationkey", nations, "n_nationkey", ["n_name", "n_regionkey"]), ("n_regionkey", regions, "r_regionkey", ["r_name"])])
    return out.select("s_suppkey", "n_name", "r_name")


@query(
    """WITH p AS (SELECT event_type, date_trunc('month', ts)::DATE AS s, (date_trunc('month', ts) + INTERVAL 10 DAY)::DATE AS e FROM events GROUP BY ALL),
n AS (SELECT *, lead(s) OVER (PARTITION BY event_type ORDER BY s) AS nx FROM p)
SELECT event_type, 120 AS "offset", s AS valid_from, e AS valid_to FROM n UNION ALL SELECT event_type, 60, e, nx FROM n"""
)
def offset_intervals(spark, sf_dir):
    """Daylight periods and the standard time between them; here the first days of each month with events."""
    months = table(spark, sf_dir, "events").select("event_type", F.trunc(F.to_date("ts"), "month").alias("s")).distinct()
    changes = months.select("event_type", "s", F.date_add("s", 10).alias("e"), F.lit(60).alias("standard"), F.lit(120).alias("daylight"))
    return history.daylight_intervals(changes, "event_type", "s", "e", "standard", "daylight")


@query("SELECT event_type, round(median(value), 4) AS median FROM events GROUP BY 1")
def median_by_ranges(spark, sf_dir):
    """Exact medians by counts of ranges, so that no task holds a group's values."""
    return rounded(history.exact_median(table(spark, sf_dir, "events"), "event_type", "value"), "median", places=4)


@query(f"{WALK_SQL}, d AS (SELECT source, node, min(dist) AS dist FROM walk GROUP BY 1, 2) SELECT round(min(total), 5) AS total FROM (SELECT source, sum(dist) AS total FROM d WHERE node IN ('region', 'lineitem', 'part') GROUP BY 1)")
def steiner_total(spark, sf_dir):
    """Weight of the tree that joins region, lineitem and part; of three tables the best one meets in one node."""
    names, edges = numbered(spark, sf_dir)
    _, _, total = graph.steiner_tree(edges, [names.index(t) for t in ("region", "lineitem", "part")])
    return rounded(spark.createDataFrame([(float(total),)], "total double"), "total", places=5)


#: The tables' columns by family, but for nested ones.
EVERY = PROFILED | {
    "region": (("r_regionkey", "number"), ("r_name", "text")),
    "orders": (("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "time"), ("o_orderpriority", "text")),
    "lineitem": (("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")),
    "events": (("event_id", "number"), ("ts", "time"), ("user_id", "number"), ("event_type", "text"), ("value", "number"), ("props", "text")),
    "documents": (("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number")),
    "labels": (("doc_id", "number"), ("quality", "number"), ("toxic", "number")),
    "benchmark": (("item_id", "number"), ("text", "text")),
    "conversations": (("conv_id", "number"), ("turn", "number"), ("role", "text"), ("text", "text")),
    "pages": (("page_id", "number"), ("url", "text"), ("html", "text")),
}


def every_sql(t: str, c: str, i: int, n: int, kind: str) -> str:
    number = {"number": f"{c}::DOUBLE", "text": f"try_cast({c} AS DOUBLE)", "time": "NULL::DOUBLE"}[kind]
    return f"""SELECT '{t}' AS "table", '{c}' AS "column", {i} AS ordinal, {n} AS n_cols, '{kind}' AS family, count(*) AS n_rows, count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_distinct, min({number}) AS num_min, max({number}) AS num_max, {"min(length(" + c + "))::INTEGER" if kind == "text" else "NULL::INTEGER"} AS text_min, {"max(length(" + c + "))::INTEGER" if kind == "text" else "NULL::INTEGER"} AS text_max FROM {t}"""


@query(" UNION ALL ".join(every_sql(t, c, i, len(cs), kind) for t, cs in EVERY.items() for i, (c, kind) in enumerate(cs)))
def column_profile_all_tables(spark, sf_dir):
    """A profile of every column of every table."""
    found = profile.profile_lake({t: table(spark, sf_dir, t).select(*[c for c, _ in cs]) for t, cs in EVERY.items()}, top=0)
    text = F.col("family") == "text"
    return found.select("table", "column", "ordinal", "n_cols", "family", "n_rows", "n_nonnull", "n_distinct", "num_min", "num_max", F.when(text, F.col("len_min")).alias("text_min"), F.when(text, F.col("len_max")).alias("text_max"))
