import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lakeweave.functions import keys, names, staging, values
from lakeweave.operators import candidates, classify, evaluation, features, graph, history, judge, overlap, profile, rank, similarity
from lakeweave.plans.joinplan import JoinEdge, components_of, join_all, plan, sql_text, tree_edges
from lakeweave.plans.repair import RepairSession
from lakeweave.sources.catalog import VersionedCatalog

DEMO = [(0, 1, 4.0), (1, 2, 8.0), (2, 3, 7.0), (3, 4, 9.0), (4, 5, 10.0), (5, 6, 2.0), (6, 7, 1.0), (7, 0, 8.0), (1, 7, 11.0), (2, 8, 2.0), (8, 6, 6.0), (2, 5, 4.0), (3, 5, 14.0), (7, 8, 7.0)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_equal_values_across_types(spark):
    ints = spark.createDataFrame([(1,), (2,), (None,)], "a bigint")
    floats = spark.createDataFrame([(1.0,), (2.5,), (float("nan"),), (1e30,)], "a double")
    texts = spark.createDataFrame([("1",), ("2",)], "a string")
    dates = spark.sql("SELECT DATE'2024-01-01' AS a")
    times = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS a")

    def of(x, y):
        return overlap.overlap_coefficient(x, "a", y, "a").first()["overlap"]

    assert of(ints, floats) == 0.5 and of(floats, ints) == 0.5
    assert of(ints, texts) == 0.0 and of(dates, times) == 0.0 and of(ints, ints) == 1.0
    assert of(ints.limit(0), ints) == 0.0
    assert [one(spark, values.plain_number(F.lit(x))) for x in (0.0, -0.0, 12345678.0, 1e-5, 1.5)] == ["0", "0", "12345678", "0.00001", "1.5"]
    assert one(spark, values.finite(F.lit(float("inf")))) == 0.0


def brute_emd(a, b):
    xs = sorted({*a, *b})
    return sum(abs(sum(x <= lo for x in a) / len(a) - sum(x <= lo for x in b) / len(b)) * (hi - lo) for lo, hi in zip(xs, xs[1:], strict=False))


@pytest.fixture(scope="module")
def tiny(spark):
    r = random.Random(1)
    return {
        "orders": spark.createDataFrame([(i, r.randint(0, 20), r.random() * 9) for i in range(60)], "order_id bigint, customer_id bigint, price double"),
        "customers": spark.createDataFrame([(i, f"name{i}", float(i % 7)) for i in range(21)], "customer_id bigint, name string, score double"),
        "empty": spark.createDataFrame([], "customer_id bigint"),
    }


def test_profiles_and_features(spark, tiny):
    counts = profile.value_counts(profile.lake_values(tiny)).persist()
    prof = profile.profiles(counts)
    rows = {(r.table, r.column): r for r in prof.collect()}
    assert rows["orders", "order_id"].n_distinct == 60 and rows["customers", "name"].len_max == 6 and ("empty", "customer_id") not in rows
    assert rows["customers", "score"].top_values[0].freq == 3
    feats = {(r.table1, r.column1, r.table2, r.column2): r for r in features.pair_features(counts, prof, profile.column_text(prof, profile.frequent_values(counts))).collect()}
    assert len(feats) == 9
    good = feats["customers", "customer_id", "orders", "customer_id"]
    assert good.containment2 == 1.0 and good.edit_ratio == 1.0 and good.token_sort_ratio == 1.0 and 0 < good.content_similarity <= 1 and good.header_jaccard == pytest.approx(0.2)
    a, b = ([v for r in tiny[t].collect() if (v := r[c]) is not None] for t, c in (("customers", "score"), ("orders", "price")))
    assert feats["customers", "score", "orders", "price"].earth_mover == pytest.approx(brute_emd(a, b))
    zero = features.pair_features(counts, prof, profile.column_text(prof, profile.frequent_values(counts)), zero_content=True)
    assert zero.agg(F.max("content_similarity")).first()[0] == 0.0
    scored = candidates.RuleScorer().score(spark.createDataFrame([r for r in feats.values()]))
    best = candidates.top_per_table_pair(scored, 1).first()
    assert (best.column1, best.column2) == ("customer_id", "customer_id")
    turned = features.fact_first(spark.createDataFrame(list(feats.values())), 50).first()
    assert turned.table1 == "orders" and turned.join_type == "N:1" and turned.row_ratio == pytest.approx(60 / 21)


def test_overlap_is_symmetric_and_bounded(tiny):
    counts = profile.value_counts(profile.lake_values(tiny)).persist()
    for r in overlap.containment(overlap.shared_values(counts), profile.profiles(counts)).collect():
        assert 0 < r.min_containment <= r.max_containment <= 1 and r.overlap == pytest.approx(r.max_containment)
        assert r.containment1 * r.n1 == pytest.approx(r.containment2 * r.n2)
    sketched = overlap.sketch_overlap(overlap.overlap_sketches(counts)).where("column1 = 'customer_id' and column2 = 'customer_id'").first()
    assert sketched["overlap"] == 1.0


def test_names(spark):
    assert one(spark, names.name_tokens(F.lit("customerID_no-2x"))) == ["customer", "id", "no", "2x"]
    assert [one(spark, names.likely_key(F.lit(n))) for n in ("id", "user_id", "country_code", "name", "idea")] == [True, True, True, False, False]
    assert one(spark, names.jaccard(F.array(), F.array())) == 0.0
    v = similarity.HashedTrigrams(64).encode(F.lit("orders"))
    assert one(spark, similarity.cosine(v, v)) == pytest.approx(1.0)


def test_classifier(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for i in range(120):
        label = i % 3 == 0
        base = [r.random() * 0.3 + 0.6 * label for _ in features.FEATURES]
        rows.append(("a", f"c{i}", "b", f"d{i}", *base, int(label), 5, 5))
    frame = spark.createDataFrame(rows, [*candidates.PAIR, *features.FEATURES, "label", "n_rows1", "n_rows2"])
    train, test = classify.split(frame)
    assert train.count() + test.count() == 120
    model = classify.JoinClassifier().fit(train)
    assert classify.evaluate(model.score(test)).first().f1 == 1.0
    model.save(str(tmp_path / "m"))
    assert classify.JoinClassifier.load(str(tmp_path / "m")).score(test).agg(F.max("prob")).first()[0] > 0.9
    assert classify.JoinClassifier().score(test).agg(F.max("prob")).first()[0] == 0.0
    assert model.score(test.withColumn("n_rows1", F.lit(0))).agg(F.max("prob")).first()[0] == 0.0


def test_negatives_exclude_joins(spark, tiny):
    prof = profile.profiles(profile.value_counts(profile.lake_values(tiny)))
    good = spark.createDataFrame([("orders", "customer_id", "customers", "customer_id")], candidates.PAIR)
    drawn = [tuple(r)[:4] for r in candidates.negative_pairs(prof, good).collect()]
    assert len(drawn) == 3 and all(c1 != c2 for _, c1, _, c2 in drawn)


def test_graph_solvers():
    graph_ = graph.adjacency(DEMO)
    dist, before = graph.shortest_paths(graph_, 0)
    assert dist[4] == 21 and graph.path_to(before, 0, 4) == [0, 7, 6, 5, 4] and graph.path_to(before, 0, 99) == []
    assert sum(w for _, _, w in graph.spanning_forest(DEMO)) == 37
    nodes, tree, total = graph.steiner_tree(DEMO, [0, 3, 8])
    assert {n for n, k in nodes if k == "required"} == {0, 3, 8} and total == sum(w for _, _, w in tree)
    assert graph.steiner_tree(DEMO, [2]) == ([(2, "required")], [], 0)
    apart = graph.steiner_tree([(0, 1, 1.0), (2, 3, 1.0)], [0, 1, 2, 3])
    assert len(apart[1]) == 2


def best_tree(edges, terminals, n):
    best = math.inf
    others = [v for v in range(n) if v not in terminals]
    for k in range(len(others) + 1):
        for extra in itertools.combinations(others, k):
            inside = {*terminals, *extra}
            tree = graph.spanning_forest(e for e in edges if e[0] in inside and e[1] in inside)
            if len(tree) == len(inside) - 1:
                best = min(best, sum(w for _, _, w in tree))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_steiner_is_within_twice_the_optimum(seed):
    r = random.Random(seed)
    n = 7
    edges = [(i, i + 1, r.uniform(0.1, 5)) for i in range(n - 1)] + [(*r.sample(range(n), 2), r.uniform(0.1, 5)) for _ in range(8)]
    terminals = r.sample(range(n), 3)
    nodes, tree, total = graph.steiner_tree(edges, terminals)
    assert len(tree) == len(nodes) - 1 and total <= 2 * best_tree(edges, terminals, n) + 1e-9


def brute_arborescence(edges, root, nodes):
    best = math.inf
    choices = [[e for e in edges if e[1] == v] for v in nodes if v != root]
    for pick in itertools.product(*choices):
        reach, todo = {root}, [root]
        while todo:
            u = todo.pop()
            for e in pick:
                if e[0] == u and e[1] not in reach:
                    reach.add(e[1])
                    todo.append(e[1])
        if len(reach) == len(nodes):
            best = min(best, sum(e[2] for e in pick))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_arborescence(seed):
    r = random.Random(seed)
    edges = [(u, v, round(r.uniform(0, 5), 3)) for u in range(5) for v in range(5) if u != v and (u == 0 or r.random() < 0.6)]
    got = graph.arborescence(edges, 0)
    assert sorted(e[1] for e in got) == [1, 2, 3, 4] and sum(e[2] for e in got) == pytest.approx(brute_arborescence(edges, 0, range(5)))


def test_forest_of_arborescences_and_recall():
    edges = [(0, 1, 0.1), (1, 2, 5.0), (3, 2, 0.2)]
    assert graph.k_arborescences(edges, range(4)) == [(0, 1, 0.1), (3, 2, 0.2)]
    assert len(graph.recalled([(0, 1, 0.9), (1, 3, 0.8), (2, 3, 0.5)], [(0, 1, 0.1)])) == 2


def test_review_rejects_and_excludes():
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (0, 3, 1.0), (3, 2, 1.5)]
    _, tree, total = graph.reviewed_tree(edges, [0, 2], lambda u, v: (u, v) != (1, 2))
    assert [e[:2] for e in tree] == [(0, 3), (2, 3)] and total == 2.5
    _, tree, _ = graph.reviewed_tree(edges, [0, 2], lambda u, v: True, lambda es: [(0, 1)] if (0, 1) in es else [])
    assert (0, 1) not in [e[:2] for e in tree]


def test_edge_frames(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "u string, v string, weight double")
    pick = spark.createDataFrame([("c", "b")], "u string, v string")
    assert graph.reject(edges, pick).count() == 1
    assert {(r.u, r.weight) for r in graph.accept(edges, pick).collect()} == {("a", 1.0), ("b", 0.0)}
    rows = spark.createDataFrame([("a", "x", "b", "y", 0.5), ("b", "y", "a", "z", 0.8), ("a", "x", "c", "y", 0.0)], [*candidates.PAIR, "prob"])
    assert [(r.u, r.v, round(r.weight, 4)) for r in graph.collapse(rows).collect()] == [("a", "b", round(-math.log(0.8), 4))]


def test_gain_prefix(spark):
    rows = [("q", f"t{i:02}", s) for i, s in enumerate([0.9, 0.8, 0.1, 0.7, 0.6])] + [("z", "a", 0.0), ("z", "b", -1.0)] + [("m", f"t{i:02}", 1.0) for i in range(30)]
    got = rank.gain_prefix(spark.createDataFrame(rows, "query string, table string, prob double"), ratio=0.4).groupBy("query").count()
    want = {}
    for q in "qm":
        s = sorted((r[2] for r in rows if r[0] == q), reverse=True)[:20]
        gains = [x / math.log2(i + 2) for i, x in enumerate(s)]
        want[q] = next((i for i in range(1, len(s)) if gains[i] < 0.4 * gains[0]), len(s))
    assert {r["query"]: r["count"] for r in got.collect()} == want


def test_ranking_frames(spark):
    rows = [("q", f"t{i}", i / 10) for i in range(5)]
    frame = spark.createDataFrame(rows, "query string, table string, prob double")
    assert rank.top_percent(frame).count() == 2 and rank.top_percent(frame.where("table = 't0'")).count() == 1
    assert one(spark, rank.normalised_query(F.lit("  A\n b  C "))) == "a b c"
    assert one(spark, rank.terms(F.lit("Total user_id of X"), ["tal"])) == ["total", "user_id", "of", "tal"]
    q = spark.createDataFrame([("Hello  World",), ("x" * 120,), ("none",)], "query string")
    labels = spark.createDataFrame([("hello world", 1, 0), ("HELLO world", 2, 1), ("x" * 110, 3, 2)], "query string, y int, position int")
    found, lost = rank.join_labels(q, labels)
    assert sorted(r.y for r in found.collect()) == [2, 3] and [r["query"] for r in lost.collect()] == ["none"]
    scores = spark.createDataFrame([("a", '{"t": 0.5}'), ("b", '[["u", 0.25]]')], "query string, table_scores string")
    assert sorted(tuple(r) for r in rank.score_rows(scores).collect()) == [("a", "t", 0.5), ("b", "u", 0.25)]
    pairs = spark.createDataFrame([("orders", "orders"), ("orders", "zebra")], "query string, text string")
    got = {r.text: r.prob for r in rank.pair_score(pairs).collect()}
    assert got["orders"] > 0.999 > got["zebra"]
    labelled = spark.createDataFrame([("orders of x", f"orders t{i}", 1) for i in range(6)] + [("orders of x", f"zebra{i} t", 0) for i in range(6)], "query string, text string, label int")
    probs = {r.text: r.prob for r in rank.calibrate(labelled)(pairs).collect()}
    assert probs["orders"] > 0.5 > probs["zebra"]
    nearest = similarity.top_similar(spark.createDataFrame([(1, [1.0, 0.0])], "id int, vector array<double>"), spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0])], "id int, vector array<double>"), 1)
    assert [(r["query"], r.neighbour) for r in nearest.collect()] == [(1, 2)]


def test_metrics(spark):
    a = spark.createDataFrame([("q", "x"), ("q", "y"), ("r", "z")], "query string, table string")
    b = spark.createDataFrame([("q", "x"), ("q", "w")], "query string, table string")
    got = {r["query"]: r for r in evaluation.set_metrics(a, b).collect()}
    assert got["q"].f1 == 0.5 and got["q"].false_positives == ["y"] and got["q"].false_negatives == ["w"] and got["r"].f1 is None
    edges = spark.createDataFrame([("a", "x", "b", "y")], candidates.PAIR)
    wrong = spark.createDataFrame([("b", "z", "a", "x")], candidates.PAIR)
    row = evaluation.edge_f1(wrong, edges).first()
    assert (row.tp, row.fp, row.fn) == (0, 1, 1) and evaluation.edge_recall(wrong, edges).first().recall == 1.0
    assert evaluation.edge_recall(wrong, edges.limit(0)).first().recall == 0.0
    there, back = evaluation.name_mapping(F.array(F.lit("a-to-b"), F.lit("c-to-d"), F.lit("bad")))
    assert one(spark, there) == {"a": "b", "c": "d"} and one(spark, back) == {"b": "a", "d": "c"}
    assert evaluation.folder_means(spark.createDataFrame([("f", 1.0), ("f", 0.0)], "folder string, f1 double")).first().average == 0.5


def test_judge_steps(spark):
    rows = [("find price", "orders", ["price", "id"]), ("find price", "nation", ["name"]), ("zzz", "orders", ["price"]), ("zzz", "nation", ["name"])]
    frame = spark.createDataFrame(rows, "query string, table string, columns array<string>")
    reviewer = judge.LexicalJudge(lambda q: rank.terms(q), add_terms=1)
    kept = judge.keep_step(frame, reviewer)
    assert sorted(map(tuple, kept.collect())) == [("find price", "orders"), ("zzz", "nation"), ("zzz", "orders")]
    named = spark.createDataFrame([("find price", "nation")], "query string, table string")
    assert ("find price", "nation") in [tuple(r) for r in judge.keep_step(frame, reviewer, named).collect()]
    assert judge.supplement_step(named, frame, reviewer).where("query = 'find price'").count() == 2
    specs = spark.createDataFrame([("b", "x", "a", "y"), ("a", "y", "b", "x")], candidates.PAIR)
    assert [tuple(p) for p in judge.group_specs(specs).first().pairs] == [("y", "x")]
    same = judge.same_entity(specs, {"x": "e"}, {"y": "e"})
    assert sorted(r.same for r in same.collect()) == [False, True]
    ordinal = spark.createDataFrame([("t", f"c{i}_id", i) for i in range(12)] + [("t", "name", 20)], "table string, column string, ordinal int")
    assert len(judge.likely_keys(ordinal).first()["keys"]) == 10


def test_join_plan(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "id bigint, b_id bigint")
    b = spark.createDataFrame([("10", 5), ("20", 6)], "id string, c_id int")
    c = spark.createDataFrame([(5, 1), (6, 9)], "id bigint, a_id bigint")
    edges = [JoinEdge("a", "b", (("b_id", "id"),)), JoinEdge("b", "c", (("c_id", "id"),)), JoinEdge("a", "c", (("id", "a_id"),))]
    tables = {"a": a.withColumn("b_id", F.col("b_id").cast("string")), "b": b, "c": c}
    rows = join_all(tables, edges).collect()
    assert len(rows) == 1 and rows[0]["a__id"] == 1 and rows[0]["c__id"] == 5
    assert len(plan(edges)[2].on) == 2 and "CAST(t1.`b_id` AS STRING) = CAST(t2.`id` AS STRING)" in sql_text(edges)
    with pytest.raises(ValueError, match="not connected"):
        plan([JoinEdge("a", "b", (("x", "y"),)), JoinEdge("c", "d", (("x", "y"),))])
    assert components_of([JoinEdge("a", "b", ()), JoinEdge("c", "d", ())]) == [["a", "b"], ["c", "d"]]
    assert {frozenset((e.left, e.right)) for e in tree_edges([("a", "x", "b", "y", 0.9), ("b", "y", "c", "z", 0.8), ("a", "q", "c", "z", 0.1)], ["a", "c"])} == {frozenset("ab"), frozenset("bc")}
    left = join_all({"a": tables["a"], "b": b.where("id = '10'")}, [JoinEdge("b", "a", (("id", "b_id"),), "right")], start="a")
    assert left.count() == 2


def test_repairs_are_versions(spark):
    dirty = spark.createDataFrame([("K-001",), ("K-002",)], "k string")
    clean = spark.createDataFrame([("1",), ("2",)], "k string")
    s = RepairSession(VersionedCatalog(spark, {"dirty": dirty, "clean": clean}))
    worse = ("upper", "dirty", lambda df: {"k": keys.cased(F.col("k"), "upper")})
    good = ("digits", "dirty", lambda df: {"k": keys.without_zeros(keys.split_prefix(F.col("k"), "[A-Z]-")[0])})
    assert s.validate("dirty", "k", "clean", "k", [worse, good]) == 1.0
    assert [(r.op, r.kept) for r in s.log_frame().collect()] == [("upper", False), ("digits", True)]
    assert s.catalog.latest("dirty") == "dirty_1" and s.catalog.frames["dirty"].first().k == "K-001"
    assert s.validate("dirty", "k", "clean", "k", [worse]) == 1.0 and len(s.log) == 2


def test_key_functions(spark):
    assert one(spark, keys.trimmed(F.lit("  #a b!"))) == "a b"
    rest, suffix = keys.split_suffix(F.lit("12kg"), "[a-z]+")
    assert (one(spark, rest), one(spark, suffix)) == ("12", "kg")
    assert one(spark, keys.in_unit(F.lit("2.5 KG"), {"kg": 1000.0})) == 2500.0 and one(spark, keys.in_unit(F.lit("2 x"), {"kg": 1.0})) is None
    assert [str(one(spark, keys.any_date(F.lit(t)))) for t in ("2024-02-01", "01.02.2024", "02/01/2024", "20240201")] == ["2024-02-01"] * 4
    assert one(spark, keys.any_date(F.lit("x"))) is None and one(spark, keys.without_zeros(F.lit("000"))) == "0"
    assert one(spark, keys.mapped(F.lit("z"), {"a": "b"}, keep=False)) is None and one(spark, keys.aligned(F.lit("x"), "int")) is None


def test_staging_functions(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False)], "id int, gone boolean")
    assert staging.live(df, "gone").count() == 2
    assert one(spark, staging.first_of_list(F.lit("[a, b]"))) == "a" and one(spark, staging.first_of_list(F.lit("[]"))) is None
    parts = staging.url_parts(F.lit("https://h.org/p/q?utm_source=s&x=1#f"))
    assert [one(spark, parts[k]) for k in ("base_url", "url_host", "url_path", "utm_source", "utm_term")] == ["https://h.org/p/q", "h.org", "/p/q", "s", None]
    assert one(spark, staging.url_parts(F.lit("no url"))["base_url"]) == "no url"
    assert one(spark, staging.surrogate_key(F.lit("a"), F.lit(None), F.lit("b"))) == one(spark, F.md5(F.lit("a--b")))
    assert one(spark, staging.click_through(F.lit(200), F.lit(9900))) == 0 and one(spark, staging.click_through(F.lit(1), F.lit(0))) is None
    assert one(spark, staging.flag(F.lit("f"))) is False and one(spark, staging.flag(F.lit(1))) is True and one(spark, staging.flag(F.lit("x"))) is None
    assert one(spark, staging.email_domain(F.lit("a@b.c"))) == "b.c"


def test_daylight_intervals(spark):
    rows = [("z", "2024-03-31", "2024-10-27", 60, 120), ("z", "2025-03-30", "2025-10-26", 60, 120)]
    frame = spark.createDataFrame(rows, "time_zone string, daylight_start string, daylight_end string, standard_offset int, daylight_offset int")
    got = [(r.offset, r.valid_from, r.valid_to) for r in history.daylight_intervals(frame).orderBy("valid_from").collect()]
    assert got == [(120, "2024-03-31", "2024-10-27"), (60, "2024-10-27", "2025-03-30"), (120, "2025-03-30", "2025-10-26"), (60, "2025-10-26", None)]


def test_stream_profile(spark, tmp_path):
    from lakeweave.streaming.profile import stream_profile, windowed_counts

    rows = spark.sql("SELECT id, cast(id % 3 AS string) AS k, timestamp_seconds(id * 600) AS at FROM range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_profile("t", stream).writeStream.outputMode("complete").format("memory").queryName("prof").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.column: (r.n_rows, r.n_distinct) for r in spark.table("prof").collect()}["k"] == (30, 3)
    q = windowed_counts(stream, "at", ["k"]).writeStream.outputMode("append").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] > 0


def test_bucketed_error_intervals_against_brute_force(spark, small):
    from datetime import timedelta

    from lakeweave import queries

    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "event_type", "ts").collect()
    errors = [(e.event_id, e.ts, e.ts + timedelta(minutes=90)) for e in events if e.event_type == "error"]
    want = sorted((e.event_id, k) for e in events for k, f, t in errors if f <= e.ts < t)
    assert len(errors) > len([e for e in events if e.event_id % 97 == 0])
    assert sorted(map(tuple, queries.QUERIES["bucketed_error_intervals"](spark, small).collect())) == want


def test_error_intervals_meet_few_events_in_vain(spark, small, monkeypatch):
    """The rows that meet in a bucket are few more than the results; with buckets of a day they were 16 times as many."""
    from lakeweave import queries

    given = {}
    join = history.bucketed_interval_join
    monkeypatch.setattr(history, "bucketed_interval_join", lambda *a, **k: given.update(k) or join(*a, **k))
    n = queries.QUERIES["bucketed_error_intervals"](spark, small).count()
    size = given.get("seconds", 86_400)
    met = spark.read.parquet(f"{small}/events.parquet").selectExpr("event_type = 'error' AS e", f"floor(unix_seconds(ts::timestamp) / {size}) AS b", f"floor((unix_seconds(ts::timestamp) + 5400) / {size}) AS last")
    at = met.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    met = met.where("e").select(F.explode(F.sequence("b", "last")).alias("b")).join(at, "b").agg(F.sum("n")).first()[0]
    assert n <= met < 1.5 * n


def test_bucketed_interval_join_by_blocks(spark, monkeypatch):
    """Blocks and runs that are cut anywhere give what each pair looked at gives: open, empty, reversed and long intervals, null and old times."""
    from datetime import datetime, timedelta

    monkeypatch.setattr(history, "BLOCK_ROWS", 3, raising=False)
    monkeypatch.setattr(history, "BUCKETS_DEALT", 2, raising=False)
    r, zero = random.Random(4), datetime(1969, 12, 31, 23)
    at = lambda s: zero + timedelta(seconds=s)
    points = [(k, at(r.choice([60 * r.randint(0, 120), r.randint(0, 7200)]))) for k in range(120)] + [(200, None), (201, at(600)), (201, at(600))]
    spans = [(k, at(f := 60 * r.randint(0, 120)), None if k % 9 == 0 else at(f + r.choice([0, -300, 1, 600, 5400, 90_000]))) for k in range(40)] + [(90, None, at(600)), (91, None, None)]
    until = at(6000)
    want = [(p, k) for p, t in points for k, f, e in spans if t and f and f <= t < (e or until)]
    left, right = spark.createDataFrame(points, "point long, t timestamp_ntz"), spark.createDataFrame(spans, "span long, f timestamp_ntz, e timestamp_ntz")
    for seconds in (60, 600, 86_400):
        got = history.bucketed_interval_join(left, "t", right, "f", "e", F.lit(until).cast("timestamp_ntz"), seconds=seconds)
        assert got.columns == ["point", "t", "span", "f", "e"]
        assert sorted((x.point, x.span) for x in got.collect()) == sorted(want)
    assert got.union(got).count() == 2 * len(want)


def test_error_intervals_are_written_small(spark, tmp_path):
    """Files of the pairs take a third of a byte a pair at most; pairs in the order of buckets took over a byte."""
    from lakeweave import queries

    spark.sql("SELECT id AS event_id, timestamp_micros(id * 7919000000 % 36000000000 + id)::timestamp_ntz AS ts, if(id % 5 = 0, 'error', 'view') AS event_type FROM range(9000)").write.parquet(str(tmp_path / "events.parquet"))
    queries.QUERIES["bucketed_error_intervals"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    pairs = spark.read.parquet(str(tmp_path / "out"))
    n = pairs.count()
    assert n == pairs.distinct().count() > 2_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n / 3


def test_native_counts_equal_melted_ones(spark, tiny):
    """A column at a time or all cells melted: the same counts, over odd types and values too."""
    odd = spark.sql("""SELECT * FROM VALUES (1.50BD, 1.5D, true, DATE'2024-01-01', array(1, 2), 'x'), (2.00BD, double('NaN'), false, NULL, array(1, 2), repeat('long', 100)), (NULL, -0.0D, NULL, DATE'2024-01-01', NULL, 'x'), (NULL, 1.5D + 4e-14D, NULL, NULL, NULL, 'y'),
        (1.50BD, 0.0D, true, NULL, NULL, NULL) AS t(d, f, b, day, list, s)""")
    lake = {**tiny, "odd": odd}
    keys_ = ("table", "column", "ordinal", "n_cols", "family", "value")
    merged = lambda df: {tuple(r[k] for k in keys_): (r.freq, r.length) for r in df.groupBy(*keys_).agg(F.sum("freq").alias("freq"), F.max("length").alias("length")).collect()}
    assert merged(profile.lake_counts(lake)) == merged(profile.value_counts(profile.lake_values(lake)))
    near = lambda v: round(v, 9) if isinstance(v, float) else v  # texts have 12 decimals
    profiled = lambda counts: sorted(str([near(v) for v in r]) for r in profile.profiles(counts, top=0).collect())
    assert profiled(profile.lake_counts(lake)) == profiled(profile.value_counts(profile.lake_values(lake)))


@pytest.mark.parametrize("bits", [512, 10])
def test_shared_values_of_wide_lakes(spark, monkeypatch, bits):
    """More columns than one number has bits, or than bits are kept for."""
    monkeypatch.setattr(overlap, "MOST_BITS", bits)
    r = random.Random(bits)
    sets = {(f"t{t:02}", f"c{c}"): {r.randint(0, 30) for _ in range(4)} for t in range(24) for c in range(3)}
    rows = {t: spark.createDataFrame(list(itertools.zip_longest(*[sorted(sets[f"t{t:02}", f"c{c}"]) for c in range(3)])), "c0 int, c1 int, c2 int") for t in range(24)}
    counts = profile.lake_counts({f"t{t:02}": df for t, df in rows.items()})
    got = {(x.table1, x.column1, x.table2, x.column2): x.shared for x in overlap.shared_values(counts).collect()}
    want = {(*a, *b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if a[0] != b[0] and sets[a] & sets[b]}
    assert got == want


def test_distances_in_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(overlap, "WIDE", 4)
    monkeypatch.setattr(overlap, "RANGE_ROWS", 7)
    r = random.Random(5)
    data = {f"t{t}": [(float(r.randint(0, 40)), r.gauss(20, 9) if t % 2 else None) for _ in range(r.randint(5, 60))] for t in range(5)}
    lake = {t: spark.createDataFrame(rows, "a double, b double") for t, rows in data.items()}
    counts = profile.lake_counts(lake)
    pairs = features.candidate_pairs(profile.profiles(counts, top=0))
    got = {(x.table1, x.column1, x.table2, x.column2): x.emd for x in overlap.earth_mover(counts, pairs).collect()}
    values_of = {(t, c): [row[i] for row in rows if row[i] is not None] for t, rows in data.items() for i, c in enumerate("ab")}
    for a, b in itertools.combinations(sorted(values_of), 2):
        if a[0] != b[0] and values_of[a] and values_of[b]:
            assert got.pop((*a, *b)) == pytest.approx(brute_emd(values_of[a], values_of[b]))
    assert not got


def test_exact_median(spark):
    import statistics

    r = random.Random(2)
    rows = [(g, float(r.choice([r.randint(0, 5), r.random() * 100]))) for g in "abc" for _ in range(r.randint(1, 90))] + [("d", 1.0), ("d", 2.0), ("e", None), (None, 3.0)]
    got = {x.g: x.median for x in history.exact_median(spark.createDataFrame(rows, "g string, v double"), "g", "v", ranges=9).collect()}
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got == {g: pytest.approx(statistics.median(v)) for g, v in want.items()}
    assert history.exact_median(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def test_lookup_chain_multiplies_no_row(spark):
    cities = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "city string, land int")
    lands = spark.createDataFrame([(1, "x"), (1, "y")], "id int, name string")
    got = keys.rolled_up(spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "i int, c string"), [("c", cities, "city", ["land"]), ("land", lands, "id", ["name"])])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, "x"), (2, "b", 2, None), (3, None, None, None), (4, "z", None, None)]


def test_models_by_join_type_and_validation(spark):
    r = random.Random(3)
    rows = []
    for i in range(240):
        label, many = i % 4 == 0, i % 3 == 0
        row = {f: r.random() * 0.2 for f in features.FEATURES}
        row["max_containment"] = r.uniform(0.7, 1.0) if label else r.uniform(0.0, 0.4)
        rows.append({"table1": f"t{i}", "column1": "a", "table2": f"u{i}", "column2": "b", "label": int(label), "join_type": "N:1" if many else "1:1", **row})
    samples = spark.createDataFrame(rows)
    train, rest = classify.split(samples)
    assert train.count() + rest.count() == 240 and 20 < rest.count() < 80
    model, kind, f1 = classify.best_f1_model(train, rest)
    assert kind == "logistic" and f1 > 0.95
    parts = {k: classify.JoinClassifier().fit(train.where(F.col("join_type") == k)) for k in ("N:1", "1:1")}
    both = classify.DualClassifier(parts["N:1"], parts["1:1"]).score(rest)
    assert both.count() == rest.count() and classify.evaluate(both).first().f1 > 0.95
    crossed = classify.cross_scored(samples)
    assert crossed.count() == 240 and classify.evaluate(crossed).first().f1 > 0.95


def test_written_frames_are_made_by_small_tasks(spark, monkeypatch):
    from lakeweave.sources import shared

    monkeypatch.setattr(shared, "TASK_BYTES", 1 << 20, raising=False)
    keys_ = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = [spark.conf.get(k, None) for k in keys_]
    numbers = shared.written(spark.range(2_000_000).select(F.xxhash64("id").alias("x")).groupBy("x").count(), "numbers")
    again = shared.written(numbers.groupBy("x").count(), "again")
    for made in (numbers, again):
        rows = [r["count"] for r in made.groupBy(F.input_file_name()).count().collect()]
        assert sum(rows) == 2_000_000 and max(rows) < 250_000  # of 500_000 at the session's four partitions
    assert [spark.conf.get(k, None) for k in keys_] == before


@pytest.mark.parametrize("text", [False, True])
def test_top_similar_against_all_pairs(spark, monkeypatch, text):
    """Copies, ties, NaN, zeros, nulls and vectors of other lengths, in several blocks and batches, without a nested loop."""
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 5)
    r = random.Random(8)
    odd = [None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 2.0], [1.0, 2.0], [float("inf"), 1.0, 1.0], [1.0, None, 2.0]]
    near = [[r.gauss(0, 1) for _ in range(3)] for _ in range(12)]
    rows = [(str(i) if text else i, odd[i % 7] if i % 9 == 0 else [r.choice((1.0, 0.1, 3.0)) * x for x in r.choice(near)] if i % 2 else r.choice(near)) for i in range(160)] + [(None, near[0])]
    vectors = spark.createDataFrame(rows, f"id {'string' if text else 'long'}, vector array<double>")
    queries = vectors.where("id % 11 = 0")
    a, b = queries.selectExpr("id AS query", "vector AS x"), vectors.selectExpr("id AS neighbour", "vector AS y")
    pairs = a.join(b, F.expr("query <> neighbour")).select("query", "neighbour", similarity.dot(similarity.unit(F.col("x")), similarity.unit(F.col("y"))).alias("cosine"))
    pairs.createOrReplaceTempView("every_pair")
    want = spark.sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM every_pair) WHERE rank <= 4")
    got = similarity.top_similar(queries, vectors, 4)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    found = similarity.Nearest([1, 2], [[1.0], None], 2)
    found.AT_ONCE = found.KEPT = 3
    found.add(list(range(9, -1, -1)), [[1.0], [-1.0]] * 5)
    assert sorted(zip(*found.best(), strict=True), key=str) == [(1, 3, 1.0), (1, 5, 1.0), (2, 0, None), (2, 1, None)]
    assert similarity.top_similar(queries.where("false"), vectors, 4).count() == 0 == similarity.top_similar(queries, vectors.where("false"), 4).count()
