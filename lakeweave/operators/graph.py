"""Join graphs: edge collapse on Spark, and solvers for graphs of tables.

A graph's nodes are tables, so the solvers see as many edges as there are table
pairs, not rows; many graphs are solved in parallel, one a project.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators.candidates import edge_weight

Edge = tuple[int, int, float]


def collapse(candidates: DataFrame) -> DataFrame:
    """``u, v, weight``, u < v by name: the least weight of each table pair; probabilities of 0 go."""
    edges = candidates.where("prob > 0 and table1 <> table2")
    return edges.groupBy(F.least("table1", "table2").alias("u"), F.greatest("table1", "table2").alias("v")).agg(F.min(edge_weight(F.col("prob"))).alias("weight"))


def table_ids(edges: DataFrame) -> DataFrame:
    """``id, table``: tables numbered in the order of their names."""
    names = edges.select(F.col("u").alias("table")).unionByName(edges.select(F.col("v").alias("table"))).agg(F.array_sort(F.collect_set("table")).alias("t"))
    return names.select(F.posexplode("t").alias("id", "table"))


def reject(edges: DataFrame, rejected: DataFrame) -> DataFrame:
    """Without the edges of ``rejected(u, v)``, in either direction."""
    sides = rejected.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return edges.join(sides, ["u", "v"], "left_anti")


def accept(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """With weight 0 on the edges of ``accepted(u, v)``."""
    sides = accepted.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("ok", F.lit(True))
    return edges.join(sides, ["u", "v"], "left").select("u", "v", F.when(F.col("ok"), F.lit(0.0)).otherwise(F.col("weight")).alias("weight"))


def fk_once(edges: DataFrame) -> DataFrame:
    """Of the edges of a table and source column, the cheapest: a foreign key points to one table."""
    rank = F.row_number().over(Window.partitionBy("table1", "column1").orderBy("weight", "table2", "column2"))
    return edges.withColumn("_r", rank).where("_r = 1").drop("_r")


def shortest_paths_sql(source: int) -> str:
    """SQL for the distances from ``source`` over a view ``edges(u, v, weight)``, both directions, walks without
    a repeated node."""
    return f"""WITH RECURSIVE both_ways AS (SELECT u, v, weight FROM edges UNION ALL SELECT v, u, weight FROM edges),
walk(node, dist, seen) AS (
  SELECT {source}, CAST(0 AS DOUBLE), ARRAY({source})
  UNION ALL
  SELECT b.v, w.dist + b.weight, array_append(w.seen, b.v) FROM walk w JOIN both_ways b ON b.u = w.node WHERE NOT array_contains(w.seen, b.v))
SELECT node, min(dist) AS dist FROM walk GROUP BY node"""


# --- solvers on the edges of one graph -------------------------------------------------


def adjacency(edges: Iterable[Edge]) -> dict[int, dict[int, float]]:
    """Both directions of every edge, the least weight of parallel ones."""
    out: dict[int, dict[int, float]] = defaultdict(dict)
    for u, v, w in edges:
        if u != v and w < out[u].get(v, float("inf")):
            out[u][v] = out[v][u] = w
    return out


def shortest_paths(graph: dict[int, dict[int, float]], source: int) -> tuple[dict[int, float], dict[int, int]]:
    """Distances and predecessors from a node; unreachable nodes are absent."""
    settled: dict[int, float] = {}
    before: dict[int, int] = {}
    queue = [(0.0, source, source)]
    while queue:
        d, node, via = heapq.heappop(queue)
        if node in settled:
            continue
        settled[node] = d
        if node != source:
            before[node] = via
        for other, w in graph.get(node, {}).items():
            if other not in settled:
                heapq.heappush(queue, (d + w, other, node))
    return settled, before


def path_to(before: dict[int, int], source: int, target: int) -> list[int]:
    """Nodes from source to target; empty if there is no path."""
    if source == target:
        return [source]
    if target not in before:
        return []
    out = [target]
    while out[-1] != source:
        out.append(before[out[-1]])
    return out[::-1]


def spanning_forest(edges: Iterable[Edge]) -> list[Edge]:
    """The minimum spanning forest; ties by (weight, u, v)."""
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := group.setdefault(x, x)) != x:
            group[x] = x = group.setdefault(up, up)
        return x

    out = []
    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges):
        a, b = root(u), root(v)
        if a != b:
            group[a] = b
            out.append((u, v, w))
    return out


def metric_closure(graph: dict[int, dict[int, float]], terminals: list[int]) -> tuple[list[Edge], dict[int, dict[int, int]]]:
    """Distances between terminals, and each terminal's predecessors."""
    edges, before = [], {}
    for i, t in enumerate(terminals):
        dist, before[t] = shortest_paths(graph, t)
        edges += [(t, o, dist[o]) for o in terminals[i + 1 :] if o in dist]
    return edges, before


def steiner_tree(edges: Iterable[Edge], terminals: Iterable[int]) -> tuple[list[tuple[int, str]], list[Edge], float]:
    """A tree that joins the terminals, at most twice the least weight: ``nodes (id, required or steiner), edges, total``.

    The closure's spanning tree is expanded to paths, spanned again, and freed of
    leaves that nobody asked for.  Terminals that can't be joined give a forest.
    """
    graph, wanted = adjacency(edges), sorted(set(terminals))
    closure, before = metric_closure(graph, wanted)
    used: dict[tuple[int, int], float] = {}
    for u, v, _ in spanning_forest(closure):
        path = path_to(before[u], u, v)
        for a, b in zip(path, path[1:], strict=False):
            used[min(a, b), max(a, b)] = graph[a][b]
    tree = spanning_forest((a, b, w) for (a, b), w in used.items())
    while True:
        degree: dict[int, int] = defaultdict(int)
        for a, b, _ in tree:
            degree[a] += 1
            degree[b] += 1
        bare = {n for n, d in degree.items() if d == 1 and n not in wanted}
        if not bare:
            break
        tree = [e for e in tree if e[0] not in bare and e[1] not in bare]
    nodes = sorted({n for a, b, _ in tree for n in (a, b)} | set(wanted))
    return [(n, "required" if n in wanted else "steiner") for n in nodes], sorted(tree), sum(w for _, _, w in tree)


def arborescence(edges: list[Edge], root: int) -> list[Edge]:
    """The directed spanning tree of least weight from ``root`` over the nodes it reaches (contracting cycles)."""
    reach, todo = {root}, [root]
    out_of = defaultdict(list)
    for u, v, _ in edges:
        out_of[u].append(v)
    while todo:
        for v in out_of[todo.pop()]:
            if v not in reach:
                reach.add(v)
                todo.append(v)
    live = [(u, v, w, i) for i, (u, v, w) in enumerate(edges) if u in reach and v in reach and u != v and v != root]

    def solve(arcs: list[tuple[int, int, float, int]], top: int) -> set[int]:
        cheapest: dict[int, tuple[int, int, float, int]] = {}
        for arc in arcs:
            if arc[1] != top and (arc[1] not in cheapest or (arc[2], arc[3]) < (cheapest[arc[1]][2], cheapest[arc[1]][3])):
                cheapest[arc[1]] = arc
        state: dict[int, int] = {}
        cycle: list[int] = []
        for start in sorted(cheapest):
            node, trail = start, []
            while node in cheapest and node not in state:
                state[node] = start
                trail.append(node)
                node = cheapest[node][0]
            if node in cheapest and state.get(node) == start and node in trail:
                cycle = trail[trail.index(node) :]
                break
        if not cycle:
            return {arc[3] for arc in cheapest.values()}
        inside, new = set(cycle), max(max(u, v) for u, v, _, _ in arcs) + 1
        inside_target = {}
        inner = []
        for u, v, w, i in arcs:
            if u in inside and v in inside:
                continue
            if v in inside:
                inside_target[i] = v
                inner.append((u, new, w - cheapest[v][2], i))
            else:
                inner.append((new if u in inside else u, v, w, i))
        chosen = solve(inner, top)
        entered = next(inside_target[i] for i in chosen if i in inside_target)
        return chosen | {cheapest[v][3] for v in cycle if v != entered}

    return sorted(edges[i] for i in solve(live, root)) if live else []


def k_arborescences(edges: list[Edge], nodes: Iterable[int], no_join: float = 0.5) -> list[Edge]:
    """A least-weight forest of arborescences: a node joins only where that beats the weight of probability ``no_join``."""
    import math

    top = max([*nodes, *(n for u, v, _ in edges for n in (u, v))], default=0) + 1
    every = [*edges, *((top, n, -math.log(no_join)) for n in sorted(set(nodes)))]
    return [e for e in arborescence(every, top) if e[0] != top]


def recalled(edges: list[tuple[int, int, float]], tree: list[Edge], least: float = 0.7) -> list[Edge]:
    """The tree, and the edges ``(u, v, prob)`` outside it of more than ``least`` probability, as weights."""
    import math

    have = {frozenset(e[:2]) for e in tree}
    return tree + [(u, v, -math.log(p)) for u, v, p in edges if p > least and frozenset((u, v)) not in have]


def steiner_by_project(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """``project, u, v, weight``: each project's tree.  ``edges(project, u, v, weight)``, ``terminals(project, node)``.

    A group is one project's table graph, bounded by its table pairs.
    """
    import pandas as pd

    def solve(key, own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        _, tree, _ = steiner_tree(own[["u", "v", "weight"]].itertuples(index=False, name=None), wanted["node"].tolist())
        return pd.DataFrame([(key[0], int(u), int(v), float(w)) for u, v, w in tree], columns=["project", "u", "v", "weight"])

    return edges.groupBy("project").cogroup(terminals.groupBy("project")).applyInPandas(solve, "project string, u long, v long, weight double")


def reviewed_tree(edges: list[Edge], terminals: list[int], judge_edge, judge_set=None, rounds: int = 20) -> tuple[list[tuple[int, str]], list[Edge], float]:
    """Solves, has each new edge judged (rejected ones go, accepted ones weigh 0) and solves again until all
    edges are accepted; then has the whole set judged, and repeats without what that excludes."""
    weights = {(min(u, v), max(u, v)): w for u, v, w in edges}
    first, accepted = dict(weights), set()
    for _ in range(rounds):
        nodes, tree, _ = steiner_tree(((u, v, w) for (u, v), w in weights.items()), terminals)
        new = [e[:2] for e in tree if e[:2] not in accepted]
        good = {e for e in new if judge_edge(*e)}
        for e in new:
            if e in good:
                accepted.add(e)
                weights[e] = 0.0
            else:
                weights.pop(e)
        if len(good) < len(new):
            continue
        excluded = {(min(e), max(e)) for e in (judge_set([e[:2] for e in tree]) if judge_set else ())}
        if not excluded & set(weights):
            break
        for e in excluded:
            weights.pop(e, None)
    tree = [(u, v, first[u, v]) for u, v, _ in tree]
    return nodes, tree, sum(w for _, _, w in tree)
