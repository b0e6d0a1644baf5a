"""Typed join edges to one joined DataFrame."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.values import canonical
from lakeweave.operators.graph import spanning_forest


@dataclass(frozen=True)
class JoinEdge:
    """Equalities between two tables' columns, and how to join."""

    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    how: str = "inner"


@dataclass
class JoinStep:
    """One join: a table, how, and equalities of earlier tables' columns with its own."""

    table: str
    alias: str
    how: str
    on: list[tuple[str, str, str]] = field(default_factory=list)  # earlier table, its column, own column


FLIPPED = {"left": "right", "right": "left"}


def plan(edges: list[JoinEdge], start: str | None = None) -> list[JoinStep]:
    """Joins each table once, along a spanning tree in the edges' order; an edge that closes a cycle adds its
    equalities to the later of its tables.  Raises where the edges don't connect all tables."""
    names = list(dict.fromkeys(t for e in edges for t in (e.left, e.right)))
    if not names:
        raise ValueError("no edges")
    start = start or names[0]
    steps, have, rest = [JoinStep(start, "t1", "from")], {start}, list(edges)
    while rest:
        edge = next((e for e in rest if (e.left in have) != (e.right in have)), None)
        if edge is None:
            if any(e.left not in have for e in rest):
                raise ValueError("the tables are not connected")
            break
        rest.remove(edge)
        flip = edge.right in have
        old, new = (edge.right, edge.left) if flip else (edge.left, edge.right)
        how = FLIPPED.get(edge.how, edge.how) if flip else edge.how
        on = [(old, b, a) if flip else (old, a, b) for a, b in edge.on]
        have.add(new)
        for e in [e for e in rest if {e.left, e.right} <= have]:
            rest.remove(e)
            on += [(e.left, a, b) if e.right == new else (e.right, b, a) for a, b in e.on]
        steps.append(JoinStep(new, f"t{len(steps) + 1}", how, on))
    return steps


def join_all(tables: Mapping[str, DataFrame], edges: list[JoinEdge], start: str | None = None, as_text: bool = True) -> DataFrame:
    """The joined frame, all columns named ``table__column``.

    ``as_text`` compares canonical texts, so that keys of different types meet; equal
    types are compared as they are, which keeps statistics and bucketing usable.  The
    physical joins are left to the optimizer.
    """
    steps = plan(edges, start)

    def named(table: str) -> DataFrame:
        df = tables[table]
        return df.select(*[F.col(f"`{c}`").alias(f"{table}__{c}") for c in df.columns])

    out = named(steps[0].table)
    for step in steps[1:]:
        right, condition = named(step.table), None
        for table, a, b in step.on:
            kinds = tables[table].schema[a].dataType, tables[step.table].schema[b].dataType
            x, y = F.col(f"`{table}__{a}`"), F.col(f"`{step.table}__{b}`")
            if as_text and kinds[0] != kinds[1]:
                x, y = canonical(x, kinds[0]), canonical(y, kinds[1])
            condition = (x == y) if condition is None else condition & (x == y)
        out = out.join(right, condition, step.how)
    return out


def sql_text(edges: list[JoinEdge], start: str | None = None) -> str:
    """The same as one statement over tables of those names."""
    steps = plan(edges, start)
    alias = {s.table: s.alias for s in steps}
    lines = [f"SELECT * FROM `{steps[0].table}` AS t1"]
    for s in steps[1:]:
        on = " AND ".join(f"CAST({alias[t]}.`{a}` AS STRING) = CAST({s.alias}.`{b}` AS STRING)" for t, a, b in s.on)
        lines.append(f"{s.how.upper()} JOIN `{s.table}` AS {s.alias} ON {on}")
    return "\n".join(lines)


def tree_edges(candidates: list[tuple[str, str, str, str, float]], required: list[str]) -> list[JoinEdge]:
    """The join edges of the minimal tree over ``required`` from candidates ``(table1, column1, table2, column2, prob)``."""
    import math

    from lakeweave.operators.graph import steiner_tree

    names = sorted({t for c in candidates for t in (c[0], c[2])} | set(required))
    number = {n: i for i, n in enumerate(names)}
    best: dict[tuple[int, int], tuple[float, tuple]] = {}
    for t1, c1, t2, c2, p in candidates:
        if p <= 0:
            continue
        key = tuple(sorted((number[t1], number[t2])))
        if key not in best or (-math.log(p), (t1, c1, t2, c2)) < best[key]:
            best[key] = (-math.log(p), (t1, c1, t2, c2))
    _, tree, _ = steiner_tree([(u, v, w) for (u, v), (w, _) in best.items()], [number[t] for t in required])
    out = []
    for u, v, _ in tree:
        t1, c1, t2, c2 = best[u, v][1]
        out.append(JoinEdge(t1, t2, ((c1, c2),)))
    return out


def components_of(edges: list[JoinEdge]) -> list[list[str]]:
    """Tables that join to one another."""
    names = sorted({t for e in edges for t in (e.left, e.right)})
    number = {n: i for i, n in enumerate(names)}
    forest, groups = spanning_forest((number[e.left], number[e.right], 1.0) for e in edges), defaultdict(set)
    root = list(range(len(names)))
    for u, v, _ in forest:
        a, b = root[u], root[v]
        root = [a if r == b else r for r in root]
    for i, r in enumerate(root):
        groups[r].add(names[i])
    return [sorted(g) for g in groups.values()]
