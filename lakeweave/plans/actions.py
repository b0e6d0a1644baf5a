"""Text actions of a planning agent, parsed to objects and run against a catalog.

No shell and no network: SQL, catalog look-ups, repairs and termination only.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lakeweave.sources import catalog as cat
from lakeweave.sources.lake import sample_rows

OBSERVATION_CHARACTERS = 30_000
#: Seconds an action's jobs may take.
ACTION_SECONDS = 200.0


@dataclass(frozen=True)
class Sql:
    command: str
    output: str = "direct"


@dataclass(frozen=True)
class GetTables:
    save_path: str = "direct"


@dataclass(frozen=True)
class GetTableInfo:
    table: str
    save_path: str = "direct"


@dataclass(frozen=True)
class SampleRows:
    table: str
    rows: int = 5


@dataclass(frozen=True)
class Finish:
    output: str = ""


ACTIONS = {"SQL": (Sql, ("command", "output")), "GET_TABLES": (GetTables, ("save_path",)), "GET_TABLE_INFO": (GetTableInfo, ("table", "save_path")), "SAMPLE_ROWS": (SampleRows, ("table", "rows")), "Terminate": (Finish, ("output",))}


def unquoted(text: str) -> str:
    """Without one pair of matching outer quotes."""
    text = text.strip()
    for q in ('"""', "'''", '"', "'", "`"):
        if len(text) >= 2 * len(q) and text.startswith(q) and text.endswith(q):
            return text[len(q) : -len(q)]
    return text


def parse(text: str):
    """The last action written as ``Name(field="value", ...)``; None if there is none.  A text that doesn't
    parse is tried again with its escapes resolved."""
    for attempt in (text, text.replace('\\"', '"').replace("\\n", "\n")):
        found = None
        for m in re.finditer(r"\b(" + "|".join(ACTIONS) + r")\s*\(", attempt):
            kind, names = ACTIONS[m[1]]
            values = {}
            for name in names:
                v = re.compile(rf"{name}\s*=\s*(\"\"\".*?\"\"\"|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^,)\s]+)", re.S).search(attempt, m.end())
                if v:
                    values[name] = unquoted(v[1])
            if "rows" in values:
                values["rows"] = int(values["rows"])
            try:
                found = kind(**values)
            except TypeError:  # a required field is missing
                continue
        if found is not None:
            return found
    return None


def parse_pairs(text: str) -> list[tuple[str, str]]:
    """Join pairs from a list or comma form; sides are separated by ↔, <->, -> or a dash between spaces."""
    out = []
    for part in re.split(r"[,\n]", re.sub(r"^\s*\[|\]\s*$", "", text)):
        sides = re.split(r"\s*(?:↔|<->|->)\s*|\s+-\s+", unquoted(part), maxsplit=1)
        if len(sides) == 2 and all(s.strip() for s in sides):
            out.append((unquoted(sides[0]), unquoted(sides[1])))
    return out


def true_pairs(text: str) -> list[tuple[str, str]]:
    """The join pairs of a JSON object that maps each to a verdict: those with true, as a value or a text."""
    verdicts = json.loads(text)
    return [pair for name, verdict in verdicts.items() if verdict is True or str(verdict).strip().lower() == "true" for pair in parse_pairs(name)]


def observation(text: str, most: int = OBSERVATION_CHARACTERS) -> str:
    return text if len(text) <= most else text[:most] + "\n[cut]"


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[threading.Event]:
    """Cancels the jobs begun within, by their tag, once ``seconds`` have gone; the event tells whether they had."""
    sc, tag, over, late = spark.sparkContext, f"action-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not over.wait(wait):
            late.set()
            sc.cancelJobsWithTag(tag)
            wait = 1.0  # an action may begin another job

    sc.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield late
    finally:
        over.set()
        watcher.join()
        sc.removeJobTag(tag)


def run(spark: SparkSession, action, seconds: float = ACTION_SECONDS) -> str:
    """What an action gives, as text; errors are text too, so that a planner can react, and so is an
    action's end at its time limit."""
    with time_limit(spark, seconds) as late:
        text = dispatch(spark, action)
    return f"error: stopped after {seconds:g} seconds" if late.is_set() and text.startswith("error") else text


def dispatch(spark: SparkSession, action) -> str:
    try:
        if isinstance(action, Sql):
            return observation(str(cat.run_sql(spark, action.command, action.output)))
        if isinstance(action, GetTables):
            return observation(cat.csv_text(cat.list_tables(spark)))
        if isinstance(action, GetTableInfo):
            return observation(cat.csv_text(cat.table_info(spark.table(cat.quoted(action.table)))))
        if isinstance(action, SampleRows):
            return observation("\n".join(r[0] for r in sample_rows(spark.table(cat.quoted(action.table)), action.rows).collect()))
        if isinstance(action, Finish):
            return action.output
    except Exception as e:  # the planner gets the message
        return observation(f"error: {str(e).splitlines()[0]}")
    return "error: unknown action"


@dataclass
class Loop:
    """A planner's turns: ``plan(messages)`` gives a text, its action is run, the observation goes back.

    Ends at Finish, at an action repeated twice over, after three texts without an
    action, or at the budget, which each call has for itself.  The trajectory has each turn's
    seconds of planning and of running, and the tokens (estimated by words) sent and received.
    """

    spark: SparkSession
    plan: Callable[[list[str]], str]
    budget: int = 100
    memory: int = 25
    seconds: float = ACTION_SECONDS
    trajectory: list[dict] = field(default_factory=list)

    def run(self, task: str) -> str | None:
        messages, failures, repeats, last = [task], 0, 0, None
        for _ in range(self.budget):
            asked = [messages[0], *messages[1:][-2 * self.memory :]]
            began = time.perf_counter()
            text = self.plan(asked)
            planned = time.perf_counter()
            action = parse(text)
            if action is None:
                failures += 1
                if failures >= 3:
                    return None
                messages += [text, "no action found"]
                continue
            failures = 0
            repeats = repeats + 1 if action == last else 0
            if repeats >= 2:
                return None
            last = action
            seen = run(self.spark, action, self.seconds)
            cost = {"plan_seconds": planned - began, "run_seconds": time.perf_counter() - planned, "tokens_in": sum(len(m.split()) for m in asked), "tokens_out": len(text.split())}
            self.trajectory.append({"thought": text, "action": repr(action), "observation": seen, **cost})
            if isinstance(action, Finish):
                return seen
            messages += [text, seen]
        return None

    def log(self):
        return self.spark.createDataFrame([(i, *t.values()) for i, t in enumerate(self.trajectory)], "step int, thought string, action string, observation string, plan_seconds double, run_seconds double, tokens_in int, tokens_out int")
