"""Plans as text, trees and graphs; timing of runs."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from dataclasses import dataclass
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from quillon.frame import Frame


def _query_execution(f: Frame):
    return f.to_df(ordered=True)._jdf.queryExecution()


def plan(f: Frame) -> str:
    """Logical plan as built."""
    return _query_execution(f).logical().toString()


def explain(f: Frame) -> str:
    """Logical, optimised and physical plan."""
    q = _query_execution(f)
    return f"== Logical ==\n{q.analyzed().toString()}\n== Optimised ==\n{q.optimizedPlan().toString()}\n== Physical ==\n{q.executedPlan().toString()}"


def _nodes(f: Frame, optimised: bool = True) -> list[tuple[int, str]]:
    """(depth, text) of the plan's nodes, from its JSON form."""
    q = _query_execution(f)
    todo = [(0, q.optimizedPlan() if optimised else q.analyzed())]
    out = []
    while todo:
        depth, node = todo.pop()
        out.append((depth, node.simpleString(100)))
        children = node.children()
        todo += [(depth + 1, children.apply(i)) for i in reversed(range(children.size()))]
    return out


def explain_tree(f: Frame, ascii_only: bool = False) -> str:
    """Plan drawn as a tree."""
    mid, end, bar = ("|- ", "`- ", "|  ") if ascii_only else ("├─ ", "└─ ", "│  ")
    nodes = _nodes(f)
    lines = []
    for i, (depth, text) in enumerate(nodes):
        lead = ""
        for level in range(1, depth + 1):
            later = next((d for d, _ in nodes[i + 1 :] if d <= level), 0) == level
            lead += (mid if later else end) if level == depth else (bar if later else "   ")
        lines.append(lead + text)
    return "\n".join(lines)


def mermaid(f: Frame) -> str:
    """Plan as a Mermaid flowchart."""
    lines, path = ["flowchart TD"], []
    for i, (depth, text) in enumerate(_nodes(f)):
        label = text.replace('"', "'")
        lines.append(f'  n{i}["{label}"]')
        path = path[:depth]
        if path:
            lines.append(f"  n{i} --> n{path[-1]}")
        path.append(i)
    return "\n".join(lines)


def graph(f: Frame) -> str:
    """Plan as a Graphviz digraph; edges point where rows go."""
    lines, path = ["digraph plan {", "  rankdir=BT; node [shape=box];"], []
    for i, (depth, text) in enumerate(_nodes(f)):
        label = text.replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'  n{i} [label="{label}"];')
        path = path[:depth]
        if path:
            lines.append(f"  n{i} -> n{path[-1]};")
        path.append(i)
    return "\n".join([*lines, "}"])


def optimizer_passes(f: Frame) -> list[str]:
    """Rules of the optimizer that ran for this plan, with their times and numbers of runs."""
    executor = f.df.sparkSession._jvm.org.apache.spark.sql.catalyst.rules.RuleExecutor
    executor.resetMetrics()
    _query_execution(f).optimizedPlan()
    return [line for line in executor.dumpTimeSpent().split("\n") if "catalyst" in line]


@dataclass(frozen=True)
class Trace:
    """What one physical operator did: rows out and, where it counts them, its other metrics."""

    depth: int
    operator: str
    rows: int
    metrics: dict[str, int]


def traced(f: Frame) -> list[Trace]:
    """Run a frame without keeping its rows; metrics of every physical operator as it ran."""
    root = _query_execution(f).executedPlan()
    root.execute().count()
    todo, out = [(0, root)], []
    while todo:
        depth, node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append((depth, node.executedPlan()))
            continue
        metrics = {}
        entries = node.metrics().iterator()
        while entries.hasNext():
            entry = entries.next()
            metrics[entry._1()] = entry._2().value()
        inner = [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        out.append(Trace(depth, node.nodeName(), metrics.get("numOutputRows", 0), metrics))
        todo += [(depth + 1, c) for c in reversed(inner)]
    return out


def format_traces(traces: list[Trace]) -> str:
    return "\n".join(f"{'  ' * t.depth + t.operator:<60}{t.rows:>12} rows" + "".join(f"  {k}={v}" for k, v in t.metrics.items() if k != "numOutputRows" and v > 0) for t in traces)


class Profiler:
    """Wall time of named steps; the steps inside Spark are in its own metrics."""

    def __init__(self) -> None:
        self.spans: list[tuple[str, float, float]] = []

    @contextmanager
    def span(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spans.append((name, began, time.perf_counter() - began))

    def collect(self, name: str, f: Frame) -> list:
        with self.span(name):
            return f.collect()

    def report(self) -> str:
        total = sum(s for _, _, s in self.spans) or 1.0
        return "\n".join(f"{name:<24}{s * 1000:10.1f} ms {100 * s / total:5.1f} %" for name, _, s in self.spans)

    def chrome_trace(self) -> str:
        return json.dumps([{"name": n, "ph": "X", "ts": b * 1e6, "dur": s * 1e6, "pid": 0, "tid": 0} for n, b, s in self.spans])
