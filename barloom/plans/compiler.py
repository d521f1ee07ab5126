"""Stage compiler: expression nodes to one select per window depth."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import Node
from barloom.schema import finite


def _column(n: Node, done: dict[str, str]) -> Column:
    """The node's expression over columns that exist; equal nodes were emitted once."""
    if n.key in done:
        return F.col(done[n.key])
    return n.build(*(_column(x, done) for x in n.inputs))


def _all(nodes: Iterable[Node]) -> dict[str, Node]:
    found: dict[str, Node] = {}
    todo = list(nodes)
    while todo:
        n = todo.pop()
        if n.key not in found:
            found[n.key] = n
            todo.extend(n.inputs)
    return found


def _read(roots: Iterable[Node], done: set[str]) -> set[str]:
    """Which finished nodes the roots still read."""
    found, todo = set(), list(roots)
    while todo:
        n = todo.pop()
        if n.key in done:
            found.add(n.key)
        else:
            todo.extend(n.inputs)
    return found


def _shared(roots: Iterable[Node], done: set[str]) -> list[list[Node]]:
    """Scalars that the roots read more than once, level by level, so that each is computed once."""
    uses: dict[str, int] = {}
    nodes: dict[str, Node] = {}
    todo = [n for n in {n.key: n for n in roots}.values()]
    while todo:
        n = todo.pop()
        if n.key in done or not n.inputs:
            continue
        uses[n.key] = uses.get(n.key, 0) + 1
        if n.key not in nodes:
            nodes[n.key] = n
            todo.extend(n.inputs)
    level: dict[str, int] = {}

    def of(n: Node) -> int:
        """Levels of shared scalars at and below a node."""
        if n.key not in nodes:
            return 0
        if n.key not in level:
            level[n.key] = max((of(x) for x in n.inputs), default=0) + (uses[n.key] > 1)
        return level[n.key]

    out: dict[int, list[Node]] = {}
    for n in nodes.values():
        if uses[n.key] > 1:
            out.setdefault(of(n), []).append(n)
    return [out[k] for k in sorted(out)]


def evaluate(df: DataFrame, wanted: dict[str, Node], keep: Iterable[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` and the ``wanted`` nodes, NaN and infinities as null.

    All stages share one exchange and sort by symbol, because every window has the same
    partitioning and order.  Columns live only as long as a later stage reads them.
    """
    keep = list(df.columns if keep is None else keep)
    nodes = _all(wanted.values())
    last = max((n.depth for n in nodes.values()), default=0)
    done: dict[str, str] = {}
    at, number = df, 0

    def share(roots: list[Node]) -> None:
        nonlocal at, done, number
        for own in _shared(roots, done.keys()):
            fresh = {n.key: f"_s{number + i}" for i, n in enumerate(own)}
            number += len(own)
            at = at.select("*", *(_column(n, done).alias(fresh[n.key]) for n in own))
            done = done | fresh

    for depth in range(1, last + 1):
        own = [n for n in nodes.values() if n.window and n.depth == depth]
        share([x for n in own for x in n.inputs])
        after = [*wanted.values(), *(n for n in nodes.values() if n.window and n.depth > depth)]
        needed = _read(after, done.keys() | {n.key for n in own})
        alive = {k: c for k, c in done.items() if k in needed}
        fresh = {n.key: f"_w{depth}_{i}" for i, n in enumerate(own)}
        at = at.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(c) for c in alive.values()), *(_column(n, done).alias(fresh[n.key]) for n in own))
        done = alive | fresh
    share(list(wanted.values()))
    return at.select(*(F.col(f"`{c}`") for c in keep), *(finite(_column(n, done).cast("double")).alias(name) for name, n in wanted.items()))
