"""Expression nodes with a window depth.

Spark allows no window function inside another within one select.  A node therefore
knows how many window stages lie below it; the stage compiler emits one select per
depth.  Nodes are keyed by what they compute, so equal sub-expressions of different
factors become one column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    key: str
    build: Callable[..., Column] = field(compare=False, repr=False)
    inputs: tuple[Node, ...] = field(default=(), compare=False, repr=False)
    window: bool = field(default=False, compare=False)

    @cached_property
    def depth(self) -> int:
        return max((n.depth for n in self.inputs), default=0) + self.window

    def __add__(self, other) -> Node:
        return _binary("+", self, other, lambda a, b: a + b)

    def __radd__(self, other) -> Node:
        return node(other) + self

    def __sub__(self, other) -> Node:
        return _binary("-", self, other, lambda a, b: a - b)

    def __rsub__(self, other) -> Node:
        return node(other) - self

    def __mul__(self, other) -> Node:
        return _binary("*", self, other, lambda a, b: a * b)

    def __rmul__(self, other) -> Node:
        return node(other) * self

    def __truediv__(self, other) -> Node:
        """Null where the divisor is 0 or null."""
        return _binary("/", self, other, F.try_divide)

    def __neg__(self) -> Node:
        return scalar("neg", lambda a: -a, self)


def node(x) -> Node:
    if isinstance(x, Node):
        return x
    return Node(repr(float(x)), lambda: F.lit(float(x)))


def column(name: str) -> Node:
    return Node(f"`{name}`", lambda: F.col(name))


def scalar(name: str, build: Callable[..., Column], *inputs) -> Node:
    inputs = tuple(node(x) for x in inputs)
    return Node(f"{name}({','.join(n.key for n in inputs)})", build, inputs)


def windowed(name: str, build: Callable[..., Column], *inputs) -> Node:
    inputs = tuple(node(x) for x in inputs)
    return Node(f"{name}({','.join(n.key for n in inputs)})", build, inputs, True)


def _binary(sign: str, a, b, build: Callable[..., Column]) -> Node:
    a, b = node(a), node(b)
    return Node(f"({a.key}{sign}{b.key})", build, (a, b))


def ln(x) -> Node:
    """Null outside the domain."""
    return scalar("ln", lambda a: F.when(a > 0, F.ln(a)), x)


def absolute(x) -> Node:
    return scalar("abs", F.abs, x)


def root(x) -> Node:
    return scalar("sqrt", F.sqrt, x)


def greatest(*xs) -> Node:
    """Skips nulls."""
    return scalar("greatest", F.greatest, *xs)


def least(*xs) -> Node:
    return scalar("least", F.least, *xs)


def at_least(x, low: float) -> Node:
    """Clip from below; null stays null."""
    return scalar(f"clip_low[{low}]", lambda a: F.when(a < low, F.lit(float(low))).otherwise(a), x)


def at_most(x, high: float) -> Node:
    return scalar(f"clip_high[{high}]", lambda a: F.when(a > high, F.lit(float(high))).otherwise(a), x)


def coalesce(*xs) -> Node:
    return scalar("coalesce", F.coalesce, *xs)


def is_greater(a, b) -> Node:
    """1 or 0; a missing side compares as false."""
    return scalar("gt", lambda x, y: F.coalesce(x > y, F.lit(False)).cast("double"), a, b)
