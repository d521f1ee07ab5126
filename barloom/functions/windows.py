"""Row-window primitives per symbol, in order of time.

A window of w rows gives a value only when all w rows exist and none is null.

Whether a window is full or constant, and the moments behind beta and the fitted lines,
come from running sums over the symbol, a row's less those of w rows before: one pass for
any number of windows, whatever their length.  Values enter these sums relative to the
symbol's first one.  A difference of running sums loses the digits by which the whole sum
exceeds the window's, so against two passes over each window betas, slopes and residuals
agree to about 1e-9 of the values' scale.  Variances of levels, which lose far more, and
order statistics read their own rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.expr import Node, node, scalar, windowed

KEY, TIME = "symbol", "timestamp"


def ordered() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def rows(w: int) -> WindowSpec:
    return ordered().rowsBetween(-(w - 1), 0)


def upto() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def lag(x, k: int = 1) -> Node:
    return windowed(f"lag[{k}]", lambda a: F.lag(a, k).over(ordered()) if k else a, x) if k else node(x)


def lead(x, k: int) -> Node:
    return windowed(f"lead[{k}]", lambda a: F.lead(a, k).over(ordered()), x)


def diff(x) -> Node:
    x = node(x)
    return x - lag(x)


def padded(x) -> Node:
    """The last value that is not null."""
    return windowed("ffill", lambda a: F.last(a, ignorenulls=True).over(upto()), x)


def pct_change(x, k: int = 1) -> Node:
    f = padded(x)
    return f / lag(f, k) - 1


def running(x) -> Node:
    return windowed("cumsum", lambda a: F.sum(a).over(upto()), x)


def _since(sums: Node, w: int) -> Node:
    """What running sums gained over the last w rows."""
    return scalar(f"gained[{w}]", lambda now, then: now - F.coalesce(then, F.lit(0)), sums, lag(sums, w))


def _there(*xs) -> Node:
    """1 where every one of ``xs`` is a finite number, else 0."""

    def build(*cols: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, (F.abs(c) < F.lit(float("inf")) for c in cols)), F.lit(1)).otherwise(F.lit(0))

    return scalar("there", build, *xs)


def full(w: int, *xs) -> Node:
    """Whether each of the last w rows exists and holds a value of every ``xs``."""
    return scalar(f"full[{w}]", lambda n: n == w, _since(running(_there(*xs)), w))


def constant(x, w: int) -> Node:
    """Whether a full window holds one value only."""
    changed = scalar("changed", lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0)), x, lag(x))
    return scalar("none", lambda n: n == 0, _since(running(changed), w - 1)) if w > 1 else scalar("one", lambda a: a.isNotNull(), x)


def _if(condition: Node, x: Node) -> Node:
    return scalar("if", lambda c, a: F.when(c, a), condition, x)


def _if_not(condition: Node, x: Node) -> Node:
    return scalar("unless", lambda c, a: F.when(~c, a), condition, x)


def _rolling(name: str, w: int, agg: Callable[..., Column], *xs) -> Node:
    return _if(full(w, *xs), windowed(f"{name}[{w}]", agg, *xs))


def _relative(x, *others) -> Node:
    """``x`` less the symbol's first value, and 0 where it or any of ``others`` is missing."""
    first = windowed("first", lambda a: F.first(a, ignorenulls=True).over(upto()), x)
    return scalar("relative", lambda a, b, there: F.when(there == 1, a - b).otherwise(F.lit(0.0)), x, first, _there(x, *others))


def mean(x, w: int) -> Node:
    return _rolling("mean", w, lambda a: F.avg(a).over(rows(w)), x)


def total(x, w: int) -> Node:
    return _rolling("sum", w, lambda a: F.sum(a).over(rows(w)), x)


def std(x, w: int) -> Node:
    """Population standard deviation."""
    return _rolling("std", w, lambda a: F.stddev_pop(a).over(rows(w)), x)


def highest(x, w: int) -> Node:
    return _rolling("max", w, lambda a: F.max(a).over(rows(w)), x)


def lowest(x, w: int) -> Node:
    return _rolling("min", w, lambda a: F.min(a).over(rows(w)), x)


def quantile(x, w: int, q: float) -> Node:
    """Linear interpolation."""
    return _rolling(f"quantile{q}", w, lambda a: F.percentile(a, q).over(rows(w)), x)


def rank_pct(x, w: int) -> Node:
    """Rank of the last value in its window over w; ties share the average rank."""

    def agg(a: Column) -> Column:
        values = F.collect_list(a).over(rows(w))
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.when(v < a, 1.0).when(v == a, 0.5).otherwise(0.0)) / w + 0.5 / w

    return _rolling("rank", w, agg, x)


def since_highest(x, w: int) -> Node:
    """Rows since the first (oldest) maximum of the window."""
    return _rolling("argmax", w, lambda a: (w - F.array_position(F.collect_list(a).over(rows(w)), F.max(a).over(rows(w)))).cast("double"), x)


def since_lowest(x, w: int) -> Node:
    return _rolling("argmin", w, lambda a: (w - F.array_position(F.collect_list(a).over(rows(w)), F.min(a).over(rows(w)))).cast("double"), x)


def corr(x, y, w: int) -> Node:
    """Pearson correlation; null when a side is constant."""

    def agg(a: Column, b: Column) -> Column:
        return F.try_divide(F.covar_pop(a, b).over(rows(w)), F.stddev_pop(a).over(rows(w)) * F.stddev_pop(b).over(rows(w)))

    return _if_not(constant(x, w), _if_not(constant(y, w), _rolling("corr", w, agg, x, y)))


def _pair(x, y, w: int) -> tuple[Node, Node]:
    """w times the covariance of ``x`` and ``y`` over the window, and w times the variance of ``y``."""
    a, b = _relative(x, y), _relative(y, x)
    sa, sb = _since(running(a), w), _since(running(b), w)
    return _since(running(a * b), w) - sa * sb / w, _since(running(b * b), w) - sb * sb / w


def beta(x, y, w: int) -> Node:
    """Sample covariance over population variance of ``y``: w / (w - 1) times the usual slope."""
    together, spread = _pair(x, y, w)
    some = scalar("positive", lambda a: F.when(a > 0, a), spread)
    return _if(full(w, x, y), _if_not(constant(y, w), together / some * (w / (w - 1)))) if w > 1 else _if(full(w, x, y), node(float("nan")))


def position() -> Node:
    """Row number inside the symbol, from 1."""
    return windowed("row", lambda: F.row_number().over(ordered()))


def unexplained(x, y, w: int) -> Node:
    """What the line of ``x`` on ``y`` with slope ``beta`` leaves of ``x`` at the last row."""
    a, b = _relative(x, y), _relative(y, x)
    return (a - _since(running(a), w) / w) - beta(x, y, w) * (b - _since(running(b), w) / w)


def steady_std(x, w: int) -> Node:
    """Population standard deviation of values that scatter about one level, such as returns; 0 for a constant window."""
    a = _relative(x)
    mean_now, square = _since(running(a), w) / w, _since(running(a * a), w) / w
    spread = scalar("root_of_positive", lambda v, flat: F.when(flat, F.lit(0.0)).otherwise(F.sqrt(F.greatest(v, F.lit(0.0)))), square - mean_now * mean_now, constant(x, w))
    return _if(full(w, x), spread)


def _line(x, w: int) -> tuple[Node, Node]:
    """Slope of the least-squares line through the window, and its value at the last row less ``x``'s first one."""
    a, t = _relative(x), position()
    level = _since(running(a), w)
    # Weights from -(w - 1) / 2 up to (w - 1) / 2, by the rows' numbers.
    weighted = _since(running(a * t), w) - level * (t - (w - 1) / 2)
    steep = weighted / (w * (w * w - 1) / 12)
    return steep, level / w + steep * ((w - 1) / 2)


def slope(x, w: int) -> Node:
    return _if(full(w, x), _line(x, w)[0])


def r_squared(x, w: int) -> Node:
    """Null for a constant window."""
    steep = _line(x, w)[0]
    spread = windowed(f"var[{w}]", lambda a: F.var_pop(a).over(rows(w)), x)
    return _if(full(w, x), _if_not(constant(x, w), steep * steep * ((w * w - 1) / 12) / spread))


def residual(x, w: int) -> Node:
    return _if(full(w, x), _relative(x) - _line(x, w)[1])


def compounded(r, w: int, skip: int = 0) -> Node:
    """Product of (1 + r) over the w - skip rows that end ``skip`` rows ago, minus 1."""
    past = lag(scalar("plus1", lambda a: a + 1, r), skip)
    return _rolling("product", w - skip, lambda a: F.product(a).over(rows(w - skip)), past) - 1
