"""DuckDB SQL for panel queries, written from the formulas apart from the Spark planner."""

from __future__ import annotations

P = "over (partition by symbol order by timestamp)"


def over(w: int) -> str:
    return f"over (partition by symbol order by timestamp rows between {w - 1} preceding and current row)"


def full(agg: str, x: str, w: int) -> str:
    """``agg`` over w rows if all of them hold a value of ``x``."""
    return f"case when count({x}) {over(w)} = {w} then {agg} {over(w)} end"


def mean(x: str, w: int) -> str:
    return full(f"avg({x})", x, w)


def total(x: str, w: int) -> str:
    return full(f"sum({x})", x, w)


def std(x: str, w: int) -> str:
    return full(f"stddev_pop({x})", x, w)


def top(x: str, w: int) -> str:
    return full(f"max({x})", x, w)


def low(x: str, w: int) -> str:
    return full(f"min({x})", x, w)


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {P}"


def query(ctes: list[str], stages: list[dict[str, str]], final: dict[str, str], digits: int = 6, source: str = "bars") -> str:
    """Stages of named columns over ``source``, then rounded results by symbol and timestamp."""
    parts, at = list(ctes), source
    for i, columns in enumerate(stages):
        parts.append(f"s{i} as (select *, " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + f" from {at})")
        at = f"s{i}"
    clean = lambda e: f"case when isfinite(({e})::double) then round(({e})::double, {digits}) + 0.0 end"
    return "with " + ",\n".join(parts) + "\nselect symbol, timestamp, " + ",\n  ".join(f"{clean(e)} as \"{n}\"" for n, e in final.items()) + f"\nfrom {at}"
