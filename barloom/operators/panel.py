"""Factor frames: bars and reference data in, named factor columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.functions.windows import position
from barloom.operators.factors import REGISTRY
from barloom.operators.references import augment
from barloom.operators.registry import Inputs, Registry
from barloom.plans.compiler import evaluate
from barloom.schema import REQUIRED_BARS, canonical, require


def factor_frame(bars: DataFrame, names: list[str], registry: Registry = REGISTRY, keep: list[str] | None = None, **references: DataFrame | None) -> DataFrame:
    """``bars`` (or their ``keep`` columns), the factors in the order asked, and history_count.

    ``references`` are benchmark, fundamentals, industry and dividends; only those that a
    factor needs are read.  Rows are unordered; an empty panel gives an empty frame.
    """
    require(bars, REQUIRED_BARS, "bars")
    factors = registry.select(names)
    needs = {n for f in factors for n in f.needs}
    panel = augment(canonical(bars), needs, **references)
    offered = Inputs(frozenset(panel.columns))
    wanted = {f.name: f.build(offered) for f in factors}
    out = evaluate(panel, wanted | {"history_count": position()}, keep)
    return out.withColumn("history_count", out["history_count"].cast("long"))
