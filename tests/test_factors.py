"""Ported cases (X) and edge vectors (E) of FIXTURES.md for factors and window primitives."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import expr as E
from barloom.functions import windows as W
from barloom.operators import references as R
from barloom.operators.asof import asof
from barloom.operators.factors import REGISTRY, alpha158, alpha360
from barloom.operators.panel import factor_frame
from barloom.operators.registry import FAMILIES, Registry, family
from barloom.plans.compiler import evaluate

D0 = datetime(2024, 1, 1)


def bars(spark, rows, extra=()):
    """rows: (symbol, day number, open, high, low, close, volume, *extra)"""
    cols = ["symbol", "timestamp", "open", "high", "low", "close", "volume", *extra]
    data = [(r[0], D0 + timedelta(days=r[1]), *(None if x is None else float(x) for x in r[2:])) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} {'string' if c == 'symbol' else 'timestamp_ntz' if c == 'timestamp' else 'double'}" for c in cols))


def linear(n):
    return [("a", i, 10 + 0.2 * i, 10.3 + 0.2 * i, 9.8 + 0.2 * i, 10.1 + 0.2 * i, 1000 + 50 * i) for i in range(n)]


def series(spark, values, **nodes):
    df = spark.createDataFrame([("a", D0 + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], "symbol string, timestamp timestamp_ntz, x double")
    out = evaluate(df, nodes, ["timestamp"]).orderBy("timestamp").collect()
    return {k: [r[k] for r in out] for k in nodes}


X = E.column("x")


def test_registry():
    assert len(REGISTRY.listed()) == 622 and len(alpha158()) == 158 and len(alpha360()) == 360 and len(FAMILIES) == 14
    assert {f.name for f in REGISTRY.listed(tag="alpha158")} == {*alpha158(), "VOLUME0"}
    assert {f.name for f in REGISTRY.listed(tag="alpha360")} == set(alpha360())
    for names, rows in ((["OPEN59"], 59), (["MA60"], 60), (["CORD30"], 31), (["return_20", "close_location_value"], 20), (["beta_120_hs300"], 121), (["momentum_252_21"], 252), ([], 0)):
        assert REGISTRY.lookback(names) == rows
    assert REGISTRY.exact_lookback(["ivol_60_hs300"]) == 119
    for call in (lambda: REGISTRY.get("nope"), lambda: family("nope"), lambda: Registry([REGISTRY.get("MA5"), REGISTRY.get("MA5")])):
        with pytest.raises(ValueError):
            call()


def test_technical_formulas(spark):  # X5, X7
    rows = linear(70)
    p = pd.DataFrame([r[2:] for r in rows], columns=["o", "h", "l", "c", "v"])
    amount = p.v * 100 * (p.c + 0.1)
    df = bars(spark, [(*r, a) for r, a in zip(rows, amount)], ["amount"])
    names = ["stochastic_k_14", "stochastic_d_14_3", "williams_r_14", "money_flow_index_14", "upper_shadow_pct", "lower_shadow_pct", "real_body_pct", "atr_14_pct", "parkinson_volatility_20", "garman_klass_volatility_20", "OPEN0", "OPEN59", "VWAP0", "VOLUME1", "KMID", "MA5", "STD5", "IMAX5", "CORR5", "dollar_volume_20", "rsi_14"]
    out = factor_frame(df, names)
    assert out.columns == [*df.columns, *names, "history_count"]
    got = out.orderBy(F.desc("timestamp")).first()
    k = (p.c - p.l.rolling(14).min()) / (p.h.rolling(14).max() - p.l.rolling(14).min())
    tr = pd.concat([p.h - p.l, (p.h - p.c.shift()).abs(), (p.l - p.c.shift()).abs()], axis=1).max(axis=1)
    gk = (0.5 * np.log(p.h / p.l) ** 2 - (2 * math.log(2) - 1) * np.log(p.c / p.o) ** 2).clip(lower=0)
    want = {
        "stochastic_k_14": k, "stochastic_d_14_3": k.rolling(3).mean(), "williams_r_14": -100 * (1 - k), "money_flow_index_14": p.c * 0 + 100, "rsi_14": p.c * 0 + 100,
        "upper_shadow_pct": (p.h - p.c) / p.c, "lower_shadow_pct": (p.o - p.l) / p.c, "real_body_pct": (p.c - p.o) / p.o, "atr_14_pct": tr.rolling(14).mean() / p.c,
        "parkinson_volatility_20": (np.log(p.h / p.l) ** 2 / (4 * math.log(2))).rolling(20).mean() ** 0.5, "garman_klass_volatility_20": gk.rolling(20).mean() ** 0.5,
        "OPEN0": p.o / p.c, "OPEN59": p.o.shift(59) / p.c, "VWAP0": (p.c + 0.1) / p.c, "VOLUME1": p.v.shift() / p.v, "KMID": (p.c - p.o) / p.o, "MA5": p.c.rolling(5).mean() / p.c,
        "STD5": p.c.rolling(5).std(ddof=0) / p.c, "IMAX5": p.c * 0, "CORR5": p.c.rolling(5).corr(np.log(p.v + 1)), "dollar_volume_20": amount.rolling(20).mean(),
    }
    for name, s in want.items():
        assert got[name] == pytest.approx(s.iloc[-1], rel=1e-9, abs=1e-12), name
    assert got.history_count == 70


def test_downside_volatility(spark):  # X2
    r = np.array([0.01, -0.02, 0.015, -0.005, 0.0] * 5)
    c = 10 * np.cumprod(1 + r)
    df = bars(spark, [("a", i, x, x, x, x, 100, 1000 * (i + 1)) for i, x in enumerate(c)], ["amount"])
    got = factor_frame(df, ["dollar_volume_20", "downside_volatility_20"]).orderBy(F.desc("timestamp")).first()
    assert got.dollar_volume_20 == pytest.approx(np.mean([1000 * i for i in range(6, 26)]))
    assert got.downside_volatility_20 == pytest.approx(np.sqrt(np.mean(np.minimum(r[-20:], 0) ** 2)))


STATEMENT = {"total_assets": 2000, "total_liabilities": 800, "total_parent_equity": 1000, "share_capital": 100, "inventory": 200, "accounts_rece": 120, "monetary_funds": 400, "total_operate_income_ttm": 500, "operate_cost_ttm": 300, "operate_profit_ttm": 50, "parent_netprofit_ttm": 40, "netcash_operate_ttm": 60, "asset_growth": 0.1, "investment_to_assets": 0.1, "accruals": 0.1, "inventory_growth": 0.3, "receivables_growth": 0.4, "capex_growth": 0.5}


def statement(spark, values, available="2023-12-31"):
    row = spark.createDataFrame([("a", *map(float, values.values()))], "symbol string, " + ", ".join(f"{c} double" for c in values))
    return row.select("*", F.lit("2023-09-30").cast("date").alias("report_date"), F.lit(available).cast("date").alias("available_date"))


def test_fundamentals(spark):  # X1
    df = bars(spark, [("a", 1, 20, 20, 20, 20, 1)])
    want = {"cashflow_to_price": 0.03, "roa_ttm": 0.02, "gross_margin": 0.4, "operating_margin": 0.1, "cash_profitability": 0.03, "asset_turnover": 0.25, "liabilities_to_assets": 0.4, "liabilities_to_equity": 0.8, "cash_to_assets": 0.2, "inventory_to_assets": 0.1, "receivables_to_assets": 0.06, "inventory_growth": 0.3, "receivables_growth": 0.4, "capex_growth": 0.5}
    got = factor_frame(df, list(want), fundamentals=statement(spark, STATEMENT)).first()
    for name, x in want.items():
        assert got[name] == pytest.approx(x), name
    with pytest.raises(FileNotFoundError):
        factor_frame(df, ["roa_ttm"])
    with pytest.raises(ValueError, match="total_assets"):
        factor_frame(df, ["roa_ttm"], fundamentals=statement(spark, {k: v for k, v in STATEMENT.items() if k != "total_assets"}))
    late = factor_frame(df, ["roa_ttm"], fundamentals=statement(spark, STATEMENT, "2024-02-01")).first()
    assert late.roa_ttm is None


def test_dividends(spark):  # X3, E11
    df = bars(spark, [("a", 365, 20, 20, 20, 20, 1), ("b", 365, 20, 20, 20, 20, 1)])
    paid = spark.createDataFrame([("a", "2024-03-11", 1.2), ("a", "2024-09-11", 0.8), ("a", "2024-01-01", 9.0)], "symbol string, event_date string, cash_dividend_per_share double")
    optional = {k: v for k, v in STATEMENT.items() if k not in ("total_liabilities", "inventory")}
    both = statement(spark, optional)
    got = {r.symbol: r for r in factor_frame(df, ["dividend_yield_ttm", "dividend_payout_ratio_ttm"], fundamentals=both, dividends=paid).collect()}
    assert got["a"].dividend_yield_ttm == pytest.approx(0.1) and got["a"].dividend_payout_ratio_ttm == pytest.approx(5.0)
    assert got["b"].dividend_yield_ttm is None
    none = factor_frame(df, ["dividend_yield_ttm"], dividends=None).first()
    assert none.dividend_yield_ttm is None


def test_industry_momentum(spark):  # X4, E12, E13
    rows = [(s, i, *[10 * g**i] * 4, 1) for s, g in (("a", 1.005), ("b", 1.01)) for i in range(140)]
    kinds = spark.createDataFrame([("a", "2020-01-01", "x"), ("b", "2020-01-01", "x")], "symbol string, change_date string, industry_level_1 string")
    last = factor_frame(bars(spark, rows), ["industry_momentum_126_21"], industry=kinds).where("symbol = 'a'").orderBy(F.desc("timestamp")).first()
    assert last.industry_momentum_126_21 == pytest.approx(1.01**105 - 1)
    lone = R.with_peer_returns(R.with_industry(bars(spark, rows), kinds.where("symbol = 'a'"))).where("symbol = 'a'")
    assert lone.agg(F.count("industry_return_1_level_1")).first()[0] == 0
    group = R.with_peer_returns(R.with_industry(bars(spark, rows), None)).agg(F.count("industry_return_1_level_1")).first()[0]
    assert group == 278


def test_edge_vectors(spark):
    got = series(spark, [1, 2, None, 4, 8], r=W.pct_change(X), roc=W.lag(X) / X, m=W.mean(X, 2))  # E1, E2
    assert got["r"] == [None, 1, 0, 1, 1] and got["roc"] == [None, 0.5, None, None, 0.5] and got["m"] == [None, 1.5, None, None, 6]
    flat = series(spark, [3] * 6, std=W.std(X, 5), r2=W.r_squared(X, 5), c=W.corr(X, W.position(), 5), rank=W.rank_pct(X, 5), top=W.since_highest(X, 5))  # E3
    assert {k: v[-1] for k, v in flat.items()} == {"std": 0, "r2": None, "c": None, "rank": pytest.approx(0.6), "top": 4}
    assert series(spark, [3, 5, 5, 1, 2], t=W.since_highest(X, 5))["t"][-1] == 3  # E4
    assert series(spark, [2, 2, 4, 1, 0], q=W.quantile(X, 5, 0.8))["q"][-1] == pytest.approx(2.4)  # E5
    assert series(spark, [1, 2, 4], p=W.compounded(X, 3, 1))["p"] == [None, None, 5.0]


def test_random_panel_against_pandas(spark):
    rng = np.random.default_rng(0)
    rows, frames = [], []
    for s in "ab":
        c = np.round(10 + rng.normal(0, 0.4, 60).cumsum(), 1)
        c[20:31] = c[20]
        v = rng.integers(1, 9, 60).astype(float) * 100
        c = [None if i in (7, 40) else x for i, x in enumerate(c)]
        rows += [(s, i, x, None if x is None else x + 1, None if x is None else x - 1, x, y) for i, (x, y) in enumerate(zip(c, v))]
        frames.append((s, pd.DataFrame({"c": np.array(c, float), "v": v})))
    names = [f"{op}5" for op in ("ROC", "BETA", "RSQR", "RESI", "QTLU", "RANK", "IMAX", "CORR", "CNTP", "SUMP", "WVMA", "VSUMD")] + ["volatility_5", "return_3"]
    got = {(r.symbol, r.timestamp): r for r in factor_frame(bars(spark, rows), names, keep=["symbol", "timestamp"]).collect()}
    for s, p in frames:
        c, v, t = p.c, p.v, pd.Series(range(60), dtype=float)
        roll = c.rolling(5)
        beta = t.rolling(5).cov(c) / t.rolling(5).var()
        d, dv = c.diff(), v.diff()
        flat = roll.max() == roll.min()
        m = (c / c.shift() - 1).abs() * v
        r1 = c.ffill().pct_change()
        share = lambda x: x.clip(lower=0).rolling(5).sum() / (x.abs().rolling(5).sum() + 1e-12)
        want = {
            "ROC5": c.shift(5) / c, "BETA5": beta / c, "RSQR5": (t.rolling(5).corr(c) ** 2).mask(flat), "RESI5": (c - (roll.mean() + beta * 2)) / c, "QTLU5": roll.quantile(0.8) / c, "RANK5": roll.rank(pct=True),
            "IMAX5": (c + 1).rolling(5).apply(lambda x: 4 - np.argmax(x)) / 5, "CORR5": roll.corr(np.log(v + 1)).mask(flat | (v.rolling(5).max() == v.rolling(5).min())), "CNTP5": (c > c.shift()).astype(float).rolling(5).mean(),
            "SUMP5": share(d), "WVMA5": m.rolling(5).std(ddof=0) / (m.rolling(5).mean() + 1e-12), "VSUMD5": share(dv) - share(-dv), "volatility_5": r1.rolling(5).std(ddof=0), "return_3": c.ffill().pct_change(3),
        }
        for name, w in want.items():
            for i in range(60):
                x = got[s, D0 + timedelta(days=i)][name]
                assert (x is None) == bool(np.isnan(w[i])), (name, s, i, x, w[i])
                assert x is None or x == pytest.approx(w[i], abs=1e-6), (name, s, i)


def test_asof(spark):  # E10
    left = spark.createDataFrame([("a", D0 - timedelta(days=1), 1), ("a", D0, 2), ("a", D0 + timedelta(days=4), 3), ("z", D0, 4)], "symbol string, t timestamp_ntz, n int")
    right = spark.createDataFrame([("a", D0, 1), ("a", D0 + timedelta(days=2), 2), ("a", D0 + timedelta(days=2), 3), (None, D0, 9)], "symbol string, u timestamp_ntz, v int")
    assert [r.v for r in asof(left, right, "t", "u", tie=["v"]).orderBy("n").collect()] == [None, 1, 3, None]
    newer = right.unionByName(spark.createDataFrame([("a", D0 + timedelta(days=3), None)], right.schema))
    assert [r.v for r in asof(left, newer, "t", "u", tie=["v"]).orderBy("n").collect()] == [None, 1, None, None]
    with pytest.raises(ValueError):
        asof(left, right.withColumnRenamed("v", "n"), "t", "u")


def test_beta_scale_and_one_exchange(spark):  # E14
    rng = np.random.default_rng(1)
    b, r = rng.normal(0, 0.01, 40), rng.normal(0, 0.01, 40)
    r += b
    close, index = 10 * np.cumprod(1 + r), 100 * np.cumprod(1 + b)
    df = bars(spark, [("a", i, *[x] * 4, 1) for i, x in enumerate(close)])
    bench = spark.createDataFrame([(D0 + timedelta(days=i), float(x)) for i, x in enumerate(index)], "timestamp timestamp_ntz, close double")
    got = factor_frame(df, ["beta_20_hs300"], benchmark=bench).orderBy(F.desc("timestamp")).first().beta_20_hs300
    assert got == pytest.approx(20 / 19 * np.cov(r[-20:], b[-20:], ddof=0)[0, 1] / np.var(b[-20:]))
    wide = factor_frame(df, ["volatility_20", "rsi_14", "ROC60", "stochastic_d_14_3"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1


def test_empty_panel(spark):
    assert factor_frame(bars(spark, []), ["return_1", "MA5"]).count() == 0
    with pytest.raises(ValueError, match="volume"):
        factor_frame(bars(spark, []).drop("volume"), ["return_1"])
