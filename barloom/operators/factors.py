"""The built-in factors as expression nodes."""

from __future__ import annotations

import math
from collections.abc import Callable

from barloom.functions.expr import Node, absolute, at_least, at_most, coalesce, column, greatest, is_greater, least, ln, node, root, scalar
from barloom.functions.windows import (
    beta, compounded, corr, diff, highest, lag, lowest, mean, pct_change, quantile, r_squared, rank_pct, residual, since_highest, since_lowest, slope, std, steady_std, total, unexplained,
)
from barloom.operators.registry import Factor, Inputs, Registry
from barloom.schema import LOT_SIZE

TINY = 1e-12
ROLLING_WINDOWS = (5, 10, 20, 30, 60)
KBAR = ("KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2", "KSFT", "KSFT2")
HISTORY_FIELDS = ("close", "open", "high", "low", "vwap")

O, H, L, C, V = (column(x) for x in ("open", "high", "low", "close", "volume"))
BENCHMARK = "sh000300"


def amount(i: Inputs) -> Node:
    """Traded value, from price and lots where it is missing."""
    proxy = C * V * LOT_SIZE
    return coalesce(column("amount"), proxy) if "amount" in i.columns else proxy


def typical() -> Node:
    return (H + L + C) / 3


def vwap(i: Inputs) -> Node:
    """Decided by the columns present, not row by row."""
    if "vwap" in i.columns:
        return column("vwap")
    return column("amount") / (V * LOT_SIZE) if "amount" in i.columns else typical()


def fundamental(i: Inputs, name: str) -> Node:
    if f"fund_{name}" not in i.columns:
        raise ValueError(f"factor needs fundamentals column {name}")
    return column(f"fund_{name}")


def _present(i: Inputs, name: str) -> Node:
    if name not in i.columns:
        raise ValueError(f"factor needs column {name}")
    return column(name)


# -- families of formulas; each returns a node for given parameters


def rsi(w: int) -> Node:
    d = diff(C)
    gain, loss = mean(at_least(d, 0), w), mean(at_least(-d, 0), w)
    from pyspark.sql import functions as F

    def build(g, x):
        return F.when(g.isNull() | x.isNull(), None).when(g == 0, F.lit(0.0)).when(x == 0, F.lit(100.0)).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(g, x)))

    return scalar("rsi", build, gain, loss)


def channel(w: int) -> Node:
    return (C - lowest(L, w)) / (highest(H, w) - lowest(L, w))


def money_flow(w: int) -> Node:
    from pyspark.sql import functions as F

    price = typical()
    flow, step = price * V, diff(price)
    side = lambda sign, s: scalar(f"flow{sign}", lambda f, d: F.when(f.isNull(), None).when(F.coalesce(d > 0 if s > 0 else d < 0, F.lit(False)), f).otherwise(F.lit(0.0)), flow, step)
    up, down = total(side("+", 1), w), total(side("-", -1), w)
    return scalar("mfi", lambda u, d: F.when(u.isNull() | d.isNull(), None).when(d == 0, F.lit(100.0)).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(u, d))), up, down)


def true_range() -> Node:
    previous = lag(C)
    return greatest(H - L, absolute(H - previous), absolute(L - previous))


def turnover(i: Inputs) -> Node:
    return V * LOT_SIZE / fundamental(i, "share_capital")


def _stock(i: Inputs) -> Node:
    return pct_change(C)


def market_beta(i: Inputs, w: int) -> Node:
    return beta(pct_change(C), _present(i, f"benchmark_return_1_{BENCHMARK}"), w)


def residual_volatility(i: Inputs, w: int) -> Node:
    """Deviation of r - (alpha + beta b) with both re-estimated on every row."""
    return steady_std(unexplained(pct_change(C), _present(i, f"benchmark_return_1_{BENCHMARK}"), w), w)


def price_to_rolling_low(w: int) -> Node:
    """Close over the lowest close of the window, less 1; a kind without registered factors."""
    return C / lowest(C, w) - 1


def per_share_yield(i: Inputs, name: str) -> Node:
    return fundamental(i, name) / fundamental(i, "share_capital") / C


def ratio(top: str, bottom: str) -> Callable[[Inputs], Node]:
    return lambda i: fundamental(i, top) / fundamental(i, bottom)


def gross(i: Inputs) -> Node:
    return fundamental(i, "total_operate_income_ttm") - fundamental(i, "operate_cost_ttm")


def kbar(name: str) -> Node:
    spread = at_positive(H - L) + TINY
    top, bottom = H - greatest(O, C), least(O, C) - L
    return {
        "KMID": (C - O) / O, "KLEN": (H - L) / O, "KMID2": (C - O) / spread,
        "KUP": top / O, "KUP2": top / spread, "KLOW": bottom / O, "KLOW2": bottom / spread,
        "KSFT": (C * 2 - H - L) / O, "KSFT2": (C * 2 - H - L) / spread,
    }[name]


def at_positive(x: Node) -> Node:
    """Null where 0."""
    from pyspark.sql import functions as F

    return scalar("nonzero", lambda a: F.nullif(a, F.lit(0.0)), x)


def _share(x: Node, w: int, sign: int) -> Node:
    d = diff(x)
    return total(at_least(d if sign > 0 else -d, 0), w) / (total(absolute(d), w) + TINY)


def rolling(op: str, w: int) -> Node:
    up, down = lambda: mean(is_greater(C, lag(C)), w), lambda: mean(is_greater(lag(C), C), w)
    if op == "WVMA":
        moved = absolute(C / lag(C) - 1) * V
        return std(moved, w) / (mean(moved, w) + TINY)
    return {
        "ROC": lambda: lag(C, w) / C,
        "MA": lambda: mean(C, w) / C,
        "STD": lambda: std(C, w) / C,
        "BETA": lambda: slope(C, w) / C,
        "RSQR": lambda: r_squared(C, w),
        "RESI": lambda: residual(C, w) / C,
        "MAX": lambda: highest(H, w) / C,
        "MIN": lambda: lowest(L, w) / C,
        "QTLU": lambda: quantile(C, w, 0.8) / C,
        "QTLD": lambda: quantile(C, w, 0.2) / C,
        "RANK": lambda: rank_pct(C, w),
        "RSV": lambda: channel(w),
        "IMAX": lambda: since_highest(H, w) / w,
        "IMIN": lambda: since_lowest(L, w) / w,
        "IMXD": lambda: (since_highest(H, w) - since_lowest(L, w)) / w,
        "CORR": lambda: corr(C, ln(V + 1), w),
        "CORD": lambda: corr(C / lag(C), ln(V / lag(V) + 1), w),
        "CNTP": up,
        "CNTN": down,
        "CNTD": lambda: up() - down(),
        "SUMP": lambda: _share(C, w, 1),
        "SUMN": lambda: _share(C, w, -1),
        "SUMD": lambda: _share(C, w, 1) - _share(C, w, -1),
        "VMA": lambda: mean(V, w) / (V + TINY),
        "VSTD": lambda: std(V, w) / (V + TINY),
        "VSUMP": lambda: _share(V, w, 1),
        "VSUMN": lambda: _share(V, w, -1),
        "VSUMD": lambda: _share(V, w, 1) - _share(V, w, -1),
    }[op]()


ROLLING_FAMILY = (
    dict.fromkeys(("ROC", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD"), "trend")
    | dict.fromkeys(("VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD"), "volume")
    | dict.fromkeys(("RSV", "IMAX", "IMIN", "IMXD", "RANK"), "position")
    | dict.fromkeys(("MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN", "QTLU", "QTLD", "CORR", "CORD"), "rolling_stats")
)
#: In published order.
ROLLING_OPS = ("ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN", "QTLU", "QTLD", "RANK", "RSV", "IMAX", "IMIN", "IMXD", "CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD")
_ONE_MORE = {"CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "WVMA", "VSUMP", "VSUMN", "VSUMD"}


def alpha158() -> list[str]:
    return [*KBAR, "OPEN0", "HIGH0", "LOW0", "VWAP0", *(f"{op}{w}" for op in ROLLING_OPS for w in ROLLING_WINDOWS)]


def alpha360() -> list[str]:
    return [f"{f.upper()}{k}" for f in (*HISTORY_FIELDS, "volume") for k in range(59, -1, -1)]


def _history(field: str, k: int) -> Callable[[Inputs], Node]:
    if field == "volume":
        return lambda i: lag(V, k) / (V + TINY)
    return lambda i: lag(vwap(i) if field == "vwap" else column(field), k) / C


def _built_in() -> list[Factor]:
    out: list[Factor] = []

    def add(name, family, kind, build, lookback=0, needs=(), tags=(), exact=None):
        out.append(Factor(name, family, kind, build, lookback, frozenset(needs), tuple(tags), exact))

    def each(pattern, windows, family, kind, build, more=0, needs=(), tags=()):
        for w in windows:
            add(pattern.format(w), family, kind, (lambda i, w=w: build(i, w)), w + more, needs, tags)

    each("return_{}", (1, 3, 5, 10, 20, 60, 120), "trend", "return", lambda i, w: pct_change(C, w), tags=("price_only", "trend"))
    each("close_to_sma_{}", (5, 10, 20, 60, 120), "trend", "sma_distance", lambda i, w: C / mean(C, w) - 1, tags=("price_only", "trend"))
    each("volatility_{}", (5, 10, 20, 60), "volatility", "volatility", lambda i, w: std(pct_change(C), w), 1, tags=("risk",))
    each("volume_ratio_{}", (5, 20, 60), "volume", "volume_ratio", lambda i, w: V / mean(V, w) - 1, tags=("volume",))
    for s, w in ((5, 20), (10, 60)):
        add(f"volume_trend_{s}_{w}", "volume", "volume_trend", lambda i, s=s, w=w: mean(V, s) / mean(V, w) - 1, w, tags=("volume", "trend"))
    for w in (63, 126, 252):
        add(f"momentum_{w}_21", "trend", "momentum_skip", lambda i, w=w: lag(C, 21) / lag(C, w) - 1, w, tags=("price_only", "trend", "momentum"))
        add(f"industry_momentum_{w}_21", "trend", "industry_momentum_skip", lambda i, w=w: compounded(_present(i, "industry_return_1_level_1"), w, 21), w, ("industry",), ("industry", "trend", "momentum"))
    for name, w in (("price_to_26w_high", 126), ("price_to_52w_high", 252)):
        add(name, "trend", "price_to_rolling_high", lambda i, w=w: C / highest(C, w) - 1, w, tags=("price_only", "trend", "breakout"))
    each("short_term_reversal_{}", (5, 20), "trend", "short_term_reversal", lambda i, w: -pct_change(C, w), tags=("price_only", "trend"))
    each("channel_position_{}", (10, 20, 60), "position", "channel_position", lambda i, w: channel(w), tags=("range", "position"))
    each("distance_to_high_{}", (10, 20, 60), "position", "distance_to_high", lambda i, w: C / highest(H, w) - 1, tags=("range", "breakout"))
    each("distance_to_low_{}", (10, 20, 60), "position", "distance_to_low", lambda i, w: C / lowest(L, w) - 1, tags=("range", "reversion"))
    add("rsi_14", "oscillator", "rsi", lambda i: rsi(14), 15, tags=("oscillator",))
    add("bollinger_zscore_20", "oscillator", "bollinger_zscore", lambda i: (C - mean(C, 20)) / std(C, 20), 20, tags=("oscillator",))
    add("stochastic_k_14", "oscillator", "stochastic_k", lambda i: channel(14), 14, tags=("oscillator", "range"))
    add("stochastic_d_14_3", "oscillator", "stochastic_d", lambda i: mean(channel(14), 3), 16, tags=("oscillator", "range"))
    add("williams_r_14", "oscillator", "williams_r", lambda i: (highest(H, 14) - C) / (highest(H, 14) - lowest(L, 14)) * -100, 14, tags=("oscillator", "range"))
    add("money_flow_index_14", "oscillator", "money_flow_index", lambda i: money_flow(14), 15, tags=("oscillator", "volume"))
    shapes = {
        "intraday_range_pct": (H - L) / C, "open_to_close_pct": (C - O) / O, "close_location_value": (C - L) / (H - L), "high_to_close_pct": H / C - 1,
        "low_to_close_pct": L / C - 1, "upper_shadow_pct": (H - greatest(O, C)) / C, "lower_shadow_pct": (least(O, C) - L) / C, "real_body_pct": absolute(C - O) / O,
    }
    for name, n in shapes.items():
        add(name, "bar_shape", name, lambda i, n=n: n, tags=("bar_shape",))
    add("overnight_gap_pct", "bar_shape", "overnight_gap_pct", lambda i: O / lag(C) - 1, 1, tags=("bar_shape",))
    each("beta_{}_hs300", (20, 60, 120, 252), "market", "beta", market_beta, 1, ("benchmark",), ("benchmark", "risk"))
    for w in (20, 60, 120):
        add(f"ivol_{w}_hs300", "market", "idiosyncratic_volatility", lambda i, w=w: residual_volatility(i, w), w + 1, ("benchmark",), ("benchmark", "risk"), 2 * w - 1)
    each("amihud_illiquidity_{}", (5, 20, 60), "liquidity", "amihud", lambda i, w: mean(absolute(pct_change(C)) / amount(i), w), 1, tags=("liquidity",))
    each("turnover_{}", (5, 20, 60), "liquidity", "turnover", lambda i, w: mean(turnover(i), w), 0, ("fundamentals",), ("liquidity", "turnover"))
    each("abnormal_turnover_{}", (5, 20, 60), "liquidity", "abnormal_turnover", lambda i, w: turnover(i) / mean(turnover(i), w) - 1, 0, ("fundamentals",), ("liquidity", "turnover"))
    each("dollar_volume_{}", (5, 20, 60), "liquidity", "dollar_volume", lambda i, w: mean(amount(i), w), tags=("liquidity",))

    def statement(name, family, build, needs=("fundamentals",)):
        add(name, family, name, build, 0, needs, (family,))

    statement("log_total_mkt_cap", "valuation", lambda i: ln(C * fundamental(i, "share_capital")))
    for name, source in (("book_to_market", "total_parent_equity"), ("earnings_to_price", "parent_netprofit_ttm"), ("sales_to_price", "total_operate_income_ttm"), ("cashflow_to_price", "netcash_operate_ttm")):
        statement(name, "valuation", lambda i, s=source: per_share_yield(i, s))
    statement("dividend_yield_ttm", "valuation", lambda i: _present(i, "dividend_cash_per_share_ttm") / C, ("dividends",))
    statement("dividend_payout_ratio_ttm", "quality", lambda i: _present(i, "dividend_cash_per_share_ttm") / (fundamental(i, "parent_netprofit_ttm") / fundamental(i, "share_capital")), ("fundamentals", "dividends"))
    statement("gross_profit_to_assets", "quality", lambda i: gross(i) / fundamental(i, "total_assets"))
    statement("gross_margin", "quality", lambda i: gross(i) / fundamental(i, "total_operate_income_ttm"))
    for name, top, bottom in (
        ("operating_profitability", "operate_profit_ttm", "total_parent_equity"), ("roe_ttm", "parent_netprofit_ttm", "total_parent_equity"),
        ("roa_ttm", "parent_netprofit_ttm", "total_assets"), ("operating_margin", "operate_profit_ttm", "total_operate_income_ttm"),
        ("cash_profitability", "netcash_operate_ttm", "total_assets"), ("asset_turnover", "total_operate_income_ttm", "total_assets"),
        ("liabilities_to_assets", "total_liabilities", "total_assets"), ("liabilities_to_equity", "total_liabilities", "total_parent_equity"),
        ("cash_to_assets", "monetary_funds", "total_assets"), ("inventory_to_assets", "inventory", "total_assets"), ("receivables_to_assets", "accounts_rece", "total_assets"),
    ):
        statement(name, "quality", ratio(top, bottom))
    for name in ("asset_growth", "investment_to_assets", "inventory_growth", "receivables_growth", "capex_growth"):
        statement(name, "investment", lambda i, n=name: fundamental(i, n))
    statement("accruals", "quality", lambda i: fundamental(i, "accruals"))
    each("downside_volatility_{}", (20, 60), "volatility", "downside_volatility", lambda i, w: root(mean(at_most(pct_change(C), 0) * at_most(pct_change(C), 0), w)), 1, tags=("risk", "downside"))
    each("atr_{}_pct", (14, 20), "volatility", "atr_pct", lambda i, w: mean(true_range(), w) / C, 1, tags=("risk", "range"))
    spread = ln(H / L)
    each("parkinson_volatility_{}", (20, 60), "volatility", "parkinson_volatility", lambda i, w: root(mean(spread * spread / (4 * math.log(2)), w)), tags=("risk", "range"))
    body = ln(C / O)
    each("garman_klass_volatility_{}", (20, 60), "volatility", "garman_klass_volatility", lambda i, w: root(mean(at_least(spread * spread * 0.5 - body * body * (2 * math.log(2) - 1), 0), w)), tags=("risk", "ohlc"))

    for name in KBAR:
        add(name, "bar_shape", "kbar", lambda i, n=name: kbar(n), 0, tags=("alpha158", "kbar"))
    for op in ROLLING_OPS:
        for w in ROLLING_WINDOWS:
            add(f"{op}{w}", ROLLING_FAMILY[op], "rolling", lambda i, op=op, w=w: rolling(op, w), w + (op in _ONE_MORE), tags=("alpha158", "rolling"))
    for field in (*HISTORY_FIELDS, "volume"):
        for k in range(59, -1, -1):
            tags = ("alpha360", "history", *(("alpha158",) if field != "close" and k == 0 else ()))
            add(f"{field.upper()}{k}", "raw_volume_history" if field == "volume" else "raw_price_history", "history", _history(field, k), k, tags=tags)
    return out


REGISTRY = Registry(_built_in())
