"""Registered queries over the driver's tables and the SQL they must agree with.

Keys begin with the inventory ids they cover (F: canonical factors, K and Q: alpha
factors, WN: window primitives, XS: cross-section, JN: joins, and so on).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import expr as E
from barloom.functions import windows as W
from barloom.operators import cross_section as X
from barloom.operators import diagnostics, ingest, metrics, predict, ridge, splits
from barloom.operators import factors as fac
from barloom.operators import references as R
from barloom.operators.dataset import Spec, inference_dataset, training_dataset
from barloom.operators.panel import factor_frame
from barloom.plans import experiment
from barloom.plans import sql as S
from barloom.plans import testdata as T
from barloom.plans.compiler import evaluate
from barloom.sources import bars as sources
from barloom.sources import symbols

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

R1 = "close / nullif(lag(close) over (partition by symbol order by timestamp), 0) - 1"


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, names: list[str], digits: int = 6, keys: tuple[str, ...] = ("symbol", "timestamp")) -> DataFrame:
    return df.select(*keys, *(F.round(n, digits).alias(n) for n in names))


def _panel(name: str, stages: list[dict[str, str]], final: dict[str, str], digits: int = 6, ctes: tuple[str, ...] = (), source: str = "bars", **tables: Query) -> None:
    """A factor query: its names are the keys of ``final``, its SQL the formulas."""
    names = list(final)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {k: f(spark, sf_dir) for k, f in tables.items()}
        return rounded(factor_frame(T.bars(spark, sf_dir), names, keep=["symbol", "timestamp"], **given), names, digits)

    register(name, run, S.query([T.BARS_SQL, *ctes], stages, final, digits, source))


r1 = {"r1": R1}
_panel("f01_f04_returns", [], {f"return_{w}": f"{S.div('close', S.lag('close', w))} - 1" for w in (1, 3, 5, 10, 20, 60, 120)} | {f"momentum_{w}_21": f"{S.div(S.lag('close', 21), S.lag('close', w))} - 1" for w in (63, 126, 252)} | {f"short_term_reversal_{w}": f"-({S.div('close', S.lag('close', w))} - 1)" for w in (5, 20)})
_panel("f05_f06_price_levels", [], {f"close_to_sma_{w}": f"{S.div('close', S.mean('close', w))} - 1" for w in (5, 10, 20, 60, 120)} | {n: f"{S.div('close', S.top('close', w))} - 1" for n, w in (("price_to_26w_high", 126), ("price_to_52w_high", 252))})
register(
    "f07_price_to_rolling_low",
    lambda s, d: rounded(evaluate(T.bars(s, d), {f"low_{w}": fac.price_to_rolling_low(w) for w in (20, 60, 126)}, ["symbol", "timestamp"]), ["low_20", "low_60", "low_126"]),
    S.query([T.BARS_SQL], [], {f"low_{w}": f"{S.div('close', S.low('close', w))} - 1" for w in (20, 60, 126)}),
)
_panel("f08_f61_volatility", [r1, {"neg": "case when r1 > 0 then 0 else r1 end"}], {f"volatility_{w}": S.std("r1", w) for w in (5, 10, 20, 60)} | {f"downside_volatility_{w}": f"sqrt({S.mean('neg * neg', w)})" for w in (20, 60)})
_panel("f09_f10_volume", [], {f"volume_ratio_{w}": f"{S.div('volume', S.mean('volume', w))} - 1" for w in (5, 20, 60)} | {f"volume_trend_{a}_{b}": f"{S.div(S.mean('volume', a), S.mean('volume', b))} - 1" for a, b in ((5, 20), (10, 60))})
_channel = lambda w: S.div(f"close - {S.low('low', w)}", f"{S.top('high', w)} - {S.low('low', w)}")
_panel("f11_f13_ranges", [], {f"channel_position_{w}": _channel(w) for w in (10, 20, 60)} | {f"distance_to_high_{w}": f"{S.div('close', S.top('high', w))} - 1" for w in (10, 20, 60)} | {f"distance_to_low_{w}": f"{S.div('close', S.low('low', w))} - 1" for w in (10, 20, 60)})
_panel(
    "f14_f19_oscillators",
    [
        {"d": f"close - {S.lag('close')}", "tp": "(high + low + close) / 3", "k": _channel(14)},
        {"dt": f"tp - {S.lag('tp')}"},
        {"up": "case when dt > 0 then tp * volume else 0 end", "dn": "case when dt < 0 then tp * volume else 0 end"},
        {"g": S.mean("greatest(d, 0) + 0 * d", 14), "x": S.mean("greatest(-d, 0) + 0 * d", 14), "u": S.total("up", 14), "w": S.total("dn", 14)},
    ],
    {
        "rsi_14": "case when g is null then null when g = 0 then 0 when x = 0 then 100 else 100 - 100 / (1 + g / x) end",
        "bollinger_zscore_20": S.div(f"close - {S.mean('close', 20)}", S.std("close", 20)),
        "stochastic_k_14": "k",
        "stochastic_d_14_3": S.mean("k", 3),
        "williams_r_14": f"-100 * {S.div(S.top('high', 14) + ' - close', S.top('high', 14) + ' - ' + S.low('low', 14))}",
        "money_flow_index_14": "case when u is null then null when w = 0 then 100 else 100 - 100 / (1 + u / w) end",
    },
)
_panel(
    "f20_f28_bar_shape",
    [],
    {
        "intraday_range_pct": S.div("high - low", "close"), "open_to_close_pct": S.div("close - open", "open"), "overnight_gap_pct": f"{S.div('open', S.lag('close'))} - 1",
        "close_location_value": S.div("close - low", "high - low"), "high_to_close_pct": f"{S.div('high', 'close')} - 1", "low_to_close_pct": f"{S.div('low', 'close')} - 1",
        "upper_shadow_pct": S.div("high - greatest(open, close)", "close"), "lower_shadow_pct": S.div("least(open, close) - low", "close"), "real_body_pct": S.div("abs(close - open)", "open"),
    },
)
_INDEX = (T.BENCHMARK_SQL, "index_returns as (select timestamp, close / lag(close) over (order by timestamp) - 1 as b from index_series)", "joined as (select bars.*, b from bars left join index_returns using (timestamp))")
_both = lambda agg, w: f"case when count(case when b is not null then r1 end) {S.over(w)} = {w} and max(b) {S.over(w)} <> min(b) {S.over(w)} then {agg} end"
_beta = lambda w: _both(f"covar_samp(r1, b) {S.over(w)} / nullif(var_pop(b) {S.over(w)}, 0)", w)
_panel("f29_beta_jn1", [r1], {f"beta_{w}_hs300": _beta(w) for w in (20, 60, 120, 252)}, 5, _INDEX, "joined", benchmark=T.benchmark)
_panel("f30_idiosyncratic_volatility", [r1, {f"e{w}": f"r1 - (({S.mean('r1', w)}) - ({_beta(w)}) * ({S.mean('b', w)}) + ({_beta(w)}) * b)" for w in (20, 60, 120)}], {f"ivol_{w}_hs300": S.std(f"e{w}", w) for w in (20, 60, 120)}, 5, _INDEX, "joined", benchmark=T.benchmark)
_panel("f31_f32_liquidity", [r1, {"q": S.div("abs(r1)", "coalesce(amount, close * volume * 100)") + " * 1e6"}], {f"amihud_illiquidity_{w}": f"({S.mean('q', w)}) / 1e6" for w in (5, 20, 60)} | {f"dollar_volume_{w}": S.mean("coalesce(amount, close * volume * 100)", w) for w in (5, 20, 60)}, 5)
_FUND = (T.FUNDAMENTALS_SQL, "funded as (select bars.*, f.* exclude (symbol, available_date) from bars asof left join fundamentals f on bars.symbol = f.symbol and bars.timestamp >= f.available_date)")
_panel("f33_f34_turnover_jn2", [{"t": S.div("volume * 100", "share_capital")}], {f"turnover_{w}": S.mean("t", w) for w in (5, 20, 60)} | {f"abnormal_turnover_{w}": f"{S.div('t', S.mean('t', w))} - 1" for w in (5, 20, 60)}, 11, _FUND, "funded", fundamentals=T.fundamentals)
_per = lambda c: S.div(S.div(c, "share_capital"), "close")
_panel(
    "f35_f39_valuation",
    [],
    {"log_total_mkt_cap": "ln(case when close * share_capital > 0 then close * share_capital end)", "book_to_market": _per("total_parent_equity"), "earnings_to_price": _per("parent_netprofit_ttm"), "sales_to_price": _per("total_operate_income_ttm"), "cashflow_to_price": _per("netcash_operate_ttm")},
    6, _FUND, "funded", fundamentals=T.fundamentals,
)
_gross = "total_operate_income_ttm - operate_cost_ttm"
_panel(
    "f41_f60_statements",
    [],
    {
        "gross_profit_to_assets": S.div(_gross, "total_assets"), "operating_profitability": S.div("operate_profit_ttm", "total_parent_equity"), "roe_ttm": S.div("parent_netprofit_ttm", "total_parent_equity"),
        "roa_ttm": S.div("parent_netprofit_ttm", "total_assets"), "gross_margin": S.div(_gross, "total_operate_income_ttm"), "operating_margin": S.div("operate_profit_ttm", "total_operate_income_ttm"),
        "cash_profitability": S.div("netcash_operate_ttm", "total_assets"), "asset_turnover": S.div("total_operate_income_ttm", "total_assets"), "liabilities_to_assets": S.div("total_liabilities", "total_assets"),
        "liabilities_to_equity": S.div("total_liabilities", "total_parent_equity"), "cash_to_assets": S.div("monetary_funds", "total_assets"), "inventory_to_assets": S.div("inventory", "total_assets"),
        "receivables_to_assets": S.div("accounts_rece", "total_assets"), **{c: c for c in ("asset_growth", "investment_to_assets", "accruals", "inventory_growth", "receivables_growth", "capex_growth")},
    },
    6, _FUND, "funded", fundamentals=T.fundamentals,
)
_PAID = (
    *_FUND,
    T.DIVIDENDS_SQL,
    """paying as (
  select funded.*, case when exists (select 1 from dividends x where x.symbol = funded.symbol) then coalesce((
    select sum(cash) from dividends d where d.symbol = funded.symbol and d.event_date <= funded.timestamp and d.event_date > funded.timestamp - interval 365 day), 0) end as dps
  from funded)""",
)
_panel("f40_f49_dividends_jn4", [], {"dividend_yield_ttm": S.div("dps", "close"), "dividend_payout_ratio_ttm": S.div("dps", S.div("parent_netprofit_ttm", "share_capital"))}, 10, _PAID, "paying", fundamentals=T.fundamentals, dividends=T.dividends)
_gk = "greatest(0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open), 0)"
_panel(
    "f62_f64_range_volatility",
    [{"tr": f"greatest(high - low, abs(high - {S.lag('close')}), abs(low - {S.lag('close')}))", "pk": "ln(high / low) * ln(high / low) / (4 * ln(2))", "gk": _gk}],
    {f"atr_{w}_pct": S.div(S.mean("tr", w), "close") for w in (14, 20)} | {f"parkinson_volatility_{w}": f"sqrt({S.mean('pk', w)})" for w in (20, 60)} | {f"garman_klass_volatility_{w}": f"sqrt({S.mean('gk', w)})" for w in (20, 60)},
)
_peers = (
    T.INDUSTRY_SQL,
    "placed as (select bars.*, i.level_1, close / nullif(lag(close) over (partition by bars.symbol order by timestamp), 0) - 1 as own from bars asof left join industry i on bars.symbol = i.symbol and bars.timestamp >= i.change_date)",
    "peers as (select *, case when count(own) over g > 1 then (coalesce(sum(own) over g, 0) - own) / (count(own) over g - 1) end as peer from placed window g as (partition by timestamp, level_1))",
)
# Compounded peer returns reach 1e17 and more on these tables; their logarithm compares without loss of digits.
_SPANS = {63: 42, 126: 105, 252: 231}
_MOMENTUM = S.query([T.BARS_SQL, *_peers], [{"m": f"lag(1 + peer, 21) {S.P}"}], {f"log_growth_{w}": f"ln(case when ({S.full('product(m)', 'm', n)}) > 0 then {S.full('product(m)', 'm', n)} end)" for w, n in _SPANS.items()}, 6, "peers")


def _industry_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = factor_frame(T.bars(spark, sf_dir), [f"industry_momentum_{w}_21" for w in _SPANS], keep=["symbol", "timestamp"], industry=T.industry(spark, sf_dir))
    growth = lambda w: F.when(F.col(f"industry_momentum_{w}_21") > -1, F.ln(F.col(f"industry_momentum_{w}_21") + 1)).alias(f"log_growth_{w}")
    return rounded(frame.select("symbol", "timestamp", *(growth(w) for w in _SPANS)), [f"log_growth_{w}" for w in _SPANS])


register("f03_industry_momentum_ag1_jn3", _industry_momentum, _MOMENTUM)

_rng = "(nullif(high - low, 0) + 1e-12)"
_panel(
    "k1_k9_kbar",
    [],
    {"KMID": S.div("close - open", "open"), "KLEN": S.div("high - low", "open"), "KMID2": f"(close - open) / {_rng}", "KUP": S.div("high - greatest(open, close)", "open"), "KUP2": f"(high - greatest(open, close)) / {_rng}",
     "KLOW": S.div("least(open, close) - low", "open"), "KLOW2": f"(least(open, close) - low) / {_rng}", "KSFT": S.div("2 * close - high - low", "open"), "KSFT2": f"(2 * close - high - low) / {_rng}"},
)
_panel("alpha360_raw_history", [], {f"{f.upper()}{k}": S.div(S.lag("amount / (volume * 100)" if f == "vwap" else f, k), "close") for f in fac.HISTORY_FIELDS for k in (0, 1, 30, 59)} | {f"VOLUME{k}": f"{S.lag('volume', k)} / (volume + 1e-12)" for k in (0, 1, 30, 59)})


def _alpha(name: str, ops: dict[str, Callable[[int], str]], stages: list[dict[str, str]], windows: tuple[int, ...] = (5, 20, 60), digits: int = 6) -> None:
    _panel(name, stages, {f"{op}{w}": f(w) for op, f in ops.items() for w in windows}, digits)


_d = {"lc": S.lag("close"), "d": f"close - {S.lag('close')}", "dv": f"volume - {S.lag('volume')}", "rn": f"row_number() {S.P}"}
_alpha("q01_q03_q07_q08_q12_levels", {"ROC": lambda w: S.div(S.lag("close", w), "close"), "MA": lambda w: S.div(S.mean("close", w), "close"), "STD": lambda w: S.div(S.std("close", w), "close"), "MAX": lambda w: S.div(S.top("high", w), "close"), "MIN": lambda w: S.div(S.low("low", w), "close"), "RSV": _channel}, [])
_alpha(
    "q04_q06_wn15_wn17_regression",
    {
        "BETA": lambda w: S.div(S.full("regr_slope(close, rn)", "close", w), "close"),
        "RSQR": lambda w: f"case when max(close) {S.over(w)} <> min(close) {S.over(w)} then {S.full('regr_r2(close, rn)', 'close', w)} end",
        "RESI": lambda w: S.div(f"close - (({S.full('regr_intercept(close, rn)', 'close', w)}) + ({S.full('regr_slope(close, rn)', 'close', w)}) * rn)", "close"),
    },
    [_d], digits=5,
)
_since = lambda x, m, w: f"case when count({x}) {S.over(w)} = {w} then ({w} - list_position(list({x}) {S.over(w)}, {m}({x}) {S.over(w)}))::double end"
_alpha(
    "q09_q11_q13_q15_wn10_wn12_order",
    {
        "QTLU": lambda w: S.div(S.full("quantile_cont(close, 0.8)", "close", w), "close"), "QTLD": lambda w: S.div(S.full("quantile_cont(close, 0.2)", "close", w), "close"),
        "RANK": lambda w: f"case when count(close) {S.over(w)} = {w} then (list_sum(list_transform(list(close) {S.over(w)}, lambda v: case when v < close then 1.0 when v = close then 0.5 else 0.0 end)) + 0.5) / {w} end",
        "IMAX": lambda w: f"({_since('high', 'max', w)}) / {w}", "IMIN": lambda w: f"({_since('low', 'min', w)}) / {w}", "IMXD": lambda w: f"(({_since('high', 'max', w)}) - ({_since('low', 'min', w)})) / {w}",
    },
    [], windows=(5, 30),
)
_corr = lambda a, b, w: f"case when count(case when {b} is not null then {a} end) {S.over(w)} = {w} and max({a}) {S.over(w)} <> min({a}) {S.over(w)} and max({b}) {S.over(w)} <> min({b}) {S.over(w)} then covar_pop({a}, {b}) {S.over(w)} / nullif(stddev_pop({a}) {S.over(w)} * stddev_pop({b}) {S.over(w)}, 0) end"
_alpha("q16_q17_wn13_correlation", {"CORR": lambda w: _corr("close", "lv", w), "CORD": lambda w: _corr("rc", "rv", w)}, [{"lv": "ln(volume + 1)", "rc": S.div("close", S.lag("close")), "rv": f"ln({S.div('volume', S.lag('volume'))} + 1)"}], digits=5)
_share = lambda d, s, w: f"({S.total(f'case when {s}{d} < 0 then 0 else {s}{d} end', w)}) / (({S.total(f'abs({d})', w)}) + 1e-12)"
_count = lambda s, w: S.mean(f"(case when coalesce({s}, false) then 1.0 else 0.0 end)", w)
_alpha(
    "q18_q23_direction",
    {
        "CNTP": lambda w: _count("d > 0", w), "CNTN": lambda w: _count("d < 0", w), "CNTD": lambda w: f"({_count('d > 0', w)}) - ({_count('d < 0', w)})",
        "SUMP": lambda w: _share("d", "", w), "SUMN": lambda w: _share("d", "-", w), "SUMD": lambda w: f"{_share('d', '', w)} - {_share('d', '-', w)}",
    },
    [_d],
)
_alpha(
    "q24_q29_volume",
    {
        "VMA": lambda w: f"({S.mean('volume', w)}) / (volume + 1e-12)", "VSTD": lambda w: f"({S.std('volume', w)}) / (volume + 1e-12)", "WVMA": lambda w: f"({S.std('m', w)}) / (({S.mean('m', w)}) + 1e-12)",
        "VSUMP": lambda w: _share("dv", "", w), "VSUMN": lambda w: _share("dv", "-", w), "VSUMD": lambda w: f"{_share('dv', '', w)} - {_share('dv', '-', w)}",
    },
    [_d | {"m": f"abs({R1}) * volume"}],
)



# -- primitives, cross-section, labels, splits and metrics

_SCORED = "scored as (select symbol, timestamp, close, round(close / nullif(case when count(close) over w = 20 then avg(close) over w end, 0) - 1, 9) as p, round(lead(close, 5) over t / nullif(close, 0) - 1, 9) as y from bars window w as (partition by symbol order by timestamp rows between 19 preceding and current row), t as (partition by symbol order by timestamp))"
_RANK = lambda x, by="timestamp": f"((rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) / count(*) over (partition by {by}))"
_DAILY = lambda by="timestamp", source="scored": f"""
ranked as (select *, {_RANK('p', by)} as rp, {_RANK('y', by)} as ry, row_number() over (partition by {by} order by p desc, symbol) as np, row_number() over (partition by {by} order by y desc, symbol) as ny
  from {source} where p is not null and y is not null),
daily as (select {by}, case when count(*) > 1 and max(p) <> min(p) and max(y) <> min(y) then covar_pop(p, y) / (stddev_pop(p) * stddev_pop(y)) end as ic,
    case when count(*) > 1 and max(p) <> min(p) and max(y) <> min(y) then covar_pop(rp, ry) / (stddev_pop(rp) * stddev_pop(ry)) end as rank_ic,
    sum(case when np <= 10 then (pow(2, y) - 1) / log2(np + 1) end) as dcg, sum(case when ny <= 10 then (pow(2, y) - 1) / log2(ny + 1) end) as idcg,
    sum(abs(p - y)) as ae, sum((p - y) * (p - y)) as se, count(*) as n, sum(y) as sy, sum(y * y) as sy2
  from ranked group by {by})"""  # noqa: E731
_METRICS = """
    avg(ic) as ic, case when count(ic) > 1 then stddev_pop(ic) else 0 end as ic_std, avg(rank_ic) as rank_ic, case when count(rank_ic) > 1 then stddev_pop(rank_ic) else 0 end as rank_ic_std,
    avg(case when idcg > 0 and isfinite(dcg / idcg) then dcg / idcg end) as ndcg_at_10, sum(ae) / sum(n) as mae,
    case when sum(sy2) - sum(sy) * sum(sy) / sum(n) > 0 then 1 - sum(se) / (sum(sy2) - sum(sy) * sum(sy) / sum(n)) when sum(se) = 0 then 1 else 0 end as r2"""
_FINAL = ", ".join(f"round(coalesce({e}, 0), 5) + 0.0 as {n}" for n, e in {c: c for c in ("ic", "ic_std", "rank_ic", "rank_ic_std", "ndcg_at_10", "mae", "r2")}.items()) + ", round(case when ic_std > 0 then coalesce(ic, 0) / ic_std else 0 end, 5) + 0.0 as icir, round(case when rank_ic_std > 0 then coalesce(rank_ic, 0) / rank_ic_std else 0 end, 5) + 0.0 as rank_icir"


def _with(*ctes: str) -> str:
    return "with " + ",\n".join((T.BARS_SQL, *ctes)) + "\n"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean daily rank IC of close_to_sma_20 against the next five bars' return."""
    return rounded(metrics.evaluate(T.scored(spark, sf_dir)), list(metrics.METRICS), 5, ())


register("flagship", flagship, _with(_SCORED, _DAILY(), f"m as (select {_METRICS} from daily)") + f"select {_FINAL} from m")
register(
    "xs6_xs8_daily_metrics",
    lambda s, d: rounded(metrics.daily(T.scored(s, d)), ["ic", "rank_ic", "ndcg_at_10"], 5, ("timestamp", "n")),
    _with(_SCORED, _DAILY()) + "select timestamp, n, round(ic, 5) + 0.0 as ic, round(rank_ic, 5) + 0.0 as rank_ic, round(case when idcg > 0 and isfinite(dcg / idcg) then dcg / idcg end, 5) + 0.0 as ndcg_at_10 from daily",
)
register(
    "wn4_wn18_wn21_primitives",
    lambda s, d: rounded(
        evaluate(
            T.bars(s, d).withColumn("x", F.when(F.col("volume") % 7 != 0, F.col("close"))),
            {"filled": W.padded(E.column("x")), "change": W.pct_change(E.column("x"), 2), "running": W.running(E.column("volume")), "product": W.compounded(W.pct_change(E.column("close")), 10, 3), "history_count": W.position(), "ahead": W.lead(E.column("close"), 3)},
            ["symbol", "timestamp"],
        ),
        ["filled", "change", "running", "product", "history_count", "ahead"],
        9,
    ),
    S.query(
        [T.BARS_SQL],
        [
            {"x": "case when volume % 7 <> 0 then close end", "r": R1},
            {"f": "last_value(x ignore nulls) over (partition by symbol order by timestamp rows unbounded preceding)", "g": f"lag(1 + r, 3) {S.P}"},
        ],
        {"filled": "f", "change": f"f / nullif({S.lag('f', 2)}, 0) - 1", "running": "sum(volume) over (partition by symbol order by timestamp rows unbounded preceding)", "product": f"({S.full('product(g)', 'g', 7)}) - 1", "history_count": f"row_number() {S.P}", "ahead": f"lead(close, 3) {S.P}"},
        9,
    ),
)
register(
    "xs1_xs3_normalize",
    lambda s, d: rounded(X.normalize(T.scored(s, d).withColumn("z", F.col("prediction")), ["z"], "zscore").withColumn("rank", X.rank_pct("prediction")), ["z", "rank"], 5),
    _with(_SCORED)
    + f"""select symbol, timestamp, round(case when max(p) over d <> min(p) over d then (p - avg(p) over d) / stddev_samp(p) over d end, 5) + 0.0 as z,
  case when p is not null then round({_RANK('p', 'timestamp, p is null')}, 5) end as rank from scored window d as (partition by timestamp)""",
)
register(
    "xs5_buckets",
    lambda s, d: X.buckets(T.scored(s, d), "prediction", 5, "bucket").select("symbol", "timestamp", "bucket"),
    _with(_SCORED, "placed as (select *, least(greatest(ceil(row_number() over (partition by timestamp, p is null order by p, symbol) / count(*) over (partition by timestamp, p is null)::double * 5), 1), 5)::int as q from scored)")
    + "select symbol, timestamp, case when p is null then null when q = 1 then 'cap_q1_smallest' when q = 5 then 'cap_q5_largest' else 'cap_q' || q end as bucket from placed",
)
register(
    "xs9_score_ranks",
    lambda s, d: rounded(X.score_ranks(T.scored(s, d)).withColumn("score_rank", F.col("score_rank").cast("double")), ["score_rank", "score_percentile"]),
    _with(_SCORED) + f"select symbol, timestamp, case when p is not null then rank() over (partition by timestamp, p is null order by p desc)::double end as score_rank, case when p is not null then round({_RANK('p', 'timestamp, p is null')}, 6) end as score_percentile from scored",
)
register(
    "lb1_lb2_xs4_labels",
    lambda s, d: rounded(X.with_label(T.bars(s, d), 3, True), ["future_return_3d", "future_return_rank_3d"]),
    _with(f"l as (select symbol, timestamp, lead(close, 3) {S.P} / nullif(close, 0) - 1 as y from bars)") + f"select symbol, timestamp, round(y, 6) + 0.0 as future_return_3d, case when y is not null then round({_RANK('y', 'timestamp, y is null')}, 6) end as future_return_rank_3d from l",
)
_IDX = "dates as (select timestamp, row_number() over (order by timestamp) - 1 as i from (select distinct timestamp from bars))"


def _fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = T.bars(spark, sf_dir)
    folds = splits.walk_forward(splits.date_index(bars).count(), 1000, 300, 300, 5, 2, True)
    count = lambda part: splits.members(bars, folds, part).groupBy("fold").agg(F.count("*").alias(f"{part}_rows"), F.min("timestamp").alias(f"{part}_first"), F.max("timestamp").alias(f"{part}_last"))
    return count("train").join(count("valid"), "fold")


register(
    "sp2_jn9_walk_forward",
    _fold_counts,
    _with(
        _IDX,
        "folds as (select 'fold_' || (k + 1) as fold, 1000 + 300 * k as e from (select unnest(range(0, 100)) as k) where 1000 + 300 * k + 302 <= (select count(*) from dates))",
        "tagged as (select b.*, i from bars b join dates using (timestamp))",
    )
    + """select fold, count(*) filter (i <= e - 6) as train_rows, min(timestamp) filter (i <= e - 6) as train_first, max(timestamp) filter (i <= e - 6) as train_last,
  count(*) filter (i between e + 2 and e + 301) as valid_rows, min(timestamp) filter (i between e + 2 and e + 301) as valid_first, max(timestamp) filter (i between e + 2 and e + 301) as valid_last
from folds join tagged on i <= e - 6 or i between e + 2 and e + 301 group by fold""",
)


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = T.bars(spark, sf_dir)
    fold = [splits.holdout(splits.date_index(bars).count(), 1500, 5, 2)]
    side = lambda part: splits.members(bars, fold, part).groupBy("fold").agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).withColumn("part", F.lit(part))
    return side("train").unionByName(side("valid"))


register("sp1_holdout", _holdout, _with(_IDX) + "select 'holdout' as fold, count(*) as rows, min(timestamp) as first, max(timestamp) as last, case when i <= 1495 then 'train' else 'valid' end as part from bars join dates using (timestamp) where i <= 1495 or i >= 1503 group by 5")
_INDUSTRY = (T.INDUSTRY_SQL, "placed as (select bars.symbol, bars.timestamp, i.level_1 as industry_level_1 from bars asof left join industry i on bars.symbol = i.symbol and bars.timestamp >= i.change_date)")
register("jn3_industry_asof", lambda s, d: R.with_industry(T.bars(s, d), T.industry(s, d)).select("symbol", "timestamp", "industry_level_1"), _with(*_INDUSTRY) + "select * from placed")
register(
    "jn7_industry_standard",
    lambda s, d: R.with_industry(T.bars(s, d), T.industry(s, d), "region").select("symbol", "timestamp", "industry_level_1"),
    _with(T.INDUSTRY_SQL) + "select bars.symbol, bars.timestamp, i.level_1 as industry_level_1 from bars asof left join (select * from industry where change_date = date '1992-01-01') i on bars.symbol = i.symbol and bars.timestamp >= i.change_date",
)
# Twenty weekdays before Sunday 1995-01-01, the first of them Friday: Monday 1994-12-05.
register(
    "flt1_flt2_flt3_lb3_training_dataset",
    lambda s, d: rounded(training_dataset(T.bars(s, d), Spec(("close_to_sma_20", "return_5"), 5, "return", "rank", "1995-01-01", "1998-06-30")), ["close_to_sma_20", "return_5", "future_return_5d"]),
    _with(
        f"f as (select symbol, timestamp, close, close / nullif({S.mean('close', 20)}, 0) - 1 as a, close / nullif({S.lag('close', 5)}, 0) - 1 as b, lead(close, 5) {S.P} / nullif(close, 0) - 1 as y from bars where timestamp >= timestamp '1994-12-05' and timestamp < timestamp '1998-07-01')",
        f"n as (select *, {_RANK('a', 'timestamp, a is null')} as ra, {_RANK('b', 'timestamp, b is null')} as rb from f)",
    )
    + "select symbol, timestamp, round(ra, 6) as close_to_sma_20, round(rb, 6) as return_5, round(y, 6) + 0.0 as future_return_5d from n where a is not null and b is not null and y is not null and timestamp >= timestamp '1995-01-01'",
)
register(
    "lb4_inference_dataset",
    lambda s, d: rounded(inference_dataset(T.bars(s, d), Spec(("close_to_sma_20",), normalization="zscore", start="1995-01-01", end="1996-12-31", lookback=100_000)), ["close_to_sma_20"], 5),
    _with(f"f as (select symbol, timestamp, close / nullif({S.mean('close', 20)}, 0) - 1 as a from bars where timestamp < timestamp '1997-01-01')")
    + "select symbol, timestamp, round(case when max(a) over d <> min(a) over d then (a - avg(a) over d) / stddev_samp(a) over d end, 5) + 0.0 as close_to_sma_20 from f window d as (partition by timestamp)",
)


def _ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = T.scored(spark, sf_dir).withColumnRenamed("prediction", "x").where("x is not null and label is not null")
    return rounded(ridge.score(scored, ridge.fit(scored, ["x"], "label", 25.0)), ["prediction"])


register(
    "ml1_ridge",
    _ridge,
    _with(_SCORED, "v as (select symbol, timestamp, p, y from scored where p is not null and y is not null)", "m as (select avg(p) as mp, stddev_pop(p) as sp, avg(y) as my, count(*) as n, covar_pop(p, y) as c from v)")
    + "select symbol, timestamp, round(my + (p - mp) / sp * (n * c / sp / (n + 25.0)), 6) + 0.0 as prediction from v, m",
)
def _ridge_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on one feature over walk-forward folds and a holdout, each fitted on its own training days."""
    data = T.scored(spark, sf_dir).withColumnRenamed("prediction", "x").where("x is not null and label is not null")
    n = splits.date_index(data).count()
    folds = [*splits.walk_forward(n, 1000, 400, 400, 5, 2), splits.holdout(n, 1500, 5, 2)]
    return experiment.validate(data, "ridge", ["x"], "label", folds, {"alpha": 25.0})


_RIDGE = (
    _SCORED, "v as (select symbol, timestamp, p as x, y from scored where p is not null and y is not null)", "days as (select timestamp, row_number() over (order by timestamp) - 1 as i from (select distinct timestamp from v))",
    "folds as (select 'fold_' || (k + 1) as fold, 1000 + 400 * k - 6 as last, 1000 + 400 * k + 2 as a, 1000 + 400 * k + 401 as b from (select unnest(range(0, 100)) as k) where 1000 + 400 * k + 402 <= (select count(*) from days) union all select 'holdout', 1495, 1503, 1000000)",
    "tagged as (select v.*, i from v join days using (timestamp))",
    "fitted as (select fold, avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, count(*) as n, covar_pop(x, y) as c from folds join tagged on i <= last group by fold)",
    "guessed as (select f.fold, symbol, timestamp, my + (x - mx) / sx * (n * c / sx / (n + 25.0)) as p, y from folds f join fitted using (fold) join tagged on i between a and b)",
)
register("ev1_ev2_ridge_folds", lambda s, d: rounded(_ridge_folds(s, d), list(metrics.METRICS), 5, ("fold",)), _with(*_RIDGE, _DAILY("fold, timestamp", "guessed"), f"m as (select fold, {_METRICS} from daily group by fold)") + f"select fold, {_FINAL} from m")
register(
    "ag4_mean_of_folds",
    lambda s, d: rounded(metrics.mean_of_folds(_ridge_folds(s, d)), ["ic", "ic_std", "rank_ic", "rank_ic_std", "ndcg_at_10", "mae", "r2"], 5, ()),
    _with(*_RIDGE, _DAILY("fold, timestamp", "guessed"), f"m as (select fold, {_METRICS} from daily group by fold)") + "select " + ", ".join(f"round(avg(coalesce({c}, 0)), 5) + 0.0 as {c}" for c in ("ic", "ic_std", "rank_ic", "rank_ic_std", "ndcg_at_10", "mae", "r2")) + " from m",
)
_WINDOWS = (("early", "1993-01-01", "1994-12-31"), ("late", "1994-06-01", "1997-06-30"), ("none", "2030-01-01", "2030-12-31"))
register(
    "ev5_signal_windows",
    lambda s, d: rounded(experiment.by_windows(T.scored(s, d), _WINDOWS), list(metrics.METRICS), 5, ("window",)),
    _with(_SCORED, "tagged as (select 'test' as w, * from scored" + "".join(f" union all select '{n}', * from scored where timestamp::date between date '{a}' and date '{b}'" for n, a, b in _WINDOWS) + ")", _DAILY("w, timestamp", "tagged"), f"m as (select w, {_METRICS} from daily group by w)") + f'select w as "window", {_FINAL} from m',
)
_YEARS = "tagged as (select *, 'oos_' || year(timestamp) || case when strftime(max(timestamp) over (partition by year(timestamp)), '%m-%d') = '12-31' then '' else '_ytd' end as bucket from scored)"
register(
    "dg2_dg6_year_slices",
    lambda s, d: rounded(diagnostics.slices(diagnostics.with_year(T.scored(s, d)), ["year_window"]), list(metrics.METRICS), 5, ("bucket", "rows")),
    _with(_SCORED, _YEARS, _DAILY("bucket, timestamp", "tagged"), f"m as (select bucket, {_METRICS} from daily group by bucket)", "counted as (select bucket, count(*) as rows from tagged group by bucket)") + f"select bucket, rows, {_FINAL} from m join counted using (bucket)",
)
register(
    "dg1_ic_decay",
    lambda s, d: rounded(diagnostics.ic_decay(T.scored(s, d).drop("label").join(T.bars(s, d).select("symbol", "timestamp", "close"), ["symbol", "timestamp"]), [1, 5, 10]), list(metrics.METRICS), 5, ("horizon", "rows")),
    _with(_SCORED, "stacked as (" + " union all ".join(f"select symbol, timestamp, {h} as horizon, p, lead(close, {h}) {S.P} / nullif(close, 0) - 1 as y from scored" for h in (1, 5, 10)) + ")", _DAILY("horizon, timestamp", "stacked"), f"m as (select horizon, sum(n)::bigint as rows, {_METRICS} from daily group by horizon)") + f"select horizon, rows, {_FINAL} from m",
)
register(
    "dg3_jn6_ag5_regimes",
    lambda s, d: diagnostics.with_regime(T.scored(s, d), T.benchmark(s, d)).groupBy("market_regime").agg(F.count("*").alias("rows")),
    _with(
        _SCORED, T.BENCHMARK_SQL,
        "r as (select timestamp, close / lag(close, 20) over (order by timestamp) - 1 as trend, close / lag(close) over (order by timestamp) - 1 as r1 from index_series)",
        "v as (select timestamp, trend, case when count(r1) over w = 20 then stddev_pop(r1) over w end as vol from r window w as (order by timestamp rows between 19 preceding and current row))",
        "j as (select symbol, trend, vol from scored left join v using (timestamp))", "c as (select median(trend) as tc, median(vol) as vc from j)",
    )
    + "select case when trend is not null and vol is not null then 'trend_' || case when trend >= tc then 'up' else 'down' end || '_' || case when vol >= vc then 'high' else 'low' end || '_vol' end as market_regime, count(*) as rows from j, c group by 1",
)
register(
    "dg4_industry_slices",
    lambda s, d: rounded(diagnostics.slices(R.with_industry(T.scored(s, d), T.industry(s, d)), ["industry_level_1"]), list(metrics.METRICS), 5, ("bucket", "rows")),
    _with(_SCORED, *_INDUSTRY, "tagged as (select scored.*, industry_level_1 as bucket from scored join placed using (symbol, timestamp) where industry_level_1 is not null)", _DAILY("bucket, timestamp", "tagged"), f"m as (select bucket, {_METRICS} from daily group by bucket)", "counted as (select bucket, count(*) as rows from tagged group by bucket)")
    + f"select bucket, rows, {_FINAL} from m join counted using (bucket)",
)

_CAPS = (*_FUND, "caps as (select symbol, timestamp, ln(case when close * share_capital > 0 then close * share_capital end) as cap from funded)", "placed as (select scored.*, cap from scored left join caps using (symbol, timestamp))",
    "numbered as (select *, least(greatest(ceil(row_number() over (partition by timestamp, cap is null order by cap, symbol) / count(*) over (partition by timestamp, cap is null)::double * 5), 1), 5)::int as q from placed)",
    "tagged as (select *, case when q = 1 then 'cap_q1_smallest' when q = 5 then 'cap_q5_largest' else 'cap_q' || q end as bucket from numbered where cap is not null)")


def _cap_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = factor_frame(T.bars(spark, sf_dir), ["log_total_mkt_cap"], keep=["symbol", "timestamp"], fundamentals=T.fundamentals(spark, sf_dir))
    placed = diagnostics.with_cap_buckets(diagnostics.with_caps(T.scored(spark, sf_dir), panel), 5)
    return rounded(diagnostics.slices(placed, ["market_cap_bucket"]), list(metrics.METRICS), 5, ("bucket", "rows"))


register(
    "dg5_jn5_cap_slices", _cap_slices,
    _with(_SCORED, *_CAPS, _DAILY("bucket, timestamp", "tagged"), f"m as (select bucket, {_METRICS} from daily group by bucket)", "counted as (select bucket, count(*) as rows from tagged group by bucket)") + f"select bucket, rows, {_FINAL} from m join counted using (bucket)",
)


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol's last scored day in 1996 and its place among all symbols of that day."""
    frame = T.scored(spark, sf_dir)
    own = predict.latest_row(frame, ["prediction"], "1996-12-31", "000007").select(F.to_date("timestamp").cast("string").alias("d")).first()
    return rounded(predict.context(frame, own.d, "000007"), ["prediction", "score_percentile", "top_score", "median_score", "bottom_score"], 6, ("symbol", "timestamp", "score_rank", "context_size"))


register(
    "pr1_pr2_st6_ag6_context", _context,
    _with(_SCORED, "day as (select max(timestamp) as t from scored where symbol = '000007' and p is not null and timestamp < timestamp '1997-01-01')", "rows_of as (select s.* from scored s join day on s.timestamp = t where p is not null)",
          f"ranked as (select *, rank() over (order by p desc) as score_rank, {_RANK('p')} as score_percentile from rows_of)", "whole as (select count(*) as context_size, max(p) as top_score, median(p) as median_score, min(p) as bottom_score from rows_of)")
    + "select symbol, timestamp, score_rank::int as score_rank, context_size, round(p, 6) + 0.0 as prediction, round(score_percentile, 6) as score_percentile, round(top_score, 6) + 0.0 as top_score, round(median_score, 6) + 0.0 as median_score, round(bottom_score, 6) + 0.0 as bottom_score from ranked, whole where symbol = '000007'",
)

# -- ingestion over the event and order tables


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"), F.col("o_totalprice").alias("close"), "o_orderkey")
    return ingest.upsert(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0"), tie=["o_orderkey"]).select("symbol", "timestamp", "close")


register(
    "mrg1_st9_set1_upsert",
    _upsert,
    """with o as (select o_custkey::varchar as symbol, o_orderdate::timestamp as timestamp, o_totalprice as close, o_orderkey as k from orders),
both_ages as (select *, 0 as age from o where k % 3 <> 0 union all select *, 1 from o where k % 2 = 0)
select symbol, timestamp, close from both_ages qualify row_number() over (partition by symbol, timestamp order by age desc, k desc) = 1""",
)


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.fundamentals(spark, sf_dir)
    dates = F.col("report_date").alias("REPORT_DATE"), F.col("available_date").alias("NOTICE_DATE")
    balance = q.where("month(report_date) <> 6").select("symbol", *dates, F.col("total_assets").alias("TOTAL_ASSETS"), F.col("total_parent_equity").alias("TOTAL_EQUITY"), F.col("share_capital").alias("SHARE_CAPITAL"), F.col("inventory").alias("INVENTORY"))
    profit = q.select("symbol", dates[0], F.col("parent_netprofit_ttm").alias("NETPROFIT"), F.col("operate_cost_ttm").alias("OPERATE_COST"))
    cash = q.where("month(report_date) <> 9").select("symbol", dates[0], F.col("netcash_operate_ttm").alias("NETCASH_OPERATE"))
    out = ingest.fundamentals(balance, profit, cash)
    return out.select("symbol", "report_date", "available_date", *(F.round(c, 5).alias(c) for c in ("total_parent_equity", "parent_netprofit_ttm", "operate_cost_ttm", "netcash_operate_ttm", "asset_growth", "accruals", "inventory_growth")))


_single = lambda c: f"{c} - coalesce(case when quarter(report_date) > 1 then lag({c}) over (partition by symbol, year(report_date) order by report_date) end, 0)"
register(
    "jn8_std1_std7_fundamentals",
    _statements,
    "with " + T.FUNDAMENTALS_SQL + """,
raw as (select *, (available_date::date - 45) as report_date from fundamentals),
joined as (select symbol, report_date, case when month(report_date) <> 6 then available_date::date else report_date end as available_date, case when month(report_date) <> 6 then total_assets end as ta, case when month(report_date) <> 6 then total_parent_equity end as te,
    case when month(report_date) <> 6 then inventory end as inv, parent_netprofit_ttm as np, operate_cost_ttm as oc, case when month(report_date) <> 9 then netcash_operate_ttm end as nc from raw),
single as (select *, """ + ", ".join(f"{_single(c)} as {c}1" for c in ("np", "oc", "nc")) + """ from joined),
summed as (select *, """ + ", ".join(f"case when count({c}1) over w = 4 then sum({c}1) over w end as {c}4" for c in ("np", "oc", "nc")) + """ from single window w as (partition by symbol order by report_date rows between 3 preceding and current row))
select symbol, report_date, available_date, round(te, 5) + 0.0 as total_parent_equity, round(np4, 5) + 0.0 as parent_netprofit_ttm, round(oc4, 5) + 0.0 as operate_cost_ttm, round(nc4, 5) + 0.0 as netcash_operate_ttm,
  round(ta / nullif(lag(ta, 4) over w, 0) - 1, 5) + 0.0 as asset_growth, round((np4 - nc4) / nullif(lag(ta, 4) over w, 0), 5) + 0.0 as accruals, round(inv / nullif(lag(inv, 4) over w, 0) - 1, 5) + 0.0 as inventory_growth
from summed window w as (partition by symbol order by report_date)""",
)
register(
    "std9_dividends",
    lambda s, d: ingest.dividends(T.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("ex"), F.col("o_orderdate").alias("pay"), F.col("o_totalprice").alias("ten")), {"ex_date": "ex", "pay_date": "pay", "cash_per_ten": "ten"}).groupBy("event_date").agg(F.count("*").alias("n"), F.round(F.sum("cash_dividend_per_share"), 3).alias("cash")),
    "select o_orderdate::date as event_date, count(*) as n, round(sum(o_totalprice / 10), 3) as cash from orders group by 1",
)
register(
    "src12_src13_std11_symbols",
    lambda s, d: T.table(s, d, "part").select(F.concat(F.lit(" "), (F.col("p_partkey") * 3571 % 700000).cast("string")).alias("raw")).distinct().select("raw", symbols.normalize(F.col("raw")).alias("symbol"), symbols.asset_type(F.col("raw")).alias("asset_type"), symbols.exchange_symbol(symbols.normalize(F.col("raw"))).alias("exchange_symbol")),
    """with r as (select distinct ' ' || (p_partkey * 3571 % 700000)::varchar as raw from part), s as (select raw, lpad(trim(raw), greatest(6, length(trim(raw)))::int, '0') as symbol from r)
select raw, symbol, case when symbol[1:2] = '16' then 'lof' when symbol[1:2] in ('15', '50', '51', '52', '56', '58') then 'etf'
  when symbol[1:3] in ('000', '001', '002', '003', '300', '301', '600', '601', '603', '605', '688') then 'stock' end as asset_type, case when symbol[1:1] in ('5', '6', '9') then 'SH' else 'SZ' end || symbol as exchange_symbol from s""",
)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("p_partkey") * 3571 % 700000).cast("string")
    parts = T.table(spark, sf_dir, "part")
    master = parts.where("p_partkey % 3 = 0").select(code.alias("symbol"), F.when(F.col("p_partkey") % 2 == 0, "ETF").otherwise("Bond").alias("asset_type"))
    return symbols.route(parts.select(symbols.normalize(code).alias("symbol")).distinct(), master)


register(
    "src13_route_by_master",
    _routed,
    """with r as (select distinct p_partkey * 3571 % 700000 as n from part), s as (select lpad(n::varchar, greatest(6, length(n::varchar))::int, '0') as symbol from r),
m as (select lpad((p_partkey * 3571 % 700000)::varchar, greatest(6, length((p_partkey * 3571 % 700000)::varchar))::int, '0') as symbol, max(case when p_partkey % 2 = 0 then 'etf' else 'bond' end) as t from part where p_partkey % 3 = 0 group by 1)
select symbol, coalesce(t, case when symbol[1:2] = '16' then 'lof' when symbol[1:2] in ('15', '50', '51', '52', '56', '58') then 'etf'
  when symbol[1:3] in ('000', '001', '002', '003', '300', '301', '600', '601', '603', '605', '688') then 'stock' end) as asset_type from s left join m using (symbol)""",
)
register(
    "src9_src10_universe_in_order",
    lambda s, d: sources.universe(T.table(s, d, "supplier").orderBy(F.desc("s_suppkey")).select((F.col("s_suppkey") * 7 % 60).cast("string").alias("code"))).select("symbol", F.row_number().over(Window.orderBy("seq")).cast("long").alias("place")),
    """with r as (select lpad((s_suppkey * 7 % 60)::varchar, 6, '0') as symbol, row_number() over (order by s_suppkey desc) as n from supplier), f as (select symbol, min(n) as n from r group by symbol)
select symbol, row_number() over (order by n) as place from f""",
)
register(
    "src5_src8_jn10_load",
    lambda s, d: sources.load(s, f"{d.rstrip('/')}/lineitem.parquet", sources.universe(T.table(s, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("string").alias("symbol"))), "1993-01-01", "1998-06-30", lambda spark, path: T.bars(spark, path.rpartition("/")[0])).select("symbol", "timestamp", "close", "volume"),
    _with("u as (select lpad(s_suppkey::varchar, 6, '0') as symbol from supplier where s_suppkey % 3 <> 0)") + "select symbol, timestamp, close, volume from bars where symbol in (select symbol from u) and timestamp >= timestamp '1993-01-01' and timestamp < timestamp '1998-07-01'",
)
register(
    "ag9_mrg2_latest_day",
    lambda s, d: s.createDataFrame([(x := ingest.latest_day(T.table(s, d, "orders"), ["trade_date", "o_orderdate"]), ingest.incremental_start(date(1992, 1, 1), x, date(2030, 1, 1), 7))], "latest date, start date"),
    "select max(o_orderdate)::date as latest, max(o_orderdate)::date - 7 as start from orders",
)
register(
    "std8_industries",
    lambda s, d: ingest.industries(T.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.when(F.col("s_suppkey") % 5 > 0, F.lit("1995-06-01")).otherwise(F.lit("unknown")).alias("from"), F.col("s_nationkey").cast("string").alias("code"), F.col("s_name").alias("industry_level_1")), {"change_date": "from", "industry_code": "code"}).select("symbol", "change_date", "industry_level_1", "industry_code"),
    "select s_suppkey::varchar as symbol, date '1995-06-01' as change_date, s_name as industry_level_1, s_nationkey::varchar as industry_code from supplier where s_suppkey % 5 > 0",
)
register(
    "std10_benchmark",
    lambda s, d: ingest.benchmark(T.benchmark(s, d).select(F.col("timestamp").cast("string").alias("trade_date"), F.col("close").cast("string").alias("close"))),
    "with " + T.BENCHMARK_SQL + " select timestamp, close from index_series",
)
register("ag7_coverage", lambda s, d: rounded(diagnostics.coverage(T.scored(s, d), ["prediction", "label"]), ["prediction", "label"], 6, ()), _with(_SCORED) + "select round(avg((p is not null)::int), 6) as prediction, round(avg((y is not null)::int), 6) as label from scored")
