"""The factor catalog: one declarative table of templates gives columns and metadata.

A factor is a template with whole-number parameters, named like ``ret_5`` or
``ma_spread_5_20_60``. Any window is allowed; names that no template takes are
left out. All factors over a symbol's rows share one partitioning and order, so
Spark plans one sort; statistics of first-stage columns (returns, gaps, true
ranges) need a second projection. A rolling statistic that several factors use
is computed once: Spark would walk its window again for each use.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.windows import by_symbol, ratio, rolling

PRICE, LIQUID, RANGE, CLOSE = ("close", "high", "low"), ("amount", "turnover_rate", "close"), ("close", "high", "low", "open"), ("close",)


#: Rolling columns of the factors that are being built, by name; None outside of ``add_factors``.
_ROLLED: ContextVar[dict[str, Column] | None] = ContextVar("rolled", default=None)


def _roll(fn, c: str, n: int) -> Column:
    """``rolling``; inside ``add_factors`` the name of a column that all its uses share."""
    shared = _ROLLED.get()
    if shared is None:
        return rolling(fn, c, n)
    name = f"__{fn.__name__}_{c}_{n}"
    if name not in shared:
        shared[name] = rolling(fn, c, n)
    return F.col(name)


def _mean(c, n):
    return _roll(F.avg, c, n)


def _std(c, n):
    return _roll(F.stddev_samp, c, n)


def _ma(n):
    return _mean("close", n)


def _hi(n):
    return _roll(F.max, "high", n)


def _lo(n):
    return _roll(F.min, "low", n)


def _lag(n):
    return F.lag("close", n).over(by_symbol())


def _ret(n):
    return ratio("close_ff", F.lag("close_ff", n).over(by_symbol())) - 1


def _vol(n):
    return _std("daily_ret", n)


def _channel(n):
    return ratio(F.col("close") - _lo(n), _hi(n) - _lo(n))


def _zscore(c, n):
    return ratio(F.col(c) - _mean(c, n), _std(c, n))


def _rel(a: Column, b: Column) -> Column:
    return ratio(a, b) - 1


@dataclass(frozen=True)
class Template:
    """One row of the table; ``pattern`` holds the name's parameters as groups."""

    pattern: str
    build: Callable[..., Column]
    text: str
    family: str
    subfamily: str
    label: str = "direct"
    needs: tuple[str, ...] = CLOSE


def _t(name: str, groups: int, *rest, **more) -> Template:
    return Template(name + r"_(\d+)" * groups, *rest, **more)


TEMPLATES: tuple[Template, ...] = (
    _t("ret", 1, _ret, "close / lag(close, {0}) - 1", "reversal", "return_reversal", "return", PRICE),
    _t("close_to_ma", 1, lambda n: _rel(F.col("close"), _ma(n)), "close / mean(close, {0}) - 1", "sma", "price_vs_ma", "close_to_ma", PRICE),
    _t("trend", 2, lambda f, s: _rel(_ma(f), _ma(s)), "mean(close, {0}) / mean(close, {1}) - 1", "sma", "ma_ratio", "trend_ratio", PRICE),
    _t("ma_spread", 3, lambda f, m, s: ratio(_ma(f) - _ma(m), _ma(s)), "(mean(close, {0}) - mean(close, {1})) / mean(close, {2})", "sma", "ma_spread",
       "ma_spread", PRICE),
    _t("vol", 1, _vol, "std(daily return, {0})", "volatility", "vol_amp", needs=RANGE),
    _t("amp", 1, lambda n: _rel(_hi(n), _lo(n)), "max(high, {0}) / min(low, {0}) - 1", "volatility", "vol_amp", needs=RANGE),
    _t("turnover", 1, lambda n: _mean("turnover_rate", n), "mean(turnover_rate, {0})", "liquidity", "turnover_amount", needs=LIQUID),
    _t("ret_reversal", 2, lambda f, s: _ret(f) - _ret(s), "return over {0} less return over {1}", "reversal", "return_reversal", "return_spread", PRICE),
    _t("vol_ratio", 2, lambda f, s: _rel(_vol(f), _vol(s)), "std(daily return, {0}) / std(daily return, {1}) - 1", "volatility", "vol_amp", "vol_ratio",
       RANGE),
    _t("turnover_ratio", 2, lambda f, s: _rel(_mean("turnover_rate", f), _mean("turnover_rate", s)), "mean turnover over {0} / over {1} - 1", "liquidity",
       "turnover_amount", "turnover_ratio", LIQUID),
    _t("channel_pos", 1, lambda n: _channel(n) - 0.5, "place of close between low and high of {0}, less 0.5", "path", "price_position",
       "channel_position", PRICE),
    _t("close_to_high", 1, lambda n: _rel(F.col("close"), _hi(n)), "close / max(high, {0}) - 1", "path", "price_position"),
    _t("distance_to_high", 1, lambda n: _rel(F.col("close"), _hi(n)), "close / max(high, {0}) - 1", "path", "price_position", "distance_to_high", PRICE),
    _t("close_to_low", 1, lambda n: _rel(F.col("close"), _lo(n)), "close / min(low, {0}) - 1", "path", "price_position"),
    _t("distance_to_low", 1, lambda n: ratio(F.col("close") - _lo(n), _lo(n)), "(close - min(low, {0})) / min(low, {0})", "path", "price_position",
       "distance_to_low", PRICE),
    _t("price_zscore", 1, lambda n: _zscore("close", n), "(close - mean) / std over {0}", "path", "price_standardized", "price_zscore", PRICE),
    _t("efficiency_ratio", 1, lambda n: ratio(F.abs(F.col("close") - _lag(n)), _roll(F.sum, "abs_diff", n)), "net over gross move of {0}",
       "volatility", "trend_efficiency", "efficiency_ratio", RANGE),
    _t("atr", 1, lambda n: ratio(_mean("true_range", n), "close"), "mean(true range, {0}) / close", "volatility", "true_range", "atr", RANGE),
    _t("atr_ratio", 2, lambda f, s: _rel(_mean("true_range", f), _mean("true_range", s)), "mean true range over {0} / over {1} - 1", "volatility",
       "true_range", "atr_ratio", RANGE),
    _t("breakout_ratio", 1, _channel, "place of close between low and high of {0}", "path", "breakout", "breakout_ratio", PRICE),
    _t("amount_zscore", 1, lambda n: _zscore("amount", n), "(amount - mean) / std over {0}", "liquidity", "amount_anomaly", "amount_zscore", LIQUID),
    _t("turnover_zscore", 1, lambda n: _zscore("turnover_rate", n), "(turnover_rate - mean) / std over {0}", "liquidity", "turnover_anomaly",
       "turnover_zscore", LIQUID),
    Template("amount_ratio_5_20", lambda: ratio(_mean("amount", 5), _mean("amount", 20)), "mean(amount, 5) / mean(amount, 20)", "liquidity",
             "turnover_amount", needs=LIQUID),
    Template("amount_ratio_1_20", lambda: _rel(F.col("amount"), _mean("amount", 20)), "amount / mean(amount, 20) - 1", "liquidity", "turnover_amount",
             needs=LIQUID),
    Template("gap_1", lambda: F.col("gap_1"), "open / lag(close) - 1", "reversal", "return_reversal"),
    Template("intraday_ret_1", lambda: _rel(F.col("close"), F.col("open")), "close / open - 1", "reversal", "return_reversal"),
    Template("overnight_ret_5", lambda: _mean("gap_1", 5), "mean(gap_1, 5)", "reversal", "return_reversal"),
    Template("range_pct_1", lambda: ratio(F.col("high") - F.col("low"), "close"), "(high - low) / close", "volatility", "vol_amp", needs=RANGE),
    Template("vol_compress_5_20", lambda: -F.abs(_rel(_vol(10), _vol(20))), "-abs(std(daily return, 10) / std(daily return, 20) - 1)", "volatility",
             "vol_amp", needs=RANGE),
    Template("vol_compress_10_60", lambda: -F.abs(_rel(_vol(10), _vol(60))), "-abs(std(daily return, 10) / std(daily return, 60) - 1)", "volatility",
             "vol_amp", needs=RANGE),
    Template("turnover_shock_1_20", lambda: _rel(F.col("turnover_rate"), _mean("turnover_rate", 20)), "turnover_rate / mean(turnover_rate, 20) - 1",
             "liquidity", "turnover_amount", needs=LIQUID),
    Template("turnover_shock_5_60", lambda: _rel(_mean("turnover_rate", 5), _mean("turnover_rate", 60)), "mean turnover over 5 / over 60 - 1", "liquidity",
             "turnover_amount", needs=LIQUID),
    Template("price_volume_div_5", lambda: _ret(5) - _rel(_mean("amount", 5), _mean("amount", 20)), "return over 5 less growth of amount 5 on 20",
             "liquidity", "turnover_amount", needs=LIQUID),
    Template("price_volume_div_20", lambda: _ret(20) - _rel(_mean("amount", 20), _mean("amount", 60)), "return over 20 less growth of amount 20 on 60",
             "liquidity", "turnover_amount", needs=LIQUID),
    Template("rebound_from_low_20", lambda: _rel(F.col("close"), _lo(20)) - _ret(20), "close / min(low, 20) - 1 less return over 20", "reversal",
             "return_reversal"),
    Template("amount_trend_5", lambda: _rel(_mean("amount", 5), _mean("amount", 20)), "mean(amount, 5) / mean(amount, 20) - 1", "liquidity",
             "turnover_amount", needs=LIQUID),
    Template("float_mv_log", lambda: F.ln(F.greatest(F.col("float_mv"), F.lit(1.0))), "ln(max(float_mv, 1))", "size", "size", needs=("float_mv",)),
)

#: A fundamental factor, the column behind it, and how it is used.
FUNDAMENTAL_FACTORS = {
    "value_earnings_yield": ("pe_ttm", "inverse"), "value_book_to_price": ("pb", "inverse"), "value_sales_yield": ("ps_ttm", "inverse"),
    "value_dividend_yield": ("dv_ttm", "same"), "quality_roe": ("roe", "same"), "quality_roe_dt": ("roe_dt", "same"), "quality_roa": ("roa", "same"),
    "quality_roic": ("roic", "same"), "quality_grossprofit_margin": ("grossprofit_margin", "same"),
    "quality_netprofit_margin": ("netprofit_margin", "same"), "quality_ocfps": ("ocfps", "same"), "quality_cfps": ("cfps", "same"),
    "quality_profit_dedt_to_mv": ("profit_dedt", "per float_mv"), "leverage_debt_to_assets": ("debt_to_assets", "negative"),
    "solvency_current_ratio": ("current_ratio", "same"), "solvency_quick_ratio": ("quick_ratio", "same"),
    "growth_basic_eps_yoy": ("basic_eps_yoy", "same"), "growth_dt_eps_yoy": ("dt_eps_yoy", "same"), "growth_netprofit_yoy": ("netprofit_yoy", "same"),
    "growth_dt_netprofit_yoy": ("dt_netprofit_yoy", "same"), "growth_ocf_yoy": ("ocf_yoy", "same"), "growth_revenue_yoy": ("tr_yoy", "same"),
    "growth_operating_revenue_yoy": ("or_yoy", "same"), "growth_q_sales_yoy": ("q_sales_yoy", "same"), "growth_q_op_qoq": ("q_op_qoq", "same"),
}

#: The windows of the standard set, by template.
STANDARD_WINDOWS = {
    "ret": "1 3 5 10 20 60", "close_to_ma": "5 8 10 13 16 20 21 32 34 55 60 89 120",
    "trend": "5_13 5_20 5_34 8_16 8_21 10_20 13_34 13_55 16_48 20_60 20_120 21_55 34_89 55_120",
    "ma_spread": "5_20_60 5_34_89 8_21_55 10_20_60 13_34_89 20_60_120", "vol": "10 20", "amp": "5 20", "turnover": "5 20",
    "ret_reversal": "5_20 10_60", "vol_ratio": "5_20 10_20 20_60", "turnover_ratio": "5_20 5_60 20_60", "channel_pos": "16 20 60 120",
    "close_to_high": "16 20", "distance_to_high": "20 60 120", "close_to_low": "16 20", "distance_to_low": "20 60 120",
    "price_zscore": "20 60 120", "efficiency_ratio": "10 20 60", "atr": "14 20", "atr_ratio": "14_60 20_60", "breakout_ratio": "20 60 120",
    "amount_zscore": "20 60", "turnover_zscore": "20 60",
}
SINGLE = tuple(t.pattern for t in TEMPLATES if "(" not in t.pattern)
STANDARD_FACTORS: tuple[str, ...] = (
    *(f"{name}_{w}" for name, windows in STANDARD_WINDOWS.items() for w in windows.split()), *SINGLE, *FUNDAMENTAL_FACTORS,
)


def match(name: str) -> tuple[Template, tuple[int, ...]] | None:
    """The template and parameters of a factor's name; exact names go before patterns."""
    for t in sorted(TEMPLATES, key=lambda t: "(" in t.pattern):
        if m := re.fullmatch(t.pattern, name):
            return t, tuple(int(g) for g in m.groups())
    return None


def _fundamental(name: str) -> Column:
    source, use = FUNDAMENTAL_FACTORS[name]
    c = F.col(source).cast("double")
    return {"inverse": ratio(F.lit(1.0), c), "negative": -c, "per float_mv": ratio(c, "float_mv")}.get(use, c)


def factor_column(name: str) -> Column | None:
    """The factor over a staged panel (see ``stage``); None for an unknown name."""
    if name in FUNDAMENTAL_FACTORS:
        return _fundamental(name)
    found = match(name)
    return found[0].build(*found[1]) if found else None


def stage(panel: DataFrame) -> DataFrame:
    """Add the columns that rolling statistics are taken of."""
    w = by_symbol()
    filled = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = panel.withColumns({"close_ff": filled, "prev_close": F.lag("close").over(w)})
    return out.withColumns(
        {
            "daily_ret": ratio("close_ff", F.lag("close_ff").over(w)) - 1,
            "gap_1": ratio("open", "prev_close") - 1,
            "true_range": F.greatest(
                F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))
            ),
            "abs_diff": F.abs(F.col("close") - F.col("prev_close")),
        }
    )


def add_factors(panel: DataFrame, names: list[str] | tuple[str, ...] = STANDARD_FACTORS, as_float: bool = True) -> DataFrame:
    """Add the known factors of ``names``, as float32 if ``as_float``.

    Filter dates afterwards: a filter before would shorten the windows.
    Fundamental factors whose column the panel lacks are left out.
    """
    kind, rolled = ("float" if as_float else "double"), {}
    token = _ROLLED.set(rolled)
    try:
        wanted = {n: factor_column(n) for n in names if n not in FUNDAMENTAL_FACTORS or FUNDAMENTAL_FACTORS[n][0] in panel.columns}
    finally:
        _ROLLED.reset(token)
    columns = {n: c.cast(kind).alias(n) for n, c in wanted.items() if c is not None}
    staged = stage(panel).withColumns(rolled) if rolled else stage(panel)
    return staged.select(*[c for c in panel.columns if c not in columns], *columns.values())


def describe(name: str) -> dict | None:
    """A registry row; None for an unknown name."""
    numbers = [int(n) for n in re.findall(r"\d+", name)]
    if name in FUNDAMENTAL_FACTORS:
        source, use = FUNDAMENTAL_FACTORS[name]
        kind = name.split("_")[0]
        family = {"leverage": "quality", "solvency": "quality"}.get(kind, kind)
        sub = {"value": "valuation", "quality": "profitability", "growth": "fundamental_growth"}.get(kind, kind)
        text = {"inverse": f"1 / {source}", "negative": f"-{source}", "per float_mv": f"{source} / float_mv"}.get(use, source)
        label, needs = f"fundamental_{kind}", [source, "float_mv"] if use == "per float_mv" else [source]
    else:
        found = match(name)
        if found is None:
            return None
        t, params = found
        family, sub, label, text, needs = t.family, t.subfamily, t.label, t.text.format(*params), list(t.needs)
    return {
        "feature": name, "family": family, "subfamily": sub, "template": label, "expression": text,
        "params": json.dumps({"window": numbers[0]} if len(numbers) == 1 else {"windows": numbers} if numbers else {}),
        "data_dependencies": json.dumps(needs), "calc_source": "internal", "production_ready": True, "direction_hint": "unknown",
        "status": "candidate", "notes": "",
    }


def dependencies(names=STANDARD_FACTORS) -> list[str]:
    return sorted({d for n in names if (row := describe(n)) for d in json.loads(row["data_dependencies"])})


def registry(spark: SparkSession, names=STANDARD_FACTORS) -> DataFrame:
    """One row per known factor, by family and name."""
    rows = sorted((row for n in names if (row := describe(n))), key=lambda r: (r["family"], r["feature"]))
    schema = "feature string, family string, subfamily string, template string, expression string, params string, data_dependencies string, " + (
        "calc_source string, production_ready boolean, direction_hint string, status string, notes string"
    )
    return spark.createDataFrame(rows, schema)


def registry_report(rows: DataFrame) -> DataFrame:
    """One row on a registry: its size, the features it holds twice, those not computed here or not ready, and ``ok`` or ``error``."""
    needed = ["feature", "family", "subfamily", "template", "expression", "params", "data_dependencies", "calc_source", "production_ready", "direction_hint", "status"]
    missing = [c for c in needed if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in missing})
    per = rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(~F.col("calc_source").eqNullSafe("internal")).alias("foreign"),
        F.max(~F.coalesce(F.col("production_ready").cast("boolean"), F.lit(False))).alias("unready"),
    )
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("feature"))))
    out = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("feature_count"), names(F.col("n") > 1).alias("duplicated_features"),
        names(F.col("foreign")).alias("invalid_calc_source"), names(F.col("unready")).alias("not_production_ready"),
    )
    out = out.withColumn("missing_columns", F.array(*map(F.lit, missing)).cast("array<string>"))
    wrong = F.size("missing_columns") + F.size("duplicated_features") + F.size("invalid_calc_source") + F.size("not_production_ready")
    return out.withColumn("status", F.when(wrong == 0, "ok").otherwise("error"))
