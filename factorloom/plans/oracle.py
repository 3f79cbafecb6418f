"""DuckDB texts that the queries are held against."""

from __future__ import annotations

from factorloom.operators.factors import STANDARD_WINDOWS
from factorloom.plans.fixtures import duck_ctes
from factorloom.sources.panel import DAILY_FUNDAMENTALS, FILED

_W = "PARTITION BY symbol ORDER BY date"

PANEL = f"""
WITH {duck_ctes()},
ins AS (SELECT s_suppkey AS symbol, r_name AS industry, s_acctbal AS float_mv FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey),
panel AS (SELECT s AS symbol, d AS date, open, high, low, close, vol AS volume, amount, coalesce(industry, 'UNKNOWN') AS industry,
            coalesce(float_mv, 0.0) AS float_mv, vol / 100 AS turnover_rate, date_diff('day', min(d) OVER (PARTITION BY s), d) AS listed_days,
            coalesce(close / nullif(open, 0) - 1 >= 0.098, FALSE) AS is_limit_up FROM wk LEFT JOIN ins ON ins.symbol = s),
s0 AS (SELECT *, lag(close) OVER ({_W}) AS prev_close FROM panel),
s1 AS (SELECT *, close / nullif(prev_close, 0) - 1 AS daily_ret, open / nullif(prev_close, 0) - 1 AS gap_1,
         greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS true_range, abs(close - prev_close) AS abs_diff FROM s0)"""


def roll(f: str, c: str, n) -> str:
    frame = f"OVER ({_W} ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({c}) {frame} = {n} THEN {f}({c}) {frame} END)"


def ret(n) -> str:
    return f"(close / nullif(lag(close, {n}) OVER ({_W}), 0) - 1)"


def rel(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0) - 1)"


def ma(n):
    return roll("avg", "close", n)


def hi(n):
    return roll("max", "high", n)


def lo(n):
    return roll("min", "low", n)


def vol(n):
    return roll("stddev_samp", "daily_ret", n)


def zs(c, n):
    return f"(({c} - {roll('avg', c, n)}) / nullif({roll('stddev_samp', c, n)}, 0))"


def chan(n):
    return f"((close - {lo(n)}) / nullif({hi(n)} - {lo(n)}, 0))"


def mean(c, n):
    return roll("avg", c, n)


FACTOR = {
    "ret": ret, "close_to_ma": lambda n: rel("close", ma(n)), "trend": lambda f, s: rel(ma(f), ma(s)),
    "ma_spread": lambda f, m, s: f"(({ma(f)} - {ma(m)}) / nullif({ma(s)}, 0))", "vol": vol, "amp": lambda n: rel(hi(n), lo(n)),
    "turnover": lambda n: mean("turnover_rate", n), "ret_reversal": lambda f, s: f"({ret(f)} - {ret(s)})", "vol_ratio": lambda f, s: rel(vol(f), vol(s)),
    "turnover_ratio": lambda f, s: rel(mean("turnover_rate", f), mean("turnover_rate", s)), "channel_pos": lambda n: f"({chan(n)} - 0.5)",
    "close_to_high": lambda n: rel("close", hi(n)), "distance_to_high": lambda n: rel("close", hi(n)), "close_to_low": lambda n: rel("close", lo(n)),
    "distance_to_low": lambda n: f"((close - {lo(n)}) / nullif({lo(n)}, 0))", "price_zscore": lambda n: zs("close", n),
    "efficiency_ratio": lambda n: f"(abs(close - lag(close, {n}) OVER ({_W})) / nullif({roll('sum', 'abs_diff', n)}, 0))",
    "atr": lambda n: f"({mean('true_range', n)} / nullif(close, 0))", "atr_ratio": lambda f, s: rel(mean("true_range", f), mean("true_range", s)),
    "breakout_ratio": chan, "amount_zscore": lambda n: zs("amount", n), "turnover_zscore": lambda n: zs("turnover_rate", n),
}

SINGLE = {
    "amount_ratio_5_20": f"{mean('amount', 5)} / nullif({mean('amount', 20)}, 0)", "amount_ratio_1_20": rel("amount", mean("amount", 20)), "gap_1": "gap_1",
    "intraday_ret_1": rel("close", "open"), "overnight_ret_5": mean("gap_1", 5), "range_pct_1": "(high - low) / nullif(close, 0)",
    "vol_compress_5_20": f"-abs({rel(vol(10), vol(20))})", "vol_compress_10_60": f"-abs({rel(vol(10), vol(60))})",
    "turnover_shock_1_20": rel("turnover_rate", mean("turnover_rate", 20)), "turnover_shock_5_60": rel(mean("turnover_rate", 5), mean("turnover_rate", 60)),
    "price_volume_div_5": f"{ret(5)} - {rel(mean('amount', 5), mean('amount', 20))}",
    "price_volume_div_20": f"{ret(20)} - {rel(mean('amount', 20), mean('amount', 60))}", "rebound_from_low_20": f"{rel('close', lo(20))} - {ret(20)}",
    "amount_trend_5": rel(mean("amount", 5), mean("amount", 20)), "float_mv_log": "ln(greatest(float_mv, 1))",
}

#: Every factor that needs bars only: the registered names with windows, and the single ones.
EVERY = {f"{t}_{w}": FACTOR[t](*w.split("_")) for t, ws in STANDARD_WINDOWS.items() for w in ws.split()} | SINGLE

DAY = "strftime(date, '%Y-%m-%d') AS date"


def factors(columns: dict[str, str]) -> str:
    return f"{PANEL}\nSELECT symbol, {DAY}, " + ", ".join(f"round({e} + 1e-9, 6) + 0.0 AS {n}" for n, e in columns.items()) + " FROM s1"


def label(h: int) -> str:
    return f"(lead(close, {h}) OVER ({_W}) / nullif(lead(open, 1) OVER ({_W}), 0) - 1)"


#: Rows with a score (the 5-bar return), a second factor, a target and the universe's flag.
SCORED = f"""{PANEL},
sc AS (SELECT symbol, date, open, industry, float_mv, is_limit_up, {ret(5)} AS score, {zs("close", 20)} AS z, {label(10)} AS target,
         coalesce(listed_days >= 140 AND {roll("avg", "amount", 20)} >= 30000, FALSE) AS ok FROM s1)"""

#: Whole-number quantile buckets of rank r among n, q of them.
BUCKET = "greatest(1, coalesce(((r - 1) * {q} + n - 2) // nullif(n - 1, 0), 1))"

SIGNAL = f"""{SCORED},
sg AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS r, count(*) OVER (PARTITION BY date) AS n,
         rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS sr,
         rank() OVER (PARTITION BY date ORDER BY target) + (count(*) OVER (PARTITION BY date, target) - 1) / 2.0 AS tr
       FROM sc WHERE ok AND score IS NOT NULL AND target IS NOT NULL),
sb AS (SELECT *, {BUCKET.format(q=5)} AS b FROM sg WHERE n >= 5),
daily AS (SELECT date, max(n) AS n, covar_pop(score, target) / nullif(stddev_pop(score) * stddev_pop(target), 0) AS pearson_ic,
            covar_pop(sr, tr) / nullif(stddev_pop(sr) * stddev_pop(tr), 0) AS rank_ic,
            avg(target) FILTER (b = 5) - avg(target) FILTER (b = 1) AS top_bottom_spread FROM sb GROUP BY date),
br AS (SELECT date, {", ".join(f"avg(target) FILTER (b = {k}) AS Q{k}" for k in range(1, 6))}, avg(target) FILTER (b = 5) - avg(target) FILTER (b = 1) AS long_short
       FROM sb GROUP BY date)"""

FEATURES = f"""{SCORED},
lf AS (SELECT symbol, date, target, 'ret_5' AS feature, score AS value FROM sc WHERE ok AND target IS NOT NULL
       UNION ALL SELECT symbol, date, target, 'price_zscore_20', CASE WHEN symbol % 3 <> 0 THEN z END FROM sc WHERE ok AND target IS NOT NULL),
rf AS (SELECT *, count(*) OVER (PARTITION BY date, feature) AS rows, count(value) OVER (PARTITION BY date, feature) AS n,
         CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY date, feature, value IS NULL ORDER BY value, symbol) END AS r,
         CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY date, feature, value IS NULL ORDER BY value)
           + (count(*) OVER (PARTITION BY date, feature, value) - 1) / 2.0 END AS vr,
         rank() OVER (PARTITION BY date, feature ORDER BY target) + (count(*) OVER (PARTITION BY date, feature, target) - 1) / 2.0 AS tr FROM lf),
bf AS (SELECT *, CASE WHEN r IS NOT NULL THEN {BUCKET.format(q=5)} END AS b FROM rf),
fd AS (SELECT date, feature,
         CASE WHEN min(value) < max(value) THEN covar_pop(value, target) / nullif(stddev_pop(value) * stddev_pop(target) FILTER (value IS NOT NULL), 0) END AS pearson_ic,
         CASE WHEN min(vr) < max(vr) THEN covar_pop(vr, tr) / nullif(stddev_pop(vr) * stddev_pop(tr) FILTER (vr IS NOT NULL), 0) END AS rank_ic,
         avg(target) FILTER (b = 5 AND n >= 5) - avg(target) FILTER (b = 1 AND n >= 5) AS top_bottom_spread
       FROM bf WHERE rows >= 2 AND n > 0 GROUP BY date, feature)"""


def info_ratio(c: str) -> str:
    return f"coalesce(CASE WHEN stddev_pop({c}) > 0 THEN avg({c}) / stddev_pop({c}) END, 0.0)"


POSITIONS = f"""{SCORED},
cal AS (SELECT DISTINCT date FROM sc),
reb AS (SELECT arg_max(date, row(isodow(date) - 1 = 0, date)) AS date FROM cal GROUP BY isoyear(date), week(date)),
reb4 AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM reb) WHERE (k - 1) % 4 = 0),
pos AS (SELECT date, symbol, least(1.0 / count(*) OVER (PARTITION BY date), 0.12) AS w FROM
         (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS r FROM sc WHERE ok AND score IS NOT NULL AND date IN (FROM reb4))
        WHERE r <= 12),
nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM cal),
sig AS (SELECT date, lead(date) OVER (ORDER BY date) AS exit_sig FROM (SELECT DISTINCT date FROM pos)),
trd AS (SELECT p.date, p.symbol, a.nxt AS trade_date, e.open AS entry_open, x.open AS exit_open, p.w * (x.open / e.open - 1 - 0.002) AS wr
        FROM pos p JOIN sig USING (date) JOIN nx a ON a.date = p.date JOIN nx b ON b.date = sig.exit_sig
        JOIN sc e ON e.date = a.nxt AND e.symbol = p.symbol AND NOT e.is_limit_up JOIN sc x ON x.date = b.nxt AND x.symbol = p.symbol),
pf AS (SELECT trade_date AS date, sum(wr) AS portfolio_ret FROM trd GROUP BY trade_date),
bt AS (SELECT *, product(1 + portfolio_ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM pf)"""


def metrics(source: str, keys: str = "", tag: str = "") -> str:
    """Metrics over (date, portfolio_ret, equity); ``mx`` and the tag name the result."""
    part = f"PARTITION BY {keys} " if keys else ""
    k, lead_ = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""
mg{tag} AS (SELECT *, date_diff('day', lag(date) OVER ({part}ORDER BY date), date) AS gap, max(equity) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM {source}),
ma{tag} AS (SELECT {k}count(*) AS periods, median(gap) AS g, arg_max(equity, date) AS e, avg(portfolio_ret) AS m, stddev_pop(portfolio_ret) AS s,
         min(equity / nullif(peak, 0) - 1) AS max_drawdown FROM mg{tag} {lead_}),
mt{tag} AS (SELECT {k}periods, CASE WHEN g > 0 THEN 365.25 / g ELSE 52.0 END AS ppy, e, m, s, max_drawdown FROM ma{tag}),
mx{tag} AS (SELECT {k}'ok' AS status, periods, ppy AS periods_per_year_est, CASE WHEN e > 0 THEN pow(e, ppy / periods) - 1 ELSE -1.0 END AS annual_return_est,
         s * sqrt(ppy) AS annual_vol_est, coalesce(m / nullif(s, 0), 0.0) * sqrt(ppy) AS sharpe_est, max_drawdown FROM mt{tag})"""


METRIC_COLUMNS = ("periods_per_year_est", "annual_return_est", "annual_vol_est", "sharpe_est", "max_drawdown")


def rounds(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


RAW_PANEL = f"""
WITH {duck_ctes("daily_kline", "daily_basic", "stock_basic", "index_weight", "filings_raw")},
filings AS (SELECT ts_code, ann_date, end_date, {", ".join(f"CAST(CAST(TRY_CAST({f} AS DOUBLE) AS FLOAT) AS DOUBLE) AS {f}" for f in FILED)} FROM filings_raw
            QUALIFY row_number() OVER (PARTITION BY ts_code, ann_date, end_date ORDER BY update_flag DESC) = 1),
wd AS (SELECT DISTINCT trade_date AS weight_date FROM index_weight),
base AS (SELECT k.*, b.turnover_rate, {", ".join("b." + f for f in DAILY_FUNDAMENTALS)}, b.circ_mv, m.name, m.industry, m.list_date,
           row_number() OVER (PARTITION BY k.trade_date ORDER BY b.circ_mv DESC NULLS LAST, k.ts_code) AS rk,
           (SELECT max(weight_date) FROM wd WHERE weight_date <= k.trade_date) AS snap
         FROM daily_kline k LEFT JOIN daily_basic b USING (ts_code, trade_date) LEFT JOIN stock_basic m USING (ts_code)),
fdate AS (SELECT k.ts_code, k.trade_date, max(f.ann_date) AS ann FROM daily_kline k JOIN (SELECT ts_code, ann_date FROM filings) f
          ON f.ts_code = k.ts_code AND f.ann_date <= k.trade_date GROUP BY ALL),
full_panel AS (SELECT base.*, w.weight AS index_weight, w.con_code, {", ".join("f." + f for f in FILED)} FROM base
         LEFT JOIN index_weight w ON w.con_code = base.ts_code AND w.trade_date = base.snap
         LEFT JOIN fdate ON fdate.ts_code = base.ts_code AND fdate.trade_date = base.trade_date LEFT JOIN filings f ON f.ts_code = base.ts_code AND f.ann_date = fdate.ann)"""


_YEARLY_FACTORS = {
    "ret_5": ret(5), "price_zscore_20": f"CASE WHEN symbol % 3 <> 0 THEN {zs('close', 20)} END", "gap_1": "gap_1", "vol_10": vol(10),
}
_MEANS = ", ".join(f"avg(target) FILTER (b = {k}) AS Q{k}" for k in range(1, 6))

#: The yearly report of four factors: daily statistics, directions, curves of the buckets in that direction, excess over the index.
YEARLY = f"""{PANEL}, {duck_ctes("index_daily")[len(duck_ctes()) + 2 :]},
ix AS (SELECT strptime(trade_date, '%Y%m%d') AS date, coalesce(close / nullif(pre_close, 0) - 1, 0) AS benchmark_ret FROM index_daily),
s4 AS (SELECT symbol, date, {label(10)} AS target, coalesce(listed_days >= 140 AND {roll("avg", "amount", 20)} >= 30000, FALSE) AS ok,
         {", ".join(f"{e} AS {n}" for n, e in _YEARLY_FACTORS.items())} FROM s1),
lf AS (SELECT symbol, date, target, feature, value FROM s4 UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(_YEARLY_FACTORS)})) WHERE ok),
qu AS (SELECT date, feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM lf WHERE value IS NOT NULL GROUP BY ALL),
lt AS (SELECT symbol, date, feature, target, value, CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END AS x FROM lf LEFT JOIN qu USING (date, feature) WHERE target IS NOT NULL),
rf AS (SELECT *, count(*) OVER (PARTITION BY date, feature) AS rows, count(value) OVER (PARTITION BY date, feature) AS n,
         rank() OVER (PARTITION BY date, feature ORDER BY target) + (count(*) OVER (PARTITION BY date, feature, target) - 1) / 2.0 AS tr,
         CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY date, feature, value IS NULL ORDER BY value) + (count(*) OVER (PARTITION BY date, feature, value) - 1) / 2.0 END AS vr,
         row_number() OVER (PARTITION BY date, feature, value IS NULL ORDER BY value, symbol) AS r0, row_number() OVER (PARTITION BY date, feature, value IS NULL ORDER BY x, symbol) AS r1,
         row_number() OVER (PARTITION BY date, feature, value IS NULL ORDER BY x DESC, symbol) AS r2 FROM lt),
bf AS (SELECT *, year(date) AS year, {", ".join(BUCKET.format(q=5).replace("((r -", f"((r{k} -") + f" AS b{k}" for k in range(3))} FROM rf),
fd AS (SELECT year, date, feature, CASE WHEN min(value) < max(value) THEN covar_pop(value, target) / nullif(stddev_pop(value) * stddev_pop(target) FILTER (value IS NOT NULL), 0) END AS pearson_ic,
         CASE WHEN min(vr) < max(vr) THEN covar_pop(vr, tr) / nullif(stddev_pop(vr) * stddev_pop(tr) FILTER (vr IS NOT NULL), 0) END AS rank_ic,
         avg(target) FILTER (value IS NOT NULL AND b0 = 5 AND n >= 5) - avg(target) FILTER (value IS NOT NULL AND b0 = 1 AND n >= 5) AS top_bottom_spread
       FROM bf WHERE rows >= 2 AND n > 0 GROUP BY ALL),
yr AS (SELECT year, feature, avg(rank_ic) AS mean_rank_ic, {info_ratio("rank_ic")} AS rank_ic_ir, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_rank_ic_ratio,
         avg(top_bottom_spread) AS mean_top_bottom_spread, CASE WHEN avg(rank_ic) < 0 THEN -1 ELSE 1 END AS direction FROM fd GROUP BY ALL),
br AS (SELECT *, Q5 - Q1 AS long_short FROM (SELECT year, feature, date, {_MEANS}
       FROM (SELECT bf.*, CASE WHEN direction < 0 THEN b2 ELSE b1 END AS b FROM bf JOIN yr USING (year, feature) WHERE value IS NOT NULL AND n >= 5) GROUP BY ALL)),
un AS (SELECT year, feature, date, bucket, portfolio_ret FROM br UNPIVOT (portfolio_ret FOR bucket IN (Q1, Q2, Q3, Q4, Q5, long_short))),
gc AS (SELECT *, product(1 + portfolio_ret) OVER (PARTITION BY year, feature, bucket ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM un),{metrics("gc", "year, feature, bucket")},
ob AS (SELECT year, feature, date, Q5 - benchmark_ret AS portfolio_ret FROM br JOIN ix USING (date)),
oc AS (SELECT *, product(1 + portfolio_ret) OVER (PARTITION BY year, feature ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM ob),{metrics("oc", "year, feature", "o")},
mm AS (SELECT year, feature, count(*) AS coverage_dates, avg(Q1) AS a, avg(Q2) AS b, avg(Q3) AS c, avg(Q4) AS d, avg(Q5) AS e FROM br GROUP BY ALL),
sp AS (SELECT year, feature, corr(i, r) AS spearman FROM (SELECT year, feature, i, rank() OVER (PARTITION BY year, feature ORDER BY v) AS r
       FROM (SELECT year, feature, unnest([1, 2, 3, 4, 5]) AS i, unnest([a, b, c, d, e]) AS v FROM mm)) GROUP BY ALL),
ls AS (SELECT year, feature, max(annual_return_est) FILTER (bucket = 'long_short') AS ls, max(sharpe_est) FILTER (bucket = 'long_short') AS lsh,
         max(annual_return_est) FILTER (bucket = 'Q5') AS tb, max(annual_return_est) FILTER (bucket = 'Q1') AS bb FROM mx GROUP BY ALL),
an AS (SELECT yr.*, direction < 0 AS sign_flipped, coverage_dates, ls, lsh, tb, bb, o.annual_return_est AS ex, o.sharpe_est AS exs, spearman AS sp,
         coalesce(b >= a AND c >= b AND d >= c AND e >= d, FALSE) AS mi, coalesce(b <= a AND c <= b AND d <= c AND e <= d, FALSE) AS md
       FROM yr LEFT JOIN mm USING (year, feature) LEFT JOIN sp USING (year, feature) LEFT JOIN ls USING (year, feature) LEFT JOIN mxo o USING (year, feature))"""
