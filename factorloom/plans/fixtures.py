"""Raw market tables derived from the driver's tables, for the queries and for tests.

One text per table serves Spark and DuckDB; only three spellings differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factorloom.functions.lineage import cut
from factorloom.sources.panel import FILED
from factorloom.sources.tables import read_table

SPARK = {"ROW": "struct", "YMD": "date_format({}, 'yyyyMMdd')"}
DUCK = {"ROW": "row", "YMD": "strftime({}, '%Y%m%d')"}

_CODE = (
    "concat(CASE s % 4 WHEN 0 THEN '300' WHEN 1 THEN '688' WHEN 2 THEN '000' ELSE '600' END, lpad(CAST(s AS STRING), 4, '0'), '.X')"
)

_CTES = {
    "wk": """SELECT l_suppkey AS s, date_trunc('week', l_shipdate) AS d, min_by(p, k) AS open, max(p) AS high, min(p) AS low, max_by(p, k) AS close,
  sum(l_quantity) AS vol, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS p, ROW(l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS k FROM lineitem) GROUP BY 1, 2""",
    "daily_kline": f"""SELECT {_CODE} AS ts_code, YMD(d) AS trade_date, open, high, low, close, lag(close) OVER (PARTITION BY s ORDER BY d) AS pre_close,
  vol, amount FROM wk""",
    "daily_basic": f"""SELECT {_CODE} AS ts_code, YMD(d) AS trade_date, vol / 100.0 AS turnover_rate, CASE WHEN s % 5 <> 0 THEN close / 10.0 END AS pe_ttm,
  close / 100.0 AS pb, CAST(s % 3 AS DOUBLE) AS ps_ttm, vol / 7.0 AS dv_ttm, CASE WHEN s % 11 <> 0 THEN CAST(s_acctbal AS DOUBLE) END AS circ_mv
  FROM wk JOIN supplier ON s_suppkey = s WHERE s % 7 <> 0""",
    "stock_basic": f"""SELECT {_CODE} AS ts_code, concat(CASE s % 10 WHEN 0 THEN '*ST' WHEN 1 THEN 'ST' WHEN 2 THEN 'S*ST' ELSE 'N' END, CAST(s AS STRING)) AS name,
  CASE WHEN s % 6 <> 0 THEN r_name END AS industry, CASE WHEN s % 9 <> 0 THEN YMD(f) END AS list_date
  FROM (SELECT s, min(d) AS f FROM wk GROUP BY s) JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE s % 13 <> 0""",
    "index_weight": f"""SELECT '000852.SH' AS index_code, {_CODE} AS con_code, YMD(m) AS trade_date, 100.0 / rk AS weight
  FROM (SELECT s, date_trunc('month', d) AS m, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY sum(amount) DESC, s) AS rk FROM wk GROUP BY 1, 2)
  WHERE rk <= 20 AND m >= TIMESTAMP '1996-01-01 00:00:00'""",
    "index_daily": """SELECT '000852.SH' AS ts_code, YMD(d) AS trade_date, c AS close, lag(c) OVER (ORDER BY d) AS pre_close
  FROM (SELECT d, round(avg(close), 6) AS c FROM wk GROUP BY d)""",
    "filings_raw": f"""SELECT {_CODE} AS ts_code, YMD(q + INTERVAL '3' MONTH + INTERVAL '29' DAY) AS ann_date, YMD(q + INTERVAL '3' MONTH - INTERVAL '1' DAY) AS end_date,
  CAST(u AS STRING) AS update_flag, """
    + ", ".join(f"CASE WHEN (s + {k}) % 4 <> 0 THEN CAST(round(a * {k + 1} + b + u + 1e-7, 4) AS STRING) ELSE 'n/a' END AS {f}" for k, f in enumerate(FILED))
    + """ FROM (SELECT l_suppkey AS s, date_trunc('quarter', l_shipdate) AS q, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1, 2)
  CROSS JOIN (SELECT 0 AS u UNION ALL SELECT 1 AS u) WHERE u = 0 OR s % 2 = 0""",
}

_SOURCES = ("lineitem", "supplier", "nation", "region")


def _spell(text: str, dialect: dict[str, str]) -> str:
    text = text.replace("ROW(", dialect["ROW"] + "(")
    out, at = [], 0
    for m in re.finditer(r"YMD\(", text):  # the argument may hold brackets
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += [text[at : m.start()], dialect["YMD"].format(text[m.end() : end - 1])]
        at = end
    return "".join(out) + text[at:]


def duck_ctes(*names: str) -> str:
    """``name AS (...)`` of the tables and what they build on, for DuckDB."""
    wanted = ["wk", *names]
    return ",\n".join(f"{n} AS ({_spell(_CTES[n], DUCK)})" for n in _CTES if n in wanted)


def raw_table(spark: SparkSession, sf_dir: str, name: str, wk: DataFrame | None = None, supplier: bool = False) -> DataFrame:
    """One of the raw tables as a DataFrame; ``wk``: the weekly bars that several are derived from, where they are there already.

    ``supplier`` adds its key ``s``: codes are cut to four digits, so suppliers above 9,999 share theirs with others.
    """
    text = _spell(_CTES[name], SPARK)
    if supplier:
        text = text.replace("SELECT ", "SELECT s, ", 1)
    for s in (*_SOURCES, "wk"):
        text = re.sub(rf"(FROM|JOIN) {s}\b", rf"\1 {{{s}}}", text)
    used = {s: read_table(spark, sf_dir, s) for s in _SOURCES if "{" + s + "}" in text}
    if "{wk}" in text:
        used["wk"] = raw_table(spark, sf_dir, "wk") if wk is None else wk
    return spark.sql(text, **used)


def raw_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Several raw tables over weekly bars that are derived and written once."""
    wk = cut(raw_table(spark, sf_dir, "wk"), "wk")
    return {n: raw_table(spark, sf_dir, n, wk) for n in names}
