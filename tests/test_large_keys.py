"""Queries on suppliers above 9,999, whose codes are those of other suppliers."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from factorloom.plans.queries import ORACLE, QUERIES
from factorloom.sources import panel


def test_upsert_keeps_suppliers_of_one_code(spark, tmp_path):
    path = str(tmp_path / "lineitem.parquet")
    days = ("1996-01-02", "1996-01-09", "2001-01-02")
    rows = ", ".join(f"({k}, 1, {s}, {k + 2}.0, {50 * k + s % 7 + 10}.0, 0.05, 0.01, TIMESTAMP '{d} 00:00:00')" for k, (s, d) in enumerate((s, d) for s in (1000, 10000, 10004, 7) for d in days))
    db = duckdb.connect()
    db.sql(f"CREATE TABLE lineitem AS SELECT * REPLACE (l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice) FROM (VALUES {rows}) t(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)")
    db.sql(f"COPY lineitem TO '{path}'")
    want = Counter((a, b, float(c)) for a, b, c in db.sql(ORACLE["upsert"]).fetchall())
    assert Counter(tuple(r) for r in QUERIES["upsert"](spark, str(tmp_path)).collect()) == want
    assert sum(want.values()) == 12 + 2 and want["3001000.X", "20991231", 1.0] == 1


def _repeated(spark):
    """Tables in which code A has two rows of everything, B one, C a row of prices only."""
    k = [(c, "20200106", v, 2.0, 0.5, 1.0, None if v == 2.0 else v, v) for c, v in (("A", 1.0), ("A", 2.0), ("B", 3.0), ("C", 4.0), (None, 5.0))]
    b = [(c, "20200106", v, v, None, v, v, m) for c, v, m in (("A", 1.0, 70.0), ("A", 2.0, 50.0), ("B", 3.0, 60.0), (None, 4.0, 99.0), ("D", 1.0, 99.0))]
    m = [("A", "ST1", "x", "20200101"), ("A", "N1", None, None), ("B", "N2", "y", "20200103"), (None, "ST", "z", "20200101")]
    f = [("A", "20200101", "20191231", 0.5), ("B", "20200107", "20191231", 0.7)]
    w = [("000852.SH", "A", "20200101", 1.5), ("000852.SH", "A", "20200101", None), ("000852.SH", "B", "20191201", 9.0), ("000001.SH", "C", "20200101", 9.0)]
    kinds = (
        "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double",
        "ts_code string, trade_date string, turnover_rate double, pe_ttm double, pb double, ps_ttm double, dv_ttm double, circ_mv double",
        "ts_code string, name string, industry string, list_date string", "index_code string, con_code string, trade_date string, weight double", "ts_code string, ann_date string, end_date string, eps double",
    )
    return [spark.createDataFrame(rows, kind) for rows, kind in zip((k, b, m, w, f), kinds, strict=True)]


def test_panel_combines_repeated_codes_last(spark, monkeypatch):
    """Combinations of a code's rows are made above all shuffles; ranks, filings and weights are those of the combined rows."""
    k, b, m, w, f = _repeated(spark)
    monkeypatch.setattr(panel, "RANKS", (2, 6))
    rows = panel.build_panel(k, b, m, None, f)
    assert rows._jdf.queryExecution().executedPlan().toString().split("Exchange")[0].count("Generate") == 4
    got = rows.collect()
    want = Counter({("A", o, t, i): 1 for o in (1.0, 2.0) for t in (1.0, 2.0) for i in ("x", "UNKNOWN")} | {("B", 3.0, 3.0, "y"): 1, ("C", 4.0, 0.0, "UNKNOWN"): 1, (None, 5.0, 0.0, "UNKNOWN"): 1})
    assert Counter((r.symbol, r.open, r.turnover_rate, r.industry) for r in got) == want
    # by size: four rows of A (70), B (60), four of A (50), the others; ranks 2 to 6 are in
    assert Counter((r.symbol, r.float_mv) for r in got if r.in_universe) == {("A", 700000.0): 3, ("B", 600000.0): 1, ("A", 500000.0): 1}
    assert {(r.symbol, r.eps, r.listed_days, r.is_st) for r in got} == {("A", 0.5, 5, True), ("A", 0.5, 9999, False), ("B", None, 3, False), ("C", None, 9999, False), (None, None, 9999, False)}
    weighed = panel.build_panel(k, b, m, w, f).collect()
    assert Counter((r.symbol, r.index_weight, r.in_universe) for r in weighed) == {("A", 1.5, True): 8, ("A", 0.0, True): 8, ("B", 0.0, False): 1, ("C", 0.0, False): 1, (None, 0.0, False): 1}


def test_registry_counts_without_combining(spark):
    """What the registry counts is what the panel's rows have; no combination is made for it."""
    tables = _repeated(spark)
    columns = ["open", "volume", "amount", "turnover_rate", "float_mv", "pe_ttm", "pb", "eps", "roe"]
    counted = panel.count_values(panel.panel_groups(*tables), columns)
    assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    rows = panel.build_panel(*tables)
    assert counted.head() == rows.agg(*[F.count(c).alias(c) for c in columns]).head()
