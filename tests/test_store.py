"""The raw store over sessions, versions and streams; a run's output and its check."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factorloom.operators import factors
from factorloom.plans import cli, research
from factorloom.plans.artefacts import named, output_health, write_artefacts
from factorloom.plans.fixtures import raw_table
from factorloom.sources import panel as panels
from factorloom.sources import store
from factorloom.sources.rawstore import RawStore, prune, prune_plan, rebuild_filings, update_raw
from factorloom.sources.tables import derived_panel
from factorloom.streaming.refresh import upsert_stream

SF, ROOT = "/root/testdata/sf0.001", str(Path(__file__).parents[1])
TABLES = {"daily_kline": "daily_kline", "daily_basic": "daily_basic", "stock_basic": "stock_basic", "index_weight": "index_weight", "index_daily": "index_daily",
          "filings_raw": "fina_indicator_raw_v2"}


def _bars(spark, rows):
    return spark.createDataFrame(rows, "ts_code string, trade_date string, close double")


def _files(root, name):
    return {p.name for p in Path(root, name).rglob("data-*/**/*.parquet")}


def test_commands_of_three_sessions_meet(spark, tmp_path):
    t = {}
    for source, name in TABLES.items():
        rows = raw_table(spark, SF, source)
        t[name] = rows.where(F.col(store.DATES[name]) >= "20010601") if store.DATES[name] else rows
        t[name].write.parquet(f"{tmp_path}/in/{name}.parquet")

    def session(*args):
        done = subprocess.run([sys.executable, "-m", "factorloom.plans.cli", *args, "--store", f"{tmp_path}/store"], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT})
        assert done.returncode == 0, done.stderr[-2000:]
        return done.stdout

    first = session("update-raw", "--incoming", f"{tmp_path}/in", "--start-date", "1990-01-01")
    assert "daily_kline: 0 rows" in first and "fina_indicator_raw_v2" in first
    session("rebuild-fina-indicator")
    session("export-panel", "--output", f"{tmp_path}/bars.parquet")
    want = panels.build_panel(t["daily_kline"], t["daily_basic"], t["stock_basic"], None, store.clean_filings(t["fina_indicator_raw_v2"]))
    got = panels.load_panel(spark, f"{tmp_path}/bars.parquet")
    want = panels.normalize(want)
    same = lambda rows: {(r.symbol, str(r.date), round(r.close, 3), r.industry, None if r.roe is None else round(r.roe, 3)) for r in rows.collect()}
    assert same(got) == same(want) and got.count() > 100


def test_upsert_writes_the_months_that_it_touches(spark, tmp_path):
    tables = RawStore(spark, str(tmp_path))
    assert not tables.exists("daily_kline") and tables.names() == []
    assert tables.upsert("daily_kline", _bars(spark, [("a", "20240102", 1.0), ("a", "20240205", 2.0), ("b", "20240301", 3.0), ("b", None, 4.0)])) == ["202401", "202402", "202403", "none"]
    before, version = _files(tmp_path, "daily_kline"), tables.version("daily_kline")
    old = {r.ts_code + str(r.trade_date): r.close for r in tables.read("daily_kline").collect()}
    kept = {m: p for m, p in tables.parts("daily_kline").items() if m != "202402"}
    assert tables.upsert("daily_kline", _bars(spark, [("a", "20240205", 9.0), ("c", "20240206", 5.0), ("c", "20240206", 6.0)])) == ["202402"]
    new = {r.ts_code + str(r.trade_date): r.close for r in tables.read("daily_kline").collect()}
    assert new == old | {"a20240205": 9.0, "c20240206": 6.0}
    assert {m: p for m, p in tables.parts("daily_kline").items() if m != "202402"} == kept and before <= _files(tmp_path, "daily_kline")
    assert {r.ts_code: r.close for r in tables.read("daily_kline", version=version).where("trade_date = '20240205'").collect()} == {"a": 2.0}
    assert {r.trade_date for r in tables.read("daily_kline", "20240201", "20240229").collect()} == {"20240205", "20240206"}
    assert tables.upsert("daily_kline", _bars(spark, [])) == [] and tables.version("daily_kline") == version + 1
    gone = tables.vacuum("daily_kline")
    assert gone and {r.ts_code + str(r.trade_date): r.close for r in RawStore(spark, str(tmp_path)).read("daily_kline").collect()} == new


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    tables = RawStore(spark, str(tmp_path))
    tables.upsert("index_daily", _bars(spark, [("x", "20240102", 1.0)]))

    def dies(*args, **kwargs):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(RawStore, "_commit", dies)
        with pytest.raises(RuntimeError):
            tables.upsert("index_daily", _bars(spark, [("x", "20240102", 2.0)]))
    Path(tmp_path, "index_daily", "manifest", f"v={tables.version('index_daily') + 1}", "_temporary").mkdir(parents=True)  # or dies while it writes the manifest
    assert [r.close for r in RawStore(spark, str(tmp_path)).read("index_daily").collect()] == [1.0]
    tables.upsert("index_daily", _bars(spark, [("x", "20240102", 3.0)]))
    assert [r.close for r in tables.read("index_daily").collect()] == [3.0]


def test_filings_master_data_and_pruning(spark, tmp_path):
    tables = RawStore(spark, str(tmp_path))
    raw = spark.createDataFrame([("a", "20240301", "20231231", "0", "1.5"), ("a", "20240301", "20231231", "1", "2.5"), ("b", "20240401", "20231231", "0", "n/a")],
                                "ts_code string, ann_date string, end_date string, update_flag string, eps string")
    master = spark.createDataFrame([("a", "A", "20200101"), ("b", "B", "20210101")], "ts_code string, name string, list_date string")
    report = update_raw(tables, {"fina_indicator_raw_v2": raw, "stock_basic": master})
    assert report["fina_indicator_raw_v2"][0]["row_count"] == 0 and report["fina_indicator_raw_v2"][1]["max_date"] == "20240401"
    assert report["stock_basic"][1] == {"row_count": 2, "min_date": "20200101", "max_date": "20210101", "date_count": 2}
    assert rebuild_filings(tables)["fina_indicator_clean"][1]["row_count"] == 2
    assert {(r.ts_code, r.update_flag, r.eps) for r in tables.read("fina_indicator_clean").collect()} == {("a", 1, 2.5), ("b", 0, None)}
    assert rebuild_filings(tables, raw, limit_stocks=1)["fina_indicator_raw_v2"][1]["row_count"] == 2
    tables.replace("stock_basic", tables.read("stock_basic").where("ts_code = 'a'"))  # reads what it replaces
    assert [r.ts_code for r in tables.read("stock_basic").collect()] == ["a"]
    tables.replace("odd", spark.range(3))
    plan = prune_plan(tables, {n: "raw" for n in store.COLUMNS}, {"odd": "not needed"})
    assert {(p.table, p.action, p.row_count) for p in plan} == {("fina_indicator_clean", "keep", 1), ("fina_indicator_raw_v2", "keep", 2), ("odd", "drop", 3), ("stock_basic", "keep", 1)}
    assert prune(tables, plan) == ["odd"] and tables.exists("odd")
    assert prune(tables, plan, execute=True) == ["odd"] and not tables.exists("odd") and "odd" not in tables.register()


def test_stream_repairs_a_table(spark, tmp_path):
    rows = [("a", "20240102", 1.0), ("a", "20240103", 2.0)]
    tables = RawStore(spark, f"{tmp_path}/store")
    tables.upsert("daily_kline", _bars(spark, rows))
    _bars(spark, [("a", "20240103", 5.0), ("b", "20240301", 7.0)]).write.parquet(f"{tmp_path}/late")
    late = spark.readStream.schema("ts_code string, trade_date string, close double").parquet(f"{tmp_path}/late")
    upsert_stream(late, f"{tmp_path}/store", "daily_kline", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert {(r.ts_code, r.trade_date, r.close) for r in tables.read("daily_kline").collect()} == {("a", "20240102", 1.0), ("a", "20240103", 5.0), ("b", "20240301", 7.0)}


def test_output_health(spark, tmp_path):
    days = spark.sql("select timestamp'2024-01-02' as date, 'a' as symbol, 0.1D as target_weight union all select timestamp'2024-01-09', 'b', 0.2D")
    frames = named({"lgbm_positions": days, "lgbm_metrics": days, "predictions": days, "metrics": days.select(F.lit("lgbm").alias("strategy"))})
    assert {"positions_lgbm.csv", "positions.csv", "latest_signals_lgbm.csv", "latest_signals.csv", "predictions.parquet", "metrics.json"} == set(frames)
    folder = f"{tmp_path}/out"
    assert output_health(spark, folder).head().status == "error"
    write_artefacts({k: v for k, v in frames.items() if k != "latest_signals.csv"}, folder)
    assert output_health(spark, folder).head().reason == "latest_signals.csv missing"
    write_artefacts(frames, folder)
    row = output_health(spark, folder).head()
    assert (row.status, row.latest_signals_rows, row.predictions_rows) == ("ok", 1, 2) and row.written is not None
    Path(tmp_path, "log").write_text("all well\nTraceback (most recent call last)\n")
    assert output_health(spark, folder, f"{tmp_path}/log").head().status == "warn"
    write_artefacts(frames | {"predictions.parquet": days.limit(0)}, folder)
    assert output_health(spark, folder).head().reason == "predictions.parquet empty"


def test_bucketed_panel_needs_no_shuffle(spark, tmp_path):
    rows = derived_panel(spark, SF).withColumn("symbol", F.col("symbol").cast("string"))
    panels.export_bucketed(rows, f"{tmp_path}/bars", 4)
    names = ["ret_5", "price_zscore_20", "close_to_ma_10"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    loaded = panels.load_bucketed(spark, f"{tmp_path}/bars")
    done, usual = factors.add_factors(panels.normalize(loaded), names), factors.add_factors(panels.normalize(rows), names)
    assert plan(done).count("Exchange") == 0 < plan(usual).count("Exchange hashpartitioning(symbol")
    same = lambda df: Counter((r.symbol, r.date, *[None if r[n] is None else round(r[n], 4) for n in names]) for r in df.collect())
    assert same(done) == same(usual)
    part = panels.load_bucketed(spark, f"{tmp_path}/bars", "1999-03-01", "1999-12-31")
    assert "year" in plan(part) and {r.y for r in part.select(F.year("date").alias("y")).distinct().collect()} == {1999}


def test_refreshed_factors_equal_a_full_run(spark, tmp_path):
    names = ["ret_5", "price_zscore_60", "vol_10", "close_to_ma_60"]
    rows = derived_panel(spark, SF)
    bars = rows.where("not (symbol = 3 and date between '1996-01-01' and '1999-06-01')").cache()  # a name with a long break
    old = bars.where("date < '2000-05-10'").withColumn("close", F.when(F.col("date") >= "2000-04-03", F.col("close") * 2).otherwise(F.col("close")))
    tables = RawStore(spark, str(tmp_path), {"factors": "date"})
    research.refresh_factors(tables, old, names, "2000-05-01")
    kept = {m: p for m, p in tables.parts("factors").items() if m < "200004"}
    got = research.refresh_factors(tables, bars, names, "2000-04-10")
    want = factors.add_factors(bars, names, as_float=False).select("symbol", "date", *names)
    same = lambda df: Counter((r.symbol, r.date, *[None if r[n] is None else round(r[n], 9) for n in names]) for r in df.collect())
    assert same(got) == same(want) and {m: p for m, p in tables.parts("factors").items() if m < "200004"} == kept
    assert research.LOOK_BACK >= 125


def test_daily_research_from_raw_rows_to_checked_output(spark, tmp_path):
    for source, name in TABLES.items():
        rows = raw_table(spark, SF, source)
        (rows.where(F.col(store.DATES[name]) >= "19990101") if store.DATES[name] else rows).write.parquet(f"{tmp_path}/in/{name}.parquet")
    cli.main(["daily-research", "--incoming", f"{tmp_path}/in", "--store", f"{tmp_path}/store", "--start-date", "1999-01-01", "--output", f"{tmp_path}/bars.parquet", "--benchmark",
              f"{tmp_path}/index.parquet", "--output-dir", f"{tmp_path}/daily", "--features", "ret_5", "intraday_ret_1", "--min-listed-days", "0", "--min-amount", "0", "--train-days", "40",
              "--min-train-rows", "10", "--lgbm-n-estimators", "1", "--lgbm-max-depth", "1", "--folds", "1", "--rebalance-weekday", "0"])
    row = output_health(spark, f"{tmp_path}/daily").head()
    assert row.status == "ok" and row.predictions_rows > 0
    assert spark.read.parquet(f"{tmp_path}/index.parquet").count() > 50
