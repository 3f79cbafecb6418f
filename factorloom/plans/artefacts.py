"""Results of a run under their fixed names, a manifest of what was written, and the check of a run's output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Artefact of each strategy result; ``{}`` is the strategy's name.
STRATEGY_FILES = {
    "positions": "positions_{}.csv", "portfolio": "backtest_equity_{}.csv", "benchmark": "benchmark_equity_{}.csv", "excess": "excess_return_{}.csv",
    "index": "official_index_benchmark_{}.csv", "index_excess": "official_index_excess_{}.csv", "signal_daily": "ic_timeseries_{}.csv",
    "bucket_returns": "bucket_returns_{}.csv", "industry_exposure": "industry_exposure_{}.csv", "size_exposure": "size_exposure_{}.csv",
    "signal_summary": "diagnostics_{}.json", "benchmark_metrics": "benchmark_metrics_{}.json", "excess_metrics": "excess_metrics_{}.json",
    "index_metrics": "official_index_benchmark_metrics_{}.json", "index_excess_metrics": "official_index_excess_metrics_{}.json",
    "industry_summary": "industry_bias_summary_{}.json", "size_summary": "size_bias_summary_{}.json",
}
#: Results of the main strategy that are written without its name too.
ALIASES = {
    "positions": "positions.csv", "portfolio": "backtest_equity.csv", "benchmark": "benchmark_equity.csv", "excess": "excess_return.csv",
    "index": "official_index_benchmark.csv", "index_excess": "official_index_excess.csv", "industry_exposure": "industry_exposure.csv",
    "size_exposure": "size_exposure.csv", "latest_signals": "latest_signals.csv",
}
#: What the check of a daily run looks for, and the words in a log that it minds.
REQUIRED, BAD_WORDS = ("metrics.json", "latest_signals.csv", "predictions.parquet"), ("traceback", "error", "exception")
MANIFEST = "manifest.json"


def latest_signals(positions: DataFrame) -> DataFrame:
    """The positions of the last date."""
    last = positions.agg(F.max("date").alias("__last"))
    return positions.join(F.broadcast(last), F.col("date") == F.col("__last")).drop("__last")  # one row


def named(found: dict[str, DataFrame], main: str | None = "lgbm") -> dict[str, DataFrame]:
    """Artefact name of each result; strategy results are known by ``<strategy>_<result>``, others by their own names as CSV."""
    out: dict[str, DataFrame] = {}
    stems = [k.removesuffix("_positions") for k in found if k.endswith("_positions")]
    used = set()
    for stem in stems:
        own = {k: found[f"{stem}_{k}"] for k in STRATEGY_FILES if f"{stem}_{k}" in found}
        used |= {f"{stem}_{k}" for k in (*STRATEGY_FILES, "metrics")}
        own["latest_signals"] = latest_signals(own["positions"])
        out |= {({**STRATEGY_FILES, "latest_signals": "latest_signals_{}.csv"})[k].format(stem): v for k, v in own.items()}
        if stem == main:
            out |= {ALIASES[k]: v for k, v in own.items() if k in ALIASES}
    for name, frame in found.items():
        if name not in used and frame is not None:
            kind = "parquet" if name.startswith("predictions") else "json" if name == "metrics" or name.endswith("_metrics") else "csv"
            out[f"{name}.{kind}"] = frame
    return out


def write_artefacts(frames: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each artefact by its suffix, all tasks writing, and ``manifest.json`` with its rows; the manifest.

    Nested columns are JSON text in a CSV. The manifest comes last, so a run that
    died has none or that of the run before.
    """
    rows = []
    for name, frame in frames.items():
        spark, kind = frame.sparkSession, name.rsplit(".", 1)[-1]
        nested = [f.name for f in frame.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        flat = frame.withColumns({c: F.to_json(c) for c in nested}) if kind == "csv" and nested else frame
        path = f"{folder}/{name}"
        flat.write.mode("overwrite").options(**({"header": True} if kind == "csv" else {})).format(kind).save(path)
        reader = spark.read.schema(flat.schema) if flat.schema.fields else spark.read
        rows.append((name, kind, reader.options(**({"header": True} if kind == "csv" else {})).format(kind).load(path).count()))
    manifest = spark.createDataFrame(rows, "name string, kind string, row_count long").withColumn("written", F.current_timestamp())
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/{MANIFEST}")
    return manifest


def output_health(spark: SparkSession, folder: str, log: str | None = None, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """One row about a run's output: status, reason, when it was written, rows of the latest signals and of the predictions.

    error: no manifest, or an artefact of ``required`` that is missing or
    empty (signals may be); warn: the log holds one of ``BAD_WORDS``; else ok.
    """
    schema = "name string, kind string, row_count long, written timestamp"
    try:
        rows = {r.name: r for r in spark.read.schema(schema).json(f"{folder}/{MANIFEST}").collect()}  # one row per artefact
    except AnalysisException:
        rows = {}
    reasons = [] if rows else [f"{MANIFEST} missing"]
    for name in required if rows else ():
        try:
            spark.read.format("binaryFile").load(f"{folder}/{name}").limit(0).count()
            if name not in rows:
                reasons.append(f"{name} missing")
            elif rows[name].row_count == 0 and not name.startswith("latest_signals"):
                reasons.append(f"{name} empty")
        except AnalysisException:
            reasons.append(f"{name} missing")
    status = "error" if reasons else "ok"
    if log and not reasons:
        try:
            lines = spark.read.text(log).where(F.lower("value").rlike("|".join(BAD_WORDS)))
            if not lines.isEmpty():
                status, reasons = "warn", ["the log contains error keywords"]
        except AnalysisException:
            pass
    count = lambda n: rows[n].row_count if n in rows else None
    written = max((r.written for r in rows.values()), default=None)
    row = [(status, reasons[0] if reasons else "", written, count("latest_signals.csv"), count("predictions.parquet"))]
    return spark.createDataFrame(row, "status string, reason string, written timestamp, latest_signals_rows long, predictions_rows long")
