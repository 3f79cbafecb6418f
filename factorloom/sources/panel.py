"""The daily panel: reading, normalising, building from raw tables, export, benchmarks, result sinks."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.functions.windows import cumulative_product, finite, ratio
from factorloom.sources.asof import as_of, as_of_dates
from factorloom.sources.tables import FUNDAMENTALS

#: Column names of a panel by kind, and what stands for a column that is absent.
REQUIRED = ("date", "symbol", "open", "high", "low", "close", "volume", "amount")
FLOATS = ("open", "high", "low", "close", "volume", "amount", "turnover_rate", "float_mv", "index_weight")
FLAGS = ("is_st", "is_paused", "is_limit_up", "is_limit_down", "in_universe")
DEFAULTS = {
    "turnover_rate": 0.0, "float_mv": 0.0, "index_weight": 0.0, "industry": "UNKNOWN", "is_st": False, "is_paused": False, "is_limit_up": False,
    "is_limit_down": False, "listed_days": 9999, "in_universe": True,
}
#: Fundamentals that come with daily figures; the others come with filings.
DAILY_FUNDAMENTALS = ("pe_ttm", "pb", "ps_ttm", "dv_ttm")
FILED = tuple(f for f in FUNDAMENTALS if f not in DAILY_FUNDAMENTALS)
SUFFIXES = (".parquet", ".csv")
DEFAULT_INDEX = "000852.SH"
#: Board prefixes with the wider daily limit, and both limits.
WIDE_PREFIXES, WIDE_LIMIT, LIMIT = ("300", "688"), 0.195, 0.098
RANKS = (801, 1800)


def ymd(c: str | Column) -> Column:
    """A ``YYYYMMDD`` text as timestamp; NULL if it is no date."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit("yyyyMMdd"))


def normalize(rows: DataFrame) -> DataFrame:
    """Check, default, coerce and downcast a panel.

    A required column that is absent is an error. Text that is no number is
    NULL; NaN and infinities are NULL; a null flag is false; null listed_days
    are 9999. Other columns stay as they are.
    """
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    rows = rows.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in rows.columns})
    number = lambda c: finite(F.expr(f"try_cast(`{c}` as double)"))
    new = {c: number(c).cast("float") for c in (*FLOATS, *FUNDAMENTALS) if c in rows.columns}
    new |= {c: F.coalesce(F.expr(f"try_cast(`{c}` as boolean)"), F.lit(False)) for c in FLAGS}
    days = F.coalesce(F.expr("try_cast(try_cast(listed_days as double) as int)"), F.lit(9999))
    return rows.withColumns(new | {"date": F.col("date").cast("timestamp"), "symbol": F.col("symbol").cast("string"), "listed_days": days})


def between_dates(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both bounds included. Pushed to the scan when it comes before windows; use it after them for exact features."""
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("timestamp"))
    return rows.where(F.col("date") <= F.lit(end).cast("timestamp")) if end else rows


def window_dates(rows: DataFrame, start: str, end: str) -> DataFrame:
    """``start`` included, ``end`` not."""
    return rows.where((F.col("date") >= F.lit(start).cast("timestamp")) & (F.col("date") < F.lit(end).cast("timestamp")))


def resolve_input(path: str, exists=lambda p: Path(p).exists()) -> str:
    """The path itself, or with another suffix, or the default panel files; the error names all that were tried."""
    base = str(Path(path).with_suffix("")) if Path(path).suffix in SUFFIXES else path
    tried = list(dict.fromkeys([path, *(base + s for s in SUFFIXES), *(f"data/daily_bars{s}" for s in SUFFIXES)]))
    for p in tried:
        if exists(p):
            return p
    raise FileNotFoundError(f"no panel found; tried {', '.join(tried)}")


def load_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A normalised panel from Parquet or CSV by suffix. Column lists and date bounds reach the scan."""
    suffix = Path(path).suffix
    if suffix == ".parquet":
        rows = spark.read.parquet(path)
    elif suffix == ".csv":
        rows = spark.read.csv(path, header=True)
    else:
        raise ValueError(f"no reader for {suffix or path}")
    if columns:
        rows = rows.select(*[c for c in dict.fromkeys([*REQUIRED, *columns]) if c in rows.columns])
    return between_dates(normalize(rows), start, end)


def limit_flag(up: bool) -> Column:
    move = ratio("close", "open") - 1
    wide = F.col("symbol").startswith(WIDE_PREFIXES[0]) | F.col("symbol").startswith(WIDE_PREFIXES[1])
    bound = F.when(wide, WIDE_LIMIT).otherwise(LIMIT)
    return F.coalesce(move >= bound if up else move <= -bound, F.lit(False))


#: Columns of a panel row that each raw table gives; a code's rows of one date are kept as arrays of them.
_KLINE, _BASIC, _MASTER = ("open", "high", "low", "close", "vol", "amount"), ("circ_mv", "turnover_rate", *DAILY_FUNDAMENTALS), ("name", "industry", "list_date")


def panel_groups(
    kline: DataFrame, basic: DataFrame, master: DataFrame, weights: DataFrame | None = None, filings: DataFrame | None = None,
    index_code: str = DEFAULT_INDEX, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """What a panel is made of, a row per code and date: its rows of the raw tables as arrays, what was filed, its places by size.

    Where codes repeat in a table, a panel has each combination of their rows.
    These are made last, from here, inside a task: no shuffle, sort or window
    sees more than the raw tables have. ``ks``, ``bs``, ``ms`` and ``ws`` are rows
    of prices, daily figures, master and weights; ``places`` has, for those of
    ``bs`` (in their order) that reach into ``RANKS``, how many panel rows of the
    date are larger, on dates without a weight snapshot.
    """
    k = kline.where(ymd("trade_date") >= F.lit(start).cast("timestamp")) if start else kline
    k = k.where(ymd("trade_date") <= F.lit(end).cast("timestamp")) if end else k
    keys = ("ts_code", "trade_date")
    k = k.select(*keys, F.struct(*_KLINE).alias("k"))
    b = basic.where("ts_code is not null and trade_date is not null").select(*keys, F.struct(*_BASIC).alias("b"))
    rows = k.unionByName(b, allowMissingColumns=True).repartition("ts_code").groupBy(*keys)
    rows = rows.agg(F.collect_list("k").alias("ks"), F.sort_array(F.collect_list("b")).alias("bs")).where(F.size("ks") > 0)
    m = master.where("ts_code is not null").groupBy("ts_code").agg(F.collect_list(F.struct(*_MASTER)).alias("ms"))
    rows = rows.join(m, "ts_code", "left").withColumnRenamed("ts_code", "symbol").withColumn("date", ymd("trade_date"))
    if weights is None:
        rows, extra = rows.withColumn("snapshot", F.lit(False)), None
    else:
        w = weights.where((F.col("index_code") == index_code) & F.col("con_code").isNotNull())
        w = w.select(F.col("con_code").alias("symbol"), ymd("trade_date").alias("weight_date"), F.struct("weight").alias("w"))
        snaps = F.broadcast(as_of_dates(k.select(ymd("trade_date").alias("date")), w, "date", "weight_date"))  # one row per date
        extra = w.join(snaps, "weight_date").groupBy("symbol", "date").agg(F.collect_list("w").alias("ws"))
        rows = rows.join(snaps, "date", "left").withColumn("snapshot", F.col("weight_date").isNotNull()).drop("weight_date")
    sized = rows.where("not snapshot").select("symbol", "trade_date", "date", _times("ks", "ms").alias("n"), F.posexplode_outer("bs").alias("place", "b"))
    larger = Window.partitionBy("trade_date").orderBy(F.col("b.circ_mv").desc_nulls_last(), "symbol", "place").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("before", F.coalesce(F.sum("n").over(larger), F.lit(0).cast("long")))
    sized = sized.where((F.col("before") < RANKS[1]) & (F.col("before") + F.col("n") >= RANKS[0]))
    entry = F.struct(F.coalesce("place", F.lit(0)), "before")
    places = sized.groupBy("symbol", "trade_date").agg(F.map_from_entries(F.collect_list(entry)).alias("places"))
    if filings is None:
        rows = rows.withColumns({f: F.lit(None).cast("double") for f in FILED})
    else:
        known = [f for f in FILED if f in filings.columns]
        f = filings.select(F.col("ts_code").alias("symbol"), ymd("ann_date").alias("ann"), ymd("end_date").alias("end"), *[F.col(c).cast("double") for c in known])
        rows = as_of(rows, f, "date", "ann", known, ["symbol"], ["end"])
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in FILED if c not in known})
    rows = rows.join(places, ["symbol", "trade_date"], "left")
    return rows.withColumn("ws", F.lit(None).cast("array<struct<weight:double>>")) if extra is None else rows.join(extra, ["symbol", "date"], "left")


def _times(*arrays: str) -> Column:
    """How many combinations the rows of these arrays have; one that is empty or missing stands for a row of nulls."""
    out = F.lit(1).cast("long")
    for a in arrays:
        out *= F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(1))
    return out


def count_values(groups: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values that are not null each column of the panel of ``groups`` has, without making its rows."""

    def total(c: str) -> Column:
        source = "vol" if c == "volume" else c
        if c in FILED:
            found = F.when(F.col(c).isNotNull(), _times("ks", "bs", "ms", "ws"))
        elif source in _KLINE:
            found = F.size(F.filter("ks", lambda k: k[source].isNotNull())) * _times("bs", "ms", "ws")
        elif c in DAILY_FUNDAMENTALS:
            found = F.size(F.filter("bs", lambda b: b[c].isNotNull())) * _times("ks", "ms", "ws")
        else:  # the others have a value in every row
            found = _times("ks", "bs", "ms", "ws")
        return F.coalesce(F.sum(found), F.lit(0)).cast("long").alias(c)

    return groups.agg(*map(total, columns))


def build_panel(
    kline: DataFrame, basic: DataFrame, master: DataFrame, weights: DataFrame | None = None, filings: DataFrame | None = None,
    index_code: str = DEFAULT_INDEX, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """The panel from raw tables, each row with only what was known on its date.

    Membership: in the newest weight snapshot at or before the date if there is
    one (a name missing from it is out), else a size rank within ``RANKS``.
    Filings count from their announcement date; later period ends win ties.
    """
    rows = panel_groups(kline, basic, master, weights, filings, index_code, start, end).withColumn("masters", _times("ms"))
    for array, name in (("ks", "k"), ("bs", "b"), ("ms", "m"), ("ws", "w")):
        rows = rows.select("*", F.posexplode_outer(array).alias(f"{name}_at", name))
    place = F.element_at("places", F.coalesce("b_at", F.lit(0))) + F.col("k_at") * F.col("masters") + F.coalesce("m_at", F.lit(0)) + 1
    member = F.when(F.col("snapshot"), F.col("ws").isNotNull()).otherwise(F.coalesce(place.between(*RANKS), F.lit(False)))
    listed = F.when(F.col("m.list_date").isNull(), 9999).otherwise(F.greatest(F.datediff("date", ymd("m.list_date")), F.lit(0)))
    name = F.coalesce("m.name", F.lit(""))
    rows = rows.select(
        "date", "symbol", *[F.col(f"k.{c}").alias(c) for c in ("open", "high", "low", "close")], (F.col("k.vol") * 100.0).alias("volume"),
        (F.col("k.amount") * 1000.0).alias("amount"), F.coalesce("b.turnover_rate", F.lit(0.0)).alias("turnover_rate"),
        *[F.col(f"b.{c}").alias(c) for c in DAILY_FUNDAMENTALS], F.coalesce(F.col("b.circ_mv") * 10000.0, F.lit(0.0)).alias("float_mv"),
        F.coalesce("m.industry", F.lit("UNKNOWN")).alias("industry"), listed.alias("listed_days"), F.coalesce("w.weight", F.lit(0.0)).alias("index_weight"),
        member.alias("in_universe"), *FILED, (name.like("ST%") | name.like("*ST%") | name.like("S*ST%")).alias("is_st"), F.lit(False).alias("is_paused"),
    )
    return rows.withColumns({"is_limit_up": limit_flag(True), "is_limit_down": limit_flag(False)})


def export_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").parquet(path)


def export_bucketed(panel: DataFrame, path: str, buckets: int | None = None) -> None:
    """The panel for factor work: buckets of symbols, each in order of symbol and date, in folders by year.

    Windows over a symbol's dates then plan without a shuffle, and filters on
    ``year`` skip whole folders. ``buckets``: as many as shuffle partitions by default.
    """
    spark = panel.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bars_{uuid.uuid4().hex}"
    rows = panel.withColumn("year", F.year("date")).repartition(n, "symbol")
    rows.write.partitionBy("year").bucketBy(n, "symbol").sortBy("symbol", "date").format("parquet").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # a table with a path of its own leaves its files
    spark.createDataFrame([(n, panel.schema.json())], "buckets int, columns string").coalesce(1).write.mode("overwrite").json(f"{path}_layout")


def load_bucketed(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """What ``export_bucketed`` wrote, in any session, with its layout; bounds of dates, both included, skip years."""
    layout = spark.read.schema("buckets int, columns string").json(f"{path}_layout").head()
    columns, name = StructType.fromJson(json.loads(layout.columns)), f"bars_{uuid.uuid4().hex}"
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    spark.sql(f"CREATE TABLE {name} ({text}, year int) USING parquet PARTITIONED BY (year) CLUSTERED BY (symbol) SORTED BY (symbol, date) INTO {layout.buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    rows = spark.table(name)
    if start:
        rows = rows.where(F.col("year") >= int(start[:4]))
    if end:
        rows = rows.where(F.col("year") <= int(end[:4]))
    return between_dates(rows.drop("year"), start, end)


def benchmark_path(index_code: str = DEFAULT_INDEX) -> str:
    return f"data/benchmark_{index_code.replace('.', '_').lower()}.parquet"


def index_benchmark(index_daily: DataFrame, index_code: str = DEFAULT_INDEX, start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, benchmark_ret, benchmark_equity) of one index; a missing return is 0. No rows: an empty table of that shape."""
    rows = index_daily.where(F.col("ts_code") == index_code).select(ymd("trade_date").alias("date"), "close", "pre_close")
    rows = between_dates(rows, start, end)
    rows = rows.select("date", F.coalesce(ratio("close", "pre_close") - 1, F.lit(0.0)).alias("benchmark_ret"))
    return rows.withColumn("benchmark_equity", cumulative_product(1 + F.col("benchmark_ret"), Window.orderBy("date")))  # one row per date


def benchmark_on(benchmark: DataFrame, dates: DataFrame) -> DataFrame:
    """A benchmark on the given dates only, its equity compounded over just these."""
    rows = benchmark.select("date", "benchmark_ret").join(dates.select("date").distinct(), "date", "left_semi")
    return rows.withColumn("benchmark_equity", cumulative_product(1 + F.coalesce("benchmark_ret", F.lit(0.0)), Window.orderBy("date")))


def official_benchmark(spark: SparkSession, dates: DataFrame, index_code: str = DEFAULT_INDEX, path: str | None = None, table: str = "index_daily") -> DataFrame:
    """The index on the given dates: from its exported file, else from the raw table, else an empty table of that shape."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(path or benchmark_path(index_code)).select(F.col("date").cast("timestamp").alias("date"), "benchmark_ret")
    except AnalysisException:
        if not spark.catalog.tableExists(table):
            return spark.createDataFrame([], "date timestamp, benchmark_ret double, benchmark_equity double")
        found = index_benchmark(spark.table(table), index_code)
    return benchmark_on(found, dates)


def write_run_config(cfg, path: str) -> None:
    """A run's configuration as JSON."""
    from dataclasses import asdict

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(cfg), indent=2, default=str))


def feature_pool(spark: SparkSession, path: str) -> list[str]:
    """Names in the ``feature`` column of a CSV."""
    return [r.feature for r in spark.read.csv(path, header=True).where("feature is not null").select("feature").distinct().orderBy("feature").collect()]
