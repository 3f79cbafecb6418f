"""The driver's tables, and price bars derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fundamental columns of a panel.
FUNDAMENTALS = (
    "pe_ttm", "pb", "ps_ttm", "dv_ttm", "eps", "bps", "cfps", "ocfps", "roe", "roe_dt", "roa", "roic", "grossprofit_margin", "netprofit_margin",
    "debt_to_assets", "current_ratio", "quick_ratio", "profit_dedt", "basic_eps_yoy", "dt_eps_yoy", "netprofit_yoy", "dt_netprofit_yoy", "ocf_yoy",
    "tr_yoy", "or_yoy", "q_sales_yoy", "q_op_qoq",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """Bars per supplier and week (or day): the open is the first line's unit price, the close the last one's.

    Lines that share a date, order and number are told apart by their price.
    Bars hold few lines each, so lines go to their supplier's task as they are,
    without partial sums, and are sorted once: bars come in the order that
    windows over a supplier's dates ask for.
    """
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.date_trunc(grain, "l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
    ).repartition("symbol")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "p")
    return lines.groupBy("symbol", "date").agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, industry, float_mv): the supplier's region and balance."""
    s, n, r = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("industry"), F.col("s_acctbal").alias("float_mv"))


def derived_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole panel from the driver's tables: bars, instruments and the default flags.

    ``listed_days`` counts from a symbol's first bar; ``turnover_rate`` is a
    hundredth of the volume.
    """
    from pyspark.sql import Window

    rows = bars(spark, sf_dir).join(instruments(spark, sf_dir), "symbol", "left")
    first = F.min("date").over(Window.partitionBy("symbol"))
    return rows.withColumns(
        {
            "industry": F.coalesce("industry", F.lit("UNKNOWN")),
            "float_mv": F.coalesce("float_mv", F.lit(0.0)),
            "turnover_rate": F.col("volume") / 100,
            "listed_days": F.datediff("date", first),
            "is_st": F.lit(False),
            "is_paused": F.lit(False),
            "is_limit_up": F.try_divide("close", "open") - 1 >= 0.098,
            "is_limit_down": F.try_divide("close", "open") - 1 <= -0.098,
            "in_universe": F.lit(True),
        }
    )
