"""Price and exchange-rate levels as long tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pair, currency and the level around which it moves, by order priority.
PAIRS = [("1-URGENT", "EURUSD=X", "EUR", 1.1), ("2-HIGH", "GBPUSD=X", "GBP", 1.27), ("3-MEDIUM", "USDJPY=X", "JPY", 150.0)]
#: The native currency of a region's instruments.
CURRENCIES = [("AFRICA", "USD"), ("AMERICA", "USD"), ("ASIA", "JPY"), ("EUROPE", "EUR"), ("MIDDLE EAST", "GBP")]
SUPPORTED = ("USD", "EUR", "GBP", "JPY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels_by(lines: DataFrame, key: str) -> DataFrame:
    """(date, instrument, level): a bounded price level from discounts and taxes, by day and ``key``."""
    level = F.round(100 * (1 + F.avg("l_discount") - F.avg("l_tax")), 8)
    named = lines.select(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("ticker:"), F.upper(F.trim(key))).alias("instrument"), "l_discount", "l_tax")
    return named.where("date IS NOT NULL AND instrument IS NOT NULL").groupBy("date", "instrument").agg(level.alias("level"))


def type_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return levels_by(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]), "p_type")


def brand_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return levels_by(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]), "p_brand")


def nation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    joined = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"]).join(nations, suppliers["s_nationkey"] == nations["n_nationkey"])
    return levels_by(joined, "n_name")


def read_levels(levels: DataFrame, universe: DataFrame, start: date, end: date) -> DataFrame:
    """The levels of a universe (column instrument) between two days, both included."""
    return levels.where(F.col("date").between(F.lit(start), F.lit(end))).join(universe.select("instrument").distinct(), "instrument", "left_semi")


def pair_levels(orders: DataFrame) -> DataFrame:
    """(date, pair, currency, level) of the three currency pairs."""
    pairs = orders.sparkSession.createDataFrame(PAIRS, "o_orderpriority string, pair string, currency string, base double")
    daily = orders.groupBy(F.to_date("o_orderdate").alias("date"), "o_orderpriority").agg(F.avg("o_totalprice").alias("price"))
    level = F.round(F.col("base") * (1 + 0.05 * (F.col("price") / 250000 - 1)), 8)
    return daily.join(F.broadcast(pairs), "o_orderpriority").select("date", "pair", "currency", level.alias("level"))


def usd_per_unit(pairs: DataFrame) -> DataFrame:
    """(date, currency, usd_per_unit): the yen pair turned over, and the dollar itself as one."""
    rate = F.when(F.col("pair") == "USDJPY=X", F.try_divide(F.lit(1.0), F.col("level"))).otherwise(F.col("level"))
    own = pairs.select("date").distinct().select("date", F.lit("USD").alias("currency"), F.lit(1.0).alias("usd_per_unit"))
    return pairs.select("date", "currency", rate.alias("usd_per_unit")).unionByName(own)


def nation_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, currency, symbol) of the nation panel; one nation in an unsupported currency."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    codes = spark.createDataFrame(CURRENCIES, "r_name string, currency string")
    named = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).join(F.broadcast(codes), "r_name", "left")
    return named.select(F.concat(F.lit("ticker:"), F.upper("n_name")).alias("instrument"), F.when(F.col("n_nationkey") == 24, "CHF").otherwise(F.col("currency")).alias("currency"))


def instrument_currencies(instruments: DataFrame, listings: DataFrame) -> DataFrame:
    """(instrument, currency, problem): unknown symbols and unsupported currencies carry their problem."""
    joined = instruments.select("instrument").distinct().join(listings, "instrument", "left")
    problem = F.when(F.col("currency").isNull(), "unknown").when(~F.col("currency").isin(*SUPPORTED), "unsupported")
    return joined.select("instrument", "currency", problem.alias("problem"))
