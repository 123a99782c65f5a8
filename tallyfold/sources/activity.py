"""The daily activity table: files, and adapters that make it from order and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DAY, USER
from ..schema import ACTIVITY

MONEY = "decimal(18,2)"


def read(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Activity from parquet or CSV with a header, with days as dates; another format is an error."""
    format = format or path.rstrip("/").rpartition(".")[2]
    if format == "parquet":
        rows = spark.read.parquet(path)
    elif format == "csv":
        rows = spark.read.schema(ACTIVITY).option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {format!r}: parquet or csv")
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in ACTIVITY])


def choose(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first of the paths that exists."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in candidates:
        place = hadoop(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return read(spark, path)
    raise FileNotFoundError(f"none of {candidates} exists")


def _stages(rows: DataFrame, flags: dict[str, Column], sums: dict[str, Column], money: dict[str, Column]) -> DataFrame:
    made = rows.groupBy(USER, DAY).agg(
        *[F.max(F.when(c, 1).otherwise(0)).cast(T.IntegerType()).alias(n) for n, c in flags.items()],
        *[F.sum(c).cast("bigint").alias(n) for n, c in sums.items()],
        *[F.sum(c).cast(MONEY).alias(n) for n, c in money.items()],
    )
    return made.select(*ACTIVITY.fieldNames())


def from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders as activity: status tells how far a day's funnel went, urgent orders are the search channel.

    Money of a channel is null on days without it.
    """
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    s, status = F.col("s"), F.col("o_orderstatus")
    rows = orders.join(lines, "o_orderkey", "left").select(
        F.col("o_custkey").alias(USER), F.to_date("o_orderdate").alias(DAY),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("s"),
        F.coalesce("n", F.lit(0)).alias("searches"),
        F.when(status.isin("P", "F"), F.coalesce("n", F.lit(0))).otherwise(0).alias("to_cart"),
        F.when(status == "F", 1).otherwise(0).alias("to_ord"),
        F.when(status == "F", F.col("o_totalprice").cast(MONEY)).otherwise(F.lit(0).cast(MONEY)).alias("gmv"),
    )
    cart, order = F.col("to_cart"), F.col("to_ord")
    return _stages(
        rows,
        {"search": s == 1, "cat": s == 0, "has_search_to_cart": (s == 1) & (cart > 0), "has_search_to_ord": (s == 1) & (order > 0), "has_cat_to_cart": (s == 0) & (cart > 0), "has_cat_to_ord": (s == 0) & (order > 0)},
        {"search_to_cart": s * cart, "search_to_ord": s * order, "cat_to_cart": (1 - s) * cart, "cat_to_ord": (1 - s) * order, "to_cart": cart, "to_ord": order, "searches": F.col("searches")},
        {"gmv_search": F.when(s == 1, F.col("gmv")), "gmv_cat": F.when(s == 0, F.col("gmv")), "gmv": F.col("gmv")},
    )


def from_events(events: DataFrame) -> DataFrame:
    """Events as activity: views search, clicks fill the cart, purchases order; even event ids are the search channel."""
    kind, s = F.col("event_type"), F.col("event_id") % 2 == 0
    rows = events.select(F.col("user_id").alias(USER), F.to_date("ts").alias(DAY), "event_type", "event_id", F.col("value").cast(MONEY).alias("v"))

    def is_(k: str, channel: Column | None = None) -> Column:
        return kind == k if channel is None else (kind == k) & channel

    def one(c: Column) -> Column:
        return F.when(c, 1).otherwise(0)

    def spent(c: Column) -> Column:
        return F.when(c, F.col("v")).otherwise(F.lit(0).cast(MONEY))

    return _stages(
        rows,
        {"search": is_("view", s), "cat": is_("view", ~s), "has_search_to_cart": is_("click", s), "has_search_to_ord": is_("purchase", s), "has_cat_to_cart": is_("click", ~s), "has_cat_to_ord": is_("purchase", ~s)},
        {"search_to_cart": one(is_("click", s)), "search_to_ord": one(is_("purchase", s)), "cat_to_cart": one(is_("click", ~s)), "cat_to_ord": one(is_("purchase", ~s)), "to_cart": one(is_("click")), "to_ord": one(is_("purchase")), "searches": one(is_("view"))},
        {"gmv_search": spent(is_("purchase", s)), "gmv_cat": spent(is_("purchase", ~s)), "gmv": spent(is_("purchase"))},
    )
