"""Daily activity from a stream of events, so that feature builds need not read raw events again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DAY, USER


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Per user and day: searches, carts, orders and spend of a stream of events (user_id, ts, event_type, value).

    A day is final once the watermark, ``late`` behind the newest event, has
    passed it; later events for it are left out.
    """
    kind = F.col("event_type")
    counts = [F.count_if(kind == k).alias(n) for k, n in (("view", "searches"), ("click", "to_cart"), ("purchase", "to_ord"))]
    spent = F.sum(F.when(kind == "purchase", F.col("value").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)").alias("gmv")
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    days = timed.groupBy(USER, F.window("at", "1 day").alias("w")).agg(*counts, spent)
    return days.select(USER, F.to_date("w.start").alias(DAY), *[c for c in days.columns if c not in (USER, "w")])


def write(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends final days to a dataset partitioned by day; each day's rows come exactly once."""
    return days.writeStream.outputMode("append").partitionBy(DAY).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
