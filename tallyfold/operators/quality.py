"""Report on the daily activity table and on built folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAY, USER


def volume(activity: DataFrame) -> DataFrame:
    """Rows, users, period, calendar days and the rows a dense table would have, density, negative spend."""
    found = activity.agg(F.count("*").alias("n_rows"), F.countDistinct(USER).alias("n_users"), F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day"), F.count_if(F.col("gmv") < 0).alias("negative_gmv"))
    days = F.datediff("last_day", "first_day").cast("long") + 1
    return found.select("*", days.alias("calendar_days"), (F.col("n_users") * days).alias("dense_rows"), F.round(F.col("n_rows") / F.col("n_users"), 6).alias("rows_per_user"))


def nulls(activity: DataFrame) -> DataFrame:
    """(column_name, n_null), one scan for all columns."""
    counts = activity.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in activity.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in activity.columns)
    return counts.selectExpr(f"stack({len(activity.columns)}, {pairs}) AS (column_name, n_null)")


def duplicates(activity: DataFrame) -> DataFrame:
    """Rows that repeat an earlier (user, day)."""
    return activity.groupBy(USER, DAY).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def fold_report(table: DataFrame) -> DataFrame:
    """For each fold of a feature table with targets: users, share with a positive target, mean target."""
    return table.groupBy("fold", "fold_idx").agg(F.count("*").alias("n_users"), F.count_if(F.col("target") > 0).alias("n_positive"), F.round(F.avg((F.col("target") > 0).cast("double")), 6).alias("positive_share"), F.round(F.sum(F.col("target").cast("decimal(28,2)")).cast("double"), 2).alias("target_sum"))
