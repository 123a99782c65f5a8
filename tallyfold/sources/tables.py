"""Built tables: feature folds, predictions, importances, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_folds(table: DataFrame, path: str) -> None:
    """One dataset partitioned by fold; writing some folds again replaces only those. The test fold has null targets."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """All folds, old to new by ``fold_idx`` and not by name."""
    return spark.read.parquet(path)


def read_fold(spark: SparkSession, path: str, fold: int | str) -> DataFrame:
    """One fold by index or name, reading only its partition; a missing one is an error."""
    name = fold if isinstance(fold, str) else f"fold_{fold}"
    rows = read_folds(spark, path).where(F.col("fold") == name)
    if not rows.limit(1).count():
        raise FileNotFoundError(f"no fold {name!r} in {path}")
    return rows


def write_csv(table: DataFrame, path: str) -> None:
    """Out-of-fold predictions, submissions or importances, with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_settings(spark: SparkSession, settings: dict[str, float], path: str) -> None:
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in settings.items()])
    row.write.mode("overwrite").json(path)


def read_settings(spark: SparkSession, path: str, defaults: dict[str, float]) -> dict[str, float]:
    """Stored settings laid over the defaults."""
    rows = spark.read.json(path).limit(1).collect()
    return defaults | (rows[0].asDict() if rows else {})
