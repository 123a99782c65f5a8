"""Rolling-origin folds, their checks, the target, and which folds train for which."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DAY, USER, Calendar
from ..functions.numeric import log1p0


def calendar(spark: SparkSession, cal: Calendar, test: bool = True) -> DataFrame:
    """(fold, fold_idx, cutoff, target_start, target_end), oldest first; the test fold's target follows history."""
    kept, days = cal.kept_folds, cal.target_days
    last = F.lit(cal.hist_end)
    folds = spark.range(kept).select(
        F.concat(F.lit("fold_"), F.col("id").cast("string")).alias("fold"),
        F.col("id").cast("int").alias("fold_idx"),
        F.date_sub(last, (F.lit(days) + (F.lit(kept - 1) - F.col("id")) * cal.step).cast("int")).alias("cutoff"),
    )
    if test:
        folds = folds.unionByName(spark.range(1).select(F.lit("test").alias("fold"), F.lit(kept).alias("fold_idx"), last.alias("cutoff")))
    return folds.select("*", F.date_add("cutoff", 1).alias("target_start"), F.date_add("cutoff", days).alias("target_end"))


def overlap_check(folds: DataFrame) -> DataFrame:
    """Each fold with the end of the target before it, and whether the two meet. One row per fold: the window is over a handful of rows."""
    before = F.lag("target_end").over(Window.orderBy("fold_idx"))
    return folds.select("fold", "fold_idx", "target_start", before.alias("prev_target_end")).withColumn("overlaps", F.coalesce(F.col("target_start") <= F.col("prev_target_end"), F.lit(False)))


def validated(folds: DataFrame, cal: Calendar) -> DataFrame:
    """``folds``, or an error if targets meet or a training target leaves history."""
    before = F.lag("target_end").over(Window.orderBy("fold_idx"))
    late = (F.col("fold") != "test") & (F.col("target_end") > F.lit(cal.hist_end))
    # One row per fold: a window over a handful of rows, in one job.
    if folds.withColumn("before", before).where((F.col("target_start") <= F.col("before")) | late).limit(1).count():
        raise ValueError("targets of folds overlap or leave the history")
    return folds


def as_of(activity: DataFrame, folds: DataFrame, until: str = "cutoff") -> DataFrame:
    """Each activity row once for each fold whose cutoff it does not pass, and its age in days; with ``until`` = target_end also those after the cutoff, of negative age.

    Folds are a table of a few rows made from the calendar, so they are broadcast.
    """
    return activity.join(F.broadcast(folds.select("fold", "fold_idx", "cutoff", F.col(until).alias("until"))), F.col(DAY) <= F.col("until")).drop("until").withColumn("age", F.datediff("cutoff", DAY))


def universe(activity: DataFrame, folds: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(fold, user_id) of users seen by the cutoff, of those in ``users`` if given."""
    if users is not None:
        activity = activity.join(users.select(USER).distinct(), USER, "left_semi")
    first = activity.groupBy(USER).agg(F.min(DAY).alias("first_day"))
    return first.join(F.broadcast(folds), F.col("first_day") <= F.col("cutoff")).select("fold", "fold_idx", USER)


def targets(activity: DataFrame, folds: DataFrame, people: DataFrame) -> DataFrame:
    """(fold, fold_idx, user_id, target, target_log) for each row of ``people`` (fold, fold_idx, user_id)."""
    inside = activity.select(USER, DAY, "gmv").join(F.broadcast(folds.select("fold", "target_start", "target_end")), F.col(DAY).between(F.col("target_start"), F.col("target_end")))
    spent = inside.groupBy("fold", USER).agg(F.sum("gmv").cast("double").alias("spent"))
    joined = people.select("fold", "fold_idx", USER).join(spent, ["fold", USER], "left")
    target = F.greatest(F.coalesce("spent", F.lit(0.0)), F.lit(0.0))
    return joined.select("fold", "fold_idx", USER, target.alias("target"), log1p0(target).alias("target_log"))


def sized(folds: DataFrame, activity: DataFrame) -> DataFrame:
    """``folds`` with n_users, the users seen by the cutoff. Users are counted by their first day before they meet the folds."""
    days = activity.groupBy(USER).agg(F.min(DAY).alias("first_day")).groupBy("first_day").agg(F.count("*").alias("n"))
    seen = days.join(F.broadcast(folds.select("fold", "cutoff")), F.col("first_day") <= F.col("cutoff")).groupBy("fold").agg(F.sum("n").alias("n_users"))
    return folds.join(seen, "fold", "left").withColumn("n_users", F.coalesce("n_users", F.lit(0).cast("long")))


def with_users(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """(valid_idx, train_idx) pairs with the rows that each side of the pair has, from folds with n_users."""
    for side in ("valid", "train"):
        pairs = pairs.join(F.broadcast(counted.select(F.col("fold_idx").alias(f"{side}_idx"), F.col("n_users").alias(f"{side}_users"))), f"{side}_idx")
    return pairs


def walk_forward(folds: DataFrame, last: int | None = None) -> DataFrame:
    """(valid_idx, train_idx): every fold but the first is validated on all older ones; with ``last``, only the newest so many."""
    idx = folds.where("fold != 'test'").select("fold_idx")
    pairs = idx.select(F.col("fold_idx").alias("valid_idx")).join(F.broadcast(idx.select(F.col("fold_idx").alias("train_idx"))), F.col("train_idx") < F.col("valid_idx"))
    if last is not None:
        pairs = pairs.join(F.broadcast(idx.agg((F.max("fold_idx") - last).alias("from"))), F.col("valid_idx") > F.col("from")).drop("from")
    return pairs


def leave_one_out(folds: DataFrame) -> DataFrame:
    """(valid_idx, train_idx): each fold is validated on all others, newer ones too."""
    idx = folds.where("fold != 'test'").select("fold_idx")
    return idx.select(F.col("fold_idx").alias("valid_idx")).join(F.broadcast(idx.select(F.col("fold_idx").alias("train_idx"))), F.col("train_idx") != F.col("valid_idx"))
