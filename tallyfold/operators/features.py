"""The 346 features of each (fold, user), from one shuffled pass over the activity.

Rows are brought together by user once; days, gaps between purchases, the sums of
all folds, windows and targets then need no other exchange.  The wide steps are SQL text:
a call for each part of hundreds of columns took longer than the pass itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..config import DAY, DECAYS, LOOKBACKS, MONEY, PAIRS, SUMMED, USER, Calendar
from ..functions.numeric import filled, safe_div
from ..sources.scratch import written
from .btyd import heuristic
from .folds import as_of, validated

#: Fixed value: natural logarithm of two, for the half lives of decayed sums.
LN2 = 0.6931471805599453


def _cents(column: str) -> Column:
    return (F.col(column).cast("decimal(18,2)") * 100).cast("long")


def daily(activity: DataFrame, last: date) -> DataFrame:
    """One row per user and active day up to ``last``, with the gap since the last purchase day.

    Money is in whole cents, whose sums are as exact as decimals' and take a fraction of the time.  Several purchase rows on one day are gaps of 0 after the first.
    Each of these rows becomes hundreds of values for each fold, so the session's number of
    shuffle partitions is kept, which adaptive execution would lower by the size of the rows.
    """
    parts = int(activity.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = activity.where(F.col(DAY) <= F.lit(last)).repartition(parts, USER)
    bought = F.col("gmv") > 0
    days = rows.groupBy(USER, DAY).agg(
        *[F.sum(F.coalesce(_cents(c) if c in MONEY else F.col(c), F.lit(0))).alias(c) for c in SUMMED],
        F.count_if(bought).alias("buys"),
        F.sum(F.when(bought, _cents("gmv"))).alias("bought"),
    )
    earlier = F.last(F.when(F.col("buys") > 0, F.col(DAY)), ignorenulls=True).over(Window.partitionBy(USER).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1))
    return days.withColumn("gap", F.when(F.col("buys") > 0, F.datediff(DAY, earlier)))


def _band() -> Column:
    """The band of ages that a day falls into: window k of the lookbacks less the one before; one more for older days, and -1 for days after the cutoff."""
    found = F.when(F.col("age") < 0, -1)
    for k, n in enumerate(LOOKBACKS):
        found = found.when(F.col("age") < n, k)
    return found.otherwise(len(LOOKBACKS))


def bands(activity: DataFrame, folds: DataFrame, cal: Calendar, target: bool = False) -> DataFrame:
    """Sums per (fold, user, band of ages): the only step that looks at each day for each fold. With ``target`` the days to forecast are a band, too."""
    days = as_of(daily(activity, cal.hist_end + timedelta(days=cal.target_days) if target else cal.hist_end), folds, "target_end" if target else "cutoff")
    bought = F.col("buys") > 0
    # Gaps of a day: one since the day before, and 0 for each further row.
    zeros = F.when(bought, F.col("buys") - 1).otherwise(0)
    decayed = [F.expr(f"sum(CASE WHEN age >= 0 AND age < {n} THEN gmv / 100D * exp({-LN2}D * age / {n}) END) AS ema_gmv_{n}d") for n in DECAYS]
    return days.withColumn("band", _band()).groupBy("fold", "fold_idx", "cutoff", USER, "band").agg(
        F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day"), F.count("*").alias("active"),
        F.min(F.when(bought, F.col(DAY))).alias("first_buy"), F.max(F.when(bought, F.col(DAY))).alias("last_buy"),
        F.count_if(bought).alias("buy_days"), F.sum("buys").alias("buy_rows"), F.sum("bought").alias("buy_sum"),
        (F.count("gap") + F.sum(zeros)).alias("gaps"), F.sum("gap").alias("gap_sum"), F.sum(F.col("gap").cast("long") * F.col("gap")).alias("gap_squares"),
        F.min(F.when(zeros > 0, F.lit(0)).otherwise(F.col("gap"))).alias("gap_min"), F.max("gap").alias("gap_max"),
        *[F.sum(c).alias(c) for c in SUMMED], *decayed,
    )


def aggregates(activity: DataFrame, folds: DataFrame, cal: Calendar, target: bool = False) -> DataFrame:
    """Everything summed per (fold, user). Sums over empty windows are null, which the ratios rely on.

    Days are summed into disjoint bands of ages first; windows are sums over a handful of bands.
    ``target`` adds the spend of the days after the cutoff (0 or more) and its logarithm, from the same pass.
    """
    past = "CASE WHEN band >= 0 THEN {} END"

    def over(kind: str, *columns: str) -> list[str]:
        return [f"{kind}({past.format(c)}) AS {c}" for c in columns]

    found = [*over("min", "first_day", "first_buy", "gap_min"), *over("max", "last_day", "last_buy", "gap_max"), *over("sum", "active", "buy_days", "buy_rows", "gaps", "gap_sum", "gap_squares"), f"sum({past.format('buy_sum')}) / 100D AS buy_sum"]
    for k, n in enumerate(LOOKBACKS):
        inside = f"sum(CASE WHEN band >= 0 AND band <= {k} THEN {{}} END)"
        found += [f"{inside.format(c)} / {100 if c in MONEY else 1}D AS {c}_sum_{n}d" for c in SUMMED]
        found += [f"nullif(coalesce({inside.format(c)}, 0), 0) AS {name}_{n}d" for c, name in (("active", "n_active_days"), ("buy_days", "n_purchase_days"))]
    found += [f"sum(ema_gmv_{n}d) AS ema_gmv_{n}d" for n in DECAYS]
    if target:
        spent = "greatest(coalesce(sum(CASE WHEN band < 0 THEN gmv END), 0) / 100D, 0D)"
        found += [f"{spent} AS target", f"log1p({spent}) AS target_log"]
    sums = bands(activity, folds, cal, target).groupBy("fold", "fold_idx", "cutoff", USER).agg(*map(F.expr, found))
    # Who is seen after the cutoff only is no user of the fold.
    return sums.where("active > 0") if target else sums


def _lifetime() -> dict[str, str]:
    recency, tenure = "datediff(cutoff, last_day)", "(datediff(cutoff, first_day) + 1)"
    logs = (f"CASE WHEN {x} IS NOT NULL THEN log1p(greatest(CAST({x} AS double), 0D)) END" for x in (tenure, recency))
    return dict(zip(S.LIFETIME, (recency, tenure, "active", safe_div("active", tenure), *logs)))


def _purchase() -> dict[str, str]:
    days, n, total = "nullif(buy_days, 0)", "CAST(nullif(gaps, 0) AS double)", "CAST(coalesce(gap_sum, 0) AS double)"
    spread = f"CASE WHEN gaps > 1 THEN sqrt(greatest((coalesce(gap_squares, 0) - {total} * {total} / {n}) / ({n} - 1), 0D)) END"
    few, most = "CASE WHEN gaps > 0 THEN gap_min END", "CASE WHEN gaps > 0 THEN coalesce(gap_max, 0) END"
    values = ("datediff(cutoff, last_buy)", "datediff(cutoff, first_buy)", days, "buy_sum", f"CAST({days} AS double)", f"{total} / {n}", spread, few, most)
    return dict(zip(S.PURCHASE, values))


def _ratios() -> dict[str, str]:
    found = {}
    for n in LOOKBACKS:
        gmv, orders, cart, searches = (f"{c}_sum_{n}d" for c in ("gmv", "to_ord", "to_cart", "searches"))
        active, bought = f"n_active_days_{n}d", f"n_purchase_days_{n}d"
        values = (safe_div(gmv, active), safe_div(gmv, orders), safe_div(gmv, bought), safe_div(orders, cart), safe_div(cart, searches), safe_div(active, str(n)))
        found |= {f"{name}_{n}d": v for name, v in zip(("gmv_per_active_day", "avg_order_value", "gmv_per_purchase_day", "cart_to_order_rate", "search_to_cart_rate", "activity_density"), values)}
    for a, b in PAIRS:
        for name, column in (("gmv", "gmv_sum_{}d"), ("orders", "to_ord_sum_{}d"), ("purchase_days", "n_purchase_days_{}d")):
            found[f"{name}_ratio_{a}_{b}"] = safe_div(column.format(a), column.format(b))
    for name, column in (("gmv", "gmv_sum_{}d"), ("orders", "to_ord_sum_{}d")):
        new, all_ = column.format(30), column.format(90)
        # Null before the subtraction when the last 30 days are empty, and so 0 in the end.
        found[f"{name}_old_60d"] = f"CASE WHEN {new} IS NOT NULL THEN greatest({all_} - {new}, 0D) END"
        found[f"{name}_recent_share"] = safe_div(new, all_)
    return found


def _targets(rows: DataFrame) -> list[str]:
    return [c for c in ("target", "target_log") if c in rows.columns]


def base(sums: DataFrame) -> DataFrame:
    """The 175 base features before nulls are filled, with fold, fold_idx, cutoff and user, and targets where there are. The BTYD features are the heuristic's unless ``sums`` has them."""
    blocks = {**{c: c for c in S.LOOKBACK + S.DECAYED + S.BTYD}, **_lifetime(), **_purchase(), **_ratios()}
    if S.BTYD[0] not in sums.columns:
        sums = sums.withColumns(heuristic())
    return sums.selectExpr("fold", "fold_idx", "cutoff", USER, *[f"{blocks[name]} AS {name}" for name in S.BASE], *_targets(sums))


def complete(values: DataFrame, columns: tuple[str, ...] = S.FEATURES) -> DataFrame:
    """All 346 features, or ``columns`` of them, with 0 for what is missing, and the cutoff as ``cutoff_date``; then the targets where there are."""
    base = dict.fromkeys(c.removeprefix("log1p_") for c in columns)
    held = values.selectExpr("fold", "fold_idx", USER, "cutoff AS cutoff_date", *[f"{filled(c)} AS {c}" for c in base], *_targets(values))
    # A missing value is 0, and so is its logarithm.
    return held.selectExpr("fold", "fold_idx", USER, "cutoff_date", *[f"log1p(greatest({c.removeprefix('log1p_')}, 0D)) AS {c}" if c.startswith("log1p_") else c for c in columns], *_targets(values))


def build(activity: DataFrame, folds: DataFrame, cal: Calendar, users: DataFrame | None = None, columns: tuple[str, ...] = S.FEATURES, target: bool = False) -> DataFrame:
    """Features of every user seen by each cutoff, of those in ``users`` if given; only ``columns`` of them are worked out. ``target`` adds target and target_log from the same pass."""
    if users is not None:
        activity = activity.join(users.select(USER).distinct(), USER, "left_semi")
    folds = validated(folds, cal)
    return complete(base(aggregates(activity, folds, cal, target)), columns)


def narrowed(table: DataFrame) -> DataFrame:
    """Doubles as floats and longs as ints, but for keys: half the bytes at the sink."""
    kinds = {"double": "float", "bigint": "int"}
    return table.select(*[F.col(c).cast(kinds[t]).alias(c) if t in kinds and c not in S.KEYS[:3] else F.col(c) for c, t in table.dtypes])


def feature_columns(table: DataFrame) -> list[str]:
    """The feature columns that a table has, in the schema's order."""
    there = set(table.columns)
    return [c for c in S.FEATURES if c in there]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fold and column of a task's rows: count, sums of target_log and its square, and, around a value of the column, sums of it, its square and its product with target_log.

    The value is the column's first, so that squares of large numbers do not cancel.  Nulls add nothing.
    """
    sums, origin, names = {}, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        folds, y = batch.column(0).to_numpy(zero_copy_only=False), pc.fill_null(batch.column(1), 0.0).to_numpy(zero_copy_only=False)
        names, columns = batch.schema.names[2:], batch.columns[2:]
        if origin is None:
            origin = [next((v for v in c.to_pylist() if v is not None), 0.0) for c in columns]
        values = np.stack([pc.fill_null(c, o).to_numpy(zero_copy_only=False) - o for c, o in zip(columns, origin)])
        for fold in np.unique(folds):
            x, t = values[:, folds == fold], y[folds == fold]
            found = (len(t), t.sum(), t @ t, x.sum(axis=1), np.einsum("ij,ij->i", x, x), x @ t)
            sums[fold] = tuple(a + b for a, b in zip(sums[fold], found)) if fold in sums else found
    for fold, (n, t, tt, x, xx, xt) in sums.items():
        k = len(names)
        same = [pa.array(np.full(k, v)) for v in (np.int64(n), float(t), float(tt))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, fold, np.int32)), pa.array(names, pa.string()), *same, *map(pa.array, (np.array(origin, float), x, xx, xt))], ["fold_idx", "feature", "n", "y", "yy", "o", "x", "xx", "xy"])


def relevance(table: DataFrame, columns: list[str], last: int) -> DataFrame:
    """(fold_model, feature, importance): absolute correlation of each column with target_log over the folds before each fold up to ``last``.

    The moments of all columns come from one pass, a matrix product for each batch, and are written; they add
    up over folds, so a fold's ranking never sees the fold itself.  A constant column has 0.
    """
    parts = written(table.where("fold != 'test'").selectExpr("fold_idx", "target_log", *[f"CAST({c} AS double) AS {c}" for c in columns]).mapInArrow(_moments, "fold_idx int, feature string, n long, y double, yy double, o double, x double, xx double, xy double"), "moments")
    # The parts' sums around one value, which for a constant column is the constant.
    d = F.col("o") - F.min("o").over(Window.partitionBy("feature"))
    shifted = parts.withColumn("d", d).selectExpr("fold_idx", "feature", "n", "y", "yy", "x + n * d AS x", "xx + 2 * d * x + n * d * d AS xx", "xy + d * y AS xy")
    models = parts.select(F.col("fold_idx").alias("fold_model")).distinct().where(F.col("fold_model") <= last)
    later = shifted.join(F.broadcast(models), F.col("fold_idx") < F.col("fold_model"))
    whole = later.groupBy("fold_model", "feature").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "x", "xx", "xy")])
    spread = (F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("yy") - F.col("y") ** 2)
    value = F.abs(F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(F.when(spread > 0, spread))
    return whole.select("fold_model", "feature", F.coalesce(value, F.lit(0.0)).alias("importance"))


def _lot(seed: int) -> Column:
    """A digest of seed, fold and user as hex digits, which any engine gives alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), "fold", F.col(USER).cast("string")))


def sample_fraction(table: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """About ``fraction`` of each fold's rows; the same rows in every run."""
    return table.where(F.conv(F.substring(_lot(seed), 1, 8), 16, 10).cast("long") < int(fraction * (1 << 32)))


def sample_rows(table: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` rows of each fold, or all if it has fewer; the same in every run.

    Parts of each fold choose their own first, so that no task sorts a whole fold.
    """
    table = table.withColumn("_h", _lot(seed)).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    for keys in (("fold", "_part"), ("fold",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", USER))
        table = table.withColumn("_rank", rank).where(F.col("_rank") <= rows)
    return table.drop("_h", "_part", "_rank")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
