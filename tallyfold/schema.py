"""Input types and the names of all features, in order."""

from __future__ import annotations

from pyspark.sql import types as T

from .config import COUNTS, DAY, DECAYS, FLAGS, LOOKBACKS, MONEY, PAIRS, SUMMED, USER

ACTIVITY = T.StructType(
    [T.StructField(USER, T.LongType()), T.StructField(DAY, T.DateType())]
    + [T.StructField(c, T.IntegerType()) for c in FLAGS]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(c, T.DecimalType(18, 2)) for c in MONEY]
)

LIFETIME = ("recency_days", "tenure_days", "n_active_days_total", "activity_density_total", "log_tenure_days", "log_recency_days")
PURCHASE = ("recency_purchase_days", "first_purchase_days", "n_purchase_days", "total_purchase_gmv", "purchase_frequency", "mean_purchase_gap", "std_purchase_gap", "min_purchase_gap", "max_purchase_gap")
LOOKBACK = tuple(name for days in LOOKBACKS for name in (*(f"{c}_sum_{days}d" for c in SUMMED), f"n_active_days_{days}d", f"n_purchase_days_{days}d"))
BTYD = ("btyd_p_alive", "btyd_exp_orders_30d", "btyd_exp_gmv_30d", "btyd_log_exp_orders", "btyd_log_exp_gmv", "btyd_order_value", "btyd_total_gmv")
DECAYED = tuple(f"ema_gmv_{days}d" for days in DECAYS)
RATIOS = tuple(f"{name}_{days}d" for days in LOOKBACKS for name in ("gmv_per_active_day", "avg_order_value", "gmv_per_purchase_day", "cart_to_order_rate", "search_to_cart_rate", "activity_density"))
CROSS = tuple(f"{name}_ratio_{a}_{b}" for a, b in PAIRS for name in ("gmv", "orders", "purchase_days"))
RECENT = ("gmv_old_60d", "gmv_recent_share", "orders_old_60d", "orders_recent_share")
BASE = LIFETIME + PURCHASE + LOOKBACK + BTYD + DECAYED + RATIOS + CROSS + RECENT
#: A logarithm of each base feature whose name does not already say that it is one.
LOGS = tuple(f"log1p_{name}" for name in BASE if "log_" not in name)
FEATURES = BASE + LOGS
#: Columns of a feature table that are not features.
KEYS = ("fold", "fold_idx", USER, "cutoff_date", "target", "target_log")
