"""SQL of the registered queries, for a database that reads the same tables."""

from __future__ import annotations

from .. import schema as S
from ..config import DECAYS, EVENTS, LOOKBACKS, ORDERS, PAIRS, SUMMED, Calendar

#: The orders fixture as daily activity.
ORDERS_ACTIVITY = """li AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o_custkey AS user_id, CAST(o_orderdate AS date) AS event_date, o_orderstatus AS st,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS s,
         coalesce(n, 0) AS n, CAST(o_totalprice AS decimal(18,2)) AS p
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
e AS (
  SELECT user_id, event_date, s, n AS searches, CASE WHEN st IN ('P', 'F') THEN n ELSE 0 END AS to_cart,
         CASE WHEN st = 'F' THEN 1 ELSE 0 END AS to_ord,
         CASE WHEN st = 'F' THEN p ELSE CAST(0 AS decimal(18,2)) END AS gmv
  FROM o),
a AS (
  SELECT user_id, event_date,
    CAST(max(s) AS int) AS search, CAST(max(1 - s) AS int) AS cat,
    CAST(max(CASE WHEN s = 1 AND to_cart > 0 THEN 1 ELSE 0 END) AS int) AS has_search_to_cart,
    CAST(max(CASE WHEN s = 1 AND to_ord > 0 THEN 1 ELSE 0 END) AS int) AS has_search_to_ord,
    CAST(max(CASE WHEN s = 0 AND to_cart > 0 THEN 1 ELSE 0 END) AS int) AS has_cat_to_cart,
    CAST(max(CASE WHEN s = 0 AND to_ord > 0 THEN 1 ELSE 0 END) AS int) AS has_cat_to_ord,
    CAST(sum(s * to_cart) AS bigint) AS search_to_cart, CAST(sum(s * to_ord) AS bigint) AS search_to_ord,
    CAST(sum((1 - s) * to_cart) AS bigint) AS cat_to_cart, CAST(sum((1 - s) * to_ord) AS bigint) AS cat_to_ord,
    CAST(sum(to_cart) AS bigint) AS to_cart, CAST(sum(to_ord) AS bigint) AS to_ord, CAST(sum(searches) AS bigint) AS searches,
    CAST(sum(CASE WHEN s = 1 THEN gmv END) AS decimal(18,2)) AS gmv_search,
    CAST(sum(CASE WHEN s = 0 THEN gmv END) AS decimal(18,2)) AS gmv_cat, CAST(sum(gmv) AS decimal(18,2)) AS gmv
  FROM e GROUP BY user_id, event_date)"""

#: The events fixture as daily activity.
EVENTS_ACTIVITY = """a AS (
  SELECT user_id, event_date,
    CAST(max(CASE WHEN s = 1 AND k = 'view' THEN 1 ELSE 0 END) AS int) AS search,
    CAST(max(CASE WHEN s = 0 AND k = 'view' THEN 1 ELSE 0 END) AS int) AS cat,
    CAST(max(CASE WHEN s = 1 AND k = 'click' THEN 1 ELSE 0 END) AS int) AS has_search_to_cart,
    CAST(max(CASE WHEN s = 1 AND k = 'purchase' THEN 1 ELSE 0 END) AS int) AS has_search_to_ord,
    CAST(max(CASE WHEN s = 0 AND k = 'click' THEN 1 ELSE 0 END) AS int) AS has_cat_to_cart,
    CAST(max(CASE WHEN s = 0 AND k = 'purchase' THEN 1 ELSE 0 END) AS int) AS has_cat_to_ord,
    count(CASE WHEN s = 1 AND k = 'click' THEN 1 END) AS search_to_cart, count(CASE WHEN s = 1 AND k = 'purchase' THEN 1 END) AS search_to_ord,
    count(CASE WHEN s = 0 AND k = 'click' THEN 1 END) AS cat_to_cart, count(CASE WHEN s = 0 AND k = 'purchase' THEN 1 END) AS cat_to_ord,
    count(CASE WHEN k = 'click' THEN 1 END) AS to_cart, count(CASE WHEN k = 'purchase' THEN 1 END) AS to_ord, count(CASE WHEN k = 'view' THEN 1 END) AS searches,
    CAST(coalesce(sum(CASE WHEN s = 1 AND k = 'purchase' THEN v END), 0) AS decimal(18,2)) AS gmv_search,
    CAST(coalesce(sum(CASE WHEN s = 0 AND k = 'purchase' THEN v END), 0) AS decimal(18,2)) AS gmv_cat,
    CAST(coalesce(sum(CASE WHEN k = 'purchase' THEN v END), 0) AS decimal(18,2)) AS gmv
  FROM (SELECT user_id, CAST(ts AS date) AS event_date, event_type AS k, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS s,
               CAST(value AS decimal(18,2)) AS v FROM events) x
  GROUP BY user_id, event_date)"""


def folds(cal: Calendar) -> str:
    """Common table f: the folds and the test fold, by date arithmetic."""
    n, days = cal.kept_folds, cal.target_days
    return f"""f AS (
  SELECT fold, fold_idx, cutoff, cutoff + 1 AS target_start, cutoff + {days} AS target_end FROM (
    SELECT 'fold_' || i AS fold, CAST(i AS int) AS fold_idx, DATE '{cal.hist_end}' - CAST({days} + ({n - 1} - i) * {cal.step} AS int) AS cutoff FROM range({n}) r(i)
    UNION ALL SELECT 'test', {n}, DATE '{cal.hist_end}') c)"""


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS double) / CASE WHEN {b} IS NOT NULL THEN greatest(CAST({b} AS double), 1e-6) END)"


def _log(x: str) -> str:
    return f"ln(1 + CASE WHEN {x} IS NOT NULL THEN greatest(CAST({x} AS double), 0) END)"


def sums(activity: str = ORDERS_ACTIVITY, cal: Calendar = ORDERS) -> str:
    """Common tables up to g: everything summed per fold and user."""
    windows = []
    for n in LOOKBACKS:
        windows += [f"CAST(sum(coalesce({c}, 0)) FILTER (age < {n}) AS double) AS {c}_sum_{n}d" for c in SUMMED]
        windows += [f"nullif(count(*) FILTER (age < {n}), 0) AS n_active_days_{n}d", f"nullif(count(*) FILTER (age < {n} AND gmv > 0), 0) AS n_purchase_days_{n}d"]
    windows += [f"sum(CAST(coalesce(gmv, 0) AS double) * exp(-0.6931471805599453 * age / {n})) FILTER (age < {n}) AS ema_gmv_{n}d" for n in DECAYS]
    return f"""WITH {activity},
{folds(cal)},
b AS (SELECT *, CASE WHEN gmv > 0 THEN date_diff('day', lag(event_date) OVER (PARTITION BY user_id, gmv > 0 ORDER BY event_date), event_date) END AS gap FROM a),
h AS (SELECT f.fold, f.fold_idx, f.cutoff, b.*, date_diff('day', event_date, cutoff) AS age FROM b JOIN f ON event_date <= cutoff),
g AS (
  SELECT fold, fold_idx, cutoff, user_id, min(event_date) AS first_day, max(event_date) AS last_day, count(*) AS active,
    min(event_date) FILTER (gmv > 0) AS first_buy, max(event_date) FILTER (gmv > 0) AS last_buy,
    count(*) FILTER (gmv > 0) AS buy_days, CAST(sum(gmv) FILTER (gmv > 0) AS double) AS buy_sum,
    avg(gap) AS gap_mean, stddev_samp(gap) AS gap_std, min(gap) AS gap_min, max(gap) AS gap_max,
    {", ".join(windows)}
  FROM h GROUP BY fold, fold_idx, cutoff, user_id)"""


def blocks() -> dict[str, str]:
    """Each base feature as an expression over g, before nulls are filled."""
    recency, tenure = "date_diff('day', last_day, cutoff)", "(date_diff('day', first_day, cutoff) + 1)"
    found = dict(zip(S.LIFETIME, (recency, tenure, "active", _div("active", tenure), _log(tenure), _log(recency))))
    days = "nullif(buy_days, 0)"
    found |= dict(zip(S.PURCHASE, ("date_diff('day', last_buy, cutoff)", "date_diff('day', first_buy, cutoff)", days, "buy_sum", days, "gap_mean", "gap_std", "gap_min", "gap_max")))
    found |= {c: c for c in S.LOOKBACK + S.DECAYED}
    alive = "exp(-0.02 * (date_diff('day', first_buy, cutoff) - date_diff('day', first_buy, last_buy)))"
    orders = f"({alive} * buy_days / (date_diff('day', first_buy, cutoff) + 30) * 30)"
    value = f"(buy_sum / {days})"
    found |= dict(zip(S.BTYD, (alive, orders, f"({orders} * {value})", _log(orders), _log(f"({orders} * {value})"), value, "buy_sum")))
    for n in LOOKBACKS:
        gmv, order, cart, search, active, bought = f"gmv_sum_{n}d", f"to_ord_sum_{n}d", f"to_cart_sum_{n}d", f"searches_sum_{n}d", f"n_active_days_{n}d", f"n_purchase_days_{n}d"
        names = [c for c in S.RATIOS if c.endswith(f"_{n}d")]
        found |= dict(zip(names, (_div(gmv, active), _div(gmv, order), _div(gmv, bought), _div(order, cart), _div(cart, search), _div(active, str(n)))))
    for a, b in PAIRS:
        found[f"gmv_ratio_{a}_{b}"] = _div(f"gmv_sum_{a}d", f"gmv_sum_{b}d")
        found[f"orders_ratio_{a}_{b}"] = _div(f"to_ord_sum_{a}d", f"to_ord_sum_{b}d")
        found[f"purchase_days_ratio_{a}_{b}"] = _div(f"n_purchase_days_{a}d", f"n_purchase_days_{b}d")
    for name, column in (("gmv", "gmv_sum"), ("orders", "to_ord_sum")):
        found[f"{name}_old_60d"] = f"CASE WHEN {column}_30d IS NOT NULL THEN greatest({column}_90d - {column}_30d, 0) END"
        found[f"{name}_recent_share"] = _div(f"{column}_30d", f"{column}_90d")
    return found


def features(columns: tuple[str, ...], extra: str = "") -> str:
    """The given features of each fold and user, missing values as 0, rounded to 4 places."""
    made = blocks()
    base = sorted({c.removeprefix("log1p_") for c in columns}, key=S.BASE.index)
    inner = ", ".join(f"{made[c]} AS x_{c}" for c in base)
    outer = ", ".join(f"round(coalesce(CAST({_log('x_' + c.removeprefix('log1p_')) if c.startswith('log1p_') else 'x_' + c} AS double), 0), 4) AS {c}" for c in columns)
    return f"{sums()},\nv AS (SELECT fold, fold_idx, cutoff, user_id, {inner} FROM g)\nSELECT fold, user_id, {outer}{extra} FROM v"


def _values(columns: tuple[str, ...]) -> str:
    """Common tables up to c: the given features of each fold and user, missing values as 0."""
    made = blocks()
    base = sorted({c.removeprefix("log1p_") for c in columns}, key=S.BASE.index)
    inner = ", ".join(f"{made[c]} AS x_{c}" for c in base)
    outer = ", ".join(f"coalesce(CAST({_log('x_' + c.removeprefix('log1p_')) if c.startswith('log1p_') else 'x_' + c} AS double), 0) AS {c}" for c in columns)
    return f"{sums()},\nv AS (SELECT fold, fold_idx, user_id, {inner} FROM g WHERE fold <> 'test'),\nc AS (SELECT fold, fold_idx, user_id, {outer} FROM v)"


def _standardize(columns: tuple[str, ...]) -> str:
    moments = ", ".join(f"avg({c}) AS m_{c}, greatest(coalesce(stddev_samp({c}), 0), 1e-6) AS s_{c}" for c in columns)
    return f"""{_values(columns)}, m AS (SELECT {moments} FROM c WHERE fold_idx < {ORDERS.kept_folds - 1})
SELECT fold, user_id, {", ".join(f"round(({c} - m_{c}) / s_{c}, 5) AS {c}" for c in columns)} FROM c, m"""


def _top(columns: tuple[str, ...], k: int) -> str:
    """Absolute correlations with the logarithm of the target in the folds before each fold, their mean, and the first k."""
    corr = ", ".join(f"abs(coalesce(CASE WHEN min({c}) < max({c}) THEN corr({c}, y) END, 0)) AS {c}" for c in columns)
    return f"""{_values(columns)}, {_TARGETS.split("u AS")[0].rstrip().rstrip(",")},
z AS (SELECT c.*, ln(1 + greatest(coalesce(spent, 0), 0)) AS y FROM c LEFT JOIN t ON c.fold = t.fold AND c.user_id = t.user_id),
w AS (SELECT b.i AS fold_model, {corr} FROM z JOIN (SELECT CAST(i AS int) AS i FROM range(1, {ORDERS.kept_folds}) r(i)) b ON z.fold_idx < b.i GROUP BY b.i),
long AS (UNPIVOT w ON COLUMNS(* EXCLUDE (fold_model)) INTO NAME feature VALUE importance)
SELECT feature, round(avg(importance), 4) AS importance FROM long GROUP BY feature ORDER BY importance DESC, feature LIMIT {k}"""


PREDICTORS = f"""{sums()},
p AS (SELECT fold, fold_idx, user_id, coalesce(gmv_sum_30d, 0) AS last30, coalesce(gmv_sum_90d, 0) / 3 AS last90, coalesce({blocks()["btyd_exp_gmv_30d"]}, 0) AS btyd FROM g),
t AS (SELECT f.fold, a.user_id, CAST(sum(gmv) AS double) AS spent FROM a JOIN f ON event_date BETWEEN target_start AND target_end GROUP BY f.fold, a.user_id),
pt AS (SELECT p.*, greatest(coalesce(spent, 0), 0) AS target FROM p LEFT JOIN t USING (fold, user_id)),
pred AS (
  SELECT 'last30' AS model, fold, user_id, target, last30 AS pred FROM pt UNION ALL
  SELECT 'btyd', fold, user_id, target, btyd FROM pt UNION ALL
  SELECT 'last90', fold, user_id, target, last90 FROM pt)"""

_TARGETS = """t AS (SELECT f.fold, a.user_id, CAST(sum(gmv) AS double) AS spent FROM a JOIN f ON event_date BETWEEN target_start AND target_end GROUP BY f.fold, a.user_id),
u AS (SELECT DISTINCT f.fold, f.fold_idx, a.user_id FROM a JOIN f ON event_date <= cutoff)"""

_SIZED = "n AS (SELECT fold_idx, count(*) AS n_users FROM u GROUP BY fold_idx)"

_BGNBD = {"r": 0.5, "alpha": 20.0, "a": 0.8, "b": 2.5}
_GAMMA = {"p": 2.5, "q": 3.5, "v": 1000.0}
_FREQUENT = {"r": 0.3, "alpha": 0.2, "a": 1.5, "b": 5.0}


def _summaries() -> str:
    return f"""{sums()},
s AS (SELECT fold, user_id, greatest(buy_days - 1, 0) AS x, date_diff('day', first_buy, last_buy) AS tx, date_diff('day', first_buy, cutoff) AS t, buy_sum / buy_days AS m, buy_sum AS total FROM g WHERE buy_days > 0)"""


def _loglik() -> str:
    r, al, a, b = _BGNBD.values()
    u, v = f"(-({r} + x) * ln({al} + t))", f"(ln({a}) - ln({b} + x - 1) - ({r} + x) * ln({al} + tx))"
    return f"lgamma({r} + x) - lgamma({r}) + {r} * ln({al}) + lgamma({b} + x) - lgamma({b}) - lgamma({a} + {b} + x) + lgamma({a} + {b}) + CASE WHEN x > 0 THEN greatest({u}, {v}) + ln(exp({u} - greatest({u}, {v})) + exp({v} - greatest({u}, {v}))) ELSE {u} END"


def _gamma_loglik() -> str:
    p, q, v = _GAMMA.values()
    return f"lgamma({p} * x + {q}) - lgamma({p} * x) - lgamma({q}) + {q} * ln({v}) + ({p} * x - 1) * ln(m) + {p} * x * ln(x) - ({p} * x + {q}) * ln(x * m + {v})"


def _alive(given: dict[str, float]) -> str:
    r, al, a, b = given.values()
    return f"CASE WHEN x > 0 THEN 1 / (1 + {a} / ({b} + x - 1) * exp(({r} + x) * (ln({al} + t) - ln({al} + tx)))) ELSE 1.0 END"


def _orders(given: dict[str, float]) -> str:
    r, al, a, b = given.values()
    z, q, c = f"(30 / ({al} + t + 30))", f"({a - 1})", f"({a + b} + x - 1)"
    return f"greatest({c} / {q} * (1 - exp({q} * ln(1 - {z})) * series) * ({_alive(given)}), 0)"


def _scores(given: dict[str, float]) -> str:
    """Common tables up to k: summaries with the hypergeometric series, as many terms of it as each row's convergence needs."""
    r, al, a, b = given.values()
    p, q, c, z = a + b - 1 - r, a - 1, f"({a + b} + x - 1)", f"(30 / ({al} + t + 30))"
    # (q)_k = q * (q + 1) * ...: for k >= 1 its size is |q| * gamma(q + k) / gamma(q + 1).
    term = f"lgamma({p} + k) - lgamma({p}) + ln({abs(q)}) + lgamma({q} + k) - lgamma({q} + 1) - lgamma({c} + k) + lgamma({c}) - lgamma(k + 1.0) + k * ln({z})"
    return f"""{_summaries()}, k AS (
  SELECT s.*, 1 + {1 if q > 0 else -1} * list_sum(list_transform(range(1, 80 + CAST(ceil(-40 / ln({z})) AS bigint)), lambda k: exp({term}))) AS series FROM s)"""


def _scored(given: dict[str, float]) -> str:
    return f"""{_scores(given)},
w AS (SELECT *, {_alive(given)} AS alive, {_orders(given)} AS n, CASE WHEN fold = 'fold_0' THEN m ELSE {_GAMMA['p']} * ({_GAMMA['v']} + x * m) / ({_GAMMA['p']} * x + {_GAMMA['q'] - 1}) END AS worth FROM k)
SELECT fold, user_id, round(alive, 6) AS btyd_p_alive, round(n, 6) AS btyd_exp_orders_30d, round(n * worth, 2) AS btyd_exp_gmv_30d, round(ln(1 + n), 6) AS btyd_log_exp_orders, round(ln(1 + n * worth), 6) AS btyd_log_exp_gmv, round(m, 4) AS btyd_order_value, round(total, 2) AS btyd_total_gmv FROM w"""


def _derivatives() -> str:
    """Mean likelihood of each fold and its derivatives, as sums over each buyer's purchases and shares of having left or not."""
    r, al, a, b = _BGNBD.values()
    rising = {n: f"coalesce(list_sum(list_transform(range(0, x), lambda k: 1 / ({v} + k))), 0)" for n, v in (("r", r), ("b", b), ("ab", a + b))}
    u, v = f"(-({r} + x) * ln({al} + t))", f"(ln({a}) - ln({b} + x - 1) - ({r} + x) * ln({al} + tx))"
    return f"""{_summaries()}, d AS (
  SELECT *, {_loglik()} AS ll, CASE WHEN x > 0 THEN 1 / (1 + exp({u} - {v})) ELSE 0 END AS gone, {", ".join(f"{e} AS s_{n}" for n, e in rising.items())} FROM s)
SELECT fold, count(*) AS n, round(avg(ll), 6) AS ll,
       round(avg(s_r + ln({al}) - (1 - gone) * ln({al} + t) - gone * ln({al} + tx)), 6) AS d_r,
       round(avg({r} / {al} - ({r} + x) * ((1 - gone) / ({al} + t) + gone / ({al} + tx))), 6) AS d_alpha,
       round(avg(gone / {a} - s_ab), 6) AS d_a,
       round(avg(s_b - s_ab - CASE WHEN x > 0 THEN gone / ({b} + x - 1) ELSE 0 END), 6) AS d_b
FROM d GROUP BY fold"""


def all_queries() -> dict[str, str]:
    act, f = f"WITH {ORDERS_ACTIVITY}", folds(ORDERS)
    plain = "SELECT * REPLACE (CAST(gmv_search AS double) AS gmv_search, CAST(gmv_cat AS double) AS gmv_cat, CAST(gmv AS double) AS gmv) FROM a"
    found = {
        "activity_daily": f"{act} {plain}",
        "activity_events": f"WITH {EVENTS_ACTIVITY} {plain}",
        "dq_volume": f"""{act} SELECT *, date_diff('day', first_day, last_day) + 1 AS calendar_days, n_users * (date_diff('day', first_day, last_day) + 1) AS dense_rows, round(n_rows / n_users, 6) AS rows_per_user
FROM (SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, min(event_date) AS first_day, max(event_date) AS last_day, count(*) FILTER (gmv < 0) AS negative_gmv FROM a)""",
        "dq_nulls": f"{act} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM a" for c in S.ACTIVITY.fieldNames()),
        "dq_duplicates": "WITH r AS (SELECT o_custkey, CAST(o_orderdate AS date) AS d, count(*) AS n FROM orders GROUP BY ALL) SELECT CAST(coalesce(sum(n - 1), 0) AS bigint) AS duplicate_rows FROM r",
        "fold_calendar": f"{act}, {f}, {_TARGETS}, {_SIZED} SELECT f.*, coalesce(n_users, 0) AS n_users FROM f LEFT JOIN n USING (fold_idx)",
        "fold_overlap_check": f"{act}, {f}, {_TARGETS}, {_SIZED} SELECT fold, fold_idx, target_start, prev_target_end, coalesce(target_start <= prev_target_end, false) AS overlaps, n_users FROM n JOIN (SELECT *, lag(target_end) OVER (ORDER BY fold_idx) AS prev_target_end FROM f) USING (fold_idx)",
        "walk_forward_pairs": f"{act}, {f}, {_TARGETS}, {_SIZED} SELECT v.fold_idx AS valid_idx, t.fold_idx AS train_idx, nv.n_users AS valid_users, nt.n_users AS train_users FROM f v JOIN n nv ON v.fold_idx = nv.fold_idx JOIN f t ON t.fold_idx < v.fold_idx JOIN n nt ON t.fold_idx = nt.fold_idx WHERE v.fold <> 'test' AND t.fold <> 'test'",
        "walk_forward_last_two": f"{act}, {f}, {_TARGETS}, {_SIZED} SELECT v.fold_idx AS valid_idx, t.fold_idx AS train_idx, nv.n_users AS valid_users, nt.n_users AS train_users FROM f v JOIN n nv ON v.fold_idx = nv.fold_idx JOIN f t ON t.fold_idx < v.fold_idx JOIN n nt ON t.fold_idx = nt.fold_idx WHERE v.fold <> 'test' AND t.fold <> 'test' AND v.fold_idx >= {ORDERS.kept_folds - 2}",
        "leave_one_out_pairs": f"{act}, {f}, {_TARGETS}, {_SIZED} SELECT v.fold_idx AS valid_idx, t.fold_idx AS train_idx, nv.n_users AS valid_users, nt.n_users AS train_users FROM f v JOIN n nv ON v.fold_idx = nv.fold_idx JOIN f t ON t.fold_idx <> v.fold_idx JOIN n nt ON t.fold_idx = nt.fold_idx WHERE v.fold <> 'test' AND t.fold <> 'test'",
        "user_universe": f"{act}, {f}, {_TARGETS} SELECT fold, fold_idx, user_id FROM u",
        "target_window": f"{act}, {f}, {_TARGETS} SELECT fold, fold_idx, user_id, greatest(coalesce(spent, 0), 0) AS target, round(ln(1 + greatest(coalesce(spent, 0), 0)), 6) AS target_log FROM u LEFT JOIN t USING (fold, user_id)",
        "target_window_events": f"WITH {EVENTS_ACTIVITY}, {folds(EVENTS)}, {_TARGETS} SELECT fold, fold_idx, user_id, greatest(coalesce(spent, 0), 0) AS target, round(ln(1 + greatest(coalesce(spent, 0), 0)), 6) AS target_log FROM u LEFT JOIN t USING (fold, user_id)",
        "fold_report": f"{act}, {f}, {_TARGETS} SELECT fold, fold_idx, count(*) AS n_users, count(*) FILTER (spent > 0) AS n_positive, round(avg(CASE WHEN spent > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, round(sum(coalesce(spent, 0)), 2) AS target_sum FROM u LEFT JOIN t USING (fold, user_id) GROUP BY fold, fold_idx",
        "lifetime": features(S.LIFETIME),
        "purchase_history": features(S.PURCHASE[:5]),
        "purchase_gaps": features(S.PURCHASE[5:]),
        "lookback_sums": features(tuple(c for c in S.LOOKBACK if "_sum_" in c)),
        "lookback_days": features(tuple(c for c in S.LOOKBACK if "_sum_" not in c)),
        "ema_gmv": features(S.DECAYED),
        "btyd_heuristic": features(S.BTYD),
        "funnel_ratios": features(S.RATIOS),
        "cross_window": features(S.CROSS),
        "recent_vs_old": features(S.RECENT),
        "log_features": features(S.LOGS),
        "features_full": features(S.FEATURES),
        "rfm": f"{_summaries()} SELECT fold, user_id, CAST(x AS bigint) AS frequency, CAST(tx AS bigint) AS recency, CAST(t AS bigint) AS t, round(m, 4) AS monetary_value, round(total, 2) AS total_gmv FROM s",
        "bgnbd_loglik": f"{_summaries()} SELECT fold, user_id, round({_loglik()}, 6) AS loglik FROM s",
        "gamma_gamma_value": f"{_summaries()} SELECT fold, user_id, round({_GAMMA['p']} * ({_GAMMA['v']} + x * m) / ({_GAMMA['p']} * x + {_GAMMA['q'] - 1}), 4) AS expected_value FROM s",
        **{name: f"{_scores(given)} SELECT fold, user_id, round({_alive(given)}, 6) AS p_alive, round({_orders(given)}, 6) AS exp_orders FROM k" for name, given in (("bgnbd_scores", _BGNBD), ("bgnbd_scores_frequent", _FREQUENT))},
        "btyd_scored": _scored(_BGNBD),
        "btyd_scored_frequent": _scored(_FREQUENT),
        "bgnbd_derivatives": _derivatives(),
        "features_with_target": f"""{sums()}, {_TARGETS.split("u AS")[0].rstrip().rstrip(",")}
SELECT g.fold, g.user_id, round(coalesce(gmv_sum_30d, 0), 4) AS gmv_sum_30d, round(coalesce(gmv_sum_365d, 0), 4) AS gmv_sum_365d, greatest(coalesce(spent, 0), 0) AS target, round(ln(1 + greatest(coalesce(spent, 0), 0)), 6) AS target_log FROM g LEFT JOIN t ON g.fold = t.fold AND g.user_id = t.user_id""",
        "standardize": _standardize(S.FEATURES[:100]),
        "rmsle_by_fold": f"""{PREDICTORS}, k AS (SELECT model, fold, pow(ln(1 + greatest(pred, 0)) - ln(1 + greatest(target, 0)), 2) AS e FROM pred WHERE fold <> 'test')
SELECT model, fold, count(*) AS n, round(sqrt(avg(e)), 6) AS rmsle FROM k GROUP BY GROUPING SETS ((model, fold), (model))""",
        "oof_table": f"{PREDICTORS} SELECT model, fold, user_id, round(target, 2) AS target, round(pred, 4) AS pred FROM pred WHERE fold <> 'test'",
        "fold_average": f"{PREDICTORS} SELECT user_id, round(avg(pred), 4) AS predict FROM pred WHERE model = 'btyd' GROUP BY user_id",
        "seed_average": f"{PREDICTORS} SELECT user_id, round(exp(greatest(avg(ln(1 + greatest(pred, 0))), 0)) - 1, 4) AS predict FROM pred WHERE fold = 'test' GROUP BY user_id",
        "blend": f"{PREDICTORS} SELECT user_id, round(sum(pred * CASE model WHEN 'last30' THEN 0.50 WHEN 'btyd' THEN 0.35 ELSE 0.15 END), 4) AS predict FROM pred WHERE fold = 'test' GROUP BY user_id",
        "top_k_features": _top(S.FEATURES, 100),
        "gamma_gamma_loglik": f"{_summaries()} SELECT fold, user_id, round({_gamma_loglik()}, 6) AS loglik FROM s WHERE x > 0 AND m > 0",
        "sample_per_fold": f"""{act}, {f}, {_TARGETS},
h AS (SELECT *, md5('42|' || fold || '|' || user_id) AS h FROM u)
SELECT fold, fold_idx, user_id FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY h, user_id) AS k FROM h WHERE substr(h, 1, 8) < '4ccccccc') x WHERE k <= 100""",
    }
    # What is written and read again is the same.
    return found | {"activity_csv": found["activity_daily"], "folds_round_trip": found["features_with_target"]}
