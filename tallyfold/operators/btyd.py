"""Buy-till-you-die: purchase summaries, the heuristic, and the fitted BG/NBD and gamma-gamma models.

Formulas follow Fader, Hardie and Lee (2005) and Fader and Hardie's note on the
gamma-gamma model.  A fit is Newton's method on written sufficient statistics,
histograms of the summaries: each step is one aggregate of the likelihood with its
first and second derivatives, for all folds together, so the activity is read once
whatever the number of steps.  Both likelihoods are sums of a term in the number of
purchases alone, with its gamma functions, and a term that also has times or means and takes a
few logarithms.  There are few numbers of purchases, so only the second grows with the buyers.  Expected purchases are an integral over the chance to
drop out, which converges for all parameters and periods alike.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import USER
from ..functions.numeric import digamma, lgamma, log1p0, trigamma
from ..sources.scratch import written

#: Penalty on squared parameters, repeat buyers that a value model needs, days of the forecast.
PENALTY, LEAST_REPEAT, DAYS = 0.01, 20, 30
#: Fixed values of the heuristic: decay of being alive per silent day, and days added to the time observed.
SILENCE, PRIOR_DAYS = 0.02, 30


def summary_columns() -> dict[str, Column]:
    """frequency, recency, t and monetary_value from what :func:`features.aggregates` sums."""
    return {
        "frequency": F.greatest(F.col("buy_days") - 1, F.lit(0)),
        "recency": F.greatest(F.datediff("last_buy", "first_buy"), F.lit(0)),
        "t": F.greatest(F.datediff("cutoff", "first_buy"), F.lit(0)),
        "monetary_value": F.col("buy_sum") / F.nullif(F.col("buy_rows"), F.lit(0)),
        "total_gmv": F.col("buy_sum"),
    }


def rfm(sums: DataFrame) -> DataFrame:
    """(fold, user, frequency, recency, t, monetary_value, total_gmv) of all buyers."""
    return sums.where("buy_days > 0").select("fold", USER, *[c.alias(n) for n, c in summary_columns().items()])


def heuristic() -> dict[str, Column]:
    """The seven BTYD features from sums, by the heuristic. Null for users who never bought."""
    s = summary_columns()
    alive = F.exp(-SILENCE * F.greatest(s["t"] - s["recency"], F.lit(0)))
    orders = F.when(F.col("buy_days") > 0, alive * (s["frequency"] + 1) / (s["t"] + PRIOR_DAYS) * DAYS)
    return _features(F.when(F.col("buy_days") > 0, alive), orders, orders * s["monetary_value"], s["monetary_value"], s["total_gmv"])


def _features(alive: Column, orders: Column, gmv: Column, value: Column, total: Column) -> dict[str, Column]:
    return {"btyd_p_alive": alive, "btyd_exp_orders_30d": orders, "btyd_exp_gmv_30d": gmv, "btyd_log_exp_orders": log1p0(orders), "btyd_log_exp_gmv": log1p0(gmv), "btyd_order_value": value, "btyd_total_gmv": total}


#: A term of a log likelihood, its first derivatives by the parameters, and those second ones that are not 0.
Term = tuple[Column, list[Column], dict[tuple[int, int], Column]]


def _total(*terms: Term) -> tuple[list[Column], dict[tuple[int, int], Column]]:
    """First and second derivatives of a sum of terms."""
    keys = sorted({k for _, _, second in terms for k in second})
    return [reduce(add, each) for each in zip(*(first for _, first, _ in terms))], {k: reduce(add, [second[k] for _, _, second in terms if k in second]) for k in keys}


def _bgnbd_count(x: Column, r: Column, alpha: Column, a: Column, b: Column) -> Term:
    """What the number x of repeat days alone adds to :func:`bgnbd_loglik`."""
    steps = F.slice(F.sequence(F.lit(0), x.cast("int")), F.lit(1), x.cast("int"))
    rising = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.log(r + k) + F.log(b + k) - F.log(a + b + k))
    first = [
        digamma(r + x) - digamma(r) + F.log(alpha),
        r / alpha,
        digamma(a + b) - digamma(a + b + x),
        digamma(b + x) - digamma(b) + digamma(a + b) - digamma(a + b + x),
    ]
    both = trigamma(a + b) - trigamma(a + b + x)
    second = {(0, 0): trigamma(r + x) - trigamma(r), (0, 1): 1 / alpha, (1, 1): -r / alpha**2, (2, 2): both, (2, 3): both, (3, 3): trigamma(b + x) - trigamma(b) + both}
    return rising + r * F.log(alpha), first, second


def _bgnbd_times(x: Column, tx: Column, t: Column, r: Column, alpha: Column, a: Column, b: Column) -> Term:
    """What the times add to :func:`bgnbd_loglik`."""
    repeat = x > 0
    before = F.when(repeat, b + x - 1).otherwise(F.lit(1.0))
    # A sum of two powers, u for being a buyer still and v for having left; their shares of it weigh their derivatives.
    u, v = -(r + x) * F.log(alpha + t), F.log(a) - F.log(before) - (r + x) * F.log(alpha + tx)
    both = F.greatest(u, v) + F.log(F.exp(u - F.greatest(u, v)) + F.exp(v - F.greatest(u, v)))
    left = F.when(repeat, 1 / (1 + F.exp(u - v))).otherwise(F.lit(0.0))
    du = [-F.log(alpha + t), -(r + x) / (alpha + t), F.lit(0.0), F.lit(0.0)]
    dv = [-F.log(alpha + tx), -(r + x) / (alpha + tx), 1 / a, -1 / before]
    spread = left * (1 - left)
    first = [(1 - left) * du[i] + left * dv[i] for i in range(4)]
    second = {(i, j): spread * (du[i] - dv[i]) * (du[j] - dv[j]) for i in range(4) for j in range(i, 4)}
    second[0, 1] -= (1 - left) / (alpha + t) + left / (alpha + tx)
    second[1, 1] += (r + x) * ((1 - left) / (alpha + t) ** 2 + left / (alpha + tx) ** 2)
    second[2, 2] -= left / a**2
    second[3, 3] += left / before**2
    return F.when(repeat, both).otherwise(u), first, second


def bgnbd_loglik(x: Column, tx: Column, t: Column, r: Column, alpha: Column, a: Column, b: Column) -> Column:
    """Log likelihood of a buyer with x repeat days, the last at tx of t days."""
    return _bgnbd_count(x, r, alpha, a, b)[0] + _bgnbd_times(x, tx, t, r, alpha, a, b)[0]


def bgnbd_alive(x: Column, tx: Column, t: Column, r: Column, alpha: Column, a: Column, b: Column) -> Column:
    """Probability of still being a buyer; 1 for those with one purchase day."""
    odds = a / F.when(x > 0, b + x - 1).otherwise(F.lit(1.0)) * F.exp((r + x) * (F.log(alpha + t) - F.log(alpha + tx)))
    return F.when(x > 0, 1 / (1 + odds)).otherwise(F.lit(1.0))


#: Step and reach of the double exponential rule: halving the step squares its error, which is about 1e-13 here.
STEP, REACH = 0.06, 6.6


def bgnbd_gain(x: Column, t: Column, r: Column, alpha: Column, a: Column, b: Column, days: int = DAYS) -> Column:
    """Expected purchase days in the next ``days`` of one who is still a buyer.

    Given the chance p to drop out after a purchase they are
    (1 - (1 + p days / (alpha + t)) ** -(r + x)) / p, and p has a beta distribution with
    a and b + x.  The integral over the logit of p uses the double exponential rule
    around the distribution's mode.  Unlike the hypergeometric series, which needs thousands of
    terms when alpha + t is small against ``days``, it takes the same nodes everywhere, and a = 1 is no exception.
    """
    at = [STEP * k for k in range(-round(REACH / STEP), round(REACH / STEP) + 1)]
    nodes = F.array(*[F.struct(F.lit(math.pi / 2 * math.sinh(s)).alias("u"), F.lit(STEP * math.pi / 2 * math.cosh(s)).alias("w")) for s in at])
    held = F.struct((b + x).alias("c"), F.log(a / (b + x)).alias("mode"), (F.lit(float(days)) / (alpha + t)).alias("share"), (r + x).alias("k"), (lgamma(a) + lgamma(b + x) - lgamma(a + b + x)).alias("beta"), a.alias("a"))

    def value(n: Column, h: Column) -> Column:
        u = n["u"] + h["mode"]
        stay, leave = -F.log1p(F.exp(u)), -F.log1p(F.exp(-u))
        return -n["w"] * F.expm1(-h["k"] * F.log1p(F.exp(leave) * h["share"])) * F.exp((h["a"] - 1) * leave + h["c"] * stay - h["beta"])

    # An array of one, so that what the nodes share is worked out once.
    return F.transform(F.array(held), lambda h: F.aggregate(nodes, F.lit(0.0), lambda total, n: total + value(n, h)))[0]


def bgnbd_orders(x: Column, tx: Column, t: Column, r: Column, alpha: Column, a: Column, b: Column, days: int = DAYS) -> Column:
    """Expected purchase days in the next ``days``: :func:`bgnbd_gain` times :func:`bgnbd_alive`."""
    return bgnbd_gain(x, t, r, alpha, a, b, days) * bgnbd_alive(x, tx, t, r, alpha, a, b)


def with_gain(rows: DataFrame) -> DataFrame:
    """Rows (fold, frequency, t, r, alpha, a, b, ...) with :func:`bgnbd_gain` as ``_gain``.

    Buyers share few pairs of frequency and time, which are days and counts: the integral is worked out once for each,
    so ``rows`` are read twice and should be written.
    """
    names = ["frequency", "t", "r", "alpha", "a", "b"]
    gains = rows.select("fold", *names).distinct().select("fold", "frequency", "t", bgnbd_gain(*map(F.col, names)).alias("_gain"))
    return rows.join(gains, ["fold", "frequency", "t"])


def gamma_gamma_value(x: Column, m: Column, p: Column, q: Column, v: Column) -> Column:
    """Expected mean spend of a purchase, given x of mean m."""
    return p * (v + x * m) / (p * x + q - 1)


def _gamma_gamma_count(x: Column, p: Column, q: Column, v: Column) -> Term:
    """What the number x of purchases alone adds to :func:`gamma_gamma_loglik`."""
    whole = p * x + q
    first = [x * (digamma(whole) - digamma(p * x) + F.log(x)), digamma(whole) - digamma(q) + F.log(v), q / v]
    second = {(0, 0): x * x * (trigamma(whole) - trigamma(p * x)), (0, 1): x * trigamma(whole), (1, 1): trigamma(whole) - trigamma(q), (1, 2): 1 / v, (2, 2): -q / v**2}
    return lgamma(whole) - lgamma(p * x) - lgamma(q) + q * F.log(v) + p * x * F.log(x), first, second


def _gamma_gamma_means(x: Column, m: Column, p: Column, q: Column, v: Column) -> Term:
    """What the mean m adds to :func:`gamma_gamma_loglik`."""
    whole, spent = p * x + q, x * m + v
    first = [x * (F.log(m) - F.log(spent)), -F.log(spent), -whole / spent]
    second = {(0, 2): -x / spent, (1, 2): -1 / spent, (2, 2): whole / spent**2}
    return (p * x - 1) * F.log(m) - whole * F.log(spent), first, second


def gamma_gamma_loglik(x: Column, m: Column, p: Column, q: Column, v: Column) -> Column:
    return _gamma_gamma_count(x, p, q, v)[0] + _gamma_gamma_means(x, m, p, q, v)[0]


def bgnbd_parts(x: Column, tx: Column, t: Column, r: Column, alpha: Column, a: Column, b: Column) -> tuple[list[Column], dict[tuple[int, int], Column]]:
    """First and second derivatives of :func:`bgnbd_loglik` by r, alpha, a and b."""
    return _total(_bgnbd_count(x, r, alpha, a, b), _bgnbd_times(x, tx, t, r, alpha, a, b))


def gamma_gamma_parts(x: Column, m: Column, p: Column, q: Column, v: Column) -> tuple[list[Column], dict[tuple[int, int], Column]]:
    """First and second derivatives of :func:`gamma_gamma_loglik` by p, q and v."""
    return _total(_gamma_gamma_count(x, p, q, v), _gamma_gamma_means(x, m, p, q, v))


def derivatives(rows: DataFrame, loglik: Column, first: list[Column], names: list[str]) -> DataFrame:
    """(fold, n, ll, d_ of each name): mean log likelihood of a histogram (fold, n, ...) and its mean derivatives."""
    total = F.sum("n")
    return rows.groupBy("fold").agg(total.alias("n"), (F.sum(F.col("n") * loglik) / total).alias("ll"), *[(F.sum(F.col("n") * c) / total).alias(f"d_{name}") for name, c in zip(names, first)])


def _newton(terms: list[tuple[DataFrame, Term]], start: dict[str, float], steps: int) -> DataFrame:
    """(fold, parameters, penalised_ll): each fold's greatest penalised mean log likelihood, whose terms are each over a written histogram (fold, n, ...) of the same buyers.

    Newton's method on the logarithms of the parameters, damped until a step gains.  One
    aggregate serves a step of all folds; what comes to the driver is one row per fold.
    A fold is done when its gradient vanishes or no step gains any more.
    """
    spark, names, d = terms[0][0].sparkSession, list(start), len(start)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [
        [F.sum("n").alias("n"), F.sum(F.col("n") * loglik).alias("ll")]
        + [F.sum(F.col("n") * c).alias(f"g{i}") for i, c in enumerate(first)]
        + [(F.sum(F.col("n") * second[i, j]) if (i, j) in second else F.lit(0.0)).alias(f"h{i}{j}") for i, j in upper]
        for _, (loglik, first, second) in terms
    ]

    def measured(points: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
        """Of each fold: score, and its gradient and Hessian by the logarithms."""
        grid = spark.createDataFrame([(f, *np.exp(z).tolist()) for f, z in points.items()], "fold string, " + ", ".join(f"{n} double" for n in names))
        parts: dict[str, list] = {}
        for row in reduce(DataFrame.unionByName, [rows.join(F.broadcast(grid), "fold").groupBy("fold").agg(*each) for (rows, _), each in zip(terms, sums)]).collect():
            parts.setdefault(row.fold, []).append(row)
        found = {}
        for fold, held in parts.items():
            n, at = held[0].n, np.exp(points[fold])
            # A sum is null where no buyer has a finite term: no number.
            total = {c: sum(np.nan if row[c] is None else row[c] for row in held) / n for c in held[0].asDict() if c not in ("fold", "n")}
            g = np.array([total[f"g{i}"] for i in range(d)])
            h = np.array([[total[f"h{min(i, j)}{max(i, j)}"] for j in range(d)] for i in range(d)])
            g, h = g - 2 * PENALTY * at, h - 2 * PENALTY * np.eye(d)
            found[fold] = (total["ll"] - PENALTY * float(at @ at), g * at, h * np.outer(at, at) + np.diag(g * at))
        return found

    folds = [r[0] for r in terms[0][0].select("fold").distinct().collect()]
    best = {f: np.log([start[n] for n in names]) for f in folds}
    state = measured(best) if folds else {}
    for f, (score, g, h) in state.items():
        if not (math.isfinite(score) and np.isfinite(g).all() and np.isfinite(h).all()):
            raise ValueError(f"no finite likelihood for {f}")
    damping, open_ = dict.fromkeys(folds, 0.0), set(folds)
    for _ in range(steps):
        tries = {}
        for f in sorted(open_):
            _, g, h = state[f]
            least = np.linalg.eigvalsh(-h)[0]
            # Positive definite, so that the step leads upwards, and no longer than a factor of e to the second.
            step = np.linalg.solve(-h + (max(0.0, 1e-6 - 2 * least) + damping[f]) * np.eye(d), g)
            tries[f] = best[f] + step * min(1.0, 2.0 / np.abs(step).max()) if np.abs(g).max() > 1e-9 else None
        open_ -= {f for f, z in tries.items() if z is None}
        if not open_:
            break
        for f, (score, g, h) in measured({f: tries[f] for f in open_}).items():
            if math.isfinite(score) and score > state[f][0]:
                best[f], state[f], damping[f] = tries[f], (score, g, h), damping[f] / 10 if damping[f] > 1e-6 else 0.0
            elif np.abs(tries[f] - best[f]).max() < 1e-7:
                open_.discard(f)
            else:
                damping[f] = max(damping[f] * 10, 1e-3)
    if open_:
        raise ValueError(f"no maximum after {steps} steps for {sorted(open_)}")
    return spark.createDataFrame([(f, *np.exp(best[f]).tolist(), float(state[f][0])) for f in folds], "fold string, " + ", ".join(f"{n} double" for n in names) + ", penalised_ll double")


def _spread(rows: DataFrame) -> DataFrame:
    """A histogram in as many parts as the session shuffles to: its few bytes would be one task's, but each row takes a likelihood in every step."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _counts(rows: DataFrame) -> DataFrame:
    """The histogram of the numbers of purchases alone: as many rows as there are such numbers, which are at most the days of the history."""
    return written(rows.groupBy("fold", "frequency").agg(F.sum("n").alias("n")), "counts")


def fit_bgnbd(summaries: DataFrame, steps: int = 60) -> DataFrame:
    """(fold, r, alpha, a, b, penalised_ll) from (fold, frequency, recency, t). The greatest of the penalised mean log likelihood; a fold without one raises."""
    rows = written(_spread(summaries.groupBy("fold", *[F.col(c).cast("double").alias(c) for c in ("frequency", "recency", "t")]).agg(F.count("*").alias("n"))), "summaries")
    x, tx, t, *given = (F.col(c) for c in ("frequency", "recency", "t", "r", "alpha", "a", "b"))
    return _newton([(_counts(rows), _bgnbd_count(x, *given)), (rows, _bgnbd_times(x, tx, t, *given))], {"r": 0.5, "alpha": 10.0, "a": 0.8, "b": 2.0}, steps)


def fit_gamma_gamma(summaries: DataFrame, steps: int = 60) -> DataFrame:
    """(fold, p, q, v, penalised_ll) from repeat buyers with positive mean value, for folds with enough of them."""
    repeat = summaries.where("frequency > 0 and monetary_value > 0")
    counted = written(_spread(repeat.groupBy("fold", F.col("frequency").cast("double").alias("frequency"), F.round("monetary_value", 2).alias("m")).agg(F.count("*").alias("n"))), "values")
    enough = counted.groupBy("fold").agg(F.sum("n").alias("k")).where(F.col("k") >= LEAST_REPEAT)
    rows = counted.join(F.broadcast(enough.select("fold")), "fold", "left_semi")
    x, m, *given = (F.col(c) for c in ("frequency", "m", "p", "q", "v"))
    return _newton([(_counts(rows), _gamma_gamma_count(x, *given)), (rows, _gamma_gamma_means(x, m, *given))], {"p": 2.0, "q": 3.0, "v": 10.0}, steps)


def _scores(rows: DataFrame, value: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with summaries, the parameters and ``_gain``, laid beside their value model, and the seven BTYD features of them."""
    args = {c: F.col(c) for c in ("frequency", "recency", "t", "r", "alpha", "a", "b")}
    rows = rows.join(F.broadcast(value.select("fold", "p", "q", "v")), "fold", "left")
    rows = rows.withColumn("_alive", bgnbd_alive(*args.values())).withColumn("_orders", F.col("_alive") * F.col("_gain"))
    fitted = gamma_gamma_value(*(F.col(c) for c in ("frequency", "monetary_value", "p", "q", "v")))
    spend = F.col("_orders") * F.when(F.col("p").isNotNull(), fitted).otherwise(F.col("monetary_value"))
    return rows, _features(F.col("_alive"), F.col("_orders"), spend, F.col("monetary_value"), F.col("total_gmv"))


def scored(summaries: DataFrame, bgnbd: DataFrame, value: DataFrame) -> DataFrame:
    """The seven BTYD features of each buyer from fitted parameters; a fold without a value model uses each buyer's own mean."""
    rows, made = _scores(with_gain(summaries.join(F.broadcast(bgnbd), "fold")), value)
    return rows.select("fold", USER, *[c.alias(n) for n, c in made.items()])


def with_fitted(sums: DataFrame) -> DataFrame:
    """Written sums of every (fold, user) with the seven BTYD features of the models fitted on each fold; null for users who never bought. A failed fit raises.

    Sums are hundreds of bytes wide, so they are not shuffled: they meet the parameters of their fold, and the integrals,
    one for each pair of frequency and time, whose written table is small enough to be sent to them.
    """
    buyers = rfm(sums)
    bgnbd, value = fit_bgnbd(buyers), fit_gamma_gamma(buyers)
    names = ["frequency", "t", "r", "alpha", "a", "b"]
    pairs = _spread(buyers.select("fold", "frequency", "t").distinct()).join(F.broadcast(bgnbd), "fold")
    gains = written(pairs.select("fold", F.col("frequency").alias("_f"), F.col("t").alias("_t"), bgnbd_gain(*map(F.col, names)).alias("_gain")), "gains")
    rows = sums.withColumns({n: F.when(F.col("buy_days") > 0, c) for n, c in summary_columns().items()}).join(F.broadcast(bgnbd), "fold", "left")
    rows = rows.join(gains.withColumnRenamed("fold", "_fold"), (F.col("fold") == F.col("_fold")) & (F.col("frequency") == F.col("_f")) & (F.col("t") == F.col("_t")), "left")
    rows, made = _scores(rows, value)
    return rows.select(*sums.columns, *[F.when(F.col("buy_days") > 0, c).alias(n) for n, c in made.items()])


def with_mode(values: DataFrame, summaries: DataFrame, mode: str) -> DataFrame:
    """Base features with their BTYD columns by the heuristic or the fitted models, and the mode in ``btyd_mode``. A failed fit raises."""
    if mode not in ("heuristic", "bgnbd"):
        raise ValueError(f"unknown btyd mode {mode!r}")
    if mode == "bgnbd":
        # A fold without a fit raises before its buyers could lose their features.
        summaries = written(summaries, "buyers")
        fresh = scored(summaries, fit_bgnbd(summaries), fit_gamma_gamma(summaries))
        values = values.drop(*[c for c in fresh.columns if c.startswith("btyd_")]).join(fresh, ["fold", USER], "left")
    return values.withColumn("btyd_mode", F.lit(mode))
