"""The registered queries, each over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..config import DAY, EVENTS, MONEY, ORDERS, USER
from ..functions.numeric import filled, log1p0, rounded
from ..operators import btyd, evaluate, features, folds, learn, quality
from ..sources import activity as source
from ..sources import tables
from ..sources.scratch import fresh, written

#: Parameters with which fitted formulas are compared with SQL.
BGNBD = {"r": 0.5, "alpha": 20.0, "a": 0.8, "b": 2.5}
GAMMA = {"p": 2.5, "q": 3.5, "v": 1000.0}
#: Fixed value: parameters of buyers who come often, for whom the plain series would need thousands of terms.
FREQUENT = {"r": 0.3, "alpha": 0.2, "a": 1.5, "b": 5.0}


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return source.from_orders(spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return source.from_events(spark.read.parquet(f"{sf}/events.parquet"))


def _folds(spark: SparkSession) -> DataFrame:
    return folds.calendar(spark, ORDERS)


def _plain(rows: DataFrame) -> DataFrame:
    """Money as doubles, to compare."""
    return rows.withColumns({c: F.col(c).cast("double") for c in MONEY})


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return folds.sized(_folds(spark), _orders(spark, sf))


def _pairs(scheme: Callable[..., DataFrame], **more: int) -> Callable[[SparkSession, str], DataFrame]:
    """Pairs of folds with their numbers of rows."""
    return lambda spark, sf: folds.with_users(scheme(_folds(spark), **more), _sized(spark, sf))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return folds.overlap_check(_folds(spark)).join(F.broadcast(_sized(spark, sf).select("fold", "n_users")), "fold")


def _sums(spark: SparkSession, sf: str) -> DataFrame:
    return features.aggregates(_orders(spark, sf), _folds(spark), ORDERS)


def _block(columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        table = features.complete(features.base(_sums(spark, sf)), columns)
        return table.selectExpr("fold", USER, *[f"{rounded(c, 4)} AS {c}" for c in columns])

    return run


def _with_target(spark: SparkSession, sf: str, columns: tuple[str, ...] = S.FEATURES) -> DataFrame:
    """Features with targets."""
    return features.build(_orders(spark, sf), _folds(spark), ORDERS, columns=columns, target=True)


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    """Activity written as CSV and read again with its types."""
    path = fresh(spark, "activity")
    tables.write_csv(_orders(spark, sf), path)
    return _plain(source.read(spark, path, "csv"))


def _folds_again(spark: SparkSession, sf: str) -> DataFrame:
    """Features with targets, written by fold, one fold of them a second time, and read again: all folds and, from its folder alone, the last of them."""
    path = fresh(spark, "folds")
    table = _with_target(spark, sf, ("gmv_sum_30d", "gmv_sum_365d"))
    tables.write_folds(table, path)
    last = f"fold_{ORDERS.kept_folds - 1}"
    tables.write_folds(written(tables.read_fold(spark, path, last), "fold"), path)
    return tables.read_folds(spark, path).where(F.col("fold") != last).unionByName(tables.read_fold(spark, path, last))


def _targets(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    found = folds.targets(rows, calendar, folds.universe(rows, calendar))
    return found.withColumn("target_log", F.round("target_log", 6))


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    return btyd.rfm(_sums(spark, sf))


def _parameters(names: tuple[str, ...], given: dict[str, float] = BGNBD | GAMMA) -> list[Column]:
    return [F.lit(given[n]) for n in names]


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three simple forecasts of each fold and user: last 30 days, a third of 90 days, the BTYD heuristic."""
    table = features.base(features.aggregates(_orders(spark, sf), _folds(spark), ORDERS, target=True))
    made = {"last30": F.expr(filled("gmv_sum_30d")), "btyd": F.expr(filled("btyd_exp_gmv_30d")), "last90": F.expr(filled("gmv_sum_90d")) / 3}
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.alias("pred")) for n, c in made.items()]))
    return table.select("fold", USER, "target", parts.alias("m")).select("m.model", "fold", USER, "target", "m.pred")


def _compared(table: DataFrame) -> DataFrame:
    """Two features with targets, to compare."""
    return _rounded(table.select("fold", USER, "gmv_sum_30d", "gmv_sum_365d", "target", "target_log"), gmv_sum_30d=4, gmv_sum_365d=4, target_log=6)


def _rounded(table: DataFrame, **places: int) -> DataFrame:
    return table.withColumns({c: F.round(c, n) for c, n in places.items()})


def _standardize(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred features in deviations of the folds that the last model trains on."""
    table = features.build(_orders(spark, sf), _folds(spark), ORDERS, columns=STANDARD).where("fold != 'test'").drop("cutoff_date")
    table = written(table, "table")
    made = learn.scaler(table.where(F.col("fold_idx") < ORDERS.kept_folds - 1), list(STANDARD)).transform(table)
    return made.selectExpr("fold", USER, *[f"round({c}, 5) AS {c}" for c in STANDARD])


def _top(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred features that go best with the logarithm of the target in the folds before each fold, on average."""
    rows = evaluate.mean_importance(features.relevance(_with_target(spark, sf), list(S.FEATURES), ORDERS.kept_folds - 1))
    return evaluate.top_features(_rounded(rows, importance=4), MOST_IMPORTANT, list(S.FEATURES))


#: Features that are standardised for SQL to compare.
STANDARD = S.FEATURES[:100]
#: Features that the registered learners read, and how many of the most important ones the factorization machines do; trials of the search.
LEARNED, MOST_IMPORTANT, TRIALS = list(S.FEATURES), 100, 40
#: Settings of the registered learners. Boosting has a ceiling of rounds that its patience ends long before; a faster rate than the
#: library's search uses needs fewer rounds, each of which is a Spark job for each level of its tree.
TREES = learn.Trees(rounds=5000, rate=0.3, depth=5, patience=5)
FOREST = learn.Trees()
#: Rounds and patience of the search's trials.
SEARCH_ROUNDS, SEARCH_PATIENCE = 40, 5
#: Stages of the search: shares of a trial's rounds.
STAGES = (0.1, 0.3, 1.0)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return learn.assembled(_with_target(spark, sf, tuple(LEARNED)), LEARNED)


def _gbt(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return learn.out_of_fold(vectors, learn.fit_folds(vectors, TREES), "gbt")


def _forest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return learn.out_of_fold(vectors, learn.fit_folds(vectors, FOREST, "forest", "leave_one_out"), "forest")


def _importance(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return evaluate.top_features(evaluate.mean_importance(learn.importances(learn.fit_folds(vectors, TREES), LEARNED, spark)), 30)


def _factors(spark: SparkSession, sf: str) -> DataFrame:
    """The machines' forecasts of the last fold, from features ranked in the folds before it."""
    table, valid = written(_with_target(spark, sf), "table"), ORDERS.kept_folds - 1
    best = learn.ranked(learn.assembled(table, LEARNED), LEARNED, TREES, valid, MOST_IMPORTANT)
    return evaluate.seed_average(learn.seed_scores(table, learn.factor_seeds(table, best, valid), valid))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return evaluate.submission(evaluate.fold_average(learn.predict(vectors, learn.fit_folds(vectors, TREES), "gbt")))


def _search(spark: SparkSession, sf: str) -> DataFrame:
    return learn.search(_vectors(spark, sf), learn.candidates(TRIALS, rounds=SEARCH_ROUNDS, patience=SEARCH_PATIENCE), last=2, stages=STAGES)


def _end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run: both tree learners on all features and the machines on the most important ones, their fold and seed averages, and the blend of the test fold."""
    table, test = written(_with_target(spark, sf), "table"), ORDERS.kept_folds
    vectors = learn.assembled(table, LEARNED)
    models = learn.fit_folds(vectors, TREES)
    forest = learn.fit_folds(vectors, FOREST, "forest", "leave_one_out")
    # All folds but the test fold have trained or stopped these models.
    best = [r["feature"] for r in evaluate.top_features(evaluate.mean_importance(learn.importances(models, LEARNED, spark)), MOST_IMPORTANT).collect()]
    factors = learn.seed_scores(table, learn.factor_seeds(table, best, test), test)
    parts = {"gbt": evaluate.fold_average(learn.predict(vectors, models, "gbt")), "forest": evaluate.fold_average(learn.predict(vectors, forest, "forest")), "fm": evaluate.seed_average(factors)}
    return evaluate.submission(evaluate.blend(features.union_all([p.withColumn("model", F.lit(n)) for n, p in parts.items()]), evaluate.WEIGHTS))


def _loglik(spark: SparkSession, sf: str) -> DataFrame:
    like = btyd.bgnbd_loglik(F.col("frequency"), F.col("recency"), F.col("t"), *_parameters(("r", "alpha", "a", "b")))
    return _summaries(spark, sf).select("fold", USER, F.round(like, 6).alias("loglik"))


def _bgnbd_scores(given: dict[str, float]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = written(_summaries(spark, sf).withColumns({n: F.lit(v) for n, v in given.items()}), "summaries")
        alive = btyd.bgnbd_alive(*[F.col(c) for c in ("frequency", "recency", "t", "r", "alpha", "a", "b")])
        return btyd.with_gain(rows).select("fold", USER, F.round(alive, 6).alias("p_alive"), F.round(alive * F.col("_gain"), 6).alias("exp_orders"))

    return run


def _bgnbd_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    """Each fold's likelihood at fixed parameters, and its derivatives by them, as a step of the fit sums them."""
    rows = _summaries(spark, sf).groupBy("fold", "frequency", "recency", "t").agg(F.count("*").alias("n"))
    args = [*[F.col(c).cast("double") for c in ("frequency", "recency", "t")], *_parameters(("r", "alpha", "a", "b"))]
    found = btyd.derivatives(rows, btyd.bgnbd_loglik(*args), btyd.bgnbd_parts(*args)[0], ["r", "alpha", "a", "b"])
    return _rounded(found, ll=6, d_r=6, d_alpha=6, d_a=6, d_b=6)


def _gamma_value(spark: SparkSession, sf: str) -> DataFrame:
    value = btyd.gamma_gamma_value(F.col("frequency"), F.col("monetary_value"), *_parameters(("p", "q", "v")))
    return _summaries(spark, sf).select("fold", USER, F.round(value, 4).alias("expected_value"))


def _gamma_loglik(spark: SparkSession, sf: str) -> DataFrame:
    like = btyd.gamma_gamma_loglik(F.col("frequency"), F.col("monetary_value"), *_parameters(("p", "q", "v")))
    return _summaries(spark, sf).where("frequency > 0 and monetary_value > 0").select("fold", USER, F.round(like, 6).alias("loglik"))


def _btyd_scored(given: dict[str, float]) -> Callable[[SparkSession, str], DataFrame]:
    """The seven BTYD features from fixed parameters; the first fold has no value model."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        calendar = _folds(spark).select("fold")
        counts, value = (calendar.select("fold", *[F.lit(v).alias(n) for n, v in held.items()]) for held in (given, GAMMA))
        table = btyd.scored(_summaries(spark, sf), counts, value.where("fold != 'fold_0'"))
        return _rounded(table, btyd_p_alive=6, btyd_exp_orders_30d=6, btyd_exp_gmv_30d=2, btyd_log_exp_orders=6, btyd_log_exp_gmv=6, btyd_order_value=4, btyd_total_gmv=2)

    return run


def _fitted(spark: SparkSession, sf: str) -> DataFrame:
    """All features, their BTYD columns from the models fitted on each fold."""
    sums = written(_sums(spark, sf), "sums")
    return features.complete(features.base(btyd.with_fitted(sums))).withColumn("btyd_mode", F.lit("bgnbd"))


def _rfm(spark: SparkSession, sf: str) -> DataFrame:
    table = _summaries(spark, sf)
    return _rounded(table.withColumns({c: F.col(c).cast("long") for c in ("frequency", "recency", "t")}), monetary_value=4, total_gmv=2)


def _raw_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicates(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias(USER), F.to_date("o_orderdate").alias(DAY)))


def _oof(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).where("fold != 'test'")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "activity_daily": lambda s, d: _plain(_orders(s, d)),
    "activity_csv": _csv,
    "activity_events": lambda s, d: _plain(_events(s, d)),
    "fold_calendar": _sized,
    "walk_forward_pairs": _pairs(folds.walk_forward),
    "walk_forward_last_two": _pairs(folds.walk_forward, last=2),
    "leave_one_out_pairs": _pairs(folds.leave_one_out),
    "dq_volume": lambda s, d: quality.volume(_orders(s, d)),
    "dq_nulls": lambda s, d: quality.nulls(_orders(s, d)),
    "dq_duplicates": _raw_duplicates,
    "fold_overlap_check": _overlaps,
    "user_universe": lambda s, d: folds.universe(_orders(s, d), _folds(s)),
    "target_window": lambda s, d: _targets(_orders(s, d), _folds(s)),
    "target_window_events": lambda s, d: _targets(_events(s, d), folds.calendar(s, EVENTS)),
    "fold_report": lambda s, d: quality.fold_report(_targets(_orders(s, d), _folds(s))),
    "lifetime": _block(S.LIFETIME),
    "purchase_history": _block(S.PURCHASE[:5]),
    "purchase_gaps": _block(S.PURCHASE[5:]),
    "lookback_sums": _block(tuple(c for c in S.LOOKBACK if "_sum_" in c)),
    "lookback_days": _block(tuple(c for c in S.LOOKBACK if "_sum_" not in c)),
    "ema_gmv": _block(S.DECAYED),
    "btyd_heuristic": _block(S.BTYD),
    "funnel_ratios": _block(S.RATIOS),
    "cross_window": _block(S.CROSS),
    "recent_vs_old": _block(S.RECENT),
    "log_features": _block(S.LOGS),
    "features_full": _block(S.FEATURES),
    "features_with_target": lambda s, d: _compared(_with_target(s, d, ("gmv_sum_30d", "gmv_sum_365d"))),
    "folds_round_trip": lambda s, d: _compared(_folds_again(s, d)),
    "rfm": _rfm,
    "bgnbd_loglik": _loglik,
    "bgnbd_scores": _bgnbd_scores(BGNBD),
    "bgnbd_scores_frequent": _bgnbd_scores(FREQUENT),
    "bgnbd_derivatives": _bgnbd_derivatives,
    "gamma_gamma_value": _gamma_value,
    "gamma_gamma_loglik": _gamma_loglik,
    "btyd_scored": _btyd_scored(BGNBD),
    "btyd_scored_frequent": _btyd_scored(FREQUENT),
    "standardize": _standardize,
    "top_k_features": _top,
    "rmsle_by_fold": lambda s, d: _rounded(evaluate.rmsle(_oof(s, d)), rmsle=6),
    "oof_table": lambda s, d: _rounded(_oof(s, d), target=2, pred=4),
    "fold_average": lambda s, d: _rounded(evaluate.fold_average(_predictions(s, d).where("model = 'btyd'")), predict=4),
    "seed_average": lambda s, d: _rounded(evaluate.seed_average(_predictions(s, d).where("fold = 'test'").withColumn("pred_log", log1p0(F.col("pred")))), predict=4),
    "blend": lambda s, d: _rounded(evaluate.blend(_predictions(s, d).where("fold = 'test'").withColumnRenamed("pred", "predict").drop("target"), {"last30": 0.50, "btyd": 0.35, "last90": 0.15}), predict=4),
    "gbt_walk_forward": _gbt,
    "rf_leave_one_out": _forest,
    "fm_seeds": _factors,
    "feature_importance": _importance,
    "gbt_test_scores": _scored,
    "random_search": _search,
    "end_to_end_blend": _end_to_end,
    "bgnbd_fit": lambda s, d: btyd.fit_bgnbd(_summaries(s, d)),
    "gamma_gamma_fit": lambda s, d: btyd.fit_gamma_gamma(_summaries(s, d)),
    "features_fitted_btyd": _fitted,
    "sample_per_fold": lambda s, d: features.sample_rows(features.sample_fraction(folds.universe(_orders(s, d), _folds(s)), 0.3), 100),
}
