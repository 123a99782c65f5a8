"""The hand-computed cases, properties of the features, and the models' formulas."""

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold import schema as S
from tallyfold.config import Calendar, as_date
from tallyfold.operators import btyd, evaluate, features, folds, quality

from .conftest import DATA

CAL = Calendar(date(2025, 1, 1), date(2025, 6, 30), n_folds=0)
ROWS = [(1, "2025-06-01", 100, 1, 1, 2), (1, "2025-06-11", 200, 2, 4, 4), (1, "2025-06-29", 50, 1, 1, 0), (1, "2025-07-05", 70, 1, 1, 1), (2, "2025-05-01", 90, 1, 1, 1), (3, "2025-06-20", 0, 0, 0, 5), (4, "2025-07-03", 500, 1, 1, 1), (5, "2025-06-10", 10, 0, 0, 0), (5, "2025-06-10", 30, 0, 0, 0)]


def activity(spark, rows=ROWS):
    rows = [(u, d, float(g), *rest) for u, d, g, *rest in rows]
    table = spark.createDataFrame(rows, "user_id long, day string, gmv double, to_ord long, to_cart long, searches long")
    given = {"event_date": F.to_date("day"), "gmv": F.col("gmv").cast("decimal(18,2)")}
    missing = {f.name: F.lit(0).cast(f.dataType) for f in S.ACTIVITY if f.name not in ("user_id", "event_date", "gmv", "to_ord", "to_cart", "searches")}
    return table.withColumns(given | missing).select(*S.ACTIVITY.fieldNames())


def built(spark, rows=ROWS, cal=CAL):
    return {r.user_id: r for r in features.build(activity(spark, rows), folds.calendar(spark, cal), cal).collect()}


def test_schema():
    assert len(S.FEATURES) == 346 == len(set(S.FEATURES)) and len(S.BASE) == 175
    assert "log1p_btyd_exp_gmv_30d" in S.FEATURES and "log1p_log_tenure_days" not in S.FEATURES


def test_micro_fixture(spark):
    found = built(spark)
    assert set(found) == {1, 2, 3, 5}
    one = found[1]
    expected = dict(recency_days=1, tenure_days=30, n_active_days_total=3, mean_purchase_gap=14, std_purchase_gap=5.656854, min_purchase_gap=10, max_purchase_gap=18, purchase_frequency=3, gmv_sum_7d=50, gmv_sum_30d=350, avg_order_value_30d=87.5, cart_to_order_rate_30d=0.666667, ema_gmv_7d=45.286183, ema_gmv_30d=228.963724, btyd_p_alive=0.980199, btyd_exp_orders_30d=1.495218, btyd_exp_gmv_30d=174.442137)
    for name, value in expected.items():
        assert one[name] == pytest.approx(value, abs=1e-6), name
    two = found[2]
    assert (two.gmv_sum_30d, two.gmv_sum_90d, two.gmv_old_60d, two.gmv_recent_share) == (0, 90, 0, 0)
    three = found[3]
    assert all(three[c] == 0 for c in S.PURCHASE + S.BTYD) and (three.recency_days, three.n_active_days_30d, three.search_to_cart_rate_30d) == (10, 1, 0)
    five = found[5]
    assert (five.n_purchase_days, five.mean_purchase_gap, five.min_purchase_gap, five.max_purchase_gap, five.std_purchase_gap) == (1, 0, 0, 0, 0)
    assert five.btyd_order_value == 20 and five.avg_order_value_30d == 40_000_000
    assert quality.duplicates(activity(spark)).first()[0] == 1


def test_targets(spark):
    calendar = folds.calendar(spark, CAL)
    found = {r.user_id: r for r in folds.targets(activity(spark), calendar, folds.universe(activity(spark), calendar)).collect()}
    assert set(found) == {1, 2, 3, 5} and found[1].target == 70 and found[1].target_log == pytest.approx(4.262680, abs=1e-6) and found[2].target == 0
    some = folds.universe(activity(spark), calendar, spark.createDataFrame([(1,), (4,), (1,)], "user_id long"))
    assert [r.user_id for r in some.collect()] == [1]


def test_future_rows_and_order_change_nothing(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(8), f"2025-0{rng.randrange(1, 8)}-{rng.randrange(1, 29):02d}", rng.choice([0, 0, 12.5, 80]), rng.randrange(3), rng.randrange(4), rng.randrange(5)) for _ in range(200)]
    cal = Calendar(date(2025, 1, 1), date(2025, 6, 30), n_folds=3)
    whole = features.build(activity(spark, rows), folds.calendar(spark, cal), cal)
    key = {(r.fold, r.user_id): r for r in whole.collect()}
    past = [r for r in rows if r[1] <= "2025-06-30"]
    rng.shuffle(past)
    again = {(r.fold, r.user_id): r for r in features.build(activity(spark, past).repartition(7), folds.calendar(spark, cal), cal).collect()}
    assert set(key) == set(again)
    for k, r in key.items():
        for c in S.FEATURES:
            assert r[c] == pytest.approx(again[k][c], rel=1e-9, abs=1e-12), (k, c)
        sums = [r[f"to_ord_sum_{n}d"] for n in (7, 14, 30, 60, 90, 180, 365)]
        assert sums == sorted(sums)
    alone = folds.calendar(spark, cal).where("fold = 'fold_1'")
    for r in features.build(activity(spark, rows), alone, cal).collect():
        assert all(r[c] == pytest.approx(key["fold_1", r.user_id][c], rel=1e-9, abs=1e-12) for c in S.FEATURES)


def test_calendar_rules(spark):
    default = Calendar()
    found = [str(r.cutoff) for r in folds.calendar(spark, default).orderBy("fold_idx").collect()]
    assert found == ["2025-08-17", "2025-09-16", "2025-10-16", "2025-11-15", "2025-12-15", "2026-01-14", "2026-02-13"]
    with pytest.raises(ValueError):
        _ = Calendar(step_days=10).step
    assert Calendar(hist_start=date(2025, 12, 1)).kept_folds == 2
    assert as_date("2025-02-03") == date(2025, 2, 3)
    assert folds.validated(folds.calendar(spark, default), default).count() == 7
    bad = folds.calendar(spark, default).withColumn("target_end", F.date_add("target_end", 40))
    with pytest.raises(ValueError):
        folds.validated(bad, default)


def test_features_and_targets_leave_one_pass(spark):
    """One scan of each raw table, and the targets that a join gives."""
    from tallyfold.plans import queries

    found = queries._with_target(spark, DATA, ("gmv_sum_30d", "searches_sum_365d"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    rows = queries._orders(spark, DATA)
    apart = folds.targets(rows, queries._folds(spark), folds.universe(rows, queries._folds(spark)))
    wanted = sorted((r.fold, r.user_id, r.target, r.target_log) for r in apart.collect())
    assert sorted((r.fold, r.user_id, r.target, r.target_log) for r in found.collect()) == wanted and any(t for _, _, t, _ in wanted)


def test_likelihood_and_alive(spark):
    r, al, a, b = 0.7, 9.0, 0.8, 2.2
    cases = [(0, 0, 30), (1, 10, 40), (4, 80, 81), (12, 100, 300)]
    rows = spark.createDataFrame(cases, "x int, tx int, t int")
    args = [F.col("x"), F.col("tx"), F.col("t"), *map(F.lit, (r, al, a, b))]
    for row, (x, tx, t) in zip(rows.select(btyd.bgnbd_loglik(*args).alias("ll"), btyd.bgnbd_alive(*args).alias("p"), btyd.bgnbd_orders(*args).alias("n")).collect(), cases):
        first = math.lgamma(r + x) - math.lgamma(r) + r * math.log(al) + math.lgamma(a + b) + math.lgamma(b + x) - math.lgamma(b) - math.lgamma(a + b + x)
        second = (al + t) ** -(r + x) + (a / (b + x - 1) * (al + tx) ** -(r + x) if x else 0)
        assert row.ll == pytest.approx(first + math.log(second), abs=1e-9)
        assert row.p == pytest.approx(1 / (1 + (a / (b + x - 1) * ((al + t) / (al + tx)) ** (r + x) if x else 0)))
        assert row.n > 0
    log = spark.range(1).select(*[F.round(btyd.lgamma(F.lit(v)), 8) for v in (0.3, 1.0, 7.7, 120.5)]).first()
    assert list(log) == pytest.approx([math.lgamma(v) for v in (0.3, 1.0, 7.7, 120.5)], abs=1e-7)


def test_fit_recovers_parameters(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        rate, drop = rng.gammavariate(0.9, 1 / 12), rng.betavariate(0.9, 2.5)
        t, at, x, last = 200, 0.0, 0, 0
        while True:
            at += rng.expovariate(rate)
            if at > t:
                break
            x, last = x + 1, int(at)
            if rng.random() < drop:
                break
        rows.append(("f", x, last, t))
    frame = spark.createDataFrame(rows, "fold string, frequency int, recency int, t int")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    best = btyd.fit_bgnbd(frame.mapInArrow(counted, frame.schema)).first()
    assert read.value == len(rows)
    args = [F.col("frequency").cast("double"), F.col("recency").cast("double"), F.col("t").cast("double")]

    def score(r, alpha, a, b):
        return frame.agg(F.avg(btyd.bgnbd_loglik(*args, *map(F.lit, (r, alpha, a, b))))).first()[0] - 0.01 * (r**2 + alpha**2 + a**2 + b**2)

    found = (best.r, best.alpha, best.a, best.b)
    assert best.penalised_ll == pytest.approx(score(*found), abs=1e-9) and best.penalised_ll >= score(0.9, 12.0, 0.9, 2.5)
    # The greatest value: it falls by any small step, and as the derivatives say.
    for i in range(4):
        for factor in (0.99, 1.01):
            near = [v * factor if i == k else v for k, v in enumerate(found)]
            assert score(*near) < best.penalised_ll
    first, _ = btyd.bgnbd_parts(*args, *map(F.lit, found))
    slopes = frame.agg(*[F.avg(c) for c in first]).first()
    assert list(slopes) == pytest.approx([0.02 * v for v in found], abs=1e-6)


def test_gamma_functions_are_worked_out_once_for_each_number_of_purchases(spark, monkeypatch):
    """Of what a step of a fit sums over every pair of times, or every mean, nothing goes by the number of purchases alone."""
    seen, newton = [], btyd._newton
    monkeypatch.setattr(btyd, "_newton", lambda terms, *more: seen.append(terms) or newton(terms, *more))
    rng = random.Random(3)
    rows = [("f", x, min(t, 10 * x + rng.randrange(40)) if x else 0, t, 5.0 + rng.randrange(4000) / 100) for x, t in ((rng.choice([0, 0, 0, 1, 1, 2, 3, 5]), rng.randrange(60, 400)) for _ in range(3000))]
    frame = spark.createDataFrame(rows, "fold string, frequency int, recency int, t int, monetary_value double")
    assert btyd.fit_bgnbd(frame).count() == btyd.fit_gamma_gamma(frame).count() == 1
    for (counts, _), (wide, (loglik, first, second)) in seen:
        assert counts.count() <= 6 < 400 < wide.count()
        assert counts.agg(F.sum("n")).first()[0] == wide.agg(F.sum("n")).first()[0]
        # The gamma functions' series divide by 12, and products over the purchases are aggregates of arrays.
        assert not any(mark in str(c) for c in (loglik, *first, *second.values()) for mark in ("12", "aggregate"))


def test_derivatives_are_those_of_the_likelihoods(spark):
    cases = spark.createDataFrame([(0.0, 0.0, 30.0, 5.0), (1.0, 10.0, 40.0, 0.5), (4.0, 80.0, 81.0, 20.0), (60.0, 100.0, 300.0, 90.0)], "x double, tx double, t double, m double")
    for like, parts, given, columns in ((btyd.bgnbd_loglik, btyd.bgnbd_parts, [0.7, 9.0, 0.8, 2.2], ("x", "tx", "t")), (btyd.gamma_gamma_loglik, btyd.gamma_gamma_parts, [2.0, 3.0, 4.0], ("x", "m"))):
        rows = cases if len(columns) == 3 else cases.where("x > 0")
        args = [F.col(c) for c in columns]
        first, second = parts(*args, *map(F.lit, given))

        def at(column):
            return [r[0] for r in rows.select(column).collect()]

        def moved(i, h):
            return [F.lit(v + (h if i == k else 0.0)) for k, v in enumerate(given)]

        for i in range(len(given)):
            slope = [(a - b) / 2e-4 for a, b in zip(at(like(*args, *moved(i, 1e-4))), at(like(*args, *moved(i, -1e-4))))]
            assert at(first[i]) == pytest.approx(slope, abs=1e-6, rel=1e-5)
            for j in range(i, len(given)):
                bend = [(a - b) / 2e-4 for a, b in zip(at(parts(*args, *moved(j, 1e-4))[0][i]), at(parts(*args, *moved(j, -1e-4))[0][i]))]
                assert at(second[i, j]) == pytest.approx(bend, abs=1e-6, rel=1e-5)


def test_expected_purchases_against_twenty_thousand_terms(spark):
    """Over alpha 0.1 to 100, a 0.1 to 5 and time from 0; the last of them is a fold of its own in the reviews."""
    rng, cases = random.Random(5), []
    while len(cases) < 120:
        al, a, b, r = 10 ** rng.uniform(-1, 2), 10 ** rng.uniform(-1, 0.7), 10 ** rng.uniform(-1, 1.3), 10 ** rng.uniform(-1, 0.6)
        x, t = rng.choice([0, 0, 1, 3, 30, 200]), float(rng.choice([0, 1, 5, 60, 400]))
        if abs(a - 1) > 0.02 and abs(a + b + x - 1) > 0.02:
            cases.append((float(x), t, r, al, a, b))
    cases += [(0.0, 0.0, 0.2, 0.2, 2.5, 6.0), (0.0, 0.0, 0.3, 0.5, 1.5, 5.0), (2.0, 40.0, 0.7, 9.0, 1.0, 2.0)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, x double, t double, r double, alpha double, a double, b double")
    found = dict(rows.select("k", btyd.bgnbd_gain(*[F.col(c) for c in ("x", "t", "r", "alpha", "a", "b")])).collect())
    for k, (x, t, r, al, a, b) in enumerate(cases):
        a = a + 1e-7 if a == 1 else a
        z, p, q, c = 30 / (al + t + 30), a + b - 1 - r, a - 1, a + b + x - 1
        term, total = 1.0, []
        for i in range(20_000):
            total.append(term)
            term *= (p + i) * (q + i) / ((c + i) * (i + 1)) * z
        wanted = c / q * (1 - math.exp(q * math.log(1 - z)) * math.fsum(total))
        assert found[k] == pytest.approx(wanted, rel=1e-6, abs=1e-9), cases[k]
    assert found[120] == pytest.approx(2.312, abs=1e-3) and found[121] == pytest.approx(3.435, abs=1e-3)


def test_value_fit_mode_and_scores(spark):
    """The value model's fit is no worse than the truth; the mode's features are the fitted ones; a fold without a value model uses the buyer's mean."""
    rng = random.Random(4)
    rows = []
    for user in range(600):
        # Penalties weigh on large parameters, so the truth is small.
        scale, x = rng.gammavariate(3.0, 1 / 4.0), rng.randrange(0, 6)
        mean = rng.gammavariate(2.0 * max(x, 1), 1 / scale) / max(x, 1)
        rows.append(("f" if user < 590 else "few", user, x, rng.randrange(0, 60) if x else 0, 90, mean, mean * (x + 1)))
    frame = spark.createDataFrame(rows, "fold string, user_id long, frequency int, recency int, t int, monetary_value double, total_gmv double")
    value = {r.fold: r for r in btyd.fit_gamma_gamma(frame).collect()}
    like = btyd.gamma_gamma_loglik(F.col("frequency"), F.round("monetary_value", 2), *map(F.lit, (2.0, 3.0, 4.0)))
    truth = frame.where("fold = 'f' and frequency > 0 and round(monetary_value, 2) > 0").agg(F.avg(like)).first()[0] - 0.01 * (4 + 9 + 16)
    assert set(value) == {"f"} and value["f"].penalised_ll >= truth - 1e-3
    heuristic = frame.select("fold", "user_id", *[F.lit(-1.0).alias(c) for c in S.BTYD])
    found = {(r.fold, r.user_id): r for r in btyd.with_mode(heuristic, frame, "bgnbd").collect()}
    assert len(found) == 600 and {r.btyd_mode for r in found.values()} == {"bgnbd"}
    for fold, user, x, _, _, mean, total in rows:
        r = found[fold, user]
        assert 0 <= r.btyd_p_alive <= 1 and r.btyd_exp_orders_30d >= 0 and r.btyd_total_gmv == total
        v = value.get(fold)
        worth = v.p * (v.v + x * mean) / (v.p * x + v.q - 1) if v else mean
        assert r.btyd_exp_gmv_30d == pytest.approx(r.btyd_exp_orders_30d * worth, rel=1e-6)
    assert btyd.with_mode(heuristic, frame, "heuristic").where("btyd_p_alive = -1").count() == 600
    with pytest.raises(ValueError):
        btyd.with_mode(heuristic, frame, "pareto")


def test_scores_averages_and_blend(spark):
    rows = [("m", "fold_0", 1, 0.0, -5.0), ("m", "fold_0", 2, 10.0, 10.0), ("m", "fold_1", 1, 3.0, 8.0)]
    table = spark.createDataFrame(rows, "model string, fold string, user_id long, target double, pred double")
    found = {r.fold: r.rmsle for r in evaluate.rmsle(table).collect()}
    last = math.log(9) - math.log(4)
    assert found["fold_0"] == 0 and found["fold_1"] == pytest.approx(last) and found[None] == pytest.approx(math.sqrt(last**2 / 3))
    models = [("gbt", 1, 10.0), ("gbt", 2, 20.0), ("fm", 2, 2.0), ("fm", 1, 1.0), ("forest", 2, 4.0), ("forest", 1, 3.0)]
    frame = spark.createDataFrame(models, "model string, user_id long, target double")
    blended = {r.user_id: r.predict for r in evaluate.blend(frame, evaluate.WEIGHTS).collect()}
    assert blended == pytest.approx({1: 6.2, 2: 11.7})
    assert {r.user_id: r.predict for r in evaluate.blend(frame, evaluate.WEIGHTS_WITHOUT_SECOND).collect()} == pytest.approx({1: 8.65, 2: 17.3})
    with pytest.raises(Exception, match="do not match"):
        evaluate.blend(frame.where("not (model = 'fm' and user_id = 1)"), evaluate.WEIGHTS).collect()


def test_samples_and_narrowing(spark):
    table = spark.range(3000).select(F.when(F.col("id") < 2000, "a").otherwise("b").alias("fold"), F.col("id").alias("user_id"), F.lit(1.5).alias("x"))
    some = features.sample_fraction(table, 0.3)
    assert 700 < some.count() < 1100 and some.collect() == features.sample_fraction(table, 0.3).collect()
    assert {r.fold: r["count"] for r in features.sample_rows(table, 1500).groupBy("fold").count().collect()} == {"a": 1500, "b": 1000}
    assert dict(features.narrowed(table).dtypes) == {"fold": "string", "user_id": "bigint", "x": "float"}


def test_integral_is_worked_out_once_for_buyers_alike(spark):
    """Buyers who share frequency and time get one integral, equal to each one's own."""
    rows = [("f", k, float(k % 3), 5.0 * (k % 3), 40.0, 0.5, 20.0, 0.8, 2.5) for k in range(30)]
    buyers = spark.createDataFrame(rows, "fold string, user_id long, frequency double, recency double, t double, r double, alpha double, a double, b double")
    args = [F.col(c) for c in ("frequency", "t", "r", "alpha", "a", "b")]
    made = btyd.with_gain(buyers).withColumn("own", btyd.bgnbd_gain(*args))
    found = made.select("user_id", "_gain", "own").collect()
    assert len(found) == 30 and all(r._gain == pytest.approx(r.own, rel=1e-12) for r in found)
    assert "Aggregate" in btyd.with_gain(buyers)._jdf.queryExecution().optimizedPlan().toString()


def test_relevance_reads_its_rows_once(spark):
    """One pass over the table gives the moments of all folds; constant columns have 0 and nulls add nothing."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = random.Random(3)
    rows = [(f"fold_{f}", f, y, y * 2 + rng.random(), 0.1, None if k % 4 == 0 else y) for f in range(3) for k in range(50) for y in [rng.random()]]
    kind = "fold string, fold_idx int, target_log double, a double, same double, gaps double"
    table = spark.createDataFrame(rows, kind).repartition(5).mapInArrow(passed, kind)
    found = {(r.fold_model, r.feature): r.importance for r in features.relevance(table, ["a", "same", "gaps"], 2).collect()}
    assert seen.value == 150
    for model in (1, 2):
        part = [r for r in rows if r[1] < model]
        x, y = np.array([r[3] for r in part]), np.array([r[2] for r in part])
        assert found[model, "a"] == pytest.approx(abs(np.corrcoef(x, y)[0, 1]), rel=1e-9)
        assert found[model, "same"] == 0.0 and found[model, "gaps"] > 0


def test_rounding_equals_sql_without_decimals(spark, duck):
    """Halves go away from zero as in SQL, for negative and very large numbers too, and no number goes through its decimal digits."""
    from tallyfold.functions.numeric import rounded

    values = [0.0, 0.03125, 312.5e-4, 1.00005, -0.03125, -2.71828, 7 / 3, 1e6 / 7, 123456789.98765, 3e11 + 1 / 3, 5e11 + 0.3, -5e11 - 0.3, 1e17, -1e20, 0.00005, 0.00004999]
    text = ", ".join(f"(CAST('{v!r}' AS double))" for v in values)
    found = [r[0] for r in spark.sql(f"SELECT {rounded('x', 4)} AS y FROM VALUES {text} AS t(x)").collect()]
    assert found == [r[0] for r in duck.execute(f"SELECT round(x, 4) FROM (VALUES {text}) t(x)").fetchall()]
    assert "round(" not in rounded("x", 4)


def test_fitted_features_meet_their_sums_unshuffled(spark):
    """The fitted mode of the registered query has the features that a join of base features with the buyers' scores has, and no exchange of the wide sums."""
    from tallyfold.config import ORDERS
    from tallyfold.operators import btyd, folds
    from tallyfold.sources import activity
    from tallyfold.sources.scratch import written

    rows = activity.from_orders(spark.read.parquet(f"{DATA}/orders.parquet"), spark.read.parquet(f"{DATA}/lineitem.parquet"))
    sums = written(features.aggregates(rows, folds.calendar(spark, ORDERS), ORDERS), "sums")
    made = features.complete(features.base(btyd.with_fitted(sums)))
    joined = features.complete(btyd.with_mode(features.base(sums), btyd.rfm(sums), "bgnbd"))
    assert made.columns == [c for c in joined.columns if c != "btyd_mode"]
    names = [c for c in made.columns if "btyd" in c]
    one, other = ({(r.fold, r.user_id): [r[c] for c in names] for r in t.collect()} for t in (made, joined))
    assert one.keys() == other.keys() and len(one) == sums.count()
    assert all(a == pytest.approx(b, rel=1e-9, abs=1e-9) for k in one for a, b in zip(one[k], other[k]))
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
