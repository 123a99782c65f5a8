"""Sources, sinks, streams and saved models."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyfold.config import ORDERS
from tallyfold.operators import features, folds, learn
from tallyfold.sources import activity, tables
from tallyfold.streaming import activity as stream

from .conftest import DATA


def orders(spark):
    return activity.from_orders(spark.read.parquet(f"{DATA}/orders.parquet"), spark.read.parquet(f"{DATA}/lineitem.parquet"))


def test_activity_files(spark, tmp_path):
    rows = orders(spark)
    rows.write.parquet(f"{tmp_path}/a.parquet")
    rows.write.option("header", True).csv(f"{tmp_path}/a.csv")
    expected = sorted(map(tuple, rows.collect()), key=repr)
    for name in ("a.parquet", "a.csv"):
        assert sorted(map(tuple, activity.read(spark, f"{tmp_path}/{name}").collect()), key=repr) == expected
    with pytest.raises(ValueError):
        activity.read(spark, f"{tmp_path}/a.xlsx")
    assert activity.choose(spark, [f"{tmp_path}/none.parquet", f"{tmp_path}/a.csv"]).count() == len(expected)
    with pytest.raises(FileNotFoundError):
        activity.choose(spark, [f"{tmp_path}/none.parquet"])


def test_fold_tables(spark, tmp_path):
    path = f"{tmp_path}/folds"
    table = features.build(orders(spark), folds.calendar(spark, ORDERS), ORDERS, columns=("recency_days", "gmv_sum_30d"))
    tables.write_folds(table, path)
    total = tables.read_folds(spark, path).count()
    one = tables.read_fold(spark, path, 1)
    assert 0 < one.count() < total and tables.read_fold(spark, path, "test").count() > 0
    tables.write_folds(table.where("fold = 'fold_1'").limit(5), path)
    assert tables.read_fold(spark, path, 1).count() == 5 and tables.read_folds(spark, path).count() < total
    with pytest.raises(FileNotFoundError):
        tables.read_fold(spark, path, 77)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


def test_settings_and_csv(spark, tmp_path):
    tables.write_settings(spark, {"rate": 0.5, "depth": 7}, f"{tmp_path}/s")
    assert tables.read_settings(spark, f"{tmp_path}/s", {"rate": 0.1, "bins": 64}) == {"rate": 0.5, "depth": 7, "bins": 64}
    trees = learn.Trees().over(tables.read_settings(spark, f"{tmp_path}/s", {}))
    assert trees == learn.Trees(rate=0.5, depth=7) and isinstance(trees.depth, int)
    with pytest.raises(TypeError):
        learn.Trees().over({"leaves": 5})
    tables.write_csv(spark.createDataFrame([(1, 2.5)], "user_id long, predict double"), f"{tmp_path}/c")
    assert [tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/c", "user_id long, predict double").collect()] == [(1, 2.5)]


def test_stream_of_events(spark, tmp_path):
    rows = [(1, "2024-01-01 05:00:00", "view", 0.0), (1, "2024-01-01 09:00:00", "purchase", 9.5), (2, "2024-01-02 01:00:00", "click", 0.0), (1, "2024-01-09 01:00:00", "view", 0.0)]
    events = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(3, "2024-01-20 00:00:00", "view", 0.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.write(stream.daily(read), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    found = {(r.user_id, r.event_date): (r.searches, r.to_cart, r.to_ord, float(r.gmv)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found[1, date(2024, 1, 1)] == (1, 0, 1, 9.5) and found[2, date(2024, 1, 2)] == (0, 1, 0, 0.0)


def test_models_save_and_load(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("fold_"), (F.col("id") % 3).cast("string")).alias("fold"), (F.col("id") % 3).cast("int").alias("fold_idx"), F.col("id").alias("user_id"), F.col("id").cast("double").alias("a"), (F.hash("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("target_log", F.col("a") / 100).withColumn("target", F.expm1("target_log"))
    vectors = learn.assembled(rows, ["a", "b"])
    models = learn.fit_folds(vectors, learn.Trees(rounds=5, depth=3, least_rows=2))
    scored = learn.out_of_fold(vectors, models, "gbt")
    assert {r.fold for r in scored.select("fold").distinct().collect()} == {"fold_1", "fold_2"}
    learn.save(models, f"{tmp_path}/m")
    again = learn.out_of_fold(vectors, learn.load([k for k, _ in models], f"{tmp_path}/m"), "gbt")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))
    assert learn.importances(models, ["a", "b"], spark).where("feature = 'a'").agg(F.min("importance")).first()[0] > 0.5
    with pytest.raises(ValueError):
        learn.fit_folds(vectors, learn.Trees(), kind="tweedie")


def learned(spark, n=600, folds_=4):
    """Folds of a target that two columns make, with noise."""
    import random

    rng, rows = random.Random(7), []
    for k in range(n):
        a, b, noise = rng.random(), rng.random(), rng.gauss(0, 0.3)
        y = 3 * a + (b > 0.5) + noise
        rows.append((f"fold_{k % folds_}", k % folds_, k, a, b, rng.random(), y if k % folds_ == folds_ - 1 else rng.random(), 2.718281828**y - 1, y))
    return spark.createDataFrame(rows, "fold string, fold_idx int, user_id long, a double, b double, noise double, planted double, target double, target_log double")


def test_patience_chooses_the_best_of_all_rounds(spark):
    table = learn.assembled(learned(spark), ["a", "b", "noise"])
    train, valid = table.where("fold_idx < 3"), table.where("fold_idx = 3")
    settings = learn.Trees(rounds=5000, rate=0.5, depth=3, least_rows=5, bins=32, patience=8)
    model = learn.boost(train, valid, settings)
    whole = learn.boost(train, valid, learn.Trees(rounds=60, rate=0.5, depth=3, least_rows=5, bins=32))
    errors = whole.stages[-1].evaluateEachIteration(valid, "squared")
    # The first round that no later one within the patience improves on.
    best = next(k for k in range(len(errors)) if errors[k] == min(errors[: k + 9]) and errors[k] <= min(errors[: k + 1]))
    tries = min(errors[: 8 * learn.FIRST])
    assert model.stages[-1].getNumTrees == 1 + errors.index(tries) >= best
    assert [tuple(r) for r in learn.chosen_rounds([(3, model)], spark).collect()] == [(3, model.stages[-1].getNumTrees)]
    assert model.stages[-1].evaluateEachIteration(valid, "squared")[-1] == pytest.approx(tries)


def test_staged_search_finds_the_winner_of_the_full_one(spark):
    table = learn.assembled(learned(spark), ["a", "b", "noise"])
    trials = [learn.Trees(rounds=20, rate=r, depth=d, least_rows=5, bins=32) for r in (0.02, 0.1, 0.3) for d in (2, 4)]
    full = learn.search(table, trials, last=1).collect()
    staged = learn.search(table, trials, last=1, stages=(0.5, 1.0)).collect()
    assert [r.stage for r in staged] == [1] * 3 + [0] * 6
    assert staged[0].trial == full[0].trial and staged[0].rmsle == pytest.approx(full[0].rmsle)
    work = sum(r.rounds for r in staged) / (2 * sum(r.rounds for r in full))
    print(f"staged search: {work:.0%} of twice the full one's rounds")


def test_ranking_sees_no_later_fold(spark):
    """A column that equals the target in the last fold only is not chosen, whatever that fold holds."""
    table = learn.assembled(learned(spark), ["a", "b", "noise", "planted"])
    settings = learn.Trees(rounds=20, rate=0.3, depth=3, least_rows=5, bins=32, patience=5)
    assert learn.ranked(table, ["a", "b", "noise", "planted"], settings, 3, 2) == ["a", "b"]
    near = features.relevance(learned(spark), ["a", "b", "noise", "planted"], 3)
    means = {r.feature: r.importance for r in near.groupBy("feature").agg(F.avg("importance").alias("importance")).collect()}
    assert sorted(means, key=means.get, reverse=True)[:2] == ["a", "b"] and means["planted"] < 0.3
    assert near.where("fold_model = 3").count() == 4


def test_saved_pipeline_scales_as_it_was_fitted(spark, tmp_path):
    table = learned(spark).withColumn("constant", F.lit(5.0))
    columns = ["a", "b", "constant"]
    models = learn.factor_seeds(table, columns, 3, seeds=(1, 2), rounds=5)
    scored = sorted(map(tuple, learn.seed_scores(table, models, 3).collect()))
    learn.save(models, f"{tmp_path}/fm")
    again = learn.seed_scores(table, learn.load([1, 2], f"{tmp_path}/fm"), 3)
    assert len(scored) == 300 and sorted(map(tuple, again.collect())) == scored
    train = table.where("fold_idx < 3").toPandas()
    row = learn.scaler(table.where("fold_idx < 3"), columns).transform(table).orderBy("user_id").first()
    first = table.orderBy("user_id").first()
    assert row.a == pytest.approx((first.a - train.a.mean()) / train.a.std()) and row.constant == 0 and row.noise == first.noise


def test_best_rounds_are_kept_and_not_fitted_again(spark, tmp_path, monkeypatch):
    """The model of the best rounds is the first trees of the last try: the same forecasts, importances and file as a fit of so many rounds."""
    table = learn.assembled(learned(spark), ["a", "b", "noise"])
    train, valid = table.where("fold_idx < 3"), table.where("fold_idx = 3")
    shape = {"rate": 0.5, "depth": 3, "least_rows": 5, "bins": 32}
    fitted, boosted = [], learn._boosted
    monkeypatch.setattr(learn, "_boosted", lambda s: fitted.append(s.rounds) or boosted(s))
    model = learn.boost(train, valid, learn.Trees(rounds=5000, patience=8, **shape))
    best = model.stages[-1].getNumTrees
    assert fitted == [24 * 2**k for k in range(len(fitted))] and best < fitted[-1]
    again = learn.boost(train, valid, learn.Trees(rounds=best, **shape))
    learn.save([(3, model)], f"{tmp_path}/m")
    for made in (model, learn.load([3], f"{tmp_path}/m")[0][1]):
        one, other = ([r.prediction for r in m.transform(valid).orderBy("user_id").collect()] for m in (made, again))
        assert one == pytest.approx(other, rel=1e-12)
        assert made.stages[-1].featureImportances.toArray().tolist() == pytest.approx(again.stages[-1].featureImportances.toArray().tolist())
        assert made.stages[-1].numFeatures == 3 and made.stages[-1].getMaxDepth() == 3


def test_partitions_of_vectors_hold_many_rows(spark):
    """Each partition sends a whole set of histograms for each level, so few rows do not make a partition of their own."""
    rows = spark.range(0, 90_000, 1, 12).selectExpr("'fold_0' AS fold", "0 AS fold_idx", "id AS user_id", "0D AS target", "0D AS target_log", "CAST(id AS double) AS a")
    assert learn.assembled(rows, ["a"]).rdd.getNumPartitions() == 1


def test_machines_read_their_own_columns_only(spark, monkeypatch):
    """What is written for the machines has no other features than theirs."""
    held, before = [], learn.written
    monkeypatch.setattr(learn, "written", lambda table, name: held.append((name, table.columns)) or before(table, name))
    learn.factor_seeds(learned(spark), ["a", "b"], 3, seeds=(1,), rounds=2)
    assert held[0] == ("train", ["fold", "fold_idx", "user_id", "target", "target_log", "a", "b"])
