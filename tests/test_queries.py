"""Each registered query of the feature engine against its SQL."""

import pytest

from tallyfold.plans import oracles
from tallyfold.plans.queries import QUERIES

from .conftest import DATA, same

ORACLES = oracles.all_queries()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_registered_learners_run_the_whole_job(spark, monkeypatch):
    """All features, all folds and the ceiling of rounds; the search has its trials' own ranges; machines read the 100 most important of earlier folds."""
    from tallyfold import schema as S
    from tallyfold.operators import evaluate, learn
    from tallyfold.plans import queries

    read, fits, machines, searches, asked = [], [], [], [], []
    ranks = spark.createDataFrame([(0, c, float(k)) for k, c in enumerate(S.FEATURES)], "fold_model int, feature string, importance double")
    best = list(S.FEATURES)[::-1][:100]
    monkeypatch.setattr(queries, "_with_target", lambda s, d, columns=S.FEATURES: columns)
    monkeypatch.setattr(queries, "written", lambda table, name: table)
    monkeypatch.setattr(queries.features, "sample_fraction", lambda table, share: table if share == 0.3 else None)
    monkeypatch.setattr(learn, "assembled", lambda table, columns: read.append(list(columns)))
    monkeypatch.setattr(learn, "fit_folds", lambda vectors, settings, kind="gbt", scheme="walk_forward", last=None: fits.append((settings, last)))
    monkeypatch.setattr(learn, "importances", lambda *a: ranks)
    monkeypatch.setattr(learn, "ranked", lambda vectors, columns, settings, before, k: asked.append((settings, before, k)) or best)
    monkeypatch.setattr(learn, "search", lambda vectors, trials, last=2, stages=(): searches.append((trials, last, stages)))
    monkeypatch.setattr(learn, "factor_seeds", lambda table, columns, valid: machines.append((columns, valid)))
    for name in ("out_of_fold", "predict", "seed_scores"):
        monkeypatch.setattr(learn, name, lambda *a: None)
    for name in ("seed_average", "fold_average", "submission"):
        monkeypatch.setattr(evaluate, name, lambda *a: None)
    names = ["gbt_walk_forward", "rf_leave_one_out", "feature_importance", "gbt_test_scores", "fm_seeds", "random_search"]
    found = {n: QUERIES[n](spark, DATA) for n in names}
    assert read == [list(S.FEATURES)] * 6
    assert fits == [(queries.TREES, None), (queries.FOREST, None), (queries.TREES, None), (queries.TREES, None)]
    assert queries.TREES.rounds == 5000 and queries.TREES.patience > 0
    assert found["feature_importance"].count() == 30
    assert asked == [(queries.TREES, 5, 100)] and machines == [(best, 5)]
    (trials, last, stages) = searches[0]
    assert len(trials) == 40 and last == 2 and stages[-1] == 1.0 and {t.rounds for t in trials} == {queries.SEARCH_ROUNDS} and {t.depth for t in trials} <= set(range(4, 11))


def test_search_reads_every_row(spark, monkeypatch):
    """The trials learn from all rows of the folds, not from a share of them."""
    from tallyfold.operators import learn
    from tallyfold.plans import queries

    table = spark.range(1000).selectExpr("'fold_0' AS fold", "id AS user_id")
    monkeypatch.setattr(queries, "_with_target", lambda s, d, columns=(): table)
    monkeypatch.setattr(learn, "assembled", lambda rows, columns: rows)
    monkeypatch.setattr(learn, "search", lambda vectors, trials, **more: vectors)
    assert QUERIES["random_search"](spark, DATA).count() == 1000


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).columns) == 348
    assert set(entry.oracle_sql()) <= set(entry.queries())
