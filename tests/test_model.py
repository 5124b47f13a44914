from __future__ import annotations

import duckdb
import pytest

from martlens.churn import evaluate as V
from martlens.churn import features as X
from martlens.churn import model as F
from martlens.churn import nodes as N
from martlens.fixed_values import FEATURES
from martlens.fixed_values import TREES as TREES_PUBLISHED
from martlens.plans import catalog
from martlens.sources.tpch import retail_views

TREES = 20  # enough for the checks below; the default stays at 200


@pytest.fixture(scope="module")
def matrix(spark, sample_dir):
    return X.feature_matrix(retail_views(spark, sample_dir), catalog.AS_OF)


@pytest.fixture(scope="module")
def fitted(matrix):
    return F.train_and_score(matrix, trees=TREES)


def test_recency_leaks_the_label(matrix, fitted):
    _, scored = fitted
    assert V.roc_auc(scored).first().auc > 0.95
    _, blind = F.train_and_score(matrix.drop("recency"), trees=TREES)
    assert V.roc_auc(blind).first().auc < 0.9


def test_parameters_and_scores(matrix, fitted):
    model, scored = fitted
    forest = model.stages[-1]
    assert forest.getNumTrees == TREES and forest.getMaxDepth() == 8
    assert forest.getMinInstancesPerNode() == 5 and forest.getFeatureSubsetStrategy() == "sqrt"
    low, high = scored.selectExpr("min(score)", "max(score)").first()
    assert 0 <= low <= high <= 1
    everyone = F.score(model, matrix)
    assert everyone.count() == matrix.count()
    assert set(V.risk_bands(everyone).columns) == {
        "customer_id", "churn_probability", "predicted_segment"
    }


def test_rows_keep_their_nodes_and_the_forest_stays_the_same(matrix, monkeypatch):
    kept = F.train(matrix, trees=TREES).stages[-1]
    assert kept.getOrDefault("cacheNodeIds")
    plain = F.RandomForestClassifier
    monkeypatch.setattr(F, "RandomForestClassifier", lambda **given: plain(**given | {"cacheNodeIds": False}))
    walked = F.train(matrix, trees=TREES).stages[-1]
    assert not walked.getOrDefault("cacheNodeIds") and walked.totalNumNodes == kept.totalNumNodes
    assert walked.featureImportances.toArray() == pytest.approx(kept.featureImportances.toArray(), abs=1e-9)


def test_the_walk_looks_inputs_up_by_place(spark, matrix, fitted):
    walk = N.score_by_nodes(N.forest_nodes(spark, fitted[0]), matrix)
    assert "map(" not in walk._jdf.queryExecution().optimizedPlan().toString()


def test_importances(matrix, fitted):
    rows = F.importances(fitted[0], matrix).collect()
    assert len(rows) == len(FEATURES)
    assert rows[-1].feature == "recency"
    assert [r.is_top for r in rows].count(True) == 3
    assert sum(r.importance for r in rows) == pytest.approx(1.0)


def test_cross_validation_against_sql_over_its_scores(matrix):
    """Mean and deviation of the areas, by pairs of rows, from the written scores."""
    scores = F.cv_scores(matrix, folds=3, trees=5)
    assert scores.count() == matrix.count() == scores.select("customer_id").distinct().count()
    rows = scores.toPandas()
    area, std = duckdb.sql("""
        WITH areas AS (
          SELECT p.fold, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5
                             ELSE 0 END) AS auc
          FROM rows p JOIN rows n ON p.fold = n.fold AND p.churned = 1 AND n.churned = 0
          GROUP BY p.fold)
        SELECT avg(auc), stddev_pop(auc) FROM areas""").fetchall()[0]
    row = F.auc_of_folds(scores).first()
    assert row.folds == 3 and row.mean_auc > 0.9
    assert (row.mean_auc, row.std_auc) == pytest.approx((area, std), abs=1e-12)


def test_area_of_groups(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 0, 0.8), ("c", 1, 0.5)]
    found = V.roc_auc_by(spark.createDataFrame(rows, "fold string, churned int, score double"), "fold")
    assert dict(found.collect()) == {"a": 0.75, "b": 0.0, "c": None}


WALK = """
WITH RECURSIVE reached AS (
  SELECT customer_id, tree, 0 AS node FROM matrix, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT r.customer_id, r.tree, CASE WHEN v.value <= n.threshold THEN n."left" ELSE n."right" END
  FROM reached r JOIN nodes n USING (tree, node)
  JOIN inputs v ON v.customer_id = r.customer_id AND v.feature = n.feature
)
SELECT customer_id, avg(n.churned) FROM reached JOIN nodes n USING (tree, node)
WHERE n.feature IS NULL GROUP BY customer_id"""

IMPORTANCES = """
WITH won AS (SELECT tree, feature, sum(gain * weight) AS w FROM nodes WHERE feature IS NOT NULL GROUP BY ALL),
shares AS (SELECT feature, w / sum(w) OVER (PARTITION BY tree) AS s FROM won)
SELECT feature, sum(s) / (SELECT sum(s) FROM shares) FROM shares GROUP BY feature"""


def test_sql_over_the_nodes_gives_every_figure_of_the_forest(spark, matrix):
    """The whole forest as published, walked by another engine."""
    model, _ = F.train_and_score(matrix)
    table = N.forest_nodes(spark, model)
    nodes = table.toPandas()
    assert nodes["tree"].nunique() == TREES_PUBLISHED
    matrix_rows = matrix.toPandas()
    values = matrix_rows.melt("customer_id", list(FEATURES), "feature", "value")
    con = duckdb.connect()
    for name, frame in (("nodes", nodes), ("matrix", matrix_rows), ("inputs", values)):
        con.register(name, frame)
    walked = dict(con.execute(WALK).fetchall())
    scored = {r.customer_id: r.score for r in F.score(model, matrix).collect()}
    assert len(scored) == len(walked) and walked == pytest.approx(scored, abs=1e-9)
    by_nodes = {r.customer_id: r.score for r in N.score_by_nodes(table, matrix).collect()}
    assert by_nodes == pytest.approx(scored, abs=1e-9)
    expected = {f: i for f, i, _ in F.importances(model, matrix).collect() if i}
    assert dict(con.execute(IMPORTANCES).fetchall()) == pytest.approx(expected, abs=1e-9)
    ours = N.importances_by_nodes(table, list(FEATURES)).collect()
    assert [(r.feature, r.is_top) for r in ours] == [
        (f, top) for f, _, top in F.importances(model, matrix).collect()
    ]


def test_fits_do_not_depend_on_the_order_of_rows(matrix):
    other = matrix.orderBy("monetary").repartition(5)
    scores = [
        dict(F.train_and_score(m, trees=5)[1].select("customer_id", "score").collect())
        for m in (matrix, other)
    ]
    assert scores[0] == scores[1]
