from __future__ import annotations

import random

import pytest

from martlens.churn import evaluate as V
from tests.builders import by_key


def scored(spark, pairs):
    rows = [(f"c{i}", label, float(score)) for i, (label, score) in enumerate(pairs)]
    return spark.createDataFrame(rows, "customer_id string, churned int, score double")


def tied_pairs(seed, n=300):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.4), rng.randrange(40) / 40) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_is_the_share_of_won_pairs(spark, seed):
    pairs = tied_pairs(seed)
    wins = [
        1.0 if p > n else 0.5 if p == n else 0.0
        for a, p in pairs if a == 1
        for b, n in pairs if b == 0
    ]
    found = V.roc_auc(scored(spark, pairs), digits=9).first().auc
    assert found == pytest.approx(sum(wins) / len(wins), abs=1e-9)


def test_auc_extremes(spark):
    assert V.roc_auc(scored(spark, [(0, 0.1), (1, 0.9)])).first().auc == 1.0
    assert V.roc_auc(scored(spark, [(1, 0.1), (0, 0.9)])).first().auc == 0.0
    assert V.roc_auc(scored(spark, [(1, 0.1), (1, 0.9)])).first().auc is None


def curve(pairs, drop):
    """Cumulative counts by threshold, thinned where both second differences vanish."""
    scores = sorted({s for _, s in pairs}, reverse=True)
    fp = [sum(label == 0 and s >= cut for label, s in pairs) for cut in scores]
    tp = [sum(label == 1 and s >= cut for label, s in pairs) for cut in scores]
    keep = [
        not drop
        or i in (0, len(scores) - 1)
        or fp[i + 1] - 2 * fp[i] + fp[i - 1] != 0
        or tp[i + 1] - 2 * tp[i] + tp[i - 1] != 0
        for i in range(len(scores))
    ]
    points = [(0.0, 0.0)]
    points += [(fp[i] / fp[-1], tp[i] / tp[-1]) for i in range(len(scores)) if keep[i]]
    return points


@pytest.mark.parametrize("drop", [True, False])
def test_roc_curve(spark, drop):
    pairs = tied_pairs(3, 60) + [(1, 2.0), (1, 3.0), (1, 4.0), (0, -1.0), (0, -2.0), (0, -3.0)]
    rows = V.roc_curve(scored(spark, pairs), drop_intermediate=drop).collect()
    assert [(r.fpr, r.tpr) for r in rows] == curve(pairs, drop)
    assert rows[0].threshold is None


def test_report_and_confusion(spark):
    df = scored(spark, [(1, 0.9), (1, 0.51), (1, 0.5), (0, 0.7), (0, 0.2)])
    cells = by_key(V.confusion_matrix(df), "actual", "predicted")
    assert {k: v["customers"] for k, v in cells.items()} == {
        ("Active", "Active"): 1, ("Active", "Churned"): 1,
        ("Churned", "Active"): 1, ("Churned", "Churned"): 2,
    }
    report = by_key(V.classification_report(df), "class")
    assert report["Churned"] == {
        "class": "Churned", "precision": 0.6667, "recall": 0.6667, "f1": 0.6667, "support": 3
    }
    assert report["Active"]["f1"] == 0.5
    assert report["accuracy"]["f1"] == 0.6
    assert report["macro avg"]["precision"] == 0.5833
    assert report["weighted avg"]["recall"] == 0.6


def test_report_without_predictions_of_a_class(spark):
    report = by_key(V.classification_report(scored(spark, [(1, 0.1), (0, 0.1)])), "class")
    assert report["Churned"]["precision"] == 0.0 and report["Churned"]["f1"] == 0.0
    assert len(V.confusion_matrix(scored(spark, [(1, 0.1)])).collect()) == 4


def test_bands_follow_the_rounded_probability(spark):
    values = [0.4, 0.40004, 0.40006, 0.7, 0.70004, 0.70006, 0.12345]
    banded = V.risk_bands(scored(spark, [(0, v) for v in values]))
    rows = [(r.churn_probability, r.predicted_segment) for r in banded.orderBy("customer_id").collect()]
    assert rows == [
        (0.4, "Low Risk"), (0.4, "Low Risk"), (0.4001, "Medium Risk"), (0.7, "Medium Risk"),
        (0.7, "Medium Risk"), (0.7001, "High Risk"), (0.1234, "Low Risk"),
    ]
    counts = V.risk_band_counts(banded).collect()
    assert [tuple(r) for r in counts] == [("Low Risk", 3), ("Medium Risk", 3), ("High Risk", 1)]
