"""Ranking metrics and report against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from riskloom.operators import curves, report
from riskloom.functions import labels as L
from tests.frames import scored, values


def sample(seed: int, rows: int, levels: int) -> list[tuple[int, float]]:
    rng = random.Random(seed)
    return [
        (int(rng.random() < 0.3), min(rng.randrange(levels) / levels, 0.999)) for _ in range(rows)
    ]


def brute_curve(pairs):
    y = np.array([p[0] for p in pairs])
    s = np.array([p[1] for p in pairs])
    points = []
    for threshold in sorted(set(s), reverse=True):
        hit = s >= threshold
        tp, fp = int((y[hit] == 1).sum()), int((y[hit] == 0).sum())
        precision, recall = tp / (tp + fp), tp / y.sum()
        f1 = 2 * precision * recall / (precision + recall + 1e-9)
        points.append((threshold, tp, fp, precision, recall, f1))
    return points


def brute_auc(pairs):
    positive = [s for y, s in pairs if y]
    negative = [s for y, s in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return wins / (len(positive) * len(negative))


@pytest.mark.parametrize(("seed", "rows", "levels"), [(1, 400, 1000), (2, 400, 7), (3, 60, 10**6)])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_curve_and_metrics(spark, seed, rows, levels, coalesce):
    # Without coalescing, the scores spread over many partitions.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        pairs = sample(seed, rows, levels)
        curve = curves.pr_curve(scored(spark, pairs)).cache()
        expected = brute_curve(pairs)
        found = sorted(values(curve, "score", "tp", "fp", "precision", "recall", "f1"))[::-1]
        assert [row[:3] for row in found] == [row[:3] for row in expected]
        np.testing.assert_allclose([row[3:] for row in found], [row[3:] for row in expected])

        recalls = [0.0] + [row[4] for row in expected]
        ap = sum((b - a) * row[3] for a, b, row in zip(recalls, recalls[1:], expected))
        best = max(reversed(expected), key=lambda row: row[5])
        summary = curves.summary(curve).first()
        assert summary.average_precision == pytest.approx(ap, abs=1e-12)
        assert summary.roc_auc == pytest.approx(brute_auc(pairs), abs=1e-12)
        assert summary.threshold == best[0]
        assert summary.f1 == pytest.approx(best[5], abs=1e-12)
        assert curves.average_precision(curve).first()[0] == pytest.approx(ap, abs=1e-12)
        assert curves.roc_auc(curve).first()[0] == pytest.approx(brute_auc(pairs), abs=1e-12)
        assert curves.best_f1_threshold(curve).first().threshold == best[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_all_scores_tied(spark):
    curve = curves.pr_curve(scored(spark, [(1, 0.5), (0, 0.5), (0, 0.5)]))
    summary = curves.summary(curve).first()
    assert (summary.roc_auc, summary.threshold) == (0.5, 0.5)
    assert summary.average_precision == pytest.approx(1 / 3)


@pytest.mark.parametrize("label", [0, 1])
def test_single_class(spark, label):
    curve = curves.pr_curve(scored(spark, [(label, 0.2), (label, 0.7)]))
    summary = curves.summary(curve).first()
    assert summary.roc_auc is None
    assert (summary.average_precision is None) == (label == 0)
    assert curves.best_f1_threshold(curve).count() == label


def test_no_rows(spark):
    curve = curves.pr_curve(scored(spark, []))
    assert curve.count() == 0
    assert tuple(curves.summary(curve).first()) == (None, None, None, None)


def brute_report(pairs, threshold):
    rows = {}
    for c, name in enumerate(L.CLASS_NAMES):
        hits = sum(1 for y, s in pairs if y == c and (s >= threshold) == bool(c))
        predicted = sum(1 for _, s in pairs if (s >= threshold) == bool(c))
        actual = sum(1 for y, _ in pairs if y == c)
        precision = hits / predicted if predicted else 0.0
        recall = hits / actual if actual else 0.0
        both = precision + recall
        rows[name] = (precision, recall, 2 * precision * recall / both if both else 0.0, actual)
    total = len(pairs)
    correct = sum(1 for y, s in pairs if (s >= threshold) == bool(y))
    rows["accuracy"] = (None, None, correct / total, total)
    a, b = (rows[name] for name in L.CLASS_NAMES)
    rows["macro avg"] = (*((a[i] + b[i]) / 2 for i in range(3)), total)
    rows["weighted avg"] = (*((a[i] * a[3] + b[i] * b[3]) / total for i in range(3)), total)
    return rows


@pytest.mark.parametrize("tuned", [0.3, 0.0, 1.0])
def test_report(spark, tuned):
    pairs = sample(5, 200, 50)
    predictions = report.threshold_predictions(scored(spark, pairs), tuned)
    found = report.classification_report(predictions).collect()
    for name, threshold in (("pred_default", 0.5), ("pred_tuned", tuned)):
        expected = brute_report(pairs, threshold)
        rows = {row.class_name: row for row in found if row.prediction == name}
        assert set(rows) == set(expected)
        for key, want in expected.items():
            got = tuple(rows[key])[2:]
            assert got[3] == want[3]
            for mine, theirs in zip(got[:3], want[:3]):
                assert mine == (theirs if theirs is None else pytest.approx(theirs, abs=1e-12))


def test_threshold_is_inclusive(spark):
    predictions = report.threshold_predictions(scored(spark, [(1, 0.5), (0, 0.3)]), 0.3)
    assert values(predictions.orderBy("user_id"), "pred_default", "pred_tuned") == [(1, 1), (0, 1)]
