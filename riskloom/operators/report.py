"""Hard predictions and the per-class report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import labels as L


def threshold_predictions(
    scored: DataFrame, tuned: Column | float, default: float = L.DEFAULT_THRESHOLD
) -> DataFrame:
    """Predictions at the default and at the tuned threshold, both inclusive.

    ``tuned`` is a number or a scalar subquery such as ``best.select("threshold").scalar()``.
    """
    tuned = tuned if isinstance(tuned, Column) else F.lit(tuned)
    return scored.withColumns(
        {
            "pred_default": (F.col("score") >= default).cast("int"),
            "pred_tuned": (F.col("score") >= tuned).cast("int"),
        }
    )


def _ratio(part: Column, whole: Column) -> Column:
    """0 where undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classification_report(
    predictions: DataFrame,
    label: str = "y",
    columns: tuple[str, ...] = ("pred_default", "pred_tuned"),
) -> DataFrame:
    """Precision, recall, F1 and support per class with accuracy and averages, per column.

    One pass counts the confusion matrices of all columns in one row; the report is stacked from it.
    """
    truth = F.col(label) == 1
    outcomes = {
        "tp": lambda hit: truth & hit,
        "fp": lambda hit: ~truth & hit,
        "fn": lambda hit: truth & ~hit,
        "tn": lambda hit: ~truth & ~hit,
    }
    counts = predictions.agg(
        *(
            F.count_if(outcome(F.col(name) == 1)).alias(f"{name}_{kind}")
            for name in columns
            for kind, outcome in outcomes.items()
        )
    )
    lines = [(name, *line) for name in columns for line in _lines(name)]
    values = [F.lit(value) if isinstance(value, str) else value for line in lines for value in line]
    return counts.select(
        F.stack(F.lit(len(lines)), *values).alias(
            "prediction", "class_name", "precision", "recall", "f1_score", "support"
        )
    )


def _lines(name: str) -> list[tuple]:
    """The five lines of the report of one prediction, from its counts."""
    tp, fp, fn, tn = (F.col(f"{name}_{kind}") for kind in ("tp", "fp", "fn", "tn"))
    # (hits, predicted, actual) of each class
    classes = [(tn, tn + fn, tn + fp), (tp, tp + fp, tp + fn)]
    rows = []
    for class_name, (hits, predicted, actual) in zip(L.CLASS_NAMES, classes):
        precision, recall = _ratio(hits, predicted), _ratio(hits, actual)
        rows.append((class_name, precision, recall, _ratio(2 * hits, predicted + actual), actual))
    total = tp + fp + fn + tn

    def average(weights: list[Column], index: int) -> Column:
        weighted = rows[0][index] * weights[0] + rows[1][index] * weights[1]
        return _ratio(weighted, weights[0] + weights[1])

    supports = [row[4] for row in rows]
    ones = [F.lit(1), F.lit(1)]
    unknown = F.lit(None).cast("double")
    return [
        *rows,
        ("accuracy", unknown, unknown, _ratio(tp + tn, total), total),
        ("macro avg", *(average(ones, i) for i in (1, 2, 3)), total),
        ("weighted avg", *(average(supports, i) for i in (1, 2, 3)), total),
    ]
