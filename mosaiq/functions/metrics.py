"""Segmentation metrics from counts of true and false positives and negatives.

A ratio whose denominator is 0 is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def pairs(n: Column) -> Column:
    """Number of unordered pairs of n things."""
    return n * (n - 1) / 2


def pixel_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """The 23 metrics of a class over pixels."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    recall, precision, specificity, npv = ratio(tp, tp + fn), ratio(tp, tp + fp), ratio(tn, tn + fp), ratio(tn, tn + fn)
    fpr, accuracy = ratio(fp, fp + tn), ratio(tp + tn, n)
    expected = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    cells = pairs(tp) + pairs(fp) + pairs(fn) + pairs(tn)
    rows, columns = pairs(tp + fp) + pairs(fn + tn), pairs(tp + fn) + pairs(fp + tn)
    chance = ratio(rows * columns, pairs(n))
    mirkin = (tp + fn) * (tp + fn) + (fp + tn) * (fp + tn) + (tp + fp) * (tp + fp) + (fn + tn) * (fn + tn) - 2 * (tp * tp + fp * fp + fn * fn + tn * tn)
    beta = lambda b2: ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)
    return {
        "iou": ratio(tp, tp + fp + fn),
        "sensitivity": recall,
        "precision": precision,
        "specificity": specificity,
        "npv": npv,
        "fnr": ratio(fn, tp + fn),
        "fpr": fpr,
        "fdr": ratio(fp, tp + fp),
        "for": ratio(fn, tn + fn),
        "prevalence": ratio(tp + fn, n),
        "accuracy": accuracy,
        "balanced_accuracy": (recall + specificity) / 2,
        "f05": beta(0.25),
        "f1": beta(1.0),
        "prevalence_threshold": ratio(F.sqrt(recall * fpr) - fpr, recall - fpr),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "fmi": F.sqrt(precision * recall),
        "informedness": recall + specificity - 1,
        "markedness": precision + npv - 1,
        "kappa": ratio(accuracy - expected, 1 - expected),
        "mirkin": mirkin,
        "adjusted_mirkin": ratio(mirkin, n * n),
        "adjusted_rand": ratio(cells - chance, (rows + columns) / 2 - chance),
    }


def region_metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """The 8 metrics of a class over objects."""
    tp, fp, fn = (x.cast("double") for x in (tp, fp, fn))
    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return {
        "iou": ratio(tp, tp + fp + fn),
        "sensitivity": recall,
        "precision": precision,
        "fnr": ratio(fn, tp + fn),
        "fdr": ratio(fp, tp + fp),
        "f05": ratio(1.25 * tp, 1.25 * tp + 0.25 * fn + fp),
        "f1": ratio(2 * tp, 2 * tp + fn + fp),
        "fmi": F.sqrt(precision * recall),
    }
