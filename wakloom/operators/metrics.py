"""Confusion counts and what follows from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(gold: str, pred: str) -> list[Column]:
    """tp, fp, fn, tn, dropped of boolean columns; a null prediction is dropped, a null gold is left out."""
    g, p = F.col(gold), F.col(pred)
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"), F.count_if(g.isNotNull() & p.isNull()).alias("dropped")]


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded; null where b is 0."""
    return F.when(b != 0, F.round(a / b, digits))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval of hits in n; null where n is 0."""
    p, z2 = hits / n, z * z
    middle, spread = p + z2 / (2 * n), z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    return tuple(F.when(n > 0, F.round(x / (1 + z2 / n), 6)) for x in (middle - spread, middle + spread))


def with_metrics(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn, tn, dropped) with accuracy, precision, recall, f1, coverage, intervals and conservative values.

    f1 is made of the rounded precision and recall, null where one is 0 or null.
    The conservative values count dropped cases as wrong.
    """
    tp, fp, fn, tn, dropped = (F.col(c) for c in ("tp", "fp", "fn", "tn", "dropped"))
    seen = tp + fp + fn + tn
    f1 = lambda p, r: F.when((F.col(p) > 0) & (F.col(r) > 0), F.round(2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r)), 6))
    low_p, high_p = wilson(tp, tp + fp)
    low_r, high_r = wilson(tp, tp + fn)
    out = counts.withColumns({
        "coverage": ratio(seen, seen + dropped), "accuracy": ratio(tp + tn, seen), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "precision_low": low_p, "precision_high": high_p, "recall_low": low_r, "recall_high": high_r,
        "safe_precision": ratio(tp, tp + fp + dropped), "safe_recall": ratio(tp, tp + fn + dropped),
    })
    return out.withColumns({"f1": f1("precision", "recall"), "safe_f1": f1("safe_precision", "safe_recall")})
