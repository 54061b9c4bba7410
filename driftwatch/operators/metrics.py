"""Detection metrics over truth and prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.scalars import ratio, rounded


def pair(truth: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truth and prediction of the same key; unmatched rows stay with a NULL side."""
    return truth.join(predicted, list(keys), "full_outer")


def orphans(paired: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """How many keys lack a side; anything above zero means the inputs do not line up."""
    return paired.agg(F.count(F.lit(1)).alias("n_keys"),
                      F.count_if(F.col(actual).isNull()).alias("no_truth"),
                      F.count_if(F.col(predicted).isNull()).alias("no_prediction"))


def _metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall,
        "f1_score": ratio(2 * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn), "specificity": F.when(fp + tn > 0, 1 - ratio(fp, fp + tn)).otherwise(0.0),
    }


def _counts(actual: Column, predicted: Column) -> dict[str, Column]:
    return {"tp": F.count_if(actual & predicted), "fp": F.count_if(~actual & predicted),
            "tn": F.count_if(~actual & ~predicted), "fn": F.count_if(actual & ~predicted)}


def detection_metrics(df: DataFrame, keys: Sequence[str] = (), actual: str = "actual",
                      predicted: str = "predicted", digits: int = 4) -> DataFrame:
    """Confusion counts and the rates derived from them, in one combined aggregate."""
    c = df.groupBy(*keys).agg(*[v.alias(k) for k, v in _counts(F.col(actual), F.col(predicted)).items()])
    m = _metrics(*[F.col(k) for k in ("tp", "fp", "tn", "fn")])
    return c.select(*keys, *[F.round(v, digits).alias(k) for k, v in m.items()], "tp", "fp", "tn", "fn",
                    (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("total"))


def false_positive_rate(df: DataFrame, keys: Sequence[str] = (), actual: str = "actual",
                        predicted: str = "predicted") -> DataFrame:
    c = _counts(F.col(actual), F.col(predicted))
    return df.groupBy(*keys).agg(ratio(c["fp"], c["fp"] + c["tn"]).alias("fpr"))


def early_warning_days(df: DataFrame, event: str = "event_date", warning: str = "warning_date",
                       keys: Sequence[str] = ()) -> DataFrame:
    """Mean days from first warning to event; negative means late."""
    return df.groupBy(*keys).agg(F.avg(F.datediff(event, warning)).alias("mean_lead_days"),
                                 F.count(F.lit(1)).alias("n_events"))


def alert_rate(results: DataFrame, people: DataFrame, start, end, level: int = 1, key: str = "elder_id",
               day: str = "date", digits: int = 4) -> DataFrame:
    """Alerts of at least ``level`` per person and day; silent people count in the denominator."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    marked = results.select(key, F.when(F.col(day).between(lo, hi) & (F.col("risk_level") >= level), 1)
                            .otherwise(0).alias("a"))
    both = marked.unionByName(people.select(key, F.lit(0).alias("a")))
    per = both.groupBy(key).agg(F.sum("a").alias("a"))
    total = per.agg(F.sum("a").alias("total_alerts"),
                    (F.count(F.lit(1)) * (F.datediff(hi, lo) + 1)).cast("long").alias("total_elder_days"))
    return total.select(F.round(ratio(F.col("total_alerts"), F.col("total_elder_days")), digits)
                        .alias("alerts_per_elder_day"), "total_alerts", "total_elder_days")


def compare_thresholds(df: DataFrame, personal: str, population: str, actual: str = "actual",
                       limit: float = 1.0, digits: bool = True) -> DataFrame:
    """False-positive rates of two scores at one limit, side by side in one aggregate."""
    parts = {}
    for name, col in (("personal", personal), ("population", population)):
        parts.update({f"{name}_{k}": v for k, v in _counts(F.col(actual), F.col(col) > limit).items()})
    c = df.agg(*[v.alias(k) for k, v in parts.items()])
    out = []
    for name in ("personal", "population"):
        m = _metrics(*[F.col(f"{name}_{k}") for k in ("tp", "fp", "tn", "fn")])
        out += [F.round(v, 4).alias(f"{name}_{k}") for k, v in m.items()]
    c = c.select(*out)
    a, b = F.col("personal_fpr"), F.col("population_fpr")
    return c.withColumns({
        "fpr_reduction": F.round(b - a, 4),
        "fpr_reduction_ratio": F.when(a > 0, rounded(b / F.when(a > 0, a), 2, digits)).otherwise(float("inf"))})
