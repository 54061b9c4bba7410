"""The weekly job: next versions of the baselines, then reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.config import DEFAULTS, KEY, Settings
from driftwatch.operators import baseline, report
from driftwatch.operators.scoring import latest_baseline


def retrain(days: DataFrame, results: DataFrame, baselines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """A new baseline version for everyone with enough normal days; append it to the store.

    Older versions stay, so going back is a matter of choosing an earlier one. Moving-average baselines are carried
    on; those of other models are left as they are.
    """
    recent = baseline.finetune_days(days.filter("stored AND valid"), results.filter("saved AND is_deviation"), s)
    return baseline.retrained(recent, latest_baseline(baselines), s)


def weekly_reports(results: DataFrame, generated_at: str, s: Settings = DEFAULTS, week_end=None,
                   people: DataFrame | None = None) -> DataFrame:
    """Report rows per person and week with the risk label read back from the text.

    With ``people`` (and ``week_end``) everyone gets a row for that week: without a result in it,
    from their last seven results; without any, the empty form.
    """
    if people is None:
        summary = report.weekly_summary(results, s, week_end)
    else:
        end = F.lit(week_end).cast("date")
        week = report.weekly_summary(results, s, week_end).filter(F.col("week_end") == end)
        silent = report.latest_summary(results, week_end, s).join(week.select(KEY), KEY, "left_anti")
        summary = report.weeks_of(people, week.unionByName(silent), week_end)
    reports = report.markdown_report(summary, generated_at)
    return reports.withColumn("risk_label", report.risk_label_of("report"))
