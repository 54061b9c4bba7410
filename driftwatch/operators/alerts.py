"""Alert rows: routing, actions and messages by risk level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.config import KEY, LEVEL_NAMES
from driftwatch.functions.scalars import join_names, level_label

# Level -> action, recipients, report flags.
ROUTES: dict[int, dict] = {
    0: {"action": "none", "notify": [], "in_report": False, "highlight": False},
    1: {"action": "log_only", "notify": [], "in_report": True, "highlight": False},
    2: {"action": "push_notification", "notify": ["children"], "in_report": True, "highlight": True},
    3: {"action": "force_notification", "notify": ["children", "community_worker"],
        "in_report": True, "highlight": True},
}

# Message per level around the person and the risk names.
MESSAGES = {
    1: ("【关注】", "指标出现轻微波动，系统将持续监测"),
    2: ("【提醒】", "指标连续偏离常态，建议您主动联系老人了解近况"),
    3: ("【严重】", "指标严重异常，建议尽快安排探访或就医咨询"),
}


def executed_actions(level: int) -> list[str]:
    """What an alert of this level does, in order."""
    route = ROUTES[level]
    if route["action"] == "none":
        return []
    done = ["log_alert"] + [f"push_to_{who}" for who in route["notify"]]
    return done + (["force_ring"] if level == 3 else [])


def _by_level(level: Column, value, dtype: str) -> Column:
    out = F
    for n in ROUTES:
        out = out.when(level == n, value(n))
    return out.otherwise(F.lit(None).cast(dtype))


def with_alert(judged: DataFrame, person: str = KEY) -> DataFrame:
    """Add the alert record. A level outside 0-3 is treated as normal, its label is unknown."""
    known = F.coalesce(F.col("risk_level").isin(list(ROUTES)), F.lit(False))
    level = F.when(known, F.col("risk_level")).otherwise(0)
    names = join_names(F.coalesce("risk_types", F.array().cast("array<string>")), "多项指标")
    text = lambda n: (F.lit("") if n not in MESSAGES else F.concat(
        F.lit(MESSAGES[n][0]), F.col(person).cast("string"), F.lit("老人"), names, F.lit(MESSAGES[n][1])))
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return judged.withColumns({
        "alerted": level >= 2,
        "alert_level": _by_level(level, lambda n: F.lit(LEVEL_NAMES[n]), "string"),
        "alert_label": level_label(F.col("risk_level")),
        "action": _by_level(level, lambda n: F.lit(ROUTES[n]["action"]), "string"),
        "recipients": _by_level(level, lambda n: strings(ROUTES[n]["notify"]), "array<string>"),
        "actions": _by_level(level, lambda n: strings(executed_actions(n)), "array<string>"),
        "in_report": _by_level(level, lambda n: F.lit(ROUTES[n]["in_report"]), "boolean"),
        "highlight": _by_level(level, lambda n: F.lit(ROUTES[n]["highlight"]), "boolean"),
        "message": _by_level(level, text, "string"),
    })


def alert_rows(judged: DataFrame) -> DataFrame:
    """Rows for the alert table: successful days at level 1 or above."""
    return with_alert(judged.filter((F.col("status") == "success") & (F.col("risk_level") >= 1)))
