"""Scalar column functions: casts, clamps, tags, times, labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwatch.config import EMOTION_TAGS, LEVEL_LABELS, UNKNOWN_LABEL


def safe_double(col: Column | str) -> Column:
    """Double or NULL; text that is no number and NaN both become NULL."""
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.when(~F.isnan(value), value)


def clamp(col: Column, low: float, high: float) -> Column:
    """Keep NULL as NULL (greatest/least alone would turn it into a bound)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def total(cols: Iterable[Column]) -> Column:
    """Sum of columns as one expression, left to right."""
    out = None
    for c in cols:
        out = c if out is None else out + c
    return F.lit(0) if out is None else out


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """num / den, or ``empty`` where the denominator is zero or NULL."""
    return F.when(den != 0, num / F.when(den != 0, den)).otherwise(F.lit(empty))


def rounded(col: Column, digits: int, on: bool = True) -> Column:
    """Round for presentation; ``on=False`` keeps full precision for later maths."""
    return F.round(col, digits) if on else col


def strip_tags(col: Column | str) -> Column:
    """Drop ``<...>`` runs and surrounding white space of any script."""
    blank = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"
    return F.regexp_replace(F.regexp_replace(col, r"<[^>]+>", ""), f"^{blank}|{blank}$", "")


def emotion_of(col: Column | str) -> Column:
    """First tag of the fixed priority list that occurs in the text."""
    text = F.col(col) if isinstance(col, str) else col
    out = None
    for tag, name in EMOTION_TAGS:
        hit = text.contains(tag)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("neutral")


def speech_rate(text: Column, duration_sec: Column) -> Column:
    """Characters per second; very short segments count as 0.1 s."""
    return F.length(text) / F.greatest(F.lit(0.1), duration_sec)


def clock(ms: Column) -> Column:
    """``MM:SS.mmm`` from integer milliseconds (so it never prints ``.1000``)."""
    ms = ms.cast("long")
    return F.format_string(
        "%02d:%02d.%03d",
        F.floor(ms / 60000).cast("long"),
        F.pmod(F.floor(ms / 1000).cast("long"), F.lit(60)),
        F.pmod(ms, F.lit(1000)),
    )


def minutes_of(hhmm: Column) -> Column:
    """Minutes since midnight of ``HH:MM``; anything else is NULL."""
    ok = hhmm.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
    parts = F.split(F.when(ok, hhmm), ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def level_label(level: Column) -> Column:
    out = None
    for value, text in LEVEL_LABELS.items():
        out = F.when(level == value, text) if out is None else out.when(level == value, text)
    return out.otherwise(UNKNOWN_LABEL)


def join_names(names: Column, empty: str, sep: str = "、") -> Column:
    """Join an array of names, or ``empty`` when there is none."""
    return F.when(F.size(names) > 0, F.array_join(names, sep)).otherwise(F.lit(empty))


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def week_end_of(day: Column, anchor: Column, days: int = 7) -> Column:
    """End of the ``days``-long block, counted back from ``anchor``, that holds ``day``."""
    back = F.floor(F.datediff(anchor, day) / days) * days
    return F.date_sub(anchor, back.cast("int"))
