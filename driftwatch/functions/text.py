"""Expression text for wide rows.

Ten features times a few statistics is a lot of near-equal columns. Stated as SQL text they
reach Catalyst in one call per step instead of one call per operator and column, which keeps
plan building to a fraction of a second.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from driftwatch.config import DAY, FEATURES, KEY, Settings

BY_PERSON = f"PARTITION BY {KEY}"
BY_DAY = f"{BY_PERSON} ORDER BY {DAY}"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def num(x: float) -> str:
    """A double literal (a bare 0.05 would be a decimal)."""
    return f"{float(x)!r}D"


def each(template: str, names: Iterable[str] = FEATURES) -> list[str]:
    """One text per feature; ``{f}`` is its name and ``{i}`` its position."""
    return [template.format(f=f, i=i) for i, f in enumerate(names)]


def add(df: DataFrame, *exprs: str | list[str]) -> DataFrame:
    """Append columns given as ``expression AS name``."""
    return df.selectExpr("*", *flat(exprs))


def flat(exprs: Iterable[str | list[str]]) -> list[str]:
    return [e for x in exprs for e in ([x] if isinstance(x, str) else x)]


def deviation(x: str, over: str = "") -> str:
    """Population deviation of ``x``, also over the window ``over``.

    The same as ``stddev_pop`` up to the last bit, where the two differ: each row adds ``(x - old mean) * (x - new mean)``, as
    the SQL engine of the catalog does, so a value exactly at a limit falls on the same side in both.
    """
    return f"sqrt(covar_pop({x}, {x}){over})"


def plus(terms: Iterable[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def weighted(template: str, s: Settings) -> str:
    """Weighted mean over the features of a text that holds ``{f}`` and ``{i}``."""
    parts = [f"{template.format(f=f, i=i)} * {num(s.weight(f))}" for i, f in enumerate(FEATURES)]
    return f"({plus(parts)} / {num(s.weight_sum)})"


def array(template: str) -> str:
    return f"array({', '.join(each(template))})"


def names_where(template: str, names: Iterable[str] = FEATURES) -> str:
    """Array of the names whose condition holds, in order."""
    return "array_compact(array(%s))" % ", ".join(
        f"CASE WHEN {template.format(f=f)} THEN '{f}' END" for f in names)
