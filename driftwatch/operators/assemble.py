"""Four modality frames to one ten-feature row per person and day."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.config import DAY, FEATURES, KEY, MODALITIES
from driftwatch.functions.scalars import safe_double, total


def project_modality(df: DataFrame, modality: str) -> DataFrame:
    """Key, day and the modality's features as doubles; absent columns become NULL.

    A modality of another name (a plug-in) brings those of the ten features that it has.
    """
    have = set(df.columns)
    if modality not in MODALITIES:
        return df.select(KEY, DAY, *[safe_double(f).alias(f) for f in FEATURES if f in have])
    return df.select(KEY, DAY, *[
        (safe_double(f) if f in have else F.lit(None).cast("double")).alias(f) for f in MODALITIES[modality]])


def assemble(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Join the modalities on (person, day), any of them missing, with one shuffle.

    A tagged union and one combined aggregate replace three outer joins.
    """
    union = None
    for name, df in frames.items():
        part = project_modality(df, name)
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    have = set(union.columns)
    wide = union.groupBy(KEY, DAY).agg(*[F.max(f).alias(f) for f in FEATURES if f in have])
    return with_missing(ensure_features(wide))


def ensure_features(df: DataFrame) -> DataFrame:
    """Add absent feature columns as NULL and turn NaN into NULL."""
    have = set(df.columns)
    return df.withColumns({f: (F.when(~F.isnan(f), F.col(f)) if f in have else F.lit(None).cast("double"))
                           for f in FEATURES})


def check_features(df: DataFrame) -> DataFrame:
    """Raise at plan time if a feature column is absent or not a double."""
    types = dict(df.dtypes)
    wrong = [f for f in FEATURES if types.get(f) != "double"]
    if wrong:
        raise ValueError(f"expected {len(FEATURES)} double feature columns; wrong or absent: {wrong}")
    return df


def with_missing(df: DataFrame) -> DataFrame:
    """``missing_raw`` and ``missing_names`` (in feature order)."""
    return df.withColumns({"missing_raw": missing_count(), "missing_names": missing_names()})


def missing_count(cols: list[str] = FEATURES) -> Column:
    return total(F.col(f).isNull().cast("int") for f in cols)


def missing_names(cols: list[str] = FEATURES) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in cols]))


def feature_value(df: DataFrame, name: str) -> Column:
    if name not in FEATURES:
        raise ValueError(f"unknown feature: {name}")
    return df[name]
