"""As-of join without a range join: one sort per key over both sides together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
               strict: bool = True) -> DataFrame:
    """Each left row with the last right row of its key before it (or at it, if not strict).

    Right columns are NULL where none qualifies. Rows are never multiplied, so a key with
    many right rows costs no more than its own length.
    """
    side = [c for c in right.columns if c not in keys]
    l_rows = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_tag"),
                         F.struct(*[c for c in left.columns if c not in keys]).alias("_l"))
    r_rows = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_tag"),
                          F.struct(*side).alias("_r"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_tag").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    return found.select(*keys, "_l.*", *[F.col("_hit")[c].alias(c) for c in side])
