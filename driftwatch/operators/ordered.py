"""Order-dependent work that survives one key holding most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here the order is cut into buckets of a fixed width
(a quarter of an hour, or a few thousand numbers), and rows are hashed by (keys, bucket) once. A bucket is worked on
alone; it leaves its first and last row and its sums, which is all that its neighbours need of it. Only these
summaries, a row per (keys, bucket), meet per key. There is no sampling pass, no second exchange of rows, and no input
is read twice.

Buckets follow from the values alone, so a second evaluation cuts the same way. Rows without an order value are the
first bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, BEFORE_ALL = "_bucket", -1 << 62
SECONDS, NUMBERS = 900, 4096      # width of a bucket of instants, and of numbers
PairTerm = Callable[[Mapping[str, Column], Mapping[str, Column]], Column]


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int | None = None) -> DataFrame:
    """Rows with their bucket of the first ``order`` column, dealt out by (keys, bucket).

    Results do not depend on ``width``; it sets how finely a key is cut and how many summaries it has.
    """
    first, kind = F.col(order[0]), dict(df.dtypes)[order[0]]
    if kind.startswith("timestamp"):
        at, size = F.unix_micros(first.cast("timestamp")), (width or SECONDS) * 1_000_000
    elif kind == "date":
        at, size = F.unix_date(first), width or 1
    else:
        at, size = first, width or NUMBERS
    slot = F.coalesce(F.floor(at / size).cast("long"), F.lit(BEFORE_ALL))
    return df.withColumn(BUCKET, slot).repartition(*keys, BUCKET)


def adjacent_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    terms: Mapping[str, PairTerm],
    sums: Mapping[str, Column] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Per key, add up ``term(previous row, row)`` over all neighbours in order.

    ``order`` must be unique within a key. ``sums`` are ordinary per-row sums taken
    in the same pass. Terms must be non-NULL for any two real rows.
    """
    return sums_of_buckets(bucketed(df, keys, order, width), keys, order, carry, terms, sums)


def bucket_summaries(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    terms: Mapping[str, PairTerm],
    sums: Mapping[str, Column] | None = None,
    per: Sequence[str] = (),
    same: Sequence[str] = (),
) -> DataFrame:
    """A row per (keys, bucket) of ``bucketed`` rows: ``_t_<term>``, ``_s_<sum>``, ``_first``, ``_last``.

    With ``per`` a row per value of these columns too: a term counts for its later row, and ``_first`` and ``_last`` are
    those of that value's rows (with their positions in ``_first_at``, ``_last_at``). ``same`` are columns that have one
    value per key.
    """
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    rows = rows.withColumns({f"_s_{n}": e for n, e in (sums or {}).items()})
    rows = rows.withColumn("_here", F.struct(*carry)).withColumn("_prev", F.lag("_here").over(local))
    position = F.struct(*order)
    return rows.groupBy(*keys, BUCKET, *per).agg(
        *[F.sum(F.when(F.col("_prev").isNotNull(), t(_fields("_prev", carry), _fields("_here", carry)))).alias(f"_t_{n}")
          for n, t in terms.items()],
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums or {}],
        F.min_by("_here", position).alias("_first"), F.max_by("_here", position).alias("_last"),
        F.min(position).alias("_first_at"), F.max(position).alias("_last_at"), *[F.first(c).alias(c) for c in same])


def sums_of_buckets(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    terms: Mapping[str, PairTerm],
    sums: Mapping[str, Column] | None = None,
    same: Sequence[str] = (),
) -> DataFrame:
    """``adjacent_sums`` of rows that are ``bucketed`` already; ``same`` are columns that have one value per key."""
    each = bucket_summaries(rows, keys, order, carry, terms, sums, same=same)
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    edges = each.withColumn("_before", F.lag("_last").over(across))
    return edges.groupBy(*keys).agg(
        *[(F.coalesce(F.sum(f"_t_{n}"), F.lit(0)) + F.coalesce(F.sum(F.when(
            F.col("_before").isNotNull(), t(_fields("_before", carry), _fields("_first", carry)))), F.lit(0))).alias(n)
          for n, t in terms.items()],
        *[F.sum(f"_s_{n}").alias(n) for n in sums or {}], *[F.first(c).alias(c) for c in same])


def _fields(struct: str, names: Sequence[str]) -> dict[str, Column]:
    return {c: F.col(struct)[c] for c in names}


def merge_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    same: str,
    text: str,
    first: Mapping[str, str],
    last: Mapping[str, str],
    sep: str = "",
    width: int | None = None,
) -> DataFrame:
    """Turn each run of neighbours with equal ``same`` into one row.

    Text is joined in order; ``first``/``last`` name the columns whose first/last value of the run is kept
    (output -> input). Runs are built inside a bucket and most are finished there; only the first and the last one of
    a bucket, which its neighbours may continue, meet per key. ``order`` must be unique within a key.
    """
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    changed = ~F.lag(same).over(local).eqNullSafe(F.col(same))
    numbered = (bucketed(df, keys, order, width)
                .withColumn("_new", F.when((F.row_number().over(local) == 1) | changed, 1).otherwise(0))
                .withColumn("_run", F.sum("_new").over(local)))
    position = F.struct(*order)

    def joined(at: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("p"), F.col(text).alias("t")))),
                                        lambda x: x["t"]), sep)

    runs = numbered.groupBy(*keys, BUCKET, "_run").agg(
        F.min(position).alias("_pos"), F.first(same).alias(same), joined(position).alias(text),
        *[F.min_by(src, position).alias(out) for out, src in first.items()],
        *[F.max_by(src, position).alias(out) for out, src in last.items()],
        F.count(F.lit(1)).alias("n_merged"))
    whole = Window.partitionBy(*keys, BUCKET)
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(whole)))
    columns = [*keys, "_pos", same, text, *first, *last, "n_merged"]

    lane = Window.partitionBy(*keys).orderBy(BUCKET, "_run")
    joins = (F.lag(BUCKET).over(lane).isNotNull() | (F.row_number().over(lane) > 1)) & ~F.lag(BUCKET).over(lane).eqNullSafe(
        F.col(BUCKET)) & F.lag(same).over(lane).eqNullSafe(F.col(same))
    edges = runs.filter("_edge").withColumn("_turn", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(lane))
    edges = edges.groupBy(*keys, "_turn").agg(
        F.min("_pos").alias("_pos"), F.first(same).alias(same), joined(F.col("_pos")).alias(text),
        *[F.min_by(out, "_pos").alias(out) for out in first],
        *[F.max_by(out, "_pos").alias(out) for out in last],
        F.sum("n_merged").alias("n_merged"))
    return runs.filter("NOT _edge").select(*columns).unionByName(edges.select(*columns)).select(
        *keys, *[F.col("_pos")[c].alias(f"first_{c}") for c in order], same, text, *first, *last, "n_merged")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str],
                salts: int = 8) -> DataFrame:
    """Inner join of many rows with one small row per key, hot keys cut ``salts`` ways."""
    many = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    one = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(one, [*keys, "_salt"]).drop("_salt")


def _slot(at: Column, width: int) -> Column:
    return ((at - F.pmod(at, F.lit(width))) / width).cast("long")


def trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    measures: Mapping[str, Column],
    window_seconds: int,
    bucket_seconds: int = 900,
) -> DataFrame:
    """Sums over ``[t - window, t]`` (both ends included) at every instant ``t`` of a key.

    The window is cut at bucket edges into a tail inside the oldest bucket, whole buckets,
    and a head inside the newest one. Head and tail are running sums within one (key,
    bucket); the middle runs over bucket totals. Nothing is subtracted, so doubles keep
    their precision, and no task ever sorts a whole key. Rows of one instant are added up
    before the first shuffle, which bounds a bucket by its number of microseconds.
    """
    if window_seconds % bucket_seconds:
        raise ValueError("the bucket must divide the window")
    names = list(measures)
    span, width = window_seconds * 1_000_000, bucket_seconds * 1_000_000
    n_buckets = window_seconds // bucket_seconds

    instants = (df.select(*keys, F.unix_micros(ts).alias("_us"), *[e.alias(n) for n, e in measures.items()])
                  .groupBy(*keys, "_us").agg(*[F.sum(n).alias(n) for n in names]))

    marks = instants.withColumn("_mark", F.explode(F.array(
        F.struct(F.lit(True).alias("arrives"), F.col("_us").alias("at")),
        F.struct(F.lit(False).alias("arrives"), (F.col("_us") + span).alias("at")))))
    marks = (marks.select(*keys, *names, F.col("_mark.arrives").alias("_arrives"), F.col("_mark.at").alias("_at"))
                  .withColumn("_bucket", _slot(F.col("_at"), width)))
    part = Window.partitionBy(*keys, "_bucket")
    head = part.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = part.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.withColumns({f"_h_{n}": F.sum(F.when(F.col("_arrives"), F.col(n))).over(head) for n in names})
    marks = marks.withColumns({f"_t_{n}": F.sum(F.when(~F.col("_arrives"), F.col(n))).over(tail) for n in names})
    points = marks.filter("_arrives")

    totals = (instants.groupBy(*keys, _slot(F.col("_us"), width).alias("_bucket"))
                      .agg(*[F.sum(n).alias(n) for n in names]))
    between = Window.partitionBy(*keys).orderBy("_bucket").rangeBetween(-(n_buckets - 1), -1)
    middle = totals.select(*keys, "_bucket", *[F.sum(n).over(between).alias(f"_m_{n}") for n in names])

    def part_sum(n: str) -> Column:
        return (F.coalesce(F.col(f"_m_{n}"), F.lit(0)) + F.coalesce(F.col(f"_t_{n}"), F.lit(0))
                + F.coalesce(F.col(f"_h_{n}"), F.lit(0)))

    return points.join(middle, [*keys, "_bucket"]).select(
        *keys, F.timestamp_micros("_at").alias(ts), *[part_sum(n).alias(n) for n in names])
