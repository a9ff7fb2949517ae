"""Order-aware columns over range partitions: numbers, running sums, the row before, the last row as of a place.

A window by group, or without one, puts a group into one task. Here rows are
dealt by ranges of (group, order), so a group of any size is spread over as
many tasks as it fills; what a task must know of those before it (how many
rows, which sum, which last row) is one row for each group and partition,
joined back. A result is the same whatever the ranges are.

``order`` must be total up to rows that are equal in every column asked for:
among equal places the partition decides. Nulls come first. Column names that
start with ``_`` are used inside and must not be given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Write = Callable[[DataFrame], DataFrame]


def checkpointed(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def placed(rows: DataFrame, order: Sequence[str | Column], within: Sequence[str], write: Write) -> DataFrame:
    """``rows`` written in ranges of (within, order), with their range ``_part`` and place in it ``_nth``."""
    keys = [*within, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return write(dealt.select("*", F.spark_partition_id().alias("_part"), nth.alias("_nth")))


def _told(dealt: DataFrame, within: Sequence[str], summary: Sequence[Column], carried: Sequence[Column], whole: Sequence[Column] = ()) -> DataFrame:
    """``dealt`` with what each group's parts before a row's own say: ``summary`` of a part, ``carried`` over those before, ``whole`` over all."""
    key = F.struct(*within, "_part").alias("_key")
    parts = dealt.groupBy(*within, "_part").agg(*summary)
    group = Window.partitionBy(*within or [F.lit(0)])
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in parts.columns if c not in (*within, "_part")]
    over = [*(c.over(before).alias(f"_carried{i}") for i, c in enumerate(carried)), *(c.over(group).alias(f"_whole{i}") for i, c in enumerate(whole))]
    told = parts.select(key, *names, *over)
    return dealt.withColumn("_key", F.struct(*within, "_part")).join(told, "_key")


def numbered(rows: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "place", total: str | None = None, write: Write = checkpointed) -> DataFrame:
    """``rows`` with ``name``, the number from 0 of a row in its group, and with ``total``, if named, the rows of the group."""
    dealt = placed(rows, order, within, write)
    told = _told(dealt, within, [F.min("_nth").alias("_low"), F.count(F.lit(1)).alias("_rows")], [F.sum("_rows")], [F.sum("_rows")])
    place = F.col("_nth") - F.col("_low") + F.coalesce("_carried0", F.lit(0))
    return told.select(*rows.columns, place.cast("long").alias(name), *([F.col("_whole0").alias(total)] if total else []))


def running_sum(rows: DataFrame, value: str, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "before", write: Write = checkpointed) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows of the group that come before."""
    dealt = placed(rows, order, within, write)
    told = _told(dealt, within, [F.sum(value).alias("_sum")], [F.sum("_sum")])
    inside = Window.partitionBy("_key").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce("_carried0", F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return told.select(*rows.columns, before.alias(name))


def row_before(rows: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), columns: Sequence[str] = (), name: str = "previous", write: Write = checkpointed) -> DataFrame:
    """``rows`` with ``name``, a struct of ``columns`` of the row before in the group, null for the first."""
    dealt = placed(rows, order, within, write)
    told = _told(dealt, within, [F.max_by(F.struct(*columns), "_nth").alias("_last")], [F.last("_last")])
    own = F.lag(F.struct(*columns)).over(Window.partitionBy("_key").orderBy("_nth"))
    return told.select(*rows.columns, F.coalesce(own, "_carried0").alias(name))


def as_of(left: DataFrame, right: DataFrame, on: str, within: Sequence[str] = (), columns: Sequence[str] = (), name: str = "asof", strict: bool = True, write: Write = checkpointed) -> DataFrame:
    """``left`` with ``name``, ``columns`` of the last row of ``right`` in the group whose ``on`` is before the row's (``strict``), or not after.

    Of rows of ``right`` with one place the greatest struct of ``columns``
    counts. Rows of ``left`` without a place have none; those of ``right`` are passed over.
    """
    given = right.where(F.col(on).isNotNull()).groupBy(*within, on).agg(F.max(F.struct(*columns)).alias("_given"))
    # At one place what is asked comes first if only earlier rows count.
    asked = left.select(*within, on, F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_row"))
    told = given.select(*within, on, F.lit(1 if strict else 0).alias("_side"), "_given")
    both = asked.unionByName(told, allowMissingColumns=True)
    dealt = placed(both, [on, "_side"], within, write)
    own = Window.partitionBy("_key").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    # The last row of a part that gives anything; none if the part has none.
    summary = F.max_by("_given", F.when(F.col("_given").isNotNull(), F.col("_nth"))).alias("_last")
    seen = _told(dealt, within, [summary], [F.last("_last", ignorenulls=True)])
    found = F.coalesce(F.last("_given", ignorenulls=True).over(own), F.col("_carried0"))
    return seen.select("_row", F.when(F.col(on).isNotNull(), found).alias(name)).where("_row is not null").select("_row.*", name)
