"""Row numbers over whole tables without a task that sees all rows.

Rows are sorted into ranges of the order and written; a row's number is its place in its range
and the count of the rows in the ranges before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(rows: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "position", first: int = 1) -> DataFrame:
    """rows with their number, from first on, in the order, within equal values of by (null is a value).

    Equal rows are dealt to several ranges too, so no value of the order makes a range larger.  The
    counts are a row for each range and value of by."""
    salted = written(rows.withColumn("_salt", F.monotonically_increasing_id()), "unordered")
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order, F.col("_salt")]
    ranged = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    runs = written(ranged.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_run", F.shiftright("_seq", 33)), "ordered")
    mine = [f"_{k}" for k in range(len(by))]
    counts = runs.groupBy(*(F.col(c).alias(m) for c, m in zip(by, mine)), F.col("_run").alias("_of")).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = f"coalesce(sum(_n) over ({'partition by ' + ', '.join(mine) if by else ''} order by _of rows between unbounded preceding and 1 preceding), 0)"
    counts = counts.withColumn("_before", F.expr(before))
    same = [F.col("_run") == F.col("_of"), *(F.col(c).eqNullSafe(F.col(m)) for c, m in zip(by, mine))]
    place = F.col("_before") + F.col("_seq") - F.col("_first") + first
    return runs.join(counts, same).withColumn(name, place).select(*rows.columns, name)
