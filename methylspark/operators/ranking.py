"""Dense numbering that never sorts a whole group in one task.

A plain ``row_number`` over a group runs in a single task, which fails once a
group holds a large share of all rows. Here a group is cut into value-based
blocks; only the block *sizes* are summed per group, and rows are numbered
inside their block. The cut depends on values alone, so a re-run of a lost task
numbers its rows the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


def _preceding(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


#: Groups up to this size may be sorted in one task (it spills to disk if need be).
TASK_ROWS = 2_000_000


def largest_group(df: DataFrame, parts: Sequence[str]) -> int:
    """Rows of the largest group; pre-aggregated, for use on a written table."""
    sizes = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("n")).first().n or 0


def dense_row_number(df: DataFrame, parts: Sequence[str], order: Sequence[str], out: str,
                     block_rows: int = BLOCK_ROWS, largest: int | None = None) -> DataFrame:
    """Number rows 0..n-1 within ``parts`` by ``order``.

    The last order column must be a unique BIGINT; the ones before it should
    have a bounded number of distinct values per group (positions in a window).
    Where ``largest`` says that every group fits a task, one window does it.
    """
    if largest is not None and largest <= TASK_ROWS:
        number = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
        return df.withColumn(out, number - 1)
    parts, coarse, last = list(parts), list(order[:-1]), order[-1]
    fine = parts + coarse
    keys = fine + ["_blk"]
    rows = df.withColumn("_blk", F.expr(f"{last} div {block_rows}"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(
        F.sum("_n").over(_preceding(Window.partitionBy(*fine).orderBy("_blk"))), F.lit(0)))
    if coarse:
        runs = sizes.groupBy(*fine).agg(F.sum("_n").alias("_run"))
        runs = runs.select(*fine, F.coalesce(
            F.sum("_run").over(_preceding(Window.partitionBy(*parts).orderBy(*coarse))),
            F.lit(0)).alias("_base"))
        offsets = offsets.join(runs, fine).withColumn("_before", F.col("_before") + F.col("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(last))
    return (rows.withColumn("_in", inside)
            .join(offsets.select(*keys, "_before"), keys)
            .withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("int"))
            .select(*df.columns, out))


def running_sum(df: DataFrame, parts: Sequence[str], order: str, value: str, out: str,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inclusive running sum of ``value`` within ``parts`` by the dense integer ``order``."""
    parts = list(parts)
    keys = parts + ["_blk"]
    rows = df.withColumn("_blk", F.expr(f"{order} div {block_rows}"))
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(
        _preceding(Window.partitionBy(*parts).orderBy("_blk"))), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("_in", F.sum(value).over(upto)).join(offsets, keys)
            .withColumn(out, F.col("_before") + F.col("_in")).select(*df.columns, out))
