"""Interval joins as equi-joins on fixed-width bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methylspark.schemas import CLASSES

BIN_BP = 16384
SALTS = 8
#: Largest row count of a narrow table that is copied to every executor.
BROADCAST_ROWS = 500_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a narrow table is small enough to broadcast; reads at most one row more."""
    return df.limit(max_rows + 1).count() <= max_rows


def _bins(lo: str, hi: str, width: int):
    return F.expr(f"explode(sequence({lo} div {width}, {hi} div {width}))")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str],
                 right_span: tuple[str, str], left_key: str, width: int = BIN_BP,
                 salts: int = SALTS, copy_right: bool = False) -> DataFrame:
    """Pairs of rows on one ``chrom`` whose inclusive spans intersect.

    Both sides go to every bin they touch; a pair is kept only in the first bin
    they share, so no ``distinct`` follows. ``left`` is the large side. With
    ``copy_right`` (checked by ``fits_broadcast``) it is not shuffled at all.
    Otherwise its rows are spread over ``salts`` sub-keys, so that a bin with a
    large share of all rows is worked on by several tasks, and ``right`` (narrow
    rows) is repeated per salt.
    """
    if copy_right:
        salts = 1
    l_lo, l_hi = left_span
    r_lo, r_hi = right_span
    lhs = (left.withColumn("_lb", F.expr(f"{l_lo} div {width}"))
           .withColumn("_bin", _bins(l_lo, l_hi, width))
           .withColumn("_salt", F.pmod(F.xxhash64(left_key), F.lit(salts)).cast("int")))
    rhs = (right.withColumnRenamed("chrom", "_chrom")
           .withColumn("_rb", F.expr(f"{r_lo} div {width}"))
           .withColumn("_rbin", _bins(r_lo, r_hi, width))
           .withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    hit = ((F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_rbin"))
           & (F.col("_salt") == F.col("_rsalt"))
           & (F.col("_bin") == F.greatest("_lb", "_rb"))
           & (F.col(l_lo) <= F.col(r_hi)) & (F.col(l_hi) >= F.col(r_lo)))
    return lhs.join(F.broadcast(rhs) if copy_right else rhs, hit).drop("_lb", "_rb", "_bin", "_rbin", "_salt", "_rsalt", "_chrom")


def in_touched_bins(rows: DataFrame, spans: DataFrame, row_span: tuple[str, str],
                    span: tuple[str, str], width: int = BIN_BP) -> DataFrame:
    """Rows that share a bin with some span: a cheap superset of those that overlap one.

    A row goes to each of its bins and stays at the first touched one. Touched
    bins know the touched bin before them, so this needs no ``distinct`` and,
    while the bins fit a broadcast, no shuffle of ``rows``.
    """
    bins = spans.select(F.col("chrom").alias("_chrom"), _bins(*span, width).alias("_at")).distinct()
    before = F.lag("_at", 1, -1).over(Window.partitionBy("_chrom").orderBy("_at"))
    touched = bins.withColumn("_before", before)
    if fits_broadcast(bins):
        touched = F.broadcast(touched)
    spread = rows.withColumn("_first", F.expr(f"{row_span[0]} div {width}")).withColumn(
        "_bin", _bins(*row_span, width))
    here = (F.col("chrom") == F.col("_chrom")) & (F.col("_bin") == F.col("_at"))
    return spread.join(touched, here).filter("_before < _first").select(*rows.columns)


def rank_sites(sites: DataFrame, points: DataFrame,
               width: int = BIN_BP) -> tuple[DataFrame, DataFrame]:
    """Distinct ``sites(chrom, pos)`` with their 0-based ``rank`` per chromosome, and for the distinct
    ``points(chrom, pos, upto)`` how many sites lie before them (with ``upto``, or at them) as ``n``.

    One sweep inside each bin over sites and points; a bin has a bounded number of different rows,
    however many windows begin or end there, and only bin counts are summed per chromosome.
    """
    events = sites.select("chrom", "pos", F.lit(1).alias("turn")).union(
        points.select("chrom", "pos", F.when(F.col("upto"), 2).otherwise(0))).distinct().withColumn(
        "bin", F.expr(f"cast(pos div {width} as bigint)"))
    is_site = (F.col("turn") == 1).cast("bigint")
    bins = events.groupBy("chrom", "bin").agg(F.sum(is_site).alias("n"))
    before = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("chrom", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    along = Window.partitionBy("chrom", "bin").orderBy("pos", "turn").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("n", F.sum(is_site).over(along)).join(bins, ["chrom", "bin"]).withColumn(
        "n", F.col("n") + F.col("base"))
    return (swept.filter("turn = 1").select("chrom", "pos", (F.col("n") - 1).alias("rank")),
            swept.filter("turn <> 1").select("chrom", "pos", (F.col("turn") == 2).alias("upto"), "n"))


def classes_at(sites: DataFrame, intervals: DataFrame, width: int = BIN_BP) -> DataFrame:
    """Distinct ``(chrom, pos)`` of ``sites`` with one BOOLEAN per interval class.

    A sweep inside each bin replaces the site x interval join: interval ends
    become +1 / -1 steps, summed per position before the shuffle, and a running
    sum tells at each site how many intervals cover it. Rows per bin are bounded
    by the bin width however many intervals overlap there.
    """
    spans = (intervals.select("chrom", "cls", (F.col("start") + 1).alias("lo"),
                              F.col("end").alias("hi"))
             .filter("hi >= lo and lo >= 0")
             .withColumn("bin", _bins("lo", "hi", width)))
    steps = spans.select(
        "chrom", "bin",
        F.explode(F.array(
            F.struct(F.greatest("lo", F.col("bin") * width).alias("pos"),
                     F.lit(1).alias("step"), F.col("cls")),
            F.struct((F.least("hi", F.col("bin") * width + (width - 1)) + 1).alias("pos"),
                     F.lit(-1).alias("step"), F.col("cls")))).alias("e"))
    flags = [f"_d{i}" for i in range(len(CLASSES))]
    steps = steps.groupBy("chrom", "bin", F.col("e.pos").alias("pos")).agg(*[
        F.sum(F.when(F.col("e.cls") == c, F.col("e.step")).otherwise(0)).alias(f)
        for c, f in zip(CLASSES, flags)]).withColumn("_site", F.lit(0))
    points = (sites.select("chrom", "pos").distinct()
              .withColumn("bin", F.expr(f"cast(pos div {width} as bigint)"))
              .select("chrom", "bin", "pos", *[F.lit(0).cast("bigint").alias(f) for f in flags],
                      F.lit(1).alias("_site")))
    along = (Window.partitionBy("chrom", "bin").orderBy("pos", "_site")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    depth = [(F.sum(f).over(along) > 0).alias(f) for f in flags]
    swept = steps.unionByName(points).select("chrom", "pos", "_site", *depth)
    return swept.filter("_site = 1").select(
        "chrom", "pos", F.col("_d0").alias("in_pmd"),
        F.col("_d1").alias("in_repressive_state"), F.col("_d2").alias("accessible"))
