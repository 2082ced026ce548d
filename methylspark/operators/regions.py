"""One analysis window per variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def make_regions(snvs: DataFrame, window: int = 1000) -> DataFrame:
    """Windows ``[pos - window, pos + window]``, 1-based inclusive, clamped to 1."""
    return snvs.select(
        F.col("snv_id").alias("region_id"), "snv_id", "chrom", "pos", "ref", "alt", "qual",
        F.greatest(F.lit(1), F.col("pos") - window).alias("win_start"),
        (F.col("pos") + window).alias("win_end"))


def limit_snvs(snvs: DataFrame, n: int) -> DataFrame:
    """First ``n`` variants in input order; 0 keeps all."""
    return snvs.orderBy("snv_id").limit(n) if n > 0 else snvs


def top_snvs(snvs: DataFrame, n: int = 10) -> DataFrame:
    """Head of the variant list, for display."""
    return snvs.select("snv_id", "chrom", "pos", "ref", "alt", "qual", "somatic_conf") \
        .orderBy("snv_id").limit(n)


def sample_snvs(snvs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` variants in a seeded pseudo-random order that any engine can repeat."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("snv_id").cast("string")))
    return snvs.withColumn("_key", key).orderBy("_key", "snv_id").limit(n).drop("_key")


def region_status(regions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Regions with ``success``; one without reference bases fails with a message."""
    has_bases = F.col("win_start") < F.coalesce(F.col("length"), F.lit(-1))
    return regions.join(lengths, "chrom", "left").select(
        *[regions[c] for c in regions.columns if c != "chrom"], "chrom",
        has_bases.alias("success"),
        F.when(has_bases, "").otherwise("Failed to fetch reference sequence")
        .alias("error_message"))
