"""Aligned reads from Parquet tables or SAM text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.sources.variants import read_lines

MANDATORY = 11


def _tag(prefix: str) -> Column:
    """Rest of the optional SAM field that starts with ``prefix``, null when absent."""
    hit = F.get(F.filter("tags", lambda t: t.startswith(prefix)), F.lit(0))
    return F.substring(hit, F.lit(len(prefix) + 1), F.length(hit))


def _byte_array(name: str) -> Column:
    """Array field of unsigned bytes; one of another subtype is present but empty."""
    numbers = F.filter(F.split(_tag(f"{name}:B:C"), ","), lambda v: v != "")
    values = F.transform(numbers, lambda v: v.cast("smallint"))
    other = F.when(_tag(f"{name}:").isNotNull(), F.array().cast("array<smallint>"))
    return F.coalesce(values, other)


def parse_sam(lines: DataFrame) -> DataFrame:
    """SAM body lines as the alignment table (without ``is_tumor``)."""
    c = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("@")).select(
        F.col("ord").alias("read_key"), c.alias("c"),
        F.slice(c, F.lit(MANDATORY + 1), F.size(c)).alias("tags"))
    return rows.select(
        "read_key", F.col("c")[0].alias("qname"), F.col("c")[1].cast("int").alias("flag"),
        F.col("c")[2].alias("chrom"), (F.col("c")[3].cast("int") - 1).alias("align_start"),
        F.col("c")[4].cast("int").alias("mapq"), F.col("c")[5].alias("cigar"),
        F.col("c")[9].alias("seq"), F.col("c")[10].alias("qual"),
        _tag("HP:i:").cast("int").alias("hp"), _tag("PS:i:").cast("int").alias("ps"),
        _tag("MM:Z:").alias("mm"), _byte_array("ML").alias("ml"))


def load_alignments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Alignment table from ``parquet`` or ``sam`` (plain or gzipped text)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "sam":
        return parse_sam(read_lines(spark, path))
    raise ValueError("fmt must be 'parquet' or 'sam'")


def combine_samples(tumor: DataFrame, normal: DataFrame | None = None) -> DataFrame:
    """Union of both samples with ``is_tumor``; keys stay unique by parity."""
    def mark(df: DataFrame, is_tumor: bool) -> DataFrame:
        return df.withColumn("read_key", F.col("read_key") * 2 + (0 if is_tumor else 1)) \
                 .withColumn("is_tumor", F.lit(is_tumor))

    both = mark(tumor, True)
    return both if normal is None else both.unionByName(mark(normal, False))
