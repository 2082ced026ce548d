"""BED intervals with a class name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.schemas import CLASSES


def parse_bed(lines: DataFrame) -> DataFrame:
    """``chrom start end class`` rows; track, browser and comment lines go."""
    c = F.split("value", "\t")
    return (lines.filter(~F.col("value").rlike("^(#|track|browser)") & (F.size(c) >= 4))
            .select(c[0].alias("chrom"), F.get(c, F.lit(1)).try_cast("int").alias("start"),
                    F.get(c, F.lit(2)).try_cast("int").alias("end"),
                    F.upper(F.get(c, F.lit(3))).alias("cls"))
            .filter(F.col("cls").isin(*CLASSES) & (F.col("end") > F.col("start"))))


def load_annotation(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))
