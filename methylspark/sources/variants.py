"""Variant tables from VCF or whitespace-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from methylspark.operators.ranking import dense_row_number

BASES = ("A", "C", "G", "T")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with ``ord``, their number in the order of file paths and of lines in a file.

    Spark deals input splits out by size, so its own row numbers follow no order of files. A split's
    lines stay together, however: counting the lines of earlier splits makes the number exact.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (
        F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    # One row per split, so it always fits a broadcast, and lines are not shuffled for it.
    return lines.join(F.broadcast(offsets), ["_file", "_start"]).select(
        "value", (F.col("_id") + F.col("_offset")).alias("ord"))


def _sample_value(keys: Column, values: Column, key: str) -> Column:
    """First number of a FORMAT field in the first sample, null when absent."""
    at = F.array_position(F.split(keys, ":"), key)
    cell = F.when(at > 0, F.get(F.split(values, ":"), (at - 1).cast("int")))
    return F.split(cell, ",")[0].try_cast("double")


def parse_vcf(lines: DataFrame) -> DataFrame:
    """VCF data lines as typed columns, one row per record, nothing filtered."""
    cols = F.split("value", "\t")
    rows = (lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
            .select("ord", cols.alias("c")))
    field = lambda i: F.get("c", F.lit(i))
    return rows.select(
        "ord", field(0).alias("chrom"), field(1).try_cast("int").alias("pos"),
        field(3).alias("ref"), field(4).alias("alt"),
        F.coalesce(field(5).try_cast("double"), F.lit(0.0)).alias("qual"),
        field(6).alias("flt"), field(7).alias("info"),
        F.coalesce(_sample_value(field(8), field(9), "AF"), F.lit(0.0)).alias("somatic_conf"),
        _sample_value(field(8), field(9), "NAF").alias("normal_af"))


def _single_base(c: str) -> Column:
    return F.upper(F.col(c)).isin(*BASES)


def select_snvs(records: DataFrame, min_qual: float = 0.0, require_pass: bool = True,
                accept_missing_filter: bool = False, somatic_info_tag: str | None = None,
                keep_multiallelic: bool = False, chroms: list[str] | None = None,
                interval: tuple[int, int] | None = None,
                max_normal_af: float | None = None) -> DataFrame:
    """Keep somatic single-base substitutions that meet the given conditions."""
    keep = F.col("qual") >= min_qual
    if require_pass:
        # FILTER may list several names; PASS among them is enough.
        passed = F.array_contains(F.split("flt", ";"), "PASS")
        keep &= (passed | (F.col("flt") == ".")) if accept_missing_filter else passed
    if somatic_info_tag:
        names = F.transform(F.split("info", ";"), lambda x: F.split(x, "=")[0])
        keep &= F.array_contains(names, somatic_info_tag)
    if keep_multiallelic:
        keep &= _single_base("ref") & F.forall(
            F.split("alt", ","), lambda a: F.upper(a).isin(*BASES))
    else:
        keep &= _single_base("ref") & _single_base("alt")
    if chroms is not None:
        keep &= F.col("chrom").isin(*chroms)
    if interval is not None:
        keep &= F.col("pos").between(*interval)
    if max_normal_af is not None:
        keep &= F.coalesce(F.col("normal_af"), F.lit(0.0)) <= max_normal_af
    return records.filter(keep)


def number_snvs(records: DataFrame) -> DataFrame:
    """Attach ``snv_id`` = rank in input order and lay out the variant table."""
    return dense_row_number(records, [], ["ord"], "snv_id").select(
        "snv_id", "chrom", "pos", "ref", "alt", "qual",
        F.array_contains(F.split("flt", ";"), "PASS").alias("is_pass"),
        "somatic_conf", "info")


def load_vcf(spark: SparkSession, path: str, **conditions) -> DataFrame:
    """PASS biallelic SNVs of a plain or gzipped VCF text file."""
    return number_snvs(select_snvs(parse_vcf(read_lines(spark, path)), **conditions))


def parse_snv_tsv(lines: DataFrame) -> DataFrame:
    """``chrom pos ref alt [qual]`` rows; header, comments and blank lines go."""
    c = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        "ord", c[0].alias("chrom"), F.get(c, F.lit(1)).try_cast("int").alias("pos"),
        F.get(c, F.lit(2)).alias("ref"), F.get(c, F.lit(3)).alias("alt"),
        F.coalesce(F.get(c, F.lit(4)).try_cast("double"), F.lit(0.0)).alias("qual"))
    rows = rows.filter(~F.lower("chrom").isin("chr", "chrom") & F.col("pos").isNotNull()
                       & _single_base("ref") & _single_base("alt"))
    return dense_row_number(rows, [], ["ord"], "snv_id").select(
        "snv_id", "chrom", "pos", "ref", "alt", "qual", F.lit(True).alias("is_pass"),
        F.lit(0.0).alias("somatic_conf"), F.lit("").alias("info"))


def load_snv_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_snv_tsv(read_lines(spark, path))


def header_contigs(lines: DataFrame) -> DataFrame:
    """Contigs declared by ``##contig=<ID=...>`` lines, with their line order."""
    name = F.regexp_extract("value", r"^##contig=<ID=([^,>]+)", 1)
    return lines.filter(F.col("value").startswith("##contig=")).select(
        name.alias("chrom"), "ord")


def chrom_dictionary(names: DataFrame) -> DataFrame:
    """``(chr_id, chrom)`` numbered by the first ``ord`` at which a name occurs."""
    first = names.groupBy("chrom").agg(F.min("ord").alias("ord"))
    return dense_row_number(first, [], ["ord"], "chr_id").select("chr_id", "chrom")
