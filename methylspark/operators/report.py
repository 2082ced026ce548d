"""Run summaries, consistency checks and export text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_summary(result: DataFrame) -> DataFrame:
    """Totals over successful regions; averages are null when none succeeded."""
    ok = F.col("success")
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    return result.agg(
        F.count(F.lit(1)).alias("total_regions"), F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"), total("num_reads").alias("total_reads"),
        total("num_cpgs").alias("total_cpgs"),
        F.try_divide(total("num_reads"), F.count_if(ok)).alias("avg_reads"),
        F.try_divide(total("num_cpgs"), F.count_if(ok)).alias("avg_cpgs"))


def region_extremes(result: DataFrame) -> DataFrame:
    """Spread of reads and CpGs over successful regions, one row per measure."""
    long = result.filter("success").select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("v"))
        for c in ("num_reads", "num_cpgs")])).alias("m")).select("m.*")
    # Counting each value first keeps the median's input small.
    counts = long.groupBy("measure", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("measure").agg(
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile("v", F.lit(0.5), F.col("n")).alias("median"),
        F.sum(F.col("v") * F.col("n")).alias("_s"), F.sum("n").alias("_n"),
        F.sum(F.col("v") * F.col("v") * F.col("n")).alias("_ss"),
    ).select("measure", "min", "max", "median", (F.col("_s") / F.col("_n")).alias("mean"),
             F.when(F.col("_n") > 1, F.sqrt(
                 (F.col("_n") * F.col("_ss") - F.col("_s") * F.col("_s"))
                 / (F.col("_n") * (F.col("_n") - 1)))).alias("stddev"))


def check_dimensions(result: DataFrame, reads: DataFrame, matrix: DataFrame) -> DataFrame:
    """Regions whose tables disagree with their reported reads and CpGs."""
    in_reads = reads.groupBy("region_id").agg(F.count(F.lit(1)).alias("read_rows"))
    sites = matrix.groupBy("region_id").agg(
        (F.max("cpg_id") + 1).alias("site_rows"), F.max("read_id").alias("max_read"))
    joined = result.join(in_reads, "region_id", "full").join(sites, "region_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    issue = (F.when(F.col("snv_id").isNull(), "unexpected region")
             .when(zero("read_rows") != F.col("num_reads"), "reads")
             .when(zero("site_rows") != F.col("num_cpgs"), "sites")
             .when(F.coalesce("max_read", F.lit(-1)) >= F.col("num_reads"), "rows"))
    return joined.select("region_id", issue.alias("issue")).filter("issue is not null")


def region_name(region_id: Column) -> Column:
    """Directory-style name, zero padded to four digits."""
    text = region_id.cast("string")
    return F.concat(F.lit("region_"), F.when(F.length(text) >= 4, text)
                    .otherwise(F.lpad(text, 4, "0")))


def matrix_csv_lines(reads_wide: DataFrame) -> DataFrame:
    """Text of each region's matrix: a header line (line_no 0), then one line per read."""
    cell = lambda p: F.when(p.isNull(), "NA").otherwise(F.format_string("%.4f", p))
    body = reads_wide.select(
        "region_id", (F.col("read_id") + 1).alias("line_no"),
        F.concat_ws(",", F.col("read_id").cast("string"), F.transform("probs", cell))
        .alias("line"))
    heads = reads_wide.filter("read_id = 0").select(
        "region_id", F.lit(0).alias("line_no"),
        F.concat_ws(",", F.lit("read_id"), F.transform("positions", lambda p: p.cast("string")))
        .alias("line"))
    return heads.unionByName(body)


def reads_tsv_lines(reads: DataFrame, chroms: DataFrame) -> DataFrame:
    """Text of each region's read table: a header (line_no 0), then one line per read."""
    s = lambda c: F.col(c).cast("string")
    body = reads.join(chroms, "chrom").select(
        "region_id", (F.col("read_id") + 1).alias("line_no"), F.concat_ws(
            "\t", s("read_id"), "qname", s("chr_id"), s("align_start"), s("align_end"), s("mapq"),
            s("hp"), "alt_support", F.when(F.col("is_tumor"), "1").otherwise("0")).alias("line"))
    # Fixed value: the column names of the file.
    head = "read_id read_name chr_id start end mapq hp alt_support is_tumor".split()
    return _under_headers(body, reads.filter("read_id = 0"), head)


def cpg_sites_tsv_lines(index: DataFrame, regions: DataFrame, chroms: DataFrame) -> DataFrame:
    """Text of each region's site table: a header (line_no 0), then one line per site."""
    s = lambda c: F.col(c).cast("string")
    body = index.join(chroms, "chrom").select(
        "region_id", (F.col("cpg_id") + 1).alias("line_no"),
        F.concat_ws("\t", s("cpg_id"), s("chr_id"), s("pos")).alias("line"))
    # Fixed value: the column names of the file.
    return _under_headers(body, regions, ["cpg_id", "chr_id", "position"])


def distance_csv_lines(matrix: DataFrame) -> DataFrame:
    """Text of each region's distance matrix: a header (line_no 0), then one line per read.

    ``matrix`` has one row per read with its distances to all reads of the region in order, whose
    names run from 0.
    """
    cell = lambda d: F.when(d.isNull(), "NA").otherwise(
        F.format_string("%.4f", F.floor(d * 1e4 + 0.5) / F.lit(1e4)))
    body = matrix.select("region_id", (F.col("read_id") + 1).alias("line_no"), F.concat_ws(
        ",", F.col("read_id").cast("string"), F.transform("dist", cell)).alias("line"))
    heads = matrix.filter("read_id = 0").select(
        "region_id", F.lit(0).alias("line_no"), F.concat_ws(",", F.lit("read_id"), F.transform(
            "dist", lambda d, k: k.cast("string"))).alias("line"))
    return heads.unionByName(body)


def _under_headers(body: DataFrame, regions: DataFrame, names: list[str]) -> DataFrame:
    return regions.select("region_id", F.lit(0).alias("line_no"),
                          F.lit("\t".join(names)).alias("line")).unionByName(body)


def metadata_lines(regions: DataFrame, result: DataFrame) -> DataFrame:
    """The descriptive text of each region as numbered lines (timing left out)."""
    n, m = F.col("num_reads").cast("string"), F.col("num_cpgs").cast("string")
    s = lambda c: F.col(c).cast("string")
    where = lambda *parts: F.concat(*parts)
    # Whole-number qualities print without a decimal part.
    qual = F.when(F.col("qual") == F.floor("qual"), F.floor("qual").cast("string")).otherwise(
        s("qual"))
    lines = F.array(
        where(F.lit("Region ID: "), s("region_id")),
        where(F.lit("Region: "), F.col("chrom"), F.lit(":"), s("win_start"), F.lit("-"),
              s("win_end")),
        where(F.lit("Region Size: "), (F.col("win_end") - F.col("win_start") + 1).cast("string"),
              F.lit(" bp")),
        F.lit(""),
        where(F.lit("SNV ID: "), s("snv_id")),
        where(F.lit("SNV Position: "), F.col("chrom"), F.lit(":"), s("pos")),
        where(F.lit("SNV: "), F.col("ref"), F.lit(" -> "), F.col("alt")),
        where(F.lit("SNV Quality: "), qual),
        F.lit(""),
        where(F.lit("Num Reads: "), n), where(F.lit("Num CpG Sites: "), m),
        where(F.lit("Matrix Dimensions: "), n, F.lit(" × "), m))
    both = regions.join(result.filter("success").select("region_id", "num_reads", "num_cpgs"),
                        "region_id")
    return both.select("region_id", F.posexplode(lines).alias("line_no", "line"))


def reads_jsonl(reads: DataFrame, matrix: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One JSON object per read with its methylation map (position -> probability)."""
    cells = matrix.groupBy("region_id", "read_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "prob"))).alias("c"))
    rows = reads.join(cells, ["region_id", "read_id"], "left")
    rows = (rows.join(labels, ["region_id", "read_id"], "left") if labels is not None
            else rows.withColumn("cluster_id", F.lit(None).cast("int")))
    none = F.array().cast("array<struct<pos:int,prob:double>>")
    methylation = F.map_from_entries(F.transform(
        F.coalesce("c", none), lambda e: F.struct(e["pos"].cast("string"), F.round(e["prob"], 4))))
    return rows.select("region_id", "read_id", F.to_json(F.struct(
        "region_id", F.col("qname").alias("read_name"), F.col("chrom").alias("chr"),
        F.col("align_start").alias("start"), "hp", "is_tumor", "alt_support", "cluster_id",
        methylation.alias("methylation"))).alias("json"))


def cluster_summary(stats: DataFrame, tests: DataFrame, regions: DataFrame) -> DataFrame:
    """Cluster counts with haplotype and allele p-values, in export layout."""
    def p(factor: str, name: str) -> DataFrame:
        return tests.filter(F.col("factor") == factor).select(
            "region_id", "cluster_id", F.col("p_value").alias(name))

    keys = ["region_id", "cluster_id"]
    return (stats.join(p("hp", "p_hp"), keys, "left").join(p("allele", "p_somatic"), keys, "left")
            .join(regions.select("region_id", F.col("chrom").alias("chr"), "pos"), "region_id")
            .select("region_id", "chr", "pos", "cluster_id", "size",
                    F.col("count_hp1").alias("hp1"), F.col("count_hp2").alias("hp2"),
                    F.col("count_hp_unknown").alias("hpNA"), F.col("count_tumor").alias("tumor"),
                    F.col("count_normal").alias("normal"), F.col("count_alt").alias("alt"),
                    F.col("count_ref").alias("ref"), "p_hp", "p_somatic"))
