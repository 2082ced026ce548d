"""Association of clusters with haplotype, allele and sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methylspark.functions.stats import chi_square_p, fisher_log10
from methylspark.operators.cluster import label_reads
from methylspark.operators.distance import in_pair_blocks, split_group
from methylspark.params import Params

# Factor name and the two ClusterStats counts it compares.
FACTORS = (("hp", "count_hp1", "count_hp2"), ("allele", "count_alt", "count_ref"),
           ("sample", "count_tumor", "count_normal"))


def contingency(stats: DataFrame) -> DataFrame:
    """2x2 counts ``a b / c d`` of each cluster against the rest, per factor.

    Reads without haplotype and with ``UNKNOWN`` allele support are left out, as
    ``cluster_stats`` has counted them apart.
    """
    rows = stats.select("region_id", "cluster_id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("factor"), F.col(x).alias("a"), F.col(y).alias("b"))
        for name, x, y in FACTORS])).alias("t")).select("region_id", "cluster_id", "t.*")
    totals = rows.groupBy("region_id", "factor").agg(
        F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return rows.join(totals, ["region_id", "factor"]).select(
        "region_id", "cluster_id", "factor", "a", "b",
        (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d"))


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Add the two-sided exact p and its log10; each distinct table is evaluated once.

    ``p_value`` is 0 only below 1e-308; ``log10_p`` tells such tables apart.
    """
    cells = ["a", "b", "c", "d"]
    solved = tables.select(*cells).distinct().withColumn("log10_p", fisher_log10(*cells))
    return tables.join(solved, cells).select(
        *tables.columns, F.pow(F.lit(10.0), "log10_p").alias("p_value"), "log10_p")


def chi_square(tables: DataFrame) -> DataFrame:
    """Add the 2x2 statistic and its p; null where a margin is zero."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    stat = F.try_divide((a + b + c + d) * (a * d - b * c) * (a * d - b * c), margins)
    return tables.withColumn("chi2", stat).withColumn(
        "p_value", F.when(F.col("chi2").isNotNull(), chi_square_p("chi2", F.lit(1))))


def _factor_value(factor: str) -> Column:
    """Label of a read under a factor, null when it does not count."""
    if factor == "hp":
        return F.when(F.col("hp").isin(1, 2), F.col("hp").cast("string"))
    if factor == "allele":
        return F.when(F.col("alt_support") != "UNKNOWN", F.col("alt_support"))
    if factor == "sample":
        return F.when(F.col("is_tumor"), "tumor").otherwise("normal")
    raise ValueError("factor must be hp, allele or sample")


def _cross_counts(labels: DataFrame, reads: DataFrame, factor: str) -> DataFrame:
    return label_reads(labels, reads).withColumn("level", _factor_value(factor)).filter(
        "level is not null").groupBy("region_id", "cluster_id", "level").agg(
        F.count(F.lit(1)).alias("n"))


def _with_margins(counts: DataFrame) -> DataFrame:
    rows = counts.groupBy("region_id", "cluster_id").agg(F.sum("n").alias("row_n"))
    cols = counts.groupBy("region_id", "level").agg(F.sum("n").alias("col_n"))
    whole = counts.groupBy("region_id").agg(F.sum("n").alias("total"))
    return counts.join(rows, ["region_id", "cluster_id"]).join(
        cols, ["region_id", "level"]).join(whole, "region_id")


def chi_square_table(labels: DataFrame, reads: DataFrame, factor: str) -> DataFrame:
    """Statistic, degrees of freedom and p of all clusters x factor levels per region."""
    n, r, c = F.col("n"), F.col("row_n").cast("double"), F.col("col_n")
    out = _with_margins(_cross_counts(labels, reads, factor)).groupBy("region_id").agg(
        (F.first("total") * (F.sum(n * n / (r * c)) - 1.0)).alias("chi2"),
        ((F.countDistinct("cluster_id") - 1) * (F.countDistinct("level") - 1)).alias("dof"))
    return out.withColumn("p_value", F.when(F.col("dof") > 0, chi_square_p("chi2", "dof")))


def fdr_bh(tests: DataFrame) -> DataFrame:
    """Benjamini-Hochberg ``q_value`` over the clusters of a region, per factor."""
    group = Window.partitionBy("region_id", "factor")
    by_p = group.orderBy("p_value", "cluster_id")
    down = group.orderBy(F.desc("p_value"), F.desc("cluster_id")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (tests.withColumn("_rank", F.row_number().over(by_p))
            .withColumn("_m", F.count(F.lit(1)).over(group))
            .withColumn("_raw", F.col("p_value") * F.col("_m") / F.col("_rank"))
            .withColumn("q_value", F.least(F.lit(1.0), F.min("_raw").over(down)))
            .select(*tests.columns, "q_value"))


def _choose2(x: Column) -> Column:
    return F.sum(x * (x - 1) / 2)


def adjusted_rand(labels: DataFrame, reads: DataFrame, factor: str) -> DataFrame:
    """Adjusted Rand index of clusters and factor levels; null when undefined."""
    counts = _cross_counts(labels, reads, factor)
    both = counts.groupBy("region_id").agg(_choose2(F.col("n")).alias("both"),
                                           F.sum("n").alias("total"))
    rows = counts.groupBy("region_id", "cluster_id").agg(F.sum("n").alias("n")).groupBy(
        "region_id").agg(_choose2(F.col("n")).alias("rows"))
    cols = counts.groupBy("region_id", "level").agg(F.sum("n").alias("n")).groupBy(
        "region_id").agg(_choose2(F.col("n")).alias("cols"))
    expected = F.try_divide(F.col("rows") * F.col("cols"),
                            F.col("total") * (F.col("total") - 1) / 2)
    return both.join(rows, "region_id").join(cols, "region_id").withColumn(
        "e", expected).select("region_id", F.try_divide(
            F.col("both") - F.col("e"),
            (F.col("rows") + F.col("cols")) / 2 - F.col("e")).alias("ari"))


def nmi(labels: DataFrame, reads: DataFrame, factor: str) -> DataFrame:
    """Mutual information over the mean of both entropies; null when undefined."""
    counts = _cross_counts(labels, reads, factor)
    whole = counts.groupBy("region_id").agg(F.sum("n").alias("total"))

    def plogp(by: str) -> DataFrame:
        p = F.col("n") / F.col("total")
        return counts.groupBy("region_id", by).agg(F.sum("n").alias("n")).join(
            whole, "region_id").groupBy("region_id").agg((-F.sum(p * F.ln(p))).alias(f"h_{by}"))

    joint = counts.join(whole, "region_id").groupBy("region_id").agg(
        (-F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") / F.col("total")))).alias("h"))
    mutual = F.col("h_cluster_id") + F.col("h_level") - F.col("h")
    return joint.join(plogp("cluster_id"), "region_id").join(plogp("level"), "region_id").select(
        "region_id",
        F.try_divide(mutual, (F.col("h_cluster_id") + F.col("h_level")) / 2).alias("nmi"))


#: Units of a distance in the sums below; products of two fit 64 bits in a block of pairs.
_MICRO = 1_000_000


def _corr_kernel(group):
    """Sums over the pairs of two blocks whose reads have a label."""
    import numpy as np

    ids, (i, j), dist = split_group(group)
    label, _ = group["label"]
    x = np.floor(dist * _MICRO + 0.5).astype(np.int64)
    y = (label[i] != label[j]).astype(np.int64)
    sums = {"n": len(x), "sx": x.sum(), "sy": y.sum(), "sxy": (x * y).sum(), "sxx": (x * x).sum()}
    return {"region_id": np.full(1, group["region_id"][0], np.int32),
            **{k: np.full(1, v, np.int64) for k, v in sums.items()}}


def label_distance_corr(distances: DataFrame, reads: DataFrame, factor: str,
                        params: Params = Params()) -> DataFrame:
    """Correlation per region of read distance with "labels differ".

    The tasks that hold a block of known pairs return their sums, so pairs are shuffled once. Pairs
    without a known distance count as 1 under ``max_dist``; how many there are follows from the
    sizes of the labels. Under ``skip`` they are left out.
    """
    level = reads.withColumn("level", _factor_value(factor)).filter("level is not null")
    labelled = level.select("region_id", "read_id", F.array(F.xxhash64("level")).alias("label"))
    names = ["n", "sx", "sy", "sxy", "sxx"]
    known = distances.filter("dist is not null").join(
        labelled.select("region_id", F.col("read_id").alias("read_i")), ["region_id", "read_i"],
        "left_semi").join(labelled.select("region_id", F.col("read_id").alias("read_j")),
                          ["region_id", "read_j"], "left_semi")
    blocks = in_pair_blocks(labelled, known, "label", _corr_kernel,
                            "region_id INT, " + ", ".join(f"{c} BIGINT" for c in names))
    sums = blocks.groupBy("region_id").agg(*(
        F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names))
    if params.missing_pairs == "max_dist":
        sizes = level.groupBy("region_id", "level").agg(F.count(F.lit(1)).alias("c")).groupBy(
            "region_id").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        every, differ = (F.col("c") * (F.col("c") - 1) / 2, (F.col("c") * F.col("c") - F.col("cc")) / 2)
        sums = sums.join(sizes, "region_id").withColumn(
            "more", every.cast("decimal(38,0)") - F.col("n")).withColumn(
            "apart", differ.cast("decimal(38,0)") - F.col("sy"))
        sums = sums.select(
            "region_id", (F.col("n") + F.col("more")).alias("n"),
            (F.col("sx") + F.col("more") * _MICRO).alias("sx"),
            (F.col("sy") + F.col("apart")).alias("sy"),
            (F.col("sxy") + F.col("apart") * _MICRO).alias("sxy"),
            (F.col("sxx") + F.col("more") * (_MICRO * _MICRO)).alias("sxx"))
    n, sx, sy, sxy, sxx = (F.col(c).cast("double") for c in names)
    var = (n * sxx - sx * sx) * (n * sy - sy * sy)
    return sums.filter("n > 0").select(
        "region_id", F.col("n").cast("bigint").alias("n_pairs"),
        F.when(var > 0, (n * sxy - sx * sy) / F.sqrt(var)).alias("corr"))


def truth_report(tests: DataFrame, truth: DataFrame, regions: DataFrame,
                 alpha: float = 0.05) -> DataFrame:
    """Share of regions with a significant association, true against false variants."""
    hits = tests.groupBy("region_id").agg(F.max((F.col("q_value") <= alpha).cast("int"))
                                          .alias("hit"))
    return label_truth(regions, truth).join(hits, "region_id", "left").groupBy("truth").agg(
        F.count(F.lit(1)).alias("n_regions"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_significant"),
    ).withColumn("share", F.col("n_significant") / F.col("n_regions"))


def label_truth(regions: DataFrame, truth: DataFrame) -> DataFrame:
    """Attach the truth label of the anchor variant; ``NA`` when none is known."""
    return regions.join(truth, "snv_id", "left").withColumn(
        "truth", F.coalesce("truth", F.lit("NA")))


#: Ranks of the quantiles below are right within a share of 1 / this of all regions.
QUANTILE_ACCURACY = 10_000
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def correlation_by_truth(correlations: DataFrame, regions: DataFrame, truth: DataFrame,
                         accuracy: int = QUANTILE_ACCURACY) -> DataFrame:
    """Distribution of ``corr`` over the regions of true and of false variants.

    The quantiles come from sketches that tasks fill and merge, so no group is sorted; up to
    ``accuracy`` regions a group they are exact (the value at rank ceil(q n)). Regions without a
    correlation are counted apart.
    """
    values = label_truth(regions, truth).join(
        correlations.select("region_id", "corr"), "region_id", "left")
    sketch = F.percentile_approx("corr", list(QUANTILES), accuracy)
    return values.groupBy("truth").agg(
        F.count("corr").alias("n_corr"), F.count_if(F.col("corr").isNull()).alias("n_without"),
        sketch.alias("q")).select("truth", "n_corr", "n_without", *(
            F.get("q", F.lit(k)).alias(f"q{int(q * 100):02d}") for k, q in enumerate(QUANTILES)))
