"""One query per operator over the tables derived from the star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.operators import assoc, calls, cluster, distance, matrix, reads, regions, report
from methylspark.params import Params
from methylspark.plans import star
from methylspark.plans.region_run import RegionRun
from methylspark.plans.staging import Store
from methylspark.sources import alignments, annotation, reference, sinks, variants

#: Documents are short contigs, so windows and reads are shorter than the defaults.
PARAMS = Params(window=200, min_read_length=100)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_runs: dict[tuple[str, str], RegionRun] = {}
_stores: dict[tuple[str, str], Store] = {}
_contigs: dict[tuple[str, str], DataFrame] = {}
_records: dict[tuple[str, str], DataFrame] = {}
_alignments: dict[tuple[str, str], DataFrame] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(value: Column) -> Column:
    """Six decimals by the same arithmetic in every engine."""
    return F.floor(value * F.lit(1e6) + 0.5) / F.lit(1e6)


def store_of(spark: SparkSession, sf_dir: str) -> Store:
    """Where tables and files of one data folder are written."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = Store(spark, sf_dir.strip("/").replace("/", "_"))
    return _stores[key]


def run_of(spark: SparkSession, sf_dir: str) -> RegionRun:
    """The analysis of one data folder, with shared tables written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        store, contigs = store_of(spark, sf_dir), contigs_of(spark, sf_dir)
        snvs = store("snvs", star.snvs(spark, sf_dir, records_of(spark, sf_dir)))
        near = star.alignments(spark, sf_dir, contigs, reads.well_mapped(PARAMS),
                               regions.make_regions(snvs, PARAMS.window))
        _runs[key] = RegionRun(snvs=snvs, alignments=store("near_alignments", near), contigs=contigs,
                               params=PARAMS, annotation=star.annotation(spark, sf_dir), store=store)
    return _runs[key]


def contigs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contigs of one data folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contigs:
        _contigs[key] = store_of(spark, sf_dir)("contigs", star.contigs(spark, sf_dir))
    return _contigs[key]


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant records of one data folder, written once per application: their places are searched
    for once, and not again by each filter on them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _records:
        _records[key] = store_of(spark, sf_dir)("variant_records", star.variant_records(
            spark, sf_dir, contigs_of(spark, sf_dir)))
    return _records[key]


def alignments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads of one data folder, written once per application for the queries about every read;
    windows are worked on from the reads near them (``run_of``)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _alignments:
        by_place = star.alignments(spark, sf_dir, contigs_of(spark, sf_dir)).sortWithinPartitions(
            "chrom", "align_start")
        _alignments[key] = store_of(spark, sf_dir)("alignments", by_place)
    return _alignments[key]


def lazy_run(spark: SparkSession, sf_dir: str) -> RegionRun:
    """The same analysis as one plan; only the alignments are a written table."""
    staged = run_of(spark, sf_dir)
    return RegionRun(staged.snvs, staged.alignments, staged.contigs, PARAMS, staged.annotation)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_of(spark, sf_dir).result


def given_labels(run: RegionRun) -> DataFrame:
    """A fixed labelling, for operators that take clusters as input."""
    return run.reads.select("region_id", "read_id", (F.col("hp") + 1).alias("cluster_id"))


def as_files(run: RegionRun, name: str, lines: DataFrame) -> str:
    """Path of text files that hold ``lines(ord, value)`` in order, for the readers to open."""
    path = run.store.path(name)
    lines.repartitionByRange(4, "ord").sortWithinPartitions("ord").select("value").write.mode(
        "overwrite").text(path)
    return path


# --- sources and sinks -------------------------------------------------------

@query
def load_vcf(spark, sf_dir):
    snvs = variants.load_vcf(spark, as_files(run_of(spark, sf_dir), "vcf",
                                             star.vcf_lines(spark, sf_dir)))
    return snvs.select("snv_id", "chrom", "pos", "ref", "alt", "qual", "is_pass",
                       r6(F.col("somatic_conf")).alias("somatic_conf"), "info")


@query
def load_snv_tsv(spark, sf_dir):
    lines = star.variant_records(spark, sf_dir).select("ord", F.concat_ws(
        "  ", "chrom", F.col("pos").cast("string"), "ref", "alt",
        F.when(F.col("ord") % 5 != 0, F.col("qual").cast("string"))).alias("value"))
    path = as_files(run_of(spark, sf_dir), "snv_lines", lines)
    return variants.load_snv_tsv(spark, path).select("snv_id", "chrom", "pos", "ref", "alt", "qual")


@query
def select_snvs(spark, sf_dir):
    kept = variants.select_snvs(
        star.variant_records(spark, sf_dir), min_qual=10, accept_missing_filter=True,
        somatic_info_tag="SOMATIC", interval=(1, 1500), max_normal_af=0.04)
    return kept.select("ord", "chrom", "pos", "ref", "alt", "qual", "flt")


@query
def load_alignments(spark, sf_dir):
    path = store_of(spark, sf_dir).path("sam")
    # The text is put together after the shuffle and the sort, packed, in as many files as a shuffle has tasks.
    star.sam_lines(star.alignments_by_key(spark, sf_dir)).select("value").write.mode("overwrite").text(
        path, compression="gzip")
    parsed = alignments.load_alignments(spark, path, "sam")
    return parsed.select(
        "read_key", "qname", "flag", "chrom", "align_start", "mapq", "cigar", "hp", "ps",
        F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"),
        F.md5("mm").alias("mm_md5"),
        F.md5(F.array_join(F.col("ml").cast("array<string>"), ",")).alias("ml_md5"))


@query
def tile_reference(spark, sf_dir):
    return star.tiles(spark, sf_dir)


@query
def load_fasta_tiles(spark, sf_dir):
    """Tiles from the lines of FASTA files, in which a contig is never one row, and their lengths."""
    run = run_of(spark, sf_dir)
    lines = F.regexp_replace("seq", "(.{1,60})", "\n$1")
    text = run.contigs.select(F.col("chrom").alias("ord"),
                              F.concat(F.lit(">"), "chrom", F.lit(" derived"), lines).alias("value"))
    found = reference.load_fasta_tiles(spark, as_files(run, "fasta", text))
    lengths = reference.tile_lengths(found).withColumnRenamed("length", "contig_length")
    return found.join(lengths, "chrom").select(
        "chrom", "tile", "tile_start", "core", F.md5("seq").alias("seq_md5"), "contig_length")


@query
def contig_lengths(spark, sf_dir):
    return reference.contig_lengths(star.contigs(spark, sf_dir),
                                    star.variant_records(spark, sf_dir))


@query
def chrom_dictionary(spark, sf_dir):
    return variants.chrom_dictionary(star.variant_records(spark, sf_dir))


@query
def load_annotation(spark, sf_dir):
    lines = star.annotation(spark, sf_dir).select(F.col("chrom").alias("ord"), F.concat_ws(
        "\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"),
        F.lower("cls")).alias("value"))
    return annotation.load_annotation(spark, as_files(run_of(spark, sf_dir), "bed", lines))


@query
def write_snv_tsv(spark, sf_dir):
    run = run_of(spark, sf_dir)
    path = run.store.path("snv_tsv")
    sinks.write_snv_tsv(run.snvs, path, mode="overwrite")
    back = spark.read.csv(path, sep="\t", header=True, schema=sinks.snv_export(run.snvs).schema)
    return back.withColumn("somatic_conf", r6(F.col("somatic_conf")))


@query
def write_region_tables(spark, sf_dir):
    """All four tables of a run written and read back: rows and a checksum of each."""
    run = run_of(spark, sf_dir)
    path = run.store.path("region_tables")
    tables = {"reads": run.reads, "cpg_sites": run.counts.drop("n"), "matrix": run.matrix,
              "region_result": run.result}
    # contigs are many and short here, so they get no directory each
    sinks.write_region_tables(tables, path, mode="overwrite", by_chrom=False)
    checks = {"reads": F.col("read_id") + F.col("align_start"), "cpg_sites": F.col("cpg_id") + F.col("pos"),
              "matrix": F.col("ml").cast("int"), "region_result": F.col("num_reads") + F.col("num_cpgs")}
    parts = [spark.read.parquet(f"{path}/{name}").groupBy("region_id").agg(
        F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"),
        F.sum(value).cast("bigint").alias("checksum")) for name, value in checks.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def matrix_csv_lines(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return report.matrix_csv_lines(matrix.packed_matrix_wide(run.reads, run.packed, run.counts))


@query
def reads_tsv_lines(spark, sf_dir):
    run = run_of(spark, sf_dir)
    chroms = variants.chrom_dictionary(records_of(spark, sf_dir))
    return report.reads_tsv_lines(run.reads, chroms)


@query
def cpg_sites_tsv_lines(spark, sf_dir):
    run = run_of(spark, sf_dir)
    chroms = variants.chrom_dictionary(records_of(spark, sf_dir))
    return report.cpg_sites_tsv_lines(run.counts, run.live_regions, chroms)


@query
def distance_csv_lines(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return report.distance_csv_lines(distance.distance_matrix(run.reads, run.distances))


@query
def metadata_lines(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return report.metadata_lines(run.regions, run.result)


@query
def reads_jsonl(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return report.reads_jsonl(run.reads, run.matrix, given_labels(run))


@query
def cluster_summary_csv(spark, sf_dir):
    run = run_of(spark, sf_dir)
    stats = cluster.cluster_stats(given_labels(run), run.reads)
    tests = assoc.fisher_exact(assoc.contingency(stats)).withColumn(
        "p_value", r6(F.col("p_value")))  # the text has six decimals
    return report.cluster_summary(stats, tests, run.regions)


# --- projections, filters, row selection -------------------------------------

@query
def make_regions(spark, sf_dir):
    return regions.make_regions(star.snvs(spark, sf_dir), PARAMS.window)


@query
def limit_snvs(spark, sf_dir):
    return regions.limit_snvs(star.snvs(spark, sf_dir), 32).select("snv_id", "chrom", "pos")


@query
def sample_snvs(spark, sf_dir):
    return regions.sample_snvs(star.snvs(spark, sf_dir), 32).select("snv_id", "chrom", "pos")


@query
def top_snvs(spark, sf_dir):
    return regions.top_snvs(star.snvs(spark, sf_dir), 10).withColumn(
        "somatic_conf", r6(F.col("somatic_conf")))


@query
def filter_reads(spark, sf_dir):
    return reads.filter_reads(alignments_of(spark, sf_dir), PARAMS).select(
        "read_key", "flag", "mapq", "cigar")


@query
def filter_reasons(spark, sf_dir):
    return reads.filter_reasons(alignments_of(spark, sf_dir), PARAMS)


@query
def cigar_lengths(spark, sf_dir):
    return reads.cigar_lengths(alignments_of(spark, sf_dir)).select(
        "read_key", "cigar", "query_length", "align_end")


@query
def read_info(spark, sf_dir):
    return reads.read_info(alignments_of(spark, sf_dir))


@query
def alt_support(spark, sf_dir):
    return lazy_run(spark, sf_dir).overlaps.select("region_id", "read_key", "alt_support")


@query
def read_state(spark, sf_dir):
    return reads.read_state(run_of(spark, sf_dir).reads).select(
        "region_id", "read_id", "state_bits")


@query
def phase_set_check(spark, sf_dir):
    return reads.phase_set_check(run_of(spark, sf_dir).reads)


@query
def phase_gate(spark, sf_dir):
    """The outcome of a run that skips windows of several phase sets."""
    run = run_of(spark, sf_dir)
    return replace(run, params=replace(PARAMS, phase_gate=True)).result


# --- from reads to calls -----------------------------------------------------

@query
def cigar_blocks(spark, sf_dir):
    return calls.cigar_blocks(alignments_of(spark, sf_dir))


def _per_read(bases: DataFrame, place: str) -> DataFrame:
    """Counts and order-free checksums per read, to keep the compared result small."""
    return bases.groupBy("read_key", "chrom").agg(
        F.count(F.lit(1)).alias("n"), F.sum(place).alias("sum_place"),
        F.sum(F.col(place) * (F.col("ml") + 1)).alias("sum_weighted"))


@query
def modified_bases(spark, sf_dir):
    return _per_read(calls.modified_bases(alignments_of(spark, sf_dir), PARAMS), "seq_idx")


@query
def project_calls(spark, sf_dir):
    bases = calls.modified_bases(alignments_of(spark, sf_dir), PARAMS)
    return _per_read(calls.project_calls(bases), "pos")


@query
def validate_cpg(spark, sf_dir):
    return _per_read(_all_calls(spark, sf_dir, star.alignments(spark, sf_dir)), "pos")


def _all_calls(spark: SparkSession, sf_dir: str, every: DataFrame) -> DataFrame:
    # The same contigs that reads derived on the way lie on, so that they are shuffled once for both.
    return calls.methylation_calls(
        every, reference.reference_cpg_sites(star.tiles(spark, sf_dir, usable=True)), PARAMS)


@query
def methylation_calls(spark, sf_dir):
    # Reads are looked at once, so they are derived on the way and not written.
    return _all_calls(spark, sf_dir, star.alignments(spark, sf_dir)).groupBy("chrom", "pos").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("ml").alias("sum_ml"),
        F.count_if(F.col("prob") >= 0.8).alias("n_high"))


@query
def reference_cpg_sites(spark, sf_dir):
    return reference.reference_cpg_sites(star.tiles(spark, sf_dir))


@query
def read_methyl_summary(spark, sf_dir):
    every = alignments_of(spark, sf_dir)
    return calls.read_methyl_summary(every, _all_calls(spark, sf_dir, every), PARAMS)


@query
def read_audit(spark, sf_dir):
    run = run_of(spark, sf_dir)
    counts = run.packed.select("region_id", "read_id", F.size("pos").cast("bigint").alias("n_sites"))
    return reads.read_audit(run.reads, run.alignments, counts, PARAMS)


# --- joins -------------------------------------------------------------------

@query
def region_reads(spark, sf_dir):
    run = lazy_run(spark, sf_dir)
    return run.reads.select("region_id", "read_id", "read_key", "qname", "chrom", "align_start",
                            "align_end", "mapq", "hp", "is_tumor", "alt_support")


@query
def region_calls(spark, sf_dir):
    return lazy_run(spark, sf_dir).cells


@query
def annotate_cpg(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return run.flags


@query
def gate_pmd(spark, sf_dir):
    run = run_of(spark, sf_dir)
    kept = matrix.gate_pmd(run.counts, run.flags)
    return matrix.numbered_matrix(run.packed, kept).select("region_id", "read_id", "pos", "ml")


@query
def region_status(spark, sf_dir):
    return run_of(spark, sf_dir).status.select(
        "region_id", "chrom", "win_start", "win_end", "success", "error_message")


@query
def read_pairs(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return distance.read_pairs(run.reads, run.gated)


@query
def label_reads(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return cluster.label_reads(given_labels(run), run.reads)


@query
def label_truth(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return assoc.label_truth(run.regions, star.truth(run.snvs)).select("region_id", "truth")


# --- matrices and aggregates -------------------------------------------------

@query
def region_matrix(spark, sf_dir):
    return run_of(spark, sf_dir).matrix.select("region_id", "read_id", "cpg_id", "pos", "prob")


@query
def region_matrix_wide(spark, sf_dir):
    run = run_of(spark, sf_dir)
    wide = matrix.packed_matrix_wide(run.reads, run.packed, run.counts)
    cell = F.transform("probs", lambda p: F.coalesce(
        F.floor(p * 255 + 0.5).cast("string"), F.lit("NA")))
    return wide.select("region_id", "read_id", F.size("positions").alias("n_sites"),
                       F.array_join(cell, ",").alias("levels"))


@query
def matrix_ref_columns(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return matrix.ref_columns(run.window_sites, run.counts)


@query
def binarize(spark, sf_dir):
    return run_of(spark, sf_dir).matrix.select("region_id", "read_id", "cpg_id", "bin")


@query
def gate_coverage(spark, sf_dir):
    return matrix.gate_coverage(run_of(spark, sf_dir).matrix, PARAMS).select(
        "region_id", "read_id", "pos", "ml")


@query
def drop_empty_reads(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return matrix.drop_empty_reads(run.reads, run.gated).select("region_id", "read_id")


@query
def matrix_stats(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return matrix.matrix_stats(run.result, run.cells)


@query
def region_result(spark, sf_dir):
    return run_of(spark, sf_dir).result


@query
def run_summary(spark, sf_dir):
    return run_of(spark, sf_dir).summary


@query
def region_extremes(spark, sf_dir):
    return report.region_extremes(run_of(spark, sf_dir).result).select(
        "measure", "min", "max", "median", "mean", r6(F.col("stddev")).alias("stddev"))


@query
def check_dimensions(spark, sf_dir):
    run = run_of(spark, sf_dir)
    # Gating changes the tables but not the reported counts, so mismatches do occur.
    gated = matrix.region_matrix(matrix.gate_coverage(run.cells, PARAMS))
    return report.check_dimensions(run.result, run.reads, gated)


@query
def site_asm(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return matrix.site_asm(run.cells, run.reads)


@query
def site_tumor_normal(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return matrix.site_tumor_normal(run.cells, run.reads)


# --- distances ---------------------------------------------------------------

def _distance_query(metric: str) -> Query:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        run = run_of(spark, sf_dir)
        if metric == "nhd_weighted":
            found = distance.pair_distances(
                run.reads, distance.site_weights(run.matrix, run.flags), metric, every=True)
        else:
            found = distance.list_distances(run.reads, run.gated_lists, metric, PARAMS, every=True)
        return found.select(
            "region_id", "read_i", "read_j", "n_common", r6(F.col("dist")).alias("dist"))
    fn.__name__ = f"dist_{metric}"
    return fn


for _metric in ("nhd", "l1", "l2", "corr", "jaccard", "nhd_weighted"):
    query(_distance_query(_metric))


@query
def fill_missing_pairs(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return distance.fill_missing_pairs(run.reads, run.distances, PARAMS).select(
        "region_id", "read_i", "read_j", r6(F.col("dist")).alias("dist"))


@query
def distance_matrix(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return distance.distance_matrix(run.reads, run.distances).select(
        "region_id", "read_id", F.array_join(F.transform("dist", lambda d: F.format_string(
            "%.6f", r6(d))), ",").alias("distances"))


# --- clusters ----------------------------------------------------------------

@query
def cluster_reads_upgma(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return cluster.cluster_reads(run.reads, run.distances, "upgma")


@query
def cluster_reads_ward(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return cluster.cluster_reads(run.reads, run.distances, "ward")


@query
def cut_height(spark, sf_dir):
    return cluster.cut_height(run_of(spark, sf_dir).leaves, 0.5)


@query
def cut_k(spark, sf_dir):
    return cluster.cut_k(run_of(spark, sf_dir).leaves, 3)


@query
def cut_silhouette(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return cluster.cut_silhouette(run.leaves, run.distances, [2, 3, 4, 5])


@query
def silhouette(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return cluster.silhouette(given_labels(run), run.distances).withColumn(
        "silhouette", r6(F.col("silhouette")))


@query
def newick(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return cluster.newick(run.reads, run.distances)


@query
def cluster_stats(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return cluster.cluster_stats(given_labels(run), run.reads)


@query
def methylation_entropy(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return cluster.methylation_entropy(given_labels(run), run.gated).withColumn(
        "entropy", r6(F.col("entropy")))


# --- association -------------------------------------------------------------

def _tables(run: RegionRun) -> DataFrame:
    return assoc.contingency(cluster.cluster_stats(given_labels(run), run.reads))


@query
def contingency(spark, sf_dir):
    return _tables(run_of(spark, sf_dir))


@query
def fisher_exact(spark, sf_dir):
    return assoc.fisher_exact(_tables(run_of(spark, sf_dir))).withColumns(
        {name: r6(F.col(name)) for name in ("p_value", "log10_p")})


@query
def chi_square(spark, sf_dir):
    return assoc.chi_square(_tables(run_of(spark, sf_dir))).withColumns(
        {name: r6(F.col(name)) for name in ("chi2", "p_value")})


@query
def chi_square_table(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return assoc.chi_square_table(given_labels(run), run.reads, "allele").select(
        "region_id", r6(F.col("chi2")).alias("chi2"), "dof",
        r6(F.col("p_value")).alias("p_value"))


@query
def fdr_bh(spark, sf_dir):
    tests = assoc.fisher_exact(_tables(run_of(spark, sf_dir)))
    return assoc.fdr_bh(tests).select("region_id", "cluster_id", "factor", *(
        r6(F.col(name)).alias(name) for name in ("p_value", "q_value")))


@query
def cluster_tests(spark, sf_dir):
    """From distances to tree, cut and association: tests of the three clusters of each region."""
    run = run_of(spark, sf_dir)
    stats = cluster.cluster_stats(cluster.cut_k(run.leaves, 3), run.reads)
    return assoc.fdr_bh(assoc.fisher_exact(assoc.contingency(stats))).withColumns(
        {name: r6(F.col(name)) for name in ("p_value", "log10_p", "q_value")})


@query
def cluster_agreement(spark, sf_dir):
    """Agreement of the three clusters of each region with haplotypes."""
    run = run_of(spark, sf_dir)
    labels = cluster.cut_k(run.leaves, 3)
    return assoc.adjusted_rand(labels, run.reads, "hp").join(
        assoc.nmi(labels, run.reads, "hp"), "region_id").select(
        "region_id", r6(F.col("ari")).alias("ari"), r6(F.col("nmi")).alias("nmi"))


@query
def adjusted_rand(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return assoc.adjusted_rand(given_labels(run), run.reads, "allele").select(
        "region_id", r6(F.col("ari")).alias("ari"))


@query
def nmi(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return assoc.nmi(given_labels(run), run.reads, "allele").select(
        "region_id", r6(F.col("nmi")).alias("nmi"))


@query
def label_distance_corr(spark, sf_dir):
    run = run_of(spark, sf_dir)
    return assoc.label_distance_corr(run.distances, run.reads, "hp").select(
        "region_id", "n_pairs", r6(F.col("corr")).alias("corr"))


@query
def truth_report(spark, sf_dir):
    run = run_of(spark, sf_dir)
    tests = assoc.fisher_exact(_tables(run))
    return assoc.truth_report(assoc.fdr_bh(tests.filter("factor = 'allele'")),
                              star.truth(run.snvs), run.live_regions)


@query
def correlation_by_truth(spark, sf_dir):
    """How well distance follows cluster labels in windows of true and of false variants."""
    run = run_of(spark, sf_dir)
    labels = cluster.cut_k(run.leaves, 3).join(run.reads.drop("hp"), ["region_id", "read_id"])
    corr = assoc.label_distance_corr(run.distances, labels.withColumn(
        "hp", F.least(F.col("cluster_id"), F.lit(2))), "hp").withColumn("corr", r6(F.col("corr")))
    return assoc.correlation_by_truth(corr, run.live_regions, star.truth(run.snvs))


# --- windows and set operations ----------------------------------------------

@query
def read_ids(spark, sf_dir):
    return lazy_run(spark, sf_dir).reads.select("region_id", "read_key", "read_id")


@query
def cpg_index(spark, sf_dir):
    return run_of(spark, sf_dir).counts.drop("n")


@query
def combine_samples(spark, sf_dir):
    every = alignments_of(spark, sf_dir)
    both = alignments.combine_samples(every.filter("is_tumor").drop("is_tumor"),
                                      every.filter("not is_tumor").drop("is_tumor"))
    return both.select("read_key", "qname", "chrom", "align_start", "is_tumor")
