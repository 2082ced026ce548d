"""Read filters, labels and the region x read join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methylspark.functions import cigar as cg
from methylspark.operators.intervals import fits_broadcast, overlap_join
from methylspark.operators.ranking import dense_row_number
from methylspark.params import Params

# SAM flag bits.
UNMAPPED, REVERSE, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x400, 0x800

# Read state bits.
STATE_TUMOR, STATE_HP1, STATE_HP2, STATE_ALT, STATE_REF, STATE_UNKNOWN = 1, 2, 4, 8, 16, 32


def _has_flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0


def drop_reason(params: Params) -> Column:
    """Name of the first check a read fails, null when it passes all."""
    reason = (F.when(_has_flag(SECONDARY), "secondary")
              .when(_has_flag(SUPPLEMENTARY), "supplementary")
              .when(_has_flag(DUPLICATE), "duplicate")
              .when(_has_flag(UNMAPPED), "unmapped")
              .when(F.col("mapq") < params.min_mapq, "low_mapq")
              .when(cg.query_length(F.col("cigar")) < params.min_read_length, "short"))
    if params.require_mm_ml:
        reason = reason.when(F.col("mm").isNull() | F.col("ml").isNull(), "no_mm_ml")
    return reason


def well_mapped(params: Params = Params()) -> Column:
    """The part of the checks that ``flag`` and ``mapq`` decide."""
    bits = UNMAPPED | SECONDARY | DUPLICATE | SUPPLEMENTARY
    return (F.col("flag").bitwiseAND(bits) == 0) & (F.col("mapq") >= params.min_mapq)


def filter_reads(alignments: DataFrame, params: Params = Params()) -> DataFrame:
    """Primary, mapped, unique reads that pass quality, length and tag checks."""
    kept = alignments.filter(well_mapped(params))
    if params.require_mm_ml:
        kept = kept.filter(F.col("mm").isNotNull() & F.col("ml").isNotNull())
    return kept.filter(cg.query_length(F.col("cigar")) >= params.min_read_length)


def filter_reasons(alignments: DataFrame, params: Params = Params()) -> DataFrame:
    """Reads per outcome of the checks, taken in their order."""
    return (alignments.select(F.coalesce(drop_reason(params), F.lit("kept")).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_reads")))


def cigar_lengths(alignments: DataFrame) -> DataFrame:
    c = F.col("cigar")
    return alignments.withColumn("query_length", cg.query_length(c)).withColumn(
        "align_end", cg.reference_end(c, F.col("align_start")))


def read_info(alignments: DataFrame) -> DataFrame:
    """Label columns of a read; an absent haplotype tag becomes 0."""
    return alignments.select(
        "read_key", "qname", "chrom", "align_start",
        cg.reference_end(F.col("cigar"), F.col("align_start")).alias("align_end"),
        "mapq", F.coalesce("hp", F.lit(0)).alias("hp"), "ps", "is_tumor")


def alt_support_at(min_base_quality: int) -> tuple[Column, Column, Column]:
    """Offset, base and verdict at ``pos`` for one read x variant row.

    The latter two refer to a column ``_offset`` that holds the first. ALT is
    compared before REF; absent qualities pass.
    """
    # A read that begins behind the variant is not taken apart.
    offset = F.when(F.col("pos") <= F.col("align_start"), -1).otherwise(
        cg.aligned_offset(F.col("cigar"), F.col("align_start"), F.col("pos") - 1))
    at = F.col("_offset")
    base = F.substring(F.col("seq"), at + 1, F.lit(1))
    low = (F.col("qual") != "*") & (
        F.ascii(F.substring(F.col("qual"), at + 1, F.lit(1))) - 33 < min_base_quality)
    verdict = (F.when((at < 0) | low, "UNKNOWN").when(base == F.col("alt"), "ALT")
               .when(base == F.col("ref"), "REF").otherwise("UNKNOWN"))
    return offset, base, verdict


def alt_support(pairs: DataFrame, min_base_quality: int = 20) -> DataFrame:
    """Attach ``alt_support`` to rows that hold a read and its anchor variant."""
    offset, _, verdict = alt_support_at(min_base_quality)
    return pairs.withColumn("_offset", offset).withColumn("alt_support", verdict).drop("_offset")


def read_state(reads: DataFrame) -> DataFrame:
    """Bit mask of sample, haplotype and allele support."""
    def bit(cond: Column, value: int) -> Column:
        return F.when(cond, value).otherwise(0)

    return reads.withColumn("state_bits", (
        bit(F.col("is_tumor"), STATE_TUMOR)
        .bitwiseOR(bit(F.col("hp") == 1, STATE_HP1)).bitwiseOR(bit(F.col("hp") == 2, STATE_HP2))
        .bitwiseOR(bit(F.col("alt_support") == "ALT", STATE_ALT))
        .bitwiseOR(bit(F.col("alt_support") == "REF", STATE_REF))
        .bitwiseOR(bit(F.col("alt_support") == "UNKNOWN", STATE_UNKNOWN))).cast("int"))


def overlapping_reads(alignments: DataFrame, regions: DataFrame,
                      params: Params = Params()) -> DataFrame:
    """Kept reads per region window, with allele support but without ``read_id``.

    A window table of checked size is copied to the executors, and the alignments are then never
    shuffled. Beyond that size they go once through the (salted) interval join with the bases and
    qualities, which are looked at behind it.
    """
    windows = regions.select("region_id", "chrom", "win_start", "win_end", "pos", "ref", "alt")
    kept = filter_reads(alignments, params)
    payload = ["cigar", "seq", "qual"]
    spans = kept.select(
        "read_key", "qname", "chrom", "align_start",
        cg.reference_end(F.col("cigar"), F.col("align_start")).alias("align_end"), "mapq",
        F.coalesce("hp", F.lit(0)).alias("hp"), "ps", "is_tumor",
        (F.col("align_start") + 1).alias("_lo"), *payload)
    pairs = overlap_join(spans, windows, ("_lo", "align_end"), ("win_start", "win_end"),
                         "read_key", copy_right=fits_broadcast(windows)).drop("_lo")
    return alt_support(pairs, params.min_base_quality).drop(*payload)


def read_ids(pairs: DataFrame, largest: int | None = None) -> DataFrame:
    """``read_id``: rank of a kept read in file order within its region.

    ``largest`` is the size of the largest region, where it is known.
    """
    return dense_row_number(pairs, ["region_id"], ["align_start", "read_key"], "read_id",
                            largest=largest)


def region_reads(alignments: DataFrame, regions: DataFrame,
                 params: Params = Params()) -> DataFrame:
    """Kept reads per region with ``read_id`` and allele support."""
    return read_ids(overlapping_reads(alignments, regions, params))


def phase_set_check(reads: DataFrame, min_share: float = 0.9) -> DataFrame:
    """Majority phase set per region and whether its share suffices."""
    counts = reads.filter("ps is not null").groupBy("region_id", "ps").agg(
        F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("region_id").agg(
        F.sum("n").alias("n_phased"),
        F.max(F.struct(F.col("n"), (-F.col("ps")).alias("neg"))).alias("m"))
    share = F.col("m.n") / F.col("n_phased")
    return best.select(
        "region_id", (-F.col("m.neg")).cast("int").alias("major_ps"), "n_phased",
        share.alias("share"),
        F.when(share >= min_share, "OK").otherwise("AMBIGUOUS_PHASE").alias("status"))


def keep_major_phase(reads: DataFrame, checks: DataFrame) -> DataFrame:
    """Reads of each region's majority phase set."""
    return reads.join(checks.select("region_id", F.col("major_ps").alias("ps")),
                      ["region_id", "ps"], "left_semi")


def read_audit(pairs: DataFrame, alignments: DataFrame, site_counts: DataFrame,
               params: Params = Params()) -> DataFrame:
    """Trace of each read: CIGAR, offset, base, quality, verdict, number of sites."""
    offset, base, verdict = alt_support_at(params.min_base_quality)
    at = F.col("_offset")
    quality = F.when((at >= 0) & (F.col("qual") != "*"),
                     F.ascii(F.substring(F.col("qual"), at + 1, F.lit(1))) - 33)
    payload = alignments.select("read_key", "cigar", "seq", "qual")
    traced = pairs.drop("alt_support").join(payload, "read_key").withColumn("_offset", offset)
    return traced.join(site_counts, ["region_id", "read_id"], "left").select(
        "region_id", "read_id", "qname", "cigar", at.alias("snv_offset"),
        F.when(at >= 0, base).alias("base"), quality.cast("int").alias("base_quality"),
        verdict.alias("alt_support"), F.coalesce("n_sites", F.lit(0)).alias("n_sites"))
