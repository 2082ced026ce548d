"""From modified-base tags to methylation calls on reference CpG sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.functions import placement
from methylspark.operators.reads import REVERSE, drop_reason
from methylspark.params import Params


def cigar_blocks(alignments: DataFrame) -> DataFrame:
    """One row per gap-free aligned block: ``read_key, seq_start, ref_start, length``."""
    return alignments.select("read_key", "align_start", "cigar").mapInArrow(
        placement.place_blocks, placement.BLOCK_FIELDS)


def modified_bases(alignments: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per modified base: place in the read, place on the reference, raw probability.

    Cytosines are counted on the stored sequence, whatever the strand. With ``original_strand`` those
    of a reverse read are its stored G, counted from the end, and ``pos`` is that of the C before it
    on the reference, so that both strands of a site meet in one position.
    """
    return _decodable(alignments, params).mapInArrow(
        placement.place_modified_bases, placement.CALL_FIELDS)


def _decodable(alignments: DataFrame, params: Params, carry: Sequence[str] = ()) -> DataFrame:
    """What the kernels decode, with the columns ``carry``: CIGAR and tags as text, the code that is
    looked for, and whether deltas run from the read's end (``original_strand`` and a reverse read).

    Reads lacking the code, its deltas or enough probabilities have no bases there.
    """
    backward = F.col("flag").bitwiseAND(REVERSE) != 0 if params.original_strand else F.lit(False)
    return alignments.select(
        "read_key", "chrom", "align_start", "cigar", "seq", "mm", "ml", backward.alias("backward"),
        F.lit(params.mod_code).alias("code"), F.lit(params.compat_ml_offset).alias("compat"), *carry)


def calls_in_windows(alignments: DataFrame, windows: DataFrame,
                     params: Params = Params()) -> DataFrame:
    """Placed calls per read and window, as arrays of ``pos`` and ``ml``, in the pass that decodes.

    ``windows`` goes to every task, so its size must have been checked (``fits_broadcast``); calls
    outside of all windows never leave the task.
    """
    import numpy as np

    given = windows.select("chrom", "win_start", "win_end", "region_id").toPandas()
    chroms = {chrom: k for k, chrom in enumerate(given["chrom"].unique())}
    base = given["chrom"].map(chroms).to_numpy(np.int64) << 32
    starts, ends = (base + given[c].to_numpy(np.int64) for c in ("win_start", "win_end"))
    order = np.argsort(starts, kind="stable")
    shared = windows.sparkSession.sparkContext.broadcast(
        (chroms, starts[order], ends[order], given["region_id"].to_numpy(np.int64)[order]))
    return _decodable(alignments, params).mapInArrow(
        placement.place_in_windows(shared), placement.WINDOW_FIELDS)


def calls_in_own_windows(alignments: DataFrame, reads: DataFrame,
                         params: Params = Params()) -> DataFrame:
    """The same, with ``read_id``, for windows of any number: each read meets those it is in.

    ``reads`` (pairs of reads and windows) become one narrow row per read; the alignments are shuffled
    once, and calls outside of a read's windows never leave the task that decodes it.
    """
    names = ("win_start", "win_end", "region_id", "read_id")
    mine = reads.groupBy("read_key").agg(F.collect_list(F.struct(*names)).alias("w")).select(
        "read_key", *(F.col(f"w.{c}").alias(c) for c in names))
    return _decodable(alignments.join(mine, "read_key"), params, names).mapInArrow(
        placement.place_in_own_windows, placement.OWN_WINDOW_FIELDS)


def project_calls(bases: DataFrame) -> DataFrame:
    """Bases with a reference position; those in insertions and clips vanish."""
    return bases.filter("pos is not null").select("read_key", "chrom", "pos", "ml")


def validate_cpg(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls whose reference position is the C of a CG."""
    return calls.join(sites.select("chrom", "pos"), ["chrom", "pos"], "left_semi") \
        .select("read_key", "chrom", "pos", "ml")


#: Width of the bins that calls and sites are joined on as arrays.
SITE_BIN_BP = 512


def methylation_calls(alignments: DataFrame, sites: DataFrame,
                      params: Params = Params()) -> DataFrame:
    """Validated calls with ``prob = ml / 255``; each read is decoded once.

    Calls of a read in a bin of the reference are one row that meets the bin's sites, and become rows
    only once they are validated.
    """
    packed = _decodable(alignments, params).mapInArrow(
        placement.place_in_bins(SITE_BIN_BP), placement.BIN_FIELDS)
    # Sites as bits, 64 to a word; they are no more than the reference, so calls are looked up without a sort.
    words = [F.expr(f"coalesce(bit_or(case when pos % {SITE_BIN_BP} div 64 = {k} then "
                    f"shiftleft(1L, pos % {SITE_BIN_BP} % 64) end), 0L)").alias(f"w{k}")
             for k in range(-(-SITE_BIN_BP // 64))]
    of_bin = sites.groupBy("chrom", F.expr(f"cast(pos div {SITE_BIN_BP} as int)").alias("bin")).agg(*words)
    calls = packed.join(of_bin.hint("shuffle_hash"), ["chrom", "bin"]).mapInArrow(
        placement.keep_on_bin_sites(SITE_BIN_BP), placement.CHECKED_FIELDS)
    return calls.withColumn("prob", F.col("ml") / F.lit(255.0))


def read_methyl_summary(alignments: DataFrame, calls: DataFrame,
                        params: Params = Params()) -> DataFrame:
    """Reads seen, kept and with calls, total calls, calls per read with calls."""
    reads = alignments.agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.count_if(drop_reason(params).isNull()).alias("n_kept"))
    per_read = calls.groupBy("read_key").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("n_with_calls"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_calls"))
    both = reads.select(F.lit(1).alias("_one"), "*").join(
        per_read.select(F.lit(1).alias("_one"), "*"), "_one").drop("_one")
    return both.withColumn("calls_per_read", F.try_divide("n_calls", "n_with_calls"))
