"""Read x CpG matrices in long form: an absent row is an uncovered cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methylspark.functions import placement
from methylspark.params import Params


#: Width of the bins that calls and windows of a read are joined on.
CALL_BIN_BP = 1024
#: Width of the bins in which windows find their reference sites.
SITE_BIN_BP = 256


def _checked(cells: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Cells on ``sites``, looked at after most calls have dropped out by position."""
    if sites is None:
        return cells
    return cells.join(sites.select("chrom", "pos"), ["chrom", "pos"],
                      "left_semi").select(*cells.columns)


def _meetings(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls with the windows of their read that touch their bin."""
    bins = F.expr(f"explode(sequence(win_start div {CALL_BIN_BP}, win_end div {CALL_BIN_BP}))")
    keys = reads.select("region_id", "read_id", "read_key", "win_start", "win_end",
                        bins.alias("_bin"))
    binned = calls.drop("prob").withColumn("_bin", F.expr(f"pos div {CALL_BIN_BP}"))
    return keys.join(binned, ["read_key", "_bin"])


def region_calls(reads: DataFrame, calls: DataFrame,
                 sites: DataFrame | None = None) -> DataFrame:
    """Calls inside the window of each region their read belongs to.

    The outermost bases of a window carry no call, since the base after a site
    must lie in the window too and fetched bases start one past ``win_start``.
    Calls not yet validated are checked against ``sites`` here. A call meets only the windows
    of its read that touch its bin, so a read with many windows does not multiply its calls.
    """
    cells = _meetings(reads, calls).filter(
        (F.col("pos") > F.col("win_start")) & (F.col("pos") < F.col("win_end"))
    ).select("region_id", "read_id", "read_key", "chrom", "pos", "ml")
    return _checked(cells, sites)


def window_cells(reads: DataFrame, found: DataFrame,
                 sites: DataFrame | None = None) -> DataFrame:
    """The same cells from ``calls_in_windows``: one row per read and window is joined, not per call."""
    return own_window_cells(reads.select("region_id", "read_id", "read_key").join(
        found, ["region_id", "read_key"]), sites)


def own_window_cells(found: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """The same cells from ``calls_in_own_windows``, which has the number of each read already."""
    cells = found.select("region_id", "read_id", "read_key", "chrom",
                         F.inline(F.arrays_zip("pos", "ml")))
    return _checked(cells, sites)


def site_bins(sites: DataFrame) -> DataFrame:
    """Sites ``(chrom, pos)`` as arrays, one per bin (as ``cpg_site_bins`` finds them)."""
    return sites.groupBy("chrom", F.expr(f"cast((pos - 1) div {SITE_BIN_BP} as int)").alias("bin")).agg(
        F.collect_set("pos").alias("sites"))


def window_sites(windows: DataFrame, bins: DataFrame) -> DataFrame:
    """The sites strictly inside each window that has one, as a sorted array, from ``site_bins``."""
    return windows.select("region_id", "chrom", "win_start", "win_end", F.explode(F.sequence(*(
        F.expr(f"cast(({edge} - 1) div {SITE_BIN_BP} as int)") for edge in ("win_start", "win_end")))).alias(
        "bin")).join(bins, ["chrom", "bin"]).select("region_id", "chrom", F.filter("sites", lambda s: (
            s > F.col("win_start")) & (s < F.col("win_end"))).alias("sites")).filter(
        F.size("sites") > 0).groupBy("region_id", "chrom").agg(
        F.sort_array(F.flatten(F.collect_list("sites"))).alias("sites"))


def packed_on_sites(found: DataFrame, mine: DataFrame) -> DataFrame:
    """Cells on the sites of their window (``mine``, of ``window_sites``) from calls per read and window
    (arrays ``pos`` and ``ml``, with ``read_id``), as arrays again: calls are never rows."""
    return found.join(mine.select("region_id", "sites"), "region_id").select(
        "region_id", "read_id", "read_key", "chrom", "pos", "ml", "sites").mapInArrow(
        placement.pack_on_sites, placement.PACKED_FIELDS)


def unpacked(packed: DataFrame) -> DataFrame:
    """One row per cell."""
    return packed.select("region_id", "read_id", "read_key", "chrom",
                         F.inline(F.arrays_zip("pos", "ml")))


def cells_on_sites(found: DataFrame, windows: DataFrame, sites: DataFrame) -> DataFrame:
    """The cells of ``packed_on_sites`` as rows, from windows and sites."""
    return unpacked(packed_on_sites(found, window_sites(windows, site_bins(sites))))


def site_counts(cells: DataFrame) -> DataFrame:
    """``cpg_index`` with the number of reads that cover each site, ``n``."""
    sites = cells.groupBy("region_id", "chrom", "pos").agg(F.count(F.lit(1)).alias("n"))
    # A region has at most one row per window position here, however many reads it has.
    by_pos = Window.partitionBy("region_id").orderBy("pos")
    return sites.withColumn("cpg_id", F.row_number().over(by_pos) - 1)


def cpg_index(cells: DataFrame) -> DataFrame:
    """Sites seen per region with their 0-based rank by position."""
    return site_counts(cells).drop("n")


def region_matrix(cells: DataFrame) -> DataFrame:
    """Long matrix ``region_id, read_id, cpg_id, chrom, pos, ml, prob``."""
    ranked = cpg_index(cells).select("region_id", "pos", "cpg_id")
    return cells.join(ranked, ["region_id", "pos"]).select(
        "region_id", "read_id", "cpg_id", "chrom", "pos", "ml",
        (F.col("ml") / F.lit(255.0)).alias("prob"))


def _numbered_sites(counts: DataFrame) -> DataFrame:
    """Per region its sites and their numbers as arrays."""
    return counts.groupBy("region_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "cpg_id"))).alias("s")).select(
        "region_id", F.col("s.pos").alias("sites"), F.col("s.cpg_id").alias("cpg_ids"))


def numbered_lists(packed: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``numbered_matrix`` as lists, one row per read that has one: cells are never rows."""
    return packed.join(_numbered_sites(counts), "region_id").select(
        "region_id", "read_id", "pos", "ml", "sites", "cpg_ids").mapInArrow(
        placement.number_lists_on_sites, placement.LIST_FIELDS)


def numbered_matrix(packed: DataFrame, counts: DataFrame) -> DataFrame:
    """The long matrix from packed cells, on the sites of ``counts`` (of ``site_counts``, or those that
    a gate has left): a region brings its sites as arrays, so no cell is shuffled as a row."""
    mine = _numbered_sites(counts)
    cells = packed.join(mine, "region_id").select(
        "region_id", "read_id", "chrom", "pos", "ml", "sites", "cpg_ids").mapInArrow(
        placement.number_on_sites, placement.NUMBERED_FIELDS)
    return cells.select("region_id", "read_id", "cpg_id", "chrom", "pos", "ml",
                        (F.col("ml") / F.lit(255.0)).alias("prob"))


def gated_counts(counts: DataFrame, params: Params, flags: DataFrame | None = None) -> DataFrame:
    """The sites of ``site_counts`` that pass the coverage gate and, with ``flags``, the PMD gate."""
    kept = counts.filter(F.col("n") >= params.min_site_coverage)
    return kept if flags is None else gate_pmd(kept, flags)


def region_matrix_wide(reads: DataFrame, matrix: DataFrame) -> DataFrame:
    """One ARRAY<DOUBLE> per kept read, aligned to ``positions``; null = uncovered."""
    columns = matrix.select("region_id", "cpg_id", "pos").distinct().groupBy("region_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cpg_id", "pos"))),
                    lambda s: s["pos"]).alias("positions"))
    rows = matrix.groupBy("region_id", "read_id").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "prob"))).alias("_cells"))
    return _wide(reads, rows, columns)


def _wide(reads: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    none = F.array().cast("array<int>")
    return (reads.select("region_id", "read_id")
            .join(rows, ["region_id", "read_id"], "left")
            .join(columns, "region_id", "left")
            .withColumn("positions", F.coalesce("positions", none))
            .select("region_id", "read_id", "positions",
                    F.transform("positions", lambda p: F.try_element_at("_cells", p))
                    .alias("probs")))


def packed_matrix_wide(reads: DataFrame, packed: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from packed cells, of which there is one row per read, and ``site_counts``."""
    columns = counts.groupBy("region_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    probs = F.transform("ml", lambda v: v / F.lit(255.0))
    rows = packed.select("region_id", "read_id", F.map_from_arrays("pos", probs).alias("_cells"))
    return _wide(reads, rows, columns)


def matrix_ref_columns(cells: DataFrame, regions: DataFrame, sites: DataFrame) -> DataFrame:
    """Variant whose columns are all reference CpGs of the window, seen or not."""
    return ref_columns(window_sites(regions, site_bins(sites)),
                       cells.groupBy("region_id", "pos").agg(F.count(F.lit(1)).alias("n")))


def ref_columns(mine: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from ``window_sites`` and ``site_counts``: a window's sites are one sorted array, so a
    column's number is its place there."""
    columns = mine.select("region_id", "chrom", F.posexplode("sites").alias("cpg_id", "pos"))
    seen = counts.select("region_id", "pos", F.col("n").alias("n_reads"))
    return columns.join(seen, ["region_id", "pos"], "left").select(
        "region_id", "cpg_id", "chrom", "pos", F.coalesce("n_reads", F.lit(0)).alias("n_reads"))


def binary_state(params: Params = Params(), prob: Column | None = None) -> Column:
    prob = F.col("prob") if prob is None else prob
    return F.when(prob >= params.methyl_high, 1).when(prob <= params.methyl_low, 0)


def binarize(matrix: DataFrame, params: Params = Params()) -> DataFrame:
    """Add ``bin``: 1 methylated, 0 unmethylated, null in between."""
    return matrix.withColumn("bin", binary_state(params).cast("int"))


def gate_coverage(matrix: DataFrame, params: Params = Params()) -> DataFrame:
    """Keep sites that enough reads of the region cover."""
    covered = matrix.groupBy("region_id", "pos").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= params.min_site_coverage).select("region_id", "pos")
    return matrix.join(covered, ["region_id", "pos"], "left_semi").select(*matrix.columns)


def gate_pmd(matrix: DataFrame, flags: DataFrame) -> DataFrame:
    """Drop sites inside partially methylated domains (``flags`` from ``annotate_cpg``)."""
    inside = flags.filter("in_pmd").select("chrom", "pos")
    return matrix.join(inside, ["chrom", "pos"], "left_anti").select(*matrix.columns)


def gated_matrix(cells: DataFrame, params: Params, flags: DataFrame | None = None) -> DataFrame:
    """``binarize(gate_coverage(gate_pmd(region_matrix(cells))))``, with both gates decided per site:
    cells are joined once, with the numbers of the sites that stay."""
    sites = gated_counts(site_counts(cells), params, flags)
    kept = cells.join(sites.select("region_id", "pos", "cpg_id"), ["region_id", "pos"]).select(
        "region_id", "read_id", "cpg_id", "chrom", "pos", "ml",
        (F.col("ml") / F.lit(255.0)).alias("prob"))
    return binarize(kept, params)


def drop_empty_reads(reads: DataFrame, matrix: DataFrame) -> DataFrame:
    """Reads that still have a site."""
    return reads.join(matrix.select("region_id", "read_id").distinct(),
                      ["region_id", "read_id"], "left_semi").select(*reads.columns)


def region_result(status: DataFrame, reads: DataFrame, cells: DataFrame) -> DataFrame:
    """Reads and CpGs per region; a region without reads is a success with zeros."""
    n_reads = reads.groupBy("region_id").agg(F.count(F.lit(1)).alias("num_reads"))
    n_cpgs = cells.select("region_id", "pos").distinct().groupBy("region_id").agg(
        F.count(F.lit(1)).alias("num_cpgs"))
    return (status.join(n_reads, "region_id", "left").join(n_cpgs, "region_id", "left")
            .select("region_id", "snv_id", F.coalesce("num_reads", F.lit(0)).alias("num_reads"),
                    F.coalesce("num_cpgs", F.lit(0)).alias("num_cpgs"), "success",
                    "error_message"))


def matrix_stats(result: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells without value, zero and non-zero per region, and the share without."""
    filled = cells.groupBy("region_id").agg(
        F.count_if(F.col("ml") == 0).alias("zero_cells"),
        F.count_if(F.col("ml") > 0).alias("nonzero_cells"))
    zero, nonzero = (F.coalesce(c, F.lit(0)) for c in ("zero_cells", "nonzero_cells"))
    total = F.col("num_reads") * F.col("num_cpgs")
    return result.filter("success").join(filled, "region_id", "left").select(
        "region_id", total.alias("cells"), (total - zero - nonzero).alias("na_cells"),
        zero.alias("zero_cells"), nonzero.alias("nonzero_cells"),
        F.try_divide((total - zero - nonzero) * F.lit(100.0), total).alias("sparsity_pct"))


def _contrast(cells: DataFrame, first: Column, second: Column, a: str, b: str) -> DataFrame:
    def mean(cond):
        return F.try_divide(F.sum(F.when(cond, F.col("ml").cast("bigint"))),
                            F.count_if(cond) * F.lit(255.0))

    return cells.groupBy("region_id", "pos").agg(
        F.count_if(first).alias(f"n_{a}"), F.count_if(second).alias(f"n_{b}"),
        mean(first).alias(f"mean_{a}"), mean(second).alias(f"mean_{b}"),
    ).withColumn("diff", F.col(f"mean_{a}") - F.col(f"mean_{b}"))


def _labelled(cells: DataFrame, reads: DataFrame, *labels: str) -> DataFrame:
    return cells.join(reads.select("region_id", "read_id", *labels), ["region_id", "read_id"])


def site_asm(cells: DataFrame, reads: DataFrame) -> DataFrame:
    """Mean methylation of both haplotypes per region and site, and the difference."""
    return _contrast(_labelled(cells, reads, "hp"), F.col("hp") == 1, F.col("hp") == 2,
                     "hp1", "hp2")


def site_tumor_normal(cells: DataFrame, reads: DataFrame) -> DataFrame:
    """The same contrast for tumor against normal reads."""
    return _contrast(_labelled(cells, reads, "is_tumor"), F.col("is_tumor"),
                     ~F.col("is_tumor"), "tumor", "normal")
