"""The whole analysis as one lazy plan: variants and reads to matrices and results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.functions.cigar import reference_end
from methylspark.operators import calls as calls_ops
from methylspark.operators import matrix as matrix_ops
from methylspark.operators import reads as reads_ops
from methylspark.operators import report
from methylspark.operators.cluster import cluster_reads
from methylspark.operators.distance import known_pairs, list_distances
from methylspark.operators.intervals import classes_at, fits_broadcast, in_touched_bins
from methylspark.operators.ranking import largest_group
from methylspark.operators.regions import make_regions, region_status
from methylspark.params import Params
from methylspark.plans.staging import keep_lazy
from methylspark.sources import reference


@dataclass
class RegionRun:
    """Tables of a run over ``snvs``, ``alignments`` and ``contigs``.

    Each property is a DataFrame. A ``Store`` writes the tables that several later
    steps read (windows, read pairs, cells, gated matrix, distances) when they are
    first asked for; with the default ``store`` the analysis stays one plan, and
    only the sizes of the window table are looked at beforehand.

    Alignments are scanned twice, once for the read x window pairs and once to
    decode the reads near a window, and shuffled in neither pass when the windows
    fit a broadcast. Each read is decoded once however many windows it spans, and
    only reference tiles under a window are searched for CpG sites.
    """

    snvs: DataFrame
    alignments: DataFrame
    #: Whole contigs ``(chrom, seq)``, or null where ``tiles`` are given.
    contigs: DataFrame | None
    params: Params = Params()
    annotation: DataFrame | None = None
    #: The reference as tiles (``load_fasta_tiles``), so that no contig is ever one row.
    tiles: DataFrame | None = None
    #: Where to cut the plan: called with a name and a table that later steps share.
    store: Callable[[str, DataFrame], DataFrame] = keep_lazy

    @cached_property
    def regions(self) -> DataFrame:
        return make_regions(self.snvs, self.params.window)

    @cached_property
    def status(self) -> DataFrame:
        lengths = (reference.contig_lengths(self.contigs) if self.tiles is None
                   else reference.tile_lengths(self.tiles))
        return region_status(self.regions, lengths)

    @cached_property
    def live_regions(self) -> DataFrame:
        return self.store("live_regions", self.status.filter("success"))

    @cached_property
    def overlaps(self) -> DataFrame:
        """Kept read x region pairs with allele support."""
        return self.store("overlaps", reads_ops.overlapping_reads(
            self.alignments, self.live_regions, self.params))

    @cached_property
    def ambiguous(self) -> DataFrame | None:
        """With the phase gate: windows whose reads are of several phase sets."""
        if not self.params.phase_gate:
            return None
        checks = reads_ops.phase_set_check(self.overlaps, self.params.min_phase_share)
        return self.store("ambiguous", checks.filter("status <> 'OK'").select("region_id", "status"))

    @cached_property
    def outcome(self) -> DataFrame:
        """``status``, with the windows that a gate has skipped as failures."""
        if self.ambiguous is None:
            return self.status
        marked = self.status.join(self.ambiguous.withColumnRenamed("status", "_gate"), "region_id",
                                  "left")
        return marked.withColumn("success", F.col("success") & F.col("_gate").isNull()).withColumn(
            "error_message", F.coalesce("_gate", "error_message")).select(*self.status.columns)

    @cached_property
    def reads(self) -> DataFrame:
        """The pairs with ``read_id``, without those of skipped windows."""
        kept = self.overlaps
        written = self.store is not keep_lazy
        largest = largest_group(kept, ["region_id"]) if written else None
        if self.ambiguous is not None:
            kept = kept.join(self.ambiguous, "region_id", "left_anti")
        return self.store("reads", reads_ops.read_ids(kept, largest))

    @cached_property
    def sites(self) -> DataFrame:
        tiles = reference.tile_reference(self.contigs) if self.tiles is None else self.tiles
        return reference.reference_cpg_sites(
            reference.tiles_of_regions(tiles, self.live_regions))

    @cached_property
    def window_sites(self) -> DataFrame:
        """The CpG sites inside each window as an array; sites are found as arrays and never rows."""
        tiles = reference.tile_reference(self.contigs) if self.tiles is None else self.tiles
        bins = reference.cpg_site_bins(
            reference.tiles_near_regions(tiles, self.live_regions), matrix_ops.SITE_BIN_BP)
        return self.store("window_sites", matrix_ops.window_sites(self.live_regions, bins))

    @cached_property
    def _near(self) -> DataFrame:
        """Kept alignments near a window."""
        kept = reads_ops.filter_reads(self.alignments, self.params).withColumn(
            "_end", reference_end(F.col("cigar"), F.col("align_start")))
        return in_touched_bins(kept, self.live_regions, ("align_start", "_end"),
                               ("win_start", "win_end"))

    @cached_property
    def packed(self) -> DataFrame:
        """Calls on CpG sites, one row per read and window with arrays of them. Windows of a checked size are looked up while
        reads are decoded; beyond that, each read is joined with the windows it is in before it is
        decoded. Calls outside of windows are never rows."""
        windows = self.live_regions.select("region_id", "chrom", "win_start", "win_end")
        if fits_broadcast(windows):
            found = calls_ops.calls_in_windows(self._near, windows, self.params)
            found = self.reads.select("region_id", "read_id", "read_key").join(
                found, ["region_id", "read_key"])
        else:
            kept = reads_ops.filter_reads(self.alignments, self.params)
            found = calls_ops.calls_in_own_windows(kept, self.reads, self.params)
        return self.store("packed", matrix_ops.packed_on_sites(found, self.window_sites))

    @cached_property
    def cells(self) -> DataFrame:
        """The same, one row per call."""
        return matrix_ops.unpacked(self.packed)

    @cached_property
    def counts(self) -> DataFrame:
        """Sites seen per region, with their number and the reads that cover them."""
        return self.store("counts", matrix_ops.site_counts(self.cells))

    @cached_property
    def matrix(self) -> DataFrame:
        return matrix_ops.binarize(
            matrix_ops.numbered_matrix(self.packed, self.counts), self.params)

    @cached_property
    def flags(self) -> DataFrame:
        """Annotation flags of the sites in the matrix."""
        if self.annotation is None:
            raise ValueError("no annotation given")
        return classes_at(self.counts, self.annotation)

    @cached_property
    def _gated_counts(self) -> DataFrame:
        covered = matrix_ops.gated_counts(self.counts, self.params)
        if self.annotation is None or not self.params.pmd_gating:
            return covered
        # Only sites that are still there are looked up in the annotation.
        return matrix_ops.gate_pmd(covered, classes_at(covered, self.annotation))

    @cached_property
    def gated(self) -> DataFrame:
        """Matrix after PMD gating (when an annotation is given) and coverage gating."""
        return self.store("gated", matrix_ops.binarize(
            matrix_ops.numbered_matrix(self.packed, self._gated_counts), self.params))

    @cached_property
    def gated_lists(self) -> DataFrame:
        """The same cells as lists, one row per read and window, for distances."""
        return self.store("gated_lists", matrix_ops.numbered_lists(self.packed, self._gated_counts))

    @cached_property
    def result(self) -> DataFrame:
        return matrix_ops.region_result(self.outcome, self.reads, self.counts)

    @cached_property
    def summary(self) -> DataFrame:
        return report.run_summary(self.result)

    @cached_property
    def distances(self) -> DataFrame:
        """Known pairs only; what the others count as stays implied."""
        raw = list_distances(self.reads, self.gated_lists, self.params.metric, self.params)
        return self.store("distances", known_pairs(raw, self.params))

    @cached_property
    def leaves(self) -> DataFrame:
        """Dendrogram of each region under average linkage."""
        return self.store("leaves", cluster_reads(self.reads, self.distances))
