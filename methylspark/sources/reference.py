"""Reference sequence as fixed-width tiles that an equi-join can address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.functions import placement
from methylspark.operators.intervals import fits_broadcast
from methylspark.operators.ranking import running_sum
from methylspark.sources.variants import read_lines

TILE_BP = 4096


def load_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(chrom, seq)``, one row per FASTA record; line breaks are removed."""
    records = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    return records.select(F.split(F.trim(head), r"\s+")[0].alias("chrom"),
                          F.regexp_replace(body, r"\s", "").alias("seq"))


def tile_reference(contigs: DataFrame, tile: int = TILE_BP, overlap: int = 1) -> DataFrame:
    """Uppercase tiles ``(chrom, tile, tile_start, core, seq)``.

    ``seq`` runs ``overlap`` bases past the ``core`` bases the tile stands for;
    contigs without sequence give no tile. A contig is cut in one linear pass.
    """
    if not 0 <= overlap <= tile:
        raise ValueError("overlap must lie between 0 and the tile width")
    cut = F.regexp_extract_all(F.upper("seq"), F.lit("(?s).{1,%d}" % tile), F.lit(0))
    pieces = F.transform("cut", lambda piece, i: F.struct(
        piece.alias("piece"),
        F.substring(F.coalesce(F.get("cut", i + 1), F.lit("")), 1, overlap).alias("next")))
    return (contigs.select("chrom", cut.alias("cut"))
            .select("chrom", F.posexplode(pieces).alias("tile", "p"))
            .select("chrom", "tile", (F.col("tile") * tile).alias("tile_start"),
                    F.length("p.piece").alias("core"),
                    F.concat("p.piece", "p.next").alias("seq")))


def load_fasta_tiles(spark: SparkSession, path: str, tile: int = TILE_BP,
                     overlap: int = 1) -> DataFrame:
    """The same tiles straight from FASTA lines, without a contig ever being one row.

    Running sums over the lines give each line its contig and its offset there;
    lines are then cut at tile borders and put together per tile.
    """
    lines = read_lines(spark, path).withColumn(
        "head", F.when(F.col("value").startswith(">"), 1).otherwise(0))
    numbered = running_sum(lines, [], "ord", "head", "contig")
    names = numbered.filter("head = 1").select("contig", F.split(
        F.substring(F.col("value"), F.lit(2), F.length("value")), r"\s+")[0].alias("chrom"))
    bases = numbered.filter("head = 0").select(
        "contig", "ord", F.upper(F.regexp_replace("value", r"\s", "")).alias("line"))
    bases = running_sum(bases.withColumn("n", F.length("line")).filter("n > 0"),
                        ["contig"], "ord", "n", "upto").withColumn(
        "from", F.col("upto") - F.col("n"))
    parts = bases.withColumn("tile", F.explode(F.sequence(
        F.greatest(F.lit(0), F.expr(f"(from - {overlap}) div {tile}")),
        F.expr(f"(upto - 1) div {tile}"))))
    lo = F.greatest("from", F.col("tile") * tile)
    hi = F.least("upto", F.col("tile") * tile + (tile + overlap))
    parts = parts.withColumn("lo", lo).filter(hi > lo).select(
        "contig", "tile", "lo", F.substring(
            F.col("line"), (F.col("lo") - F.col("from") + 1).cast("int"),
            (hi - F.col("lo")).cast("int")).alias("piece"))
    whole = parts.groupBy("contig", "tile").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("lo", "piece"))), lambda p: p["piece"]), "")
        .alias("seq"))
    return whole.join(names, "contig").select(
        "chrom", F.col("tile").cast("int").alias("tile"),
        (F.col("tile") * tile).cast("int").alias("tile_start"),
        F.least(F.lit(tile), F.length("seq")).alias("core"), "seq")


def contig_lengths(contigs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(chrom, length)``; asked-for names that are unknown get -1."""
    known = contigs.select("chrom", F.length("seq").alias("length"))
    if names is None:
        return known
    return names.select("chrom").distinct().join(known, "chrom", "left").select(
        "chrom", F.coalesce("length", F.lit(-1)).alias("length"))


def tile_lengths(tiles: DataFrame) -> DataFrame:
    """``(chrom, length)`` of contigs that are there as tiles."""
    return tiles.groupBy("chrom").agg(
        F.max(F.col("tile_start") + F.col("core")).cast("int").alias("length"))


def reference_cpg_sites(tiles: DataFrame) -> DataFrame:
    """1-based position of every CG; tiles must overlap by at least one base."""
    return tiles.select("chrom", "tile_start", "core", "seq").mapInArrow(
        placement.find_cpg, placement.SITE_FIELDS)


def cpg_site_bins(tiles: DataFrame, width: int) -> DataFrame:
    """The same positions as arrays, one row per tile and bin of ``width`` bases that has one."""
    return tiles.select("chrom", "tile_start", "core", "seq").mapInArrow(
        placement.find_cpg_in_bins(width), placement.SITE_BIN_FIELDS)


def tiles_near_regions(tiles: DataFrame, regions: DataFrame, tile: int = TILE_BP) -> DataFrame:
    """``tiles_of_regions`` while the touched tiles fit a broadcast. So many windows that they do not lie
    on much of the reference, and to search a tile is less than to shuffle it: then all of them."""
    wanted = _touched_tiles(regions, tile)
    if not fits_broadcast(wanted):
        return tiles
    return tiles.join(F.broadcast(wanted), ["chrom", "tile"], "left_semi")


def _touched_tiles(regions: DataFrame, tile: int) -> DataFrame:
    return regions.select("chrom", F.expr(
        f"explode(sequence(cast((win_start - 1) div {tile} as int), "
        f"cast((win_end - 1) div {tile} as int)))").alias("tile")).distinct()


def tiles_of_regions(tiles: DataFrame, regions: DataFrame, tile: int = TILE_BP) -> DataFrame:
    """Only the tiles that some region window touches."""
    wanted = _touched_tiles(regions, tile)
    return tiles.join(wanted, ["chrom", "tile"], "left_semi")
