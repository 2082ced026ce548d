"""Writers: one table per kind of result, partitioned by chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snv_export(snvs: DataFrame) -> DataFrame:
    """Variant table in export layout."""
    return snvs.select("snv_id", F.col("chrom").alias("chr"), "pos", "ref", "alt", "qual",
                       F.when(F.col("is_pass"), "PASS").otherwise("FAIL").alias("filter"),
                       "somatic_conf")


def write_snv_tsv(snvs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    snv_export(snvs).write.mode(mode).csv(path, sep="\t", header=True)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_jsonl(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, from the ``json`` column."""
    lines.select("json").write.mode(mode).text(path)


def write_region_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet",
                        mode: str = "errorifexists", by_chrom: bool = True) -> None:
    """Write each table to ``path/name``, sorted by region inside its files.

    Tables with a ``chrom`` column get one directory per chromosome; switch that
    off for references of very many contigs, where the sort order alone lets
    readers skip files. Rows are cut by range over chromosome and region, so a
    large chromosome does not end up in one task.
    """
    for name, df in tables.items():
        order = [c for c in ("chrom", "region_id", "read_id", "cpg_id") if c in df.columns]
        writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write
        if by_chrom and "chrom" in df.columns:
            writer = writer.partitionBy("chrom")
        writer.mode(mode).format(fmt).options(**({"header": True} if fmt == "csv" else {})) \
            .save(f"{path}/{name}")
