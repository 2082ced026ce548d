"""Merkle tree of a dataset from concatenated-level strings, with a proof for every row.

The leaf of a row is a digest of its columns. Leaves of one source, in order, are cut into aligned
blocks of 16^3. A block keeps each of its levels as one string of hexadecimal digests: substrings of
16 digests are hashed to the parents, which make the next string, and the substrings before and after
a digest inside its run of 16 are its siblings. The roots of the blocks are the leaves of the same
step again, until every source has one root; the roots of the sources, in order, are treated alike.

A digest is the lower-case hex SHA-256 of its inputs joined, digests as hex text. A column counts as
``-`` if null, else as its length in UTF-8 bytes, ``:`` and its value. Rows of a source are ordered by
doc_id (nulls first), then by leaf, so repeated rows are leaves of their own and re-runs agree. Sources
are ordered by their bytes, the null one first; an empty source differs from it. A source with one row
has its leaf as root. An empty table has no rows and no root. Columns of other names are not read.

Rows are numbered by a range sort (equal rows are told apart by their place in a written table, so
even a third of all rows alike spreads over tasks) and the row counts of its partitions. A task holds
one block of at most 4,096 rows without their texts. Every table is written to the shared folder.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methylspark.llm.tables import Written, let, maybe_small

FANOUT, DEPTH = 16, 3
BLOCK = FANOUT ** DEPTH
DIGEST = 64
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Rows up to which the numbering sort uses one partition less.
PARTITION_ROWS = 500_000


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**columns: Column) -> Column:
    """Digest of some columns, in the order given."""
    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                          F.lit("-"))

    return sha(*map(told, columns.values()))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """``source, doc_id, leaf, other``: ``other`` is the leaf with ``changed`` in the place of the
    text, null where ``changed`` is null."""
    columns = {c: F.col(c) for c in COLUMNS}
    other = F.lit(None).cast("string") if changed is None else F.when(
        changed.isNotNull(), leaf(**columns | {"text": changed}))
    return docs.select("source", "doc_id", leaf(**columns).alias("leaf"), other.alias("other"))


def numbered(rows: DataFrame, group: str, order: list[str], keep: Written) -> DataFrame:
    """Written ``rows`` with their place ``pos`` in their group, and the group's size ``n``.

    The cut points of the range sort come from a sample; only the counts per partition and group are
    gathered, so no task sorts a whole group.
    """
    parts = rows.count() // PARTITION_ROWS + 1
    by = [group, *(F.asc_nulls_first(c) for c in order), "tie"]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(
        parts, *by).sortWithinPartitions(*by).drop("tie").withColumn(
        "at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    placed = keep(placed)
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"),
                                             F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = keep(runs.select(
        group, "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy(group)).alias("n")))
    return placed.join(maybe_small(runs), [group, "part"]).withColumn(
        "pos", F.col("at") - F.col("first") + F.col("before")).drop(
        "part", "at", "first", "before")


def _parents(level: Column) -> Column:
    """The level above, from the string of a level."""
    width = FANOUT * DIGEST
    return F.array_join(F.transform(
        F.sequence(F.lit(0), ((F.octet_length(level) - 1) / width).cast("int")),
        lambda k: F.sha2(F.substring(level, k * width + 1, F.lit(width)), 256)), "").cast("binary")


def _siblings(level: Column, at: Column) -> Column:
    """The digests before and after number ``at`` in its run."""
    inside = F.pmod(at, F.lit(FANOUT))
    run = (at - inside) * DIGEST

    def part(start: Column, count: Column) -> Column:
        return F.substring(level, start + 1, count * DIGEST)

    return F.struct(part(run, inside).alias("left"),
                    part((at + 1) * DIGEST, FANOUT - 1 - inside).alias("right"))


def _path(at: Column) -> Column:
    """Siblings of leaf ``at`` of a block up to the block's root."""
    step = [_siblings(F.col(f"level{k}"), F.floor(at / FANOUT ** k).cast("int"))
            for k in range(DEPTH)]
    return F.slice(F.array(*step), F.lit(1), F.col("depth"))


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(
        s["left"], h.cast("binary"), s["right"]), 256))


def blocks(nodes: DataFrame, group: str, keep: Written) -> DataFrame:
    """One written row per block of ``nodes(group, pos, n, member)`` with its members in order, the
    strings of its levels, the ``path`` of its root, and ``root``, that of the group."""
    rows = nodes.groupBy(group, F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", "member"))).alias("nodes"))
    rows = rows.select(group, "block", "n", F.col("nodes.member").alias("members"))
    # a group of one block grows until one digest is left; more blocks are all of full height
    depth = sum((F.col("n") > FANOUT ** k).cast("int") for k in range(DEPTH))
    rows = rows.withColumn("depth", depth).withColumn("level0", F.array_join(
        F.transform("members", lambda m: m["leaf"]), "").cast("binary"))
    for k in range(DEPTH):
        rows = rows.withColumn(f"level{k + 1}", _parents(F.col(f"level{k}")))
    tops = F.array(*(F.substring(f"level{k}", 1, DIGEST) for k in range(DEPTH + 1)))
    rows = keep(rows.withColumn("top", F.get(tops, F.col("depth")).cast("string")).drop(
        f"level{DEPTH}"))
    most = rows.agg(F.max("n").alias("n")).first().n or 0
    if most <= BLOCK:
        return rows.withColumn("path", F.array().cast(PATH)).withColumn("root", F.col("top"))
    above = blocks(rows.select(
        group, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"),
        F.struct(F.col("top").alias("leaf"), F.col("block")).alias("member")), group, keep)
    paths = keep(above.select(group, "path", "root", *_LEVELS, F.posexplode("members")).select(
        group, F.col("col.block").alias("block"), F.concat(_path(F.col("pos")), "path").alias("path"),
        "root"))
    return rows.join(maybe_small(paths), [group, "block"])


PATH = "array<struct<left: binary, right: binary>>"
_LEVELS = ["depth", *(f"level{k}" for k in range(DEPTH))]


class Manifest(NamedTuple):
    """``sources(source, n, subroot, path, root)`` and the blocks of leaves under them."""
    sources: DataFrame
    leaf_blocks: DataFrame


def build(given: DataFrame, keep: Written) -> Manifest:
    """The tree over ``given(source, doc_id, leaf, other)``."""
    # one key that is never null, ordered as sources are
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    rows = numbered(keep(given.withColumn("key", key)), "key", ["doc_id", "leaf"], keep)
    of_rows = blocks(rows.select("key", "pos", "n", F.struct(
        "leaf", "doc_id", "other", "source").alias("member")), "key", keep)
    subroots = keep(of_rows.filter("block = 0").select(
        F.lit(0).alias("all"), "key", F.get("members", F.lit(0))["source"].alias("source"),
        F.col("n").alias("rows"), F.col("root").alias("subroot")))
    of_sources = blocks(numbered(subroots, "all", ["key"], keep).select(
        "all", "pos", "n", F.struct(F.col("subroot").alias("leaf"), "key", "source",
                                    "rows").alias("member")), "all", keep)
    sources = keep(of_sources.select("path", "root", *_LEVELS, F.posexplode("members")).select(
        "col.key", "col.source", F.col("col.rows").alias("n"), F.col("col.leaf").alias("subroot"),
        F.concat(_path(F.col("pos")), "path").alias("path"), "root"))
    return Manifest(sources, of_rows)


def prove(tree: Manifest) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row:
    the digest of all siblings from the leaf up, and the root that ``other`` (where null, the leaf
    itself) gives with them."""
    up = maybe_small(tree.sources.select("key", F.col("subroot"), F.col("path").alias("up"),
                                         F.col("root").alias("whole")))
    rows = tree.leaf_blocks.join(up, "key")

    def proof(path: Column, m: Column) -> Column:
        joined = F.aggregate(path, F.lit("").cast("binary"), lambda x, s: F.concat(
            x, s["left"], s["right"]))
        return F.struct(m["doc_id"].alias("doc_id"), m["source"].alias("source"),
                        m["leaf"].alias("leaf"), F.sha2(joined, 256).alias("proof_sha256"),
                        fold(F.coalesce(m["other"], m["leaf"]), path).alias("folded_root"))

    each = F.transform("members", lambda m, k: let(
        F.concat(_path(k), "path", "up"), lambda path: proof(path, m)))
    return rows.select("subroot", F.col("whole").alias("root"), F.inline(each)).select(
        "doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
