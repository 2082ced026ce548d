"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Only vectors with equal labels and equal length are compared. Equal vectors count as one with many
copies. Each tree splits its label's vectors again and again by projection on a random direction
(one per tree and level); vectors within a margin of the cut go to both sides. The margin is
absolute (``SPILL`` deviations of the projected difference of two unit vectors at the threshold), so
a pair is parted as rarely in a dense group as in a loose one. Every label of more than ``LEAF``
vectors has cuts of its own, fitted to about ``SAMPLE`` of its vectors by seeded choice: a level's
cut is the one that leaves the least work, and a level that saves none is not split. So a group too
tight to be cut stays whole, and its leaf is compared exactly, while loose vectors are split until
leaves come near ``LEAF``. Every vector is routed.

Vectors of a leaf are compared in double precision, in pairs of blocks of at most ``BLOCK``; a unit
of work returns link counts and a spanning forest, never the pairs. A pair that meets in several
trees or leaves is counted in the first one: two routes share a leaf if at every level they took the
same side or one of them took both.

Null, empty and zero vectors, vectors with null or non-finite numbers, and rows with a null label
link with nothing: n_links 0, their own component, kept. Repeated rows count as further vectors. An
empty table gives an empty result. Columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.llm.components import components
from methylspark.llm.tables import Written, maybe_small

TREES, LEAF, BLOCK, SPILL, MAX_DEPTH = 4, 512, 1024, 0.67, 40
SAMPLE, QUANTILES = 2_000, np.linspace(0.1, 0.9, 17)


def directions(length: int, seed: int = 5) -> np.ndarray:
    """A direction per tree and level, for vectors of one length."""
    return np.random.default_rng(seed).normal(size=(length, TREES * MAX_DEPTH))


def margin(threshold: float) -> float:
    """How far from a cut a unit vector goes to both sides."""
    return SPILL * math.sqrt(max(2 - 2 * threshold, 0))


def fit(unit: np.ndarray, size: int, spill: float) -> np.ndarray:
    """Cuts by tree and level for a label of ``size`` vectors of which ``unit`` are a sample.

    A level that does not split has no number. Without levels one leaf holds all.
    """
    shadow = unit @ directions(unit.shape[1])
    scale = size / len(unit)

    def work(counts):  # compared pairs, and what rows cost besides
        return scale * scale * (counts * (counts - 1)).sum() + 2 * LEAF * scale * counts.sum()

    cuts = np.full((TREES, MAX_DEPTH), np.nan)
    for tree in range(TREES):
        row, leaf, idle = np.arange(len(unit)), np.zeros(len(unit), np.int64), 0
        least = work(np.array([len(unit)]))
        for level in range(MAX_DEPTH):
            at = shadow[:, tree * MAX_DEPTH + level]
            here, n = at[row], leaf.max() + 1
            tried = np.unique(np.quantile(at, QUANTILES))
            costs = [work(np.bincount(leaf[here <= t + spill], minlength=n))
                     + work(np.bincount(leaf[here >= t - spill], minlength=n)) for t in tried]
            best = int(np.argmin(costs))
            idle += 1
            if costs[best] < 0.97 * least:
                cuts[tree, level], least, idle = tried[best], costs[best], 0
                sides = [here <= tried[best] + spill, here >= tried[best] - spill]
                row = np.concatenate([row[x] for x in sides])
                leaf = np.concatenate([leaf[x] * 2 + k for k, x in enumerate(sides)])
                leaf = np.unique(leaf, return_inverse=True)[1]
            if idle == 6:
                break
        if np.isnan(cuts[tree]).all():
            return cuts[:, :0]
    return cuts[:, :np.flatnonzero(~np.isnan(cuts).all(axis=0)).max() + 1]


def route(unit: np.ndarray, cuts: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Sides and spilled levels of unit vectors, as bits, one column per tree."""
    depth = cuts.shape[1]
    shadow = (unit @ directions(unit.shape[1])).reshape(len(unit), TREES, MAX_DEPTH)[:, :, :depth]
    power = 1 << np.arange(depth, dtype=np.int64)
    return ((shadow > cuts) @ power).astype(np.int64), (
        (np.abs(shadow - cuts) <= spill) @ power).astype(np.int64)


def _leaves(side: int, both: int) -> list[int]:
    """All leaves of a route."""
    out = [side & ~both]
    while both:
        bit = both & -both
        out += [leaf | bit for leaf in out]
        both ^= bit
    return out


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _matrix(column) -> np.ndarray:
    """Vectors of one length, each scaled by a power of two so that no square over- or underflows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(
        len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None]) if len(rows) else rows


def fit_all(reps: DataFrame, spill: float) -> DataFrame:
    """``(label, length, cuts)`` of every label of more than ``LEAF`` vectors of one length."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep").combine_chunks()
        cuts = fit(_unit(_matrix(table.column("vec").chunk(0))),
                   table.column("size")[0].as_py(), spill)
        return pa.table({"label": table.column("label")[:1], "length": table.column("length")[:1],
                         "cuts": pa.array([cuts.ravel()], pa.list_(pa.float64()))})

    chosen = F.pmod(F.xxhash64("rep", F.lit(17)), F.col("size")) < SAMPLE
    return reps.filter((F.col("size") > LEAF) & chosen).groupBy("label", "length").applyInArrow(
        run, "label long, length int, cuts array<double>")


def route_all(reps: DataFrame, spill: float) -> DataFrame:
    """``reps`` with the bits of every tree, and one row per tree and leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            length = np.array([len(x) for x in batch.column(2)])
            for key in sorted(set(zip(label.tolist(), length.tolist(), strict=True))):
                here = np.flatnonzero((label == key[0]) & (length == key[1]))
                part = batch.take(pa.array(here))
                cuts = np.array(part.column(4)[0].as_py() or []).reshape(TREES, -1)
                if cuts.size:
                    side, both = route(_unit(_matrix(part.column(2))), cuts, spill)
                else:  # one leaf
                    side = both = np.zeros((len(here), TREES), np.int64)
                rows, tree, leaf = [], [], []
                for k in range(len(here)):
                    for t in range(TREES if cuts.size else 1):
                        for x in _leaves(int(side[k, t]), int(both[k, t])):
                            rows.append(k)
                            tree.append(t)
                            leaf.append(x)
                spread = part.select(range(4)).take(pa.array(rows, pa.int64()))
                bits = [pa.ListArray.from_arrays(
                    pa.array(np.arange(len(rows) + 1) * TREES, pa.int32()),
                    pa.array(x[rows].ravel())) for x in (side, both)]
                yield pa.RecordBatch.from_arrays(
                    [*spread.columns, pa.array(tree, pa.int32()), pa.array(leaf, pa.int64()),
                     *bits], ["rep", "label", "vec", "copies", "tree", "leaf", "side", "both"])

    vec = reps.schema["vec"].dataType.simpleString()
    return reps.select("rep", "label", "vec", "copies", "cuts").mapInArrow(
        run, f"rep long, label long, vec {vec}, copies long, tree int, leaf long, "
             "side array<long>, both array<long>")


def _links(vectors, copies, block, side, both, tree, leaf, threshold):
    """Linked copies per vector, and the least place in its part of the links of a unit."""
    n = len(vectors)
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    linked = vectors @ vectors.T >= threshold * np.multiply.outer(norm, norm)
    np.fill_diagonal(linked, False)
    if block[0] != block[1]:
        linked &= np.not_equal.outer(block[2], block[2])
    root = np.arange(n)
    for k in range(n):  # parts of the links
        if root[k] == k:
            todo = [k]
            while todo:
                near = np.flatnonzero(linked[todo.pop()])
                near = near[(root[near] == near) & (near > k)]
                root[near] = k
                todo += near.tolist()
    counted = linked
    if linked.any():
        for t in range(tree):  # met in an earlier tree
            apart = (side[:, t][:, None] ^ side[:, t]) & ~(both[:, t][:, None] | both[:, t])
            counted = counted & (apart != 0)
        # both spilled at a level: only the leaf on side 0 counts
        counted = counted & ((both[:, tree][:, None] & both[:, tree] & leaf) == 0)
    return counted @ copies, root


def compare(routed: DataFrame, threshold: float, keep: Written) -> DataFrame:
    """``(rep, n, root)`` for every vector that a unit of ``routed`` links."""
    keys = ["label", "length", "tree", "leaf", "i", "j"]

    def solve(key, parts):
        rep, copies, mine = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        vectors, side, both = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        n, root = _links(vectors, copies, (key[4], key[5], mine), side, both, key[2], key[3],
                         threshold)
        here = np.flatnonzero((n > 0) | (root != np.arange(len(rep))))
        return rep[here], n[here], rep[root[here]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts = None, []

        def done():
            return [solve(unit, parts)] if sum(len(p[0]) for p in parts) > 1 else []

        for batch in batches:
            found = []
            columns = [batch.column(k).to_numpy() for k in range(6)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for low, high in zip([0, *new.tolist()], [*new.tolist(), len(batch)], strict=True):
                key = tuple(c[low].item() for c in columns)
                if key != unit:
                    found += done()
                    unit, parts = key, []
                piece = batch.slice(low, high - low)
                parts.append([*(piece.column(k).to_numpy() for k in (6, 7, 8)),
                              _matrix(piece.column(9)),
                              *(piece.column(k).flatten().to_numpy().reshape(-1, TREES)
                                for k in (10, 11))])
            yield from _told(found)
        yield from _told(done())

    def _told(found):
        for rep, n, root in found:
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), pa.array(root)],
                                             ["rep", "n", "root"])

    sized = routed.withColumn("length", F.size("vec"))
    # only leaves of several blocks are looked up; vectors are shuffled once, to their units
    wide = keep(sized.groupBy(*keys[:4]).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
                .filter("blocks > 1"))
    several = sized.join(maybe_small(wide), keys[:4], "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    units = several.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn(
        "i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    return units.select(*keys, "rep", "copies", "mine", "vec", "side", "both").repartition(
        *keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, n long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93,
                    keep: Written | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    keep = keep or Written(embeddings.sparkSession)
    # single precision travels as such and is compared in double precision
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("vec"))
    finite = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)
                                 & (F.abs(x) < float("inf"))), F.lit(False))
    fit = finite & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull() & F.col(
        "vec_id").isNotNull()
    marked = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    valid = marked.filter("fit")
    classes = valid.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"),
                                                F.count("*").alias("copies"))
    classes = keep(classes)
    sizes = classes.groupBy("label", F.size("vec").alias("length")).agg(F.count("*").alias("size"))
    reps = keep(classes.withColumn("length", F.size("vec")).join(sizes, ["label", "length"]))
    spill = margin(threshold)
    cuts = keep(fit_all(reps, spill))
    cut = reps.join(maybe_small(cuts), ["label", "length"], "left")
    found = keep(compare(route_all(cut, spill), threshold, keep))
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), keep)
    told = classes.join(counted, "rep", "left").join(
        named.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    linked = valid.join(told, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = marked.filter("not fit").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(
        F.col("vec_id") == F.col("component_id"), F.lit(True)))
