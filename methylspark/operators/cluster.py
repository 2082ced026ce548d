"""Hierarchical clustering of reads per region.

A dendrogram is one row per read: its place ``leaf_pos`` in the leaf order, and
the merge that ties it to the leaf before it (``join_read``, ``height``; null for
the first leaf). A cluster is named by its smallest read, and the cluster with
the smaller name comes first, so the row of read ``b`` holds the merge that ends
the cluster ``b``. Any cut of the tree is then a running count along the leaves.

Both linkages follow from exact integer sums over pairs of reads. Distances are
taken at a resolution of 1e-9, and pairs without a known distance count as 1.
Pairs of clusters are ordered by distance (in units of that resolution under
Ward's linkage), then by a hash of both names, which deals ties out evenly, then by
name. Both linkages are reducible, so any order of merging nearest neighbours
gives the tree of one-by-one merging. Regions up to ``max_local_reads`` are handled
in an Arrow kernel that follows chains of nearest neighbours; larger ones merge
all mutually nearest clusters per round of joins and aggregations, with the same
sums and hence the same tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methylspark.functions.grouping import apply_to_runs
from methylspark.operators.distance import all_pairs, in_pair_blocks, split_group
from methylspark.operators.ranking import dense_row_number, running_sum
from methylspark.shared import shared_folder

METHODS = ("upgma", "ward")
UNITS = 1_000_000_000
MAX_LOCAL_READS = 1024
#: Regions up to so many reads are merged together, and so many places of their pair sums at a time.
BATCH_READS, BATCH_PLACES = 64, 1 << 18

# Factors and modulus of the hash that orders ties.
TIE_A, TIE_B, TIE_MOD = 1_000_003, 998_244_353, 2_147_483_647

LEAVES = "region_id INT, read_id INT, leaf_pos INT, join_read INT, height DOUBLE"
TREES = "region_id INT, newick STRING"


def tie_order(a, b):
    """A number that orders pairs of clusters ``a < b`` at one distance; columns, arrays or numbers."""
    mixed = (a * TIE_A + b * TIE_B) % TIE_MOD
    return mixed * mixed % TIE_MOD


def _cluster_kernel(method: str, want_tree: bool):
    """All merges of one region from its known integer pair sums."""

    def kernel(group):
        import numpy as np
        import pyarrow as pa

        region = group["region_id"][0]
        i, j, unit = group["read_i"], group["read_j"], group["unit"]
        names = np.unique(np.concatenate([i, j])).astype(np.int64)
        n = len(names)
        i, j = np.searchsorted(names, i), np.searchsorted(names, j)
        sums = np.full((n, n), UNITS, np.int64)
        sums[i, j] = unit
        sums[j, i] = unit
        size, within, inner = np.ones(n), np.zeros(n, np.int64), np.zeros(n)
        gone, every = np.zeros(n), np.arange(n)
        owner, place = np.arange(n), np.zeros(n, np.int64)
        join, height = np.full(n, -1), np.full(n, np.nan)
        top = np.zeros(n)
        tree = [str(v) for v in names] if want_tree else None

        def linkage(x):
            """Values of x with every cluster, and what they are ordered by."""
            cross = sums[x] / (size[x] * size)
            if method != "ward":
                return cross, cross + gone
            before = every < x
            value = 2.0 * (size[x] * size) / (size[x] + size) * (
                cross - np.where(before, inner, inner[x]) - np.where(before, inner[x], inner))
            return value, np.floor(value + 0.5) + gone

        def nearest(x):
            value, key = linkage(x)
            key[x] = np.inf
            y = int(key.argmin())
            ties = np.flatnonzero(key == key[y])
            if len(ties) > 1:
                a, b = np.minimum(ties, x), np.maximum(ties, x)
                y = int(ties[np.lexsort((b, a, tie_order(names[a], names[b])))[0]])
            return y, value[y]

        chain = []
        for _ in range(n - 1):
            if not chain:
                chain.append(int(owner[0]))
            y, d = nearest(chain[-1])
            while len(chain) < 2 or y != chain[-2]:
                chain.append(y)
                y, d = nearest(y)
            a, b = sorted(chain[-2:])
            del chain[-2:]
            h = np.sqrt(max(d, 0.0) / UNITS) if method == "ward" else d / UNITS
            join[b], height[b] = a, h
            if tree:
                left, right = (np.floor((h - top[x]) / 2 * 1e6 + 0.5) / 1e6 for x in (a, b))
                tree[a] = f"({tree[a]}:{left:.6f},{tree[b]}:{right:.6f})"
                tree[b] = None
                top[a] = h
            moved = owner == b
            owner[moved] = a
            place[moved] += int(size[a])
            within[a] += within[b] + sums[a, b]
            size[a] += size[b]
            inner[a] = within[a] / (size[a] * size[a])
            sums[a] += sums[b]
            sums[:, a] = sums[a]
            gone[b] = np.inf
        if want_tree:
            return {"region_id": np.full(1, region, np.int32),
                    "newick": pa.array([f"{tree[0]};"])}
        return {
            "region_id": np.full(n, region, np.int32),
            "read_id": names.astype(np.int32),
            "leaf_pos": place.astype(np.int32),
            "join_read": pa.array(names[join].astype(np.int32), mask=join < 0),
            "height": pa.array(height, mask=join < 0),
        }

    return kernel


def _merge_stacked(names, sums, method: str):
    """The merges of regions of one size, a pair of clusters in each at a time: ``names`` of their reads
    as rows, ``sums`` as a stack of matrices. Gives place, join and height of the reads, and the merges
    in order. The nearest pair of all is a pair of nearest neighbours, so the tree is the kernel's.
    """
    import numpy as np

    many, n = names.shape
    g, every = np.arange(many), np.arange(n)
    size, within, inner = np.ones((many, n)), np.zeros((many, n)), np.zeros((many, n))
    gone = np.zeros((many, n), bool)
    owner = np.tile(every, (many, 1))
    place, join = np.zeros((many, n), np.int64), np.full((many, n), -1)
    height = np.full((many, n), np.nan)
    low, high = np.minimum.outer(every, every), np.maximum.outer(every, every)
    tie = tie_order(names[:, low], names[:, high]) * (n * n) + low * n + high
    merges = []

    def linkage(x):
        """Values of the clusters x with every cluster."""
        cross = sums[g, x] / (size[g, x][:, None] * size)
        if method != "ward":
            return cross
        before, own, mine = every < x[:, None], inner[g, x][:, None], size[g, x][:, None]
        return 2.0 * (mine * size) / (mine + size) * (
            cross - np.where(before, inner, own) - np.where(before, own, inner))

    def ordered(value):
        return np.floor(value + 0.5) if method == "ward" else value

    key = np.stack([ordered(linkage(np.full(many, x))) for x in range(n)], axis=1)
    key[:, every, every] = np.inf
    for _ in range(n - 1):
        least = key.min(axis=(1, 2))
        found = np.where(key == least[:, None, None], tie, np.iinfo(np.int64).max)
        a, b = np.divmod(found.reshape(many, -1).argmin(axis=1), n)  # the first of both places: a < b
        d = linkage(a)[g, b]
        h = np.sqrt(np.maximum(d, 0.0) / UNITS) if method == "ward" else d / UNITS
        merges.append((a, b, h))
        join[g, b], height[g, b] = a, h
        moved = owner == b[:, None]
        place += np.where(moved, size[g, a][:, None].astype(np.int64), 0)
        owner = np.where(moved, a[:, None], owner)
        within[g, a] += within[g, b] + sums[g, a, b]
        size[g, a] += size[g, b]
        inner[g, a] = within[g, a] / (size[g, a] * size[g, a])
        sums[g, a] += sums[g, b]
        sums[g, :, a] = sums[g, a]
        gone[g, b] = True
        fresh = ordered(linkage(a))
        fresh[gone] = np.inf
        fresh[g, a] = np.inf
        key[g, a] = fresh
        key[g, :, a] = fresh
        key[g, b] = np.inf
        key[g, :, b] = np.inf
    return place, join, height, merges


def _stacked_trees(names, merges):
    """Tree texts from the merges of ``_merge_stacked``, as the kernel writes them."""
    import numpy as np

    many, n = names.shape
    g, top = np.arange(many), np.zeros((many, n))
    text = [[str(v) for v in row] for row in names.tolist()]
    for a, b, h in merges:
        left, right = (np.floor((h - top[g, x]) / 2 * 1e6 + 0.5) / 1e6 for x in (a, b))
        top[g, a] = h
        for row, x, y, p, q in zip(text, *(v.tolist() for v in (a, b, left, right))):
            row[x], row[y] = f"({row[x]}:{p:.6f},{row[y]}:{q:.6f})", None
    return [f"{row[0]};" for row in text]


def _batch_kernel(method: str, want_tree: bool):
    """``_cluster_kernel`` for all regions of a batch; small ones of one size are merged together."""
    alone = _cluster_kernel(method, want_tree)

    def kernel(rows, bounds):
        import numpy as np
        import pyarrow as pa

        region, unit = rows["region_id"][bounds[:-1]], rows["unit"]
        of_row = np.repeat(np.arange(len(region)), np.diff(bounds))
        i, j = (rows[c].astype(np.int64) for c in ("read_i", "read_j"))
        stride = max(int(i.max()), int(j.max())) + 1
        ids, places = np.unique(np.concatenate([of_row * stride + i, of_row * stride + j]),
                                return_inverse=True)
        first = np.searchsorted(ids, np.arange(len(region) + 1) * stride)
        sizes, ids = np.diff(first), ids % stride
        i, j = places.reshape(2, -1) - first[of_row]
        for r in np.flatnonzero(sizes > BATCH_READS).tolist():
            yield alone({name: value[bounds[r]:bounds[r + 1]] for name, value in rows.items()})
        slot = np.zeros(len(region), np.int64)
        for n in np.unique(sizes[sizes <= BATCH_READS]).tolist():
            same = np.flatnonzero(sizes == n)
            step = max(BATCH_PLACES // (n * n), 1)
            for part in (same[k:k + step] for k in range(0, len(same), step)):
                names = ids[first[part][:, None] + np.arange(n)]
                slot[:] = -1
                slot[part] = np.arange(len(part))
                mine = np.flatnonzero(slot[of_row] >= 0)
                at, x, y = slot[of_row[mine]], i[mine], j[mine]
                sums = np.full((len(part), n, n), float(UNITS))
                sums[at, x, y] = unit[mine]
                sums[at, y, x] = unit[mine]
                place, join, height, merges = _merge_stacked(names, sums, method)
                if want_tree:
                    yield {"region_id": region[part].astype(np.int32),
                           "newick": _stacked_trees(names, merges)}
                    continue
                joined = np.take_along_axis(names, np.maximum(join, 0), axis=1)
                yield {"region_id": np.repeat(region[part], n).astype(np.int32),
                       "read_id": names.ravel().astype(np.int32),
                       "leaf_pos": place.ravel().astype(np.int32),
                       "join_read": pa.array(joined.ravel().astype(np.int32), mask=join.ravel() < 0),
                       "height": pa.array(height.ravel(), mask=join.ravel() < 0)}

    return kernel


def _units(dist: Column, method: str) -> Column:
    value = dist * dist if method == "ward" else dist
    return F.floor(value * F.lit(float(UNITS)) + 0.5)


def _linkage_value(method: str) -> Column:
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    cross = F.col("s") / (na * nb)
    if method == "upgma":
        return cross
    return (F.lit(2.0) * (na * nb) / (na + nb)
            * (cross - F.col("w_a") / (na * na) - F.col("w_b") / (nb * nb)))


def _branch(x: str) -> Column:
    """Half the rise in height, rounded half up before it becomes text, as in the kernel."""
    return F.floor((F.col("h") - F.col(f"top_{x}")) / 2 * F.lit(1e6) + 0.5) / F.lit(1e6)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the cluster's shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def _merge_rounds(pairs: DataFrame, reads: DataFrame, method: str, want_tree: bool) -> DataFrame:
    """The same merges as rounds of joins, for regions of any size."""
    clusters = reads.select(
        "region_id", F.col("read_id").alias("c"), F.lit(1).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("w"), F.lit(0.0).alias("top"),
        (F.col("read_id").cast("string") if want_tree else F.lit("")).alias("tree"))
    leaves = reads.select(
        "region_id", "read_id", F.col("read_id").alias("c"),
        F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("int").alias("join_read"),
        F.lit(None).cast("double").alias("height"))
    pairs = cut_lineage(pairs.select("region_id", F.col("read_i").alias("a"),
                                     F.col("read_j").alias("b"), F.col("unit").alias("s")))
    clusters, leaves = cut_lineage(clusters), cut_lineage(leaves)

    while not pairs.isEmpty():
        def side(x: str) -> DataFrame:
            return clusters.select("region_id", F.col("c").alias(x), F.col("n").alias(f"n_{x}"),
                                   F.col("w").alias(f"w_{x}"), F.col("top").alias(f"top_{x}"),
                                   F.col("tree").alias(f"tree_{x}"))

        sized = pairs.join(side("a").drop("top_a", "tree_a"), ["region_id", "a"]).join(
            side("b").drop("top_b", "tree_b"), ["region_id", "b"])
        scored = sized.withColumn("d", _linkage_value(method))
        ways = scored.withColumn("q", F.explode(F.array(
            F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
            F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
        key = F.floor(F.col("d") + 0.5) if method == "ward" else F.col("d")
        near = ways.groupBy("region_id", F.col("q.x").alias("x")).agg(
            F.min(F.struct(key.alias("key"), tie_order(F.col("a").cast("bigint"), F.col("b").cast(
                "bigint")).alias("tie"), "a", "b", F.col("q.y").alias("y"), "d", "s")).alias(
            "m")).select("region_id", "x", F.col("m.y").alias("y"), F.col("m.d").alias("d"),
                         F.col("m.s").alias("s"))
        back = near.select("region_id", F.col("x").alias("y"), F.col("y").alias("x"))
        mutual = near.join(back, ["region_id", "x", "y"]).filter("x < y")
        height = (F.sqrt(F.greatest(F.col("d"), F.lit(0.0)) / UNITS) if method == "ward"
                  else F.col("d") / UNITS)
        merges = mutual.select("region_id", F.col("x").alias("a"), F.col("y").alias("b"), "s",
                               height.alias("h")).join(side("a"), ["region_id", "a"])
        if want_tree:
            merges = merges.join(side("b").select("region_id", "b", "top_b", "tree_b"),
                                 ["region_id", "b"])
        else:
            merges = merges.withColumn("top_b", F.lit(0.0)).withColumn("tree_b", F.lit(""))
        merges = cut_lineage(merges.select(
            "region_id", "a", "b", "s", "h", F.col("n_a").alias("shift"),
            F.when(F.lit(want_tree), F.format_string(
                "(%s:%.6f,%s:%.6f)", "tree_a", _branch("a"), "tree_b", _branch("b")))
            .otherwise("").alias("tree")))
        ended = merges.select("region_id", F.col("b").alias("old"), F.col("a").alias("new"),
                              "shift", F.col("h"))

        def renamed(df: DataFrame, x: str) -> DataFrame:
            names = ended.select("region_id", F.col("old").alias(x), F.col("new").alias("_new"))
            return df.join(names, ["region_id", x], "left").withColumn(
                x, F.coalesce("_new", x)).drop("_new")

        moved = renamed(renamed(pairs, "a"), "b").filter("a <> b")
        pairs = cut_lineage(moved.groupBy(
            "region_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
            F.sum("s").alias("s")))
        gained = merges.select("region_id", F.col("a").alias("c"), F.col("s").alias("w_new"),
                               F.col("h").alias("top_new"), F.col("tree").alias("tree_new"))
        totals = renamed(clusters, "c").groupBy("region_id", "c").agg(
            F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("top").alias("top"),
            F.max("tree").alias("tree"))
        clusters = cut_lineage(totals.join(gained, ["region_id", "c"], "left").select(
            "region_id", "c", "n", (F.col("w") + F.coalesce("w_new", F.lit(0))).alias("w"),
            F.coalesce("top_new", "top").alias("top"),
            F.coalesce("tree_new", "tree").alias("tree")))
        ends = ended.select("region_id", F.col("old").alias("c"), "new", "shift", "h")
        leaves = cut_lineage(leaves.join(ends, ["region_id", "c"], "left").select(
            "region_id", "read_id", F.coalesce("new", "c").alias("c"),
            (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"),
            F.when(F.col("read_id") == F.col("c"), F.coalesce("join_read", "new"))
            .otherwise(F.col("join_read")).alias("join_read"),
            F.when(F.col("read_id") == F.col("c"), F.coalesce("height", "h"))
            .otherwise(F.col("height")).alias("height")))
    if want_tree:
        return clusters.select("region_id", F.concat("tree", F.lit(";")).alias("newick"))
    return leaves.select("region_id", "read_id", F.col("place").cast("int").alias("leaf_pos"),
                         "join_read", "height")


def _build(reads: DataFrame, distances: DataFrame, method: str, max_local_reads: int,
           want_tree: bool) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    members = reads.select("region_id", "read_id")
    # A missing or null distance (strategy "skip") counts as the largest one here.
    pairs = distances.filter("dist is not null").select(
        "region_id", "read_i", "read_j", _units(F.col("dist"), method).alias("unit"))
    large = members.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > max_local_reads).select("region_id")
    some_large = not large.isEmpty()
    small_pairs, small_members = pairs, members
    if some_large:
        small_pairs = pairs.join(large, "region_id", "left_anti")
        small_members = members.join(large, "region_id", "left_anti")
    alone = small_members.select("region_id", F.col("read_id").alias("read_i"),
                                 F.col("read_id").alias("read_j"),
                                 F.lit(0).cast("bigint").alias("unit"))
    out = apply_to_runs(small_pairs.unionByName(alone), ["region_id"],
                        _batch_kernel(method, want_tree), TREES if want_tree else LEAVES,
                        together=True, hold=BATCH_PLACES // 2)
    if some_large:
        large_members = members.join(large, "region_id", "left_semi")
        every = all_pairs(large_members).join(
            pairs, ["region_id", "read_i", "read_j"], "left").fillna(UNITS, ["unit"])
        rounds = _merge_rounds(every, large_members, method, want_tree)
        out = out.unionByName(rounds)
    return out


def cluster_reads(reads: DataFrame, distances: DataFrame, method: str = "upgma",
                  max_local_reads: int = MAX_LOCAL_READS) -> DataFrame:
    """Dendrogram of each region (see the module text) from its known pair distances."""
    return _build(reads, distances, method, max_local_reads, False)


def newick(reads: DataFrame, distances: DataFrame, method: str = "upgma",
           max_local_reads: int = MAX_LOCAL_READS) -> DataFrame:
    """Tree text per region; a branch is half the rise in merge height."""
    return _build(reads, distances, method, max_local_reads, True)


def _segments(leaves: DataFrame, parts: list[str], starts: Column) -> DataFrame:
    """Labels 1..K from segment starts along the leaves, by smallest read."""
    flagged = leaves.withColumn("_start", F.when(starts, 1).otherwise(0))
    cut = running_sum(flagged, parts, "leaf_pos", "_start", "_seg")
    firsts = cut.groupBy(*parts, "_seg").agg(F.min("read_id").cast("bigint").alias("_first"))
    ranked = dense_row_number(firsts, parts, ["_first"], "_rank")
    return cut.join(ranked.select(*parts, "_seg", "_rank"), [*parts, "_seg"]).select(
        *parts, "read_id", (F.col("_rank") + 1).alias("cluster_id"))


def cut_height(leaves: DataFrame, height: float) -> DataFrame:
    """Clusters whose merges all lie at or below ``height``."""
    return _segments(leaves, ["region_id"],
                     F.col("height").isNull() | (F.col("height") > height))


def _last_merges(leaves: DataFrame, most: int) -> DataFrame:
    """Leaves with ``_late``: 1 for the last merge, null beyond ``most``."""
    late = Window.partitionBy("region_id").orderBy(
        F.desc("height"), F.desc("join_read"), F.desc("read_id"))
    last = leaves.filter("height is not null").withColumn(
        "_late", F.row_number().over(late)).filter(F.col("_late") <= most).select(
        "region_id", "read_id", "_late")
    return leaves.join(last, ["region_id", "read_id"], "left")


def cut_k(leaves: DataFrame, k: int) -> DataFrame:
    """``k`` clusters per region (fewer where it has fewer reads)."""
    if k < 1:
        raise ValueError("k must be positive")
    starts = F.col("height").isNull() | F.col("_late").isNotNull()
    return _segments(_last_merges(leaves, k - 1), ["region_id"], starts)


def _sums_kernel(group):
    """Of each read, sum and number of its known distances to each cluster of each labelling:
    labels as one-hot columns, so a block of pairs is one product for all labellings."""
    import numpy as np

    ids, (i, j), dist = split_group(group)
    if not len(i):
        return None
    flat, lengths = group["labels"]
    labels = flat.reshape(len(ids), lengths[0])
    unit = np.floor(dist * UNITS + 0.5).astype(np.int64)
    ends, others = np.concatenate([i, j]), np.concatenate([j, i])
    unit = np.concatenate([unit, unit])
    out = []
    for k in range(labels.shape[1]):
        clusters, of = np.unique(labels[:, k], return_inverse=True)
        cell = ends * len(clusters) + of[others]
        total = np.zeros(len(ids) * len(clusters), np.int64)
        np.add.at(total, cell, unit)
        count = np.bincount(cell, minlength=len(total))
        seen = np.flatnonzero(count)
        out.append((ids[seen // len(clusters)], np.full(len(seen), k), clusters[seen % len(clusters)],
                    total[seen], count[seen]))
    read, k, cluster, total, count = (np.concatenate(c) for c in zip(*out))
    return {"region_id": np.full(len(read), group["region_id"][0], np.int32),
            "read_id": read.astype(np.int32), "k": k.astype(np.int32), "other": cluster,
            "known": total, "n_known": count.astype(np.int64)}


_SUMS = "region_id INT, read_id INT, k INT, other BIGINT, known BIGINT, n_known BIGINT"


def _silhouettes(labels: DataFrame, distances: DataFrame) -> DataFrame:
    """``region_id, read_id, k, cluster_id, silhouette`` for reads with an array ``labels`` of their
    clusters under each labelling ``k``. Pairs are read once for all labellings."""
    known = in_pair_blocks(labels, distances.filter("dist is not null"), "labels", _sums_kernel,
                           _SUMS).groupBy("region_id", "read_id", "k", "other").agg(
        F.sum("known").alias("known"), F.sum("n_known").alias("n_known"))
    mine = labels.select("region_id", "read_id", F.posexplode("labels").alias("k", "own"))
    sizes = mine.groupBy("region_id", "k", F.col("own").alias("other")).agg(
        F.count(F.lit(1)).alias("size"))
    # pairs without a known distance add the largest one each
    n = F.col("size") - F.when(F.col("other") == F.col("own"), 1).otherwise(0)
    total = F.coalesce("known", F.lit(0)) + UNITS * (n - F.coalesce("n_known", F.lit(0)))
    mean = F.when(n > 0, total / n)
    here = F.col("other") == F.col("own")
    per_read = mine.join(sizes, ["region_id", "k"]).join(
        known, ["region_id", "read_id", "k", "other"], "left").groupBy(
        "region_id", "read_id", "k", "own").agg(
        F.max(F.when(here, mean)).alias("a"), F.min(F.when(~here, mean)).alias("b"))
    top = F.greatest("a", "b")
    value = (F.when(F.col("b").isNull(), None).when(F.col("a").isNull() | (top == 0), 0.0)
             .otherwise((F.col("b") - F.col("a")) / top))
    return per_read.select("region_id", "read_id", "k", F.col("own").alias("cluster_id"),
                           value.alias("silhouette"))


def silhouette(labels: DataFrame, distances: DataFrame) -> DataFrame:
    """Silhouette per read: 0 for a singleton, null where a region has one cluster."""
    one = labels.select("region_id", "read_id",
                        F.array(F.col("cluster_id").cast("bigint")).alias("labels"))
    return _silhouettes(one, distances).select(
        "region_id", "read_id", F.col("cluster_id").cast(
            labels.schema["cluster_id"].dataType).alias("cluster_id"), "silhouette")


def cut_silhouette(leaves: DataFrame, distances: DataFrame, ks: list[int]) -> DataFrame:
    """Labels of the cut among ``ks`` with the best mean silhouette (smaller k on ties)."""
    ks = sorted(set(ks))
    marked = _last_merges(leaves, ks[-1] - 1).withColumn(
        "k", F.explode(F.array(*[F.lit(k) for k in ks])))
    starts = F.col("height").isNull() | (F.col("_late") <= F.col("k") - 1)
    cut = _segments(marked, ["region_id", "k"], F.coalesce(starts, F.lit(False)))
    labels = cut.groupBy("region_id", "read_id").agg(
        F.sort_array(F.collect_list(F.struct("k", F.col("cluster_id").cast("bigint").alias("c"))))
        .alias("v")).select("region_id", "read_id", F.col("v.c").alias("labels"))
    # summed as integers, so that equal scores are equal whatever the order of addition
    unit = F.floor(F.col("silhouette") * 1e9 + 0.5)
    scores = _silhouettes(labels, distances).groupBy("region_id", "k").agg(
        (F.sum(unit).cast("double") / F.count("silhouette")).alias("mean"))
    best = scores.groupBy("region_id").agg(F.max(F.struct(
        F.coalesce("mean", F.lit(-2.0 * UNITS)).alias("m"),
        (-F.col("k")).alias("neg"))).alias("b")).select("region_id", (-F.col("b.neg")).alias("at"))
    chosen = F.get(F.array(*[F.lit(k) for k in ks]), F.col("at"))
    return labels.join(best, "region_id").select(
        "region_id", "read_id", F.get("labels", F.col("at")).cast("int").alias("cluster_id"),
        chosen.alias("k"))


def label_reads(labels: DataFrame, reads: DataFrame) -> DataFrame:
    """Cluster labels with haplotype, allele support and sample of each read."""
    return labels.join(reads.select("region_id", "read_id", "hp", "alt_support", "is_tumor"),
                       ["region_id", "read_id"])


def cluster_stats(labels: DataFrame, reads: DataFrame) -> DataFrame:
    """Label counts per cluster; ``UNKNOWN`` allele support is in neither allele count."""
    n = F.count_if
    return label_reads(labels, reads).groupBy("region_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("size"), n(F.col("hp") == 1).alias("count_hp1"),
        n(F.col("hp") == 2).alias("count_hp2"),
        n(~F.col("hp").isin(1, 2)).alias("count_hp_unknown"),
        n(F.col("is_tumor")).alias("count_tumor"), n(~F.col("is_tumor")).alias("count_normal"),
        n(F.col("alt_support") == "ALT").alias("count_alt"),
        n(F.col("alt_support") == "REF").alias("count_ref"))


def methylation_entropy(labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """Mean binary entropy of the methylated share per site, per cluster."""
    p = F.sum("bin") / F.count("bin")
    sites = matrix.filter("bin is not null").join(labels, ["region_id", "read_id"]).groupBy(
        "region_id", "cluster_id", "pos").agg(p.alias("p"))

    def term(x: Column) -> Column:
        return F.when(x > 0, -x * F.log2(x)).otherwise(0.0)

    return sites.groupBy("region_id", "cluster_id").agg(
        F.avg(term(F.col("p")) + term(1 - F.col("p"))).alias("entropy"),
        F.count(F.lit(1)).alias("n_sites"))
