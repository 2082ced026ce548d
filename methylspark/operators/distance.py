"""Read-read distances per region, computed in bounded blocks of reads.

Pairs are never formed by a self-join over sites. Each read is packed into one
row, reads are cut into blocks by ``read_id``, and a task gets two blocks of one
region at a time. A region with very many reads thus spreads over many tasks,
and the pair x site intermediate exists only inside a task.

For the metrics on binary states a read is a row of 64-bit words, one mask and one
value word for every 64 sites, put together by Spark before the shuffle; a pair is
then an XOR and two bit counts, for all groups of a batch at once.

A table of distances holds only pairs that are known. What a missing pair counts
as stays implied: the operators that need all pairs add it (``fill_missing_pairs``
as rows, ``distance_matrix`` as arrays, clustering and silhouettes as sums).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.functions import placement
from methylspark.functions.grouping import apply_to_runs
from methylspark.operators.matrix import binary_state
from methylspark.params import METRICS, Params
from methylspark.schemas import DISTANCES

BLOCK_READS = 256
#: Pairs of packed reads that a task looks at in one go.
PAIRS = 1 << 18
#: Up to so many sites, and pairs times sites, a group is worked on together with others; a larger one
#: is worth matrix products of its own.
GROUP_SITES, GROUP_CELLS = 128, 1 << 14


def _block_kernel(metric: str, every: bool):
    """Distances between the two read blocks of one group; with ``every`` also of pairs without a
    common site."""

    def kernel(group):
        import numpy as np
        import pyarrow as pa

        region = group["region_id"][0]
        block_i, block_j = group["block_i"][0], group["block_j"][0]
        ids, blocks = group["read_id"], group["block"]
        sites, counts = group["sites"]
        levels = group["levels"][0]
        row = np.repeat(np.arange(len(ids)), counts)
        names, col = np.unique(sites, return_inverse=True)
        seen = np.zeros((len(ids), max(len(names), 1)))
        value = np.zeros_like(seen)
        weight = np.ones(seen.shape[1])
        seen[row, col] = 1.0
        value[row, col] = levels
        if metric == "nhd_weighted" and len(sites):
            weight[col] = group["weights"][0]

        order = np.argsort(ids, kind="stable")
        left, right = order[blocks[order] == block_i], order[blocks[order] == block_j]
        m, x, mt, xt = seen[left], value[left], seen[right].T, value[right].T
        n = m @ mt
        with np.errstate(divide="ignore", invalid="ignore"):
            if metric == "nhd_weighted":
                w = weight[:, None]
                differing = x @ (w * (mt - xt)) + (m - x) @ (w * xt)
                dist = differing / (m @ (w * mt))
            elif metric == "l1":
                total = np.empty_like(n)
                for i in range(len(left)):
                    total[i] = (np.abs(xt - x[i][:, None]) * mt * m[i][:, None]).sum(axis=0)
                dist = total / (255.0 * n)
            elif metric == "l2":
                dist = ((x * x) @ mt + m @ (xt * xt) - 2.0 * (x @ xt)) / (65025.0 * n)
            else:
                sx, sy = x @ mt, m @ xt
                var = (n * ((x * x) @ mt) - sx * sx) * (n * (m @ (xt * xt)) - sy * sy)
                dist = 1.0 - (n * (x @ xt) - sx * sy) / np.sqrt(var)
                dist[var <= 0] = np.nan
        i, j = (np.triu_indices(len(left), 1) if block_i == block_j
                else tuple(a.ravel() for a in np.indices(n.shape)))
        if not every:
            shared = n[i, j] > 0
            i, j = i[shared], j[shared]
        d = np.where(n[i, j] > 0, dist[i, j], np.nan)
        return {
            "region_id": np.full(len(i), region, np.int32),
            "read_i": ids[left][i].astype(np.int32),
            "read_j": ids[right][j].astype(np.int32),
            "n_common": n[i, j].astype(np.int32),
            "dist": pa.array(d, mask=~np.isfinite(d)),
        }

    return kernel


def _partners(block, block_i, same, bounds):
    """Where the partners of each row begin, and how many pairs the rows before it have: partners of a
    read are the reads behind it in its block, or all of the other block."""
    import numpy as np

    ends = np.repeat(bounds[1:], np.diff(bounds))
    turn = np.flatnonzero((np.diff(block) != 0) & (np.diff(ends) == 0)) + 1
    second = ends.copy()  # where the second block of a row's group begins
    group = np.searchsorted(bounds, turn, "right") - 1
    for g, first in zip(group.tolist(), turn.tolist()):
        second[bounds[g]:bounds[g + 1]] = first
    begin = np.where(same, np.arange(len(block)) + 1, second)
    partners = np.where(same | (block == block_i), ends - begin, 0)
    return begin, np.append(0, np.cumsum(partners))


def _pair_chunks(begin, upto):
    """Rows of the pairs of ``_partners``, some at a time."""
    import numpy as np

    low, rows = 0, len(begin)
    while low < rows:
        high = max(int(np.searchsorted(upto, upto[low] + PAIRS, "right")) - 1, low + 1)
        many = np.diff(upto[low:high + 1])
        i = np.repeat(np.arange(low, high), many)
        yield i, begin[i] + np.arange(len(i)) - np.repeat(upto[low:high] - upto[low], many)
        low = high


def _cell_kernel(metric: str, every: bool):
    """``_block_kernel`` for all small groups of a batch at once: a pass over the pairs for each place
    among the sites of a group, which pairs of groups with fewer sites leave early."""
    alone = _block_kernel(metric, every)

    def kernel(rows, bounds):
        import numpy as np
        import pyarrow as pa

        sites, counts = rows["sites"]
        levels = rows["levels"][0]
        weights = rows["weights"][0] if metric == "nhd_weighted" else None
        of_row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        row = np.repeat(np.arange(len(of_row)), counts)
        stride = np.int64(sites.max(initial=0)) + 1
        names, col = np.unique(of_row[row] * stride + sites, return_inverse=True)
        first = np.searchsorted(names, np.arange(len(bounds)) * stride)
        width, col = np.diff(first), col - first[of_row[row]]
        begin, upto = _partners(rows["block"], rows["block_i"], rows["block_i"] == rows["block_j"],
                                bounds)
        pairs = upto[bounds[1:]] - upto[bounds[:-1]]
        small = (width <= GROUP_SITES) & (pairs * width <= GROUP_CELLS)
        cells = np.append(0, np.cumsum(counts))
        for g in np.flatnonzero(~small & (pairs > 0)).tolist():
            lo, hi = int(bounds[g]), int(bounds[g + 1])
            yield alone({name: (value[0][cells[lo]:cells[hi]], value[1][lo:hi])
                         if isinstance(value, tuple) else value[lo:hi]
                         for name, value in rows.items()})
        # Groups with many sites come first, so that the pairs that have a further place lead a chunk.
        kept = np.flatnonzero((small & (pairs > 0))[of_row])
        if not len(kept):
            return
        kept = kept[np.argsort(-width[of_row[kept]], kind="stable")]
        region, ids, block, block_i, block_j = (rows[c][kept] for c in (
            "region_id", "read_id", "block", "block_i", "block_j"))
        wide = width[of_row[kept]]
        place = np.full(len(of_row), -1)
        place[kept] = np.arange(len(kept))
        there = np.flatnonzero(place[row] >= 0)
        at = col[there], place[row[there]]
        seen = np.zeros((int(wide.max(initial=0)), len(kept)), bool)
        value, weight = np.zeros(seen.shape), None
        seen[at] = True
        value[at] = levels[there]
        if weights is not None:
            weight = np.zeros(seen.shape)
            weight[at] = weights[there]
        starts = np.flatnonzero(np.append(True, np.diff(of_row[kept]) != 0))
        begin, upto = _partners(block, block_i, block_i == block_j, np.append(starts, len(kept)))
        for i, j in _pair_chunks(begin, upto):
            n = np.zeros(len(i), np.int64)
            sums = np.zeros((5, len(i)))
            for w in range(int(wide[i[0]]) if len(i) else 0):
                last = np.searchsorted(-wide[i], -w)
                a, b = i[:last], j[:last]
                both = seen[w][a] & seen[w][b]
                x, y = value[w][a] * both, value[w][b] * both
                n[:last] += both
                if metric == "corr":
                    for k, term in enumerate((x, y, x * x, y * y, x * y)):
                        sums[k, :last] += term
                elif metric == "l2":
                    sums[0, :last] += (x - y) ** 2
                elif metric == "l1":
                    sums[0, :last] += np.abs(x - y)
                else:
                    both = both * weight[w][a]
                    sums[0, :last] += np.abs(x - y) * both
                    sums[1, :last] += both
            if not every:
                shared = n > 0
                i, j, n, sums = i[shared], j[shared], n[shared], sums[:, shared]
            with np.errstate(divide="ignore", invalid="ignore"):
                if metric == "corr":
                    sx, sy, sxx, syy, sxy = sums
                    var = (n * sxx - sx * sx) * (n * syy - sy * sy)
                    dist = 1.0 - (n * sxy - sx * sy) / np.sqrt(var)
                    dist[var <= 0] = np.nan
                else:
                    dist = sums[0] / (sums[1] if weights is not None else
                                      (255.0 if metric == "l1" else 65025.0) * n)
            yield {"region_id": region[i].astype(np.int32), "read_i": ids[i].astype(np.int32),
                   "read_j": ids[j].astype(np.int32), "n_common": n.astype(np.int32),
                   "dist": pa.array(dist, mask=(n == 0) | ~np.isfinite(dist))}

    return kernel


def _word_kernel(metric: str, every: bool):
    """Distances of all pairs of the groups of a batch from their mask and value words; with ``every``
    also of pairs without a common site."""

    def kernel(rows, bounds):
        import numpy as np
        import pyarrow as pa

        region, ids, block = rows["region_id"], rows["read_id"], rows["block"]
        word, counts = rows["words"]
        n_words = int(word.max(initial=0)) + 1
        at = np.repeat(np.arange(len(ids)), counts), word
        mask, value = (np.zeros((len(ids), n_words), np.uint64) for _ in range(2))
        mask[at] = rows["masks"][0].astype(np.int64).view(np.uint64)
        value[at] = rows["bits"][0].astype(np.int64).view(np.uint64)
        begin, upto = _partners(block, rows["block_i"], rows["block_i"] == rows["block_j"], bounds)
        for i, j in _pair_chunks(begin, upto):
            n, x, y = (np.zeros(len(i), np.int64) for _ in range(3))
            for w in range(n_words):
                both = mask[i, w] & mask[j, w]
                n += np.bitwise_count(both)
                if metric == "nhd":
                    x += np.bitwise_count((value[i, w] ^ value[j, w]) & both)
                else:
                    x += np.bitwise_count(value[i, w] & value[j, w])
                    y += np.bitwise_count((value[i, w] | value[j, w]) & both)
            if not every:
                shared = n > 0
                i, j, n, x, y = i[shared], j[shared], n[shared], x[shared], y[shared]
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = x / n if metric == "nhd" else np.where(y > 0, 1.0 - x / y, 0.0)
            yield {"region_id": region[i].astype(np.int32), "read_i": ids[i].astype(np.int32),
                   "read_j": ids[j].astype(np.int32), "n_common": n.astype(np.int32),
                   "dist": pa.array(dist, mask=n == 0)}

    return kernel


def _pack(reads: DataFrame, matrix: DataFrame, level: str, weighted: bool,
          every: bool) -> DataFrame:
    """One row per kept read that has a site (or of ``every`` one), with the arrays of its sites and
    levels."""
    fields = ["cpg_id", F.col(level).cast("double").alias("level")]
    if weighted:
        fields.append(F.col("weight").cast("double").alias("weight"))
    rows = matrix.filter(F.col(level).isNotNull()).groupBy("region_id", "read_id").agg(
        F.collect_list(F.struct(*fields)).alias("v"))
    out = [F.col("v.cpg_id").alias("sites"), F.col("v.level").alias("levels")]
    if weighted:
        out.append(F.col("v.weight").alias("weights"))
    return _kept(reads, rows.select("region_id", "read_id", *out), every)


def _kept(reads: DataFrame, rows: DataFrame, every: bool, carry: Sequence[str] = ()) -> DataFrame:
    """``rows`` of reads that are there, with columns of the reads; with ``every`` also reads without a
    row, by empty arrays."""
    keys = ["region_id", "read_id"]
    if not every:
        return rows.join(reads.select(*keys, *carry), keys, "inner" if carry else "left_semi")
    return reads.select(*keys, *carry).join(rows, keys, "left").select(*keys, *carry, *(
        F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name)
        for f in rows.schema if f.name not in keys))


def pack_words(matrix: DataFrame) -> DataFrame:
    """``words, masks, bits`` of every read with a binary state: which words of 64 sites it has, and
    of each the sites it covers and those that are methylated. Words are put together before the
    shuffle."""
    bit = F.expr("shiftleft(1L, cpg_id % 64)")
    words = matrix.filter("bin is not null").groupBy(
        "region_id", "read_id", F.expr("cast(cpg_id div 64 as int)").alias("word")).agg(
        F.bit_or(bit).alias("mask"),
        F.bit_or(F.when(F.col("bin") == 1, bit).otherwise(0)).alias("bits"))
    return words.groupBy("region_id", "read_id").agg(
        F.collect_list(F.struct("word", "mask", "bits")).alias("v")).select(
        "region_id", "read_id", F.col("v.word").alias("words"), F.col("v.mask").alias("masks"),
        F.col("v.bits").alias("bits"))


def _last_blocks(reads: DataFrame, block_reads: int) -> DataFrame:
    return reads.groupBy("region_id").agg(
        F.expr(f"cast(max(read_id) div {block_reads} as int)").alias("last"))


def _in_block_pairs(rows: DataFrame, reads: DataFrame, block_reads: int) -> DataFrame:
    """``rows`` of reads, each once for every pair of blocks that its block is in."""
    return _to_block_pairs(rows.join(_last_blocks(reads, block_reads), "region_id"), block_reads)


def _to_block_pairs(rows: DataFrame, block_reads: int) -> DataFrame:
    """The same for rows that bring the ``last`` block of their region."""
    spread = rows.withColumn("block", F.expr(f"cast(read_id div {block_reads} as int)")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    return spread.withColumn("block_i", F.least("block", "other")).withColumn(
        "block_j", F.greatest("block", "other")).drop("other")


_BLOCK_KEYS = ["region_id", "block_i", "block_j"]


def pair_distances(reads: DataFrame, matrix: DataFrame, metric: str = "nhd",
                   block_reads: int = BLOCK_READS, every: bool = False) -> DataFrame:
    """Pairs ``read_i < read_j`` of each region that share a site, with ``n_common`` and ``dist``.

    With ``every`` all pairs of a region are there. ``dist`` is null where it is undefined (no common
    site, no variance). ``matrix`` needs ``bin`` for the binary metrics, ``ml`` for the others and
    ``weight`` besides ``bin`` for ``nhd_weighted``.
    """
    if metric not in METRICS + ("nhd_weighted",):
        raise ValueError(f"unknown metric {metric}")
    if metric in ("nhd", "jaccard"):
        rows = _kept(reads, pack_words(matrix), every)
    else:
        level = "bin" if metric == "nhd_weighted" else "ml"
        rows = _pack(reads, matrix, level, metric == "nhd_weighted", every)
    return _compared(_in_block_pairs(rows, reads, block_reads), metric, every)


def _compared(rows: DataFrame, metric: str, every: bool) -> DataFrame:
    kernel = _word_kernel if metric in ("nhd", "jaccard") else _cell_kernel
    return apply_to_runs(rows, _BLOCK_KEYS, kernel(metric, every), DISTANCES,
                         order=["block", "read_id"], together=True)


def list_distances(reads: DataFrame, lists: DataFrame, metric: str, params: Params = Params(),
                   block_reads: int = BLOCK_READS, every: bool = False) -> DataFrame:
    """``pair_distances`` from cells as lists ``cpg_id`` and ``ml``, one row per read (of
    ``matrix.numbered_lists``): no cell is a row, and lists are shuffled to their reads and to their
    blocks only."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric in ("nhd", "jaccard"):
        state = F.transform("ml", lambda v: F.coalesce(
            binary_state(params, v / F.lit(255.0)), F.lit(-1)).cast("smallint"))
        rows = lists.select("region_id", "read_id", "cpg_id", state.alias("bin")).mapInArrow(
            placement.words_of_lists, placement.WORD_FIELDS)
    else:
        rows = lists.select("region_id", "read_id", F.col("cpg_id").alias("sites"),
                            F.col("ml").cast("array<double>").alias("levels"))
    placed = reads.select("region_id", "read_id").join(_last_blocks(reads, block_reads), "region_id")
    return _compared(_to_block_pairs(_kept(placed, rows, every, ["last"]), block_reads), metric, every)


def read_pairs(reads: DataFrame, matrix: DataFrame) -> DataFrame:
    """Pairs of reads that share sites, with how many they share."""
    covered = matrix.withColumn("bin", F.when(F.col("ml").isNotNull(), 1))
    return pair_distances(reads, covered, "nhd").select(
        "region_id", "read_i", "read_j", "n_common")


def known_pairs(distances: DataFrame, params: Params = Params()) -> DataFrame:
    """Pairs with a distance from enough common sites; the others stay implied."""
    return distances.filter((F.col("n_common") >= params.min_common_coverage)
                            & F.col("dist").isNotNull())


def all_pairs(reads: DataFrame) -> DataFrame:
    """Every pair ``read_i < read_j`` of each region: one row per read grows to its partners."""
    ids = reads.groupBy("region_id").agg(F.sort_array(F.collect_list("read_id")).alias("ids"))
    place = F.array_position("ids", F.col("read_id")).cast("int")
    return reads.select("region_id", "read_id").join(ids, "region_id").select(
        "region_id", F.col("read_id").alias("read_i"), F.explode(F.slice(
            "ids", place + 1, F.size("ids") - place)).alias("read_j"))


def _fill_kernel(filler: float):
    """All pairs of the groups of a batch from their reads (negative ``read_j``) and known pairs."""

    def kernel(rows, bounds):
        import numpy as np
        import pyarrow as pa

        here = rows["read_j"] < 0
        of_row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        group, ids = of_row[here].astype(np.int64), rows["read_i"][here].astype(np.int64)
        region, block, block_i, block_j = (rows[c][here] for c in (
            "region_id", "block", "block_i", "block_j"))
        starts = np.searchsorted(group, np.arange(len(bounds)))
        begin, upto = _partners(block, block_i, block_i == block_j, starts)
        stride = np.int64(max(int(rows["read_i"].max()), int(rows["read_j"].max()), 0)) + 1
        key, known = np.append(group * stride + ids, -1), np.flatnonzero(~here)
        ends = [of_row[known] * stride + rows[c][known] for c in ("read_i", "read_j")]
        first, second = (np.searchsorted(key[:-1], end) for end in ends)
        there = (key[first] == ends[0]) & (key[second] == ends[1])
        known, first, second = known[there], first[there], second[there]
        at = upto[first] + second - begin[first]
        order = np.argsort(at)
        at, dist, common = at[order], rows["dist"][known][order], rows["n_common"][known][order]
        done = 0
        for i, j in _pair_chunks(begin, upto):
            value, n = np.full(len(i), filler), np.zeros(len(i), np.int32)
            lo, hi = np.searchsorted(at, (done, done + len(i)))
            value[at[lo:hi] - done] = dist[lo:hi]
            n[at[lo:hi] - done] = common[lo:hi]
            done += len(i)
            yield {"region_id": region[i].astype(np.int32), "read_i": ids[i].astype(np.int32),
                   "read_j": ids[j].astype(np.int32), "n_common": n,
                   "dist": pa.array(value, mask=np.isnan(value))}

    return kernel


def fill_missing_pairs(reads: DataFrame, distances: DataFrame, params: Params = Params(),
                       block_reads: int = BLOCK_READS) -> DataFrame:
    """All pairs; those without a known distance get 1.0 (``max_dist``) or null (``skip``).

    Only reads and known pairs are shuffled; the others arise inside the pairs of read blocks.
    """
    known = known_pairs(distances, params)
    members = _in_block_pairs(reads.select("region_id", "read_id"), reads, block_reads).select(
        *_BLOCK_KEYS, "block", F.col("read_id").alias("read_i"), F.lit(-1).alias("read_j"),
        F.lit(0).alias("n_common"), F.lit(0.0).alias("dist"))
    of = "cast({} div " + str(block_reads) + " as int)"
    pairs = known.select(
        "region_id", F.expr(of.format("read_i")).alias("block_i"),
        F.expr(of.format("read_j")).alias("block_j"), F.lit(0).alias("block"), "read_i", "read_j",
        F.col("n_common").cast("int").alias("n_common"), "dist")
    filler = 1.0 if params.missing_pairs == "max_dist" else float("nan")
    return apply_to_runs(members.unionByName(pairs), _BLOCK_KEYS, _fill_kernel(filler), DISTANCES,
                         order=["read_j", "read_i"], together=True)


def in_pair_blocks(reads: DataFrame, distances: DataFrame, payload: str, kernel, schema: str,
                   block_reads: int = BLOCK_READS) -> DataFrame:
    """``kernel`` on each pair of read blocks: its reads with ``payload`` (an array of BIGINT; such
    rows have a negative ``read_j``), then the known pairs between the two blocks.

    Pairs are shuffled once, and reads go to as many groups as their region has blocks.
    """
    nothing = F.array().cast("array<bigint>")
    members = _in_block_pairs(reads.select("region_id", "read_id", payload), reads, block_reads)
    members = members.select(*_BLOCK_KEYS, F.col("read_id").alias("read_i"),
                             F.lit(-1).alias("read_j"), F.lit(0.0).alias("dist"), payload)
    block = "cast({} div " + str(block_reads) + " as int)"
    pairs = distances.select(
        "region_id", F.expr(block.format("read_i")).alias("block_i"),
        F.expr(block.format("read_j")).alias("block_j"), "read_i", "read_j", "dist",
        nothing.alias(payload))
    return apply_to_runs(members.unionByName(pairs), _BLOCK_KEYS, kernel, schema,
                         order=["read_j", "read_i"])


def split_group(group):
    """Of a group of ``in_pair_blocks``: its reads in order, and its pairs as places in them."""
    import numpy as np

    n = int(np.searchsorted(group["read_j"], 0))
    ids = group["read_i"][:n]
    return ids, (np.searchsorted(ids, group["read_i"][n:]),
                 np.searchsorted(ids, group["read_j"][n:])), group["dist"][n:]


def _matrix_kernel(block_reads: int, filler: float):
    """The two blocks of a group as rows of the whole matrix."""

    def kernel(group):
        import numpy as np
        import pyarrow as pa

        ids, (i, j), dist = split_group(group)
        whole = np.full((len(ids), len(ids)), filler)
        whole[i, j] = dist
        whole[j, i] = dist
        np.fill_diagonal(whole, 0.0)
        block_i, block_j = int(group["block_i"][0]), int(group["block_j"][0])
        of = ids // block_reads
        out = []
        for rows, columns in {(block_i, block_j), (block_j, block_i)}:
            cells = whole[of == rows][:, of == columns]
            out.append((ids[of == rows], np.full(len(cells), columns), cells))
        flat = np.concatenate([cells.ravel() for _, _, cells in out])
        sizes = np.concatenate([np.full(len(c), c.shape[1]) for _, _, c in out])
        values = pa.array(flat, mask=np.isnan(flat))
        return {"region_id": np.full(len(sizes), group["region_id"][0], np.int32),
                "read_id": np.concatenate([r for r, _, _ in out]).astype(np.int32),
                "part": np.concatenate([p for _, p, _ in out]).astype(np.int32),
                "dist": pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)}

    return kernel


def distance_matrix(reads: DataFrame, distances: DataFrame, params: Params = Params(),
                    block_reads: int = BLOCK_READS) -> DataFrame:
    """Symmetric matrix with zero diagonal: one row per read, its distances to all reads of the
    region in order. Blocks of rows come from the tasks and are only joined end to end."""
    filler = 1.0 if params.missing_pairs == "max_dist" else float("nan")
    parts = in_pair_blocks(
        reads.withColumn("_none", F.array().cast("array<bigint>")), known_pairs(distances, params),
        "_none", _matrix_kernel(block_reads, filler),
        "region_id INT, read_id INT, part INT, dist ARRAY<DOUBLE>", block_reads)
    return parts.groupBy("region_id", "read_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "dist"))).alias("p")).select(
        "region_id", "read_id", F.flatten("p.dist").alias("dist"))


def site_weights(matrix: DataFrame, flags: DataFrame, pmd_weight: int = 1,
                 open_weight: int = 4) -> DataFrame:
    """Attach integer site weights: sites in PMDs count less instead of being dropped."""
    return matrix.join(flags.select("chrom", "pos", "in_pmd"), ["chrom", "pos"], "left") \
        .withColumn("weight", F.when(F.col("in_pmd"), pmd_weight).otherwise(open_weight)) \
        .drop("in_pmd")
