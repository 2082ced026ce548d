"""MinHash near-duplicates with circulant signatures, confirmed on full shingle sets.

Two permutations make a signature: the first spreads a document's shingles over ``SLOTS`` places,
the second ranks the places; coordinate k is the least rank after a circular shift by k. Shifted
ranks lie side by side in memory, so all coordinates of a shingle are one short read.

1. Documents with equal shingle sets form a class, found by a 128-bit digest. Only its least
   document goes on, so groups of exact copies cost one row each.
2. Signatures are cut into bands. Buckets with two or more classes join their documents into
   candidate groups (a similarity of 0.8 goes unseen with probability 3e-6).
3. Inside a candidate group all pairs are compared on full sets, exactly. Groups are cut into blocks
   of bounded size and every pair of blocks is a unit of work of its own; a unit returns a spanning
   forest of its links, never the pairs. Groups above ``REFINE`` documents get larger blocks, which
   changes how often a text is sent but no result.
4. Components of the links.

Null, empty and blank texts have an empty set and link with nothing. Repeated rows of one doc_id
stay rows; should their texts differ, the least one is compared. Rows without doc_id stay, link with nothing, have no
component and are kept. A text of fewer words than ``width`` is one shingle. An empty table gives an
empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylspark.llm.components import components
from methylspark.llm.shingles import mix, shingle_set
from methylspark.llm.tables import Written, maybe_small

SLOTS, BANDS, ROWS = 1 << 19, 32, 5
#: Documents and shingles of a block; documents above which a group has blocks ``WIDER`` times as large.
BLOCK, BLOCK_SHINGLES, REFINE, WIDER = 256, 2_000_000, 20_000, 4

_tables: dict[int, np.ndarray] = {}


def _ranks() -> np.ndarray:
    """Row s: the ranks of places s, s + 1, ... (circular), one per coordinate; a view."""
    if SLOTS not in _tables:
        ranks = np.random.default_rng(20240229).permutation(SLOTS).astype(np.uint32)
        wide = np.concatenate([ranks, ranks[:BANDS * ROWS]])
        _tables[SLOTS] = np.lib.stride_tricks.sliding_window_view(wide, BANDS * ROWS)
    return _tables[SLOTS]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set."""
    ranks = _ranks()
    places = (mix(shingles ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(SLOTS)).astype(np.int64)
    least = np.full(BANDS * ROWS, SLOTS, np.uint32)
    for k in range(0, len(places), 2048):
        np.minimum(least, ranks[places[k:k + 2048]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    with np.errstate(over="ignore"):
        total = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).astype(np.uint64).T:
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n_shingles, d1, d2, bands)``; without digest and bands for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, first, second, bands = [], [], [], []
            for text in batch.column(1):
                raw = text.as_buffer()
                found = shingle_set(raw.to_pybytes() if raw is not None else None, width)
                count.append(len(found))
                if len(found):
                    one, two = np.frombuffer(hashlib.blake2b(
                        found.tobytes(), digest_size=16).digest(), np.int64).tolist()
                    first.append(one)
                    second.append(two)
                    bands.append(band_keys(signature(found)))
                else:
                    first.append(None)
                    second.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "d1", "d2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _groups(buckets: DataFrame, keep: Written) -> DataFrame:
    """``(node, component)`` of documents that share a bucket; ``buckets(key, rep)``."""
    least = buckets.groupBy("key").agg(F.min("rep").alias("least"))
    links = buckets.join(least, "key").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return components(links, keep)


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets are similar enough: a boolean matrix, exact."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((len(sets), len(sets)), np.int64)
    if len(column):
        column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
        step = max(1, 8_000_000 // len(sets))
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = np.zeros((len(sets), step), np.float32)
            part[owner[low:high], column[low:high] % step] = 1
            common += (part @ part.T).astype(np.int64)  # below 2^24, so exact
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join everything that ``linked`` joins, one per joined member."""
    out, open_ = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if open_[root]:
            open_[root] = False
            todo = [root]
            while todo:
                near = np.flatnonzero(linked[todo.pop()] & open_)
                open_[near] = False
                out += [(root, k) for k in near.tolist()]
                todo += near.tolist()
    return out


def _compare(work: DataFrame, width: int, percent: int) -> DataFrame:
    """``(a, b)``: links inside each unit of ``work(unit.., rep, text)``, as spanning forests."""
    def links(ids: list[int], texts: list[bytes]) -> list[tuple[int, int]]:
        sets = [shingle_set(t, width) for t in texts]
        return [(ids[i], ids[j]) for i, j in _forest(_linked(sets, percent))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, texts = None, [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            for (*key, rep), text in zip(keys, batch.column(4), strict=True):
                if key != unit:
                    found += links(ids, texts) if len(ids) > 1 else []
                    unit, ids, texts = key, [], []
                ids.append(rep)
                texts.append(text.as_buffer().to_pybytes())
            yield _pairs(found)
        if len(ids) > 1:
            yield _pairs(links(ids, texts))

    sorted_work = work.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return sorted_work.select("grp", "i", "j", "rep", "text").mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64())
                                       for k in range(2)], ["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80,
                    keep: Written | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row."""
    keep = keep or Written(docs.sparkSession)
    signed = keep(signatures(docs, width))
    reps = signed.filter("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"))
    members = keep(signed.drop("bands").join(reps, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")))

    banded = signed.filter("d1 is not null and doc_id is not null").select(
        "doc_id", "d1", F.explode("bands").alias("key"))
    keys = keep(banded.groupBy("key").agg(F.min("d1").alias("low"), F.max("d1").alias("high"))
                .filter("low <> high").select("key"))
    hits = keep(banded.select("doc_id", "key").join(maybe_small(keys), "key"))
    candidates = keep(hits.select("doc_id").distinct())
    rep_of = members.filter("rep is not null").select("doc_id", "rep").distinct()
    rep_of = keep(rep_of.join(maybe_small(candidates), "doc_id"))
    buckets = keep(hits.join(maybe_small(rep_of), "doc_id").select("key", "rep").distinct())

    groups = keep(_groups(buckets, keep))
    found = components(_compare(_units(docs, groups, members), width, percent), keep)
    named = found.select(F.col("node").alias("rep"), "component")
    return members.join(maybe_small(keep(named)), "rep", "left").select(
        "doc_id", "n_shingles",
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "rep", "doc_id"),
                   F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80,
             keep: Written | None = None) -> DataFrame:
    """One row of each component, that with the least doc_id, with all its columns.

    Of rows that repeat a doc_id one stays; rows without doc_id all stay.
    """
    keep = keep or Written(docs.sparkSession)
    found = keep(near_duplicates(docs, width, percent, keep))
    gone = keep(found.filter("not kept").select("doc_id").distinct())
    again = keep(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter(
        "count > 1").select("doc_id"))
    rest = docs.join(maybe_small(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return rest
    # of rows with one id the least text stays; the given columns lie in a struct
    once = rest.join(maybe_small(again), "doc_id", "left_semi").select(
        "doc_id", F.col("text").alias("order"), F.struct(*docs.columns).alias("doc")).groupBy(
        "doc_id").agg(F.min_by("doc", F.coalesce("order", F.lit(""))).alias("doc")).select("doc.*")
    return rest.join(maybe_small(again), "doc_id", "left_anti").select(*docs.columns).union(once)


def _units(docs: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """``(grp, i, j, rep, text)``: each candidate in all block pairs of its group."""
    size = members.filter("doc_id = rep").groupBy("rep").agg(F.max("n_shingles").alias("n"))
    placed = groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")).join(
        size, "rep")
    many = F.count("*")
    blocks = placed.groupBy("grp").agg(F.greatest(
        F.ceil(many / F.when(many > REFINE, WIDER * BLOCK).otherwise(BLOCK)),
        F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    units = placed.join(blocks, "grp").select(
        "rep", "grp", block.alias("mine"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).select(
        "rep", "grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    wanted = groups.select(F.col("node").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = texts.join(maybe_small(wanted), "doc_id", "left_semi").filter(
        "text is not null").groupBy(F.col("doc_id").alias("rep")).agg(F.min("text").alias("text"))
    return units.join(texts, "rep")
