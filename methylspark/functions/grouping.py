"""Grouped Arrow kernels without one Python call per group.

``applyInArrow`` sets up an Arrow stream per group, which dominates when groups
are small and many. Here rows are hash-partitioned and sorted by key, and one
Python call walks over the groups of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_to_runs(df: DataFrame, keys: Sequence[str], kernel: Callable, schema: str,
                  order: Sequence[str] = (), together: bool = False, hold: int = 0) -> DataFrame:
    """``kernel(columns) -> columns or None`` for each group of ``keys``, its rows by ``order``.

    ``columns`` maps names to NumPy arrays, a list column to ``(values, lengths)``.
    Only the rows of the group at hand are held back between Arrow batches. With ``together``
    a kernel gets all groups that a batch completes, and their bounds:
    ``kernel(columns, bounds)`` yields columns. Batches are gathered until they have ``hold`` rows.
    """
    keys = list(keys)
    names = df.columns

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        def arrays(table):
            out = {}
            for name in names:
                column = table.column(name).combine_chunks()
                if isinstance(column, pa.ChunkedArray):
                    column = column.chunk(0)
                if pa.types.is_list(column.type):
                    bounds = column.offsets.to_numpy()
                    out[name] = (column.values.to_numpy(zero_copy_only=False), bounds)
                else:
                    out[name] = column.to_numpy(zero_copy_only=False)
            return out

        def part(data, lo, hi):
            out = {}
            for name, value in data.items():
                if isinstance(value, tuple):
                    flat, bounds = value
                    out[name] = (flat[bounds[lo]:bounds[hi]], np.diff(bounds[lo:hi + 1]))
                else:
                    out[name] = value[lo:hi]
            return out

        def solve(table):
            data = arrays(table)
            changed = np.zeros(table.num_rows, bool)
            changed[0] = True
            for key in keys:
                changed[1:] |= data[key][1:] != data[key][:-1]
            starts = np.flatnonzero(changed)
            if together:
                whole = part(data, 0, table.num_rows)
                for out in kernel(whole, np.append(starts, table.num_rows)):
                    yield from pa.table({k: pa.array(v) for k, v in out.items()}).to_batches(
                        max_chunksize=65536)
                return
            results = [kernel(part(data, lo, hi))
                       for lo, hi in zip(starts, np.append(starts[1:], table.num_rows))]
            results = [r for r in results if r]
            if results:
                joined = {}
                for name in results[0]:
                    pieces = [r[name] for r in results]
                    if isinstance(pieces[0], pa.Array):
                        joined[name] = pa.chunked_array(pieces)
                    else:
                        joined[name] = pa.array(np.concatenate(pieces))
                yield from pa.table(joined).to_batches(max_chunksize=65536)

        held = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # Everything before the last key change is complete.
            last = np.ones(batch.num_rows, bool)
            for key in keys:
                column = batch.column(key).to_numpy(zero_copy_only=False)
                last &= column == column[-1]
            begins = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            same = begins == 0 and held and all(
                held[-1].column(key)[-1].as_py() == batch.column(key)[0].as_py() for key in keys)
            if same or sum(b.num_rows for b in held) < hold:
                held.append(batch)
                continue
            done = held + ([batch.slice(0, begins)] if begins else [])
            if done:
                yield from solve(pa.Table.from_batches(done).combine_chunks())
            held = [batch.slice(begins)]
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    # Partitioning by a hash of the keys, not by the keys: a repartition that an input
    # happens to satisfy is optimised away, and adaptive execution may then change
    # that input's partitioning without knowing that groups must stay whole.
    ordered = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(walk, schema)
