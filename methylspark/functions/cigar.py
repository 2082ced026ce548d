"""Column expressions over CIGAR text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the SAM format: which operations use up read or reference bases.
QUERY_OPS = "MIS=X"
REFERENCE_OPS = "MDN=X"
ALIGNED_OPS = "M=X"


def _total(cigar: Column, ops: str) -> Column:
    counts = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(counts, F.lit(0), lambda acc, n: acc + n.cast("int"))


def query_length(cigar: Column) -> Column:
    """Bases of the read, soft clips included."""
    return _total(cigar, QUERY_OPS)


def reference_end(cigar: Column, align_start: Column) -> Column:
    """Exclusive 0-based end; a record without reference span counts as one base."""
    return align_start + F.greatest(_total(cigar, REFERENCE_OPS), F.lit(1))


def aligned_offset(cigar: Column, align_start: Column, pos0: Column) -> Column:
    """0-based read offset aligned to reference ``pos0``, -1 when there is none."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))

    def step(acc: Column, op: Column) -> Column:
        n = F.substring(op, F.lit(1), F.length(op) - 1).cast("int")
        letter = F.right(op, F.lit(1))
        ref, query, found = acc["ref"], acc["query"], acc["found"]
        here = (letter.isin(*ALIGNED_OPS) & (found < 0) & (ref <= pos0) & (pos0 < ref + n))
        return F.struct(
            (ref + F.when(letter.isin(*REFERENCE_OPS), n).otherwise(0)).alias("ref"),
            (query + F.when(letter.isin(*QUERY_OPS), n).otherwise(0)).alias("query"),
            F.when(here, query + pos0 - ref).otherwise(found).alias("found"))

    start = F.struct(align_start.cast("int").alias("ref"), F.lit(0).alias("query"),
                     F.lit(-1).alias("found"))
    return F.aggregate(ops, start, step, lambda acc: acc["found"])
