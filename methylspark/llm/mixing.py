"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). A
flow network routes words from patterns to the quotas of sources: a pattern offers its words once
for cost 1, a second time for 3 more, a third time for 5 more (convex, so nothing repeats before
everything was used), each edge to one of its sources. What flows out of a pattern is then taken
from its documents in a seeded order: whole rounds of all documents, and for the rest documents in
hash order while they fit the quota. Documents are taken whole or not at all: what the first that does
not fit leaves open is filled with smaller ones, from :data:`FILLERS` of each power of two of words,
or by that document itself, whichever comes nearer.

The rest is found without sorting a source: words are summed by ``BUCKETS`` hash buckets, and only
the bucket in which the quota is reached is put in order (a thousandth of a source).

Null source is a source of its own, after all others. Null text has no words; documents without
words take none. Repeated rows are separate documents; an empty table gives an empty result. The
patterns come to the driver, at most ``MAX_PATTERNS`` of them, else an error is raised. Reruns on
the same rows agree. Only the named columns are read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methylspark.llm.tables import Written, maybe_small

WORD = r"[^ \t\n\x0B\f\r]+"
MAX_REPEATS, BUCKETS, MAX_PATTERNS = 3, 1024, 200_000
#: Documents of each size class that are tried for what is left open.
FILLERS = 16
WEIGHTS = (1, 2, 3)


def targets(sizes: dict[str, int], weights: dict[str, float],
            max_repeats: int = MAX_REPEATS) -> dict[str, float]:
    """Shares of all words by weight, none above ``max_repeats`` times its source's size."""
    found: dict[str, float] = {}
    free = dict(weights)
    left = float(sum(sizes.values()))
    while free:
        total = sum(free.values())
        over = [s for s, w in free.items() if left * w / total > max_repeats * sizes[s]]
        if not over:
            found |= {s: left * w / total for s, w in free.items()}
            break
        for s in over:
            found[s] = float(max_repeats * sizes[s])
            del free[s]
        left = float(sum(sizes.values())) - sum(found.values())
    return found


def flow(patterns: dict[tuple[str, ...], int], quotas: dict[str, int],
         max_repeats: int = MAX_REPEATS) -> dict[tuple[tuple[str, ...], str], int]:
    """Words that go from each pattern to each source: a cheapest maximum flow."""
    out = {}
    for members in _parts(patterns):
        out |= _route(members, patterns, quotas, max_repeats)
    return out


def _parts(patterns) -> list[list[tuple[str, ...]]]:
    """Patterns that are joined by common sources, which can be routed by themselves."""
    by_source: dict[str, list] = {}
    for p in patterns:
        for s in p:
            by_source.setdefault(s, []).append(p)
    seen, parts = set(), []
    for first in patterns:
        if first not in seen:
            seen.add(first)
            part = [first]
            for p in part:
                for s in p:
                    for q in by_source.pop(s, ()):
                        if q not in seen:
                            seen.add(q)
                            part.append(q)
            parts.append(part)
    return parts


def _route(members, patterns, quotas, max_repeats):
    """Successive shortest paths on one part of the network."""
    room, cost, near = {}, {}, {}

    def arc(a, b, capacity, price):
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            room[x, y], cost[x, y] = c, p
            near.setdefault(x, []).append(y)

    for p in members:
        for k in range(max_repeats):  # a node per repetition, as two nodes share one arc only
            arc("from", (p, k), patterns[p], 2 * k + 1)
            arc((p, k), p, patterns[p], 0)
        for s in p:
            arc(p, ("source", s), max_repeats * patterns[p], 0)
    for s in {s for p in members for s in p}:
        arc(("source", s), "to", quotas.get(s, 0), 0)
    while True:
        best, back, queue, waiting = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for b in near[a]:
                if room[a, b] > 0 and best[a] + cost[a, b] < best.get(b, float("inf")):
                    best[b], back[b] = best[a] + cost[a, b], a
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if "to" not in back:
            break
        path, at = [], "to"
        while at != "from":
            path.append((back[at], at))
            at = back[at]
        amount = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= amount
            room[b, a] += amount
    return {(p, s): used for p in members for s in p if (used := room[("source", s), p])}


def membership(sources: Column) -> Column:
    """Sorted names of a row's sources: ``s`` + name, or ``~`` for null."""
    return F.array_sort(F.array_distinct(F.transform(
        sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~")))))


def row_key(pattern: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), pattern)


def mix(docs: DataFrame, sources: Column, seed: int = 17, weights=None,
        max_repeats: int = MAX_REPEATS, keep: Written | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, row_key, pattern, size, taken)`` of every row, and ``(source, source_size,
    target)``.

    ``sources``: array of the sources of a row. ``weights``: source -> weight; without it sources
    weigh 1, 2, 3, repeating, by code point. Sources are named as in :func:`membership`.
    """
    spark = docs.sparkSession
    keep = keep or Written(spark)
    pattern = membership(sources)
    sized = keep(docs.select(
        F.col("doc_id").alias("doc_id"), pattern.alias("pattern"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(pattern, seed).alias("row_key"),
        F.monotonically_increasing_id().alias("row")))  # tells repeated rows apart once written
    totals = keep(sized.groupBy("pattern").agg(F.sum("size").alias("n")))
    if totals.count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r.pattern): r.n for r in totals.collect()}

    sizes: dict[str, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    # by code point: Python compares strings so, and ~ is above the s of all named sources
    order = sorted(sizes)
    given = weights or {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(order)}
    wanted = targets(sizes, {s: given[s] for s in order}, max_repeats)
    routed = flow(patterns, {s: int(wanted[s] + 0.5) for s in order}, max_repeats)
    used: dict[tuple[str, ...], int] = {}
    for (p, _), n in routed.items():
        used[p] = used.get(p, 0) + n
    plan = spark.createDataFrame(
        [(list(p), used.get(p, 0) // n, used.get(p, 0) % n) for p, n in patterns.items() if n],
        "pattern array<string>, rounds long, rest long")
    told = spark.createDataFrame([(s, sizes[s], wanted[s]) for s in order],
                                 "source string, source_size long, target double")

    bucket = F.shiftrightunsigned("row_key", 64 - BUCKETS.bit_length() + 1)
    planned = sized.withColumn("bucket", bucket).join(F.broadcast(plan), "pattern", "left")
    by_bucket = planned.filter("rest > 0").groupBy("pattern", "rest", "bucket").agg(
        F.sum("size").alias("n"))
    until = by_bucket.withColumn("until", F.sum("n").over(
        Window.partitionBy("pattern").orderBy("bucket")))  # at most BUCKETS rows each
    edge = until.filter("until >= rest and until - n < rest").select(
        "pattern", F.col("bucket").alias("edge"), (F.col("until") - F.col("n")).alias("before"))
    placed = planned.join(F.broadcast(edge), "pattern", "left")
    whole = F.col("size") * F.coalesce("rounds", F.lit(0))
    inside = Window.partitionBy("pattern").orderBy("row_key", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    columns = ["doc_id", "row_key", "pattern", "size", "row", whole.alias("whole")]
    apart = placed.filter("edge is null or bucket <> edge").select(
        *columns, (F.col("bucket") < F.col("edge")).alias("fits"),
        F.lit(None).cast("long").alias("open"))
    at_edge = placed.filter("bucket = edge").withColumn(
        "open", F.col("rest") - F.col("before") - F.sum("size").over(inside) + F.col("size")).select(
        *columns, (F.col("open") >= F.col("size")).alias("fits"), "open")
    dealt = keep(apart.unionByName(at_edge))
    # the first document that does not fit says how much is left open
    gaps = keep(dealt.filter("not fits and open > 0").groupBy("pattern").agg(
        F.max(F.struct("open", "size", "row")).alias("at")).select(
        "pattern", F.col("at.open").alias("gap"), (F.col("at.size") - F.col("at.open")).alias("over"),
        F.col("at.row").alias("first")))
    filling = dealt.filter("not fits and size > 0").join(F.broadcast(gaps), "pattern").filter(
        "size <= gap").groupBy("pattern", F.floor(F.log2("size")).alias("class"), F.pmod(
            "row_key", F.lit(FILLERS)).alias("lot")).agg(
        F.min(F.struct("row_key", "doc_id", "size", "row")).alias("x"))
    tries = filling.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct(
        "x.size", "x.row_key", "x.doc_id", "x.row")), False).alias("tries"))
    start = F.struct(F.col("gap").alias("left"), F.array().cast("array<long>").alias("rows"))
    filled = F.aggregate("tries", start, lambda s, x: F.when(x["size"] <= s["left"], F.struct(
        (s["left"] - x["size"]).alias("left"), F.array_append(s["rows"], x["row"]).alias("rows")))
        .otherwise(s))
    # or that document itself, where it comes nearer
    chosen = gaps.join(tries, "pattern", "left").withColumn("filled", F.coalesce(filled, start)).select(
        F.when(F.col("over") < F.col("filled.left"), F.array("first")).otherwise(
            F.col("filled.rows")).alias("rows"))
    extra = keep(chosen.select(F.explode("rows").alias("row"), F.lit(True).alias("fills")))
    taken = F.col("whole") + F.when(F.coalesce("fits", F.lit(False)) | F.coalesce(
        "fills", F.lit(False)), F.col("size")).otherwise(0)
    return dealt.join(maybe_small(extra), "row", "left").select(
        "doc_id", "row_key", "pattern", "size", taken.alias("taken")), told


def take(docs: DataFrame, sources: Column, mixed: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with their columns.

    Rows that repeat each other in id, text and sources are taken together, as copies of one of them.
    """
    names = docs.columns
    told = mixed.filter("taken > 0").groupBy("row_key").agg(
        F.sum("taken").alias("take"), F.max("size").alias("size"))
    # the given columns lie in a struct, so that no name can clash
    mine = docs.select(row_key(membership(sources), seed).alias("row_key"),
                       F.struct(*names).alias("doc")).dropDuplicates(["row_key"])
    spread = mine.join(told, "row_key").withColumn("copy", F.explode(F.sequence(
        F.lit(1), (F.col("take") / F.col("size")).cast("int"))))
    return spread.select(*(F.col("doc")[c].alias(c) for c in names))
