import random

import pytest

from methylspark.operators import intervals
from methylspark.operators.ranking import dense_row_number, running_sum


@pytest.mark.parametrize("block", [1, 3, 65536])
def test_dense_row_number(spark, block):
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), rng.randint(0, 4), k) for k in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "g INT, s INT, k BIGINT")
    got = dense_row_number(df, ["g"], ["s", "k"], "n", block)
    want = {}
    for g in range(3):
        for i, r in enumerate(sorted(r for r in rows if r[0] == g)):
            want[r] = i
    assert {(r.g, r.s, r.k): r.n for r in got.collect()} == want
    whole = dense_row_number(df, [], ["k"], "n", block)
    assert [r.n for r in whole.orderBy("k").collect()] == list(range(120))


@pytest.mark.parametrize("block", [1, 4, 65536])
def test_running_sum(spark, block):
    rng = random.Random(2)
    rows = [(g, i, rng.randint(0, 3)) for g in range(2) for i in range(30)]
    df = spark.createDataFrame(rows, "g INT, i INT, v INT")
    got = {(r.g, r.i): r.t for r in running_sum(df, ["g"], "i", "v", "t", block).collect()}
    for g, i, _ in rows:
        assert got[g, i] == sum(v for h, j, v in rows if h == g and j <= i)


def _spans(rng, n):
    out = []
    for k in range(n):
        lo = rng.randint(0, 300)
        out.append((k, rng.choice(["a", "b"]), lo, lo + rng.choice([0, 3, 40, 150])))
    return out


@pytest.mark.parametrize("copy_right", [False, True])
def test_overlap_join(spark, copy_right):
    rng = random.Random(3)
    left, right = _spans(rng, 60), _spans(rng, 40)
    l_df = spark.createDataFrame(left, "k INT, chrom STRING, lo INT, hi INT")
    r_df = spark.createDataFrame(right, "j INT, chrom STRING, x INT, y INT")
    got = intervals.overlap_join(l_df, r_df, ("lo", "hi"), ("x", "y"), "k", width=16, salts=3,
                                 copy_right=copy_right)
    pairs = [(r.k, r.j) for r in got.collect()]
    want = [(a[0], b[0]) for a in left for b in right
            if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]]
    assert sorted(pairs) == sorted(want)


def test_touched_bins_is_a_superset_without_repeats(spark):
    rng = random.Random(4)
    left, right = _spans(rng, 80), _spans(rng, 5)
    l_df = spark.createDataFrame(left, "k INT, chrom STRING, lo INT, hi INT")
    r_df = spark.createDataFrame(right, "j INT, chrom STRING, x INT, y INT")
    got = [r.k for r in intervals.in_touched_bins(
        l_df, r_df, ("lo", "hi"), ("x", "y"), width=16).collect()]
    want = {a[0] for a in left for b in right
            if a[1] == b[1] and a[2] // 16 <= b[3] // 16 and b[2] // 16 <= a[3] // 16}
    assert len(got) == len(set(got)) and set(got) == want


def test_classes_at(spark):
    rng = random.Random(5)
    names = ["PMD", "REPRESSIVE", "ACCESSIBLE"]
    bed = [(c, lo, hi + 1, rng.choice(names)) for _, c, lo, hi in _spans(rng, 12)]
    sites = [(rng.choice(["a", "b", "z"]), rng.randint(1, 460)) for _ in range(200)]
    got = intervals.classes_at(
        spark.createDataFrame(sites, "chrom STRING, pos INT"),
        spark.createDataFrame(bed, "chrom STRING, start INT, end INT, cls STRING"), width=32)
    rows = got.collect()
    assert len(rows) == len(set(sites))
    for r in rows:
        flags = tuple(any(c == r.chrom and s < r.pos <= e and k == n for c, s, e, k in bed)
                      for n in names)
        assert (r.in_pmd, r.in_repressive_state, r.accessible) == flags


def test_many_windows_of_one_read(spark):
    """1,000 windows and 20,000 calls of one read meet in far fewer than 20 million pairs."""
    from methylspark.operators import matrix
    reads = spark.range(1000).selectExpr(
        "cast(id as int) region_id", "0 read_id", "7L read_key", "cast(id * 2000 + 1 as int) win_start",
        "cast(id * 2000 + 2001 as int) win_end")
    calls = spark.range(20000).selectExpr("7L read_key", "'c' chrom", "cast(id * 100 + 50 as int) pos",
                                          "cast(9 as smallint) ml")
    assert matrix._meetings(reads, calls).count() < 100_000
    cells = matrix.region_calls(reads, calls)
    assert cells.count() == 20000
    assert cells.filter("pos <= region_id * 2000 + 1 or pos >= region_id * 2000 + 2001").count() == 0


def test_windows_looked_up_while_decoding(spark, monkeypatch):
    """Overlapping, unequal, empty and repeated windows, a few candidates at a time."""
    from methylspark.functions import placement
    from methylspark.operators import calls, matrix
    rng = random.Random(31)
    seq = "".join(rng.choice("CG") for _ in range(400))
    n_c = seq.count("C")
    rows = []
    for k in range(40):
        deltas = [rng.randrange(3) for _ in range(n_c // 3)]
        rows.append((k, f"chr{k % 3}", rng.randrange(900), "100M20I50M30D200M30S", seq,
                     "C+m?," + ",".join(map(str, deltas)) + ";", [k % 250] * len(deltas)))
    aln = spark.createDataFrame(rows, "read_key LONG, chrom STRING, align_start INT, cigar STRING, "
                                "seq STRING, mm STRING, ml ARRAY<SMALLINT>")
    wide = [(g, f"chr{g % 4}", s, s + rng.choice([1, 2, 40, 300]))
            for g, s in enumerate(rng.choices(range(1, 1300), k=80))]
    windows = spark.createDataFrame(wide + [(99, *wide[0][1:])],
                                    "region_id INT, chrom STRING, win_start INT, win_end INT")
    reads = windows.join(aln.select("read_key", "chrom"), "chrom").selectExpr(
        "region_id", "cast(read_key as int) read_id", "read_key", "win_start", "win_end")
    want = matrix.region_calls(reads, calls.project_calls(calls.modified_bases(aln)))
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 1000
    for most in (placement.CANDIDATES, 10):
        monkeypatch.setattr(placement, "CANDIDATES", most)
        found = calls.calls_in_windows(aln, windows)
        assert found.groupBy("region_id", "read_key").count().filter("count > 1").count() == 0
        assert sorted(map(tuple, matrix.window_cells(reads, found).collect())) == want
    assert calls.calls_in_windows(aln, windows.limit(0)).count() == 0


def test_reference_columns_by_rank(spark):
    """Windows that share ends, lie on sites, hold none, or come in great number in one bin."""
    from methylspark.operators import matrix
    rng = random.Random(37)
    sites = {(f"chr{k % 2}", p) for k, p in enumerate(rng.sample(range(1, 60000), 900))}
    wide = [(g, f"chr{g % 3}", s, s + rng.choice([0, 1, 2, 30, 900, 40000]))
            for g, s in enumerate([p for _, p in list(sites)[:60]] + rng.choices(range(500), k=200))]
    regions = spark.createDataFrame(wide, "region_id INT, chrom STRING, win_start INT, win_end INT")
    cells = spark.createDataFrame([(0, p) for _, p in sites for _ in range(2)],
                                  "region_id INT, pos INT")
    rows = matrix.matrix_ref_columns(cells, regions, spark.createDataFrame(
        sorted(sites), "chrom STRING, pos INT")).collect()
    want = set()
    for g, chrom, lo, hi in wide:
        inside = sorted(p for c, p in sites if c == chrom and lo < p < hi)
        want |= {(g, k, chrom, p, 2 if g == 0 else 0) for k, p in enumerate(inside)}
    assert set(map(tuple, rows)) == want and len(rows) == len(want)
