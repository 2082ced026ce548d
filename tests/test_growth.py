"""Steps whose work or shuffled rows must grow with their input, and no faster."""

import random

from pyspark.sql import functions as F

from methylspark.functions import placement
from methylspark.operators import calls, matrix
from methylspark.params import Params


def _alignments(spark, n, n_chroms, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        seq = "".join(rng.choice("CG") for _ in range(60))
        deltas = [rng.randrange(2) for _ in range(10)]
        rows.append((k, f"chr{k % n_chroms}", rng.randrange(200), "20M5I10M5D25M", seq,
                     "C+m?," + ",".join(map(str, deltas)) + ";", [k % 250] * len(deltas)))
    return spark.createDataFrame(rows, "read_key LONG, chrom STRING, align_start INT, cigar STRING, "
                                 "seq STRING, mm STRING, ml ARRAY<SMALLINT>")


def test_windows_are_looked_up_for_all_chromosomes_of_a_batch_at_once(spark, monkeypatch):
    """A batch of 500 reads on 500 chromosomes gives one batch, not one per chromosome."""
    aln = _alignments(spark, 500, 500)
    windows = aln.selectExpr("cast(read_key as int) region_id", "chrom",
                             "align_start + 5 win_start", "align_start + 45 win_end")
    kernels, whole = [], placement.place_in_windows
    monkeypatch.setattr(placement, "place_in_windows",
                        lambda shared: kernels.append(whole(shared)) or kernels[0])
    found = calls.calls_in_windows(aln, windows).count()
    batch = calls._decodable(aln, Params()).toArrow().combine_chunks().to_batches()
    assert [len(b) for b in batch] == [500]
    assert [len(b) for b in kernels[0](batch)] == [found] and found > 400


def test_reads_bring_their_windows(spark, monkeypatch):
    """Calls in the windows of their own read, without calls as rows of a shuffle."""
    aln = _alignments(spark, 60, 3)
    windows = spark.createDataFrame(
        [(g, f"chr{g % 3}", s, s + w) for g, (s, w) in enumerate(zip(range(1, 260, 4), [1, 2, 30, 200] * 17))],
        "region_id INT, chrom STRING, win_start INT, win_end INT")
    reads = windows.join(aln.select("read_key", "chrom"), "chrom").filter(
        "(region_id + read_key) % 4 > 0").selectExpr(
        "region_id", "cast(read_key + 7 as int) read_id", "read_key", "win_start", "win_end")
    want = sorted(map(tuple, matrix.region_calls(
        reads, calls.project_calls(calls.modified_bases(aln))).collect()))
    assert len(want) > 1000
    for most in (placement.CANDIDATES, 5):
        monkeypatch.setattr(placement, "CANDIDATES", most)
        found = calls.calls_in_own_windows(aln, reads)
        assert found.groupBy("region_id", "read_key").count().filter("count > 1").count() == 0
        assert sorted(map(tuple, matrix.own_window_cells(found).collect())) == want
    assert calls.calls_in_own_windows(aln, reads.limit(0)).count() == 0


def test_calls_meet_sites_as_arrays(spark, monkeypatch):
    """Validated calls equal those of a join row by row, but fewer rows than calls are joined."""
    aln = _alignments(spark, 80, 3)
    sites = spark.range(300).filter("id % 3 > 0").selectExpr(
        "concat('chr', id % 2) chrom", "cast(id as int) pos")
    single = calls.project_calls(calls.modified_bases(aln))
    want = sorted(map(tuple, calls.validate_cpg(single, sites).collect()))
    for width in (512, 16):
        monkeypatch.setattr(calls, "SITE_BIN_BP", width)
        got = calls.methylation_calls(aln, sites)
        assert sorted((*r,)[:4] for r in got.collect()) == want and len(want) > 100
        batches = calls._decodable(aln, Params()).toArrow().to_batches()
        packed = sum(map(len, placement.place_in_bins(width)(batches)))
        assert packed < single.count() / 2
    assert calls.methylation_calls(aln.limit(0), sites).count() == 0
    assert calls.methylation_calls(aln, sites.limit(0)).count() == 0


def test_alignment_text_is_packed_and_dealt_out(spark):
    """The text of all reads is gzipped, in order, in as many files as the shuffle has tasks of size."""
    import glob

    from methylspark.plans import catalog
    small = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["load_alignments"](spark, small).count()
    files = glob.glob(f"{catalog.store_of(spark, small).path('sam')}/part-*")
    assert files and all(f.endswith(".txt.gz") for f in files)
    assert rows == spark.read.parquet(f"{small}/lineitem.parquet").count()


def test_calls_are_packed_for_the_shuffle(spark):
    """Calls go to their sites as four bytes each, whatever the probability; reads are not taken apart
    by expressions that filters would repeat, and sites are looked up without a sort."""
    aln = _alignments(spark, 60, 3).withColumn("ml", F.expr(
        "transform(ml, (v, i) -> cast(v + 100 * i - 300 as smallint))"))
    sites = spark.range(400).filter("id % 3 > 0").selectExpr(
        "concat('chr', id % 2) chrom", "cast(id as int) pos")
    want = calls.validate_cpg(calls.project_calls(calls.modified_bases(aln)), sites).collect()
    got = calls.methylation_calls(aln, sites.union(sites))
    assert sorted((*r,)[:4] for r in got.collect()) == sorted(map(tuple, want))
    values = {r.ml for r in want}
    assert min(values) < 0 and max(values) > 255
    assert not any(x in _plan(got) for x in ("regexp", "collect_set")) and "strategy=shuffle_hash" in _plan(got)
    batches = calls._decodable(aln, Params()).toArrow().to_batches()
    single = calls.project_calls(calls.modified_bases(aln)).count()
    packed = [x for b in placement.place_in_bins(512)(batches) for x in b.column("calls").to_pylist()]
    assert sum(map(len, packed)) == 4 * single


def test_tags_and_cigars_as_text(spark):
    """Odd tags and CIGARs: sections without deltas, long and empty numbers, too few probabilities."""
    def read(mm, ml, cigar="20M", seq="C" * 20):
        return (len(rows), "chr1", 10, cigar, seq, mm, ml)

    rows = []
    for mm, ml in [("C+m?,1,2,0;", [1, 2, 3]), ("C+h?,0,3;C+m?,0;", [7, 8, 9]), ("C+m?;", [1]), ("C+m?,;", [1]),
                   ("C+m?,12,0,,1", [4, 5, 6, 7]), ("C+m?,0,0;", [1]), ("C+m?x,1;", [1]), ("C+m?,1,x2;", [5, 6]),
                   ("C+m?", [1]), ("", []), (None, [1]), ("C+m?,1;", None), ("C+m?,007;", [3])]:
        rows.append(read(mm, ml))
    for cigar in ("5S10M5I", "10M7D10M", "*", None, "5H9=1X10=", "12"):
        rows.append(read("C+m?,0,8,1;", [1, 2, 3], cigar))
    rows.append(read("C+m?,0;", [1], "3M"))
    df = spark.createDataFrame(rows, "read_key LONG, chrom STRING, align_start INT, cigar STRING, seq STRING, "
                               "mm STRING, ml ARRAY<SMALLINT>").coalesce(1)
    got = {}
    for r in calls.modified_bases(df).collect():
        got.setdefault(r.read_key, []).append((r.seq_idx, r.pos, r.ml))
    at = lambda *x: [(i, None if p is None else p + 11, v) for i, p, v in x]
    assert got == {
        0: at((1, 1, 1), (4, 4, 2), (5, 5, 3)), 1: at((0, 0, 9)), 4: at((12, 12, 4), (13, 13, 5), (15, 15, 6)),
        7: at((1, 1, 5)), 12: at((7, 7, 3)), 13: at((0, None, 1), (9, 4, 2), (11, 6, 3)),
        14: at((0, 0, 1), (9, 9, 2), (11, 18, 3)), 15: at((0, None, 1), (9, None, 2), (11, None, 3)),
        16: at((0, None, 1), (9, None, 2), (11, None, 3)), 17: at((0, 0, 1), (9, 9, 2), (11, 11, 3)),
        18: at((0, None, 1), (9, None, 2), (11, None, 3)), 19: at((0, 0, 1))}


def test_calls_of_all_reads_write_no_reads(spark, monkeypatch):
    """Both queries give the rows of the written table of reads without it, and move each contig once."""
    from methylspark.plans import catalog, star
    small = "/root/testdata/sf0.001"
    every = catalog.alignments_of(spark, small)
    want = sorted(map(str, catalog._per_read(catalog._all_calls(spark, small, every), "pos").collect()))
    for needless in ("run_of", "alignments_of", "contigs_of"):
        monkeypatch.delattr(catalog, needless)
    assert sorted(map(str, catalog.QUERIES["validate_cpg"](spark, small).collect())) == want and len(want) > 100
    found = catalog.QUERIES["methylation_calls"](spark, small)
    assert sum(r.n_calls for r in found.collect()) > 1000
    assert "ReusedExchange [doc_id" in found._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in _plan(star.contigs(spark, small, usable=True)).split("RepartitionByExpression")[1]
    assert "regexp" not in _plan(star.tiles(spark, small)).split("RepartitionByExpression")[1]


def test_probabilities_are_made_for_a_batch_at_a_time(spark):
    """ML values equal those written out one by one, and no expression goes over them."""
    from methylspark.plans import star
    rows = [(z, z // 7 % 2, z % 5 * (z % 11 > 0), z % 23) for z in range(0, 4194304, 7919)]
    found = spark.createDataFrame(rows, "z LONG, hap INT, n_h INT, n_m INT").select(
        "z", star._probabilities(*(F.col(c) for c in ("z", "hap", "n_h", "n_m"))).alias("ml"))
    got = {r.z: r.ml for r in found.collect()}
    for z, hap, n_h, n_m in rows:
        want = [(z * 197 % 256 + i) * 13 % 256 for i in range(n_h)] + [
            (i * 37 + z) % 256 if (i + z) % 6 == 0 else 255 - (i * i * 7 + z % 60) % 60 if hap
            else (i + z // 11 % 5) % 5 * 11 + z % 11 for i in range(n_m)]
        assert got[z] == (want[:-1] if z % 37 == 0 else want)
    plan = _plan(star.alignments(spark, "/root/testdata/sf0.001").select("ml"))
    assert "ArrowEvalPython" in plan and "smallint" not in plan


def test_alignment_text_is_made_behind_the_shuffle(spark, monkeypatch, write):
    """Reads are dealt out as bases and numbers, in order, without a run or a table of all reads; lines
    are numbered without a shuffle of theirs."""
    from methylspark.plans import catalog, star
    from methylspark.sources import variants
    small = "/root/testdata/sf0.001"
    every = catalog.alignments_of(spark, small)
    for needless in ("run_of", "alignments_of"):
        monkeypatch.delattr(catalog, needless)
    parsed = catalog.QUERIES["load_alignments"](spark, small).collect()
    found = star.alignments_by_key(spark, small)
    moved = _plan(found).split("RepartitionByExpression")[0].splitlines()[-2:]
    assert all(x not in "".join(moved) for x in ("III", "C+m", "qname"))
    keys = [r.read_key for r in found.select("read_key").collect()]
    assert keys == sorted(keys) and len(keys) == len(parsed) == every.count()
    assert found.columns == every.columns and found.exceptAll(every).count() == 0
    in_order = {r.qname: n for n, r in enumerate(every.select("qname").orderBy("read_key").collect())}
    assert {r.qname: r.read_key for r in parsed} == in_order
    lines = variants.read_lines(spark, write("a.txt", "b\na\n"))
    assert "strategy=broadcast" in _plan(lines) and sorted(lines.collect(), key=lambda r: r.ord)[0].value == "b"


def test_only_reads_near_a_window_get_their_bases(spark):
    """The reads of a run are few, equal to those of the whole table, and give the same pairs."""
    from methylspark.operators import reads
    from methylspark.plans import catalog
    small = "/root/testdata/sf0.001"
    run, every = catalog.run_of(spark, small), catalog.alignments_of(spark, small)
    assert 0 < run.alignments.count() < 0.6 * every.count()
    assert run.alignments.exceptAll(every).count() == 0
    whole = reads.overlapping_reads(every, run.live_regions, catalog.PARAMS)
    assert sorted(map(str, whole.collect())) == sorted(map(str, run.overlaps.collect()))


def test_windows_bring_their_sites(spark):
    """Cells on sites equal those of a join call by call; sites at bin borders and windows without any."""
    aln = _alignments(spark, 60, 3)
    windows = spark.createDataFrame(
        [(g, f"chr{g % 3}", s, s + w) for g, (s, w) in enumerate(zip(range(1, 260, 4), [1, 2, 30, 300] * 17))],
        "region_id INT, chrom STRING, win_start INT, win_end INT")
    reads = windows.join(aln.select("read_key", "chrom"), "chrom").selectExpr(
        "region_id", "cast(read_key + 7 as int) read_id", "read_key", "win_start", "win_end")
    found = calls.calls_in_own_windows(aln, reads)
    sites = spark.range(600).filter("id % 3 > 0 or id = 255").selectExpr(
        "concat('chr', id % 2) chrom", "cast(id as int) pos")
    for some in (sites, sites.limit(0)):
        want = matrix.own_window_cells(found, some).collect()
        assert sorted(map(tuple, matrix.cells_on_sites(found, windows, some).collect())) == sorted(map(tuple, want))
        assert (len(want) > 300) == (some is sites)


def test_gates_are_decided_per_site(spark):
    """The gated matrix equals that of gates applied cell by cell, with fewer shuffles."""
    rows = [(g, i, 100 * g + i, f"chr{g % 2}", s, (37 * i + 11 * s) % 256)
            for g in range(4) for i in range(9) for s in range(5, 40) if (s * (i + 1) + g) % 3]
    cells = spark.createDataFrame(
        rows, "region_id INT, read_id INT, read_key LONG, chrom STRING, pos INT, ml SMALLINT")
    flags = cells.select("chrom", "pos", (F.col("pos") % 4 == 0).alias("in_pmd")).distinct()
    params = Params(min_site_coverage=7)
    whole = matrix.binarize(matrix.region_matrix(cells), params)
    for some in (flags, None):
        want = matrix.gate_coverage(whole if some is None else matrix.gate_pmd(whole, some), params)
        got = matrix.gated_matrix(cells, params, some)
        assert got.columns == want.columns and 0 < want.count() < len(rows)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in (got, want)]
        assert joins[0] < joins[1]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reads_are_dealt_out_once(spark):
    """Reads meet their contig, its length, tiles and windows in one join; the table is as before."""
    from methylspark.operators import reads
    from methylspark.plans import catalog, star
    small = "/root/testdata/sf0.001"
    contigs = catalog.contigs_of(spark, small)
    assert _plan(star.alignments(spark, small, contigs)).count("Join ") == 1
    run = catalog.run_of(spark, small)
    near = star.alignments(spark, small, contigs, reads.well_mapped(catalog.PARAMS), run.regions)
    assert _plan(near).count("Join ") == 2 and "arrays_overlap" not in _plan(near)


def test_variants_are_placed_once(spark):
    """Numbering and filters read written records; no text is searched again."""
    from methylspark.plans import catalog, star
    small = "/root/testdata/sf0.001"
    found = star.snvs(spark, small, catalog.records_of(spark, small))
    assert "instr" not in _plan(found) and "instr" in _plan(star.snvs(spark, small))
    assert sorted(map(str, found.collect())) == sorted(map(str, star.snvs(spark, small).collect()))


def test_cells_stay_packed_until_they_are_numbered(spark):
    """Matrix, wide matrix and reference columns from packed cells equal those from cells as rows, and a
    run writes one row per read and window."""
    from methylspark.plans import catalog
    run = catalog.run_of(spark, "/root/testdata/sf0.001")
    cells, packed = run.cells.cache(), run.packed
    assert 0 < packed.count() == cells.select("region_id", "read_id").distinct().count() < cells.count()
    assert packed.select("region_id", "read_id").distinct().count() == packed.count()
    rows = matrix.region_matrix(cells)

    def same(got, want):
        assert got.columns == want.columns and want.count() > 100
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    same(matrix.numbered_matrix(packed, run.counts), rows)
    same(run.gated, matrix.gated_matrix(cells, run.params, run.flags))
    same(matrix.packed_matrix_wide(run.reads, packed, run.counts), matrix.region_matrix_wide(run.reads, rows))
    same(matrix.ref_columns(run.window_sites, run.counts),
         matrix.matrix_ref_columns(cells, run.live_regions, run.sites))
    assert _plan(run.matrix).count("Join ") == 1 and "explode" not in _plan(run.matrix)
    assert matrix.numbered_matrix(packed, run.counts.limit(0)).count() == 0
    cells.unpersist()


def test_sites_are_found_as_arrays(spark, monkeypatch):
    """Sites per bin and window equal those of a row for every site, also where all tiles are searched,
    and reference columns need one join."""
    from methylspark.operators import intervals
    from methylspark.sources import reference
    rng = random.Random(3)
    contigs = spark.createDataFrame(
        [(f"chr{k}", "".join(rng.choice("ACGcgN") for _ in range(n))) for k, n in enumerate((9000, 700, 1, 512))],
        "chrom STRING, seq STRING")
    windows = spark.createDataFrame([(g, f"chr{g % 5 if s < 700 else 0}", s, s + w) for g, (s, w) in enumerate(
        zip([1, 250, 4000, 4095, 8900, 255, 256, 257], [600, 6, 400, 2, 300, 1, 2, 300]))],
        "region_id INT, chrom STRING, win_start INT, win_end INT")
    tiles = reference.tile_reference(contigs)
    sites = reference.reference_cpg_sites(tiles).collect()
    want = {}
    for w in windows.collect():
        inside = sorted(s.pos for s in sites if s.chrom == w.chrom and w.win_start < s.pos < w.win_end)
        want |= {w.region_id: inside} if inside else {}
    found = 0
    for most in (intervals.BROADCAST_ROWS, 2):
        monkeypatch.setattr(intervals.fits_broadcast, "__defaults__", (most,))
        near = reference.tiles_near_regions(tiles, windows)
        assert (near.count() == tiles.count()) == (most == 2)
        bins = reference.cpg_site_bins(near, matrix.SITE_BIN_BP)
        got = matrix.window_sites(windows, bins)
        assert {r.region_id: r.sites for r in got.collect()} == want and len(want) >= 4
        found += bins.count()
    assert 0 < found < len(sites)
    counts = spark.createDataFrame([(0, 5, 2)], "region_id INT, pos INT, n LONG")
    assert _plan(matrix.ref_columns(got, counts)).count("Join ") <= 3


def test_bases_go_once_through_the_interval_join(spark, monkeypatch):
    """Beyond a broadcast reads meet their windows in one join, with the same pairs."""
    from methylspark.operators import intervals, reads
    from methylspark.plans import catalog
    run = catalog.run_of(spark, "/root/testdata/sf0.001")
    want = sorted(map(str, run.overlaps.collect()))
    monkeypatch.setattr(intervals.fits_broadcast, "__defaults__", (3,))
    found = reads.overlapping_reads(run.alignments, run.live_regions, catalog.PARAMS)
    assert _plan(found).count("Join ") == 1
    assert sorted(map(str, found.collect())) == want and len(want) > 100


def _rows_of(outputs):
    """Rows of the outputs of a kernel, in order of their text."""
    import pyarrow as pa
    return sorted(str(row) for out in outputs for row in pa.table(
        {k: pa.array(v) for k, v in out.items()}).to_pylist())


def test_small_regions_are_merged_together():
    """Trees of 300 regions come in a few steps, and are those of one region at a time."""
    import numpy as np

    from methylspark.operators import cluster
    rng = np.random.default_rng(4)
    parts, bounds = [], [0]
    for region in range(300):
        n = int(rng.integers(1, 12)) if region else cluster.BATCH_READS + 3
        names = np.sort(rng.choice(100, n, replace=False))
        i, j = (names[k] for k in np.triu_indices(n, 1))
        known = rng.random(len(i)) < 0.7
        unit = np.floor(rng.choice([0, 0.25, 1 / 3, 0.5, 1.0], known.sum()) * cluster.UNITS + 0.5)
        parts.append((np.full(n + known.sum(), 2 * region), np.append(names, i[known]),
                      np.append(names, j[known]), np.append(np.zeros(n), unit).astype(np.int64)))
        bounds.append(bounds[-1] + len(parts[-1][0]))
    rows = dict(zip(("region_id", "read_i", "read_j", "unit"), map(np.concatenate, zip(*parts))))
    for method in cluster.METHODS:
        for tree in (False, True):
            one = cluster._cluster_kernel(method, tree)
            want = [one({k: v[lo:hi] for k, v in rows.items()}) for lo, hi in zip(bounds, bounds[1:])]
            got = list(cluster._batch_kernel(method, tree)(rows, np.array(bounds)))
            assert len(got) <= 12 and _rows_of(got) == _rows_of(want)


def test_batches_are_gathered(spark):
    """A kernel gets whole groups, and with ``hold`` those of several batches at once."""
    from methylspark.functions.grouping import apply_to_runs

    def sizes(rows, bounds):
        import numpy as np
        yield {"groups": np.array([len(bounds) - 1]), "rows": np.array([bounds[-1]])}

    df = spark.range(40_000).selectExpr("cast(id div 70 as int) g", "id")
    found = {}
    for hold in (0, 1 << 20):
        got = apply_to_runs(df, ["g"], sizes, "groups LONG, rows LONG", together=True, hold=hold).collect()
        assert sum(r.groups for r in got) == 572 and sum(r.rows for r in got) == 40_000
        found[hold] = len(got)
    assert found[1 << 20] <= 4


def test_small_groups_are_compared_together(monkeypatch):
    """Distances of 200 groups come in a few steps, and are those of one group at a time."""
    import numpy as np

    from methylspark.operators import distance
    rng = np.random.default_rng(6)
    rows, bounds, sites, levels, counts = [], [0], [], [], []
    for g in range(200):
        two = g % 3 == 0
        for read in range(int(rng.integers(1, 9)) if g else 60):
            mine = rng.choice(150 if g == 1 else 12, int(rng.integers(0, 12)), replace=False)
            rows.append((g, 0, int(two), read if not two else read * 5, int(two and read * 5 >= 20)))
            sites.append(mine)
            levels.append(rng.choice([0, 10, 51, 204, 255], len(mine)).astype(float))
            counts.append(len(mine))
        bounds.append(len(rows))
    names = ("region_id", "block_i", "block_j", "read_id", "block")
    data = dict(zip(names, np.array(rows).T))
    flat = np.concatenate(sites)
    weights = np.where(flat % 3 == 0, 1.0, 4.0)
    upto = np.append(0, np.cumsum(counts))

    def group(lo, hi):
        part = slice(upto[lo], upto[hi])
        return {k: v[lo:hi] for k, v in data.items()} | {
            k: (v[part], np.array(counts[lo:hi])) for k, v in cells.items()}

    for metric in ("l1", "l2", "corr", "nhd_weighted"):
        value = np.concatenate(levels)
        cells = {"sites": flat, "weights": weights,
                 "levels": (value > 100).astype(float) if metric == "nhd_weighted" else value}
        for every in (True, False):
            one = distance._block_kernel(metric, every)
            want = _rows_of(one(group(lo, hi)) for lo, hi in zip(bounds, bounds[1:]))
            for places in (1 << 14, 100):
                monkeypatch.setattr(distance, "GROUP_CELLS", places)
                got = list(distance._cell_kernel(metric, every)(group(0, len(rows)), np.array(bounds)))
                assert _rows_of(got) == want and len(want) > 1000
                assert places == 100 or len(got) <= 5


def test_missing_pairs_arise_in_blocks(spark):
    """Only reads and known pairs are joined and shuffled; the result is that of a join with all pairs."""
    from methylspark.operators import distance
    reads = spark.range(60).selectExpr("cast(id div 20 as int) region_id", "cast(id % 20 as int) read_id")
    reads = reads.filter("region_id < 2 or read_id < 1")
    known = distance.all_pairs(reads).filter("(read_i * 7 + read_j) % 3 = 0").selectExpr(
        "*", "cast((read_i + read_j) % 6 as int) n_common", "read_j / 40 dist")
    known = spark.createDataFrame(known.collect(), known.schema)
    stray = known.selectExpr("region_id", "read_i", "read_j + 100 read_j", "n_common", "dist")
    for params in (Params(), Params(missing_pairs="skip")):
        filler = 1.0 if params.missing_pairs == "max_dist" else None
        want = distance.all_pairs(reads).join(
            known.filter("n_common >= 3"), ["region_id", "read_i", "read_j"], "left").select(
            "region_id", "read_i", "read_j", F.coalesce("n_common", F.lit(0)).alias("n_common"),
            F.coalesce("dist", F.lit(filler).cast("double")).alias("dist"))
        want = sorted(map(str, want.collect()))
        for block in (256, 6):
            got = distance.fill_missing_pairs(reads, known.union(stray), params, block)
            assert sorted(map(str, got.collect())) == want and len(want) == 380
            assert _plan(got).count("Join ") == 1


def test_distances_come_from_lists(spark):
    """Distances from cells as lists equal those from cells as rows, and a run writes no row per cell."""
    from methylspark.operators import distance
    from methylspark.plans import catalog
    run = catalog.run_of(spark, "/root/testdata/sf0.001")
    reads, gated, lists = run.reads.cache(), run.gated.cache(), run.gated_lists.cache()
    assert 0 < lists.count() == gated.select("region_id", "read_id").distinct().count() < gated.count()
    for metric, every, block in (("nhd", True, 3), ("jaccard", False, 256), ("l1", True, 256),
                                 ("l2", False, 3), ("corr", True, 3)):
        want = distance.pair_distances(reads, gated, metric, block, every)
        got = distance.list_distances(reads, lists, metric, run.params, block, every)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert want.count() > 100 and _plan(got).count("Join ") <= 2
    assert distance.list_distances(reads, lists.limit(0), "nhd", every=False).count() == 0
    wide = spark.createDataFrame(
        [(1, r, [0, 63, 64, 200], [255, 0, v, 255]) for r, v in enumerate((0, 255, 128))],
        "region_id INT, read_id INT, cpg_id ARRAY<INT>, ml ARRAY<SMALLINT>")
    got = {(r.read_i, r.read_j): (r.n_common, r.dist) for r in distance.list_distances(
        wide.select("region_id", "read_id"), wide, "nhd", run.params).collect()}
    assert got == {(0, 1): (4, 0.25), (0, 2): (3, 0.0), (1, 2): (3, 0.0)}
    for df in (reads, gated, lists):
        df.unpersist()


def test_only_covered_sites_are_looked_up_in_the_annotation(spark, monkeypatch):
    """Sites below the coverage gate are dropped before the sweep over the annotation."""
    from methylspark.plans import catalog, region_run
    run = catalog.run_of(spark, "/root/testdata/sf0.001")
    want = sorted(map(str, matrix.gated_counts(run.counts, run.params, run.flags).collect()))
    asked, whole = [], region_run.classes_at
    monkeypatch.setattr(region_run, "classes_at", lambda sites, spans: asked.append(sites) or whole(sites, spans))
    again = region_run.RegionRun(run.snvs, run.alignments, run.contigs, run.params, run.annotation,
                                 store=run.store)
    assert sorted(map(str, again._gated_counts.collect())) == want and want
    assert [sites.filter(f"n < {run.params.min_site_coverage}").count() for sites in asked] == [0]
