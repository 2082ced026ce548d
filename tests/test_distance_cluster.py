import math
import random

import pytest

from methylspark.operators import assoc, cluster, distance
from methylspark.params import Params


def cells(seed, n_reads=(9, 5, 1), sites=12):
    rng = random.Random(seed)
    rows = []
    for region, n in enumerate(n_reads):
        for read in range(n):
            for site in range(sites):
                if rng.random() < 0.6:
                    ml = rng.choice([0, 10, 51, 100, 204, 250, 255])
                    b = 1 if ml >= 204 else 0 if ml <= 51 else None
                    rows.append((region, read, site, ml, b, rng.choice([1, 4])))
    reads = [(g, i) for g, n in enumerate(n_reads) for i in range(n)]
    return rows, reads


def brute(metric, a, b):
    key = 4 if metric in ("nhd", "jaccard") else 3
    x = {r[2]: r[key] for r in a if r[key] is not None}
    y = {r[2]: r[key] for r in b if r[key] is not None}
    both = sorted(set(x) & set(y))
    n = len(both)
    if n == 0:
        return 0, None
    p, q = [x[s] for s in both], [y[s] for s in both]
    if metric == "nhd":
        return n, sum(abs(u - v) for u, v in zip(p, q)) / n
    if metric == "l1":
        return n, sum(abs(u - v) for u, v in zip(p, q)) / 255 / n
    if metric == "l2":
        return n, sum((u - v) ** 2 for u, v in zip(p, q)) / 65025 / n
    if metric == "jaccard":
        either = sum(max(u, v) for u, v in zip(p, q))
        return n, 1 - sum(u * v for u, v in zip(p, q)) / either if either else 0.0
    mp, mq = sum(p) / n, sum(q) / n
    vp, vq = sum((u - mp) ** 2 for u in p), sum((v - mq) ** 2 for v in q)
    if vp < 1e-9 or vq < 1e-9:
        return n, None
    return n, 1 - sum((u - mp) * (v - mq) for u, v in zip(p, q)) / math.sqrt(vp * vq)


@pytest.mark.parametrize("metric", ["nhd", "l1", "l2", "corr", "jaccard"])
@pytest.mark.parametrize("block", [2, 256])
def test_distances(spark, metric, block):
    rows, reads = cells(7)
    m = spark.createDataFrame(
        rows, "region_id INT, read_id INT, cpg_id INT, ml INT, bin INT, weight INT")
    r = spark.createDataFrame(reads, "region_id INT, read_id INT")
    got = {(x.region_id, x.read_i, x.read_j): (x.n_common, x.dist)
           for x in distance.pair_distances(r, m, metric, block).collect()}
    want = {(g, i, j): brute(metric, [x for x in rows if x[:2] == (g, i)],
                             [x for x in rows if x[:2] == (g, j)])
            for g, i in reads for h, j in reads if g == h and i < j}
    want = {k: v for k, v in want.items() if v[0]}  # pairs without a common site stay implied
    assert got.keys() == want.keys()
    for k, (n, d) in want.items():
        assert got[k][0] == n
        assert (got[k][1] is None) == (d is None)
        if d is not None:
            assert got[k][1] == pytest.approx(d, abs=1e-9)


def test_packed_words_of_many_sites(spark, monkeypatch):
    """Sites in several words, several regions in a task, and fewer pairs at a time than a read has."""
    monkeypatch.setattr(distance, "PAIRS", 5)
    rows, reads = cells(8, (11, 1, 7, 4), 150)
    m = spark.createDataFrame(
        rows, "region_id INT, read_id INT, cpg_id INT, ml INT, bin INT, weight INT")
    r = spark.createDataFrame(reads, "region_id INT, read_id INT")
    for metric in ("nhd", "jaccard"):
        got = {tuple(x)[:3]: tuple(x)[3:] for x in distance.pair_distances(r, m, metric, 3).collect()}
        for (g, i, j), (n, d) in got.items():
            want = brute(metric, *([x for x in rows if x[:2] == (g, k)] for k in (i, j)))
            assert (n, pytest.approx(d, abs=1e-12)) == want
        assert len(got) == 55 + 21 + 6
    shared = {tuple(x)[:3]: x.n_common for x in distance.read_pairs(r, m.drop("bin")).collect()}
    sites = {}
    for x in rows:
        sites.setdefault(x[:2], set()).add(x[2])
    assert shared == {(g, i, j): len(sites[g, i] & sites[g, j]) for g, i, j in got}


def test_missing_pairs_and_matrix(spark):
    d = spark.createDataFrame([(0, 0, 1, 3, 0.5), (0, 0, 2, 2, 0.1), (0, 1, 3, 5, None)],
                              "region_id INT, read_i INT, read_j INT, n_common INT, dist DOUBLE")
    reads = spark.createDataFrame([(0, i) for i in range(4)], "region_id INT, read_id INT")
    skip = Params(missing_pairs="skip")
    for params, far in ((Params(), 1.0), (skip, None)):
        filled = distance.fill_missing_pairs(reads, d, params).orderBy("read_i", "read_j").collect()
        assert [(r.read_i, r.read_j) for r in filled] == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3),
                                                          (2, 3)]
        assert [r.dist for r in filled] == [0.5, far, far, far, far, far]
        for block in (1, 3, 256):
            rows = distance.distance_matrix(reads, d, params, block).orderBy("read_id").collect()
            assert [r.dist for r in rows] == [[0.0, 0.5, far, far], [0.5, 0.0, far, far],
                                              [far, far, 0.0, far], [far, far, far, 0.0]]


def one_by_one(n, d, method):
    """Greedy merging with explicit Lance-Williams updates: [(a, b, height)]."""
    live = {i: 1 for i in range(n)}
    dist = {(i, j): (d[i, j] ** 2 if method == "ward" else d[i, j])
            for i in range(n) for j in range(i + 1, n)}
    get = lambda i, j: dist[min(i, j), max(i, j)]
    out = []
    while len(live) > 1:
        a, b = min(((i, j) for i in live for j in live if i < j),
                   key=lambda p: (round(get(*p), 9), p))
        h = get(a, b)
        out.append((a, b, math.sqrt(max(h, 0)) if method == "ward" else h))
        na, nb = live[a], live.pop(b)
        for c in live:
            if c != a:
                nc = live[c]
                if method == "ward":
                    v = ((na + nc) * get(a, c) + (nb + nc) * get(b, c) - nc * h) / (na + nb + nc)
                else:
                    v = (na * get(a, c) + nb * get(b, c)) / (na + nb)
                dist[min(a, c), max(a, c)] = v
        live[a] = na + nb
    return out


def random_pairs(spark, seed, sizes, levels=None):
    rng = random.Random(seed)
    rows, tables = [], []
    for g, n in enumerate(sizes):
        pts = [(rng.random(), rng.random()) for _ in range(n)]
        d = {}
        for i in range(n):
            for j in range(i + 1, n):
                v = math.dist(pts[i], pts[j]) / 1.5
                d[i, j] = d[j, i] = round(v * levels) / levels if levels else v
                rows.append((g, i, j, 5, d[i, j]))
        tables.append(d)
    pairs = spark.createDataFrame(
        rows, "region_id INT, read_i INT, read_j INT, n_common INT, dist DOUBLE")
    reads = spark.createDataFrame([(g, i) for g, n in enumerate(sizes) for i in range(n)],
                                  "region_id INT, read_id INT")
    return reads, pairs, tables


@pytest.mark.parametrize("method", ["upgma", "ward"])
def test_tree_matches_one_by_one_merging(spark, method):
    sizes = (12, 7, 1, 2)
    reads, pairs, tables = random_pairs(spark, 11, sizes)
    leaves = cluster.cluster_reads(reads, pairs, method).collect()
    for g, n in enumerate(sizes):
        mine = {r.read_id: (r.join_read, r.height) for r in leaves if r.region_id == g}
        assert sorted(r.leaf_pos for r in leaves if r.region_id == g) == list(range(n))
        want = one_by_one(n, tables[g], method)
        assert len(mine) == n and sum(v[0] is not None for v in mine.values()) == n - 1
        for a, b, h in want:
            assert mine[b][0] == a and mine[b][1] == pytest.approx(h, abs=1e-6)


@pytest.mark.parametrize("method,levels", [("upgma", None), ("upgma", 4), ("upgma", 64),
                                           ("ward", None), ("ward", 64)])
def test_large_regions_get_the_same_tree(spark, method, levels):
    reads, pairs, _ = random_pairs(spark, 13, (9, 6, 3), levels)
    key = lambda r: (r.region_id, r.read_id)
    near = sorted(cluster.cluster_reads(reads, pairs, method).collect(), key=key)
    far = sorted(cluster.cluster_reads(reads, pairs, method, max_local_reads=4).collect(), key=key)
    assert near == far
    text = {r.region_id: r.newick for r in cluster.newick(reads, pairs, method).collect()}
    wide = {r.region_id: r.newick
            for r in cluster.newick(reads, pairs, method, max_local_reads=4).collect()}
    assert text == wide


def line(n):
    """Gaps that grow: every cluster but one waits for its neighbour, so rounds merge one pair each."""
    at = [k * k for k in range(n)]
    return {(i, j): (at[j] - at[i]) / (n * n) for i in range(n) for j in range(i + 1, n)}


@pytest.mark.parametrize("method", ["upgma", "ward"])
def test_many_tied_reads(spark, method, monkeypatch):
    """All pairs alike, and none known at all: ties are dealt out, so few rounds are needed."""
    rounds = []
    cut = cluster.cut_lineage
    monkeypatch.setattr(cluster, "cut_lineage", lambda df: rounds.append(df) or cut(df))
    n = 14
    reads = spark.createDataFrame([(0, i) for i in range(n)], "region_id INT, read_id INT")
    schema = "region_id INT, read_i INT, read_j INT, dist DOUBLE"
    alike = spark.createDataFrame([(0, i, j, 0.25) for i in range(n) for j in range(i + 1, n)], schema)
    for pairs in (alike, spark.createDataFrame([], schema)):
        near = cluster.newick(reads, pairs, method).collect()
        rounds.clear()
        assert cluster.newick(reads, pairs, method, max_local_reads=4).collect() == near
        assert len(rounds) <= 3 + 4 * 9


@pytest.mark.parametrize("method", ["upgma", "ward"])
def test_kernel_on_1024_reads(method):
    """Tied, chained and random regions of the largest size for one task; generous limits."""
    import time

    import numpy as np
    n = cluster.MAX_LOCAL_READS
    i, j = np.triu_indices(n, 1)
    draw = np.random.default_rng(3)
    tables = [np.full(len(i), cluster.UNITS), (j * j - i * i) * 900,
              draw.integers(0, cluster.UNITS, len(i))]
    for unit in tables:
        group = {"region_id": np.zeros(len(i), np.int32), "read_i": i, "read_j": j, "unit": unit}
        start = time.process_time()
        out = cluster._cluster_kernel(method, False)(group)
        assert time.process_time() - start < 3
        assert sorted(out["leaf_pos"]) == list(range(n))
        assert out["join_read"].null_count == 1


@pytest.mark.parametrize("method", ["upgma", "ward"])
def test_chains_of_neighbours(spark, method):
    d = line(20)
    pairs = spark.createDataFrame([(0, i, j, 5, v) for (i, j), v in d.items()],
                                  "region_id INT, read_i INT, read_j INT, n_common INT, dist DOUBLE")
    reads = spark.createDataFrame([(0, i) for i in range(20)], "region_id INT, read_id INT")
    mine = {r.read_id: (r.join_read, r.height)
            for r in cluster.cluster_reads(reads, pairs, method).collect()}
    for a, b, h in one_by_one(20, d, method):
        assert mine[b] == (a, pytest.approx(h, abs=1e-6))


def test_unknown_pairs_count_as_one(spark):
    """The same tree, cuts and scores whether missing pairs are rows or implied."""
    reads, pairs, _ = random_pairs(spark, 23, (6, 5, 2))
    known = pairs.filter("(read_i + 2 * read_j) % 3 <> 0")
    full = distance.fill_missing_pairs(reads, known)
    for method in ("upgma", "ward"):
        for most in (4, 100):
            texts = [sorted(map(tuple, cluster.newick(reads, d, method, most).collect()))
                     for d in (known, full)]
            assert texts[0] == texts[1]
    leaves = cluster.cluster_reads(reads, known)
    labels = cluster.cut_k(leaves, 3)
    for fn in (lambda d: cluster.silhouette(labels, d),
               lambda d: cluster.cut_silhouette(leaves, d, [2, 3, 4])):
        assert sorted(map(tuple, fn(known).collect()), key=str) == sorted(
            map(tuple, fn(full).collect()), key=str)
    hp = reads.selectExpr("*", "read_id % 3 as hp", "'ALT' as alt_support", "true as is_tumor")
    one, two = (assoc.label_distance_corr(d, hp, "hp").orderBy("region_id").collect()
                for d in (known, full))
    assert one == two and [r.n_pairs for r in one] == [6, 3]
    left = assoc.label_distance_corr(known, hp, "hp", Params(missing_pairs="skip")).orderBy("region_id")
    assert [r.n_pairs for r in left.collect()] == [
        known.filter(f"region_id = {g} and read_i % 3 > 0 and read_j % 3 > 0").count() for g in (0, 1)]


def test_silhouettes_over_blocks(spark, monkeypatch):
    reads, pairs, _ = random_pairs(spark, 29, (11, 4))
    labels = reads.selectExpr("region_id", "read_id", "read_id % 3 + 1 as cluster_id")
    one = sorted(map(tuple, cluster.silhouette(labels, pairs).collect()))
    monkeypatch.setattr(distance.in_pair_blocks, "__defaults__", (3,))
    assert sorted(map(tuple, cluster.silhouette(labels, pairs).collect())) == one


def test_newick_and_cuts(spark):
    d = [(0, 0, 1, 5, 0.2), (0, 0, 2, 5, 0.6), (0, 1, 2, 5, 0.8), (0, 0, 3, 5, 1.0),
         (0, 1, 3, 5, 1.0), (0, 2, 3, 5, 1.0)]
    pairs = spark.createDataFrame(
        d, "region_id INT, read_i INT, read_j INT, n_common INT, dist DOUBLE")
    reads = spark.createDataFrame([(0, i) for i in range(4)], "region_id INT, read_id INT")
    assert cluster.newick(reads, pairs).first().newick == (
        "(((0:0.100000,1:0.100000):0.250000,2:0.350000):0.150000,3:0.500000);")
    leaves = cluster.cluster_reads(reads, pairs)

    def labels(df):
        return [r.cluster_id for r in df.orderBy("read_id").collect()]

    assert labels(cluster.cut_height(leaves, 0.1)) == [1, 2, 3, 4]
    assert labels(cluster.cut_height(leaves, 0.2)) == [1, 1, 2, 3]
    assert labels(cluster.cut_height(leaves, 0.7)) == [1, 1, 1, 2]
    assert labels(cluster.cut_k(leaves, 3)) == [1, 1, 2, 3]
    assert labels(cluster.cut_k(leaves, 1)) == [1, 1, 1, 1]
    assert labels(cluster.cut_k(leaves, 9)) == [1, 2, 3, 4]
    best = cluster.cut_silhouette(leaves, pairs, [2, 3])
    scores = {}
    for k in (2, 3):
        s = cluster.silhouette(cluster.cut_k(leaves, k), pairs).collect()
        scores[k] = sum(r.silhouette for r in s) / 4
    assert best.first().k == max(scores, key=lambda k: (scores[k], -k))


def test_silhouette_rules(spark):
    _, pairs, (d, _) = random_pairs(spark, 17, (6, 2))
    lab = [1, 1, 1, 2, 2, 3]
    labels = spark.createDataFrame([(0, i, c) for i, c in enumerate(lab)] + [(1, 0, 1), (1, 1, 1)],
                                   "region_id INT, read_id INT, cluster_id INT")
    got = {(r.region_id, r.read_id): r.silhouette
           for r in cluster.silhouette(labels, pairs).collect()}
    for i in range(6):
        own = [d[i, j] for j in range(6) if j != i and lab[j] == lab[i]]
        if not own:
            assert got[0, i] == 0.0
            continue
        a = sum(own) / len(own)
        b = min(sum(v) / len(v) for v in ([d[i, j] for j in range(6) if lab[j] == c]
                                          for c in set(lab) - {lab[i]}))
        assert got[0, i] == pytest.approx((b - a) / max(a, b), abs=1e-6)
    assert got[1, 0] is None


def hypergeometric_p(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    w = {x: math.comb(row, x) * math.comb(n - row, col - x)
         for x in range(max(0, row + col - n), min(row, col) + 1)}
    return sum(v for v in w.values() if v <= w[a] * (1 + 1e-7)) / sum(w.values())


def test_fisher_and_chi_square(spark):
    rng = random.Random(19)
    rows = [(0, i, "hp", *[rng.choice([0, 1, 3, 8, 20, 60]) for _ in range(4)]) for i in range(80)]
    rows += [(0, 99, "hp", 0, 0, 0, 0), (0, 98, "hp", 300, 100, 90, 310),
             (0, 97, "hp", 80, 0, 0, 80)]
    df = spark.createDataFrame(
        rows, "region_id INT, cluster_id INT, factor STRING, a BIGINT, b BIGINT, c BIGINT, d BIGINT")
    for r in assoc.fisher_exact(df).collect():
        exact = hypergeometric_p(r.a, r.b, r.c, r.d)
        assert r.p_value == pytest.approx(exact, rel=1e-9)
        assert r.log10_p == pytest.approx(math.log10(exact), rel=1e-9, abs=1e-12)
    for r in assoc.chi_square(df).collect():
        margins = (r.a + r.b) * (r.c + r.d) * (r.a + r.c) * (r.b + r.d)
        if margins == 0:
            assert r.chi2 is None and r.p_value is None
        else:
            n = r.a + r.b + r.c + r.d
            stat = n * (r.a * r.d - r.b * r.c) ** 2 / margins
            assert r.chi2 == pytest.approx(stat)
            assert r.p_value == pytest.approx(math.erfc(math.sqrt(stat / 2)), abs=1e-12)


def test_fisher_of_many_reads(spark):
    df = spark.createDataFrame([(0, 1, "hp", 2500, 0, 0, 2500)], "region_id INT, cluster_id INT, "
                               "factor STRING, a BIGINT, b BIGINT, c BIGINT, d BIGINT")
    exact = math.log10(2) - (math.lgamma(5001) - 2 * math.lgamma(2501)) / math.log(10)
    assert assoc.fisher_exact(df).first().log10_p == pytest.approx(exact, rel=1e-9)


def test_chi_square_of_many_degrees(spark):
    from pyspark.sql import functions as F

    from methylspark.functions.stats import chi_square_p
    df = spark.createDataFrame([(1400.0, 1400), (2000.0, 2000), (2001.0, 2001), (0.0, 3)],
                               "x DOUBLE, k INT")
    got = [r.p for r in df.select(chi_square_p("x", "k").alias("p")).collect()]
    # the median lies at about k - 2 / 3
    assert all(0.49 < p < 0.5 for p in got[:3]) and got[3] == 1.0
    assert df.select(chi_square_p("x", F.lit(None).cast("int")).alias("p")).count() == 4


def test_chi_square_tail(spark):
    from pyspark.sql import functions as F

    from methylspark.functions.stats import chi_square_p
    # Upper 5 % points of the chi-square distribution.
    points = {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729, 5: 11.070498, 10: 18.307038}
    df = spark.createDataFrame(list(points.items()), "k INT, x DOUBLE")
    for r in df.select(chi_square_p(F.col("x"), F.col("k")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-6)


def test_fdr_and_agreement(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(0, i, "hp", v) for i, v in enumerate(p)],
                               "region_id INT, cluster_id INT, factor STRING, p_value DOUBLE")
    got = [r.q_value for r in assoc.fdr_bh(df).orderBy("cluster_id").collect()]
    assert got == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])
    reads = spark.createDataFrame(
        [(0, i, 1 + i // 3, "ALT" if i < 3 else "REF", True) for i in range(6)],
        "region_id INT, read_id INT, hp INT, alt_support STRING, is_tumor BOOLEAN")
    same = spark.createDataFrame([(0, i, 1 + i // 3) for i in range(6)],
                                 "region_id INT, read_id INT, cluster_id INT")
    assert assoc.adjusted_rand(same, reads, "hp").first().ari == pytest.approx(1.0)
    assert assoc.nmi(same, reads, "allele").first().nmi == pytest.approx(1.0)
    stats = {r.cluster_id: r for r in cluster.cluster_stats(same, reads).collect()}
    assert (stats[1].count_alt, stats[1].count_ref, stats[1].count_hp1) == (3, 0, 3)
    pairs = spark.createDataFrame(
        [(0, i, j, 0.0 if i // 3 == j // 3 else 1.0) for i in range(6) for j in range(i + 1, 6)],
        "region_id INT, read_i INT, read_j INT, dist DOUBLE")
    assert assoc.label_distance_corr(pairs, reads, "hp").first().corr == pytest.approx(1.0)
