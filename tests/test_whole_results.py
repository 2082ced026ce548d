"""Queries that must return every row of their job."""

import duckdb
import pytest

import __spark_entry__ as contract
from methylspark.operators import distance

SMALL = "/root/testdata/sf0.001"
METRICS = ("nhd", "l1", "l2", "corr", "jaccard", "nhd_weighted")


@pytest.mark.parametrize("metric", METRICS)
def test_distances_of_all_pairs(spark, metric):
    """Reads without a site, pairs without a common one and both blocks of a large region."""
    rows = [(g, i, s, (37 * i + 11 * s) % 256, (i + s) % 3 % 2, 1 + s % 4)
            for g in range(2) for i in range(5) for s in range(12) if i != 3 and (s + i * g) % (i + 2)]
    rows += [(0, 6, 40, 9, 1, 2)]
    m = spark.createDataFrame(
        rows, "region_id INT, read_id INT, cpg_id INT, ml INT, bin INT, weight INT")
    r = spark.createDataFrame([(g, i) for g in range(3) for i in range(7 - 3 * g)],
                              "region_id INT, read_id INT")
    shared = {tuple(x)[:3]: tuple(x)[3:] for x in distance.pair_distances(r, m, metric, 2).collect()}
    want = {(x.region_id, x.read_i, x.read_j): shared.get((x.region_id, x.read_i, x.read_j), (0, None))
            for x in distance.all_pairs(r).collect()}
    got = distance.pair_distances(r, m, metric, 2, every=True).collect()
    assert {tuple(x)[:3]: tuple(x)[3:] for x in got} == want
    assert len(got) == len(want) == 21 + 6 + 0 and 0 < len(shared) < len(want)


def test_distance_queries_hold_pairs_without_a_common_site(spark):
    db = duckdb.connect()
    for t in ("customer", "supplier", "part", "lineitem", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for metric in METRICS:
        df = contract.queries()[f"dist_{metric}"](spark, SMALL)
        sql = contract.oracle_sql()[f"dist_{metric}"]
        want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        got = list(map(tuple, df.collect()))
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert any(row[3] == 0 and row[4] is None for row in got)
