import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from methylspark.plans import catalog
from methylspark.plans.staging import Store

SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("gone", [("corpus_pipeline", "methylspark.llm"), ("sentencepiece",)])
def test_entry_without_the_training_data_operators(gone):
    """Their two folders, or a package they need, may be missing; every other query stays."""
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, *rest):\n"
            f"        if name in {gone!r}:\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "print(len(e.queries()), len(e.oracle_sql()))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES))] * 2, out.stderr


def test_store_tells_analyses_apart(spark):
    store = Store(spark, "test")
    one = store("t", spark.range(3))
    two = store("t", spark.range(4))
    assert (one.count(), two.count(), store("t", spark.range(3)).count()) == (3, 4, 3)
    store.drop()
    assert store("t", spark.range(5)).count() == 5
    store.drop()


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) > 100 and any(r.num_cpgs > 0 for r in rows)
    assert any(not r.success for r in rows)


@pytest.mark.parametrize("name", ["region_result", "methylation_calls", "region_reads",
                                  "dist_nhd", "fisher_exact", "cluster_reads_ward", "newick",
                                  "cut_silhouette", "silhouette", "distance_csv_lines",
                                  "phase_gate", "matrix_ref_columns", "correlation_by_truth"])
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = contract.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    cursor = db.execute(f"SELECT {', '.join(cols)} FROM ({contract.oracle_sql()[name]})")
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(
        map(str, cursor.fetchall()))


def test_lazy_plan_and_large_window_route_agree(spark, monkeypatch):
    from methylspark.operators import intervals
    staged = sorted(map(tuple, catalog.run_of(spark, SMALL).result.collect()))
    assert sorted(map(tuple, catalog.lazy_run(spark, SMALL).result.collect())) == staged
    monkeypatch.setattr(intervals.fits_broadcast, "__defaults__", (0,))
    assert sorted(map(tuple, catalog.lazy_run(spark, SMALL).result.collect())) == staged


def test_tiles_in_the_place_of_contigs(spark):
    """The same result where the reference comes as tiles from FASTA lines."""
    from methylspark.plans.region_run import RegionRun
    from methylspark.sources import reference
    run = catalog.run_of(spark, SMALL)
    text = run.contigs.selectExpr("chrom as ord", "concat('>', chrom, '\\n', seq) as value")
    tiles = reference.load_fasta_tiles(spark, catalog.as_files(run, "fasta_of_test", text))
    tiled = RegionRun(run.snvs, run.alignments, None, run.params, run.annotation, tiles)
    assert sorted(map(tuple, tiled.result.collect())) == sorted(map(tuple, run.result.collect()))


def test_clusters_cover_all_reads(spark):
    run = catalog.run_of(spark, SMALL)
    labels = catalog.QUERIES["cut_k"](spark, SMALL)
    assert labels.count() == run.reads.count()
    assert labels.groupBy("region_id").agg({"cluster_id": "max"}).filter(
        "`max(cluster_id)` > 3").count() == 0
