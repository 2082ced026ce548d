from methylspark.operators import matrix, report
from methylspark.params import Params

# Three reads on two sites: 0 has both, 1 has one, 2 has none.
CELLS = [(0, 0, 10, "c", 100, 255), (0, 0, 10, "c", 110, 0), (0, 1, 11, "c", 110, 51)]
READS = [(0, 0, 10, 1, True), (0, 1, 11, 2, False), (0, 2, 12, 0, True)]


def frames(spark):
    cells = spark.createDataFrame(
        CELLS, "region_id INT, read_id INT, read_key BIGINT, chrom STRING, pos INT, ml SMALLINT")
    reads = spark.createDataFrame(
        READS, "region_id INT, read_id INT, read_key BIGINT, hp INT, is_tumor BOOLEAN")
    return cells, reads


def test_known_matrix(spark):
    cells, reads = frames(spark)
    m = matrix.region_matrix(cells)
    got = sorted((r.read_id, r.cpg_id, r.prob) for r in m.collect())
    assert got == [(0, 0, 1.0), (0, 1, 0.0), (1, 1, 0.2)]
    wide = {r.read_id: r.probs for r in matrix.region_matrix_wide(reads, m).collect()}
    assert wide == {0: [1.0, 0.0], 1: [None, 0.2], 2: [None, None]}
    lines = [r.line for r in report.matrix_csv_lines(
        matrix.region_matrix_wide(reads, m)).orderBy("line_no").collect()]
    assert lines == ["read_id,100,110", "0,1.0000,0.0000", "1,NA,0.2000", "2,NA,NA"]


def test_binarize_borders(spark):
    df = spark.createDataFrame([(v, v / 255.0) for v in (50, 51, 52, 203, 204, 205)],
                               "ml INT, prob DOUBLE")
    assert [r.bin for r in matrix.binarize(df).collect()] == [0, 0, None, None, 1, 1]


def test_gates(spark):
    cells, reads = frames(spark)
    kept = matrix.gate_coverage(cells, Params(min_site_coverage=2))
    assert sorted((r.read_id, r.pos) for r in kept.collect()) == [(0, 110), (1, 110)]
    assert matrix.drop_empty_reads(reads, kept).count() == 2
    flags = spark.createDataFrame([("c", 110, True), ("c", 100, False)],
                                  "chrom STRING, pos INT, in_pmd BOOLEAN")
    assert [r.pos for r in matrix.gate_pmd(cells, flags).collect()] == [100]


def test_stats_results_and_summary(spark):
    cells, reads = frames(spark)
    status = spark.createDataFrame(
        [(0, 5, True, ""), (1, 6, True, ""), (2, 7, False, "no")],
        "region_id INT, snv_id INT, success BOOLEAN, error_message STRING")
    result = matrix.region_result(status, reads, cells)
    rows = {r.region_id: (r.num_reads, r.num_cpgs, r.success) for r in result.collect()}
    assert rows == {0: (3, 2, True), 1: (0, 0, True), 2: (0, 0, False)}
    stats = {r.region_id: r for r in matrix.matrix_stats(result, cells).collect()}
    assert (stats[0].na_cells, stats[0].zero_cells, stats[0].nonzero_cells) == (3, 1, 2)
    assert stats[0].sparsity_pct == 50.0 and stats[1].sparsity_pct is None
    s = report.run_summary(result).first()
    assert (s.total_regions, s.successful, s.failed, s.total_reads, s.avg_reads) == (3, 2, 1, 3, 1.5)
    none = report.run_summary(result.filter("not success")).first()
    assert none.avg_reads is None and none.total_reads == 0
    m = matrix.region_matrix(cells)
    assert report.check_dimensions(result, reads, m).count() == 0
    assert report.check_dimensions(result, reads.filter("read_id < 2"), m).first().issue == "reads"


def test_contrasts(spark):
    cells, reads = frames(spark)
    asm = {r.pos: r for r in matrix.site_asm(cells, reads).collect()}
    assert (asm[110].mean_hp1, asm[110].mean_hp2, asm[110].diff) == (0.0, 0.2, -0.2)
    assert asm[100].mean_hp2 is None and asm[100].diff is None
    tn = {r.pos: r for r in matrix.site_tumor_normal(cells, reads).collect()}
    assert (tn[110].n_tumor, tn[110].n_normal) == (1, 1)


def test_reads_jsonl(spark):
    import json
    cells, reads = frames(spark)
    named = reads.selectExpr("*", "concat('r', read_id) AS qname", "'c' AS chrom",
                             "99 AS align_start", "'ALT' AS alt_support")
    rows = report.reads_jsonl(named, matrix.region_matrix(cells)).orderBy("read_id").collect()
    first = json.loads(rows[0].json)
    assert first["methylation"] == {"100": 1.0, "110": 0.0} and first["read_name"] == "r0"
    assert json.loads(rows[2].json)["methylation"] == {}


def test_region_name(spark):
    df = spark.createDataFrame([(7,), (12345,)], "i INT")
    got = [r.n for r in df.select(report.region_name(df.i).alias("n")).collect()]
    assert got == ["region_0007", "region_12345"]
