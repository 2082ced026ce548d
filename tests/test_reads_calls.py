import random

from pyspark.sql import functions as F

from methylspark.operators import calls, reads
from methylspark.params import Params
from methylspark.schemas import ALIGNMENTS


def read(key, cigar="8M", seq="ACGTACGT", start=99, flag=0, mapq=60, qual=None, hp=None, ps=None,
         mm="C+m?,0;", ml=(200,), tumor=True, chrom="chr1"):
    return (key, f"r{key}", flag, chrom, start, mapq, cigar, seq,
            "I" * len(seq) if qual is None else qual, hp, ps, mm,
            None if ml is None else list(ml), tumor)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ALIGNMENTS)


SMALL = Params(min_read_length=8)


def test_filter_and_reasons(spark):
    df = table(spark, read(1), read(2, flag=0x100), read(3, flag=0x800), read(4, flag=0x400),
               read(5, flag=0x4), read(6, mapq=19), read(7, cigar="7M", seq="ACGTACG"),
               read(8, mm=None), read(9, ml=None), read(10, flag=16, cigar="2S6M"),
               read(11, cigar="4M100D3M", seq="ACGTACG"))
    assert sorted(r.read_key for r in reads.filter_reads(df, SMALL).collect()) == [1, 10]
    got = {r.reason: r.n_reads for r in reads.filter_reasons(df, SMALL).collect()}
    assert got == {"kept": 2, "secondary": 1, "supplementary": 1, "duplicate": 1, "unmapped": 1,
                   "low_mapq": 1, "short": 2, "no_mm_ml": 2}
    loose = Params(min_read_length=8, require_mm_ml=False)
    assert reads.filter_reads(df, loose).count() == 4


def test_cigar_lengths(spark):
    df = table(spark, read(1, cigar="5H2S3M1I2D4=1X6N1M2S"), read(2, cigar="*"))
    rows = {r.read_key: (r.query_length, r.align_end - r.align_start)
            for r in reads.cigar_lengths(df).collect()}
    assert rows == {1: (2 + 3 + 1 + 4 + 1 + 1 + 2, 3 + 2 + 4 + 1 + 6 + 1), 2: (0, 1)}


def test_state_bits(spark):
    df = spark.createDataFrame([(True, 1, "ALT"), (True, 2, "REF"), (False, 0, "UNKNOWN")],
                               "is_tumor BOOLEAN, hp INT, alt_support STRING")
    assert [r.state_bits for r in reads.read_state(df).collect()] == [11, 21, 32]


def test_alt_support(spark):
    # 0-based start 99, so position 100 is the first base.
    def verdict(row, pos, ref="A", alt="T", **kw):
        df = table(spark, row).withColumn("pos", F.lit(pos)).withColumn(
            "ref", F.lit(ref)).withColumn("alt", F.lit(alt))
        return reads.alt_support(df, 20).first().alt_support

    plain = read(1, seq="ACGTACGT")
    assert verdict(plain, 100) == "REF"
    assert verdict(plain, 103) == "ALT"
    assert verdict(plain, 101) == "UNKNOWN"
    assert verdict(plain, 99) == "UNKNOWN" and verdict(plain, 108) == "UNKNOWN"
    assert verdict(plain, 100, ref="A", alt="A") == "ALT"
    deletion = read(1, cigar="2M3D6M", seq="ACTGACGT")
    assert verdict(deletion, 103) == "UNKNOWN" and verdict(deletion, 105) == "ALT"
    assert verdict(read(1, cigar="1S2I5M", seq="CCCTACGT"), 100) == "ALT"
    assert verdict(read(1, qual="4IIIIIII"), 100) == "UNKNOWN"
    assert verdict(read(1, qual="5IIIIIII"), 100) == "REF"
    assert verdict(read(1, qual="*"), 100) == "REF"


def brute_calls(cigar, start, seq, mm, ml, code="C+m?", compat=False):
    """Direct walk over one read: (seq_idx, 1-based pos or None, ml)."""
    import re
    at = mm.find(code)
    if at < 0 or mm[at + len(code):at + len(code) + 1] != ",":
        return []
    deltas = [int(x) for x in mm[at + len(code) + 1:].split(";")[0].split(",") if x]
    offset = mm[:at].count(",") - (mm[:at].count(";") if compat else 0)
    if not deltas or offset < 0 or offset + len(deltas) > len(ml):
        return []
    where, ref, query = {}, start, 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                where[query] = ref + 1
            query += op in "MIS=X"
            ref += op in "MDN=X"
    cs = [i for i, b in enumerate(seq) if b == "C"]
    out, at_c = [], -1
    for k, d in enumerate(deltas):
        at_c += d + 1
        if at_c < len(cs):
            out.append((cs[at_c], where.get(cs[at_c]), ml[offset + k]))
    return out


def test_modified_bases_against_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for key in range(600):
        ops = [("M", rng.randint(0, 9))]
        for _ in range(rng.randint(0, 5)):
            ops.append((rng.choice("MIDN=X"), rng.randint(1, 6)))
        if rng.random() < 0.4:
            ops = [("H", 3), ("S", rng.randint(1, 4))] + ops + [("S", 2)]
        cigar = "".join(f"{n}{op}" for op, n in ops)
        length = sum(n for op, n in ops if op in "MIS=X")
        seq = "".join(rng.choice("ACCGT") for _ in range(length))
        h, m = [[rng.randint(0, 3) for _ in range(rng.randint(0, 6))] for _ in range(2)]
        mm = "".join(f"{c}{''.join(f',{d}' for d in ds)};"
                     for c, ds in (("C+h?", h), ("C+m?", m)) if rng.random() < 0.85)
        ml = [rng.randint(0, 255) for _ in range(max(0, len(h) + len(m) - rng.randint(0, 1)))]
        rows.append(read(key, cigar=cigar, seq=seq, start=50, mm=mm, ml=ml))
        for compat in (False, True):
            want.setdefault(compat, []).extend(
                (key, *c) for c in brute_calls(cigar, 50, seq, mm, ml, compat=compat))
    for compat in (False, True):
        got = calls.modified_bases(table(spark, *rows), Params(compat_ml_offset=compat))
        assert sorted((r.read_key, r.seq_idx, r.pos or 0, r.ml) for r in got.collect()) == sorted(
            (k, i, p or 0, v) for k, i, p, v in want[compat])
    assert len(want[False]) > 200


def test_ml_offset_modes(spark):
    df = table(spark, read(1, cigar="6M", seq="CCCCCC", mm="C+h?,0,0;C+m?,1,0;", ml=[1, 2, 3, 4]))
    plain = calls.modified_bases(df, Params()).orderBy("seq_idx").collect()
    assert [(r.seq_idx, r.pos, r.ml) for r in plain] == [(1, 101, 3), (2, 102, 4)]
    shifted = calls.modified_bases(df, Params(compat_ml_offset=True)).orderBy("seq_idx").collect()
    assert [r.ml for r in shifted] == [2, 3]


def test_calls_need_cpg(spark):
    df = table(spark, read(1, cigar="6M", seq="CGCACG", mm="C+m?,0,0,0;", ml=[255, 9, 0]))
    sites = spark.createDataFrame([("chr1", 100), ("chr1", 104), ("chr2", 102)],
                                  "chrom STRING, pos INT")
    got = calls.methylation_calls(df, sites).orderBy("pos").collect()
    assert [(r.pos, r.ml, r.prob) for r in got] == [(100, 255, 1.0), (104, 0, 0.0)]


def test_cigar_blocks(spark):
    df = table(spark, read(1, cigar="3S2M1I3=2D1X"), read(2, cigar="*"))
    got = sorted(map(tuple, calls.cigar_blocks(df).collect()))
    assert got == [(1, 3, 99, 2), (1, 6, 101, 3), (1, 9, 106, 1)]


def test_phase_set(spark):
    rows = [(0, 7)] * 9 + [(0, 8)] + [(1, 7)] * 8 + [(1, 8)] * 2 + [(2, None)]
    df = spark.createDataFrame(rows, "region_id INT, ps INT")
    checks = reads.phase_set_check(df)
    got = {r.region_id: (r.major_ps, r.share, r.status) for r in checks.collect()}
    assert got == {0: (7, 0.9, "OK"), 1: (7, 0.8, "AMBIGUOUS_PHASE")}
    assert reads.keep_major_phase(df, checks).count() == 17


def test_original_strand_of_reverse_reads(spark):
    """Both strands of the CpG at 101 and of the one at 106; off by default."""
    seq = "ACGTTACGTG"  # stored bases; C at 1 and 6, G at 2, 7 and 9
    rows = [read(1, "10M", seq, mm="C+m?,0,0;", ml=(10, 20)),
            read(2, "10M", seq, flag=16, mm="C+m?,1,0;", ml=(30, 40))]
    df = table(spark, *rows)

    def placed(params):
        return sorted(tuple(r) for r in calls.modified_bases(df, params).select(
            "read_key", "seq_idx", "pos", "ml").collect())

    assert placed(Params()) == [(1, 1, 101, 10), (1, 6, 106, 20), (2, 6, 106, 30)]
    # from the end: G at 9 is skipped, then those at 7 and 2
    assert placed(Params(original_strand=True)) == [
        (1, 1, 101, 10), (1, 6, 106, 20), (2, 2, 101, 40), (2, 7, 106, 30)]


def test_phase_gate_skips_mixed_windows(spark):
    from methylspark.plans.region_run import RegionRun
    seq = "ACGTACGT" * 4
    aln = table(spark, *[read(k, "32M", seq, start=s, hp=1, ps=ps, mm="C+m?,0,0;", ml=(9, 9))
                         for k, (s, ps) in enumerate([(0, 5)] * 9 + [(0, 6), (100, 7), (100, 8)] + [
                             (200, None)])])
    snvs = spark.createDataFrame(
        [(k, "chr1", p, "A", "T", 50.0) for k, p in enumerate((5, 104, 204))],
        "snv_id INT, chrom STRING, pos INT, ref STRING, alt STRING, qual DOUBLE")
    contigs = spark.createDataFrame([("chr1", "ACGT" * 100)], "chrom STRING, seq STRING")
    for gate in (False, True):
        run = RegionRun(snvs, aln, contigs, Params(window=20, min_read_length=8, phase_gate=gate))
        got = {r.region_id: (r.num_reads, r.num_cpgs > 0, r.success, r.error_message)
               for r in run.result.collect()}
        assert got[0] == (10, True, True, "") and got[2] == (1, True, True, "")
        assert got[1] == ((0, False, False, "AMBIGUOUS_PHASE") if gate else (2, True, True, ""))
        assert {r.region_id for r in run.matrix.select("region_id").distinct().collect()} == (
            {0, 2} if gate else {0, 1, 2})


def test_written_tables_come_back(spark, tmp_path):
    """All tables of a run, one directory per chromosome."""
    from methylspark.sources import sinks
    tables = {
        "reads": spark.createDataFrame([(0, 0, "chr1"), (1, 0, "chr2")],
                                       "region_id INT, read_id INT, chrom STRING"),
        "matrix": spark.createDataFrame([(0, 0, 0, "chr1", 9), (1, 0, 0, "chr2", 8)],
                                        "region_id INT, read_id INT, cpg_id INT, chrom STRING, ml INT"),
        "region_result": spark.createDataFrame([(0, 3)], "region_id INT, num_reads INT")}
    sinks.write_region_tables(tables, str(tmp_path / "t"))
    for name, df in tables.items():
        back = spark.read.parquet(str(tmp_path / "t" / name)).select(*df.columns)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert {p.name for p in (tmp_path / "t" / "reads").iterdir() if p.is_dir()} == {
        "chrom=chr1", "chrom=chr2"}
