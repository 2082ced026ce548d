import random

from methylspark.functions.placement import SITE_FIELDS  # noqa: F401 - import check
from methylspark.operators.regions import make_regions, region_status
from methylspark.sources import alignments, annotation, reference, sinks, variants

VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=100>
##contig=<ID=chr2,length=100>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS
chr2\t10\t.\tA\tC\t30.5\tPASS\tSOMATIC\tGT:AF\t0/1:0.25,0.5
chr1\t20\t.\tA\tG\t.\tPASS\t.\tGT\t0/1
chr1\t21\t.\tA\tG\t50\tLowQual\t.\tGT:AF\t0/1:0.5
chr1\t22\t.\tAT\tG\t50\tPASS\t.\tGT:AF\t0/1:0.5
chr1\t23\t.\tA\tG,T\t50\tPASS\t.\tGT:AF\t0/1:0.5
chr1\t24\t.\tA\tG\t50\t.\t.\tGT:AF\t0/1:0.5
chr3\t25\t.\tT\tG\t9\tPASS\tX;SOMATIC=1\tGT:AF\t0/1:.
"""


def test_load_vcf(spark, write):
    rows = variants.load_vcf(spark, write("a.vcf", VCF)).orderBy("snv_id").collect()
    assert [(r.snv_id, r.chrom, r.pos, r.ref, r.alt) for r in rows] == [
        (0, "chr2", 10, "A", "C"), (1, "chr1", 20, "A", "G"), (2, "chr3", 25, "T", "G")]
    assert [r.somatic_conf for r in rows] == [0.25, 0.0, 0.0]
    assert [r.qual for r in rows] == [30.5, 0.0, 9.0]


def test_vcf_conditions(spark, write):
    path = write("a.vcf", VCF)
    pick = lambda **kw: sorted(r.pos for r in variants.load_vcf(spark, path, **kw).collect())
    assert pick(accept_missing_filter=True) == [10, 20, 24, 25]
    assert pick(require_pass=False) == [10, 20, 21, 24, 25]
    assert pick(somatic_info_tag="SOMATIC") == [10, 25]
    assert pick(keep_multiallelic=True) == [10, 20, 23, 25]
    assert pick(chroms=["chr1"], min_qual=0) == [20]
    assert pick(interval=(15, 30)) == [20, 25]


def test_chrom_dictionary_prefers_header(spark, write):
    lines = variants.read_lines(spark, write("a.vcf", VCF))
    names = variants.header_contigs(lines).unionByName(
        variants.parse_vcf(lines).select("chrom", "ord"))
    rows = variants.chrom_dictionary(names).orderBy("chr_id").collect()
    assert [(r.chr_id, r.chrom) for r in rows] == [(0, "chr1"), (1, "chr2"), (2, "chr3")]


def test_load_snv_tsv(spark, write):
    path = write("s.tsv", "chr\tpos\tref\talt\tqual\n\n# note\nchr17 5 C T 12.5\n"
                          "chr1  7\tA\tG\nchr1 9 AT C\nchr1 x A C\n")
    rows = variants.load_snv_tsv(spark, path).orderBy("snv_id").collect()
    assert [(r.snv_id, r.chrom, r.pos, r.alt, r.qual) for r in rows] == [
        (0, "chr17", 5, "T", 12.5), (1, "chr1", 7, "G", 0.0)]


def test_headerless_tsv_keeps_first_row(spark, write):
    path = write("s.tsv", "chr17 5 C T\nchr17 6 C T\n")
    assert variants.load_snv_tsv(spark, path).count() == 2


def test_parse_sam(spark, write):
    sam = ("@HD\tVN:1.6\n"
           "r1\t16\tchr1\t101\t60\t4M\t*\t0\t0\tACGC\tIIII\tHP:i:2\tPS:i:7\t"
           "MM:Z:C+m?,0,0;\tML:B:C,255,0\n"
           "r2\t0\tchr1\t5\t9\t4M\t*\t0\t0\tACGC\t*\n"
           "r3\t0\tchr1\t5\t9\t4M\t*\t0\t0\tACGC\t*\tMM:Z:C+m?;\tML:B:s,1\n")
    a, b, c = alignments.load_alignments(spark, write("x.sam", sam), "sam").orderBy(
        "read_key").collect()
    assert (a.qname, a.flag, a.align_start, a.hp, a.ps, a.ml) == ("r1", 16, 100, 2, 7, [255, 0])
    assert (b.hp, b.mm, b.ml, b.qual) == (None, None, None, "*")
    assert c.ml == []


def test_combine_samples_keeps_keys_apart(spark):
    one = spark.createDataFrame([(1,), (2,)], "read_key BIGINT")
    both = alignments.combine_samples(one, one)
    assert both.select("read_key").distinct().count() == 4
    assert both.filter("is_tumor").count() == 2


SEQ = {"c1": "acgtNCGGcgA" * 7, "c2": "CG", "c3": "C" * 16, "c4": "A"}


def _sites(seqs):
    return sorted((c, i + 1) for c, s in seqs.items() for i in range(len(s) - 1)
                  if s[i:i + 2].upper() == "CG")


def test_tiles_and_sites(spark):
    contigs = spark.createDataFrame(list(SEQ.items()) + [("c5", "")], "chrom STRING, seq STRING")
    tiles = reference.tile_reference(contigs, tile=8, overlap=1)
    for r in tiles.collect():
        start = r.tile * 8
        assert (r.tile_start, r.seq) == (start, SEQ[r.chrom][start:start + 9].upper())
        assert r.core == min(8, len(SEQ[r.chrom]) - start)
    assert sorted(map(tuple, reference.reference_cpg_sites(tiles).collect())) == _sites(SEQ)


def test_fasta_tiles_match_contig_tiles(spark, write):
    text = "".join(f">{c} description\n" + "\n".join(
        s[i:i + 5] for i in range(0, len(s), 5)) + "\n" for c, s in SEQ.items())
    path = write("r.fa", text)
    contigs = reference.load_fasta(spark, path)
    assert {r.chrom: r.seq for r in contigs.collect()} == SEQ
    for tile, overlap in ((8, 1), (4, 4), (100, 1), (16, 3)):
        whole = reference.tile_reference(contigs, tile, overlap)
        lines = reference.load_fasta_tiles(spark, path, tile, overlap)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, lines.collect()))


def test_contig_lengths_and_status(spark):
    contigs = spark.createDataFrame([("c1", "ACGT" * 10)], "chrom STRING, seq STRING")
    names = spark.createDataFrame([("c1",), ("cx",)], "chrom STRING")
    assert {r.chrom: r.length for r in reference.contig_lengths(contigs, names).collect()} == {
        "c1": 40, "cx": -1}
    snvs = spark.createDataFrame([(0, "c1", 5, "A", "C", 1.0), (1, "cx", 5, "A", "C", 1.0)],
                                 "snv_id INT, chrom STRING, pos INT, ref STRING, alt STRING, qual DOUBLE")
    regions = make_regions(snvs, 10)
    got = {r.region_id: r for r in region_status(
        regions, reference.contig_lengths(contigs)).collect()}
    assert (got[0].win_start, got[0].win_end, got[0].success) == (1, 15, True)
    assert not got[1].success and "reference" in got[1].error_message


def test_annotation(spark, write):
    path = write("a.bed", "track x\nc1\t0\t10\tpmd\nc1\t5\t5\tPMD\nc1\t5\t9\tother\nc2\t1\t2\tAccessible\n")
    assert sorted(map(tuple, annotation.load_annotation(spark, path).collect())) == [
        ("c1", 0, 10, "PMD"), ("c2", 1, 2, "ACCESSIBLE")]


def test_sinks(spark, tmp_path):
    snvs = spark.createDataFrame(
        [(0, "chr1", 5, "A", "C", 1.0, True, 0.5, "")],
        "snv_id INT, chrom STRING, pos INT, ref STRING, alt STRING, qual DOUBLE, "
        "is_pass BOOLEAN, somatic_conf DOUBLE, info STRING")
    sinks.write_snv_tsv(snvs, str(tmp_path / "snv"))
    back = spark.read.csv(str(tmp_path / "snv"), sep="\t", header=True).first()
    assert (back.chr, back.filter) == ("chr1", "PASS")
    table = spark.createDataFrame([(1, "a"), (0, "b")], "region_id INT, chrom STRING")
    for fmt in ("parquet", "csv"):
        sinks.write_region_tables({"t": table}, str(tmp_path / fmt), fmt)
        assert (tmp_path / fmt / "t" / "chrom=a").exists()
        reader = spark.read.option("header", True).format(fmt)
        assert reader.load(str(tmp_path / fmt / "t")).count() == 2


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    """Input splits are dealt out by size; numbers must follow files and lines all the same."""
    from methylspark.sources import reference, variants
    rng = random.Random(3)
    genome = {"chrA": "".join(rng.choice("ACGT") for _ in range(1000)),
              "chrB": "".join(rng.choice("ACGT") for _ in range(760))}
    fasta, table = tmp_path / "fasta", tmp_path / "table"
    fasta.mkdir()
    table.mkdir()
    for k, (name, seq) in enumerate(genome.items()):
        lines = [seq[i:i + 50] for i in range(0, len(seq), 50)]
        (fasta / f"{k}.fa").write_text("\n".join([f">{name} x", *lines]) + "\n")
    sizes = {"a": 3, "b": 400, "c": 40}
    for name, n in sizes.items():
        (table / f"{name}.tsv").write_text("".join(f"{name}\t{i + 1}\tA\tC\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        tiles = reference.load_fasta_tiles(spark, str(fasta), tile=100, overlap=1).collect()
        snvs = variants.load_snv_tsv(spark, str(table)).orderBy("snv_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, seq in genome.items():
        mine = sorted((t.tile, t.core, t.seq) for t in tiles if t.chrom == name)
        assert "".join(s[:n] for _, n, s in mine) == seq
    assert [(r.chrom, r.pos) for r in snvs] == [(name, i + 1) for name, n in sizes.items()
                                               for i in range(n)]


def test_sample_is_spread_and_follows_the_seed(spark):
    from methylspark.operators.regions import sample_snvs
    snvs = spark.range(1000).withColumnRenamed("id", "snv_id")
    one, two = ([r.snv_id for r in sample_snvs(snvs, 32, seed).collect()] for seed in (42, 43))
    assert len(set(one)) == 32 and set(one) != set(two)
    assert sorted(one) != list(range(min(one), min(one) + 32)) and max(one) > 500 > min(one)
