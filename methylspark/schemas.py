"""Column layouts of the tables that operators exchange (DDL strings)."""

SNVS = ("snv_id INT, chrom STRING, pos INT, ref STRING, alt STRING, qual DOUBLE, "
        "is_pass BOOLEAN, somatic_conf DOUBLE, info STRING")

#: ``align_start`` is 0-based; ``qual`` is SAM text (phred + 33, ``*`` when absent);
#: ``read_key`` is unique and increases in file order.
ALIGNMENTS = ("read_key BIGINT, qname STRING, flag INT, chrom STRING, align_start INT, "
              "mapq INT, cigar STRING, seq STRING, qual STRING, hp INT, ps INT, "
              "mm STRING, ml ARRAY<SMALLINT>, is_tumor BOOLEAN")

#: One row per modified base; ``pos`` is the 1-based reference position.
CALLS = "read_key BIGINT, chrom STRING, pos INT, ml SMALLINT"

#: BED convention: 0-based start, exclusive end.
ANNOTATION = "chrom STRING, start INT, end INT, cls STRING"

#: Interval classes of an annotation table.
CLASSES = ("PMD", "REPRESSIVE", "ACCESSIBLE")

DISTANCES = "region_id INT, read_i INT, read_j INT, n_common INT, dist DOUBLE"

LABELS = "region_id INT, read_id INT, cluster_id INT"
