"""DuckDB SQL for each query of the catalog (checks only)."""

from __future__ import annotations

from methylspark.plans.oracle_base import MIN_LENGTH, MIN_MAPQ, sql


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


_REASON = f"""CASE WHEN flag & 256 <> 0 THEN 'secondary' WHEN flag & 2048 <> 0 THEN 'supplementary'
    WHEN flag & 1024 <> 0 THEN 'duplicate' WHEN flag & 4 <> 0 THEN 'unmapped'
    WHEN mapq < {MIN_MAPQ} THEN 'low_mapq' WHEN query_length < {MIN_LENGTH} THEN 'short'
    WHEN mm IS NULL OR ml IS NULL THEN 'no_mm_ml' ELSE 'kept' END"""


def _per_read(table: str, place: str, where: str = "TRUE") -> str:
    return f"""SELECT read_key, chrom, count(*) AS n, CAST(sum({place}) AS BIGINT) AS sum_place,
        CAST(sum(CAST({place} AS BIGINT) * (ml + 1)) AS BIGINT) AS sum_weighted
        FROM {table} WHERE {where} GROUP BY ALL"""


def _pair_metric(n: str, dist: str, where: str = "TRUE") -> str:
    """All pairs with aggregates ``n`` and ``dist`` over the rows of ``common``."""
    return f"""SELECT region_id, read_i, read_j, coalesce(n, 0) AS n_common,
        {r6('dist')} AS dist
        FROM all_pairs LEFT JOIN (
            SELECT region_id, read_i, read_j, {n} AS n, {dist} AS dist
            FROM common WHERE {where} GROUP BY region_id, read_i, read_j)
        USING (region_id, read_i, read_j)"""


_CORR = """CASE WHEN (n * sxx - sx * sx) * (n * sy - sy * sy) > 0 THEN
    (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * sy - sy * sy)) END"""

_BINARY = "p IS NOT NULL AND q IS NOT NULL"

_CONTRAST = """SELECT region_id, pos, n_{a}, n_{b}, mean_{a}, mean_{b}, mean_{a} - mean_{b} AS diff
    FROM (SELECT c.region_id, c.pos, count(*) FILTER ({ca}) AS n_{a},
                 count(*) FILTER ({cb}) AS n_{b},
                 CAST(sum(ml) FILTER ({ca}) AS DOUBLE) / (count(*) FILTER ({ca}) * 255.0::DOUBLE)
                   AS mean_{a},
                 CAST(sum(ml) FILTER ({cb}) AS DOUBLE) / (count(*) FILTER ({cb}) * 255.0::DOUBLE)
                   AS mean_{b}
          FROM cells c JOIN pairs p ON p.region_id = c.region_id AND p.read_id = c.read_id
          GROUP BY c.region_id, c.pos)"""

_SPREAD = """SELECT '{m}' AS measure, min({m}) AS min, max({m}) AS max, median({m}) AS median,
    sum({m})::DOUBLE / count(*) AS mean, """ + r6("stddev_samp({m})") + """ AS stddev
    FROM result WHERE success"""


def _chi_tail(x: str, k: str) -> str:
    """1 minus the series of the lower tail; its terms are all positive."""
    h = f"greatest({x}, 1e-300) / 2"
    return (f"(1.0 - least(1.0, list_sum(list_transform(range(0, 400), lambda i: exp(-({h}) "
            f"+ (i + {k} / 2.0) * ln({h}) - lgamma(i + {k} / 2.0 + 1))))))")


def _rand_index(counts: str) -> str:
    """Adjusted Rand index from a table of cluster x level counts."""
    return f"""
    SELECT region_id, {r6('''(i - e) / nullif((r + c) / 2 - e, 0)''')} AS ari
    FROM (SELECT *, r * c / nullif(t * (t - 1) / 2, 0) AS e
          FROM (SELECT region_id, sum(n * (n - 1) / 2)::DOUBLE AS i, sum(n)::DOUBLE AS t
                FROM {counts} GROUP BY 1)
          JOIN (SELECT region_id, sum(n * (n - 1) / 2)::DOUBLE AS r FROM (
                SELECT region_id, cluster_id, sum(n) AS n FROM {counts} GROUP BY ALL)
                GROUP BY 1) USING (region_id)
          JOIN (SELECT region_id, sum(n * (n - 1) / 2)::DOUBLE AS c FROM (
                SELECT region_id, level, sum(n) AS n FROM {counts} GROUP BY ALL)
                GROUP BY 1) USING (region_id))"""


def _mutual(counts: str) -> str:
    """Normalised mutual information from a table of cluster x level counts."""
    return f"""
    SELECT region_id, {r6('(hc + hl - h) / nullif((hc + hl) / 2, 0)')} AS nmi
    FROM (SELECT region_id, -sum(p * ln(p)) AS h FROM (
            SELECT region_id, n::DOUBLE / sum(n) OVER (PARTITION BY region_id) AS p
            FROM {counts}) GROUP BY 1)
    JOIN (SELECT region_id, -sum(p * ln(p)) AS hc FROM (
            SELECT region_id, n::DOUBLE / sum(n) OVER (PARTITION BY region_id) AS p
            FROM (SELECT region_id, cluster_id, sum(n) AS n FROM {counts} GROUP BY ALL))
          GROUP BY 1) USING (region_id)
    JOIN (SELECT region_id, -sum(p * ln(p)) AS hl FROM (
            SELECT region_id, n::DOUBLE / sum(n) OVER (PARTITION BY region_id) AS p
            FROM (SELECT region_id, level, sum(n) AS n FROM {counts} GROUP BY ALL))
          GROUP BY 1) USING (region_id)"""


def statements() -> dict[str, str]:
    """SQL text per query name."""
    out: dict[str, str] = {}

    def add(name: str, body: str, *tables: str) -> None:
        out[name] = sql(body, *tables)

    # Sources and sinks.
    add("load_vcf", f"""SELECT snv_id, chrom, pos, ref, alt, qual, is_pass,
        {r6('somatic_conf')} AS somatic_conf, info FROM snvs""", "snvs")
    add("load_snv_tsv", """SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS INT) AS snv_id,
        chrom, pos, ref, alt, CASE WHEN ord % 5 <> 0 THEN qual ELSE 0.0 END AS qual
        FROM records WHERE ref IN ('A','C','G','T') AND alt IN ('A','C','G','T')""", "records")
    add("select_snvs", """SELECT ord, chrom, pos, ref, alt, qual, flt FROM records
        WHERE qual >= 10 AND flt IN ('PASS', '.') AND info LIKE 'SOMATIC;%'
          AND pos BETWEEN 1 AND 1500 AND normal_af <= 0.04
          AND ref IN ('A','C','G','T') AND alt IN ('A','C','G','T')""", "records")
    add("load_alignments", """SELECT row_number() OVER (ORDER BY read_key) - 1 AS read_key, qname, flag, chrom, align_start, mapq, cigar, hp,
        ps, md5(seq) AS seq_md5, md5(qual) AS qual_md5, md5(mm) AS mm_md5,
        md5(CASE WHEN len(ml) = 0 THEN '' ELSE
            array_to_string(list_transform(ml, lambda x: CAST(x AS VARCHAR)), ',') END)
          AS ml_md5 FROM aln""", "aln")
    add("tile_reference", "SELECT chrom, tile, tile_start, core, seq FROM tiles", "tiles")
    add("load_fasta_tiles", """SELECT chrom, tile, tile_start, core, md5(seq) AS seq_md5,
        length AS contig_length FROM tiles JOIN (
            SELECT chrom, length(seq) AS length FROM contigs) USING (chrom)""", "tiles", "contigs")
    add("contig_lengths", """SELECT chrom, coalesce(length(seq), -1) AS length
        FROM (SELECT DISTINCT chrom FROM records) LEFT JOIN contigs USING (chrom)""",
        "records", "contigs")
    add("chrom_dictionary", """SELECT CAST(row_number() OVER (ORDER BY min(ord)) - 1 AS INT)
        AS chr_id, chrom FROM records GROUP BY chrom""", "records")
    add("load_annotation", 'SELECT chrom, "start", "end", cls FROM annotation', "annotation")
    add("write_snv_tsv", f"""SELECT snv_id, chrom AS chr, pos, ref, alt, qual, 'PASS' AS filter,
        {r6('somatic_conf')} AS somatic_conf FROM snvs""", "snvs")
    add("write_region_tables", """
        SELECT region_id, 'reads' AS name, count(*) AS n_rows,
               CAST(sum(read_id + align_start) AS BIGINT) AS checksum FROM rr GROUP BY region_id
        UNION ALL SELECT region_id, 'cpg_sites', count(*), CAST(sum(cpg_id + pos) AS BIGINT)
        FROM (SELECT DISTINCT region_id, cpg_id, pos FROM matrix) GROUP BY region_id
        UNION ALL SELECT region_id, 'matrix', count(*), CAST(sum(ml) AS BIGINT)
        FROM matrix GROUP BY region_id
        UNION ALL SELECT region_id, 'region_result', 1, num_reads + num_cpgs FROM result""",
        "rr", "matrix", "result")
    chroms = """(SELECT row_number() OVER (ORDER BY min(ord)) - 1 AS chr_id, chrom
        FROM records GROUP BY chrom)"""
    add("reads_tsv_lines", f"""
        SELECT region_id, 0 AS line_no, array_to_string(['read_id', 'read_name', 'chr_id', 'start',
            'end', 'mapq', 'hp', 'alt_support', 'is_tumor'], chr(9)) AS line
        FROM rr WHERE read_id = 0
        UNION ALL
        SELECT region_id, read_id + 1, concat_ws(chr(9), read_id, qname, chr_id, align_start,
               align_end, mapq, hp, alt_support, CASE WHEN is_tumor THEN 1 ELSE 0 END)
        FROM rr JOIN {chroms} USING (chrom)""", "rr", "records")
    add("cpg_sites_tsv_lines", f"""
        SELECT region_id, 0 AS line_no,
               array_to_string(['cpg_id', 'chr_id', 'position'], chr(9)) AS line
        FROM status WHERE success
        UNION ALL
        SELECT region_id, cpg_id + 1, concat_ws(chr(9), cpg_id, chr_id, pos)
        FROM (SELECT DISTINCT region_id, chrom, pos, cpg_id FROM matrix)
        JOIN {chroms} USING (chrom)""", "status", "matrix", "records")
    add("distance_csv_lines", """
        SELECT region_id, 0 AS line_no,
               'read_id,' || string_agg(CAST(read_j AS VARCHAR), ',' ORDER BY read_j) AS line
        FROM whole_matrix WHERE read_i = 0 GROUP BY region_id
        UNION ALL
        SELECT region_id, read_i + 1, read_i || ',' || string_agg(
               printf('%.4f', floor(dist * 1e4 + 0.5) / 1e4), ',' ORDER BY read_j)
        FROM whole_matrix GROUP BY region_id, read_i""", "whole_matrix")
    add("matrix_csv_lines", """
        SELECT region_id, 0 AS line_no, 'read_id' || coalesce(',' || string_agg(
                 CAST(pos AS VARCHAR), ',' ORDER BY pos), '') AS line
        FROM (SELECT DISTINCT p.region_id, m.pos FROM pairs p
              LEFT JOIN (SELECT DISTINCT region_id, pos FROM matrix) m USING (region_id))
        GROUP BY region_id
        UNION ALL
        SELECT region_id, read_id + 1, read_id || coalesce(',' || string_agg(cell, ','
                 ORDER BY pos), '')
        FROM (SELECT p.region_id, p.read_id, s.pos, CASE WHEN s.pos IS NOT NULL THEN
                     coalesce(printf('%.4f', m.prob), 'NA') END AS cell
              FROM pairs p
              LEFT JOIN (SELECT DISTINCT region_id, pos FROM matrix) s
                ON s.region_id = p.region_id
              LEFT JOIN matrix m ON m.region_id = p.region_id AND m.read_id = p.read_id
                AND m.pos = s.pos)
        GROUP BY region_id, read_id""", "pairs", "matrix")
    add("metadata_lines", """
        SELECT region_id, CAST(i AS INT) AS line_no, lines[i + 1] AS line
        FROM (SELECT *, unnest(range(0, len(lines))) AS i FROM (
            SELECT s.region_id, [
                'Region ID: ' || s.region_id,
                'Region: ' || chrom || ':' || win_start || '-' || win_end,
                'Region Size: ' || (win_end - win_start + 1) || ' bp', '',
                'SNV ID: ' || s.snv_id, 'SNV Position: ' || chrom || ':' || pos,
                'SNV: ' || ref || ' -> ' || alt, 'SNV Quality: ' || CAST(qual AS INT), '',
                'Num Reads: ' || num_reads, 'Num CpG Sites: ' || num_cpgs,
                'Matrix Dimensions: ' || num_reads || ' × ' || num_cpgs] AS lines
            FROM status s JOIN result r ON r.region_id = s.region_id WHERE s.success))""",
        "status", "result")

    add("reads_jsonl", """
        SELECT region_id, read_id, '{"region_id":' || region_id || ',"read_name":"' || qname
            || '","chr":"' || chrom || '","start":' || align_start || ',"hp":' || hp
            || ',"is_tumor":' || is_tumor || ',"alt_support":"' || alt_support
            || '","cluster_id":' || (hp + 1) || ',"methylation":{' || coalesce(calls, '')
            || '}}' AS json
        FROM rr LEFT JOIN (
            SELECT region_id, read_id, string_agg('"' || pos || '":' || round(prob, 4), ','
                   ORDER BY pos) AS calls FROM matrix GROUP BY ALL)
        USING (region_id, read_id)""", "rr", "matrix")
    add("cluster_summary_csv", """
        SELECT s.region_id, r.chrom AS chr, r.pos, s.cluster_id, size, count_hp1 AS hp1,
               count_hp2 AS hp2, count_hp_unknown AS hpNA, count_tumor AS tumor,
               count_normal AS normal, count_alt AS alt, count_ref AS ref,
               {h} AS p_hp, {a} AS p_somatic
        FROM stats s JOIN regions r ON r.region_id = s.region_id
        JOIN tests h ON h.region_id = s.region_id AND h.cluster_id = s.cluster_id
          AND h.factor = 'hp'
        JOIN tests a ON a.region_id = s.region_id AND a.cluster_id = s.cluster_id
          AND a.factor = 'allele'""".format(h=r6("h.p_value"), a=r6("a.p_value")),
        "stats", "regions", "tests")

    # Projections, filters, row selection.
    add("make_regions", "SELECT * FROM regions", "regions")
    add("limit_snvs", "SELECT snv_id, chrom, pos FROM snvs ORDER BY snv_id LIMIT 32", "snvs")
    add("sample_snvs", """SELECT snv_id, chrom, pos FROM snvs
        ORDER BY md5('42:' || snv_id), snv_id LIMIT 32""", "snvs")
    add("top_snvs", f"""SELECT snv_id, chrom, pos, ref, alt, qual,
        {r6('somatic_conf')} AS somatic_conf FROM snvs ORDER BY snv_id LIMIT 10""", "snvs")
    add("filter_reads", "SELECT read_key, flag, mapq, cigar FROM kept", "kept")
    add("filter_reasons", f"""SELECT {_REASON} AS reason, count(*) AS n_reads
        FROM info GROUP BY 1""", "info")
    add("cigar_lengths", "SELECT read_key, cigar, query_length, align_end FROM info", "info")
    add("read_info", """SELECT read_key, qname, chrom, align_start, align_end, mapq,
        coalesce(hp, 0) AS hp, ps, is_tumor FROM info""", "info")
    add("alt_support", "SELECT region_id, read_key, alt_support FROM rr", "rr")
    add("read_state", """SELECT region_id, read_id,
        (CASE WHEN is_tumor THEN 1 ELSE 0 END) | (CASE hp WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 0 END)
        | (CASE alt_support WHEN 'ALT' THEN 8 WHEN 'REF' THEN 16 ELSE 32 END) AS state_bits
        FROM rr""", "rr")
    add("phase_gate", """
        SELECT r.region_id, snv_id, CASE WHEN bad THEN 0 ELSE num_reads END AS num_reads,
               CASE WHEN bad THEN 0 ELSE num_cpgs END AS num_cpgs, success AND NOT bad AS success,
               CASE WHEN bad THEN 'AMBIGUOUS_PHASE' ELSE error_message END AS error_message
        FROM (SELECT r.*, coalesce(p.most::DOUBLE / p.n < 0.9, FALSE) AS bad FROM result r LEFT JOIN (
            SELECT region_id, max(n) AS most, sum(n) AS n FROM (
                SELECT region_id, ps, count(*) AS n FROM pairs WHERE ps IS NOT NULL GROUP BY ALL)
            GROUP BY region_id) p ON p.region_id = r.region_id) r""", "result", "pairs")
    add("phase_set_check", """
        SELECT region_id, ps AS major_ps, CAST(n_phased AS BIGINT) AS n_phased,
               n::DOUBLE / n_phased AS share,
               CASE WHEN n::DOUBLE / n_phased >= 0.9 THEN 'OK' ELSE 'AMBIGUOUS_PHASE' END AS status
        FROM (SELECT *, sum(n) OVER (PARTITION BY region_id) AS n_phased,
                     row_number() OVER (PARTITION BY region_id ORDER BY n DESC, ps) AS rk
              FROM (SELECT region_id, ps, count(*) AS n FROM pairs WHERE ps IS NOT NULL
                    GROUP BY ALL)) WHERE rk = 1""", "pairs")

    # From reads to calls.
    add("cigar_blocks", "SELECT read_key, seq_start, ref_start, length FROM blocks", "blocks")
    add("modified_bases", _per_read("bases", "seq_idx"), "bases")
    add("project_calls", _per_read("bases", "pos", "pos IS NOT NULL"), "bases")
    add("validate_cpg", _per_read("calls", "pos"), "calls")
    add("methylation_calls", """SELECT chrom, pos, count(*) AS n_calls,
        CAST(sum(ml) AS BIGINT) AS sum_ml, count(*) FILTER (ml / 255.0::DOUBLE >= 0.8) AS n_high
        FROM calls GROUP BY ALL""", "calls")
    add("reference_cpg_sites", "SELECT chrom, pos FROM sites", "sites")
    add("read_methyl_summary", f"""
        SELECT (SELECT count(*) FROM info) AS n_reads,
               (SELECT count(*) FROM info WHERE {_REASON} = 'kept') AS n_kept,
               count(DISTINCT read_key) AS n_with_calls, count(*) AS n_calls,
               count(*)::DOUBLE / count(DISTINCT read_key) AS calls_per_read
        FROM calls""", "info", "calls")
    add("read_audit", """
        SELECT o.region_id, o.read_id, o.qname, o.cigar, o.off AS snv_offset,
               CASE WHEN o.off >= 0 THEN o.seq[o.off + 1] END AS base,
               CASE WHEN o.off >= 0 AND o.qual <> '*' THEN ascii(o.qual[o.off + 1]) - 33 END
                 AS base_quality, r.alt_support, coalesce(n, 0) AS n_sites
        FROM offsets o JOIN rr r ON r.region_id = o.region_id AND r.read_id = o.read_id
        LEFT JOIN (SELECT region_id, read_id, count(*) AS n FROM cells GROUP BY ALL) c
          ON c.region_id = o.region_id AND c.read_id = o.read_id""", "offsets", "rr", "cells")

    # Joins.
    add("region_reads", """SELECT region_id, read_id, read_key, qname, chrom, align_start,
        align_end, mapq, hp, is_tumor, alt_support FROM rr""", "rr")
    add("region_calls", "SELECT * FROM cells", "cells")
    add("annotate_cpg", "SELECT * FROM flags", "flags")
    add("gate_pmd", """SELECT region_id, read_id, pos, ml FROM cells
        WHERE (chrom, pos) NOT IN (SELECT (chrom, pos) FROM flags WHERE in_pmd)""",
        "cells", "flags")
    add("region_status", """SELECT region_id, chrom, win_start, win_end, success, error_message
        FROM status""", "status")
    add("read_pairs", """SELECT region_id, read_i, read_j, count(*) AS n_common FROM common
        GROUP BY ALL""", "common")
    add("label_reads", "SELECT * FROM labelled", "labelled")
    add("label_truth", """SELECT region_id, CASE WHEN snv_id % 3 = 0 THEN 'FP' ELSE 'TP' END
        AS truth FROM regions""", "regions")

    # Matrices and aggregates.
    add("region_matrix", "SELECT region_id, read_id, cpg_id, pos, prob FROM matrix", "matrix")
    add("region_matrix_wide", """
        SELECT region_id, read_id, count(pos) AS n_sites,
               coalesce(string_agg(cell, ',' ORDER BY pos), '') AS levels
        FROM (SELECT p.region_id, p.read_id, s.pos, CASE WHEN s.pos IS NOT NULL THEN
                     coalesce(CAST(m.ml AS VARCHAR), 'NA') END AS cell
              FROM pairs p
              LEFT JOIN (SELECT DISTINCT region_id, pos FROM matrix) s
                ON s.region_id = p.region_id
              LEFT JOIN matrix m ON m.region_id = p.region_id AND m.read_id = p.read_id
                AND m.pos = s.pos)
        GROUP BY region_id, read_id""", "pairs", "matrix")
    add("matrix_ref_columns", """
        SELECT r.region_id, CAST(row_number() OVER (PARTITION BY r.region_id ORDER BY s.pos) - 1
                 AS INT) AS cpg_id, s.chrom, s.pos, coalesce(n, 0) AS n_reads
        FROM status r JOIN sites s ON s.chrom = r.chrom AND s.pos > r.win_start
          AND s.pos < r.win_end
        LEFT JOIN (SELECT region_id, pos, count(*) AS n FROM cells GROUP BY ALL) c
          ON c.region_id = r.region_id AND c.pos = s.pos
        WHERE r.success""", "status", "sites", "cells")
    add("binarize", "SELECT region_id, read_id, cpg_id, bin FROM matrix", "matrix")
    add("gate_coverage", """SELECT region_id, read_id, pos, ml FROM (
        SELECT *, count(*) OVER (PARTITION BY region_id, pos) AS n FROM cells) WHERE n >= 5""",
        "cells")
    add("drop_empty_reads", "SELECT DISTINCT region_id, read_id FROM gated", "gated")
    add("matrix_stats", """
        SELECT r.region_id, num_reads * num_cpgs AS cells,
               num_reads * num_cpgs - coalesce(n, 0) AS na_cells,
               coalesce(z, 0) AS zero_cells, coalesce(n - z, 0) AS nonzero_cells,
               CASE WHEN num_reads * num_cpgs > 0 THEN
                 (num_reads * num_cpgs - coalesce(n, 0)) * 100.0::DOUBLE / (num_reads * num_cpgs)
               END AS sparsity_pct
        FROM result r LEFT JOIN (SELECT region_id, count(*) AS n, count(*) FILTER (ml = 0) AS z
                                 FROM cells GROUP BY 1) c ON c.region_id = r.region_id
        WHERE success""", "result", "cells")
    add("region_result", "SELECT * FROM result", "result")
    add("run_summary", """
        SELECT count(*) AS total_regions, count(*) FILTER (success) AS successful,
               count(*) FILTER (NOT success) AS failed,
               CAST(sum(num_reads) FILTER (success) AS BIGINT) AS total_reads,
               CAST(sum(num_cpgs) FILTER (success) AS BIGINT) AS total_cpgs,
               sum(num_reads) FILTER (success)::DOUBLE / count(*) FILTER (success) AS avg_reads,
               sum(num_cpgs) FILTER (success)::DOUBLE / count(*) FILTER (success) AS avg_cpgs
        FROM result""", "result")
    add("region_extremes", _SPREAD.format(m="num_reads") + " UNION ALL "
        + _SPREAD.format(m="num_cpgs"), "result")
    add("check_dimensions", """
        SELECT region_id, issue FROM (
            SELECT r.region_id, CASE WHEN coalesce(n_sites, 0) <> num_cpgs THEN 'sites' END AS issue
            FROM result r LEFT JOIN (
                SELECT region_id, count(DISTINCT pos) AS n_sites FROM (
                    SELECT *, count(*) OVER (PARTITION BY region_id, pos) AS n FROM cells)
                WHERE n >= 5 GROUP BY 1) s ON s.region_id = r.region_id)
        WHERE issue IS NOT NULL""", "result", "cells")
    add("site_asm", _CONTRAST.format(a="hp1", b="hp2", ca="p.hp = 1", cb="p.hp = 2"),
        "cells", "pairs")
    add("site_tumor_normal", _CONTRAST.format(a="tumor", b="normal", ca="p.is_tumor",
                                              cb="NOT p.is_tumor"), "cells", "pairs")

    # Distances.
    pairs = ("all_pairs", "common")
    add("dist_nhd", f"""SELECT region_id, read_i, read_j, n_common, {r6('dist')} AS dist
        FROM nhd""", "nhd")
    add("dist_l1", _pair_metric("count(*)", "sum(abs(x - y))::DOUBLE / (255.0 * count(*))"), *pairs)
    add("dist_l2", _pair_metric(
        "count(*)", "sum((x - y) * (x - y))::DOUBLE / (65025.0 * count(*))"), *pairs)
    var = ("(count(*) * sum(x * x) - sum(x) * sum(x))::DOUBLE"
           " * (count(*) * sum(y * y) - sum(y) * sum(y))::DOUBLE")
    add("dist_corr", _pair_metric("count(*)", f"""CASE WHEN {var} > 0 THEN
        1.0 - (count(*) * sum(x * y) - sum(x) * sum(y))::DOUBLE / sqrt({var}) END"""), *pairs)
    add("dist_jaccard", _pair_metric("count(*)", """CASE WHEN sum(greatest(p, q)) > 0 THEN
        1.0 - sum(p * q)::DOUBLE / sum(greatest(p, q)) ELSE 0.0 END""", _BINARY), *pairs)
    add("dist_nhd_weighted", f"""
        SELECT region_id, read_i, read_j, coalesce(n, 0) AS n_common, {r6('dist')} AS dist
        FROM all_pairs LEFT JOIN (
            SELECT a.region_id, a.read_id AS read_i, b.read_id AS read_j, count(*) AS n,
                   sum(abs(a.bin - b.bin) * w)::DOUBLE / sum(w) AS dist
            FROM matrix a JOIN matrix b ON a.region_id = b.region_id AND a.pos = b.pos
             AND a.read_id < b.read_id
            JOIN (SELECT chrom, pos, CASE WHEN in_pmd THEN 1 ELSE 4 END AS w FROM flags) f
              ON f.chrom = a.chrom AND f.pos = a.pos
            WHERE a.bin IS NOT NULL AND b.bin IS NOT NULL GROUP BY ALL)
        USING (region_id, read_i, read_j)""", "all_pairs", "matrix", "flags")
    add("fill_missing_pairs", f"""SELECT region_id, read_i, read_j, {r6('dist')} AS dist
        FROM filled""", "filled")
    add("distance_matrix", f"""SELECT region_id, read_i AS read_id, string_agg(
            printf('%.6f', {r6('dist')}), ',' ORDER BY read_j) AS distances
        FROM whole_matrix GROUP BY ALL""", "whole_matrix")

    # Dendrograms and their cuts.
    for method in ("upgma", "ward"):
        add(f"cluster_reads_{method}", f"SELECT * FROM leaves_{method}", f"leaves_{method}")
    add("newick", """SELECT region_id, arg_max(trees, step)[1] || ';' AS newick
        FROM state_upgma GROUP BY region_id""", "state_upgma")
    add("cut_height", """
        SELECT region_id, read_id, dense_rank() OVER (
                   PARTITION BY region_id ORDER BY first) AS cluster_id
        FROM (SELECT *, min(read_id) OVER (PARTITION BY region_id, seg) AS first
              FROM (SELECT *, sum(CASE WHEN height IS NULL OR height > 0.5 THEN 1 ELSE 0 END) OVER (
                           PARTITION BY region_id ORDER BY leaf_pos) AS seg
                    FROM leaves_upgma))""", "leaves_upgma")
    add("cut_k", "SELECT region_id, read_id, cluster_id FROM cuts WHERE k = 3", "cuts")
    add("cut_silhouette", """
        SELECT region_id, read_id, cluster_id, k FROM cuts
        JOIN (SELECT region_id, -max({'m': coalesce(mean, -2e9), 'neg': -k}).neg AS k
              FROM cut_scores GROUP BY region_id) USING (region_id, k)""", "cuts", "cut_scores")

    # Clusters, from the fixed labelling.
    add("silhouette", f"""
        SELECT l.region_id, l.read_id, l.cluster_id, {r6('''CASE WHEN b IS NULL THEN NULL
            WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END''')}
            AS silhouette
        FROM labels l LEFT JOIN (
            SELECT m.region_id, m.read_i, max(mean) FILTER (m.other = o.cluster_id) AS a,
                   min(mean) FILTER (m.other <> o.cluster_id) AS b
            FROM (SELECT w.region_id, w.read_i, t.cluster_id AS other,
                         sum(CAST(floor(dist * 1e9 + 0.5) AS BIGINT))::DOUBLE / count(*) AS mean
                  FROM both_ways w JOIN labels t
                    ON t.region_id = w.region_id AND t.read_id = w.read_j GROUP BY ALL) m
            JOIN labels o ON o.region_id = m.region_id AND o.read_id = m.read_i
            GROUP BY ALL) s ON s.region_id = l.region_id AND s.read_i = l.read_id""",
        "labels", "both_ways")
    add("cluster_stats", "SELECT * FROM stats", "stats")
    add("methylation_entropy", f"""
        SELECT region_id, cluster_id, {r6('''avg(
            CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END
            + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END)''')} AS entropy,
            count(*) AS n_sites
        FROM (SELECT g.region_id, l.cluster_id, g.pos, sum(bin)::DOUBLE / count(*) AS p
              FROM gated g JOIN labels l ON l.region_id = g.region_id AND l.read_id = g.read_id
              WHERE bin IS NOT NULL GROUP BY ALL)
        GROUP BY region_id, cluster_id""", "gated", "labels")

    # Association.
    add("contingency", "SELECT * FROM tables", "tables")
    add("fisher_exact", f"""SELECT * REPLACE ({r6('p_value')} AS p_value,
        {r6('log10_p')} AS log10_p) FROM tests""", "tests")
    add("chi_square", f"""
        SELECT * EXCLUDE (chi2_raw), CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN
            {r6('(a + b + c + d)::DOUBLE * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d))')}
            END AS chi2,
            CASE WHEN chi2_raw IS NOT NULL THEN {r6(_chi_tail("chi2_raw", "1"))} END AS p_value
        FROM (SELECT *, (a + b + c + d)::DOUBLE * (a * d - b * c) * (a * d - b * c)
              / nullif((a + b) * (c + d) * (a + c) * (b + d), 0) AS chi2_raw FROM tables)""",
        "tables")
    add("chi_square_table", f"""
        SELECT region_id, {r6('x')} AS chi2, dof,
               CASE WHEN dof > 0 THEN {r6(_chi_tail("greatest(x, 0)", "dof"))} END AS p_value
        FROM (
        SELECT region_id, any_value(total) * (sum(n * n / (r::DOUBLE * c)) - 1.0) AS x,
               (count(DISTINCT cluster_id) - 1) * (count(DISTINCT level) - 1) AS dof
        FROM (SELECT *, sum(n) OVER (PARTITION BY region_id, cluster_id) AS r,
                     sum(n) OVER (PARTITION BY region_id, level) AS c,
                     sum(n) OVER (PARTITION BY region_id) AS total FROM crossed)
        GROUP BY region_id)""", "crossed")
    add("fdr_bh", f"""SELECT region_id, cluster_id, factor, {r6('p_value')} AS p_value,
        {r6('q_value')} AS q_value
        FROM bh""", "bh")
    add("cluster_tests", f"""SELECT region_id, cluster_id, factor, a, b, c, d,
        {r6('p_value')} AS p_value, {r6('log10_p')} AS log10_p, {r6('q_value')} AS q_value
        FROM k_bh""", "k_bh")
    add("adjusted_rand", _rand_index("crossed"), "crossed")
    add("nmi", _mutual("crossed"), "crossed")
    add("cluster_agreement", f"""SELECT region_id, ari, nmi FROM ({_rand_index("k_crossed")})
        JOIN ({_mutual("k_crossed")}) USING (region_id)""", "k_crossed")
    add("label_distance_corr", f"""
        SELECT region_id, CAST(n AS BIGINT) AS n_pairs, {r6(_CORR)} AS corr
        FROM (SELECT region_id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy,
                     sum(x * y)::DOUBLE AS sxy, sum(x * x)::DOUBLE AS sxx
              FROM (SELECT f.region_id, CAST(floor(dist * 1e6 + 0.5) AS BIGINT) AS x,
                           CASE WHEN a.hp <> b.hp THEN 1 ELSE 0 END AS y
                    FROM filled f
                    JOIN pairs a ON a.region_id = f.region_id AND a.read_id = f.read_i
                    JOIN pairs b ON b.region_id = f.region_id AND b.read_id = f.read_j
                    WHERE a.hp IN (1, 2) AND b.hp IN (1, 2)) GROUP BY 1)""", "filled", "pairs")
    add("truth_report", """
        SELECT truth, count(*) AS n_regions, CAST(sum(coalesce(hit, 0)) AS BIGINT) AS n_significant,
               sum(coalesce(hit, 0))::DOUBLE / count(*) AS share
        FROM (SELECT region_id, CASE WHEN snv_id % 3 = 0 THEN 'FP' ELSE 'TP' END AS truth
              FROM status WHERE success)
        LEFT JOIN (SELECT region_id, max(CASE WHEN q_value <= 0.05 THEN 1 ELSE 0 END) AS hit
                   FROM bh WHERE factor = 'allele' GROUP BY 1) USING (region_id)
        GROUP BY truth""", "status", "bh")

    ranks = (5, 25, 50, 75, 95)
    at_rank = ", ".join(f"list_sort(list(corr) FILTER (corr IS NOT NULL))["
                        f"greatest(1, ceil({q / 100} * count(corr)))::BIGINT] AS q{q:02d}" for q in ranks)
    add("correlation_by_truth", f"""
        SELECT truth, count(corr) AS n_corr, count(*) - count(corr) AS n_without, {at_rank}
        FROM (SELECT region_id, CASE WHEN snv_id % 3 = 0 THEN 'FP' ELSE 'TP' END AS truth
              FROM status WHERE success)
        LEFT JOIN (
            SELECT region_id, {r6(_CORR)} AS corr
            FROM (SELECT region_id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx,
                         sum(y)::DOUBLE AS sy, sum(x * y)::DOUBLE AS sxy, sum(x * x)::DOUBLE AS sxx
                  FROM (SELECT f.region_id, CAST(floor(dist * 1e6 + 0.5) AS BIGINT) AS x,
                               CASE WHEN least(a.cluster_id, 2) <> least(b.cluster_id, 2) THEN 1
                                    ELSE 0 END AS y
                        FROM filled f
                        JOIN cuts a ON a.k = 3 AND a.region_id = f.region_id AND a.read_id = f.read_i
                        JOIN cuts b ON b.k = 3 AND b.region_id = f.region_id AND b.read_id = f.read_j)
                  GROUP BY 1)) USING (region_id)
        GROUP BY truth""", "status", "filled", "cuts")

    # Windows and set operations.
    add("read_ids", "SELECT region_id, read_key, read_id FROM pairs", "pairs")
    add("cpg_index", "SELECT DISTINCT region_id, chrom, pos, cpg_id FROM matrix", "matrix")
    add("combine_samples", """SELECT read_key * 2 AS read_key, qname, chrom, align_start, is_tumor
        FROM aln WHERE is_tumor
        UNION ALL SELECT read_key * 2 + 1, qname, chrom, align_start, is_tumor
        FROM aln WHERE NOT is_tumor""", "aln")
    return out
