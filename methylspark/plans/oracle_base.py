"""The derived tables of ``star`` and the shared steps as DuckDB views (CTE text).

Used only to check results: each entry is ``name -> (names it reads, SQL)``.
"""

from __future__ import annotations

import re

from methylspark.plans import star

WINDOW = 200
MIN_LENGTH = 100
MIN_MAPQ = 20
MIN_BASEQ = 20

#: ``lf(a, b, c, d, x)``: log probability of x in the first cell, margins as given.
_LF = re.compile(r"\blf\(a, b, c, d, (\w)\)")


def _log_point(match: re.Match) -> str:
    x = match.group(1)
    up = ("a + b", "c + d", "a + c", "b + d")
    down = ("a + b + c + d", x, f"a + b - {x}", f"a + c - {x}", f"d - a + {x}")
    return "(" + " + ".join(f"lgamma({v} + 1)" for v in up) + " - " + " - ".join(
        f"lgamma({v} + 1)" for v in down) + ")"


_SECTION = ("'{code}' || CASE WHEN {n} > 0 THEN ',' ELSE '' END || "
            "coalesce(array_to_string(list_transform(range(0, {n}), "
            "lambda i: CAST((i * {step} + z) % 3 AS VARCHAR)), ','), '') || ';'")

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "nd": ((), "SELECT max(doc_id) + 1 AS n FROM documents"),
    "contigs": ((), f"""
        SELECT doc_id AS cid, 'chr' || doc_id AS chrom,
               regexp_replace(translate(text, '{star.LETTERS}', '{star.BASES}'),
                              '[^acgtACGT]', 'N', 'g') AS seq
        FROM documents"""),
    "tiles_over": (("contigs",), f"""
        SELECT chrom, CAST(t AS INT) AS tile, CAST(t * {star.TILE_BP} AS INT) AS tile_start,
               CAST(least({star.TILE_BP}, length(seq) - t * {star.TILE_BP}) AS INT) AS core,
               upper(substr(seq, t * {star.TILE_BP} + 1,
                            {star.TILE_BP} + {star.TILE_OVERLAP})) AS seq
        FROM (SELECT *, unnest(range(0, (length(seq) - 1) // {star.TILE_BP} + 1)) AS t
              FROM contigs WHERE length(seq) > 0)"""),
    "tiles": (("tiles_over",), f"""
        SELECT chrom, tile, tile_start, core, substr(seq, 1, {star.TILE_BP} + 1) AS seq
        FROM tiles_over"""),
    "sites": (("contigs",), """
        SELECT chrom, CAST(upto - 1 AS INT) AS pos
        FROM (SELECT chrom, i, n, sum(length(piece) + 2)
                       OVER (PARTITION BY chrom ORDER BY i) AS upto
              FROM (SELECT chrom, len(p) AS n, unnest(p) AS piece,
                           unnest(range(1, len(p) + 1)) AS i
                    FROM (SELECT chrom, string_split(upper(seq), 'CG') AS p FROM contigs)))
        WHERE i < n"""),
    "records": (("nd", "contigs"), """
        SELECT ord, coalesce(chrom, 'chrUn') AS chrom,
               CAST(CASE WHEN off > 0 THEN start + off ELSE start END AS INT) AS pos,
               CASE WHEN off > 0 THEN 'C' ELSE base END ||
                 CASE WHEN ord % 43 = 0 THEN 'A' ELSE '' END AS ref,
               CASE WHEN off > 0 THEN 'G' WHEN base = 'A' THEN 'T' ELSE 'A' END ||
                 CASE WHEN ord % 41 = 0 THEN ',N' ELSE '' END AS alt,
               CAST(p_size AS DOUBLE) AS qual,
               CASE ord % 10 WHEN 3 THEN 'LowQual' WHEN 4 THEN '.' ELSE 'PASS' END AS flt,
               CASE WHEN ord % 3 = 0 THEN 'DP=' ELSE 'SOMATIC;DP=' END || p_size AS info,
               CASE WHEN ord % 13 = 0 THEN 0.0 ELSE CAST(ord % 100 AS DOUBLE) / 100.0 END
                 AS somatic_conf,
               CASE WHEN ord % 13 = 0 THEN 0.01 ELSE CAST(ord % 7 AS DOUBLE) / 100.0 END
                 AS normal_af
        FROM (SELECT *, coalesce(instr(substr(seq, start), 'TCT'), 0) AS off,
                     coalesce(substr(seq, start, 1), 'A') AS base
              FROM (SELECT p_partkey AS ord, p_size, c.chrom, upper(c.seq) AS seq,
                           1 + (p_partkey * 104729 + p_size * 31)
                             % greatest(coalesce(length(c.seq), 1000), 1) AS start
                    FROM (SELECT *, CASE WHEN p_partkey % 97 = 0 THEN -1
                                    ELSE (p_partkey * 7919) % (SELECT n FROM nd) END AS cid
                          FROM part) p LEFT JOIN contigs c ON p.cid = c.cid))"""),
    "snvs": (("records",), """
        SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS INT) AS snv_id, chrom, pos, ref,
               alt, qual, TRUE AS is_pass, somatic_conf, info
        FROM records
        WHERE flt = 'PASS' AND ref IN ('A','C','G','T') AND alt IN ('A','C','G','T')"""),
    "regions": (("snvs",), f"""
        SELECT snv_id AS region_id, snv_id, chrom, pos, ref, alt, qual,
               greatest(1, pos - {WINDOW}) AS win_start, pos + {WINDOW} AS win_end
        FROM snvs"""),
    "status": (("regions", "contigs"), """
        SELECT r.*, win_start < coalesce(length(seq), -1) AS success,
               CASE WHEN win_start < coalesce(length(seq), -1) THEN ''
                    ELSE 'Failed to fetch reference sequence' END AS error_message
        FROM regions r LEFT JOIN contigs USING (chrom)"""),
    "lines": (("nd",), """
        SELECT *, (k * 31 + part * 17 + supp) % (SELECT n FROM nd) AS cid
        FROM (SELECT l_orderkey * 8 + l_linenumber AS k,
                     (l_partkey * 10007 + l_suppkey * 17
                      + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) % 4194304 AS z,
                     l_partkey AS part, l_suppkey AS supp,
                     120 + 8 * CAST(l_quantity AS INT) AS want,
                     l_returnflag <> 'A' AS is_tumor FROM lineitem)"""),
    "placed": (("lines", "contigs"), f"""
        SELECT * REPLACE (CASE WHEN m >= 60 AND avail >= m + gap THEN kind ELSE 0 END AS kind,
                          CASE WHEN m >= 60 AND avail >= m + gap THEN gap ELSE 0 END AS gap),
               m // 2 AS a, m - m // 2 AS b, start // {star.TILE_BP} AS tile,
               (z + supp) % 2 AS hap
        FROM (SELECT *, CASE kind WHEN 2 THEN 7 WHEN 4 THEN 20 ELSE 0 END AS gap
              FROM (SELECT *, least(want, avail) AS m, (k + z) % 5 AS kind
                    FROM (SELECT *, len - start AS avail
                          FROM (SELECT l.*, c.chrom, length(c.seq) AS len,
                                       (z * 7919 + k * 104729) % length(c.seq) AS start
                                FROM lines l JOIN contigs c USING (cid)))))"""),
    "built": (("placed", "tiles_over"), f"""
        SELECT *, length(seq) - length(replace(seq, 'C', '')) AS n_c
        FROM (SELECT *, CASE kind WHEN 1 THEN '{star.CLIP}' ELSE '' END
                || substr(src, p1, a) || CASE kind WHEN 1 THEN '{star.INSERT}' ELSE '' END
                || substr(src, p1 + a + gap, b)
                || CASE kind WHEN 2 THEN '{star.TAIL}' ELSE '' END AS seq,
                CASE kind WHEN 1 THEN '10S' || a || 'M5I' || b || 'M'
                     WHEN 2 THEN a || 'M7D' || b || 'M3S'
                     WHEN 3 THEN '5H' || a || '=1X' || (b - 1) || '='
                     WHEN 4 THEN a || 'M20N' || b || 'M' ELSE m || 'M' END AS cigar
              FROM (SELECT p.*, start - p.tile * {star.TILE_BP} + 1 AS p1,
                           CASE WHEN is_tumor AND hap = 1 THEN replace(t.seq, 'TCT', 'TGT')
                                ELSE t.seq END AS src
                    FROM placed p JOIN tiles_over t ON p.chrom = t.chrom AND p.tile = t.tile))"""),
    "aln": (("built",), f"""
        SELECT k * 4194304 + z AS read_key, 'r' || k || '_' || z AS qname,
               CASE z % 20 WHEN 0 THEN 256 WHEN 1 THEN 2048 WHEN 2 THEN 1024 WHEN 3 THEN 4
                    ELSE CASE WHEN z % 20 < 12 THEN 16 ELSE 0 END END AS flag,
               chrom, CAST(start AS INT) AS align_start, CAST((k * 7 + z) % 61 AS INT) AS mapq,
               cigar, seq,
               CASE WHEN z % 50 = 7 THEN '*' ELSE
                 substr(repeat('{star.QUALITIES}', {star.QUALITY_COPIES}), 1 + z % 13,
                        length(seq)) END AS qual,
               CASE WHEN z % 7 <> 0 THEN CAST(1 + hap AS INT) END AS hp,
               CASE WHEN z % 7 <> 0 THEN CASE WHEN cid % 4 = 0 AND z % 3 = 0 THEN 900
                    WHEN z % 23 = 0 THEN 900 ELSE 100 END END AS ps,
               CASE WHEN z % 29 <> 0 THEN
                 CASE WHEN z % 11 = 0 THEN '' ELSE {_SECTION.format(code='C+h?', n='n_h', step=7)} END
                 || CASE WHEN z % 31 = 0 THEN '' ELSE
                    {_SECTION.format(code='C+m?', n='n_m', step=5)} END END AS mm,
               CASE WHEN z % 29 <> 0 THEN
                 CASE WHEN z % 37 = 0 THEN v[1:greatest(len(v) - 1, 0)] ELSE v END END AS ml,
               is_tumor
        FROM (SELECT *, list_concat(
                list_transform(range(0, n_h), lambda i: (i * 13 + z) % 256),
                list_transform(range(0, n_m), lambda i:
                  CASE WHEN (i + z) % 6 = 0 THEN (i * 37 + z) % 256
                       WHEN hap = 1 THEN 255 - (i * i * 7 + z) % 60
                       ELSE (i * 11 + z) % 55 END)) AS v
              FROM (SELECT *, CASE WHEN z % 31 = 0 THEN 0 ELSE n_c // 2 END AS n_m,
                           CASE WHEN z % 11 = 0 THEN 0 ELSE n_c // 4 END AS n_h FROM built))"""),
    "info": (("aln",), """
        SELECT *, CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1),
                       lambda x: CAST(x AS INT))) AS INT) AS query_length,
               align_start + greatest(1, CAST(coalesce(list_sum(list_transform(
                   regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1),
                   lambda x: CAST(x AS INT))), 0) AS INT)) AS align_end
        FROM aln"""),
    "kept": (("info",), f"""
        SELECT * FROM info
        WHERE (flag & 3332) = 0 AND mapq >= {MIN_MAPQ} AND query_length >= {MIN_LENGTH}
          AND mm IS NOT NULL AND ml IS NOT NULL"""),
    "ops": (("aln",), """
        SELECT read_key, k, n, op, align_start,
               sum(CASE WHEN contains('MIS=X', op) THEN n ELSE 0 END)
                 OVER (PARTITION BY read_key ORDER BY k) AS q_to,
               align_start + sum(CASE WHEN contains('MDN=X', op) THEN n ELSE 0 END)
                 OVER (PARTITION BY read_key ORDER BY k) AS r_to
        FROM (SELECT read_key, align_start, unnest(range(1, len(o) + 1)) AS k,
                     CAST(unnest(regexp_extract_all(cigar, '([0-9]+)[A-Z=]', 1)) AS INT) AS n,
                     unnest(regexp_extract_all(cigar, '[0-9]+([A-Z=])', 1)) AS op
              FROM (SELECT *, regexp_extract_all(cigar, '[0-9]+[A-Z=]') AS o FROM aln))"""),
    "blocks": (("ops",), """
        SELECT read_key, CAST(q_to - n AS INT) AS seq_start, CAST(r_to - n AS INT) AS ref_start,
               n AS length
        FROM ops WHERE contains('M=X', op) AND n > 0"""),
    "tags": (("aln",), """
        SELECT read_key, chrom, seq, deltas, ml[off + 1:off + len(deltas)] AS ml
        FROM (SELECT *, list_transform(list_filter(string_split(
                          string_split(substr(rest, 2), ';')[1], ','), lambda x: x <> ''),
                          lambda x: CAST(x AS INT)) AS deltas
              FROM (SELECT *, length(before) - length(replace(before, ',', '')) AS off
                    FROM (SELECT *, substr(mm, 1, instr(mm, 'C+m?') - 1) AS before,
                                 substr(mm, instr(mm, 'C+m?') + 4) AS rest
                          FROM aln WHERE instr(mm, 'C+m?') > 0)) WHERE rest LIKE ',%')
        WHERE len(deltas) > 0 AND off + len(deltas) <= len(ml)"""),
    "bases": (("tags", "blocks"), """
        SELECT m.read_key, m.chrom, CAST(seq_idx AS INT) AS seq_idx,
               CAST(b.ref_start + seq_idx - b.seq_start + 1 AS INT) AS pos,
               CAST(ml AS SMALLINT) AS ml
        FROM (SELECT o.read_key, o.chrom, o.ml, c.seq_idx
              FROM (SELECT read_key, chrom, ml,
                           sum(d + 1) OVER (PARTITION BY read_key ORDER BY k) AS ordinal
                    FROM (SELECT read_key, chrom, unnest(range(0, len(deltas))) AS k,
                                 unnest(deltas) AS d, unnest(ml) AS ml FROM tags)) o
              JOIN (SELECT read_key, i, n, sum(length(piece) + 1)
                             OVER (PARTITION BY read_key ORDER BY i) - 1 AS seq_idx
                    FROM (SELECT read_key, len(p) AS n, unnest(p) AS piece,
                                 unnest(range(1, len(p) + 1)) AS i
                          FROM (SELECT read_key, string_split(seq, 'C') AS p FROM tags))) c
                ON c.read_key = o.read_key AND c.i = o.ordinal AND c.i < c.n) m
        LEFT JOIN blocks b ON b.read_key = m.read_key
          AND seq_idx >= b.seq_start AND seq_idx < b.seq_start + b.length"""),
    "calls": (("bases", "sites"), """
        SELECT b.read_key, b.chrom, b.pos, b.ml FROM bases b
        JOIN sites s ON s.chrom = b.chrom AND s.pos = b.pos"""),
    "pairs": (("kept", "status"), """
        SELECT r.region_id, k.read_key, k.qname, k.chrom, k.align_start, k.align_end, k.mapq,
               coalesce(k.hp, 0) AS hp, k.ps, k.is_tumor, r.win_start, r.win_end, r.pos, r.ref,
               r.alt, k.seq, k.qual, k.cigar,
               CAST(row_number() OVER (PARTITION BY r.region_id
                    ORDER BY k.align_start, k.read_key) - 1 AS INT) AS read_id
        FROM status r JOIN kept k ON k.chrom = r.chrom
          AND k.align_start < r.win_end AND k.align_end >= r.win_start
        WHERE r.success"""),
    "offsets": (("pairs", "blocks"), """
        SELECT p.*, coalesce(b.seq_start + p.pos - 1 - b.ref_start, -1) AS off
        FROM pairs p LEFT JOIN blocks b ON b.read_key = p.read_key
          AND p.pos - 1 >= b.ref_start AND p.pos - 1 < b.ref_start + b.length"""),
    "rr": (("offsets",), f"""
        SELECT * EXCLUDE (seq, qual, cigar), CASE
            WHEN off < 0 THEN 'UNKNOWN'
            WHEN qual <> '*' AND ascii(qual[off + 1]) - 33 < {MIN_BASEQ} THEN 'UNKNOWN'
            WHEN seq[off + 1] = alt THEN 'ALT' WHEN seq[off + 1] = ref THEN 'REF'
            ELSE 'UNKNOWN' END AS alt_support
        FROM offsets"""),
    "cells": (("pairs", "calls"), """
        SELECT p.region_id, p.read_id, p.read_key, c.chrom, c.pos, c.ml
        FROM pairs p JOIN calls c ON c.read_key = p.read_key
          AND c.pos > p.win_start AND c.pos < p.win_end"""),
    "matrix": (("cells",), """
        SELECT region_id, read_id, CAST(dense_rank() OVER (PARTITION BY region_id ORDER BY pos)
                 - 1 AS INT) AS cpg_id, chrom, pos, ml, ml / 255.0::DOUBLE AS prob,
               CASE WHEN ml / 255.0::DOUBLE >= 0.8 THEN 1
                    WHEN ml / 255.0::DOUBLE <= 0.2 THEN 0 END AS bin
        FROM cells"""),
    "annotation": (("nd",), """
        SELECT 'chr' || ((c_custkey * 7) % (SELECT n FROM nd)) AS chrom,
               CAST((c_custkey * 613) % 2500 AS INT) AS "start",
               CAST((c_custkey * 613) % 2500 + 50 + (c_nationkey * 17) % 400 AS INT) AS "end",
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'PMD'
                    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'REPRESSIVE'
                    ELSE 'ACCESSIBLE' END AS cls
        FROM customer"""),
    "flags": (("cells", "annotation"), """
        SELECT s.chrom, s.pos,
               coalesce(bool_or(a.cls = 'PMD'), FALSE) AS in_pmd,
               coalesce(bool_or(a.cls = 'REPRESSIVE'), FALSE) AS in_repressive_state,
               coalesce(bool_or(a.cls = 'ACCESSIBLE'), FALSE) AS accessible
        FROM (SELECT DISTINCT chrom, pos FROM cells) s
        LEFT JOIN annotation a ON a.chrom = s.chrom AND a."start" < s.pos AND s.pos <= a."end"
        GROUP BY s.chrom, s.pos"""),
    "gated": (("matrix", "flags"), """
        SELECT * EXCLUDE (n) FROM (
            SELECT m.*, count(*) OVER (PARTITION BY region_id, pos) AS n
            FROM matrix m JOIN flags f USING (chrom, pos) WHERE NOT f.in_pmd)
        WHERE n >= 5"""),
    "all_pairs": (("pairs",), """
        SELECT a.region_id, a.read_id AS read_i, b.read_id AS read_j
        FROM pairs a JOIN pairs b ON a.region_id = b.region_id AND a.read_id < b.read_id"""),
    "common": (("gated",), """
        SELECT a.region_id, a.read_id AS read_i, b.read_id AS read_j,
               CAST(a.ml AS BIGINT) AS x, CAST(b.ml AS BIGINT) AS y, a.bin AS p, b.bin AS q
        FROM gated a JOIN gated b ON a.region_id = b.region_id AND a.pos = b.pos
         AND a.read_id < b.read_id"""),
    "nhd": (("all_pairs", "common"), """
        SELECT region_id, read_i, read_j, coalesce(n, 0) AS n_common,
               CASE WHEN n > 0 THEN s::DOUBLE / n END AS dist
        FROM all_pairs LEFT JOIN (
            SELECT region_id, read_i, read_j, count(*) AS n, sum(abs(p - q)) AS s FROM common
            WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL)
        USING (region_id, read_i, read_j)"""),
    "filled": (("nhd",), """
        SELECT region_id, read_i, read_j, n_common,
               CASE WHEN n_common >= 3 AND dist IS NOT NULL THEN dist ELSE 1.0 END AS dist
        FROM nhd"""),
    "both_ways": (("filled",), """
        SELECT region_id, read_i, read_j, dist FROM filled
        UNION ALL SELECT region_id, read_j, read_i, dist FROM filled"""),
    "whole_matrix": (("both_ways", "pairs"), """
        SELECT region_id, read_i, read_j, dist FROM both_ways
        UNION ALL SELECT region_id, read_id, read_id, 0.0 FROM pairs"""),
    "labels": (("pairs",), """
        SELECT region_id, read_id, hp + 1 AS cluster_id FROM pairs"""),
    "labelled": (("labels", "rr"), """
        SELECT l.region_id, l.read_id, l.cluster_id, r.hp, r.alt_support, r.is_tumor
        FROM labels l JOIN rr r ON l.region_id = r.region_id AND l.read_id = r.read_id"""),
    "stats": (("labelled",), """
        SELECT region_id, cluster_id, count(*) AS size,
               count(*) FILTER (hp = 1) AS count_hp1, count(*) FILTER (hp = 2) AS count_hp2,
               count(*) FILTER (hp NOT IN (1, 2)) AS count_hp_unknown,
               count(*) FILTER (is_tumor) AS count_tumor,
               count(*) FILTER (NOT is_tumor) AS count_normal,
               count(*) FILTER (alt_support = 'ALT') AS count_alt,
               count(*) FILTER (alt_support = 'REF') AS count_ref
        FROM labelled GROUP BY ALL"""),
    "tables": (("stats",), """
        SELECT region_id, cluster_id, factor, a, b,
               CAST(sum(a) OVER w - a AS BIGINT) AS c, CAST(sum(b) OVER w - b AS BIGINT) AS d
        FROM (SELECT region_id, cluster_id, 'hp' AS factor, count_hp1 AS a, count_hp2 AS b
              FROM stats
              UNION ALL SELECT region_id, cluster_id, 'allele', count_alt, count_ref FROM stats
              UNION ALL SELECT region_id, cluster_id, 'sample', count_tumor, count_normal
              FROM stats)
        WINDOW w AS (PARTITION BY region_id, factor)"""),
    "tests": (("tables",), """
        SELECT t.*, p.p_value, p.log10_p FROM tables t JOIN (
            SELECT a, b, c, d, exp(log_p) AS p_value, log_p / ln(10) AS log10_p FROM (
            SELECT a, b, c, d, least(0.0, max(lp) FILTER (lp <= lobs + 1e-7)
                   + ln(sum(exp(lp - lmax)) FILTER (lp <= lobs + 1e-7))) AS log_p
            FROM (SELECT *, max(lp) FILTER (lp <= lobs + 1e-7)
                         OVER (PARTITION BY a, b, c, d) AS lmax
            FROM (SELECT a, b, c, d, x, lf(a, b, c, d, a) AS lobs, lf(a, b, c, d, x) AS lp
                  FROM (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)),
                                               least(a + b, a + c) + 1)) AS x
                        FROM (SELECT DISTINCT a, b, c, d FROM tables))))
            GROUP BY a, b, c, d)) p USING (a, b, c, d)"""),
    "bh": (("tests",), """
        SELECT *, least(1.0, min(raw) OVER (PARTITION BY region_id, factor
                        ORDER BY p_value DESC, cluster_id DESC
                        ROWS UNBOUNDED PRECEDING)) AS q_value
        FROM (SELECT *, p_value * count(*) OVER (PARTITION BY region_id, factor)
                     / row_number() OVER (PARTITION BY region_id, factor
                                          ORDER BY p_value, cluster_id) AS raw FROM tests)"""),
    "crossed": (("labelled",), """
        SELECT region_id, cluster_id, alt_support AS level, count(*) AS n
        FROM labelled WHERE alt_support <> 'UNKNOWN' GROUP BY ALL"""),
    "result": (("status", "pairs", "cells"), """
        SELECT s.region_id, s.snv_id, coalesce(n_reads, 0) AS num_reads,
               coalesce(n_cpgs, 0) AS num_cpgs, success, error_message
        FROM status s
        LEFT JOIN (SELECT region_id, count(*) AS n_reads FROM pairs GROUP BY 1) USING (region_id)
        LEFT JOIN (SELECT region_id, count(DISTINCT pos) AS n_cpgs FROM cells GROUP BY 1)
          USING (region_id)"""),
}


_MIXED = "((a::BIGINT * 1000003 + b::BIGINT * 998244353) % 2147483647)"
_TIE = f"{_MIXED} * {_MIXED} % 2147483647"


def _merging(method: str) -> str:
    """One merge per region and step: the nearest two clusters, by a hash of both names on ties.

    A state holds the cluster and leaf place of every read and, by cluster name, the size, the sum
    of inner distances, the height of the last merge and the tree as text.
    """
    value = "s::DOUBLE / (na * nb)"
    height = "m.d / 1e9"
    order = "{}"
    if method == "ward":
        value = (f"2.0 * (na * nb) / (na + nb) * ({value} - wa::DOUBLE / (na * na)"
                 " - wb::DOUBLE / (nb * nb))")
        height = "sqrt(greatest(m.d, 0.0) / 1e9)"
        order = "floor({} + 0.5)"
    branch = "printf('%.6f', floor(({h} - tops[m.{x} + 1]) / 2 * 1e6 + 0.5) / 1e6)"
    left, right = (branch.format(h=height, x=x) for x in "ab")

    def put(values: str, new: str) -> str:
        return f"list_transform({values}, lambda v, i: CASE WHEN i = m.a + 1 THEN {new} ELSE v END)"

    return f"""
        SELECT region_id, list(read_id ORDER BY read_id) AS owners,
               list(0::BIGINT ORDER BY read_id) AS places, list(1::BIGINT ORDER BY read_id) AS sizes,
               list(0::HUGEINT ORDER BY read_id) AS inners, list(0.0::DOUBLE ORDER BY read_id) AS tops,
               list(read_id::VARCHAR ORDER BY read_id) AS trees,
               NULL::INT AS a, NULL::INT AS b, NULL::DOUBLE AS h, 0 AS step
        FROM pairs GROUP BY region_id
        UNION ALL
        SELECT region_id, list_transform(owners, lambda o: CASE WHEN o = m.b THEN m.a ELSE o END),
               list_transform(places, lambda p, i: CASE WHEN owners[i] = m.b
                              THEN p + sizes[m.a + 1] ELSE p END),
               {put("sizes", "v + sizes[m.b + 1]")}, {put("inners", "v + inners[m.b + 1] + m.s")},
               {put("tops", height)},
               {put("trees", f"'(' || v || ':' || {left} || ',' || trees[m.b + 1] || ':' || {right} || ')'")},
               m.a, m.b, {height}, step + 1
        FROM (
            SELECT region_id, min({{'key': {order.format(value)}, 'tie': {_TIE}, 'a': a, 'b': b,
                                    'd': {value}, 's': s}}) AS m
            FROM (SELECT t.*, sizes[t.a + 1]::DOUBLE AS na, sizes[t.b + 1]::DOUBLE AS nb,
                         inners[t.a + 1] AS wa, inners[t.b + 1] AS wb
                  FROM (SELECT region_id, least(oi, oj) AS a, greatest(oi, oj) AS b, sum(unit) AS s
                        FROM (SELECT region_id, owners[read_i + 1] AS oi, owners[read_j + 1] AS oj,
                                     unit
                              FROM state_{method} JOIN units_{method} USING (region_id))
                        WHERE oi <> oj GROUP BY ALL) t
                  JOIN state_{method} USING (region_id))
            GROUP BY region_id)
        JOIN state_{method} USING (region_id)"""


for _method, _dist in (("upgma", "dist"), ("ward", "dist * dist")):
    CTES[f"units_{_method}"] = (("filled",), f"""
        SELECT region_id, read_i, read_j, CAST(floor({_dist} * 1e9 + 0.5) AS BIGINT) AS unit
        FROM filled""")
    CTES[f"state_{_method}"] = (("pairs", f"units_{_method}"), _merging(_method))
    CTES[f"leaves_{_method}"] = ((f"state_{_method}", "pairs"), f"""
        SELECT p.region_id, p.read_id, CAST(e.places[p.read_id + 1] AS INT) AS leaf_pos,
               m.a AS join_read, m.h AS height
        FROM pairs p
        JOIN (SELECT region_id, arg_max(places, step) AS places FROM state_{_method}
              GROUP BY region_id) e ON e.region_id = p.region_id
        LEFT JOIN state_{_method} m ON m.region_id = p.region_id AND m.b = p.read_id""")
#: The same tests as of the fixed labels, of the clusters that ``cut_k`` gives.
CTES["k_stats"] = (("cuts", "rr"), CTES["stats"][1].replace("FROM labelled", """FROM (
        SELECT c.region_id, c.cluster_id, hp, alt_support, is_tumor FROM cuts c
        JOIN rr r ON c.region_id = r.region_id AND c.read_id = r.read_id WHERE c.k = 3)"""))
CTES["k_tables"] = (("k_stats",), CTES["tables"][1].replace("stats", "k_stats"))
CTES["k_tests"] = (("k_tables",), CTES["tests"][1].replace("tables", "k_tables"))
CTES["k_bh"] = (("k_tests",), CTES["bh"][1].replace("FROM tests", "FROM k_tests"))
CTES["k_crossed"] = (("cuts", "rr"), """
    SELECT c.region_id, c.cluster_id, hp AS level, count(*) AS n FROM cuts c
    JOIN rr r ON c.region_id = r.region_id AND c.read_id = r.read_id
    WHERE c.k = 3 AND hp IN (1, 2) GROUP BY ALL""")
#: Leaves with, by lateness, the merges that a cut undoes first.
CTES["late"] = (("leaves_upgma",), """
    SELECT *, CASE WHEN height IS NOT NULL THEN row_number() OVER (
        PARTITION BY region_id, height IS NULL
        ORDER BY height DESC, join_read DESC, read_id DESC) END AS late FROM leaves_upgma""")
CTES["cuts"] = (("late",), """
    SELECT region_id, k, read_id, dense_rank() OVER (
               PARTITION BY region_id, k ORDER BY first) AS cluster_id
    FROM (SELECT *, min(read_id) OVER (PARTITION BY region_id, k, seg) AS first
          FROM (SELECT *, sum(CASE WHEN height IS NULL OR late <= k - 1 THEN 1 ELSE 0 END) OVER (
                       PARTITION BY region_id, k ORDER BY leaf_pos) AS seg
                FROM late CROSS JOIN (SELECT unnest([2, 3, 4, 5]) AS k)))""")
_SCORE = """CASE WHEN b IS NULL THEN NULL WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0
             ELSE (b - a) / greatest(a, b) END"""
CTES["cut_scores"] = (("cuts", "both_ways"), f"""
    SELECT cuts.region_id, cuts.k, sum(CAST(floor(({_SCORE}) * 1e9 + 0.5) AS BIGINT))::DOUBLE
           / nullif(count({_SCORE}), 0) AS mean
    FROM cuts LEFT JOIN (
        SELECT m.region_id, m.k, m.read_i, max(mean) FILTER (m.other = o.cluster_id) AS a,
               min(mean) FILTER (m.other <> o.cluster_id) AS b
        FROM (SELECT w.region_id, t.k, w.read_i, t.cluster_id AS other,
                     sum(CAST(floor(dist * 1e9 + 0.5) AS BIGINT))::DOUBLE / count(*) AS mean
              FROM both_ways w JOIN cuts t
                ON t.region_id = w.region_id AND t.read_id = w.read_j GROUP BY ALL) m
        JOIN cuts o ON o.region_id = m.region_id AND o.k = m.k AND o.read_id = m.read_i
        GROUP BY ALL) s
      ON s.region_id = cuts.region_id AND s.k = cuts.k AND s.read_i = cuts.read_id
    GROUP BY cuts.region_id, cuts.k""")


#: Tables behind the trees that several later ones read; worked out once.
SHARED = {"pairs", "gated", "filled", "leaves_upgma", "cuts"}


def sql(body: str, *names: str) -> str:
    """``WITH`` the named tables and all they read, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                visit(dep)
            order.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in SHARED)}({CTES[n][1].strip()})" for n in order)
    ctes = _LF.sub(_log_point, ctes)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}" if ctes else body.strip()
