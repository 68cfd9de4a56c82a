"""Logical views of the driver's tables in the shape of genomic tables."""

from .registry import VIEWS

VIEWS |= {
    "ivl": "SELECT concat('chr', l_suppkey % 16 + 1) AS id, l_partkey * 100 AS lo, l_partkey * 100 + CAST(l_quantity AS BIGINT) AS hi FROM {lineitem}",
    "gene": "SELECT concat('chr', p_partkey % 16 + 1) AS id, p_partkey AS gene, p_partkey * 100 + 3 AS lo, p_partkey * 100 + 23 + CAST(p_size AS BIGINT) AS hi FROM {part}",
    "chrom": "SELECT id, CAST(0 AS BIGINT) AS lo, max(hi) + 100 AS hi FROM {ivl} GROUP BY id",
    "dna": (
        "SELECT doc_id AS id, doc_id AS ord, concat(CAST(doc_id AS STRING), ' from ', source) AS description, regexp_replace(lower(text), '[^acgtn]', '') AS seq FROM {documents}",
        "SELECT doc_id AS id, doc_id AS ord, concat(CAST(doc_id AS STRING), ' from ', source) AS description, regexp_replace(lower(text), '[^acgtn]', '', 'g') AS seq FROM {documents}",
    ),
    "named_dna": "SELECT concat(CASE WHEN id % 2 = 0 THEN 'ctg' ELSE 'scf' END, id) AS id, ord, description, seq FROM {dna}",
    "coords": """SELECT concat('asm', l_linenumber) AS asm, concat('ref', l_suppkey % 16) AS ref, concat('ctg', l_orderkey % 40) AS qry,
        l_partkey * 100 + 1 AS ref_start, l_partkey * 100 + CAST(l_quantity AS BIGINT) * 2 AS ref_end,
        CASE WHEN l_returnflag = 'R' THEN l_orderkey * 7 % 50000 + CAST(l_quantity AS BIGINT) * 2 ELSE l_orderkey * 7 % 50000 + 1 END AS qry_start,
        CASE WHEN l_returnflag = 'R' THEN l_orderkey * 7 % 50000 + 1 ELSE l_orderkey * 7 % 50000 + CAST(l_quantity AS BIGINT) * 2 END AS qry_end FROM {lineitem}""",
    "chromosome": "SELECT DISTINCT ref, CAST(substring(ref, 4) AS BIGINT) AS ord, 100000 + 10000 * CAST(substring(ref, 4) AS BIGINT) AS len FROM {coords}",
    "contig": "SELECT DISTINCT asm, qry, CAST(substring(qry, 4) AS BIGINT) AS ord, 52000 + CAST(substring(qry, 4) AS BIGINT) * 100 AS len FROM {coords}",
    "hit_raw": """SELECT concat('q', l_partkey % 400) AS qseqid, concat(CASE WHEN l_suppkey % 7 = 0 THEN 'q' ELSE 's' END, l_suppkey % 100) AS sseqid,
        100 - 500 * l_discount AS pident, l_partkey % 13 * 30 + 1 AS qstart, l_partkey % 13 * 30 + CAST(l_quantity AS BIGINT) * 4 AS qend,
        CASE WHEN l_returnflag = 'R' THEN l_orderkey % 11 * 25 + CAST(l_quantity AS BIGINT) * 4 ELSE l_orderkey % 11 * 25 + 1 END AS sstart,
        CASE WHEN l_returnflag = 'R' THEN l_orderkey % 11 * 25 + 1 ELSE l_orderkey % 11 * 25 + CAST(l_quantity AS BIGINT) * 4 END AS send,
        l_tax AS evalue, l_extendedprice AS bitscore, 560 + l_partkey % 400 % 7 * 40 AS qlen, 460 + l_suppkey % 100 % 5 * 40 AS slen,
        CAST(l_quantity AS BIGINT) * 2 AS qcovs, l_orderkey * 8 + l_linenumber AS o1 FROM {lineitem}""",
    "hit": "SELECT *, CAST(row_number() OVER (ORDER BY o1, qseqid, sseqid, pident, qstart, qend, sstart, send, evalue, bitscore, qcovs) AS BIGINT) AS ord FROM {hit_raw}",
    "node": "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS len, p_brand = 'Brand#2' AS is_ref FROM {part}",
    "edge": "SELECT p_partkey AS src, p_partkey * 7 % 2000 AS dst FROM {part} WHERE p_size > 40 AND p_partkey <> p_partkey * 7 % 2000 AND p_partkey * 7 % 2000 IN (SELECT p_partkey FROM {part})",
    "sv": """SELECT event_id, CASE event_type WHEN 'click' THEN 'INS' WHEN 'view' THEN 'DEL' WHEN 'signup' THEN 'DUP' WHEN 'purchase' THEN 'INV' ELSE 'TRA' END AS type,
        concat('chromosome', user_id % 16 + 1) AS chrom, event_id * 37 % 100000 + 1 AS pos, CAST(floor(value * 20) AS BIGINT) + 1 AS len,
        concat('chromosome', user_id * 3 % 16 + 1) AS mate_chrom, event_id * 91 % 100000 + 1 AS mate_pos FROM {events}""",
    "packed_sv": "SELECT event_id, concat_ws('_', CAST(event_id AS STRING), type, chrom, CAST(pos AS STRING), CAST(len AS STRING), 'L') AS id, concat('SVTYPE=', type, ';SVLEN=', len, ';BREAKPOINT2=', mate_chrom, ':', mate_pos) AS info FROM {sv}",
    "gt": """SELECT event_id AS variant, chrom, pos, type, r_regionkey AS sample, hap, CASE WHEN (event_id * 31 + r_regionkey * 17 + hap * 7) % 5 = 0 THEN '1' ELSE '0' END AS allele
        FROM {sv} CROSS JOIN {region} CROSS JOIN (SELECT 1 AS hap UNION ALL SELECT 2 AS hap) AS h""",
    "depth": "SELECT concat('st', l_suppkey % 8) AS strain, concat('g', l_partkey % 200) AS gene, l_orderkey * 13 % 1000 AS pos, CAST(l_quantity AS BIGINT) - 1 AS depth FROM {lineitem}",
    "pheno": "SELECT c_custkey AS strain, c_mktsegment AS cond, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS value FROM {customer}",
    "assoc": """SELECT concat(CASE WHEN p_size % 3 = 0 THEN 'SNP' WHEN p_size % 3 = 1 THEN 'INDEL' ELSE 'SV' END, '_', p_partkey) AS snp, p_partkey AS ord, p_partkey % 16 + 1 AS chrom, p_partkey * 100 AS bp,
        (p_partkey * 7919 % 9973 + 1) / CAST(10000 AS DOUBLE) AS p, p_size % 5 AS perm FROM {part}""",
    "taxon": "SELECT n_nationkey AS taxid, CASE r_name WHEN 'AFRICA' THEN 'Bacteria' WHEN 'AMERICA' THEN 'Eukaryote' WHEN 'ASIA' THEN 'genus' WHEN 'EUROPE' THEN 'sister species' ELSE 'species' END AS clade FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "membership": "SELECT concat('grp', p_partkey % 300) AS grp, concat('st', p_partkey % 12, CASE WHEN p_size % 2 = 0 THEN '.HP1' ELSE '.HP2' END) AS haplotype, concat('gene', p_partkey) AS gene FROM {part}",
    "gff": "SELECT concat('chr', p_partkey % 16 + 1) AS seqid, p_type AS type, p_partkey * 100 + 4 AS start, p_partkey * 100 + 23 + CAST(p_size AS BIGINT) AS stop, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, concat('ID=id', p_partkey, ';Name=', replace(p_name, ' ', '_'), ';gene=g', p_partkey % 100) AS attributes, p_partkey AS ord FROM {part}",
}
