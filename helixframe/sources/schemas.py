"""Column layouts of the files that the readers know, as DDL."""

HITS_12 = "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, evalue double, bitscore double"
HITS_13 = f"{HITS_12}, qlen long"
HITS_14 = f"{HITS_13}, slen long"
HITS_15 = f"{HITS_14}, qcovs double"
HITS_PROTEIN = "qseqid string, sseqid string, stitle string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, evalue double, bitscore double, length2 long, qlen long, slen long, qcovs double, sscinames string, scomnames string, staxids string"
COORDS = "ref_start long, ref_end long, qry_start long, qry_end long, ref_len long, qry_len long, identity double, ref string, qry string"
GFF = "seqid string, source string, type string, start long, stop long, score string, strand string, phase string, attributes string"
BED = "id string, lo long, hi long"
DEPTH = "gene string, pos long, depth long"
READ_COUNTS = "gene string, length long, reads long"
IDENTICAL = "gene1 string, start1 long, end1 long, gene2 string, start2 long, end2 long"
ID_MAP = "old_id string, new_id string"
BIM = "chrom string, id string, distance double, pos long, major string, minor string"
