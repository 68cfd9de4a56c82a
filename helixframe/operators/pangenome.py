"""Gene pangenome operators: orthology groups, presence, copy number, expression, origin, annotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..storage import written as cut_lineage

# Clades from the weakest to the strongest evidence (later ones win), and gene types.
CLADES = ("Virus", "Bacteria", "Archaea", "Eukaryote", "Fungi", "genus", "sister species", "species")
ABSENT = "*"


def split_ortho(genes: DataFrame) -> DataFrame:
    """orthologous: whether the transferred name differs from the gene's own id."""
    return genes.withColumn("orthologous", F.split_part(F.col("name"), F.lit("_truncated"), F.lit(1)) != F.col("gene"))


def add_reference(groups: DataFrame, names: DataFrame) -> DataFrame:
    """Members added to the groups of the reference names (/-joined, maybe _truncated) they were given."""
    rows = names.select("gene", F.explode(F.split("name", "/")).alias("grp")).withColumn("grp", F.replace("grp", F.lit("_truncated"), F.lit("")))
    known = rows.join(groups.select("grp").distinct(), "grp", "left_semi")
    return groups.select("grp", "gene").unionByName(known.select("grp", "gene")).distinct()


def singletons(catalogue: DataFrame, edges: DataFrame) -> DataFrame:
    linked = edges.select(F.col("src").alias("gene")).unionByName(edges.select(F.col("dst").alias("gene")))
    return catalogue.join(linked, "gene", "left_anti").select(F.col("gene").alias("grp"), "gene")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(grp, gene) of groups given as arrays."""
    return groups.select("grp", F.explode("genes").alias("gene"))


def presence(members: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """grp, haplotype, cell for every group and haplotype: members joined by commas, * if none."""
    cells = members.groupBy("grp", "haplotype").agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("cell"))
    grid = members.select("grp").distinct().crossJoin(haplotypes.select("haplotype").distinct())
    return grid.join(cells, ["grp", "haplotype"], "left").withColumn("cell", F.coalesce("cell", F.lit(ABSENT)))


def presence_matrix(members: DataFrame, haplotypes: Sequence[str]) -> DataFrame:
    """The wide form, with the columns named up front, so no extra job looks for them."""
    cells = members.groupBy("grp").pivot("haplotype", list(haplotypes)).agg(F.array_join(F.array_sort(F.collect_set("gene")), ","))
    return cells.select("grp", *(F.when(F.coalesce(F.col(f"`{h}`"), F.lit("")) == "", ABSENT).otherwise(F.col(f"`{h}`")).alias(h) for h in haplotypes))


def merge_haplotypes(members: DataFrame) -> DataFrame:
    return members.withColumn("haplotype", F.regexp_replace("haplotype", r"\.HP[12]$", ""))


def reference_column(members: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    """The reference strain's genes (grp, gene) as one more haplotype."""
    return members.select("grp", "haplotype", "gene").unionByName(reference.select("grp", F.lit(name).alias("haplotype"), "gene"))


def reference_families(cells: DataFrame, name: str) -> DataFrame:
    return cells.filter((F.col("haplotype") == name) & (F.col("cell") != ABSENT)).select("grp")


def localisation(gff: DataFrame, keep: Sequence[str] = ("gene",)) -> DataFrame:
    """strain, chrom, gene, strand, start, end with the genes before and after it in file order."""
    order = Window.partitionBy("strain", "chrom").orderBy("ord")
    genes = gff.filter(F.col("type").isin(*keep))
    return genes.withColumns({"previous": F.lag("gene").over(order), "next": F.lead("gene").over(order)})


def chromosome_number(name: Column, other: int = 17) -> Column:
    """The number after `chromosome`, or `other`; a name with two chromosomes has none."""
    found = F.regexp_extract_all(name, F.lit(r"chromosome(\d+)"), F.lit(1))
    return F.when(F.size(found) == 1, found[0].cast("int")).otherwise(other)


def assign_gene_ids(genes: DataFrame) -> DataFrame:
    rows = numbered(genes, ["number", "start", "gene"], "_n")
    return rows.select(*genes.columns, F.format_string("YX%05d", "_n").alias("gene_id"))


def relabel(genes: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """A gene column replaced by the id (gene, gene_id) of its group; null stays null."""
    names = ids.select(F.col("gene").alias("_g"), F.col("gene_id").alias("_i"))
    return genes.join(names, F.col(column) == F.col("_g"), "left").withColumn(column, F.col("_i")).drop("_g", "_i")


def representative_sequences(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    return seqs.join(ids.select(F.col("gene").alias("id"), "gene_id"), "id").select(F.col("gene_id").alias("id"), "seq").orderBy("id")


def mask_identical(depth: DataFrame, regions: DataFrame) -> DataFrame:
    """Depth rows outside the identical regions (gene, lo, hi), whose positions lo + 1 .. hi are masked."""
    hit = (depth["gene"] == regions["gene"]) & (depth["pos"] > regions["lo"]) & (depth["pos"] <= regions["hi"])
    return depth.join(regions, hit, "left_anti")


def normalise_depth(depth: DataFrame) -> DataFrame:
    """strain, gene, depth (median), norm: over the strain's median of positive depths."""
    base = depth.filter("depth > 0").groupBy("strain").agg(F.median("depth").alias("base"))
    genes = depth.groupBy("strain", "gene").agg(F.median("depth").alias("depth"))
    return genes.join(base, "strain").select("strain", "gene", "depth", (F.col("depth") / F.col("base")).alias("norm"))


def call_copies(norm: DataFrame, ploidy: Column, exponent: float = 0.15, threshold: float = 0.3) -> DataFrame:
    """cn: half-even rounded copies per genome of genes deep enough, at least one copy; else 0."""
    present = F.col("norm") * F.pow(ploidy.cast("double"), F.lit(exponent)) >= threshold
    rounded = F.rint(F.col("norm") * ploidy) / ploidy
    return norm.withColumn("cn", F.when(~present, 0.0).when(rounded == 0, F.lit(1).cast("double") / ploidy).otherwise(rounded))


def tpm(counts: DataFrame) -> DataFrame:
    """strain, gene, tpm from reads and lengths; the row * is left out."""
    rpk = counts.filter("gene <> '*'").withColumn("rpk", F.col("reads") / F.col("length"))
    total = F.sum("rpk").over(Window.partitionBy("strain"))
    return rpk.select("strain", "gene", (F.col("rpk") / (total / 1e6)).alias("tpm"))


def genes_present(copies: DataFrame) -> DataFrame:
    return copies.filter("cn > 0").select("gene").distinct()


def clade_flags(hits: DataFrame, taxa: DataFrame) -> DataFrame:
    """One row per hit (id, pident) with the clades of its ;-joined taxids."""
    ids = hits.select("id", "pident", F.explode(F.split("taxids", ";")).alias("t")).withColumn("taxid", F.col("t").cast("int"))
    return ids.join(taxa, "taxid", "left").groupBy("id", "pident").agg(F.collect_set("clade").alias("clades"))


def origin_call(flags: DataFrame, sister_identity: float = 93) -> DataFrame:
    """origin: the strongest clade; sister species only from an identity; Error without any."""
    out = F.lit("Error")
    for clade in CLADES:
        here = F.array_contains("clades", clade)
        out = F.when(here & (F.col("pident") >= sister_identity) if clade == "sister species" else here, clade).otherwise(out)
    return flags.withColumn("origin", out)


def mechanism_call(flags: DataFrame, identity: float = 80) -> DataFrame:
    has = lambda c: F.array_contains("clades", c)
    near = F.col("pident") >= identity
    out = (
        F.when(has("species"), "Fast evolving gene")
        .when(has("genus") & near, "Introgression")
        .when(has("genus"), "Candidate introgression")
        .when(has("Eukaryote") & near, "HGT")
        .when(F.size("clades") > 0, "Candidate HGT")
        .otherwise("Error")
    )
    return flags.withColumn("mechanism", out)


def no_hit_fill(called: DataFrame, catalogue: DataFrame) -> DataFrame:
    missing = catalogue.select("id").join(called, "id", "left_anti").select("id", F.lit("NoHit").alias("origin"), F.lit("Unknown").alias("mechanism"))
    return called.select("id", "origin", "mechanism").unionByName(missing)


def taxonomy_closure(parents: DataFrame, roots: DataFrame, max_rounds: int = 64) -> DataFrame:
    """clade, taxid: a clade's root and all taxa below it, from (taxid, parent) and (clade, taxid) of the roots.

    Pointer doubling: after k rounds every taxon knows its ancestors up to 2 ** k above it, so rounds grow with the
    logarithm of the depth. A taxon that is its own parent, or whose parent is unknown, is a top. Roots without
    a row of their own still stand for themselves; a taxon listed under two parents is below both.
    """
    up = cut_lineage(parents.filter(F.col("taxid") != F.col("parent")).select("taxid", F.col("parent").alias("ancestor")).distinct(), "up")
    size = up.count()
    for _ in range(max_rounds):
        further = up.join(up.select(F.col("taxid").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor").select("taxid", F.col("above").alias("ancestor"))
        up = cut_lineage(up.unionByName(further).filter("taxid <> ancestor").distinct(), "up")
        now = up.count()
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"the taxonomy is deeper than 2 ** {max_rounds}")
    below = roots.select("clade", F.col("taxid").alias("ancestor")).join(up, "ancestor").select("clade", "taxid")
    return below.unionByName(roots.select("clade", "taxid")).distinct()


def taxid_sets(taxa: DataFrame) -> DataFrame:
    return taxa.groupBy("clade").agg(F.array_sort(F.collect_set("taxid")).alias("taxids"))


def informative(hits: DataFrame, strain: str) -> DataFrame:
    """Hits with an informative title, or of the reference strain."""
    vague = F.lower("title").rlike("hypothetical|uncharacterized")
    return hits.filter(~vague | (F.col("species") == strain))


def function_label(hits: DataFrame, enriched: DataFrame) -> DataFrame:
    """id, function: how similar, to what, from which database (enrichment: accession, description)."""
    joined = hits.join(enriched, "accession", "left")
    how = F.when(F.col("pident") >= 80, "Highly similar to").otherwise("Similar to")
    base = F.when(F.col("description").isNotNull(), "Uniprot").otherwise("RefSeq")
    return joined.select("id", F.concat_ws(" ", how, F.coalesce("description", "title"), F.concat(F.lit("("), base, F.lit(":"), "accession", F.lit(")"))).alias("function"))


def function_fallback(catalogue: DataFrame, hits: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labels; Uncharacterized for genes with vague hits only; Dubious for those without hits."""
    some = hits.select("id").distinct().withColumn("some", F.lit(True))
    joined = catalogue.select("id").distinct().join(labelled.select("id", "function"), "id", "left").join(some, "id", "left")
    return joined.select("id", F.coalesce("function", F.when(F.col("some"), "Uncharacterized").otherwise("Dubious")).alias("function"))


def collect_go(rows: DataFrame, key: str = "gene", column: str = "go") -> DataFrame:
    """Sorted distinct terms of |-joined lists, the (source) taken off; - means none."""
    terms = F.transform(F.split(F.col(column), r"\|"), lambda t: F.regexp_replace(t, r"\(.*\)$", ""))
    kept = F.filter(terms, lambda t: (t != "-") & (t != ""))
    return rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(kept)))).alias("terms"))


def merge_annotations(*tables: DataFrame, key: str = "gene") -> DataFrame:
    """Full outer join by gene; nulls of strings become empty."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full")
    return out.select(key, *(F.coalesce(c, F.lit("")).alias(c) if dict(out.dtypes)[c] == "string" else F.col(c) for c in out.columns if c != key))


def redundant_flag(genes: DataFrame, catalogue: DataFrame) -> DataFrame:
    known = catalogue.select("gene").distinct().withColumn("_k", F.lit(True))
    return genes.join(known, "gene", "left").withColumn("redundant", F.col("_k").isNull()).drop("_k")


def round_robin(df: DataFrame, order: str, parts: int = 16) -> DataFrame:
    return numbered(df, [order], "_n").select(*df.columns, ((F.col("_n") - 1) % parts + 1).cast("long").alias("part"))


def taxid_map(files: DataFrame, replaced: DataFrame, taxa: DataFrame) -> DataFrame:
    """sequence, taxid from (file, sequences): file name to species, replaced names, species to taxid."""
    species = files.withColumn("species", F.regexp_replace(F.regexp_replace("file", r"\.[a-z]+$", ""), "_", " "))
    named = species.join(replaced.select(F.col("old").alias("species"), "new"), "species", "left").withColumn("name", F.coalesce("new", "species"))
    return named.join(taxa, "name").select(F.explode("sequences").alias("sequence"), "taxid")
