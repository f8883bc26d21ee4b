"""Local and global convergence groups.

Sequences come as (cdr3, in_sample, in_reference), one row a distinct
sequence; groups go as one row a group with a tag, members as (tag, cdr3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from receptory.functions import scalars, stats
from receptory.operators.keep import kept
from receptory.plans.params import GroupParams


def working_sequences(rows: DataFrame, reference: DataFrame, params: GroupParams) -> DataFrame:
    """Distinct sequences of both sides that pass the length and end-residue tests, with a flag for each side."""
    test = scalars.is_working(F.col("cdr3"), params.least_length, params.require_cf)
    both = rows.where(test).select("cdr3", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(reference.where(test).select("cdr3", F.lit(0).alias("s"), F.lit(1).alias("r")))
    return both.groupBy("cdr3").agg(F.max("s").alias("in_sample"), F.max("r").alias("in_reference"))


def totals(sequences: DataFrame) -> DataFrame:
    """One row: n_sample, n_reference, longest (interior length is taken off by the caller)."""
    return sequences.agg(F.coalesce(F.sum("in_sample"), F.lit(0)).alias("n_sample"), F.coalesce(F.sum("in_reference"), F.lit(0)).alias("n_reference"), F.max(F.when(F.col("in_sample") == 1, F.length("cdr3"))).alias("longest"))


def motif_windows(region: str, lengths: tuple[int, ...], discontinuous: bool = False) -> Column:
    """(motif, start from 1) of every window of the region as an array; with gaps windows of one more residue, one inside masked."""
    parts = []
    for k in lengths:
        windows = f"transform(sequence(1, length({region}) - {k - 1}), i -> named_struct('motif', substr({region}, i, {k}), 'start', i))"
        parts.append(f"if(length({region}) >= {k}, {windows}, array())")
        if discontinuous and 2 <= k < 6:
            gapped = f"flatten(transform(sequence(1, length({region}) - {k}), i -> transform(sequence(1, {k - 1}), g -> named_struct('motif', overlay(substr({region}, i, {k + 1}) placing '%' from g + 1 for 1), 'start', i))))"
            parts.append(f"if(length({region}) > {k}, {gapped}, array())")
    return F.expr(f"concat({', '.join(parts)})")


def motif_occurrences(sequences: DataFrame, region: str, lengths: tuple[int, ...], discontinuous: bool = False) -> DataFrame:
    """sequences with motif and start of every window of the region."""
    return sequences.withColumn("_o", F.explode(motif_windows(region, lengths, discontinuous))).select("*", "_o.motif", "_o.start").drop("_o")


def motif_counts(sequences: DataFrame, params: GroupParams) -> DataFrame:
    """Occurrences of every motif in interiors: num_in_sample, num_in_ref."""
    inner = sequences.withColumn("core", scalars.interior("cdr3", params.boundary))
    found = motif_occurrences(inner.select("core", "in_sample", "in_reference"), "core", params.motif_lengths, params.discontinuous)
    return found.groupBy("motif").agg(F.sum("in_sample").cast("long").alias("num_in_sample"), F.sum("in_reference").cast("long").alias("num_in_ref"))


def motif_statistics(sequences: DataFrame, params: GroupParams) -> DataFrame:
    """Fold change and rounded tail probability of every motif that is in the sample."""
    rows = motif_counts(sequences, params).where("num_in_sample > 0").join(F.broadcast(totals(sequences).select("n_sample", "n_reference").withColumn("_j", F.lit(1))), F.lit(1) == F.col("_j")).drop("_j")
    rows = stats.with_upper_tail(rows, "fisher_score", "num_in_sample", "num_in_ref + num_in_sample", "n_reference + n_sample - num_in_ref - num_in_sample", "n_sample", rounded=True)
    fold = F.col("num_in_sample") / (F.col("num_in_ref") + 0.01) / F.col("n_sample") * F.col("n_reference")
    return rows.withColumn("num_fold", scalars.round_1dp(fold)).withColumn("residues", F.length(F.translate("motif", "%", "")))


def selected_motifs(statistics: DataFrame, params: GroupParams) -> DataFrame:
    least = params.min_ove()
    bound = F.coalesce(F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, float(v))])[F.col("residues")], F.lit(0.0)) if len(params.lcminove) > 1 else F.lit(float(params.lcminove[0]))
    return statistics.where((F.col("num_fold") >= bound) & (F.col("fisher_score") <= params.lcminp) & (F.col("num_in_sample") >= params.kmer_mindepth))


def kept_starts(starts: str, span: str) -> Column:
    """Leftmost starts that do not overlap, of a sorted array."""
    return F.expr(f"aggregate({starts}, named_struct('keep', cast(array() as array<int>), 'free', 0), (_a, x) -> if(x >= _a.free, named_struct('keep', concat(_a.keep, array(x)), 'free', x + {span}), _a), _a -> _a.keep)")


def motif_hits(sequences: DataFrame, motifs: DataFrame, params: GroupParams) -> DataFrame:
    """(motif, cdr3, start) of non-overlapping occurrences of selected motifs; there are at most as many motifs as the alphabet allows."""
    inner = sequences.where("in_sample = 1").withColumn("core", scalars.interior("cdr3", params.boundary)).select("cdr3", "core")
    found = motif_occurrences(inner, "core", params.motif_lengths, params.discontinuous).join(motifs.select("motif"), "motif", "left_semi")
    each = found.groupBy("motif", "cdr3").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    return each.select("motif", "cdr3", F.explode(kept_starts("starts", "length(motif)")).alias("start"))


def position_chains(hits: DataFrame, distance: int) -> DataFrame:
    """(motif, low, high, chains): runs of distinct starts with no gap above distance - 1."""
    w = Window.partitionBy("motif").orderBy("start")
    starts = hits.select("motif", "start").distinct()
    marked = starts.withColumn("new", F.when(F.col("start") - F.lag("start").over(w) > distance - 1, 1).otherwise(0)).withColumn("chain", F.sum("new").over(w))
    ranges = marked.groupBy("motif", "chain").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    return ranges.join(ranges.groupBy("motif").agg(F.count("*").alias("chains")), "motif")


def local_groups(sequences: DataFrame, params: GroupParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, their members and the selected motifs."""
    motifs = kept(selected_motifs(motif_statistics(sequences, params), params))
    hits = kept(motif_hits(sequences, motifs, params))
    longest = totals(sequences).select((F.col("longest") - 2 * params.boundary).alias("most"), F.lit(1).alias("_j"))
    chains = position_chains(hits, params.motif_distance).join(F.broadcast(longest), F.lit(1) == F.col("_j"))
    alone = (F.col("chains") == 1) | F.lit(params.motif_distance < 1)
    if params.motif_distance < 1:
        chains = chains.groupBy("motif").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most")).withColumn("chains", F.lit(1))
    tag = F.concat_ws("_", F.translate("motif", "%", "."), (F.when(alone, 1).otherwise(F.col("low")) + params.boundary).cast("string"), (F.when(alone, F.col("most")).otherwise(F.col("high")) + params.boundary).cast("string"))
    chains = chains.select("motif", "low", "high", tag.alias("tag"))
    members = kept(hits.join(chains, "motif").where("start between low and high").select("tag", "motif", "cdr3").distinct())
    counted = members.groupBy("tag", "motif").agg(F.count("*").alias("cluster_size"))
    groups = counted.join(motifs.select("motif", "num_in_ref", "num_fold", "n_sample", "n_reference"), "motif")
    groups = stats.with_upper_tail(groups, "fisher_score", "cluster_size", "num_in_ref + cluster_size", "n_reference + n_sample - num_in_ref - cluster_size", "n_sample", rounded=True)
    groups = groups.select(F.lit("local").alias("type"), "tag", "cluster_size", F.col("cluster_size").alias("unique_cdr3_sample"), F.col("num_in_ref").alias("unique_cdr3_ref"), F.col("num_fold").alias("ove"), "fisher_score")
    return groups, members.select(F.lit("local").alias("type"), "tag", "cdr3"), motifs


def masks(sequences: DataFrame, boundary: int) -> DataFrame:
    """(cdr3, in_sample, in_reference, mask, residue): one row for each interior position, which is masked."""
    inner = sequences.withColumn("core", scalars.interior("cdr3", boundary)).withColumn("pos", F.explode(F.expr("sequence(1, length(core))")))
    return inner.select("cdr3", "in_sample", "in_reference", F.expr("overlay(core placing '%' from pos for 1)").alias("mask"), F.expr("substr(core, pos, 1)").alias("residue"))


def mask_counts() -> dict[str, Column]:
    bits = f"bit_or(if(in_sample = 1, shiftleft(1, instr('{scalars.AMINO_ACIDS}', residue) - 1), 0))"
    return {"n_s": F.sum("in_sample"), "n_r": F.sum("in_reference"), "bits": F.expr(bits)}


def mask_groups(masked: DataFrame) -> DataFrame:
    """Masks that two or more sample sequences share: counts of each side and the residues as bits."""
    return masked.groupBy("mask").agg(*[x.alias(name) for name, x in mask_counts().items()]).where("n_s >= 2")


def global_groups(sequences: DataFrame, params: GroupParams, v_genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups and members: interiors equal but for one position, split by residue compatibility and, if asked, V gene.

    v_genes: (cdr3, v_gene) of the input rows, for global_vgene.
    """
    # reference sequences of lengths that no sample sequence has share no mask; there are few lengths
    lengths = sequences.where("in_sample = 1").select(F.length("cdr3").alias("_length")).distinct()
    near = sequences.join(F.broadcast(lengths), F.length("cdr3") == F.col("_length"), "left_semi")
    # one exchange of the masks, sorted by a hash first; a mask's rows are few, as they differ in one residue and the ends
    w = Window.partitionBy("_h", "mask")
    masked = masks(near, params.boundary).withColumn("_h", F.xxhash64("mask"))
    counts = [x.over(w).alias(name) for name, x in mask_counts().items()]
    nodes = masked.select("mask", "cdr3", "residue", "in_sample", *counts).where("in_sample = 1 and n_s >= 2").drop("in_sample").withColumn("bit", scalars.residue_bit("residue"))
    if params.all_aa_interchangeable:
        nodes = nodes.withColumn("part", F.lit(0))
    else:
        parts = nodes.select("bit", "bits").distinct().withColumn("part", scalars.residue_component("bit", "bits"))
        nodes = nodes.join(parts, ["bit", "bits"])
    if params.global_vgene:
        nodes = nodes.join(v_genes.select("cdr3", F.coalesce("v_gene", F.lit("NA")).alias("v")).distinct(), "cdr3")
    else:
        nodes = nodes.withColumn("v", F.lit(""))
    nodes = kept(nodes)  # a sequence is once in a mask and V gene
    groups = nodes.groupBy("mask", "v", "part").agg(F.count("*").alias("cluster_size"), F.max("n_r").alias("unique_cdr3_ref"), F.expr("bit_or(bit)").alias("found")).where("cluster_size >= 2").withColumn("unique_cdr3_sample", F.col("cluster_size"))
    tag = F.concat_ws("_", "mask", F.when(F.col("v") != "", F.col("v")), scalars.residues_of("found"))
    groups = groups.withColumn("tag", tag)
    members = nodes.join(groups.select("mask", "v", "part", "tag"), ["mask", "v", "part"]).select(F.lit("global").alias("type"), "tag", "cdr3")
    groups = groups.join(F.broadcast(totals(sequences).select("n_sample", "n_reference", F.lit(1).alias("_j"))), F.lit(1) == F.col("_j"))
    groups = stats.with_upper_tail(groups, "fisher_score", "unique_cdr3_sample", "unique_cdr3_ref + unique_cdr3_sample", "n_reference + n_sample - unique_cdr3_ref - unique_cdr3_sample", "n_sample")
    return groups.select(F.lit("global").alias("type"), "tag", "cluster_size", "unique_cdr3_sample", "unique_cdr3_ref", F.lit(0.0).alias("ove"), "fisher_score"), members
