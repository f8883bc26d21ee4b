"""Merged clusters: one-mismatch edges, enriched motifs and their connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receptory.functions import stats
from receptory.operators.components import connected_components
from receptory.operators.groups import motif_windows
from receptory.operators.keep import kept
from receptory.plans.params import ClusterParams


def sequence_masks(sequences: DataFrame, trim: int = 0) -> DataFrame:
    """(seq_id, mask, position): every sequence with each position of [trim, length - trim) masked."""
    each = sequences.withColumn("position", F.explode(F.expr(f"if(length(cdr3) > {2 * trim}, sequence({trim}, length(cdr3) - {trim + 1}), array())")))
    return each.select("seq_id", F.expr("overlay(cdr3 placing '%' from position + 1 for 1)").alias("mask"), "position")


def hamming_edges(sequences: DataFrame, trim: int = 0) -> DataFrame:
    """(a, b, position) of all pairs a < b that differ at just that position."""
    m = sequence_masks(sequences, trim)
    x, y = m.alias("x"), m.alias("y")
    return x.join(y, (F.col("x.mask") == F.col("y.mask")) & (F.col("x.seq_id") < F.col("y.seq_id"))).select(F.col("x.seq_id").alias("a"), F.col("y.seq_id").alias("b"), "x.position")


def sequence_motifs(sequences: DataFrame, params: ClusterParams) -> DataFrame:
    """Distinct (cdr3, motif) within the trimmed region, of distinct sequences: each row's repeats are left out within the row."""
    region = f"if(length(cdr3) > {2 * params.trim}, substr(cdr3, {params.trim + 1}, length(cdr3) - {2 * params.trim}), '')"
    own = F.array_distinct(F.transform(motif_windows("region", params.motif_lengths, params.gapped), lambda x: x["motif"]))
    return sequences.withColumn("region", F.expr(region)).withColumn("motif", F.explode(own)).drop("region")


def enriched_motifs(sequences: DataFrame, reference: DataFrame, params: ClusterParams) -> DataFrame:
    """Motifs by the number of sequences that carry them: counts, fold, p, q, and whether they pass."""
    inputs = sequence_motifs(sequences.select("cdr3"), params).groupBy("motif").agg(F.count("*").alias("input_count")).where(F.col("input_count") >= params.min_count)
    refs = sequence_motifs(reference.select("cdr3"), params).groupBy("motif").agg(F.count("*").alias("reference_count"))
    sizes = sequences.agg(F.count("*").alias("n_in")).join(reference.agg(F.count("*").alias("n_ref")), F.lit(True)).withColumn("_j", F.lit(1))
    rows = inputs.join(refs, "motif", "left").fillna(0, ["reference_count"]).join(F.broadcast(sizes), F.lit(1) == F.col("_j"))
    rows = stats.with_upper_tail(rows, "p_value", "input_count", "input_count + reference_count", "n_in + n_ref - input_count - reference_count", "n_in")
    rows = stats.benjamini_hochberg(rows, "p_value", "q_value")
    rows = rows.withColumn("k", F.length(F.translate("motif", "%", ""))).withColumn("fold", F.expr("if(reference_count = 0, cast('Infinity' as double), (input_count / n_in) / (reference_count / n_ref))"))
    least = F.lit(params.default_min_fold)
    for k, value in params.min_fold:
        least = F.when(F.col("k") == k, value).otherwise(least)
    tested = F.col("q_value" if params.fdr else "p_value")
    return rows.withColumn("passes", (F.col("fold") >= least) & (tested <= params.max_p)).drop("_j", "n_in", "n_ref")


def motif_members(sequences: DataFrame, motifs: DataFrame, params: ClusterParams) -> DataFrame:
    """(motif, seq_id) of the sequences that carry a motif."""
    return sequence_motifs(sequences, params).join(motifs.select("motif"), "motif", "left_semi").select("motif", "seq_id")


def clusters(sequences: DataFrame, edges_of: DataFrame | None, motifs: DataFrame | None, params: ClusterParams) -> tuple[DataFrame, DataFrame]:
    """Components of mask groups and motif groups, by stars from each group's least member, so edges stay linear.

    Returns clusters (cluster_id, size, n_local_edges, motifs) and members (cluster_id, seq_id).
    """
    parts = edges_of if edges_of is not None else sequence_masks(sequences, params.mismatch_trim)
    # one exchange of the masks, sorted by a hash first; a mask's sequences are as many as there are residues at the most
    w = Window.partitionBy("_h", "mask")
    near = parts.select("mask", "seq_id").withColumn("_h", F.xxhash64("mask")).select("seq_id", F.min("seq_id").over(w).alias("b"), F.count("*").over(w).alias("n"))
    near = kept(near.where("n > 1"))
    stars, links = near.where("seq_id = b").select("b", "n"), near.select(F.col("seq_id").alias("a"), "b")
    carried = None
    if motifs is not None:
        carried = kept(motif_members(sequences, motifs, params))
        heads = carried.groupBy("motif").agg(F.min("seq_id").alias("b"))
        links = links.unionByName(carried.join(heads, "motif").select(F.col("seq_id").alias("a"), "b"))
    found = connected_components(links)
    members = sequences.select("seq_id").join(found, F.col("seq_id") == F.col("node"), "left").select("seq_id", F.coalesce("component", "seq_id").alias("root"))
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= max(params.min_size, 1))
    edges = stars.join(members.withColumnRenamed("seq_id", "b"), "b").groupBy("root").agg(F.sum(F.expr("n * (n - 1) div 2")).cast("long").alias("n_local_edges"))
    out = sizes.join(edges, "root", "left").fillna(0, ["n_local_edges"])
    if carried is not None:
        names = carried.join(members, "seq_id").select("root", "motif").distinct().groupBy("root").agg(F.array_sort(F.collect_list("motif")).alias("motifs"))
        out = out.join(names, "root", "left").withColumn("motifs", F.coalesce("motifs", F.array().cast("array<string>")))
    else:
        out = out.withColumn("motifs", F.array().cast("array<string>"))
    return out, members.join(sizes.select("root"), "root", "left_semi").select("root", "seq_id")
