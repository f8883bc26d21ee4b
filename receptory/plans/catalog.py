"""Named queries over the driver's tables: one for each operator of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from receptory.functions import scalars, stats
from receptory.operators import downstream, groups, merged
from receptory.operators.keep import kept
from receptory.plans import fixtures, pipelines
from receptory.plans.oracle import ORACLE_SQL
from receptory.plans.params import Association, ClusterParams, GroupParams
from receptory.sources import synth, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["ORACLE_SQL", "QUERIES"]

ALL_AA = GroupParams(all_aa_interchangeable=True, local=False)
BOTH = GroupParams(lcminove=(10.0,), all_aa_interchangeable=True)
LOCAL = GroupParams(global_=False, lcminove=(10.0,))
LABELS = Association("CMV+", "CMV-", min_donors=2)
#: Kept by some groups of the test tables and not by others.
Q_BOUND = 0.6
WHOLE = ClusterParams(min_fold=(), default_min_fold=10.0)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def score(p: str) -> Column:
    """-log10 of a probability, to three places; floats differ in their last digits between engines."""
    return F.round(F.lit(0) - F.log10(F.greatest(F.col(p), F.lit(1e-300))), 3) + 0.0


def convergence(spark: SparkSession, sf: str, params: GroupParams, hla: bool = False) -> pipelines.Convergence:
    data = fixtures.Receptors(spark, sf)
    return pipelines.convergence_groups(data.sample, data.reference, params, data.hla if hla else None)


def sequences(spark: SparkSession, sf: str, params: GroupParams = ALL_AA) -> DataFrame:
    data = fixtures.Receptors(spark, sf)
    return kept(groups.working_sequences(data.sample, data.reference, params))


def shown(found: pipelines.Convergence) -> DataFrame:
    rows = found.with_members()
    return rows.select("type", "tag", F.col("cluster_size").cast("long").alias("cluster_size"), F.col("unique_cdr3_sample").cast("long").alias("unique_cdr3_sample"), "unique_cdr3_ref", "ove", score("fisher_score").alias("fisher_score"), score("fdr_q").alias("fdr_q"), F.col("n_subjects").cast("long").alias("n_subjects"), F.array_join("members", " ").alias("members"))


# ---- sources and scalars


def raw_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The receptor rows as an untidy file might have them."""
    return fixtures.tcr(spark, sf).selectExpr(
        "row_idx",
        "case when row_idx % 7 = 0 then '  ' || lower(cdr3) when row_idx % 11 = 0 then cdr3 || '*' when row_idx % 13 = 0 then '' else cdr3 end as cdr3",
        "case when row_idx % 5 = 0 then 'NA' when row_idx % 9 = 0 then ' ' else v_gene end as v_gene",
        "case when row_idx % 6 = 0 then '0.25' when row_idx % 10 = 0 then 'many' when row_idx % 15 = 1 then cast(count as string) || '.9' else cast(count as string) end as count",
    )


@query
def normalize_cdr3(spark: SparkSession, sf: str) -> DataFrame:
    return raw_fields(spark, sf).select("row_idx", scalars.normalize_cdr3(F.col("cdr3")).alias("cdr3"))


@query
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    return raw_fields(spark, sf).select("row_idx", scalars.present(F.col("v_gene")).alias("v_gene"))


@query
def count_coercion(spark: SparkSession, sf: str) -> DataFrame:
    return raw_fields(spark, sf).select("row_idx", scalars.count_value(F.col("count")).alias("count"))


@query
def header_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a header in another order, parsed through the header's names."""
    lines = fixtures.sample(spark, sf).select((F.col("row_idx") + 1).alias("line_idx"), F.concat_ws("\t", F.col("count").cast("string"), "cdr3", "v_gene", "subject").alias("value"))
    head = spark.createDataFrame([(0, "Freq\tcdr3aa\tv_call\tdonor")], "line_idx long, value string")
    return tables.parsed_rows(head.unionByName(lines)).select((F.col("row_idx") - 1).alias("row_idx"), "cdr3", "v_gene", "j_gene", "subject", "count")


@query
def working_set(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf)


@query
def dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return tables.first_seen_ids(fixtures.sample(spark, sf))


@query
def hla_wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = fixtures.Receptors(spark, sf).hla.groupBy("subject").agg(F.min("allele").alias("allele_1"), F.max("allele").alias("allele_2")).withColumn("allele_3", F.lit("NA"))
    return tables.wide_to_long(wide, "subject")


@query
def pool_repertoires(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.sample(spark, sf).selectExpr("row_idx", "subject as sample", "if(row_idx % 17 = 0, cdr3 || '_', cdr3) as cdr3aa", "v_gene || ',TRBV99' as v", "j_gene as j", "count")
    metadata = fixtures.sample(spark, sf).where("subject like '%:CMV+' or subject like '%:CMV-'").selectExpr("subject as sample", "substring_index(subject, ':', 1) as subject", "right(subject, 1) as label").distinct()
    return tables.pooled(rows, metadata)


# ---- statistics


def margins(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("cast(l_orderkey % 9 as bigint) as a", "cast(l_partkey % 12 as bigint) as b", "cast(l_suppkey % 7 as bigint) as c", "cast(l_linenumber + l_orderkey % 5 as bigint) as d").distinct()


@query
def fisher_p(spark: SparkSession, sf: str) -> DataFrame:
    return margins(spark, sf).withColumn("p", stats.fisher_greater("a", "b", "c", "d")).select("a", "b", "c", "d", score("p").alias("p"))


@query
def hypergeom_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = margins(spark, sf).selectExpr("a as x", "a + b * 50 as m", "c * 1000 + d as n", "a + b + c as k").where("k <= m + n").distinct()
    return rows.withColumn("p", stats.hypergeom_upper("x", "m", "n", "k")).select("x", "m", "n", "k", score("p").alias("p"))


@query
def bh_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey * 8 + l_linenumber as id", "l_returnflag as kind", "(l_partkey * 7919 + l_suppkey * 31) % 10000 / 10000D * ((l_orderkey % 100 + 1) / 100D) as p")
    return stats.benjamini_hochberg(rows, "p", "q", ["kind"]).select("id", "kind", F.round("q", 9).alias("q"))


@query
def poisson_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = margins(spark, sf).selectExpr("a as k", "(b + 1) / 2D as rate").distinct()
    return rows.select("k", "rate", F.round(stats.poisson_upper("k", "rate"), 9).alias("p"))


@query
def odds_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return margins(spark, sf).select("a", "b", "c", "d", F.round(stats.odds_ratio("a", "b", "c", "d"), 6).alias("odds"))


# ---- motifs and local groups


@query
def motif_occurrence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return groups.motif_counts(sequences(spark, sf), LOCAL)


@query
def gapped_motif_counts(spark: SparkSession, sf: str) -> DataFrame:
    return groups.motif_counts(sequences(spark, sf), GroupParams(motif_lengths=(2, 3), discontinuous=True, lcminove=(10.0,)))


@query
def motif_sequence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return merged.sequence_motifs(fixtures.sample(spark, sf).select("cdr3").distinct(), WHOLE).groupBy("motif").agg(F.count("*").alias("n"))


@query
def motif_fold(spark: SparkSession, sf: str) -> DataFrame:
    return groups.motif_statistics(sequences(spark, sf), LOCAL).select("motif", "num_fold")


def shown_motifs(rows: DataFrame) -> DataFrame:
    return rows.select("motif", "num_in_sample", "num_in_ref", score("fisher_score").alias("fisher_score"), "num_fold")


@query
def motif_enrichment_p1(spark: SparkSession, sf: str) -> DataFrame:
    return shown_motifs(groups.selected_motifs(groups.motif_statistics(sequences(spark, sf), LOCAL), LOCAL))


def tested_motifs(spark: SparkSession, sf: str, params: ClusterParams = WHOLE) -> DataFrame:
    data = fixtures.Receptors(spark, sf)
    return merged.enriched_motifs(data.sample.select("cdr3").distinct(), data.reference.distinct(), params)


@query
def motif_enrichment_p1_default(spark: SparkSession, sf: str) -> DataFrame:
    """The published defaults: another least fold for each motif length."""
    return shown_motifs(groups.selected_motifs(groups.motif_statistics(sequences(spark, sf), GroupParams()), GroupParams()))


@query
def motif_enrichment_p2_default(spark: SparkSession, sf: str) -> DataFrame:
    rows = tested_motifs(spark, sf, ClusterParams()).where("passes")
    return rows.select("motif", F.col("k").cast("long").alias("k"), "input_count", "reference_count", score("p_value").alias("p"))


@query
def motif_members(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences that carry an enriched motif."""
    data = fixtures.Receptors(spark, sf)
    own = data.sample.select("cdr3", F.lit(0).alias("seq_id")).distinct()
    motifs = tested_motifs(spark, sf, ClusterParams()).where("passes")
    return merged.sequence_motifs(own, ClusterParams()).join(motifs.select("motif"), "motif", "left_semi").select("motif", "cdr3")


@query
def motif_order(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched motifs with their place in the order of the motif table."""
    rows = tested_motifs(spark, sf, ClusterParams()).where("passes").select("motif", scalars.order_key("motif").alias("o"))
    return rows.select("motif", F.row_number().over(Window.orderBy("o")).cast("long").alias("place"))


@query
def motif_enrichment_p2(spark: SparkSession, sf: str) -> DataFrame:
    return tested_motifs(spark, sf).where("passes").select("motif", F.col("k").cast("long").alias("k"), "input_count", "reference_count", F.round("fold", 6).alias("fold"), score("p_value").alias("p"))


@query
def motif_bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    return tested_motifs(spark, sf).select("motif", score("q_value").alias("q"))


@query
def motif_positions_nonoverlap(spark: SparkSession, sf: str) -> DataFrame:
    seqs = sequences(spark, sf)
    chosen = groups.selected_motifs(groups.motif_statistics(seqs, LOCAL), LOCAL)
    return groups.motif_hits(seqs, chosen, LOCAL).select("motif", "cdr3", F.col("start").cast("long").alias("start"))


@query
def local_groups(spark: SparkSession, sf: str) -> DataFrame:
    return shown(convergence(spark, sf, LOCAL)).drop("members")


@query
def local_group_members(spark: SparkSession, sf: str) -> DataFrame:
    return convergence(spark, sf, LOCAL).members


# ---- global groups


@query
def reference_mask_counts(spark: SparkSession, sf: str) -> DataFrame:
    return groups.mask_groups(groups.masks(sequences(spark, sf), 3)).select("mask", "n_s", "n_r")


@query
def global_groups_all_aa(spark: SparkSession, sf: str) -> DataFrame:
    return shown(convergence(spark, sf, ALL_AA))


@query
def global_groups_blosum(spark: SparkSession, sf: str) -> DataFrame:
    return shown(convergence(spark, sf, GroupParams(local=False)))


@query
def global_groups_vgene(spark: SparkSession, sf: str) -> DataFrame:
    return shown(convergence(spark, sf, GroupParams(local=False, global_vgene=True)))


@query
def convergence_groups(spark: SparkSession, sf: str) -> DataFrame:
    return shown(convergence(spark, sf, BOTH))


# ---- donors, association, HLA, filters


@query
def group_donor_counts(spark: SparkSession, sf: str) -> DataFrame:
    return convergence(spark, sf, ALL_AA).groups.select("tag", F.col("n_subjects").cast("long").alias("n_subjects"))


def associated(spark: SparkSession, sf: str, **changes) -> DataFrame:
    from dataclasses import replace

    found = convergence(spark, sf, replace(ALL_AA, association=replace(LABELS, **changes)))
    return found.groups.select("tag", F.col("case_donors").cast("long").alias("case_donors"), F.col("control_donors").cast("long").alias("control_donors"), score("assoc_p").alias("assoc_p"), score("assoc_q").alias("assoc_q"))


@query
def association(spark: SparkSession, sf: str) -> DataFrame:
    return associated(spark, sf)


@query
def association_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return associated(spark, sf, max_p=0.3)


@query
def association_permuted(spark: SparkSession, sf: str) -> DataFrame:
    return associated(spark, sf, permute_seed=20261006)


@query
def hla_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = convergence(spark, sf, ALL_AA, hla=True).groups.where("hla_p is not null")
    return found.select("tag", F.col("hla_donors").cast("long").alias("hla_donors"), score("hla_p").alias("hla_p"), score("hla_q").alias("hla_q"))


@query
def hla_best_allele(spark: SparkSession, sf: str) -> DataFrame:
    """The allele of least p, by name among equals."""
    found = convergence(spark, sf, ALL_AA, hla=True).groups.where("hla_p is not null")
    return found.select("tag", "hla_allele", F.col("hla_with_allele").cast("long").alias("hla_with_allele"))


@query
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The run summary of an association and HLA run whose filters leave few groups."""
    from dataclasses import replace

    found = convergence(spark, sf, replace(ALL_AA, association=replace(LABELS, max_p=0.01)), hla=True).summary()
    return spark.createDataFrame([(k, int(v)) for k, v in found.items()], "name string, value long")


@query
def hit_table(spark: SparkSession, sf: str) -> DataFrame:
    """Known members in groups of a low and of a higher p; sampled q are all high, so the bound is on q below 1."""
    from dataclasses import replace

    found = convergence(spark, sf, replace(ALL_AA, association=LABELS))
    out = downstream.hit_table(found.tested, downstream.antigen_hits(found.members, antigens(spark, sf)), 0.999)
    return out.withColumn("fisher_p", score("fisher_p"))


@query
def top_associated(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    found = convergence(spark, sf, replace(ALL_AA, association=LABELS))
    out = downstream.top_associated(found.tested, found.members, antigens(spark, sf), 1.0, "CMV")
    return out.select("type", "tag", F.col("case_donors").cast("long").alias("case_donors"), F.col("control_donors").cast("long").alias("control_donors"), score("assoc_p").alias("assoc_p"), score("assoc_q").alias("assoc_q"), "members", "epitopes")


@query
def min_subjects_filter(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    return convergence(spark, sf, replace(ALL_AA, min_subjects=4)).groups.select("tag", F.col("n_subjects").cast("long").alias("n_subjects"))


@query
def global_p_filter(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    return convergence(spark, sf, replace(ALL_AA, max_global_p=0.05)).groups.select("tag", score("fisher_score").alias("fisher_score"))


@query
def global_q_filter(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    return convergence(spark, sf, replace(ALL_AA, max_global_q=Q_BOUND)).groups.select("tag", score("fdr_q").alias("fdr_q"))


@query
def top_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the hundred largest groups, ties by tag."""
    return convergence(spark, sf, ALL_AA).groups.orderBy(F.desc("cluster_size"), "tag").limit(100).select("tag", F.col("cluster_size").cast("long").alias("cluster_size"))


# ---- merged clusters


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return tables.first_seen_ids(fixtures.sample(spark, sf))


@query
def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(spark, sf).groupBy(F.length("cdr3").cast("long").alias("length")).agg(F.count("*").alias("n"))


@query
def hamming_edges(spark: SparkSession, sf: str) -> DataFrame:
    return merged.hamming_edges(numbered(spark, sf)).select("a", "b", F.col("position").cast("long").alias("position"))


@query
def hamming_edges_trim(spark: SparkSession, sf: str) -> DataFrame:
    return merged.hamming_edges(numbered(spark, sf), 3).select("a", "b", F.col("position").cast("long").alias("position"))


def merged_found(spark: SparkSession, sf: str) -> tuple[pipelines.Clusters, DataFrame]:
    data = fixtures.Receptors(spark, sf)
    return pipelines.merged_clusters(kept(tables.first_seen_ids(data.sample)), None, ClusterParams(mismatch_trim=3, motifs=False)), data.sample


@query
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return merged_found(spark, sf)[0].clusters.select(F.col("root").alias("first_seq"), "size", "n_local_edges")


@query
def cluster_rows(spark: SparkSession, sf: str) -> DataFrame:
    found, rows = merged_found(spark, sf)
    return found.rows(rows).select(F.col("cluster_id").cast("long").alias("cluster_id"), "cluster_size", "n_local_edges", "motifs", F.col("CDR3b").alias("cdr3"), "TRBV", "TRBJ", "subject", "count")


@query
def clusters_with_motifs(spark: SparkSession, sf: str) -> DataFrame:
    data = fixtures.Receptors(spark, sf)
    found = pipelines.merged_clusters(kept(tables.first_seen_ids(data.sample)), data.reference.distinct(), ClusterParams(mismatch_trim=3, min_fold=()))
    return found.clusters.select(F.col("root").alias("first_seq"), "size", "n_local_edges", F.array_join("motifs", ",").alias("motifs"))


# ---- downstream


def large(spark: SparkSession, sf: str) -> pipelines.Convergence:
    """Groups of four or more."""
    return convergence(spark, sf, GroupParams(all_aa_interchangeable=True, local=False, cluster_min_size=4))


def antigens(spark: SparkSession, sf: str) -> DataFrame:
    own = fixtures.sample(spark, sf).where("row_idx % 50 = 0")
    return own.selectExpr("'HomoSapiens' as species", "'TRB' as gene", "cdr3", "if(row_idx % 3 = 0, 'CMV', 'EBV') as antigen", "v_gene as epitope").distinct()


@query
def antigen_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return downstream.antigen_hits(large(spark, sf).members, antigens(spark, sf)).select("tag", F.col("hit").cast("long").alias("hit"))


@query
def size_matched(spark: SparkSession, sf: str) -> DataFrame:
    found = convergence(spark, sf, ALL_AA)
    chosen = found.groups.where("n_subjects >= 4").select("tag")
    out = downstream.size_matched(found.groups, downstream.antigen_hits(found.members, antigens(spark, sf)), chosen)
    return out.select(F.col("observed").cast("long").alias("observed"), F.round("expected", 6).alias("expected"), "ratio", score("poisson_p").alias("poisson_p"))


@query
def families(spark: SparkSession, sf: str) -> DataFrame:
    return downstream.families(large(spark, sf).members)


@query
def family_report(spark: SparkSession, sf: str) -> DataFrame:
    found = large(spark, sf)
    out = downstream.family_report(found.groups, downstream.families(found.members), found.members, "fisher_score", antigens(spark, sf))
    return out.select("family", score("best_p").alias("best_p"), "groups", "cdr3s", "members", "epitopes")


@query
def family_hla(spark: SparkSession, sf: str) -> DataFrame:
    found = large(spark, sf)
    out = downstream.family_hla(downstream.families(found.members), found.members, found.rows, spark.sql(fixtures.HLA, tcr=found.rows))
    return out.select("family", "allele", "carriers_with", "carriers", "others_with", "others", score("p").alias("p"), score("q").alias("q"))


@query
def family_hla_best(spark: SparkSession, sf: str) -> DataFrame:
    found = large(spark, sf)
    tests = downstream.family_hla(downstream.families(found.members), found.members, found.rows, spark.sql(fixtures.HLA, tcr=found.rows))
    out = downstream.family_hla_best(tests)
    return out.select("family", "allele", "carriers", "carrier_share", "other_share", score("p").alias("p"))


@query
def hamming_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Mismatches of each sequence with the next of its donor; null where lengths differ."""
    own = fixtures.sample(spark, sf).selectExpr("row_idx", "cdr3", "lead(cdr3) over (partition by subject order by row_idx, cdr3) as other").where("other is not null")
    return own.select("row_idx", scalars.masked_distance("cdr3", "other").cast("long").alias("distance"))


@query
def group_diff(spark: SparkSession, sf: str) -> DataFrame:
    left, right = convergence(spark, sf, BOTH), convergence(spark, sf, GroupParams(lcminove=(10.0,), kmer_mindepth=200))
    out = downstream.group_diff(left.members, right.members)
    return out.select("type", "n_left", "n_right", "n_shared", "only_left", "only_right", "n_exact", "exact_share", F.round("mean_jaccard", 6).alias("mean_jaccard"))


@query
def interface_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that the in-memory entry point and the pipeline do not have alike: none."""
    from receptory import api

    data = fixtures.Receptors(spark, sf)
    one = pipelines.convergence_groups(data.sample, data.reference, BOTH)
    two = api.convergence_groups(spark, data.sample, data.reference, params=BOTH)
    return downstream.agreement(one.members, two.members).groupBy("side").agg(F.count("*").alias("n"))


@query
def benchmark_subset(spark: SparkSession, sf: str) -> DataFrame:
    return tables.subset(fixtures.sample(spark, sf), 40, 2000, 7)


# ---- generators


@query
def synth_repertoire(spark: SparkSession, sf: str) -> DataFrame:
    return tables.from_sequences(spark, synth.repertoire(4000, 11)).select("row_idx", "cdr3")


@query
def synth_reference(spark: SparkSession, sf: str) -> DataFrame:
    return tables.from_sequences(spark, synth.reference(4000, 3)).select("row_idx", "cdr3")


@query
def expand_repertoire(spark: SparkSession, sf: str) -> DataFrame:
    return tables.from_sequences(spark, synth.expand(synth.repertoire(500, 11), 3, 5)).select("row_idx", "cdr3")
