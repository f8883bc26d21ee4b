"""The two composite pipelines as lazy plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receptory.functions import stats
from receptory.operators import annotate, groups, merged
from receptory.operators.keep import kept
from receptory.plans.params import ClusterParams, GroupParams


@dataclass
class Convergence:
    """groups: one row a group; members: (type, tag, cdr3); motifs: the selected ones; sequences: those that were used; tested: the groups before the final filters; rows: the input. Donors, tests and q-values are worked out by finish when a table that shows them is first asked for."""

    all_members: DataFrame
    motifs: DataFrame | None
    sequences: DataFrame
    rows: DataFrame
    finish: Callable[[], tuple[DataFrame, DataFrame, DataFrame | None]]
    filters: bool = False
    classes: DataFrame | None = None
    _summary: dict = field(default_factory=dict)

    @cached_property
    def _finished(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        return self.finish()

    @property
    def groups(self) -> DataFrame:
        return self._finished[0]

    @property
    def tested(self) -> DataFrame:
        return self._finished[1]

    @property
    def hla_tests(self) -> DataFrame | None:
        return self._finished[2]

    @cached_property
    def members(self) -> DataFrame:
        """Where no filter leaves groups out, donors and tests are not worked out for their members."""
        return self.all_members.join(self.groups.select("type", "tag"), ["type", "tag"], "left_semi") if self.filters else self.all_members

    def with_members(self) -> DataFrame:
        """groups with their members as a sorted array."""
        arrays = self.members.groupBy("type", "tag").agg(F.array_sort(F.collect_list("cdr3")).alias("members"))
        return self.groups.join(arrays, ["type", "tag"])

    def ordered(self) -> DataFrame:
        """with_members in the order of the group table: local by motif and range, then global by length, place, mask, V gene as first seen and residues."""
        mask = F.substring_index("tag", "_", 1)
        parts = F.split("tag", "_")
        # V genes are as many as there are names of genes
        seen = self.rows.where("v_gene is not null").groupBy(F.col("v_gene").alias("_v")).agg(F.min("row_idx").alias("_first"))
        rows = self.with_members().withColumn("_v", F.when((F.col("type") == "global") & (F.size(parts) > 2), F.get(parts, F.lit(1)))).join(seen, "_v", "left")
        local = F.col("type") == "local"
        keys = [~local, F.length(mask), F.when(local, F.translate(mask, ".", "~")), F.when(local, F.get(parts, F.lit(1)).cast("int")), F.when(local, F.get(parts, F.lit(2)).cast("int")), F.instr(mask, "%"), mask, F.col("_first").asc_nulls_last(), "_v", F.element_at(parts, -1)]
        return rows.orderBy(*keys).drop("_v", "_first")

    def cluster_list(self) -> DataFrame:
        return self.with_members().select("tag", "members")

    def summary(self) -> dict:
        """Counts of rows, sequences, motifs and groups by type, and of tests before the final filters."""
        if not self._summary:
            t = groups.totals(self.sequences).first()
            kinds = {x.type: x["count"] for x in self.groups.groupBy("type").count().collect()}
            n = self.rows.agg(F.count("*").alias("rows"), F.countDistinct("cdr3").alias("unique")).first()
            self._summary = {"rows": n.rows, "unique": n.unique, "n_sample": t.n_sample, "n_reference": t.n_reference, "motifs": self.motifs.count() if self.motifs is not None else 0, "local_groups": kinds.get("local", 0), "global_groups": kinds.get("global", 0)}
            if self.classes is not None:
                c = self.classes.agg(F.coalesce(F.sum("is_case"), F.lit(0)).alias("case"), F.count("*").alias("all")).first()
                x = self.tested.agg(F.count("assoc_p").alias("tested"), F.count_if(F.col("assoc_q") <= 0.05).alias("significant")).first()
                self._summary |= {"n_case": c.case, "n_control": c.all - c.case, "assoc_tested": x.tested, "assoc_q05": x.significant}
            if self.hla_tests is not None:
                x = self.tested.agg(F.count("hla_p").alias("scored"), F.count_if(F.col("hla_q") <= 0.05).alias("significant")).first()
                n = self.hla_tests.agg(F.count("*").alias("tests"), F.coalesce(F.max("n_typed"), F.lit(0)).alias("typed")).first()
                self._summary |= {"hla_typed_donors": n.typed, "hla_scored": x.scored, "hla_tests": n.tests, "hla_q05": x.significant}
        return self._summary


def convergence_groups(rows: DataFrame, reference: DataFrame, params: GroupParams | None = None, hla: DataFrame | None = None) -> Convergence:
    """rows: (cdr3, v_gene, subject, row_idx only for permuted labels); reference: (cdr3); hla: (subject, allele)."""
    params = params or GroupParams()
    sequences = kept(groups.working_sequences(rows, reference, params))
    parts, motifs = [], None
    if params.local:
        found, members, motifs = groups.local_groups(sequences, params)
        parts.append((found, members))
    if params.global_:
        parts.append(groups.global_groups(sequences, params, rows if params.global_vgene else None))
    if not parts:
        raise ValueError("neither local nor global groups are asked for")
    found, members = parts[0]
    for more, their in parts[1:]:
        found, members = found.unionByName(more), members.unionByName(their)
    found = found.where(F.col("cluster_size") >= params.cluster_min_size)
    found = kept(found)
    members = kept(members.join(found.select("type", "tag"), ["type", "tag"], "left_semi"))
    a = params.association
    classes = None
    if a:
        classes = annotate.subject_classes(rows, a.case, a.control) if a.permute_seed is None else annotate.permuted_classes(rows, a.case, a.control, a.permute_seed)

    def finish() -> tuple[DataFrame, DataFrame, DataFrame | None]:
        out = found.withColumn("_p", F.when(F.isnan("fisher_score"), 1.0).otherwise(F.col("fisher_score")))
        out = stats.benjamini_hochberg(out, "_p", "fdr_q", ["type"]).drop("_p")
        donors = kept(annotate.group_donors(members, rows))
        out = annotate.donor_counts(out, donors)
        if a:
            out = annotate.associate(out, donors, classes, a.min_donors)
        tests = kept(annotate.hla_tests(donors, hla, rows)) if hla is not None else None
        if tests is not None:
            out = annotate.score_hla(out, tests)
        tested = kept(out)  # the result's tables and totals all read it
        return annotate.filtered(tested, params, a), tested, tests

    return Convergence(members, motifs, sequences, rows, finish, annotate.has_filters(params, a), classes)


@dataclass
class Clusters:
    """clusters: (root, size, n_local_edges, motifs); members: (root, seq_id, cdr3); motifs: all tested ones."""

    clusters: DataFrame
    members: DataFrame
    motifs: DataFrame | None

    def numbered(self) -> DataFrame:
        """clusters with cluster_id from 0, by least sequence number.

        The ids are dense over all clusters, so they are taken by ranges of
        the root and the ranges' totals, not in one partition.
        """
        spread = self.clusters.withColumn("_range", F.expr("root div 100000"))
        from pyspark.sql import Window

        local = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("root")))
        before = local.groupBy("_range").agg(F.count("*").alias("_size")).withColumn("_before", F.sum("_size").over(Window.orderBy("_range")) - F.col("_size"))
        return local.join(before.select("_range", "_before"), "_range").withColumn("cluster_id", F.col("_before") + F.col("_n") - 1).drop("_range", "_n", "_before")

    def rows(self, rows: DataFrame, ordered: bool = False) -> DataFrame:
        """One line for each cluster, member and input row, in that order if asked."""
        line = self.numbered().join(self.members, "root").join(rows, "cdr3")
        motifs = F.when(F.size("motifs") > 0, F.array_join("motifs", ",")).otherwise("-")
        named = [F.coalesce(x, F.lit("NA")).alias(y) for x, y in (("v_gene", "TRBV"), ("j_gene", "TRBJ"), ("subject", "subject"))]
        line = line.orderBy("cluster_id", "seq_id", "row_idx") if ordered else line
        return line.select("cluster_id", F.col("size").alias("cluster_size"), "n_local_edges", motifs.alias("motifs"), F.col("cdr3").alias("CDR3b"), *named, "count")


def merged_clusters(sequences: DataFrame, reference: DataFrame | None = None, params: ClusterParams | None = None) -> Clusters:
    """sequences: distinct (seq_id, cdr3); reference: distinct (cdr3), or none to leave motifs out."""
    params = params or ClusterParams()
    tested = kept(merged.enriched_motifs(sequences, reference, params)) if reference is not None and params.motifs else None
    found, members = merged.clusters(sequences, None, tested.where("passes") if tested is not None else None, params)
    return Clusters(found, members.join(sequences, "seq_id"), tested)
