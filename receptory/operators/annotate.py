"""Donors, case/control association, HLA restriction and filters of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receptory.functions import scalars, stats
from receptory.plans.params import Association, GroupParams


def group_donors(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(type, tag, subject): distinct donors of the groups' members over all input rows."""
    return members.join(rows.where("subject is not null").select("cdr3", "subject").distinct(), "cdr3").select("type", "tag", "subject").distinct()


def donor_counts(groups: DataFrame, donors: DataFrame) -> DataFrame:
    counted = donors.groupBy("type", "tag").agg(F.count("*").alias("n_subjects"))
    return groups.join(counted, ["type", "tag"], "left").fillna(0, ["n_subjects"])


def subject_classes(rows: DataFrame, case: str, control: str) -> DataFrame:
    """(subject, is_case): the labelled donors of the whole input."""
    named = rows.where("subject is not null").select("subject").distinct().withColumn("label", scalars.condition(F.col("subject")))
    return named.where(F.col("label").isin(case, control)).select("subject", (F.col("label") == case).cast("int").alias("is_case"))


def permuted_classes(rows: DataFrame, case: str, control: str, seed: int) -> DataFrame:
    """The labelled donors with their labels shuffled; donors are few, so the order is drawn on the driver."""
    from receptory.sources.synth import Rng

    first = rows.where("subject is not null").groupBy("subject").agg(F.min("row_idx").alias("first"))
    named = first.withColumn("label", scalars.condition(F.col("subject"))).where(F.col("label").isin(case, control)).orderBy("first").collect()
    labels, rng = [int(x.label == case) for x in named], Rng(seed)
    for i in range(len(labels) - 1, 0, -1):
        j = rng.below(i + 1)
        labels[i], labels[j] = labels[j], labels[i]
    return rows.sparkSession.createDataFrame([(x.subject, y) for x, y in zip(named, labels, strict=True)], "subject string, is_case int")


def associate(groups: DataFrame, donors: DataFrame, classes: DataFrame, min_donors: int) -> DataFrame:
    """Adds case_donors, control_donors, assoc_p and assoc_q; groups of fewer labelled donors are not tested."""
    counted = donors.join(classes, "subject").groupBy("type", "tag").agg(F.sum("is_case").alias("case_donors"), F.sum(1 - F.col("is_case")).alias("control_donors"))
    whole = classes.agg(F.coalesce(F.sum("is_case"), F.lit(0)).alias("n_case"), F.coalesce(F.sum(1 - F.col("is_case")), F.lit(0)).alias("n_control")).withColumn("_j", F.lit(1))
    rows = groups.join(counted, ["type", "tag"], "left").fillna(0, ["case_donors", "control_donors"]).join(F.broadcast(whole), F.lit(1) == F.col("_j"))
    rows = rows.withColumn("_tested", F.col("case_donors") + F.col("control_donors") >= max(min_donors, 1))
    rows = stats.with_upper_tail(rows, "_p", "case_donors", "case_donors + control_donors", "n_case + n_control - case_donors - control_donors", "n_case")
    rows = rows.withColumn("assoc_p", F.when(F.col("_tested"), F.col("_p")))
    return stats.benjamini_hochberg(rows, "assoc_p", "assoc_q").drop("_tested", "_p", "_j", "n_case", "n_control")


def hla_tests(donors: DataFrame, hla: DataFrame, rows: DataFrame) -> DataFrame:
    """(type, tag, allele, hla_donors, hla_with_allele, n_typed, p) of groups with two or more typed carriers."""
    known = rows.where("subject is not null").select("subject").distinct()
    typed = hla.distinct().join(known, "subject", "left_semi")
    background = typed.groupBy("allele").agg(F.countDistinct("subject").alias("bg"))
    whole = typed.agg(F.countDistinct("subject").alias("n_typed")).withColumn("_j", F.lit(1))
    carriers = donors.join(typed.select("subject").distinct(), "subject", "left_semi")
    sizes = carriers.groupBy("type", "tag").agg(F.count("*").alias("hla_donors")).where("hla_donors >= 2")
    with_allele = carriers.join(typed, "subject").groupBy("type", "tag", "allele").agg(F.count("*").alias("hla_with_allele"))
    tests = with_allele.join(sizes, ["type", "tag"]).join(background, "allele").join(F.broadcast(whole), F.lit(1) == F.col("_j"))
    return stats.with_upper_tail(tests, "p", "hla_with_allele", "bg", "n_typed - bg", "hla_donors").drop("_j")


def score_hla(groups: DataFrame, tests: DataFrame) -> DataFrame:
    """Adds the best allele, its counts, the Bonferroni-corrected p over the group's alleles, and q over all scored groups."""
    best = tests.groupBy("type", "tag").agg(F.min_by(F.struct("allele", "hla_donors", "hla_with_allele", "p"), F.struct("p", "allele")).alias("b"), F.count("*").alias("tests"))
    scored = best.select("type", "tag", F.col("b.allele").alias("hla_allele"), "b.hla_donors", "b.hla_with_allele", F.least(F.lit(1.0), F.col("b.p") * F.col("tests")).alias("hla_p"))
    return stats.benjamini_hochberg(groups.join(scored, ["type", "tag"], "left"), "hla_p", "hla_q")


def has_filters(params: GroupParams, association: Association | None = None) -> bool:
    """Whether filtered may leave groups out."""
    own = (params.max_global_p, params.max_global_q, *((association.max_p, association.max_q) if association else ()))
    return params.min_subjects > 1 or any(x is not None for x in own)


def filtered(groups: DataFrame, params: GroupParams, association: Association | None = None) -> DataFrame:
    """The final filters; what was not tested fails a filter on its test."""
    is_global = F.col("type") == "global"
    for column, most in (("fisher_score", params.max_global_p), ("fdr_q", params.max_global_q)):
        if most is not None:
            groups = groups.where(~is_global | (F.col(column) <= most))
    if association:
        for column, most in (("assoc_p", association.max_p), ("assoc_q", association.max_q)):
            if most is not None:
                groups = groups.where(F.col(column) <= most)
    return groups.where(F.col("n_subjects") >= params.min_subjects) if params.min_subjects > 1 else groups
