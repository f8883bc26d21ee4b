"""Entry points for lists and tables in memory: checks inputs, runs a pipeline, gives a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receptory.functions import scalars
from receptory.plans import pipelines
from receptory.plans.params import ClusterParams, GroupParams
from receptory.sources import tables

#: Strings that stand for a missing value in lists.
MISSING = ("", "nan", "na", "none")


def _present(x) -> str | None:
    return None if x is None or x != x or str(x).strip().lower() in MISSING else str(x).strip()


def repertoire(spark: SparkSession, cdr3, v_gene=None, subject=None, j_gene=None, count=None) -> DataFrame:
    """Rows from a DataFrame with known column names, or from lists of one length.

    A DataFrame's columns go by the names of tables in memory, in their order,
    else by those of file headers.
    """
    if isinstance(cdr3, DataFrame):
        places = tables.resolve_frame(cdr3.columns) or tables.resolve_header(cdr3.columns)
        if places is None:
            raise ValueError("no column with a known CDR3 name")
        at = lambda x: scalars.present(F.col(f"`{cdr3.columns[places[x]]}`").cast("string")) if x in places else F.lit(None).cast("string")
        rows = cdr3.select(F.monotonically_increasing_id().alias("row_idx"), scalars.normalize_cdr3(at("cdr3")).alias("cdr3"), at("v_gene").alias("v_gene"), at("j_gene").alias("j_gene"), at("subject").alias("subject"), scalars.count_value(at("count")).alias("count"))
        return rows.where("cdr3 is not null")
    cdr3 = list(cdr3)
    columns = [list(x) if x is not None else [None] * len(cdr3) for x in (v_gene, j_gene, subject, count)]
    if any(len(x) != len(cdr3) for x in columns):
        raise ValueError("cdr3, v_gene, j_gene, subject and count must have one length")
    records = [(_present(c), _present(v), _present(j), _present(s), int(n) if n is not None and n == n and n >= 1 else 1) for c, v, j, s, n in zip(cdr3, *columns, strict=True)]
    rows = tables.from_records(spark, records)
    return rows.withColumn("cdr3", scalars.normalize_cdr3(F.col("cdr3"))).where("cdr3 is not null")


def convergence_groups(spark: SparkSession, cdr3, reference, v_gene=None, subject=None, params: GroupParams | None = None, hla=None) -> pipelines.Convergence:
    """Convergence groups of a repertoire against a reference; hla: a DataFrame (subject, allele) or a dict of lists."""
    params = params or GroupParams()
    rows, refs = repertoire(spark, cdr3, v_gene, subject), repertoire(spark, reference)
    if not rows.limit(1).count():
        raise ValueError("no valid CDR3 sequences")
    if params.local and not refs.limit(1).count():
        raise ValueError("reference is empty; local groups need one")
    if params.association and not (params.association.case and params.association.control):
        raise ValueError("case and control must be given together")
    if isinstance(hla, DataFrame) and set(hla.columns) != {"subject", "allele"}:
        if len(hla.columns) < 2:
            raise ValueError("an HLA table needs a donor column and an allele column")
        hla = tables.wide_to_long(hla, hla.columns[0])
    if isinstance(hla, dict):
        hla = spark.createDataFrame([(s, a) for s, own in hla.items() for a in own if _present(a)], "subject string, allele string")
    return pipelines.convergence_groups(rows, refs, params, hla)


def merged_clusters(spark: SparkSession, cdr3, reference=None, params: ClusterParams | None = None) -> pipelines.Clusters:
    rows = repertoire(spark, cdr3)
    refs = repertoire(spark, reference).select("cdr3").distinct() if reference is not None else None
    return pipelines.merged_clusters(tables.first_seen_ids(rows), refs, params)


def as_columns(found: pipelines.Convergence) -> dict:
    """Small results as a dict: column lists of groups (in the group table's order) and motifs, and the run's totals."""
    rows = found.ordered()
    groups = rows.collect()
    motifs = found.motifs.select(F.translate("motif", "%", ".").alias("motif"), "num_in_sample", "num_in_ref", "fisher_score", "num_fold", scalars.order_key("motif").alias("_o")).orderBy("_o").collect() if found.motifs is not None else []
    totals = found.summary()
    part = lambda names: {k: totals[v] for k, v in names.items()} if all(v in totals for v in names.values()) else None
    return {
        "groups": {"OvE" if x == "ove" else x: [r[x] for r in groups] for x in rows.columns},
        "motifs": {x: [r[x] for r in motifs] for x in ("motif", "num_in_sample", "num_in_ref", "fisher_score", "num_fold")},
        "n_sample": totals["n_sample"],
        "n_reference": totals["n_reference"],
        "n_input_cdr3": totals["unique"],
        "association": part({"n_case": "n_case", "n_control": "n_control", "tested": "assoc_tested", "significant_q05": "assoc_q05"}),
        "hla": part({"typed_donors": "hla_typed_donors", "scored": "hla_scored", "tests": "hla_tests", "significant_q05": "hla_q05"}),
    }


def as_frames(found: pipelines.Convergence) -> dict:
    """The result as tables: groups with members, motifs, tag to members, and the sizes of sample, reference and input."""
    totals = found.summary()
    return {"cluster_properties": found.ordered(), "motif_enrichment": found.motifs, "cluster_list": found.cluster_list(), "sample_size": totals["n_sample"], "reference_size": totals["n_reference"], "input_size": totals["unique"]}
