"""Readers and writers of repertoire, reference, HLA, group, cluster and motif tables."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from receptory.functions import scalars
from receptory.operators.keep import kept

#: Column names that headers use (fixed values); compared trimmed and without case.
ALIASES = {
    "cdr3": "CDR3b cdr3aa cdr3 cdr3_b_aa junction_aa aminoAcid amino_acid".split(),
    "v_gene": "TRBV v v_gene v_call v_b_gene vGeneName".split(),
    "j_gene": "TRBJ j j_gene j_call j_b_gene jGeneName".split(),
    "subject": "subject:condition subject patient donor sample_id".split(),
    "count": "count Freq frequency duplicate_count templates".split(),
}
#: The same for tables in memory, where the first name that a table has counts (fixed values).
FRAME_ALIASES = {
    "cdr3": ["CDR3b", "cdr3", "cdr3aa", "CDR3.beta", "junction_aa"],
    "v_gene": ["TRBV", "v", "v_gene", "v_call"],
    "j_gene": ["TRBJ", "j", "j_gene", "j_call"],
    "subject": ["patient", "subject", "subject:condition", "donor", "sample_id"],
    "count": ["counts", "count", "templates"],
}
#: Places of the columns in files without a header.
POSITIONS = {"cdr3": 0, "v_gene": 1, "j_gene": 2, "subject": 4, "count": 5}
#: First-column names that make the first line of an HLA table a header (fixed values).
HLA_HEADERS = ("subject", "sample_id", "donor", "patient", "subject:condition")
FIELDS = 16


def resolve_header(fields: list[str]) -> dict[str, int] | None:
    """Places of the columns if the line is a header; the first field that fits a column has it."""
    names = [x.strip(" \t\r\n\f").lower() for x in fields]
    found = {}
    for column, aliases in ALIASES.items():
        known = {x.lower() for x in aliases}
        place = next((i for i, x in enumerate(names) if x in known), None)
        if place is not None:
            found[column] = min(place, FIELDS - 1)
    return found if "cdr3" in found else None


def resolve_frame(columns: list[str]) -> dict[str, int] | None:
    """Places of the columns of a table in memory; the first alias that a column has counts, in the aliases' order."""
    names = [x.lower() for x in columns]
    found = {k: next((names.index(x.lower()) for x in own if x.lower() in names), None) for k, own in FRAME_ALIASES.items()}
    return {k: v for k, v in found.items() if v is not None} if found["cdr3"] is not None else None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_idx"), F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.where((scalars.trimmed(F.col("value")) != "") & ~F.col("value").startswith("#"))


def parsed_rows(lines: DataFrame) -> DataFrame:
    """(row_idx, cdr3, v_gene, j_gene, subject, count) of tab-separated lines (line_idx, value); a bad cdr3 is null."""
    first = lines.orderBy("line_idx").limit(1).collect()
    places, body = POSITIONS, lines
    if first:
        fields = first[0].value.split("\t")
        header = resolve_header(fields)
        if header is not None:
            places, body = header, lines.where(F.col("line_idx") != first[0].line_idx)
        elif scalars_of(fields[0]) is None:
            raise ValueError("header has no recognisable CDR3 column")
    parts = F.split("value", "\t")

    def field(column: str) -> Column:
        return F.get(parts, F.lit(places[column])) if column in places else F.lit(None).cast("string")

    return body.select(F.col("line_idx").alias("row_idx"), scalars.normalize_cdr3(field("cdr3")).alias("cdr3"), *[scalars.present(field(x)).alias(x) for x in ("v_gene", "j_gene", "subject")], scalars.count_value(field("count")).alias("count"))


def scalars_of(text: str) -> str | None:
    """The normalised sequence of a Python string, None if it is none."""
    clean = text.strip(" \t\r\n\f").upper()
    return clean if clean and set(clean) <= set(scalars.AMINO_ACIDS) else None


def read_repertoire(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid cdr3, and one row with the number of skipped lines."""
    rows = parsed_rows(_lines(spark, path))
    return rows.where("cdr3 is not null"), rows.agg(F.count_if(F.col("cdr3").isNull()).alias("skipped"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return read_repertoire(spark, path)[0].select("cdr3").distinct()


def parsed_hla(lines: DataFrame) -> DataFrame:
    """(subject, allele) of lines of a donor and its alleles, separated by tabs or commas; NA is none."""
    first = lines.orderBy("line_idx").limit(1).collect()
    if first:
        fields = [x.strip() for x in first[0].value.replace(",", "\t").split("\t")]
        if fields[0].lower() in HLA_HEADERS:
            lines = lines.where(F.col("line_idx") != first[0].line_idx)
    parts = F.filter(F.transform(F.split("value", "[\t,]"), scalars.trimmed), lambda x: x != "")
    each = lines.select(parts.alias("p")).where(F.size("p") > 1).select(F.get("p", F.lit(0)).alias("subject"), F.explode(F.expr("slice(p, 2, size(p))")).alias("allele"))
    return each.where(F.upper("allele") != "NA").distinct()


def read_hla_table(spark: SparkSession, path: str) -> DataFrame:
    return parsed_hla(_lines(spark, path))


def first_seen_ids(rows: DataFrame, range_rows: int = 200_000) -> DataFrame:
    """(cdr3, seq_id): distinct sequences numbered from 0 in order of their first row.

    Numbers are given within ranges of the first row, as many as the rows ask
    for up to 10,000, and moved by the ranges' totals, so nothing but a range
    is sorted in one task.
    """
    firsts = kept(rows.groupBy("cdr3").agg(F.min("row_idx").alias("first")))
    ranges = min(max(1, -(-firsts.count() // range_rows)), 10_000)
    cuts = sorted(set(firsts.select(F.percentile_approx("first", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first().q or [])) if ranges > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col("first"))) if cuts else F.lit(0)
    firsts = firsts.withColumn("_part", part)
    numbered = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("first", "cdr3")))
    sizes = firsts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).select("_part", "_before")
    return numbered.join(F.broadcast(before), "_part").select("cdr3", (F.col("_n") + F.col("_before") - 1).alias("seq_id"))


def from_records(spark: SparkSession, records: list[tuple]) -> DataFrame:
    """Rows from (cdr3, v_gene, j_gene, subject, count) in memory; sequences are taken as they are."""
    schema = "row_idx long, cdr3 string, v_gene string, j_gene string, subject string, count long"
    return spark.createDataFrame([(i, *x) for i, x in enumerate(records)], schema)


def from_sequences(spark: SparkSession, sequences: list[str]) -> DataFrame:
    rows = from_records(spark, [(x, None, None, None, 1) for x in sequences])
    return rows.withColumn("cdr3", scalars.normalize_cdr3(F.col("cdr3"))).where("cdr3 is not null")


def wide_to_long(wide: DataFrame, subject: str) -> DataFrame:
    """(subject, allele) of a table of a donor column and allele columns."""
    alleles = [F.col(f"`{x}`").cast("string") for x in wide.columns if x != subject]
    each = wide.select(F.col(subject).alias("subject"), F.explode(F.array(*alleles)).alias("allele"))
    return each.withColumn("allele", scalars.present(F.col("allele"))).where("allele is not null").distinct()


def pooled(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Pools sample tables (sample, cdr3aa, v, j, count, row_idx) with metadata (sample, subject, label): one gene of several, no stops or frames shifted."""
    kept = rows.where((F.col("cdr3aa") != "") & ~F.col("cdr3aa").rlike("[_*]"))
    first = lambda x: F.get(F.split(x, ","), F.lit(0))
    return kept.join(metadata, "sample").select("row_idx", F.col("cdr3aa").alias("cdr3"), first("v").alias("v_gene"), first("j").alias("j_gene"), F.concat("subject", F.lit(":CMV"), "label").alias("subject"), "count")


def subset(rows: DataFrame, subjects: int, n: int, seed: int) -> DataFrame:
    """n distinct sequences, with their first V gene, of the first subjects, in an order fixed by the seed."""
    first = rows.where("subject is not null").groupBy("subject").agg(F.min("row_idx").alias("f")).orderBy("f").limit(subjects)
    each = rows.join(F.broadcast(first.select("subject")), "subject", "left_semi").groupBy("cdr3").agg(F.min_by("v_gene", "row_idx").alias("v_gene"))
    return each.orderBy(F.md5(F.concat("cdr3", F.lit(f":{seed}"))), "cdr3").limit(n)


def _text(x: float | None, scientific: bool) -> str:
    """The shortest digits that give the number back: as 4.6e-4 or as a plain decimal."""
    if x is None or x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    if scientific:
        return np.format_float_scientific(x, unique=True, trim="-", exp_digits=1).replace("e+", "e")
    return np.format_float_positional(x, unique=True, trim="-")


@F.pandas_udf(StringType())
def scientific(x: pd.Series) -> pd.Series:
    return x.map(lambda v: _text(v, True))


@F.pandas_udf(StringType())
def decimal(x: pd.Series) -> pd.Series:
    return x.map(lambda v: _text(v, False))


def write_tsv(rows: DataFrame, path: str) -> None:
    """One file of tab-separated lines under a header, in the order of rows.

    Sorted parts are written beside it by the executors and then copied one
    after another through the driver, which holds a buffer of them at a time.
    """
    spark = rows.sparkSession
    parts = f"{path}.parts"
    rows.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("NA")) for x in rows.columns])).write.mode("overwrite").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    fs.delete(target, True)
    out = fs.create(target, True)
    try:
        out.write(bytearray(("\t".join(rows.columns) + "\n").encode()))
        for name in names:
            source = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(folder, True)


def group_lines(groups: DataFrame) -> DataFrame:
    """groups (with members) under the names of the group table; optional blocks only where worked out."""
    names = {"type": "type", "tag": "tag", "cluster_size": "cluster_size", "unique_cdr3_sample": "unique_cdr3_sample", "unique_cdr3_ref": "unique_cdr3_ref", "ove": "OvE", "fisher_score": "fisher.score", "fdr_q": "fdr.q", "n_subjects": "n_subjects", "case_donors": "case_donors", "control_donors": "control_donors", "assoc_p": "assoc.p", "assoc_q": "assoc.q", "hla_allele": "hla.allele", "hla_donors": "hla.donors", "hla_with_allele": "hla.with_allele", "hla_p": "hla.p", "hla_q": "hla.q"}
    there = [x for x in names if x in groups.columns]
    shown = {"ove": decimal, "hla_allele": lambda x: F.coalesce(x, F.lit("NA")), "hla_donors": lambda x: F.coalesce(x, F.lit(0)), "hla_with_allele": lambda x: F.coalesce(x, F.lit(0))} | dict.fromkeys(("fisher_score", "fdr_q", "assoc_p", "assoc_q", "hla_p", "hla_q"), scientific)
    return groups.select(*[shown.get(x, lambda y: y)(F.col(x)).cast("string").alias(names[x]) for x in there], F.array_join("members", " ").alias("members"))


def write_groups(groups: DataFrame, path: str) -> None:
    write_tsv(group_lines(groups), path)


def write_motifs(motifs: DataFrame, path: str) -> None:
    """Motifs by length, then alphabet."""
    rows = motifs.orderBy(scalars.order_key("motif"))
    write_tsv(rows.select("motif", "k", "input_count", "reference_count", decimal("fold").alias("fold"), scientific("p_value").alias("p_value"), scientific("q_value").alias("q_value")), path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Sequences in the order of their rows."""
    write_tsv(sequences.orderBy("row_idx").select(F.col("cdr3").alias("CDR3b")), path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges by their ends and position."""
    write_tsv(edges.orderBy("a", "b", "position").select("a", "b", "position"), path)


def run_summary(figures: dict) -> str:
    return json.dumps(figures)
