"""Command line: groups, clusters, synth and expand."""

from __future__ import annotations

import argparse
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from receptory.plans import pipelines
from receptory.plans.params import Association, ClusterParams, GroupParams
from receptory.sources import synth, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="receptory")
    sub = top.add_subparsers(dest="command", required=True)
    g = sub.add_parser("groups", help="convergence groups")
    c = sub.add_parser("clusters", help="merged clusters")
    for p in (g, c):
        p.add_argument("--input", required=True)
        p.add_argument("--reference", required=p is g)
        p.add_argument("--out", required=True)
        p.add_argument("--min-cluster", type=int, default=2)
    g.add_argument("--paper-params", action="store_true")
    for name, kind in (("lcminp", float), ("kmer-mindepth", int), ("min-seq-length", int), ("motif-distance", int), ("max-global-p", float), ("max-global-q", float), ("min-subjects", int), ("assoc-min-donors", int), ("assoc-max-p", float), ("assoc-max-q", float), ("assoc-permute-seed", int)):
        g.add_argument(f"--{name}", type=kind)
    g.add_argument("--lcminove", type=lambda x: tuple(map(float, x.split(","))))
    for name in ("all-aa-interchangeable", "global-vgene", "discontinuous", "no-local", "no-global"):
        g.add_argument(f"--{name}", action="store_true")
    for name in ("case", "control", "hla"):
        g.add_argument(f"--{name}")
    c.add_argument("--mismatch-trim", type=int, default=0)
    c.add_argument("--max-p", type=float, default=0.001)
    c.add_argument("--min-count", type=int, default=3)
    for name in ("fdr", "gapped", "no-motifs"):
        c.add_argument(f"--{name}", action="store_true")
    s = sub.add_parser("synth", help="a synthetic repertoire")
    s.add_argument("--n", type=int, required=True)
    s.add_argument("--seed", type=int, default=1)
    s.add_argument("--reference", action="store_true")
    e = sub.add_parser("expand", help="near copies of a repertoire")
    e.add_argument("--input", required=True)
    e.add_argument("--factor", type=int, required=True)
    e.add_argument("--seed", type=int, default=1)
    for p in (s, e):
        p.add_argument("--out", required=True)
    return top


def group_params(a: argparse.Namespace) -> GroupParams:
    if (a.case is None) != (a.control is None):
        raise SystemExit("--case and --control must be given together")
    base = GroupParams.paper() if a.paper_params else GroupParams()
    changes = {k: getattr(a, k) for k in ("lcminp", "kmer_mindepth", "min_seq_length", "motif_distance", "max_global_p", "max_global_q", "min_subjects", "lcminove") if getattr(a, k) is not None}
    changes |= {k: True for k in ("all_aa_interchangeable", "global_vgene", "discontinuous") if getattr(a, k)}
    association = Association(a.case, a.control, 10 if a.assoc_min_donors is None else a.assoc_min_donors, a.assoc_max_p, a.assoc_max_q, a.assoc_permute_seed) if a.case else None
    return replace(base, cluster_min_size=a.min_cluster, local=not a.no_local, global_=not a.no_global, association=association, **changes)


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("receptory").getOrCreate()
    began = time.perf_counter()
    if a.command == "synth":
        made = synth.reference(a.n, a.seed) if a.reference else synth.repertoire(a.n, a.seed)
        tables.write_sequences(tables.from_sequences(spark, made), a.out)
        return
    rows, skipped = tables.read_repertoire(spark, a.input)
    if a.command == "expand":
        # each draw depends on those before it, so the copies are made on the driver, like the generators
        base = [x.cdr3 for x in tables.first_seen_ids(rows).orderBy("seq_id").toLocalIterator()]
        tables.write_sequences(tables.from_sequences(spark, synth.expand(base, a.factor, a.seed)), a.out)
        return
    timings = {"t_io": time.perf_counter() - began}
    if a.command == "groups":
        hla = tables.read_hla_table(spark, a.hla) if a.hla else None
        if hla is not None and not hla.limit(1).count():
            raise SystemExit("the HLA table has no alleles")
        found = pipelines.convergence_groups(rows, tables.read_sequences(spark, a.reference), group_params(a), hla)
        timings["t_groups"] = time.perf_counter() - began - timings["t_io"]
        tables.write_groups(found.ordered(), f"{a.out}_groups.tsv")
        figures = found.summary()
    else:
        params = ClusterParams(mismatch_trim=a.mismatch_trim, max_p=a.max_p, min_count=a.min_count, fdr=a.fdr, gapped=a.gapped, motifs=not a.no_motifs, min_size=a.min_cluster)
        found = pipelines.merged_clusters(tables.first_seen_ids(rows), tables.read_sequences(spark, a.reference) if a.reference else None, params)
        timings["t_clusters"] = time.perf_counter() - began - timings["t_io"]
        tables.write_tsv(found.rows(rows, ordered=True), f"{a.out}_clusters.tsv")
        if found.motifs is not None:
            tables.write_motifs(found.motifs.where("passes"), f"{a.out}_motifs.tsv")
        edges = found.clusters.agg(F.coalesce(F.sum("n_local_edges"), F.lit(0)).alias("n")).first().n
        figures = {"rows": rows.count(), "unique": rows.select("cdr3").distinct().count(), "local_edges": edges, "motifs": found.motifs.where("passes").count() if found.motifs is not None else 0, "clusters": found.clusters.count()}
    timings["t_total"] = time.perf_counter() - began
    timings["t_output"] = timings["t_total"] - sum(v for k, v in timings.items() if k != "t_total")
    print(tables.run_summary(figures | {"skipped": skipped.first().skipped} | {k: round(v, 4) for k, v in timings.items()}))


if __name__ == "__main__":
    main()
