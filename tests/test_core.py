import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from receptory.functions import scalars, stats
from receptory.operators import annotate, downstream, groups, merged
from receptory.plans.params import Association, ClusterParams, GroupParams
from receptory.plans.pipelines import convergence_groups, merged_clusters
from receptory.sources import synth, tables

AA = scalars.AMINO_ACIDS


def rows(spark, records):
    return tables.from_records(spark, [(x[0], x[2] if len(x) > 2 else None, None, x[1] if len(x) > 1 else None, 1) for x in records])


def plain(spark, sequences):
    return spark.createDataFrame([(x,) for x in sequences], "cdr3 string")


def test_fisher(spark):
    got = spark.createDataFrame([(3, 1, 1, 3), (10, 2, 3, 15), (1, 9, 11, 3), (0, 5, 5, 0)], "a long, b long, c long, d long").select(stats.fisher_greater("a", "b", "c", "d")).collect()
    assert [x[0] for x in got] == pytest.approx([0.24285714285714288, 0.00046518094336290487, 0.9999663480953023, 1])


def test_hypergeometric_against_fractions(spark):
    cases = [(x, m, n, k) for x in (0, 1, 3, 5) for m in (0, 4, 9) for n in (0, 6, 20) for k in (0, 3, 8) if k <= m + n]
    want = [float(sum(Fraction(math.comb(m, i) * math.comb(n, k - i), math.comb(m + n, k)) for i in range(x, min(k, m) + 1) if k - i <= n)) if x > max(0, k - n) else 1.0 for x, m, n, k in cases]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, x long, m long, n long, k long").select("i", stats.hypergeom_upper("x", "m", "n", "k").alias("p")).orderBy("i").collect()
    assert [x.p for x in got] == pytest.approx(want, abs=1e-12)


def test_benjamini_hochberg(spark):
    got = stats.benjamini_hochberg(spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005), (4, 0.5), (5, None)], "i int, p double"), "p", "q").orderBy("i").collect()
    assert [x.q for x in got[:5]] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.5]) and got[5].q is None


def test_benjamini_hochberg_of_many_values(spark):
    """Ties, groups and each group's own total against plain arithmetic; no frame looks ahead to the last row, which takes the square of the rows."""
    data = [("ab"[i % 3 == 0], (i * 7919 % 4001) / 4001 * (i % 5 + 1) / 5) for i in range(9000)]
    out = stats.benjamini_hochberg(spark.createDataFrame(data, "kind string, p double"), "p", "q", ["kind"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    want = {}
    for kind in "ab":
        own = sorted((p for k, p in data if k == kind), reverse=True)
        least = 1.0
        for i, p in enumerate(own):
            least = min(least, p * len(own) / (len(own) - i))
            want[kind, p] = least
    got = out.collect()
    assert len(got) == len(data) and all(math.isclose(r.q, want[r.kind, r.p], rel_tol=1e-12, abs_tol=1e-300) for r in got)


def test_poisson_of_large_rates(spark):
    """Against the sum of exact logs; exp(-rate) is 0 from 746 on."""
    cases = [(0, 3.5), (1, 0.0), (1, 2.0), (5, 0.222), (40, 12.25), (700, 745.0), (800, 800.5), (4676, 4727.787877), (4800, 4727.787877), (3703, 4422.10266), (9789, 8183.760357), (100000, 100100.0), (2000000, 100.0), (10, 2e6)]

    def tail(k, rate):
        own = math.fsum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k)) if rate else 1.0
        return max(0.0, 1 - own) if k else 1.0

    got = spark.createDataFrame(cases, "k long, rate double").select("k", "rate", stats.poisson_upper("k", "rate").alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(tail(min(r.k, 200000), r.rate), rel=1e-6, abs=1e-9), (r.k, r.rate)
    assert stats_p(got, 4676) == 0.11 and stats_p(got, 3703) == 0.0


def stats_p(rows, k):
    return round(-math.log10(next(r.p for r in rows if r.k == k)), 3) + 0.0


def test_rounding(spark):
    got = spark.createDataFrame([(0.012345,), (0.000987,), (1.0,), (0.00115,)], "x double").select(scalars.round_2sig("x").alias("x")).collect()
    assert [x.x for x in got] == [0.012, 0.00099, 1.0, 0.0011]
    assert spark.sql("select 12.345D as x").select(scalars.round_1dp(F.col("x"))).first()[0] == 12.3


def test_parse(spark):
    lines = ["CDR3b\tTRBV\tTRBJ\tCDR3a\tsubject:condition\tcount", "CASSLGQETQYF\tTRBV5\tNA\t\tP1:A\t3", "casslgqetqyf\t\t\t\tP2:A\t0.5", "CASSPGQETQYF", "CASS*X"]
    got = tables.parsed_rows(spark.createDataFrame(list(enumerate(lines)), "line_idx long, value string"))
    kept = got.where("cdr3 is not null").orderBy("row_idx").collect()
    assert [x.cdr3 for x in kept] == ["CASSLGQETQYF", "CASSLGQETQYF", "CASSPGQETQYF"] and [x["count"] for x in kept] == [3, 1, 1]
    assert kept[0].v_gene == "TRBV5" and kept[0].j_gene is None and got.where("cdr3 is null").count() == 1
    assert tables.first_seen_ids(got.where("cdr3 is not null")).orderBy("seq_id").collect()[0].cdr3 == "CASSLGQETQYF"
    with pytest.raises(ValueError, match="no recognisable CDR3"):
        tables.parsed_rows(spark.createDataFrame([(0, "xyz\tb")], "line_idx long, value string"))


def test_hla(spark):
    got = tables.parsed_hla(spark.createDataFrame([(0, "donor\ta"), (1, "P1\tA*01,NA\tB*02"), (2, "P2\tNA"), (3, "P1\tC*03")], "line_idx long, value string"))
    assert {(x.subject, x.allele) for x in got.collect()} == {("P1", "A*01"), ("P1", "B*02"), ("P1", "C*03")}


def test_gapped_motifs(spark):
    got = groups.motif_occurrences(plain(spark, ["SLGQ"]), "cdr3", (2, 3), True).select("motif").collect()
    assert sorted(x.motif for x in got) == sorted("SL LG GQ SLG LGQ S%G L%Q S%GQ SL%Q".split())


def test_hamming_and_clusters(spark):
    seqs = spark.createDataFrame(list(enumerate("CASSLGQETQYF CASSPGQETQYF CASSLGQETQYW CASSLGQETQY CATTLGQETQYF".split())), "seq_id long, cdr3 string")
    assert sorted(tuple(x) for x in merged.hamming_edges(seqs).collect()) == [(0, 1, 4), (0, 2, 11)]
    found = merged_clusters(seqs)
    got = found.numbered().collect()
    assert [(x.cluster_id, x.size, x.n_local_edges) for x in got] == [(0, 3, 2)]


def test_masks_and_motifs_without_needless_exchanges(spark, monkeypatch):
    """Motifs of a sequence are told apart within its row, tested motifs are worked out once, masks meet once."""
    seqs = plain(spark, ["CASAAAAAAYTF", "CASAAC", "CASWDQYWDQYTF"]).select("cdr3")
    found = merged.sequence_motifs(seqs, ClusterParams())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(x, x[3:-3][i : i + k]) for x in ("CASAAAAAAYTF", "CASWDQYWDQYTF") for k in (2, 3, 4) for i in range(len(x) - 6 - k + 1)}
    got = [(x.cdr3, x.motif) for x in found.collect()]
    assert set(got) == want and len(got) == len(want)
    ids = spark.createDataFrame([(i, f"CASS{a}GQ{b}QYF") for i, (a, b) in enumerate((a, b) for a in "LPRT" for b in "EA")], "seq_id long, cdr3 string")
    calls = []
    monkeypatch.setattr(merged, "kept", lambda df, own=merged.kept: calls.append(df.columns) or own(df))
    out = merged_clusters(ids, None, ClusterParams(mismatch_trim=3, motifs=False)).clusters.collect()
    assert ["seq_id", "b", "n"] in calls and [(x.root, x.size, x.n_local_edges) for x in out] == [(0, 8, 4 + 2 * 6)]


def test_members_are_had_without_donors_and_compared_in_one_pass(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(annotate, "group_donors", lambda *x, own=annotate.group_donors: calls.append(1) or own(*x))
    rows = spark.createDataFrame([(f"CASS{a}GQETQYF", "V1", f"P{i}:A", i) for i, a in enumerate("LPR")], "cdr3 string, v_gene string, subject string, row_idx long")
    found = convergence_groups(rows, rows.select("cdr3"), GroupParams(all_aa_interchangeable=True, local=False))
    assert found.members.count() == 3 and not calls
    assert [x.n_subjects for x in found.groups.collect()] == [3] and calls == [1]
    few = convergence_groups(rows, rows.select("cdr3"), GroupParams(all_aa_interchangeable=True, local=False, min_subjects=4))
    assert few.members.count() == 0 and few.all_members.count() == 3
    sides = [spark.createDataFrame(x, "type string, tag string, cdr3 string") for x in ([("g", "A", "C1"), ("g", "A", "C2"), ("g", "B", "C1"), ("g", "D", "C4")], [("g", "A", "C2"), ("g", "A", "C1"), ("g", "B", "C3"), ("g", "E", "C5")])]
    got = {(x.tag, x.members, x.side) for x in downstream.agreement(*sides).collect()}
    assert got == {("B", "C1", "left"), ("B", "C3", "right"), ("D", "C4", "left"), ("E", "C5", "right")}


def test_normalizing_without_patterns(spark):
    """Patterns that a plan repeats for every test on the result took most of a run of a table in memory."""
    found = spark.createDataFrame([(x,) for x in (" cas\t", "\n", "CAS*", "", None, "\f\rcassf\r\n", "C AS")], "x string").select(scalars.normalize_cdr3(F.col("x")).alias("x"))
    plan = found._jdf.queryExecution().analyzed().toString().lower()
    assert "rlike" not in plan and "regexp" not in plan
    assert [r.x for r in found.collect()] == ["CAS", None, None, None, None, "CASSF", None]


def test_global_groups(spark):
    found = convergence_groups(rows(spark, [("CASG%sETQYQF" % x,) for x in "IVW"]), plain(spark, ["CASSLGQETQYF"]), GroupParams(local=False))
    assert [x.tag for x in found.groups.collect()] == ["G%ETQ_IV"]
    found = convergence_groups(rows(spark, [("CASG%sETQYQF" % x,) for x in "IVW"]), plain(spark, ["CASSLGQETQYF"]), GroupParams(local=False, all_aa_interchangeable=True))
    assert [(x.tag, x.members) for x in found.with_members().select("tag", "members").collect()] == [("G%ETQ_IVW", ["CASGIETQYQF", "CASGVETQYQF", "CASGWETQYQF"])]


def test_residue_components_by_fixpoint(spark):
    import random

    r = random.Random(1)
    cases = []
    for _ in range(200):
        mask = r.randrange(1, 1 << 20)
        bit = 1 << r.choice([i for i in range(20) if mask >> i & 1])
        c = bit
        while True:
            d = c
            for i in range(20):
                if c >> i & 1:
                    d |= scalars.COMPATIBLE[i] & mask
            if d == c:
                break
            c = d
        cases.append((bit, mask, c))
    got = spark.createDataFrame(cases, "b int, m int, want int").select(scalars.residue_component("b", "m").alias("got"), "want").collect()
    assert all(x.got == x.want for x in got)


def test_association_and_hla(spark):
    records = [(f"CASG{x}ETQYQF", f"D{i}:{'case' if x == 'P' else 'case'}") for i, x in enumerate("PPPQQQ")] + [(f"CAWAWWW{'A' if i % 2 else 'C'}QYQF", f"E{i}:control") for i in range(6)]
    params = GroupParams(local=False, all_aa_interchangeable=True, association=Association("case", "control", min_donors=2))
    source = rows(spark, records)
    hla = spark.createDataFrame([(f"D{i}:case", "A*01") for i in range(6)] + [(f"E{i}:control", "B*02") for i in range(6)], "subject string, allele string")
    found = {x.tag: x for x in convergence_groups(source, plain(spark, ["CASSLGQETQYF"]), params, hla).groups.collect()}
    g = found["G%ETQ_PQ"]
    assert (g.case_donors, g.control_donors, g.n_subjects) == (6, 0, 6) and g.assoc_p == pytest.approx(1 / 924)
    assert (g.hla_allele, g.hla_donors, g.hla_with_allele) == ("A*01", 6, 6) and g.hla_p == pytest.approx(1 / 924)
    classes = annotate.permuted_classes(source, "case", "control", 5)
    assert classes.count() == 12 and classes.agg(F.sum("is_case")).first()[0] == 6


def test_enriched_motif(spark):
    seqs = spark.createDataFrame(list(enumerate(["CASSWWWEQYF", "CASRWWWTQYF", "CASTWWWGQYF", "CASSLGQETQYF"])), "seq_id long, cdr3 string")
    refs = [f"CAS{AA[i % 20]}{AA[i // 20 % 20]}G{AA[i % 17]}ETQYF" for i in range(1000)]
    refs = sorted(set(refs))[:300] + ["CASSWWWAQYF"]
    found = merged_clusters(seqs, plain(spark, refs), ClusterParams())
    assert "WWW" in {x.motif for x in found.motifs.where("passes").collect()}
    assert {x.seq_id for x in found.members.where("root = 0").collect()} >= {0, 1, 2}


def test_empty(spark):
    none = rows(spark, [])
    assert convergence_groups(none, plain(spark, []), GroupParams()).groups.count() == 0


def test_generators():
    a = synth.repertoire(400, 11)
    assert a == synth.repertoire(400, 11) and len(a) == 400 and all(set(x) <= set(AA) for x in a)
    assert synth.expand(a[:10], 3, 1)[:10] == a[:10] and len(synth.expand(a[:10], 3, 1)) == 30


def test_result_does_not_depend_on_partitions(spark):
    source = rows(spark, [(x, f"D{i % 7}:a") for i, x in enumerate(synth.repertoire(300, 2))])
    refs = plain(spark, synth.reference(500, 3))
    one = convergence_groups(source, refs, GroupParams(all_aa_interchangeable=True, lcminove=(10.0,))).with_members()
    two = convergence_groups(source.repartition(7), refs.repartition(3), GroupParams(all_aa_interchangeable=True, lcminove=(10.0,))).with_members()
    key = lambda df: sorted(str(sorted(x.asDict().items())) for x in df.collect())
    assert key(one) == key(two)
