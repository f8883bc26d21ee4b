"""Files, command line and in-memory entry points, end to end."""

import json
import math
import random

import pytest

from receptory import api, cli
from receptory.functions import scalars, stats
from receptory.operators import downstream, merged
from receptory.plans.params import Association, ClusterParams, GroupParams
from receptory.plans.pipelines import convergence_groups
from receptory.sources import synth, tables

AA = scalars.AMINO_ACIDS


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A sample with a global group, a local one, donors of two conditions, a reference and HLA types."""
    path = tmp_path_factory.mktemp("run")
    lines = ["# comment", "CDR3b\tTRBV\tTRBJ\tCDR3a\tsubject:condition\tcount"]
    for i, x in enumerate("PPPQQQIVL"):
        lines.append(f"CASG{x}ETQYQF\tTRBV{i % 2 + 5}\tNA\t\tD{i % 6}:case\t3")
    for i in range(6):
        lines.append(f"cas{AA[i]}WWW{AA[i + 5]}EQYF\t\tTRBJ1\t\tE{i}:control\t0.5\r")
    lines += ["", "CASS*X\tTRBV1", "CASSLGQETQYF"]
    (path / "rep.tsv").write_text("\n".join(lines) + "\n")
    reference = [f"CAS{AA[i % 20]}{AA[i // 20 % 20]}G{AA[i % 17]}ETQYF" for i in range(1000)]
    (path / "ref.txt").write_text("\n".join(sorted(set(reference))) + "\n")
    (path / "hla.csv").write_text("donor,a\n" + "".join(f"D{i}:case,A*01,NA\n" for i in range(6)) + "".join(f"E{i}:control\tB*02\n" for i in range(6)))
    return path


def table(path):
    head, *rows = path.read_text().split("\n")[:-1]
    return head.split("\t"), [dict(zip(head.split("\t"), x.split("\t"), strict=True)) for x in rows]


def test_groups_command(spark, files, capsys):
    cli.main(["groups", "--input", str(files / "rep.tsv"), "--reference", str(files / "ref.txt"), "--out", str(files / "g"), "--all-aa-interchangeable", "--lcminove", "10", "--case", "case", "--control", "control", "--assoc-min-donors", "0", "--hla", str(files / "hla.csv")])
    said = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    head, rows = table(files / "g_groups.tsv")
    assert head == "type tag cluster_size unique_cdr3_sample unique_cdr3_ref OvE fisher.score fdr.q n_subjects case_donors control_donors assoc.p assoc.q hla.allele hla.donors hla.with_allele hla.p hla.q members".split()
    by_tag = {x["tag"]: x for x in rows}
    g = by_tag["G%ETQ_ILPQV"]
    assert (g["cluster_size"], g["n_subjects"], g["case_donors"], g["control_donors"], g["OvE"]) == ("5", "6", "6", "0", "0") and g["members"] == "CASGIETQYQF CASGLETQYQF CASGPETQYQF CASGQETQYQF CASGVETQYQF"
    assert g["assoc.p"].startswith("1.0822510822") and g["assoc.p"].endswith("e-3") and g["hla.allele"] == "A*01"
    kinds = [x["type"] for x in rows]
    assert kinds == sorted(kinds, reverse=True) and any(x["tag"].startswith("WWW_") for x in rows)
    local = [x["tag"].split("_")[0] for x in rows if x["type"] == "local"]
    assert local == sorted(local, key=lambda m: (len(m), m))
    masks = [x["tag"].split("_")[0] for x in rows if x["type"] == "global"]
    assert masks == sorted(masks, key=lambda m: (len(m), m.index("%"), m))
    assert said["skipped"] == 1 and said["rows"] == 16 and said["n_case"] == 6 and said["n_control"] == 6 and said["hla_typed_donors"] == 12 and said["assoc_tested"] == len(rows) and {"t_io", "t_groups", "t_output", "t_total"} <= said.keys()
    assert said["local_groups"] + said["global_groups"] == len(rows)


def test_totals_count_tests_before_filters(spark, files):
    rows, _ = tables.read_repertoire(spark, str(files / "rep.tsv"))
    params = GroupParams(local=False, all_aa_interchangeable=True, association=Association("case", "control", 0, max_p=0.0))
    found = convergence_groups(rows, tables.read_sequences(spark, str(files / "ref.txt")), params)
    assert found.groups.count() == 0 and found.summary()["assoc_tested"] > 0 and found.summary()["assoc_q05"] > 0
    assert cli.group_params(cli.parser().parse_args(["groups", "--input", "a", "--reference", "b", "--out", "c", "--case", "x", "--control", "y", "--assoc-min-donors", "0"])).association.min_donors == 0


def test_clusters_command(spark, files, capsys):
    cli.main(["clusters", "--input", str(files / "rep.tsv"), "--reference", str(files / "ref.txt"), "--out", str(files / "c")])
    said = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    head, rows = table(files / "c_clusters.tsv")
    assert head == "cluster_id cluster_size n_local_edges motifs CDR3b TRBV TRBJ subject count".split()
    assert [int(x["cluster_id"]) for x in rows] == sorted(int(x["cluster_id"]) for x in rows) and rows[0]["CDR3b"] == "CASGPETQYQF" and rows[0]["TRBJ"] == "NA" and rows[0]["count"] == "3"
    assert said["clusters"] == len({x["cluster_id"] for x in rows}) and said["local_edges"] == sum({x["cluster_id"]: int(x["n_local_edges"]) for x in rows}.values())
    head, motifs = table(files / "c_motifs.tsv")
    assert head == "motif k input_count reference_count fold p_value q_value".split() and "WWW" in {x["motif"] for x in motifs}
    www = next(x for x in motifs if x["motif"] == "WWW")
    assert (www["k"], www["input_count"], www["reference_count"], www["fold"]) == ("3", "6", "0", "inf") and "e-" in www["p_value"]
    assert [x["motif"] for x in motifs] == sorted((x["motif"] for x in motifs), key=lambda m: (len(m), m))


def test_errors_of_the_command(spark, files):
    base = ["groups", "--input", str(files / "rep.tsv"), "--reference", str(files / "ref.txt"), "--out", str(files / "x")]
    with pytest.raises(SystemExit):
        cli.main([*base, "--case", "a"])
    (files / "none.tsv").write_text("donor\ta\n")
    with pytest.raises(SystemExit):
        cli.main([*base, "--hla", str(files / "none.tsv")])
    with pytest.raises(SystemExit):
        cli.main(["groups", "--input", "a", "--out", "b"])


def test_generators_command(spark, tmp_path):
    cli.main(["synth", "--n", "60", "--seed", "11", "--out", str(tmp_path / "s.tsv")])
    lines = (tmp_path / "s.tsv").read_text().split()
    assert lines[0] == "CDR3b" and lines[1:] == synth.repertoire(60, 11)
    cli.main(["expand", "--input", str(tmp_path / "s.tsv"), "--factor", "2", "--seed", "3", "--out", str(tmp_path / "e.tsv")])
    first = list(dict.fromkeys(lines[1:]))
    assert (tmp_path / "e.tsv").read_text().split()[1:] == synth.expand(first, 2, 3)


def test_generator_words_against_plain_arithmetic():
    """The generator's words by the textbook rule, with numpy's 64-bit integers instead of masks."""
    np = pytest.importorskip("numpy")
    for seed in (0, 1, 11, 2**40 + 7):
        with np.errstate(over="ignore"):
            state, want = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1), []
            for _ in range(200):
                state ^= state >> np.uint64(12)
                state ^= state << np.uint64(25)
                state ^= state >> np.uint64(27)
                want.append(int(state * np.uint64(0x2545F4914F6CDD1D)))
        rng = synth.Rng(seed)
        assert [rng.word() for _ in range(200)] == want
    rng = synth.Rng(5)
    a, b = synth.Rng(5), rng.chance(0.5)
    assert b == ((a.word() >> 11) / 2**53 < 0.5)


def test_headerless_and_single_column_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("CASSLGQETQYF\tTRBV1\tTRBJ2\tCAV\tP1:A\t7\nCASSPGQETQYF\n")
    rows, skipped = tables.read_repertoire(spark, str(tmp_path / "a.tsv"))
    got = [tuple(x)[1:] for x in rows.orderBy("row_idx").collect()]
    assert got == [("CASSLGQETQYF", "TRBV1", "TRBJ2", "P1:A", 7), ("CASSPGQETQYF", None, None, None, 1)] and skipped.first().skipped == 0
    (tmp_path / "b.tsv").write_text("# nothing\n\n")
    assert tables.read_repertoire(spark, str(tmp_path / "b.tsv"))[0].count() == 0
    (tmp_path / "c.tsv").write_text("count\tfreq\tcdr3nt\tcdr3aa\tv\td\tj\n5\t0.1\tTGT\tCASSLGQETQYF\tTRBV7-2\t.\tTRBJ2\n")
    (row,) = tables.read_repertoire(spark, str(tmp_path / "c.tsv"))[0].collect()
    assert (row.cdr3, row.v_gene, row.j_gene, row.subject, row["count"]) == ("CASSLGQETQYF", "TRBV7-2", "TRBJ2", None, 5)


def test_lists_frames_and_files_agree(spark, files):
    rows, _ = tables.read_repertoire(spark, str(files / "rep.tsv"))
    refs = tables.read_sequences(spark, str(files / "ref.txt"))
    params = GroupParams(all_aa_interchangeable=True, lcminove=(10.0,), kmer_mindepth=3)
    raw = rows.orderBy("row_idx").collect()
    reference = [x.cdr3 for x in refs.collect()]
    lists = api.convergence_groups(spark, [x.cdr3.lower() for x in raw], reference, v_gene=[x.v_gene or "nan" for x in raw], subject=[x.subject for x in raw], params=params)
    frame = spark.createDataFrame([("no", x.cdr3, x.v_gene, x.subject, "other") for x in raw], "junction_aa string, CDR3b string, v string, patient string, donor string")
    frames = api.convergence_groups(spark, frame, reference, params=params)
    file = convergence_groups(rows, refs, params)
    for x in (lists, frames):
        assert downstream.agreement(file.members, x.members).count() == 0
        assert sorted(map(tuple, x.groups.select("tag", "n_subjects").collect())) == sorted(map(tuple, file.groups.select("tag", "n_subjects").collect()))
    columns = api.as_columns(lists)
    assert columns["n_input_cdr3"] == len({x.cdr3 for x in raw}) and columns["association"] is None and columns["hla"] is None
    assert len(columns["groups"]["tag"]) == len(columns["groups"]["members"]) == file.groups.count() and "OvE" in columns["groups"]
    assert columns["motifs"]["motif"] == sorted(columns["motifs"]["motif"], key=lambda m: (len(m), m)) and columns["motifs"]["num_in_sample"]
    assert api.as_frames(lists)["sample_size"] == columns["n_sample"]


def test_input_errors(spark):
    with pytest.raises(ValueError, match="no valid CDR3"):
        api.convergence_groups(spark, ["xx1"], ["CASSLGQETQYF"])
    with pytest.raises(ValueError, match="reference is empty"):
        api.convergence_groups(spark, ["CASSLGQETQYF"], [])
    with pytest.raises(ValueError, match="one length"):
        api.convergence_groups(spark, ["CASSLGQETQYF"], ["CASSLGQETQYF"], v_gene=["a", "b"])
    with pytest.raises(ValueError, match="case and control"):
        api.convergence_groups(spark, ["CASSLGQETQYF"], ["CASSLGQETQYF"], params=GroupParams(association=Association("a", "")))
    with pytest.raises(ValueError, match="no column"):
        api.repertoire(spark, spark.createDataFrame([("a",)], "x string"))


def test_hypergeometric_tail_of_skewed_margins(spark):
    """Margins far apart, where the sums are cut at twelve standard deviations and 64 terms."""
    from fractions import Fraction

    r = random.Random(4)
    cases = [(x, m, n, k) for m, n, k in ((3, 10**6, 500), (10**5, 20, 10), (40, 2000, 1900), (5000, 5000, 60), (2, 3, 4), (900, 100, 950)) for x in sorted({0, 1, 2, min(m, k), min(m, k) // 2, max(0, k - n), max(0, k - n) + 1, r.randrange(min(m, k) + 1)})]

    def exact(x, m, n, k):
        low, high = max(x, k - n, 0), min(m, k)
        total = math.comb(m + n, k)
        return float(Fraction(sum(math.comb(m, i) * math.comb(n, k - i) for i in range(low, high + 1)), total)) if high - low < 3000 else None

    want = [exact(*c) for c in cases]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, x long, m long, n long, k long").select("i", stats.hypergeom_upper("x", "m", "n", "k").alias("p")).orderBy("i").collect()
    for c, w, g in zip(cases, want, got, strict=True):
        assert w is None or g.p == pytest.approx(w, rel=1e-6, abs=1e-9), c


def test_reports(spark):
    members = spark.createDataFrame([("global", "A", "C1"), ("global", "A", "C2"), ("global", "B", "C2"), ("global", "Z", "C9")], "type string, tag string, cdr3 string")
    base = spark.createDataFrame([("HomoSapiens", "TRB", "C1", "CMV", "NLV"), ("HomoSapiens", "TRB", "C2", "EBV", "GLC"), ("HomoSapiens", "TRA", "C9", "CMV", "NLV")], "species string, gene string, cdr3 string, antigen string, epitope string")
    groups = spark.createDataFrame([("global", "A", 2, 5, 1, 0.01, 0.02), ("global", "B", 1, 4, 0, 0.02, 0.03), ("global", "Z", 1, 1, 1, 0.9, 0.9)], "type string, tag string, cluster_size int, case_donors int, control_donors int, assoc_p double, assoc_q double")
    top = downstream.top_associated(groups, members, base, antigen="CMV").collect()
    assert [(x.tag, x.members, x.epitopes) for x in top] == [("A", 2, "CMV:NLV"), ("B", 1, "-")]
    family = downstream.families(members)
    assert {(x.tag, x.family) for x in family.collect()} == {("A", "A"), ("B", "A"), ("Z", "Z")}
    report = {x.family: x for x in downstream.family_report(groups, family, members, "assoc_p", base).collect()}
    assert (report["A"].best_tag, report["A"].case_donors, report["A"].cdr3s, report["A"].members, report["A"].epitopes) == ("A", 5, 2, "C1 C2", "CMV:NLV;EBV:GLC") and report["Z"].epitopes == "-"
    hits = downstream.antigen_hits(members, base, ("EBV",))
    assert {(x.tag, x.hit) for x in hits.collect()} == {("A", 1), ("B", 1), ("Z", 0)}
    (t,) = downstream.hit_table(groups, hits).collect()
    assert (t.sig_hit, t.sig_miss, t.rest_hit, t.rest_miss, t.odds_ratio) == (2, 0, 0, 1, 15.0) and t.fisher_p == pytest.approx(1 / 3)
    (m,) = downstream.size_matched(groups, hits, groups.where("tag = 'B'").select("tag")).collect()
    assert (m.observed, m.expected, m.ratio) == (1, 0.0, None)


def test_edges_and_clusters_with_motifs(spark, tmp_path):
    seqs = spark.createDataFrame(list(enumerate("CASSLGQETQYF CASSPGQETQYF CASSLGQETQYW CASSLGQETQY CATTLGQETQYF".split())), "seq_id long, cdr3 string")
    tables.write_edges(merged.hamming_edges(seqs), str(tmp_path / "edges.tsv"))
    assert (tmp_path / "edges.tsv").read_text() == "a\tb\tposition\n0\t1\t4\n0\t2\t11\n"
    motifs = spark.createDataFrame([("TLG",), ("SPG",)], "motif string")
    found, members = merged.clusters(seqs, None, motifs, ClusterParams(min_size=1))
    got = {x.root: x for x in found.collect()}
    assert got[0].motifs == ["SPG"] and got[0].n_local_edges == 2 and got[4].motifs == ["TLG"] and members.count() == 5
