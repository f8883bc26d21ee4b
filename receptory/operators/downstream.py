"""Analyses of finished groups: antigen lookup, families, size matching, family HLA tests, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receptory.functions import stats
from receptory.operators.components import connected_components


#: Viruses whose hits are told apart from the one under study (fixed values).
OTHER_VIRUSES = ("EBV", "InfluenzaA", "SARS-CoV-2", "HIV-1", "YFV", "HCV", "HSV-2", "DENV1", "DENV2", "DENV3/4", "HPV")


def human_beta(database: DataFrame) -> DataFrame:
    """(cdr3, antigen, epitope) of human beta chains in a table (species, gene, cdr3, antigen, epitope); the epitope is named with its antigen."""
    rows = database.where("species = 'HomoSapiens' and gene = 'TRB'")
    for x in ("antigen", "epitope"):
        rows = rows if x in rows.columns else rows.withColumn(x, F.lit(""))
    return rows.select("cdr3", "antigen", F.concat("antigen", F.lit(":"), "epitope").alias("epitope")).distinct()


def antigen_hits(members: DataFrame, database: DataFrame, antigens: tuple[str, ...] | None = None) -> DataFrame:
    """(type, tag, hit): whether any member is known for one of the antigens, or for any."""
    known = human_beta(database)
    known = (known.where(F.col("antigen").isin(*antigens)) if antigens else known).select("cdr3").distinct().withColumn("hit", F.lit(1))
    return members.join(known, "cdr3", "left").groupBy("type", "tag").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))


def epitopes_of(members: DataFrame, database: DataFrame, by: list[str], antigen: str | None = None) -> DataFrame:
    """(*by, epitopes): the known epitopes of the members, sorted and joined by semicolons."""
    known = human_beta(database)
    known = known.where(F.col("antigen") == antigen) if antigen else known
    return members.join(known, "cdr3").groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("epitope")), ";").alias("epitopes"))


def hit_table(tested: DataFrame, hits: DataFrame, most_q: float = 0.05) -> DataFrame:
    """One row: tested groups with and without a hit, significant or not, their shares, odds ratio and one-sided p."""
    rows = tested.where("assoc_p is not null").join(hits, ["type", "tag"]).withColumn("s", (F.col("assoc_q") <= most_q).cast("int"))
    cells = {"sig_hit": "s * hit", "sig_miss": "s * (1 - hit)", "rest_hit": "(1 - s) * hit", "rest_miss": "(1 - s) * (1 - hit)"}
    one = rows.agg(*[F.coalesce(F.sum(F.expr(x)), F.lit(0)).cast("long").alias(k) for k, x in cells.items()])
    share = lambda hit, miss: F.round(F.expr(f"{hit} / greatest(1, {hit} + {miss})"), 6)
    return one.withColumn("sig_share", share("sig_hit", "sig_miss")).withColumn("rest_share", share("rest_hit", "rest_miss")).withColumn("odds_ratio", F.round(stats.odds_ratio(*cells), 3)).withColumn("fisher_p", stats.fisher_greater(*cells))


def top_associated(found: DataFrame, members: DataFrame, database: DataFrame, most_q: float = 0.05, antigen: str | None = None) -> DataFrame:
    """Significant groups by p, type and tag: donors, p, q, size and the known epitopes of members ('-' for none). The order is the sink's to keep."""
    rows = found.where((F.col("assoc_p").isNotNull()) & (F.col("assoc_q") <= most_q)).join(epitopes_of(members, database, ["type", "tag"], antigen), ["type", "tag"], "left")
    sizes = members.groupBy("type", "tag").agg(F.count("*").alias("members"))
    rows = rows.join(sizes, ["type", "tag"]).select("type", "tag", "case_donors", "control_donors", "assoc_p", "assoc_q", "members", F.coalesce("epitopes", F.lit("-")).alias("epitopes"))
    return rows.orderBy("assoc_p", "type", "tag")


def families(members: DataFrame) -> DataFrame:
    """(tag, family): groups that share a sequence, directly or through others; named by their least tag."""
    pairs = members.select("tag", "cdr3").distinct()
    heads = pairs.groupBy("cdr3").agg(F.min("tag").alias("b"))
    found = connected_components(pairs.join(heads, "cdr3").select(F.col("tag").alias("a"), "b"))
    return pairs.select("tag").distinct().join(found, F.col("tag") == F.col("node"), "left").select("tag", F.coalesce("component", "tag").alias("family"))


def family_report(groups: DataFrame, family: DataFrame, members: DataFrame, p: str, database: DataFrame | None = None) -> DataFrame:
    """Of each family: best p and tag (with its donors, if counted), groups, distinct sequences, and with a database whether any is known, and for what."""
    donors = [x for x in ("case_donors", "control_donors") if x in groups.columns]
    best = groups.join(family, "tag").groupBy("family").agg(F.min(p).alias("best_p"), F.min_by(F.struct("tag", *donors), F.struct(p, "tag")).alias("b"), F.count("*").alias("groups"))
    best = best.select("family", "best_p", F.col("b.tag").alias("best_tag"), "groups", *[f"b.{x}" for x in donors])
    own = members.join(family, "tag").select("family", "cdr3").distinct()
    out = best.join(own.groupBy("family").agg(F.count("*").alias("cdr3s"), F.array_join(F.array_sort(F.collect_list("cdr3")), " ").alias("members")), "family")
    if database is None:
        return out
    return out.join(epitopes_of(own, database, ["family"]), "family", "left").withColumn("epitopes", F.coalesce("epitopes", F.lit("-")))


def size_matched(groups: DataFrame, hits: DataFrame, chosen: DataFrame, cap: int = 40) -> DataFrame:
    """One row: observed hits of the chosen groups, those expected from the other groups of their sizes (all above cap together), their ratio, and the Poisson p of as many."""
    rows = groups.join(hits, ["type", "tag"]).join(chosen.select("tag", F.lit(1).alias("chosen")), "tag", "left").select(F.least("cluster_size", F.lit(cap)).alias("bin"), "hit", F.coalesce("chosen", F.lit(0)).alias("chosen"))
    bins = rows.groupBy("bin").agg(F.sum("chosen").alias("n"), F.sum(F.col("chosen") * F.col("hit")).alias("seen"), F.sum(1 - F.col("chosen")).alias("rest"), F.sum((1 - F.col("chosen")) * F.col("hit")).alias("rest_hits"))
    one = bins.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("observed"), F.coalesce(F.sum(F.expr("if(rest > 0, n * rest_hits / rest, 0D)")), F.lit(0.0)).alias("expected"))
    return one.withColumn("ratio", F.expr("if(expected > 0, round(observed / expected, 3), cast(null as double))")).withColumn("poisson_p", stats.poisson_upper("observed", "expected"))


def family_hla(family: DataFrame, members: DataFrame, rows: DataFrame, hla: DataFrame) -> DataFrame:
    """(family, allele, carriers_with, carriers, others_with, others, p, q): Fisher of carriers against the other typed donors, q over all tests."""
    typed = hla.distinct()
    donors = rows.where("subject is not null").select("subject").distinct().join(typed.select("subject").distinct(), "subject", "left_semi")
    carriers = members.join(family, "tag").select("family", "cdr3").distinct().join(rows.select("cdr3", "subject").distinct(), "cdr3").select("family", "subject").distinct().join(donors, "subject", "left_semi")
    alleles = typed.join(donors, "subject", "left_semi")
    sizes = carriers.groupBy("family").agg(F.count("*").alias("carriers"))
    background = alleles.groupBy("allele").agg(F.count("*").alias("bg"))
    seen = carriers.join(alleles, "subject").groupBy("family", "allele").agg(F.count("*").alias("carriers_with"))
    whole = donors.agg(F.count("*").alias("n")).withColumn("_j", F.lit(1))
    tests = seen.join(sizes, "family").join(background, "allele").join(F.broadcast(whole), F.lit(1) == F.col("_j"))
    tests = stats.with_upper_tail(tests, "p", "carriers_with", "bg", "n - bg", "carriers")
    tests = tests.select("family", "allele", "carriers_with", "carriers", (F.col("bg") - F.col("carriers_with")).alias("others_with"), (F.col("n") - F.col("carriers")).alias("others"), "p")
    return stats.benjamini_hochberg(tests, "p", "q")


def family_hla_best(tests: DataFrame) -> DataFrame:
    """Of each family its test of least p, ties by allele, with the shares of carriers and others who have the allele."""
    share = lambda a, b: F.round(F.expr(f"{a} / greatest(1, {b})"), 3)
    best = tests.groupBy("family").agg(F.min_by(F.struct("allele", "carriers_with", "carriers", "others_with", "others", "p", "q"), F.struct("p", "allele")).alias("b")).select("family", "b.*")
    return best.withColumn("carrier_share", share("carriers_with", "carriers")).withColumn("other_share", share("others_with", "others"))


def group_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """By type, and of all together: tags of either side, of both and of one only, with equal members, the share of left's that is equal, and the mean Jaccard likeness of members of shared tags. Sides: (type, tag, cdr3)."""
    a = left.groupBy("type", "tag").agg(F.collect_set("cdr3").alias("x"))
    b = right.groupBy("type", "tag").agg(F.collect_set("cdr3").alias("y"))
    both = a.join(b, ["type", "tag"], "full_outer")
    jaccard = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    in_both = F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = both.select(F.explode(F.array("type", F.lit("all"))).alias("type"), F.col("x").isNotNull().cast("int").alias("l"), F.col("y").isNotNull().cast("int").alias("r"), in_both.cast("int").alias("b"), F.when(in_both, jaccard).alias("j"))
    sums = rows.groupBy("type").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum("b").alias("n_shared"), F.sum((F.coalesce("j", F.lit(0.0)) == 1).cast("int")).alias("n_exact"), F.avg("j").alias("mean_jaccard"))
    return sums.withColumn("only_left", F.col("n_left") - F.col("n_shared")).withColumn("only_right", F.col("n_right") - F.col("n_shared")).withColumn("exact_share", F.expr("if(n_left > 0, round(n_exact / n_left, 6), cast(null as double))"))


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """(type, tag, members, side) of the groups that only one side has with just these members; none where they agree."""
    both = left.select("type", "tag", "cdr3", F.lit(True).alias("_l")).unionByName(right.select("type", "tag", "cdr3", F.lit(False).alias("_l")))
    own = lambda side: F.array_join(F.array_sort(F.collect_set(F.when(side, F.col("cdr3")))), " ")
    is_left, is_right = F.col("_l"), ~F.col("_l")
    met = both.groupBy("type", "tag").agg(own(is_left).alias("a"), own(is_right).alias("b"), F.bool_or(is_left).alias("in_a"), F.bool_or(is_right).alias("in_b")).where("a <> b or in_a <> in_b")
    sides = [F.when(F.col(there), F.struct(F.col(x).alias("members"), F.lit(side).alias("side"))) for there, x, side in (("in_a", "a", "left"), ("in_b", "b", "right"))]
    return met.select("type", "tag", F.explode(F.array_compact(F.array(*sides))).alias("_s")).select("type", "tag", "_s.members", "_s.side")
