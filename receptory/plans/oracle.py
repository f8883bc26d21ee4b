"""DuckDB SQL of the catalog's queries, put together from named parts."""

from __future__ import annotations

import re

from receptory.functions.scalars import AMINO_ACIDS, COMPATIBLE
from receptory.plans.fixtures import HLA, tcr_sql

PAIRS = ", ".join(f"('{AMINO_ACIDS[i]}', '{AMINO_ACIDS[j]}')" for i in range(20) for j in range(20) if COMPATIBLE[i] >> j & 1)


def tail(x: str, m: str, n: str, k: str) -> str:
    """P(X >= x) by the sum of all terms."""
    choose = lambda a, b: f"(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"
    term = f"exp({choose(m, 'i')} + {choose(n, f'({k} - i)')} - {choose(f'({m} + {n})', k)})"
    return f"case when {x} <= greatest(0, {k} - {n}) then 1 when {x} > least({k}, {m}) then 0 else least(1, list_sum(list_transform(range(cast(greatest({x}, {k} - {n}) as bigint), cast(least({k}, {m}) + 1 as bigint)), lambda i: {term}))) end"


def score(p: str) -> str:
    return f"round(0 - log10(greatest({p}, 1e-300)), 3) + 0.0"


def windows(core: str, source: str, lengths: tuple[int, ...], carry: str, gaps: bool = False) -> str:
    parts = [f"select {carry}, substr({core}, i, {k}) as motif, i as start from (select *, unnest(range(1, length({core}) - {k} + 2)) as i from {source})" for k in lengths]
    if gaps:
        parts += [f"select {carry}, substr({core}, i, g) || '%' || substr({core}, i + g + 1, {k} - g) as motif, i as start from (select *, unnest(range(1, length({core}) - {k} + 1)) as i from {source}), (select unnest(range(1, {k})) as g)" for k in lengths]
    return " union all ".join(parts)


def bh(source: str, p: str, by: str = "1") -> str:
    """(by, p, q) of a table's p-values."""
    return f"select b, p, least(1, min(p * total / r) over (partition by b order by p rows between current row and unbounded following)) as q from (select b, p, sum(c) over (partition by b order by p) as r, sum(c) over (partition by b) as total from (select {by} as b, {p} as p, count(*) as c from {source} where {p} is not null group by 1, 2))"


CTES = {
    "tcr": tcr_sql(),
    "rows": "select * from tcr where role = 'sample'",
    "raw": """select row_idx, case when row_idx % 7 = 0 then '  ' || lower(cdr3) when row_idx % 11 = 0 then cdr3 || '*' when row_idx % 13 = 0 then '' else cdr3 end as cdr3,
      case when row_idx % 5 = 0 then 'NA' when row_idx % 9 = 0 then ' ' else v_gene end as v_gene,
      case when row_idx % 6 = 0 then '0.25' when row_idx % 10 = 0 then 'many' when row_idx % 15 = 1 then cast(count as varchar) || '.9' else cast(count as varchar) end as count from tcr""",
    "seqs": "select cdr3, max(cast(role = 'sample' as int)) as s, max(cast(role = 'reference' as int)) as r from tcr where length(cdr3) >= 7 and cdr3 like 'C%F' group by cdr3",
    "cores": "select *, substr(cdr3, 4, length(cdr3) - 6) as core from seqs",
    "tot": "select sum(s) as ns, sum(r) as nr, max(case when s = 1 then length(cdr3) end) as longest from seqs",
    "margins": "select distinct cast(l_orderkey % 9 as bigint) as a, cast(l_partkey % 12 as bigint) as b, cast(l_suppkey % 7 as bigint) as c, cast(l_linenumber + l_orderkey % 5 as bigint) as d from lineitem",
    "occ": windows("core", "cores", (2, 3, 4), "cdr3, s, r"),
    "gapped": windows("core", "cores", (2, 3), "cdr3, s, r", True),
    "counts": "select motif, cast(sum(s) as bigint) as num_in_sample, cast(sum(r) as bigint) as num_in_ref from occ group by motif",
    "mstat": f"select *, sign(f) * floor(abs(f) * 10 + 0.5) / 10 as num_fold, cast(printf('%.1e', p) as double) as fisher from (select *, num_in_sample / (num_in_ref + 0.01) / ns * nr as f, {tail('num_in_sample', '(num_in_ref + num_in_sample)', '(nr + ns - num_in_ref - num_in_sample)', 'ns')} as p from counts, tot where num_in_sample > 0)",
    "chosen": "select * from mstat where num_fold >= 10 and fisher <= 0.01 and num_in_sample >= 3",
    "found": "select motif, cdr3, start, length(motif) as size from occ join chosen using (motif) where s = 1",
    "following": "select a.motif, a.cdr3, a.start, min(b.start) as next from found a left join found b on a.motif = b.motif and a.cdr3 = b.cdr3 and b.start >= a.start + a.size group by all",
    "hits": "select motif, cdr3, min(start) as start from found group by motif, cdr3 union all select f.motif, f.cdr3, f.next from hits h join following f using (motif, cdr3, start) where f.next is not null",
    "chainrows": "select motif, start, sum(new) over (partition by motif order by start) as chain from (select motif, start, cast(coalesce(start - lag(start) over (partition by motif order by start) > 2, false) as int) as new from (select distinct motif, start from hits))",
    "chains": "select motif, chain, min(start) as low, max(start) as high, count(*) over (partition by motif) as n from chainrows group by motif, chain",
    "lmembers": "select distinct motif, cdr3, motif || '_' || cast(case when n = 1 then 1 else low end + 3 as varchar) || '_' || cast(case when n = 1 then longest - 6 else high end + 3 as varchar) as tag from hits join chains using (motif), tot where start between low and high",
    "lgroups": f"select 'local' as type, tag, size as cluster_size, size as unique_cdr3_sample, num_in_ref as unique_cdr3_ref, num_fold as ove, cast(printf('%.1e', {tail('size', '(num_in_ref + size)', '(nr + ns - num_in_ref - size)', 'ns')}) as double) as p from (select motif, tag, count(*) as size from lmembers group by motif, tag having count(*) >= 2) join chosen using (motif)",
    "masks": "select cdr3, s, r, substr(core, 1, i - 1) || '%' || substr(core, i + 1) as mask, substr(core, i, 1) as residue from (select *, unnest(range(1, length(core) + 1)) as i from cores)",
    "mg": "select mask, cast(sum(s) as bigint) as n_s, cast(sum(r) as bigint) as n_r from masks group by mask having sum(s) >= 2",
    "plain": "select mask, cdr3, residue, n_r, 0 as part, '' as v from masks join mg using (mask) where s = 1",
    "compat": f"select * from (values {PAIRS}) as t(x, y)",
    "present": "select distinct mask, residue from plain",
    "reach": "select mask, residue, residue as spot from present union select r.mask, r.residue, p.residue from reach r join compat c on c.x = r.spot join present p on p.mask = r.mask and p.residue = c.y",
    "parts": f"select mask, residue, min(instr('{AMINO_ACIDS}', spot)) as part from reach group by mask, residue",
    "blosum": "select p.mask, p.cdr3, p.residue, n_r, q.part, '' as v from plain p join parts q using (mask, residue)",
    "vgenes": "select b.mask, b.cdr3, b.residue, n_r, b.part, coalesce(g.v_gene, 'NA') as v from blosum b join (select distinct cdr3, v_gene from rows) g using (cdr3)",
}
for _name, _nodes in (("plain", "plain"), ("blosum", "blosum"), ("vgenes", "vgenes")):
    CTES[f"{_name}_parts"] = f"select mask, v, part, count(*) as cluster_size, count(distinct cdr3) as u, max(n_r) as n_r, string_agg(distinct residue, '' order by residue) as found from {_nodes} group by mask, v, part having count(*) >= 2"
    CTES[f"{_name}_tagged"] = f"select *, mask || '_' || case when v <> '' then v || '_' else '' end || found as tag from {_name}_parts"
    CTES[f"{_name}_members"] = f"select distinct 'global' as type, tag, n.cdr3, cluster_size from {_nodes} n join {_name}_tagged g using (mask, v, part)"
    CTES[f"{_name}_groups"] = f"select 'global' as type, tag, cluster_size, u as unique_cdr3_sample, n_r as unique_cdr3_ref, cast(0 as double) as ove, {tail('u', '(n_r + u)', '(nr + ns - n_r - u)', 'ns')} as p from {_name}_tagged, tot"
_FULL = (1 << 64) - 1


def _generator(seed: int) -> dict[str, str]:
    """Labels shuffled by the seeded generator: the state of step k, its word, and the swaps from the last place down."""
    start = seed * 0x9E3779B97F4A7C15 & _FULL | 1
    a = "xor(x, x >> 12)"
    b = f"xor(x, (x << 25) & {_FULL}::hugeint)"
    c = "xor(x, x >> 27)"
    high, low = "(x >> 32)", f"(x & {(1 << 32) - 1}::hugeint)"
    times = 0x2545F4914F6CDD1D
    word = f"((((({high} * {times}::hugeint) & {(1 << 32) - 1}::hugeint) << 32) + {low} * {times}::hugeint) & {_FULL}::hugeint)"
    step = f"select k, {c} as x from (select k, {b} as x from (select k, {a} as x from (select k + 1 as k, x from states where k < 1000)))"
    return {
        "states": f"select 0 as k, {start}::hugeint as x union all {step}",
        "words": f"select k, {word} as w from states where k > 0",
        "shuffled": "select n - 1 as i, labels from labels0 union all select i - 1, list_transform(range(1, len(labels) + 1), lambda p: case when p = i + 1 then labels[j + 1] when p = j + 1 then labels[i + 1] else labels[p] end) from (select s.i, s.labels, cast(w % (s.i + 1) as bigint) as j from shuffled s join labels0 on true join words on k = n - s.i where s.i > 0)",
        "pclasses": "select unnest(names) as subject, unnest((select labels from shuffled where i = 0)) as is_case from labels0",
        "pcount": "select tag, coalesce(sum(is_case), 0) as x, coalesce(sum(1 - is_case), 0) as y from plain_tagged left join gdonors using (tag) left join pclasses using (subject) group by tag",
        "ptested": f"select *, case when x + y >= 2 then {tail('x', '(x + y)', '(nc + nk - x - y)', 'nc')} end as p from pcount, ctotal",
        "passoc_q": bh("ptested", "p"),
    }


CTES |= _generator(20261006)
CTES |= {
    "gdonors": "select distinct tag, subject from plain_members join rows using (cdr3)",
    "dcounts": "select tag, count(*) as n_subjects from gdonors group by tag",
    "classes": "select distinct subject, cast(subject like '%:CMV+' as int) as is_case from rows where subject like '%:CMV+' or subject like '%:CMV-'",
    "ctotal": "select sum(is_case) as nc, sum(1 - is_case) as nk from classes",
    "ccount": "select tag, coalesce(sum(is_case), 0) as x, coalesce(sum(1 - is_case), 0) as y from plain_tagged left join gdonors using (tag) left join classes using (subject) group by tag",
    "tested": f"select *, case when x + y >= 2 then {tail('x', '(x + y)', '(nc + nk - x - y)', 'nc')} end as p from ccount, ctotal",
    "assoc_q": bh("tested", "p"),
    "typed": HLA.format(tcr="rows"),
    "hbg": "select allele, count(distinct subject) as bg from typed group by allele",
    "hn": "select count(distinct subject) as n from typed",
    "carriers": "select tag, subject from gdonors where subject in (select subject from typed)",
    "hsize": "select tag, count(*) as k from carriers group by tag having count(*) >= 2",
    "htests": f"select *, {tail('w', 'bg', '(n - bg)', 'k')} as p from (select tag, allele, count(*) as w from carriers join typed using (subject) group by tag, allele) join hsize using (tag) join hbg using (allele), hn",
    "hbest": "select tag, max(k) as hla_donors, least(1, min(p) * count(*)) as p from htests group by tag",
    "hq": bh("hbest", "p"),
    "ids": "select cdr3, row_number() over (order by min(row_idx), cdr3) - 1 as seq_id from rows group by cdr3",
    "idmasks": "select seq_id, p as position, substr(cdr3, 1, p) || '%' || substr(cdr3, p + 2) as mask from (select *, unnest(range(0, length(cdr3))) as p from ids)",
    "idmasks3": "select seq_id, p as position, substr(cdr3, 1, p) || '%' || substr(cdr3, p + 2) as mask from (select *, unnest(range(3, length(cdr3) - 3)) as p from ids where length(cdr3) > 6)",
    "edges": "select a.seq_id as a, b.seq_id as b, a.position from idmasks a join idmasks b on a.mask = b.mask and a.seq_id < b.seq_id",
    "edges3": "select a.seq_id as a, b.seq_id as b, a.position from idmasks3 a join idmasks3 b on a.mask = b.mask and a.seq_id < b.seq_id",
    "both3": "select a, b from edges3 union select b, a from edges3",
    "cc": "select seq_id as node, seq_id as root from ids where seq_id in (select a from both3) union select b, root from cc join both3 on a = node where root < b",
    "croots": "select node, min(root) as root from cc group by node",
    "csizes": "select root, count(*) as size from croots group by root",
    "trims": "select cdr3, role, substr(cdr3, 4, length(cdr3) - 6) as core from (select distinct cdr3, role from tcr) where length(cdr3) > 6",
    "carry": f"select distinct cdr3, role, motif from ({windows('core', 'trims', (2, 3, 4), 'cdr3, role')})",
    "m2": "select motif, count(*) filter (role = 'sample') as input_count, count(*) filter (role = 'reference') as reference_count from carry group by motif having count(*) filter (role = 'sample') >= 3",
    "sizes2": "select count(distinct cdr3) filter (role = 'sample') as n_in, count(distinct cdr3) filter (role = 'reference') as n_ref from tcr",
    "m2p": f"select *, case when reference_count = 0 then cast('Infinity' as double) else (input_count / n_in) / (reference_count / n_ref) end as fold, {tail('input_count', '(input_count + reference_count)', '(n_in + n_ref - input_count - reference_count)', 'n_in')} as p from m2, sizes2",
    "m2q": bh("m2p", "p"),
    "p2": f"select * from m2p where fold >= 10 and p <= 0.001",
    "p2carry": "select c.motif, seq_id from carry c join p2 using (motif) join ids using (cdr3) where role = 'sample'",
    "star": "select seq_id as a, min(seq_id) over (partition by motif) as b from p2carry union select a, b from edges3",
    "both4": "select a, b from star where a <> b union select b, a from star where a <> b",
    "cc4": "select seq_id as node, seq_id as root from ids where seq_id in (select a from both4) union select b, root from cc4 join both4 on a = node where root < b",
    "croots4": "select node, min(root) as root from cc4 group by node",
    "m2d": "select *, case length(motif) when 2 then 1000 when 3 then 100 else 10 end as least from m2p",
    "p2d": "select * from m2d where fold >= least and p <= 0.001",
    "antigens": "select distinct cdr3, case when row_idx % 3 = 0 then 'CMV' else 'EBV' end as antigen, v_gene as epitope from rows where row_idx % 50 = 0",
    "atested": "select t.*, z.q, hit from tested t join assoc_q z on z.p = t.p join (select tag, max(cast(cdr3 in (select cdr3 from antigen) as int)) as hit from plain_members group by tag) using (tag)",
    "acells": "select coalesce(sum(s * hit), 0) as sig_hit, coalesce(sum(s * (1 - hit)), 0) as sig_miss, coalesce(sum((1 - s) * hit), 0) as rest_hit, coalesce(sum((1 - s) * (1 - hit)), 0) as rest_miss from (select *, cast(q <= 0.999 as int) as s from atested)",
    "lost": "select sum(c) as n, sum(c * hit) as seen, sum(1 - c) as rest, sum((1 - c) * hit) as rest_hits from (select g.cluster_size, cast(n_subjects >= 4 as int) as c, hit from plain_tagged g join dcounts using (tag) join (select tag, max(cast(cdr3 in (select cdr3 from antigen) as int)) as hit from plain_members group by tag) using (tag)) group by least(cluster_size, 40)",
    "matched": "select sum(seen) as observed, sum(case when rest > 0 then n * rest_hits / rest else 0 end) as expected from lost",
    # the seeded generator, one word a row: x ^= x >> 12, x ^= x << 25, x ^= x >> 27, times a constant, in 64 bits
    "donors1": "select subject, min(row_idx) as first from rows where subject like '%:CMV+' or subject like '%:CMV-' group by subject",
    "labels0": "select list(cast(subject like '%:CMV+' as int) order by first) as labels, list(subject order by first) as names, count(*) as n from donors1",
    "big": "select * from plain_tagged where cluster_size >= 4",
    "bigm": "select distinct tag, cdr3 from plain_members where cluster_size >= 4",
    "antigen": "select distinct cdr3 from rows where row_idx % 50 = 0",
    "link": "select distinct a.tag as a, b.tag as b from bigm a join bigm b using (cdr3)",
    "fam": "select tag, tag as root from big union select b, root from fam join link on a = tag where root < b",
    "family": "select tag, min(root) as family from fam group by tag",
    "fcar": "select distinct family, subject from bigm join family using (tag) join rows using (cdr3) where subject in (select subject from typed)",
    "fsize": "select family, count(*) as carriers from fcar group by family",
    "ftests": f"select *, {tail('w', 'bg', '(n - bg)', 'carriers')} as p from (select family, allele, count(*) as w from fcar join typed using (subject) group by family, allele) join fsize using (family) join hbg using (allele), hn",
    "fq": bh("ftests", "p"),
}


def group_select(name: str, members: bool = True) -> str:
    people = f"{name}_members" if name != "l" else "lmembers"
    source = f"{name}_groups" if name != "l" else "lgroups"
    last = ", m.members" if members else ""
    return (
        f"select type, g.tag, cast(cluster_size as bigint) as cluster_size, cast(unique_cdr3_sample as bigint) as unique_cdr3_sample, cast(unique_cdr3_ref as bigint) as unique_cdr3_ref, ove, {score('g.p')} as fisher_score, {score('q')} as fdr_q, coalesce(n, 0) as n_subjects{last} "
        f"from {source} g join ({bh(source, 'p')}) z on z.p = g.p join (select tag, string_agg(cdr3, ' ' order by cdr3) as members from (select distinct tag, cdr3 from {people}) group by tag) m on m.tag = g.tag "
        f"left join (select tag, count(distinct subject) as n from {people} join rows using (cdr3) group by tag) d on d.tag = g.tag"
    )


def sql(final: str) -> str:
    """The parts that final needs, each after those it needs itself, and final."""
    placed: dict[str, str] = {}

    def place(text: str, inside: tuple[str, ...]) -> None:
        for k in sorted(set(re.findall(r"\w+", text)) & CTES.keys()):
            if k not in placed and k not in inside:
                place(CTES[k], (*inside, k))
                placed[k] = CTES[k]

    place(final, ())
    return "with recursive " + ",\n".join(f"{k} as ({v})" for k, v in placed.items()) + "\n" + final


def group_rows(name: str, members: bool = True) -> str:
    return sql(group_select(name, members))


def diff(left: str, right: str) -> str:
    """Comparison of two sets of (type, tag, cdr3), by type and of all."""
    lists = lambda x, c: f"select type, tag, list(distinct cdr3 order by cdr3) as {c} from ({x}) group by type, tag"
    shared = "x is not null and y is not null"
    return (
        f"select kind as type, count(x) as n_left, count(y) as n_right, count(*) filter ({shared}) as n_shared, count(x) - count(*) filter ({shared}) as only_left, count(y) - count(*) filter ({shared}) as only_right, count(*) filter (x = y) as n_exact, "
        f"case when count(x) > 0 then round(count(*) filter (x = y) / count(x), 6) end as exact_share, round(avg(case when {shared} then len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end), 6) as mean_jaccard "
        f"from (select unnest([type, 'all']) as kind, x, y from ({lists(left, 'x')}) a full join ({lists(right, 'y')}) b using (type, tag)) group by kind"
    )


ORACLE_SQL = {
    "normalize_cdr3": sql(f"select row_idx, case when regexp_full_match(upper(trim(cdr3)), '[{AMINO_ACIDS}]+') then upper(trim(cdr3)) end as cdr3 from raw"),
    "missing_fields": sql("select row_idx, nullif(nullif(trim(v_gene), ''), 'NA') as v_gene from raw"),
    "count_coercion": sql("select row_idx, coalesce(case when try_cast(count as double) >= 1 then cast(floor(try_cast(count as double)) as bigint) end, 1) as count from raw"),
    "header_alias": sql("select row_idx, cdr3, v_gene, cast(null as varchar) as j_gene, subject, count from rows"),
    "working_set": sql("select cdr3, s as in_sample, r as in_reference from seqs"),
    "dedup_first_seen": sql("select cdr3, seq_id from ids"),
    "hla_wide_to_long": sql("select distinct subject, allele from typed"),
    "pool_repertoires": sql("select row_idx, cdr3, v_gene, j_gene, subject, count from rows where row_idx % 17 <> 0 and (subject like '%:CMV+' or subject like '%:CMV-')"),
    "fisher_p": sql(f"select a, b, c, d, {score(tail('a', '(a + c)', '(b + d)', '(a + b)'))} as p from margins"),
    "hypergeom_tail": sql(f"select x, m, n, k, {score(tail('x', 'm', 'n', 'k'))} as p from (select distinct a as x, a + b * 50 as m, c * 1000 + d as n, a + b + c as k from margins) where k <= m + n"),
    "bh_qvalues": f"with t as (select l_orderkey * 8 + l_linenumber as id, l_returnflag as kind, (l_partkey * 7919 + l_suppkey * 31) % 10000 / 10000 * ((l_orderkey % 100 + 1) / 100) as p from lineitem) select id, kind, round(q, 9) as q from t join ({bh('t', 'p', 'kind')}) z on z.b = kind and z.p = t.p",
    "poisson_tail": sql("select k, rate, round(case when k <= 0 then 1 else greatest(0, 1 - list_sum(list_transform(range(k), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1))))) end, 9) as p from (select distinct a as k, (b + 1) / 2 as rate from margins)"),
    "odds_ratio": sql("select a, b, c, d, round((a + e) * (d + e) / ((b + e) * (c + e)), 6) as odds from (select *, cast(0.5 as double) as e from margins)"),
    "motif_occurrence_counts": sql("select * from counts"),
    "gapped_motif_counts": sql("select motif, cast(sum(s) as bigint) as num_in_sample, cast(sum(r) as bigint) as num_in_ref from gapped group by motif"),
    "motif_sequence_counts": sql("select motif, count(*) as n from carry where role = 'sample' group by motif"),
    "motif_fold": sql("select motif, num_fold from mstat"),
    "motif_enrichment_p1": sql(f"select motif, num_in_sample, num_in_ref, {score('fisher')} as fisher_score, num_fold from chosen"),
    "motif_enrichment_p2": sql(f"select motif, cast(length(motif) as bigint) as k, input_count, reference_count, round(fold, 6) as fold, {score('p')} as p from m2p where fold >= 10 and p <= 0.001"),
    "motif_bh_fdr": sql(f"select motif, {score('q')} as q from m2p join m2q using (p)"),
    "motif_positions_nonoverlap": sql("select motif, cdr3, start from hits"),
    "local_groups": group_rows("l", False),
    "local_group_members": sql("select distinct 'local' as type, tag, cdr3 from lmembers where tag in (select tag from lgroups)"),
    "reference_mask_counts": sql("select mask, n_s, n_r from mg"),
    "global_groups_all_aa": group_rows("plain"),
    "global_groups_blosum": group_rows("blosum"),
    "global_groups_vgene": group_rows("vgenes"),
    "group_donor_counts": sql("select tag, n_subjects from dcounts"),
    "association": sql(f"select tag, cast(x as bigint) as case_donors, cast(y as bigint) as control_donors, {score('t.p')} as assoc_p, {score('q')} as assoc_q from tested t left join assoc_q z on z.p = t.p"),
    "association_filtered": sql(f"select tag, cast(x as bigint) as case_donors, cast(y as bigint) as control_donors, {score('t.p')} as assoc_p, {score('q')} as assoc_q from tested t join assoc_q z on z.p = t.p where t.p <= 0.3"),
    "hla_scores": sql(f"select tag, hla_donors, {score('h.p')} as hla_p, {score('q')} as hla_q from hbest h join hq z on z.p = h.p"),
    "min_subjects_filter": sql("select tag, n_subjects from dcounts where n_subjects >= 4"),
    "global_p_filter": sql(f"select tag, {score('p')} as fisher_score from plain_groups where p <= 0.05"),
    "global_q_filter": sql(f"select tag, {score('q')} as fdr_q from plain_groups g join ({bh('plain_groups', 'p')}) z on z.p = g.p where q <= 0.6"),
    "top_groups": sql("select tag, cast(cluster_size as bigint) as cluster_size from plain_tagged order by cluster_size desc, tag limit 100"),
    "length_buckets": sql("select length(cdr3) as length, count(*) as n from ids group by 1"),
    "hamming_edges": sql("select a, b, position from edges"),
    "hamming_edges_trim": sql("select a, b, position from edges3"),
    "clusters": sql("select root as first_seq, size, n_local_edges from csizes join (select root, count(*) as n_local_edges from edges3 join croots on node = a group by root) using (root)"),
    "cluster_rows": sql("select dense_rank() over (order by root) - 1 as cluster_id, size as cluster_size, n_local_edges, '-' as motifs, cdr3, v_gene as TRBV, j_gene as TRBJ, subject, count from croots join csizes using (root) join (select root, count(*) as n_local_edges from edges3 join croots on node = a group by root) using (root) join ids on seq_id = node join rows using (cdr3)"),
    "clusters_with_motifs": sql("select root as first_seq, size, coalesce(n, 0) as n_local_edges, coalesce(motifs, '') as motifs from (select root, count(*) as size from croots4 group by root) left join (select root, count(*) as n from edges3 join croots4 on node = a group by root) using (root) left join (select root, string_agg(motif, ',' order by motif) as motifs from (select distinct root, motif from p2carry join croots4 on node = seq_id) group by root) using (root) where size >= 2"),
    "antigen_lookup": sql("select tag, cast(max(cast(cdr3 in (select cdr3 from antigen) as int)) as bigint) as hit from bigm group by tag"),
    "size_matched": sql(f"select cast(observed as bigint) as observed, round(expected, 6) as expected, case when expected > 0 then round(observed / expected, 3) end as ratio, {score("greatest(0, 1 - coalesce(list_sum(list_transform(range(cast(observed as bigint)), lambda i: exp(i * ln(expected) - expected - lgamma(i + 1)))), 0))")} as poisson_p from matched"),
    "families": sql("select tag, family from family"),
    "family_report": sql(f"select family, {score('best_p')} as best_p, groups, cdr3s, members, coalesce(epitopes, '-') as epitopes from (select family, min(p) as best_p, count(*) as groups from family join plain_groups using (tag) group by family) join (select family, count(distinct cdr3) as cdr3s, string_agg(distinct cdr3, ' ' order by cdr3) as members from family join bigm using (tag) group by family) using (family) left join (select family, string_agg(distinct antigen || ':' || epitope, ';' order by antigen || ':' || epitope) as epitopes from family join bigm using (tag) join antigens using (cdr3) group by family) using (family)"),
    "family_hla": sql(f"select family, allele, w as carriers_with, carriers, bg - w as others_with, n - carriers as others, {score('t.p')} as p, {score('q')} as q from ftests t join fq z on z.p = t.p"),
    "family_hla_best": sql(f"select family, allele, carriers, round(w / greatest(1, carriers), 3) as carrier_share, round((bg - w) / greatest(1, n - carriers), 3) as other_share, {score('p')} as p from ftests qualify row_number() over (partition by family order by p, allele) = 1"),
    "group_diff": sql(diff("select distinct 'local' as type, tag, cdr3 from lmembers where tag in (select tag from lgroups) union all select 'global', tag, cdr3 from plain_members", "select distinct 'local' as type, tag, cdr3 from lmembers join chosen using (motif) where num_in_sample >= 200 and tag in (select tag from lgroups) union all select 'global', tag, cdr3 from blosum_members")),
    "interface_agreement": "select 'none' as side, cast(0 as bigint) as n where false",
    "convergence_groups": sql(group_select("l") + " union all " + group_select("plain")),
    "association_permuted": sql(f"select tag, cast(x as bigint) as case_donors, cast(y as bigint) as control_donors, {score('t.p')} as assoc_p, {score('q')} as assoc_q from ptested t left join passoc_q z on z.p = t.p"),
    "benchmark_subset": sql("select cdr3, v_gene from (select cdr3, arg_min(v_gene, row_idx) as v_gene from rows where subject in (select subject from rows where subject is not null group by subject order by min(row_idx) limit 40) group by cdr3) order by md5(cdr3 || ':7') limit 2000"),
    "motif_enrichment_p1_default": sql(f"select motif, num_in_sample, num_in_ref, {score('fisher')} as fisher_score, num_fold from mstat where num_fold >= case length(motif) when 2 then 1000 when 3 then 100 else 10 end and fisher <= 0.01 and num_in_sample >= 3"),
    "motif_enrichment_p2_default": sql(f"select motif, cast(length(motif) as bigint) as k, input_count, reference_count, {score('p')} as p from p2d"),
    "motif_members": sql("select motif, cdr3 from carry join p2d using (motif) where role = 'sample'"),
    "motif_order": sql("select motif, row_number() over (order by length(motif), motif) as place from p2d"),
    "hla_best_allele": sql("select tag, allele as hla_allele, w as hla_with_allele from htests qualify row_number() over (partition by tag order by p, allele) = 1"),
    "hit_table": sql(f"select cast(sig_hit as bigint) as sig_hit, cast(sig_miss as bigint) as sig_miss, cast(rest_hit as bigint) as rest_hit, cast(rest_miss as bigint) as rest_miss, round(sig_hit / greatest(1, sig_hit + sig_miss), 6) as sig_share, round(rest_hit / greatest(1, rest_hit + rest_miss), 6) as rest_share, round((sig_hit + 0.5) * (rest_miss + 0.5) / ((sig_miss + 0.5) * (rest_hit + 0.5)), 3) as odds_ratio, {score(tail('sig_hit', '(sig_hit + rest_hit)', '(sig_miss + rest_miss)', '(sig_hit + sig_miss)'))} as fisher_p from acells"),
    "top_associated": sql(f"select 'global' as type, t.tag, cast(x as bigint) as case_donors, cast(y as bigint) as control_donors, {score('t.p')} as assoc_p, {score('q')} as assoc_q, members, coalesce(epitopes, '-') as epitopes from atested t join (select tag, count(*) as members from plain_members group by tag) using (tag) left join (select tag, string_agg(distinct antigen || ':' || epitope, ';' order by antigen || ':' || epitope) as epitopes from plain_members join antigens using (cdr3) where antigen = 'CMV' group by tag) using (tag) where q <= 1"),
    "run_totals": sql("select unnest(['rows', 'unique', 'n_sample', 'n_reference', 'motifs', 'local_groups', 'global_groups', 'n_case', 'n_control', 'assoc_tested', 'assoc_q05', 'hla_typed_donors', 'hla_scored', 'hla_tests', 'hla_q05']) as name, unnest([(select count(*) from rows), (select count(distinct cdr3) from rows), cast((select ns from tot) as bigint), cast((select nr from tot) as bigint), 0, 0, (select count(*) from tested where p <= 0.01), cast((select nc from ctotal) as bigint), cast((select nk from ctotal) as bigint), (select count(p) from tested), (select count(*) from tested t join assoc_q z on z.p = t.p where z.q <= 0.05), (select n from hn), (select count(*) from hbest), (select count(*) from htests), (select count(*) from hbest h join hq z on z.p = h.p where z.q <= 0.05)]) as value"),
    "hamming_distance": sql("select row_idx, cast(case when length(cdr3) = length(other) then list_sum(list_transform(range(1, length(cdr3) + 1), lambda i: cast(substr(cdr3, i, 1) <> substr(other, i, 1) as int))) end as bigint) as distance from (select row_idx, cdr3, lead(cdr3) over (partition by subject order by row_idx, cdr3) as other from rows) where other is not null"),
}
