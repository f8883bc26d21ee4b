"""Line dedup by content-defined line chunks, in built-in functions only.

A text is cut into short lines by what stands in it: at line breaks, after
sentence ends, and after words with certain letters, so inside long sentences
and in text without punctuation too.  A line's hash is its length in bytes; a
rolling hash over two of them is taken at each line, and where it is less than
at both neighbours a chunk begins.  So chunks have two lines or more, mostly three, and depend on nearby
content only: what is inserted before a passage does not shift its chunks.

Of chunks with equal text the first by doc_id and place leads.  Equal keys are
only a hint: each other chunk's bytes are compared with the first's, and then
line by line what stands before and after both, as far as the neighbouring
chunks go, which are known not to match whole.  Ranges of lines found equal
that touch are one region; a region of MIN_CHARS characters or more is removed.
Each removed line thus has an equal one earlier that its place refers to, and
so the first of them stays.  White space at the ends of lines is not compared.

The counts of keys are aggregated before they are shuffled; only chunks whose
key occurs again are brought together, a frequent key's in shares with a copy of
the first each, and only documents that lose text are put together anew.

Edge cases: a null text stays null and an empty one empty; a document all of
whose text came before keeps its row with an empty text; rows equal in doc_id
and text are one document, and are kept or cut alike; rows of one doc_id, or of
none, with different texts are different documents, ordered by a hash of the
text; a null doc_id sorts last; doc_id is an integer column; other columns pass
unchanged, but for n_chars, which is set anew; columns of the input named as
those added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from receptory.llm.bits import bitmap, marked, within
from receptory.llm.common import discard, stored, table, tidy

#: Characters of the longest line, bytes of the first two lines of a chunk that is looked for again, characters of the shortest region that is removed.
LINE_CHARS, SEED_BYTES, MIN_CHARS = 160, 12, 120
#: A line ends with a line break, a sentence end, or a word from one of two letters on (one word in four or so).
_LINE = "[^{0}\\n]{{{{0,{{0}}}}}}(?:[{0}]{1}{{{{0,20}}}}[.!?,;:]* ?\\n?|\\n)|[^\\n]{{{{1,{{1}}}}}}"
LINE_PATTERN = _LINE.format("gb.!?", "[a-zà-ÿ]").format(LINE_CHARS - 1, LINE_CHARS)
#: Texts of other scripts, by their bytes a character, have their marks and two of their letters too (a far slower pattern to Java's engine).
WIDE, WIDE_PATTERN = "octet_length({0}) * 2 > length({0}) * 3", _LINE.format("gbгб.!?。！？，、،", "[a-zа-я]").format(LINE_CHARS - 1, LINE_CHARS)
#: Stands for a null doc_id; sorts last.
LAST = (1 << 63) - 1
#: Chunks of one key above which they are dealt to several tasks, at least; such keys at most; chunks that one copy of the first is compared with.
HOT, HOT_KEYS, SHARE = 4000, 100_000, 1000
_ADDED = ("removed_chunks", "removed_chars")


def put(df: DataFrame, name: str, value: str) -> DataFrame:
    """Adds a column that is computed once; projections would be merged and arrays recomputed for every element."""
    return df.select("*", F.explode(F.array(F.expr(value))).alias(name))


def lined(rows: DataFrame) -> DataFrame:
    """Adds lines, the array of the text's lines; together they are the text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.when(F.expr(WIDE.format("coalesce(text, '')")), F.regexp_extract_all(text, F.lit(WIDE_PATTERN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(LINE_PATTERN), F.lit(0)))
    return rows.select("*", F.explode(F.array(lines)).alias("lines"))


def chunked(rows: DataFrame) -> DataFrame:
    """Adds lines and starts, the places of the lines that begin a chunk."""
    out = put(lined(rows), "r", "transform(lines, (u, i) -> (coalesce(octet_length(get(lines, i - 1)), 0) * 331 + octet_length(u)) * 40503L % 65521)")
    out = put(out, "starts", "if(size(r) = 0, array(), filter(sequence(0, greatest(size(r) - 1, 0)), i -> i = 0 or (i >= 2 and get(r, i) < get(r, i - 1) and get(r, i) <= get(r, i + 1))))")
    return out.drop("r")


def _bare(text: str) -> str:
    return rf"trim(trailing ' \n' from {text})"


#: Of the chunk from line s, the k-th: the line after its last, whether it is long enough to look for, and its key.
_END = "coalesce(get(starts, k + 1), size(lines))"
_LONG = f"octet_length(get(lines, s)) + octet_length(get(lines, s + 1)) >= {SEED_BYTES}"
_KEY = f"xxhash64(slice(lines, s + 1, {_END} - s - 1), {_bare(f'get(lines, {_END} - 1)')})"


def chunk_keys(rows: DataFrame) -> DataFrame:
    """(doc_id, key) of the chunks that may be looked for: of two lines or more, the first two of SEED_BYTES bytes or more."""
    keys = F.expr(f"transform(starts, (s, k) -> if({_LONG}, {_KEY}, null))")
    return chunked(rows).select("doc_id", F.explode(keys).alias("key")).where("key is not null")


def chunk_spans(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, rid, k, key, s, a, b, span) of those whose key may be in the bitmap: span has the lines of the chunk and of the ones before and after it; the chunk is [a, b) there, and line s of the text is its first."""
    chunks = F.expr(f"transform(starts, (s, k) -> if({_LONG}, named_struct('k', k, 'key', {_KEY}, 's', s, 'e', {_END}, 'p', coalesce(get(starts, k - 1), 0), 'q', coalesce(get(starts, k + 2), size(lines))), null))")
    one = chunked(rows).select("doc_id", "rid", "lines", F.explode(chunks).alias("c")).where("c is not null").withColumn("key", F.col("c.key"))
    one = within(one, "key", keys)
    return one.select("doc_id", "rid", F.col("c.k").alias("k"), "key", "c.s", F.expr("c.s - c.p").alias("a"), F.expr("c.e - c.p").alias("b"), F.expr("slice(lines, c.p + 1, c.q - c.p)").alias("span"))


def _same(n: str, mine: str, first: str) -> str:
    """How many lines are equal one after another, of at most n; mine and first are their places at step j."""
    return f"if({n} <= 0, 0, aggregate(sequence(1, {n}), 0, (m, j) -> if(m = j - 1 and {_bare(f'get(span, {mine})')} = {_bare(f'get(first_span, {first})')}, m + 1, m)))"


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, ranges): of each text the sorted ranges (f, t) of lines that came before."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("rid"), F.col("text").cast("string").alias("text"))
    place = F.struct("doc_id", "rid", "k")
    often = stored(chunk_keys(rows).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"), "often")
    tidy(docs.sparkSession)
    keys = bitmap(often, "key")
    # a key's chunks meet in one task, where the first is read off; a frequent key's are dealt to several, each with a copy of the first.
    # Of n chunks at most HOT_KEYS have keys of more than n / HOT_KEYS, so these keys may be sent to all
    most = max(HOT, (often.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = stored(often.where(F.col("n") > most).select("key", "first_id", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), "hot")
    share = F.coalesce(F.expr("cast(pmod(rid, shares) as int)"), F.lit(0))
    names = ["key", "share", "doc_id", "rid", "k", "s", "a", "b", "span"]
    found = chunk_spans(rows, keys).join(F.broadcast(hot.select("key", "shares")), "key", "left").withColumn("share", share).select(names)
    if hot.limit(1).count():
        heads = chunk_spans(within(rows, "doc_id", bitmap(hot, "first_id")), bitmap(hot, "key")).join(F.broadcast(hot), "key").where("doc_id = first_id")
        heads = heads.groupBy("key", "shares").agg(F.min_by(F.struct("doc_id", "rid", "k", "s", "a", "b", "span"), place).alias("x"))
        found = found.unionByName(heads.select("key", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "x.*").select(names))
    first = F.first(F.struct(place.alias("place"), "span", "a", "b")).over(Window.partitionBy("key", "share").orderBy(place))
    pairs = found.withColumn("first", first).where(place != F.col("first.place")).select("*", F.col("first.span").alias("first_span"), F.col("first.a").alias("fa"), F.col("first.b").alias("fb"))
    pairs = pairs.where(f"{_bare("array_join(slice(span, a + 1, b - a), '')")} = {_bare("array_join(slice(first_span, fa + 1, fb - fa), '')")}")
    before = _same("least(a, fa)", "a - j", "fa - j")
    after = _same("least(size(span) - b, size(first_span) - fb)", "b + j - 1", "fb + j - 1")
    ranges = pairs.select("doc_id", "rid", F.expr(f"s - {before}").alias("f"), F.expr(f"s + b - a + {after}").alias("t"))
    gone = stored(ranges.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(F.struct("f", "t"))).alias("ranges")), "ranges")
    discard(often, keys, hot)
    tidy(docs.sparkSession)
    return gone


#: Ranges that overlap or touch as regions, those of MIN_CHARS characters or more.
_REGIONS = (
    "filter(aggregate(ranges, cast(array() as array<struct<f: int, t: int>>), (z, x) -> "
    "if(size(z) > 0 and x.f <= element_at(z, -1).t, concat(slice(z, 1, size(z) - 1), array(named_struct('f', element_at(z, -1).f, 't', greatest(element_at(z, -1).t, x.t)))), concat(z, array(x)))), "
    f"z -> length(array_join(slice(lines, z.f + 1, z.t - z.f), '')) >= {MIN_CHARS})"
)
_KEPT = (
    "aggregate(regions, named_struct('out', '', 'at', 0), (z, x) -> named_struct('out', concat(z.out, array_join(slice(lines, z.at + 1, x.f - z.at), '')), 'at', x.t), "
    "z -> concat(z.out, array_join(slice(lines, z.at + 1, size(lines) - z.at), '')))"
)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated regions cut from text and n_chars (if there) set anew; adds removed_chunks, the number of regions, and removed_chars."""
    gone = repeated_ranges(docs)
    touched = bitmap(gone, "rid")
    names = [x for x in docs.columns if x not in _ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in names]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("rid"), F.col("text").cast("string").alias("text"))
    rows = marked(rows, "rid", touched)
    same = rows.where("not perhaps").select("row", F.col("text"), F.lit(0).alias("removed_chunks"))
    cut = lined(rows.where("perhaps").join(gone, ["doc_id", "rid"], "left"))
    cut = put(cut, "regions", f"if(ranges is null, cast(array() as array<struct<f: int, t: int>>), {_REGIONS})")
    cut = cut.select("row", F.expr(f"if(size(regions) = 0, text, {_KEPT})").alias("text"), F.size("regions").alias("removed_chunks"))
    both = same.unionByName(cut)
    columns = [F.col("text") if x == "text" else F.length("text").cast(docs.schema[x].dataType).alias(x) if x == "n_chars" else F.col(f"row.`{x}`").alias(x) for x in names]
    removed = F.coalesce(F.length(F.col("row.text").cast("string")) - F.length("text"), F.lit(0))
    return both.select(*columns, F.col("removed_chunks").cast("long").alias("removed_chunks"), removed.cast("long").alias("removed_chars"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "removed_chunks", "removed_chars")


OP9_SQL = rf"""
with r as (select row_number() over () as rid, coalesce(doc_id, {LAST}) as id, doc_id, text, case when {WIDE.format("coalesce(text, '')").replace("octet_length", "strlen")} then regexp_extract_all(coalesce(text, ''), '{WIDE_PATTERN.replace(chr(92) + "n", chr(10))}') else regexp_extract_all(coalesce(text, ''), '{LINE_PATTERN.replace(chr(92) + "n", chr(10))}') end as lines from documents),
u as (select rid, id, i - 1 as i, lines[i] as line from (select rid, id, lines, unnest(range(1, len(lines) + 1)) as i from r)),
a as (select *, rtrim(line, e' \n') as bare from u),
b as (select *, (coalesce(lag(strlen(line)) over w, 0) * 331 + strlen(line)) * 40503 % 65521 as r from a window w as (partition by rid order by i)),
c as (select *, i = 0 or (i >= 2 and coalesce(r < lag(r) over w and r <= lead(r) over w, false)) as start from b window w as (partition by rid order by i)),
d as (select *, lead(k, 1, -1) over (partition by rid order by i) <> k as last from (select *, sum(cast(start as int)) over (partition by rid order by i) - 1 as k from c)),
e as (select rid, id, k, min(i) as s, max(i) + 1 as t, string_agg(case when last then bare else line end, '' order by i) as body, list_sum(list_slice(list(strlen(line) order by i), 1, 2)) as seed, count(*) as size from d group by rid, id, k),
f as (select *, coalesce(lag(s) over w, s) as p, coalesce(lead(t) over w, t) as q from e window w as (partition by rid order by k)),
z as (select body, min((id, rid, k)) as first, max((id, rid, k)) as last from f where seed >= {SEED_BYTES} and size > 1 group by body),
m as (
  select row_number() over () as m, x.rid, x.s, x.t, x.p, x.q, y.rid as frid, y.s as fs, y.t as ft, y.p as fp, y.q as fq
  from f x join z on x.body = z.body and x.seed >= {SEED_BYTES} and x.size > 1 and first <> last and (x.id, x.rid, x.k) <> first join f y on (y.id, y.rid, y.k) = first),
j as (
  select m, 0 as side, rid, frid, s, fs, t, ft, unnest(range(1, least(s - p, fs - fp) + 1)) as j from m
  union all select m, 1, rid, frid, s, fs, t, ft, unnest(range(1, least(q - t, fq - ft) + 1)) from m),
n as (
  select j.m, side, coalesce(min(j) filter (x.bare <> y.bare) - 1, count(*)) as n
  from j join a x on x.rid = j.rid and x.i = case side when 0 then s - j else t + j - 1 end join a y on y.rid = j.frid and y.i = case side when 0 then fs - j else ft + j - 1 end
  group by j.m, side),
g as (select distinct rid, unnest(range(s - coalesce((select n from n where n.m = m.m and side = 0), 0), t + coalesce((select n from n where n.m = m.m and side = 1), 0))) as i from m),
o as (select rid, i, i - row_number() over (partition by rid order by i) as island from g),
l as (select o.rid, island, sum(length(line)) as n from o join u on u.rid = o.rid and u.i = o.i group by o.rid, island having sum(length(line)) >= {MIN_CHARS}),
x as (select distinct o.rid, o.i from o join l on l.rid = o.rid and l.island = o.island),
k as (select u.rid, coalesce(string_agg(line, '' order by u.i) filter (x.i is null), '') as text, count(x.i) as cut from u left join x on x.rid = u.rid and x.i = u.i group by u.rid),
v as (select rid, count(*) as removed from l group by rid)
select r.doc_id, case when v.removed > 0 then k.text else r.text end as text, cast(coalesce(v.removed, 0) as bigint) as removed_chunks,
  cast(case when v.removed > 0 then length(r.text) - length(k.text) else 0 end as bigint) as removed_chars
from r left join k using (rid) left join v using (rid)
"""
