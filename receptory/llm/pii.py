"""PII: surrogate generation, in built-in functions only.

Detected entities are taken apart into tokens that name one thing wherever
they occur: an e-mail's local part and domain, a phone's last ten digits, a
given name, a surname.  Every distinct token of the whole table gets one keyed
surrogate of its type: the same kinds of characters in the same places, a card
with a valid check digit where it had one, an address of four octets, names of
the same gender and script, part by part where they have hyphens.  Keys in hex
digits, of 32 digits and more in either case, passwords and names are replaced
at their whole length.  So a token has one surrogate in all documents
(coreference), rendered in the separators and the case it had there.

Names are found by the titles before them; in the same text their words are
then replaced without a title too.  A given name has one gender: that of most
of the titles it stands with, none if they balance or tell nothing.

Surrogates are checked for collisions: with the surrogate of another token of
the type, with any token that is in the corpus, with the token itself.  Of
several tokens with one surrogate the least keeps it; the others are drawn
again by the next attempt number until all are distinct.  Where a type of fixed
format has fewer surrogates than tokens that cannot be, which is an error.

Edge cases: null texts stay null, texts without entities pass unchanged;
repeated rows get equal texts; other columns pass unchanged, but for n_chars,
which is set anew, and an n_entities of the input, which is replaced; an empty
table gives an empty result; text that is all one entity is replaced whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from receptory.llm.common import discard, stored, table

#: Honorifics by gender; names are told by them.
TITLES = {"m": ["Mr", "Sir", "Herr", "Señor", "Monsieur", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа"], "n": ["Dr", "Prof", "Доктор"]}
#: Given names by gender and script, and syllables of surnames by script, that surrogates are made of.
GIVEN = {
    "m:latin": "Adrian Bernard Conrad Damian Edgar Felix Gustav Hector Ivan Julian Konrad Leander Marius Norbert Oskar Patrick Quentin Roland Stefan Tobias".split(),
    "f:latin": "Adela Beatrix Clara Dorothea Elena Flora Greta Helena Irene Julia Katrin Leonora Marina Nadia Ottilie Paula Regina Sabine Tamara Ursula".split(),
    "n:latin": "Alex Andrea Charlie Dominique Eden Francis Jordan Kim Lou Maxime Morgan Nicola Robin Sasha Sidney Toni".split(),
    "m:cyrillic": "Андрей Борис Виктор Григорий Дмитрий Егор Захар Игорь Кирилл Леонид Максим Николай Олег Павел Роман Степан".split(),
    "f:cyrillic": "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Лариса Марина Нина Ольга Полина Раиса Софья Тамара".split(),
    "n:cyrillic": "Саша Женя Валя Слава Шура Паша".split(),
}
SYLLABLES = {"latin": "bar den fol gar hal ker lan mor nev pol ran sel tor vin wal zed".split(), "cyrillic": "бар ден фол гар хал кер лан мор нев пол ран сел тор вин вал зед".split()}
_W = r"\p{Lu}[\p{L}'’-]++"
_TITLE = "|".join(x for own in TITLES.values() for x in own)
#: Patterns by type, first match wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)",
    "awskey": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "hex": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "password": r"(?<=password=)[A-Za-z0-9_-]{4,}+",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_W}(?: {_W})?",
}
MASTER = "|".join(f"(?:{x})" for x in PATTERNS.values())
#: What a text must have for any pattern to match; cheap to look for.
NEEDS = rf"\d{{3}}|@|\d\.\d|password=|AKIA|[0-9A-Fa-f]{{32}}|(?:{_TITLE})\.? \p{{Lu}}"
FIXED = ("phone", "card", "ssn", "ip", "hex", "awskey")
#: Rounds in a row that may leave as many tokens without a surrogate as before.
ROUNDS = 16
#: Texts that one copy of an entity's surrogate is joined to.
SHARE = 1000
#: The session setting that holds the key, and the key without it, for tests.
KEY_SETTING, TEST_KEY = "spark.receptory.pii.key", "a key kept by the owner"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: list[str]) -> str:
    return f"array({', '.join(map(_quote, words))})"


def kind_of(column: str) -> Column:
    """The type of a match."""
    out = None
    for kind, pattern in PATTERNS.items():
        test = F.col(column).rlike(f"^(?:{pattern.replace('(?<=password=)', '')})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("password")


_NAME = "split(regexp_replace(match, '^[^ ]+ ', ''), ' ')"


def _script(x: str) -> str:
    return f"if({x} rlike '\\\\p{{IsCyrillic}}', 'cyrillic', 'latin')"


def tokens_of() -> Column:
    """Array of structs (type, token, gender): what a match (columns match, kind) is made of; the surrogates, put into the match's form, replace it."""
    title = "regexp_replace(split(match, ' ')[0], '[.]', '')"
    gender = "case " + " ".join(f"when {title} in ({', '.join(map(_quote, x))}) then '{g}'" for g, x in TITLES.items()) + " else 'n' end"
    one = lambda kind, token, g="'n'": f"named_struct('type', {kind}, 'token', {token}, 'gender', {g})"
    word = lambda kind, x, g="'n'": one(f"concat('{kind}:', {_script(x)})", f"lower({x})", g)
    return F.expr(
        "case kind "
        f"when 'email' then array({one(_quote('local'), 'lower(split(match, _at)[0])')}, {one(_quote('domain'), 'lower(split(match, _at)[1])')}) "
        f"when 'phone' then array({one(_quote('phone'), _right10('match'))}) "
        f"when 'card' then array({one(_quote('card'), _digits('match'))}) "
        f"when 'ssn' then array({one(_quote('ssn'), _digits('match'))}) "
        f"when 'name' then if(size({_NAME}) = 2, array({word('given', _NAME + '[0]', gender)}, {word('surname', _NAME + '[1]')}), array({word('surname', _NAME + '[0]')})) "
        f"when 'given' then array({word('given', 'match')}) when 'surname' then array({word('surname', 'match')}) "
        f"when 'hex' then array({one('kind', 'lower(match)')}) "
        f"else array({one('kind', 'match')}) end".replace("_at", "'@'")
    )


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _right10(x: str) -> str:
    return f"right({_digits(x)}, 10)"


def surrogate(key: str) -> Column:
    """The surrogate of columns type, token, gender, attempt."""
    seed = f"concat_ws('|', {_quote(key)}, type, token, cast(attempt as string))"
    # digests of 32 bytes, as many as the token has characters for and two at least
    longs = f"transform(sequence(2, greatest(2, cast(ceil(length(token) / 32) as int))), j -> sha2(concat({seed}, '|more', if(j = 2, '', cast(j as string))), 256))"
    digests = f"concat(array(sha2({seed}, 256)), {longs})"
    byte = lambda i: f"cast(conv(substr(digests[cast(({i}) div 32 % size(digests) as int)], cast(({i}) % 32 * 2 as int) + 1, 2), 16, 10) as int)"
    pick = lambda chars, i: f"substr({_quote(chars)}, {byte(i)} % {len(chars)} + 1, 1)"
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    chars = "split(token, '')"
    same = f"transform({chars}, (c, i) -> case when c rlike '[0-9]' then {pick(digit, 'i')} when c rlike '\\\\p{{IsCyrillic}}' then {pick('абвгдежзиклмнопрстуфхц', 'i')} when c rlike '\\\\p{{Lu}}' then {pick(upper, 'i')} when c rlike '\\\\p{{L}}' then {pick(lower, 'i')} else c end)"
    longer = f"array_join(transform(sequence(0, cast(attempt / 4 as int)), i -> if(i = 0, '', {pick(lower, 'i + 50')})), '')"
    hexes = f"array_join(transform({chars}, (c, i) -> {pick(hexa, 'i')}), '')"
    octets = f"concat_ws('.', {', '.join(f'cast(1 + {byte(i)} % 254 as string)' for i in (1, 2, 3, 4))})"
    phone = f"concat(substr('23456789', {byte(0)} % 8 + 1, 1), {pick(digit, 1)}, {pick(digit, 2)}, substr('23456789', {byte(3)} % 8 + 1, 1), array_join(transform(sequence(4, 9), i -> {pick(digit, 'i')}), ''))"
    body = f"concat(substr(token, 1, 1), array_join(transform(sequence(1, 14), i -> {pick(digit, 'i')}), ''))"
    sums = lambda x: f"aggregate(sequence(1, length({x})), 0, (s, i) -> s + if((length({x}) - i) % 2 = 1, cast(substr('0246813579', cast(substr({x}, i, 1) as int) + 1, 1) as int), cast(substr({x}, i, 1) as int)))"
    card = f"concat({body}, cast((10 - {sums(f'concat({body}, {_quote("0")})')} % 10 + if({sums('token')} % 10 = 0, 0, 1 + {byte(40)} % 9)) % 10 as string))"
    cases = [f"when type = 'hex' then {hexes}", f"when type = 'ip' then {octets}", f"when type = 'phone' and length(token) = 10 then {phone}", f"when type = 'card' then {card}", f"when type = 'awskey' then concat('AKIA', array_join(slice({same}, 5, 16), ''))"]
    # names part by part: hyphens and apostrophes stay, a lone letter stays one
    parts = "filter(split(token, \"(?<=[-'’])|(?=[-'’])\"), x -> x <> '')"
    by_part = lambda made, letters: f"array_join(transform({parts}, (c, p) -> case when c rlike \"^[-'’]$\" then c when length(c) = 1 then {pick(letters, 'p')} else {made} end), '')"
    more = "cast(attempt / 4 as int)"
    for name, words in GIVEN.items():
        g, script = name.split(":")
        made = f"array_join(transform(sequence(0, {more}), i -> {_array(words)}[{byte('i + 3 * p')} % {len(words)}]), '')"
        cases.append(f"when type = 'given:{script}' and gender = '{g}' then {by_part(made, upper if script == 'latin' else 'АБВГДЕЖЗИКЛМНОПРСТУФ')}")
    for script, words in SYLLABLES.items():
        made = f"initcap(array_join(transform(sequence(0, 2 + {more}), i -> {_array(words)}[{byte('i + 5 * p')} % {len(words)}]), ''))"
        cases.append(f"when type = 'surname:{script}' then {by_part(made, upper if script == 'latin' else 'АБВГДЕЖЗИКЛМНОПРСТУФ')}")
    cases.append(f"when type = 'domain' then concat(array_join(slice({same}, 1, length(token) - length(substring_index(token, '.', -1)) - 1), ''), {longer}, '.', substring_index(token, '.', -1))")
    fixed = ", ".join(map(_quote, FIXED))
    expression = f"case {' '.join(cases)} else concat(array_join({same}, ''), if(type in ({fixed}), '', {longer})) end"
    return F.expr(f"element_at(transform(array({digests}), digests -> {expression}), 1)")


def surrogates(tokens: DataFrame, key: str) -> DataFrame:
    """(type, token, surrogate) of distinct tokens (type, token, gender), all surrogates of a type distinct and none a token of the corpus."""
    own = tokens.select(F.col("type").alias("own_type"), F.col("token").alias("own_token"))
    pending, accepted, attempt, idle, left = tokens, None, 0, 0, -1
    while True:
        made = stored(pending.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", surrogate(key)).select("type", "token", "gender", "surrogate").withColumn("form", F.lower("surrogate")), "attempts")
        least = made.groupBy("type", "form").agg(F.min("token").alias("winner"))
        good = made.join(least, ["type", "form"]).where("token = winner").drop("winner")
        good = good.join(own, (F.col("type") == F.col("own_type")) & (F.col("form") == F.lower("own_token")), "left_anti")
        if accepted is not None:
            good = good.join(accepted.select("type", "form"), ["type", "form"], "left_anti")
        good = stored(good.select("type", "token", "surrogate", "form"), "accepted")
        accepted = good if accepted is None else accepted.unionByName(good)
        if attempt:
            discard(pending)
        pending = stored(made.select("type", "token", "gender").join(good.select("type", "token"), ["type", "token"], "left_anti"), "pending")
        discard(made)
        before, left = left, pending.count()
        if not left:
            discard(pending)
            return accepted.select("type", "token", "surrogate")
        idle = idle + 1 if left == before else 0
        if idle == ROUNDS:
            raise ValueError(f"{left} tokens have no surrogate of their own after {attempt + 1} attempts")
        attempt += 1


def rendered() -> Column:
    """A match (columns match, kind) with its tokens' surrogates (array s, in order) in its own separators and case."""
    refill = lambda x, digits: f"aggregate(sequence(1, length({x})), named_struct('out', '', 'n', 0), (a, i) -> if(substr({x}, i, 1) rlike '[0-9]', named_struct('out', concat(a.out, substr({digits}, a.n + 1, 1)), 'n', a.n + 1), named_struct('out', concat(a.out, substr({x}, i, 1)), 'n', a.n)), a -> a.out)"
    cased = lambda x, i: f"if(length({x}) > 1 and {x} = upper({x}), upper(s[{i}]), s[{i}])"
    hexes = "if(match = lower(match), s[0], if(match = upper(match), upper(s[0]), array_join(zip_with(split(match, ''), split(s[0], ''), (a, b) -> if(a = lower(a), b, upper(b))), '')))"
    head = f"left({_digits('match')}, greatest(length({_digits('match')}) - 10, 0))"
    return F.expr(
        "case kind when 'email' then concat(if(match = upper(match), upper(s[0]), s[0]), '@', if(match = upper(match), upper(s[1]), s[1])) "
        f"when 'phone' then {refill('match', f'concat({head}, s[0])')} when 'card' then {refill('match', 's[0]')} when 'ssn' then {refill('match', 's[0]')} "
        f"when 'hex' then {hexes} "
        f"when 'name' then concat(split(match, ' ')[0], ' ', {cased(_NAME + '[0]', 0)}, if(size({_NAME}) = 2, concat(' ', {cased(_NAME + '[1]', 1)}), '')) "
        f"when 'given' then {cased('match', 0)} when 'surname' then {cased('match', 0)} else s[0] end"
    )


def _kept(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_matches(rows: DataFrame) -> DataFrame:
    """Adds pattern, that of all entities of the text, and givens and surnames, the words of its titled names, which are entities by themselves too."""
    titled = rf"(?:{_TITLE})\.? "
    named = rows.withColumn("some_names", F.col("text").rlike(rf"(?<![\p{{L}}\p{{N}}]){titled}\p{{Lu}}"))
    named = _kept(named, "names", F.when(F.col("some_names"), F.array_distinct(F.regexp_extract_all("text", F.lit(MASTER), F.lit(0)))).otherwise(F.array().cast("array<string>")))
    words = f"transform(filter(names, m -> m rlike '^{titled.replace(chr(92), chr(92) * 2)}'), match -> {_NAME})"
    named = _kept(named, "words", F.expr(words))
    named = named.withColumn("givens", F.expr("array_distinct(transform(filter(words, x -> size(x) = 2), x -> x[0]))")).withColumn("surnames", F.expr("array_distinct(transform(words, x -> element_at(x, -1)))"))
    own = r"concat(_master, '|(?<![\\p{L}\\p{N}])(?:', array_join(array_sort(array_union(surnames, givens), (x, y) -> length(y) - length(x)), '|'), ')(?![\\p{L}\\p{N}])')".replace("_master", _quote(MASTER))
    return _kept(named, "pattern", F.expr(f"if(size(words) = 0, {_quote(MASTER)}, {own})")).drop("some_names", "names", "words")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs with the entities of text replaced by keyed surrogates; adds n_entities."""
    names = [x for x in docs.columns if x != "n_entities"]
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in names]).alias("row"), F.col("text").cast("string").alias("text"))
    some = F.coalesce(F.col("text").rlike(NEEDS), F.lit(False))
    perhaps = with_matches(rows.where(some).withColumn("place", F.xxhash64("text")))
    found = perhaps.select("place", "pattern", "givens", "surnames", F.explode(F.array_distinct(F.expr("regexp_extract_all(text, pattern, 0)"))).alias("match"))
    kind = F.when(F.array_contains("surnames", F.col("match")), "surname").when(F.array_contains("givens", F.col("match")), "given").otherwise(kind_of("match"))
    found = stored(found.select("place", "match", kind.alias("kind")).distinct(), "entities")
    entities = found.groupBy("match", "kind").agg(F.count("*").alias("n"))
    parts = stored(entities.select("match", "kind", "n", F.posexplode(tokens_of()).alias("i", "t")).select("match", "kind", "n", "i", "t.*"), "tokens")
    sides = parts.groupBy("type", "token").agg(F.sum(F.when(F.col("gender") == "m", 1).when(F.col("gender") == "f", -1).otherwise(0)).alias("side"))
    known = surrogates(stored(sides.select("type", "token", F.when(F.col("side") > 0, "m").when(F.col("side") < 0, "f").otherwise("n").alias("gender")), "distinct"), key)
    whole = parts.join(known, ["type", "token"]).groupBy("match", "kind").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "surrogate"))), lambda x: x.surrogate).alias("s"))
    new = whole.withColumn("new", rendered()).withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int"))
    shares = found.join(new.select("match", "kind", "shares").where("shares > 1"), ["match", "kind"], "left").withColumn("share", F.coalesce(F.expr("cast(pmod(place, shares) as int)"), F.lit(0))).drop("shares")
    given = new.select("match", "kind", "new", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"))
    lists = shares.join(given, ["match", "kind", "share"]).groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("match", "new"))).alias("new"))
    joined = _kept(perhaps.join(lists, "place", "left").select("row", "text", "new", "pattern"), "matches", F.expr("if(new is null, array(), regexp_extract_all(text, pattern, 0))"))
    filled = F.expr("array_join(zip_with(split(text, pattern, -1), transform(matches, m -> coalesce(new[m], m)), (a, b) -> concat(a, coalesce(b, ''))), '')")
    done = joined.select("row", F.when(F.col("new").isNull(), F.col("text")).otherwise(filled).alias("text"), F.size("matches").cast("long").alias("n_entities"))
    both = rows.where(~some).select("row", "text", F.lit(0).cast("long").alias("n_entities")).unionByName(done)
    return both.select(*[F.col("text") if x == "text" else F.length("text").cast(docs.schema[x].dataType).alias(x) if x == "n_chars" else F.col(f"row.`{x}`").alias(x) for x in names], "n_entities")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, under the session's key."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), spark.conf.get(KEY_SETTING, TEST_KEY))
