"""PII surrogates: detected entities get keyed replacements of their own kind, in DataFrame operations only.

Kinds: e-mail addresses, IPv4 addresses, social-security numbers, bank accounts (IBAN), payment
cards, phone numbers, secrets (long hexadecimal strings and access keys) and person names (after a
title, or a known given name followed by another capitalised word; also in capitals).  An entity's
canonical form (digits of a number, lower case of an address) decides its surrogate, so all its
mentions get the same one, laid out as each mention is.  Surrogates keep lengths, separators, letter
case, country codes, check digits (Luhn, mod 97), the script of a name and the gender that its title
or given name shows.

Names are replaced word by word: a word of a name has one surrogate in the whole corpus, so short and
long forms of a name agree, and all other mentions of these words in the text, capitalised or in
capitals, are replaced as well.  Phone numbers with and without the code of a country whose numbers
all have one length (NATIONAL_DIGITS) agree; such a number ends after that many digits, one of
another country goes on over separated groups, but not into an IPv4 address.

All distinct entities of the corpus are checked on what is printed: two never share a surrogate, none
keeps its own form, and none gets a form that is an entity of the corpus itself (a given name may:
given names of one gender and script change places).  Who loses a draw draws again with the next
counter; draws get longer by a sign a round after ``LONGER`` rounds, so small spaces never run out.

The key decides the draws: without it surrogates can't be recomputed.  Null texts stay null; texts
without entities, and empty ones, stay as they are.  Rows that repeat are replaced alike, null ids
don't matter (texts are matched by their hashes), other columns are left alone whatever their names
(names that begin with two underscores are reserved).  An empty table gives an empty result.  A very
long text costs memory in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Names by script and gender, and the syllables of surnames.
NAMES = {
    "latin_f": "Anna Maria Laura Julia Sophie Clara Emma Elena Lucia Marta Paula Carmen Claire Camille Ingrid Greta Alice Nora Helen Ruth Irene Diana Olivia Teresa",
    "latin_m": "Peter Martin Thomas Paul Lukas Felix Jonas Oscar Hugo Louis Marco Diego Carlos Javier Andre Henri Karl Otto James Henry Arthur Victor Simon Daniel",
    "cyrillic_f": "Анна Мария Ольга Елена Ирина Наталья Татьяна Светлана Вера Нина Дарья Юлия",
    "cyrillic_m": "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Олег Виктор Егор",
}
#: More given names that are found, by gender.
MORE_NAMES = {
    "f": "Mary Sarah Emily Elizabeth Susan Margaret Lisa Petra Sabine Monika Heike Marie Isabelle Nathalie Chloé Léa María Lucía Sofía Pilar Екатерина Людмила",
    "m": "John Michael David Robert William Hans Jürgen Klaus Stefan Wolfgang Pierre Jean François Luc José Antonio Juan Miguel Pedro Luis Александр Владимир",
}
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа",
    "m": "Mr|Herr|Monsieur|Señor|Sr|г-н",
    "x": "Dr|Prof",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te va",
    "cyrillic": "ба бе бо да де до фа фе га го ха ка ке ла ле ло ма ме мо на не но па пе ра ре ро са се та те ва",
}
ENDINGS = {"latin": "ner man sen rin lin dal vik ton", "cyrillic": "нин рин лин кин сон тин дин вин"}
GIVEN_ENDINGS = {"latin_f": "na la ria", "latin_m": "no lo rio", "cyrillic_f": "на ла рия", "cyrillic_m": "слав мир дар"}
#: Rounds of draws from the lists of given names, and rounds after which draws get longer.
LISTED, LONGER = 6, 12
#: Copies of a text whose rows are dealt to SALTS tasks: those of more than one in HOT rows, HOT texts at most.
HOT, SALTS = 2000, 64

_women, _men = (f"{NAMES[f'latin_{g}']} {NAMES[f'cyrillic_{g}']} {MORE_NAMES[g]}".split() for g in "fm")
_given = "|".join(sorted(_women + _men, key=lambda x: (-len(x), x)))
_title = "|".join(TITLES.values())
#: A word of a name.
WORD = r"\p{Lu}(?:\p{Ll}+|\p{Lu}+)"
LONE_WORD = rf"(?<!\p{{L}}){WORD}(?!\p{{L}})"
#: An address may follow a number after a blank; it isn't a part of it.
_ip = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
#: Digits after the country code where a country's numbers all have the same length.
NATIONAL_DIGITS = {"1": 10, "7": 10, "31": 9, "32": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "91": 10}
_country = "|".join(rf"{c}(?=\d{{{n}}}$)" for c, n in NATIONAL_DIGITS.items())
_fixed = "|".join(rf"\+{c}(?:[ .-]?\(0\))?(?:[ .-]?[(]?\d|(?<=\d)\)[ .-]?\d){{{n}}}" for c, n in NATIONAL_DIGITS.items())
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.\p{L}{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z_-]{0,128}[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|ghp|pat)[-_][A-Za-z0-9]{20,80})(?![A-Za-z0-9])",
    "ip": _ip,
    "card": rf"(?<![\d+])\d(?:(?:[ -](?!{_ip}))?\d){{12,18}}(?!\d)",
    "phone": rf"(?<![\p{{L}}\d])(?:(?:{_fixed})(?!\d)|\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:(?:[ .-](?!{_ip}))?\d{{2,4}}){{1,4}}|\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|\d{{3}}-\d{{4}})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{_title})\.? {WORD}(?: {WORD})?|(?:{_given}|{_given.upper()}) {WORD})(?!\p{{L}})",
}
_number = "|".join(PATTERNS[k] for k in ("ssn", "ip", "card", "phone"))
#: Each kind is only tried where its first character allows it.
ANY = (
    rf"{PATTERNS['email']}|(?=[+(0-9])(?:{_number})|(?=[0-9a-fA-Fsgp])(?:{PATTERNS['secret']})|(?=[A-Z])(?:{PATTERNS['iban']})|(?=[A-ZгА-Я])(?:{PATTERNS['name']})"
)
NUMERIC = ("ssn", "card", "phone")


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind in reversed(list(PATTERNS)[:-1]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _country_of(entity: Column) -> Column:
    """Country code of a phone number of a country with one length, else empty."""
    signs = F.regexp_replace(F.replace(entity, F.lit("(0)"), F.lit("")), "[^0-9+]", "")
    return F.regexp_extract(signs, rf"^\+({_country})", 1)


def canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    fixed = _country_of(entity)
    national = F.regexp_replace(F.replace(entity, F.lit("(0)"), F.lit("")), "[^0-9]", "")
    national = F.substring(national, F.length(fixed) + 1, F.length(national))
    country = F.regexp_extract(entity, r"^\+(\d{1,3})[ .(-]", 1)
    abroad = F.concat(F.lit("+"), country, F.lit(" "), F.substring(digits, F.length(country) + 1, F.length(digits)))
    return (
        F.when((kind == "phone") & (fixed != ""), national)
        .when((kind == "phone") & (country != ""), abroad)
        .when(kind.isin(*NUMERIC), digits)
        .when(kind == "email", F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .otherwise(entity)
    )


def name_words(entity: Column) -> Column:
    """Words of a name in lower case, with the gender that is shown of a given name, and whether it is one."""
    bare = F.split(F.regexp_replace(entity, rf"^(?:{_title})\.? ", ""), " ")
    women, men = (F.array(*[F.lit(x.lower()) for x in names]) for names in (_women, _men))
    title = F.when(entity.rlike(rf"^(?:{TITLES['f']})\.? "), "f").when(entity.rlike(rf"^(?:{TITLES['m']})\.? "), "m").otherwise("x")

    def one(word: Column, i: Column) -> Column:
        w = F.lower(word)
        listed = F.when(F.array_contains(women, w), "f").when(F.array_contains(men, w), "m")
        given = listed.isNotNull() | ((i == 0) & (F.size(bare) == 2))
        return F.struct(w.alias("canon"), F.when(given, F.coalesce(listed, title)).otherwise("x").alias("sex"), given.alias("given"))

    return F.transform(bare, one)


def _stream(key: str, *parts: Column) -> Column:
    """128 keyed hexadecimal digits."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(F.concat(F.lit("a"), seed), 256), F.sha2(F.concat(F.lit("b"), seed), 256))


def _draw(stream: Column, i: Column | int, n: Column | int) -> Column:
    """Number below n from place i of the stream."""
    at = (i if isinstance(i, Column) else F.lit(i)) % 60
    return F.conv(F.substring(stream, at * 2 + 1, F.lit(8)), 16, 10).cast("bigint") % n


def _recode(text: Column, stream: Column) -> Column:
    """Digits to digits, letters to letters of their case; hexadecimal letters stay hexadecimal."""
    lower, upper = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    hexa = text.rlike("^[0-9a-f]+$|^[0-9A-F]+$")
    span = F.when(hexa, 6).otherwise(26)

    def one(c: Column, i: Column) -> Column:
        pick = lambda alphabet: F.substring(alphabet, (_draw(stream, i, span) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[0-9]"), _draw(stream, i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), pick(upper)).when(c.rlike(r"\p{L}"), pick(lower)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted singly."""
    places = F.split(F.reverse(digits), "")
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(places, lambda c, i: F.when(i % 2 == 1, twice(F.coalesce(c.try_cast("int"), F.lit(0)))).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _mod97(account: Column) -> Column:
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _name_word(stream: Column, canon: Column, sex: Column, given: Column, attempt: Column, extra: Column) -> Column:
    def choose(text: str, i: int | Column) -> Column:
        words = text.lower().split()
        return F.element_at(F.array(*map(F.lit, words)), (_draw(stream, i, len(words)) + 1).cast("int"))

    def of(script: str) -> Column:
        body = F.array_join(F.transform(F.sequence(F.lit(0), extra + 2), lambda i: choose(SYLLABLES[script], 12 + 4 * i)), "")
        female = F.when(sex == "x", _draw(stream, 9, 2) == 0).otherwise(sex == "f")
        listed = F.when(female, choose(NAMES[f"{script}_f"], 0)).otherwise(choose(NAMES[f"{script}_m"], 0))
        made = F.concat(body, F.when(female, choose(GIVEN_ENDINGS[f"{script}_f"], 8)).otherwise(choose(GIVEN_ENDINGS[f"{script}_m"], 8)))
        surname = F.concat(body, choose(ENDINGS[script], 8))
        surname = F.when(canon.endswith("а"), F.concat(surname, F.lit("а"))).otherwise(surname) if script == "cyrillic" else surname
        return F.when(given & (attempt < LISTED), listed).when(given, made).otherwise(surname)

    return F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def surrogate(key: str, kind: Column, canon: Column, sex: Column, given: Column, attempt: int) -> Column:
    """The canonical form of the replacement that a draw gives."""
    extra = max(0, attempt - LONGER)
    s = _stream(key, kind, canon, F.lit(str(attempt)))
    plain = _recode(F.concat(canon, F.lit("0" * extra)), s)
    head = F.concat(F.lit("x" * extra), F.regexp_extract(canon, r"^(.*)\.\p{L}+$", 1))
    mail = F.concat(_recode(head, s), F.regexp_extract(canon, r"(\.\p{L}+)$", 1))
    octets = F.array_join(F.array(*[(_draw(s, 7 * i, 254) + 1).cast("string") for i in range(4 + extra)]), ".")
    stem = F.substring(plain, F.lit(1), F.length(plain) - 1)
    check = (10 - _luhn(F.concat(stem, F.lit("0"))) % 10) % 10
    card = F.when(_luhn(canon) % 10 == 0, F.concat(stem, check.cast("string"))).otherwise(plain)
    body = F.substring(plain, F.lit(5), F.length(plain))
    country = F.substring(canon, 1, 2)
    digits = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    account = F.concat(country, F.when(_mod97(canon) == 1, digits).otherwise(F.substring(plain, 3, 2)), body)
    fixed = F.regexp_extract(canon, r"^(AKIA|(?:sk|ghp|pat)[-_]|\+\d+ )", 1)
    kept = F.concat(fixed, _recode(F.concat(F.substring(canon, F.length(fixed) + 1, F.length(canon)), F.lit("0" * extra)), s))
    name = _name_word(s, canon, sex, given, F.lit(attempt), F.lit(extra))
    return F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "card", card).when(kind == "iban", account).when(kind == "name", name).when(kind.isin("secret", "phone"), kept).otherwise(plain)


def lay_out(kind: Column, entity: Column, new: Column) -> Column:
    """The surrogate as this mention (of any kind but a name) is written."""
    signs = F.regexp_replace(new, "[^A-Z0-9]", "")
    code = F.when(kind == "phone", F.concat(_country_of(entity), F.when((_country_of(entity) != "") & entity.contains("(0)"), "0").otherwise(""))).otherwise("")
    signs = F.concat(code, signs)
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^A-Z0-9]", ""))
    grouped = F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[A-Z0-9]"), F.substring(signs, before(i), F.lit(1))).otherwise(c))
    longer = F.substring(signs, before(F.length(entity)) + 1, F.length(signs))
    cased = F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(entity, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    return F.when(kind.isin(*NUMERIC, "iban"), F.concat(F.array_join(grouped, ""), longer)).when(kind == "email", F.array_join(cased, "")).otherwise(new)


def assign(entities: DataFrame, key: str, rounds: int = 80) -> DataFrame:
    """entities (kind, canon, sex, given; distinct in kind and canon) with a surrogate each, all different.

    A draw is lost to its own canonical form, to an entity of the corpus (unless it is a given name),
    to a surrogate given earlier and, within a round, to the smaller canonical form.
    """
    if not key:
        raise ValueError("surrogates need a key")
    taken = entities.filter("not given").select("kind", F.col("canon").alias("new"))
    pending, done = entities, None
    for attempt in range(rounds):
        drawn = pending.withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.col("sex"), F.col("given"), attempt))
        free = drawn.join(taken.withColumn("__taken", F.lit(True)).distinct(), ["kind", "new"], "left")
        first = F.row_number().over(Window.partitionBy("kind", "new").orderBy("canon")) == 1
        won = first & F.col("__taken").isNull() & (F.col("new") != F.col("canon"))
        judged = stage_table(free.withColumn("won", won).select(*entities.columns, "new", "won"), "surrogates")
        winners = judged.filter("won").select("kind", "canon", "new")
        done = winners if done is None else done.unionByName(winners)
        pending = judged.filter("not won").select(*entities.columns)
        if pending.isEmpty():
            return done
        taken = taken.unionByName(winners.select("kind", "new"))
    raise RuntimeError("some entities found no free surrogate")


def has_entity(text: Column) -> Column:
    """Every kind but names has a digit or an at sign: most texts need one look for these and one for names."""
    return F.coalesce(text.rlike(f"(?=[A-ZгА-Я])(?:{PATTERNS['name']})") | (text.rlike("[0-9@]") & text.rlike(ANY)), F.lit(False))


def _filled(text: Column, found: Column, pattern: str, new) -> Column:
    """text with what the pattern found in it exchanged."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda p, e: F.concat(p, F.coalesce(new(e), F.lit("")))), "")


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with entities of the text replaced; count names a column for their number (bare words of names aren't counted)."""
    columns = docs.columns
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    digest = F.sha2(F.col(text), 256)
    hit, clean = docs.filter(has_entity(F.col(text))), docs.filter(~has_entity(F.col(text)))
    mentions = hit.select(digest.alias("__id"), F.explode(F.array_distinct(found)).alias("entity")).withColumn("kind", kind_of(F.col("entity")))
    numbers = F.array(F.struct(canonical(F.col("kind"), F.col("entity")).alias("canon"), F.lit("x").alias("sex"), F.lit(False).alias("given")))
    parts = F.when(F.col("kind") == "name", name_words(F.col("entity"))).otherwise(numbers)
    mentions = mentions.withColumn("part", F.explode(parts)).select("__id", "kind", F.when(F.col("kind") == "name", F.col("part.canon")).otherwise(F.col("entity")).alias("entity"), "part.*")
    mentions = stage_table(mentions.groupBy("__id", "kind", "entity", "canon").agg(F.min("sex").alias("sex"), F.max("given").alias("given"), F.count(F.lit(1)).alias("n")), "mentions")
    known = assign(mentions.groupBy("kind", "canon").agg(F.min("sex").alias("sex"), F.max("given").alias("given")), key)
    laid = mentions.select("__id", "entity", "kind", "canon").join(known, ["kind", "canon"])
    laid = laid.select("__id", F.struct(F.concat(F.when(F.col("kind") == "name", "n").otherwise("e"), "entity").alias("key"), lay_out(F.col("kind"), F.col("entity"), F.col("new")).alias("value")).alias("__e"))
    # a text's own entities: bounded by its length
    maps = laid.groupBy("__id").agg(F.map_from_entries(F.collect_list("__e")).alias("__map"))
    keyed = hit.withColumn("__id", digest)
    sizes = mentions.groupBy("__id").agg(F.min("n").alias("n"))  # rows with the text, or a few times as many
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in sizes.filter(F.col("n") * HOT > max(total, HOT * SALTS)).select("__id").collect()]  # fewer than HOT texts
    if hot:
        marks = F.broadcast(hit.sparkSession.createDataFrame([(h,) for h in hot], "__h string").select(F.col("__h").alias("__id"), F.lit(True).alias("__hot")))
        salt = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
        keyed = keyed.join(marks, "__id", "left").withColumn("__salt", salt).drop("__hot")
        maps = maps.join(marks, "__id", "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
        joined = keyed.withColumn("__salt", F.col("__salt").cast("int")).join(maps, ["__id", "__salt"])
    else:
        joined = keyed.join(maps, "__id")
    entry = lambda mark, e: F.element_at(F.col("__map"), F.concat(F.lit(mark), F.coalesce(e, F.lit(""))))

    def word(w: Column) -> Column:
        new = entry("n", F.lower(w))
        return F.when(new.isNull(), w).when((F.upper(w) == w) & (F.length(w) > 1), F.upper(new)).otherwise(F.initcap(new))

    words = lambda t: _filled(t, F.regexp_extract_all(t, F.lit(LONE_WORD), F.lit(0)), LONE_WORD, word)
    other = _filled(F.col(text), found, ANY, lambda e: F.coalesce(entry("e", e), e))
    named = F.exists(F.map_keys("__map"), lambda k: k.startswith("n"))
    both = joined.withColumn("__text", other)
    out = both.select(*[F.when(named, words(F.col("__text"))).otherwise(F.col("__text")).alias(c) if c == text else F.col(c) for c in columns], *([F.size(found).alias(count)] if count else []))
    rest = clean.select(*columns, *([F.lit(0).alias(count)] if count else []))
    return out.unionByName(rest)
