"""Surrogates for personal data and secrets.

Entities are found with one pattern; each distinct one gets a replacement of its own type, script, case and format,
derived from a secret key, so that equal entities are replaced alike in all documents. Replacements that meet each
other or a real entity are derived anew until all are distinct. A person who is named with a form of address is
replaced wherever the document names them again, with or without it. Only DataFrame functions are used. The texts are
searched once; what is found is written and used from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Forms of address by gender (m, f, or n for either).
TITLES = {"m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"], "n": ["Dr", "Prof"]}

#: Given names by gender and script.
GIVEN = {
    "m latin": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Nils", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    "f latin": ["Anna", "Berta", "Clara", "Diana", "Elena", "Fiona", "Greta", "Helen", "Irene", "Julia", "Klara", "Laura", "Maria", "Nina", "Olivia", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
    "m cyrillic": ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Леонид", "Максим", "Николай", "Олег", "Павел", "Роман", "Сергей", "Тимур"],
    "f cyrillic": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лариса", "Мария", "Надежда", "Ольга", "Полина", "Раиса", "Светлана", "Тамара", "Юлия"],
}

#: Syllables of invented names.
SYLLABLES = {"latin": ["bar", "den", "fal", "gor", "hel", "kam", "lin", "mar", "nor", "pel", "rin", "sol", "tor", "vel", "win", "zan"], "cyrillic": ["бар", "ден", "фал", "гор", "хел", "кам", "лин", "мар", "нор", "пел", "рин", "сол", "тор", "вел", "вин", "зан"]}

_FORMS = "(?:" + "|".join(dict.fromkeys(x for v in TITLES.values() for t in v for x in (t, t.lower(), t.upper()))) + ")"
_TITLE = _FORMS + r"\.?"

#: Particles of surnames, which stay.
PARTICLES = ["van der", "van den", "van de", "van", "von der", "von", "de la", "del", "della", "de", "der", "den", "di", "da", "dos", "le", "la", "bin", "al", "el"]

_PARTICLE = f"(?:{'|'.join(PARTICLES)}) "
_WORD = rf"(?!{_FORMS}(?!\p{{L}})|[A-Za-z0-9._%+\-]*@)" + r"\p{Lu}(?:['\u2019]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+){0,7}"
_NAME = rf"(?:\p{{Lu}}\. ){{0,3}}(?:{_PARTICLE})?{_WORD}(?:(?: \p{{Lu}}\.)? (?:{_PARTICLE})?{_WORD})?"

#: The kinds of entity, in the order in which they are tried, with their patterns. Groups repeat a bounded number of times (a domain
#: has at most 127 labels, a name eight parts): Java's matcher goes one call deeper for each.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.){1,127}[A-Za-z]{2,}",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=(?:password|passwd|secret|token|api_key)=)[^\s\"']+|(?<=(?:password|passwd|secret|token|api_key) ?[=:] ?[\"'])[^\s\"']+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9])0[0-9]{2,4}[ /\-][0-9]{6,8}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ \-]?[0-9]{4}){3}|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?!\.?[0-9])",
    "name": rf"(?<![\p{{L}}]){_TITLE} {_NAME}",
}

PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without a match of this one has no entity; it needs one pass over the text.
SIGN = r"[0-9@]|AKIA|ASIA|(?:password|passwd|secret|token|api_key) ?[=:]|" + _TITLE + rf" (?:{_PARTICLE})?\p{{Lu}}"
#: Rounds of deriving clashing surrogates anew.
ROUNDS = 24


def _kind(x: Column) -> Column:
    out = F.lit("secret")
    for k, p in reversed(KINDS.items()):
        if k != "secret":
            bare = p.replace(r"(?<![\p{L}])", "")
            out = F.when(x.rlike(f"^(?:{bare})$"), k).otherwise(out)
    return out


def _byte(i: str) -> str:
    """The i-th byte of the keyed hash in column ``hex``, over and over."""
    return f"cast(conv(substring(hex, cast(({i}) % 64 * 2 + 1 as int), 2), 16, 10) as int)"


def _same_form(value: str, skip: str = "0") -> str:
    """Digits for digits and letters for letters of either case; the first ``skip`` characters stay."""
    letter = lambda first: f"chr({ord(first)} + {_byte('i')} % 26)"
    return (
        f"array_join(transform(split({value}, ''), (c, i) -> case when i < {skip} then c when c rlike '[0-9]' then cast({_byte('i')} % 10 as string) "
        f"when c rlike '[a-z]' then {letter('a')} when c rlike '[A-Z]' then {letter('A')} else c end), '')"
    )


def _pick(words: list[str], i: str) -> str:
    return f"element_at(array({', '.join(repr(w) for w in words)}), {_byte(i)} % {len(words)} + 1)"


def _invented(script: str, end: str) -> str:
    return f"initcap(concat({_pick(SYLLABLES[script], '1')}, {_pick(SYLLABLES[script], '2')}, if({_byte('3')} % 2 = 0, {_pick(SYLLABLES[script], '4')}, ''), if({_byte('5')} % 4 = 0, {_pick(SYLLABLES[script], '6')}, ''), {end}))"


def _digit_of(digits: str) -> str:
    """``value`` with its digits replaced in turn by those of the array ``digits``."""
    nth = "length(regexp_replace(substring(value, 1, i + 1), '[^0-9]', ''))"
    return f"array_join(transform(split(value, ''), (c, i) -> if(c rlike '[0-9]', cast(element_at({digits}, greatest({nth}, 1)) as string), c)), '')"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _surrogate() -> str:
    """Replacement of ``value`` of type ``kind`` and gender ``gender``; ``hex`` is its keyed hash of this ``attempt``."""
    # cards keep the first digit and end in a valid check digit
    size = "length(regexp_replace(value, '[^0-9]', ''))"
    digits = f"transform(sequence(0, {size} - 2), i -> if(i = 0, cast(substring(regexp_replace(value, '[^0-9]', ''), 1, 1) as int), {_byte('i')} % 10))"
    doubled = "aggregate(transform(ds, (d, i) -> if((size(ds) + 1 - i) % 2 = 0, if(d * 2 > 9, d * 2 - 9, d * 2), d)), 0, (a, d) -> a + d)"
    card = _let("ds", digits, _let("es", f"concat(ds, array((10 - {doubled} % 10) % 10))", _digit_of("es")))
    # an account keeps its country; its check digits are those of the new number
    bare = "regexp_replace(a, ' ', '')"
    worth = "if(c rlike '[0-9]', cast(c as int), ascii(c) - 55)"
    rest = f"aggregate(split(concat(substring({bare}, 5), substring({bare}, 1, 2), '00'), ''), 0, (n, c) -> (n * if(c rlike '[0-9]', 10, 100) + {worth.replace('cast(c as int)', 'try_cast(c as int)')}) % 97)"
    iban = _let("a", _same_form("value", "2"), f"concat(substring(a, 1, 2), lpad(cast(98 - {rest} as string), 2, '0'), substring(a, 5))")
    latin = "value rlike '^[\\\\p{IsLatin}]+$'"
    given = {}
    for g, end in (("m", ("'o'", "'ий'")), ("f", ("'a'", "'а'")), ("n", ("'is'", "'ин'"))):
        for script, e in zip(("latin", "cyrillic"), end):
            made = _invented(script, e)
            given[g, script] = f"if(attempt = 0, {_pick(GIVEN[f'{g} {script}'], '0')}, {made})" if g != "n" else made
    person = "case " + " ".join(f"when gender = '{g}' and {latin if s == 'latin' else 'not ' + latin} then {x}" for (g, s), x in given.items()) + " end"
    end = "case when value rlike '(ов|ев|ёв|ин|ын)$' then 'ов' when value rlike '(ск|цк)$' then 'ск' else '' end"
    surname = f"if({latin}, {_invented('latin', chr(39) * 2)}, {_invented('cyrillic', end)})"
    email = f"concat({_same_form('substring_index(value, chr(64), 1)')}, '@', {_same_form("regexp_extract(value, '@(.*)[.][A-Za-z]+$', 1)")}, '.', substring_index(value, '.', -1))"
    octets = f"array_join(transform(sequence(0, 3), i -> cast(1 + {_byte('i')} % 254 as string)), '.')"
    hexes = f"array_join(transform(split(value, ''), (c, i) -> lower(conv(cast({_byte('i')} % 16 as string), 10, 16))), '')"
    return (
        f"case when kind = 'given' then {person} when kind = 'surname' then {surname} when kind = 'email' then {email} when kind = 'ip' then {octets} when kind = 'card' then {card} "
        f"when kind = 'aws_key' then {_same_form('value', '4')} when kind = 'iban' then {iban} "
        f"when kind = 'phone' then {_same_form('value', "if(value like '+%', length(regexp_extract(value, '^[+][0-9]{1,3}(?=[^0-9])', 0)), 0)")} "
        f"when value rlike '^[0-9a-f]{{8,}}$' then {hexes} else {_same_form('value')} end"
    )


def distinct_surrogates(found: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, value and surrogate of each distinct (kind, value) of ``found`` (kind, value, gender: m, f or n).

    A given name has the gender that most of its mentions with one have. A surrogate that another value of its kind
    has too, or that is itself a value, is derived anew with the next attempt, except for the smallest of the values
    that share it; after eight attempts it also grows by a counter. What still clashes after all rounds, in formats
    with too few members, gets twelve digits of its keyed hash appended.
    """
    votes = found.groupBy("kind", "value", "gender").agg(F.count("*").alias("n"))
    e = votes.groupBy("kind", "value").agg(F.max_by("gender", F.struct((F.col("gender") != "n").alias("known"), "n", "gender")).alias("gender"))
    e, made = cut(e.withColumn("attempt", F.lit(0))), F.expr(_surrogate())
    for i in range(rounds):
        s = e.withColumn("hex", F.sha2(F.concat_ws("|", F.lit(key), "kind", "value", F.col("attempt").cast("string")), 512)).withColumn("surrogate", made)
        s = s.withColumn("surrogate", F.when(F.col("attempt") > 8, F.concat("surrogate", F.col("attempt").cast("string"))).otherwise(F.col("surrogate")))
        s = cut(s)
        keeper = s.groupBy("kind", F.lower("surrogate").alias("low")).agg(F.min("value").alias("keeper"))
        real = s.select("kind", F.lower("value").alias("low"), F.lit(True).alias("real")).distinct()
        checked = s.withColumn("low", F.lower("surrogate")).join(keeper, ["kind", "low"]).join(real, ["kind", "low"], "left")
        checked = cut(checked.select("kind", "value", "gender", "surrogate", "hex", "attempt", (F.col("real").isNotNull() | (F.col("value") != F.col("keeper"))).alias("clash")))
        if checked.where("clash").isEmpty() or i == rounds - 1:
            return checked.select("kind", "value", F.when(F.col("clash"), F.concat("surrogate", F.lit("-"), F.substring("hex", 1, 12))).otherwise(F.col("surrogate")).alias("surrogate"))
        e = checked.select("kind", "value", "gender", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def _stem(part: Column) -> Column:
    """A surname without the ending that tells gender."""
    low = F.lower(part)
    return F.when(low.rlike("(ов|ев|ёв|ин|ын)а$"), F.expr("substring(part, 1, length(part) - 1)")).when(low.rlike("(ск|цк)(ий|ая)$"), F.expr("substring(part, 1, length(part) - 2)")).otherwise(part)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """Texts with surrogates for all detected entities.

    Returns doc_id, text, n_entities and kinds (distinct, sorted, comma-joined), a row for each row of ``docs``.
    Emails, phone numbers, IP addresses, card numbers (which keep a valid check digit), IBANs (likewise), social security
    numbers, access keys, secrets after ``password=`` and the like, and names after a form of address are replaced; a
    person so named also where the same document names them without it. Names keep gender, script, case, particles and
    marks, and each word of a name has one surrogate under all forms of address; a word is a
    given name or a surname as most of its mentions have it. Names that a document never mentions
    with a form of address stay. Entities are compared without regard to case. ``key``, which is not to be empty,
    makes the replacement secret.

    A null text stays null and an empty one empty, with no entities; repeated rows are replaced alike; an empty
    table gives no rows. Other columns don't matter.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    t = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    found = F.when(F.col("text").rlike(SIGN), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    hits = t.select("doc_id", F.xxhash64("text").alias("text_hash"), found.alias("found")).where(F.size("found") > 0)
    hits = written(hits, "entities")
    one = hits.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.posexplode("found").alias("pos", "entity"))
    one = cut(one.withColumn("kind", _kind(F.col("entity"))))

    # names: each word of a name is a part, given names before the last space, the surname after it
    names = one.where("kind = 'name'").withColumn("title", F.regexp_extract("entity", f"^({_TITLE}) ", 1)).withColumn("rest", F.expr("substring(entity, length(title) + 2)"))
    title = F.lower(F.regexp_replace("title", r"\.$", ""))
    gender = F.when(title.isin([x.lower() for x in TITLES["m"]]), "m").when(title.isin([x.lower() for x in TITLES["f"]]), "f").otherwise("n")
    last = F.regexp_extract("rest", r"([^ ]+)$", 1)
    first = F.regexp_replace(F.expr("substring(rest, 1, length(rest) - length(regexp_extract(rest, '([^ ]+)$', 1)))"), f"(?:^| ){_PARTICLE}", " ")
    words = lambda x: F.filter(F.regexp_extract_all(x, F.lit(r"\p{L}+"), F.lit(0)), lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}"))
    each = F.concat(F.transform(words(first), lambda w: F.struct(F.lit("given").alias("kind"), w.alias("part"))), F.transform(words(last), lambda w: F.struct(F.lit("surname").alias("kind"), w.alias("part"))))
    parts = cut(names.select("doc_id", "text_hash", gender.alias("gender"), F.inline(each)).withColumn("word", F.initcap("part")))
    votes = parts.groupBy("word", "kind").agg(F.count("*").alias("n")).groupBy("word").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))  # a word is a given name or a surname everywhere
    parts = cut(parts.drop("kind").join(votes, "word").withColumn("value", F.initcap(F.when(F.col("kind") == "surname", _stem(F.col("part"))).otherwise(F.col("part")))))
    others = one.where("kind <> 'name'").withColumn("value", F.when(F.col("kind").isin("secret", "aws_key", "iban"), F.col("entity")).otherwise(F.lower("entity")))
    known = cut(distinct_surrogates(parts.select("kind", "value", "gender").unionByName(others.select("kind", "value", F.lit("n").alias("gender"))), key))

    # of a document: what each word of its people's names becomes, as written, capitalised, in capitals, and in both genders
    p = parts.join(known, ["kind", "value"])
    slavic = F.when((F.col("kind") == "surname") & F.col("value").rlike("(ов|ев|ёв|ин|ын)$"), F.array(F.lit(""), F.lit("а"))).when((F.col("kind") == "surname") & F.col("value").rlike("(ск|цк)$"), F.array(F.lit("ий"), F.lit("ая"))).otherwise(F.array(F.lit("")))
    p = p.select("doc_id", "text_hash", "kind", "value", "surrogate", F.explode(slavic).alias("end"))
    p = p.select("doc_id", "text_hash", "kind", F.concat("value", "end").alias("old"), F.concat("surrogate", "end").alias("new"))
    p = p.select("doc_id", "text_hash", "kind", F.inline(F.array(F.struct("old", "new"), F.struct(F.upper("old").alias("old"), F.upper("new").alias("new")))))
    people = p.groupBy("doc_id", "text_hash", "old").agg(F.min(F.struct("kind", "new")).alias("x")).groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("old", F.col("x.new").alias("new")))).alias("people"))

    cased = F.when((F.col("entity") == F.upper("entity")) & (F.col("kind") == "email"), F.upper("surrogate")).otherwise(F.col("surrogate"))
    plain = others.join(known, ["kind", "value"]).select("doc_id", "text_hash", "pos", "kind", F.lit("").alias("title"), cased.alias("new"))
    ready = plain.unionByName(names.select("doc_id", "text_hash", "pos", "kind", "title", F.col("rest").alias("new")))
    ready = ready.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "title", "new"))).alias("x"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    none = F.expr("cast(map() as map<string,string>)")
    ready = written(ready.alias("r").join(people.alias("q"), same("r", "q"), "left").select("r.doc_id", "r.text_hash", "x", F.coalesce("people", none).alias("people")), "replacements")

    # Only texts that may have entities are shuffled: a bit set of their hashes, of at most 8 MB, tells; others pass by.
    n_words = 1 << min(20, max(6, (hits.count() // 4).bit_length()))
    word = F.shiftright("text_hash", 6).bitwiseAND(F.lit(n_words - 1))
    marked = hits.select(word.alias("word"), F.expr("shiftleft(1L, cast(text_hash & 63 as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    every = t.withColumn("text_hash", F.xxhash64("text")).withColumn("word", word).join(F.broadcast(marked), "word", "left")  # at most n_words rows
    maybe = F.coalesce(F.expr("shiftright(bits, cast(text_hash & 63 as int)) & 1") == 1, F.lit(False))
    plain = every.where(~maybe).select(F.col("doc_id").cast(kind).alias("doc_id"), "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    h = every.where(maybe).select("doc_id", "text", "text_hash").alias("h").join(ready.hint("merge").alias("r"), same("h", "r"), "left")
    renamed = lambda x: F.when(F.size("r.people") == 0, x).otherwise(F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at("r.people", w), w)), ""))
    new = F.transform("r.x", lambda e: F.when(e["kind"] == "name", F.concat(e["title"], F.lit(" "), renamed(e["new"]))).otherwise(e["new"]))
    pieces = F.zip_with(F.split("h.text", PATTERN), new, lambda a, b: F.array(renamed(a), F.coalesce(b, F.lit(""))))
    text = F.when(F.col("r.x").isNull(), F.col("h.text")).otherwise(F.array_join(F.flatten(pieces), ""))
    kinds = F.array_join(F.sort_array(F.array_distinct(F.col("r.x.kind"))), ",")
    changed = h.select(F.col("h.doc_id").cast(kind).alias("doc_id"), text.alias("text"), F.when(F.col("r.x").isNull(), 0).otherwise(F.size("r.x")).cast("long").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("kinds"))
    return plain.unionByName(changed)
