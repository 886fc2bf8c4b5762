"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

Detection is one regular expression over the whole text: e-mail addresses, phone numbers, card and account numbers, IP addresses,
social security numbers, access keys and hex tokens, and names. A name is one or two capitalised words after a title or after a phrase by which people
give their name, or a known given name and a capitalised word; other names aren't found. An address has at most 64 characters before its sign and 63 in each
label, a word of a name at most 61; no repetition in the pattern recurses, so a text of any length passes. A surrogate is made from the
SHA-256 of key, kind, value and attempt: digits stay digits in the same layout, a card number that satisfies the Luhn check gets one that does, an account number with right check digits gets right ones,
an address gets a reserved example domain, a name gets a given name of its gender and script and a made-up
surname. Values are normalised first (case, separators), so one entity gets one surrogate in every layout and document, and a
surname alone gets what it gets after a given name, a phone number what it gets after a country code. Secrets and titles are found in any case, and a replacement takes the case of what it
replaces; only "miss" and "ms" in lower case aren't titles. In a text all in upper case the word after a lone surname counts as part of the name.

Collision check: over the corpus's distinct values, a surrogate that two values share, or that is itself a value of
the corpus, moves all but the least value on to the next attempt, until none is left. Each attempt lengthens names and addresses, and beyond DENSE attempts,
when a format of fixed length is nearly used up, other surrogates get a further digit each time (an IP address a port), so that the attempts come to an end with any number of values. Surrogates are computed in place and texts
aren't shuffled: the values with an attempt above 0 go to all tasks if they are few, and are joined to their documents if they are many.

All of it is DataFrame functions.

Defined results: null text stays null and empty stays empty, with no entities; repeated rows get the same surrogates; extra columns
are kept by ``surrogate_text`` and ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

KEY = "provenir-surrogates"
DENSE = 30  # attempts of a fixed length
MAX_BROADCAST = 20_000  # values with an attempt above 0 that all tasks get; more are joined
SLOTS = 256
Attempts = Callable[[Column], Column]

# Titles by gender, phrases before a name, given names by script and gender, syllables by script.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
    "u": ["Dr", "Prof"],
}
CUES = ["my name is", "ich heiße", "je m'appelle", "me llamo", "меня зовут"]
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Cedric", "Dominic", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Beatrice", "Clara", "Dora", "Elena", "Flora", "Greta", "Helena", "Ines", "Julia", "Karin", "Livia", "Marta", "Nora", "Olivia", "Petra"],
    ("latin", "u"): ["Alex", "Robin", "Kim", "Sascha", "Dominique", "Jordan", "Morgan", "Quinn"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
    ("cyrillic", "u"): ["Саша", "Женя", "Валя", "Слава"],
    ("greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Νίκος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("greek", "u"): ["Χάρις", "Φώτις"],
}
SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dan", "del", "fen", "gar", "hal", "kel", "lan", "mer", "nor", "pel", "ros", "tan", "wes"],
    "cyrillic": ["бар", "бел", "вол", "гор", "дан", "зор", "кал", "лан", "мер", "нор", "пел", "рос", "сол", "тан", "фед", "хол"],
    "greek": ["βαρ", "γαλ", "δαν", "ζερ", "θαλ", "καλ", "λαν", "μερ", "νορ", "παλ", "ροδ", "σαλ", "ταν", "φερ", "χαλ", "ψαν"],
}
SCRIPTS = ("latin", "cyrillic", "greek")

_TITLE = "(?!m(?:is)?s[. ])(?iu:" + "|".join(t for g in "mfu" for t in sorted(TITLES[g], key=len, reverse=True)) + ")"
_CUE = "(?iu:" + "|".join(CUES) + ")"
_KNOWN = "(?iu:" + "|".join(n for (_, g), names in GIVEN.items() if g != "u" for n in names) + ")"
_NAME = r"\p{Lu}[\p{L}'’-]{1,60}+(?![\p{L}'’-])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+",
    "phone": r"(?:\+\d{1,3}[ .-]?|(?<![\d(])(?=\())(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.-])[2-9]\d{2}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d-]|\.\d)",
    "secret": r"(?<![A-Za-z0-9])(?i:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Z0-9]{36}|sk-[A-Z0-9]{20,64}|[0-9a-f]{32,64})(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<!\d)(?<!\d[.,])\d(?:[ -]?\d){12,18}(?!\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLE}\.?|{_CUE}) {_NAME}(?: {_NAME})?",
    "known": rf"(?<!\p{{L}})(?=\p{{Lu}}){_KNOWN} {_NAME}",
}
PATTERN = "|".join(PATTERNS.values())
# Country codes of one and two digits; all others have three.
CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
GATE = rf"[0-9@]|{_TITLE}[. ]|[0-9a-fA-F]{{32}}|{_CUE} |{PATTERNS['known']}"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that it reads many times: computed once, and once in the plan."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def entities(text: Column) -> Column:
    """Entities of a text in order, as they stand there."""
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))


def kind_of(e: Column) -> Column:
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(e.rlike("^(?i:AKIA|gh[pousr]_|sk-)"), "secret")
        .when(e.rlike("^[0-9a-fA-F]{32,64}$"), "hex")
        .when(e.rlike(r"^[+(]|^\d{3}(-\d{3}-|\.\d{3}\.)\d{4}$"), "phone")
        .when(e.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(e.rlike(r"^\d"), "card")
        .otherwise("person")
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(title: Column, given: Column) -> Column:
    title, titles = F.lower(title), {g: [t.lower() for t in TITLES[g]] for g in "mf"}
    known = {g: [n.lower() for s in SCRIPTS for n in GIVEN[s, g]] for g in "mf"}
    return F.when(title.isin(titles["m"]), "m").when(title.isin(titles["f"]), "f").when(F.lower(given).isin(known["m"]), "m").when(F.lower(given).isin(known["f"]), "f").otherwise("u")


def _person(e: Column) -> tuple[Column, Column, Column]:
    """title or phrase with its space, or empty; given name or empty; surname"""
    head = F.regexp_extract(e, rf"^((?:{_TITLE}\.?|{_CUE}) )", 1)
    names = F.split(F.substr(e, F.length(head) + 1), " ")
    return head, F.when(F.size(names) > 1, names[0]).otherwise(F.lit("")), F.element_at(names, -1)


def units(e: Column) -> Column:
    """What of an entity gets a surrogate: an array of kind and normalised value, one for each, two for a full name."""
    return let(F.struct(kind_of(e).alias("kind"), *[c.alias(n) for n, c in zip(("head", "given", "surname"), _person(e), strict=True)]), lambda x: _units(e, x["kind"], x["head"], x["given"], x["surname"]))


def _national(e: Column) -> Column:
    """The digits of a phone number behind its country code, where it is written with one."""
    return F.regexp_replace(F.regexp_replace(e, CODE, ""), r"\D", "")


def _units(e: Column, kind: Column, head: Column, given: Column, surname: Column) -> Column:
    digits = F.regexp_replace(e, r"\D", "")
    norm = F.when(kind.isin("email", "secret", "hex"), F.lower(e)).when(kind == "phone", _national(e)).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(e, " ", "")).otherwise(e)
    gender = _gender(F.regexp_extract(head, r"^(\p{L}+)", 1), given)
    unit = lambda k, v: F.struct(k.alias("kind"), v.alias("norm"))
    last = unit(F.concat(F.lit("surname."), _script(surname)), F.lower(surname))
    first = unit(F.concat(F.lit("given."), gender, F.lit("."), _script(given)), F.lower(given))
    return F.when(kind != "person", F.array(unit(kind, norm))).when(given == "", F.array(last)).otherwise(F.array(first, last))


def _table(values: dict[str, list[str]]) -> Column:
    """A constant map to arrays of lower-cased strings."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*[F.lit(w.lower()) for w in v]))])


def _number(hex_: Column, at: Column, size: int) -> Column:
    return F.conv(F.substr(hex_, at, F.lit(size)), 16, 10).cast("long")


def _pick(values: Column, number: Column) -> Column:
    return F.try_element_at(values, (number % F.size(values) + 1).cast("int"))


def _weave(shape: Column, digits: Column, letters: Column) -> Column:
    """The shape with its digits and letters replaced in order; case and all other signs stay."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("d"), F.lit(1).alias("l"))

    def step(acc: Column, c: Column) -> Column:
        d, low, up = F.substr(digits, acc["d"], F.lit(1)), c.rlike("^[a-z]$"), c.rlike("^[A-Z]$")
        letter = F.substr(letters, acc["l"], F.lit(1))
        digit = c.rlike("^[0-9]$")
        put = F.when(digit, d).when(low, letter).when(up, F.upper(letter)).otherwise(c)
        return F.struct(F.concat(acc["out"], put).alias("out"), (acc["d"] + digit.cast("int")).alias("d"), (acc["l"] + (low | up).cast("int")).alias("l"))

    return F.aggregate(F.split(shape, ""), state, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _mod97(account: Column) -> Column:
    """The remainder of an account number, its first four characters moved to the end, by 97: 1 where the check digits are right."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    each = lambda a, c: F.when(c.rlike("^[0-9]$"), a * 10 + c.cast("int")).when(c.rlike("^[A-Z]$"), a * 100 + F.ascii(c) - 55).otherwise(a) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), each)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The normalised surrogate of a unit."""
    made = lambda x: F.struct(x["a"].alias("a"), F.sha2(F.concat_ws("|", F.lit(key), kind, x["a"].cast("string"), norm), 256).alias("hex"))
    more = lambda x: F.struct(x["a"].alias("a"), x["hex"].alias("hex"), F.translate(x["hex"], "abcdef", "270583").alias("digits"), F.translate(x["hex"], "0123456789abcdef", "etaoinshrdlumcfg").alias("letters"))
    return let(let(let(F.struct(attempt.alias("a")), made), more), lambda x: _surrogate(kind, norm, x["a"], x["hex"], x["digits"], x["letters"]))


def _surrogate(kind: Column, norm: Column, attempt: Column, hex_: Column, digits: Column, letters: Column) -> Column:
    n = F.length(norm)
    further = F.when(attempt > DENSE, F.substr(digits, F.lit(41), F.least(attempt - DENSE, F.lit(24)))).otherwise("")
    phone = F.concat(F.translate(F.substr(digits, F.lit(1), F.lit(1)), "01", "57"), F.substr(digits, F.lit(2), n - 1))
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(digits, F.lit(1), n - 2))
    check = F.when(_luhn(norm) == 0, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")).otherwise(F.substr(digits, F.lit(40), F.lit(1)))
    octet = lambda at, mod, plus: (_number(hex_, F.lit(at), 6) % mod + plus).cast("string")
    local = F.substring_index(norm, "@", 1)
    tld = F.when(norm.rlike(r"\.(com|org|net)$"), F.substring_index(norm, ".", -1)).otherwise("com")
    number = F.substr(digits, F.lit(50), F.least(attempt + 1, F.lit(15)))
    woven = lambda shape: _weave(shape, F.concat(digits, digits), F.concat(letters, letters))
    email = F.concat(woven(local), F.lit("@mail"), number, F.lit(".example."), tld)
    prefix = F.regexp_extract(norm, "^(akia|gh[pousr]_|sk-)", 1)
    secret = F.concat(prefix, woven(F.substr(norm, F.length(prefix) + 1)))
    land = F.substr(norm, F.lit(1), F.lit(2))
    right = lambda account: F.lpad((98 - _mod97(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0")
    iban = let(woven(F.substr(norm, F.lit(5))), lambda a: F.concat(land, F.when(_mod97(norm) == 1, right(a)).otherwise(F.substr(digits, F.lit(38), F.lit(2))), a))
    ip = F.concat_ws(".", octet(1, 223, 1), octet(7, 256, 0), octet(13, 256, 0), octet(19, 254, 1))
    out = (
        F.when(kind == "email", email)
        .when(kind == "phone", F.concat(phone, further))
        .when(kind == "card", F.concat(body, check, further))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(digits, F.lit(1), n - 1), further))
        .when(kind == "ip", F.concat(ip, F.when(further != "", F.concat(F.lit(":"), further)).otherwise("")))
        .when(kind == "secret", F.concat(secret, further))
        .when(kind == "iban", F.concat(iban, further))
        .when(kind == "hex", F.concat(F.substr(hex_, F.lit(1), n), further))
    )
    given = F.try_element_at(_table({f"given.{g}.{script}": v for (script, g), v in GIVEN.items()}), kind)
    parts = F.try_element_at(_table(SYLLABLES), F.substring_index(kind, ".", -1))
    syllables = lambda count: F.array_join(F.transform(F.sequence(F.lit(1), F.least(count, F.lit(16))), lambda i: _pick(parts, _number(hex_, i * 4 - 3, 4))), "")
    out = out.when(kind.startswith("surname."), syllables(attempt + 2))
    return out.when(kind.startswith("given."), F.concat(_pick(given, _number(hex_, F.lit(1), 6)), F.when(attempt > 0, syllables(attempt)).otherwise("")))


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(word)).otherwise(F.initcap(word))


def _cased_as(value: Column, like: Column) -> Column:
    """The value with its letters in upper case where ``like``, of the same length, has them so."""
    return F.array_join(F.zip_with(F.split(value, ""), F.split(like, ""), lambda c, x: F.when(x.rlike("^[A-Z]$"), F.upper(c)).otherwise(c)), "")


def render(e: Column, attempts: Attempts | None, key: str) -> Column:
    """An entity's replacement in the entity's own layout."""
    found = units(e)

    def made(u: Column) -> Column:
        name = F.concat_ws("|", u["kind"], u["norm"])
        attempt = F.lit(0) if attempts is None else attempts(name)
        return surrogate(u["kind"], u["norm"], attempt, key)

    parts = F.struct(F.transform(found, made).alias("new"), kind_of(e).alias("kind"), *[c.alias(n) for n, c in zip(("head", "given", "surname"), _person(e), strict=True)])
    return let(parts, lambda x: _laid_out(e, x["new"], x["kind"], x["head"], x["given"], x["surname"]))


def _laid_out(e: Column, new: Column, kind: Column, head: Column, given: Column, surname: Column) -> Column:
    name = F.concat(head, F.when(given == "", F.lit("")).otherwise(F.concat(_cased(new[0], given), F.lit(" "))), _cased(F.element_at(new, -1), surname))
    hex_ = F.when(e.rlike("[A-F]") & ~e.rlike("[a-f]"), F.upper(new[0])).otherwise(new[0])
    # digits in the entity's layout, behind a phone number's country code; what an attempt beyond DENSE added comes last
    digits = F.regexp_replace(e, r"\D", "")
    all_ = F.when(kind == "phone", F.concat(F.substr(digits, F.lit(1), F.length(digits) - F.length(_national(e))), new[0])).otherwise(new[0])
    laid = F.concat(_weave(e, all_, F.lit("")), F.substr(all_, F.length(digits) + 1))
    out = F.when(kind == "person", name).when(kind == "secret", _cased_as(new[0], e)).when(kind == "hex", hex_)
    out = out.when(kind.isin("phone", "card", "ssn"), laid)
    return out.when(kind == "iban", F.concat(_respace(e, new[0]), F.substr(new[0], F.length(F.regexp_replace(e, " ", "")) + 1))).otherwise(new[0])


def _respace(e: Column, value: Column) -> Column:
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substr(value, acc["i"], F.lit(1)))).alias("out"), (acc["i"] + (c != " ").cast("int")).alias("i"))
    return F.aggregate(F.split(e, ""), state, step, lambda acc: acc["out"])


def resolve(values: DataFrame, key: str = KEY) -> DataFrame:
    """kind, norm, attempt of the distinct values whose first surrogate won't do."""
    every = materialize(values.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)), "values")
    current = every
    while True:
        made = current.withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key))
        shared = made.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("norm").alias("first")).where("n > 1")
        twice = made.join(shared, ["kind", "new"]).where("norm <> first").select("kind", "norm")
        real = made.join(every.select("kind", F.col("norm").alias("new")), ["kind", "new"], "left_semi").select("kind", "norm")
        again = materialize(twice.unionByName(real).distinct(), "again")
        if again.isEmpty():
            return current.where("attempt > 0")
        moved = current.join(again.withColumn("_up", F.lit(1)), ["kind", "norm"], "left")
        current = materialize(moved.select("kind", "norm", (F.col("attempt") + F.coalesce("_up", F.lit(0))).alias("attempt")), "values")


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, and _pv_entities, the entities that it held."""
    text = [F.xxhash64("text"), F.xxhash64("text", F.lit(1))]  # what a text holds goes by the text, not by its row
    found = docs.withColumn("_pv_entities", entities(F.col("text")))
    held = docs.select(text[0].alias("h1"), text[1].alias("h2"), F.explode(F.array_distinct(entities(F.col("text")))).alias("e"))
    values = held.select("h1", "h2", F.explode(units(F.col("e"))).alias("u")).select("h1", "h2", "u.kind", "u.norm")
    moved = materialize(resolve(values, key), "attempts")
    name = F.concat_ws("|", "kind", "norm")
    some = moved.limit(MAX_BROADCAST + 1).count()
    attempts: Attempts | None = None
    if some > MAX_BROADCAST:  # joined to the texts that hold them
        own = values.distinct().join(moved, ["kind", "norm"]).groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct(name, "attempt"))).alias("_pv_map"))
        own = own.withColumnsRenamed({"h1": "_pv_h1", "h2": "_pv_h2"})
        found = found.withColumns({"_pv_a": text[0], "_pv_b": text[1]}).join(own, (F.col("_pv_a") == F.col("_pv_h1")) & (F.col("_pv_b") == F.col("_pv_h2")), "left")
        attempts = lambda n: F.coalesce(F.try_element_at(F.col("_pv_map"), n), F.lit(0))
    elif some:  # few: one row of small maps by the name's checksum goes to all tasks
        rows = moved.select(name.alias("name"), "attempt").withColumn("slot", F.crc32("name") % SLOTS)
        maps = rows.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "m"))).alias("_pv_map"))
        found = found.join(F.broadcast(maps))
        attempts = lambda n: F.coalesce(F.try_element_at(F.try_element_at(F.col("_pv_map"), F.crc32(n) % SLOTS), n), F.lit(0))
    new = F.transform("_pv_entities", lambda e: render(e, attempts, key))
    pieces = F.split("text", PATTERN, -1)
    woven = F.array_join(F.zip_with(pieces, new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    out = found.withColumn("text", F.when(F.size("_pv_entities") > 0, woven).otherwise(F.col("text")))
    return out.select(*docs.columns, "_pv_entities")


def surrogate_text(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text replaced and nothing else changed."""
    return _replaced(docs, key).drop("_pv_entities")


def surrogate_query(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text, n_entities and kinds of every row."""
    out = _replaced(docs.selectExpr("cast(doc_id as long) doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("_pv_entities", kind_of))), ",")
    return out.select("doc_id", "text", F.coalesce(F.size("_pv_entities"), F.lit(0)).cast("long").alias("n_entities"), kinds.alias("kinds"))
