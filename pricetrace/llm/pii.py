"""Personal data replaced by surrogates: keyed, of the same type and format, one per entity, none shared.

Emails, phone numbers, card numbers, IP addresses and names of persons are found by one pattern. Each distinct entity of
the corpus draws a surrogate from a keyed hash; draws that collide with each other, with one given before or with an
entity that occurs are drawn again, so that different entities stay different and equal ones equal, in whatever format
they are written. Everything is a DataFrame expression; only texts with entities are shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrace.scratch import Staged

# Given names by script and gender.
GIVEN = {
    ("latin", "m"): ["James", "Robert", "Michael", "William", "David", "Joseph", "Charles", "Thomas", "Christopher", "Matthew", "Jürgen", "Wolfgang", "François", "Guillaume", "Alejandro", "Francisco"],
    ("latin", "f"): ["Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Margaret", "Dorothy", "Michelle", "Ursula", "Brigitte", "Françoise", "Véronique", "Guadalupe", "Dolores"],
    ("cyrillic", "m"): ["Александр", "Дмитрий", "Сергей", "Николай", "Владимир", "Михаил"],
    ("cyrillic", "f"): ["Екатерина", "Наталья", "Ольга", "Татьяна", "Людмила", "Светлана"],
    ("greek", "m"): ["Γεώργιος", "Δημήτριος", "Κωνσταντίνος", "Νικόλαος"],
    ("greek", "f"): ["Αικατερίνη", "Βασιλική", "Ελένη", "Σοφία"],
}
# Titles before a family name.
TITLES = ["Mr", "Mrs", "Ms", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "г-н", "г-жа", "κ"]
# Parts of family names by script.
SYLLABLES = {
    "latin": ["bar", "den", "fol", "gar", "hal", "ken", "lor", "mar", "nor", "pel", "ran", "sel", "tor", "ven", "wal", "zim"],
    "cyrillic": ["бар", "вол", "гор", "дан", "жар", "кол", "лем", "мор", "нов", "пал", "рад", "сол", "тур", "фед", "хар", "чер"],
    "greek": ["βαρ", "γαλ", "δαν", "ζαρ", "καλ", "λεμ", "μαρ", "νικ", "παπ", "ραλ", "σαρ", "ταμ", "φιλ", "χαρ", "ψαλ", "δημ"],
}
ENDINGS = {"latin": "er", "cyrillic": "ов", "greek": "ης"}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,8}"
ADDRESS = r"(?<![\p{L}\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\d]|\.\d)"
CARD = r"(?<![\p{L}\d])(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?![\p{L}\d])"
PHONE = (
    r"(?<![\p{L}\d+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}"
    r"|\+[2-9]\d{0,2}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4})(?![\p{L}\d])"
)
PERSON = (
    r"(?<![\p{L}\p{M}])(?:(?:" + "|".join(TITLES) + r")\.? |(?:" + "|".join(n for names in GIVEN.values() for n in names) + r") )\p{Lu}[\p{L}\p{M}]{2,40}"
)
PATTERN = f"{EMAIL}|{ADDRESS}|{CARD}|{PHONE}|{PERSON}"
TYPES = ["email", "address", "card", "phone", "person"]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Luhn sum of a string of digits; a valid card number's is divisible by 10."""

    def weigh(total: Column, at: Column) -> Column:
        digit = F.substring(number, F.length(number) - at, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(at % 2 == 0, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), weigh)


def script(value: Column) -> Column:
    return F.when(F.regexp_like(value, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(value, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def kind_of(found: Column) -> Column:
    """Type of a match; null for one that only looks like an entity: a number without a valid check digit or octets above 255."""
    octets = F.transform(F.split(found, r"\."), lambda part: part.try_cast("int"))
    return (
        F.when(F.contains(found, F.lit("@")), "email")
        .when(F.regexp_like(found, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")), F.when(F.forall(octets, lambda o: o <= 255), "address"))
        .when(F.regexp_like(found, F.lit(r"^(\d{13,19}|(\d{4}[ -]){3}\d{4})$")), F.when(luhn_sum(digits(found)) % 10 == 0, "card"))
        .when(F.regexp_like(found, F.lit(r"\d$")), "phone")
        .otherwise("person")
    )


def canonical(kind: Column, found: Column) -> Column:
    """What all ways of writing an entity share. A phone number's leading +1 is a way of writing it."""
    number = digits(found)
    return (
        F.when(kind == "card", number)
        .when(kind == "phone", F.when((F.length(number) == 11) & F.startswith(number, F.lit("1")), F.substring(number, 2, 10)).when(F.startswith(found, F.lit("+")), F.concat(F.lit("+"), number)).otherwise(number))
        .when(kind == "person", F.lower(F.element_at(F.split(found, " "), -1)))
        .otherwise(F.lower(found))
    )


def bits(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("\u0000", F.lit(key), *parts), 512)


def pick(hexes: Column, at: Column) -> Column:
    return F.conv(F.substring(hexes, at % 63 * 2 + 1, F.lit(4)), 16, 10).cast("int")


def same_letters(value: Column, hexes: Column) -> Column:
    """Each digit as a digit, each letter as a letter of its script, all else as it is."""

    def change(char: Column, at: Column) -> Column:
        number = pick(hexes, at)
        letters = F.when(F.regexp_like(char, F.lit(r"\d")), F.substring(F.lit("0123456789"), number % 10 + 1, F.lit(1)))
        for name, alphabet in ALPHABETS.items():
            fits = F.regexp_like(char, F.lit(r"\p{L}")) & (script(char) == name)
            letters = letters.when(fits, F.substring(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1)))
        return letters.otherwise(char)

    return F.array_join(F.transform(F.split(value, ""), change), "")


def random_digits(length: Column, hexes: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda at: (pick(hexes, at) % 10).cast("string")), "")


def surrogate(key: str, kind: Column, entity: Column, attempt: int) -> Column:
    """Canonical form of the surrogate; from the eighth attempt on those with few forms grow by a character per attempt."""
    drawn, longer = bits(key, kind, entity, F.lit(str(attempt))), max(0, attempt - 7)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = same_letters(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), bits(key, F.lit("domain"), domain))
    email = F.concat(same_letters(F.concat(local, F.lit("x" * longer)), drawn), F.lit("@"), host, top)
    address = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda at: (pick(drawn, at) % 254 + 1).cast("string")), ".")
    body = F.concat(F.substring(entity, 1, 1), random_digits(F.length(entity) - 2, drawn), F.lit("0"))
    check = (10 - luhn_sum(body) % 10) % 10
    card = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), check.cast("string"))
    phone = F.when(F.startswith(entity, F.lit("+")), F.concat(F.substring(entity, 1, 3), random_digits(F.length(entity) - 3, drawn))).otherwise(random_digits(F.length(entity), drawn))
    person = F.lit(None).cast("string")
    for name, parts in SYLLABLES.items():
        choose = [F.element_at(F.array(*map(F.lit, parts)), pick(drawn, F.lit(3 * at)) % len(parts) + 1) for at in range(3 + longer)]
        person = F.when(script(entity) == name, F.concat(*choose, F.lit(ENDINGS[name]))).otherwise(person)
    return F.when(kind == "email", email).when(kind == "address", address).when(kind == "card", card).when(kind == "phone", phone).otherwise(person)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for the distinct (kind, entity): distinct per kind, and none is an entity that occurs.

    Draws that fail are repeated; a round's few losers are all that the next one reads.
    """
    pending, attempt = entities, 0
    given = entities.where(F.lit(False)).withColumn("surrogate", F.lit(None).cast("string"))
    while True:
        drawn = pending.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("entity"), attempt))
        occurring = entities.select("kind", F.col("entity").alias("surrogate"))
        free = drawn.join(occurring, ["kind", "surrogate"], "left_anti").join(given, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate")
        given = Staged(given.unionByName(won), "surrogates").df
        pending = Staged(pending.join(given, ["kind", "entity"], "left_anti"), "collisions").df
        if pending.isEmpty():
            return given
        attempt += 1
        if attempt > 64:
            raise ValueError("no free surrogates are left")


def given_names(key: str) -> Column:
    """Map of given names to others of the same script and gender: the next one in a keyed order."""
    pairs: list[Column] = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda name: hashlib.sha256(f"{key}{name}".encode()).digest())
        for name, other in zip(order, [*order[1:], order[0]], strict=True):
            pairs += [F.lit(name), F.lit(other)]
    return F.create_map(*pairs)


def written(found: Column, kind: Column, new: Column, key: str) -> Column:
    """Surrogate in the format of the match: its separators, its case, its title or a given name of the same gender."""
    number = F.when((kind == "phone") & (F.length(digits(found)) == 11) & (F.length(new) == 10), F.concat(F.lit("1"), new)).otherwise(digits(new))
    gaps = F.split(found, "[0-9]")
    filled = F.array_join(F.transform(gaps, lambda gap, at: F.concat(gap, F.substring(number, at + 1, F.lit(1)))), "")
    first = F.substring_index(found, " ", 1)
    person = F.concat_ws(" ", F.coalesce(F.try_element_at(given_names(key), first), first), F.initcap(new))
    cased = F.when((found == F.upper(found)) & (found != F.lower(found)), F.upper(new)).otherwise(new)
    return F.when(kind.isin("phone", "card"), filled).when(kind == "person", person).otherwise(cased)


def replace_pii(df: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with surrogates in `text`, and `n_replaced`. The same secret gives the same surrogates for the same corpus.

    Null and empty texts stay as they are, as does every row without entities; rows repeat as in the input. Extra columns
    are passed through, but for an older `n_replaced`; names starting with an underscore are taken. `df` is read three times.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    has = F.coalesce(F.regexp_like(F.col(text), F.lit(PATTERN)), F.lit(False))
    own = [F.col(key).alias("_key"), F.xxhash64(text).alias("_hash")]
    listed = df.where(has).select(*own, found.alias("_found")).groupBy("_key", "_hash").agg(F.first("_found").alias("_found"))
    spots = listed.select("_key", "_hash", F.posexplode("_found").alias("_at", "_match"))
    kind = kind_of(F.col("_match"))
    spots = Staged(spots.withColumn("kind", kind).withColumn("entity", canonical(F.col("kind"), F.col("_match"))), "spots").df
    entities = Staged(spots.where(F.col("kind").isNotNull()).select("kind", "entity").distinct(), "entities").df
    table = surrogates(entities, secret)
    named = spots.join(table, ["kind", "entity"], "left")
    shown = F.coalesce(written(F.col("_match"), F.col("kind"), F.col("surrogate"), secret), F.col("_match"))
    spot = F.struct("_at", shown.alias("shown"), F.col("surrogate").isNotNull().cast("long").alias("new"))
    lists = named.groupBy("_key", "_hash").agg(F.sort_array(F.collect_list(spot)).alias("_spots"))
    gaps = F.split(F.col(text), PATTERN, -1)
    ends = F.concat(F.transform("_spots", lambda s: s["shown"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, ends, lambda a, b: F.array(a, b))), "")
    marked = df.where(has).withColumn("_hash", F.xxhash64(text))
    count = F.aggregate("_spots", F.lit(0).cast("long"), lambda n, s: n + s["new"])
    same = (F.col("d._hash") == F.col("l._hash")) & F.col(f"d.{key}").eqNullSafe(F.col("l._key"))
    columns = [rebuilt.alias(c) if c == text else F.col(f"d.{c}") for c in df.columns if c != "n_replaced"]
    changed = marked.alias("d").join(lists.alias("l"), same).select(*columns, count.alias("n_replaced"))
    return changed.unionByName(df.where(~has).withColumn("n_replaced", F.lit(0).cast("long")))
