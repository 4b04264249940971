"""Personal data replaced by keyed, type-consistent surrogates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.sources.shared import materialize

KEY = "a key of the caller's own"
#: From this round on a surrogate may leave the form of its entity, so that small forms never run out.
LOOSE = 8
BROADCAST_ROWS = 200_000

#: Titles before a name, with the gender they state.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Г-жа"),
    "n": ("Dr", "Prof"),
}
_TITLE = "(?:" + "|".join(t for group in TITLES.values() for t in group) + ")"

#: Kinds of entities in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)",
    "card": r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)",
    "secret": r"\b(?=[a-f0-9]*\d)(?=[a-f0-9]*[a-f])[a-f0-9]{32,64}\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d{8,14})(?!\d)",
    "person": r"(?<=\b" + _TITLE + r"\.?[ ])\p{Lu}[\p{L}'’-]+(?:[ ]\p{Lu}[\p{L}'’-]+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: All kinds but names; and a title with the name behind it.
_OTHERS = "|".join(f"(?:{p})" for kind, p in KINDS.items() if kind != "person")
_NAME = r"\p{Lu}[\p{L}'’-]+(?:[ ]\p{Lu}[\p{L}'’-]+)?"
_TITLED = r"\b(" + _TITLE[3:-1] + r")\.?[ ](" + _NAME + ")"

#: Letters of a script are exchanged among themselves, vowels and consonants apart.
CLASSES = {
    "vowels": "aeiou", "consonants": "bcdfghklmnprstvwz", "accented": "áéíóú", "umlauts": "äöü",
    "cyrillic_vowels": "аеиоуя", "cyrillic": "бвгдзклмнпрст", "greek_vowels": "αεηιου", "greek": "βγδζκλμνπρστ",
}
#: Names of a script are made of its consonants and vowels in turn; those of women end in the vowel given, those of men in a consonant.
SCRIPTS = {
    r"\p{IsCyrillic}": ("cyrillic", "cyrillic_vowels", "а"), r"\p{IsGreek}": ("greek", "greek_vowels", "α"),
    r"[\s\S]": ("consonants", "vowels", "a"),
}


def _kind(surface: Column) -> Column:
    """Kinds differ in their characters, so that a match tells its own without its context."""
    digits = F.length(F.regexp_replace(surface, r"\D", ""))
    return (F.when(surface.contains("@"), "email").when(surface.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$"), "key")
            .when(surface.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(surface.rlike(r"^[a-f0-9]{32,64}$"), "secret")
            .when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(surface.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "iban")
            .when((digits == 16) & surface.rlike(r"^[\d -]+$"), "card").when(surface.rlike(r"\d"), "phone").otherwise("person"))


def _norm(kind: Column, surface: Column) -> Column:
    """What all ways to write an entity have in common."""
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(surface, r"\D", "")).when(
        kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).when(kind == "key", surface).otherwise(F.lower(surface))


def _number(digest: Column, i: Column) -> Column:
    """The byte of a 512-bit digest for place i."""
    return F.conv(F.substring(digest, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")


def _exchanged(c: Column, n: Column) -> Column:
    """Another character of the kind of ``c``."""
    out = F.when(c.rlike("^[0-9]$"), F.substring(F.lit("0123456789"), n % 10 + 1, F.lit(1)))
    for letters in CLASSES.values():
        out = out.when(F.lit(letters).contains(c), F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1)))
    return out.when(c.rlike("^[a-z]$"), F.substring(F.lit(CLASSES["consonants"]), n % 17 + 1, F.lit(1))).otherwise(c)


def _spelled(norm: Column, digest: Column, keep: Column) -> Column:
    """``norm`` with characters exchanged where ``keep`` (of place and character) is false."""
    chars = F.split(norm, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(keep(i, c), c).otherwise(
        _exchanged(c, _number(digest, i)))), "")


def _luhn(digits: Column) -> Column:
    """The digit that completes 15 digits."""
    weighed = F.transform(F.split(digits, ""), lambda c, i: F.when(
        i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int"))
    return ((10 - F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10) % 10).cast("string")


def _name(norm: Column, gender: Column, digest: Column, loose: bool) -> Column:
    """A name of the script and gender of ``norm``, and of its length; signs within it stay where they are.

    Of an unknown gender, the last letter stays, as it often tells.
    """
    chars, end = F.split(norm, ""), F.length(norm) - 1

    def made(consonants: str, vowels: str, female: str) -> Column:
        pick = lambda letters, i: F.substring(F.lit(CLASSES[letters]), _number(digest, i) % len(CLASSES[letters]) + 1, F.lit(1))
        last = F.when(gender == "f", F.lit(female)).when(gender == "m", pick(consonants, end)).when(
            F.lit(loose), pick(vowels, end)).otherwise(F.substring(norm, -1, 1))
        return F.array_join(F.transform(chars, lambda c, i: F.when(~c.rlike(r"\p{L}"), c).when(i == end, last).otherwise(
            F.when(i % 2 == 0, pick(consonants, i)).otherwise(pick(vowels, i)))), "")

    out = None
    for script, parts in SCRIPTS.items():
        out = F.when(norm.rlike("^" + script), made(*parts)) if out is None else out.when(norm.rlike("^" + script), made(*parts))
    return out


def _check_digits(country: Column, rest: Column) -> Column:
    """The two digits that make an account number's remainder by 97 one."""
    chars = F.split(F.concat(rest, country, F.lit("00")), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    left = F.aggregate(F.transform(chars, value), F.lit(0), lambda a, b: F.when(b > 9, (a * 100 + b) % 97).otherwise((a * 10 + b) % 97))
    return F.lpad((98 - left).cast("string"), 2, "0")


def _candidate(kind: Column, norm: Column, gender: Column, key: Column, turn: int) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", key, kind, norm, F.lit(str(turn))), 512)
    loose = turn >= LOOSE
    end = F.length(norm)
    none = lambda i, c: F.lit(False)
    # the domain's last label stays
    email = _spelled(norm, digest, lambda i, c: i >= end - F.length(F.substring_index(norm, ".", -1)))
    octet = lambda o, i: F.when(
        F.lit(loose), _number(digest, i)).when(F.length(o) == 1, 1 + _number(digest, i) % 9).when(
        F.length(o) == 2, 10 + _number(digest, i) % 90).otherwise(100 + _number(digest, i) % 156)
    ip = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: octet(o, i).cast("string")), ".")
    card = F.substring(_spelled(norm, digest, lambda i, c: i == 0), 1, 15)
    secret = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(F.lit("0123456789"), _number(digest, i) % 10 + 1, F.lit(1))).otherwise(
        F.substring(F.lit("abcdef"), _number(digest, i) % 6 + 1, F.lit(1)))), "")
    token = F.concat(F.substring(norm, 1, 4), F.upper(_spelled(F.lower(F.substring(norm, 5, 16)), digest, none)))
    phone = _spelled(norm, digest, lambda i, c: i < F.length(norm) - 10)
    person = _name(norm, gender, digest, loose)
    ssn = _spelled(norm, digest, none)
    rest = F.upper(_spelled(F.lower(F.substring(norm, 5, 40)), digest, none))
    country = F.substring(norm, 1, 2)
    iban = F.concat(country, _check_digits(country, rest), rest)
    # a longer form, where the entity's own may not have enough surrogates
    more = F.substring(F.translate(digest, "0123456789", "ghijklmnop"), 1, turn - LOOSE + 1) if loose else F.lit("")
    return (F.when(kind == "email", F.concat(more, email)).when(kind == "ip", ip)
            .when(kind == "card", F.concat(card, _luhn(card))).when(kind == "secret", secret).when(kind == "key", token)
            .when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "iban", iban).otherwise(F.concat(more, person)))


def surrogates(entities: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """kind, norm, surrogate of each distinct entity (kind, norm, gender: m, f or null).

    Candidates come from a digest of the key, the entity and the round. An entity wins its candidate if no other has won it, none
    with a smaller digest wants it now and it is nobody's own form; the others go on with the next round.
    So different entities keep different surrogates, and one entity has the same one everywhere.
    """
    left, done = entities, None
    for turn in range(rounds):
        tried = left.withColumn("surrogate", _candidate(F.col("kind"), F.col("norm"), F.col("gender"), F.lit(key), turn))
        order = F.xxhash64(F.lit(key), "norm")
        best = tried.groupBy("kind", "surrogate").agg(F.min(F.struct(order.alias("o"), "norm")).alias("best"))
        won = best.select("kind", "best.norm", "surrogate").join(
            entities.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            won = won.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialize(won.select("kind", "norm", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        left = materialize(left.join(won, ["kind", "norm"], "left_anti"), "entities")
        if left.isEmpty():
            return done
    raise ValueError(f"{left.count()} entities have no surrogate after {rounds} rounds")


def _poured(surface: Column, surrogate: Column) -> Column:
    """The letters and digits of ``surrogate`` in the places and cases of those of ``surface``."""
    letters = F.split(F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", ""), "")
    chars = F.split(surface, "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        new = F.get(letters, s["n"])
        own = F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        fits = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(s["text"], F.when(fits, F.coalesce(own, F.lit(""))).otherwise(c)).alias("text"),
                        F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"))

    done = F.aggregate(chars, start, step)
    rest = F.transform(F.array(done), lambda s: F.concat(
        s["text"], F.array_join(F.slice(letters, s["n"] + 1, F.greatest(F.size(letters) - s["n"], F.lit(0))), "")))
    return rest[0]


def _written(kind: Column, surface: Column, surrogate: Column) -> Column:
    """Kinds that are written in one way take their surrogate as it is, the others by ``surface``."""
    same = F.length(surface) == F.length(surrogate)
    return F.when(kind.isin("ip", "key", "secret"), surrogate).when(
        (kind == "email") & (surface == F.lower(surface)), surrogate).when(
        kind.isin("email", "person") & ~same, surrogate).otherwise(_poured(surface, surrogate))


def replaced(
    docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_entities (occurrences), kinds (of them, sorted), text (with surrogates) of every row.

    Mentions of an entity, however written, get the same surrogate in all rows, in the form and case of the mention; different entities
    get different ones, none of which is an entity of the input. A name is found behind a title, and its words are entities each: so a full name
    and its parts agree wherever they stand, and people who share a surname go on sharing one. The gender of a word follows from the titles
    before it, as long as all say the same. Then the words are replaced in the whole text, in one pass;
    n_entities counts the places of the patterns, not these bare mentions. Short phone numbers without an area code and names without a
    title anywhere in their text are not found. Null texts stay null with 0 entities; repeated rows and ids don't matter,
    as rows with the same id and text are treated as one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    hint = r"[@0-9]|AKIA|ASIA|\b" + _TITLE + r"\.? \p{Lu}"
    found = F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    mentions = rows.select("id", "mark", F.explode(F.array_distinct(found)).alias("surface")).distinct()
    mentions = mentions.withColumn("kind", _kind(F.col("surface"))).where("kind <> 'person'").withColumn("gender", F.lit(None).cast("string"))
    titled = F.when(F.col("text").rlike(r"\b" + _TITLE + r"\.? \p{Lu}"), F.regexp_extract_all("text", F.lit(_TITLED), F.lit(0)))
    names = rows.select("id", "mark", F.explode(F.array_distinct(titled)).alias("named"))
    named = F.regexp_extract("named", _TITLED, 2)
    gender = F.lit(None).cast("string")
    for which in "mf":
        gender = F.when(F.regexp_extract("named", _TITLED, 1).isin(*TITLES[which]), which).otherwise(gender)
    words = names.select("id", "mark", gender.alias("gender"), F.explode(F.split(named, " ")).alias("surface")).withColumn(
        "kind", F.lit("person"))
    mentions = mentions.unionByName(words.where("surface <> ''"))
    mentions = materialize(mentions.withColumn("norm", _norm(F.col("kind"), F.col("surface"))), "mentions")
    same = F.when(F.min("gender") == F.max("gender"), F.min("gender"))
    given = surrogates(materialize(mentions.groupBy("kind", "norm").agg(same.alias("gender")), "entities"), key)
    pairs = mentions.select("id", "mark", "kind", "norm", "surface").distinct().join(given, ["kind", "norm"]).select(
        "id", "mark", "kind", "surface", _written(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("new"))
    own = materialize(pairs.groupBy("id", "mark").agg(
        F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias("new_"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "person", F.col("surface")))).alias("names_"),
        F.sort_array(F.collect_set("kind")).alias("kinds")), "replacements")
    if own.agg(F.coalesce(F.sum(F.size("new_") + 2), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        own = F.broadcast(own)
    joined = rows.join(own.withColumnsRenamed({"id": "i", "mark": "m"}),
                       F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    # One pattern for all of a row: what its names are written like, and the kinds. Every place is replaced once, from the text itself.
    word = F.concat(F.lit(r"(?<![\p{L}\p{N}@.'’-])(?:"), F.array_join("names_", "|"), F.lit(r")(?![\p{L}\p{N}@'’-])"))
    both = F.when(F.size("names_") > 0, F.concat(F.lit(_OTHERS + "|"), word)).otherwise(F.lit(_OTHERS))
    matches = F.regexp_extract_all("text", both, F.lit(0))
    between = F.split("text", both, -1)
    filled = F.array_join(F.flatten(F.zip_with(between, matches, lambda gap, match: F.array(
        gap, F.coalesce(F.try_element_at(F.col("new_"), match), match, F.lit(""))))), "")
    return joined.select(
        F.col("id").alias("doc_id"), F.when(F.col("m").isNull(), 0).otherwise(
            F.coalesce(F.size(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))), F.lit(0))).alias("n_entities"),
        F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
        F.when(F.col("m").isNull(), F.col("text")).otherwise(filled).alias("text"))
