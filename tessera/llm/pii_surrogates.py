"""Personal data replaced by keyed, type-consistent surrogates, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# What is detected. Runs are bounded, so no text makes a search quadratic.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE_M = r"(?:Mr|Herr|Monsieur|Señor|Sr|Господин)"
_TITLE_F = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа)"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "male": rf"(?<!\p{{L}}){_TITLE_M}\.? \p{{Lu}}\p{{L}}{{1,40}}",
    "female": rf"(?<!\p{{L}}){_TITLE_F}\.? \p{{Lu}}\p{{L}}{{1,40}}",
}
PATTERN = "|".join(KINDS.values())
#: One of these occurs in every entity; texts without any are passed through after this one search.
HINT = rf"[0-9@]|{_TITLE_M}|{_TITLE_F}"
DIGITS, LATIN = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ACCENTED, CYRILLIC, GREEK = "àâäçéèêëîïíóñôöùûüúß", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: Attempts after which an entity that still collides is an error, not a silent clash.
ATTEMPTS = 24
#: From this attempt on, e-mail addresses and names, whose shapes may have no stand-in left, get longer ones.
LONGER_FROM = 8


def _kind(hit: Column) -> Column:
    names = list(KINDS)
    found = F.lit(names[-1])
    for name in reversed(names[:-1]):
        found = F.when(hit.rlike(f"^(?:{KINDS[name]})$"), name).otherwise(found)
    return found


def _country(hit: Column) -> Column:
    return F.regexp_extract(hit, r"^\+[0-9]{1,3}", 0)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def canonical(kind: Column, hit: Column) -> Column:
    """What mentions of one entity have in common: digits of cards and phones, lower case of the rest."""
    name = F.lower(F.regexp_extract(hit, r"\.? (\p{L}+)$", 1))
    phone = F.concat(_country(hit), F.lit(":"), _digits(F.expr("substring(hit, length(regexp_extract(hit, '^\\\\+[0-9]{1,3}', 0)) + 1)")))
    return (
        F.when(kind == "card", _digits(hit)).when(kind == "phone", phone)
        .when(kind.isin("male", "female"), name).otherwise(F.lower(hit))
    )


def _symbol(stream: Column, i: Column) -> Column:
    """The i-th number 0..255 of a keyed stream of 64."""
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _like(char: Column, draw: Column) -> Column:
    """A character of the same class and script; punctuation stays."""
    out = char
    for alphabet in (GREEK, CYRILLIC, ACCENTED, LATIN, DIGITS):
        letters = F.lit(alphabet)
        out = F.when(F.instr(letters, char) > 0, F.substring(letters, draw % len(alphabet) + 1, F.lit(1))).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int"))
                       .otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """Keyed stand-in of a canonical entity, canonical itself.

    E-mail addresses keep their shape and top-level domain, phone numbers their
    country code, cards their first digit and Luhn remainder, addresses are
    valid dotted quads, names keep gender and script. From LONGER_FROM on, and
    where no character of an address can change, 16 keyed hexadecimal digits end
    the local part and names have 14 more letters.
    """
    stream = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 512)
    chars = F.split(entity, "")
    top = F.length(F.regexp_extract(entity, r"\.[^.]*$", 0))
    shaped = F.array_join(F.transform(chars, lambda c, i: F.when(i >= F.size(chars) - top, c).otherwise(_like(c, _symbol(stream, i)))), "")
    at = F.instr(entity, "@")
    longer = F.concat(F.substring(shaped, F.lit(1), F.least(at - 1, F.lit(48))), F.substring(stream, 1, 16), F.substring(shaped, at, F.length(shaped)))
    shaped = F.when((attempt >= LONGER_FROM) | (shaped == entity), longer).otherwise(shaped)
    opening = F.instr(entity, ":")
    phone = F.array_join(F.transform(chars, lambda c, i: F.when(i < opening, c).when(i == opening, (_symbol(stream, i) % 8 + 2).cast("string")).otherwise(_like(c, _symbol(stream, i)))), "")
    body = F.array_join(F.transform(chars, lambda c, i: F.when(i == 0, c).when(i == F.size(chars) - 1, F.lit("0")).otherwise(_like(c, _symbol(stream, i)))), "")
    quad = F.concat_ws(".", *[(_symbol(stream, F.lit(k)) % 254 + 1).cast("string") for k in range(4)])
    last = F.pmod(_luhn(entity) - _luhn(body), F.lit(10)).cast("string")
    card = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), last)
    cyrillic, greek = entity.rlike("[Ѐ-ӿ]"), entity.rlike("[Ͱ-Ͽ]")

    def syllables(consonants: str, vowels: str, female: str, male: str) -> Column:
        draw = lambda letters, k: F.substring(F.lit(letters), _symbol(stream, F.lit(k)) % len(letters) + 1, F.lit(1))
        parts = [draw(consonants if k % 2 == 0 else vowels, k) for k in range(21)]
        return F.concat(*parts[:7], F.when(attempt >= LONGER_FROM, F.concat(*parts[7:])).otherwise(""), F.when(kind == "female", F.lit(female)).otherwise(F.lit(male)))

    name = (
        F.when(cyrillic, syllables("бвгдзклмнпрст", "аеиоу", "а", "ов"))
        .when(greek, syllables("βγδκλμνπρστ", "αεηιο", "η", "ος"))
        .otherwise(syllables("bdfgklmnprstv", "aeiou", "a", "en"))
    )
    return (
        F.when(kind == "ip", quad).when(kind == "phone", phone).when(kind == "card", card)
        .when(kind.isin("male", "female"), name).otherwise(shaped)
    )


def _formatted(kind: Column, hit: Column, made: Column) -> Column:
    """The surrogate in the mention's own format: its separators, its capitals, its title."""
    chars = F.split(hit, "")
    cased = F.array_join(F.zip_with(chars, F.split(made, ""), lambda c, s: F.when(c != F.lower(c), F.upper(s)).otherwise(s)), "")
    cased = F.when(F.length(hit) == F.length(made), cased).when((hit == F.upper(hit)) & (hit != F.lower(hit)), F.upper(made)).otherwise(made)
    skip = F.length(_country(hit))
    digits = F.regexp_replace(F.regexp_replace(made, "^[^:]*:", ""), "[^0-9]", "")
    placed = F.array_join(F.transform(chars, lambda c, i: F.when(
        (i >= skip) & c.rlike("[0-9]"),
        F.substring(digits, F.length(_digits(F.substring(hit, skip + 1, i - skip + 1))), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(hit, r"^(.*\.? )\p{L}+$", 1)
    shout = F.regexp_extract(hit, r" (\p{L}+)$", 1)
    name = F.concat(title, F.when(shout == F.upper(shout), F.upper(made)).otherwise(F.initcap(made)))
    return F.when(kind == "ip", made).when(kind.isin("phone", "card"), placed).when(kind.isin("male", "female"), name).otherwise(cased)


def assign(entities: DataFrame, key: str, scratch: Scratch, attempts: int = ATTEMPTS) -> DataFrame:
    """kind, entity -> kind, entity, made: surrogates that are distinct and equal no entity of the table.

    All entities draw; those whose draw was taken by a smaller entity, or is an
    entity itself, draw again with the next attempt, until none collides. The
    checks are two joins on the surrogate; nothing but the number of colliding
    entities comes to the driver.
    """
    # drawing costs more than reading: the entities are dealt over all tasks
    entities = scratch.write(entities.select("kind", "entity").distinct().repartition("entity"), "entities")
    now = entities.withColumn("attempt", F.lit(0))
    for turn in range(attempts):
        now = scratch.write(now.withColumn("made", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)), f"made{turn}")
        known = entities.select("kind", F.col("entity").alias("made"), F.lit(True).alias("taken"))
        first = now.groupBy("kind", "made").agg(F.min("entity").alias("first"), F.count(F.lit(1)).alias("n"))
        bad = (
            first.join(known, ["kind", "made"], "left").where("n > 1 or taken")
            .join(now, ["kind", "made"]).where("taken or entity <> first").select("kind", "entity", F.lit(True).alias("again"))
        )
        bad = scratch.write(bad, f"bad{turn}")
        if not bad.count():
            scratch.drop("entities", f"bad{turn}", *(f"{x}{k}" for x in ("made", "bad") for k in range(turn)))
            return now.select("kind", "entity", "made")
        now = now.join(bad, ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)).alias("attempt"))
    raise ValueError(f"surrogates still collide after {attempts} attempts")


def replace(documents: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``documents`` with surrogates in ``text``, and n_entities.

    Every mention of an entity, in any document and format, receives the same
    surrogate; different entities receive different ones; nothing else of a
    text changes. Null and empty texts stay; repeated rows repeat; a null id is
    an id like any other; a column named n_entities is replaced. Texts without
    a mention pass through untouched; only texts with mentions meet the table
    of surrogates, as one map a document, whose size is that document's own.
    """
    documents = documents.drop("n_entities")
    hits = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    marked = documents.withColumn("__hits", F.coalesce(hits, F.array().cast("array<string>")))
    plain = marked.where(F.size("__hits") == 0).drop("__hits").withColumn("n_entities", F.lit(0).cast("long"))
    found = marked.where(F.size("__hits") > 0).withColumn("__row", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256))
    mentions = scratch.write(
        found.select("__row", F.explode(F.array_distinct("__hits")).alias("hit")).distinct()
        .withColumn("kind", _kind(F.col("hit"))).withColumn("entity", canonical(F.col("kind"), F.col("hit"))), "mentions")
    made = assign(mentions, key, scratch)
    maps = (
        mentions.join(made, ["kind", "entity"]).select("__row", "hit", _formatted(F.col("kind"), F.col("hit"), F.col("made")).alias("new"))
        .groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("hit", "new"))).alias("__map"))
    )
    gaps = F.split(F.col("text"), PATTERN, -1)
    news = F.transform("__hits", lambda h: F.element_at("__map", h))
    text = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(news)), news, lambda g, s: F.concat(g, s)), ""), F.element_at(gaps, -1))
    changed = found.join(maps, "__row").withColumns({"text": text, "n_entities": F.size("__hits").cast("long")}).drop("__hits", "__row", "__map")
    return plain.unionByName(changed)
