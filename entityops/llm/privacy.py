"""Surrogates for personal data: detected entities get keyed replacements of the same type and format.

Only DataFrame functions. Entities are found by patterns: e-mail addresses, IPv4 addresses, card numbers,
phone numbers, IBANs, national numbers (nine digits as 3-2-4), secrets (access keys, tokens, passwords) and
persons behind a form of address. An entity is its type and normal form (e-mail and host names without case,
numbers without separators), so that every mention of it in the corpus gets the same surrogate (coreference).

* Digits become digits, letters become letters of the same script and case, separators stay; the part of a
  phone number that names the country stays, a card number keeps its first digit and gets a valid check
  digit, an IBAN keeps its country and gets valid check digits, and each mail host becomes a host of its own. A person gets a name of the gender that the form of address tells, in Latin, Greek or Cyrillic script
  as written; parts of a name are entities of their own, so "Mr Jan Kolb" and "Mr Kolb" still share a name.
* Each candidate comes from a hash of a secret key, the entity and a round. Candidates that two entities
  share, or that occur as an entity of the corpus, are drawn again in the next round; the smallest entity of
  a clash keeps its draw. Rounds end when no clash is left, so different entities stay different.
* Where a format has too few free values (the corpus may hold all numbers of a short format), entities that are still
  without one after ``ROUNDS`` rounds take each other's values, in a keyed cycle in which none keeps its own. Only there is
  a surrogate an entity of the corpus.

Null texts stay null, texts without an entity stay as they are. Repeated rows get equal results. A column ``entities``
of the input is replaced; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityops.functions.ordering import number_rows
from entityops.llm.storage import shared_folder, table

# Fixed patterns, tried in this order at each place of a text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
CARD = r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"
NATIONAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
SECRET = r"\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*)[^\s\"',;]{6,}|\b[0-9a-f]{40}\b"
PERSON = r"\b(?:Mr|Mrs|Ms|Miss|Sir|Madam|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Sr|Господин|Госпожа|Κύριος|Κυρία)\.? \p{Lu}[\p{Ll}\p{M}'’-]+(?: \p{Lu}[\p{Ll}\p{M}'’-]+){0,2}"
KINDS = {"email": EMAIL, "ip": IPV4, "iban": IBAN, "national": NATIONAL, "card": CARD, "phone": PHONE, "secret": SECRET, "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

# Fixed names by script and gender; given names first, then family names, which have no gender here.
NAMES = {
    "latin_m": "Adam Boris Carl David Emil Felix Georg Henri Ivan Jonas Karl Louis Marco Nils Oscar Paul Quentin Robert Simon Thomas",
    "latin_f": "Anna Beate Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sara Tina Vera",
    "latin_x": "Abel Brandt Conti Duval Ekman Ferrer Gallo Hansen Ibarra Jensen Keller Lang Moreau Novak Olsen Peters Quiroga Roux Santos Tanner",
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим",
    "cyrillic_f": "Анна Вера Галина Дарья Елена Зоя Инна Ксения Лидия Мария",
    "cyrillic_x": "Беленко Гайденко Дорошенко Зайченко Иващенко Коваленко Лысенко Мельник Назаренко Остапенко",
    "greek_m": "Ανδρέας Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λεωνίδας Μάριος Νίκος",
    "greek_f": "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Λυδία Μαρία Νίκη",
    "greek_x": "Αλεξίου Βλάχου Γεωργίου Δήμου Ευθυμίου Ζαχαρίου Ιωάννου Κωστή Λάμπρου Μιχαήλ",
}
# Fixed syllables and endings of names that are put together where the names above are all given.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ha ja ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te va ve",
    "cyrillic": "ба бе ва ве га да де за зе ка ке ла ле ма ме на не па ра ре са се та те фа ха",
    "greek": "βα βε γα γε δα δε ζα κα κε λα λε μα με να νε πα πε ρα ρε σα σε τα τε φα φε χα",
}
ENDINGS = {
    "latin_m": "n r s l d", "latin_f": "ia na lla sa tta", "latin_x": "sen mann ner ler witz",
    "cyrillic_m": "н р с л д", "cyrillic_f": "на я рья ла са", "cyrillic_x": "енко ский чук няк",
    "greek_m": "ς νος ρος λης σης", "greek_f": "να ρα λη ση νη", "greek_x": "κου δου τζη λου",
}
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Every mention has an "at" sign, a digit or one of these words; most texts have none of them.
HINT = r"[@0-9]|AKIA|(?i:password|passwd|pwd|secret|token|api_?key)|gh[pousr]_|[0-9a-f]{40}|\b(?:M[rs]|Miss|Sir|Mada|Herr|Frau|Mons|Mme|Se\u00f1or|S[r]|Го|Κυρ|Κύρ)"
TITLE = r"^([\p{L}]+\.?) "


def _all_of(pattern: str) -> Column:
    return F.lit(f"({pattern})")


def _kind(mention: Column) -> Column:
    out = None
    for name, pattern in KINDS.items():
        test = mention.rlike(f"^(?:{pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("secret")


def _normal(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"[^\p{L}\d+]", "")
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "phone", "iban", "national"), digits).otherwise(mention)


def _some(text: Column) -> Column:
    return text.rlike(HINT) & text.rlike(ANY)


def mentions(docs: DataFrame, text: str) -> Column:
    """All mentions of a text in their order."""
    return F.regexp_extract_all(F.col(text), _all_of(ANY), F.lit(0))


def _parts(found: DataFrame) -> DataFrame:
    """(kind, value) of every entity: persons count as their title's gender and each name of theirs."""
    plain = found.where("kind <> 'person'").select("kind", "value")
    names = found.where("kind = 'person'").select(F.explode(_name_parts(F.col("value"))).alias("p")).select("p.kind", "p.value")
    return plain.union(names).distinct()


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name_parts(person: Column) -> Column:
    """Names behind the form of address: the last is a family name, earlier ones are given names of its gender."""
    title = F.regexp_replace(F.regexp_extract(person, TITLE, 1), r"\.$", "")
    gender = F.when(title.isin(*FEMALE), "f").otherwise("m")
    names = F.split(F.regexp_replace(person, TITLE, ""), " ")
    return F.transform(
        names, lambda n, i: F.struct(F.concat(F.lit("name_"), _script(n), F.lit("_"), F.when(i == F.size(names) - 1, "x").otherwise(gender)).alias("kind"), n.alias("value"))
    )


def _stream(key: str, kind: Column, value: Column, turn: Column) -> Column:
    """128 hexadecimal digits that depend on the key, the entity and the round."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, turn.cast("string")), 512)


def _draw(stream: Column, place: Column, size: int) -> Column:
    """A number below ``size`` for a place of a text: four digits of the stream, hashed again past its end."""
    digits = F.when(place < 31, F.substr(stream, place * 4 + 1, F.lit(4))).otherwise(F.substr(F.md5(F.concat(stream, place.cast("string")).cast("binary")), F.lit(1), F.lit(4)))
    return (F.conv(digits, 16, 10).cast("int") % size) + 1


def _redrawn(mention: Column, stream: Column, keep: Column) -> Column:
    """Letters and digits of ``mention`` past its first ``keep`` ones become others of their class; the rest stays."""
    letters = F.filter(F.split(mention, ""), lambda c: c != "")

    def change(c: Column, i: Column) -> Column:
        at = i.cast("int")
        lower, upper = F.substr(F.lit(LOWER), _draw(stream, at, 26), F.lit(1)), F.substr(F.lit(UPPER), _draw(stream, at, 26), F.lit(1))
        digit = (_draw(stream, at, 10) - 1).cast("string")
        new = F.when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), upper).when(c.rlike("[0-9]"), digit).otherwise(c)
        return F.when(at < keep, c).otherwise(new)

    return F.array_join(F.transform(letters, change), "")


def _check_digit(digits: Column) -> Column:
    """``digits`` with the last one replaced so that the doubled sum of a card number ends in 0."""
    size = F.length(digits)
    places = F.filter(F.split(digits, ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(F.slice(places, 1, size - 1), lambda c, i: F.when((size - i) % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.concat(F.substr(digits, F.lit(1), size - 1), ((10 - total % 10) % 10).cast("string"))


def _iban(value: Column) -> Column:
    """``value`` with the check digits that make its remainder by 97 one."""
    country, body = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(5))
    places = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    rest = F.aggregate(places, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _fixed(kind: Column, value: Column) -> Column:
    """How many first characters of a value its surrogate keeps."""
    secret = F.length(F.regexp_extract(value, r"(?i)^((?:AKIA|gh[pousr]_|(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*))", 1))
    phone = F.length(F.regexp_extract(value, r"^(\+1|\+\d\d)", 1))
    return F.when(kind == "card", 1).when(kind == "iban", 2).when(kind == "phone", phone).when(kind == "secret", secret).otherwise(0)


def _composed(kind: Column, stream: Column, turn: Column) -> Column:
    """A name of the kind's script and gender put together from syllables, one more every second round."""
    name = F.substr(kind, F.lit(len("name_") + 1))

    def pick(table: dict[str, str], row: Column, place: Column) -> Column:
        pool = F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.split(F.lit(v), " "))]), row)
        return F.element_at(pool, (F.conv(F.substr(stream, place * 4 + 1, F.lit(4)), 16, 10).cast("int") % F.size(pool)) + 1)

    count = F.least(F.floor(turn / 2) + 2, F.lit(28)).cast("int")
    stem = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: pick(SYLLABLES, F.substring_index(name, "_", 1), i)), "")
    return F.initcap(F.concat(stem, pick(ENDINGS, name, F.lit(0))))


def _candidate(key: str, turn: Column) -> Column:
    """The surrogate of (kind, value) in round ``turn``, in normal form."""
    kind, value = F.col("kind"), F.col("value")
    stream = _stream(key, kind, value, turn)
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)

    def octet(k: int) -> Column:
        return _draw(stream, F.lit(k), 254).cast("string")

    fixed = _fixed(kind, value)
    names = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit("name_" + k), F.split(F.lit(v), " "))])
    pool = F.element_at(names, kind)
    picked = F.element_at(pool, (F.conv(F.substr(stream, F.lit(1), F.lit(6)), 16, 10).cast("int") % F.size(pool)) + 1)
    return (
        F.when(kind == "email", F.concat(_redrawn(local, stream, F.lit(0)), F.lit("@surrogate-"), F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("host"), host), 256), F.lit(1), F.lit(16)), F.lit("."), F.regexp_extract(host, r"((?:example\.)?[^.]+)$", 1)))
        .when(kind == "ip", F.concat_ws(".", F.when(turn < 4, "10").otherwise(octet(3)), octet(0), octet(1), octet(2)))
        .when(kind == "card", _check_digit(_redrawn(value, stream, fixed)))
        .when(kind == "phone", _redrawn(value, stream, fixed))
        .when(kind == "iban", _iban(_redrawn(value, stream, fixed)))
        .when(kind.startswith("name_"), F.when(turn == 0, picked).otherwise(_composed(kind, stream, turn)))
        .when(value.rlike("^[0-9a-f]{40}$"), F.substr(stream, F.lit(1), F.lit(40)))
        # a secret of few letters and digits becomes one of letters after some rounds
        .when((kind == "secret") & (turn > 2), F.concat(F.substr(value, F.lit(1), fixed), _redrawn(F.repeat(F.lit("a"), F.length(value) - fixed), stream, F.lit(0))))
        .otherwise(_redrawn(value, stream, fixed))
    )


#: Formats with room for twice the entities need a handful of rounds; a lone entity of a crowded format may need more.
ROUNDS, MOST_ROUNDS = 8, 64


def _format(kind: Column, value: Column) -> Column:
    """What a value has in common with those that may stand in its place."""
    classes = value
    for one, letters in (("a", "[a-z]"), ("A", "[A-Z]"), ("0", "[0-9]")):
        classes = F.regexp_replace(classes, letters, one)
    free = F.when(kind.startswith("name_") | (kind == "ip"), "").otherwise(classes)
    return F.concat_ws("\x1f", kind, F.substr(value, F.lit(1), _fixed(kind, value)), free)


def _exchanged(open_: DataFrame, done: DataFrame, key: str, folder: str) -> DataFrame:
    """``done`` and surrogates for the entities of ``open_``, whose formats are crowded.

    Those of one format are numbered in keyed order, and each takes the value of the next. One that is alone takes the
    surrogate of an entity of its format that has one, which gets its value instead.
    """
    shape = _format(F.col("kind"), F.col("value"))
    marked = open_.withColumn("shape", shape).withColumn("_h", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value"), 256))
    numbered = table(number_rows(marked, ["shape"], [F.col("_h"), F.col("value")], [F.substring("_h", 1, 3)], "number"), "crowded", folder)
    counts = numbered.groupBy("shape").agg(F.count("*").alias("n"))
    members = numbered.join(counts, "shape")
    next_ = numbered.select("shape", F.col("number").alias("_next"), F.col("value").alias("surrogate"))
    cycle = members.where("n > 1").withColumn("_next", F.col("number") % F.col("n") + 1).join(next_, ["shape", "_next"]).select("kind", "value", "surrogate")
    lone = members.where("n = 1").select("shape", F.col("value").alias("_alone"))
    given = done.withColumn("shape", shape).join(lone, "shape").groupBy("kind", "shape", "_alone").agg(F.min(F.struct("value", "surrogate")).alias("d"))
    given = table(given, "given", folder)
    swapped = given.select("kind", F.inline(F.array(F.struct(F.col("_alone").alias("value"), "d.surrogate"), F.struct("d.value", F.col("_alone").alias("surrogate")))))
    kept = done.join(given.select("kind", "d.value"), ["kind", "value"], "left_anti")
    return table(kept.unionByName(swapped).unionByName(cycle), "settled", folder)


def surrogates(docs: DataFrame, key: str, text: str = "text", folder: str | None = None) -> DataFrame:
    """(kind, value, surrogate) of every entity of the corpus; no surrogate occurs twice, is its own entity or, where its
    format has free values, another one."""
    folder = folder or shared_folder(docs.sparkSession)
    found = docs.where(F.col(text).rlike(HINT)).select(F.explode(mentions(docs, text)).alias("mention")).distinct().withColumn("kind", _kind(F.col("mention")))
    entities = table(_parts(found.withColumn("value", _normal(F.col("kind"), F.col("mention")))), "entities", folder)
    taken = entities.select(F.col("value").alias("surrogate"))
    open_, done, turn = entities, None, 0
    while True:
        drawn = table(open_.select("kind", "value", _candidate(key, F.lit(turn)).alias("surrogate")), f"drawn-{turn}", folder)
        if turn > MOST_ROUNDS:
            raise ValueError("a format has fewer values than the corpus has entities of it")
        free = drawn.join(taken.distinct(), "surrogate", "left_anti")
        won = table(
            free.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("e")).select("e.kind", "e.value", "surrogate"), f"won-{turn}", folder
        )
        done = won if done is None else done.union(won)
        open_ = drawn.join(won, ["kind", "value"], "left_anti").select("kind", "value")
        if open_.isEmpty():
            return done
        taken, turn = taken.union(won.select("surrogate")), turn + 1
        if turn == ROUNDS:
            done = _exchanged(open_, done, key, folder)
            open_ = table(open_.join(done, ["kind", "value"], "left_anti"), "lone", folder)
            if open_.isEmpty():
                return done


def _formatted(mention: Column, surrogate: Column) -> Column:
    """The letters and digits of a surrogate in the places of those of the mention; other characters stay."""
    places = F.filter(F.split(mention, ""), lambda c: c != "")
    used = F.aggregate(
        places,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(
            c.rlike(r"[\p{L}\d+]"), F.struct(F.concat(acc["out"], F.substr(surrogate, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc["out"],
    )
    return used


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``entities``: for each mention kind, replacement and its place.

    Texts without a mention are not shuffled. The others meet their replacements by a hash of id and text.
    """
    folder = folder or shared_folder(docs.sparkSession)
    names = surrogates(docs, key, text, folder)
    value = F.coalesce(F.col(text), F.lit(""))
    row = F.sha2(F.concat_ws("\x1f", F.col(doc_id).cast("string"), value), 256)
    mark = "_row"
    while mark in docs.columns:
        mark += "_"
    some = docs.where(_some(value)).withColumn(mark, row)
    each = (
        some.select(F.col(mark).alias("_row"), F.posexplode(mentions(some, text)).alias("at", "mention"))
        .distinct()
        .withColumn("kind", _kind(F.col("mention")))
        .withColumn("value", _normal(F.col("kind"), F.col("mention")))
    )
    each = each.withColumn("parts", F.when(F.col("kind") == "person", _name_parts(F.col("value"))).otherwise(F.array(F.struct("kind", "value"))))
    part = each.select("_row", "at", "mention", "kind", F.posexplode("parts").alias("k", "p")).select("_row", "at", "mention", F.col("kind").alias("whole"), "k", "p.kind", "p.value")
    joined = part.join(names, ["kind", "value"])
    filled = joined.groupBy("_row", "at", "mention", "whole").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "surrogate"))), lambda x: x["surrogate"]).alias("s"))
    person = F.concat(F.regexp_extract("mention", TITLE, 1), F.lit(" "), F.array_join("s", " "))
    shown = F.when(F.col("whole") == "person", person).when(F.col("whole").isin("card", "phone", "iban", "national"), _formatted(F.col("mention"), F.col("s")[0])).otherwise(F.col("s")[0])
    lists = filled.groupBy(F.col("_row").alias(mark)).agg(F.array_sort(F.collect_list(F.struct("at", F.col("whole").alias("kind"), shown.alias("replacement")))).alias("entities"))
    gaps = F.split(F.col(text), ANY, -1)
    new = F.concat(
        F.array_join(F.zip_with(F.slice(gaps, 1, F.size("entities")), "entities", lambda g, e: F.concat(g, e["replacement"])), ""), F.element_at(gaps, -1)
    )
    columns = [c for c in docs.columns if c != "entities"]
    changed = some.drop("entities").join(lists, mark).select(*[new.alias(c) if c == text else F.col(c) for c in columns], "entities")
    kind = "array<struct<at:int,kind:string,replacement:string>>"
    same = docs.where(~_some(value)).select(*columns, F.array().cast(kind).alias("entities"))
    return same.unionByName(changed)
