"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern; a text is split at its matches and put together again with surrogates. A
surrogate is a keyed function of the entity's type and value (SHA-256 of key, type, value and an attempt number):
letters become letters of the same case, digits digits, separators stay; a card keeps its first digit and a valid
check digit, an account number its country and valid check digits, an address its number of parts, a title its name's gender; names are
made of parts of the same script and gender, with as many hyphens as before, so a person has the same surname with and without a given
name. The same value has the same surrogate everywhere, with nothing looked up; case is not part of a value.

Distinct values must stay distinct: the distinct values of the corpus (summed before the shuffle) are checked for
surrogates that coincide, in any case of letters, with each other or with a value of the corpus (given and family names of a script
together). The losers take the next attempt, with longer names, until none is left. Only these exceptions are joined
back to the documents that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

# Forms of address by gender, and the parts that names are made of, by script: first parts, middle parts,
# and endings by gender (n: family names).
MALE = "Mr Herr Monsieur Señor Don Sir г-н господин κύριος"
FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Doña г-жа госпожа κυρία"
NAMES = {
    "latin": {
        "first": "Al Bar Cor Dal El Fen Gar Hal Ist Jar Kel Lor Mar Nor Or Pel Quin Ros Sal Tor Ul Var Wel Zan",
        "middle": "a e i o an el in or",
        "m": "o us an er in ek ar on",
        "f": "a ia ina ella ette isa ora ena",
        "n": "ley mann sen berg ton ner ovic ard win stein feld mar ini ez ano eau",
    },
    "cyrillic": {
        "first": "Ал Бор Вел Гар Дан Ел Зар Иль Кор Лев Мар Нор Ор Пав Рад Сев Тар Ул Фед Яр",
        "middle": "а и о ан ев ин",
        "m": "ий ан ор ем ей ил",
        "f": "а ия ина ена ана ея",
        "n": "ов ев ин анов ников ушин",
    },
    "greek": {
        "first": "Αλ Βασ Γερ Δαμ Ελ Ζαν Ηλ Θαν Κορ Λαμ Μαν Νικ Πετρ Σταμ Τασ Φιλ",
        "middle": "α ι ο αν ελ",
        "m": "ος ης ας ιος",
        "f": "α η ω ία",
        "n": "ίδης όπουλος άκης ίου ας ής",
    },
}
TITLES = "|".join(sorted((MALE + " " + FEMALE).split(), key=len, reverse=True))
LATER_TITLES = "|".join(t for t in TITLES.split("|") if t != "Don")  # Don is a given name, too
PARTICLES = r"(?:(?:van|von|zu|de|del|della|di|da|dos|du)(?: (?:der|den|dem|la|las|los|le))?)"
#: A part of a name: a capitalised word with its hyphens and apostrophes, initials, or one letter before a further part.
LETTERS = r"[\p{L}\p{M}]"
WORD = rf"\p{{Lu}}\p{{M}}*+(?:{LETTERS}++(?:-{LETTERS}++|['’](?:\p{{Lu}}{LETTERS}*+|\p{{Ll}}{LETTERS}++))*+|(?:-{LETTERS}++|['’]\p{{L}}{LETTERS}++)++)"
PART = rf"(?:(?:\p{{Lu}}\.(?:-?\p{{Lu}}\.)*+)(?!{LETTERS})|{WORD}|\p{{Lu}}(?= \p{{Lu}}(?:{LETTERS}|[.'’-])))"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERN = "|".join([
    r"\b(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth|token)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z+/_.-]*+\d)[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]={0,2}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b",
    rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    r"(?<![\w.])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)",
    rf"(?<!\w)(?:{TITLES})\.? (?:{PARTICLES} )?{PART}(?: (?:{PARTICLES} )?(?!(?:{LATER_TITLES})(?!{LETTERS})){PART})*+",
])
#: Every branch of PATTERN needs one of these: a digit, the sign of an address, a key's prefix or a titled name.
HINT = rf"[0-9@]|AKIA|(?:{TITLES})\.? (?:{PARTICLES} )?\p{{Lu}}"


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(e: Column) -> Column:
    digits = F.length(F.regexp_replace(e, r"\D", ""))
    return (
        F.when(e.rlike(r"^(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth|token)\s{0,3}[=:]"), "secret")
        .when(e.startswith("AKIA"), "secret").when(e.contains("@"), "email").when(e.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[\d -]+$") & (digits >= 13), "card").when(e.rlike(r"^[+(\d]"), "phone").otherwise("name")
    )


def split_entity(e: Column) -> Column:
    """array<struct<kind, value>>: the parts that get surrogates; the text between them stays."""
    one = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))

    def parts(kind: Column) -> Column:
        secret = F.when(e.startswith("AKIA"), F.substr(e, F.lit(5))).otherwise(F.regexp_extract(e, r"^[^=:]*[=:]\s*[\"']?(.*)$", 1))
        gender = F.when(e.rlike(rf"^(?:{'|'.join(FEMALE.split())})\.? "), "f").otherwise("m")
        script = F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").when(e.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        words = F.filter(F.split(F.regexp_extract(e, rf"^(?:{TITLES})\.? (.*)$", 1), " "), lambda w: w.rlike(r"^\p{Lu}"))
        names = F.transform(words, lambda w, i: one(F.concat(F.when(i == F.size(words) - 1, "n").otherwise(gender), F.lit("_"), script), w))
        phone = F.regexp_extract(e, r"^(?:\+\d{1,3}(?=[ .(-]))?(.*)$", 1)
        return F.when(kind == "name", names).otherwise(F.array(one(kind, F.when(kind == "secret", secret).when(kind == "phone", phone).otherwise(e))))

    return let(kind_of(e), parts)


def byte_at(digest: Column, i: Column) -> Column:
    """A number below 65536 from the digest (128 hex digits), by place."""
    return F.conv(F.substr(digest, (i * 4) % 124 + 1, F.lit(4)), 16, 10).cast("int")


def shaped(value: Column, digest: Column, kind: Column) -> Column:
    """Letter for letter, digit for digit; an address keeps its last label, a card its first digit."""
    hexadecimal = value.rlike("^[0-9a-fA-F]+$")
    keep_from = F.when(kind == "email", F.length(value) - F.length(F.substring_index(value, ".", -1))).otherwise(F.length(value) + 1)

    def sign(c: Column, i: Column) -> Column:
        n = byte_at(digest, i)
        pick = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return (
            F.when((i >= keep_from) | ((kind == "card") & (i == 0)) | ((kind == "iban") & (i < 2)), c)
            .when(c.rlike("[0-9]"), pick("0123456789")).when(hexadecimal & c.rlike("[a-f]"), pick("abcdef")).when(hexadecimal & c.rlike("[A-F]"), pick("ABCDEF"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), sign), "")


def luhn(digits: Column) -> Column:
    """The sum of a string of digits with every second one from the right, the last not included, doubled."""
    reverse = F.split(F.reverse(digits), "")
    each = F.transform(reverse, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def mod97(text: Column) -> Column:
    """The remainder by 97 of a string of digits and letters, a letter as the number from 10 to 35."""
    letters = F.split(F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", "")), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(letters, F.lit(0), step)


def account(value: Column, plain: Column) -> Column:
    """A surrogate of an account number: country, check digits that are valid if the value's were, and the rest of ``plain``."""
    turned = lambda x: F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))
    country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    digits = F.lpad((98 - mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(mod97(turned(value)) == 1, F.concat(country, digits, rest)).otherwise(plain)


def pool(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def name_part(lists: dict[str, str], ending: str, digest: Column, at: Column, attempt: Column) -> Column:
    """One made-up name: a first part, ``attempt`` middle parts and an ending, picked by the digest from place ``at`` on."""
    pick = lambda words, i: F.get(pool(words), byte_at(digest, i) % len(words.split()))
    middle = F.transform(F.sequence(F.lit(0), attempt), lambda k: F.when(k > 0, pick(lists["middle"], at + k + 1)).otherwise(""))
    return F.concat(pick(lists["first"], at), F.array_join(middle, ""), pick(lists[ending], at + 1))


def name_of(kind: Column, value: Column, digest: Column, attempt: Column) -> Column:
    """A name of the kind's script and gender (null for other kinds), with as many hyphens as the value."""
    places = F.sequence(F.lit(0), F.size(F.split(value, "-")) - 1)
    out = F.lit(None).cast("string")
    for script, lists in NAMES.items():
        for ending in "mfn":
            made = F.array_join(F.transform(places, lambda p: name_part(lists, ending, digest, p * 7, attempt)), "-")  # noqa: B023
            if (script, ending) == ("cyrillic", "n"):
                made = F.concat(made, F.when(value.rlike("[аяАЯ]$"), "а").otherwise(""))
            out = F.when(kind == f"{ending}_{script}", made).otherwise(out)
    return F.when((F.upper(value) == value) & value.rlike(r"^\p{Lu}[^.]"), F.upper(out)).otherwise(out)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    text = F.concat_ws("\x1f", F.lit(key), kind, F.lower(value), attempt.cast("string"))
    digest = F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit("\x1f2")), 256))

    def made(d: Column) -> Column:
        address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte_at(d, i) % 254 + 1).cast("string")), ".")
        plain = shaped(value, d, kind)
        digits = lambda x: F.regexp_replace(x, r"\D", "")
        base = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), F.lit("0"))
        valid = luhn(digits(value)) % 10 == 0
        card = F.when(valid, let(base, lambda b: F.concat(F.substr(b, F.lit(1), F.length(b) - 1), ((10 - luhn(digits(b)) % 10) % 10).cast("string")))).otherwise(plain)
        name = kind.rlike("^[mfn]_")
        return F.when(kind == "ip", address).when(kind == "card", card).when(kind == "iban", let(plain, lambda p: account(value, p))).when(name, name_of(kind, value, d, attempt)).otherwise(plain)

    return let(digest, made)


def exceptions(values: DataFrame, key: str, most: int = 64) -> DataFrame:
    """kind, value, attempt of the values (in lower case) whose first surrogate isn't theirs alone, in any case of letters."""
    # names of one script are told apart whatever part they are
    group = lambda kind: F.regexp_replace(kind, "^[mfn]_", "")
    pending = values.withColumn("attempt", F.lit(0))
    taken: DataFrame | None = None
    moved: DataFrame | None = None
    for attempt in range(most):
        emitted = F.lower(surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key))
        made = cut(pending.select("kind", "value", F.lit(attempt).alias("attempt"), group(F.col("kind")).alias("group"), emitted.alias("made")), "surrogates")
        used = values.select(group(F.col("kind")).alias("group"), F.col("value").alias("made"))
        used = used if taken is None else used.unionByName(taken.select("group", "made"))
        first = made.withColumn("place", F.row_number().over(Window.partitionBy("group", "made").orderBy("value", "kind"))).where("place = 1").drop("place")
        won = first.join(used, ["group", "made"], "left_anti")
        lost = cut(made.join(won.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value"), "collisions")
        if attempt:
            moved = won if moved is None else moved.unionByName(won)
        if lost.isEmpty():
            break
        taken = won if taken is None else taken.unionByName(won)
        pending = lost
    else:
        raise RuntimeError("too few surrogates for the distinct values")
    out = values.select("kind", "value").withColumn("attempt", F.lit(0)).where(F.lit(False))
    return out if moved is None else moved.select("kind", "value", "attempt")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs``, text with surrogates, and n_entities. Who knows ``key`` can link surrogates to guessed values.

    A null text stays null and an empty one empty; texts without entities are unchanged, byte for byte. Repeated
    rows get equal results; texts of any length are searched whole; columns other than text pass through (a column
    named like one this adds is replaced). An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    may = F.col("text").rlike(HINT)
    found = F.when(may, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    entities = F.coalesce(found, F.array().cast("array<string>"))
    units = docs.select(F.explode(entities).alias("e")).select(F.explode(split_entity(F.col("e"))).alias("u"))
    values = cut(units.select(F.col("u.kind").alias("kind"), F.lower("u.value").alias("low"), F.col("u.value").alias("value")).groupBy("kind", "low").agg(F.min("value").alias("value")).select("kind", F.col("low").alias("value")), "entities")
    odd = cut(exceptions(values, key), "exceptions")

    base = docs.select(*names, entities.alias("__found"))
    if not odd.isEmpty():
        keyed = base.withColumn("__key", F.xxhash64(F.to_json(F.col("__found")), F.col("text")))
        held = keyed.where(F.size("__found") > 0).select("__key", F.explode("__found").alias("e")).select("__key", F.explode(split_entity(F.col("e"))).alias("u"))
        mine = held.select("__key", F.col("u.kind").alias("kind"), F.lower("u.value").alias("value")).join(odd, ["kind", "value"]).distinct()
        lists = mine.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "value").alias("k"), F.col("attempt").alias("v")))).alias("__attempts"))
        base = keyed.join(lists, "__key", "left").drop("__key")
    else:
        base = base.withColumn("__attempts", F.lit(None).cast("map<string,int>"))

    def put(e: Column) -> Column:
        attempt = lambda u: F.coalesce(F.try_element_at("__attempts", F.concat_ws("\x1f", u["kind"], F.lower(u["value"]))), F.lit(0))
        made = F.transform(split_entity(e), lambda u: F.struct(u["value"].alias("old"), surrogate(u["kind"], u["value"], attempt(u), key).alias("new")))
        # parts stand in the entity in their order; the last one ends it (but for a closing quote)
        step = lambda acc, u: let(F.instr(acc["rest"], u["old"]), lambda at: F.struct(F.concat(acc["done"], F.substr(acc["rest"], F.lit(1), at - 1), u["new"]).alias("done"), F.substr(acc["rest"], at + F.length(u["old"])).alias("rest")))
        title = F.regexp_extract(e, rf"^(?:{TITLES})\.? ", 0)  # its letters are never taken for a part's
        start = F.struct(title.alias("done"), F.substr(e, F.length(title) + 1).alias("rest"))
        return F.aggregate(made, start, step, lambda acc: F.concat(acc["done"], acc["rest"]))

    pieces = F.split("text", PATTERN, -1)
    joined = let(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(F.col("__new"), i), F.lit("")))), ""))
    base = base.withColumn("__new", F.transform("__found", put))
    text = F.when(F.size("__found") > 0, joined).otherwise(F.col("text"))
    return base.select(*[text.alias("text") if c == "text" else F.col(c) for c in names], F.size("__found").cast("long").alias("n_entities"))


def key_of(spark: SparkSession) -> str:
    """The session's secret; for the invented data of the test tables a public one does."""
    return spark.conf.get("spark.corpusloom.pii.key", None) or "key of the test tables"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), key_of(spark)).select("doc_id", "text", "n_entities")


QUERIES = {"op1_pii_surrogates": op1_pii_surrogates}
