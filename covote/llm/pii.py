"""Personal data replaced by surrogates of the same kind, with DataFrame functions only.

Found are e-mail addresses, IPv4 addresses, phone, card, social-security and bank account numbers,
secret keys, and names of persons (after a title or a known given name). An entity's surrogate is
drawn from a keyed hash of its normal form, so all its mentions agree in every document, however
they are written: digits stand for digits, letters for letters of their script and case, separators
stay, a card number that passes its check digit still does, a domain keeps its ending, a given name
its gender. Parts of a name are entities of their own, so "Dr. Weber" and "Anna Weber" share one.

Two entities that draw the same surrogate, or an entity whose surrogate is itself real, are found by
an aggregation over all entities; the later one draws again until all differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covote.llm.common import kept

KEY = "surrogates-1"
ROUNDS = 64  # of drawing again
SUBSCRIBER = 10  # digits of a phone number without the code of its country, which stays

# Titles and given names that mark a person, by gender.
MALE_TITLES = ["Mr", "Herr", "Sir", "Sr", "Señor", "Monsieur", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Госпожа"]
OTHER_TITLES = ["Dr", "Prof"]
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Paul",
              "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "Luc", "Carlos", "José", "Juan", "Miguel",
              "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий"]
FEMALE_NAMES = ["Mary", "Anna", "Linda", "Susan", "Sarah", "Emma", "Julia", "Laura", "Alice", "Jane",
                "Ursula", "Sabine", "Petra", "Marie", "Claire", "Sophie", "María", "Carmen", "Lucía", "Elena",
                "Мария", "Ольга", "Наталья", "Татьяна", "Елена"]
# Syllables of invented names, sixteen for each script, so that a hex digit picks one.
LATIN = ["ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "wi", "zo", "ka", "le"]
CYRILLIC = ["ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "ви", "зо", "ка", "ле"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORD = r"\p{Lu}[\p{L}'’-]*+"
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_NAMES = "|".join(MALE_NAMES + FEMALE_NAMES + [n.upper() for n in MALE_NAMES + FEMALE_NAMES])
# Every pattern starts where a run of its characters starts and never steps back into one: linear in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:sk|pk|ghp|gho|xoxb)[_-][A-Za-z0-9_-]{16,}+|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<!\d)(?:\d{1,3}[.-])?\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "person": rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? {_WORD}(?: {_WORD})?|(?:{_NAMES}) {_WORD})",
}
ANY = "|".join(PATTERNS.values())
# no entity is without one of these; the secrets are those that may have no digit
HINT = rf"[0-9@]|(?:sk|pk|ghp|gho|xoxb)[_-][A-Za-z_-]{{16}}|AKIA[A-Z]{{16}}|[a-f]{{32}}|[A-F]{{32}}|(?<!\p{{L}})(?:{_TITLES}|{_NAMES})[. ]"


def alike(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def kind(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention; the look-arounds hold at its ends."""
    found = F.lit("person")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        found = F.when(alike(mention, pattern), name).otherwise(found)
    return found


def mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def unit(kind_: Column, canon: Column) -> Column:
    return F.struct(kind_.alias("kind"), canon.alias("canon"))


def units(mention: Column) -> Column:
    """The entities of a mention: one, or the parts of a name."""
    k = kind(mention)
    plain = F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    parts = F.filter(
        F.transform(name_words(mention), lambda w, i: unit(name_kind(mention, i), F.lower(w))),
        lambda u: u["kind"] != "title",
    )
    return (
        F.when(k == "person", parts)
        .when(k == "phone", F.array(unit(k, F.right(plain, F.lit(SUBSCRIBER)))))
        .when(k.isin("email", "ip"), F.array(unit(k, F.lower(mention))))
        .otherwise(F.array(unit(k, plain)))
    )


def name_words(mention: Column) -> Column:
    return F.split(mention, " ")


def _titled(mention: Column) -> Column:
    return mention.rlike(rf"^(?:{_TITLES})\.? ")


def name_kind(mention: Column, i: Column) -> Column:
    """What the word at ``i`` of a person's mention is: title, given name of a gender, or surname."""
    titled, n = _titled(mention), F.size(name_words(mention))
    female = mention.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\.? ") | mention.rlike(
        rf"^(?:(?:{_TITLES})\.? )?(?i:{'|'.join(FEMALE_NAMES)}) "
    )
    given = (~titled & (i == 0)) | (titled & (n == 3) & (i == 1))
    return (
        F.when(titled & (i == 0), "title")
        .when(given & female, "female")
        .when(given, "male")
        .otherwise("surname")
    )


def stream(kind_: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hex digits that only the holder of the key can tell."""
    seed = F.concat_ws("\x1f", F.lit(key), kind_, canon, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("2"), seed), 256))


def _byte(hexes: Column, k: Column) -> Column:
    return F.conv(F.substr(hexes, k * 2 % 128 + 1, F.lit(2)), 16, 10).cast("int")


def redrawn(text: Column, hexes: Column, keep: Column) -> Column:
    """``text`` with another character of its class for each one after the first ``keep``."""
    of = lambda letters, b: F.substr(F.lit(letters), b % len(letters) + 1, F.lit(1))
    hexadecimal = text.rlike("^[0-9a-f]{32,}$")

    def drawn(c: Column, k: Column) -> Column:
        b = _byte(hexes, k)
        return (
            F.when(k < keep, c)
            .when(hexadecimal, of("0123456789abcdef", b))
            .when(c.between("0", "9"), of("0123456789", b))
            .when(c.between("a", "z"), of("abcdefghijklmnopqrstuvwxyz", b))
            .when(c.between("а", "я"), of("абвгдежзиклмнопрстуфхцчшэюя", b))
            .when(c.rlike(r"^\p{L}$"), of("aeiouy", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), lambda c, k: drawn(c, k)), "")


def luhn(digits: Column) -> Column:
    """Remainder by 10 of the check sum of card numbers."""
    turned = F.split(F.reverse(digits), "")
    each = F.transform(
        turned,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10


def surrogate(kind_: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of an entity's normal form, itself in normal form."""
    hexes = stream(kind_, canon, attempt, key)
    size = F.length(canon)
    keep = (
        F.when(kind_ == "card", 1)
        .when(kind_ == "iban", 2)
        .when((kind_ == "secret") & canon.rlike("^(?:sk|pk|ghp|gho|xoxb|akia)") & ~canon.rlike("^[0-9a-f]{32,}$"), 4)
        .otherwise(0)
    )
    plain = redrawn(canon, hexes, keep)
    short = F.substr(plain, F.lit(1), F.greatest(size - 1, F.lit(0)))
    checked = F.concat(short, ((10 - luhn(F.concat(short, F.lit("0")))) % 10).cast("string"))
    ip = F.concat_ws(".", *[(_byte(hexes, F.lit(i)) % (223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    domain = F.substring_index(canon, "@", -1)
    labels = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    email = F.concat(
        redrawn(F.substring_index(canon, "@", 1), hexes, F.lit(0)),
        # from the third draw on a letter more each time, so there is no end of addresses
        F.substr(F.translate(hexes, "0123456789", "ghijklmnop"), F.lit(1), F.greatest(attempt - 2, F.lit(0))),
        F.lit("@"),
        redrawn(labels, stream(F.lit("domain"), domain, F.lit(0), key), F.lit(0)),
        F.regexp_extract(domain, r"(\.[^.]*)$", 1),
    )
    cyrillic = canon.rlike(r"^\p{IsCyrillic}")
    syllables = F.when(cyrillic, F.array(*map(F.lit, CYRILLIC))).otherwise(F.array(*map(F.lit, LATIN)))
    # from the third draw on a syllable more each time, so there is no end of names
    stem = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(2) + F.greatest(attempt - 2, F.lit(0))),
            lambda k: F.get(syllables, F.conv(F.substr(hexes, k % 128 + 1, F.lit(1)), 16, 10).cast("int")),
        ),
        "",
    )
    ending = (
        F.when((kind_ == "female") & cyrillic, "на")
        .when(kind_ == "female", "na")
        .when((kind_ == "male") & cyrillic, "н")
        .when(kind_ == "male", "n")
        .when(cyrillic, "ров")
        .otherwise("rd")
    )
    return (
        F.when(kind_.isin("male", "female", "surname"), F.concat(stem, ending))
        .when(kind_ == "email", email)
        .when(kind_ == "ip", ip)
        .when((kind_ == "card") & (luhn(F.when(kind_ == "card", canon)) == 0), checked)
        .otherwise(plain)
    )


def laid_out(mention: Column, drawn: Column) -> Column:
    """``drawn`` with the separators and the case of ``mention``, which has as many letters and digits."""
    chars = F.split(mention, "")
    is_drawn = F.transform(chars, lambda c: c.rlike(r"^[\p{L}\p{N}]$").cast("int"))
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                F.get(is_drawn, i) == 1,
                F.when(
                    (c == F.upper(c)) & (c != F.lower(c)),
                    F.upper(F.substr(drawn, F.aggregate(F.slice(is_drawn, 1, i + 1), F.lit(0), lambda a, b: a + b), F.lit(1))),
                ).otherwise(F.substr(drawn, F.aggregate(F.slice(is_drawn, 1, i + 1), F.lit(0), lambda a, b: a + b), F.lit(1))),
            ).otherwise(c),
        ),
        "",
    )


def replaced(mention: Column, attempts: Column, key: str = KEY) -> Column:
    """The surrogate of a mention as it is written. ``attempts``: map from ``kind:canon`` to the draw."""
    found = units(mention)

    def draw(u: Column) -> Column:
        tried = F.coalesce(F.element_at(attempts, F.concat_ws(":", u["kind"], u["canon"])), F.lit(0))
        return surrogate(u["kind"], u["canon"], tried, key)

    one = F.transform(found, draw)
    first = F.get(one, F.lit(0))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    shouted = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    titled = _titled(mention).cast("int")
    name = F.array_join(
        F.transform(
            name_words(mention),
            lambda w, i: F.when(i < titled, w).when((F.upper(w) == w) & (F.length(w) > 1), F.upper(F.get(one, i - titled))).otherwise(
                F.initcap(F.get(one, i - titled))
            ),
        ),
        " ",
    )
    k = kind(mention)
    return (
        F.when(k == "person", name)
        .when(k == "ip", first)
        .when(k == "email", F.when(shouted, F.upper(first)).otherwise(first))
        .when(k == "phone", laid_out(mention, F.concat(F.substr(digits, F.lit(1), F.length(digits) - F.length(first)), first)))
        .otherwise(laid_out(mention, first))
    )


def redraws(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, canon, attempt`` of the entities whose first draw is taken or is itself an entity.

    ``entities`` are distinct. Each round finds, by aggregation, the surrogates that several entities
    hold and lets all but the one of fewest draws and least canon draw again; it ends when all differ. Names
    and addresses grow, so they always come to differ. Numbers keep their digits: if there are nearly as many
    entities of a form as there are numbers, some may still be taken after ``ROUNDS`` rounds, and stay so.
    """
    held = kept(entities.select("kind", "canon", F.lit(0).alias("attempt")), "entities")
    for _ in range(ROUNDS):
        drawn = held.withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        owner = drawn.groupBy("kind", "s").agg(
            F.min(F.struct("attempt", "canon")).alias("o"), F.count(F.lit(1)).alias("n")
        ).where("n > 1")
        late = drawn.join(owner, ["kind", "s"]).where("o.canon != canon").select("kind", "canon")
        real = drawn.join(held.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_semi").select("kind", "canon")
        again = kept(late.unionByName(real).distinct(), "taken")
        if again.isEmpty():
            break
        held = kept(
            held.join(again.withColumn("more", F.lit(1)), ["kind", "canon"], "left").select(
                "kind", "canon", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")
            ),
            "entities",
        )
    return held.where("attempt > 0")


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced, and ``n_entities``, the number of mentions.

    All rows and the other columns stay as they are; a column of the name ``n_entities`` is replaced.
    Nulls stay null with no mentions, a text without an entity is unchanged. Copies of a text get the
    same text. The same key gives the same surrogates in every run over the same entities.
    """
    docs = docs.drop("n_entities")
    text = F.col("text")
    found = docs.select(text).withColumn("_m", mentions(text)).where(F.size("_m") > 0)
    entities = (
        found.select(F.explode(F.array_distinct(F.flatten(F.transform("_m", units)))).alias("u"))
        .select("u.kind", "u.canon")
        .distinct()
    )
    again = kept(redraws(entities, key), "redraws")
    none = F.lit(None).cast("map<string,int>")
    if again.isEmpty():
        rows = docs.withColumn("_attempts", none)
    else:
        # few texts have such an entity; they are told by a hash, and a stranger's entry does no harm
        by_text = kept(
            found.select(F.xxhash64(text).alias("_h"), F.explode(F.array_distinct(F.flatten(F.transform("_m", units)))).alias("u"))
            .select("_h", "u.kind", "u.canon")
            .join(again, ["kind", "canon"])
            .select("_h", F.concat_ws(":", "kind", "canon").alias("k"), "attempt")
            .distinct()
            .groupBy("_h")
            .agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("_attempts")),
            "attempts",
        )
        rows = docs.join(by_text, F.xxhash64(text) == F.col("_h"), "left").drop("_h")
    pieces = F.split(text, ANY, -1)
    new = F.transform("_m", lambda m: replaced(m, F.col("_attempts"), key))
    joined = F.array_join(
        F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""
    )
    rows = rows.withColumn("_m", mentions(text))
    return rows.withColumn("n_entities", F.when(F.size("_m") > 0, F.size("_m")).otherwise(0)).withColumn(
        "text", F.when(F.size("_m") > 0, joined).otherwise(text)
    ).drop("_m", "_attempts")
