r"""PII: surrogates in place of personal data, with DataFrame functions only.

Entities are found by one pattern and named by their type and canonical form (an e-mail address in lower
case, the digits of a number however it is written, and so on).  Each canonical form gets one surrogate
for the whole corpus, drawn with a keyed hash, of the same type and format: digits stay digits and
separators stay, cards keep their length and a valid check digit, countries of phone numbers and IBANs
stay, invented names have the script of the name and the gender of its title.  So every mention of an
entity, in any document and spelling, gets the same surrogate (coreference).

Surrogates are checked against each other and against all real entities.  Of entities that drew the same
one, the first keeps it, and the others, like those that drew a real entity, draw again until no clash is
left (distinctness).  Family names and given names (of a gender) are entities of their own and drawn as such, and a full name is
put together from its parts, so "Mr Smith" and "Mr John Smith" share a family name whatever had to be drawn again.
The spaces of invented names and phone numbers are small, so they grow with the draws: names get one more syllable each
second draw, phone numbers one more digit a draw after the first four; social security numbers and addresses leave their
reserved ranges after ten draws.

The table of entities is small beside the texts; it alone is shuffled, with those texts that hold
entities.  Entities are counted once before any join, so one that a third of all documents hold is a line.

Defined results: a null text stays null and an empty one empty, with 0 replaced; nulls elsewhere, repeated
rows and all other columns are carried along (one named like ``replaced`` is left out); an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import stored

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = {
    "f": r"Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra|госпожа|κυρία",
    "m": r"Mr|Sir|Monsieur|Herr|Señor|Sr|господин|κύριος",
    "n": r"Dr|Prof",
}
#: Types in order of precedence, each with its pattern (Java syntax, no groups).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<=[\"'])(?=[A-Za-z_\-+/=]*+\d)(?=[\d_\-+/=]*+[A-Za-z])[A-Za-z0-9_\-+/=]{16,}+(?=[\"'])|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?=[a-f]*+\d)[0-9a-f]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+.\-])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w)",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(_TITLES.values())})\.? \p{{Lu}}[\p{{Ll}}]+(?: \p{{Lu}}[\p{{Ll}}]+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Syllables of invented names by script, and endings by script and gender.
SYLLABLES = {
    "latin": ("ba", "cor", "da", "el", "fa", "gre", "hol", "ir", "jo", "ka", "lu", "mar", "ne", "or", "pa", "ren", "sol", "ta", "vi", "wen"),
    "cyrillic": ("ал", "бор", "ве", "гар", "да", "ел", "жа", "зо", "ир", "ка", "ле", "ми", "нор", "ол", "пе", "ра"),
    "greek": ("αλ", "βα", "γε", "δα", "ελ", "ζη", "θε", "ιρ", "κα", "λε", "μα", "νι", "ορ", "πα", "ρε", "σο"),
}
ENDINGS = {
    "latin": {"f": "a", "m": "on", "n": "is"},
    "cyrillic": {"f": "ина", "m": "ин", "n": "енко"},
    "greek": {"f": "η", "m": "ος", "n": "ι"},
}
#: Draws after which the space of a format counts as used up: its real entities fill it, or nearly so.
MOST_DRAWS = 100
#: Entities that a task draws surrogates for, about.
TASK_ENTITIES = 1000


def may_hold(text: Column) -> Column:
    """Cheap test that every text with an entity passes: it holds a digit, an @ or a title."""
    out = text.contains("@") | text.rlike("[0-9]")
    for title in "|".join(_TITLES.values()).split("|"):
        out |= text.contains(title)
    return out


def _type(raw: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(raw.rlike(f"^(?:{pattern})$" if kind != "secret" else r"^(?=[^@ .]*$)(?:[A-Za-z0-9_\-+/=]{16,})$") & (F.lit(kind != "secret") | raw.rlike("[A-Za-z]")), kind).otherwise(out)
    return out


def _gender(raw: Column) -> Column:
    return F.when(raw.rlike(f"^(?:{_TITLES['f']})[. ]"), "f").when(raw.rlike(f"^(?:{_TITLES['m']})[. ]"), "m").otherwise("n")


def _name(raw: Column) -> Column:
    """A titled name without its title."""
    return F.regexp_replace(raw, r"^\S+ ", "")


def canonical(kind: Column, raw: Column) -> Column:
    """What all spellings of an entity share."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "name", F.concat_ws("|", _gender(raw), _name(raw)))
        .otherwise(raw)
    )


def _numbers(seed: Column, n: int = 96) -> Column:
    """n keyed numbers of 0 to 255."""
    text = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{k}")), 256) for k in range(-(-n // 32))])
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(text, 1 + 2 * i, F.lit(2)), 16, 10).cast("int"))


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))


def _recast(text: Column, draws: Column, keep: Column | None = None) -> Column:
    """Each digit and letter replaced by one of its class; the first ``keep`` characters stay."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexed = text.rlike("^[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        d = F.element_at(draws, F.pmod(i, F.lit(96)) + 1)
        new = F.when(c.between("0", "9"), _pick("0123456789", d)).when(c.between("a", "z"), F.when(hexed, _pick("abcdef", d)).otherwise(_pick(lower, d))).when(c.between("A", "Z"), _pick(upper, d)).otherwise(c)
        return new if keep is None else F.when(i < keep, c).otherwise(new)

    return F.concat_ws("", F.transform(F.split(text, ""), one))


def _luhn_digit(digits: Column) -> Column:
    """The check digit that the digits before it call for."""
    back = F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int"))
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.pmod(10 - F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10, F.lit(10)).cast("string")


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits by modulus 97."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    mod = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), lambda a, c: (F.when(c.between("0", "9"), a * 10).otherwise(a * 100) + value(c)) % 97)
    return F.lpad((98 - mod).cast("string"), 2, "0")


def _invented(part: Column, ending: Column | None, n: Column, draw: Column) -> Column:
    """A name in the script of ``part``; ending: the gender that it shows, if any."""
    script = F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    draws = F.slice(n, 1, F.least(draw / 2, F.lit(60)).cast("int") + 3)
    out = None
    for name, syllables in SYLLABLES.items():
        table, size = F.array(*map(F.lit, syllables)), F.lit(len(syllables))
        word = F.concat_ws("", F.transform(draws, lambda d: F.element_at(table, F.pmod(d, size) + 1)))  # noqa: B023
        if ending is not None:
            word = F.concat(word, F.when(ending == "f", ENDINGS[name]["f"]).when(ending == "m", ENDINGS[name]["m"]).otherwise(ENDINGS[name]["n"]))
        out = F.initcap(word) if out is None else F.when(script == name, F.initcap(word)).otherwise(out)
    return out


def numbers(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """The keyed numbers of a canonical form's ``draw``-th draw."""
    return _numbers(F.concat_ws("|", F.lit(key), kind, canon, draw.cast("string")))


def surrogate(kind: Column, canon: Column, draw: Column, n: Column) -> Column:
    """What stands for a canonical form, drawn with the numbers ``n``; itself a canonical form of the type."""
    first = F.when(canon.rlike(r"^\+[17]"), 2).when(canon.startswith("+"), 3).otherwise(0)
    phone = _recast(canon, n, first)
    phone = F.concat(F.substring(phone, F.lit(1), first), (F.element_at(n, 90) % 8 + 2).cast("string"), F.substring(phone, first + 2, F.lit(40)))
    phone = F.concat(phone, F.concat_ws("", F.transform(F.slice(n, 60, F.greatest(F.lit(0), F.least(draw - 3, F.lit(20)))), lambda d: (d % 10).cast("string"))))
    card = F.concat(F.substring(canon, 1, 1), F.substring(_recast(canon, n), F.lit(2), F.length(canon) - 2))
    valid = _luhn_digit(F.substring(canon, F.lit(1), F.length(canon) - 1)) == F.substring(canon, -1, 1)
    card = F.concat(card, F.when(valid, _luhn_digit(card)).otherwise((F.element_at(n, 91) % 10).cast("string")))
    country, rest = F.substring(canon, 1, 2), _recast(F.substring(canon, 5, 60), n)
    octet = lambda k: (F.element_at(n, k) % 254 + 1).cast("string")
    local = F.substring_index(canon, "@", 1)
    email = F.concat(_recast(local, n), F.lit("@"), F.concat(*[_pick("abcdefghijklmnopqrstuvwxyz", F.element_at(n, k)) for k in range(80, 85)]), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), F.element_at(n, 92) % 3 + 1))
    gender = F.substring_index(canon, "|", 1)
    ssn = F.when(draw < 10, F.concat(F.lit("9"), F.substring(_recast(canon, n), 2, 8))).otherwise(_recast(canon, n))
    ip = F.concat_ws(".", F.when(draw < 10, (F.element_at(n, 1) % 16 + 240).cast("string")).otherwise(octet(1)), octet(2), octet(3), octet(4))
    return (
        F.when(kind == "email", email)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "ssn", ssn)
        .when(kind == "iban", F.concat(country, _iban_check(country, rest), rest))
        .when(kind == "ip", ip)
        .when(kind == "family", _invented(canon, None, n, draw))
        .when(kind == "given", F.concat(gender, F.lit("|"), _invented(F.substring_index(canon, "|", -1), gender, n, draw)))
        .otherwise(_recast(canon, n))
    )


def _written(kind: Column, raw: Column, made: Column, plain: Column) -> Column:
    """A surrogate in the spelling of the mention: its separators, its title, its spaces; plain: its digits and letters, more than the mention's perhaps."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    refill = F.aggregate(
        F.split(raw, ""), start,
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substring(plain, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
        lambda a: F.concat(a["out"], F.substring(plain, a["k"], F.lit(40))),
    )
    title = F.regexp_extract(raw, r"^\S+ ", 0)
    return F.when(kind == "name", F.concat(title, F.substring_index(made, "|", -1))).when(kind.isin("phone", "card", "ssn", "iban"), refill).otherwise(made)


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon -> with a surrogate that no other has and that is no real entity."""
    names = entities.where("kind = 'name'").select("canon", F.substring_index("canon", "|", 1).alias("gender"), F.substring_index("canon", "|", -1).alias("name"))
    names = names.select("canon", "gender", F.substring_index("name", " ", -1).alias("family"), F.when(F.instr("name", " ") > 0, F.concat_ws("|", "gender", F.substring_index("name", " ", 1))).alias("given"))
    parts = names.select(F.lit("family").alias("kind"), F.col("family").alias("canon")).union(names.where("given is not null").select(F.lit("given"), "given"))
    single = stored(entities.where("kind <> 'name'").select("kind", "canon").union(parts).distinct())
    real = single.select("kind", F.col("canon").alias("made"))
    waiting, held, n = single, [], single.count()
    for draw in range(MOST_DRAWS):
        # Few rows, but each costs many steps: dealt over tasks by their number.  The numbers are written before they are used,
        # since each character of a surrogate refers to them, and would else draw them anew.
        dealt = waiting.repartition(max(1, n // TASK_ENTITIES), "kind", "canon")
        new = stored(dealt.withColumn("numbers", numbers(F.col("kind"), F.col("canon"), F.lit(draw), key)))
        new = stored(new.select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), F.lit(draw), F.col("numbers")).alias("made")))
        wanted = new.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        taken = real
        for before in held:
            taken = taken.union(before.select("kind", "made"))
        # the table of what is wanted shrinks with each draw; the join sends it to the others where it is small
        taken = taken.join(wanted.select("kind", "made"), ["kind", "made"]).distinct()
        held.append(stored(wanted.join(taken, ["kind", "made"], "left_anti").select("kind", "canon", "made")))
        waiting = stored(new.join(held[-1].select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon"))
        n = waiting.count()
        if not n:
            break
    else:
        raise ValueError(f"no free surrogate after {MOST_DRAWS} draws")
    made = held[0]
    for more in held[1:]:
        made = made.union(more)
    family = made.where("kind = 'family'").select(F.col("canon").alias("family"), F.col("made").alias("new_family"))
    given = made.where("kind = 'given'").select(F.col("canon").alias("given"), F.col("made").alias("new_given"))
    whole = F.concat(F.col("gender"), F.lit("|"), F.concat_ws(" ", F.substring_index("new_given", "|", -1), "new_family"))
    full = names.join(family, "family").join(given, "given", "left").select(F.lit("name").alias("kind"), "canon", whole.alias("made"))
    out = made.where("kind not in ('family', 'given')").union(full)
    return stored(out.select("kind", "canon", "made", F.regexp_replace("made", "[^0-9A-Za-z]", "").alias("plain")))


def replace(docs: DataFrame, key: str, text: str = "text", replaced: str = "n_replaced") -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of mentions replaced in ``replaced``.

    key: the secret that surrogates are drawn with; the same key gives the same surrogates.
    """
    names = [c for c in docs.columns if c.lower() != replaced.lower()]
    body = F.col(f"`{text}`")
    has = F.coalesce(may_hold(body) & body.rlike(PATTERN), F.lit(False))
    others = [F.col(f"`{c}`") for c in names]
    free = docs.where(~has).select(*others, F.lit(0).cast("long").alias(replaced))
    touched = stored(docs.where(has).select(*others, F.md5(body.cast("binary")).alias("__text"), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)).alias("__found")))

    mentions = stored(touched.select("__text", F.explode(F.array_distinct("__found")).alias("raw")).distinct().withColumn("kind", _type(F.col("raw"))).withColumn("canon", canonical(F.col("kind"), F.col("raw"))))
    drawn = _drawn(stored(mentions.select("kind", "canon").distinct()), key)
    spelled = mentions.join(drawn, ["kind", "canon"]).select("__text", F.struct("raw", _written(F.col("kind"), F.col("raw"), F.col("made"), F.col("plain")).alias("new")).alias("pair"))
    by_text = spelled.groupBy("__text").agg(F.map_from_entries(F.collect_list("pair")).alias("__new"))

    between = F.split(body, PATTERN, -1)
    filled = F.transform(F.col("__found"), lambda raw: F.element_at("__new", raw))
    whole = F.concat_ws("", F.flatten(F.zip_with(between, filled, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    joined = touched.join(by_text, "__text")
    done = joined.select(*[whole.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in names], F.size("__found").cast("long").alias(replaced))
    return free.unionByName(done)
