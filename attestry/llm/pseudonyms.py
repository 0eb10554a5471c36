"""Format-preserving pseudonyms of personal numbers and dates by a keyed Feistel network.

Card numbers (checked by Luhn's rule), telephone numbers, internet addresses (octets checked) and dates (calendar checked) are
permuted within their own format: digits stay digits, separators stay where they were, a card number keeps a right check digit and
a date is a date, of 1900 to 2101 if it was one.  The permutation depends on the key and the kind only, so equal values stay equal across documents, and
different ones different.  Mail addresses have no number to permute: their local part becomes a keyed digest.

Only DataFrame functions: a text is cut at its matches, the matches are mapped, and the parts are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

#: What is looked for.  A digit next to a match means that it is part of some longer number, so there is none.
#: Repeats are possessive, so that a match takes the same stack however long it is.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?<!(?<![0-9])[0-9]{5,11}-)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: Numbers with single spaces or hyphens between: cards are looked for among them first and put between two of Unicode's noncharacters.
#: Numbers of mail and internet addresses, dates and telephones with a country or area code before them are left out.
#: A mail address's local part has 64 characters at most, so that is how far its end is looked for.
NUMBER = r"[0-9]++(?![A-Za-z0-9._%+-]{0,64}+@)(?!\.[0-9]{1,3}\.[0-9])"
NUMBERS = (
    r"(?<![0-9])(?<!\.[0-9]{1,3}\.)(?<!\([0-9]{3}\) ?)(?!(?<=\+)[0-9]{1,3}[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]))"
    rf"{NUMBER}(?:[ -]{NUMBER})*+"
)
OPEN, CLOSE = "\ufdd0", "\ufdd1"
CARD = f"{OPEN}[0-9][0-9 -]*+{CLOSE}"
CARD_DIGITS = (13, 19)
ANY = "|".join((EMAIL, ADDRESS, DATE, PHONE, CARD))
KINDS = ("email", "address", "date", "phone", "card")
ROUNDS = 8
#: Dates of the years 1 to 9999 count their days from this one.  Two permutations share them, so that near dates stay near ones: those of
#: NEAR[0] * NEAR[1] days from 1900-01-01 on go by one, all others, of which there are FAR[0] * FAR[1], by the other.
FIRST_DATE, NEAR_FROM = "0001-01-01", 693_595
NEAR, FAR = (256, 287), (1801, 1987)


def feistel(left: Column, right: Column, size_left: Column, size_right: Column, tag: Column, rounds: int = ROUNDS) -> Column:
    """struct(l, r): a permutation of the pairs with ``left`` under ``size_left`` and ``right`` under ``size_right``.

    Rounds add a keyed hash of one half to the other in turn, modulo that half's size.
    """

    def mixed(i: Column, half: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", tag, i.cast("string"), half.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (s["l"] + mixed(i, s["r"], size_left)) % size_left).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise((s["r"] + mixed(i, s["l"], size_right)) % size_right).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _permuted(digits: Column, tag: Column) -> Column:
    """A string of two or more digits, permuted among the strings of its length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(digits.substr(F.lit(1), a), digits.substr(a + 1, n), ten(a), ten(n - a), F.concat_ws(":", tag, n.cast("string")))
    return F.transform(F.array(out), lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), n - a, "0")))[0]


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, digits.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at")
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn's weighted sum: every second digit from the right is doubled and its digits added."""

    def add(total: Column, i: Column) -> Column:
        d = F.reverse(digits).substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _as_date(m: Column) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    return F.coalesce(F.try_to_date(F.when(iso, m), "yyyy-MM-dd"), F.try_to_date(F.when(~iso, m), "dd.MM.yyyy"))


def _day(m: Column) -> Column:
    return F.datediff(_as_date(m), F.lit(FIRST_DATE).cast("date"))


def _other_day(day: Column, tag: Column) -> Column:
    """The day that stands for ``day``."""
    near_days = NEAR[0] * NEAR[1]
    near = day.between(NEAR_FROM, NEAR_FROM + near_days - 1)
    place = F.when(near, day - NEAR_FROM).when(day < NEAR_FROM, day).otherwise(day - near_days)
    a, b = (F.when(near, F.lit(x)).otherwise(F.lit(y)).cast("long") for x, y in zip(NEAR, FAR, strict=True))
    out = F.transform(F.array(feistel(F.floor(place / b), place % b, a, b, tag)), lambda s: (s["l"] * b + s["r"]).cast("int"))[0]
    return F.when(near, out + NEAR_FROM).when(out < NEAR_FROM, out).otherwise(out + near_days)


def _matches(m: Column, pattern: str) -> Column:
    """The whole match is of this pattern; what stood before it was looked at when it was found."""
    return m.rlike(f"^(?:{pattern})$")


def kind_of(m: Column) -> Column:
    """The kind of a match, or null if it does not stand up to its check."""
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(_matches(m, ADDRESS), F.when(octets, "address"))
        .when(_matches(m, DATE), F.when(_day(m) >= 0, "date"))
        .when(_matches(m, PHONE), "phone")
        .when(luhn_sum(_digits(m)) % 10 == 0, "card")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for the match ``m`` of ``kind``; a match without a kind stands for itself."""
    tag = F.concat_ws(":", F.lit(key), kind)
    digits = _digits(m)
    body = digits.substr(F.lit(1), F.length(digits) - 1)
    card = F.transform(F.array(_permuted(body, tag)), lambda b: F.concat(b, ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))[0]
    n = F.length(digits)
    phone = F.concat(digits.substr(F.lit(1), n - 10), _permuted(digits.substr(n - 9, F.lit(10)), tag))
    parts = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    word = F.lit(65536).cast("long")
    address = F.transform(
        F.array(feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], word, word, tag)),
        lambda s: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256))),
    )[0]
    date = F.date_add(F.lit(FIRST_DATE).cast("date"), _other_day(_day(m), tag))
    local = F.substring_index(m, "@", 1)
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", tag, F.lower(local)), 256), 1, 12), m.substr(F.length(local) + 1, F.length(m)))
    return (
        F.when(kind == "card", _refilled(m, card))
        .when(kind == "phone", _refilled(m, phone))
        .when(kind == "address", address)
        .when(kind == "date", F.when(m.rlike("^[0-9]{4}-"), F.date_format(date, "yyyy-MM-dd")).otherwise(F.date_format(date, "dd.MM.yyyy")))
        .when(kind == "email", email)
        .otherwise(m)
    )


def _cards_marked(numbers: Column) -> Column:
    """``numbers``, a match of ``NUMBERS``, with its cards marked: whole numbers in a row that have a card's length and check digit.

    From left to right, the longest first; three numbers that make a date or a telephone are passed over.  A card's numbers have four
    digits at least, but for the last; others count only where ``numbers`` begin or go on after a find, as many as a card can hold.
    """
    low, high = CARD_DIGITS

    def step(g: Column, s: Column, i: Column) -> Column:
        # By places: a slice would go through all of ``g`` at every step.
        joined = lambda n: F.array_join(F.transform(F.sequence(i, F.least(i + n - 1, F.size(g))), lambda k: F.get(g, k - 1)), "")
        other = joined(F.lit(3)).rlike(f"^(?:{DATE}|{PHONE})")
        digits = lambda n: _digits(joined(n))
        shaped = lambda n: joined(n).rlike("^(?:[0-9]{4,}[ -])*[0-9]+[ -]?$")
        long = F.filter(F.sequence(F.lit(1), F.least(F.lit(high), F.size(g) - i + 1)), lambda n: F.length(digits(n)).between(low, high))
        fits = F.transform(F.array(long), lambda v: F.array_max(F.filter(v, lambda n: (shaped(n) | (s["fresh"] & (n == F.array_max(v)))) & (luhn_sum(digits(n)) % 10 == 0))))[0]
        # A number of fewer digits begins no card but where others count: runs of such numbers are long and many.
        fits = F.when(s["fresh"] | (F.length(F.get(g, i - 1)) > 4), fits)
        n = F.when(other, F.least(F.lit(3), F.size(g) - i + 1)).otherwise(fits)
        out = F.when(other | n.isNull(), joined(F.coalesce(n, F.lit(1)))).otherwise(F.regexp_replace(joined(n), "^(.*[0-9])", f"{OPEN}$1{CLOSE}"))
        return F.when(s["skip"] > 0, F.struct(s["out"].alias("out"), (s["skip"] - 1).alias("skip"), s["fresh"].alias("fresh"))).otherwise(
            F.struct(F.concat(s["out"], out).alias("out"), (F.coalesce(n, F.lit(1)) - 1).alias("skip"), n.isNotNull().alias("fresh"))
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"), F.lit(True).alias("fresh"))
    groups = F.array(F.regexp_extract_all(numbers, F.lit("[0-9]+[ -]?"), F.lit(0)))
    marked = F.transform(groups, lambda g: F.aggregate(F.sequence(F.lit(1), F.size(g)), start, lambda s, i: step(g, s, i), lambda s: s["out"]))[0]
    return F.when(F.length(_digits(numbers)) >= low, marked).otherwise(numbers)


def _rejoined(between: Column, parts: Column) -> Column:
    return F.array_join(F.flatten(F.zip_with(between, F.concat(parts, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal values in ``text_col`` replaced, and pii_kinds: the kind of every value replaced, in order.

    Whole texts are read.  A null text stays null and an empty one empty, both without kinds; an empty table gives no rows; repeated rows are
    treated alike.  A column of ``docs`` named pii_kinds gives way to the new one, any other stays as it is, whatever its name.
    Telephones are numbers of ten digits in groups of three, three and four, with or without a country's code; other countries'
    forms are not looked for.  The key is part of the plan: keep plans and event logs where the key may be kept.
    """
    taken = {c.lower() for c in docs.columns}
    cut, found_in = (next(n for n in (f"{name}{k or ''}" for k in range(len(taken) + 1)) if n not in taken) for name in ("__text", "__found"))
    text = F.col(text_col)
    carded = _rejoined(F.split(text, NUMBERS, -1), F.transform(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)), _cards_marked))
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(cut, F.lit(ANY), F.lit(0)))
    plain = lambda m: F.translate(m, OPEN + CLOSE, "")
    marked = docs.withColumn(cut, F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), carded).otherwise(text))
    marked = marked.withColumn(found_in, F.transform(F.transform(found, plain), lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))))
    swapped = F.transform(found_in, lambda x: pseudonym(x["m"], x["k"], key))
    joined = _rejoined(F.split(cut, ANY, -1), swapped)
    kinds = F.coalesce(F.filter(F.transform(found_in, lambda x: x["k"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return (
        marked.withColumn("pii_kinds", kinds)
        .withColumn(text_col, F.when(F.size("pii_kinds") > 0, joined).otherwise(text))
        .select(*[c for c in docs.columns if c != "pii_kinds"], "pii_kinds")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key="attestry-demo-key")
    counts = [(F.size("pii_kinds") - F.size(F.array_remove("pii_kinds", kind))).alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", *counts, "text")
