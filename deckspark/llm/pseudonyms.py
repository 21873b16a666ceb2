"""Format-preserving pseudonyms for personal data, on built-in expressions.

Found items are checked (Luhn digit, octets, calendar), and what is valid is permuted within its
own format by a keyed Feistel network over decimal strings, base-36 strings, address halves or
days. The permutation is one-to-one and depends on the key and the normalised value alone, so
equal values stay equal in all documents, whatever their separators or date order.

Defined cases: a null text stays null with no finds; items that fail their check stay as
they are; repeated rows give equal rows; texts of any length are rewritten whole; other
columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckspark.llm.common import free_name

ROUNDS = 8
#: Patterns of the items, tried in this order at each position. Fixed values.
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
#: Behind an ISO date the time of day may follow.
DATE = (
    r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9])|(?![0-9A-Za-z]))"
    r"|(?:[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]))"
)
MAIL = r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}+@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+"
KINDS = {"date": DATE, "social": SOCIAL, "address": ADDRESS, "phone": PHONE, "card": CARD, "mail": MAIL}
#: Numbers start with a digit or a plus sign; asking that first spares the alternatives at most positions.
NUMBERS = "(?=[0-9+])(?:" + "|".join(p for kind, p in KINDS.items() if kind != "mail") + ")"
ANY = f"{NUMBERS}|{MAIL}"
#: Days from 1800-01-01 to 2199-12-31: one whole Gregorian cycle, 189 x 773 days. Fixed values.
FIRST_DAY, DAY_ROWS, DAY_COLUMNS = "1800-01-01", 189, 773
DATE_FORMS = {"-": "yyyy-MM-dd", "/": "MM/dd/yyyy", ".": "dd.MM.yyyy"}
#: Longest half of a string that is permuted as one number, by base.
_HALF = {10: 17, 36: 11}


def _noise(key: str, kind: Column, step: Column, other: Column, size: Column) -> Column:
    """The round function: a keyed SHA-256 of the round and the other half, modulo ``size``."""
    text = F.concat_ws("|", F.lit(key), kind, step.cast("string"), other.cast("string"), size.cast("string"))
    number = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return F.pmod(number, size)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: Column) -> Column:
    """Permutes the pairs (left, right) with left < left_size and right < right_size."""
    start = F.struct(
        left.alias("a"), right.alias("b"), left_size.alias("m"), right_size.alias("n")
    )

    def turn(s: Column, step: Column) -> Column:
        moved = F.pmod(s["a"] + _noise(key, kind, step, s["b"], s["m"]), s["m"])
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_string(text: Column, base: int, key: str, kind: str) -> Column:
    """A string over the first ``base`` digits and lower-case letters, permuted within its length.

    Strings beyond two halves of bounded length are cut into blocks of about equal length. One block after the
    other is permuted under a key that takes in all other blocks as they are then, so going back
    from the last block undoes it: the whole is one-to-one, and each symbol counts for all blocks.
    """
    most = 2 * _HALF[base]

    def chained(t: Column) -> Column:
        def turn(whole: Column, k: Column) -> Column:
            at, width = k * t["width"], t["width"]
            before, after = F.substring(whole, F.lit(1), at), F.substr(whole, at + width + 1)
            others = F.concat_ws(":", F.lit(f"{kind}{base}"), k.cast("string"), before, after)
            block = F.struct(F.substr(whole, at + 1, width).alias("text"), others.alias("kind"))
            return F.concat(before, _bound(block, lambda x: _permute_block(x["text"], base, key, x["kind"])), after)

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.length(t["text"]) / most).cast("int") - 1), t["text"], turn)

    width = F.ceil(F.length(text) / F.ceil(F.length(text) / most)).cast("int")
    long = _bound(F.struct(text.alias("text"), width.alias("width")), chained)
    return F.when(F.length(text) <= most, _permute_block(text, base, key, F.lit(f"{kind}{base}"))).otherwise(long)


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once."""
    return F.transform(F.array(value), make)[0]


def _permute_block(text: Column, base: int, key: str, kind: Column) -> Column:
    """A string of at most two halves, permuted within its length."""
    powers = F.array(*[F.lit(base**k) for k in range(_HALF[base] + 1)])
    used = F.length(text)
    short = F.floor(used / 2).cast("int")
    long = used - short

    def size(length: Column) -> Column:
        return F.element_at(powers, length + 1).cast("long")

    def number(part: Column) -> Column:
        return F.coalesce(F.conv(part, base, 10).cast("long"), F.lit(0).cast("long"))

    def digits(value: Column, length: Column) -> Column:
        return F.lpad(F.lower(F.conv(value.cast("string"), 10, base)), length, F.lit("0"))

    ends = feistel(
        number(F.substring(text, F.lit(1), short)), number(F.substr(text, short + 1)), size(short), size(long), key, kind
    )
    mixed = F.concat(digits(ends["a"], short), digits(ends["b"], long))
    # One character has no halves: it is turned by a keyed step.
    alone = digits(F.pmod(number(text) + _noise(key, kind, F.lit(0), F.lit(0), F.lit(base)), F.lit(base)), F.lit(1))
    return F.when(used == 0, text).when(used == 1, alone).otherwise(mixed)


def _refill(pattern: Column, symbols: Column, fills: str) -> Column:
    """``pattern`` with its characters of class ``fills`` replaced one after the other by ``symbols``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, char: Column) -> Column:
        return F.when(
            char.rlike(fills),
            F.struct(F.concat(s["out"], F.substring(symbols, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(s["out"], char).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.filter(F.split(pattern, ""), lambda c: c != ""), start, put)["out"]


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the right; the digits at odd (1) or even (0) distance from the end are doubled."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, k: F.when(k % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(
            c.cast("int")
        ),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _card(item: Column, key: str) -> Column:
    digits = F.regexp_replace(item, "[^0-9]", "")
    body = permute_string(F.substring(digits, F.lit(1), F.length(digits) - 1), 10, key, "card")
    # With the check digit in place the sum doubles the digits at odd distance: even in the body.
    check = (10 - _luhn_sum(body, 0) % 10) % 10
    return F.when(luhn_valid(digits), _refill(item, F.concat(body, check.cast("string")), "[0-9]"))


def _phone(item: Column, key: str) -> Column:
    """The country code stays, which the first separator or the third digit ends."""
    country = F.regexp_extract(item, r"^\+[0-9]{1,3}", 0)
    rest = F.substr(item, F.length(country) + 1)
    digits = F.regexp_replace(rest, "[^0-9]", "")
    valid = F.length(F.regexp_replace(item, "[^0-9]", "")).between(8, 15)
    return F.when(valid, F.concat(country, _refill(rest, permute_string(digits, 10, key, "phone"), "[0-9]")))


def _social(item: Column, key: str) -> Column:
    """Area, group and serial number, permuted by their ranks among the valid values."""
    digits = F.regexp_replace(item, "-", "")
    valid = ~item.rlike("^(?:000|666|9)|-00-|-0000$")
    # 898 valid areas, and 99 groups of 9999 serials in each.
    area = F.substring(digits, 1, 3).cast("long")
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    low = (F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1
    ends = feistel(rank, low, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, F.lit("social"))
    new_area = ends["a"] + 1 + F.when(ends["a"] + 1 >= 666, 1).otherwise(0)
    text = F.format_string(
        "%03d-%02d-%04d", new_area, F.floor(ends["b"] / 9999) + 1, ends["b"] % 9999 + 1
    )
    return F.when(valid, text)


def _address(item: Column, key: str) -> Column:
    parts = F.split(item, r"\.")
    octet = [parts[k].cast("long") for k in range(4)]
    valid = reduce(Column.__and__, [(o <= 255) & (parts[k] == o.cast("string")) for k, o in enumerate(octet)])
    half = F.lit(65536).cast("long")
    ends = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], half, half, key, F.lit("address"))
    text = F.concat_ws(
        ".",
        *[f(ends[e]).cast("string") for e in ("a", "b") for f in (lambda x: F.shiftright(x, 8), lambda x: x.bitwiseAND(255))],
    )
    return F.when(valid, text)


def _date(item: Column, key: str) -> Column:
    sign = F.regexp_extract(item, "[-/.]", 0)
    day = F.coalesce(
        *[F.when(sign == s, F.try_to_timestamp(item, F.lit(form)).cast("date")) for s, form in DATE_FORMS.items()]
    )
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    days = DAY_ROWS * DAY_COLUMNS
    ends = feistel(
        F.floor(number / DAY_COLUMNS), number % DAY_COLUMNS, F.lit(DAY_ROWS).cast("long"), F.lit(DAY_COLUMNS).cast("long"), key, F.lit("date")
    )
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (ends["a"] * DAY_COLUMNS + ends["b"]).cast("int"))
    text = F.coalesce(*[F.when(sign == s, F.date_format(new, form)) for s, form in DATE_FORMS.items()])
    return F.when((number >= 0) & (number < days), text)


def _mail(item: Column, key: str) -> Column:
    """Letters and digits of the local part, in lower case; its signs and the domain stay."""
    local = F.lower(F.regexp_extract(item, "^[^@]+", 0))
    symbols = permute_string(F.regexp_replace(local, "[^0-9a-z]", ""), 36, key, "mail")
    return F.concat(_refill(local, symbols, "[0-9a-z]"), F.substr(item, F.length(local) + 1))


MAKERS = {"date": _date, "social": _social, "address": _address, "phone": _phone, "card": _card, "mail": _mail}


def pseudonymise_item(item: Column, key: str) -> Column:
    """The pseudonym of one found item, or null if it fails its check."""
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, pattern in KINDS.items():
        choice = choice.when(item.rlike(f"^(?:{pattern})$"), MAKERS[kind](item, key))
    return choice


def pseudonymise(df: DataFrame, text: str = "text", key: str = "pseudonym-key", changed: str = "n_changed") -> DataFrame:
    """``df`` with its texts rewritten, and the number of items that were replaced.

    One projection, no shuffle: the text is cut at the items, and joined again with their pseudonyms.
    """
    mails = F.col(text).contains("@")
    items = (
        F.when(mails, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
        .when(F.col(text).rlike("[0-9]"), F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)))
        .when(F.col(text).isNotNull(), F.array().cast("array<string>"))
    )
    found_items = free_name(df, "_items")
    new = F.transform(found_items, lambda m: F.struct(pseudonymise_item(m, key).alias("new"), m.alias("old")))
    found = df.withColumn(found_items, items).withColumn(found_items, new)
    gaps = F.when(mails, F.split(text, ANY, -1)).otherwise(F.split(text, NUMBERS, -1))
    fills = F.transform(found_items, lambda m: F.coalesce(m["new"], m["old"]))
    joined = F.array_join(
        F.flatten(
            F.zip_with(
                gaps, F.array_append(fills, F.lit("")), lambda gap, fill: F.array(gap, fill)
            )
        ),
        "",
    )
    count = F.coalesce(F.size(F.filter(found_items, lambda m: m["new"].isNotNull())), F.lit(0))
    return found.withColumn(changed, F.when(F.col(found_items).isNull(), 0).otherwise(count)).withColumn(
        text, F.when(F.size(found_items) > 0, joined).otherwise(F.col(text))
    ).drop(found_items)
