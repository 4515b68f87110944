"""Format-preserving pseudonyms for personal data and secrets.

Found values are validated (check digits, calendar, ranges) and permuted within their own format by a keyed Feistel
network: the same value gets the same pseudonym in each document, two values never get the same one, and whoever holds
the key can undo it. Punctuation, letter case, country and issuer prefixes of the format stay.

All of it is DataFrame expressions on one row at a time: no shuffle, no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import let

ROUNDS = 8
#: 400 Gregorian years have this many days; both factors make up the Feistel network of dates.
CYCLE, DAYS_A, DAYS_B = 146_097, 189, 773
EPOCH = "1700-01-01"
#: Valid social security numbers: areas 001 to 899 without 666 by groups 01 to 99, and serials 0001 to 9999.
SSN_A, SSN_B = 898 * 99, 9999

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds in the order in which they are tried at a place. Java patterns.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "access_key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex_secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "secret": r"(?<=[=: \"'])(?<=(?i:password|passwd|secret|token|api_key|apikey)[=: \"']{1,4})[^\s\"',;]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![./-]?\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ -]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![.-]?\d)",
}
ANY = "|".join(PATTERNS.values())
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, lands in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in lands.split()
}
#: Most steps of the walk in ``_walked``; a step ends it with more than even chance.
STEPS = 64
#: What a text must have at least for a value of any kind.
HINT = r"\d|@|(?i:password|passwd|secret|token|api_?key)"


def _int(x: Column) -> Column:
    return x.cast("int")


def _digest(key: str, kind: Column, step: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, step.cast("string"), half), 256)


def _rounds(start: Column, step: Callable[[Column, Column], Column], inverse: bool) -> Column:
    """``step`` for each round, as a fold: rounds nested in each other would be too deep for the analyzer."""
    order = reversed(range(ROUNDS)) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(k) for k in order]), start, step)


def _number(digest: Column, at: Column | int = 1, digits: int = 7) -> Column:
    return F.conv(F.substring(digest, at, digits) if isinstance(at, int) else F.substr(digest, at, F.lit(digits)), 16, 10).cast("long")


def _chars(v: Column) -> Column:
    return F.split(v, "")


HEX = "0123456789abcdef"


def permute_chars(v: Column, key: str, kind: Column, inverse: bool = False) -> Column:
    """Feistel over the characters: a digit stays a digit, a lower-case letter lower case, an upper-case one upper case,
    and in a hexadecimal secret all of them hexadecimal. In each step one half is shifted by a keyed hash of the other."""

    def classed(hexa: Column) -> Column:
        digit, low, up = (lambda c: c.between("0", "9")), (lambda c: c.between("a", "z")), (lambda c: c.between("A", "Z"))
        base = lambda c: F.when(digit(c), 48).when(low(c), 97).when(up(c), 65)
        radix = lambda c: F.when(hexa & (digit(c) | low(c)), 16).when(digit(c), 10).when(low(c) | up(c), 26).otherwise(1)
        value = lambda c: F.when(hexa & low(c), F.ascii(c) - 87).otherwise(F.coalesce(F.ascii(c) - base(c), F.lit(0)))

        def back(c: Column, x: Column) -> Column:
            return F.when(hexa & (digit(c) | low(c)), F.substr(F.lit(HEX), x + 1, F.lit(1))).otherwise(F.coalesce(F.char(x + base(c)), c))

        def one_step(r: Column):
            def step(s: Column, k: Column) -> Column:
                half, even = _int(F.floor(F.size(s) / 2)), k % 2 == 0
                other = F.when(even, F.slice(s, half + 1, F.size(s) - half)).otherwise(F.slice(s, F.lit(1), half))

                def shifted(d: Column) -> Column:
                    def one(x: Column, i: Column) -> Column:
                        by = _int(_number(d, (i % 32) * 2 + 1, 2))
                        moved = F.pmod(x - by if inverse else x + by, F.get(r, i))
                        return F.when((i < half) == even, moved).otherwise(x)

                    return F.transform(s, one)

                return let(_digest(key, kind, k, F.array_join(other, ",")), shifted)

            return step

        def run(chars: Column) -> Column:
            def rounds(r: Column) -> Column:
                s = _rounds(F.transform(chars, value), one_step(r), inverse)
                return F.array_join(F.zip_with(chars, s, back), "")

            return let(F.transform(chars, radix), rounds)

        return let(_chars(v), run)

    return F.when(F.length(v) > 0, let(kind == "hex_secret", classed)).otherwise(v)


def _two_halves(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: Column, inverse: bool) -> Column:
    """Feistel on a pair of numbers below ``size_a`` and ``size_b``; a struct of both."""

    def step(x: Column, k: Column) -> Column:
        def moved(own: str, other: str, size: Column) -> Column:
            by = _number(_digest(key, kind, k, x[other].cast("string")))
            return F.pmod(x[own] - by if inverse else x[own] + by, size).cast("long")

        first = F.struct(moved("a", "b", size_a).alias("a"), x["b"].alias("b"))
        return F.when(k % 2 == 0, first).otherwise(F.struct(x["a"].alias("a"), moved("b", "a", size_b).alias("b")))

    return _rounds(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step, inverse)


def _into(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""
    at = lambda i: F.length(F.regexp_replace(F.substr(template, F.lit(1), i), r"\D", ""))
    one = lambda i: F.when(F.substr(template, i, F.lit(1)).rlike(r"\d"), F.substr(digits, at(i), F.lit(1))).otherwise(F.substr(template, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), one), "")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _mod97(rearranged: Column) -> Column:
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(rearranged), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97)


def _iban_valid(v: Column) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    return _mod97(F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))) == 1


def _iban(v: Column, account: Column) -> Column:
    """The format of ``v`` with another account and its check digits."""
    land = F.substring(v, 1, 2)

    def assemble(account: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")
        new = F.concat(land, check, account)
        place = lambda i: F.length(F.replace(F.substr(v, F.lit(1), i), F.lit(" "), F.lit("")))
        one = lambda i: F.when(F.substr(v, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(new, place(i), F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), one), "")

    return let(account, assemble)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; places from the right with this parity (0: the last one) are doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _int(F.substr(digits, n - i, F.lit(1)))
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(v: Column, account: Column) -> Column:
    """The format of ``v`` with another account and its check digit."""
    checked = let(account, lambda a: F.concat(a, F.pmod(-_luhn_sum(a, 0), F.lit(10)).cast("string")))
    return let(checked, lambda c: _into(v, c))


def _parsed(v: Column) -> Column:
    iso = F.when(v.rlike(r"^\d{4}-"), v).otherwise(F.concat(F.substring(v, 7, 4), F.lit("-"), F.substring(v, 4, 2), F.lit("-"), F.substring(v, 1, 2)))
    return F.try_to_date(iso, "yyyy-MM-dd")


def _day(v: Column) -> Column:
    return F.datediff(_parsed(v), F.lit(EPOCH).cast("date"))


def _date(v: Column, x: Column) -> Column:
    """The day with these halves, in the 400-year cycle and the format of ``v``."""
    day = F.date_add(F.lit(EPOCH).cast("date"), _int(F.floor(_day(v) / CYCLE) * CYCLE + x["a"] * DAYS_B + x["b"]))

    def shown(d: Column) -> Column:
        other = F.concat(F.date_format(d, "dd"), F.substring(v, 3, 1), F.date_format(d, "MM"), F.substring(v, 6, 1), F.date_format(d, "yyyy"))
        return F.when(v.rlike(r"^\d{4}-"), F.date_format(d, "yyyy-MM-dd")).otherwise(other)

    return let(day, shown)


def _octet(v: Column, i: int) -> Column:
    return F.get(F.split(v, r"\."), F.lit(i)).cast("long")


def _ip(x: Column) -> Column:
    return F.concat_ws(".", *[y.cast("string") for h in ("a", "b") for y in (F.floor(x[h] / 256), x[h] % 256)])


def _ssn_halves(v: Column) -> tuple[Column, Column]:
    area, group, serial = (_int(F.substring(v, at, n)) for at, n in ((1, 3), (5, 2), (8, 4)))
    return (F.when(area < 666, area - 1).otherwise(area - 2)) * 99 + group - 1, serial - 1


def _ssn(x: Column) -> Column:
    area = F.floor(x["a"] / 99) + 1
    parts = F.when(area < 666, area).otherwise(area + 1), x["a"] % 99 + 1, x["b"] + 1
    return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4))])


def _prefix(v: Column) -> Column:
    """The country code of a telephone number, with its plus sign."""
    return F.regexp_extract(v, r"^(?:\+\d{1,3}(?=[ .(-])|\+\d)?", 0)


def _alone() -> dict[str, str]:
    """Patterns of the value alone: what must come before and after it has been seen in the text."""
    return {k: "^(?:" + _bare(p) + ")$" for k, p in PATTERNS.items()}


def kind_of(v: Column) -> Column:
    """The kind of a found value, null where its check digits, ranges or calendar do not hold."""
    n = F.length(_digits(v))
    checks: dict[str, Callable[[Column], Column]] = {
        "iban": _iban_valid,
        "date": lambda v: _parsed(v).isNotNull(),
        "phone": lambda v: n.between(7, 15),
        "ssn": lambda v: ~v.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "card": lambda v: _luhn_sum(_digits(v), 1) % 10 == 0,
    }
    alone = _alone()
    named = alone.pop("secret")
    out = None
    for kind, whole in alone.items():
        valid = v.rlike(whole) & checks[kind](v) if kind in checks else v.rlike(whole)
        out = F.when(valid, kind) if out is None else out.when(valid, kind)
    return out.when(v.rlike(named) & ~v.rlike("|".join(alone.values())), "secret")


def _bare(pattern: str) -> str:
    """The pattern without the look-arounds at its ends."""
    import re

    return re.sub(r"\(\?(?:<[!=]|!)(?:[^()\[\]]|\[[^\]]*\]|\([^()]*\))*\)(?:\{\d+,\d+\})?", "", pattern)


def pseudonym(v: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one value; with ``inverse`` the value of a pseudonym. Unknown kinds stay as they are."""
    flat = F.replace(v, F.lit(" "), F.lit(""))
    rest = F.substr(v, F.length(_prefix(v)) + 1, F.length(v))
    at = F.instr(v, "@")
    moved = (
        F.when(kind == "email", F.substr(v, F.lit(1), at - 1))
        .when(kind == "access_key", F.substr(v, F.lit(5), F.length(v)))
        .when(kind == "iban", F.substr(flat, F.lit(5), F.length(flat)))
        .when(kind == "phone", _digits(rest))
        .when(kind == "card", F.substr(_digits(v), F.lit(1), F.length(_digits(v)) - 1))
        .otherwise(v)
    )

    def assembled(p: Column) -> Column:
        return (
            F.when(kind == "email", F.concat(p, F.substr(v, at, F.length(v))))
            .when(kind == "access_key", F.concat(F.substring(v, 1, 4), p))
            .when(kind == "iban", _iban(v, p))
            .when(kind == "phone", F.concat(_prefix(v), _into(rest, p)))
            .when(kind == "card", _card(v, p))
            .otherwise(p)
        )

    is_ip = kind == "ip"
    day = F.pmod(_day(v), F.lit(CYCLE))
    is_ssn = kind == "ssn"
    a = F.when(is_ip, _octet(v, 0) * 256 + _octet(v, 1)).when(is_ssn, _ssn_halves(v)[0]).otherwise(F.floor(day / DAYS_B))
    b = F.when(is_ip, _octet(v, 2) * 256 + _octet(v, 3)).when(is_ssn, _ssn_halves(v)[1]).otherwise(day % DAYS_B)
    sizes = [F.when(is_ip, 65536).when(is_ssn, m).otherwise(n) for m, n in ((SSN_A, DAYS_A), (SSN_B, DAYS_B))]
    shown = lambda x: F.when(is_ip, _ip(x)).when(is_ssn, _ssn(x)).otherwise(_date(v, x))
    numbers = let(_two_halves(a, b, *sizes, key, kind, inverse), shown)
    chars = let(let(moved, lambda m: permute_chars(m, key, kind, inverse)), assembled)
    return F.when(kind.isNull(), v).when(kind.isin("ip", "date", "ssn"), numbers).otherwise(chars)


def _span(v: Column) -> Column:
    """(kind, size) of the value within a match: all of it, or else the longest valid beginning of a card or an IBAN that ends
    before a space or hyphen (a month, a security code or a currency stands behind it). Kind null: no value."""
    alone = _alone()

    def beginnings(size: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
        ends = F.filter(F.sequence(F.length(v) - 1, F.lit(1), F.lit(-1)), lambda i: F.substr(v, i + 1, F.lit(1)).isin(" ", "-"))
        return F.filter(ends, lambda i: let(F.substr(v, F.lit(1), i), lambda x: F.when(size(x), valid(x)).otherwise(False)))

    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    card = beginnings(lambda x: F.length(_digits(x)).between(13, 19), lambda x: _luhn_sum(_digits(x), 1) % 10 == 0)
    iban = beginnings(lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))) == F.try_element_at(lengths, F.substring(v, 1, 2)), _iban_valid)
    span = lambda kind, size: F.struct(F.lit(kind).cast("string").alias("kind") if not isinstance(kind, Column) else kind.alias("kind"), size.alias("size"))
    nothing = span(None, F.lit(0))

    def first(kind: str, found: Column) -> Column:
        return let(found, lambda x: F.when(F.size(x) > 0, span(kind, F.get(x, F.lit(0)))).otherwise(nothing))

    cut = F.when(v.rlike(alone["card"]), first("card", card)).when(v.rlike(alone["iban"]), first("iban", iban)).otherwise(nothing)
    return let(kind_of(v), lambda k: F.when(k.isNotNull(), span(k, F.length(v))).otherwise(cut))


def _walked(v: Column, span: Column, key: str, inverse: bool) -> Column:
    """The match with the pseudonym of its value.

    A pseudonym may make a longer beginning valid by chance, and then could not be undone. So the value is permuted again
    until the match has the same span as before, which is a permutation of the matches with that span.
    """

    def permuted(x: Column) -> Column:
        return F.concat(pseudonym(F.substr(x, F.lit(1), span["size"]), span["kind"], key, inverse), F.substr(x, span["size"] + 1, F.length(x)))

    def step(state: Column, _: Column) -> Column:
        moved = lambda y: F.struct(y.alias("v"), (_span(y) == span).alias("done"))
        return F.when(state["done"], state).otherwise(let(permuted(state["v"]), moved))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(v.alias("v"), F.lit(False).alias("done")), step, lambda s: s["v"])
    return F.when(span["size"] < F.length(v), walk).otherwise(pseudonym(v, span["kind"], key, inverse))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False, count_col: str | None = None) -> DataFrame:
    """All rows and columns, with the values in ``text_col`` replaced; ``count_col`` gets how many were.

    Without a key, pseudonyms can be undone by anyone: ``key`` is a secret of the caller. Null texts stay null, empty ones empty, texts without values unchanged; rows that
    repeat get equal results. Values that fail validation (a wrong check digit, 31 February) are no personal data and stay.
    A column named like ``count_col`` is replaced.
    """
    text = F.col(text_col)

    found, spans, new = "__found", "__spans", "__new"
    # One column after the other: the analyzer goes through nested lambdas level by level.
    out = docs.withColumn(found, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    out = out.withColumn(spans, F.transform(found, _span))
    value = lambda v, s: F.when(s["kind"].isNull(), v).otherwise(_walked(v, s, key, inverse))
    out = out.withColumn(new, F.zip_with(found, spans, value))
    parts = F.transform(F.split(text, ANY, -1), lambda p, i: F.concat(p, F.coalesce(F.get(F.col(new), i), F.lit(""))))
    columns = {text_col: F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)}
    if count_col:
        columns[count_col] = F.coalesce(F.size(F.filter(spans, lambda s: s["kind"].isNotNull())), F.lit(0))
        columns[count_col] = F.when(F.size(found) > 0, columns[count_col]).otherwise(0)
    return out.withColumns(columns).drop(found, spans, new)
