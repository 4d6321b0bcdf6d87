"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A value is found by its pattern, validated, and permuted within its own format by a keyed
Feistel network on two halves (Z_a x Z_b, additions alternating).  The network is a
permutation of the format's values, so equal values get equal pseudonyms in every document
and different values stay different.  Card and account numbers keep valid check digits, dates
stay dates, and numbers whose check digits are wrong stay as they are.  Mail addresses and
secrets have no numeric domain and get keyed digests.  Who knows the key can reverse the
permutations, so it comes from the session's settings and none is built in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The session setting that holds the key.
KEY_SETTING = "spark.quarry.pii.key"

# Patterns of what is looked for, in the order in which they are tried.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+"
SECRET = (
    r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}"
    r"|gh[pousr]_[0-9A-Za-z]{20,}+|sk-[0-9A-Za-z_-]{20,}+|xox[abprs]-[0-9A-Za-z-]{11,}+)(?![0-9A-Za-z])"
)
ASSIGNED = r"(?<![0-9A-Za-z])(?i:password|passwd|secret|token|api[_-]?key)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?(?=[A-Za-z_+/.~-]*[0-9])[0-9A-Za-z_+/.~-]{8,}+"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
DATE_ISO = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
DATE_DMY = r"(?<![\d./])\d{2}[./]\d{2}[./]\d{4}(?![\d/])"
PHONE = r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?![\d-])|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
#: Every value has a digit, an at sign or a run of 16 such characters (a secret without digits); texts without need no search.
MAY = r"[0-9@]|[A-Za-z_-]{16}"
ANY = "|".join((EMAIL, ASSIGNED, SECRET, IBAN, DATE_ISO, DATE_DMY, PHONE, SSN, IP, CARD))

#: Country calling codes of one and two digits; all others have three.
_CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Days from 1900-01-01 to 2099-12-31 are 17 x 4297, so the dates are a Feistel domain as they are.
_FIRST_DAY = "1900-01-01"
_DAYS = (17, 4297)


def _digest(key: str, tag: str, *parts: Column) -> Column:
    """A keyed 60-bit number of `parts`."""
    data = F.concat_ws("|", F.lit(key), F.lit(tag), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(data, 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """The permuted halves of (left, right) in Z_a x Z_b, as a struct (l, r)."""

    def step(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]  # noqa: E741
        even = F.struct(F.pmod(l + F.pmod(_digest(key, tag, i, a, b, r), a), a).alias("l"), r.alias("r"))
        odd = F.struct(l.alias("l"), F.pmod(r + F.pmod(_digest(key, tag, i, a, b, l), b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A digit string of the same length, permuted among the strings of that length."""

    def power(n: Column) -> Column:
        return F.pow(F.lit(10.0), n.cast("double")).cast("bigint")

    def permuted(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        left = F.coalesce(F.nullif(F.left(d, half), F.lit("")), F.lit("0"))
        halves = feistel(left, F.substr(d, half + 1), power(half), power(n - half), key, tag)
        return let(
            halves,
            lambda s: F.concat(
                F.when(half > 0, F.lpad(s["l"].cast("string"), half, F.lit("0"))).otherwise(F.lit("")),
                F.lpad(s["r"].cast("string"), n - half, F.lit("0")),
            ),
        )

    return let(digits, permuted)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the right; digits at places of parity `doubled` (0: the last) count double."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _fill(template: Column, digits: Column) -> Column:
    """`template` with its digits replaced, in order, by those of `digits`."""

    def filled(new: Column) -> Column:
        def put(s: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(
                F.concat(s["out"], F.when(is_digit, F.substr(new, s["at"], F.lit(1))).otherwise(c)).alias("out"),
                (s["at"] + is_digit.cast("int")).alias("at"),
            )

        state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(F.split(template, ""), state, put, lambda s: s["out"])

    return let(digits, filled)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _card(value: Column, key: str) -> Column:
    """A number with a valid check digit: the others permuted, the check digit set anew.  Else as it is."""

    def checked(digits: Column) -> Column:
        body = permute_digits(F.left(digits, F.length(digits) - 1), key, "card")
        return let(
            body,
            lambda new: F.concat(new, F.pmod(10 - F.pmod(_luhn_sum(new, 0), F.lit(10)), F.lit(10)).cast("string")),
        )

    def number(digits: Column) -> Column:
        valid = F.pmod(_luhn_sum(digits, 1), F.lit(10)) == 0
        return F.when(valid, _fill(value, checked(digits))).otherwise(value)

    return let(_only_digits(value), number)


def _mod97(characters: Column) -> Column:
    """The remainder by 97 of a string in which letters count from A = 10 to Z = 35."""

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.pmod(F.when(c >= "A", rest * 100 + letter).otherwise(rest * 10 + c.cast("int")), F.lit(97))

    return F.aggregate(F.filter(F.split(characters, ""), lambda c: c != ""), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    """An account number with valid check digits: its digits permuted, the check digits set anew.  Else as it is."""

    def account(plain: Column) -> Column:
        country, rest = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5))
        digits = _only_digits(rest)
        moved = F.when(digits == "", rest).otherwise(_fill(rest, permute_digits(digits, key, "iban")))

        def renewed(new: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            # The value's own spaces are kept: each of its characters in turn takes the next new one.
            return _place(value, F.concat(country, check, new))

        return F.when(_mod97(F.concat(rest, F.left(plain, F.lit(4)))) == 1, let(moved, renewed)).otherwise(value)

    return let(F.replace(value, F.lit(" "), F.lit("")), account)


def _place(template: Column, characters: Column) -> Column:
    """`template` with its characters other than spaces replaced, in order, by `characters`."""

    def put(s: Column, c: Column) -> Column:
        kept = c == " "
        return F.struct(
            F.concat(s["out"], F.when(kept, c).otherwise(F.substr(characters, s["at"], F.lit(1)))).alias("out"),
            (s["at"] + (~kept).cast("int")).alias("at"),
        )

    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.filter(F.split(template, ""), lambda c: c != ""), state, put, lambda s: s["out"])


def _phone(value: Column, key: str) -> Column:
    """Country code kept, all further digits permuted; fewer than 7 or over 15 digits are no number."""
    code = F.when(value.startswith("+"), F.length(F.regexp_extract(value, _CALLING, 1))).otherwise(0)

    def number(digits: Column) -> Column:
        new = F.concat(F.left(digits, code), permute_digits(F.substr(digits, code + 1), key, "phone"))
        return F.when(F.length(digits).between(7, 15), _fill(value, new)).otherwise(value)

    return let(_only_digits(value), number)


def _ip(value: Column, key: str) -> Column:
    """Four octets, permuted as two halves of 16 bits; an octet over 255 makes it no address."""
    side = F.lit(1 << 16).cast("bigint")

    def address(octets: Column) -> Column:
        halves = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], side, side, key, "ip")
        new = let(
            halves,
            lambda s: F.concat_ws(
                ".",
                *[
                    x.cast("bigint").cast("string")
                    for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)
                ],
            ),
        )
        return F.when(F.array_max(octets) <= 255, new).otherwise(value)

    return let(F.split(value, r"\.").cast("array<int>"), address)


def _date(value: Column, shape: str, key: str) -> Column:
    """A date between 1900 and 2099, permuted among these; another value stays."""
    start = F.lit(_FIRST_DAY).cast("date")
    a, b = (F.lit(x).cast("bigint") for x in _DAYS)

    def day(n: Column) -> Column:
        new = let(
            feistel(F.floor(n / _DAYS[1]), F.pmod(n, F.lit(_DAYS[1])), a, b, key, "date"),
            lambda s: F.date_format(F.date_add(start, (s["l"] * _DAYS[1] + s["r"]).cast("int")), shape),
        )
        new = F.when(F.instr(value, "/") > 0, F.replace(new, F.lit("."), F.lit("/"))).otherwise(new)
        return F.when(n.between(0, _DAYS[0] * _DAYS[1] - 1), new).otherwise(value)

    return let(F.datediff(F.try_to_date(F.replace(value, F.lit("/"), F.lit(".")), shape), start), day)


def _email(value: Column, key: str) -> Column:
    """A keyed name at a reserved domain."""
    return F.concat(F.lit("user"), _digest(key, "email", F.lower(value)).cast("string"), F.lit("@mail.invalid"))


#: What of a secret stays: the mark of its kind, or the name that it is assigned to.
_KEPT = r"^(AKIA|gh[pousr]_|sk-|xox[abprs]-|(?i:password|passwd|secret|token|api[_-]?key)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?)?"


def _secret(value: Column, key: str) -> Column:
    """As many hex digits of keyed digests, in the value's letter case, behind the mark of its kind."""

    def renewed(head: Column) -> Column:
        rest = F.substr(value, F.length(head) + 1)
        blocks = F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.length(rest) - 1) / 64).cast("int")),
                lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), i.cast("string"), rest), 256),
            ),
            "",
        )
        new = F.left(blocks, F.length(rest))
        return F.concat(head, F.when(F.upper(rest) == rest, F.upper(new)).otherwise(new))

    return let(F.regexp_extract(value, _KEPT, 0), renewed)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that fails its validation stays."""

    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    return (
        F.when(whole(ASSIGNED) | whole(SECRET), _secret(value, key))
        .when(F.instr(value, "@") > 0, _email(value, key))
        .when(whole(IBAN), _iban(value, key))
        .when(whole(r"\d{4}-\d{2}-\d{2}"), _date(value, "yyyy-MM-dd", key))
        .when(whole(r"\d{2}[./]\d{2}[./]\d{4}"), _date(value, "dd.MM.yyyy", key))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _fill(value, permute_digits(_only_digits(value), key, "ssn")))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), _ip(value, key))
        .when(whole(r"[+(].*"), _phone(value, key))
        .otherwise(_card(value, key))
    )


def pseudonymise(text: Column, key: str) -> Column:
    """A struct (text with pseudonyms, n values replaced) of a text column; null stays null with 0.

    The expressions hold a digest of the key, so plans and event logs do not tell the key.
    """
    if not key:
        raise ValueError(f"personal data needs a key; set {KEY_SETTING}")
    key = hashlib.sha256(f"{KEY_SETTING}|{key}".encode()).hexdigest()[:32]
    found = F.when(text.rlike(MAY), F.regexp_extract_all(text, F.lit(ANY), 0))

    def joined(values: Column) -> Column:
        pieces = F.zip_with(F.split(text, ANY, -1), values, lambda s, v: F.concat(s, F.coalesce(v["new"], F.lit(""))))
        n = F.size(F.filter(values, lambda v: v["old"] != v["new"])).cast("bigint")
        return F.struct(F.array_join(pieces, "").alias("text"), n.alias("n"))

    def replaced(old: Column) -> Column:
        new = F.transform(old, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
        unchanged = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))
        return F.when(F.size(old) > 0, let(new, joined)).otherwise(unchanged)

    return let(found, replaced)


def session_key(spark: SparkSession) -> str:
    """The key that the session's settings name; none is an error."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        raise ValueError(f"personal data needs a key; set {KEY_SETTING}")
    return key


def redact(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced) for every row of `docs`, personal data replaced by pseudonyms.

    Without `key` the session's setting is taken, and without that the call fails.  A null
    text stays null; a text without personal data is unchanged, an empty table gives an
    empty result.  Repeated rows are treated alike, other columns are ignored.
    """
    key = session_key(docs.sparkSession) if key is None else key
    done = docs.select(F.col(id_col).alias("doc_id"), pseudonymise(F.col(text_col), key).alias("done"))
    return done.select("doc_id", F.col("done.text").alias("text"), F.col("done.n").alias("n_replaced"))
