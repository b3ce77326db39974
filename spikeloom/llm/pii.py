"""Personal data: validated values are replaced by keyed permutations within their own format.

Everything here is DataFrame functions.  A value is a string of symbols; each digit, lower-case and
upper-case letter is permuted within its class by a Feistel network over symbol vectors, so length,
punctuation and class stay, and equal values get equal pseudonyms in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: What is looked for.  Dates come before addresses and plain numbers.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
DATE = r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d]|[.\-/]\d)"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\d.\-])(?:\d[ -]?){12,18}\d(?![\d]|[.\-]\d)"
#: Digits of a card by issuer: Visa, Mastercard (twice), American Express, Diners, Discover, JCB, UnionPay, Maestro.
ISSUERS = "|".join([
    r"4\d{12}(?:\d{3}){0,2}", r"5[1-5]\d{14}", r"2[2-7]\d{14}", r"3[47]\d{13}", r"3[0689]\d{12}", r"6(?:011|4[4-9]\d|5\d\d)\d{12,15}",
    r"35(?:2[89]|[3-8]\d)\d{12,15}", r"62\d{14,17}", r"(?:50|5[6-8]|6[0137])\d{11,17}",
])
SECRET = r"(?<![A-Za-z0-9])(?=[A-Fa-f0-9]*\d)(?:[a-f0-9]{32,128}|[A-F0-9]{32,128})(?![A-Za-z0-9])"
ANY = "|".join([EMAIL, DATE, ACCOUNT, SOCIAL, PHONE, ADDRESS, SECRET, CARD])
#: Every match of ANY has a match of this: an e-mail its @, a secret its hexadecimal run, and all others two digits at most one sign apart.
MAYBE = r"@|\d[ .-]?\d|[A-Fa-f0-9]{32}"
#: The 400 years within which dates are permuted, 189 x 773 days.
FIRST_DAY, HALF_DAYS = "1800-01-01", (189, 773)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _whole(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second from the right doubled; a valid number's is a multiple of ten."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    term = lambda i: F.when((n - i) % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda t, i: t + term(i))


def _mod97(account: Column) -> Column:
    """Account number, first four signs last and letters as 10 to 35, modulo 97; a valid one's is 1."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda t, c: F.when(value(c) > 9, (t * 100 + value(c)) % 97).otherwise((t * 10 + value(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def permuted(value: Column, key: str, tweak: Column) -> Column:
    """The value with its letters and digits permuted: a Feistel network of ``ROUNDS`` rounds.

    The signs are cut into two halves.  In each round the signs of one half move on within their
    class (10 digits, 26 letters) by numbers hashed from the key, the tweak, the round and the
    other half; taking the same numbers off again undoes it, so different values stay different.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, F.length(value))

    def moved(part: Column, other: Column, turn: Column) -> Column:
        drawn = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), other), 512)

        def sign(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(drawn, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            within = lambda first, size: F.char(F.lit(first) + (code - first + by) % size)
            return (
                F.when(code.between(48, 57), within(48, 10))
                .when(code.between(97, 122), within(97, 26))
                .when(code.between(65, 90), within(65, 26))
                .otherwise(c)
            )

        return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.split(part, ""), sign), ""))

    state = F.struct(left.alias("l"), right.alias("r"))
    turned = lambda s, i: F.struct(
        F.when(i % 2 == 0, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, moved(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turned, lambda s: F.concat(s["l"], s["r"]))


def _refilled(value: Column, digits: Column) -> Column:
    """The value with its digits, in order, replaced by those given."""
    step = lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["t"], F.substring(digits, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i")))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])


def _kind(v: Column) -> Column:
    """Kind of a validated value, null if it only looks like one."""
    d = _digits(v)
    parts = F.split(v, r"\.")
    return (
        F.when(_whole(v, EMAIL), "email")
        .when(_whole(v, DATE) & _date(v).isNotNull(), "date")
        .when(_whole(v, ADDRESS), F.when(F.forall(parts, lambda x: x.cast("int") <= 255), "address"))
        .when(_whole(v, ACCOUNT) & (F.when(_whole(v, ACCOUNT), _mod97(v)) == 1), "account")
        .when(_whole(v, SOCIAL) & ~d.rlike("^(?:000|666|9..|...00)") & ~d.rlike("0000$"), "social")
        .when(_whole(v, SECRET) & ~v.rlike(r"^\d+$"), "secret")
        .when(_whole(v, CARD) & d.rlike(f"^(?:{ISSUERS})$") & (_luhn(d) % 10 == 0), "card")
        .when(_whole(v, PHONE) & F.length(d).between(8, 15), "phone")
    )


def _date(v: Column) -> Column:
    """The day a date value names, if it lies within the permuted years."""
    day = F.coalesce(
        F.try_to_date(F.when(v.rlike("^....-"), v), "yyyy-MM-dd"), F.try_to_date(F.when(v.rlike("^../"), v), "dd/MM/yyyy"),
        F.try_to_date(F.when(v.rlike("^../"), v), "MM/dd/yyyy"), F.try_to_date(F.when(v.rlike(r"^..\."), v), "dd.MM.yyyy"),
    )
    n = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when(n.between(0, HALF_DAYS[0] * HALF_DAYS[1] - 1), n)


def _moved_date(v: Column, key: str) -> Column:
    """Feistel network on (day div 773, day mod 773), both halves moved by hashed numbers in turn."""
    a, b = HALF_DAYS
    drawn = lambda other, turn: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("date"), turn.cast("string"), other.cast("string")), 256), 1, 8), 16, 10).cast("long")
    n = _date(v).cast("long")
    state = F.struct(F.floor(n / b).alias("l"), (n % b).alias("r"))
    turned = lambda s, i: F.struct(
        F.when(i % 2 == 0, (s["l"] + drawn(s["r"], i)) % a).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, (s["r"] + drawn(s["l"], i)) % b).otherwise(s["r"]).alias("r"),
    )
    n = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turned, lambda s: s["l"] * b + s["r"])
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    shown = F.when(v.rlike("^....-"), F.date_format(day, "yyyy-MM-dd")).when(v.rlike(r"^..\."), F.date_format(day, "dd.MM.yyyy"))
    month_first = F.try_to_date(v, "dd/MM/yyyy").isNull()
    return shown.otherwise(F.when(month_first, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy")))


def pseudonym(value: Column, key: str) -> Column:
    """The value's pseudonym, or the value itself where it isn't valid."""

    def card(v: Column) -> Column:
        d = _digits(v)
        n = F.length(d)
        kept = F.when(d.startswith("4"), 1).otherwise(4)
        body = F.concat(F.substring(d, F.lit(1), kept), permuted(F.substring(d, kept + 1, n - kept - 1), key, F.concat(F.lit("card"), F.substring(d, F.lit(1), kept))))
        check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
        return _refilled(v, F.concat(body, check.cast("string")))

    def address(v: Column) -> Column:
        p = F.split(v, r"\.")
        pair = lambda i: p[i].cast("int") * 256 + p[i + 1].cast("int")
        drawn = lambda other, turn: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("address"), turn.cast("string"), other.cast("string")), 256), 1, 4), 16, 10).cast("int")
        turned = lambda s, i: F.struct(
            F.when(i % 2 == 0, (s["l"] + drawn(s["r"], i)) % 65536).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, (s["r"] + drawn(s["l"], i)) % 65536).otherwise(s["r"]).alias("r"),
        )
        both = lambda n: F.concat_ws(".", F.shiftright(n, 8).cast("string"), (n % 256).cast("string"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(pair(0).alias("l"), pair(2).alias("r")), turned, lambda s: F.concat_ws(".", both(s["l"]), both(s["r"])))

    def account(v: Column) -> Column:
        plain = F.regexp_replace(v, " ", "")
        body = permuted(F.substring(plain, F.lit(5), F.length(plain)), key, F.concat(F.lit("account"), F.substring(plain, 1, 2)))
        open_ = F.concat(F.substring(plain, 1, 2), F.lit("00"), body)
        made = F.concat(F.substring(plain, 1, 2), F.lpad((98 - _mod97(open_)).cast("string"), 2, "0"), body)
        step = lambda s, c: F.when(c == " ", F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i"))).otherwise(
            F.struct(F.concat(s["t"], F.substring(made, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))
        )
        return F.aggregate(F.split(v, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])

    def secret(v: Column) -> Column:
        # Sixteen signs a digit: permuted as a run of letters a to p, so the result stays hexadecimal.
        low = F.translate(F.lower(v), "0123456789abcdef", "abcdefghijklmnop")
        half = F.floor(F.length(low) / 2).cast("int")

        def moved(part: Column, other: Column, turn: Column) -> Column:
            drawn = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), turn.cast("string"), other), 512)
            sign = lambda c, i: F.char(F.lit(97) + (F.ascii(c) - 97 + F.conv(F.substring(drawn, i % 128 + 1, F.lit(1)), 16, 10).cast("int")) % 16)
            return F.array_join(F.transform(F.split(part, ""), sign), "")

        turned = lambda s, i: F.struct(
            F.when(i % 2 == 0, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, moved(s["r"], s["l"], i)).otherwise(s["r"]).alias("r"),
        )
        state = F.struct(F.substring(low, F.lit(1), half).alias("l"), F.substring(low, half + 1, F.length(low)).alias("r"))
        made = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turned, lambda s: F.concat(s["l"], s["r"]))
        made = F.translate(made, "abcdefghijklmnop", "0123456789abcdef")
        return F.when(v.rlike("[A-F]"), F.upper(made)).otherwise(made)

    at = F.instr(value, "@")
    plus = F.when(value.startswith("+"), F.length(F.regexp_extract(value, r"^\+(\d{1,3})", 1))).otherwise(0)
    d = _digits(value)
    phone = _refilled(value, F.concat(F.substring(d, F.lit(1), plus), permuted(F.substring(d, plus + 1, F.length(d)), key, F.concat(F.lit("phone"), F.substring(d, F.lit(1), plus)))))
    email = F.concat(permuted(F.substring(value, F.lit(1), at - 1), key, F.substring(value, at, F.length(value))), F.substring(value, at, F.length(value)))
    kind = _kind(value)
    return (
        F.when(kind == "email", email).when(kind == "date", _moved_date(value, key)).when(kind == "address", address(value))
        .when(kind == "account", account(value)).when(kind == "social", _refilled(value, permuted(d, key, F.lit("social"))))
        .when(kind == "secret", secret(value)).when(kind == "card", card(value)).when(kind == "phone", phone).otherwise(value)
    )


def pseudonymised(documents: DataFrame, key: str = "demonstration key", text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """``documents`` with personal data in ``text`` replaced, and ``count``, the number of values that changed, unless it is None.

    E-mail addresses, dates of 1800 to 2199, network addresses, account numbers (modulo 97), social
    numbers, cards (13 to 19 digits, Luhn and a prefix of ISSUERS), telephone numbers and hexadecimal secrets are permuted within
    their format; what fails its check stays.  The text is cut at the values found and joined again,
    so all else is untouched.  Null and empty texts stay as they are, with 0.  Other columns pass; a column named as ``count`` is replaced.
    """
    has = F.col(text).rlike(MAYBE)
    found = F.when(has, F.regexp_extract_all(F.col(text), F.lit(f"({ANY})"), F.lit(1)))
    out = documents.withColumn("_pii_found", found)
    out = out.withColumn("_pii_made", F.when(F.size("_pii_found") > 0, F.transform("_pii_found", lambda v: pseudonym(v, key))))
    changed = F.size(F.filter(F.zip_with("_pii_found", "_pii_made", lambda a, b: a != b), lambda x: x))
    gaps = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(gaps, "_pii_made", lambda gap, v: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(v, F.lit("")))), "")
    if count is not None:
        out = out.withColumn(count, F.when(F.col("_pii_made").isNull(), 0).otherwise(changed).cast("long"))
    return out.withColumn(text, F.when(F.col("_pii_made").isNull(), F.col(text)).otherwise(joined)).drop("_pii_found", "_pii_made")
