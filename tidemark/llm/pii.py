"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

E-mail addresses, telephone, card and social security numbers, IP addresses and dates are found
by patterns and validated (Luhn sum, octets, number areas, real calendar dates). Runs of numbers
are cut by their valid values only, so what fails validation hides none of them. A valid value is
split into two halves of its format's domain, and ten Feistel rounds with a keyed SHA-256 permute
the domain: every value has one pseudonym of the same format, different values have different
ones, and equal values stay linked across documents. Check digits are worked out anew. Separators,
country codes and mail domains stay.

The two halves add modulo their own sizes, so a domain of a * b values is permuted exactly,
without walking cycles. DataFrame functions only.

Edge cases: null texts stay null, empty ones empty; values that fail validation stay as they are;
of values that tie for a place the longer kind in the order of ``FIRM`` goes first; texts of any
length are rewritten whole; repeated rows are rewritten alike; an empty table gives an empty result.
All other columns are kept, but for such as are named like the counts, which these replace; the
text column keeps its place.

Whoever knows the key can invert the pseudonyms, so it has no default: keep it as a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _spans

ROUNDS = 10
KINDS = ("email", "date", "ssn", "ip", "card", "phone")

# How each kind is written.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "date": r"(?<![0-9-])(?:1[89]|2[01])\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![0-9-])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "ip": r"(?<![0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?[0-9])",
    "card": r"(?<![0-9+-])\d(?:[ -]?\d){12,18}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![0-9])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
NUMBERS = "|".join(PATTERNS[k] for k in KINDS[1:])
# What stands around a value of each kind, the usual groupings of cards, and the
# patterns whose matches are candidates, the first of two at one place going before.
AROUND = {"date": (r"(?<![0-9-])", r"(?![0-9-])"), "ssn": (r"(?<![0-9-])", r"(?![0-9-])"), "ip": (r"(?<![0-9.])", r"(?!\.?[0-9])"), "card": (r"(?<![0-9+-])", r"(?![0-9-])"), "phone": (r"(?<![0-9A-Za-z])", r"(?![0-9])")}
_USUAL = r"(?<![0-9+-])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}(?:[ -]\d{3}){3}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,3}|\d{6}[ -]\d{13}|\d{13,19})(?![0-9-])"
_USUAL_LONG = r"(?<![0-9+-])\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}(?![0-9-])"
FIRM = [*[(k, PATTERNS[k]) for k in ("date", "ssn", "ip")], ("card", _USUAL), ("card", _USUAL_LONG), ("phone", PATTERNS["phone"])]
#: digits and separators, with a letter before them, which tells that no phone number begins there
RUN = r"[A-Za-z]?[0-9 .()+-]{7,}+"
# Fixed value: days of a 400-year cycle of the calendar, 27 * 5411, from 1800-01-01.
_DAYS, _DAY_HALF = 146097, 27


def _prf(key: str, kind: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits."""
    word = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts], F.lit(key))
    return F.conv(F.substring(F.sha2(word, 256), 1, 15), 16, 10).cast("long")


def permuted(left: Column, right: Column, size_left: Column, size_right: Column, key: str, kind: str, tweak: Column) -> Column:
    """struct<l, r>: the pair permuted within size_left * size_right."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, (s["l"] + _prf(key, kind, tweak, i, s["r"])) % size_left).otherwise(s["l"])
        r = F.when(even, s["r"]).otherwise((s["r"] + _prf(key, kind, tweak, i, s["l"])) % size_right)
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""

    def run(x: Column) -> Column:
        n = F.length(x)
        a = (n / 2).cast("int")
        b = n - a
        p = permuted(F.substr(x, F.lit(1), a).cast("long"), F.substr(x, a + 1).cast("long"), _power(a), _power(b), key, kind, n)
        return _spans.let(p, lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), b, F.lit("0"))))

    return _spans.let(d, run)


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits``, one by one."""

    def fill(d: Column) -> Column:
        start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

        def step(s: Column, c: Column) -> Column:
            digit = c.rlike("[0-9]")
            return F.struct(F.concat(s["o"], F.when(digit, F.substr(d, s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + digit.cast("int")).alias("k"))

        return F.aggregate(F.split(value, ""), start, step, lambda s: s["o"])

    return _spans.let(digits, fill)


def _luhn(d: Column, first: int) -> Column:
    """Luhn sum of the digits from the right; every second one counts double, beginning with the ``first``-th or the next."""

    def add(s: Column, i: Column) -> Column:
        x = F.substr(d, -i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return s + F.when((i + first) % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        body = _permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = _spans.let(body, lambda b: F.concat(b, ((10 - _luhn(b, 1) % 10) % 10).cast("string")))
        return F.when(_luhn(d, 0) % 10 == 0, _refilled(value, whole))

    return _spans.let(_digits(value), run)


def _phone(value: Column, key: str) -> Column:
    """The last ten digits are permuted, the country code stays."""

    def run(d: Column) -> Column:
        head = F.substr(d, F.lit(1), F.length(d) - 10)
        return _refilled(value, F.concat(head, _permuted_digits(F.substr(d, F.length(d) - 9), key, "phone")))

    return _spans.let(_digits(value), run)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.split(value, "-")[i].cast("long") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - F.when(area > 666, 2).otherwise(1)
    p = permuted(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", F.lit(0))

    def written(s: Column) -> Column:
        n = F.floor(s["l"] / 99)
        n = n + F.when(n >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(n.cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _spans.let(p, written))


def _ip(value: Column, key: str) -> Column:
    o = [F.split(value, r"\.")[i].cast("long") for i in range(4)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    p = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip", F.lit(0))
    return F.when(valid, _spans.let(p, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)])))


def _date(value: Column, key: str) -> Column:
    day = value.try_cast("date")
    n = F.datediff(day, F.lit("1800-01-01").cast("date")).cast("long")
    half = _DAYS // _DAY_HALF
    p = permuted(F.floor(n / half), n % half, F.lit(_DAY_HALF), F.lit(half), key, "date", F.lit(0))
    return F.when(n.between(0, _DAYS - 1), _spans.let(p, lambda s: F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), (s["l"] * half + s["r"]).cast("int")), "yyyy-MM-dd")))


def _email(value: Column, key: str) -> Column:
    """Letters and digits of the local part move within their class, keyed by the other half; the domain stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")

    def moved(c: Column, i: Column, word: Column) -> Column:
        """Character c moved by the i-th of the keyed numbers that ``word`` gives."""
        by = F.conv(F.substring(F.sha2(F.concat_ws("|", word, i.cast("string"), F.lit(key)), 256), 1, 8), 16, 10).cast("long")
        out = F.when(F.lit(False), c)
        for letters in classes:
            at = F.instr(F.lit(letters), c)
            out = out.when(at > 0, F.substr(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1)))
        return out.otherwise(c)

    def run(x: Column) -> Column:
        n = F.length(x)
        a = F.floor(n / 2).cast("int")
        start = F.struct(F.substr(x, F.lit(1), a).alias("l"), F.substr(x, a + 1).alias("r"))

        def half(own: Column, other: Column, i: Column) -> Column:
            word = F.concat_ws("|", F.lit(key), F.lit("email"), n.cast("string"), i.cast("string"), other)
            return _spans.let(word, lambda w: F.array_join(F.transform(F.split(own, ""), lambda c, j: moved(c, j, w)), ""))

        def turn(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            return F.struct(F.when(even, half(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(half(s["r"], s["l"], i)).alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    return F.concat(_spans.let(local, run), F.lit("@"), domain)


_HOW = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone}


def _piece(kind: Column, value: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), value.alias("value"))


def _woven(text: Column, pattern: str | Column, found: Column, open_) -> Column:
    """array<struct<kind, value>>: what ``open_`` makes of the pieces of ``text`` between the matches of ``pattern``, and ``found`` (an array of pieces for each match)."""
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda p, v: F.concat(open_(p), F.coalesce(v, none))))


def _plain(text: Column) -> Column:
    return F.array(_piece(F.lit(None), text))


def _loose_cards(text: Column, key: str) -> Column:
    """Cards in other groupings than the usual ones, where no firm value is."""
    values = F.transform(_spans.matches(text, PATTERNS["card"]), lambda v: _spans.let(_card(v, key), lambda w: F.array(_piece(F.when(w.isNotNull(), F.lit("card")), F.coalesce(w, v)))))
    return F.when(text.rlike(PATTERNS["card"]), _woven(text, PATTERNS["card"], values, _plain)).otherwise(_plain(text))


def _numbers(run: Column, key: str) -> Column:
    """Pieces of a run of digits and separators.

    All places where a firm pattern matches are candidates, also within each other; the valid ones
    make the pattern by which the run is cut, so an invalid match hides nothing.
    """

    def valid(kind: str, pattern: str) -> Column:
        values = F.array_distinct(_spans.matches(run, f"(?=({pattern}))", 1))
        before, after = AROUND[kind]
        made = F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), _HOW[kind](v, key).alias("out"), F.concat(F.lit(before + r"\Q"), v, F.lit(r"\E" + after)).alias("rule")))
        none = F.array().cast("array<struct<kind:string,value:string,out:string,rule:string>>")
        return F.when(run.rlike(pattern), F.filter(made, lambda x: x["out"].isNotNull())).otherwise(none)

    def cut(made: Column) -> Column:
        rule = F.array_join(F.transform(made, lambda x: x["rule"]), "|")
        found = F.transform(F.regexp_extract_all(run, rule, F.lit(0)), lambda v: F.array(_spans.let(F.element_at(F.filter(made, lambda x: x["value"] == v), 1), lambda x: _piece(x["kind"], x["out"]))))
        return F.when(F.size(made) > 0, _woven(run, rule, found, lambda p: _loose_cards(p, key))).otherwise(_loose_cards(run, key))

    return F.when(run.rlike(NUMBERS), _spans.let(F.concat(*[valid(k, p) for k, p in FIRM]), cut)).otherwise(_plain(run))


def pseudonyms(text: Column, key: str) -> Column:
    """array<struct<kind, value>>: the pieces of ``text``, with pseudonyms of their kind for valid values and kind null for all else."""
    email = PATTERNS["email"]
    mails = F.transform(_spans.matches(text, email), lambda v: F.array(_piece(F.lit("email"), _email(v, key))))
    return _woven(text, email, mails, lambda t: _woven(t, RUN, F.transform(_spans.matches(t, RUN), lambda r: _numbers(r, key)), _plain))


def _count(kinds: str, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(kinds, lambda x: x == kind)), F.lit(0)).cast("long")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the text rewritten, and one count per kind: n_email, n_date, n_ssn, n_ip, n_card, n_phone."""
    names = [f"n_{k}" for k in KINDS]
    rest = [c for c in docs.columns if c not in names]
    rows = docs.select(*rest, F.when(docs["text"].rlike(ANY), pseudonyms(docs["text"], key)).alias("__found"))
    text = F.array_join("__found.value", "")
    counts = [_count("__found.kind", k).alias(f"n_{k}") for k in KINDS]
    return rows.select(*[F.when(F.col("__found").isNotNull(), text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in rest], *counts)
