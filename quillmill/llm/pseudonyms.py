"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only (operator 10).

One expression finds candidates; each kind is validated and replaced by a keyed permutation within
its own format, so equal values become equal pseudonyms in every document:

* payment cards (13 to 19 digits, single spaces or hyphens between; a card in groups of four, or in
  one run, is found after other digits too): issuer range and Luhn digit checked; the digits between
  the first four and the check digit are permuted, the check digit is computed anew;
* telephone numbers (+1 and ten digits, or (ddd) ddd-dddd): the ten digits are permuted;
* IPv4 addresses with octets up to 255: the 32 bits are permuted;
* dates yyyy-mm-dd (alone or before the T of a timestamp), yyyy/mm/dd and dd.mm.yyyy from 1900 to
  2099 that exist: permuted among the days of 1900-01-01 to 2099-11-12 (73,000), or among the 49 days
  left.

Values without such a format are replaced by keyed digests: e-mail addresses, and secrets (32 to 64
hexadecimal digits in quotation marks after = or :), which keep their length and case.

The permutation is an alternating Feistel network over a x b values, eight rounds of a SHA-256 based
function; it is a bijection on exactly its format. Numbers that fail validation are left alone, as
is every text without a candidate.

The key is the caller's: who has it can undo the permutations and test guesses of the digests. It is
a literal of the plan, so keep plans and event logs as private as the key.

Nulls and edges: a null text stays null and has counts of 0, so does an empty one. The patterns have
possessive or bounded repeats only, so a text of any length is scanned in time linear in it and in
bounded stack. Rows that repeat are answered each; an empty table stays empty. Extra columns are
kept, whatever their names; columns named as the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "secret", "ip", "date", "phone", "card")

# fixed patterns, by kind
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++"
SECRET = r"(?<=[=:]\s{0,2}[\"'])[0-9a-fA-F]{32,64}(?=[\"'])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w./-])(?:(?:19|20)\d\d([-/])\d\d\1\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![^\WT]|T(?!\d)|[/-])"
PHONE = r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}-\d{4})(?!\w)"
_ENDS = r"(?!\w|[.-]\d)"
_FOURS = r"\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{13,19}"
# digits in any grouping, unless a card of the usual groups begins after the first few
CARD = rf"(?<![\w.-])(?:(?:{_FOURS}){_ENDS}|(?!(?:\d{{1,12}}[ -]){{1,4}}?(?:{_FOURS}){_ENDS})\d(?:[ -]?\d){{12,18}}{_ENDS})"
ANY = "|".join((EMAIL, SECRET, IP, DATE, PHONE, CARD))


def _prf(key: str, tweak: Column, i: Column, x: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): a keyed permutation of [0, a) x [0, b); moduli need not be equal."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s, i):
        return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + F.pmod(_prf(key, tweak, i, s["r"]), a), a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_prf(key, tweak, i, s["l"]), b), b).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _weave(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    at = lambda i: F.length(_digits(F.substr(m, F.lit(1), i)))
    one = lambda i: F.when(F.substr(m, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, at(i), F.lit(1))).otherwise(F.substr(m, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def _luhn_sum(d: Column, doubled_first: bool) -> Column:
    """Sum from the right; the rightmost digit is doubled if asked for."""

    def add(total, i):
        digit = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.substr(F.lit("0246813579"), digit + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == (1 if doubled_first else 0), twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def is_card(d: Column) -> Column:
    issuer = d.rlike("^[3-6]") | F.substring(d, 1, 6).between("222100", "272099")
    return issuer & (_luhn_sum(d, False) % 10 == 0)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def _pad(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n.cast("int"), "0")


def _two(key: str, tweak: Column, d: Column) -> Column:
    """A digit string permuted among those of its length (two digits at least)."""
    h = F.floor(F.length(d) / 2)
    left, right = F.substr(d, F.lit(1), h.cast("int")), F.substr(d, (h + 1).cast("int"), F.length(d))
    return F.transform(F.array(feistel(key, tweak, left, right, _power(h), _power(F.length(d) - h))), lambda s: F.concat(_pad(s["l"], h), _pad(s["r"], F.length(d) - h)))[0]


def _card(key: str, m: Column) -> Column:
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 4), _two(key, F.concat(F.lit("card"), F.substring(d, 1, 4)), F.substr(d, F.lit(5), F.length(d) - 5)))
    full = F.transform(F.array(body), lambda x: F.concat(x, ((10 - _luhn_sum(x, True) % 10) % 10).cast("string")))[0]
    return F.when(is_card(d), F.transform(F.array(full), lambda x: _weave(m, x))[0]).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    d = _digits(m)
    new = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _two(key, F.lit("phone"), F.right(d, F.lit(10))))
    return F.transform(F.array(new), lambda x: _weave(m, x))[0]


def _ip_valid(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)


def _ip(key: str, m: Column) -> Column:
    part = lambda i: F.split(m, r"\.")[i].cast("long")
    s = feistel(key, F.lit("ip"), part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
    new = F.transform(F.array(s), lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))[0]
    return F.when(_ip_valid(m), new).otherwise(m)


def _day(m: Column) -> Column:
    iso = F.regexp_replace(m, "/", "-")
    return F.when(m.rlike(r"^\d\d\."), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(iso).try_cast("date")


def _date(key: str, m: Column) -> Column:
    n = F.datediff(_day(m), F.lit("1900-01-01").cast("date")).cast("long")
    rest = n >= 73_000
    a, b = F.when(rest, F.lit(7)).otherwise(F.lit(200)), F.when(rest, F.lit(7)).otherwise(F.lit(365))
    base = F.when(rest, F.lit(73_000)).otherwise(F.lit(0))
    s = feistel(key, F.when(rest, F.lit("late")).otherwise(F.lit("day")), F.floor((n - base) / b), (n - base) % b, a, b)
    day = F.transform(F.array(s), lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * b + s["r"] + base).cast("int")))[0]
    form = lambda d: F.when(m.rlike(r"^\d\d\."), F.date_format(d, "dd.MM.yyyy")).when(F.contains(m, F.lit("/")), F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return F.when(_day(m).isNull(), m).otherwise(F.transform(F.array(day), form)[0])


def _keyed(key: str, kind: str, m: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m), 256)


def _email(key: str, m: Column) -> Column:
    h = _keyed(key, "email", F.lower(m))
    return F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@d"), F.substring(_keyed(key, "domain", F.lower(F.substring_index(m, "@", -1))), 1, 8), F.lit(".invalid"))


def _secret(key: str, m: Column) -> Column:
    h = F.substr(_keyed(key, "secret", F.lower(m)), F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(h)).otherwise(h)


def kind_of(m: Column) -> Column:
    """Which pattern a match is of; null for what fails validation."""
    return (
        F.when(F.contains(m, F.lit("@")), F.lit("email"))
        .when(m.rlike(r"^[0-9a-fA-F]{32,64}$"), F.lit("secret"))
        .when(m.rlike(rf"^\d{{1,3}}(?:\.\d{{1,3}}){{3}}$"), F.when(_ip_valid(m), F.lit("ip")))
        .when(m.rlike(r"^(?:\d{4}[-/]\d\d[-/]\d\d|\d\d\.\d\d\.\d{4})$"), F.when(_day(m).isNotNull(), F.lit("date")))
        .when(m.rlike(r"^[+(]"), F.lit("phone"))
        .otherwise(F.when(is_card(_digits(m)), F.lit("card")))
    )


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    makers = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "phone": _phone, "card": _card}
    out = F.when(kind.isNull(), m)
    for k in KINDS:
        out = out.when(kind == k, makers[k](key, m))
    return out


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced and a count n_<kind> (long) added for each kind."""
    if not key:
        raise ValueError("pseudonyms need a key")
    kept = [c for c in docs.columns if c not in [f"n_{k}" for k in KINDS]]
    col = {c: F.col("row").getField(c) for c in kept}
    # the row travels as one column, so that no name of its can clash with ours
    may = F.col(f"`{text}`").rlike("[0-9@]|[A-Fa-f]{32}")
    kinds = F.transform(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.when(may, kinds).alias("found"))
    new = F.transform("found", lambda x: pseudonym(key, x["k"], x["m"]))
    # the pieces between matches and the matches' pseudonyms, in turn
    whole = F.array_join(F.flatten(F.zip_with(F.split(col[text], ANY, -1), new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    some = F.size("found") > 0
    count = lambda k: F.when(some, F.size(F.filter("found", lambda x: x["k"] == k))).otherwise(0).cast("long")
    return d.select(*[(F.when(some, whole).otherwise(v) if c == text else v).alias(c) for c, v in col.items()], *[count(k).alias(f"n_{k}") for k in KINDS])
