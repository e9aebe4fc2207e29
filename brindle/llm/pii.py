"""Operator 7: personal data replaced by format-preserving pseudonyms. DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, phone numbers, dates, national numbers (ddd-dd-dddd),
card numbers (13 to 19 digits in one, or in fours or as 4-6-5 with blanks or hyphens) and secrets: long
hexadecimal words, keys with known beginnings, and values after names such as password. What it finds is
validated, and what fails stays as it is: octets to 255; days that the calendar has; cards begin with 3 to 6 or
2221 to 2720 and have a right check digit; national numbers have no zero part and an area below 900 that is not
666. Phone numbers have nothing to check but their form (an area in brackets or parted by signs).

Numbers and dates go through a Feistel network keyed by `key`, on the valid numbers of their own format: digits
stay digits and signs stay where they are; a card keeps the beginning that makes it one and gets the right check
digit; national numbers permute among the valid ones; a date becomes a date from 1900-01-01 to 2100-05-02. A
network is a permutation, so equal values stay equal across documents and different ones different. Names before
an @ and secrets are not numbers: they become keyed digests, of 128 bits at the domain pseudonym.invalid for
addresses (whatever their case), as long as they were for secrets.

Each row is handled on its own; nothing is shuffled. The pattern runs over a text once and puts a mark on both
sides of what it finds; texts are parted at the marks, and each find's kind is told once.

Defined results: a null text stays null and has no findings; a null doc_id stays null; equal rows give equal
rows; an empty table gives an empty result; a text of any length is read whole. All other columns pass through
as they are, whatever they are called; a count whose name the table has already gets underscores at its end.
The key has no default: who knows it can undo the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The query's key, which is public.
DEMO_KEY = "not-a-secret"
ROUNDS = 8
#: Stands on both sides of a find; a text that has it itself is parted by the pattern.
MARK = "\x01"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.){1,126}[A-Za-z]{2,}"  # a domain has 127 labels at most
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
DATE_ISO = r"(?<![0-9])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9])"
DATE_DAY = r"(?<![0-9])(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2}(?![0-9])"
NATIONAL = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Fa-f])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Fa-f])"
#: A long hexadecimal word, or what follows a name such as password and = or :, quoted or not.
NAMED = r"""(?<=[=:"']|[=:] )(?<=(?i:password|passwd|secret|token|api[_-]?key) {0,2}[=:] {0,2}["']?)[^\s"']{6,}+"""
#: Keys that tell themselves by how they begin.
MARKED = r"(?:A(?:KI|SI)A[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}+|eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]++)"
SECRET = rf"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{{32,128}}|{MARKED})(?![0-9A-Za-z])|{NAMED}"
KINDS = {"email": EMAIL, "secret": SECRET, "date": f"{DATE_ISO}|{DATE_DAY}", "ip": IP, "phone": PHONE, "national": NATIONAL, "card": CARD}
PATTERN = "|".join(KINDS.values())
#: Days from 1900-01-01 that the network permutes: 270 * 271.
DAYS = (270, 271)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(x: Column, a: int | Column, b: int | Column, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0..a*b-1: halves of a and b values change in turn by a digest of the other."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in (a, b))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        told = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.when(even, s["r"]).otherwise(s["l"]).cast("string"), a.cast("string")), 256)
        n = _number(told)
        return F.struct(
            F.when(even, F.pmod(s["l"] + n % a, a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + n % b, b)).alias("r"),
        )

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _ten(n: Column) -> Column:
    """10 ** n as a long, n to 10."""
    return F.element_at(F.array(*[F.lit(10**k) for k in range(11)]), n.cast("int") + 1)


def digits(d: Column, kind: str, key: str) -> Column:
    """A permutation of the digit strings of each length from 2 to 18; exact long arithmetic by halves."""
    n = F.length(d)
    low = F.floor(n / 2).cast("int")
    high = n - low
    left = F.substring(d, F.lit(1), high).cast("long")
    right = F.substring(d, high + 1, low).cast("long")
    a, b = _ten(high), _ten(low)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, s["r"]).otherwise(s["l"]).cast("string")
        m = _number(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), i.cast("string"), other), 256))
        return F.struct(
            F.when(even, F.pmod(s["l"] + m % a, a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + m % b, b)).alias("r"),
        )

    start = F.struct(left.alias("l"), right.alias("r"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
        lambda s: F.concat(F.lpad(s["l"].cast("string"), high, F.lit("0")), F.lpad(s["r"].cast("string"), low, F.lit("0"))),
    )


def check_digit(payload: Column) -> Column:
    """Luhn's digit for these digits."""
    each = F.transform(F.filter(F.split(F.reverse(payload), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int"))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda s, x: s + x), F.lit(10))


def put_back(shape: Column, d: Column) -> Column:
    """The digits of d in the places of shape's digits."""
    return F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(d, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _day(m: Column) -> Column:
    return F.when(m.rlike(f"^{DATE_ISO}$"), F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy"))


def _part(d: Column, at: int, n: int) -> Column:
    return F.substring(d, at, n).cast("long")


def valid_card(bare: Column) -> Column:
    """Digits of a card: a known beginning and a right check digit."""
    begins = F.substring(bare, 1, 1).between("3", "6") | F.substring(bare, 1, 4).between("2221", "2720")
    last = F.substring(bare, F.length(bare), F.lit(1)).cast("int")
    return begins & (check_digit(F.substring(bare, F.lit(1), F.length(bare) - 1)) == last)


def valid_national(bare: Column) -> Column:
    area = _part(bare, 1, 3)
    return area.between(1, 899) & (area != 666) & (_part(bare, 4, 2) > 0) & (_part(bare, 6, 4) > 0)


def kind_of(m: Column) -> Column:
    """The kind whose pattern holds for all of it, or null where it is not valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    bare = F.regexp_replace(m, "[^0-9]", "")
    out = F.when(whole(KINDS["date"]), F.when(_day(m).isNotNull(), "date"))
    for name in ("email", "ip", "phone"):
        out = out.when(whole(KINDS[name]), name)
    out = out.when(whole(KINDS["national"]), F.when(valid_national(bare), "national"))
    out = out.when(whole(KINDS["card"]), F.when(valid_card(bare), "card"))
    return out.otherwise("secret")  # a named secret shows only beside its name


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for a found value of this kind; the value itself for none."""
    bare = F.regexp_replace(m, "[^0-9]", "")
    keyed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), F.lower(m)), 256)
    email = F.concat(F.lit("u"), F.substring(keyed, 1, 32), F.lit("@pseudonym.invalid"))
    long = F.concat(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(m)), 512), F.sha2(F.concat_ws("|", F.lit(key), F.lit("more"), F.lower(m)), 512))
    secret = F.substring(long, F.lit(1), F.length(m))
    secret = F.when(m == F.upper(m), F.upper(secret)).otherwise(secret)
    octets = F.split(m, r"\.")
    address = sum((octets[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), octets[0].cast("long") * 256**3)
    address = feistel(address, 65536, 65536, "ip", key)
    ip = F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    since = F.datediff(_day(m), F.lit("1900-01-01").cast("date"))
    moved = F.date_add(F.lit("1900-01-01").cast("date"), feistel(since, *DAYS, "date", key).cast("int"))
    date = F.when(m.contains("/"), F.date_format(moved, "dd/MM/yyyy")).when(m.contains("."), F.date_format(moved, "dd.MM.yyyy"))
    date = date.otherwise(F.date_format(moved, "yyyy-MM-dd"))
    last = F.substring(bare, F.length(bare) - 9, F.lit(10))
    phone = put_back(m, F.concat(F.substring(bare, F.lit(1), F.length(bare) - 10), digits(last, "phone", key)))
    # Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999, numbered one by one.
    area = _part(bare, 1, 3)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + _part(bare, 4, 2) - 1) * 9999 + _part(bare, 6, 4) - 1
    other = feistel(number, 898 * 99, 9999, "national", key)
    area = F.floor(other / (99 * 9999)) + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    other = (area * 100 + F.floor(other / 9999) % 99 + 1) * 10000 + other % 9999 + 1
    national = put_back(m, F.lpad(other.cast("long").cast("string"), 9, "0"))
    begins = F.when(bare.startswith("2"), 4).otherwise(1)
    hidden = F.concat(F.substring(bare, F.lit(1), begins), digits(F.substring(bare, begins + 1, F.length(bare) - begins - 1), "card", key))
    card = put_back(m, F.concat(hidden, check_digit(hidden).cast("string")))
    choice = F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "date", date)
    return choice.when(kind == "phone", phone).when(kind == "national", national).when(kind == "card", card).otherwise(m)


def _is(name: str):
    return lambda x: x["kind"] == name


def count_columns(columns: list[str]) -> dict[str, str]:
    """For each kind the name of its count, which no column of the table has."""
    taken, out = {c.lower() for c in columns}, {}
    for kind in KINDS:
        name = f"n_{kind}"
        while name in taken:
            name += "_"
        taken.add(name)
        out[kind] = name
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """The rows with text replaced, and counts n_email, n_secret, n_date, n_ip, n_phone, n_national, n_card."""
    text = F.col("text")
    maybe = text.rlike("[0-9@]|[0-9A-Fa-f]{32}|A(?:KI|SI)A|gh[oprsu]_|sk-|eyJ|(?i:password|passwd|secret|token|api[_-]?key) {0,2}[=:]")
    # Each step is a projection of its own, so that the pattern runs once although two columns come from it.
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK)
    slow = F.struct(F.split(text, PATTERN).alias("plain"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found"))
    has = text.contains(MARK)
    parted = docs.select(F.struct("*").alias("row"), F.when(maybe & ~has, marked).alias("marked"), F.when(maybe & has, slow).alias("slow"))
    every = lambda odd: F.filter("marked", lambda _, i: i % 2 == odd)
    kinds = F.transform(F.coalesce(every(1), F.col("slow").getField("found")), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    told = parted.select("row", F.coalesce(every(0), F.col("slow").getField("plain")).alias("plain"), kinds.alias("found"))
    new = F.zip_with("plain", "found", lambda p, x: F.concat(p, F.coalesce(pseudonym(x["m"], x["kind"], key), F.lit(""))))
    new = F.when(F.exists("found", lambda x: x["kind"].isNotNull()), F.array_join(new, "")).otherwise(F.col("row").getField("text"))
    # size() of null is -1.
    counts = [F.greatest(F.size(F.filter("found", _is(kind))), F.lit(0)).alias(name) for kind, name in count_columns(docs.columns).items()]
    return told.select(*[(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns], *counts)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
