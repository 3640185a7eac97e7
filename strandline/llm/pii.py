"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Findings are located by one pattern, validated by kind, and permuted within their format by a keyed
Feistel network: the variable places of a value (digits, letters, octets, day numbers) have each a radix;
even and odd places are the two halves; every round adds to the places of one half, modulo their radix,
keyed SHA-256 digests of the other half. That is a permutation of all values of one format, so equal values
get equal pseudonyms in every document and different values never meet. What fails validation stays.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import fresh

ROUNDS = 8
#: Days permuted among themselves: blocks of 128 x 128 days from this date, so a date stays in its era.
DATE_ORIGIN, DATE_SIDE = "1970-01-01", 128
_FIRST_DAY, _LAST_DAY = ((d - datetime.date.fromisoformat(DATE_ORIGIN)).days for d in (datetime.date.min, datetime.date.max))


def _radixes(days: int) -> tuple[int, int]:
    """Two factors as near each other as may be."""
    low = next(x for x in range(math.isqrt(days), 0, -1) if days % x == 0)
    return low, days // low


#: The blocks that the calendar (0001-01-01 to 9999-12-31) begins and ends in: their first day there, and radixes whose product is their number of days.
_END_BLOCKS = {
    _FIRST_DAY // DATE_SIDE**2: (_FIRST_DAY, _radixes(DATE_SIDE**2 - _FIRST_DAY % DATE_SIDE**2)),
    _LAST_DAY // DATE_SIDE**2: (_LAST_DAY - _LAST_DAY % DATE_SIDE**2, _radixes(_LAST_DAY % DATE_SIDE**2 + 1)),
}

#: The part before the @ has at most 64 characters and a name at most 127 labels, so no text makes the matcher recurse deeply.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,63}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}|(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,64})(?![A-Za-z0-9])"
#: Beginnings of well-known access keys, and how they go on.
TOKEN_FORMS = {
    "AKIA": "[0-9A-Z]{16}", "ASIA": "[0-9A-Z]{16}", "AIza": "[0-9A-Za-z_-]{35}", "sk-": "[0-9A-Za-z_-]{20,200}", "sk_live_": "[0-9A-Za-z]{16,100}", "ghp_": "[0-9A-Za-z]{36,80}", "gho_": "[0-9A-Za-z]{36,80}",
    "ghs_": "[0-9A-Za-z]{36,80}", "glpat-": "[0-9A-Za-z_-]{20,80}", "xoxb-": "[0-9A-Za-z-]{20,120}", "xoxp-": "[0-9A-Za-z-]{20,120}", "hf_": "[0-9A-Za-z]{30,80}",
}
TOKEN = "(?<![A-Za-z0-9])(?:" + "|".join(p + f for p, f in TOKEN_FORMS.items()) + ")(?![A-Za-z0-9])"
DATE = r"(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
#: With ``+`` and a country code: ten digits as in North America, or seven to fourteen in any groups (15 digits at most).
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14}(?![0-9A-Za-z]|[ .-][0-9])|(?<![0-9A-Za-z.-])(?<![0-9] )(?:\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} ))[0-9]{4}(?![0-9A-Za-z]|[ .-][0-9])"
#: Eight groups, or fewer around one ``::``; an IPv4 tail is not read.
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
CARD = r"(?<![0-9A-Za-z])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[ -][0-9])"
#: All patterns but the phones with ``+`` begin at the beginning of a word; the grouping by first character is for speed alone.
_DIGIT = "(?=[0-9(])"
ANY = f"(?<![0-9A-Za-z])(?=[0-9A-Za-z._%+(:-])(?:{EMAIL}|(?=[A-Z]){IBAN}|(?=[0-9A-Fa-f]){SECRET}|(?=[Aagshx]){TOKEN}|{_DIGIT}{DATE}|(?=[0-9A-Fa-f:]){IPV6}|{_DIGIT}{IP}|(?=[0-9(+])(?:{PHONE})|{_DIGIT}(?:{SSN}|{CARD}))|(?=\\+)(?:{PHONE})"

#: Every finding holds a digit or an @, but for an IPv6 address of letters alone.
GATE = r"[0-9@]|[A-Fa-f]:[A-Fa-f]"


#: Characters that mark findings in a text, and the one that guards such a character of the text itself.
_MARK, _GUARD = "\x01\x03", "\x01\x02"
#: Times a date is permuted at most until its day can't be read as a month (one in 10^25 needs more).
WALK = 64
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radixes: Column, key: str) -> Column:
    """Permute an array<bigint> of values below the radixes of the same array position."""

    def permuted(bounds: Column) -> Column:
        def one_round(v: Column, r: Column) -> Column:
            other = F.array_join(F.transform(F.filter(v, lambda _, i: i % 2 != r % 2), lambda x: x.cast("string")), ",")

            def moved(head: Column) -> Column:
                def step(x: Column, i: Column) -> Column:
                    digest = F.sha2(F.concat_ws("|", head, i.cast("string")), 256)
                    return F.when(i % 2 == r % 2, F.pmod(x + F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint"), F.get(bounds["r"], i))).otherwise(x)

                return F.transform(v, step)

            return let(F.concat_ws("|", F.lit(key), r.cast("string"), bounds["text"], other), moved)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one_round)

    return let(F.struct(radixes.alias("r"), F.array_join(F.transform(radixes, lambda x: x.cast("string")), ",").alias("text")), permuted)


def permute_text(text: Column, key: str, alphabet: str = "auto") -> Column:
    """Permute the ASCII digits and letters of a string, each within digits, small or capital letters
    (``hex``, ``HEX``: within 0-9a-f, 0-9A-F); all else stays in place."""
    kinds = {"hex": ["0123456789abcdef"], "HEX": ["0123456789ABCDEF"]}.get(alphabet) or ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]

    def place(c: Column) -> Column:
        out = F.struct(c.alias("c"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("v"))
        for i, k in enumerate(kinds, 1):
            out = F.when(F.lit(k).contains(c), F.struct(c.alias("c"), F.lit(i).alias("kind"), (F.instr(F.lit(k), c) - 1).cast("bigint").alias("v"))).otherwise(out)
        return out

    def walked(placed: Column) -> Column:
        moving = F.filter(placed, lambda p: p["kind"] > 0)
        sizes = F.array(*(F.lit(len(k)).cast("bigint") for k in kinds))
        permuted = feistel(F.transform(moving, lambda p: p["v"]), F.transform(moving, lambda p: F.get(sizes, p["kind"] - 1)), key)
        letters = F.array(*map(F.lit, kinds))

        def joined(v: Column) -> Column:
            start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

            def step(acc: Column, p: Column) -> Column:
                char = F.when(p["kind"] == 0, p["c"]).otherwise(F.substring(F.get(letters, p["kind"] - 1), F.get(v, acc["at"]).cast("int") + 1, F.lit(1)))
                return F.struct(F.concat(acc["out"], char).alias("out"), (acc["at"] + F.when(p["kind"] == 0, 0).otherwise(1)).alias("at"))

            return F.aggregate(placed, start, step, lambda acc: acc["out"])

        return let(permuted, joined)

    return F.when(F.length(text) == 0, text).otherwise(let(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), place), walked))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_digit(body: Column) -> Column:
    """The digit that makes body + digit pass the Luhn check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(body), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)), F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def _refill(shape: Column, digits: Column) -> Column:
    """Put digits in the places of the digits of ``shape``."""

    def filled(given: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

        def step(acc: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(given, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

        return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["out"])

    return let(digits, filled)


def _card(m: Column, key: str) -> Column:
    """First digit kept, the others permuted, the check digit set anew; null unless the number passes Luhn."""

    def made(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), key + "/card"))
        return F.when(F.call_function("luhn_check", d) & d.rlike("[1-9]"), let(body, lambda b: _refill(m, F.concat(b, _luhn_digit(b)))))

    return let(_digits(m), made)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    out = F.array_join(F.transform(feistel(octets, F.array_repeat(F.lit(256).cast("bigint"), 4), key + "/ip"), lambda x: x.cast("string")), ".")
    return F.when(F.forall(octets, lambda x: x < 256), out)


def _ipv6(m: Column, key: str) -> Column:
    """The 128 bits permuted by groups of 16 and written in full, in small letters; null where there aren't eight groups.

    All spellings of one address get the same pseudonym."""
    sides = F.split(m, "::")
    head, tail = (F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda x: x != "") for i in range(2))
    short = F.size(sides) == 2
    missing = F.lit(8) - F.size(head) - F.size(tail)
    groups = F.transform(F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail), lambda x: F.conv(x, 16, 10).cast("bigint"))
    moved = feistel(groups, F.array_repeat(F.lit(65536).cast("bigint"), 8), key + "/ipv6")
    return F.when(F.when(short, missing > 0).otherwise(missing == 0), F.array_join(F.transform(moved, lambda x: F.lower(F.hex(x))), ":"))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.get(F.split(m, "-"), F.lit(i)).cast("bigint") for i in range(3))
    index = area - F.when(area > 666, 2).otherwise(1)
    moved = feistel(F.array(index, group - 1, serial - 1), F.array(*(F.lit(x).cast("bigint") for x in (898, 99, 9999))), key + "/ssn")
    out = F.aggregate(
        F.array(moved), F.lit(""), lambda _, v: F.concat_ws("-", F.lpad((v[0] + F.when(v[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0"))
    )
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), out)


def _iban_rest(text: Column) -> Column:
    """Remainder by 97 of a string whose letters count as 10-35."""
    return F.aggregate(
        F.split(text, ""), F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    )


def _spaced(shape: Column, text: Column) -> Column:
    """``text`` with blanks where ``shape`` has them."""
    parts = F.transform(F.split(shape, " "), lambda x: F.length(x))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(parts, start, lambda acc, n: F.struct(F.concat(acc["out"], F.array(F.substring(text, acc["at"], n))).alias("out"), (acc["at"] + n).alias("at")), lambda acc: F.array_join(acc["out"], " "))


def _iban(m: Column, key: str) -> Column:
    """Country kept, account permuted, check digits set anew; null unless the number passes the mod-97 check.
    Grouped and compact spellings get the same pseudonym."""

    def made(whole: Column) -> Column:
        country, account = F.substring(whole, 1, 2), F.substring(whole, F.lit(5), F.length(whole) - 4)

        def checked(moved: Column) -> Column:
            check = F.lpad((F.lit(98) - _iban_rest(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
            return _spaced(m, F.concat(country, check, moved))

        return F.when(_iban_rest(F.concat(account, F.substring(whole, 1, 4))) == 1, let(permute_text(account, key + "/iban/"), checked))

    return let(F.replace(m, F.lit(" "), F.lit("")), made)


def _date(m: Column, key: str, pattern: str, late: bool = False) -> Column:
    """Days permuted within their block; ``late``: among the days after the 12th of a month, by permuting again until one is met."""
    day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(pattern))), F.lit(DATE_ORIGIN).cast("date")).cast("bigint")
    block = F.floor(day / F.lit(float(DATE_SIDE * DATE_SIDE))).cast("bigint")
    # The blocks at both ends of the calendar hold fewer days, so they have radixes of their own.
    low, sides = block * DATE_SIDE * DATE_SIDE, F.array(*[F.lit(DATE_SIDE).cast("bigint")] * 2)
    for edge, (start, radixes) in _END_BLOCKS.items():
        low = F.when(block == edge, F.lit(start).cast("bigint")).otherwise(low)
        sides = F.when(block == edge, F.array(*(F.lit(x).cast("bigint") for x in radixes))).otherwise(sides)

    def made(at: Column) -> Column:
        def shown(v: Column) -> Column:
            return F.date_add(F.lit(DATE_ORIGIN).cast("date"), (at["low"] + v[0] * F.get(at["sides"], F.lit(1)) + v[1]).cast("int"))

        def moved(v: Column) -> Column:
            return feistel(v, at["sides"], key + "/date")

        side = F.get(at["sides"], F.lit(1))
        out = moved(F.array(F.floor((at["day"] - at["low"]) / side.cast("double")).cast("bigint"), (at["day"] - at["low"]) % side))
        if late:
            out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), out, lambda v, _: F.when(F.dayofmonth(shown(v)) > 12, v).otherwise(moved(v)))
        return F.aggregate(F.array(out), F.lit(None).cast("string"), lambda _, v: F.date_format(shown(v), pattern))

    return F.when((day >= _FIRST_DAY) & (day <= _LAST_DAY), let(F.struct(day.alias("day"), low.alias("low"), sides.alias("sides")), made))


def _phone(m: Column, key: str) -> Column:
    """North American form: country code kept, the other ten digits permuted. Otherwise the first two digits are kept."""

    def made(d: Column) -> Column:
        code = F.when(m.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$"), F.length(d) - 10).otherwise(2)
        return let(code, lambda k: _refill(m, F.concat(F.substring(d, F.lit(1), k), permute_text(F.substring(d, k + 1, F.length(d)), key + "/phone"))))

    return let(_digits(m), made)


def _token(m: Column, key: str) -> Column:
    """The beginning that names the issuer is kept."""
    head = F.regexp_extract(m, "^(?:" + "|".join(TOKEN_FORMS) + ")", 0)
    return F.concat(head, permute_text(F.substring(m, F.length(head) + 1, F.length(m)), key + "/token"))


def kind_of(m: Column) -> Column:
    out = F.lit("card")
    for kind, pattern in (("ssn", SSN), ("phone", PHONE), ("ip", IP), ("ip", IPV6), ("date", DATE), ("token", TOKEN), ("secret", SECRET), ("iban", IBAN), ("email", EMAIL)):
        out = F.when(m.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a finding, or null where its kind's validation fails."""
    at = F.instr(m, "@")
    return (
        F.when(kind == "email", F.concat(permute_text(F.substring(m, F.lit(1), at - 1), key + "/email"), F.substring(m, at, F.length(m))))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "secret", F.when(m.rlike("[a-f]"), permute_text(m, key + "/secret", "hex")).otherwise(permute_text(m, key + "/secret", "HEX")))
        .when(kind == "token", _token(m, key))
        .when((kind == "ip") & m.contains(":"), _ipv6(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "card", _card(m, key))
        .when((kind == "date") & m.like("____-%"), _date(m, key, "yyyy-MM-dd"))
        .when((kind == "date") & m.like("__.%"), _date(m, key, "dd.MM.yyyy"))
        .when((kind == "date") & (F.substring(m, 1, 2) > "12"), _date(m, key, "dd/MM/yyyy", late=True))
        .when(kind == "date", _date(m, key, "MM/dd/yyyy"))
    )


def key_of(spark: SparkSession) -> str:
    """The key of the pseudonyms: ``spark.strandline.pii.key``; whoever has it can undo them. The default is for trials alone."""
    return spark.conf.get("spark.strandline.pii.key", "strandline")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", findings: str = "pii") -> DataFrame:
    """``docs`` with its text pseudonymised, and ``findings``: array of (kind, start, length, replaced).

    ``start`` counts code points of the text given, from 0; ``replaced`` is false where validation failed
    and the text stays as it is. A narrow projection over whole texts: no shuffle, rows and other columns
    as they were, repeated rows alike. A null text stays null with null findings; an empty one has none; an
    empty table stays empty. Of findings that overlap the first and, from one place, the kind first listed counts. A date with slashes is read as
    month/day, or as day/month where only that is one. Only an IP address may change its length. A column already
    named ``findings`` is replaced.
    """
    t = F.col(text)
    marked = F.regexp_replace(F.replace(t, F.lit(_MARK[0]), F.lit(_GUARD)), ANY, f"{_MARK}$0{_MARK}")
    parts, found = fresh(docs, "_parts"), fresh(docs, "_found")
    # One pass of the patterns: the text is cut at both ends of its findings, which take every second place.
    work = docs.withColumn(parts, F.when(t.rlike(GATE), F.split(marked, _MARK)))
    named = F.transform(F.filter(parts, lambda _, i: i % 2 == 1), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    done = F.transform(named, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("p")))
    work = work.withColumn(found, F.when(F.size(parts) > 1, done))
    gaps = F.transform(F.filter(parts, lambda _, i: i % 2 == 0), lambda g: F.replace(g, F.lit(_GUARD), F.lit(_MARK[0])))
    kinds = "struct<kind:string,start:int,length:int,replaced:boolean>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kinds}>)").alias("spans"))

    def span(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        one = F.struct(x["d"]["kind"].alias("kind"), at.alias("start"), F.length(x["d"]["m"]).alias("length"), x["d"]["p"].isNotNull().alias("replaced"))
        return F.struct((at + F.length(x["d"]["m"])).alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    def further(acc: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + acc["at"]).alias("start"), x["length"].alias("length"), x["replaced"].alias("replaced")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["spans"], F.array(moved)).alias("spans"))

    pairs = F.zip_with(gaps, found, lambda g, d: F.struct(g.alias("gap"), d.alias("d")))
    # Places add up within blocks of findings and then over the blocks, as appending to one long list would be quadratic.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda b: F.slice(F.slice(pairs, F.lit(1), F.size(found)), b * _BLOCK + 1, F.lit(_BLOCK)))
    many = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{kinds}>>)").alias("spans"))
    spans = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, start, span)), many, further, lambda acc: F.flatten(acc["spans"]))
    joined = F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], F.coalesce(x["d"]["p"], x["d"]["m"], F.lit("")))), "")
    has = F.col(found).isNotNull()
    return work.withColumns({text: F.when(has, joined).otherwise(t), findings: F.when(has, spans).when(t.isNotNull(), start["spans"])}).drop(parts, found)
