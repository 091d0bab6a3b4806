"""Format-preserving pseudonyms for personal data.

Native: DataFrame and SQL functions only.  Validated numbers (payment cards,
IBANs, telephone and social security numbers, IPv4 addresses), dates, the local
parts of e-mail addresses and hexadecimal secrets are permuted within their format
by a keyed Feistel network, so equal values stay equal in all documents, different
values stay different, and a pseudonym passes the checks that its original passed.

A value is a list of symbols, each with its own base (ten for a digit, 898 for the
area of a social security number, 256 for a part of an address).  The network adds a
keyed hash of one half of the list to the other half, modulo the bases, in ROUNDS
turns; this is one-to-one on the values of that format, and reversible with the key.
A half is hashed once a round and its digest is spread over the symbols, so the work
grows with the length of a value; no pattern recurs or goes back over a long run.

The key is the setting ``spark.leafgraph.pii.key``.  A session without one draws a key of its
own at random: its pseudonyms are linked within the session and to no other.

Defined cases: null text stays null, empty text empty; what fails its check (Luhn,
mod 97, a calendar, ranges) is left alone; an IBAN of a country of the registry ends at that
country's length; a date dd/MM/yyyy is read as MM/dd/yyyy where that is a date, else (day
over 12) it is permuted among the dates of that kind; a domain counts up to its last label, one of
which, not the first, must be of 2 to 24 letters; telephone numbers are those of +1;
other columns are kept as they are whatever their names, but for one named like the
count (``n_pii``), which is replaced; repeated rows are each replaced alike; an empty table
gives no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm.common import free_name, named

ROUNDS = 10
#: The Spark setting with the secret of the permutation.
KEY = "spark.leafgraph.pii.key"
#: Hexadecimal digits of a digest that make one number, and such numbers in a digest.
DIGITS, NUMBERS = 15, 4

#: Lengths of IBANs by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern(length: int, countries: str) -> str:
    """IBANs of these countries, without spaces or in groups of four."""
    groups, rest = divmod(length - 4, 4)
    last = f" [A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{'|'.join(countries.split())})\d{{2}}(?:[A-Z0-9]{{{length - 4}}}|(?: [A-Z0-9]{{4}}){{{groups}}}{last})(?![A-Za-z0-9])"


#: What can be a value; ``valid`` decides.  No pattern starts or ends inside a longer run.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[A-Za-z0-9.-]*?\.[A-Za-z]{2,24}(?![A-Za-z0-9-]))[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2})(?:"
    + "|".join(iban_pattern(n, c) for n, c in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?|[A-Z0-9]{11,30})(?![A-Za-z0-9]))",
    "date": r"(?<![\d./-])(?:\d{4}(?<cut>[-/.])\d{2}\k<cut>\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?\d{3}|[2-9]\d{2}[.-][2-9]\d{2})[ .-]\d{4}(?!\d)|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{4}|\d{4}(?<space>[ -])\d{6}\k<space>\d{5})(?!\d)",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: First numbers of payment cards.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[04-9]|6)"
#: Days from 1800-01-01 to 2199-12-31: one cycle of the calendar, 146,097 = 189 x 773.
FIRST_DAY, DAYS, DAY_BASES = "1800-01-01", 146_097, (189, 773)
#: Turns to reach another day over 12, of which six in ten days are: fewer than one value in 10^25 needs more.
WALK = 64


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def permuted(symbols: str, bases: str, kind: str, key: str) -> str:
    """SQL of the permuted symbols."""

    def mixed(half: str, base: str, other: str) -> str:
        """The half plus numbers of a keyed hash of the other half, of which one digest gives NUMBERS."""
        digest = f"sha2(concat_ws('|', {quoted(key)}, '{kind}', i, array_join(transform({other}, y -> cast(y AS string)), ',')), 256)"
        spread = f"transform(sequence(0, size({half}) div {NUMBERS}), k -> sha2(concat(d, '|', k), 256))"
        turn = f"cast(conv(substr(ds[j div {NUMBERS}], j % {NUMBERS} * {DIGITS} + 1, {DIGITS}), 16, 10) AS bigint)"
        sums = f"transform({half}, (v, j) -> (v + {turn} % {base}[j]) % {base}[j])"
        return f"transform(transform(array({digest}), d -> {spread}), ds -> {sums})[0]"

    low, high = "slice(y.{0}, 1, size(y.{0}) div 2)", "slice(y.{0}, size(y.{0}) div 2 + 1, size(y.{0}))"
    halves = f"named_struct('l', {low.format('s')}, 'r', {high.format('s')}, 'lb', {low.format('b')}, 'rb', {high.format('b')})"
    step = f"named_struct('l', if(i % 2 = 0, {mixed('s.l', 'z.lb', 's.r')}, s.l), 'r', if(i % 2 = 1, {mixed('s.r', 'z.rb', 's.l')}, s.r))"
    run = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', z.l, 'r', z.r), (s, i) -> {step}, s -> concat(s.l, s.r))"
    given = f"transform(array(named_struct('s', {symbols}, 'b', {bases})), y -> {halves})"
    return f"transform({given}, z -> {run})[0]"


def digits(s: str) -> str:
    """SQL of the digits of a string as numbers."""
    return f"transform(filter(split({s}, ''), c -> c rlike '^[0-9]$'), c -> cast(c AS bigint))"


def spelled(numbers: str) -> str:
    return f"array_join(transform({numbers}, y -> cast(y AS string)), '')"


def poured(template: str, new: str, kind: str = "[0-9]") -> str:
    """SQL: the characters of ``template`` of that kind replaced in order by those of ``new``."""
    step = (
        f"if(c rlike '^{kind}$', named_struct('out', concat(a.out, substr(q.new, a.n + 1, 1)), 'n', a.n + 1),"
        " named_struct('out', concat(a.out, c), 'n', a.n))"
    )
    run = f"aggregate(split(q.t, ''), named_struct('out', '', 'n', 0), (a, c) -> {step}, a -> a.out)"
    return f"transform(array(named_struct('t', {template}, 'new', {new})), q -> {run})[0]"


def luhn_sum(d: str) -> str:
    """Luhn's sum, of the digits before a check digit that is zero or known."""
    doubled = "if((size(w) - 1 - k) % 2 = 0, x, if(x > 4, 2 * x - 9, 2 * x))"
    return f"transform(array({d}), w -> aggregate(transform(w, (x, k) -> {doubled}), 0L, (a, x) -> a + x))[0]"


def mod97(s: str) -> str:
    """An IBAN's remainder: letters count from ten, the first four characters come last."""
    moved = f"split(concat(substr({s}, 5), substr({s}, 1, 4)), '')"
    step = "if(c rlike '^[0-9]$', (a * 10 + cast(c AS bigint)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(filter({moved}, c -> c <> ''), 0L, (a, c) -> {step})"


def by_character(s: str, kind: str, key: str, letters: int) -> str:
    """SQL: letters (the first ``letters``, of either case) and digits permuted in place; the rest stays.

    With 16 symbols (hexadecimal) letters and digits are one alphabet.
    """
    chars = f"filter(split({s}, ''), c -> c <> '')"
    if letters == 6:
        symbols = f"transform({chars}, c -> cast(conv(c, 16, 10) AS bigint))"
        out = permuted(symbols, f"transform({chars}, c -> 16L)", kind, key)
        plain = f"array_join(transform({out}, y -> lower(hex(y))), '')"
        return f"if({s} rlike '[A-F]', upper({plain}), {plain})"
    symbol = "CASE WHEN c rlike '^[0-9]$' THEN ascii(c) - 48 WHEN c rlike '^[a-z]$' THEN ascii(c) - 97 WHEN c rlike '^[A-Z]$' THEN ascii(c) - 65 ELSE 0 END"
    base = "CASE WHEN c rlike '^[0-9]$' THEN 10 WHEN c rlike '^[a-zA-Z]$' THEN 26 ELSE 1 END"
    out = permuted(f"transform({chars}, c -> cast({symbol} AS bigint))", f"transform({chars}, c -> cast({base} AS bigint))", kind, key)
    back = "CASE WHEN c rlike '^[0-9]$' THEN char(48 + y) WHEN c rlike '^[a-z]$' THEN char(97 + y) WHEN c rlike '^[A-Z]$' THEN char(65 + y) ELSE c END"
    return f"array_join(zip_with({chars}, {out}, (c, y) -> {back}), '')"


def pseudonym(key: str) -> str:
    """SQL of the pseudonym of a match ``m``; what isn't valid stays as it is."""
    is_a = {k: f"m rlike {quoted('^(?:' + p + ')$')}" for k, p in PATTERNS.items()}
    email = f"concat({by_character("substring_index(m, '@', 1)", 'email', key, 26)}, '@', substring_index(m, '@', -1))"

    plain = "replace(m, ' ', '')"
    inner = permuted(digits(f"substr({plain}, 5)"), f"transform({digits(f'substr({plain}, 5)')}, d -> 10L)", "iban", key)
    body = poured(f"substr({plain}, 5)", spelled(inner))
    whole = f"transform(array({body}), b -> concat(substr(m, 1, 2), lpad(cast(98 - {mod97("concat(substr(m, 1, 2), '00', b)")} AS string), 2, '0'), b))[0]"
    iban = poured("m", whole, "[A-Z0-9]")

    day, lo, hi = "datediff(d, date'%s')" % FIRST_DAY, *DAY_BASES
    turned = permuted(f"array(cast({day} div {hi} AS bigint), cast({day} % {hi} AS bigint))", f"array({lo}L, {hi}L)", "date", key)
    moved = f"transform(array({turned}), t -> date_add(date'{FIRST_DAY}', cast(t[0] * {hi} + t[1] AS int)))[0]"
    forms = {
        r"^\\d{4}-": "yyyy-MM-dd", r"^\\d{4}/": "yyyy/MM/dd", r"^\\d{4}[.]": "yyyy.MM.dd", r"^\\d{2}[.]": "dd.MM.yyyy", r"^\\d{2}/": "MM/dd/yyyy",
    }

    def dated(form: str, new: str) -> str:
        return f"transform(array(to_date(try_to_timestamp(m, '{form}'))), d -> if(d IS NULL OR {day} < 0 OR {day} >= {DAYS}, m, date_format({new}, '{form}')))[0]"

    # turned until the day is over 12 again, so no pseudonym reads as MM/dd/yyyy and different dates stay different
    walked = f"aggregate(sequence(1, {WALK}), d, (w, n) -> if(n > 1 AND day(w) > 12, w, transform(array(w), d -> {moved})[0]))"
    day_first = r"^(?:1[3-9]|[23]\\d)/"
    date = f"CASE WHEN m rlike '{day_first}' THEN {dated('dd/MM/yyyy', walked)} " + " ".join(
        f"WHEN m rlike '{r}' THEN {dated(f, moved)}" for r, f in forms.items()
    ) + " END"

    area = "cast(substr(m, 1, 3) AS bigint)"
    ssn_symbols = f"array({area} - if({area} > 666, 2L, 1L), cast(substr(m, 5, 2) AS bigint) - 1, cast(substr(m, 8, 4) AS bigint) - 1)"
    ssn_out = permuted(ssn_symbols, "array(898L, 99L, 9999L)", "ssn", key)
    ssn = f"transform(array({ssn_out}), t -> concat(lpad(cast(t[0] + if(t[0] >= 665, 2L, 1L) AS string), 3, '0'), '-', lpad(cast(t[1] + 1 AS string), 2, '0'), '-', lpad(cast(t[2] + 1 AS string), 4, '0')))[0]"
    ssn_valid = f"{area} NOT IN (0, 666) AND {area} < 900 AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'"

    ten = f"slice({digits('m')}, -10, 10)"
    # area and exchange begin with 2 to 9, with +1 or parentheses also with 0 or 1: both kinds are kept
    phone_out = permuted(f"transform({ten}, (x, k) -> if(k IN (0, 3) AND x > 1, x - 2, x))", f"transform({ten}, (x, k) -> if(k IN (0, 3), if(x > 1, 8L, 2L), 10L))", "phone", key)
    phone_new = f"transform({phone_out}, (x, k) -> if(k IN (0, 3) AND element_at({ten}, k + 1) > 1, x + 2, x))"
    phone = poured("m", f"concat(if(size({digits('m')}) > 10, '1', ''), {spelled(phone_new)})")

    ip_out = permuted("transform(split(m, '[.]'), x -> cast(x AS bigint))", "array(256L, 256L, 256L, 256L)", "ip", key)
    ip = f"array_join(transform({ip_out}, y -> cast(y AS string)), '.')"

    all_digits = digits("m")
    # the first digit names the kind of issuer and stays, the last is the check digit
    mid = permuted(f"slice({all_digits}, 2, size({all_digits}) - 2)", f"transform(slice({all_digits}, 2, size({all_digits}) - 2), d -> 10L)", "card", key)
    new_head = f"concat(slice({all_digits}, 1, 1), {mid})"
    checked = f"transform(array({new_head}), h -> concat({spelled('h')}, cast((10 - {luhn_sum('concat(h, array(0L))')} % 10) % 10 AS string)))[0]"
    card = poured("m", checked)
    card_valid = f"{spelled(all_digits)} rlike {quoted(ISSUERS)} AND {luhn_sum(all_digits)} % 10 = 0"

    secret = by_character("m", "secret", key, 6)
    return (
        f"CASE WHEN {is_a['email']} THEN {email}"
        f" WHEN {is_a['iban']} AND length({plain}) BETWEEN 15 AND 34 AND {mod97(plain)} = 1 THEN {iban}"
        f" WHEN {is_a['date']} THEN {date}"
        f" WHEN {is_a['ssn']} THEN if({ssn_valid}, {ssn}, m)"
        f" WHEN {is_a['phone']} THEN {phone}"
        f" WHEN {is_a['ip']} THEN {ip}"
        f" WHEN {is_a['card']} AND {card_valid} THEN {card}"
        f" WHEN {is_a['secret']} AND m rlike '[0-9]' AND m rlike '[A-Fa-f]' THEN {secret}"
        " ELSE m END"
    )


def key_of(spark: SparkSession) -> str:
    """The key in the setting KEY; where there is none, a random one that the session keeps."""
    found = spark.conf.get(KEY, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY, found)
    return found


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", count: str = "n_pii") -> DataFrame:
    """``docs`` with its text pseudonymised, and ``count``, the number of values replaced.

    ``key`` is the secret of the permutation, else that of the session (``key_of``).
    """
    key = key or key_of(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() != count.lower()]
    parts, news = free_name(docs, "_parts"), free_name(docs, "_new")
    (source,) = named([text])
    here = source.cast("string")
    found = F.regexp_extract_all(here, F.lit(ANY), F.lit(0))
    cut = F.struct(F.split(here, ANY, -1).alias("rest"), found.alias("old"))
    new = F.expr(f"transform({parts}.old, m -> {pseudonym(key)})")
    joined = F.expr(f"array_join(flatten(zip_with({parts}.rest, {news}, (a, b) -> array(a, coalesce(b, '')))), '')")
    changed = F.expr(f"cast(size(filter(zip_with({parts}.old, {news}, (a, b) -> a <> b), x -> x)) AS bigint)")
    maybe = here.rlike("[0-9@]")
    out = docs.select(*named(columns)).withColumn(parts, F.when(maybe, cut))
    out = out.withColumn(news, F.when(F.size(f"{parts}.old") > 0, new))
    return out.select(
        *(F.when(F.col(news).isNotNull(), joined).otherwise(here).alias(c) if c == text else x for c, x in zip(columns, named(columns))),
        F.when(F.col(news).isNotNull(), changed).otherwise(F.lit(0).cast("long")).alias(count),
    )
