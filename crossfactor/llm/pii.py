"""Format-preserving pseudonyms for numbers and dates, in SQL functions only.

Card numbers (Luhn), social security numbers, telephone numbers, IPv4 addresses and calendar dates are
found by format and validated; each valid value is permuted by a keyed Feistel network over the
values of its own format: equal values get equal pseudonyms in every document and form, different
values different ones, and a pseudonym is valid again. E-mail addresses and secrets after a key word, which
are digits and letters too, are permuted character by character within their classes: digits, and Latin, Greek and
Cyrillic letters of either case; other characters of a mail name stay.

A Feistel round adds a keyed SHA-256 of one half to the other, modulo the half's size; halves may
differ in size, so a network permutes exactly the values of a format: 146,097 days are 189 x 773. Dates are walked
along their cycle until the day is over 12 again, or 12 and less again, in every form: so day-first dates with slashes
still read as day-first, and a day has one pseudonym however it is written. A date with slashes whose first two numbers
are both under 13 is read month first.
Telephone numbers keep their country code, a 1 before ten digits too; ten digits with an area code of the North
American plan get such a code and exchange again, others keep a leading 0 or 1. IBANs, IPv6 addresses and postal
addresses are not looked for.

The key reaches the rows as the result of a scalar subquery, so no plan, event log or page of the user interface shows it.

Defined results: null texts stay null, empty ones empty; invalid values, other text and other columns, whatever
their names, stay as they are; where formats overlap the first in the list wins; repeated rows get the same
text; an empty table gives no rows; texts and secrets of any length are matched whole, by patterns that neither
recurse nor go back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.common import fresh

ROUNDS = 8
#: The days of 400 Gregorian years, as two factors for the halves.
FIRST_YEAR, DAYS, DAY_HALVES = 1800, 146_097, (189, 773)
#: Steps within which a day of the same kind is reached again; that none is has a chance of 1e-27.
#: In two levels, as most dates need one or two.
WALK = (8, 16)

EDGE, END = r"(?<![\w.+\-])", r"(?![\w\-]|\.\d)"
#: Formats of the values, in order of preference where they overlap.
FORMATS = {
    "mail": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"""(?<=\b(?i:token|secret|password|api_key|apikey|access_key)["']?\s{0,2}[=:]\s{0,2}["']?)[A-Za-z0-9+/_\-]{16,}+(?![A-Za-z0-9+/_\-])""",
    "address": EDGE + r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)" + END,
    "date": EDGE + r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + END,
    "card": EDGE + r"(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}(?:[ \-]\d{3})?|\d{4}[ \-]\d{6}[ \-]\d{5})" + END,
    "social": EDGE + r"\d{3}-\d{2}-\d{4}" + END,
    "phone": r"(?<![\w.\-])(?:\+\d{1,3}[ .\-]?|1[ .\-])?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}" + END,
    "pairs": r"(?<![\w.\-])(?:\+\d{1,3}[ .\-]\d{1,2}|0\d)(?:[ .\-]\d{2}){4}" + END,
    "plus": r"(?<![\w.\-])\+\d{9,14}" + END,
}
#: What a text must hold for a value to be in it.
HINT = r"""[0-9@]|[=:]\s{0,2}["']?[A-Za-z0-9+/_\-]{16}"""
#: Letters and digits that are shifted among themselves: the first and the last of each class.
CLASSES = ("az", "AZ", "09", "\u00e0\u00f6", "\u00c0\u00d6", "\u00f8\u00fe", "\u00d8\u00de", "\u03b1\u03c9", "\u0391\u03a1", "\u03a3\u03a9", "\u0430\u044f", "\u0410\u042f")
ALL = "|".join(f"(?:{p})" for p in FORMATS.values())


def quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def draw(key: str, use: str, turn: str, half: str) -> str:
    """SQL: 60 keyed bits of a half, from 15 hex digits of a SHA-256. ``key`` is SQL, too."""
    return f"cast(conv(substring(sha2(concat({key}, '|{use}|', {turn}, '|', {half}), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: str, use: str, left: str, right: str, sizes: tuple[str, str]) -> str:
    """SQL: the struct (a, b) that the pair (left, right) of numbers under ``sizes`` is permuted to."""
    a = f"(s.a + {draw(key, use, 't', 's.b')} % {sizes[0]}) % {sizes[0]}"
    b = f"(s.b + {draw(key, use, 't', 's.a')} % {sizes[1]}) % {sizes[1]}"
    return f"aggregate(sequence(1, {ROUNDS}), struct(cast({left} as bigint) as a, cast({right} as bigint) as b), (s, t) -> case when t % 2 = 1 then struct({a} as a, s.b as b) else struct(s.a as a, {b} as b) end)"


def named(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digits_permuted(key: str, use: str, digits: str) -> str:
    """SQL: a string of 2 to 36 digits permuted within its length."""
    cut = f"(length({digits}) div 2)"
    sizes = (f"cast(pow(10, {cut}) as bigint)", f"cast(pow(10, length({digits}) - {cut}) as bigint)")
    run = feistel(key, f"{use}', length({digits}), '", f"substring({digits}, 1, {cut})", f"substring({digits}, {cut} + 1)", sizes)
    return named(run, "r", f"concat(lpad(cast(r.a as string), {cut}, '0'), lpad(cast(r.b as string), length({digits}) - {cut}, '0'))")


def national(key: str, p: str) -> str:
    """SQL: the digits of a telephone number, without country code, permuted among those of its kind.

    Ten digits that begin with 2 to 9 are an area of 800, an exchange of 800 (of 200 if it begins with 0 or 1) and
    four digits; a leading 0 or 1 stays; the first of other digits stays within 2 to 9.
    """
    area, exchange, line = f"(cast(substring({p}, 1, 3) as bigint) - 200)", f"cast(substring({p}, 4, 3) as bigint)", f"cast(substring({p}, 7, 4) as bigint)"

    def plan(first: int, many: int) -> str:
        half = 80_000 if many == 800 else 40_000  # half * half = 800 * many * 10,000
        number = f"(({area} * {many} + {exchange} - {first}) * 10000 + {line})"
        moved = feistel(key, f"phone{many}", f"{number} div {half}", f"{number} % {half}", (str(half), str(half)))
        return named(named(moved, "r", f"r.a * {half} + r.b"), "n", f"format_string('%03d%03d%04d', n div {many * 10_000} + 200, n div 10000 % {many} + {first}, n % 10000)")

    cut = f"(length({p}) div 2)"
    least = f"(2 * cast(pow(10, {cut} - 1) as bigint))"
    sizes = (f"(4 * {least})", f"cast(pow(10, length({p}) - {cut}) as bigint)")
    moved = feistel(key, f"phone', length({p}), '", f"substring({p}, 1, {cut}) - {least}", f"substring({p}, {cut} + 1)", sizes)
    other = named(moved, "r", f"concat(cast(r.a + {least} as string), lpad(cast(r.b as string), length({p}) - {cut}, '0'))")
    trunk = f"concat(substring({p}, 1, 1), {digits_permuted(key, 'trunk', f'substring({p}, 2)')})"
    return f"case when substring({p}, 1, 1) < '2' then {trunk} when length({p}) <> 10 then {other} when substring({p}, 4, 1) < '2' then {plan(0, 200)} else {plan(200, 800)} end"


def refilled(shape: str, digits: str) -> str:
    """SQL: ``shape`` with its digits replaced, in order, by those of ``digits``."""
    step = f"case when c between '0' and '9' then struct(concat(s.o, substring({digits}, s.n, 1)) as o, s.n + 1 as n) else struct(concat(s.o, c) as o, s.n as n) end"
    return f"aggregate(split({shape}, ''), struct('' as o, 1 as n), (s, c) -> {step}, s -> s.o)"


def luhn(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits, from its right end."""
    doubled = "case when i % 2 = 1 then d * 2 - case when d > 4 then 9 else 0 end else d end"
    return f"aggregate(transform(reverse(split({digits}, '')), (c, i) -> {named('cast(c as int)', 'd', doubled)}), 0, (s, x) -> s + x)"


def characters_permuted(key: str, use: str, value: str, classes: Sequence[str] = CLASSES) -> str:
    """SQL: letters and digits shifted within their classes by keyed hashes of the other half; the rest stays."""

    def shifted(half: str, other: str) -> str:
        mask = half
        for low, high in classes:
            mask = f"regexp_replace({mask}, '[{low}-{high}]', '{low}')"
        move = "cast(conv(substring(sha2(concat(h, ':', i), 256), 1, 8), 16, 10) as bigint)"
        letters = lambda low, high: "".join(map(chr, range(ord(low), ord(high) + 1)))
        kinds = " ".join(f"when c between '{low}' and '{high}' then substring('{letters(low, high)}', cast(1 + (ascii(c) - {ord(low)} + {move}) % {ord(high) - ord(low) + 1} as int), 1)" for low, high in classes)
        return named(f"sha2(concat({key}, '|{use}|', t, '|', {mask}, '|', {other}), 256)", "h", f"array_join(transform(split({half}, ''), (c, i) -> case {kinds} else c end), '')")

    cut = f"(length({value}) div 2)"
    start = f"struct(substring({value}, 1, {cut}) as a, substring({value}, {cut} + 1) as b)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, t) -> case when t % 2 = 1 then struct({shifted('s.a', 's.b')} as a, s.b as b) else struct(s.a as a, {shifted('s.b', 's.a')} as b) end, s -> concat(s.a, s.b))"


def pseudonym(key: str, m: str = "m") -> str:
    """SQL: the pseudonym of a match, or the match itself if it is not valid."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    is_ = lambda name: f"regexp_like({m}, '^(?:{quoted(FORMATS[name])})$')"
    # Dates: the parts by form, a real day of the 400 years, its number permuted and printed in the same form.
    turned = f"(contains({m}, '/') and substring(d, 1, 2) > '12' and substring({m}, 3, 1) = '/')"
    printed = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d{2}\.": "dd.MM.yyyy"}
    form = "case " + " ".join(f"when regexp_like({m}, '{quoted(p)}') then '{f}'" for p, f in printed.items()) + f" when {turned} then 'dd/MM/yyyy' else 'MM/dd/yyyy' end"
    iso = f"case when regexp_like({m}, '^\\\\d{{4}}') then concat(substring(d, 1, 4), '-', substring(d, 5, 2), '-', substring(d, 7, 2)) when contains({m}, '/') and not {turned} then concat(substring(d, 5, 4), '-', substring(d, 1, 2), '-', substring(d, 3, 2)) else concat(substring(d, 5, 4), '-', substring(d, 3, 2), '-', substring(d, 1, 2)) end"
    zero = f"date'{FIRST_YEAR}-01-01'"
    day = f"datediff(try_cast({iso} as date), {zero})"
    big, low = DAY_HALVES[1], DAY_HALVES[0]
    step = lambda n: named(feistel(key, "date", f"{n} div {big}", f"{n} % {big}", (str(low), str(big))), "r", f"cast(r.a * {big} + r.b as int)")
    # A date goes on along its cycle until its day is of the same kind, over 12 or not.
    over = lambda x: f"(day(date_add({zero}, {x})) > 12)"
    walk = lambda steps, begin, body: f"aggregate(sequence(1, {steps}), {begin}, (x, i) -> case when {over('x')} <> {over('n')} then {body} else x end)"
    moved = walk(WALK[0], step("n"), walk(WALK[1], "x", step("x")))
    date = named(day, "n", f"case when n >= 0 and n < {DAYS} then date_format(date_add({zero}, {moved}), {form}) else {m} end")
    # Social security numbers: areas 1 to 899 but 666, groups 1 to 99, serials 1 to 9999.
    area, group, serial = "cast(substring(d, 1, 3) as int)", "cast(substring(d, 4, 2) as int)", "cast(substring(d, 6, 4) as int)"
    moved = feistel(key, "social", f"({area} - 1 - case when {area} > 666 then 1 else 0 end) * 99 + {group} - 1", f"{serial} - 1", (str(898 * 99), "9999"))
    back = "r.a div 99 + 1 + case when r.a div 99 + 1 >= 666 then 1 else 0 end"
    social = f"case when {area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0 then {named(moved, 'r', f'format_string({chr(39)}%03d-%02d-%04d{chr(39)}, {back}, r.a % 99 + 1, r.b + 1)')} else {m} end"
    # Addresses: two 16-bit halves.
    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as bigint)"
    moved = feistel(key, "address", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", ("65536", "65536"))
    address = named(moved, "r", "concat_ws('.', r.a div 256, r.a % 256, r.b div 256, r.b % 256)")
    # Cards: all digits but the last permuted, then the check digit of the new number.
    body = digits_permuted(key, "card", "substring(d, 1, length(d) - 1)")
    check = f"(10 - {luhn('concat(b, chr(48))')} % 10) % 10"
    card = f"case when {luhn('d')} % 10 = 0 and not regexp_like(d, '^0+$') then {named(body, 'b', refilled(m, f'concat(b, {check})'))} else {m} end"
    # Telephone numbers: the country code stays; 7 to 15 digits are valid.
    code = f"case when regexp_like({m}, '^[+]1[0-9]{{10}}$') or length(d) = 11 and regexp_like({m}, '^1[ .-]') then 1 else length(regexp_replace(regexp_extract({m}, '^([+][0-9]{{1,3}})[ .(-]', 1), '[^0-9]', '')) end"
    rest = named(f"substring(d, {code} + 1)", "p", named(national(key, "p"), "q", refilled(m, f"concat(substring(d, 1, length(d) - length(p)), q)")))
    phone = f"case when length(d) between 7 and 15 and length(d) - ({code}) >= 4 then {rest} else {m} end"
    mail = f"concat({characters_permuted(key, 'mail', f'substring_index({m}, {chr(39)}@{chr(39)}, 1)')}, substring({m}, instr({m}, '@')))"
    secret = f"case when regexp_like({m}, '^[0-9a-f]+$') then {characters_permuted(key, 'hex', m, ('af', '09'))} else {characters_permuted(key, 'secret', m, ('az', 'AZ', '09'))} end"
    return named(d, "d", f"case when contains({m}, '@') then {mail} when {is_('address')} then {address} when {is_('date')} then {date} when {is_('social')} then {social} when {is_('card')} then {card} when {is_('phone')} or {is_('pairs')} or {is_('plus')} then {phone} when length({m}) >= 16 and regexp_like({m}, '[A-Za-z]') then {secret} else {m} end")


def held(spark: SparkSession, key: str) -> DataFrame:
    """The key as a local table of one row, which plans show without its values."""
    values = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 1)
    values[0] = key
    rows = spark._jvm.java.util.ArrayList()
    rows.add(spark._jvm.org.apache.spark.sql.RowFactory.create(values))
    return DataFrame(spark._jsparkSession.createDataFrame(rows, spark._jvm.org.apache.spark.sql.types.StructType.fromDDL("key string")), spark)


def mask(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``found``, also a column of that name for the number of values that were replaced."""
    match, new, secret = (fresh(docs, n) for n in ("match", "new", "key"))
    pattern, own = quoted(ALL), f"`{text}`"
    out = docs.withColumn(secret, held(docs.sparkSession, key).scalar())
    out = out.withColumn(match, F.expr(f"case when regexp_like({own}, '{quoted(HINT)}') then regexp_extract_all({own}, '{pattern}', 0) else array() end"))
    out = out.withColumn(new, F.expr(f"transform({match}, m -> {pseudonym(secret)})"))
    between = f"split({own}, '{pattern}', -1)"
    joined = F.expr(f"case when size({match}) > 0 then array_join(transform({between}, (x, i) -> concat(x, coalesce(get({new}, i), ''))), '') else {own} end")
    columns = [joined.alias(c) if c.lower() == text.lower() else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    if found is not None:
        columns.append(F.expr(f"size(filter(sequence(0, size({match})), i -> coalesce(get({match}, i) <> get({new}, i), false)))").alias(found))
    return out.select(*columns)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_replaced."""
    return mask(docs.select("doc_id", "text"), key, found="n_replaced")
