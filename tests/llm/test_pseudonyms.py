"""Pseudonyms against a Feistel network in plain Python, and the links of dates over all their forms."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re

from pyspark.sql import functions as F

from crossfactor.llm import pii

KEY = "k"
ZERO = dt.date(1800, 1, 1)


def digest(*parts, digits=15):
    return int(hashlib.sha256("".join(map(str, parts)).encode()).hexdigest()[:digits], 16)


def feistel(use, a, b, sizes):
    for t in range(1, pii.ROUNDS + 1):
        if t % 2:
            a = (a + digest(KEY, "|", use, "|", t, "|", b) % sizes[0]) % sizes[0]
        else:
            b = (b + digest(KEY, "|", use, "|", t, "|", a) % sizes[1]) % sizes[1]
    return a, b


def moved_day(day):
    n = (day - ZERO).days
    step = lambda x: (lambda r: r[0] * 773 + r[1])(feistel("date", *divmod(x, 773), (189, 773)))
    late = lambda x: (ZERO + dt.timedelta(x)).day > 12
    x = step(n)
    while late(x) != late(n):
        x = step(x)
    return ZERO + dt.timedelta(x)


def digits(use, text):
    cut = len(text) // 2
    a, b = feistel(f"{use}{len(text)}", int(text[:cut]), int(text[cut:]), (10**cut, 10 ** (len(text) - cut)))
    return f"{a:0{cut}d}{b:0{len(text) - cut}d}"


def luhn(text):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(text)))


def card(text):
    body = digits("card", text[:-1])
    return body + str(-luhn(body + "0") % 10)


def social(text):
    area, group, serial = map(int, text.split("-"))
    a, b = feistel("social", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, (898 * 99, 9999))
    area = a // 99 + 1
    return f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def address(text):
    a, b, c, d = map(int, text.split("."))
    x, y = feistel("address", a * 256 + b, c * 256 + d, (65536, 65536))
    return ".".join(map(str, (*divmod(x, 256), *divmod(y, 256))))


def national(text):
    """Ten digits with an area code and an exchange of 200 and more."""
    n = ((int(text[:3]) - 200) * 800 + int(text[3:6]) - 200) * 10000 + int(text[6:])
    a, b = feistel("phone800", *divmod(n, 80_000), (80_000, 80_000))
    n = a * 80_000 + b
    return f"{n // 8_000_000 + 200:03d}{n // 10000 % 800 + 200:03d}{n % 10000:04d}"


def characters(use, text, classes):
    def shifted(half, other, t):
        mask = half
        for low, high in classes:
            mask = re.sub(f"[{low}-{high}]", low, mask)
        h = hashlib.sha256(f"{KEY}|{use}|{t}|{mask}|{other}".encode()).hexdigest()
        out = []
        for i, c in enumerate(half):
            for low, high in classes:
                if low <= c <= high:
                    c = chr(ord(low) + (ord(c) - ord(low) + digest(h, ":", i, digits=8)) % (ord(high) - ord(low) + 1))
                    break
            out.append(c)
        return "".join(out)

    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for t in range(1, pii.ROUNDS + 1):
        a, b = (shifted(a, b, t), b) if t % 2 else (a, shifted(b, a, t))
    return a + b


def masked(spark, texts):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), KEY).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_against_plain_python(spark):
    rng = random.Random(8)
    given, wanted = [], []

    def add(text, new):
        given.append(f"a {text} b")
        wanted.append(f"a {new} b")

    for _ in range(60):
        day = ZERO + dt.timedelta(rng.randrange(146_097))
        add(day.isoformat(), moved_day(day).isoformat())
        body = "".join(rng.choices("0123456789", k=15))
        number = body + str(-luhn(body + "0") % 10)
        add(number, card(number))
        code = f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        add(code, social(code))
        place = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        add(place, address(place))
        phone = f"{rng.randint(200, 999)}{rng.randint(200, 999)}{rng.randint(0, 9999):04d}"
        new = national(phone)
        add(f"{phone[:3]}-{phone[3:6]}-{phone[6:]}", f"{new[:3]}-{new[3:6]}-{new[6:]}")
        add(f"1-{phone[:3]}-{phone[3:6]}-{phone[6:]}", f"1-{new[:3]}-{new[3:6]}-{new[6:]}")
        add(f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}", f"+1 ({new[:3]}) {new[3:6]}-{new[6:]}")
        name = "".join(rng.choices("abzAZ059._jörgÉяΣ日", k=rng.randint(1, 12)))
        add(f"{name}@example.com", f"{characters('mail', name, pii.CLASSES)}@example.com")
        secret = "".join(rng.choices("abcXYZ012+/_", k=rng.randint(17, 40))) + "Q"
        add(f"token={secret}", f"token={characters('secret', secret, ('az', 'AZ', '09'))}")
        key = "".join(rng.choices("0123456789abcdef", k=32)) + "f"
        add(f"api_key: {key}", f"api_key: {characters('hex', key, ('af', '09'))}")
    assert masked(spark, given) == wanted


FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def test_a_day_has_one_pseudonym_in_every_form(spark):
    """All days of the 400 years in all forms; a day up to the 12th, day first with slashes, reads as another day."""
    days = spark.range(146_097).withColumn("day", F.expr("date_add(date'1800-01-01', cast(id as int))"))
    texts = days.select(F.concat_ws(" ", *(F.date_format("day", f) for f in FORMS)).alias("text"), F.col("id").alias("doc_id"), "day").repartition(4)
    got = pii.mask(texts, KEY).select("day", *(F.to_date(F.split("text", " ")[i], f).alias(f"d{i}") for i, f in enumerate(FORMS)))
    late = F.dayofmonth("day") > 12
    agree = (F.col("d0") == F.col("d1")) & (F.col("d0") == F.col("d2")) & (F.col("d0") == F.col("d3")) & (~late | (F.col("d0") == F.col("d4"))) & (late == (F.dayofmonth("d0") > 12))
    row = got.agg(F.count_if(agree).alias("agree"), F.count_distinct("d0").alias("distinct"), F.count("*").alias("all")).first()
    assert (row.agree, row.distinct, row["all"]) == (146_097,) * 3


def test_secrets_of_any_length(spark):
    long = "x1" * 40_000
    text, short = masked(spark, [f"password = {long} end", "password = short end"])
    assert len(text) == len(f"password = {long} end") and long[:50] not in text and text.endswith(" end") and short == "password = short end"
