"""Language and toxicity models against plain Python, and the whole pipeline."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib
from pathlib import Path

import pytest
from test_operators import ROWS, SCHEMA, prose

from crossfactor.llm import langid, toxicity

SYLLABLES = {"en": ("tion", "er", "an", "the"), "de": ("ung", "sch", "ein", "ß"), "el": ("ος", "ική", "και", "ω")}


def gram_hash(points, size):
    mixed = 0x811C9DC5 + size
    for p in points:
        mixed = (mixed ^ p) * 0x9E3779B1 & 0xFFFFFFFF
        mixed ^= mixed >> 15
    return (mixed * 0x85EBCA6B & 0xFFFFFFFF) >> 16


def gram_counts(text):
    points = [ord(c) if c.isalpha() else 32 for c in " " + text.lower()] + [32, 32]
    return collections.Counter(gram_hash(points[i : i + n], n) for n in (1, 2, 3) for i in range(len(points) - 2))


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def bayes(rows):
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for i, text, lang in rows:
        if not held_out(i, 5, 0) and lang is not None and text is not None:
            counts[lang] += gram_counts(text)
            docs[lang] += 1
    sums = {g: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for g, c in counts.items()}
    out = []
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            out.append((i, held_out(i, 5, 0), "und", 0.0))
            continue
        own = gram_counts(text)
        total = {g: math.log(docs[g] / sum(docs.values())) + sum(n * math.log((c[b] + langid.SMOOTHING) / sums[g]) for b, n in own.items()) for g, c in counts.items()}
        best = min(total, key=lambda g: (-total[g], g))
        out.append((i, held_out(i, 5, 0), best, 1 / sum(math.exp(t - total[best]) for t in total.values())))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2:]))


def test_language_against_plain_python(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, prose(rng.randint(1, 40), i, SYLLABLES[(lang := rng.choice(list(SYLLABLES)))]), lang) for i in range(90)]
    rows += [(90, "ein the και", None), (91, None, "en"), (92, "", "de"), (93, "12 ... 7", "el"), (None, "the tion an er", "en"), (None, None, "en"), (5, rows[5][1], rows[5][2]), (94, "a", None), (95, "the " * 500 + "\x00\U0001f600É", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    wanted = order(bayes(rows))
    for window in (langid.WINDOW, 7):
        monkeypatch.setattr(langid, "WINDOW", window)
        got = order(tuple(r) for r in langid.predict(docs).collect())
        assert [g[:3] for g in got] == [w[:3] for w in wanted]
        assert max(abs(g[3] - w[3]) for g, w in zip(got, wanted, strict=True)) < 1e-3


def bag(text):
    """The features of each sentence with a word: its words and their beginnings."""
    out = []
    for part in re.split(rb"[.!?\n]", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())):
        words = re.findall(rb"[0-9a-z'\x80-\xff]+", part)
        if words:
            out.append([*words, *(w[:k] for k in toxicity.STEMS for w in words if len(w) > k)])
    return out


def noisy_or(rows, labels):
    marks = collections.defaultdict(int)
    for i, toxic in labels:
        if i is not None and toxic is not None and not held_out(i, 4, 2):
            marks[i] |= toxic
    texts = {}
    for i, text in rows:
        if i in marks:
            texts[i] = min(texts.get(i, text or ""), text or "", key=str.encode)
    bags, toxic = [bag(texts[i]) for i in texts], [marks[i] for i in texts]
    held = collections.Counter(f for b in bags for f in {f for s in b for f in s})
    often = {f for f, n in held.items() if n >= max(2, toxicity.MIN_SHARE * len(bags))}
    bags = [[[f for f in s if f in often] for s in b] for b in bags]
    weight, first, second, bias = dict.fromkeys(often, 0.0), collections.defaultdict(float), collections.defaultdict(float), -6.0
    soft = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0.0)
    logistic = lambda z: math.exp(-soft(-z))
    for step in range(1, toxicity.STEPS + 1):
        slopes, total = dict.fromkeys(often, 0.0), 0.0
        for b, mark in zip(bags, toxic, strict=True):
            z = [bias + sum(weight[f] for f in s) for s in b]
            none = math.exp(-sum(map(soft, z)))
            slope = -none / max(1 - none, 1e-12) if mark else 1.0
            for s, v in zip(b, z, strict=True):
                part = slope * logistic(v) / len(bags)
                total += part
                for f in s:
                    slopes[f] += part
        for f in (*often, None):
            g = total if f is None else slopes[f] + toxicity.DECAY / len(bags) * weight[f]
            first[f] = 0.9 * first[f] + 0.1 * g
            second[f] = 0.99 * second[f] + 0.01 * g * g
            move = toxicity.RATE * (first[f] / (1 - 0.9**step)) / (math.sqrt(second[f] / (1 - 0.99**step)) + 1e-8)
            if f is None:
                bias -= move
            else:
                weight[f] -= move
    out = []
    for i, text in rows:
        z = [bias + sum(weight.get(f, 0.0) for f in s) for s in bag(text or "")] or [bias]
        out.append((i, held_out(i, 4, 2), 1 - math.exp(-sum(map(soft, z))), sum(logistic(v) >= toxicity.THRESHOLD for v in z) if bag(text or "") else 0))
    return out


def test_toxicity_against_plain_python(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(120):
        toxic = rng.random() < 0.3
        parts = [prose(rng.randint(2, 8), 1000 * i + k).rstrip(".") for k in range(rng.randint(1, 5))]
        if toxic:
            parts[rng.randrange(len(parts))] += rng.choice((" you stupid fool", " Idiots like them", " shut up, idiot"))
        rows.append((i, rng.choice((". ", "\n", "! ")).join(parts)))
        labels.append((i, int(toxic)))
    rows += [(120, None), (121, ""), (None, "idiot."), (3, "another text"), (4, rows[4][1]), (122, "ÉÀ Idiot?! " * 3)]
    labels += [(3, 1), (None, 1), (119, None), (500, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = order((r.doc_id, r.held_out, round(r.score, 4), r.predicted, len(r.offending)) for r in toxicity.predict(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect())
    wanted = order((i, h, round(s, 4), int(s >= toxicity.THRESHOLD), n) for i, h, s, n in noisy_or(rows, labels))
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in wanted]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, wanted, strict=True)) < 2e-3
    assert sum(g[3] for g in got) > 20 and any(g[1] and g[3] for g in got)


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_whole_pipeline(pipeline, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "shared_folder", lambda _: str(tmp_path))
    rows = [(i, t, "de" if i == 14 else "en", f"s{(i or 0) % 3}", None if t is None else len(t), "clash", 1) for i, t in ROWS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    packed = pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == spark.createDataFrame([], SCHEMA).columns
    alone = pipeline.pack(spark, docs, str(tmp_path)).collect()
    pieces = lambda found: sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert pieces(packed) == pieces(alone) and {r.doc_id for r in packed} >= {6, 10, 14, None} and not {r.doc_id for r in packed} & {7, 8, 9, 15}
    for sequence in {r.sequence_id for r in packed}:
        own = sorted((r.offset, r.length) for r in packed if r.sequence_id == sequence)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    left = sorted(p.name for run in Path(tmp_path).glob("run-*") for p in run.iterdir() if not p.name.startswith("."))
    assert left == ["pii"]  # what the last stage reads lazily


def test_pipeline_on_an_empty_table(pipeline, spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
