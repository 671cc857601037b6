"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1-, 2- and 3-grams of the lower-cased text, other characters than letters as one space, are
taken on a documented, bounded sample of the labelled rows and summed by language and hash
bucket in Spark; the log-probability matrix, languages by buckets, is broadcast: its size is bounded by
``BUCKETS`` and ``MAX_LANGUAGES``. Scoring sums its rows over a text's n-grams, a slice of texts at a time, in numpy.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all if nothing
could be learned; null ids count as held out; repeated rows get the same verdict each; an empty table gives
no rows; a long text is scored in windows, with the same sums; of equally likely languages the first by name
wins; other columns are ignored by ``predict``, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import fresh, sampled, text_or_empty, tidy

BITS = 16
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
SMOOTHING = 0.1
#: Labelled rows to learn from, about: a hash of the id takes that share of them.
SAMPLE_ROWS = 30_000
#: 3-grams, spaces around the text included, under which a text is too short to be none of the languages.
JUDGED = 32
UNKNOWN = "und"
#: Languages that a model may have, as the matrix of a quarter megabyte each is broadcast: more raise.
MAX_LANGUAGES = 256
#: Characters that are scored at a time.
WINDOW = 1 << 18

letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    if not letters:
        letters.append(np.fromiter((c if chr(c).isalpha() else 32 for c in range(sys.maxunicode + 1)), np.uint32, sys.maxunicode + 1))
    return letters[0]


def windows(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Runs of about ``WINDOW`` characters: text number, characters, and how many of them begin n-grams of the window.

    A text begins with a space; what follows a window's own characters is the text's next ones.
    """
    run, held, ahead = [], 0, max(SIZES) - 1
    for i, text in enumerate(texts):
        lowered = " " + text.lower()
        for at in range(0, len(lowered), WINDOW):
            own = min(WINDOW, len(lowered) - at)
            if run and held + own > WINDOW:
                yield run
                run, held = [], 0
            run.append((i, lowered[at : at + own + ahead], own))
            held += own
    if run:
        yield run


def grams(run: list[tuple[int, str, int]]) -> Iterator[np.ndarray]:
    """For each n-gram size the hash buckets of all windows' n-grams, in order."""
    gap = " " * (max(SIZES) - 1)
    points = letter_table()[np.frombuffer((gap.join(t for _, t, _ in run) + gap).encode("utf-32-le", "replace"), "<u4")]
    sizes = np.fromiter((len(t) + len(gap) for _, t, _ in run), np.int64, len(run))
    own = np.fromiter((n for _, _, n in run), np.int64, len(run))
    begins = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(own, sizes)
    with np.errstate(over="ignore"):
        for size in SIZES:
            mixed = np.full(len(points), 0x811C9DC5 + size, np.uint32)
            for j in range(size):
                mixed[: len(points) - j] = (mixed[: len(points) - j] ^ points[j:]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            yield ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))[begins]


@tidy()
def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, bucket, n) rows, summed within the batch; bucket -1 counts documents."""
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            total = np.zeros(BUCKETS, np.int64)
            for run in windows(own):
                for buckets in grams(run):
                    total += np.bincount(buckets, minlength=BUCKETS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], len(own)))], names=["lang", "bucket", "n"])


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, log-probabilities (languages by buckets) and log-priors, from the rows that are not held out."""
    own = docs.where(~held_out(5, 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rate = sample_rows / max(own.count(), 1)
    if rate < 1:
        own = own.where(sampled(rate))
    counts = own.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most BUCKETS + 1 rows a language
    names = sorted(set(found["lang"].to_pylist()))
    if not names:
        return None
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES}")
    lang = np.searchsorted(names, found["lang"].to_pylist())
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    table, rows = np.full((len(names), BUCKETS), SMOOTHING), np.zeros(len(names))
    table[lang[bucket >= 0], bucket[bucket >= 0]] += n[bucket >= 0]
    rows[lang[bucket < 0]] = n[bucket < 0]
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32), np.log(rows / rows.sum())


def score(texts: list[str], table: np.ndarray, priors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its posterior probability, and its mean log-probability of the longest n-grams over that of a uniform bucket (0 for short texts), for each text."""
    total = np.tile(priors, (len(texts), 1))
    longest, count = np.zeros_like(total), np.zeros(len(texts))
    for run in windows(texts):
        owner, own = (np.array([w[k] for w in run], np.int64) for k in (0, 2))
        starts = np.cumsum(own) - own
        np.add.at(count, owner, own)
        for size, buckets in zip(SIZES, grams(run), strict=True):
            for k, row in enumerate(table):
                part = np.add.reduceat(row[buckets], starts, dtype=np.float64)
                np.add.at(total[:, k], owner, part)
                if size == max(SIZES):
                    np.add.at(longest[:, k], owner, part)
    best = total.argmax(axis=1)
    like = np.where(count < JUDGED, 0.0, longest[np.arange(len(texts)), best] / count + np.log(BUCKETS))
    return best, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), like


def predictor(model):
    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, priors = model.value
        for batch in batches:
            texts, known = batch.column(2).to_pylist(), np.array(batch.column(3).to_pylist(), bool)
            best, sure, like = score(texts, table, priors)
            langs = np.where(known, np.array(names, object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(np.where(known, sure, 0.0)), pa.array(like)], names=["doc_id", "held_out", "lang_pred", "score", "likeness"])

    return run


def letters_in() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def likened(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``predict`` with the column likeness: mean log-probability of its 3-grams in the language found, over chance; well below 0, the text is in none of those learned."""
    model = fit(docs, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), text_or_empty().alias("__text"), letters_in().alias("__known"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("likeness"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double, likeness double")


def predict(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    return likened(docs, sample_rows).drop("likeness")


def spoken(docs: DataFrame, sure: float, strange: float, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, with all their columns, whose language is found with a score of at least ``sure`` and a likeness of at least ``strange``.

    A document's verdict is that of its own row: nothing is joined, and null, repeated or clashing names change nothing.
    """
    model = fit(docs, sample_rows)
    if model is None:
        return docs.where("false")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, known = docs.columns.index(next(c for c in docs.columns if c.lower() == "text")), len(docs.columns)

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, priors = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            _, found, like = score(texts, table, priors)
            keep = np.array(batch.column(known).to_pylist(), bool) & (found >= sure) & (like >= strange)
            yield batch.filter(pa.array(keep)).select(list(range(known)))

    return docs.withColumn(fresh(docs, "letters"), letters_in()).mapInArrow(run, docs.schema)
