"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of the summed weights of its
hashed words and word beginnings, which inflected words share; a document's is the noisy-or of its sentences. The weights are learned from document
labels alone, by Adam on the document likelihood, in one task over a documented sample of
labelled rows, bounded in rows and bytes, and are broadcast: their size is fixed by ``BUCKETS``. Up to half of
the sample is toxic, and rows count by the inverse of their class's share in it, so that scores keep the labels' rate.
The learned sentence scores then say which sentences offend.

Defined results: null and empty texts have no sentences and get the score of one empty sentence; null
ids count as held out; ids that repeat in the labels count once, toxic if any row says so, and of documents that
share a labelled id the smallest text is learned from; texts longer than ``TEXT_BYTES`` are scored, whole, but not
learned from; repeated rows get the same score each; an empty table gives no rows; with no labelled rows all
scores are 0; other columns are ignored, whatever their names; there are no ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import text_or_empty, tidy, working_tables, written
from crossfactor.llm.hashing import U64, byte_spans, slices, span_hashes
from crossfactor.llm.langid import held_out

BITS = 20
BUCKETS = 1 << BITS
#: Bytes of the word beginnings that are features too.
STEMS = (4, 5, 6, 7)
#: Labelled rows to learn from, about, and the bytes of their texts: hashes of ids take that share of them. No longer text than ``TEXT_BYTES`` is among them.
SAMPLE_ROWS, SAMPLE_BYTES, TEXT_BYTES = 10_000, 32 << 20, 1 << 20
THRESHOLD = 0.3
STEPS, RATE, DECAY = 60, 0.1, 0.2
#: Share of the sample's documents that must hold a word for it to get a weight, and two documents at least: the others could only be learned by heart.
MIN_SHARE = 0.001

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), 39, *range(128, 256)]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?\n")] = True


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sentence of each word; text, begin and end (bytes in the text) of each sentence with a word."""
    data, starts = byte_spans(texts)
    data = LOWER[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], WORD[data], [False]))))
    begin, end = edge[::2], edge[1::2]
    stop = STOP[data]
    stop[starts[1:] - 1] = True  # the space that closes each text
    stop[-1:] = True
    ends = np.flatnonzero(stop)
    place = np.searchsorted(ends, begin)
    with_words, sentence = np.unique(place, return_inverse=True)
    last = ends[with_words]
    owner = np.searchsorted(starts, last, "right") - 1
    first = begin[np.flatnonzero(np.diff(np.concatenate(([-1], sentence))))] if len(sentence) else np.zeros(0, np.int64)
    stems = [begin.size * [True]] + [end - begin > k for k in STEMS]
    spans = [(begin, end, sentence)] + [(begin[m], begin[m] + k, sentence[m]) for k, m in zip(STEMS, stems[1:], strict=True)]
    begins, stops, places = (np.concatenate(x) for x in zip(*spans, strict=True))
    bucket = (span_hashes(data, begins, stops) >> U64(64 - BITS)).astype(np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return bucket, places.astype(np.int32), owner, first - starts[owner], np.minimum(last + 1 - starts[owner], sizes[owner])


def frequent(bags: list[tuple]) -> np.ndarray:
    """Which buckets enough documents hold."""
    held = np.zeros(BUCKETS, np.int32)
    for bucket, sentence, owner, _ in bags:
        held += np.bincount(np.unique(owner[sentence].astype(np.int64) * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS).astype(np.int32)
    return held >= max(2, MIN_SHARE * sum(b[3] for b in bags))


def logistic(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def learn(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], labels: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Weights by bucket and, last, the bias. Each bag: buckets, sentences, owners and number of texts of a slice. ``worth`` says how much each text counts."""
    often = frequent(bags)
    kept = [often[b[0]] for b in bags]
    shift_s, shift_t = np.cumsum([0, *(len(b[2]) for b in bags)]), np.cumsum([0, *(b[3] for b in bags)])
    bucket = np.concatenate([b[0][k] for b, k in zip(bags, kept, strict=True)])
    sentence = np.concatenate([b[1][k] + int(n) for b, k, n in zip(bags, kept, shift_s, strict=False)])
    owner = np.concatenate([b[2] + n for b, n in zip(bags, shift_t, strict=False)])
    texts, count = int(shift_t[-1]), len(owner)
    weights = np.zeros(BUCKETS + 1)
    weights[-1] = -6.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    toxic, worth = labels.astype(bool), worth / worth.mean()
    for step in range(1, STEPS + 1):
        z = weights[-1] + np.bincount(sentence, weights[bucket], minlength=count)
        mass = np.bincount(owner, np.logaddexp(0, z), minlength=texts)  # -log of the chance that no sentence offends
        none = np.exp(-mass)
        slope = worth * np.where(toxic, -none / np.maximum(1 - none, 1e-12), 1.0)
        by_sentence = slope[owner] * logistic(z) / texts
        gradient = np.append(np.bincount(bucket, by_sentence[sentence], minlength=BUCKETS), by_sentence.sum())
        gradient[:-1] += DECAY / texts * weights[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights.astype(np.float32)


@tidy()
def trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bags, labels, worth = [], [], []
    for batch in batches:
        texts = batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
        worth += batch.column(2).to_pylist()
        for begin, end in slices(texts):
            bucket, sentence, owner, _, _ = sentences(texts[begin:end])
            bags.append((bucket, sentence, owner, end - begin))
    if labels:
        yield pa.RecordBatch.from_arrays([pa.array([learn(bags, np.array(labels), np.array(worth)).tobytes()])], names=["weights"])


def share(rate: Column | float, *names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(1 << 40)) < F.lit(float(1 << 40)) * rate


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Weights from the labelled rows that are not held out."""
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(4, 2) & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("__of")).agg(F.max("toxic").cast("int").alias("__toxic"))
    toxic, clean = marks.agg(F.coalesce(F.sum("__toxic"), F.lit(0)), F.count_if(F.col("__toxic") == 0)).first()
    taken = min(toxic, sample_rows // 2)
    rates = F.when(F.col("__toxic") == 1, F.lit(taken / max(toxic, 1))).otherwise(F.lit(min(1.0, (sample_rows - taken) / max(clean, 1))))
    # About ``sample_rows`` rows of 16 bytes: a proven bound, so the documents stay where they are and only the sample moves.
    marks = F.broadcast(marks.withColumn("__rate", rates).where(share(F.col("__rate"), "__of")))
    own = docs.where(F.octet_length(text_or_empty()) <= TEXT_BYTES).select(F.col("doc_id").alias("__of"), text_or_empty().cast("binary").alias("__text")).join(marks, "__of")
    own = own.groupBy("__of").agg(F.min("__text").alias("__text"), F.first("__toxic").alias("__toxic"), (1 / F.first("__rate")).alias("__worth"))
    with working_tables(docs.sparkSession):
        own = written(own, "toxicity-sample")
        size = own.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
        if size > SAMPLE_BYTES:
            own = own.where(share(SAMPLE_BYTES / size, "__text", "__of"))
        rows = own.repartition(1).sortWithinPartitions("__of").select("__text", "__toxic", "__worth").mapInArrow(trainer, "weights binary").collect()
    return np.frombuffer(rows[0][0], np.float32) if rows else None


def score(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text, and its offending sentences: begin, end (bytes) and score."""
    bucket, sentence, owner, begin, end = sentences(texts)
    z = float(weights[-1]) + np.bincount(sentence, weights[bucket], minlength=len(owner))
    mass = np.bincount(owner, np.logaddexp(0, z), minlength=len(texts)).astype(float)
    mass[np.bincount(owner, minlength=len(texts)) == 0] = np.logaddexp(0, float(weights[-1]))
    found: list[list[dict]] = [[] for _ in texts]
    chance = logistic(z)
    for i in np.flatnonzero(chance >= THRESHOLD):
        found[owner[i]].append({"begin": int(begin[i]), "end": int(end[i]), "score": float(chance[i])})
    return 1 - np.exp(-mass), found


OFFENDING = "array<struct<begin: int, end: int, score: double>>"
OFFENDING_ARROW = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scorer(shared):
    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in slices(texts):
                chance, found = score(texts[begin:end], shared.value)
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(chance), pa.array((chance >= THRESHOLD).astype(np.int32)), pa.array(found, OFFENDING_ARROW)], names=["doc_id", "held_out", "score", "predicted", "offending"])

    return run


def predict(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, offending sentences."""
    weights = fit(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), text_or_empty().cast("binary").alias("__text"))
    if weights is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(OFFENDING).alias("offending"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return rows.mapInArrow(scorer(shared), f"doc_id long, held_out boolean, score double, predicted int, offending {OFFENDING}")
