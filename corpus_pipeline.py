"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written
as Parquet to the shared folder and read again, and the table before it is removed. All stages but the last return
the columns of ``documents``; the last returns the packed pieces.

Defined results: null, empty and letterless texts have no language and go first; documents with null or repeated
ids are judged by their own row and text; of equal texts one row stays; texts of any length are taken whole; other
columns, whatever their names, pass through; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm import exact_dedup, langid, minhash, packing, pii
from crossfactor.llm.common import read_documents, remove, shared_folder, working_tables
from crossfactor.llm.queries import PII_KEY

#: Documents go whose language is unknown, less sure than this, or makes their 3-grams less likely than chance by more than a factor e on average (STRANGE).
SURE = 0.5
#: Names and keys in a short text alone take it a little below 0.
STRANGE = -1.0
#: Setting of the session with the key of the pseudonyms; Spark redacts settings of such names.
KEY_SETTING = "crossfactor.pii.secret"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.spoken(docs, SURE, STRANGE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs, spark.conf.get(KEY_SETTING, PII_KEY))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_private),
    ("packing", pack),
]

#: SQL cannot express hashed n-gram models, ProbMinHash or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_documents(spark, sf_dir), None
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with working_tables(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
