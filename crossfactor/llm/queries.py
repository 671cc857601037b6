"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from crossfactor.llm import bpe, clustering, exact_dedup, inner_products, langid, minhash, packing, pii, quality, runs, sharding, token_files, toxicity
from crossfactor.llm.common import read_documents
from crossfactor.llm.vectors import STEPS, read_embeddings

#: The key of the pseudonyms; production sets its own.
PII_KEY = "crossfactor-test-key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(read_documents(spark, sf_dir))


ORACLE["op1_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""


@query
def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.balanced(16)
    return sharding.shard(read_documents(spark, sf_dir), tree, sharding.grow(tree))


def sharding_sql(tree: sharding.Tree, grown: sharding.Tree) -> str:
    """The tree of the query as DuckDB SQL: the draws of all nodes, the smallest at each level."""

    def draws(t: sharding.Tree, label: str) -> str:
        rows = []
        for i, g in enumerate(t.children):
            for j, k in enumerate(g.children):
                rows += [f"('{g.name}', {g.weight}, {i}, '{k.name}', {k.weight}, {j}, '{x.name}', {x.weight}, {m}, {x.shard})" for m, x in enumerate(k.children)]
        draw = "-ln((('0x' || substr(md5(key || ':' || {0}), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / {1}::DOUBLE"
        return f"""
{label}_tree(gn, gw, gi, kn, kw, ki, sn, sw, si, shard) AS (VALUES {", ".join(rows)}),
{label} AS (
  SELECT row, first(shard ORDER BY {draw.format("gn", "gw")}, gi, {draw.format("kn", "kw")}, ki, {draw.format("sn", "sw")}, si) AS shard
  FROM d, {label}_tree GROUP BY row
)"""

    def crc_step() -> str:
        """A byte's step of CRC-32: the table is linear, so the entries of the eight single bits do."""
        value, terms = 0xEDB88320, []
        for bit in range(7, -1, -1):  # bit 7 has the polynomial itself
            terms.append(f"((xor(a, b) >> {bit}) & 1) * {value}")
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        step = "a >> 8"
        for term in terms:
            step = f"xor({step}, {term})"
        return step

    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
{draws(tree, "now")},
{draws(grown, "later")},
o AS (
  SELECT d.doc_id, octet_length(encode(d.text)) + 1 AS size, now.shard, later.shard AS grown_shard,
         key,
         CASE WHEN d.text = '' THEN 0 ELSE xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(d.text)), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda a, b: {crc_step()})) END AS text_crc32
  FROM d JOIN now USING (row) JOIN later USING (row)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key || ':' || text_crc32 || ':' || size), 1, 8))::BIGINT % blocks, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM o, (SELECT greatest({sharding.SLOT_BLOCKS}, ceil(count(*) / {sharding.BLOCK_ROWS * len(tree.leaves())})::BIGINT) AS blocks FROM documents) c
"""


ORACLE["op4_hash_tree_sharding"] = sharding_sql(sharding.balanced(16), sharding.grow(sharding.balanced(16)))


@query
def op6_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classify(read_documents(spark, sf_dir))


@query
def op2_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_documents(spark, sf_dir))


def line_passes_sql(line: str) -> str:
    """The rules of ``quality.line_passes`` in DuckDB's words."""
    like = lambda pattern: f"regexp_matches({line}, '{pattern.replace(chr(39), chr(39) * 2)}')"
    hits = lambda pattern: f"len(regexp_extract_all({line}, '{pattern}'))"
    return f"""{like(quality.TERMINAL)} AND 20 * {hits(quality.SYMBOL)} <= length({line}) AND {hits(quality.SHOUT)} < 3
        AND 2 * {hits(chr(92) + "p{Lu}")} <= length({line}) AND {hits(quality.NAVIGATION)} < 3 AND NOT {like(quality.BOILERPLATE)}"""


ORACLE["op3_line_quality"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{quality.WORD}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{quality.WORD}')) AS lines
  FROM documents
), win AS (
  SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, g) > 1
), cov AS (
  SELECT row, count(DISTINCT i + j) AS n FROM rep, range(3) r(j) GROUP BY row
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(list_append(w, ''), 'string_agg', ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{quality.SYMBOL}'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0) AS chars,
         coalesce(list_sum(list_transform(list_filter(lines, lambda l: {line_passes_sql("l")}), lambda l: length(l))), 0) AS good
  FROM d LEFT JOIN cov USING (row)
), b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND chars - good <= {quality.MAX_LOST} * chars AS kept
FROM b
"""


@query
def op8_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read_documents(spark, sf_dir))


@query
def op9_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op5_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_documents(spark, sf_dir), PII_KEY)


@query
def op11_weighted_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.label(read_embeddings(spark, sf_dir))


def integers_sql(components: int | None) -> str:
    """Vectors without null or non-finite components, as integers."""
    length = f" AND len(embedding) = {components}" if components else ""
    return f"""
  SELECT vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true){length}"""


def clustering_sql(clusters: int, rounds: int, components: int) -> str:
    """Lloyd rounds as chained subqueries: the first nearest centroid, then exact floors of means."""
    apart = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    parts = [
        f"d AS ({integers_sql(components)}), e AS (SELECT *, row_number() OVER () AS row FROM d)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS k, v AS c FROM e QUALIFY k < {clusters})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT row, vec_id, v, k, {apart} AS distance FROM e, c{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, k) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {components + 1}) r(j) GROUP BY k, j)")
            parts.append(f"m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, k::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


ORACLE["op11_weighted_clustering"] = clustering_sql(clustering.CLUSTERS, clustering.ROUNDS, clustering.COMPONENTS)


@query
def op12_norm_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.search(read_embeddings(spark, sf_dir))


ORACLE["op12_norm_sorted_search"] = f"""
WITH d AS ({integers_sql(None)}), e AS (SELECT *, row_number() OVER () AS row FROM d),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM e q JOIN e c ON q.row <> c.row WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(read_documents(spark, sf_dir))
