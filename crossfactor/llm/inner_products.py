"""Exact top-k search by inner product: vectors in descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become integers and are dealt by range into blocks of descending length; queries, every row whose id a number
divides, are dealt the same way. The rotation is the eigenvectors of the Gram matrix of all vectors, so the first components
of rotated vectors carry most of their length. Rounds go over the blocks of candidates in order, four times as many
blocks each, and a task takes one block of queries with one of candidates, both of a bounded size. It goes down its
candidates slice by slice: a query is through with a slice, and all after it, once its length times the slice's
largest is under its k-th score so far; of the rest, pairs whose partial sum over the first components, plus the product of
the remaining lengths, is under that score fall out, twice, and only what is left is scored, in integers.
Bounds are floating-point with a margin well above its error, so nothing falls out that belongs in. A round's best rows give
each query the score to beat in the next; pairs of blocks that can't reach it are not dealt.

Pairs are never joined or emitted but for the k best of a task. Equal lengths don't gather, as rows are ranged by length and row.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as filled up
with zeros; an empty vector scores 0; a null ``vec_id`` is no query, and as a candidate comes last among equal scores; each of
repeated rows is a query and a candidate of the others; a query with fewer candidates than k has fewer rows; an
empty table gives no rows; other columns are ignored, whatever their names. Components beyond 2,097,152 in size raise, and so
do vectors so long that a score may not fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfactor.llm.common import sized, tidy, written
from crossfactor.llm.vectors import matrix, quantised, valid

#: Rows of a block of candidates and of queries; candidates of a slice; pairs that are scored at a time.
BLOCK, QUERIES, SLICE, PAIRS = 4096, 4096, 256, 1 << 15
#: Blocks of a round, as a multiple of those of the one before.
GROWTH = 4
#: Share of the product of two lengths by which a bound may be wrong: far more than rounding errors of thousands of components.
MARGIN = 1e-9
NONE = np.iinfo(np.int64).min

FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"
FOUND_ARROW = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def gramming(width: int):
    """A task's sums of products of two components: i, j (i <= j), value. Floating-point, as only the rotation comes of it."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            own = matrix(batch.column(0), width).astype(float)
            total += own.T @ own
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(total[i, j])})

    return run


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Columns: the right singular vectors of all rows, the largest singular value first. ``width`` squared values reach the driver."""
    gram = np.zeros((width, width))
    for r in rows.select("vector").mapInArrow(gramming(width), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        gram[r.i, r.j] = gram[r.j, r.i] = r.value
    return np.linalg.eigh(gram)[1][:, ::-1]


@dataclass
class Side:
    """Integer vectors, what they are rotated to, and the lengths of the rest after each cut."""

    whole: np.ndarray
    turned: np.ndarray
    rests: list[np.ndarray]

    @classmethod
    def of(cls, whole: np.ndarray, turn: np.ndarray, cuts: list[int]) -> Side:
        turned = whole @ turn
        return cls(whole, turned, [np.sqrt((turned[:, c:] ** 2).sum(axis=1)) for c in (0, *cuts)])


def beating(queries: Side, candidates: Side, goal: np.ndarray, cuts: list[int], live: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate of the slice) that the partial sums leave to be scored."""
    lengths, theirs = queries.rests[0][live], candidates.rests[0][part]
    slack = MARGIN * np.outer(lengths, theirs) + 0.5
    product = queries.turned[live, : cuts[0]] @ candidates.turned[part, : cuts[0]].T
    bound = product + np.outer(queries.rests[1][live], candidates.rests[1][part]) + slack
    q, c = np.nonzero(bound >= goal[live][:, None])
    sums, room = product[q, c], slack[q, c]
    for step in range(1, len(cuts)):
        low, high = cuts[step - 1 : step + 1]
        use = np.zeros(len(q), bool)
        for at in range(0, len(q), PAIRS):
            some = slice(at, at + PAIRS)
            i, j = live[q[some]], part.start + c[some]
            sums[some] += np.einsum("ij,ij->i", queries.turned[i, low:high], candidates.turned[j, low:high])
            use[some] = sums[some] + queries.rests[step + 1][i] * candidates.rests[step + 1][j] + room[some] >= goal[i]
        q, c, sums, room = q[use], c[use], sums[use], room[use]
    return live[q], part.start + c


def best(queries: Side, candidates: Side, goal: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the candidates, which descend in length, for each query with scores of ``goal`` or more: query, candidate, score.

    ``own`` and ``rows`` are the row numbers of both sides: a row is no candidate of its own. ``ids`` order equal scores.
    """
    goal, held = goal.copy(), tuple(np.zeros(0, np.int64) for _ in range(3))
    for begin in range(0, len(rows), SLICE):
        part = slice(begin, min(begin + SLICE, len(rows)))
        reach = queries.rests[0] * candidates.rests[0][begin] * (1 + MARGIN) + 0.5
        live = np.flatnonzero(reach >= goal)
        if not len(live):
            break
        q, c = beating(queries, candidates, goal, cuts, live, part)
        use = own[q] != rows[c]
        q, c = q[use], c[use]
        score = np.concatenate([*(np.einsum("ij,ij->i", queries.whole[q[a : a + PAIRS]], candidates.whole[c[a : a + PAIRS]]) for a in range(0, len(q), PAIRS)), np.zeros(0, np.int64)])
        use = score >= goal[q]
        q, c, score = (np.concatenate((h, x[use])) for h, x in zip(held, (q, c, score), strict=True))
        sort = np.lexsort((ids[c], -score, q))
        q, c, score = q[sort], c[sort], score[sort]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        use = place < k
        held = q, c, score = q[use], c[use], score[use]
        full = place[use] == k - 1
        goal[q[full]] = np.maximum(goal[q[full]], score[full])
    return held


def searching(k: int, width: int, turn: np.ndarray, cuts: list[int]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND_ARROW.empty_table()
        values = matrix(right["vector"].combine_chunks(), width)
        order = np.argsort(-right["squared"].to_numpy(), kind="stable")
        candidates = Side.of(values[order], turn, cuts)
        rows = right["row"].to_numpy()[order]
        named = right["vec_id"].take(pa.array(order)).combine_chunks()
        # A null id comes last: ids are compared by their places among the block's.
        ids = np.argsort(np.lexsort((named.fill_null(0).to_numpy(zero_copy_only=False), named.is_null().to_numpy(zero_copy_only=False))))
        queries = Side.of(matrix(left["vector"].combine_chunks(), width), turn, cuts)
        own = left["row"].to_numpy()
        q, c, score = best(queries, candidates, left["goal"].to_numpy(), own, rows, ids, k, cuts)
        return pa.table({"query": pa.array(own[q]), "query_id": left["vec_id"].take(pa.array(q)), "vec_id": named.take(pa.array(c)), "score": pa.array(score)}, schema=FOUND_ARROW)

    return run


def dealt(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
    """``rows`` with the number of their block, of about ``size`` rows and descending length."""
    blocks = -(-count // size)
    if blocks <= 1:
        return rows.withColumn(name, F.lit(0))
    return rows.repartitionByRange(blocks, F.desc("squared"), "row").withColumn(name, F.spark_partition_id())


def search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner products for each row whose id ``every`` divides."""
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(valid(F.col("embedding")))
    given = given.select("vec_id", quantised(F.col("embedding")).alias("vector"), F.monotonically_increasing_id().alias("row"))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    safe = F.when(length < 2.0**62, length).otherwise(F.raise_error(F.lit("a vector is too long for 64-bit scores")).cast("double"))
    rows = written(given.withColumn("squared", safe), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")).first()
    width = max(facts["width"] or 0, 1)
    turn = rotation(rows, width)
    cuts = sorted({max(1, width // 4), max(1, width // 2)})
    candidates = written(dealt(rows, facts["n"], BLOCK, "block"), "candidates")
    queries = written(dealt(asked, facts["asked"], QUERIES, "group"), "queries")
    heads = written(candidates.groupBy("block").agg(F.max("squared").alias("most")), "heads")
    blocks = -(-facts["n"] // BLOCK)
    held = written(rows.sparkSession.createDataFrame([], FOUND), "found")
    begin, many = 0, 1
    top = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = held.withColumn("rank", F.row_number().over(top))
    while begin < blocks:
        end = min(begin + many, blocks)
        goals = held.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("goal"))
        live = queries.join(goals.withColumnRenamed("query", "row"), "row", "left").withColumn("goal", F.coalesce("goal", F.lit(NONE)))
        # Of each group of queries, the blocks that some query can still find something in.
        live = live.withColumn("block", F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))).join(sized(heads, 16), "block")
        live = live.where(F.sqrt("squared") * F.sqrt("most") * (1 + MARGIN) + 1 >= F.col("goal")).select("row", "vec_id", "vector", "goal", "group", "block")
        pairs = written(live.select("group", "block").distinct(), "pairs")
        if pairs.isEmpty():
            break  # the blocks after are of shorter vectors
        near = candidates.where(F.col("block").between(begin, end - 1)).join(sized(pairs, 16), "block")
        found = live.groupBy("group", "block").cogroup(near.groupBy("group", "block")).applyInArrow(searching(k, width, turn, cuts), FOUND)
        ranked = written(held.unionByName(found).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), "found", lasting=True)
        held = ranked.drop("rank")
        begin, many = end, many * GROWTH
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
