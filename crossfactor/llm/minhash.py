"""Near-duplicate documents by ProbMinHash.

Shingles of five words, weighted by their counts, arrive at each document's registers as Poisson
processes with rates equal to their weights. A register keeps the shingle that arrives first, and
arrivals end early, once none can be earlier than the latest register. Registers of two documents
agree with a probability equal to their probability Jaccard similarity. Bands of registers give
candidate pairs, which are verified against the exact similarity of the whole texts, 0.8 or more.

Texts with equal word sequences collapse to a node first. In each bucket of a band the nodes pair
with the bucket's leader; verified pairs join components. Where the nodes of a bucket are then
still in several components, rounds with other leaders follow. At last the nodes of such buckets
get a sketch of four times as many registers, and blocks of a bucket's nodes are compared with
blocks, within a task: each pair of different components in the first bucket that it shares only. Nodes
with a partner that the sketch puts near the threshold or above then meet again with their texts, and such
pairs are verified there, unless links found before join them. So no pair becomes a row but the links that
join components, no bucket or candidate is capped, and of a bucket's texts only those of such nodes move.

With 24 bands of 5 registers a pair of similarity 0.8 is missed with probability 7e-5; the sketch
misses it with 1e-4 (3.9 standard deviations). Other pairs of its class may still join it.

Defined results: documents without words (null, empty or white space) are each in a class of
their own, as are documents similar to none; a text of fewer than five words is one shingle;
texts of any length are compared whole; of a class the smallest ``doc_id`` stays; rows that repeat id and
text share one verdict; null ids are last and a class of null ids only has a null class; an empty table gives no
rows; other columns, whatever their names, are ignored by ``classify`` and kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import fresh, sized, text_or_empty, tidy, working_tables, written
from crossfactor.llm.hashing import U64, mixed, shingles, slices

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Rounds with bucket leaders before the pairs that are left are tested in full.
LEADER_ROUNDS = 2
#: Registers of a sketch, a byte each, and the part that must agree: 0.73 by chance corrected for equal bytes.
SKETCH, NEAR = 480, 0.73
#: Nodes of a bucket in a block, about, and bytes of their texts.
BLOCK, BLOCK_BYTES = 800, 8 << 20
#: Links that one task may join, about 400 bytes each in its tables; more are joined by stars over all executors.
ONE_TASK_LINKS = 200_000

#: A node's place in two blocks of a bucket.
PLACED = ["__key", "__i", "__j", "__block", "__node", "__label"]

SIGNED = "doc_id long, __node binary, __bands array<long>"
SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("__node", pa.binary()), ("__bands", pa.list_(pa.int64()))])


def node() -> Column:
    """128 bits that name a word sequence; null for a text without words."""
    flat = F.trim(F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat != "", F.unhex(F.substring(F.sha2(flat, 256), 1, 32)))


def signatures(texts: list[bytes], registers: int = REGISTERS, width: int = WIDTH) -> np.ndarray:
    """The shingle in each register of each text; zero where a text has no words."""
    shingle, owner, count = shingles(texts, width)
    first = np.full(len(texts) * registers, np.inf)
    held = np.zeros(len(texts) * registers, U64)
    rate = count.astype(float)
    clock = np.zeros(len(shingle))
    turn = 0
    while len(shingle):
        with np.errstate(over="ignore"):
            drawn = mixed(shingle + U64(2 * turn + 1) * U64(0x9E3779B97F4A7C15))
            place = mixed(drawn ^ U64(0xA0761D6478BD642F))
        clock = clock - np.log(((drawn >> U64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        slot = owner * registers + ((place >> U64(33)) % U64(registers)).astype(np.int64)
        np.minimum.at(first, slot, clock)
        won = first[slot] == clock
        held[slot[won]] = shingle[won]
        latest = first.reshape(-1, registers).max(axis=1)
        live = clock < latest[owner]
        shingle, owner, rate, clock, turn = shingle[live], owner[live], rate[live], clock[live], turn + 1
    return held.reshape(len(texts), registers)


def banded(held: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each band; the band's number is part of it."""
    rows = held.shape[1] // bands
    key = np.zeros((len(held), bands), U64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mixed(key * U64(3) + held.reshape(len(held), bands, rows)[:, :, j])
        return mixed(key + np.arange(bands, dtype=U64))


@tidy()
def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for begin, end in slices(texts):
            keys = banded(signatures(texts[begin:end])).view(np.int64)
            part = batch.slice(begin, end - begin)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.binary()), lists], schema=SIGNED_ARROW)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, of two sorted arrays of shingles with their counts.

    A shared shingle d adds 1 / sum over e of max(x_e / x_d, y_e / y_d); the sum splits at the ratio x_d / y_d.
    """
    keys = np.union1d(a[0], b[0])
    if not len(keys):
        return 0.0
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    below = np.searchsorted(ratio, ratio[both], "left")
    y_before = np.concatenate(([0.0], np.cumsum(y)))
    x_after = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))
    return float((1.0 / (x_after[below] / x[both] + y_before[below] / y[both])).sum())


def parted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for begin, end in slices(texts):
        found, owner, count = shingles(texts[begin:end], WIDTH)
        edge = np.searchsorted(owner, np.arange(end - begin + 1))
        out += [(found[i:j], count[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
    return out


@tidy()
def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes with both texts: the pairs that are similar enough."""
    last: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        sizes = sum(pc.binary_length(batch.column(k)).to_numpy() for k in (2, 3))
        for begin, end in slices([range(n) for n in sizes.tolist()]):
            nodes, _, texts, others = (c.to_pylist() for c in batch.slice(begin, end - begin).columns)
            need = {n: t for n, t in zip(nodes, texts, strict=True) if n not in last}
            last = {n: last[n] for n in set(nodes) if n in last} | dict(zip(need, parted(list(need.values())), strict=True))
            keep[begin:end] = [probability_jaccard(last[n], right) >= SIMILARITY for n, right in zip(nodes, parted(others), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["__a", "__b"]).filter(pa.array(keep))


def similar(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """Of distinct pairs (__a, __b) those whose texts are similar."""
    right = pairs.join(content.select(F.col("__node").alias("__b"), F.col("__text").alias("__text_b")), "__b")
    both = right.join(content.select(F.col("__node").alias("__a"), F.col("__text").alias("__text_a")), "__a")
    return both.select("__a", "__b", "__text_a", "__text_b").mapInArrow(verify, "__a binary, __b binary")


@tidy()
def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task; the root is the smallest node."""
    above: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while above[top] != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([root(n) for n in part], pa.binary())], names=["__node", "__label"])


def components(edges: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(__node, __label) of linked nodes: the smallest node of each component.

    Links counted to be few are joined in one task; else alternating large and small stars join them,
    in rounds that are logarithmic in the longest chain.
    """
    if edges.limit(one_task + 1).count() <= one_task:
        return written(edges.select("__a", "__b").coalesce(1).mapInArrow(joined, "__node binary, __label binary"), "near-labels")
    edges = written(edges.select("__a", "__b").where("__a <> __b"), "near-edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("__b").alias("__a"), F.col("__a").alias("__b")))
        low = both.groupBy("__a").agg(F.least(F.min("__b"), F.col("__a")).alias("__m"))
        large = both.join(low, "__a").where("__b > __a").select(F.col("__b").alias("__a"), F.col("__m").alias("__b"))
        down = large.where("__a <> __b").distinct()  # __b < __a from here on
        low = down.groupBy("__a").agg(F.min("__b").alias("__m"))
        hung = down.join(low, "__a")
        edges = written(hung.select(F.col("__b").alias("__a"), F.col("__m").alias("__b")).where("__a <> __b").unionAll(low.select("__a", F.col("__m").alias("__b"))).distinct(), "near-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("__a", "__b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("__a").alias("__node"), F.col("__b").alias("__label")).unionAll(edges.select(F.col("__b").alias("__node"), F.col("__b").alias("__label"))).distinct()


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b")]


def split(rows: DataFrame, by_key: DataFrame) -> DataFrame:
    """``rows`` joined by bucket with a row a bucket: a sort-merge join, so that adaptive execution splits the rows of a hot bucket over tasks."""
    return rows.join(by_key.hint("merge"), "__key")


def link(signed: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(__node, __label) of the nodes that are similar to another; None if there are none."""
    with working_tables(docs.sparkSession):
        labels = linked(signed, docs)
        return None if labels is None else written(labels, "near-classes", lasting=True)


def linked(signed: DataFrame, docs: DataFrame) -> DataFrame | None:
    nodes = signed.where("__node is not null").groupBy("__node").agg(F.min(F.struct("__bands")).alias("__s"))
    rows = nodes.select("__node", F.explode("__s.__bands").alias("__key"))
    shared = rows.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__node").alias("__leader")).where("__n > 1")
    bucket = written(split(rows, shared.select("__key", "__leader")), "near-buckets")
    tested = written(bucket.where("__node <> __leader").select(*ordered(F.col("__node"), F.col("__leader"))).distinct(), "near-pairs")
    if tested.isEmpty():
        return None
    wanted = written(bucket.select(F.col("__node").alias("__want")).distinct(), "near-nodes")
    named = docs.select(node().alias("__node"), text_or_empty().cast("binary").alias("__text"))
    content = written(named.join(sized(wanted, 16), F.col("__node") == F.col("__want"), "left_semi").dropDuplicates(["__node"]), "near-texts")
    edges = written(similar(tested, content), "near-links")
    labels, turn = components(edges), 0
    while True:
        known = bucket.select("__key", "__node").join(labels, "__node", "left").select("__key", "__node", F.coalesce("__label", "__node").alias("__label"))
        mixed_up = known.groupBy("__key").agg(F.min("__label").alias("__low"), F.max("__label").alias("__high")).where("__low <> __high").select("__key")
        rest = written(split(known, mixed_up), "near-open")
        if rest.isEmpty():
            return labels
        if turn == LEADER_ROUNDS:
            found = written(block_links(rest, content), "near-links")
            return labels if found.isEmpty() else components(edges.unionAll(found))
        fresh_pairs = written(leader_pairs(rest, turn).distinct().join(tested, ["__a", "__b"], "left_anti"), "near-pairs")
        turn += 1
        if fresh_pairs.isEmpty():
            turn = LEADER_ROUNDS
            continue
        tested = tested.unionAll(fresh_pairs)
        found = written(similar(fresh_pairs, content), "near-links")
        if not found.isEmpty():
            edges = edges.unionAll(found)
            labels = components(edges)


def leader_pairs(rest: DataFrame, turn: int) -> DataFrame:
    """In each bucket, a leader for each component, another one each turn; nodes pair with the leaders of the smallest and largest label."""
    rank = F.xxhash64("__node", F.lit(turn))
    heads = rest.groupBy("__key", "__label").agg(F.min(F.struct(rank.alias("__r"), F.col("__node").alias("__node"))).alias("__h")).select("__key", F.struct(F.col("__label").alias("__of"), F.col("__h.__node").alias("__head")).alias("__e"))
    ends = heads.groupBy("__key").agg(F.array(F.min("__e"), F.max("__e")).alias("__ends"))
    return split(rest, ends).select("__node", "__label", F.explode("__ends").alias("__e")).where("__label <> __e.__of").select(*ordered(F.col("__node"), F.col("__e.__head")))


@tidy()
def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for begin, end in slices(texts):
            part = batch.slice(begin, end - begin)
            held = (signatures(texts[begin:end], SKETCH) >> U64(56)).astype(np.uint8)
            keys = banded(signatures(texts[begin:end]))
            columns = [part.column(0).cast(pa.binary()), pa.array(map(len, texts[begin:end]), pa.int64()), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (held, keys))]
            yield pa.RecordBatch.from_arrays(columns, names=["__of", "__bytes", "__sketch", "__keys"])


def numbered(labels: list[bytes]) -> np.ndarray:
    number = {label: k for k, label in enumerate(dict.fromkeys(labels))}
    return np.array([number[label] for label in labels])


def near(table: pa.Table, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Two blocks of a bucket, or one with itself: each row and its partners, the nearest first.

    Partners are of another ``part`` at the time of asking, share this bucket as their first and are near by sketch.
    """
    marks = np.frombuffer(b"".join(table.column("__sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    keys = np.frombuffer(b"".join(table.column("__keys").to_pylist()), np.int64).reshape(-1, BANDS)
    here, i, j = (table.column(c)[0].as_py() for c in ("__key", "__i", "__j"))
    block = table.column("__block").to_numpy()
    first = np.flatnonzero(block == i)
    second = first if i == j else np.flatnonzero(block == j)
    least = int(np.ceil(SKETCH * (NEAR + (1 - NEAR) / 256)))
    for at, k in enumerate(first):
        others = second[at + 1 :] if i == j else second
        others = others[part[others] != part[k]]
        shared = keys[others] == keys[k]
        others = others[keys[k][shared.argmax(axis=1)] == here]
        agree = (marks[others] == marks[k]).sum(axis=1)
        yield k, others[np.argsort(-agree, kind="stable")][: int((agree >= least).sum())]


def close(table: pa.Table) -> pa.Table:
    """The rows of two blocks that have a partner."""
    has = np.zeros(table.num_rows, bool)
    for k, others in near(table, numbered(table.column("__label").to_pylist())):
        has[others] = True
        has[k] |= len(others) > 0
    return table.select(PLACED).filter(pa.array(has))


def compare(table: pa.Table) -> pa.Table:
    """The rows of two blocks that have a partner, with their texts: links between similar nodes of different components."""
    nodes, texts = (table.column(c).to_pylist() for c in ("__node", "__text"))
    part = numbered(table.column("__label").to_pylist())  # a node's component, joined as links are found
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found: list[tuple[bytes, bytes]] = []

    def content(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in held:
            held[k] = parted([texts[k]])[0]
        return held[k]

    for k, others in near(table, part):
        for n in others:
            if part[n] != part[k] and probability_jaccard(content(k), content(n)) >= SIMILARITY:
                found.append((min(nodes[k], nodes[n]), max(nodes[k], nodes[n])))
                part[part == part[n]] = part[k]
    return pa.table({"__a": pa.array([a for a, _ in found], pa.binary()), "__b": pa.array([b for _, b in found], pa.binary())})


def block_links(rest: DataFrame, content: DataFrame) -> DataFrame:
    """Links that join nodes of a bucket which are in different components. Blocks are bounded in nodes and in bytes."""
    own = rest.select(F.col("__node").alias("__want")).distinct()
    marked = content.join(own, F.col("__node") == F.col("__want"), "left_semi").select("__node", "__text").mapInArrow(sketch, "__of binary, __bytes long, __sketch binary, __keys binary")
    marked = written(marked, "near-sketches")
    sizes = rest.join(marked.select("__of", "__bytes"), F.col("__node") == F.col("__of"))
    sizes = sizes.groupBy("__key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("__bytes") / BLOCK_BYTES)).alias("__blocks"))
    dealt = split(rest, sizes).withColumn("__block", F.pmod(F.xxhash64("__node"), "__blocks"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    dealt = dealt.select("__key", F.least("__block", "__other").alias("__i"), F.greatest("__block", "__other").alias("__j"), "__block", "__node", "__label")
    marks = marked.drop("__bytes")
    both = dealt.join(marks, F.col("__node") == F.col("__of")).drop("__of")
    apart = written(both.groupBy("__key", "__i", "__j").applyInArrow(close, "__key long, __i long, __j long, __block long, __node binary, __label binary"), "near-close")
    told = apart.join(marks, F.col("__node") == F.col("__of")).drop("__of").join(content.select("__node", "__text"), "__node")
    return told.groupBy("__key", "__i", "__j").applyInArrow(compare, "__a binary, __b binary")


def classify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept."""
    return classified(docs).drop("__node")


def classified(docs: DataFrame) -> DataFrame:
    """``classify`` with the node of each document."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node().alias("__node"), text_or_empty().cast("binary").alias("__text"))
    signed = written(named.mapInArrow(sign, SIGNED), "near-signed")
    labels = link(signed, docs)
    single = F.col("__node").isNull()
    per_node = signed.where(~single).groupBy("__node").agg(F.min("doc_id").alias("__least"), F.count("*").alias("__rows"))
    if labels is not None:
        per_node = per_node.join(labels, "__node", "left").withColumn("__label", F.coalesce("__label", "__node"))
        per_class = per_node.groupBy("__label").agg(F.min("__least").alias("class_id"), F.sum("__rows").alias("class_size"))
        per_node = per_node.join(per_class.where("class_size > 1"), "__label")
    else:
        per_node = per_node.where("__rows > 1").withColumnsRenamed({"__least": "class_id", "__rows": "class_size"})
    found = per_node.select(F.col("__node").alias("__of"), "class_id", "class_size")
    return signed.select("doc_id", "__node").join(found, F.col("__node") == F.col("__of"), "left").select(
        "doc_id",
        F.when(F.col("__of").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (F.col("__of").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
        "__node",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    name, of = fresh(docs, "drop"), fresh(docs, "drop_node")
    dropped = written(classified(docs).where("not kept").select(F.col("doc_id").alias(name), F.col("__node").alias(of)).distinct(), "near-dropped")
    return docs.join(sized(dropped, 24), F.col("doc_id").eqNullSafe(F.col(name)) & (node() == F.col(of)), "left_anti")
