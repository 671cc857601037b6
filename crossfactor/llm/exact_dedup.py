"""Exact deduplication by Patricia-trie owners.

Each input partition inserts the normalised byte strings of its texts into a compressed radix
trie whose terminal nodes hold the best row and the number of rows; a trie past its byte budget
evicts its largest subtree as partial rows. The partial rows go to the owner of their length and
content hash, which inserts the full byte strings again and so merges the terminals. Owners read
their rows sorted by length and hash, with Spark's external sort underneath, and release subtrees
that no later row can reach. Each document then finds its class by the SHA-256 of its text.

Copies collapse before the shuffle, so a text that makes up a third of the rows sends one partial
row from each input partition to its owner, and only classes of two rows or more join back.

Defined results: null text counts as empty, empty texts are one class; of equal texts the row with
the most code points stays, of as long ones that with the smallest ``doc_id``, null ids last; rows that
repeat both id and text share one verdict; texts of any length are compared whole; an empty table gives no
rows; other columns, whatever their names, are ignored by ``mark`` and kept by ``dedup``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import fresh, sized, text_or_empty, tidy, written

#: Bytes of labels that a trie holds before it evicts subtrees.
TRIE_BYTES = 48 << 20
EMIT_BYTES = 4 << 20
#: A null id goes by this, beyond all long values.
NO_ID = 1 << 63

PARTIAL = "__norm binary, __chars int, __id long, __n long"
PARTIAL_ARROW = pa.schema([("__norm", pa.binary()), ("__chars", pa.int32()), ("__id", pa.int64()), ("__n", pa.int64())])


class Node:
    __slots__ = ("best", "children", "label", "rows")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.children: dict[int, Node] = {}
        self.rows = 0
        self.best = (0, NO_ID)


def shared_prefix(key: bytes, at: int, label: bytes) -> int:
    """Length of what ``key`` from ``at`` on and ``label`` share, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key[at : at + middle] == label[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over bytes; a terminal keeps the best (chars, id) and its row count."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.held: dict[int, int] = {}
        self.bytes = 0

    def insert(self, key: bytes, chars: int, doc_id: int, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                cost = len(key) - at + 200
                self.held[key[0]] = self.held.get(key[0], 0) + cost
                self.bytes += cost
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                keep = shared_prefix(key, at, child.label)
                middle = Node(child.label[:keep])
                child.label = child.label[keep:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                node, at = middle, at + keep
        if not node.rows or (-chars, doc_id) < (-node.best[0], node.best[1]):
            node.best = (chars, doc_id)
        node.rows += rows

    def pop(self, first: int | None = None) -> Iterator[tuple[bytes, tuple[int, int], int]]:
        """Remove and yield the terminals of the subtree under byte ``first``, or of the whole trie."""
        if first is None:
            stack = [(b"", self.root)]
            self.root, self.held, self.bytes = Node(b""), {}, 0
        else:
            stack = [(b"", self.root.children.pop(first))]
            self.bytes -= self.held.pop(first)
        while stack:
            before, node = stack.pop()
            here = before + node.label
            if node.rows:
                yield here, node.best, node.rows
            stack.extend((here, child) for child in node.children.values())

    def largest(self) -> int:
        return max(self.held, key=self.held.__getitem__)


class Emitter:
    """Gathers partial rows into record batches of a few megabytes."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, terminals: Iterator[tuple[bytes, tuple[int, int], int]], skip: int = 0) -> Iterator[pa.RecordBatch]:
        for key, (chars, doc_id), rows in terminals:
            self.rows.append((key[skip:], chars, None if doc_id == NO_ID else doc_id, rows))
            self.bytes += len(key) + 40
            if self.bytes >= EMIT_BYTES:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTIAL_ARROW, strict=True)], schema=PARTIAL_ARROW)
            self.rows, self.bytes = [], 0


@tidy()
def local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse the copies within an input partition."""
    trie, out = PatriciaTrie(), Emitter()
    for batch in batches:
        for norm, chars, doc_id in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            trie.insert(norm, chars, NO_ID if doc_id is None else doc_id)
            while trie.bytes > TRIE_BYTES:
                yield from out.add(trie.pop(trie.largest()))
    yield from out.add(trie.pop())
    yield from out.flush()


@tidy()
def owner_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the partial terminals of equal byte strings; rows come sorted by length and hash."""
    trie, out, last = PatriciaTrie(), Emitter(), b""
    for batch in batches:
        for norm, chars, doc_id, rows, size, mixed in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            place = struct.pack(">IQ", size, mixed & (1 << 64) - 1)
            if place != last and trie.bytes > TRIE_BYTES:
                yield from out.add(trie.pop(), 12)
            last = place
            trie.insert(place + norm, chars, NO_ID if doc_id is None else doc_id, rows)
    yield from out.add(trie.pop(), 12)
    yield from out.flush()


def normalised() -> F.Column:
    return F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]+", "")


def classes(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: its SHA-256, the row that stays and the number of rows."""
    partial = docs.select(normalised().cast("binary").alias("__norm"), F.length(text_or_empty()).alias("__chars"), F.col("doc_id").cast("long").alias("__id")).mapInArrow(local_tries, PARTIAL)
    owned = partial.select("*", F.octet_length("__norm").alias("__size"), F.xxhash64("__norm").alias("__mixed")).repartition("__size", "__mixed").sortWithinPartitions("__size", "__mixed")
    return owned.mapInArrow(owner_tries, PARTIAL).select(F.sha2("__norm", 256).alias("text_sha256"), F.col("__id").alias("keep_id"), F.col("__n").alias("group_size"))


def mark(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = classes(docs).where("group_size > 1").withColumnRenamed("text_sha256", "__sha")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(), 256).alias("text_sha256"))
    return own.join(found, F.col("text_sha256") == F.col("__sha"), "left").select(
        "doc_id",
        F.when(F.col("__sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("__sha").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    name, sha = fresh(docs, "drop"), fresh(docs, "drop_sha")
    dropped = written(mark(docs).where("not kept").select(F.col("doc_id").alias(name), F.unhex("text_sha256").alias(sha)), "exact-dropped")
    # Only rows whose id and text are both those of a dropped row go: a repeated id alone says nothing.
    return docs.join(sized(dropped, 40), F.col("doc_id").eqNullSafe(F.col(name)) & (F.unhex(F.sha2(normalised(), 256)) == F.col(sha)), "left_anti")
