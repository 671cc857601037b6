"""Periodic runs of words by Crochemore's partition refinement, and texts with their runs collapsed.

A run is a stretch of words with smallest period q, no shorter than ``MIN_WORDS`` words and ``MIN_REPEATS``
periods, that neither neighbouring word extends. The places of a text are kept in classes of equal factors, at
level l those of l words. From one level to the next each class splits by the classes of the places one further
on; of the children of a class that split before, the largest needs no look (smaller half), so each place
is moved O(log n) times. A place whose next member of its class is just l further on begins a square with a root of l words
that is no power itself, as a power's root would stand between them. Squares at neighbouring places merge to a run.

All texts of a slice are refined together in numpy: classes are segments of one array of places and doubly linked
lists by place; each text ends in a symbol of its own. New distances of list neighbours wait, sorted, for their
level; those over a quarter of the text are of no run and are left out, and a text needs no levels beyond.

Defined results: null, empty and short texts have no runs; a text with a null id is looked at as it is; repeated
rows are looked at each; an empty table gives no rows; a text of any length is taken whole (one worker holds its words
and seven numbers for each); other columns are ignored, whatever their names. Equal runs don't exist, and of
the longest ones the first by start, then period, counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import tidy
from crossfactor.llm.hashing import slices

MIN_WORDS, MIN_REPEATS = 6, 4
#: Bytes of text that are refined together.
TOGETHER = 6 << 20

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN_ARROW)), ("collapsed", pa.binary())])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def edges(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Waiting:
    """(distance, place) pairs until their level comes: sorted stretches, each at least twice as long as the next."""

    def __init__(self) -> None:
        self.stretches: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, distance: np.ndarray, place: np.ndarray) -> None:
        while self.stretches and len(self.stretches[-1][0]) < 2 * len(distance):
            d, p = self.stretches.pop()
            distance, place = np.concatenate((d, distance)), np.concatenate((p, place))
        order = np.argsort(distance, kind="stable")
        self.stretches.append((distance[order], place[order]))

    def take(self, level: int) -> np.ndarray:
        """Places whose distance is ``level``; nearer ones are gone."""
        out = []
        for i, (d, p) in enumerate(self.stretches):
            if len(d) and d[0] <= level:
                begin, end = np.searchsorted(d, [level, level + 1])
                out.append(p[begin:end])
                self.stretches[i] = d[end:], p[end:]
        self.stretches = [s for s in self.stretches if len(s[0])]
        return np.concatenate(out) if out else np.zeros(0, np.int32)


class Partition:
    """Places by equal factors: ``order`` holds the members of class c from ``first[c]`` on, ``after`` and ``ahead`` link them by place."""

    def __init__(self, symbols: np.ndarray, limit: np.ndarray) -> None:
        count, kind = len(symbols), np.int32 if len(symbols) < 1 << 31 else np.int64
        self.limit, self.waiting, self.level = limit, Waiting(), 1
        self.order = np.argsort(symbols, kind="stable").astype(kind)
        begins = edges(symbols[self.order])
        self.first, self.size = np.zeros(count, kind), np.zeros(count, kind)
        self.first[: len(begins)] = begins
        self.size[: len(begins)] = np.diff(np.append(begins, count))
        self.classes = len(begins)
        self.owner, self.slot = np.zeros(count, kind), np.zeros(count, kind)
        self.owner[self.order] = np.repeat(np.arange(self.classes), self.size[: self.classes])
        self.slot[self.order] = np.arange(count)
        self.after, self.ahead, self.taken = np.full(count, -1, kind), np.full(count, -1, kind), np.zeros(count, bool)
        self.link(self.order, begins)
        self.wait(self.order)
        self.small = np.arange(self.classes)

    def link(self, members: np.ndarray, begins: np.ndarray) -> None:
        """Make lists of ``members``, sorted by place within each stretch that begins at ``begins``."""
        self.after[members[:-1]], self.ahead[members[1:]] = members[1:], members[:-1]
        self.ahead[members[begins]] = self.after[members[np.append(begins[1:], len(members)) - 1]] = -1

    def wait(self, places: np.ndarray) -> None:
        places = places[self.after[places] >= 0]
        distance = self.after[places] - places
        due = (distance >= self.level) & (distance <= self.limit[places])
        if due.any():
            self.waiting.add(distance[due], places[due])

    def squares(self) -> np.ndarray:
        """Places, ascending, of squares whose root has as many words as the level."""
        found = self.waiting.take(self.level)
        return np.unique(found[self.after[found] - found == self.level])

    def refine(self) -> None:
        """From factors of ``level`` words to those of one more."""
        reason = np.repeat(self.small, self.size[self.small])
        members = self.order[ranges(self.first[self.small], self.size[self.small])]
        use = (members > 0) & (self.limit[members] > self.level)
        place, reason = members[use] - 1, reason[use]
        use = self.size[self.owner[place]] > 1
        place, reason = place[use], reason[use]
        self.level += 1
        self.small = np.zeros(0, np.int64)
        if not len(place):
            return
        owner = self.owner[place]
        sort = np.lexsort((place, reason, owner))
        place, reason, owner = place[sort], reason[sort], owner[sort]
        group = edges(owner, reason)
        many = np.diff(np.append(group, len(place)))
        parent = owner[group]
        own = edges(parent)  # the first group of each class
        groups = np.diff(np.append(own, len(parent)))
        of = np.repeat(np.arange(len(own)), groups)
        rest = self.size[parent[own]] - np.add.reduceat(many, own)
        largest = np.maximum.reduceat(many, own)
        best = np.lexsort((np.arange(len(many)), -many, of))[own]  # the first of the largest groups of each class
        # A class whose places are all in groups keeps its largest group, others keep the rest.
        stays = np.zeros(len(many), bool)
        stays[best[rest == 0]] = True
        moves = ~stays
        number = np.where(moves, self.classes + np.cumsum(moves) - 1, parent)
        big = np.zeros(len(many), bool)
        big[best[(rest == 0) | (largest > rest)]] = True
        split = (groups > 1) | (rest > 0)
        self.small = np.concatenate((number[moves & ~big], parent[own][split & (rest > 0) & (largest > rest)]))
        if not moves.any():
            return
        moving = np.repeat(moves, many)
        place, owner = place[moving], owner[moving]
        size = many[moves]
        begins = np.cumsum(size) - size
        # Out of the old lists: chains of neighbours leave together.
        chain = np.lexsort((place, owner))
        leaving = place[chain]
        joined = np.zeros(len(leaving) + 1, bool)
        joined[1:-1] = self.after[leaving[:-1]] == leaving[1:]
        left, right = self.ahead[leaving[~joined[:-1]]], self.after[leaving[~joined[1:]]]
        self.after[left[left >= 0]] = right[left >= 0]
        self.ahead[right[right >= 0]] = left[right >= 0]
        self.link(place, begins)
        # To the end of their class's segment, groups one after another; places that were there fill the gaps.
        old = edges(owner)
        leave = np.diff(np.append(old, len(owner)))
        tail = self.first[owner[old]] + self.size[owner[old]] - leave
        slots = ranges(tail, leave)
        held = self.slot[place]
        gaps = held[held < np.repeat(tail, leave)]
        self.taken[place] = True
        fill = self.order[slots]
        fill = fill[~self.taken[fill]]
        self.taken[place] = False
        self.order[gaps], self.slot[fill] = fill, gaps
        self.order[slots], self.slot[place] = place, slots
        self.size[owner[old]] -= leave
        new = number[moves]
        self.first[new], self.size[new] = slots[begins], size
        self.owner[place] = np.repeat(new, size)
        self.classes += len(new)
        self.wait(np.concatenate((left[left >= 0], place)))


def runs_of(texts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Of each array of word numbers, its runs as rows of start, length, period, by start, then period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    long = np.flatnonzero(sizes >= MIN_WORDS)
    if not len(long):
        return out
    # Classes by text and word: texts have their own range of symbols, and one more at the end.
    firsts = np.cumsum(sizes[long] + 1) - sizes[long] - 1
    words = np.concatenate([np.append(texts[i], -1) for i in long])
    text = np.repeat(np.arange(len(long)), sizes[long] + 1)
    part = Partition(text * (int(words.max()) + 2) + words + 1, np.repeat(sizes[long] // MIN_REPEATS, sizes[long] + 1))
    found, top = [], int(sizes.max()) // MIN_REPEATS
    while True:
        at = part.squares()
        if len(at):
            begins = edges(at - np.arange(len(at)))
            first, last = at[begins], at[np.append(begins[1:], len(at)) - 1]
            length = last - first + 2 * part.level
            enough = length >= max(MIN_WORDS, MIN_REPEATS * part.level)
            found.append(np.column_stack((first[enough], length[enough], np.full(int(enough.sum()), part.level))))
        if part.level >= top or not len(part.small):
            break
        part.refine()
    if found and len(rows := np.concatenate(found).astype(np.int64)):
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        of = text[rows[:, 0]]
        rows[:, 0] -= firsts[of]
        begins = edges(of)
        for begin, end in zip(begins, [*begins[1:], len(of)], strict=True):
            out[long[of[begin]]] = rows[begin:end]
    return out


def kept_words(count: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: those of a run after its first period go."""
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def repeated_tail(doc_id: int | None, count: int) -> np.ndarray:
    """Places of the words that a text is made of: of every tenth text by its id's checksum, the end repeats a part of it."""
    places = np.arange(count)
    if doc_id is None or not count:
        return places
    tens, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return places
    begin = tens % count
    period = 1 + (count - begin) // (3 + tens % 8)
    places[begin:] = begin + (places[begin:] - begin) % period
    return places


def task(rewrite: Callable[[int | None, int], np.ndarray] | None):
    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end in slices(texts, TOGETHER):
                # Bytes split at just the six characters of ASCII white space.
                words = [t.split() for t in texts[begin:end]]
                index: dict[bytes, int] = {}
                numbers = [np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, len(ws)) for ws in words]
                places = [rewrite(i, len(ws)) if rewrite else np.arange(len(ws)) for i, ws in zip(names[begin:end], words, strict=True)]
                numbers = [n[p] for n, p in zip(numbers, places, strict=True)]
                found = runs_of(numbers)
                plain = [b" ".join(map(ws.__getitem__, p[kept_words(len(p), r)].tolist()) if len(r) or rewrite else ws) for ws, p, r in zip(words, places, found, strict=True)]
                rows = np.concatenate(found)
                runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(RUN_ARROW)))
                yield pa.RecordBatch.from_arrays([pa.array(names[begin:end], pa.int64()), pa.array(map(len, words), pa.int64()), runs, pa.array(plain, pa.binary())], schema=RUNS_ARROW)

    return run


def detect(docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period, by start), and the words that stay, joined by spaces, as bytes.

    ``rewrite`` gives, by a text's id and number of words, the places of the words that the text is made of first.
    """
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary")).mapInArrow(task(rewrite), RUNS)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest one, and the SHA-256 of all runs and of the collapsed text; every tenth text is given a repeated end first."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = detect(docs, repeated_tail).withColumn("__longest", longest)
    start, length, period = -F.col("__longest.start"), F.col("__longest.length"), -F.col("__longest.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.expr("1000 * __longest.length div -__longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
