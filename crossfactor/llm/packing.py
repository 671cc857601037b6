"""Best-fit packing of token pieces with swap-based local search.

Texts become ids with an end id each; longer ones are cut into pieces of the sequence length.
Groups of pieces, salted by row so that no key can fill one, are packed apart: best fit in
descending order, then exchanges between bins that are not full. A piece moves, or one piece is
exchanged for one, or two for one, if that increases the sum of squared fills, so full bins get
fuller and the emptiest empty, until no exchange between any two of the group's bins helps or the
bins are as few as the total allows.
Pieces of each group's bins that are still under the ``loose`` fill meet again in the next level, in
groups of the same size, until one group is left or a level saves no bin; no group ever grows with the input.

Defined results: null and empty texts give the end id alone; a long text is cut into full pieces and a last one;
repeated rows are packed each; of pieces of one length any may go first; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import text_or_empty, tidy, written
from crossfactor.llm.hashing import slices
from crossfactor.llm.tokens import encoder

LENGTH = 2048
GROUP_PIECES = 20_000
#: Bins of a group that are filled less than this, as part of the length, are packed again with others'.
LOOSE = 0.98
#: Underfull bins, the emptiest, that are exchanged pair by pair before the search over all of them.
DRAINED_BINS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    @tidy(keeps=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for begin, stop in slices(texts):
                rows = []
                for name, ids in zip(names[begin:stop], encoder(path, "words").encode(texts[begin:stop]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES_ARROW, strict=True)], schema=PIECES_ARROW)

    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary")).mapInArrow(cut(path, length, end_id), PIECES)


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best fit in descending order; the open bins with each room left are a stack, and a bit set finds the least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    open_rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size << size
        if fits:
            left = (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                open_rooms &= ~(1 << left)
            bins[b].append(i)
        else:
            left, b = room, len(bins)
            bins.append([i])
        if left > size:
            by_room.setdefault(left - size, []).append(b)
            open_rooms |= 1 << left - size
    return bins


def exchange(giver: list[tuple[int, int]], taker: list[tuple[int, int]], gap: int) -> tuple[list, list] | None:
    """The exchange that fills ``taker``, the fuller bin, most: pieces that it takes and gives back. Bins are sorted by size."""
    sizes = [s for s, _ in giver]
    best, found = 0, None

    def consider(limit: int, back: list) -> None:
        """One piece of the giver of at most ``limit``, or two, for ``back``."""
        nonlocal best, found
        given = sum(s for s, _ in back)
        k = bisect_left(sizes, limit + 1) - 1
        if k >= 0 and sizes[k] - given > best:
            best, found = sizes[k] - given, ([giver[k]], back)
        if len(back) < 2:
            low, high = 0, len(giver) - 1
            while low < high:  # two for one: the largest sum within the limit
                both = sizes[low] + sizes[high]
                if both > limit:
                    high -= 1
                else:
                    if both - given > best:
                        best, found = both - given, ([giver[low], giver[high]], back)
                    low += 1

    consider(gap, [])
    for i, one in enumerate(taker):
        if best == gap:
            break
        consider(gap + one[0], [one])
        for two in taker[:i]:
            consider(gap + one[0] + two[0], [two, one])
    return found


def drained(bins: list[list[int]], sizes: np.ndarray, room: int, searched: int = DRAINED_BINS) -> list[list[int]]:
    """Exchanges between the emptiest underfull bins until none increases the sum of squared fills."""
    least = -(-int(sizes.sum()) // room)
    fill = [int(sizes[b].sum()) for b in bins]
    loose = sorted((k for k in range(len(bins)) if fill[k] < room), key=fill.__getitem__)
    rest = {k: sorted((int(sizes[i]), i) for i in bins[k]) for k in loose[:searched]}
    gone: set[int] = set()
    moved = True
    while moved and len(bins) - len(gone) > least:
        moved = False
        for giver in sorted(rest, key=fill.__getitem__):
            for taker in sorted((k for k in rest if k != giver), key=lambda k: -fill[k]):
                while giver in rest and fill[giver] <= fill[taker] < room and (swap := exchange(rest[giver], rest[taker], room - fill[taker])):
                    for piece in swap[0]:
                        rest[giver].remove(piece)
                        insort(rest[taker], piece)
                    for piece in swap[1]:
                        rest[taker].remove(piece)
                        insort(rest[giver], piece)
                    change = sum(s for s, _ in swap[0]) - sum(s for s, _ in swap[1])
                    fill[taker] += change
                    fill[giver] -= change
                    moved = True
                    if not rest[giver]:
                        del rest[giver]
                        gone.add(giver)
                if giver not in rest:
                    break
            if len(bins) - len(gone) <= least:
                break
    return [[i for _, i in rest[k]] if k in rest else b for k, b in enumerate(bins) if k not in gone]


def sums(pieces: list[tuple[int, int]]) -> tuple[int, int]:
    """Bit sets of the sizes of single pieces and of the sums of two."""
    one = two = 0
    for size, _ in pieces:
        two |= one << size
        one |= 1 << size
    return one, two


def set_bits(bits: int) -> Iterator[int]:
    while bits:
        yield (bits & -bits).bit_length() - 1
        bits &= bits - 1


class Givers:
    """Bins by the sizes that one or two of their pieces sum to, with a bit set of the sizes that any bin has."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[int, int]] = {}
        self.bins: tuple[dict[int, set[int]], dict[int, set[int]]] = ({}, {})
        self.has = [0, 0]

    def put(self, k: int, new: tuple[int, int]) -> None:
        """The sums of bin ``k`` are ``new`` from now on; (0, 0) takes it out."""
        old = self.of.pop(k, (0, 0))
        if new[0]:
            self.of[k] = new
        for j, bins in enumerate(self.bins):
            for size in set_bits(old[j] & ~new[j]):
                bins[size].remove(k)
                if not bins[size]:
                    del bins[size]
                    self.has[j] &= ~(1 << size)
            for size in set_bits(new[j] & ~old[j]):
                bins.setdefault(size, set()).add(k)
                self.has[j] |= 1 << size

    def best(self, taker: tuple[int, int], gap: int, fill: list[int]) -> tuple[int, int, int, int, int] | None:
        """The exchange that fills a bin with the sums ``taker`` most, with the emptiest bin that has it: giver, pieces and size taken, pieces and size given back."""
        if (found := most(*self.has, taker, gap)) is None:
            return None
        size, few, back = found
        bins = self.bins[0].get(size, set()) | (self.bins[1].get(size, set()) if few < 2 else set())
        giver = min(bins, key=lambda k: (fill[k], k))
        return giver, 1 if self.of[giver][0] >> size & 1 else 2, size, few, back


def most(one: int, two: int, taker: tuple[int, int], gap: int) -> tuple[int, int, int] | None:
    """What a bin that takes, with ``gap`` left, gains most by: size taken from the sums ``one`` and ``two``, pieces and size given back."""
    for more in range(gap, 0, -1):
        some = (one | two) & (taker[0] | 1) << more
        if some:
            size = some.bit_length() - 1
            return size, 1 if size > more else 0, size - more
        pair = one & taker[1] << more
        if pair:
            size = pair.bit_length() - 1
            return size, 2, size - more
    return None


def chosen(pieces: list[tuple[int, int]], count: int, size: int) -> list[tuple[int, int]]:
    """``count`` pieces, at most two, of the ``size`` together. Pieces are sorted by size."""
    if count < 2:
        return [pieces[bisect_left(pieces, (size, -1))]] if count else []
    low, high = 0, len(pieces) - 1
    while pieces[low][0] + pieces[high][0] != size:
        if pieces[low][0] + pieces[high][0] > size:
            high -= 1
        else:
            low += 1
    return [pieces[low], pieces[high]]


def local_search(bins: list[list[int]], sizes: np.ndarray, room: int) -> list[list[int]]:
    """Exchanges between underfull bins, all of them, until none increases the sum of squared fills.

    The emptiest are drained first. Then a pass fills each bin from those that are not fuller, the fullest first; passes end with one that changes nothing.
    """
    bins = drained(bins, sizes, room)
    least = -(-int(sizes.sum()) // room)
    fill = [int(sizes[b].sum()) for b in bins]
    rest = {k: sorted((int(sizes[i]), i) for i in b) for k, b in enumerate(bins) if fill[k] < room}
    gone: set[int] = set()
    moved = True
    while moved and len(bins) - len(gone) > least:
        moved, givers, passed = False, Givers(), []
        order = sorted((fill[k], k) for k in rest if k not in gone and fill[k] < room)
        for _, k in order:
            givers.put(k, sums(rest[k]))
        while order and len(bins) - len(gone) > least:
            full, taker = order.pop()
            for k in passed:
                if fill[k] > full:
                    givers.put(k, (0, 0))
            passed = [k for k in passed if fill[k] <= full]
            own = givers.of[taker]
            givers.put(taker, (0, 0))
            while fill[taker] < room and (swap := givers.best(own, room - fill[taker], fill)):
                giver, taken, size, few, back = swap
                there, here = chosen(rest[giver], taken, size), chosen(rest[taker], few, back)
                for piece in there:
                    rest[giver].remove(piece)
                    insort(rest[taker], piece)
                for piece in here:
                    rest[taker].remove(piece)
                    insort(rest[giver], piece)
                if (at := bisect_left(order, (fill[giver], giver))) < len(order) and order[at][1] == giver:
                    del order[at]
                fill[taker] += size - back
                fill[giver] -= size - back
                moved = True
                own = sums(rest[taker])
                givers.put(giver, sums(rest[giver]))
                if rest[giver]:
                    if giver not in passed:
                        insort(order, (fill[giver], giver))
                else:
                    gone.add(giver)
                    if len(bins) - len(gone) <= least:
                        break
            if fill[taker] < room:
                givers.put(taker, own)
                passed.append(taker)
    return [[i for _, i in rest[k]] if k in rest else b for k, b in enumerate(bins) if k not in gone]


def packed(level: int, room: int, last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["length"].to_numpy()
        bins = local_search(best_fit(sizes, room), sizes, room)
        sequence, offset, again = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64), np.zeros(len(group), bool)
        for number, members in enumerate(bins):
            taken = sizes[members]
            sequence[members] = (level << 56) + (int(key[0]) << 20) + number
            offset[members] = np.cumsum(taken) - taken
            again[members] = not last and taken.sum() < LOOSE * room
        return group[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset, __again=again)

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    left, done, level, before = written(pieces(docs, path, length), "pack-pieces", lasting=True), None, 0, None
    while True:
        count = left.count()
        groups = max(1, -(-count // group_pieces))
        salted = left.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)))
        # One group is the end; so is a level whose bins are as many as those that its pieces came from, which are then as good.
        out = salted.groupBy("__group").applyInPandas(packed(level, length, groups == 1), PIECES + ", sequence_id long, offset long, __again boolean")
        if groups > 1:
            out = written(out, "pack-level", lasting=True)
            bins = out.select("sequence_id").distinct().count()
        last = groups == 1 or before is not None and bins >= before
        if groups > 1 and last and bins > before:
            out = earlier
        stay = out.drop("__again") if last else out.where("not __again").drop("__again")
        done = stay if done is None else done.unionAll(stay)
        if last:
            return done
        earlier = out.where("__again")
        left, before = earlier.select("doc_id", "piece", "start", "length", "ids_crc32"), earlier.select("sequence_id").distinct().count()
        level += 1
