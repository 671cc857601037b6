"""Byte-level BPE by DuckDB recursive queries, one database per worker.

Each text falls into the pattern's matches. Words that the worker has not met yet go to DuckDB as rows of
token and position, first one token per byte; a recursive query joins neighbouring tokens with the merge table
and contracts, of each word, the leftmost pair of minimum rank until none is left; ordered
aggregation makes each word's ids. A text's ids are its words' ids in order. The ids of each text then
go back to DuckDB as rows of text, position and token, and ordered aggregation decodes them.

A word of more than ``LONG`` bytes is cut into pieces, which the same query contracts side by side. Two neighbouring tokens
hold if the query makes just these two of their joined bytes. A row of tokens of which all neighbours hold is the word's coding:
the first contraction over the bound of two tokens would also come about in those two alone, as contractions within them
come in the same order. Neighbours within a coded piece hold, so only the seams are looked at; around those that do not
hold, some tokens are coded again together, twice as many each time, up to the whole word. So a word takes time in proportion
to its length, unless seams far apart depend on one another, as in a long repetition. What is coded together and longer than
``LONG`` contracts in a turn, with the leftmost pair, the others of the same rank, left to right without overlap, where one turn
for each gives the same: no token that the new token begins or ends has a lower rank than it, so no pair that arises goes before
those that are left; a repetition has few ranks and so few turns. All ways have the same result for every word, which the
tests show over random merges.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are coded
each; an empty table gives no rows; a long text is coded in windows that end before a single space; other
columns are ignored, whatever their names; there are no ties.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfactor.llm.common import Kept, resident, text_or_empty, tidy
from crossfactor.llm.hashing import slices

#: Bytes that a worker's tables of words and of chunks take.
WORD_BYTES, CHUNK_BYTES = 96 << 20, 64 << 20
#: Bytes of a word beyond which it is cut, and of what is coded together beyond which a turn contracts more than one pair.
LONG = 64
#: Bytes of a piece, tokens on either side of a seam that are coded again at first, and bytes that a query contracts.
PIECE, REACH, BATCH = 24, 4, 1 << 18
#: Characters of a text that are coded at a time, and ids that are decoded at a time.
WINDOW, DECODED = 4 << 20, 1 << 20
#: A space between printable ASCII characters begins a match of the pattern.
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
#: ASCII punctuation that always ends a run of letters; the apostrophe does not.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
MEMORY = "400MB"

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def contraction(run: bool) -> str:
    """SQL: contract the words of table ``fresh`` (k, tok) until fixpoint. ``run``: all pairs of the rank at once, where safe.

    A key ``k`` is a word's number and, in its lower half, a place, so that one sort puts all words' tokens in order.
    ``least`` is a word's minimum rank and the leftmost place that has it.
    """
    if run:
        # Heads of one rank may overlap; every second one of a run of neighbours contracts. A word's last token heads nothing, so runs end there.
        heads = """
          l AS (SELECT j.*, least, rank IS NOT NULL AND rank = least >> 32 AS hit FROM j JOIN m ON (j.k >> 32) = m.w),
          o AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM l),
          r AS (SELECT *, n - max(CASE WHEN NOT hit THEN n ELSE 0 END) OVER (ORDER BY k) AS place FROM o),
          h AS (SELECT *, hit AND ((k & 4294967295) = (least & 4294967295) OR safe AND place % 2 = 1) AS head FROM r),
          g AS (SELECT *, coalesce(lag(head) OVER (ORDER BY k), false) AS gone FROM h)"""
    else:
        heads = """
          g AS (SELECT j.*, least, (k & 4294967295) = (least & 4294967295) AS head, coalesce(before = ((m.w << 32) | (least & 4294967295)), false) AS gone FROM j JOIN m ON (j.k >> 32) = m.w)"""
    return f"""
        WITH RECURSIVE s AS (
          SELECT k, tok, false AS done FROM fresh
          UNION ALL
          (WITH n AS (SELECT k, tok, CASE WHEN (lead(k) OVER o >> 32) = (k >> 32) THEN lead(tok) OVER o END AS next, lag(k) OVER o AS before FROM s WHERE NOT done WINDOW o AS (ORDER BY k)),
          j AS (SELECT n.*, merges.rank, merges.safe FROM n LEFT JOIN merges ON merges.pair = ((n.tok::BIGINT << 32) | n.next)),
          m AS (SELECT k >> 32 AS w, min((rank::BIGINT << 32) | (k & 4294967295)) AS least FROM j GROUP BY 1),{heads}
          SELECT k, CASE WHEN head THEN rank ELSE tok END, least IS NULL FROM g WHERE NOT gone)
        )
        SELECT k >> 32 AS w, array_to_string(list(tok ORDER BY k), ' ')::BLOB AS ids FROM s WHERE done GROUP BY 1 ORDER BY 1"""


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Parts of about ``size`` characters that end before a space at which a match begins; a text without such spaces is one part."""
    begin = 0
    while len(text) - begin > size and (found := CUT.search(text, begin + size)):
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


def joined(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans, those that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class Coder:
    """``ranks`` by token; tokens of one byte are all in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.bytes = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        unsafe = {part for a, b, r in rows for part in (a, b) if part > r}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")})
        merges = pa.table({"pair": pa.array([a << 32 | b for a, b, _ in rows], pa.int64()), "rank": pa.array([r[2] for r in rows], pa.int32()), "safe": pa.array([r[2] not in unsafe for r in rows])})
        # A character for each byte, so that text aggregates join bytes.
        tokens = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in ranks])})
        for name, table in (("merges", merges), ("tokens", tokens)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.words, self.chunks = Kept(WORD_BYTES), Kept(CHUNK_BYTES)

    def learn(self, words: Sequence[str]) -> None:
        """Code ``words``, distinct and new."""
        coded = [w.encode() for w in words]
        self.contract([w for w, c in zip(words, coded, strict=True) if len(c) <= LONG], [c for c in coded if len(c) <= LONG], False)
        if long := [w for w, c in zip(words, coded, strict=True) if len(c) > LONG]:
            found = self.code_long([w.encode() for w in long])
            self.words.put({w: " ".join(map(str, ids.tolist())).encode() for w, ids in zip(long, found, strict=True)})

    def contract(self, words: Sequence[str], coded: Sequence[bytes], run: bool) -> None:
        if coded:
            self.words.put(dict(zip(words, self.contracted(coded, run), strict=True)))

    def contracted(self, coded: Sequence[bytes], run: bool) -> list[bytes]:
        """The decimal ids of each, by the recursive query."""
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        number = np.repeat(np.arange(len(coded)), sizes)
        place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.db.register("fresh", pa.table({"k": number << 32 | place, "tok": self.single[np.frombuffer(b"".join(coded), np.uint8)]}))
        found = self.db.sql(contraction(run)).to_arrow_table()
        self.db.unregister("fresh")
        return found["ids"].to_pylist()

    def arrays(self, coded: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of each, in queries of a bounded size."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(coded)
        for run in (False, True):
            mine = [i for i, c in enumerate(coded) if (len(c) > LONG) == run]
            for begin, end in slices([coded[i] for i in mine], BATCH):
                for i, ids in zip(mine[begin:end], self.contracted([coded[i] for i in mine[begin:end]], run), strict=True):
                    out[i] = np.fromstring(ids, np.int32, sep=" ")
        return out

    def code_long(self, coded: Sequence[bytes]) -> list[np.ndarray]:
        """The ids of long words: of their pieces, then around seams that do not hold."""
        cuts = [[c[i : i + PIECE] for i in range(0, len(c), PIECE)] for c in coded]
        distinct = list(dict.fromkeys(p for pieces in cuts for p in pieces))
        known = dict(zip(distinct, self.arrays(distinct), strict=True))
        rows = [np.concatenate([known[p] for p in pieces]) for pieces in cuts]
        seams = [np.cumsum([len(known[p]) for p in pieces])[:-1] for pieces in cuts]
        holds: dict[tuple[int, int], bool] = {}
        reach = REACH
        while any(map(len, seams)):
            pairs = [list(zip(r[s - 1].tolist(), r[s].tolist(), strict=True)) for r, s in zip(rows, seams, strict=True)]
            fresh = [x for x in dict.fromkeys(p for ps in pairs for p in ps) if x not in holds]
            holds |= {x: ids.tolist() == list(x) for x, ids in zip(fresh, self.arrays([self.bytes[a] + self.bytes[b] for a, b in fresh]), strict=True)}
            spans = [joined([(max(0, s - reach), min(len(r), s + reach)) for s, p in zip(ss.tolist(), ps, strict=True) if not holds[p]]) for r, ss, ps in zip(rows, seams, pairs, strict=True)]
            again = [b"".join(map(self.bytes.__getitem__, r[a:b].tolist())) for r, own in zip(rows, spans, strict=True) for a, b in own]
            distinct = list(dict.fromkeys(again))
            known = dict(zip(distinct, self.arrays(distinct), strict=True))
            found = iter(again)
            for i, own in enumerate(spans):
                parts, ends, before, size = [], [], 0, 0
                for a, b in own:
                    new = known[next(found)]
                    parts += [rows[i][before:a], new]
                    size += a - before
                    ends += [size, size + len(new)]
                    size, before = size + len(new), b
                rows[i] = np.concatenate([*parts, rows[i][before:]])
                seams[i] = np.array([e for e in dict.fromkeys(ends) if 0 < e < len(rows[i])], np.int64)
            reach *= 2
        return rows

    def code_words(self, lists: Sequence[Sequence[str]]) -> list[bytes]:
        """Decimal ids of each list of words, joined by spaces; new words are coded."""
        if new := self.words.missing(set().union(*lists)):
            self.learn(new)
        known = self.words.young
        return [b" ".join([known[w] for w in words]) for words in lists]

    def split(self, chunk: str) -> list[str]:
        """The matches of a chunk with a space before it; letters with ASCII punctuation after them need no search."""
        word = chunk.rstrip(MARKS)
        if word.isalpha():
            return [" " + word] if len(word) == len(chunk) else [" " + word, chunk[len(word) :]]
        return self.find(" " + chunk)

    def code(self, texts: Sequence[str]) -> list[bytes]:
        """The decimal ids of each text, joined by spaces.

        A single space between other characters begins a match whatever stands around it, so texts
        are cut there and their chunks looked up; a window with other white space at a cut is matched whole.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        owners, parts = [], []
        for i, text in enumerate(texts):
            for part in windows(text):
                owners.append(i)
                parts.append(part)
        for begin, end in slices(parts, WINDOW):
            for i, ids in zip(owners[begin:end], self.looked_up(parts[begin:end]), strict=True):
                if ids:
                    out[i].append(ids)
        return [b" ".join(ids) for ids in out]

    def looked_up(self, texts: Sequence[str]) -> list[bytes]:
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        chunks, place = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        new = self.chunks.missing(set(chunks))
        decided = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        self.chunks.put(dict.fromkeys(new, False) | dict(zip(decided, self.code_words([self.split(c) for c in decided]), strict=True)))
        # A null, of a chunk that is not decided, makes its text null. A text's first chunk has no space before it.
        begin = cut.offsets.to_numpy()[:-1]
        heads = [chunks[k] for k in place[begin].tolist()]
        first = [None if h and self.chunks.young[h] is False else ids for h, ids in zip(heads, self.code_words([self.find(h) for h in heads]), strict=True)]
        place[begin] = len(chunks) + np.arange(len(texts))
        ids = pa.array([self.chunks.young[c] or None for c in chunks] + first, pa.binary())
        out = pc.binary_join(pa.ListArray.from_arrays(cut.offsets, ids.take(pa.array(place))), b" ").to_pylist()
        whole = [i for i, found in enumerate(out) if found is None]
        for i, found in zip(whole, self.code_words([self.find(texts[i]) for i in whole]), strict=True):
            out[i] = found
        return [found.lstrip(b" ") for found in out]

    def decode(self, ids: Sequence[np.ndarray]) -> Iterator[bytes]:
        """The bytes of each run of ids, by ordered aggregation."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.db.register("coded", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "p": np.arange(int(sizes.sum()), dtype=np.int32), "tok": np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)}))
        found = self.db.sql("SELECT d, array_to_string(list(bytes ORDER BY p), '') AS text FROM coded JOIN tokens USING (tok) GROUP BY d").to_arrow_table()
        self.db.unregister("coded")
        texts = dict(zip(found["d"].to_pylist(), found["text"].to_pylist(), strict=True))
        return (texts.get(i, "").encode("latin-1") for i in range(len(ids)))

    def decoded_hashes(self, coded: Sequence[bytes]) -> list[str]:
        """SHA-256 of the bytes that the ids of each text decode to; long texts a part after another."""
        sums = [hashlib.sha256() for _ in coded]
        held: list[np.ndarray] = []
        owners: list[int] = []
        count = 0

        def flush() -> None:
            for i, plain in zip(owners, self.decode(held), strict=True):
                sums[i].update(plain)

        for i, text in enumerate(coded):
            ids = np.fromstring(text, np.int32, sep=" ") if text else np.zeros(0, np.int32)
            for at in range(0, len(ids), DECODED):
                if count + len(ids[at : at + DECODED]) > DECODED and held:
                    flush()
                    held, owners, count = [], [], 0
                held.append(ids[at : at + DECODED])
                owners.append(i)
                count += len(held[-1])
        if held:
            flush()
        return [s.hexdigest() for s in sums]


def coder(path: str, pattern: str) -> Coder:
    """This worker's coder."""
    return resident(("coder", path, pattern), lambda: Coder(vocabulary(path), pattern))


def coding(path: str, pattern: str):
    @tidy(keeps=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end in slices(texts, 4 << 20):
                coded = own.code(texts[begin:end])
                columns = (names[begin:end], [c.count(b" ") + 1 if c else 0 for c in coded], [hashlib.sha256(c).hexdigest() for c in coded], own.decoded_hashes(coded))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CODED_ARROW, strict=True)], schema=CODED_ARROW)

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(coding(path, pattern), CODED)
