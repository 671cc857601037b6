"""Token ids by the tokenizers library, each distinct chunk encoded once.

A text is cut only where the tokenizer's own splits fall whatever stands on either side, so the
ids of a text are those of its chunks joined. A text with the string of a special token goes to the
library as it is.

``WordEncoder`` keeps what a worker has met, a run of letters and the punctuation after it apart, in
tables bounded in bytes; the rest are look-ups. ``ByteEncoder`` keeps nothing: it takes ``RUN_BYTES`` of text at
a time as arrays, finds their distinct chunks and gives these to the library in one call.

Long texts are taken in windows that end at such cuts, so a worker holds about ``SLICE_BYTES`` of text as
chunks, or ``RUN_BYTES`` of it as arrays.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crossfactor.llm.common import SLICE_BYTES, Kept, resident
from crossfactor.llm.hashing import slices

#: Bytes that a worker's tables of chunks and of words take.
TABLE_BYTES = 40 << 20, 16 << 20
#: Bytes of text that a ``ByteEncoder`` takes at a time: the more, the fewer chunks are encoded again.
RUN_BYTES = 16 << 20
#: Characters that it gives to the library in a call, about.
BLOCK = 1 << 16
#: ASCII punctuation that always ends a run of letters; the apostrophe does not, as in "can't".
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: A space between printable ASCII characters: no split of either style looks across it.
CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


def windows(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end before a space at which a cut is safe; a text without such spaces is one part."""
    begin = 0
    while len(text) - begin > size and (found := CUT.search(text, begin + size)):
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in the ranges, ends included."""
    found = np.zeros(256, bool)
    for first, last in ranges:
        found[first : last + 1] = True
    return found


#: ASCII letters; and ASCII punctuation as in MARKS.
LETTER, MARK = byte_set((65, 90), (97, 122)), np.isin(np.arange(256), list(MARKS))
#: ASCII white space of the pattern.
WHITE = byte_set((9, 13), (32, 32))
#: Bytes that begin a character which is no white space. C2, E1, E2 and E3 begin some that are.
SOLID = byte_set((33, 126), (0xC3, 0xE0), (0xE4, 0xEE), (0xF0, 0xF4))
#: Bytes of runs of letters: ASCII, Latin (U+00C0 to U+023F) and Cyrillic (U+0400 to U+047F) ones; two signs among them are none.
PLAIN = LETTER | byte_set((0x80, 0xBF), (0xC3, 0xC8), (0xD0, 0xD1))
SIGNS = (0x97, 0xB7)
#: For each byte the letter that stands for it.
SHOWN = "".join(chr(byte_letters().get(b, b)) for b in range(256))


class Encoder:
    """With ``special_as_text`` the strings of special tokens are ordinary text; without, they give their tokens, as by a plain call of the library."""

    #: Bytes of text taken at a time.
    held = SLICE_BYTES

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        special = [] if special_as_text else [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special)) if special else None

    def raw(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: bytes) -> bytes:
        """Ids by the library alone."""
        return b"".join(self.raw([w.decode()])[0] for w in windows(text, SLICE_BYTES // 16))

    def looked_up(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each text by its chunks."""
        raise NotImplementedError

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        out: list[list[bytes]] = [[] for _ in texts]
        owners, parts = [], []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                out[i].append(self.whole(text))
            else:
                for part in windows(text):
                    owners.append(i)
                    parts.append(part)
        for begin, end in slices(parts, self.held):
            for i, ids in zip(owners[begin:end], self.looked_up(parts[begin:end]), strict=True):
                out[i].append(ids)
        return [b"".join(ids) for ids in out]


class WordEncoder(Encoder):
    """For a tokenizer that lowers case and drops white space."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        super().__init__(path, special_as_text)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.chunks, self.words = map(Kept, TABLE_BYTES)

    def plain(self, word: bytes) -> str | None:
        """What the model sees of a run of letters that the normalizer leaves as it is; None for other words."""
        text = word.decode()
        if not text.isalpha() or not (text == text.lower() and unicodedata.is_normalized("NFC", text)):
            return None
        return text if text.isascii() else word.decode("latin-1").translate(self.letters)

    def learn(self, chunks: Sequence[bytes]) -> None:
        """Encode new chunks."""
        words = [c.rstrip(MARKS) for c in chunks]
        # A word by itself, marks after it with a space before them, which no word holds.
        tails = [b" " + c[len(w) :] if len(w) < len(c) else b"" for c, w in zip(chunks, words, strict=True)]
        fresh: dict[bytes, bytes | None] = {}
        for word in self.words.missing(set(words) - {b""}):
            shown = self.plain(word)
            if shown is not None:
                ids = [t.id for t in self.merge(shown)]
                fresh[word] = struct.pack(f"<{len(ids)}I", *ids)
        marks = self.words.missing(set(tails) - {b""})
        fresh |= zip(marks, self.raw([m[1:].decode() for m in marks]), strict=True)
        self.words.put(fresh)
        known, whole, new = self.words.young, [], {}
        for chunk, word, tail in zip(chunks, words, tails, strict=True):
            ids = known.get(word) if word else None
            if ids is None:
                whole.append(chunk)
            else:
                new[chunk] = ids + known[tail] if tail else ids
        new.update(zip(whole, self.raw([c.decode() for c in whole]), strict=True))
        self.chunks.put(new)

    def looked_up(self, texts: Sequence[bytes]) -> list[bytes]:
        cut = [t.lower().split() for t in texts]
        distinct = set().union(*cut)
        self.learn(self.chunks.missing(distinct))
        # A smaller table of the chunks at hand stays in the processor's cache.
        known = {c: self.chunks.young[c] for c in distinct}
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a chunk begins or ends at each place of UTF-8 texts with these bounds: where the byte-level pattern always splits, whatever stands on either side.

    White space before something else leaves its last character apart, and a space joins what follows, so a
    split falls before that character and, but for a space, after it; one falls before all white space
    that follows something else, and between a letter and a mark, as marks begin no "'s".
    """
    around = np.concatenate((data, np.zeros(1, np.uint8)))
    white = np.flatnonzero(WHITE[data])
    found = np.zeros(len(data) + 1, bool)
    found[bounds] = True
    solid = SOLID[around[white + 1]] & ~found[white + 1]
    behind = white[(white > 0) & (LETTER | MARK)[around[white - 1]]]
    line = white[solid & (data[white] != 32)] + 1
    mark = np.flatnonzero(MARK[data])
    mark = mark[(mark > 0) & LETTER[around[mark - 1]]]
    for places in (white[solid], behind, line, mark):
        found[places] = True
    return found


class ByteEncoder(Encoder):
    """For a tokenizer with the usual byte-level pattern, in which a space leads a token."""

    held = RUN_BYTES

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        super().__init__(path, special_as_text)
        from tokenizers import Tokenizer, pre_tokenizers

        # For runs of letters, which the pattern leaves whole: the same model, with splits at line feeds alone.
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = pre_tokenizers.Split(SHOWN[10], "isolated")
        self.feed = self.tokenizer.token_to_id(SHOWN[10])

    def lines(self, tokenizer, text: str, feed: str, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the ``count`` chunks of ``text``, each closed by a ``feed``, and how many each has."""
        parts, begin = [np.zeros(0, "<u4")], 0
        while begin < len(text):
            end = text.find(feed, begin + BLOCK) + 1 or len(text)
            parts.append(np.array(tokenizer.encode_batch_fast([text[begin:end]], add_special_tokens=False)[0].ids, "<u4"))
            begin = end
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.feed)
        if len(ends) != count:
            raise ValueError(f"{count} chunks gave the ids of {len(ends)}")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def learnt(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
        """Ids of distinct chunks in some order, and each chunk's place in it."""
        offsets = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, 4 * chunks.offset)
        data = np.frombuffer(chunks.buffers()[2], np.uint8)[: offsets[-1]]
        first, last = offsets[:-1], offsets[1:]
        odd = ~PLAIN[data]
        odd[1:] |= (data[:-1] == 0xC3) & np.isin(data[1:], SIGNS)
        first = first + (data[first] == 32)
        sums = np.concatenate(([0], np.cumsum(odd, dtype=np.int32)))
        plain = (sums[last] == sums[first]) & (last > first)
        count = int(plain.sum())
        joined = pc.binary_join(pa.ListArray.from_arrays([0, count], chunks.filter(pa.array(plain))), b"\n")[0].as_buffer()
        letters, own = self.lines(self.runs, codecs.charmap_decode(joined, "strict", SHOWN)[0] + SHOWN[10] if count else "", SHOWN[10], count)
        others = np.flatnonzero(~plain)
        texts = [c.decode() for c in chunks.take(pa.array(others)).to_pylist()]
        # Among line feeds each of these gives the ids that it gives alone; the rest go alone.
        cores = [t[t[0] == " " :] for t in texts]
        among = np.array([bool(c) and not c[0].isspace() and not c[-1].isspace() and "\n" not in c for c in cores], bool)
        inside = [t for t, a in zip(texts, among, strict=True) if a]
        mixed, each = self.lines(self.tokenizer, "".join(f"{t}\n" for t in inside), "\n", len(inside))
        alone = [t for t, a in zip(texts, among, strict=True) if not a]
        rest = [i for begin, end in slices(alone) for i in self.raw(alone[begin:end])]
        place = np.empty(len(chunks), np.int32)
        place[np.concatenate((np.flatnonzero(plain), others[among], others[~among]))] = np.arange(len(chunks), dtype=np.int32)
        sizes = np.concatenate((4 * own, 4 * each, np.array([len(i) for i in rest], np.int64)))
        ids = letters.tobytes() + mixed.tobytes() + b"".join(rest)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        return place, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def looked_up(self, texts: Sequence[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return [b"" for _ in texts]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        places = np.flatnonzero(cuts(data, bounds)).astype(np.int32)
        chunks = pa.BinaryArray.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        place, ids = self.learnt(chunks.dictionary)
        joined = ids.take(pa.array(place[chunks.indices.to_numpy()]))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[np.searchsorted(places, bounds)].tolist()
        view = memoryview(joined.buffers()[2])
        return [bytes(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str, style: str, special_as_text: bool = False) -> Encoder:
    """This worker's encoder; ``style`` is ``words`` or ``bytes``, the class."""
    made = {"words": WordEncoder, "bytes": ByteEncoder}[style]
    return resident(("encoder", path, style, special_as_text), lambda: made(path, special_as_text))
