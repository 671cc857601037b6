"""Token files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file is a run of zstandard frames, the last of them an index of its documents, then a skippable
frame with the seek table of the published seekable format: for each frame its compressed and
decompressed size and the low 32 bits of the XXH64 of its content, then the frame count, a
descriptor with the checksum flag and the magic number. Ids are little-endian unsigned 32-bit; a
document may span frames. A reader takes the table from the end of the file, the index from the
last frame, and decompresses only the frames that hold the documents asked for.

Rows are dealt by ranges of ``doc_id``, and of a hash of the text within one, so files follow one another in
ascending order and one id on many rows fills many files; their number follows the bytes. A task writes
under a name of its own attempt and only reported files count, so a lost or repeated task leaves
no wrong data. The manifest has a row per file; starts are sums of it.

Defined results: null and empty texts give the end id alone; null ids come first; repeated ids and rows
follow one another; a long text spans frames; an empty table gives no files and no rows; other columns, whatever
their names, are ignored. The files stay: they are the output.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossfactor.llm.common import ROW_BYTES, shared_folder, text_or_empty, tidy, written
from crossfactor.llm.tokens import RUN_BYTES, encoder

FRAME_BYTES = 1 << 18
#: Bytes of text in a file, about.
FILE_BYTES = 128 << 20
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

MANIFEST = "path string, part int, docs long, ids long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes documents' ids to an open binary file."""

    def __init__(self, file, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        import zstandard

        self.file, self.size, self.compress = file, frame_bytes, zstandard.ZstdCompressor(level=level).compress
        self.pending = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.names: list[int | None] = []
        self.counts: list[int] = []

    def frame(self, data: bytes) -> None:
        packed = self.compress(data)
        self.file.write(packed)
        self.frames.append((len(packed), len(data), checksum(data)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.names.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.pending += ids
        while len(self.pending) >= self.size:
            self.frame(bytes(self.pending[: self.size]))
            del self.pending[: self.size]

    def close(self) -> None:
        if self.pending:
            self.frame(bytes(self.pending))
        known = np.array([n is not None for n in self.names], np.uint8)
        names = np.array([n or 0 for n in self.names], "<i8")
        self.frame(struct.pack("<Q", len(known)) + known.tobytes() + names.tobytes() + np.array(self.counts, "<i8").tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()


class Reader:
    """Reads from an open random-access file; frames are decompressed as they are asked for."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        count, flag, magic = struct.unpack("<IBI", self.bytes_at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("not a token file")
        table = np.frombuffer(self.bytes_at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.packed, self.plain, self.sums = table.T
        self.place, self.begin = np.cumsum(self.packed) - self.packed, np.cumsum(self.plain) - self.plain
        self.last: tuple[int, bytes] = (-1, b"")
        index = self.frame(count - 1)
        docs = struct.unpack_from("<Q", index)[0]
        self.known = np.frombuffer(index, np.uint8, docs, 8).astype(bool)
        self.names = np.frombuffer(index, "<i8", docs, 8 + docs)
        self.counts = np.frombuffer(index, "<i8", docs, 8 + 9 * docs)
        self.starts = np.cumsum(self.counts) - self.counts

    def bytes_at(self, place: int, size: int) -> bytes:
        self.file.seek(int(place))
        return self.file.read(int(size))

    def frame(self, k: int) -> bytes:
        import zstandard

        if self.last[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self.bytes_at(self.place[k], self.packed[k]), max_output_size=int(self.plain[k]))
            if checksum(data) != self.sums[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self.last = k, data
        return self.last[1]

    def document(self, i: int) -> bytes:
        """The ids of the file's document number ``i``."""
        begin, end = 4 * int(self.starts[i]), 4 * int(self.starts[i] + self.counts[i])
        parts, k = [], int(np.searchsorted(self.begin[:-1], begin, "right")) - 1
        while begin < end:
            data = self.frame(k)
            at = begin - int(self.begin[k])
            parts.append(data[at : at + end - begin])
            begin, k = begin + len(parts[-1]), k + 1
        return b"".join(parts)


def folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs

    return pa.fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts of rows that follow one another, of about ``size`` bytes, batch ends or not; a longer text is a run of its own."""
    names, texts, held = [], [], 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if names and held + len(text) > size:
                yield names, texts
                names, texts, held = [], [], 0
            names.append(name)
            texts.append(text)
            held += len(text) + ROW_BYTES
    if names:
        yield names, texts


def writing(path: str, to: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    @tidy(keeps=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, name, docs, ids = TaskContext.get().partitionId(), None, "", 0, 0
        for names, texts in runs(batches, RUN_BYTES):
            if writer is None:
                fs, root = folder(to)
                name = f"part-{part:05d}-{uuid.uuid4().hex}.ids.zst"
                writer = Writer(fs.open_output_stream(f"{root}/{name}", compression=None))
            for doc_id, found in zip(names, encoder(path, "bytes").encode(texts), strict=True):
                writer.add(doc_id, found + end)
                docs, ids = docs + 1, ids + len(found) // 4 + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([docs]), pa.array([ids])], names=["path", "part", "docs", "ids"])

    return run


def write(docs: DataFrame, path: str, to: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as token files into the shared folder ``to``; returns the manifest with each file's start."""
    fs, root = folder(to)
    fs.create_dir(root, recursive=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("__text"), F.xxhash64("text").alias("__hash"))
    dealt = own.repartitionByRange(count, "doc_id", "__hash").sortWithinPartitions("doc_id", "__hash").drop("__hash")
    manifest = written(dealt.mapInArrow(writing(path, to, end_id), MANIFEST), "ids-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def reading(to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = folder(to)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    reader = Reader(file, file.size())
                    for begin in range(0, len(reader.names), 10_000):
                        stop = min(begin + 10_000, len(reader.names))
                        sums = [zlib.crc32(reader.document(i)) for i in range(begin, stop)]
                        columns = [pa.array(reader.names[begin:stop], mask=~reader.known[begin:stop]), pa.array(reader.starts[begin:stop] + first), pa.array(reader.counts[begin:stop]), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, schema=READ_ARROW)

    return run


def read(manifest: DataFrame, to: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    files = manifest.select("path", "first")
    files = files.repartition(max(files.count(), 1), "path")  # a file or so a task
    return files.mapInArrow(reading(to), READ_BACK)


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    to = f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read(write(docs, path, to, end_id), to)
