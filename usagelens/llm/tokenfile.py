"""Token ids of all documents in bit-plane files.

``encode`` ids, ``write`` files, ``read`` them back.  Documents lie in ascending ``doc_id``
order (nulls first; rows of one id in the order of their text's hash), dealt over files by
range, each document closed by ``end_id``.

A file is a row of frames and a footer.  A frame is one block of ``block`` ids (the last may
be shorter): the ids' bytes, or bits, are transposed so that equal positions lie together,
and each such plane is compressed by zstandard on its own.  The footer is the chunk index
(offset and size of every plane, ids of every block) and the table of documents; the last 16
bytes say where it begins.  One block and one batch of texts is all a task holds.

A task writes under a name of its own and renames the file when it is complete, so repeated
attempts are harmless.  What ``write`` returns is stored and names the complete files.

Null texts are empty ones and have only the end id.  An empty table has no files and reads
back as no rows.  Repeated rows are kept.  Other columns are not read.
"""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from usagelens.llm.common import scratch, stored, whole_text

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MAGIC = b"PLANES01"
BLOCK = 1 << 16
CACHE = 400_000
#: Units: letters and digits with the space before them; an apostrophe with what belongs to
#: it; other signs with the space before them; white space.
UNITS = re.compile(r" ?[^\W_]+|'(?:[^\w\s]|_)*[^\W_]*| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+").findall
#: White space here, but not for the tokenizer: such a text is encoded whole.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Latin letters, of which every version of Unicode thinks the same: such a unit is one match.
PLAIN = re.compile(" ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
#: Printable bytes stand for themselves in the vocabulary, the others for U+0100 and up.
PRINTABLE = {*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)}
OTHERS = {b: 0x100 + i for i, b in enumerate(sorted({*range(0x100)} - PRINTABLE))}
ALPHABET = "".join(chr(OTHERS.get(b, b)) for b in range(0x100))


class Units(dict[str, bytes]):
    """Packed ids of units; one that is missing is encoded by the library when asked for.

    The splitter and the model are those of the whole call, which also spares the offsets.  Two
    generations of about ``CACHE`` units; a unit that is met again moves to the young
    one, so frequent units stay.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.split, self.model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        packed = self.old.get(unit)
        if packed is None:
            if PLAIN(unit):
                matches = [unit.encode().decode("latin-1").translate(ALPHABET)]
            else:
                matches = [match for match, _ in self.split(unit)]
            ids = [token.id for match in matches for token in self.model(match)]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        self[unit] = packed
        return packed

    def age(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class LibraryEncoder:
    """Batches of texts to packed ids through the tokenizers library.

    Texts are cut into units at places where the tokenizer's splitting pattern always ends a
    match, and the library encodes each unit that is not in the cache.  A text that contains
    an added token (such as an end mark it quotes) goes to the library whole, which gives the
    token's own id.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = [*ODD_SPACE, *(t.content for t in added)]
        self.units = Units(self.tokenizer)

    @staticmethod
    @lru_cache(2)
    def load(path: str) -> LibraryEncoder:
        return LibraryEncoder(path)

    def many(self, texts: list[str]) -> list[bytes]:
        return [self._whole(t) if any(mark in t for mark in self.whole) else self._parts(t)
                for t in texts]

    def _parts(self, text: str) -> bytes:
        self.units.age()
        return b"".join(map(self.units.__getitem__, UNITS(text)))

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte or bit planes of a block of ids, least significant first."""
    rows = ids.astype("<u4").view("u1").reshape(len(ids), 4)
    if bits:
        return [np.packbits(p).tobytes()
                for p in np.unpackbits(rows, axis=1, bitorder="little").T]
    return [np.ascontiguousarray(p).tobytes() for p in rows.T]


def ids_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        rows = np.stack([np.unpackbits(np.frombuffer(p, "u1"), count=n) for p in planes], axis=1)
        rows = np.packbits(rows, axis=1, bitorder="little")
    else:
        rows = np.stack([np.frombuffer(p, "u1") for p in planes], axis=1)
    return np.ascontiguousarray(rows).view("<u4").reshape(n)


class PlaneWriter:
    """Ids in, frames out; ``close`` adds the footer."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False) -> None:
        self.out, self.block, self.bits = out, block, bits
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.at, self.total, self.index = len(MAGIC), 0, []
        self.waiting, self.n_waiting, self.documents = [], 0, []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, len(ids)))
        self.total += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            flat = np.concatenate(self.waiting)
            full = len(flat) // self.block * self.block
            for i in range(0, full, self.block):
                self._frame(flat[i:i + self.block])
            self.waiting, self.n_waiting = [flat[full:]], len(flat) - full

    def _frame(self, ids: np.ndarray) -> None:
        packed = [self.compress(p) for p in planes_of(ids, self.bits)]
        self.index.append([self.at, len(ids), *map(len, packed)])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_waiting:
            self._frame(np.concatenate(self.waiting))
        doc_ids, sizes = zip(*self.documents) if self.documents else ((), ())
        sink = io.BytesIO()
        documents = pa.table({"doc_id": pa.array(doc_ids, pa.int64()),
                              "n_ids": pa.array(sizes, pa.int64())})
        with pa.ipc.new_stream(sink, documents.schema) as stream:
            stream.write_table(documents)
        index = json.dumps({"bits": self.bits, "frames": self.index}).encode()
        footer = self.compress(struct.pack("<Q", len(index)) + index + sink.getvalue())
        self.out.write(footer + struct.pack("<Q", self.at) + MAGIC)


class PlaneReader:
    """Random access to the blocks of one file, and its documents in order."""

    def __init__(self, file) -> None:
        self.file, self.expand = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        file.seek(size - 16)
        (at,), magic = struct.unpack("<Q", file.read(8)), file.read(8)
        if magic != MAGIC:
            raise ValueError("not a complete plane file")
        file.seek(at)
        footer = self.expand(file.read(size - 16 - at))
        n, = struct.unpack("<Q", footer[:8])
        index = json.loads(footer[8:8 + n])
        self.bits, self.frames = index["bits"], index["frames"]
        self.documents = pa.ipc.open_stream(footer[8 + n:]).read_all()

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.frames[k]
        self.file.seek(at)
        return ids_of([self.expand(self.file.read(s)) for s in sizes], n, self.bits)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        rest, k = np.empty(0, "<u4"), 0
        for batch in self.documents.to_batches(max_chunksize=10_000):
            for doc_id, n in zip(batch["doc_id"].to_pylist(), batch["n_ids"].to_pylist()):
                parts, have = [rest], len(rest)
                while have < n:
                    parts.append(self.block(k))
                    have, k = have + len(parts[-1]), k + 1
                flat = np.concatenate(parts) if len(parts) > 1 else rest
                yield doc_id, flat[:n]
                rest = flat[n:]


def write(documents: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER,
          end_id: int = 0, block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Write the files; a stored table ``file_no, path, n_docs, n_ids`` of them.

    ``folder`` is a URI that all executors reach (default: below the shared folder).
    """
    spark = documents.sparkSession
    folder = folder or scratch(spark, "tokens")

    def write_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, writer = TaskContext.get(), LibraryEncoder.load(tokenizer), None
        end = np.array([end_id], "<u4").tobytes()
        files, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/part-{task.partitionId():06d}.planes"
        own = f"{path}.{task.taskAttemptId()}"
        for batch in batches:
            if writer is None and batch.num_rows:
                files.create_dir(root, recursive=True)
                stream = files.open_output_stream(own)
                writer = PlaneWriter(stream, block, bits)
            ids = encoder.many(batch["text"].to_pylist())
            for doc_id, packed in zip(batch["doc_id"].to_pylist(), ids):
                writer.add(doc_id, np.frombuffer(packed + end, "<u4"))
        if writer is not None:
            writer.close()
            stream.close()
            files.move(own, path)
            yield pa.RecordBatch.from_pydict({
                "file_no": pa.array([task.partitionId()], pa.int64()),
                "path": pa.array([path]),
                "n_docs": pa.array([len(writer.documents)], pa.int64()),
                "n_ids": pa.array([writer.total], pa.int64())})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            whole_text().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    written = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
               .mapInArrow(write_file, "file_no long, path string, n_docs long, n_ids long"))
    manifest = stored(written, "token_files")
    return manifest.withColumn("folder", F.lit(folder))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document of the files; ``start`` counts the
    ids of all documents before it, ``ids`` are packed as unsigned 32-bit integers."""
    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path, start in zip(*(batch[c].to_pylist()
                                             for c in ("folder", "path", "first"))):
                files, _ = pafs.FileSystem.from_uri(folder)
                with files.open_input_file(path) as file:
                    yield from _document_batches(PlaneReader(file), start)

    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(
        Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (files.select("file_no", "folder", "path", "first")
            .repartition(max(1, manifest.count()), "file_no")
            .mapInArrow(read_files, "doc_id long, start long, n_tokens long, ids binary"))


def _document_batches(reader: PlaneReader, start: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for doc_id, ids in reader:
        rows.append((doc_id, start, len(ids), ids.tobytes()))
        start, size = start + len(ids), size + len(ids)
        if size >= 1 << 20:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n, ids = zip(*rows)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()),
        "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})
