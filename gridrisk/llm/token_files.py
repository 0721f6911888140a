"""Token files: one zstandard frame for each document, a skippable frame with the document ids, and a seek table.

A file is a sequence of independent frames (the ids of one document each, little-endian unsigned 32-bit), then a
skippable frame with the documents' ids, then a skippable frame in the layout of zstandard's seekable format: for each
frame its compressed size, its decompressed size and the low 32 bits of the XXH64 of its content, and a footer with the
number of frames. A reader takes the footer and the two tables from the file's end and decompresses only the frames
of the documents that it is asked for, each checked against its checksum.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

# Fixed values of the zstandard seekable format and of skippable frames.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
NO_ID = -(1 << 63)

MANIFEST = "shard int, path string, n_docs long, n_tokens long"
READ = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"


def write_file(out, documents: Iterable[tuple[int | None, bytes]], level: int = 3) -> tuple[int, int]:
    """Write (document id, ids) pairs to a binary stream in the order given; returns the counts of documents and ids."""
    press, entries, ids, n = zstandard.ZstdCompressor(level=level), [], [], 0
    for doc, content in documents:
        frame = press.compress(content)
        out.write(frame)
        entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        ids.append(NO_ID if doc is None else doc)
        n += len(content) // 4
    for magic, body in ((SKIPPABLE_IDS, np.array(ids, "<i8").tobytes()), (SKIPPABLE_SEEK, np.array(entries, ENTRY).tobytes() + FOOTER.pack(len(ids), CHECKSUMS, SEEKABLE))):
        out.write(struct.pack("<II", magic, len(body)))
        out.write(body)
    return len(ids), n


def read_tables(f) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' ids, the seek table, and the offset of each frame, from a seekable binary stream."""
    size = f.seek(0, 2) or f.tell()
    f.seek(size - FOOTER.size)
    n, descriptor, magic = FOOTER.unpack(f.read(FOOTER.size))
    if magic != SEEKABLE or descriptor != CHECKSUMS:
        raise ValueError("the file has no seek table with checksums")
    table = n * ENTRY.itemsize + FOOTER.size
    f.seek(size - table - 8 * n - 8)
    ids = np.frombuffer(f.read(8 * n), "<i8")
    f.seek(size - table)
    entries = np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)
    return ids, entries, np.concatenate([[0], np.cumsum(entries["packed"], dtype=np.int64)])


def read_frames(f, frames: Iterable[int], tables: tuple | None = None) -> Iterator[tuple[int | None, bytes]]:
    """(document id, ids) of the frames with these numbers; no other frame is read. Raises on a wrong checksum."""
    ids, entries, at = tables or read_tables(f)
    unpress = zstandard.ZstdDecompressor()
    for k in frames:
        f.seek(int(at[k]))
        content = unpress.decompress(f.read(int(entries["packed"][k])), max_output_size=int(entries["plain"][k])) if entries["plain"][k] else b""
        if len(content) != entries["plain"][k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        yield None if ids[k] == NO_ID else int(ids[k]), content


def read_documents(path: str, wanted: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """The ids of the documents asked for, one array for each row with a document's id, in the file's order.

    A document that the file doesn't hold isn't in the result. Raises where a frame doesn't fit its checksum.
    """
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        tables = read_tables(f)
        frames = np.flatnonzero(np.isin(tables[0], np.fromiter(wanted, np.int64)))
        found: dict[int, list[np.ndarray]] = {}
        for doc, content in read_frames(f, frames, tables):
            found.setdefault(doc, []).append(np.frombuffer(content, "<u4"))
        return found


def stretch(documents: Iterator[tuple[int | None, bytes]], most: int) -> Iterator[tuple[int | None, bytes]]:
    """The next documents up to about `most` bytes, of ids and 256 a document for its entries in the tables; one at least."""
    size = 0
    for doc, content in documents:
        yield doc, content
        size += len(content) + 256
        if size >= most:
            return


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None, level: int = 3, file_bytes: int = 256_000_000) -> DataFrame:
    """Encode all documents and write them in ascending order of doc_id; returns the manifest, a row for each file.

    Documents are dealt by ranges of (doc_id, hash of the text), so that many rows with one id don't meet in a task;
    ids that are null come first, and rows with the same id are ordered by that hash. A null text counts as empty and
    so is its end id alone. A task writes one file after another, each of about file_bytes of ids before compression, so
    that what it holds doesn't grow with its range. Files have names of their own, and the manifest names those of the
    tasks that counted: what a lost or repeated task wrote isn't read. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder, path, end = folder or common.new_folder(spark, "tokens"), tokenizer or tokens.default_path(), int(end_id).to_bytes(4, "little")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(common.partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        rest = ((doc, x + end) for docs, found in tokens.encoder(path).stretches(common.filled(batches)) for doc, x in zip(docs, found))
        fs, base = pafs.FileSystem.from_uri(folder)
        for part in count():
            if (first := next(rest, None)) is None:
                return
            fs.create_dir(base, recursive=True)
            name = f"shard-{shard:06d}-{part:06d}-{uuid.uuid4().hex}.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                n_docs, n_tokens = write_file(out, stretch(chain([first], rest), file_bytes), level)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    return common.settle(common.in_arrow(dealt, run, MANIFEST, keeps=True), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest: a row for each document with the count of ids before it in all files, its count and CRC.

    A document without an id has a null doc_id, and one without ids, which write() doesn't make, a count of 0; repeated
    rows come back each for itself, and an empty manifest gives no rows. Raises where a frame doesn't fit its checksum.
    """
    spark: SparkSession = manifest.sparkSession
    before = F.sum("n_tokens").over(Window.orderBy("shard", "path").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("start")).repartitionByRange(common.partitions(spark), "shard", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            for shard, path, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    tables, rows = read_tables(f), []
                    for doc, content in read_frames(f, range(len(tables[0])), tables):
                        rows.append((doc, shard, start, len(content) // 4, zlib.crc32(content)))
                        start += len(content) // 4
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    return common.in_arrow(files, run, READ)
