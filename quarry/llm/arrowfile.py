"""Token ids as Arrow files: record batches of fixed-size lists, read by memory map.

The ids of all documents, in order of doc_id, are one long row of numbers. A
task writes its range of documents as one file in Arrow's file format (the
stream format with a footer): batches of ``rows`` sequences of ``length`` ids
and a mask of the same shape, false behind the file's last id. Beside it lies
an index file: doc_id, start within the file and n_tokens. Sequence i of a
file is row i % rows of batch i // rows, so any sequence is found without
reading another, and a memory map gives it without copying.

Files are named by attempt. Only those that a committed row of the manifest
names belong to the data, so a lost executor or a speculative task leaves
files that nothing reads, never a wrong one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import cut, shared_dir, small_batches
from quarry.llm.tokens import ByteEncoder, encoder

#: Ids of a sequence, sequences of a batch.
LENGTH, ROWS = 2048, 64
#: Appended to every document.
END = 2
#: Ids of this type suffice for the vocabulary of 50,257.
IDS = pa.uint16()


def opened(uri: str) -> pa.NativeFile:
    """A file for random access: a memory map where the shared folder is mounted."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)


def created(uri: str) -> pa.NativeFile:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def _values(column: pa.FixedSizeListArray, length: int) -> pa.Array:
    """The flat items of a batch's lists, not copied."""
    return column.values.slice(column.offset * length, len(column) * length)


class SequenceFile:
    """Random access to the sequences of one file; arrays point into the map."""

    def __init__(self, uri: str):
        self.reader = pa.ipc.open_file(opened(uri))
        self.length = self.reader.schema.field("ids").type.list_size
        meta = self.reader.schema.metadata
        self.rows, self.sequences = int(meta[b"rows"]), 0
        if self.reader.num_record_batches:
            last = self.reader.get_batch(self.reader.num_record_batches - 1)
            self.sequences = (self.reader.num_record_batches - 1) * self.rows + last.num_rows

    def __len__(self) -> int:
        return self.sequences

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        if not 0 <= i < self.sequences:
            raise IndexError(i)
        batch, row = self.reader.get_batch(i // self.rows), i % self.rows
        ids = _values(batch.column("ids"), self.length).slice(row * self.length, self.length)
        return ids.to_numpy(zero_copy_only=True), _values(batch.column("mask"), self.length).slice(row * self.length, self.length)

    def batches(self) -> Iterator[tuple[np.ndarray, int]]:
        """All ids of each batch, and how many of them the mask covers."""
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            yield _values(batch.column("ids"), self.length).to_numpy(zero_copy_only=True), _values(batch.column("mask"), self.length).true_count


class _Writer:
    """Ids as they come, cut into batches; at most one batch is held."""

    def __init__(self, uri: str, length: int, rows: int, key: pa.DataType):
        self.length, self.rows = length, rows
        self.type = pa.list_(pa.field("item", IDS, nullable=False), length)
        self.mask = pa.list_(pa.field("item", pa.bool_(), nullable=False), length)
        self.schema = pa.schema([pa.field("ids", self.type, nullable=False), pa.field("mask", self.mask, nullable=False)], metadata={"rows": str(rows)})
        self.index_schema = pa.schema([("doc_id", key), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [created(f"{uri}.tokens.arrow"), created(f"{uri}.index.arrow")]
        self.out, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.held: list[np.ndarray] = []
        self.size = self.tokens = self.docs = 0

    def add(self, keys: pa.Array, ids: list[bytes], end: int) -> None:
        """Documents in order, ``ids`` being unsigned 32-bit numbers."""
        counts = np.array([len(i) // 4 + 1 for i in ids], dtype=np.int64)
        flat = np.empty(int(counts.sum()), dtype=np.uint16)
        stops = np.cumsum(counts)
        inside = np.ones(len(flat), dtype=bool)
        inside[stops - 1] = False
        flat[inside] = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.uint16)
        flat[stops - 1] = end
        self.index.write_batch(pa.record_batch([keys, pa.array(self.tokens + stops - counts), pa.array(counts)], schema=self.index_schema))
        self.tokens += len(flat)
        self.docs += len(ids)
        self.held.append(flat)
        self.size += len(flat)
        whole = self.length * self.rows
        if self.size >= whole:
            joined = np.concatenate(self.held)
            for a in range(0, self.size - whole + 1, whole):
                self._write(joined[a : a + whole], whole)
            self.held = [joined[self.size // whole * whole :]]
            self.size = len(self.held[0])

    def _write(self, ids: np.ndarray, known: int) -> None:
        mask = np.arange(len(ids)) < known
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids, IDS), type=self.type)
        self.out.write_batch(pa.record_batch([lists, pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.mask)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            rest = np.concatenate(self.held)
            padded = np.zeros(-(-self.size // self.length) * self.length, dtype=np.uint16)
            padded[: self.size] = rest
            self._write(padded, self.size)
        for writer in (self.out, self.index, *self.sinks):
            writer.close()


def write_tokens(docs: DataFrame, path: str, length: int = LENGTH, rows: int = ROWS, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) under ``path``; returns the manifest: shard, file, docs, tokens.

    Shards are ranges of doc_id, written in order; a null id comes before all
    others, and rows of one id lie together, in any order that is the same at
    each attempt (repeated rows may lie in two neighbouring shards). A null
    text is empty, an empty one is its end alone. An empty table has no files.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not 0 <= end < 1 << IDS.bit_width:
        raise ValueError("the end must be an id of the vocabulary")
    text = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sorted_ = text.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, shard = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                shard = batch.column("shard")[0].as_py()
                name = f"{path}/{shard:07d}-{uuid.uuid4().hex[:12]}"
                writer = _Writer(name, length, rows, batch.column("doc_id").type)
            writer.add(batch.column("doc_id"), encoder(vocabulary, ByteEncoder).encode(batch.column("text").to_pylist()), end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([writer.docs], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["shard", "file", "docs", "tokens"])

    return cut(sorted_.mapInArrow(write, "shard bigint, file string, docs bigint, tokens bigint"), "manifest")


def _digests(uri: str, before: int, tokens: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, start, n_tokens and CRC of the documents of a file, by batches of its index."""
    ids = SequenceFile(f"{uri}.tokens.arrow").batches()
    known, view, at, left = 0, memoryview(b""), 0, 0
    index = pa.ipc.open_file(opened(f"{uri}.index.arrow"))
    for k in range(index.num_record_batches):
        batch = index.get_batch(k)
        start, count = batch.column("start").to_numpy(), batch.column("n_tokens").to_numpy()
        found = np.zeros(len(count), dtype=np.int64)
        for i, need in enumerate(count.tolist()):
            crc = 0
            while need:
                if not left:
                    flat, covered = next(ids)
                    known += covered
                    view, at, left = memoryview(flat[:covered].astype("<u4")).cast("B"), 0, covered
                some = min(need, left)
                crc = zlib.crc32(view[4 * at : 4 * (at + some)], crc)
                at, left, need = at + some, left - some, need - some
            found[i] = crc
        yield batch.column("doc_id"), start + before, count, found
    if left or known != tokens or next(ids, None) is not None:
        raise ValueError(f"{uri} holds other ids than its manifest says")


def read_documents(spark: SparkSession, manifest: DataFrame, key: StructField) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the files.

    One task reads one file. The manifest has a row per file, a few hundred
    bytes each; the driver adds up its tokens.
    """
    files, before = [], 0
    for row in manifest.orderBy("shard").collect():
        files.append((row["file"], before, row["tokens"]))
        before += row["tokens"]
    schema = StructType([StructField("doc_id", key.dataType), *(StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "i bigint, file string, before bigint, tokens bigint")
    each = spark.range(0, len(files), 1, len(files)).join(F.broadcast(listed), F.col("id") == F.col("i")).select("file", "before", "tokens")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for keys, *numbers in _digests(row["file"], row["before"], row["tokens"]):
                    yield pa.RecordBatch.from_arrays([keys, *map(pa.array, numbers)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return each.mapInArrow(read, schema)


def token_files(docs: DataFrame, **options) -> DataFrame:
    """``docs`` written to the shared folder and read back; see :func:`write_tokens` and :func:`read_documents`."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, f"{shared_dir(spark)}/quarry/tokens-{uuid.uuid4().hex}", **options)
    return read_documents(spark, manifest, docs.schema["doc_id"])
