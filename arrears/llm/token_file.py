"""Token-id output in Arrow's file format with equal-length sequences.

Documents are range-partitioned and sorted by id, then by text, so a repeated attempt writes
the same order and an id that many rows share is no single range. Each task encodes its range
and writes files whose batches hold two fixed-size-list columns of plain bytes and integers:
``ids`` and ``mask`` (1: a token, 0: padding after the last token of a file). Documents follow one another without gaps;
every file ends padded to a whole sequence, so sequence k of a file starts at token
k * length and any document or sequence is a slice of a memory-mapped buffer. File names sort
in document order. A task writes under a temporary name and renames when the file is whole,
so a repeated or speculative attempt replaces a file by an equal one and never shows half of it.

The index (one row per document: id, file, first token in the file, number of tokens) is a
table beside the files. ``starts`` adds the global position from the files' totals.

Edge cases: null and empty texts hold the end id only. Null ids sort first; repeated ids go by
the hash of their text, then by the text, and whole repeated rows are equal. An empty table writes no file. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.tokens import definition, text_encoder

LENGTH = 1024
BATCH_SEQUENCES = 256
FILE_TOKENS = 1 << 26
INDEX = "doc_id bigint, file string, first bigint, n_tokens bigint"


class _Writer:
    """One file: tokens in, whole sequences out."""

    def __init__(self, folder: str, name: str, length: int, dtype: np.dtype):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.part = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.length, self.dtype, self.total = length, dtype, 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.sink = self.fs.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.held_tokens = 0

    def add(self, ids: bytes) -> tuple[int, int]:
        n = len(ids) // self.dtype.itemsize
        first, self.total = self.total, self.total + n
        self.held.append(ids)
        self.held_tokens += n
        if self.held_tokens >= self.length * BATCH_SEQUENCES:
            self._flush(False)
        return first, n

    def _flush(self, last: bool) -> None:
        """Write whole batches; the rest of the last one is padding."""
        ids = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        size = self.length * BATCH_SEQUENCES
        end = ids.size if last else ids.size // size * size
        for k in range(0, end, size):
            cut = ids[k:min(k + size, end)]
            full = -(-cut.size // self.length) * self.length
            mask = (np.arange(full) < cut.size).astype(np.uint8)
            cut = np.concatenate([cut, np.zeros(full - cut.size, dtype=self.dtype)])
            self.out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(cut), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held = [ids[end:].tobytes()]
        self.held_tokens = ids.size - end

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2,
                      length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and the index table under ``folder``; returns the index."""
    spark, spec = docs.sparkSession, definition(tokenizer_path)

    def write(batches) -> Iterator[pa.RecordBatch]:
        encoder, file, task, k = text_encoder(spec), None, TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):  # few texts at a time as Python objects
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for i, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    if file is None:
                        name = f"part-{task:06d}-{k:06d}.arrow"
                        file = _Writer(folder, name, length, encoder.dtype)
                    rows.append((i, name, *file.add(ids + end)))
                    if file.total >= FILE_TOKENS:
                        file.close()
                        file, k = None, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    names=["doc_id", "file", "first", "n_tokens"])
        if file is not None:
            file.close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("copy"))
    order = ["id", F.xxhash64("text"), "text"]
    # The copy number only tells the ranges of a repeated row apart.
    ranged = rows.repartitionByRange("id", F.xxhash64("text"), "copy").sortWithinPartitions(*order).drop("copy")
    ranged.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


class TokenFile:
    """Random access to the tokens of one file; slices are views of the mapped buffer."""

    def __init__(self, folder: str, name: str):
        fs, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/{name}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.at: tuple[int, np.ndarray] | None = None

    def _batch(self, k: int) -> np.ndarray:
        if self.at is None or self.at[0] != k:
            self.at = k, self.reader.get_batch(k).column(0).flatten().to_numpy()
        return self.at[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of sequence k, both views of the mapped file."""
        batch = self.reader.get_batch(k // BATCH_SEQUENCES).slice(k % BATCH_SEQUENCES, 1)
        return batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy().view(np.bool_)

    def tokens(self, first: int, n: int) -> np.ndarray:
        size, parts = self.length * BATCH_SEQUENCES, []
        while n > 0:
            k, at = divmod(first, size)
            part = self._batch(k)[at:at + n]
            parts.append(part)
            first, n = first + part.size, n - part.size
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


def starts(index: DataFrame) -> DataFrame:
    """The index plus ``start``: tokens of all documents before, over all files. One row per
    file enters the running sum."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(files, "file").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """Index rows plus ``ids_crc32`` of the ids read back from the files."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*index.schema.fields, StructField("ids_crc32", LongType())])

    def read(batches):
        import zlib

        opened: dict[str, TokenFile] = {}
        for batch in batches:
            crc = []
            for name, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n_tokens"))):
                if name not in opened:
                    opened = {name: TokenFile(folder, name)}
                crc.append(zlib.crc32(opened[name].tokens(first, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crc, pa.int64())],
                                             names=[*batch.schema.names, "ids_crc32"])

    return index.mapInArrow(read, schema)
