"""Token ids in Arrow files of fixed-size-list batches.

The documents, in ascending order of ids, are one stream of token ids; each ends with END.
A shard holds a contiguous part of the stream as sequences of one length: column ``ids``
(fixed-size list, as narrow as the vocabulary allows) and column ``mask`` (fixed-size list
of booleans, false for what fills up the shard's last sequence). A sequence is a slice of
mapped memory: nothing is decoded or copied. A second file per shard lists its documents
(doc_id, start in the shard, n_tokens), as END may also occur inside a text. The manifest
has one row per shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, tokens
from .shared import materialize, scratch, ship

LENGTH = 2048
#: Sequences in one batch of a file.
BATCH = 256


class ShardWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, out, dtype: np.dtype, length: int = LENGTH):
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= BATCH * self.length:  # every batch but the last has BATCH sequences
            flat, size = np.concatenate(self.waiting), BATCH * self.length
            for at in range(0, len(flat) - size + 1, size):
                self._put(flat[at : at + size])
            self.waiting = [flat[len(flat) // size * size :]]
            self.n = len(self.waiting[0])

    def _put(self, ids: np.ndarray) -> None:
        body = np.zeros(-(-len(ids) // self.length) * self.length, dtype=self.dtype)
        body[: len(ids)] = ids
        mask = np.arange(len(body)) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (body, mask)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n:
            self._put(np.concatenate(self.waiting))
        self.file.close()


class Shard:
    """Random access to one file: sequences and masks by number, ids by place in the stream."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(files.reader(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.held: dict[str, tuple[int, np.ndarray]] = {}

    def _column(self, batch: int, name: str) -> np.ndarray:
        """A batch's column end to end; the last one used stays open."""
        if self.held.get(name, (-1,))[0] != batch:
            column = self.file.get_batch(batch).column(name)
            self.held[name] = batch, column.values.to_numpy(zero_copy_only=name == "ids")
        return self.held[name][1]

    def sequence(self, i: int) -> np.ndarray:
        return self._column(i // BATCH, "ids")[i % BATCH * self.length :][: self.length]

    def mask(self, i: int) -> np.ndarray:
        return self._column(i // BATCH, "mask")[i % BATCH * self.length :][: self.length]

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from a place on, as slices of one batch each."""
        size = BATCH * self.length
        while n > 0:
            part = self._column(start // size, "ids")[start % size :][:n]
            if not len(part):
                raise IndexError("no such place in the stream")
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, length: int = LENGTH
) -> DataFrame:
    """Encode whole texts and write the shards to ``path``; returns the manifest.

    The manifest has shard, n_docs, n_tokens. Null text is encoded as empty (END alone).
    Null ids come first; rows of one id follow each other in the order of a hash of their
    texts. Empty tables give an empty manifest. Shards follow the session's shuffle
    partitions and hold one batch in memory at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or tokens.default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = tokens.encoder(tokenizer)
        shard, attempt = files.attempt()
        name = f"{path}/{shard:08d}"
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        with files.replacing(f"{name}.arrow", attempt) as out, files.replacing(f"{name}.docs.arrow", attempt) as also:
            writer = ShardWriter(out, encoder.dtype, length)
            listed = pa.ipc.new_file(also, index)
            end = np.array([tokens.END], dtype=encoder.dtype)
            for b in _chained(first, batches):
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    starts, counts = [], []
                    for ids in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                        starts.append(writer.total)
                        counts.append(len(ids) + 1)
                        writer.add(ids)
                        writer.add(end)
                    listed.write_batch(pa.record_batch([part.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index))
                    n_docs += part.num_rows
            writer.close()
            listed.close()
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (shard, n_docs, writer.total)], names=["shard", "n_docs", "n_tokens"])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return materialize(ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long"), "token-manifest")


def _chained(first, rest):
    yield first
    yield from rest


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before. The driver adds up one number a shard.
    """
    before, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], before))
        before += r["n_tokens"]
    shards = spark.createDataFrame(rows, "shard long, before long")
    n = max(1, len(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = Shard(f"{path}/{number:08d}.arrow")
                listed = pa.ipc.open_file(files.reader(f"{path}/{number:08d}.docs.arrow"))
                for i in range(listed.num_record_batches):
                    part = listed.get_batch(i)
                    sums = []
                    for start, count in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        crc = 0
                        for ids in shard.ids(start, count):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        sums.append(crc)
                    starts = pa.array(part.column(1).to_numpy() + base)
                    yield pa.record_batch([part.column(0), starts, part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    return read_token_files(spark, path, write_token_files(docs, path, tokenizer))
