"""Fixed-width bit packing of token ids: every id takes the minimum bits of the vocabulary.

A shard is a file: magic, bits, ids per block, shard number, documents, ids, blocks; then the
document ids, the cumulative ids per document and the byte offset of every block; then the
packed blocks and a line feed. Blocks start at bytes, so any of them unpacks alone, vectorised.

Order is ascending doc_id, null first; rows of equal doc_id stand by a hash of their text. A null
text is an empty one, whose only id is the end id. An empty table gives no shard. Only doc_id and
the text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, join_small, stored
from .tokens import default_path, encoder

MAGIC = b"SLBP2\0\0\0"
HEAD = struct.Struct("<8sIIqQQQ")
BLOCK_IDS = 4096
SHARD_IDS = 1 << 22
NO_ID = -(2**63)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit string of `ids`, `bits` each, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first `n` ids of a bit string made by pack()."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little")
    return (flat.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def image(doc_ids: list[int], counts: list[int], ids: np.ndarray, bits: int, block: int = BLOCK_IDS, number: int = 0) -> bytes:
    """The bytes of a shard."""
    parts = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)], dtype="<u8")
    head = HEAD.pack(MAGIC, bits, block, number, len(doc_ids), len(ids), len(parts))
    return b"".join([head, np.array(doc_ids, dtype="<i8").tobytes(), np.cumsum([0, *counts], dtype="<u8").tobytes(), offsets.tobytes(), *parts, b"\n"])


class Shard:
    """A shard opened for reading; nothing is unpacked until asked for."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.number, self.n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed id shard")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at := at + 8 * self.n_docs)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * self.n_docs + 8)
        self.payload = memoryview(data)[at + 8 * n_blocks + 8 :]
        if len(self.payload) != int(self.offsets[-1]) + 1 or self.payload[-1] != 10:
            raise ValueError("a packed id shard is cut short")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the shard, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack(self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])], self.bits, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of (doc_id, text) in ascending doc_id order, a row each: image binary.

    One range shuffle by doc_id and a hash of the text, so rows without an id or with the same
    one spread too; each task encodes its sorted rows and closes a shard at `shard_ids` ids. Shard
    numbers ascend with doc_id: task << 32 | shard of the task.
    """
    path = tokenizer or default_path()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        bits, end, width = max(1, (enc.size - 1).bit_length()), end_id.to_bytes(enc.width, "little"), enc.width
        doc_ids, counts, held, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            data = image(doc_ids, counts, np.frombuffer(b"".join(held), dtype=f"<u{width}"), bits, number=part << 32 | seq)
            return pa.RecordBatch.from_pydict({"image": pa.array([data], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = enc.encode(text.as_py() or "") + end
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                counts.append(len(got) // width)
                held.append(got)
                n += counts[-1]
                if n >= shard_ids:
                    yield close()
                    doc_ids, counts, held, n, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return in_arrow(dealt, encode, "image binary")


def write_files(shards: DataFrame, path: str) -> None:
    """Writes every shard as a file of its own under a new folder of any store that Spark writes.

    Spark's writer commits the files whole, so a lost executor or a repeated task leaves no part
    of one; it ends every row with the line feed that ends a shard.
    """
    body = F.expr("substring(image, 1, octet_length(image) - 1)").cast("string")
    shards.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder: image binary."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("content").alias("image"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from shards (image): doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                if not len(data := data.as_py()):
                    continue  # Spark's file of an empty table
                shard = Shard(data)
                ids = shard.ids(0, shard.n_ids).astype("<u4")
                starts = shard.starts.astype(np.int64)
                cuts = starts.tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                none = shard.doc_ids == NO_ID
                yield pa.RecordBatch.from_pydict({"shard_id": pa.array(np.full(shard.n_docs, shard.number)), "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=none), "local": pa.array(starts[:-1]), "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array(crc, pa.int64())})

    docs = stored(in_arrow(shards, decode, "shard_id long, doc_id long, local long, n_tokens long, ids_crc32 long"), "read")
    # Bases: sums within the shards of a task, then over tasks; no window holds more than either.
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = docs.groupBy("shard_id").agg(F.sum("n_tokens").alias("n_ids")).withColumn("p", F.shiftright("shard_id", 32))
    tasks = sizes.groupBy("p").agg(F.sum("n_ids").alias("v")).select("p", before("v", Window.orderBy("p")).alias("t"))
    bases = stored(sizes.withColumn("s", before("n_ids", Window.partitionBy("p").orderBy("shard_id"))).join(tasks, "p").select("shard_id", (F.col("s") + F.col("t")).alias("base")), "bases")
    return join_small(docs, bases, ["shard_id"], "inner").select("doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
