"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

One range partition of the documents, in ascending ``doc_id`` order, becomes one shard:

    shard-00007.ids      ids of all its documents, little-endian unsigned 16 or 32 bit
    shard-00007.offsets  int64, first id of every document in the shard, then the shard's length
    shard-00007.docs     int64 document ids (a null id is written as the smallest int64)

and one row (shard, n_docs, n_ids) of ``manifest``. A shard's place in the whole is the
prefix sum of the shards before it, so no task needs to know another's size while it
writes. Files get their final name only when complete (rename inside the shared folder), and
the same rows give the same bytes, so a task that runs again does no harm.

The folder must be a path that every machine can map into memory: the shared folder
itself, or a mounted path given as ``folder``.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm.bpe import coder
from quillstat.llm.common import cpu_partitions, scratch, slices, text_hash

ROWS_READ = 16_384
IDS_READ = 1 << 20


def local_path(uri: str) -> str:
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped: {uri} is no mounted path; pass folder=")
    return parts.path


def shard_file(folder: str, shard: int, kind: str) -> str:
    return os.path.join(folder, f"shard-{shard:05d}.{kind}")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> str:
    """Write ``docs`` (doc_id, text; more columns are ignored) and return the folder.

    A null text is empty (only its end id is written); rows with equal ids stand in the
    order of their texts' hashes; an empty table gives a manifest without rows."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    place = local_path(folder)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("h"))
            .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        code, end = coder(vocabulary), None
        names = {kind: shard_file(place, shard, kind) for kind in ("ids", "offsets", "docs")}
        mark = f".{uuid.uuid4().hex}"
        files, n_docs, n_null, n_ids = {}, 0, 0, 0
        try:
            for part in slices(batches):
                if not files:
                    os.makedirs(place, exist_ok=True)
                    files = {kind: open(name + mark, "wb") for kind, name in names.items()}
                    end = np.array([end_id], code.dtype)
                flat, sizes = code.encode(part.column(1).to_pylist())
                ends = np.cumsum(sizes)
                np.insert(flat, ends, end).astype(code.dtype, copy=False).tofile(files["ids"])
                sizes = sizes + 1
                (n_ids + np.cumsum(sizes) - sizes).astype("<i8").tofile(files["offsets"])
                n_null += part.column(0).null_count  # null ids come first
                part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tofile(files["docs"])
                n_docs, n_ids = n_docs + len(sizes), n_ids + int(sizes.sum())
            if files:
                np.array([n_ids], "<i8").tofile(files["offsets"])
        finally:
            for f in files.values():
                f.close()
        for kind in files:
            os.replace(names[kind] + mark, names[kind])
        if files:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_null": [n_null],
                                              "n_ids": [n_ids], "width": pa.array([code.dtype.itemsize], pa.int32())})

    rows.mapInArrow(write, "shard int, n_docs long, n_null long, n_ids long, width int").write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``base``, the number of ids before each (one row per shard)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.schema("shard int, n_docs long, n_null long, n_ids long, width int").parquet(f"{folder}/manifest")
            .withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))))


class Shard:
    """A memory-mapped shard: ``len(shard)`` documents, ``shard[i]`` the ids of one of them."""

    def __init__(self, folder: str, shard: int, width: int):
        place = local_path(folder)
        self.ids = np.memmap(shard_file(place, shard, "ids"), f"<u{width}", "r")
        self.offsets = np.memmap(shard_file(place, shard, "offsets"), "<i8", "r")
        self.docs = np.memmap(shard_file(place, shard, "docs"), "<i8", "r")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    crc = 0
    for at in range(0, len(ids), IDS_READ):
        crc = zlib.crc32(ids[at:at + IDS_READ].astype("<u4").tobytes(), crc)
    return crc


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, shard."""
    shards = manifest(spark, folder)
    shards = shards.repartition(cpu_partitions(shards), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["shard"], row["width"])
                for at in range(0, len(shard), ROWS_READ):
                    to = min(len(shard), at + ROWS_READ)
                    edges = np.asarray(shard.offsets[at:to + 1])
                    ids = np.asarray(shard.docs[at:to])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids, pa.int64(), mask=np.arange(at, to) < row["n_null"]),
                        "start": row["base"] + edges[:-1],
                        "n_tokens": np.diff(edges),
                        "ids_crc32": pa.array([ids_crc32(shard[i]) for i in range(at, to)], pa.int64()),
                        "shard": pa.array(np.full(to - at, row["shard"], np.int32)),
                    })

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
