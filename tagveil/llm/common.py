"""What the operators of this subpackage share: word rules, Arrow row maps, materialised tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: A word is a run of bytes other than the six ASCII blanks; ``bytes.split()`` cuts at exactly these.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the Python operators hold at once, besides one single longer document.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or (where unset, as in tests) one of our own."""
    sc = spark.sparkContext
    set_dir = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="tagveil-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: a compressed Parquet table under the shared folder, read back.

    Unlike a checkpoint it has true size estimates, which plans of many rounds need. The
    table lives as long as the folder, or until it is given to ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing to come reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def doc_hash(column: str = "doc_id") -> Column:
    """crc32 of the id written in decimal, the fold rule of the held-out contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


_resident: dict[str, object] = {}


def resident(key: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks, such as a tokenizer with its remembered words: one thing at a time.

    Workers serve one operator after another; without this each would leave its memory behind.
    """
    if key not in _resident:
        _resident.clear()
        gc.collect()
        _resident[key] = make()
    return _resident[key]


def as_rows(docs: DataFrame) -> DataFrame:
    """All columns in one, ``_row``, so that columns added beside it clash with none; ``_row.*`` gives them back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def give_back() -> None:
    """Return freed memory to the system, as a worker waits for its next task with what its allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def sub_batches(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each holds about ``limit`` bytes of ``text`` at most (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i in range(n):
            total += int(sizes[i])
            if total > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, int(sizes[i])
        yield batch.slice(start)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """An Arrow column of texts as lists of UTF-8 bytes of about ``limit`` bytes in all; null is empty."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for part in sub_batches(iter([batch]), limit=limit):
        yield texts_of(part)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
