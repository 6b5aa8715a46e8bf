"""Pieces shared by the operators: bounded Arrow chunks and session settings."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.session import ship

#: Rows of an Arrow batch; long texts are cut further by ``chunks``.
BATCH_ROWS = 512
#: Text bytes that an operator holds at once inside a task (one longer text is a chunk of its own).
CHUNK_BYTES = 2 << 20
#: A word of a text for the quality, join and mixing operators (fixed by contract).
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship(spark)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and ``more``) of a table that may have any other columns."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds at most ``limit`` bytes, or a single row."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Marks:
    """A set of ids as one bit each of a bounded bitmap: never misses one, may know a few more.

    It tells which rows are worth packing before a join; the join decides. The bitmap has at least
    16 bits an id up to ``MOST`` bits in all (128 MB), beyond which it only lets more rows pass.
    """

    MOST = 1 << 30

    def __init__(self, ids: DataFrame, name: str, hashed: bool = False):
        """From a written table's column ``name``; ``hashed``: it holds whole numbers that are hashes already."""
        n = ids.count()
        self.bits, self.hashed = min(self.MOST, 1 << max(15, (16 * n).bit_length())), hashed
        spot = self.spot(F.col(name))
        pages = ids.select(spot.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits")).collect()
        whole = np.zeros(self.bits // 8, np.uint8)
        for page, bits in pages:  # pages of 4 KB, counted from 1
            whole[(page - 1) * 4096 : page * 4096] = np.frombuffer(bits, np.uint8)
        self.shared = ids.sparkSession.sparkContext.broadcast(whole)

    def spot(self, column_: Column) -> Column:
        """The place of an id, from 1."""
        return F.pmod(column_ if self.hashed else F.xxhash64(column_), F.lit(self.bits)) + 1

    @staticmethod
    def known(bitmap: np.ndarray, spots: np.ndarray) -> np.ndarray:
        at = spots - 1
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def quoted(docs: DataFrame) -> list[Column]:
    """All columns of a table, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def released(run: Callable, *forget: Callable[[], None]) -> Callable:
    """``run`` with what it remembers dropped at the end of its task.

    Python workers are used again by later stages, which need the memory.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """A record batch from row tuples in the order of ``schema``."""
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
