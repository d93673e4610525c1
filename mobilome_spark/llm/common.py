"""Helpers shared by the training-data operators: scratch tables and byte columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the set that separates words everywhere in this package.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``. Only where that is unset and all
    runs on one machine, as in tests, a temporary folder is made and kept in the
    session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mobilome-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key of more than this share of the rows is hot; so there are fewer than twice as many hot keys, whatever the input.
HOT_SHARE = 20_000
#: Hot keys whose hashes stand in the plan at most; more are left out by an anti join.
NAMED = 1024


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner", size: int | None = None) -> DataFrame:
    """``rows`` joined with a written ``table`` of one row per key, one key of which may hold most rows.

    ``table`` has a column ``_n``, the number of rows of its key, and where
    ``size`` is given ``_size``, their bytes; both are dropped. Keys that hold
    more than 1 / ``HOT_SHARE`` of ``total`` rows or ``size`` bytes, fewer than
    2 x ``HOT_SHARE``, are broadcast; the others meet in a shuffle, where no key
    holds more than that share. ``how`` is inner or left; null keys meet nothing.

    Up to ``NAMED`` hot keys are told by their hashes, the same on both sides, so
    no join hands on all rows of other keys only to leave the hot ones out.
    """
    hot = F.col("_n") * HOT_SHARE >= total
    if size is not None:
        hot = hot | (F.col("_size") * HOT_SHARE >= size)
    extra = [c for c in ("_n", "_size") if c in table.columns]
    few, rest = F.broadcast(table.filter(hot).drop(*extra)), table.filter(~hot).drop(*extra)
    told = F.xxhash64(*[F.col(k).cast(table.schema[k].dataType) for k in keys])
    n = table.agg(F.count_if(hot).alias("hot"), F.count_if(~hot).alias("rest"), F.collect_set(F.when(hot, told)).alias("told")).first()
    if not n.rest:
        return rows.join(few, keys, how)
    if not n.hot:
        return rows.join(rest, keys, how)
    if n.hot <= NAMED:
        among = told.isin(n.told)
        few, rest = F.broadcast(table.filter(among).drop(*extra)), table.filter(~among).drop(*extra)
        return rows.filter(among).join(few, keys, how).unionByName(rows.filter(~among).join(rest, keys, how))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys, how))


def release_memory() -> None:
    """Give back what a task's batches took: a worker serves later stages too and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups_of_rows(offsets: np.ndarray, limit: int):
    """Yield (first, last) row ranges that hold about ``limit`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words; words never cross rows."""
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = first_ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[first_ends]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1
