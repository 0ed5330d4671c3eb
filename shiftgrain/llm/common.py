"""Helpers of the corpus operators: written stage tables, columns of the input, sizes of blocks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrain.session import checkpoint_dir


def stage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back.

    Lineage ends at committed files, so a lost executor re-reads them; columns stay prunable.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, as (doc_id long, text string).

    Every other column is left alone, so clashing names in the input cannot matter.
    """
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_fold(doc_id, folds: int, rest: int):
    """Whether crc32 of the id's decimal text falls into a fold; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == rest, F.lit(False))


def slices(batches, rows: int):
    """Arrow batches of at most `rows` rows: what a task holds beside its input stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Clears of what operators keep in a worker process beyond a task.
_KEPT: list[Callable[[], None]] = []


def kept_in_worker(*clears: Callable[[], None]) -> None:
    """Names what empties the caches of a module that outlive tasks, for `free_worker`."""
    _KEPT.extend(clears)


def free_worker() -> None:
    """Give back what earlier stages left in this worker process, which serves one stage after another:
    remembered words, and what `trim_worker` gives back."""
    for clear in _KEPT:
        clear()
    trim_worker()


def trim_worker() -> None:
    """Give back only the memory that Arrow and the allocator hold free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
