"""Pieces that several operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.materialize import released

#: Words of the contracts: runs of anything but ASCII white space.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: The same in Java's and Spark SQL's spelling.
WORD_SQL = r"[^\x20\x09-\x0D]+"
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """``text`` with A-Z lower-cased and every other character kept."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def lower_ascii_col(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only a local session without that
    setting gets a temporary one; a cluster without it is refused, as its machines would
    not share it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="rateforge-llm-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that nothing before it runs again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again."""
    path = f"{folder or checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``stored`` for tables that nothing reads after the block: they are removed at its end."""
    folder = f"{checkpoint_folder(spark)}/work-{uuid.uuid4().hex}"
    try:
        yield lambda df: stored(df, folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        released(spark)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None],
              schema: T.StructType | str, setup: Callable[[], object] | None = None) -> DataFrame:
    """``f`` on every Arrow batch of ``df``; ``setup()`` runs once a task and its
    result is f's second argument."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            if batch.num_rows:
                out = f(batch, state) if setup else f(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
        batch = out = state = None
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand freed memory back to the machine: Python workers outlive their tasks, and what
    one stage has kept would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """The strings of a column, a slice at a time, so that not all exist at once."""
    array = batch.column(batch.schema.get_field_index(column))
    for start in range(0, len(array), 256):
        yield from array.slice(start, 256).to_pylist()


def share(key: Column, part: float, salt: str) -> Column:
    """Whether a row is in the ``part`` of all rows that a hash of ``key`` picks."""
    low = F.xxhash64(key, F.lit(salt)).bitwiseAND((1 << 53) - 1)
    return low < F.lit(int(part * (1 << 53)))


def bounded(rows: DataFrame, key: str, size: Column, most: int, salt: str) -> DataFrame:
    """Rows of ``rows`` with summed ``size`` of at most ``most``: all, or those that a hash
    of ``key`` picks at a share that is lowered until they fit."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    part = 1.0
    while total > most:
        part *= 0.95 * most / total
        picked = rows.where(share(F.col(key), part, salt))
        total = picked.agg(F.sum(size)).first()[0] or 0
    return rows if part == 1.0 else rows.where(share(F.col(key), part, salt))
