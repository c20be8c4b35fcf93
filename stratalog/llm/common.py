"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset and the master is local (tests, a laptop), a temporary folder of this machine
    stands in; elsewhere that is an error, since executors don't see this machine's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="stratalog-"))
    return _OWN_FOLDER[0]


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/stratalog/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


#: Spark deletes shuffle files at their query's end; where a stage still needs them, it is run again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries planned and run inside go when these end, not when the driver happens to collect its garbage.

    For queries that run once: what reads the same shuffles again would make them again.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again.

    The folder stays, since a lost executor's work is done again from it; forget() removes all of a session's.
    """
    path = new_folder(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.folder_of_saved = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(tables: list[DataFrame]) -> None:
    """Deletes tables that saved() gave, and the shuffle files of what read them, when all that was made of them is written itself."""
    for table in tables:
        _delete(table.sparkSession, table.folder_of_saved)
        _WRITTEN.remove(table.folder_of_saved)
    if tables:
        release(tables[0].sparkSession)


def forget(spark: SparkSession) -> None:
    """Deletes what saved() and the archives have written in the shared folder, once no result that reads it is needed any more."""
    for path in _WRITTEN:
        _delete(spark, path)
    _WRITTEN.clear()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that none of columns has (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release(spark: SparkSession) -> None:
    """Lets broadcasts and shuffle files of finished steps outside tidy() go: Spark deletes them some time after the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at a task's end its Python worker, which lives on, hands freed memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped


MIN_BLOOM, MAX_BLOOM = 20, 27  # powers of two: 128 KB to 16 MB


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter over a column as a broadcast; its size follows the number of ids up to 16 MB, and filled beyond that it rules out less."""

    bits: int
    words: Broadcast

    def bit(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << self.bits))

    def holds(self, bit: np.ndarray) -> np.ndarray:
        return ((self.words.value[bit >> 6] >> (bit & 63)) & 1).astype(bool)


def bloom_of(ids: DataFrame, column: str) -> Bloom:
    """ids should be a written table: it is read twice. Only the filter's words reach the driver."""
    size = min(MAX_BLOOM, max(MIN_BLOOM, (16 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << size))
    with tidy(ids.sparkSession):
        words = ids.select((bit / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << size - 6, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return Bloom(size, ids.sparkSession.sparkContext.broadcast(bits))


def _ruled(rows: DataFrame, ids: DataFrame, column: str):
    """A function from False to rows whose column a Bloom filter over ids rules out, from True to the others."""
    bloom = bloom_of(ids, column)
    marked = rows.select("*", bloom.bit(quoted(column)).alias(fresh(rows.columns, "bit")))

    def kept(inside: bool):
        def run(batches):
            for batch in batches:
                part = batch.filter(pa.array(bloom.holds(batch.column(batch.num_columns - 1).to_numpy()) == inside))
                yield pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])

        return marked.mapInArrow(run, rows.schema)

    return kept


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose column is not in ids, unchanged; only those that a Bloom filter can't rule out are shuffled."""
    kept = _ruled(rows, ids, column)
    return kept(False).unionByName(_met(kept(True), ids, column, "left_anti"))


def among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose column is in ids, unchanged; only those that a Bloom filter can't rule out are shuffled."""
    return _met(_ruled(rows, ids, column)(True), ids, column, "left_semi")


def _met(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    key = fresh(rows.columns, "key")
    return rows.join(ids.select(F.col(quoted(column)).alias(key)), F.col(quoted(column)) == F.col(key), how)
