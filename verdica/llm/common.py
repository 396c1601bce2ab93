"""Shared pieces of the corpus operators: word splitting, Arrow batching, shared scratch space."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and the five ASCII control blanks. ``bytes.split()`` splits on exactly these.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"

#: Rows and bytes of one Arrow batch; long texts meet the second bound first.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> None:
    """Keeps what one Python worker holds at a time small, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def native_words(text: Column) -> Column:
    """Array of words of a text, JVM-side; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds an array or struct expression once inside higher-order functions, so lambdas don't recompute it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, like ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Scratch folders that are still there.
_FOLDERS: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, which the cluster names.

    Only where that is unset and all executors are threads of this machine's driver, as in tests, a local folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/verdica-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/verdica-{uuid.uuid4().hex}"
    _FOLDERS.add(path)
    return path


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    _FOLDERS.discard(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of ``staged`` tables that nothing reads any more."""
    for table in tables:
        _deleted(table.sparkSession, table._verdica_folder)


@atexit.register
def sweep() -> None:
    """Results may be read until the program ends; then all scratch goes, if the session still stands."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the session may end meanwhile
            for path in list(_FOLDERS):
                _deleted(spark, path)


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes an intermediate once to the shared folder and reads it back: later steps neither recompute it nor depend on executors staying."""
    path = scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._verdica_folder = path
    return out


def staged_alone(df: DataFrame) -> DataFrame:
    """``staged``, whose exchanges are deleted once it is written, not when the driver happens to collect its garbage."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        return staged(df)
    finally:
        spark.conf.set(cleanup, before)


def staged_narrow(df: DataFrame, scanned: bool = False) -> DataFrame:
    """``staged`` for a few numbers a document: files of full size, not one a core or partition.

    Each file costs a task, a listing and, on local file systems, helper processes of the executor. What comes straight
    from a scan of texts (``scanned``) is dealt anew, as its partitions are cut for the texts.
    """
    df = df.hint("rebalance") if scanned else df
    spark, first = df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(first, None)
    spark.conf.set(first, "false")
    try:
        return staged(df.coalesce(2 * spark.sparkContext.defaultParallelism))
    finally:
        if before is None:
            spark.conf.unset(first)
        else:
            spark.conf.set(first, before)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 of each text, one at a time; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


#: What operators remember in a worker between tasks, by module.
HELD: dict[str, dict] = {}


def alone(owner: str) -> None:
    """Lets go of what other operators remember: a worker that outlives a stage serves the next with its memory free."""
    others = [held for name, held in HELD.items() if name != owner and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
        trim()


def trim() -> None:
    """Gives freed memory back to the system: executors are held to what their workers keep, used or not."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_rows(df: DataFrame, columns: Iterable[str], rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow over the named columns only: Spark doesn't prune columns through a Python stage."""
    bounded_batches(df.sparkSession, batch_bytes)

    def run(batches):
        alone(rows.__module__)
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)
        trim()

    return df.select(*columns).mapInArrow(run, schema)
