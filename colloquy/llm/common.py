"""What the corpus operators share: the shared work folder, written tables, ASCII lower case."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Folders of written tables, by the identity of the table.
_paths: dict[int, str] = {}

#: Most rows that Spark hands to a Python worker at once; it bounds the bytes itself.
BATCH_ROWS = 2_000


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a fresh local one where that is unset and
    Spark runs in one process. A cluster without the setting is an error: its executors would not see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-work-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = f"file://{_own[app]}"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


#: Bytes of a table that may go to all tasks at once.
SENT_BYTES = 32 << 20


def is_small(table: DataFrame, row_bytes: int) -> bool:
    """Whether ``table`` (written, so that counting is cheap) may go to all tasks: its rows of ``row_bytes`` are within
    ``SENT_BYTES``."""
    return table.count() * row_bytes <= SENT_BYTES


def sent_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table``, marked to be sent to all tasks if it is small; else as it is, and a join shuffles both sides."""
    return F.broadcast(table) if is_small(table, row_bytes) else table


def discard(*tables: DataFrame) -> None:
    """Empties tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        if path := _paths.pop(id(t), None):
            t.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when the query has ended, and not once the driver happens to collect its
    garbage: the many small jobs of an iterative operator would fill the disks until then. What is still lazy when the
    block ends runs as the session is set."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers, unless the session has set bounds of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


Batches = Iterator[pa.RecordBatch]


def give_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which a Python worker, which Spark uses again, returns freed memory to the system."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return wrapped


#: Characters beyond ASCII that lower() would change too.
_OTHER_UPPER = r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}]]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; lower() does it faster where no other capital occurs."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def free_name(taken: list[str], name: str) -> str:
    """``name`` with underscores in front until no column has it (Spark's names ignore case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
