"""What several operators need: shared storage, word patterns, bound expressions.

``spark.checkpoint.dir`` names the folder that all executors share. It is read from the
session; only where it is unset (tests, one machine) a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text, and the white space between them (ASCII only).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="terracell-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage in a way that survives the loss of any executor, gives the planner the
    true size, and keeps a costly projection from being evaluated for each consumer. Shuffle files
    of the write go when it ends: nothing reads them again. The driver then collects its garbage:
    Spark lets go of broadcast tables only then, and the heap would grow by them and by dead plans.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    spark._jvm.System.gc()
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores in front of it as long as a column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_bytes(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Arrow batches of at most ``limit`` bytes, so that a batch of whole texts fits a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, limit)


def fitted(rows: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """``fit`` of all rows of a bounded sample, run in one task.

    The driver gets the pickled result only: neither the rows nor what the fit holds beside them.
    """
    arrow_bytes(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([r for b in batches for r in b.to_pylist()])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])  # a table that is known to be empty has no task


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column that a lambda refers to is otherwise evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def upto(low: Column, high: Column) -> Column:
    """``low..high`` as an array; empty when ``high < low``."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
