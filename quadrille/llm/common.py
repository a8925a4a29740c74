"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.session import shared_output_dir

# White space and words of all query contracts (ASCII classes).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage, survives lost executors, and drops the partitioning of the
    rows, so that a later join exchanges both sides and Spark can split skew.
    """
    path = shared_output_dir(df.sparkSession, name)
    _note(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that the innermost ``dropping`` of this thread is to drop.
_noted: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("noted", default=None)


def _note(spark: SparkSession, path: str) -> None:
    if (tables := _noted.get()) is not None:
        tables.append((spark, path))


@contextmanager
def dropping() -> Iterator[list[tuple[SparkSession, str]]]:
    """Drops the tables that ``write_table`` writes inside, when left (also by an error).

    For work whose result reads none of them any more.  A decorator as well.
    """
    tables: list[tuple[SparkSession, str]] = []
    outer = _noted.set(tables)
    try:
        yield tables
    finally:
        _noted.reset(outer)
        for spark, path in tables:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_result(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``write_table`` of what ``make()`` returns; the tables that ``make`` wrote on the way are dropped then."""
    with dropping() as tables:
        out = write_table(make(), name)
        result = tables.pop()
    _note(*result)
    return out


BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_of(df: DataFrame) -> DataFrame:
    """``df``, with Spark's row count of Arrow batches lowered for whole texts.

    10,000 texts (Spark's default) are tens of MB outside the heap, several
    times over.  A session that sets another count keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, "10000") == "10000":
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns of both sides."""
    cond = None
    for n in names:
        c = left[n].eqNullSafe(right[n])
        cond = c if cond is None else cond & c
    return cond


def task_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path, inside a task, for a folder of Spark's shared store."""
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[len("file:"):]
    if uri.startswith("/") or uri.startswith("file://"):
        return pafs.LocalFileSystem(use_mmap=True), re.sub(r"^file://", "", uri)
    return pafs.FileSystem.from_uri(re.sub(r"^s3a?n?://", "s3://", uri))
