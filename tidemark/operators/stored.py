"""Tables kept as Parquet in folders, of which a write touches only the folders that its keys fall into.

The folder of a row follows from its key (the month of its date, a bucket of its id), so that a key never moves. A
write joins the batch to the rows of its folders alone, writes the folders' new contents beside the table, and then puts
them in place by a dynamic partition overwrite. Whatever ends before the new contents are complete leaves the table as it
was; whatever ends later is finished by the next write, which finds the complete contents. A commit that is named, as
a stream's batch is by its number, happens once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut
from .upsert import newest, upsert, upsert_partial

PART = "part"


@dataclass(frozen=True)
class Table:
    """Where the table is, its key, what makes one row of a key newer than another, and the folder as SQL over the key."""

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    folder: str

    def read(self, spark: SparkSession, folders: list[str] | None = None) -> DataFrame:
        """The rows, or those of the given folders only."""
        rows = spark.read.parquet(self.path)
        return rows.where(F.col(PART).isin(folders)).drop(PART) if folders is not None else rows.drop(PART)

    def put(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their folder, which begins with a letter so that it is read as text."""
        return rows.withColumn(PART, F.concat(F.lit("p"), F.coalesce(F.expr(self.folder).cast("string"), F.lit("none"))))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _into(rows: DataFrame, path: str, kept: str = "dynamic") -> None:
    # folders with many rows are written by several tasks, small ones share a task
    rows.hint("rebalance", PART).write.option("partitionOverwriteMode", kept).mode("overwrite").partitionBy(PART).parquet(path)


def create(table: Table, rows: DataFrame) -> None:
    """Write the table anew, one row of each key."""
    _into(table.put(newest(rows, list(table.keys), list(table.order))), table.path)


def _apply(spark: SparkSession, table: Table, name: str) -> None:
    """Put complete contents in place; doing so twice gives the same."""
    waiting = f"{table.path}-pending/{name}"
    _into(spark.read.parquet(waiting), table.path)
    fs, p = _fs(spark, f"{table.path}-commits/{name}")
    fs.create(p, True).close()
    fs, p = _fs(spark, waiting)
    fs.delete(p, True)


def finish(spark: SparkSession, table: Table) -> None:
    """Finish writes that ended between their new contents and the table; drop those whose contents are not complete."""
    fs, p = _fs(spark, f"{table.path}-pending")
    if not fs.exists(p):
        return
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if exists(spark, f"{table.path}-pending/{name}/_SUCCESS"):
            _apply(spark, table, name)
        else:
            fs.delete(status.getPath(), True)


def upsert_into(table: Table, batch: DataFrame, update: list[str] | None = None, commit: str | None = None) -> None:
    """Put the batch's rows, the newest of each key, in place of those of their keys; with ``update``, of rows that are there only
    these columns change. One writer at a time.

    The batch is checkpointed, the names of its folders (a month each, say) come to the driver, and only these folders are
    read and written. A commit with a name that has happened is left out.
    """
    spark, name = batch.sparkSession, commit or uuid.uuid4().hex
    finish(spark, table)
    if exists(spark, f"{table.path}-commits/{name}"):
        return
    keys, order = list(table.keys), list(table.order)
    if not exists(spark, table.path):
        b = cut(batch)
        if not b.isEmpty():
            create(table, b)
    else:
        b = cut(table.put(newest(batch, keys, order)))
        folders = [r[0] for r in b.select(PART).distinct().collect()]
        if folders:
            now = table.read(spark, folders)
            b = b.select(*now.columns)
            merged = upsert_partial(now, b, keys, update, order) if update is not None else upsert(now, b, keys, order)
            _into(table.put(merged), f"{table.path}-pending/{name}", "static")
            return _apply(spark, table, name)
    fs, p = _fs(spark, f"{table.path}-commits/{name}")
    fs.create(p, True).close()
