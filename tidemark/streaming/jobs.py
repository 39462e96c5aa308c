"""Incremental forms of the loads: bars, deduplication, upserts and late corrections over file streams.

State is bounded by a watermark in each of them. What a stream emits is upserted into a stored table under the number of
its batch, so that a batch that runs again changes nothing, and only the folders of its keys are written. A stream
drained with ``availableNow`` gives what the batch operators give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stored import Table, upsert_into


def file_stream(spark: SparkSession, path: str, like: DataFrame, files: int | None = 16) -> DataFrame:
    """A stream of the Parquet files that match ``path`` (a folder or a pattern), with the schema of ``like``; times without zone are
    read as UTC's. ``files`` at a time, or all that are there."""
    reader = spark.readStream.schema(like.schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in like.dtypes if t == "timestamp_ntz"})


def bars(ticks: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and count of each window of event time; works on streams and batches alike. A stream keeps the
    windows that the watermark, ``late`` behind the newest time, has not passed, and takes no rows of others."""
    t = ticks.withWatermark(time, late) if ticks.isStreaming else ticks
    first = F.struct(time, value)
    return t.groupBy(F.window(time, width).alias("w"), key).agg(
        F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, first).alias("close"), F.count("*").alias("n")
    ).select(key, F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def dedup(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each key; a stream forgets keys after ``late``."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run the stream until all present files are read, into Parquet under ``path``."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(rows: DataFrame, table: Table, checkpoint: str, update: list[str] | None = None, mode: str = "append") -> StreamingQuery:
    """Upsert what the stream emits, until all present files are read. Bars go with mode ``update``: a window that has changed comes
    whole, and takes the place of its former row."""

    def each(batch: DataFrame, number: int) -> None:
        upsert_into(table, batch, update, commit=f"batch-{number:09d}")

    return rows.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Groups of keys, each with one state; the group of a key follows from its hash.
GROUPS = 256


def _packed(rows: pd.DataFrame) -> bytes:
    t, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def corrections(rows: DataFrame, key: str, time: str, value: str, version: str, look_back: str = "250 days") -> DataFrame:
    """A stream's new and corrected values: key, time, value, version and revised (there was one before).

    Rows (key, time, value, version) come in any order, and again with a higher version when they are corrected. The
    state holds the times of a key in the look-back, ``look_back`` behind the newest time of all batches before; a row
    at or before that limit, and one with a null time, value or version, is dropped. Of a time that has a newer version than the state, or the same one with a higher value,
    the newest row is emitted; other rows change nothing. Keys are taken in ``GROUPS`` groups, whose rows of a batch meet the state in one
    sort; the state of a group that gets no more rows goes with the limit.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"__none boolean, __key {kinds[key]}, __us long, __version {kinds[version]}, __value {kinds[value]}, revised boolean"
    names, same = ["__none", "__key", "__us", "__version", "__value"], ["__none", "__key", "__us"]

    def step(_: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        limit = held.getCurrentWatermarkMs() * 1000
        every = [p[names].assign(old=False) for p in parts]
        if held.exists:
            every.append(pa.ipc.open_stream(held.get[0]).read_pandas().assign(old=True))
        d = pd.concat(every, ignore_index=True)
        d = d[d["__us"] > limit].sort_values([*names, "old"])  # of equal rows the one that is there stays
        if d.empty:
            if held.exists:
                held.remove()
            return
        d["revised"] = d.groupby(same, sort=False)["old"].transform("any")
        now = d[~d.duplicated(same, keep="last")]
        held.update((_packed(now[names]),))
        held.setTimeoutTimestamp(max(int(now["__us"].max()), limit) // 1000 + 2)
        new = now[~now["old"]]
        if len(new):
            yield new[[*names, "revised"]]

    # a null key is a flag and some value, as pandas would make floats of whole numbers beside a null
    blank = F.lit("1970-01-01" if kinds[key] in ("string", "binary", "date", "timestamp", "timestamp_ntz") else 0).cast(kinds[key])
    watched = rows.dropna(subset=[time, value, version]).withWatermark(time, look_back).select(
        F.pmod(F.hash(key), F.lit(GROUPS)).alias("__group"), F.col(key).isNull().alias("__none"), F.coalesce(F.col(key), blank).alias("__key"),
        F.unix_micros(time).alias("__us"), F.col(version).alias("__version"), F.col(value).alias("__value"), time,
    )
    emitted = watched.groupBy("__group").applyInPandasWithState(step, out, "rows binary", "append", "EventTimeTimeout")
    return emitted.select(F.when(~F.col("__none"), F.col("__key")).alias(key), F.timestamp_micros("__us").alias(time), F.col("__value").alias(value), F.col("__version").alias(version), "revised")


def corrected(rows: DataFrame, key: str, time: str, value: str, version: str, batch: str, look_back: str = "250 days") -> DataFrame:
    """What the table of a drained ``corrections`` stream holds, from all rows at once; ``batch`` numbers the batch in which a row came.

    The limit of a batch follows from the newest time of the batches before it: one row a batch.
    """
    rows = rows.dropna(subset=[time, value, version])
    tops = rows.groupBy(batch).agg(F.max(time).alias("__top"))
    before = tops.select(F.col(batch), (F.max("__top").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)) - F.expr(f"INTERVAL {look_back}")).alias("__limit"))
    kept = rows.join(F.broadcast(before), batch).where(F.col("__limit").isNull() | (F.col(time) > F.col("__limit")))
    return kept.groupBy(key, time).agg(F.max_by(value, F.struct(version, value)).alias(value), F.max(version).alias(version))
