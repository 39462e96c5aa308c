"""Row numbers over a whole table without a window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Bits of monotonically_increasing_id that number the rows of a partition.
_ROWS = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column | str], name: str = "row") -> DataFrame:
    """``df`` with ``name``, the row's number from 0 on in the given order.

    Rows are range-partitioned and sorted; the checkpoint fixes which partition and which place a row has, so that a
    lost executor can't change them. Only the partitions' sizes, one row each, are added up in one place. Rows that
    are equal in ``order`` share a partition: add a column that tells them apart where there may be many.
    """
    keys = [F.expr(c) if isinstance(c, str) else c for c in order]
    r = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("__at", F.monotonically_increasing_id())
    r = r.withColumn("__part", F.shiftright("__at", 33))
    sizes = r.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a partition
    return r.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_ROWS))).drop("__at", "__part", "__before")
