"""Statistics of all pairs of symbols from Gram matrices of blocks.

Symbols are numbered and dealt into blocks, times into ranges; a panel is the dense matrix of a block in a range. A
panel is sent once to each block that its own meets, one task row is a pair of panels, and its matrix products hold
the sums of all its pairs over the range. Sums of the ranges are added as matrices. So a shuffle has rows for panels and
pairs of blocks, none for pairs of symbols, let alone for each of their dates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Symbols of a block and times of a range.
BLOCK, RANGE = 64, 1024
#: Sums over the times at which both have a value: of 1, x, y, x², y² and xy.
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _panels(rows: DataFrame, halo: int, block: int, times: int) -> DataFrame:
    """g, block, rng, names and a matrix (times x symbols, NaN without value) that also has the ``halo`` times ahead of its range and behind it."""
    height = times + 2 * halo

    def pack(t: pa.Table) -> pa.Table:
        m = np.full((height, block), np.nan)
        m[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column("x").to_numpy()
        names = np.full(block, None, object)
        names[t.column("col").to_numpy()] = np.array(t.column("symbol").to_pylist(), object)
        return pa.table({"g": t.column("g")[:1], "block": t.column("block")[:1], "rng": t.column("rng")[:1], "names": pa.array([names.tolist()], pa.list_(pa.string())), "m": pa.array([m.tobytes()], pa.binary())})

    r = rows.withColumn("rng", F.explode(F.sequence(F.floor((F.col("at") - halo) / times), F.floor((F.col("at") + halo) / times))))
    r = r.select("g", "symbol", "block", "col", "rng", (F.col("at") - F.col("rng") * times + halo).cast("int").alias("row"), "x")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}["g"]
    return r.groupBy("g", "block", "rng").applyInArrow(pack, f"g {kind}, block long, rng long, names array<string>, m binary")


def gram(values: DataFrame, lags: int = 0, block: int = BLOCK, times: int = RANGE) -> DataFrame:
    """a, b (a before b), g, lag and the sums of every two symbols of a group.

    ``values`` has g (the group), symbol, at (a whole number) and x, one row of each symbol and time; other rows than those with x
    don't count. ``lag`` goes from ``-lags`` to ``lags``: x of a at a time meets y of b at that time plus the lag. Pairs
    without a common time give no row.
    """
    v = cut(values.where("x IS NOT NULL").select("g", "symbol", F.col("at").cast("long").alias("at"), F.col("x").cast("double").alias("x")))
    # a row for each symbol
    index = v.select("g", "symbol").distinct().withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("symbol")) - 1)
    many = index.groupBy("g").agg(F.ceil(F.count("*") / block).alias("many"))
    v = v.join(index, ["g", "symbol"]).select("g", "symbol", F.floor(F.col("i") / block).alias("block"), (F.col("i") % block).alias("col"), "at", "x")
    p = _panels(v, 0, block, times)
    q = (_panels(v, lags, block, times) if lags else p).withColumnsRenamed({"names": "names_b", "m": "m_b"})
    p = p.join(many, "g").withColumnsRenamed({"names": "names_a", "m": "m_a"})
    left = p.select("g", F.col("block").alias("one"), F.explode(F.sequence("block", F.col("many") - 1)).alias("two"), "rng", "names_a", "m_a")
    right = q.select("g", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("one"), F.col("block").alias("two"), "rng", "names_b", "m_b")
    kind = {f.name: f.dataType.simpleString() for f in v.schema}["g"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column("m_a"), b.column("m_b")):
                x, y = (np.frombuffer(z.as_buffer(), np.float64).reshape(-1, block) for z in (x, y))
                m, k = np.isfinite(x), np.isfinite(y)
                x, y = np.where(m, x, 0.0), np.where(k, y, 0.0)
                m, k = m.astype(float), k.astype(float)
                at = lambda z, lag: z[lags + lag : lags + lag + times]  # noqa: E731, B023
                sums = [(m.T @ at(k, d), x.T @ at(k, d), m.T @ at(y, d), (x * x).T @ at(k, d), m.T @ at(y * y, d), x.T @ at(y, d)) for d in range(-lags, lags + 1)]
                out.append(np.array(sums).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("g", "one", "two", "names_a", "names_b")), pa.array(out, pa.binary())], ["g", "one", "two", "names_a", "names_b", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_buffer(), np.float64) for s in t.column("sums")).reshape(2 * lags + 1, len(SUMS), block, block)
        # a block's names are in the panels of the ranges in which its symbols have values
        names = [np.array([next((n for n in x if n is not None), None) for x in zip(*t.column(c).to_pylist())], object) for c in ("names_a", "names_b")]
        same = t.column("one")[0].as_py() == t.column("two")[0].as_py()
        d, i, j = np.nonzero((total[:, 0] > 0) & (np.triu(np.ones((block, block), bool), 1) if same else True))
        cols = {"g": pa.array([t.column("g")[0].as_py()] * len(d), t.schema.field("g").type), "a": names[0][i].tolist(), "b": names[1][j].tolist(), "lag": (d - lags).astype(np.int32)}
        out = {c: pa.array(x, pa.string()) if c in "ab" else x for c, x in cols.items()} | {s: total[d, k, i, j] for k, s in enumerate(SUMS)}
        return pa.table(out)

    sums = left.join(right, ["g", "one", "two", "rng"]).select("g", "one", "two", "names_a", "names_b", "m_a", "m_b").mapInArrow(products, f"g {kind}, one long, two long, names_a array<string>, names_b array<string>, sums binary")
    return sums.groupBy("g", "one", "two").applyInArrow(add, f"g {kind}, a string, b string, lag int, " + ", ".join(f"{s} double" for s in SUMS))


def _spread(n: Column, s: Column, ss: Column) -> Column:
    """n times the sum of squares around the mean; null where rounding is all of it."""
    d = n * ss - s * s
    return F.when(d > 1e-13 * n * ss, d)


def corr(of=F.col) -> Column:
    """The correlation that sums give; ``of`` finds a sum by name."""
    return (of("n") * of("sxy") - of("sx") * of("sy")) / F.sqrt(_spread(of("n"), of("sx"), of("sxx"))) / F.sqrt(_spread(of("n"), of("sy"), of("syy")))


def covar_samp(of=F.col) -> Column:
    return F.when(of("n") > 1, (of("sxy") - of("sx") * of("sy") / of("n")) / (of("n") - 1))
