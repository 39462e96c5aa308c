"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target number of words. Whole passes over the source come first; what is left of the target is
filled with the documents whose hash lies under a threshold. The threshold is found from histograms: words are
summed by source and hash bucket, the bucket in which the budget ends is split again, and so on down to single
hashes. Nothing is sorted by document, and a source of any size costs a few thousand histogram rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small, text_of

#: Bits of the document hash (15 hexadecimal digits of an MD5), and bits that one histogram level resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, size (words) and h (60-bit hash of doc_id) of each document, narrow and checkpointed."""
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    return cut(
        docs.select(
            "doc_id",
            F.xxhash64(docs["text"].cast("string")).alias("text_hash"),
            docs["source"].cast("string").alias("source"),
            F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
        )
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size and target, from rows with source and size.

    Sources in code-point order, null last, weigh ``weights`` in turn. The whole size is shared by weight; no
    target passes ``cap`` times its source's size, and the excess is shared anew among the others. That
    water-filling has a closed form: with sources ordered by size per weight, those at their cap come first.
    The windows run over one row per source.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight.cast("decimal(38,0)")).withColumn("full", (F.col("source_size") * cap).cast("decimal(38,0)"))
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").isNull(), "source")
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    s = s.select(
        "*",
        (F.sum(F.col("source_size")).over(everything).cast("decimal(38,0)") - F.coalesce(F.sum("full").over(before), zero)).cast("decimal(38,0)").alias("rest"),
        F.sum("w").over(after).cast("decimal(38,0)").alias("heavy"),
    )
    capped = F.col("full") * F.col("heavy") <= F.col("w") * F.col("rest")
    level = F.min_by(F.struct("rest", "heavy"), F.when(~capped, F.col("full") / F.col("w"))).over(everything)
    s = s.withColumn("capped", capped).withColumn("level", level)
    shared = (F.col("w") * F.col("level.rest")).cast("double") / F.col("level.heavy").cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("full").cast("double")).otherwise(shared).alias("target"))


def threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the hash at which its budget ends.

    rows: source, h, size. budgets: source, budget. Returns source, edge (documents with h below it fit together
    in the budget; null if all do), under (their words) and at (words of the documents whose hash is the edge).
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"), F.lit(0).cast("long").alias("at"))
    for done in range(0, HASH_BITS, LEVEL_BITS):
        left = HASH_BITS - done - LEVEL_BITS
        o = rows.alias("o").join(small(state).alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")) & (F.shiftright("o.h", left + LEVEL_BITS) == F.col("s.prefix")))
        sums = o.groupBy("s.source", "s.budget", "s.under", F.shiftright("o.h", left).alias("bucket")).agg(F.sum("o.size").alias("words"))
        by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        cum = sums.withColumn("upto", F.col("under") + F.sum("words").over(by))
        ends = cum.where(F.col("upto") > F.col("budget")).groupBy("source", "budget").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("under"), "words")).alias("b"))
        state = cut(ends.select("source", "budget", F.col("b.bucket").alias("prefix"), F.col("b.under").alias("under"), F.col("b.words").alias("at")))
    total = rows.groupBy("source").agg(F.sum("size").alias("total"))
    b, s, t = budgets.alias("b"), state.alias("s"), total.alias("t")
    same = lambda x, y: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))
    return b.join(s, same("b", "s"), "left").join(t, same("b", "t"), "left").select("b.source", "b.budget", F.col("s.prefix").alias("edge"), F.coalesce("s.under", "t.total", F.lit(0).cast("long")).alias("under"), F.coalesce("s.at", F.lit(0)).alias("at"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """How many words of each document a mix with the given source weights takes.

    Returns doc_id, text_hash, source, size, source_size, target, copies and taken, a row for each row of ``docs``. A source
    that needs more than it has is repeated, each document ``floor(target / size)`` times; the rest of the target
    goes to the documents with the lowest hashes. Where the next document would pass the target, the hashes above
    it are searched once more for documents that still fit, and the document at that second edge is taken if
    this comes nearer the target.

    Null and empty texts have size 0 and cost nothing; a null source is a source of its own, the last; rows with
    equal doc_id share their hash and are taken together; an empty table gives no rows. Other columns don't matter.
    """
    rows = sized(docs)
    goal = cut(targets(rows, weights, cap))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("budget", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    first = cut(threshold(rows, goal.select("source", "budget")))
    gap = cut(first.where("edge IS NOT NULL").select("source", (F.col("budget") - F.col("under")).alias("budget"), F.col("edge").alias("floor")))
    rest = rows.alias("o").join(small(gap).alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")) & (F.col("o.h") > F.col("g.floor")) & (F.col("o.size") <= F.col("g.budget"))).select("o.source", "o.h", "o.size")
    second = cut(threshold(rest, gap.select("source", "budget")))
    g, a, b = goal.alias("g"), first.alias("a"), second.alias("b")
    same = lambda x, y: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))
    plan = g.join(a, same("g", "a")).join(b, same("g", "b"), "left").select(
        "g.source", "g.source_size", "g.target", "g.passes",
        F.col("a.edge").alias("edge1"), F.col("b.budget").alias("fits"), F.col("b.edge").alias("edge2"),
        (F.col("b.under") + F.col("b.at") - F.col("b.budget") < F.col("b.budget") - F.col("b.under")).alias("nearer"),
    )
    o, p = rows.alias("o"), small(cut(plan)).alias("p")
    h, size = F.col("o.h"), F.col("o.size")
    extra = F.when(F.col("edge1").isNull() | (h < F.col("edge1")), 1).when(
        (h > F.col("edge1")) & (size <= F.col("fits")) & (F.col("edge2").isNull() | (h < F.col("edge2")) | (F.col("nearer") & (h == F.col("edge2")))), 1
    ).otherwise(0)
    copies = F.least(F.col("p.passes") + extra, F.lit(cap)).cast("long")
    return o.join(p, same("o", "p")).select("o.doc_id", "o.text_hash", "o.source", "o.size", "p.source_size", "p.target", copies.alias("copies"), (copies * size).alias("taken"))
