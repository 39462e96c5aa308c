"""Stored tables and the streams that write them: what is touched, what happens twice, what is late, and how much state there is."""

import datetime as dt
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stored
from tidemark.sources import shared
from tidemark.streaming import jobs

DAY = dt.date(2024, 1, 1)


def rows(spark, items):
    return spark.createDataFrame([(k, DAY + dt.timedelta(d), v) for k, d, v in items], "k long, d date, v long")


def table(spark):
    return stored.Table(shared.new(spark, "test"), ("k", "d"), ("v",), "date_format(d, 'yyyy-MM')")


def files(path):
    found = {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}
    return {str(p): x for p, x in found.items()}


def content(spark, t):
    return sorted(tuple(r) for r in t.read(spark).collect())


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_only_touched_folders_are_written(spark):
    t = table(spark)
    old = rows(spark, [(k, d, k + d) for k in range(5) for d in range(0, 120, 7)] + [(None, 3, 1)])
    batch = rows(spark, [(1, 40, 900), (1, 40, 901), (2, 42, 77), (99, 45, 5), (None, 33, 8)])
    stored.create(t, old)
    before = files(local(t.path))
    stored.upsert_into(t, batch)
    after = files(local(t.path))
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if "part=p2024-02" in p}
    assert all("part=p2024-02" in p for p in after if p not in before)
    want = {(r.k, r.d): r.v for r in old.collect()} | {(1, DAY + dt.timedelta(40)): 901, (2, DAY + dt.timedelta(42)): 77, (99, DAY + dt.timedelta(45)): 5, (None, DAY + dt.timedelta(33)): 8}
    assert {(r.k, r.d): r.v for r in t.read(spark).collect()} == want


def test_plan_reads_only_the_folders(spark):
    t = table(spark)
    stored.create(t, rows(spark, [(1, d, d) for d in range(0, 120, 10)]))
    plan = t.read(spark, ["p2024-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "p2024-02" in plan
    assert t.read(spark, ["p2024-02"]).count() == 2


def test_a_named_commit_happens_once(spark):
    t = table(spark)
    stored.upsert_into(t, rows(spark, [(1, 0, 1), (2, 0, 1)]), commit="a")
    stored.upsert_into(t, rows(spark, [(1, 0, 5)]), commit="b")
    now = files(local(t.path))
    stored.upsert_into(t, rows(spark, [(1, 0, 9), (3, 0, 9)]), commit="b")
    stored.upsert_into(t, rows(spark, []), commit="c")
    assert files(local(t.path)) == now
    assert {(r.k, r.v) for r in t.read(spark).collect()} == {(1, 5), (2, 1)}


@pytest.mark.parametrize("complete", [True, False])
def test_a_write_that_was_cut_off(spark, monkeypatch, complete):
    t = table(spark)
    stored.create(t, rows(spark, [(1, 0, 1), (2, 40, 1)]))
    monkeypatch.setattr(stored, "_apply", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        stored.upsert_into(t, rows(spark, [(1, 0, 7)]), commit="x")
    monkeypatch.undo()
    if not complete:
        os.remove(local(f"{t.path}-pending/x/_SUCCESS"))
    stored.upsert_into(t, rows(spark, [(3, 80, 3)]), commit="y")
    assert {(r.k, r.v) for r in t.read(spark).collect()} == {(1, 7 if complete else 1), (2, 1), (3, 3)}


def test_partial_update(spark):
    t = stored.Table(shared.new(spark, "test"), ("k",), ("v",), "pmod(k, 4)")
    make = lambda x: spark.createDataFrame(x, "k long, title string, v long")
    stored.create(t, make([(1, "a", 1), (2, "b", 1)]))
    stored.upsert_into(t, make([(2, "other", 5), (6, "new", 6)]), ["v"])
    assert content(spark, t) == [(1, "a", 1), (2, "b", 5), (6, "new", 6)]


def land(spark, at, i, items, schema):
    spark.createDataFrame(items, schema).coalesce(1).write.parquet(f"{at}/landed/{i:03d}")


def test_bars_keep_a_bounded_state(spark):
    """A day's ticks a load: the windows in the state stay those of the last days, and the bars are those of all ticks."""
    at, schema, rng = shared.new(spark, "bars"), "who long, ts timestamp, v double", random.Random(1)
    t = stored.Table(f"{at}/table", ("who", "start"), ("n",), "date_format(start, 'yyyy-MM-dd')")
    states, every = [], []
    for i in range(7):
        ticks = [(rng.randint(0, 3), dt.datetime(2024, 1, 1 + i, rng.randint(0, 23), rng.randint(0, 59)), float(rng.randint(0, 9))) for _ in range(150)]
        every += ticks
        land(spark, at, i, ticks, schema)
        stream = jobs.file_stream(spark, f"{at}/landed/*", spark.createDataFrame([], schema), None)
        q = jobs.upsert_stream(jobs.bars(stream, "ts", "who", "v", late="6 hours"), t, f"{at}/checkpoint", mode="update")
        q.awaitTermination()
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    assert max(states[2:]) <= 1.5 * states[1] and max(states) < 96 * 2
    batch = jobs.bars(spark.createDataFrame(every, schema), "ts", "who", "v")
    assert content(spark, t) == sorted(tuple(r) for r in batch.collect())


def test_corrections(spark):
    """Loads out of order, with corrections, repeats, older versions, nulls and rows beyond the look-back."""
    at, rng, schema = shared.new(spark, "late"), random.Random(4), "who string, ts timestamp, v double, version long"
    t = stored.Table(f"{at}/table", ("who", "ts"), ("version", "v"), "date_format(ts, 'yyyy-MM')")
    every, states = [], []
    for i in range(6):
        items = [(rng.choice(["a", "b", f"only {i}"]), dt.datetime(2024, 1, 1) + dt.timedelta(days=i * 5 + rng.randint(-25, 4)), float(rng.randint(0, 5)), rng.randint(0, 30)) for _ in range(60)]
        items += [items[0], ("a", None, 1.0, 1), ("a", items[1][1], None, 99), (None, items[2][1], 2.0, 3)]
        every += [(*x, i) for x in items]
        land(spark, at, i, items, schema)
        stream = jobs.corrections(jobs.file_stream(spark, f"{at}/landed/*", spark.createDataFrame([], schema), None), "who", "ts", "v", "version", "10 days")
        q = jobs.upsert_stream(stream.drop("revised"), t, f"{at}/checkpoint")
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    want = jobs.corrected(spark.createDataFrame(every, schema + ", load int"), "who", "ts", "v", "version", "load", "10 days").collect()
    assert {tuple(r) for r in t.read(spark).collect()} == {(r.who, r.ts, r.v, r.version) for r in want}
    late = spark.createDataFrame(every, schema + ", load int").where("ts IS NOT NULL").select("who", "ts").distinct().count()
    assert 0 < len(want) < late  # some rows were beyond the limit
    assert states[-1] <= 6  # keys that came once are gone


def test_corrections_take_keys_in_groups(spark):
    """Thousands of keys, one of them null, whole numbers that floats cannot tell apart: no more states than groups, and what is revised."""
    at, schema, big = shared.new(spark, "groups"), "who long, ts timestamp, v double, version long", 1 << 60
    noon, found, states = dt.datetime(2024, 1, 1, 12), [], []
    loads = [[(big + k, noon, 1.0, 1) for k in range(3000)] + [(None, noon, 1.0, 1)], [(big + k, noon, 2.0, k % 2 * 2) for k in range(10)] + [(None, noon, 2.0, 2), (0, noon, 3.0, 1), (big, noon, 1.0, 1)]]
    for i, items in enumerate(loads):
        land(spark, at, i, items, schema)
        stream = jobs.corrections(jobs.file_stream(spark, f"{at}/landed/*", spark.createDataFrame([], schema), None), "who", "ts", "v", "version", "10 days")
        q = stream.writeStream.foreachBatch(lambda b, _: found.append([tuple(r) for r in b.collect()])).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(states) <= jobs.GROUPS
    first, second = [x for x in found if x]
    assert set(first) == {(*x, False) for x in loads[0]} and len(first) == 3001
    assert set(second) == {(big + k, noon, 2.0, 2, True) for k in range(1, 10, 2)} | {(None, noon, 2.0, 2, True), (0, noon, 3.0, 1, False)}
