"""Lifecycle timers, bounded live state and tables that are updated in parts."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from furlong.sinks import tables
from furlong.streaming import ingest, lifecycle

START = dt.datetime(2026, 5, 1, 12)
EVENTS = "race_id string, race_start_at timestamp, kind string, at timestamp, supported boolean"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def plain(events, until):
    """Changes of state, looking at every instant from the definition."""
    out = []
    for race in sorted({e[0] for e in events}):
        mine = sorted((e[3], e[2]) for e in events if e[0] == race)
        start, supported = next((e[1], e[4]) for e in events if e[0] == race)
        marks = [start + dt.timedelta(seconds=s) for s in (-1800, -900, -120, 0, 120)]
        last = None
        for now in sorted({t for t, _ in mine} | {m for m in marks if m > mine[0][0]}):
            if now > until:
                break
            seen = [(t, k) for t, k in mine if t <= now]
            final = any(k == "prediction" and start - dt.timedelta(minutes=15) <= t < start for t, k in seen)
            result = any(k == "result" for _, k in seen)
            state = lifecycle.classify(int(now.timestamp() * 1000), int(start.timestamp() * 1000), final, result, supported)
            if state != last:
                out.append((race, state, now))
                last = state
    return sorted(out)


def races(seed):
    draw = random.Random(seed)
    events = [("none", START, "seen", at(-100), True), ("late result", START, "seen", at(-40), True), ("late result", START, "result", at(90), True), ("late result", START, "seen", at(91), True)]
    for r in range(12):
        start = at(7 * r)
        for _ in range(draw.randint(1, 6)):
            kind = draw.choice(["seen", "prediction", "prediction", "result"])
            events.append((f"r{r}", start, kind, start + dt.timedelta(seconds=draw.randint(-3000, 900)), r % 5 != 0))
    return [*events, ("last", at(600), "seen", at(500), True)]


@pytest.mark.parametrize("files", [1, 4, 16])
def test_lifecycle_does_not_depend_on_batches(spark, tmp_path, files):
    events = sorted(races(1), key=lambda e: e[3])
    for k in range(files):
        spark.createDataFrame(events[k * len(events) // files : (k + 1) * len(events) // files] or [], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ingest.drain(lifecycle.transitions(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted((r.race_id, r.state, r.at) for r in out.collect())
    assert got == plain(events, at(500) - dt.timedelta(minutes=1))
    in_order = sorted(got, key=lambda x: x[2])
    none = [s for r, s, _ in in_order if r == "none"]
    assert none == ["WAITING", "PRE_WINDOW", "CAPTURING", "FINAL_CAPTURING", "POST_START_RETRY", "FAILED"]
    assert [s for r, s, _ in in_order if r == "late result"][-2:] == ["FAILED", "RESULT_CAPTURED"]


def test_lifecycle_keeps_state_by_bucket_not_by_race(spark, tmp_path, monkeypatch):
    """Python is called once a bucket and batch; what a bucket holds goes with its last race."""
    monkeypatch.setattr(lifecycle, "BUCKETS", 4, raising=False)
    for k, (names, hours) in enumerate([(range(90), 0), (range(90, 120), 40), ([None], 100)]):
        rows = [(None if n is None else f"r{n}", at(0) + dt.timedelta(hours=hours), "seen", at(-100) + dt.timedelta(hours=hours), True) for n in names]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = (
        lifecycle.transitions(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 4 and held[-1] == 1
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("race_id").count().collect()
    assert {r.race_id: r["count"] for r in out} == {f"r{n}": 6 for n in range(120)}


def test_a_race_is_forgotten_a_day_after_its_start():
    start = 10**12
    held, out = lifecycle.advance((start, True, False, False, None, None, ""), [(start - 10**7, "seen")], start + 10**6)
    assert [s for _, s in out] == ["WAITING", "PRE_WINDOW", "CAPTURING", "FINAL_CAPTURING", "POST_START_RETRY", "FAILED"]
    assert [t - start for t, _ in out][1:] == [-1800_000, -900_000, -120_000, 0, 120_000]
    assert lifecycle.next_timer(held, start + 10**6) == start + lifecycle.EXPIRY * 1000
    held, out = lifecycle.advance(held, [(start + 2 * 10**6, "result")], start + 10**6)
    assert not out and held[-1] == f"{start + 2 * 10**6}:result"
    held, out = lifecycle.advance(held, [], start + 3 * 10**6)
    assert out == [(start + 2 * 10**6, "RESULT_CAPTURED")] and not lifecycle.advance(held, [(start + 4 * 10**6, "seen")], start + 5 * 10**6)[1]


def test_live_state_stops_growing(spark, tmp_path):
    schema = "k long, ts timestamp, start timestamp, v long"
    for day in range(100):
        t = START + dt.timedelta(days=day)
        spark.createDataFrame([(day * 10 + i, t + dt.timedelta(hours=i), t + dt.timedelta(hours=5), i) for i in range(8)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{day:03d}")
    stream = ingest.with_late_flag(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), "ts", "start")
    state = ingest.latest_state(stream, ["k"], "ts", ["v"], delay="2 days")
    query = (
        state.writeStream.foreachBatch(lambda b, _: tables.upsert(b, f"{tmp_path}/out", ["k", "span_start"], F.date_format("span_start", "yyyy-MM"))).outputMode("update")
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 20 and max(held[3:]) == held[3] < 200  # 800 keys came, those of the open days are held
    out = tables.read(spark, f"{tmp_path}/out")
    assert out.count() == 800 and out.filter("late_rows = 1").count() == 300 and out.filter("v is not null").count() == 500


def test_rows_behind_the_watermark_go_to_a_side_table(spark, tmp_path):
    schema = "k long, ts timestamp"
    for n, rows_ in enumerate([[(1, at(0)), (2, at(60))], [(3, at(61)), (4, at(49))], [(5, at(50)), (6, at(200))]]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    late = ingest.with_side_table(stream, "ts", f"{tmp_path}/side", f"{tmp_path}/c", delay="10 minutes")
    assert sorted(r.k for r in late.collect()) == [4, 5]


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("part-*.parquet")}


@pytest.mark.parametrize("how", ["upsert", "coalesce", "replace", "ignore"])
def test_writes_leave_other_parts_alone(spark, tmp_path, how):
    path = str(tmp_path / "t")
    day = F.date_format("day", "yyyy-MM-dd")
    make = lambda low, high, d, v: spark.range(low, high).select("id", F.lit(d).cast("date").alias("day"), F.lit(v).alias("v"), F.lit(None if v == "new" else "first").cast("string").alias("w"))
    old = make(0, 50, "2026-01-01", "old").unionByName(make(0, 50, "2026-01-02", "old"))
    write = {
        "upsert": lambda df: tables.upsert(df, path, ["id", "day"], day),
        "coalesce": lambda df: tables.coalesce_upsert(df, path, ["id", "day"], ["w"], [], day),
        "replace": lambda df: tables.replace_by_key(df, path, ["id", "day"], [F.col("v").asc()], day),
        "ignore": lambda df: tables.insert_ignore(df, path, ["id", "day"], [F.col("v").asc()], day),
    }[how]
    write(old)
    before = files_of(path)
    write(make(40, 60, "2026-01-02", "new"))
    after = files_of(path)
    kept = {f: t for f, t in before.items() if "2026-01-01" in f}
    assert kept and kept.items() <= after.items()
    if how == "ignore":
        assert before.items() <= after.items()
    table = {(r.id, str(r.day)): (r.v, r.w) for r in tables.read(spark, path).collect()}
    assert len(table) == 110 and table[45, "2026-01-01"] == ("old", "first")
    assert table[45, "2026-01-02"] == {"upsert": ("new", None), "coalesce": ("new", "first"), "replace": ("new", None), "ignore": ("old", "first")}[how]
    assert table[55, "2026-01-02"] == ("new", None)


def test_only_touched_parts_are_read(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), ["id"], F.pmod("id", F.lit(8)))
    table.insert_ignore(spark.range(800).withColumn("v", F.lit(1)))
    batch = spark.createDataFrame([(8, 2), (16, 2)], "id long, v int")
    assert table.touched(batch) == ["0"]
    assert {f for f in table.rows_of(["0"]).inputFiles()} and table.rows_of(["0"]).count() == 100
    scanned = table.rows_of(["0"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scanned and "_part_of_key" in scanned
    table.merge(batch, lambda old, new: tables.upserted(old, new, ["id"]))
    assert rows(table.read().filter("v = 2").select("id")) == [(16,), (8,)]
