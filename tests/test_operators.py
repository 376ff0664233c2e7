"""Operators on small tables: empty, null, tied and repeated rows."""

import datetime as dt

from pyspark.sql import functions as F

from opsledger.operators import aggregates, keyvalue, relational

NOW = dt.datetime(2024, 1, 2)


def test_timing_summary(spark):
    rows = aggregates.timing_summary(spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", None)], "tag string, ms bigint")).orderBy("tag").collect()
    assert [tuple(r) for r in rows] == [("a", 1, 1, 2, 2), ("b", 5, 5, 5, 1), ("c", None, None, None, 0)]
    more = aggregates.measured(spark.createDataFrame([("a", 1)], "tag string, ms bigint"), "a", [3, 5])
    assert tuple(aggregates.timing_summary(more).first()) == ("a", 3, 1, 5, 3)


def test_check_summary(spark):
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "success boolean")
    assert tuple(aggregates.check_summary(table([])).first()) == (0, 0, 0, 0)
    assert tuple(aggregates.check_summary(table([True, True, False])).first()) == (3, 2, 1, 66)
    assert tuple(aggregates.check_summary(table([True, None])).first()) == (2, 1, 1, 50)
    assert aggregates.all_passed(table([])).first()[0] is True and aggregates.all_passed(table([True, False])).first()[0] is False


def test_cleanup_counts_folders_but_not_their_bytes(spark):
    rows = [("old.tmp", 2000, NOW - dt.timedelta(hours=25), False), ("day.tmp", 50, NOW - dt.timedelta(hours=24), False), ("dir", 7, NOW - dt.timedelta(hours=30), True),
            ("keepme.tmp", 9, NOW - dt.timedelta(hours=99), False), ("KEEPME", 100, NOW - dt.timedelta(hours=99), False), ("x.config", 1, NOW - dt.timedelta(hours=99), False)]
    files = spark.createDataFrame(rows, "name string, length bigint, modified timestamp, is_dir boolean")
    assert tuple(aggregates.cleanup_totals(files, F.lit(NOW), ["keepme", ".config"]).first()) == (3, 2100, 2)
    assert tuple(aggregates.cleanup_totals(files.limit(0), F.lit(NOW), []).first()) == (0, 0, 0)


def test_newest_keeps_the_last_hundred(spark):
    rows = spark.range(150).select((F.col("id") % 3).alias("ts"), F.col("id").alias("seq"))
    kept = relational.newest(rows, 100, "ts", "seq").collect()
    assert len(kept) == 100 and all(r.ts == 2 for r in kept[:50]) and kept[0].seq == 149
    assert "TakeOrderedAndProject" in relational.newest(rows, 100, "ts", "seq")._jdf.queryExecution().executedPlan().toString()


def test_notes_are_optional(spark):
    results = spark.createDataFrame([("a", True), ("b", False)], "test string, passed boolean")
    notes = spark.createDataFrame([("a", "n")], "test string, note string")
    assert sorted((r.test, r.note) for r in relational.with_notes(results, notes).collect()) == [("a", "n"), ("b", None)]


def log(spark, *writes):
    out = None
    for i, (store, values) in enumerate(writes):
        rows = keyvalue.put(spark, store, values, ts=i, seq=0)
        out = rows if out is None else out.unionByName(rows)
    return out


def test_schedule_defaults_and_last_write(spark):
    empty = spark.createDataFrame([], keyvalue.SCHEMA)
    assert tuple(keyvalue.schedule(empty).first()) == (False, 24, False, False, None)
    saved = log(spark, ("schedule", {"enabled": True, "interval_hours": 24}), ("schedule", {"enabled": True, "interval_hours": 6, "require_charging": True, "require_wifi": True, "source_path": "/sdcard/test"}))
    assert tuple(keyvalue.schedule(saved).first()) == (True, 6, True, True, "/sdcard/test")
    off = saved.unionByName(keyvalue.put(spark, "schedule", {"enabled": False}, ts=9))
    assert keyvalue.schedule(off).first().enabled is False
    again = spark.createDataFrame([("j", 24, 1, 1), ("j", 12, 2, 1), ("j", 6, 2, 0), ("k", 1, 1, 1)], "job string, interval_hours int, ts int, seq int")
    assert {tuple(r) for r in keyvalue.unique_schedules(again).select("job", "interval_hours", "replaced").collect()} == {("j", 12, 2), ("k", 1, 0)}
    thrice = log(spark, *[("schedule", {"enabled": True})] * 3)
    assert keyvalue.store_rows(thrice, "schedule").count() == 1


def test_deletes_defaults_and_secrets(spark):
    rows = log(spark, ("s", {"a": 1, "repository_password": "x", "port": "no"}), ("other", {"a": 5})).unionByName(keyvalue.deletions(spark, "s", ["a", "never"], 7))
    assert [r.key for r in keyvalue.store_rows(rows, "s").orderBy("key").collect()] == ["port", "repository_password"]
    assert keyvalue.read_typed(rows, "s", {"port": ("int", 51515)}).first().port == 51515
    assert keyvalue.redacted(keyvalue.store_rows(rows, "s")).where("key = 'repository_password'").first().value == "***"


def test_small_lookups(spark):
    rows = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "id string, n int")
    assert relational.first_by_id(rows, "id", "x", ["n"]).first().n == 1 and relational.first_by_id(rows, "id", "z", ["n"]).count() == 0
    assert relational.lookup(rows, "id", "none", "n").count() == 0 and relational.lookup(rows, "id", None, "n").count() == 1
    jobs = lambda *xs: aggregates.any_active(spark.createDataFrame([(x,) for x in xs], "state string")).first()[0]
    assert jobs() is False and jobs("SUCCEEDED", None) is False and jobs("ENQUEUED") is True
    assert relational.last_written(rows, ["id"], "n", "n").where("id = 'x'").first().n == 2
