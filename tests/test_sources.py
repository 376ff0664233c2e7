"""Settings files, listings, command output, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from opsledger.operators import keyvalue
from opsledger.sources import listing, other, settings
from opsledger.streaming import tail


def test_settings_round_trip(spark, tmp_path):
    values = {"on": True, "port": 24, "big": 1 << 40, "zoom": 1.5, "name": 'a "quoted" \n é', "digits": "24", "word": "true"}
    log = keyvalue.put(spark, "main", values, 1).unionByName(keyvalue.put(spark, "other", {"x": 1}, 1)).unionByName(keyvalue.deletions(spark, "other", ["x"], 2))
    rows = keyvalue.current(log).select("store", "key", "type", "value")
    text = settings.to_json(rows, 1700000000000, "1.0").first().value
    assert json.loads(text)["settings"] == {"main": values} and '\n  "timestamp": 1700000000000' in text
    out = settings.write(rows, str(tmp_path), 1700000000000, "1.0")
    assert out.endswith("settings_backup_20231114_221320.json")
    back = settings.restore(settings.read(spark, out), ts=5)
    assert sorted(map(tuple, keyvalue.current(back).select("store", "key", "type", "value").collect())) == sorted(map(tuple, rows.collect()))


def test_settings_of_others(spark):
    table = lambda x: spark.createDataFrame([(x,)], "value string")
    rows = settings.parse(table('{"timestamp": 1, "appVersion": "v", "settings": {"s": {"a": 24, "b": 1.5, "c": "x", "d": true, "e": null, "f": [1]}}}'))
    found = {r.key: (r.type, r.value) for r in rows.collect()}
    assert {k: v[0] for k, v in found.items()} == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "f": "unsupported"}
    assert {r.key for r in settings.restore(rows, 1).collect()} == {"a", "b", "c", "d"}
    for bad in ("not json", '{"timestamp": 1, "settings": {}}'):
        with pytest.raises(Exception, match="settings"):
            settings.parse(table(bad)).collect()
    assert settings.parse(table('{"timestamp": 1, "appVersion": "v", "settings": {}}')).count() == 0


def test_settings_mask_secrets(spark):
    rows = keyvalue.put(spark, "s", {"repository_password": "hidden", "a": 1}, 1)
    assert "hidden" not in settings.to_json(rows, 1, "v").first().value
    assert "hidden" in settings.to_json(rows, 1, "v", keep_secrets=True).first().value


def test_listing_is_complete(spark, tmp_path):
    for name, body in {"file1.txt": "File 1", "file2.txt": "File 2", "subdir/file3.txt": "File 3", ".hidden": "abc", ".dir/x": "12", "_under": "1", "empty": "", "subdir/deep/_y": "zz"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "nothing").mkdir()
    found = listing.list_files(spark, str(tmp_path))
    from opsledger.operators.aggregates import tree_size

    assert tuple(tree_size(found).first())[1:] == (26, 8)
    assert found.where("is_dir").count() == 4 and found.where("error is not null").count() == 0
    one_level = listing.list_files(spark, str(tmp_path), recursive=False)
    assert one_level.count() == 8
    missing = listing.list_files(spark, str(tmp_path / "absent"))
    assert missing.where("error is not null").count() == 1
    manifest = listing.copy_manifest(found, "/target/")
    assert manifest.where("target_path = '/target/subdir/file3.txt' and status = 'planned'").count() == 1
    assert {r.name for r in listing.deletion_candidates(one_level, ["file", "dir"]).collect()} == {".hidden", "_under", "empty", "nothing"}


def test_commands_and_snapshots(spark):
    out = other.run_command(spark, ["python", "-c", "import sys; print('[1]'); sys.exit(3)"]).first()
    assert (out.exit, out.output) == (3, "[1]\n") and other.run_command(spark, ["/no/such/program"]).first().exit == -1
    rows = other.snapshots(spark.createDataFrame([('[{"id": "a"}]',), ("warning\n[]",), (None,)], "output string"))
    assert sorted(r[0] for r in rows.select(F.col("snapshots").isNotNull()).collect()) == [False, False, True]


def test_catalogue(spark):
    folders = other.folder_catalogue(spark, [("Own", '/a"b', "d\\", True, True), ("Cache", "/c", "x", True, False), ("Open", "/d", "y", False, True), ("Shut", "/e", "z", False, False)])
    parsed = json.loads(other.catalogue_json(folders).first().value)
    assert [x["name"] for x in parsed] == ["Cache", "Open", "Own"] and parsed[2]["path"] == '/a"b' and parsed[0]["alwaysAccessible"] is True


def test_error_log_sink(spark, tmp_path):
    errors = spark.createDataFrame([("id1", 1000, "ERROR", None, "E", [f"f{i}" for i in range(9)])], "id string, timestamp_ms bigint, severity string, message string, exception_class string, stack array<string>")
    for _ in range(2):
        other.write_error_log(errors, str(tmp_path / "log"))
    text = "\n".join(p.read_text() for p in (tmp_path / "log").glob("part*"))
    assert text.count("1970-01-01 00:00:01 [ERROR] [id1] Unknown error") == 2 and "f4" in text and "f5" not in text


def test_report_sink(spark, tmp_path):
    from opsledger.plans.reports import combined, self_test_report

    results = spark.createDataFrame([("b", True), ("a", None)], "test string, passed boolean")
    report = self_test_report(results, spark.createDataFrame([("a", "why")], "test string, note string"))
    other.write_report(combined(report, report), str(tmp_path / "report"))
    lines = "".join(p.read_text() for p in (tmp_path / "report").glob("part*")).splitlines()
    assert lines == ["a: FAIL  Note: why", "b: PASS"] * 2


def test_log_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("An Alpha line\nnothing\n")
    for more in ("ALPHA again\n\n", "x\n"):
        lines = tail.tail(spark, str(source), ["alpha"])
        assert lines.isStreaming
        tail.collect_lines(lines, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        (source / f"{more[0]}.txt").write_text(more)
    tail.collect_lines(tail.tail(spark, str(source), ["alpha"]), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["ALPHA again", "An Alpha line"]


def test_latest_value_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"job":"a","ts":1,"seq":1,"status":"CONNECTING"}\n{"job":"a","ts":2,"seq":1,"status":"CONNECTED"}\n{"job":"b","ts":1,"seq":1,"status":"ERROR"}\n')
    changes = spark.readStream.schema("job string, ts bigint, seq bigint, status string").json(str(tmp_path))
    query = tail.latest(changes, "job", "ts", "seq").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.job, r.status) for r in spark.table("latest").collect()) == [("a", "CONNECTED"), ("b", "ERROR")]
    assert tail.every(6) == {"processingTime": "21600 seconds"}


def test_documents_that_would_not_fit_one_row_are_refused(spark):
    rows = spark.range(8).select(F.concat(F.lit("s"), "id").alias("store"), F.lit("k").alias("key"), F.lit("bigint").alias("type"), F.col("id").cast("string").alias("value"))
    with pytest.raises(Exception, match="more than 7 stores"):
        settings.to_json(rows, 1, "v", most=7).collect()
    assert len(json.loads(settings.to_json(rows, 1, "v", most=8).first().value)["settings"]) == 8
    assert settings.documents(rows, 1, "v").count() == 8 and settings.documents(rows.limit(0), 1, "v").count() == 0
    folders = other.accessible(rows.select(F.col("store").alias("name"), F.lit("/").alias("path"), F.lit("d").alias("description"), F.lit(True).alias("always_accessible"), F.lit(True).alias("available")))
    with pytest.raises(Exception, match="more than 7 folders"):
        other.catalogue_json(folders, most=7).collect()
    assert json.loads(other.catalogue_lines(folders).first().value)["alwaysAccessible"] is True


def test_workflow_results(spark):
    from opsledger.operators.aggregates import workflow_results

    steps = spark.createDataFrame([("a", 1, True, None), ("b", 2, False, "second"), ("b", 1, None, None), ("c", 1, False, "why"), ("c", 2, False, "later")], "workflow string, step int, ok boolean, message string")
    got = {r.workflow: (r.success, r.message, r.details) for r in workflow_results(steps).collect()}
    assert got == {"a": (True, "all steps passed", "Steps: 1"), "b": (False, "failed", "Steps: 2"), "c": (False, "why", "Steps: 2")}
