"""Expressions at their edges."""

import pytest
from pyspark.sql import functions as F

from opsledger.functions import numbers, rules, text, times


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("a, b, want", [(7, 2, 3), (-7, 2, -3), (7, 0, None), (None, 2, None)])
def test_division_truncates(spark, a, b, want):
    assert one(spark, numbers.whole_div(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))) == want


def test_numbers(spark):
    assert one(spark, numbers.percent(F.lit(2), F.lit(3))) == 66
    assert one(spark, numbers.percent(F.lit(0), F.lit(0))) == 0
    assert one(spark, numbers.truncated(F.lit(-2.7))) == -2
    assert one(spark, numbers.scaled(F.lit(1365), 0.75)) == 1023
    assert tuple(one(spark, numbers.block_space(F.lit(4096).cast("bigint"), F.lit(None).cast("bigint"), F.lit(10)))) == (0, 0)


def test_text(spark):
    assert one(spark, text.trimmed(F.lit(" \ta b\n\n"))) == "a b"
    assert one(spark, text.blank(F.lit(" \n"))) and one(spark, text.blank(F.lit(None).cast("string")))
    assert one(spark, text.after_last(F.lit("a/b/c"), "/")) == "c" and one(spark, text.after_last(F.lit("abc"), "/")) == "abc"
    assert one(spark, text.without_prefix(F.lit("raw:/x"), "raw:")) == "/x"
    assert [one(spark, text.int_or(F.lit(x).cast("string"), 51515)) for x in ("80", " 80", "x", "", None, "99999999999")] == [80, 51515, 51515, 51515, 51515, 51515]
    assert one(spark, text.contains_any(F.lit(None).cast("string"), ["a"])) is False


def test_times(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, times.older_than(ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00"), 24)) is False
    assert one(spark, times.older_than(ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:01"), 24)) is True
    assert one(spark, times.last_run_status(F.lit(None).cast("bigint"), F.lit(True))) is None
    assert one(spark, times.last_run_status(F.lit(0).cast("bigint"), F.lit(True))) is None
    assert one(spark, times.last_run_status(F.lit(1000).cast("bigint"), F.lit(True))) == "Last backup: 1970-01-01 00:00:01 (Success)"
    assert one(spark, times.last_run_status(F.lit(1000).cast("bigint"), F.lit(False))).endswith("(Failed)")


def test_years_beyond_9999_have_no_sign(spark):
    ms = F.lit(4_000_000 * 86_400_000 + 1_700_000_000_000).cast("bigint")
    assert one(spark, times.shown(ms)) == "12975-07-01 22:13:20"
    assert one(spark, times.shown(ms, times.FILE_STAMP)) == "129750701_221320"
    assert one(spark, times.last_run_status(ms, F.lit(True))) == "Last backup: 12975-07-01 22:13:20 (Success)"


def test_three_meanings_of_a_code(spark):
    codes = [200, 302, 401, 403, 404, None]
    col = lambda c: F.lit(c).cast("int")
    assert [one(spark, rules.http_up(col(c))) for c in codes] == [True, True, True, True, False, False]
    assert [one(spark, rules.http_status(col(c))) for c in codes] == ["CONNECTED", "ERROR", "CONNECTED", "ERROR", "ERROR", "DISCONNECTED"]
    assert [one(spark, rules.http_ok(col(c))) for c in codes] == [True, False, False, False, False, False]


def test_tiers(spark):
    assert [one(spark, rules.memory_tier(F.lit(x))) for x in (128, 129, 256, 257)] == ["low", "medium", "medium", "high"]
    assert one(spark, rules.tuning(F.lit(512)))["content_cache_size_mb"] == "250"
    assert [one(spark, rules.text_zoom(F.lit(x))) for x in (3.0, 2.0, 1.5, 1.0, 0.75)] == [100, 100, 110, 120, 130]
    assert [one(spark, rules.retry_delay_ms(F.lit(x))) for x in (9, 10, 20)] == [300, 500, 1000]


# Locators of the platform's own providers, and what is known of them.
LOCATORS = [
    ("content://com.android.externalstorage.documents/tree/primary%3ADownload", "tree", "/storage/emulated/0/Download"),
    ("content://com.android.externalstorage.documents/tree/1234%3Ax", "tree", None),
    ("content://com.android.externalstorage.documents/document/PRIMARY%3Aa%20b", "document_external", "/storage/emulated/0/a b"),
    ("content://com.android.providers.downloads.documents/document/raw%3A%2Fx", "document_download", "/x"),
    ("content://com.android.providers.downloads.documents/document/12", "document_download", None),
    ("content://invalid/path", "content", None), ("content://invalid/tree/path", "content", None), ("FILE:///a/b", "file", "/a/b"), ("https://x/y", "other", None), ("", "other", None),
]


@pytest.mark.parametrize("uri, kind, path", LOCATORS)
def test_locators(spark, uri, kind, path):
    assert one(spark, rules.locator_kind(F.lit(uri))) == kind
    assert one(spark, rules.locator_path(F.lit(uri))) == path


def test_maps(spark):
    from opsledger.functions import maps

    pairs = F.create_map(F.lit("b"), F.lit("1"), F.lit("token"), F.lit("x"), F.lit("a"), F.lit(None).cast("string"))
    assert one(spark, maps.sorted_text(maps.masked(pairs))) == "[a=,b=1,token=***]"
    assert one(spark, maps.sorted_text(maps.present(pairs), ["token"])) == "[token=x,b=1]"
    assert one(spark, maps.sorted_text(F.lit(None).cast("map<string,string>"))) is None


def test_input_and_output_exceptions(spark):
    for name, action in (("java.net.UnknownHostException", "clear_cache"), ("javax.net.ssl.SSLException", "clear_cache"), ("java.nio.file.NoSuchFileException", "clear_cache"), ("java.lang.IllegalStateException", "none")):
        assert one(spark, rules.recovery_action(F.lit(name), F.lit("x"))) == action


def test_path_access_is_by_folder(spark):
    ask = lambda p, full, there: one(spark, rules.can_access(F.lit(p), F.array(F.lit("/a/files/")), F.lit(full), F.lit(there)))
    assert ask("/a/files/x", False, False) and not ask("/a/files2", False, True) and ask("/b", True, True) and not ask("/b", True, False)


def test_passwords(spark):
    ask = lambda p, c, old: one(spark, rules.password_problem(F.lit(p).cast("string"), F.lit(c).cast("string"), F.lit(old)))
    assert [ask("", "", False), ask(None, None, True), ask("short", "short", False), ask("short", None, True), ask("longenough", "other", False), ask("longenough", "longenough", False)] == ["required", "required", "too_short", None, "mismatch", None]


def test_errors_and_inputs(spark):
    assert one(spark, rules.error_text(F.lit('{"error":"no"}'))) == "no" and one(spark, rules.error_text(F.lit("plain"))) == "plain" and one(spark, rules.error_text(F.lit(None).cast("string"))) == "Unknown error"
    assert tuple(one(spark, rules.start_failure(F.lit(None).cast("string"))))[0] == "Server Start Failed"
    assert one(spark, rules.path_input(F.lit("C:\\x"), F.lit("Name"))) and one(spark, rules.path_input(F.lit(""), F.lit("Repo"), F.lit("SITORY")))
    assert one(spark, rules.path_input(F.lit(None).cast("string"), F.lit("Target")))


def header(machine=183, kind=3, bits=2, little=1, magic=b"\x7fELF", size=64):
    order = "little" if little == 1 else "big"
    head = magic + bytes([bits, little]) + bytes(10) + kind.to_bytes(2, order) + machine.to_bytes(2, order)
    return (head + bytes(100))[:size]


@pytest.mark.parametrize("content, ok", [(header(), True), (header(little=2), True), (header(machine=62), False), (header(kind=2), False), (header(bits=1), False), (header(magic=b"\x7fELG"), False), (header(size=60), False)])
def test_executable_header(spark, tmp_path, content, ok):
    from opsledger.sources.other import executables

    (tmp_path / "x.bin").write_bytes(content)
    assert executables(spark, str(tmp_path / "x.bin")).first().valid is ok
