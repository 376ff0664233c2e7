"""Queries over the given tables, each with the SQL that it must agree with.

The tables hold no operational data, so each query binds an operator to stand-in columns; the bindings are ours. Events
stand for measurements, log entries, files and key-value writes; labels for check results; parts for devices and codes;
documents for log lines; pages for files and locators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.functions import maps, numbers, rules, text, times
from opsledger.operators import aggregates, keyvalue, relational
from opsledger.plans import reports
from opsledger.sources import listing, other, settings
from opsledger.sources.other import work_folder
from opsledger.streaming import tail

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str):
    """Register a function (tables) -> DataFrame under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        _queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        _sql[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a folder, as attributes; columns and filters are pushed to their scans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _files(t: Tables) -> DataFrame:
    """Events as files: name and folder flag by type, size by value."""
    return t.events.select("event_id", F.col("event_type").alias("name"), F.col("ts").alias("modified"), F.col("value").cast("bigint").alias("length"), (F.col("event_type") == "view").alias("is_dir"))


@query("""SELECT event_type AS tag, CAST(trunc(avg(CAST(trunc(value) AS BIGINT))) AS INTEGER) AS avg_ms, min(CAST(trunc(value) AS BIGINT)) AS min_ms,
 max(CAST(trunc(value) AS BIGINT)) AS max_ms, count(value) AS n FROM events GROUP BY 1""")
def timing_summary(t):
    return aggregates.timing_summary(t.events.select(F.col("event_type").alias("tag"), F.col("value").cast("bigint").alias("ms")))


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def error_log_tail(t):
    errors = relational.by_severity(t.events.withColumnRenamed("event_type", "severity"), "error")
    return relational.newest(errors, 100, "ts", "event_id").select("event_id", "ts", "user_id")


@query("""WITH n AS (SELECT max(ts) AS now FROM events)
SELECT count(*) AS candidates, CAST(coalesce(sum(CASE WHEN event_type <> 'view' THEN CAST(trunc(value) AS BIGINT) END), 0) AS BIGINT) AS freed_bytes,
 CAST(coalesce(sum(CASE WHEN event_type <> 'view' THEN CAST(trunc(value) AS BIGINT) END), 0) // 1024 AS BIGINT) AS freed_kb
FROM events, n WHERE ts < now - INTERVAL 24 HOUR AND event_type NOT LIKE '%purchase%' AND event_type NOT LIKE '%err%'""")
def stale_candidates_summary(t):
    now = t.events.agg(F.max("ts")).scalar()
    return aggregates.cleanup_totals(_files(t), now, ["purchase", "err"])


@query("""WITH n AS (SELECT max(ts) AS now FROM events)
SELECT event_id, event_type AS name FROM events, n WHERE ts < now - INTERVAL 48 HOUR AND event_type NOT LIKE '%click%'""")
def stale_files(t):
    now = t.events.agg(F.max("ts")).scalar()
    return relational.stale_files(_files(t), now, ["click"], 48).select("event_id", "name")


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) - count(*) FILTER (quality = 1) AS failed,
 CAST(coalesce(count(*) FILTER (quality = 1) * 100 // nullif(count(*), 0), 0) AS BIGINT) AS success_percent FROM labels""")
def check_summary(t):
    return aggregates.check_summary(t.labels.select((F.col("quality") == 1).alias("success")))


@query("SELECT split_part(url, '/', 3) AS root, CAST(sum(length(html)) AS BIGINT) AS bytes, count(*) AS files FROM pages GROUP BY 1")
def tree_size(t):
    return aggregates.tree_size(t.pages.select(F.split("url", "/")[2].alias("root"), F.length("html").cast("bigint").alias("length"), F.lit(False).alias("is_dir")))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT doc_id, md5(value) AS line FROM l WHERE contains(lower(value), 'the')""")
def log_filter(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return relational.matching_lines(lines, ["the", "The end"]).select("doc_id", F.md5("value").alias("line"))


@query("""SELECT event_id, key, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'double' ELSE 'bigint' END AS type, props ->> key AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def settings_flatten(t):
    doc = F.concat(F.lit('{"timestamp": 0, "appVersion": "", "settings": {"'), F.col("event_id").cast("string"), F.lit('": '), "props", F.lit("}}"))
    return settings.parse(t.events.select(doc.alias("value"))).select(F.col("store").cast("bigint").alias("event_id"), "key", "type", "value")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM r WHERE k = 1""")
def last_status(t):
    last = relational.last_written(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], "ts", "event_id")
    return last.select("user_id", "event_type", times.stamped(F.col("ts")).alias("shown"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'Last backup: ' || strftime(make_timestamp(event_id * 86400000000 + 1700000000000000), '%Y-%m-%d %H:%M:%S')
 || CASE WHEN event_type = 'error' THEN ' (Failed)' ELSE ' (Success)' END END AS status FROM events""")
def last_run_text(t):
    ms = F.when(F.col("event_id") % 7 == 0, 0).otherwise(F.col("event_id") * 86_400_000 + 1_700_000_000_000)
    return t.events.select("event_id", times.last_run_status(ms.cast("bigint"), F.col("event_type") != "error").alias("status"))


@query("SELECT doc_id, left(text, 100) AS head FROM documents")
def head_chars(t):
    return t.documents.select("doc_id", text.head(F.col("text"), 100).alias("head"))


LOCATORS = """CASE page_id % 6 WHEN 0 THEN 'content://com.android.externalstorage.documents/tree/primary%3ADownload%2F' || page_id
 WHEN 1 THEN 'content://com.android.externalstorage.documents/document/primary%3Adir%2F' || page_id WHEN 2 THEN 'content://com.android.providers.downloads.documents/document/raw%3A%2Fd%2F' || page_id
 WHEN 3 THEN 'content://com.android.providers.media.documents/document/image%3A' || page_id WHEN 4 THEN 'file:///data/' || page_id ELSE url END"""


@query(f"""WITH u AS (SELECT page_id, {LOCATORS} AS uri FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'tree' WHEN 1 THEN 'document_external' WHEN 2 THEN 'document_download' WHEN 3 THEN 'document_media' WHEN 4 THEN 'file' ELSE 'other' END AS kind,
 CASE page_id % 6 WHEN 0 THEN '/storage/emulated/0/Download/' || page_id WHEN 1 THEN '/storage/emulated/0/dir/' || page_id WHEN 2 THEN '/d/' || page_id WHEN 4 THEN '/data/' || page_id END AS path,
 CASE WHEN page_id % 6 = 3 THEN CAST(page_id AS VARCHAR) END AS media_id, array_reverse(string_split(uri, '/'))[1] AS leaf FROM u""")
def locator_route(t):
    uri = F.col("uri")
    pages = t.pages.select("page_id", F.expr(LOCATORS).alias("uri"))
    return pages.select("page_id", rules.locator_kind(uri).alias("kind"), rules.locator_path(uri).alias("path"), rules.media_key(uri)["id"].alias("media_id"), text.after_last(uri, "/").alias("leaf"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority, ends_with(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'example.com') AS own FROM pages")
def locator_authority(t):
    who = rules.authority(F.col("url"))
    return t.pages.select("page_id", who.alias("authority"), who.endswith("example.com").alias("own"))


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS place FROM events")
def newest_first(t):
    return relational.ranked_newest(t.events, "user_id", "ts", "event_id").select("event_id", "user_id", "place")


@query("SELECT l.doc_id, quality, lang FROM labels l LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'en') d USING (doc_id)")
def result_with_note(t):
    return relational.with_notes(t.labels.select("doc_id", "quality"), t.documents.where("lang <> 'en'").select("doc_id", "lang"), "doc_id")


@query("""SELECT p_partkey, CASE WHEN p_size * 10 <= 128 THEN 'low' WHEN p_size * 10 <= 256 THEN 'medium' ELSE 'high' END AS tier,
 CASE WHEN p_size * 10 <= 128 THEN '100' WHEN p_size * 10 <= 256 THEN '200' ELSE '500' END AS cache_mb,
 CASE WHEN p_size * 10 <= 128 THEN '5' WHEN p_size * 10 <= 256 THEN '10' ELSE '20' END AS mbps FROM part""")
def device_tier(t):
    memory = F.col("p_size") * 10
    tuned = rules.tuning(memory)
    return t.part.select("p_partkey", rules.memory_tier(memory).alias("tier"), tuned["cache_directory_size_mb"].alias("cache_mb"), tuned["max_download_speed_mbps"].alias("mbps"))


@query("""SELECT p_partkey, (p_size % 5 = 0 OR p_size * 10 <= 128) AS low_end,
 CAST(CASE WHEN p_size / 10.0 >= 2 THEN 100 WHEN p_size / 10.0 >= 1.5 THEN 110 WHEN p_size / 10.0 >= 1 THEN 120 ELSE 130 END AS INTEGER) AS zoom FROM part""")
def device_display(t):
    return t.part.select("p_partkey", rules.low_end(F.col("p_size") % 5 == 0, F.col("p_size") * 10).alias("low_end"), rules.text_zoom(F.col("p_size") / 10.0).alias("zoom"))


@query("SELECT source, coalesce(bool_and(quality = 1), true) AS all_passed FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def all_passed(t):
    joined = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return aggregates.all_passed(joined.withColumn("success", F.col("quality") == 1), by=["source"])


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def ordered_join(t):
    return aggregates.joined_names(t.nation, ["n_regionkey"], "n_name")


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE [200, 204, 301, 401, 403, 404, 500][p_size % 7 + 1] END AS code FROM part)
SELECT p_partkey, coalesce(code BETWEEN 200 AND 399 OR code IN (401, 403), false) AS up, coalesce(code = 200, false) AS ok,
 CASE WHEN code IS NULL THEN 'DISCONNECTED' WHEN code BETWEEN 200 AND 299 OR code = 401 THEN 'CONNECTED' ELSE 'ERROR' END AS status FROM c""")
def status_class(t):
    codes = F.array(*[F.lit(x) for x in (200, 204, 301, 401, 403, 404, 500)])
    code = F.when(F.col("p_size") != 50, F.get(codes, F.col("p_size") % 7))
    c = t.part.select("p_partkey", code.alias("code"))
    return c.select("p_partkey", rules.http_up(F.col("code")).alias("up"), rules.http_ok(F.col("code")).alias("ok"), rules.http_status(F.col("code")).alias("status"))


def _writes(t: Tables) -> DataFrame:
    """Events as writes: a store a user, a key a type; errors delete."""
    return t.events.select(F.concat(F.lit("store"), F.col("user_id").cast("string")).alias("store"), F.col("event_type").alias("key"), F.lit("bigint").alias("type"),
                           F.when(F.col("event_type") != "error", F.col("value").cast("bigint").cast("string")).alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))


@query("""WITH r AS (SELECT 'store' || user_id AS store, event_type AS key, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT store, key, value FROM r WHERE k = 1 AND key <> 'error'""")
def store_current(t):
    return keyvalue.current(_writes(t)).select("store", "key", "value")


@query("""WITH r AS (SELECT event_type, CAST(trunc(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id = 1)
SELECT coalesce(max(v) FILTER (event_type = 'click' AND k = 1), 24) AS click, coalesce(max(v) FILTER (event_type = 'no such key' AND k = 1), 51515) AS port FROM r""")
def store_typed_read(t):
    return keyvalue.read_typed(_writes(t), "store1", {"click": ("bigint", 24), "no such key": ("bigint", 51515)}).select("click", F.col("no such key").alias("port"))


#: The value of each key of each store that its last write left.
LAST = """WITH r AS (SELECT 'store' || user_id AS store, event_type AS key, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)"""


@query(f"""{LAST} SELECT CAST(1700000000000 AS BIGINT) AS timestamp, '1.0' AS app_version, store, key, 'bigint' AS type, value FROM r WHERE k = 1 AND key <> 'error'""")
def settings_round_trip(t):
    return settings.parse(settings.documents(keyvalue.current(_writes(t)), 1_700_000_000_000, "1.0"))


@query(f"""{LAST} SELECT store, key, 'bigint' AS type, value, CAST(7 AS BIGINT) AS ts FROM r WHERE k = 1 AND key <> 'error' AND key <> 'purchase'""")
def settings_restored(t):
    """Exported to files with a key masked, read again and restored: a masked value is not written back."""
    rows = keyvalue.redacted(keyvalue.current(_writes(t)), "purchase")
    folder = settings.write_documents(rows, work_folder(t.spark), 1_700_000_000_000, "1.0")
    return keyvalue.current(settings.restore(settings.read_documents(t.spark, folder), 7)).select("store", "key", "type", "value", "ts")


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'x' END AS first_id, event_id % 4 IN (1, 2) AS parsed FROM events""")
def snapshot_lists(t):
    """Output that holds more than the list is no list."""
    i = F.col("event_id")
    text_ = F.when(i % 4 == 1, F.concat(F.lit('[{"id":"'), i.cast("string"), F.lit('"}]'))).when(i % 4 == 2, '[{"id":"x"}]').when(i % 4 == 3, 'warning\n[{"id":"x"}]')
    rows = other.snapshots(t.events.select("event_id", text_.alias("output")))
    return rows.select("event_id", F.try_variant_get("snapshots", "$[0].id", "string").alias("first_id"), F.col("snapshots").isNotNull().alias("parsed"))


@query("SELECT p_partkey, p_size % 3 = 1 AND p_size * 7 >= 56 AS valid FROM part")
def executable_headers(t):
    head = F.concat(F.lit("7F454C460201"), F.repeat(F.lit("00"), 10), F.when(F.col("p_size") % 3 == 1, "0300B700").otherwise("0200B700"), F.repeat(F.lit("00"), 44))
    return t.part.select("p_partkey", rules.elf_ok(F.unhex(head), F.col("p_size") * 7).alias("valid"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 17 ORDER BY p_partkey LIMIT 1")
def first_by_id(t):
    return relational.first_by_id(t.part, "p_partkey", 17, ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT min(p_name) AS _data FROM part WHERE p_partkey = 5 HAVING count(*) > 0")
def lookup(t):
    return relational.lookup(t.part.select("p_partkey", F.col("p_name").alias("_data")), "p_partkey", 5)


@query("SELECT doc_id FROM labels WHERE NOT coalesce(quality = 1, false)")
def missing_grants(t):
    return relational.missing(t.labels.select("doc_id", (F.col("quality") == 1).alias("granted"))).select("doc_id")


@query("SELECT page_id, url AS name FROM pages WHERE starts_with(url, 'https://') AND ends_with(url, '.html')")
def named_files(t):
    return relational.named_files(t.pages.select("page_id", F.col("url").alias("name"), F.lit(False).alias("is_dir")), "https://", ".html").select("page_id", "name")


@query("SELECT event_id, [x FOR x IN [CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 3 = 0 THEN 'third' END] IF x IS NOT NULL] AS present FROM events")
def drop_nulls(t):
    parts = F.array(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.when(F.col("event_id") % 3 == 0, "third"))
    return t.events.select("event_id", F.array_compact(parts).alias("present"))


@query("""SELECT page_id, ('/x' || regexp_extract(url, '://[^/]*(/[^?#]*)', 1) = '/x/en' OR starts_with('/x' || regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/x/en/')) OR (page_id % 2 = 0 AND page_id % 3 = 0) AS ok FROM pages""")
def path_access(t):
    path = F.concat(F.lit("/x"), F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1))
    return t.pages.select("page_id", rules.can_access(path, F.array(F.lit("/x/en")), F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0).alias("ok"))


@query("SELECT coalesce(bool_or(o_orderstatus IN ('O')), false) AS active FROM orders")
def any_active(t):
    return aggregates.any_active(t.orders.select(F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("SUCCEEDED").alias("state")))


@query("""WITH n AS (SELECT event_id, ['Directory', 'dir', 'FILE', 'snapshot', 'Snapshot_Source', 'else'][event_id % 6 + 1] AS a, ['D', 'info', 'W', 'error', 'trace', 'i'][event_id % 6 + 1] AS b FROM events)
SELECT event_id, CASE lower(a) WHEN 'file' THEN 'FILE' WHEN 'snapshot' THEN 'SNAPSHOT_SOURCE' WHEN 'snapshot_source' THEN 'SNAPSHOT_SOURCE' ELSE 'DIRECTORY' END AS picker,
 CASE lower(b) WHEN 'info' THEN 'info' WHEN 'i' THEN 'info' WHEN 'w' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'debug' END AS level FROM n""")
def aliases(t):
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % 6).cast("int"))
    return t.events.select("event_id", rules.picker_type(pick("Directory", "dir", "FILE", "snapshot", "Snapshot_Source", "else")).alias("picker"), rules.log_level(pick("D", "info", "W", "error", "trace", "i")).alias("level"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN 300 WHEN p_size < 20 THEN 500 ELSE 1000 END AS INTEGER) AS delay_ms FROM part")
def retry_delays(t):
    return t.part.select("p_partkey", rules.retry_delay_ms(F.col("p_size")).alias("delay_ms"))


@query("""WITH e AS (SELECT event_id, ['java.io.IOException', 'java.lang.OutOfMemoryError', 'x.SecurityException', 'x.Other'][event_id % 4 + 1] AS c, CASE WHEN event_id % 3 = 0 THEN 'No Permission for it' ELSE 'bad password' END AS m FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'clear_cache' WHEN event_id % 4 = 1 THEN 'free_memory' WHEN event_id % 3 = 0 THEN 'ask_permission' ELSE 'none' END AS action,
 CASE WHEN event_id % 3 = 0 THEN 'Server Error' ELSE 'Incorrect Password' END AS title, CASE WHEN event_id % 3 = 0 THEN 'Change Repository' ELSE 'Retry' END AS button,
 CASE WHEN event_id % 5 = 0 THEN 'wrong_password' ELSE 'other' END AS connect FROM e""")
def failures(t):
    i = F.col("event_id")
    name = F.get(F.array(*[F.lit(x) for x in ("java.io.IOException", "java.lang.OutOfMemoryError", "x.SecurityException", "x.Other")]), (i % 4).cast("int"))
    message = F.when(i % 3 == 0, "No Permission for it").otherwise("bad password")
    told = rules.start_failure(message)
    output = F.when(i % 5 == 0, "ERROR: Invalid repository password!").otherwise("ERROR")
    return t.events.select("event_id", rules.recovery_action(name, message).alias("action"), told["title"].alias("title"), told["button"].alias("button"), rules.connect_failure(output).alias("connect"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN trim(event_type) END, CASE WHEN event_id % 3 = 0 THEN 'second' END, 'unset') AS value FROM events")
def fallback(t):
    first = F.when(F.col("event_id") % 2 == 0, text.trimmed(F.concat(F.lit(" "), "event_type", F.lit("\n"))))
    return t.events.select("event_id", F.coalesce(first, F.when(F.col("event_id") % 3 == 0, "second"), F.lit("unset")).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' WHEN event_id % 3 = 0 THEN 'b' END AS choice FROM events")
def first_present(t):
    i = F.col("event_id")
    present = F.array_compact(F.array(F.when(i % 3 == 0, "b"), F.when(i % 2 == 0, "a")))
    return relational.first_present(t.events.select("event_id", F.array(F.lit("a"), F.lit("b")).alias("wanted"), present.alias("there")), "event_id", "wanted", "there")


@query("""SELECT doc_id, doc_id % 10 = 0 OR coalesce(list_bool_or([contains(lower(text), w) OR contains(lower(left(source, 100)), w)
 FOR w IN ['path', 'directory', 'folder', 'location', 'repository', 'snapshot', 'config', 'file', 'source', 'destination', 'target']]), false) AS is_path FROM documents""")
def path_inputs(t):
    """A document's text stands for the field's own, its source for the text around it, which is cut."""
    value = F.when(F.col("doc_id") % 10 == 0, "/data/x").otherwise("plain")
    return t.documents.select("doc_id", rules.path_input(value, F.col("text"), F.lit(" "), text.head(F.col("source"), 100)).alias("is_path"))


@query("""SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'required' WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 9 < 8 THEN 'too_short' WHEN p_size % 2 = 0 THEN 'mismatch' END AS problem FROM part""")
def password_problems(t):
    word = F.repeat(F.lit("x"), F.col("p_size") % 9)
    return t.part.select("p_partkey", rules.password_problem(word, F.when(F.col("p_size") % 2 == 0, "other").otherwise(word), F.col("p_size") % 4 == 0).alias("problem"))


@query("""SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) * 1000 // 1048576 AS used_mb, 512 - CAST(trunc(o_totalprice) AS BIGINT) * 1000 // 1048576 AS available_mb,
 CAST(trunc(o_totalprice) AS BIGINT) // 1024 AS kb, CAST(o_custkey * 4096 * 100 // 1048576 AS BIGINT) AS used_space FROM orders""")
def memory_and_space(t):
    price = F.col("o_totalprice").cast("bigint") * 1000
    m = numbers.memory(price, F.lit(0), F.lit(512 * numbers.MIB).cast("bigint"))
    space = numbers.block_space(F.lit(4096).cast("bigint"), F.lit(0), F.col("o_custkey") * 100)
    return t.orders.select("o_orderkey", m["used_mb"].alias("used_mb"), m["available_mb"].alias("available_mb"), numbers.kib(F.col("o_totalprice").cast("bigint")).alias("kb"), space["used_mb"].alias("used_space"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Full filesystem access granted.' WHEN p_size >= 30 THEN 'Limited access. Grant all-files access to reach other folders.' ELSE 'Storage permissions required.' END AS told FROM part""")
def access_texts(t):
    return t.part.select("p_partkey", rules.access_text(F.col("p_size") % 3 == 0, F.col("p_size")).alias("told"))


@query("""SELECT c_custkey, substr(c_name, 10) AS tail, array_reverse(string_split(c_name, '#'))[1] AS after, left(c_name, 5) AS head, contains(lower(c_mktsegment), 'build') AS building,
 left(md5(CAST(c_custkey AS VARCHAR) || chr(31) || c_name), 8) AS id, CAST(trunc(CAST(c_acctbal AS FLOAT) * CAST(0.75 AS FLOAT)) AS INTEGER) AS scaled, to_base64(encode(c_name)) AS encoded FROM customer""")
def scalar_functions(t):
    name = F.col("c_name")
    return t.customer.select("c_custkey", text.without_prefix(name, "Customer#").alias("tail"), text.after_last(name, "#").alias("after"), text.head(name, 5).alias("head"), text.contains_any(F.col("c_mktsegment"), ["BUILD"]).alias("building"),
                             text.short_id(F.col("c_custkey"), name).alias("id"), numbers.scaled(F.col("c_acctbal"), 0.75).alias("scaled"), F.base64(F.encode(name, "UTF-8")).alias("encoded"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, '%Y%m%d_%H%M%S') AS file_stamp, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS report_stamp FROM events")
def time_formats(t):
    return t.events.select("event_id", *[times.stamped(F.col("ts"), p).alias(n) for n, p in (("shown", times.SHOWN), ("file_stamp", times.FILE_STAMP), ("report_stamp", times.REPORT_STAMP))])


@query("SELECT p_partkey, coalesce(try_cast(CASE WHEN p_size % 3 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS INTEGER), 51515) AS port FROM part")
def parse_or_default(t):
    return t.part.select("p_partkey", text.int_or(F.when(F.col("p_size") % 3 == 0, "x").otherwise(F.col("p_size").cast("string")), 51515).alias("port"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def all_rows(t):
    return relational.all_rows(t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'denied' ELSE event_type END AS told,
 '{"storage":{"type":"filesystem","config":{"path":"/r/' || event_id || '"}},"password":"p"}' AS body FROM events""")
def service_messages(t):
    reply = F.when(F.col("event_id") % 2 == 0, '{"error":"denied"}').otherwise(F.col("event_type"))
    return t.events.select("event_id", rules.error_text(reply).alias("told"), rules.connect_body(F.concat(F.lit("/r/"), F.col("event_id").cast("string")), F.lit("p")).alias("body"))


@query("""SELECT CAST(1 AS INTEGER) AS section_no, 'Operation Timings' AS section, event_type AS line_no, event_type || ': avg=' || CAST(trunc(avg(CAST(trunc(value) AS BIGINT))) AS INTEGER) || 'ms, min=' || min(CAST(trunc(value) AS BIGINT)) || 'ms, max=' || max(CAST(trunc(value) AS BIGINT)) || 'ms, count=' || count(*) AS line FROM events GROUP BY event_type
UNION ALL SELECT 2, 'Memory Usage', '0', 'Used Memory: 1 MB' UNION ALL SELECT 2, 'Memory Usage', '1', 'Max Heap Size: 3 MB' UNION ALL SELECT 2, 'Memory Usage', '2', 'Available Heap: 2 MB' UNION ALL SELECT 3, 'Storage Usage', '0', 'Internal App Storage: 4 MB used of 5 MB'""")
def performance_report(t):
    spark = t.spark
    timings = t.events.select(F.col("event_type").alias("tag"), F.col("value").cast("bigint").alias("ms"))
    return reports.performance_report(timings, spark.createDataFrame([(1, 3, 2)], "used_mb bigint, max_mb bigint, available_mb bigint"), spark.createDataFrame([(4, 5)], "used_mb bigint, total_mb bigint"))


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS p FROM labels)
SELECT CAST(1 AS INTEGER) AS section_no, 'Summary' AS section, '0' AS line_no, '- Total Tests: ' || n AS line FROM s UNION ALL SELECT 1, 'Summary', '1', '- Passed: ' || p FROM s UNION ALL SELECT 1, 'Summary', '2', '- Failed: ' || (n - p) FROM s
UNION ALL SELECT 1, 'Summary', '3', '- Success Rate: ' || (p * 100 // n) || '%' FROM s
UNION ALL SELECT 2, 'Detailed Results', CAST(doc_id AS VARCHAR), doc_id || ': ' || CASE WHEN quality = 1 THEN 'PASSED' ELSE 'FAILED' END || ' | checked | toxic ' || toxic FROM labels""")
def workflow_report(t):
    return reports.workflow_report(t.labels.select(F.col("doc_id").cast("string").alias("workflow"), (F.col("quality") == 1).alias("success"), F.lit("checked").alias("message"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("details")))


@query("""SELECT CAST(1 AS INTEGER) AS section_no, 'Test Results' AS section, CAST(l.doc_id AS VARCHAR) AS line_no, l.doc_id || ': ' || CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END || coalesce('  Note: ' || lang, '') AS line
FROM labels l LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang = 'de') d USING (doc_id)""")
def self_test_report(t):
    results = t.labels.select(F.col("doc_id").cast("string").alias("test"), (F.col("quality") == 1).alias("passed"))
    return reports.self_test_report(results, t.documents.where("lang = 'de'").select(F.col("doc_id").cast("string").alias("test"), F.col("lang").alias("note")))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, 'Error ID: ' || event_id || chr(10) || 'Time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Severity: ERROR' || chr(10) || 'Message: ' || props || chr(10) || chr(10) || 'Exception: E' || chr(10) || 'Cause: Unknown' || chr(10) || chr(10) || 'Stack trace:' || chr(10) || '  at a' || chr(10) || '  at b' AS details FROM events WHERE event_type = 'error'""")
def error_details(t):
    errors = t.events.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.lit("ERROR").alias("severity"), F.col("props").alias("message"), F.lit("E").alias("exception_class"), F.lit(None).cast("string").alias("cause"), F.array(F.lit("a"), F.lit("b")).alias("stack"))
    return reports.error_details(errors)


def _tree(t: Tables) -> str:
    """A folder with a sub-folder for each event type, which holds the ids as text files, and an empty hidden file."""
    folder = work_folder(t.spark)
    t.events.select(F.concat(F.lit("type-"), "event_type").alias("kind"), F.col("event_id").cast("string").alias("value")).write.partitionBy("kind").text(folder)
    return folder


@query("SELECT 'kind=type-' || event_type AS folder, CAST(sum(length(CAST(event_id AS VARCHAR)) + 1) AS BIGINT) AS bytes, true AS found FROM events GROUP BY 1")
def listed_tree(t):
    """Sizes by folder of a complete listing; files whose names begin with a dot count too, but not these checksums."""
    files = listing.list_files(t.spark, _tree(t)).withColumn("folder", F.element_at(F.split("path", "/"), -2)).where("folder like 'kind=%'")
    sizes = aggregates.tree_size(files.where(~F.col("name").endswith(".crc")).withColumn("root", F.col("folder")))
    return sizes.select(F.col("root").alias("folder"), "bytes", (F.col("files") > 0).alias("found"))


@query("SELECT DISTINCT 'kind=type-' || event_type AS name, true AS is_dir FROM events UNION ALL SELECT '_SUCCESS', false")
def listed_level(t):
    """One level of a folder, the names Spark itself leaves out with it."""
    return listing.list_files(t.spark, _tree(t), recursive=False).where(~F.col("name").endswith(".crc")).select("name", "is_dir")


@query("SELECT DISTINCT 'kind=type-' || event_type AS name FROM events WHERE event_type NOT LIKE '%err%' AND event_type NOT LIKE '%view%'")
def deletions_proposed(t):
    entries = listing.list_files(t.spark, _tree(t), recursive=False).where("is_dir")
    return listing.deletion_candidates(entries, ["err", "view"]).select("name")


@query("SELECT DISTINCT '/target/kind=type-' || event_type AS target_path, 'planned' AS status, true AS is_dir FROM events")
def copy_plan(t):
    found = listing.list_files(t.spark, _tree(t)).where("is_dir")
    return listing.copy_manifest(found, "/target/").select("target_path", "status", "is_dir")


@query("SELECT event_type || ' ' || event_id AS value FROM events WHERE event_type IN ('error', 'purchase')")
def log_stream(t):
    """Lines that arrive in a folder, filtered and collected by a stream until nothing is left."""
    source, out, mark = (work_folder(t.spark) for _ in range(3))
    t.events.select(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value")).write.text(source)
    tail.collect_lines(tail.tail(t.spark, source, ["ERROR", "Purchase"]), out, mark).awaitTermination()
    return t.spark.read.text(out)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_type, event_id FROM r WHERE k = 1""")
def latest_stream(t):
    """The newest event of each user, kept by a stream."""
    source, out, mark = (work_folder(t.spark) for _ in range(3))
    events = t.events.select("user_id", "event_type", "ts", "event_id")
    events.write.parquet(source)
    changes = t.spark.readStream.schema(events.schema).parquet(source)
    tail.write_latest(tail.latest(changes, "user_id", "ts", "event_id"), out, mark).awaitTermination()
    return t.spark.read.parquet(out).select("user_id", "event_type", "event_id")


@query("""WITH r AS (SELECT 'job' || (user_id % 40) AS job, event_id, event_type, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id % 40) AS n FROM events)
SELECT job, event_id % 24 AS interval_hours, event_type <> 'error' AS active, n - 1 AS replaced FROM r WHERE k = 1""")
def schedule_replaced(t):
    """One schedule a job, the last one asked for."""
    asked = t.events.select(F.concat(F.lit("job"), (F.col("user_id") % 40).cast("string")).alias("job"), (F.col("event_id") % 24).alias("interval_hours"), (F.col("event_type") != "error").alias("enabled"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    return keyvalue.unique_schedules(asked).select("job", "interval_hours", F.col("enabled").alias("active"), "replaced")


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [ERROR] [' || event_id || '] ' || props AS line FROM events WHERE event_type = 'error'
UNION ALL SELECT unnest(['Exception: E', '  at a', '  at b', '  at c', '  at d', '  at e', '']) FROM events WHERE event_type = 'error'""")
def error_log_written(t):
    """The lines of the error log, as its files hold them: of seven frames the first five."""
    errors = t.events.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.lit("ERROR").alias("severity"), F.col("props").alias("message"), F.lit("E").alias("exception_class"), F.array(*[F.lit(x) for x in "abcdefg"]).alias("stack"))
    folder = work_folder(t.spark)
    other.write_error_log(errors, folder)
    return t.spark.read.text(folder).select(F.col("value").alias("line"))


@query("""SELECT '{"name":"' || n_name || '","path":"/n/' || n_nationkey || '","description":"region ' || n_regionkey || '","alwaysAccessible":' || CASE WHEN n_nationkey % 3 = 0 THEN 'true' ELSE 'false' END || '}' AS value
FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 0""")
def folder_catalogue(t):
    rows = t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("/n/"), F.col("n_nationkey").cast("string")).alias("path"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description"), (F.col("n_nationkey") % 3 == 0).alias("always_accessible"), (F.col("n_nationkey") % 2 == 0).alias("available"))
    return other.catalogue_lines(other.accessible(rows))


@query("""SELECT '[' || string_agg('{"name":"' || r_name || '","path":"/r","description":"d","alwaysAccessible":true}', ',' ORDER BY r_name) || ']' AS value FROM region""")
def folder_catalogue_document(t):
    return other.catalogue_json(other.accessible(t.region.select(F.col("r_name").alias("name"), F.lit("/r").alias("path"), F.lit("d").alias("description"), F.lit(True).alias("always_accessible"), F.lit(True).alias("available"))))


@query("""SELECT CAST(1 AS INTEGER) AS section_no, 'Test Results' AS section, n_name AS line_no, n_name || ': ' || CASE WHEN n_nationkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS line FROM nation
UNION ALL SELECT CAST(101 AS INTEGER), 'Test Results', r_name, r_name || ': PASS  Note: ' || r_regionkey FROM region""")
def combined_report(t):
    first = reports.self_test_report(t.nation.select(F.col("n_name").alias("test"), (F.col("n_nationkey") % 2 == 0).alias("passed")), t.region.select(F.col("r_name").alias("test"), F.lit("x").alias("note")).limit(0))
    second = reports.self_test_report(t.region.select(F.col("r_name").alias("test"), F.lit(True).alias("passed")), t.region.select(F.col("r_name").alias("test"), F.col("r_regionkey").cast("string").alias("note")))
    return reports.combined(first, second)


@query("""SELECT event_id, '[' || CASE WHEN event_id % 2 = 0 THEN 'kind=' || upper(event_type) || ',' ELSE '' END || 'id=' || event_id || ',password=***]' AS shown FROM events""")
def map_values(t):
    pairs = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("kind"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")), F.lit("password"), F.col("event_type"))
    shown = maps.sorted_text(maps.masked(maps.present(pairs)), order=["kind", "id", "password"])
    return t.events.select("event_id", shown.alias("shown"))


@query("""SELECT tag, CAST(trunc(avg(ms)) AS INTEGER) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, count(*) AS n
FROM (SELECT event_type AS tag, CAST(trunc(value) AS BIGINT) AS ms FROM events UNION ALL SELECT 'started', unnest([3, 5, 9])) GROUP BY 1""")
def measured_timings(t):
    timings = t.events.select(F.col("event_type").alias("tag"), F.col("value").cast("bigint").alias("ms"))
    return aggregates.timing_summary(aggregates.measured(timings, "started", [3, 5, 9]))


@query("""WITH s AS (SELECT 'workflow ' || user_id AS workflow, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT workflow, event_id FROM s WHERE event_type = 'error' AND k = 1)
SELECT DISTINCT s.workflow, f.event_id IS NULL AS success, coalesce('failed at ' || f.event_id, 'all steps passed') AS message, 'Steps: ' || n AS details FROM s LEFT JOIN f USING (workflow)""")
def workflows_validated(t):
    """A workflow passes if all its steps do; its first failing step tells why not."""
    steps = t.events.select(F.concat(F.lit("workflow "), F.col("user_id").cast("string")).alias("workflow"), F.col("event_id").alias("step"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("failed at "), F.col("event_id").cast("string")).alias("message"))
    return aggregates.workflow_results(steps)
