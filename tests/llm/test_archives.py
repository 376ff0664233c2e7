"""WARC: round trips, foreign members, cut streams."""

import gzip
import hashlib

import pytest

from opsledger.llm import warc


def pages(spark):
    big, other = "é" * 600, "x" * 999
    return spark.createDataFrame([(1, "http://a/ b\n", big), (2, None, big), (3, "u", other), (4, "u", other), (5, "u", None), (None, "u", big), (6, "u", "y" * 1000), (6, "u", "y" * 1000), (7, "u", ""), (8, "v", "z" * 3_000_000)], "page_id bigint, url string, html string").repartition(3)


def test_round_trip(spark):
    files = warc.archive(pages(spark))
    got = {(r.page_id, r.payload_bytes): (r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(files).collect()}
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got[(2, 1200)] == (sha("é" * 600), "response", None)
    assert got[(1, 1200)] == (sha("é" * 600), "revisit", 2) and got[(None, 1200)][1:] == ("revisit", 2)
    assert got[(3, 999)][1:] == got[(4, 999)][1:] == ("response", None)
    assert got[(5, 0)] == got[(7, 0)] == (sha(""), "response", None)
    assert got[(6, 1000)][1:] == ("response", None) and got[(8, 3_000_000)][1] == "response"
    assert warc.read_archives(files).count() == 10
    for r in files.collect():
        for offset, length, kind, _, url in warc.indexed(r.index_path):
            found = warc.read_at(r.path, offset, length)
            assert found["record_type"] == kind and found["url"] == url
        with gzip.open(r.path.removeprefix("file:")) as f:  # any reader takes the members as one stream
            assert f.read().count(b"WARC/1.1\r\n") == r.records


def test_empty_table(spark):
    assert warc.read_archives(warc.archive(pages(spark).limit(0))).count() == 0


@pytest.mark.parametrize("members", [1, 3])
def test_normalise_any_members(spark, tmp_path, members):
    one = [warc.record(i, "u", b"p" * 50 * i, "response", None, "00" * 20) for i in range(9)]
    step = len(one) // members
    (tmp_path / "in.warc.gz").write_bytes(b"".join(gzip.compress(b"".join(one[i : i + step])) for i in range(0, 9, step)))
    files = spark.createDataFrame([(str(tmp_path / "in.warc.gz"),)], "path string")
    out = warc.normalise(files, str(tmp_path / "out")).first()
    assert out.records == 9
    entries = list(warc.indexed(out.index_path))
    data = open(out.path, "rb").read()
    assert [gzip.decompress(data[a : a + n]) for a, n, *_ in entries] == one


def refused(spark, tmp_path, data, match):
    (tmp_path / "in.warc.gz").write_bytes(data)
    with pytest.raises(Exception, match=match):
        warc.normalise(spark.createDataFrame([(str(tmp_path / "in.warc.gz"),)], "path string"), str(tmp_path / "out")).collect()


def test_cut_stream_is_told(spark, tmp_path):
    whole = gzip.compress(warc.record(1, "u", bytes(range(256)) * 500, "response", None, "00" * 20))
    refused(spark, tmp_path, whole[: len(whole) // 2], "ends within a")
    refused(spark, tmp_path, whole[:-8], "ends within a gzip member")  # all records are there, the trailer is not
    five = [warc.record(i, "u", b"p" * 50, "response", None, "00" * 20) for i in range(5)]
    refused(spark, tmp_path, gzip.compress(b"".join(five[:3]) + five[3][:30]), "within a record's head")
    refused(spark, tmp_path, gzip.compress(b"".join(five[:3]) + five[3][:-2]), "ends within a record")
    refused(spark, tmp_path, gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"), "no content length")
    refused(spark, tmp_path, gzip.compress(b"x" * (warc.MOST_HEAD + warc.CHUNK * 3)), "no record head")


def test_a_cut_index_is_told(spark, tmp_path):
    files = warc.archive(pages(spark).coalesce(1), str(tmp_path / "out"))
    index = files.first().index_path
    where = index.removeprefix("file:")
    whole = open(where, "rb").read()
    for data, match in ((whole[:-5], "ends within an entry"), (whole[: whole.rindex(b"\n", 0, -1) + 1], "has 9 entries, not 10")):
        with open(where, "wb") as f:
            f.write(data)
        with pytest.raises(Exception, match=match):
            warc.read_archives(files).collect()


def test_a_highly_compressed_stream_stays_small():
    import io
    import tracemalloc

    body = gzip.compress(warc.record(1, "u", b"\0" * (64 << 20), "response", None, "00" * 20), 9)
    assert len(body) < 1 << 20
    tracemalloc.start()
    sizes = [sum(map(len, pieces)) for _, pieces in warc.records(io.BytesIO(body))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes[0] > 64 << 20 and peak < 8 << 20


def test_many_small_members():
    import io

    one = [warc.record(i, "u", b"p" * (i % 90), "response", None, "00" * 20) for i in range(5000)]
    data = b"".join(map(gzip.compress, one))
    assert [b"".join(pieces) for _, pieces in warc.records(io.BytesIO(data))] == one


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    odd = pages(spark).withColumns({c: F.lit("1") for c in ("digest", "same", "largest", "n", "record_type", "refers_to", "path")})
    assert warc.read_archives(warc.archive(odd)).count() == 10
