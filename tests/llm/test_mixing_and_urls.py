"""Mixing: targets, closeness, reruns; URL filters over redirects."""

import math
import re

from opsledger.llm.mixing import mix
from opsledger.llm.url_filter import filter_urls
from tests.llm.conftest import frame, words
import random


def targets(sizes, weights=(5, 2, 1), share=1.5):
    """Source -> target, by raising a common level until the budget is spent."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        total = sum(min(2 * sizes[s], level * weight[s]) for s in order)
        low, high = (level, high) if total < share * sum(sizes.values()) else (low, level)
    return {s: min(2 * sizes[s], high * weight[s]) for s in order}


def test_mix(spark, none):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([1, 5, 30, 200])), "en", rng.choice(["a", "a", "a", "b", "c", "d", None, "z"])) for i in range(900)]
    rows += [(901, None, "en", "a"), (902, "", "en", "a"), (903, " \n", "en", "void"), (904, "é x y", "en", "b"), (None, "w w", "en", None), (0, *rows[0][1:])]
    docs = frame(spark, rows)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-3 and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]), (s, taken[s], want[s])
    for source in sizes:  # the rates are those of an independent solution of the dual
        own = [r for r in got if r.source == source and r.size]
        if 0 < want[source] < 2 * sizes[source] * (1 - 1e-9):
            low, high = -60.0, 1.0
            for _ in range(200):
                tilt = (low + high) / 2
                low, high = (tilt, high) if sum(min(2, math.exp(tilt * r.size)) * r.size for r in own) < want[source] else (low, tilt)
            assert all(abs(r.rate - min(2, math.exp(tilt * r.size))) < 1e-5 for r in own)
        else:
            assert all(r.rate == 2 for r in own)
    assert all(r.copies in (math.floor(r.rate), math.ceil(r.rate)) for r in got)
    again = mix(frame(spark, rows[::-1])).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    assert [tuple(r) for r in sorted(again, key=key)] == [tuple(r) for r in sorted(got, key=key)]
    assert mix(none).count() == 0


def test_crowded_blocks_and_many_sources(spark, monkeypatch):
    from opsledger.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK", 20)
    rows = [(5, "a b c", "en", "hot")] * 400 + [(None, "a b", "en", "hot")] * 300 + [(i, words(random.Random(i), 1 + i % 9), "en", f"s{i % 150:03d}") for i in range(900)]
    docs = frame(spark, rows)
    got = mix(docs).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-3
        taken[r.source] += r.copies * r.size
    assert len(got) == len(rows) and abs(taken["hot"] - want["hot"]) <= 0.03 * want["hot"]
    assert all(abs(taken[s] - want[s]) <= 9 for s in sizes if s != "hot")


LINK = '<html><head><link href="{}" REL=canonical></head>'
JUMP = "<meta http-equiv='Refresh' content='0; url={}'>"
PAGES = [
    (1, "http://www.example.net/de/1", "plain"), (2, "https://elsewhere.test/a?x=1#f", LINK.format("http://www.example.net/de/1")),
    (3, "http://third.test/", JUMP.format("https://elsewhere.test/a?x=1")), (4, "http://third.test", "plain"), (5, "http://free.test/x", LINK.format("/y")),
    (6, "http://m.example.net/de/8x", LINK.format("http://fourth.test/")), (7, "http://fourth.test/", "plain"), (8, "http://fifth.test/q", LINK.format("http://example.net/de/1") + LINK.format("http://example.com/en/7")),
    (9, None, LINK.format("http://www.example.net/de/1")), (10, "no scheme", None), (11, "HTTP://EXAMPLE.ORG/es/1", None), (12, "http://badexample.com.evil/en/", ""), (13, "http://com/en/", ""), (14, "http://example.com/EN/", ""),
    (15, "http://x.test/d/e", LINK.format("../f?a=1&amp;b=2")), (16, "http://x.test/f?a=1&b=2", LINK.format("//org/es/")), (1, "http://www.example.net/de/1", "plain"), (None, "http://net/de/", None), (17, "http://[bad", LINK.format("http://[bad2")),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
    got = filter_urls(pages).collect()
    assert len(got) == len(PAGES)
    told = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert told[1] == ("www.example.net", "/de/1", "net/de/", "block")
    assert [told[i][3] for i in (2, 3, 4)] == ["block"] * 3 and told[2][2] is None  # aliases of a blocked page
    assert told[5][3] == "allow" and told[6][2:] == ("example.net/de/8", "allow") and told[7][3] == "allow"
    assert told[8][3] == "allow"  # an alias allowed by a rule goes before a blocked one
    assert told[9] == told[10] == ("", "", None, "allow")
    assert told[11] == ("example.org", "/es/1", "org/es/", "block") and told[12][3] == "allow" and told[13][2] == "com/en/" and told[14][3] == "allow"
    assert told[15][3] == told[16][3] == "block" and told[None][3] == "block" and told[17][3] == "allow"
    assert filter_urls(pages.limit(0)).count() == 0


def test_links_that_are_canonical_and_those_that_are_not(spark):
    from opsledger.llm.url_filter import alias_edges

    tags = ["<link rel=canonical href=http://a.test/1>", "<LINK href='http://a.test/1' rel='alternate Canonical'/>", '<link rel="canonical alternate" href="http://a.test/1">', "<link\nrel = canonical\nhref=http://a.test/1>",
            '<link data-rel="canonical" href="http://a.test/1">', '<link rel="non-canonical" href="http://a.test/1">', '<link rel="canonical" data-href="http://a.test/1">', "<link rel=canonicals href=http://a.test/1>", "<meta data-http-equiv=refresh content='0; url=http://a.test/1'>"]
    pages = spark.createDataFrame([(i, f"http://own.test/{i}", x) for i, x in enumerate(tags)], "page_id bigint, url string, html string")
    assert sorted((r.src, r.dst) for r in alias_edges(pages).collect()) == [(f"own.test/{i}", "a.test/1") for i in range(4)]


def test_urls_of_long_pages_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    filler = "<p>canonical text and more of it</p>" * 60_000
    rows = [(1, "http://x.test/1", filler + LINK.format("http://net/de/") + filler), (2, "http://net/de/", filler), (3, "http://y.test/" + "z" * 100_000, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("1") for c in ("id", "host", "path", "rule", "verdict", "node", "alias", "tag", "src", "dst", "component", "__host", "__tail")})
    assert {r.page_id: r.verdict for r in filter_urls(pages).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_mix_of_a_very_long_text(spark):
    rows = [(1, "w " * 500_000, "en", "a"), *((i, "a b c", "en", "ab"[i % 2]) for i in range(2, 300))]
    got = {r.doc_id: r for r in mix(frame(spark, rows)).collect()}
    assert got[1].size == 500_000 and got[1].source_size == 500_000 + 149 * 3
