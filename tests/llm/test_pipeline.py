"""The pipeline's stages over a small corpus with planted cases."""

import random
import zlib
from collections import Counter

import corpus_pipeline
from opsledger.llm import kneser_ney
from opsledger.llm.mixing import mix
from tests.llm.conftest import EXTRA, words
from tests.llm.test_join import brute
from tests.llm.test_leaks import _holds


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    item = words(rng, 40)
    rows = [(i, words(rng, 80), "en", "ab"[i % 2], 0) for i in range(300)]
    near = rows[4][1].split(" ")
    near[40] = "changed"
    rows += [(1000, " ".join(near), "en", "a", 0), (1001, rows[5][1].upper(), "en", "b", 0), (1002, f"{words(rng, 40)} {item[:60]}x{item[61:]} {words(rng, 40)}", "en", "a", 0), (1003, None, None, None, None), (1004, "", "en", "a", 0), (1005, " ".join(f"X{i}#!!" for i in range(80)), "en", "b", 0), (7, *rows[7][1:])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "token_files":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert not {1003, 1004, 1005} & set(kept["quality"]) and len([k for k in kept["quality"] if k < 300]) > 285
    assert not {1000} & set(kept["near_duplicates"]) and (1001 not in kept["near_duplicates"]) and 1002 in kept["quality"]
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {1002}
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and len(kept["mixing"]) > len(kept["decontamination"])
    assert sorted(kept["token_files"]) == sorted(kept["mixing"])


def chain(spark, folder, rows, labels, item):
    """Write the tables, and run the stages: the rows of each as (doc_id, text, source), and of the last as they are."""
    from pyspark.sql import functions as F

    extra = [x.split()[0] for x in EXTRA.split(", ")] + ["pipeline_row", "key", "k", "r", "c", "gone", "may", "h1", "h2", "path", "at", "number"]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    frame.withColumns({n: F.lit("1") for n in dict.fromkeys(extra)}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        got = stage(spark, docs, str(folder))
        if name != "token_files":
            assert got.columns == columns
        got.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out[name] = Counter(map(tuple, docs.collect() if name == "token_files" else docs.select("doc_id", "text", "source").collect()))
    return out


def test_the_chain_by_brute_force(spark, tmp_path):
    """Null ids, repeated ids and rows, clashing columns: every row follows its own verdict in all stages."""
    from tokenizers import Tokenizer

    rng = random.Random(10)
    item = words(rng, 40)
    base = [(i, words(rng, rng.choice([30, 80, 120])), ["en", "de"][i % 2], rng.choice(["a", "b", "c", None]), 0) for i in range(260)]
    junk = lambda i: " ".join(f"X{rng.randrange(10**6)}#!!{i}" for _ in range(60))
    near = base[8][1].split(" ")
    near[40 % len(near)] = "changed"
    leak = f"{words(rng, 40)} {item} {words(rng, 40)}"
    rows = base + [(None, words(rng, 80), "en", "a", 0), (None, junk(1), "en", "a", 0), (None, leak, "en", "b", 0), (None, base[9][1], "en", "a", 0), (None, None, None, None, None),
                   (5, junk(2), "en", "a", 0), (5, words(rng, 80), "en", "b", 0), (6, leak.upper(), "de", "a", 0), (7, " ".join(near), "en", "a", 0), (300, " ".join(near), "en", "a", 0),
                   (301, words(rng, 90), "en", "c", 0), (301, rows_text := words(rng, 90), "en", "c", 0), (301, rows_text, "en", "c", 0), (302, "", "en", "a", 0)]
    labels = [(i, 1, 0) for i in range(0, 260, 2)] + [(None, 1, 0)]
    got = chain(spark, tmp_path, rows, labels, item)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    verdict = {(r.doc_id, r.row): r.accepted for r in kneser_ney.classify(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{tmp_path}/labels.parquet"), row_col="i").collect()}
    stays = [r for i, r in enumerate(rows) if verdict[(r[0], i)]]
    assert got["quality"] == Counter((k, t, s) for k, t, _, s, _ in stays) and len(rows) > len(stays) > 250
    assert not any(t and t.startswith("X") for _, t, _ in got["quality"]) and docs.count() == len(rows)
    group = {i: c for i, _, c in brute([(i, r[1]) for i, r in enumerate(stays)])}
    best = {}
    for i, r in enumerate(stays):
        best.setdefault(group[i], []).append((r[0] is None, r[0] or 0, r[1], r[3]))
    kept = Counter((None if null else k, t, s) for null, k, t, s in (min(x, key=lambda y: y[:2]) for x in best.values()))
    ids = lambda counter: Counter(k for k, _, _ in counter.elements())
    assert ids(got["near_duplicates"]) == ids(kept) and sum(kept.values()) < len(stays)
    from opsledger.llm.decontaminate import plain

    clean = Counter({x: n for x, n in got["near_duplicates"].items() if not _holds(plain(item), plain(x[1]))})
    assert got["decontamination"] == clean and sum(clean.values()) < sum(kept.values())
    mixed = Counter()
    for r in mix(spark.read.parquet(f"{tmp_path}/2"), row_col=None).collect():
        mixed[r.doc_id] += r.copies
    assert ids(got["mixing"]) == +mixed and set(got["mixing"]) <= set(clean)
    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter()
    for (k, t, _), n in got["mixing"].items():
        own = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want[(k, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)))] += n
    assert Counter((k, n, crc) for k, _, n, crc in got["token_files"].elements()) == want
    starts = sorted((start, n) for _, start, n, _ in got["token_files"])
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_tables(spark, tmp_path):
    got = chain(spark, tmp_path, [], [], "an item of the benchmark that nothing holds")
    assert all(not x for x in got.values())


def test_run_leaves_only_the_token_files(spark, tmp_path):
    rng = random.Random(3)
    spark.createDataFrame([(i, words(rng, 30), "en", "a", 0) for i in range(30)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind is in any text here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = []
    own, corpus_pipeline.scratch = corpus_pipeline.scratch, lambda *x: made.append(own(*x)) or made[-1]
    try:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
    finally:
        corpus_pipeline.scratch = own
    from pathlib import Path

    there = [x for x in made if Path(x.removeprefix("file:")).exists()]
    assert len(made) == 5 and len(there) == 1 and "pipeline-tokens" in there[0]
