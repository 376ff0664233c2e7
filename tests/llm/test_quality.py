"""The Kneser-Ney model against its formulas, and the classifier's cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from opsledger.llm import kneser_ney as kn
from tests.llm.conftest import frame


def shaped(word, known):
    """A word, or the class of its shape if it isn't known."""
    if word in known:
        return word
    capital, digit = sum("A" <= c <= "Z" for c in word), sum("0" <= c <= "9" for c in word)
    sign, n = sum(33 <= ord(c) < 127 and not c.isalnum() for c in word), len(word.encode())
    return (min(capital, 2), min(sign, 2), (n >= 4) + (n >= 10), min(digit, 1))


def reference(train, text, least=kn.LEAST_COUNT):
    """-log2 p of a text by the formulas, over plain dictionaries."""
    often = {w for w, n in Counter(w for t in train for w in t.split()).items() if n >= least}
    known, as_ids = len(often), lambda t: ["<", "<", *(shaped(w, often) for w in t.split()), ">"]
    tri, bi = Counter(), {}
    for t in train:
        w = as_ids(t)
        tri.update(zip(w, w[1:], w[2:]))
    for u, v, w in tri:
        bi.setdefault((v, w), set()).add(u)
    bi = {k: len(x) for k, x in bi.items()}
    uni = Counter(w for _, w in bi)
    lost = [kn.discounts(np.array([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])) for counts in (tri, bi, uni)]
    off = lambda order, c: lost[order][min(c, 3)]

    ids = kn.FIRST_WORD + known - 1  # all that can follow: known words, shapes, the end

    def p1(w):
        total = sum(uni.values())
        return max(uni[w] - off(2, uni[w]), 0) / total + sum(off(2, c) for c in uni.values()) / total / ids

    def p2(v, w):
        own = {x: c for (m, x), c in bi.items() if m == v}
        if not own:
            return p1(w)
        total = sum(own.values())
        return max(own.get(w, 0) - off(1, own.get(w, 0)), 0) / total + sum(off(1, c) for c in own.values()) / total * p1(w)

    def p3(u, v, w):
        own = {x: c for (a, m, x), c in tri.items() if (a, m) == (u, v)}
        if not own:
            return p2(v, w)
        total = sum(own.values())
        return max(own.get(w, 0) - off(0, own.get(w, 0)), 0) / total + sum(off(0, c) for c in own.values()) / total * p2(v, w)

    w = as_ids(text)
    return -sum(math.log2(p3(*x)) for x in zip(w, w[1:], w[2:]))


def test_surprise_follows_the_formulas(spark, none):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(12)] + ["Rare1", "odd#", "Éa", "x" * 12, "ABC", "7"]
    weights = [*range(1, 13), 0.2, 0.2, 0.2, 0.2, 0.2, 0.2]
    train = [" ".join(rng.choices(pool, weights=weights, k=rng.randrange(3, 30))) for _ in range(60)]
    asked = train[:3] + [" ".join(rng.choices([*pool, "new", "NEW!", "N1!!", "z" * 9], k=9)) for _ in range(25)]
    rows = [(i, t, "en", None) for i, t in enumerate(asked)] + [(80, None, "en", None), (81, " \n", "en", None), (None, asked[4], None, None)]
    got = {r.doc_id: r for r in kn.surprise(frame(spark, rows), frame(spark, [(i, t, "en", None) for i, t in enumerate(train)])).collect()}
    for i, t in enumerate(asked):
        assert got[i].n_tokens == len(t.split()) + 1 and got[i].bits == pytest.approx(reference(train, t), rel=1e-3)
    assert (got[80].n_tokens, got[80].bits) == (got[81].n_tokens, got[81].bits) == (0, 0.0)
    assert got[None].bits == got[4].bits
    assert kn.surprise(none, none).count() == 0


def test_a_shape_that_training_lacks_and_half_the_corpus_has(spark, monkeypatch):
    """Its positions go to several tasks, and nothing changes by it."""
    rng = random.Random(5)
    train = [" ".join(rng.choices([f"w{i}" for i in range(9)], k=20)) for _ in range(40)] + ["Q1! w1 w2"]
    asked = [" ".join(f"Q{rng.randrange(9)}!" if rng.random() < 0.5 else f"w{rng.randrange(9)}" for _ in range(40)) for _ in range(60)]
    monkeypatch.setattr(kn, "TASK_TRIGRAMS", 50)
    monkeypatch.setattr(kn, "HOT_TRIGRAMS", kn.SHARDS * 2)
    seen = []
    tasks = kn.Tasks
    monkeypatch.setattr(kn, "Tasks", lambda *x: seen.append(tasks(*x)) or seen[-1])
    as_rows = lambda texts: frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.bits for r in kn.surprise(as_rows(asked), as_rows(train)).collect()}
    assert seen[0].parts >= kn.SHARDS and seen[0].spread(np.arange(2, kn.FIRST_WORD)).max() > 1
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(reference(train, t), rel=2e-3)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    size = 70
    keys, counts = kn._counted(np.array([(v << 42) | (u << 21) | w for u, v, w in rng.integers(2, 12, (400, 3)).tolist()], dtype=np.uint64))
    lasts = np.zeros(size, dtype=np.int64)
    pairs, before = kn._pairs(keys)
    np.add.at(lasts, (pairs & kn.LOW).astype(int), 1)
    of_counts = np.array([*(np.count_nonzero(x == k) for x in (counts, before) for k in (1, 2, 3, 4)), len(keys), len(pairs)])
    known = kn.Known(keys, counts, kn.Model(of_counts, lasts))
    for context in (int(keys[0]) >> 21, (5 << 21) | 60, (60 << 21) | 5):
        asked = (np.uint64(context) << np.uint64(21)) | np.arange(1, size, dtype=np.uint64)
        assert np.exp2(known.log_probabilities(asked)).sum() == pytest.approx(1.0, abs=1e-6)


def test_classifier(spark, none):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(300)]
    good = [" ".join(rng.choices(pool, weights=[1 / (i + 1) for i in range(300)], k=60)) for _ in range(400)]
    bad = [" ".join(f"{rng.choice('QXZ')}{rng.randrange(10**6)}!!" for _ in range(60)) for _ in range(40)]
    rows = [(i, t, ["en", "de"][i % 2], None) for i, t in enumerate(good + bad)] + [(900, None, "en", None), (901, "", None, None), (None, good[0], None, None), (0, good[0], "en", None), (902, "w1 w2", "xx", None)]
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(0, 440, 2)] + [(None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows)
    got = {r.doc_id: r.accepted for r in kn.classify(docs, labels).collect()}
    held_out_good = [got[i] for i in range(1, 400, 2)]
    assert sum(held_out_good) / len(held_out_good) > 0.95 and not any(got[i] for i in range(400, 440))
    assert got[900] is False and got[901] is False and got[902] is True
    assert kn.classify(none, labels).count() == 0
    unlabelled = kn.classify(docs.where("doc_id < 5"), labels.limit(0)).collect()
    assert all(r.accepted and r.threshold is None for r in unlabelled)


def test_classifier_by_brute_force(spark):
    """Perplexities, thresholds and verdicts by the formulas, over languages with and without a threshold of their own."""
    from pyspark.sql import functions as F

    rng = random.Random(15)
    pool = {x: [f"{x}{i}" for i in range(25)] for x in ("en", "de", "fr")}
    lang_of = lambda i: "fr" if i % 25 == 0 else ("en", "de", None)[i % 3]
    text = lambda i: " ".join(rng.choices([*pool[lang_of(i) or "de"], "new", f"X{i}"], k=rng.choice([1, 4, 30, 60])))
    rows = [(i, text(i), lang_of(i), None) for i in range(900)] + [(901, None, "en", None), (902, " ", None, None), (None, "en1 en2 what", "en", None)]
    good = list(range(0, 900, 1))[:700]
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i in range(700, 900)], "doc_id bigint, quality int, toxic int")
    ids = spark.createDataFrame([(i,) for i in good], "i bigint")
    first = [r.i for r in ids.orderBy(F.xxhash64("i"), "i").limit(300).collect()]
    held = {r.i for r in ids.where(F.pmod(F.xxhash64(F.lit(7), F.col("i")), F.lit(kn.HELD_OUT)) == 0).collect()}
    learned = set(first) - held
    train = [t for i, t, *_ in rows if i in learned]
    facts = {}
    for i, t, lang, _ in rows:
        n = len((t or "").split())
        facts[i] = (lang, n + 1 if n else 0, reference(train, t) if n else 0.0)
    trusted = [i for i in good if i not in learned]
    mean_of = lambda own: sum(facts[i][2] for i in own) / sum(facts[i][1] for i in own)
    by_lang = {x: [i for i in trusted if facts[i][0] == x] for x in ("en", "de", "fr", None)}
    assert len(by_lang["fr"]) < kn.LEAST_HELD < len(by_lang["en"])
    means = {x: mean_of(own if len(own) >= kn.LEAST_HELD else trusted) for x, own in by_lang.items()}
    value = {i: 2 ** ((bits + kn.PRIOR_WORDS * means[lang]) / (n + kn.PRIOR_WORDS)) for i, (lang, n, bits) in facts.items() if n}
    at = lambda own: sorted(value[i] for i in own)[math.ceil(0.9 * len(own)) - 1]
    limits = {x: at(own if len(own) >= kn.LEAST_HELD else trusted) for x, own in by_lang.items()}
    got = {r.doc_id: r for r in kn.classify(frame(spark, rows), labels, keep=0.9, train_docs=300).collect()}
    assert len(got) == len(rows)
    for i, (lang, n, _) in facts.items():
        assert got[i].n_tokens == n
        if not n:
            assert got[i].perplexity is None and got[i].accepted is False
            continue
        assert got[i].perplexity == pytest.approx(value[i], rel=2e-3) and got[i].threshold == pytest.approx(limits[lang], rel=2e-3)
        if abs(value[i] / limits[lang] - 1) > 5e-3:
            assert got[i].accepted is (value[i] < limits[lang])


def test_a_very_long_text(spark):
    rng = random.Random(2)
    train = [" ".join(rng.choices("abcdef", k=50)) for _ in range(30)]
    long = " ".join(rng.choices("abcdefgh", k=400_000))
    got = kn.surprise(frame(spark, [(1, long, "en", None)]), frame(spark, [(i, t, "en", None) for i, t in enumerate(train)])).first()
    assert got.n_tokens == 400_001 and got.bits == pytest.approx(reference(train, long), rel=1e-3)


def test_all_trusted_documents_that_train_nothing_set_thresholds(spark):
    rng = random.Random(6)
    pool = {lang: [f"{lang}{i}" for i in range(n)] for lang, n in (("en", 30), ("de", 400))}
    rows = [(i, " ".join(rng.choices(pool[lang], k=40)), lang, None) for i in range(300) for lang in [("en", "de")[i % 2]]]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    limits = {(r.lang, r.threshold) for r in kn.classify(frame(spark, rows), labels, train_docs=100).collect()}
    assert len(limits) == 2 and len({x for _, x in limits}) == 2


def test_all_trusted_documents_but_the_held_out_train(spark, monkeypatch):
    """More than any earlier bound of a sample: every one of them trains, and the others set thresholds."""
    class Seen(Exception):
        pass

    def surprise(docs, train, *rest):
        raise Seen(train.count())

    monkeypatch.setattr(kn, "surprise", surprise)
    ids = spark.range(260_000).withColumnRenamed("id", "doc_id")
    docs = ids.selectExpr("doc_id", "'w1 w2' AS text", "'en' AS lang")
    with pytest.raises(Seen) as e:
        kn.classify(docs, ids.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert e.value.args[0] == ids.selectExpr(f"pmod(xxhash64(7, doc_id), {kn.HELD_OUT}) <> 0 AS k").where("k").count() > 200_000


def test_more_training_text_has_more_shards_and_ids_keep_the_most_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(kn, "SHARD_BYTES", 64)
    monkeypatch.setattr(kn, "IDS", kn.FIRST_WORD + 6)
    rng = random.Random(12)
    train = [" ".join(rng.choices([f"w{i}" for i in range(12)], weights=range(4, 16), k=40)) for _ in range(80)]
    seen, learn = [], kn.learn
    monkeypatch.setattr(kn, "learn", lambda *x: seen.append(learn(*x)) or seen[-1])
    as_rows = lambda texts: frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.bits for r in kn.surprise(as_rows(train[:8]), as_rows(train)).collect()}
    lookups, paths = seen[0]
    counts = sorted(Counter(w for t in train for w in t.split()).values())
    assert lookups.model.shards == len(paths) > kn.SHARDS and len(lookups.words.hashes) == sum(n > counts[-7] for n in counts)
    for i, t in enumerate(train[:8]):
        assert got[i] == pytest.approx(reference(train, t, counts[-7] + 1), rel=2e-3)


def test_ids_beyond_a_broadcast_are_sought_by_a_filter(spark, monkeypatch):
    from opsledger.llm import bloom

    docs = frame(spark, [(i % 90, "x", "en", None) for i in range(100)] + [(None, "y", "en", None)])
    kept = spark.range(0, 200, 3).toDF("wanted")
    want = sorted(i % 90 for i in range(100) if i % 90 % 3 == 0)
    for small in (bloom.small, lambda df, _: df):
        monkeypatch.setattr(bloom, "small", small)
        assert sorted(r.doc_id for r in bloom.only(docs, "doc_id", kept).collect()) == want
