"""Exact, line and sentence deduplication against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

from opsledger.llm.exact_dedup import exact_dedup
from opsledger.llm.line_dedup import line_dedup
from opsledger.llm.sentence_dedup import sentence_dedup, units
from tests.llm.conftest import frame

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact(docs, rows, none):
    groups = defaultdict(list)
    for k, text, *_ in rows:
        groups[(text or "").translate(AZ)].append(k)
    want = Counter()
    for text, ids in groups.items():
        keep = max((k for k in ids if k is not None), default=None)
        for k, n in Counter(ids).items():
            for i in range(n):
                want[(k, keep, len(ids), k == keep and i == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup(docs).collect())) == want
    assert exact_dedup(none).count() == 0


def test_exact_with_a_crowded_filter(docs):
    from opsledger.llm import bloom
    from opsledger.llm import exact_dedup as module
    from pyspark.sql import functions as F

    keyed = docs.select(F.coalesce("text", F.lit("")).alias("k"), F.when(F.col("doc_id") == 5, None).otherwise(F.col("text")).alias("n"))
    count = Counter(r.k for r in keyed.collect())
    for bits, passes in ((bloom.PIECE_BITS, 1), (bloom.PIECE_BITS, 4), (1 << 29, 16)):
        suspect, lone = module.repeated(keyed, "k", bits, passes)
        suspect, lone = ([r.k for r in x.collect()] for x in (suspect, lone))
        assert Counter(suspect + lone) == count and all(count[k] == 1 for k in lone) and len(lone) > 10
        suspect, lone = module.repeated(keyed, "n", bits, passes)
        assert suspect.count() + lone.count() == keyed.count() and suspect.where("n is null").count() == 0


def test_exact_in_several_passes(docs, rows, monkeypatch):
    from opsledger.llm import bloom
    from opsledger.llm import exact_dedup as module

    monkeypatch.setattr(bloom, "BITS_PER_ROW", 4000)
    own = module.repeated
    monkeypatch.setattr(module, "repeated", lambda keyed, key: own(keyed, key, bloom.PIECE_BITS, 4))
    test_exact(docs, rows, docs.limit(0))


def test_filters_of_hashes(spark):
    from opsledger.llm import bloom
    from pyspark.sql import functions as F

    held = spark.range(0, 3000, 3).withColumn("h", F.xxhash64("id"))
    asked = spark.range(4000).withColumn("h", F.when(F.col("id") != 3999, F.xxhash64("id")))
    pieces = bloom.pieces_for(held.count())
    got = {r.id: r.may for r in bloom.tested(bloom.spots(asked, F.col("h"), pieces), bloom.once(bloom.spots(held, F.col("h"), pieces)), "may").collect()}
    assert all(got[i] for i in range(0, 3000, 3)) and got[3999] is False and sum(got.values()) < 1100


def removed_lines(rows, width=3):
    """Lines that stay of each (id, text), by the definition."""
    seen = {}
    for k, text in rows:
        lines = (text or "").split("\n")
        for i in range(len(lines) - width + 1):
            run = tuple(lines[i : i + width])
            if any(x.strip(" ") for x in run):
                seen.setdefault(run, set()).add((k is not None, k or 0, i))
    out = Counter()
    for k, text in rows:
        if text is None:
            out[(k, None)] += 1
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - width + 1):
            run = tuple(lines[i : i + width])
            if run in seen and min(seen[run]) != (k is not None, k or 0, i):
                gone.update(range(i, i + width))
        out[(k, "\n".join(x for i, x in enumerate(lines) if i not in gone))] += 1
    return out


LINES = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny\na\nb\nc"), (3, "\n\n\n\n\nq"), (4, "\n\n\n\n\nq\nq\nq\nq\nq"), (5, None), (6, ""), (7, "a\nb"), (1, "a\nb\nc\nd"), (None, "x\nb\nc"), (None, None), (8, "b\nc\nd\ny"), (9, "é\n \n z\n" * 40)]


def test_lines(spark):
    got = line_dedup(frame(spark, [(k, t, None, None) for k, t in LINES]))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == removed_lines(LINES)
    for r in got.collect():
        assert r.n_lines == (0 if r.text is None else r.n_lines) and r.n_removed >= 0
    assert line_dedup(frame(spark, []).limit(0)).count() == 0


def test_lines_where_nothing_is_broadcast(spark, monkeypatch):
    from opsledger.llm import spans

    monkeypatch.setattr(spans, "small_by_bytes", lambda df, *x: df)
    test_lines(spark)


def test_blank_lines_may_go_too(spark):
    rows = [(1, "\n\n\nq"), (2, "r\n\n\n\ns")]
    got = {r.doc_id: r.text for r in line_dedup(frame(spark, [(k, t, None, None) for k, t in rows]), keep_blank=False).collect()}
    assert got == {1: rows[0][1], 2: "r\ns"}


def test_a_very_long_text(spark):
    body = "\n".join(f"line {i % 7919} of {i}" for i in range(60_000))
    rows = [(1, body), (2, "own\n" + body.split("\n", 100)[-1]), (3, "x\ny\nz")]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup(frame(spark, [(k, t, None, None) for k, t in rows])).collect()}
    assert got == {1: (60_000, 0), 2: (59_901, 59_900), 3: (3, 0)}
    got = {r.doc_id: r.n_removed for r in sentence_dedup(frame(spark, [(k, t, None, None) for k, t in rows])).collect()}
    assert got[1] == got[3] == 0 and got[2] >= 59_900


def test_no_python_in_native_operators(docs, monkeypatch):
    """Neither in what they return nor in any job on the way there."""
    from opsledger.llm import exact_dedup as exact
    from opsledger.llm import spans

    plans = []
    for module in (exact, spans):
        own = module.cut
        monkeypatch.setattr(module, "cut", lambda df, own=own: plans.append(df) or own(df))
    for out in (exact_dedup(docs), line_dedup(docs)):
        plans.append(out)
    assert len(plans) >= 7
    for df in plans:
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_units_cover_the_text():
    for text in ("", " ", "One two. Three! Four\nfive\n\n six", "w " * 100 + ". End", "no end", "\n\n", "a.b c. d", "x" * 50_000):
        own = units(text)
        assert "".join(text[a:b] for a, b, _ in own) == (text if text.split() else "")
        assert all(n <= 24 for _, _, n in own)


PASSAGE = "The old mill stood by the river for many years. Nobody knew who had built it there. In spring the water rose to its door! The miller counted his sacks and slept badly. His dog barked at every boat that passed the weir. One day a letter came from the town and it all changed at once."


def test_sentences(spark):
    rows = [(1, "First words here. " + PASSAGE + " And the end of it."), (2, "Something else begins. Other things too. " + PASSAGE.replace(" ", "  ") + "\nThen more text."), (3, "Nothing in common with the others. Not a word of it. At all, by any means."), (4, None), (5, ""), (6, PASSAGE), (6, PASSAGE), (None, "Own words. " + PASSAGE), (7, "The. Of. In. The. Of. In.")]
    got = Counter((r.doc_id, r.text, r.n_removed) for r in sentence_dedup(frame(spark, [(k, t, None, None) for k, t in rows])).collect())
    whole = {(k, t): n for (k, t, n) in got for _ in [0]}
    assert whole[(3, rows[2][1])] == 0 and whole[(4, None)] == 0 and whole[(5, "")] == 0 and whole[(7, rows[8][1])] == 0
    texts = {k: t for k, t, _ in got if k is not None}
    assert texts[2] == "Something else begins. Other things too.\nThen more text."
    assert sum(PASSAGE.split()[7] in (t or "") for _, t, _ in got) == 1  # the first place alone keeps it: null ids come first
    assert texts[6] == "" and got[(6, "", 6)] == 2


def cleaned(rows):
    """What is left of each (id, text), by the definition: every span but the first of equal ones covers its words."""
    from opsledger.llm import sentence_dedup as module

    place, seen = lambda k, a, b: (k is not None, k or 0, a * module.PLACE + b - a), {}
    found = []
    for k, text in rows:
        own, words = [], []
        if text:
            words, ends, places = module.cuts(text)
            own = [(a, b, " ".join(words[a:b])) for a, b in module.spans(ends, places)]
        found.append((words, own))
        for a, b, run in own:
            seen.setdefault(run, set()).add(place(k, a, b))
    out = Counter()
    for (k, text), (words, own) in zip(rows, found):
        gone = {i for a, b, run in own if min(seen[run]) != place(k, a, b) for i in range(a, b)}
        out[(k, None if text is None else tuple(w for i, w in enumerate(words) if i not in gone))] += 1
    return out


def test_sentences_by_the_definition(spark, monkeypatch):
    from opsledger.llm import spans

    rng = random.Random(12)
    pool = [f"w{i}" for i in range(90)]
    sentence = lambda: " ".join(rng.choices(pool, k=rng.choice([1, 2, 5, 9, 30, 60]))) + rng.choice([".", "!", "?", "\n"])
    passages = [" ".join(sentence() for _ in range(rng.randrange(2, 9))) for _ in range(8)]
    rows = [(i, " ".join(rng.choice([sentence(), sentence(), rng.choice(passages)]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(None, passages[0]), (61, None), (62, ""), (63, " \n"), (3, rows[3][1]), (64, rows[4][1])]
    want = cleaned(rows)
    docs = frame(spark, [(k, t, None, None) for k, t in rows])

    def got():
        return Counter((r.doc_id, None if r.text is None else tuple(r.text.split())) for r in sentence_dedup(docs).collect())

    assert got() == want
    monkeypatch.setattr(spans, "small_by_bytes", lambda df, *x: df)
    assert got() == want
    assert sentence_dedup(docs.limit(0)).count() == 0


def test_passages_of_short_sentences(spark):
    short = " ".join(f"{'abcdefghij'[i // 10]}{i}!!" for i in range(60))
    rows = [(1, "Some beginning of it all. " + short), (2, "Quite another start here. " + short + " Its own end."), (3, "No. Yes. No.")]
    got = {r.doc_id: (r.text, r.n_removed) for r in sentence_dedup(frame(spark, [(k, t, None, None) for k, t in rows])).collect()}
    assert got[1] == (rows[0][1], 0) and got[3] == (rows[2][1], 0)
    assert got[2] == ("Quite another start here. Its own end.", 60)


def test_every_repeat_of_over_fifty_words_holds_a_common_span():
    from opsledger.llm import sentence_dedup as module

    rng = random.Random(4)
    pool = [f"w{i}" for i in range(500)]

    def prose(n, longest):
        out = []
        while len(out) < n:
            out += rng.choices(pool, k=rng.randint(1, longest) - 1) + [rng.choice(pool) + "."]
        return out[len(out) - n :]

    for _ in range(400):
        longest = rng.choice((3, 12, 30, 200))
        passage, found = prose(51, longest), []
        if rng.random() < 0.5:
            passage[-1] = "end"
        for _ in range(2):
            words, ends, places = module.cuts(" ".join(prose(rng.randrange(70), longest)[:-1] + passage + prose(rng.randrange(70), longest)))
            found.append({" ".join(words[a:b]) for a, b in module.spans(ends, places)})
        assert any(x in " ".join(passage) for x in found[0] & found[1])


def test_passages_that_start_inside_a_sentence(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(80))
    other = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    rows = [(1, f"{other(9)} {passage} {other(20)}."), (2, f"{other(31)} {passage} {other(5)}. {other(8)}."), (3, f"{other(3)}. {passage}")]
    got = {r.doc_id: r for r in sentence_dedup(frame(spark, [(k, t, None, None) for k, t in rows])).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    for k in (2, 3):
        left = [w for w in got[k].text.split() if w[0] == "p"]
        assert got[k].n_removed > 0 and len(left) <= 32
        assert [w for w in got[k].text.split() if w[0] == "q"] == [w for w in rows[k - 1][1].split() if w[0] == "q"]
