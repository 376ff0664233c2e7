"""Decontamination against a full edit-distance table."""

import random

from opsledger.llm.decontaminate import Searcher, best_match, budget, decontaminate, find_leaks, plain
from tests.llm.conftest import frame


def table(item, window):
    """Least edits of item against a substring, by the textbook recurrence."""
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        left, row = row, [i] + [0] * len(window)
        for j, b in enumerate(window, 1):
            row[j] = min(left[j - 1] + (a != b), left[j] + 1, row[j - 1] + 1)
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        window = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        assert best_match(item, window) == table(item, window)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(max(1, len(text)))
        text[i : i + rng.choice([0, 1])] = rng.choice(["", "q", "z"])
    return "".join(text)


def _holds(item, text):
    return table(item, text)[0] <= budget(len(item)) and bool(budget(len(item)) or f" {item} " in f" {text} ")


def test_a_limit_ends_the_search_without_a_loss():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 70)))
        window = "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 60))) + edited(rng, item, rng.randrange(9)) + "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 60)))
        want, most = table(item, window), rng.randrange(12)
        got = best_match(item, window, most)
        assert got == want if want[0] <= most else got[0] > most


def test_no_match_is_lost_beside_a_hit():
    """Texts of few letters, whose pieces recur, with an item at a text's very ends and errors beside every piece."""
    rng = random.Random(11)
    found = 0
    for _ in range(150):
        item = " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 40)))
        text = plain(rng.choice(["", "b a "]) + edited(rng, item, rng.randrange(0, budget(len(item)) + 2)) + rng.choice(["", " a b"]))
        searcher = Searcher([(1, item)], 0.1)
        assert bool(searcher.matches(text)) == _holds(item, text)
        found += _holds(item, text)
    assert 30 < found < 150


def test_very_long_texts(spark):
    item = " ".join(f"word{i}" for i in range(30))
    body = " ".join(f"t{i % 997}" for i in range(300_000))
    rows = [(1, f"{body} {item.replace('word7 ', 'wordy ')} {body}", None, None), (2, body, None, None)]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [(r.doc_id, r.distance) for r in find_leaks(frame(spark, rows), bench).collect()] == [(1, 1)]
    assert [r.doc_id for r in decontaminate(frame(spark, rows), bench).collect()] == [2]


def test_finds_what_the_table_finds(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{i}" for _ in range(25))) for i in range(8)] + [(8, "tiny one"), (9, None), (10, ""), (11, "?!")]
    rows = []
    for d in range(60):
        body = " ".join(f"t{rng.randrange(500)}" for _ in range(60))
        k = rng.randrange(9)
        if d % 3:
            body = f"{body}. {edited(rng, items[k][1], rng.choice([0, 3, 8, 9, 10, 11, 12, 14])).upper()} ... {body}"
        rows.append((d, body, None, None))
    rows += [(None, items[0][1], None, None), (90, None, None, None), (91, "", None, None), (92, "tiny oneness", None, None), (93, "a tiny one", None, None), (0, rows[0][1], None, None)]
    want = set()
    for k, body, *_ in rows:
        for i, x in items:
            item, text = plain(x), plain(body)
            if item and text:
                least, _ = table(item, text)
                if least <= budget(len(item)) and (budget(len(item)) or f" {item} " in f" {text} "):
                    want.add((k, i, least))
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = find_leaks(docs, bench)
    assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == want and len(want) > 20
    assert {(r.doc_id, r.item_id, r.distance) for r in find_leaks(docs, bench, block_chars=200).collect()} == want
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    own = lambda text: any(plain(x) and _holds(plain(x), plain(text)) for _, x in items)
    stay = sorted(str(k) for k, text, *_ in rows if not own(text))
    assert sorted(str(r.doc_id) for r in kept.collect()) == stay and 2 < len(stay) < len(rows)
    assert sorted(str(r.doc_id) for r in decontaminate(docs, bench, block_chars=200).collect()) == stay
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
