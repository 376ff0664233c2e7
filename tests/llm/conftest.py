"""Small corpora with every awkward row."""

import random

import pytest

EXTRA = "id string, row bigint, sha string, suspect string, n bigint, size bigint, rate double, copies string, comp bigint, block bigint, part bigint, tokens string, n_lines string, n_removed string, text_sha256 string, __gone string, source_size string, word string, node string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source): random texts, copies in either case, near copies, empty, null, long, odd white space."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(rng, rng.choice([1, 3, 4, 5, 6, 40, 80, 120]))
        if i % 4 == 1 and rows:
            text = rng.choice(rows)[1] or ""
            if i % 8 == 1:
                text = text.upper()
        elif i % 4 == 3 and rows:
            parts = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([1, 1, 2, 3])):
                parts[rng.randrange(len(parts))] = f"x{rng.randrange(9)}"
            text = " ".join(parts)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \t\n\v\f\r ", "en", "b"), (n + 3, "É é   w1 W1 w1", "fr", "c"), (n + 4, words(rng, 30_000), "en", "a"),
             (0, rows[0][1], rows[0][2], rows[0][3]), (None, "w1 w2 w3 w4 w5 w6", "en", "a"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


def frame(spark, rows):
    """The rows with columns whose names might clash with an operator's own."""
    names = [x.split()[0] for x in EXTRA.split(", ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("1") for n in names})


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.limit(0)
