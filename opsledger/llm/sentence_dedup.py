"""Substring deduplication by sliding spans of consecutive sentences."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import freeing
from opsledger.llm.spans import PLACE, covered_intervals, text_key, with_intervals

#: Sentences in a span, the fewest words of a span (of short sentences it takes more) and the most (of long ones it
#: takes the first words), and the longest unit in words: any MOST_WORDS + SPAN_WORDS words of a text hold a whole span.
WIDTH, FEWEST_WORDS, SPAN_WORDS, MOST_WORDS = 3, 8, 34, 17
STOPS = frozenset(".!?。！？")
TOKEN = re.compile(r"\S+")


def _inner(words: list[str], a: int, b: int, most_words: int) -> list[int]:
    """Cuts inside the sentence [a, b) of words: of each most_words places between words in a row, the least hash.

    The hash is of the words on both sides, so that texts with a passage in common cut it alike whatever is around it.
    """
    import numpy as np

    own = words[a:b]
    hashes = np.array([crc32(f"{x} {y}".encode("utf-8", "surrogatepass")) for x, y in zip(own, own[1:])], dtype=np.uint32)
    if len(hashes) < most_words:
        return []
    least = np.lib.stride_tricks.sliding_window_view(hashes, most_words).argmin(axis=1)
    return np.unique(least + np.arange(a + 1, a + 1 + len(least))).tolist()


def cuts(text: str, most_words: int = MOST_WORDS) -> tuple[list[str], list[int], list[int]]:
    """The words of a text, the word places at which its sentences part, and those where units do; with both ends.

    A sentence ends after . ! ? before white space, or at a line end; one of more than most_words words has inner cuts.
    """
    words, ends = [], [0]
    for line in text.split("\n"):
        at = len(words)
        own = line.split()
        words += own
        ends += [i for i, w in enumerate(own, at + 1) if w[-1] in STOPS]
        if ends[-1] < len(words):
            ends.append(len(words))
    places = []
    for a, b in zip(ends, ends[1:]):
        places.append(a)
        if b - a > most_words:
            places += _inner(words, a, b, most_words)
    return words, ends, [*places, len(words)]


def units(text: str, most_words: int = MOST_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, words) of the units of a text, sentences or what cuts leave of them, in order and covering it."""
    _, _, places = cuts(text, most_words)
    starts = [m.start() for m in TOKEN.finditer(text)]
    edges = [0, *(starts[p] for p in places[1:-1]), len(text)]
    return [(a, b, n - m) for a, b, m, n in zip(edges, edges[1:], places, places[1:])] if starts else []


def spans(ends: list[int], places: list[int], width: int = WIDTH, fewest: int = FEWEST_WORDS, most: int = SPAN_WORDS) -> set[tuple[int, int]]:
    """(first word, end) of the spans of a text: what follows each cut, and what goes before each sentence's end.

    That is `width` sentences (a part of one counts) and as many more as it takes to hold `fewest` words; but `most`
    words where these are longer, or where the text has no more sentences.
    """
    found, total, s = set(), places[-1], 0
    for c in places:
        while s < len(ends) and ends[s] <= c:
            s += 1  # ends[s - 1] <= c < ends[s]
        j = s - 1 + width
        while j < len(ends) and ends[j] - c < fewest:
            j += 1
        if j < len(ends) and ends[j] - c <= most:
            found.add((c, ends[j]))
        elif c + most <= total:
            found.add((c, c + most))
        if ends[s - 1] < c:
            continue  # inside a sentence the spans that follow earlier cuts reach as far
        j = s - 1 - width
        while j >= 0 and c - ends[j] < fewest:
            j -= 1
        if j >= 0 and c - ends[j] <= most:
            found.add((ends[j], c))
        elif c >= most:
            found.add((c - most, c))
    return found


def _runs(width: int, fewest: int):
    most = max(SPAN_WORDS, fewest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows, pos, digests = [], [], []
            for i, text in enumerate(batch.column(2)):
                body = text.as_py()
                if not body:
                    continue
                words, ends, places = cuts(body)
                own = sorted(spans(ends, places, width, fewest, most))
                rows += [i] * len(own)
                for a, b in own:
                    pos.append(a * PLACE + b - a)
                    digests.append(blake2b(" ".join(words[a:b]).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            own = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(pos, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["id", "key", "pos", "h1", "h2"])

    return run


def without(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """A text without the words in the ranges, and how many units lose words.

    Of the white space before and after a range, that with more line ends stays between what it parts, or the later.
    """
    _, _, places = cuts(text)
    at = [m.span() for m in TOKEN.finditer(text)]
    out, done, gone = [], 0, set()
    for a, b in sorted(ranges):
        gone.update(range(bisect_right(places, a) - 1, bisect_left(places, b)))
        if a:
            before = text[at[a - 1][1] : at[a][0]]
            after = text[at[b - 1][1] : at[b][0]] if b < len(at) else ""
            out.append(text[done : at[a - 1][1]])
            out.append(before if b < len(at) and before.count("\n") > after.count("\n") else after)
        done = at[b][0] if b < len(at) else len(text)
    return "".join([*out, text[done:]]), len(gone)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        texts, gone = batch.column(1), np.zeros(batch.num_rows, dtype=np.int64)
        touched = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        if len(touched):
            texts = texts.to_pylist()
            for i in touched.tolist():
                if texts[i]:
                    texts[i], gone[i] = without(texts[i], [(r["start"], r["end"]) for r in batch.column(2)[i].as_py()])
            texts = pa.array(texts, pa.string())
        yield pa.record_batch([batch.column(0), texts, pa.array(gone)], names=["doc_id", "text", "n_removed"])


def sentence_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, fewest_words: int = FEWEST_WORDS) -> DataFrame:
    """(doc_id, text, n_removed): texts without the words that a non-first repeated span covers.

    Spans are `width` consecutive sentences, and as many more as it takes to hold fewest_words words, but of long
    sentences SPAN_WORDS words before or after a cut (see spans()). Each is hashed (128 bits, white space as one blank);
    equal spans of the whole corpus meet in a join, and all but the one with the smallest (id, place) cover their words,
    which are removed; n_removed counts the units that lose words. Cuts depend on the words around them alone, so any
    passage of over 50 words that repeats holds a common span wherever it starts; of one that starts or ends inside a
    sentence up to MOST_WORDS words at each end may stay. A null text stays null, an empty one empty; documents
    without a span stay as they are. Rows sharing an id and a text are one document and are cleaned alike; others are
    documents of their own, those of a null id too. Other columns are not carried. Ids are integers. With fewest_words
    0 or 1 any `width` sentences are a span.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = texts.where("text is not null").select("id", text_key(F.col("text")).alias("key"), "text")
    runs = keyed.mapInArrow(freeing(_runs(width, fewest_words)), "id long, key long, pos long, h1 long, h2 long")
    joined = with_intervals(texts, F.col("id"), F.col("text"), covered_intervals(runs, None), "intervals")
    return joined.select("id", "text", "intervals").mapInArrow(freeing(_clean), "doc_id long, text string, n_removed long")
