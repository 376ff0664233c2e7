"""Benchmark decontamination by pigeonhole edit matching, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import cut, freeing, fresh, small

#: Errors allowed per character of a test item, characters of the shortest piece, and of the grams that filter windows.
RATE, LEAST_PIECE, GRAM = 0.1, 8, 6
#: Characters of test items that one pass over the documents searches.
BLOCK_CHARS = 2_000_000
APART = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower case, with one blank for every run of other than letters and digits."""
    return APART.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = RATE) -> int:
    """Errors allowed in an item; so few that its pieces, one more than these, have LEAST_PIECE characters or more."""
    return max(0, min(int(length * rate), length // LEAST_PIECE - 1))


def masks_of(item: str) -> dict[str, int]:
    """The places of each character of an item, as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(item):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def best_match(item: str, window: str, most: int | None = None, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the substring of window that is nearest to item; the leftmost end of the best (Myers 1999).

    With `most` the search ends once no place that is left can come that near, as a column changes the distance by one
    at most; a result above `most` then only says that there is none.
    """
    m, n = len(item), len(window)
    where = masks_of(item) if masks is None else masks
    mask, top, limit = (1 << m) - 1, 1 << (m - 1), m if most is None else most
    up, down, score, best, end = mask, 0, m, m, 0
    for j, ch in enumerate(window, 1):
        same = where.get(ch, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (~(across | up) & mask), up & across
        if more & top:
            score += 1
            if score - n + j > limit:
                break
        elif less & top:
            score -= 1
            if score < best:
                best, end = score, j
                limit = min(limit, best)
        elif score - n + j > limit:
            break
        more, less = more << 1, less << 1
        up, down = (less | ~(vertical | more)) & mask, more & vertical & mask
    return best, end


class Searcher:
    """All items at once: an automaton of their pieces, and what verifying a hit needs.

    A piece's neighbour, the other of a pair of pieces, halved: where an item matches, one of its pieces is hit whose
    pair holds one error at most (the pigeonhole again, on pairs), so that the neighbour lies beside the hit with one
    error at most, and then one half of it is there exactly, shifted by one place at most.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(k, x, budget(len(x), rate)) for k, x in items if x]
        self.grams = [{x[j : j + GRAM] for j in range(len(x) - GRAM + 1)} for _, x, _ in self.items]
        self.masks = [masks_of(x) for _, x, _ in self.items]
        pieces = defaultdict(list)
        for i, (_, x, errors) in enumerate(self.items):
            edges = [len(x) * j // (errors + 1) for j in range(errors + 2)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                pieces[x[a:b]].append((i, a, *self.neighbour(x, edges, k)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    @staticmethod
    def neighbour(x: str, edges: list[int], k: int) -> tuple[str, int, str, int]:
        """(half that touches the hit, its place, the other half, its place), places counted from the hit's start.

        The last of an odd number of pieces has no pair: its halves are empty and found everywhere.
        """
        other = k ^ 1
        if other + 1 >= len(edges):
            return "", 0, "", 0
        a, b = edges[other], edges[other + 1]
        middle = (a + b) // 2
        first, second = (x[a:middle], a - edges[k]), (x[middle:b], middle - edges[k])
        return (*first, *second) if other > k else (*second, *first)

    def near(self, i: int, window: str) -> bool:
        """False only if too few of the window's grams are the item's for it to match (each error breaks GRAM of them)."""
        _, item, errors = self.items[i]
        need = len(item) - GRAM + 1 - errors * GRAM
        grams = self.grams[i]
        return need <= 0 or sum(window[j : j + GRAM] in grams for j in range(len(window) - GRAM + 1)) >= need

    def places(self, body: str) -> dict[int, set[int]]:
        """Item -> where in the text it would start, by the hits whose neighbour is there too."""
        starts: dict[int, set[int]] = {}
        at, before = body.startswith, max
        for end, (length, places) in self.automaton.iter(body):
            s = end - length + 1
            for i, offset, close, p, far, q in places:
                if not close or at(close, before(0, s + p)) or at(far, before(0, s + q)) or at(far, before(0, s + q + 1)) or at(far, before(0, s + q - 1)):
                    starts.setdefault(i, set()).add(s - offset)
        return starts

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item that text holds, its best place in the plain text."""
        body = plain(text)
        if not body or not self.items:
            return []
        found = []
        for i, begin in self.places(body).items():
            key, item, errors = self.items[i]
            windows = []
            for s in sorted(begin):  # a match has the piece within `errors` of where an exact one would
                a, b = max(0, s - errors), min(len(body), s + len(item) + errors)
                if windows and a <= windows[-1][1] - len(item):
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            best = None
            for a, b in windows:
                if not self.near(i, body[a:b]):
                    continue
                distance, end = best_match(item, body[a:b], errors, self.masks[i])
                if errors == 0 and distance == 0 and not _whole_words(body, a + end - len(item), a + end):
                    continue
                if distance <= errors and (best is None or distance < best[1]):
                    best = (key, distance, max(0, a + end - len(item)), a + end)
            if best:
                found.append(best)
        return found


def _whole_words(body: str, a: int, b: int) -> bool:
    return (a == 0 or body[a - 1] == " ") and (b == len(body) or body[b] == " ")


def _search(items: list[tuple[int, str]], rate: float, keys: list[str]):
    """Of batches of key columns and texts: the keys of each text that holds an item, with each match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items, rate)
        for batch in batches:
            found = [(i, m) for i, text in enumerate(batch.column(len(keys))) for m in searcher.matches(text.as_py())]
            own = [c.take(pa.array([i for i, _ in found], pa.int64())) for c in batch.columns[: len(keys)]]
            yield pa.record_batch([*own, *(pa.array([m[j] for _, m in found], pa.int64()) for j in range(4))], names=[*keys, "item_id", "distance", "start", "end"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in plain text, a block at a time: as many as hold about block_chars characters, but whole ones."""
    items = benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(text_col).alias("x")).where("x is not null")
    total = items.agg(F.sum(F.length("x"))).first()[0] or 0
    blocks = total // block_chars + 1
    for b in range(blocks):
        own = [(r.k, plain(r.x)) for r in items.where(F.pmod(F.xxhash64("k", "x"), F.lit(blocks)) == b).collect()]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield own


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every test item that a document holds within its error budget.

    Texts are compared in lower case, punctuation and white space as one blank. An item of n characters may have
    rate * n errors (insertions, deletions, substitutions); of its pieces, one more than these, one must be found
    exactly, by one automaton over all pieces; hits without the piece's neighbour and windows of too few shared grams go
    (neither loses a match), and the rest is verified. start and end are places in the plain text (start as if the match
    had the item's length). Items too short for an error must match exactly and as whole words. Null and empty texts and
    items match nothing. Documents are never shuffled; the items are searched in blocks of about block_chars characters
    (an item that is longer is a block of its own, whole), one pass each, whose results are kept in the shared folder
    before the next block is read where there are several, so that a large benchmark needs more passes and not more
    memory. Repeated rows give repeated results; repeated items one row each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _found(texts, ["doc_id"], _blocks(benchmark, item_col, item_text_col, block_chars), rate)


def _found(texts: DataFrame, keys: list[str], blocks: Iterator[list[tuple[int, str]]], rate: float) -> DataFrame:
    """The matches of all blocks; those of all but the last are computed, so that no more than two blocks are held."""
    parts: list[DataFrame] = []
    for items in blocks:
        if parts:
            parts[-1] = cut(parts[-1])
        parts.append(texts.mapInArrow(freeing(_search(items, rate, keys)), ", ".join(f"{k} long" for k in [*keys, "item_id", "distance", "start", "end"])))
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows whose text holds a test item, as find_leaks judges; all columns and every other row stay.

    A row's text alone decides, whatever its id: leaking texts are known by two 64-bit hashes, which are broadcast where
    they are few; else the documents meet them in a shuffle.
    """
    h1, h2 = fresh(docs, "h1", "h2")
    hashes = F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)
    texts = docs.select(hashes[0].alias(h1), hashes[1].alias(h2), F.col(text_col).alias("text"))
    leaks = cut(_found(texts, [h1, h2], _blocks(benchmark, item_col, item_text_col, block_chars), rate).select(h1, h2).distinct())
    return docs.join(small(leaks, 24), (hashes[0] == F.col(h1)) & (hashes[1] == F.col(h2)), "left_anti")
