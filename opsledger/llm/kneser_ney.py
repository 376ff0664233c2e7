"""Quality by perplexity: an interpolated modified Kneser-Ney trigram model of trusted text, by sharded count joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm import bloom
from opsledger.llm.blocks import BLOCK_BYTES, SCHEMA, batch_of, block_bytes, blocks_of, packed, spread, unpacked
from opsledger.llm.common import cut, freeing, freeing_group, fresh, pieces, remove, scratch, small, small_by_bytes
from opsledger.llm.files import attempt_name, opened
from opsledger.llm.wordhash import SHAPES, mix, word_hashes

#: One in so many trusted documents trains nothing but sets thresholds; all others train.
HELD_OUT = 5
#: Ids of the model: a text's begin and end, a class for each shape of unknown words, and the words of the training
#: text that it holds LEAST_COUNT times or more (a higher count where these are more than ids have room for).
BEGIN, END, FIRST_WORD, BITS, LEAST_COUNT = 0, 1, 2 + SHAPES, 21, 5
IDS = 1 << BITS
#: What stands for a first or last id that no training text has beside the middle one: ids that are never there.
NO_FIRST, NO_LAST = END, BEGIN
#: Shards of the counts in training, at least, and training text bytes of one, at most; a power of two. Text bytes whose
#: positions one scoring task looks up.
SHARDS, SHARD_BYTES, TASK_BYTES = 32, 16 << 20, 128 << 20
#: Distinct trigrams of the model that a scoring task holds, about.
TASK_TRIGRAMS = 2_000_000
#: Text bytes whose words are looked at together.
STEP_BYTES = 1 << 20
#: Bits of the filter of known pairs for each pair, and its bytes at most: beyond that more positions are looked up.
PAIR_BITS, FILTER_BYTES = 8, 32 << 20
#: The most frequent trigrams of training, whose probabilities are broadcast too, so that they need no lookup.
HOT_TRIGRAMS = 1 << 18
#: A text's surprise is averaged with that of so many words of its language, so that short texts aren't judged by chance.
PRIOR_WORDS = 10
#: Share of held-out trusted texts of a language that the threshold keeps, and the fewest for a threshold of its own.
KEEP, LEAST_HELD = 0.995, 50
#: What a count that is there loses at least.
LEAST_LOST = 0.05
#: Sums of bits are exact in this part of a bit.
FIXED = float(1 << 10)
META, COUNTS = 0, 1
LOW = np.uint64(IDS - 1)
ONE, TWO = np.uint64(BITS), np.uint64(2 * BITS)


def in_steps(texts: list[bytes]) -> Iterator[list[bytes]]:
    """A few texts at a time, of about STEP_BYTES."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < STEP_BYTES):
            size += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


class Words:
    """Texts as ids: the vocabulary as sorted hashes; unknown words by their shape."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray):
        self.hashes, self.ids = hashes, ids

    def in_steps(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """triples(), a few texts at a time, so that what only a step needs stays small; indexes in 32 bits."""
        i = 0
        for part in in_steps(texts):
            keys, index = self.triples(part)
            yield keys, (index + i).astype(np.uint32)
            i += len(part)

    def triples(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(packed trigrams, text index) of every word and end, given the two ids before it: middle, first, last id."""
        shapes: list[np.ndarray] = []
        found, counts = word_hashes(texts, fold=False, shapes=shapes)
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *shapes]).astype(np.uint64) + np.uint64(2)
        if len(self.hashes) and len(found):
            place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            known = self.hashes[place] == found
            ids[known] = self.ids[place[known]]
        n = counts + (counts > 0)  # texts without words have no end either
        last = np.full(int(n.sum()), END, dtype=np.uint64)
        ends = np.cumsum(n)[n > 0] - 1
        body = np.ones(len(last), dtype=bool)
        body[ends] = False
        last[body] = ids
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
        middle = np.concatenate([[BEGIN], last[:-1]]).astype(np.uint64)[: len(last)]
        middle[starts] = BEGIN
        first = np.concatenate([[BEGIN], middle[:-1]]).astype(np.uint64)[: len(last)]
        first[starts] = BEGIN
        return (middle << TWO) | (first << ONE) | last, np.repeat(np.arange(len(texts)), n)


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _counted_in_steps(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """_counted of all parts together; what waits is at most as long as what has been counted, or a few steps."""
    keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    waiting, size = [], 0
    for part in parts:
        waiting.append(_counted(part))
        size += len(waiting[-1][0])
        if size > max(len(keys), 1 << 19):
            keys, counts = _counted(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(n for _, n in waiting)]))
            waiting, size = [], 0
    return _counted(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(n for _, n in waiting)]))


def _slices(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            yield p, order[a:b]


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found = [unpacked(x.as_py(), "u8", "i8") for x in table["data"]]
    return _counted(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))


def _word_counts(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks_of(batches, BLOCK_BYTES):
            keys, counts = _counted_in_steps(word_hashes(part, fold=False)[0] for part in in_steps(texts))
            for p, own in _slices((keys >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64), shards):
                yield batch_of([(p, block, COUNTS, packed(keys[own], counts[own]))])

    return run


def _frequent_words(least: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _merge(table)
        keep = counts >= least
        return pa.table([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], names=["word", "n"])

    return run


def _trigram_counts(words: Words, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks_of(batches, BLOCK_BYTES):
            keys, counts = _counted_in_steps(words.triples(part)[0] for part in in_steps(texts))
            for p, own in _slices((mix(keys >> TWO) % np.uint64(shards)).astype(np.int64), shards):
                yield batch_of([(p, block, COUNTS, packed(keys[own], counts[own]))])

    return run


def _pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, last) of trigrams, packed, and the number of first ids each has: the continuation counts of bigrams."""
    return _counted(((keys >> TWO) << ONE) | (keys & LOW))


def _shard(folder: str):
    """A shard's trigram counts, written to a file of the folder, and what it adds to the model's totals."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _merge(table)
        pairs, before = _pairs(keys)
        last, each = _counted(pairs & LOW)
        of_counts = [np.count_nonzero(x == k) for x in (counts, before) for k in (1, 2, 3, 4)]
        part, name = table["part"][0].as_py(), attempt_name(f"shard-{table['part'][0].as_py()}", ".bin")
        store, where = opened(folder)
        store.create_dir(where, recursive=True)
        with store.open_output_stream(f"{where}/{name}", compression=None) as out:
            out.write(packed(keys, counts))
        return pa.table([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([packed(last, each)]), pa.array([[int(x) for x in (*of_counts, len(keys), len(pairs))]])], names=["part", "path", "lasts", "of_counts"])

    return run


def _loaded(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A shard's trigrams, ascending, and their counts."""
    store, where = opened(path)
    with store.open_input_file(where) as f:
        keys, counts = unpacked(f.read(), "u8", "i8")
    return keys, counts


def _summary(model: Model):
    """Of each shard what all tasks know: its part of the filter of pairs, the weight of single ids after its middles,
    and the bits of its most frequent trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = _loaded(path)
                known = Known(keys, counts, model)
                bits = np.zeros(model.segment, dtype=bool)
                for place in model.places(known.pairs):
                    bits[place] = True
                hot = np.sort(np.argsort(-counts, kind="stable")[: HOT_TRIGRAMS // model.shards + 1])
                cost = np.rint(-known.log_probabilities(keys[hot]) * FIXED).astype(np.int64)
                out = {"part": part, "bits": np.packbits(bits, bitorder="little").tobytes(), "middles": packed(known.middles), "rest": known.rest2.astype(np.float32).tobytes(), "hot": packed(keys[hot], cost)}
                yield pa.record_batch([pa.array([x]) for x in out.values()], names=list(out))

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2, 3 and more lose, by the numbers of n-grams with counts 1 to 4 (Chen and Goodman 1998).

    At least LEAST_LOST, so that lower orders always have some weight.
    """
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [k - (k + 1) * y * above / at if at and above else 0.5 * k for k, at, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, LEAST_LOST), k + 0.0) for x, k in zip(d, (1, 2, 3)))])


class Model:
    """What all scoring tasks share: discounts and the probabilities of single ids."""

    def __init__(self, of_counts: np.ndarray, lasts: np.ndarray, shards: int = SHARDS):
        self.trigram, self.bigram = discounts(of_counts[:4]), discounts(of_counts[4:8])
        unigram = discounts(np.array([np.count_nonzero(lasts == k) for k in (1, 2, 3, 4)]))
        total = max(1, int(lasts.sum()))
        lost = unigram[np.minimum(lasts, 3)]
        self.single = np.log2(np.maximum(lasts - lost, 0) / total + (lost.sum() / total if lasts.any() else 1.0) / (len(lasts) - 1)).astype(np.float32)
        self.single[NO_LAST] = 0.0  # the weight alone is asked for
        self.trigrams, pairs = (int(x) for x in of_counts[8:10])
        self.shards, self.segment = shards, 8 * (min(pairs * PAIR_BITS, FILTER_BYTES * 8) // (8 * shards) + 1)

    def places(self, pairs: np.ndarray) -> Iterator[np.ndarray]:
        """Two places of each pair in its shard's part of the filter."""
        h = mix(pairs)
        for half in (h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)):
            yield ((half * np.uint64(self.segment)) >> np.uint64(32)).astype(np.int64)


class Lookups:
    """What each task that reads texts knows: the vocabulary, and which positions need no lookup, or only a part of one.

    seen: the filter of pairs of ids that stand beside each other in the training text; rest: the weight of single ids
    after each middle id; hot: the most frequent trigrams, ascending, and their bits.
    """

    def __init__(self, words: Words, model: Model):
        self.words, self.model = words, model
        self.seen, self.rest = np.zeros(0, dtype=np.uint8), np.ones(len(model.single), dtype=np.float32)
        self.hot, self.hot_bits = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ids may follow each other in the training text; false only where they don't."""
        if not len(self.seen):
            return np.zeros(len(a), dtype=bool)
        base = (mix(a) % np.uint64(self.model.shards)).astype(np.int64) * self.model.segment
        out = np.ones(len(a), dtype=bool)
        for place in self.model.places((a << ONE) | b):
            place += base
            out &= (self.seen[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return out

    def asked(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a position must be looked up, its trigram without ids that change nothing, the rest of its bits).

        A first id that never stands before the middle one, and a last id that never follows it, leave what the model
        gives to lower orders: that of single ids is known here, and so is all where both are so, and all of a hot
        trigram.
        """
        middle, first, last = keys >> TWO, (keys >> ONE) & LOW, keys & LOW
        left, right = (middle == BEGIN) & bool(len(self.seen)) | self.together(first, middle), self.together(middle, last)
        bits = np.where(right, 0.0, -self.model.single[last.astype(np.int64)].astype(float))
        both = ~left & ~right
        bits[both] -= np.log2(self.rest[middle[both].astype(np.int64)].astype(float))
        whole = np.rint(bits * FIXED).astype(np.int64)
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
            hot = self.hot[place] == keys
            whole[hot] = self.hot_bits[place[hot]]
            both |= hot
        return ~both, (middle << TWO) | (np.where(left, first, np.uint64(NO_FIRST)) << ONE) | np.where(right, last, np.uint64(NO_LAST)), whole


class Tasks:
    """Which scoring tasks look up each middle id: those of many positions share them among several."""

    def __init__(self, parts: int, counts: dict[int, int], total: int, shards: int = SHARDS):
        self.parts, self.of_shards, self.often = parts, shards, np.array(sorted(counts), dtype=np.int64)
        self.shares = np.array([min(parts, -(-counts[i] * parts // max(1, total))) for i in sorted(counts)], dtype=np.uint32)

    def spread(self, middle: np.ndarray) -> np.ndarray:
        """How many tasks look up each middle id."""
        if not len(self.often):
            return np.ones(len(middle), dtype=np.uint32)
        place = np.minimum(np.searchsorted(self.often, middle), len(self.often) - 1)
        return np.where(self.often[place] == middle, self.shares[place], np.uint32(1))

    def start(self, middle: np.ndarray) -> np.ndarray:
        """The first of them; tasks are a multiple of the shards, so that it tells the shard too."""
        return (mix(middle.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)

    def of(self, middle: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return ((self.start(middle) + (turn % self.spread(middle)).astype(np.int64)) % self.parts).astype(np.int32)

    def serves(self, part: int, middle: np.ndarray) -> np.ndarray:
        """Whether a task looks up middle ids."""
        return (part - self.start(middle)) % self.parts < self.spread(middle)

    def shards(self, part: int) -> list[int]:
        """The shards that hold the middle ids of a task: one, and those of ids that others share with it."""
        more = self.start(self.often[self.serves(part, self.often)]) % self.of_shards
        return sorted({part % self.of_shards, *more.tolist()})


def _interpolate(counts: np.ndarray, context: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For n-grams sorted by context: (distinct contexts, their weight of lower orders, discounted shares, context index)."""
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    which = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(context)]])))
    total = np.add.reduceat(counts, first).astype(float)
    off = lost[np.minimum(counts, 3)]
    return context[first], np.add.reduceat(off, first) / total, np.maximum(counts - off, 0) / total[which], which


def _found(table: np.ndarray, keys: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), missing)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[place] == keys, values[place], missing)


class Known:
    """The counts of all trigrams with some middle ids, ready to be asked."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, model: Model):
        self.keys, self.model = keys, model
        if len(keys):
            self.pairs, before = _pairs(keys)
            self.middles, self.rest2, self.share2, _ = _interpolate(before, self.pairs >> ONE, model.bigram)
            self.contexts, self.rest3, self.share3, _ = _interpolate(counts, keys >> ONE, model.trigram)

    def log_probabilities(self, asked: np.ndarray) -> np.ndarray:
        """log2 p of ascending distinct trigrams."""
        last = asked & LOW
        p = np.exp2(self.model.single[last.astype(np.int64)].astype(float))
        if len(self.keys):
            middle = asked >> TWO
            p = _found(self.pairs, (middle << ONE) | last, self.share2, 0.0) + _found(self.middles, middle, self.rest2, 1.0) * p
            p = _found(self.keys, asked, self.share3, 0.0) + _found(self.contexts, asked >> ONE, self.rest3, 1.0) * p
        return np.log2(p)


def _packed_positions(keys: np.ndarray, docs: np.ndarray) -> bytes:
    """Trigrams and their texts (ascending), ordered by middle and first id, as columns that pack well."""
    order = np.argsort(keys >> ONE, kind="stable")
    keys = keys[order]
    middle, first, last = ((x & LOW).astype(np.uint32) for x in (keys >> TWO, keys >> ONE, keys))
    return packed(np.diff(middle, prepend=np.uint32(0)), np.diff(first, prepend=np.uint32(0)), last, docs[order])


def _unpacked_positions(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    middle, first, last, docs = unpacked(data, "u4", "u4", "u4", "u4")
    wide = lambda x: np.cumsum(x, dtype=np.uint32).astype(np.uint64)
    return (wide(middle) << TWO) | (wide(first) << ONE) | last.astype(np.uint64), docs


def _middles(shared, parts: int):
    """(id, positions) of the middle ids that have more than a small part of a scoring task's share; id null: of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = shared.value
        counts = np.zeros(len(lookups.rest), dtype=np.int64)
        for _, _, texts in blocks_of(batches, BLOCK_BYTES):
            for keys, _ in lookups.words.in_steps(texts):
                sent, _, _ = lookups.asked(keys)
                counts += np.bincount((keys[sent] >> TWO).astype(np.int64), minlength=len(counts))
        total = int(counts.sum())
        ids = np.flatnonzero(counts * (4 * parts) > total)
        yield pa.record_batch([pa.array([*ids.tolist(), None], pa.int64()), pa.array([*counts[ids].tolist(), total], pa.int64())], names=["id", "n"])

    return run


def _positions(shared, tasks: Tasks, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        lookups = shared.value
        for block, columns, texts in blocks_of(batches, size):
            turn = spread(block)
            length, local, found = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), []
            for keys, docs in lookups.words.in_steps(texts):
                length += np.bincount(docs, minlength=len(texts))
                sent, trimmed, bits = lookups.asked(keys)
                np.add.at(local, docs, bits)
                found.append((trimmed[sent], docs[sent]))
            keys, docs = (np.concatenate([np.zeros(0, dtype=k), *(x[i] for x in found)]) for i, k in enumerate(("u8", "u4")))
            del found
            yield batch_of([(turn % tasks.parts, block, META, pickle.dumps((columns, length.tolist(), local.tolist())))])
            part, rows = tasks.of((keys >> TWO).astype(np.int64), docs + np.uint32(turn & 0xFFFF)), []
            for p, own in _slices(part, tasks.parts):
                rows.append((p, block, COUNTS, _packed_positions(keys[own], docs[own])))
                if len(rows) == 64:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    return run


def _known(part: int, paths: list[str | None], tasks: Tasks, model: Model) -> Known:
    """A task's part of the model, from the files of the shards."""
    keys, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for shard in tasks.shards(part):
        if paths[shard]:
            k, n = _loaded(paths[shard])
            own = tasks.serves(part, (k >> TWO).astype(np.int64))
            keys.append(k[own])
            counts.append(n[own])
    return Known(*_counted(np.concatenate(keys), np.concatenate(counts)), model)


def _score(paths: list[str | None], tasks: Tasks, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            rows = []
            for part, block, kind, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "kind")), batch.column("data")):
                if kind == META:
                    rows.append((0, block, META, data.as_py()))
                    continue
                known = known or _known(part, paths, tasks, model)
                asked, docs = _unpacked_positions(data.as_py())
                distinct, inverse = np.unique(asked, return_inverse=True)
                sums = np.zeros(int(docs.max()) + 1, dtype=np.int64)
                np.add.at(sums, docs, np.rint(-known.log_probabilities(distinct) * FIXED).astype(np.int64)[inverse])
                own = np.flatnonzero(sums)
                rows.append((0, block, COUNTS, packed(own.astype(np.uint64), sums[own])))
            yield batch_of(rows)

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from freeing(run)(batches)

    of_group.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return of_group


def _gather(table: pa.Table) -> pa.Table:
    """A block's documents with all their surprise, in bits."""
    import pickle

    columns = n = local = None
    found = []
    for kind, data in zip(table["kind"].to_pylist(), table["data"]):
        if kind == META:
            columns, n, local = pickle.loads(data.as_py())
        else:
            found.append(unpacked(data.as_py(), "u8", "i8"))
    sums = np.array(local, dtype=np.int64)
    for docs, bits in found:
        sums[docs.astype(np.int64)] += bits
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(n, pa.int64()), pa.array(sums / FIXED)], names=["doc_id", "lang", "row", "n_tokens", "bits"])


def learn(trusted: DataFrame, folder: str, least_count: int = LEAST_COUNT) -> tuple[Lookups, list[str | None]]:
    """The vocabulary and what all tasks know of the model, and the files of its shards, from a column `text` (binary).

    The driver gets what ids bound: the vocabulary, 16 bytes a word, and for each shard, one after another, the counts of
    single ids, their weights, a part of the filter of known pairs and of the hot trigrams.
    """
    size = trusted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(SHARDS, 1 << (-(-size // SHARD_BYTES) - 1).bit_length())
    top = cut(trusted.mapInArrow(freeing(_word_counts(number)), SCHEMA).groupBy("part").applyInArrow(freeing_group(_frequent_words(least_count)), "word long, n long"))
    if top.count() > IDS - FIRST_WORD:
        of_count, words = top.groupBy("n").count().orderBy(F.desc("n")).toArrow(), 0
        for n, k in zip(of_count["n"].to_pylist(), of_count["count"].to_pylist()):
            if (words := words + k) > IDS - FIRST_WORD:
                top = top.where(F.col("n") > n)
                break
    top = top.toArrow()
    hashes, often = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    ranked = hashes[np.lexsort((hashes, -often))]
    order = np.argsort(ranked)
    words = Words(ranked[order], (order + FIRST_WORD).astype(np.uint32))
    shards = cut(trusted.mapInArrow(freeing(_trigram_counts(words, number)), SCHEMA).groupBy("part").applyInArrow(freeing_group(_shard(folder)), "part long, path string, lasts binary, of_counts array<long>"))
    lasts, of_counts = np.zeros(FIRST_WORD + len(hashes), dtype=np.int64), np.zeros(10, dtype=np.int64)
    paths: list[str | None] = [None] * number
    for r in shards.toLocalIterator():  # a row a shard, IDS numbers each at most
        paths[r.part] = r.path
        ids, n = unpacked(bytes(r.lasts), "u8", "i8")
        lasts[ids.astype(np.int64)] += n
        of_counts += np.array(r.of_counts)
    lookups = Lookups(words, model := Model(of_counts, lasts, number))
    if lasts.any():
        seen, hot = np.zeros((number, model.segment // 8), dtype=np.uint8), []
        for r in shards.select("part", "path").mapInArrow(freeing(_summary(model)), "part long, bits binary, middles binary, rest binary, hot binary").toLocalIterator():
            seen[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
            lookups.rest[unpacked(bytes(r.middles), "u8")[0].astype(np.int64)] = np.frombuffer(r.rest, dtype=np.float32)
            hot.append(unpacked(bytes(r.hot), "u8", "i8"))
        keys, bits = (np.concatenate([x[i] for x in hot]) for i in (0, 1))
        order = np.argsort(keys)
        lookups.seen, lookups.hot, lookups.hot_bits = seen.reshape(-1), keys[order], bits[order].astype(np.int32)
    return lookups, paths


def surprise(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", row_col: str | None = None, least_count: int = LEAST_COUNT) -> DataFrame:
    """(doc_id, lang, row, n_tokens, bits) of each document: -log2 of its probability by the model of train's texts.

    Words are compared as they are; those seen least_count times in the training text are ids, others count by their
    shape. Trigram counts are sharded by the middle word, on which all orders of a trigram's interpolation depend; each
    document sends its trigrams to the shards of their middle words, but not what no training text holds: ids that never
    stand beside the middle one change nothing (a filter of known pairs, broadcast, tells most of them); and of single
    ids and of the HOT_TRIGRAMS most frequent trigrams every task knows the probabilities, as the shards give them. Middle words that the scored texts have often, whatever the training text
    has, share their positions among several tasks; a task reads its part of the model from the files of the shards and
    takes positions one block after another. All counts, and all sums of a document, are exact whatever the order. A text without words has no
    tokens and 0 bits. row_col, a long, goes along as `row`.
    """
    spark = docs.sparkSession
    body = F.col(text_col).cast("binary").alias("text")
    folder = scratch(spark, "model")
    lookups, paths = learn(train.select(body), folder, least_count)
    model, shared = lookups.model, spark.sparkContext.broadcast(lookups)
    row = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), row.alias("row"), body)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(pieces(spark, total, TASK_BYTES, 1 << 20), model.trigrams // TASK_TRIGRAMS + 1)
    parts = -(-parts // model.shards) * model.shards
    counted = cut(texts.select("text").mapInArrow(freeing(_middles(shared, parts)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))
    positions = counted.where("id is null").agg(F.sum("n")).first()[0] or 0
    often = {r.id: r.n for r in counted.where("id is not null").where(F.col("n") * parts > positions).collect()}  # below `parts` rows
    tasks = Tasks(parts, often, positions, model.shards)
    asked = texts.mapInArrow(freeing(_positions(shared, tasks, block_bytes(total))), SCHEMA)
    scored = asked.groupBy("part").applyInArrow(_score(paths, tasks, model), SCHEMA)
    out = cut(scored.groupBy("block").applyInArrow(freeing_group(_gather), "doc_id long, lang string, row long, n_tokens long, bits double"))
    shared.destroy()
    remove(spark, folder)
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: float = KEEP, train_docs: int | None = None, least_count: int = LEAST_COUNT, row_col: str | None = None) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, accepted) of every row; with row_col, a long, that as `row` too.

    Trusted are documents labelled quality 1 and not toxic. All but one in HELD_OUT of them train the model (with
    train_docs, which no query sets, of the first so many by a hash of the id alone); the quantile `keep` of the perplexities of all others is their language's threshold
    (a language with fewer than LEAST_HELD takes that of all; without any there is no threshold and all are
    accepted). Perplexity is per word and end, mixed with PRIOR_WORDS words at the held-out mean of the language.
    Texts without words, null or empty, have no perplexity and are rejected. A null language is one of its own; rows
    of a null id are judged like others and never trusted. Repeated rows are judged alike.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    good, learned_id = cut(good), fresh(docs, "learned")[0]
    held = F.pmod(F.xxhash64(F.lit(7), F.col("__id")), F.lit(HELD_OUT)) == 0
    learned, others = good.where(~held), good.where(held)
    if train_docs is not None:
        learned = cut(good.orderBy(F.xxhash64("__id"), "__id").limit(train_docs).where(~held))
        others = good.join(learned, "__id", "left_anti")
    learned, others = cut(learned.withColumnRenamed("__id", learned_id)), cut(others)
    train = bloom.only(docs, id_col, learned)
    scored = surprise(docs, train, id_col, text_col, lang_col, row_col, least_count)
    known = scored.join(small(others, 16), F.col("doc_id") == F.col("__id"), "left_semi").where("n_tokens > 0")
    means = cut(known.groupBy("lang").agg((F.sum(F.round("bits", 3).cast("decimal(38,3)")).cast("double") / F.sum("n_tokens")).alias("mean"), F.count("*").alias("held")))
    whole = known.agg((F.sum(F.round("bits", 3).cast("decimal(38,3)")).cast("double") / F.sum("n_tokens")).alias("mean")).first()[0]
    row_bytes = F.coalesce(F.octet_length("l"), F.lit(0)) + 100
    by_lang = means.withColumnRenamed("lang", "l")

    def perplexity(df: DataFrame) -> DataFrame:
        joined = df.join(small_by_bytes(by_lang, row_bytes), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
        mean = F.coalesce(F.when(F.col("held") >= LEAST_HELD, F.col("mean")), F.lit(whole), F.lit(0.0))
        value = F.pow(F.lit(2.0), (F.col("bits") + PRIOR_WORDS * mean) / (F.col("n_tokens") + PRIOR_WORDS))
        return joined.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.round(value, 4))).drop("mean")

    ruled = cut(perplexity(known))
    quantile = F.percentile_approx("perplexity", keep, 100_000)
    limits = cut(ruled.where(F.col("held") >= LEAST_HELD).groupBy("lang").agg(quantile.alias("limit")).withColumnRenamed("lang", "l"))
    pooled = ruled.agg(quantile).first()[0]
    judged = perplexity(scored).join(small_by_bytes(limits, row_bytes), F.col("lang").eqNullSafe(F.col("l")), "left")
    threshold = F.coalesce(F.col("limit"), F.lit(pooled).cast("double"))
    return judged.select("doc_id", *["row"][: row_col is not None], "lang", "n_tokens", "perplexity", threshold.alias("threshold"), (F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))).alias("accepted"))
