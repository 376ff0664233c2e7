"""N-gram Jaccard join: globally ordered shingle sets, a prefix filter, and tries that prune by remaining length."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsledger.llm import bloom
from opsledger.llm.blocks import SCHEMA, batch_of, block_bytes, blocks_of, packed, spread, unpacked
from opsledger.llm.common import connected_components, cut, freeing, freeing_group, fresh, lower_az, pieces, small
from opsledger.llm.shingle_trie import cross_links, self_links
from opsledger.llm.wordhash import shingle_sets

#: Text bytes of a range of the hashes (their shingles are what a task holds); those of a block are block_bytes().
RANGE_BYTES = 12 << 20
#: Documents of a block that make a shingle frequent; it then needs no counting: it comes last in the order.
FREQUENT, FREQUENT_CLASS = 64, 255
#: Tokens that one trie task stores, and what a document weighs besides its tokens.
TASK_TOKENS, DOC_WEIGHT = 32_000, 64
#: What a token costs that goes to the task of a prefix shingle, against one that goes to a pair of blocks.
COPY_COST = 1.0
POSTINGS, META = 0, 1
SETS = "doc_id long, h1 long, h2 long, n long, k1 long, k2 long, prefix array<long>, tokens binary"


def _block_rows(block: int, ids: list, marks: list[list], texts: list[bytes], ranges: int) -> Iterator[pa.RecordBatch]:
    """What a block of documents sends: its shingles to their hash ranges, and what only it needs back, on any range."""
    sets = shingle_sets(texts)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    digests = b"".join(blake2b(x.tobytes(), digest_size=16).digest() for x in sets)
    names = np.array([0 if k is None else k for k in ids], dtype=np.int64)
    absent = np.array([k is None for k in ids], dtype=np.uint8)
    meta = packed(names.view(np.int64), absent, sizes, *(np.array(x, dtype=np.int64) for x in marks)) + digests
    tokens = np.concatenate(sets)
    docs = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate([first, [len(tokens)]]))
    often = counts >= FREQUENT
    hot = np.repeat(often, counts)
    yield batch_of([(spread(block) % ranges, block, META, np.int64(len(meta)).tobytes() + meta + packed(tokens[hot], docs[hot]))])
    keep = ~hot
    keep[first[often]] = True  # one entry says that the shingle is frequent here
    tokens, docs = tokens[keep], np.where(hot[keep], np.uint32(0xFFFFFFFF), docs[keep])
    part = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    edges = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
    rows = [(r, block, POSTINGS, packed(tokens[a:b], docs[a:b])) for r, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    for i in range(0, len(rows), 256):
        yield batch_of(rows[i : i + 256])


def _to_ranges(ranges: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, columns, texts in blocks_of(batches, size):
            yield from _block_rows(block, columns[0], columns[1:], texts, ranges)

    return run


def _share(table: pa.Table) -> pa.Table:
    """Of a range's shingles, those of two documents or more go back to their blocks with their class."""
    rows, tokens, docs, blocks = [], [], [], []
    for block, kind, data in zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["data"]):
        if kind == META:
            rows.append((0, block, META, data.as_py()))
        else:
            t, d = unpacked(data.as_py(), "u8", "u4")
            tokens.append(t)
            docs.append(d)
            blocks.append(np.full(len(t), block, dtype=np.int64))
    del table
    if tokens:
        t, d, b = map(np.concatenate, (tokens, docs, blocks))
        tokens, docs, blocks = [], [], []
        order = np.argsort(t, kind="stable")
        t, d, b = t[order], d[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        counts = np.diff(np.concatenate([first, [len(t)]]))
        flagged = np.logical_or.reduceat(d == 0xFFFFFFFF, first)
        kind = np.minimum(FREQUENT_CLASS - 1, np.floor(8 * np.log2(counts))).astype(np.uint8)
        kind[flagged] = FREQUENT_CLASS
        shared = np.repeat((counts > 1) | flagged, counts) & (d != 0xFFFFFFFF)
        t, d, b, c = t[shared], d[shared], b[shared], np.repeat(kind, counts)[shared]
        order = np.argsort(b, kind="stable")
        t, d, b, c = t[order], d[order], b[order], c[order]
        own, at = np.unique(b, return_index=True)
        for k, a, z in zip(own.tolist(), at, [*at[1:], len(b)]):
            rows.append((0, k, POSTINGS, packed(t[a:z], d[a:z], c[a:z])))
    return pa.Table.from_batches([batch_of(rows)])


def _collect(table: pa.Table) -> pa.Table:
    """A block's documents with their shared shingles in the global order, and the part of them in the prefix."""
    names = absent = sizes = h1 = h2 = digests = None
    tokens, docs, kinds = [], [], []
    for kind, data in zip(table["kind"].to_pylist(), table["data"]):
        data = data.as_py()
        if kind == META:
            n = int(np.frombuffer(data, np.int64, 1)[0])
            meta = data[8 : 8 + n]
            hot, where = unpacked(data[8 + n :], "u8", "u4")
            names, absent, sizes, h1, h2 = unpacked(meta, "i8", "u1", "i8", "i8", "i8")
            digests = np.frombuffer(meta[len(meta) - 16 * len(names) :], dtype="<i8").reshape(-1, 2)
            tokens.append(hot)
            docs.append(where)
            kinds.append(np.full(len(hot), FREQUENT_CLASS, dtype=np.uint8))
        else:
            t, d, c = unpacked(data, "u8", "u4", "u1")
            tokens.append(t)
            docs.append(d)
            kinds.append(c)
    t, d, c = map(np.concatenate, (tokens, docs, kinds))
    ordered = (c.astype(np.uint64) << np.uint64(56)) | (t >> np.uint64(8))
    order = np.lexsort((ordered, d))
    ordered, d = ordered[order], d[order]
    edges = np.searchsorted(d, np.arange(len(names) + 1))
    prefixes, sets = [], []
    for size, a, b in zip(sizes.tolist(), edges.tolist(), edges[1:].tolist()):
        length = size - -(-4 * size // 5) + 1 - (size - (b - a))  # shingles of one document alone come first
        if length > 0 and b > a:
            prefixes.append(ordered[a : a + length].view(np.int64))
            sets.append(ordered[a:b].tobytes())
        else:
            prefixes.append(ordered[:0].view(np.int64))
            sets.append(None)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]), pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
    return pa.table([pa.array(names, mask=absent.astype(bool)), pa.array(h1), pa.array(h2), pa.array(sizes), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), lists, pa.array(sets, pa.binary())], names=["doc_id", "h1", "h2", "n", "k1", "k2", "prefix", "tokens"])


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, text): two 64-bit hashes of each text, lower case in A-Z, tell equal ones."""
    lower = lower_az(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    hashes = F.xxhash64(lower).alias("h1"), F.xxhash64(F.lit(5), lower).alias("h2")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *hashes, F.col(text_col).cast("binary").alias("text"))


def _first_copies(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """texts without most rows that aren't the first of their group: a Bloom filter of the first ones decides."""
    may, = fresh(texts, "may")
    n = bloom.pieces_for(groups.count())
    first = bloom.once(bloom.spots(groups, F.xxhash64("h1", "h2", "keep"), n))
    return bloom.tested(bloom.spots(texts, F.xxhash64("h1", "h2", "doc_id"), n), first, may).where(may).drop(may)


def ordered_sets(texts: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, k1, k2, prefix, tokens) of each row of _marked(): its set's size and digest, and where it may link at all,
    the shingles that other documents have too, in the global order: by frequency class, then by hash.

    Blocks of documents send each shingle once to its hash range, which counts its documents; those of one document
    are dropped, as they can be in no overlap (they still count in sizes, and come first in prefixes); the others go
    back. A shingle of FREQUENT documents of one block is the most frequent class everywhere and sends one entry, so a
    hot shingle costs its range no more than a row a block.
    """
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = block_bytes(total)
    ranges = pieces(spark, total, max(RANGE_BYTES, size), 1 << 20)
    sent = texts.mapInArrow(freeing(_to_ranges(ranges, size)), SCHEMA)
    shared = sent.groupBy("part").applyInArrow(freeing_group(_share), SCHEMA)
    return cut(shared.groupBy("block").applyInArrow(freeing_group(_collect), SETS))


def _sets(table: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    return [(k, n, np.frombuffer(t, dtype=np.uint64)) for k, n, t in zip(table["doc_id"].to_pylist(), table["n"].to_pylist(), table["tokens"].to_pylist())]


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["src", "dst"])


def _within(table: pa.Table) -> pa.Table:
    """Links within each candidate component of a task."""
    order = np.argsort(table["comp"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    comps = table["comp"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], comps[1:] != comps[:-1]])).tolist()
    return _links([p for a, b in zip(starts, [*starts[1:], len(comps)]) for p in self_links(_sets(table.slice(a, b - a)))])


def _between(table: pa.Table) -> pa.Table:
    """Links between the stored and the probing documents of one task; one may be both."""
    stored, probing = (table[c].to_numpy(zero_copy_only=False) for c in ("stored", "probing"))
    return _links(cross_links(_sets(table.filter(pa.array(stored))), _sets(table.filter(pa.array(probing)))))


LINKS = "src long, dst long"


def _weight() -> Column:
    """What a document weighs, in tokens."""
    return (F.octet_length("tokens") / 8 + DOC_WEIGHT).cast("long")


def similar_links(sets: DataFrame, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(src, dst) that connect all sets which chains of links connect; sets of distinct digest, as ordered_sets gives.

    Sets that share a prefix shingle are candidates; chains of candidates form components. A component of up to
    task_tokens tokens is one trie's work. In a larger one, first a part of it is stored in one trie and probed by all,
    which joins what copies it mostly consists of; what is then outside the largest group found is open. Open documents
    meet all others of their component in pairs of blocks, as long as that moves fewer tokens than the other way, by
    which tokens moved grow with the documents and not with the component: every document goes to the tasks of its
    prefix shingles, and a shingle's documents meet in one task, or, if it is hot, in blocks of the shingle's own. Tasks
    return no more links than connect their documents.
    """
    spark = sets.sparkSession
    near = sets.where(F.size("prefix") > 0).where("doc_id is not null")
    prefix = near.select("doc_id", F.explode("prefix").alias("token"))
    hubs = prefix.groupBy("token").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("far")).where("hub <> far").drop("far")
    chains = prefix.join(hubs, "token").where("doc_id <> hub").select("doc_id", "hub").distinct()
    members = connected_components(chains, "doc_id", "hub").withColumnsRenamed({"node": "doc_id", "component": "comp"})
    placed = cut(near.select("doc_id", "n", "k1", "k2", F.size("prefix").alias("p"), "tokens").join(members, "doc_id"))
    weights = cut(placed.groupBy("comp").agg(F.sum(_weight()).alias("weight")))
    large = cut(weights.where(F.col("weight") > task_tokens))
    tasks = pieces(spark, weights.agg(F.sum("weight")).first()[0] or 0, task_tokens, task_tokens // 8 + 1)
    few = placed.join(small(large.select("comp"), 16), "comp", "left_anti").withColumn("task", F.pmod(F.xxhash64("comp"), F.lit(tasks)))
    links = few.select("comp", "task", "doc_id", "n", "tokens").groupBy("task").applyInArrow(freeing_group(_within), LINKS)
    if not large.limit(1).count():
        return cut(links)
    many = placed.join(small(large, 32), "comp").withColumn("blocks", F.ceil(F.col("weight") / task_tokens).cast("long"))
    links = cut(links.unionByName(_probe_leaders(many)))
    return cut(links.unionByName(_join_open(many.drop("weight", "blocks"), near, links, task_tokens)))


def _probe_leaders(many: DataFrame) -> DataFrame:
    """Links of a block of each component, the leaders, with all its documents: leaders go to each block of probes."""
    dealt = many.withColumn("at", F.pmod(F.xxhash64("doc_id", "k1"), F.col("blocks")))
    cols = ["comp", "j", "doc_id", "n", "tokens", "stored", "probing"]
    leaders = dealt.where("at = 0").withColumns({"j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "stored": F.lit(True), "probing": F.lit(False)})
    probes = dealt.withColumns({"j": F.col("at"), "stored": F.lit(False), "probing": F.lit(True)})
    return leaders.select(*cols).unionByName(probes.select(*cols)).groupBy("comp", "j").applyInArrow(freeing_group(_between), LINKS)


def _paired(rows: DataFrame, by: str) -> DataFrame:
    """Rows of (by, i, j): each stored block i, of open documents, with each probing block j, by replicating rows."""
    at, each = lambda n: F.pmod(F.xxhash64("doc_id", "k1"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = [by, "i", "j", "doc_id", "k1", "k2"]
    stored = rows.where("open").withColumn("i", at("open_blocks")).withColumn("j", each("all_blocks")).select(*cols, F.lit(True).alias("stored"), F.lit(False).alias("probing"))
    probes = rows.withColumn("j", at("all_blocks")).withColumn("i", each("open_blocks")).select(*cols, F.lit(False).alias("stored"), F.lit(True).alias("probing"))
    return stored.unionByName(probes)


def _join_open(many: DataFrame, sets: DataFrame, links: DataFrame, task_tokens: int) -> DataFrame:
    """Links of the documents outside each component's largest group with all of it that they may link with."""
    spark, key = many.sparkSession, ["doc_id", "k1", "k2"]
    groups = connected_components(links, "src", "dst").withColumnsRenamed({"node": "doc_id", "component": "grp"})
    known = cut(many.select("comp", *key, "p", _weight().alias("w")).join(groups, "doc_id", "left").withColumn("grp", F.coalesce("grp", "doc_id")))
    most = known.groupBy("comp", "grp").agg(F.count("*").alias("size")).groupBy("comp").agg(F.max(F.struct("size", "grp")).alias("best")).select("comp", F.col("best.grp").alias("best"))
    known = known.join(small(cut(most), 40), "comp").withColumn("open", F.col("grp") != F.col("best")).drop("grp", "best")
    opened, blocks = F.sum(F.when(F.col("open"), F.col("w")).otherwise(0)), lambda w: F.ceil(F.col(w) / task_tokens).cast("long")
    sums = known.groupBy("comp").agg(opened.alias("open_w"), F.sum("w").alias("all_w"), F.sum(F.col("p") * F.col("w")).alias("copies_w")).where("open_w > 0")
    sums = sums.withColumns({"open_blocks": blocks("open_w"), "all_blocks": blocks("all_w")})
    sums = cut(sums.withColumn("in_pairs", F.col("open_blocks") * F.col("all_w") + F.col("all_blocks") * F.col("open_w") <= COPY_COST * F.col("copies_w")))
    found = None
    if sums.where("in_pairs").limit(1).count():
        found = _paired(known.join(small(sums.where("in_pairs").select("comp", "open_blocks", "all_blocks"), 40), "comp"), "comp")
        found = found.join(many.select(*key, "n", "tokens"), key).groupBy("comp", "i", "j").applyInArrow(freeing_group(_between), LINKS)
    if not sums.where("not in_pairs").limit(1).count():
        return links.limit(0) if found is None else found
    wide = cut(known.join(small(sums.where("not in_pairs").select("comp"), 16), "comp").select(*key, "w", "open"))
    posts = cut(wide.join(sets.select(*key, F.explode("prefix").alias("token")), key))
    met = posts.groupBy("token").agg(F.count("*").alias("docs"), F.sum("w").alias("all_w"), opened.alias("open_w")).where("docs > 1 and open_w > 0")
    met = cut(met.select("token", "all_w", blocks("open_w").alias("open_blocks"), blocks("all_w").alias("all_blocks")))
    cold, hot = met.where("all_blocks = 1"), met.where("all_blocks > 1")
    tasks = pieces(spark, cold.agg(F.sum("all_w")).first()[0] or 0, task_tokens, task_tokens // 8 + 1)
    dealt = posts.join(small(cold, 40), "token").select(*key, F.col("open").alias("stored"), F.lit(True).alias("probing"), F.pmod(F.xxhash64("token"), F.lit(tasks)).alias("task")).distinct()
    cold_links = dealt.join(many.select(*key, "n", "tokens"), key).groupBy("task").applyInArrow(freeing_group(_between), LINKS)
    found = cold_links if found is None else found.unionByName(cold_links)
    if not hot.limit(1).count():
        return found
    pairs = _paired(posts.join(small(hot, 40), "token"), "token").join(many.select(*key, "n", "tokens"), key)
    return found.unionByName(pairs.groupBy("token", "i", "j").applyInArrow(freeing_group(_between), LINKS))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A document's set: the distinct shingles of five words, lower case in A-Z; of fewer words the whole sequence; none
    of an empty or null text. Documents link when 100 * overlap >= 80 * union; component_id is the smallest doc_id
    that chains of links reach, itself included. Equal sets are one set for the join and link by their digest of 128
    bits; shingles are 64-bit hashes (56 bits order a set), so that two different documents are misjudged with a chance
    of about 1e-11. Rows of equal id are one document with several sets; rows of null id have no links and a null
    component. Of equal texts (by 128 bits) only the row of the smallest id sends its shingles, so that copies take no
    disk; the others have its size and link with it. Neither copies nor near copies are ever paired one by one.
    """
    texts = _marked(docs, id_col, text_col)
    rows = cut(texts.drop("text"))
    groups = cut(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.count("*").alias("rows")))
    twins = cut(groups.where("rows > 1").drop("rows"))
    later = cut(rows.join(small(twins, 40), ["h1", "h2"]).where("not doc_id <=> keep"))
    repeated = later.limit(1).count() > 0
    sets = ordered_sets(_first_copies(texts, groups) if repeated else texts)
    if repeated:  # the filter may let some later copies through
        sets = sets.join(small(twins, 40), ["h1", "h2"], "left").where("keep is null or doc_id <=> keep").drop("keep")
    named = sets.where("n > 0 and doc_id is not null").select("doc_id", "n", "k1", "k2")
    copies = cut(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("far")).where("rep <> far").drop("far"))
    equal = cut(named.join(small(copies, 40), ["k1", "k2"]).where("doc_id <> rep").select("doc_id", "k1", "k2", "rep"))
    links = similar_links(sets.join(small(equal.drop("rep").distinct(), 40), ["doc_id", "k1", "k2"], "left_anti"), task_tokens)
    links = links.unionByName(equal.select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")))
    sizes = sets.select("doc_id", "n")
    if repeated:
        n_of = cut(sets.join(small(twins.select("h1", "h2"), 32), ["h1", "h2"], "left_semi").select("h1", "h2", "n").distinct())
        again = later.join(small(n_of, 40), ["h1", "h2"]).select("doc_id", "keep", "n")
        links = links.unionByName(again.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("src"), F.col("keep").alias("dst")))
        sizes = sizes.unionByName(again.select("doc_id", "n"))
    parts = connected_components(links, "src", "dst")
    joined = sizes.join(parts, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
