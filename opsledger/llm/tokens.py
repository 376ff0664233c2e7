"""Token ids in Parquet: list columns with chosen encodings, row groups and page indexes, read selectively."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsledger.llm.common import cut, fits_broadcast, freeing, scratch, small_batches

END_ID = 1
#: Bytes of a row group and of a page before compression, and documents and text bytes of a shard on average, at most.
GROUP_BYTES, PAGE_BYTES, SHARD_DOCS, SHARD_BYTES = 32 << 20, 256 << 10, 8192, 64 << 20
#: Bytes of the runs whose ids a worker remembers, in each of two generations, what a run takes besides its characters
#: and ids, and characters that are encoded at once.
REMEMBERED_BYTES, RUN_BYTES, AT_ONCE = 16 << 20, 170, 2 << 20
#: One text in so many, by a hash, is also encoded whole, and must give the same ids.
PROOF = 256


#: A mark that follows a letter or digit of Latin-1, and words of small Latin letters.
MARKS = ".,!?;:%&*#$"
NEXT_MARK = re.compile(f"[{re.escape(MARKS)}](?<=[0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff].)")
LATIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def latin(text: str) -> bool:
    """Whether all characters are of Latin-1, whose small letters are of Latin-1 too, each alone."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


END = packed([END_ID])


class Encoder(dict):
    """Ids of whole texts by a tokenizer file, as bytes by run: a run of other than blanks and line feeds, encoded once.

    White space separates the pieces that the tokenizer's pattern makes, so a text's ids are those of its runs, put
    together. This and three shorter ways (marks apart from the letters and digits before them, texts of Latin-1 in small
    letters, plain words by the model alone) hold for tokenizers that drop white space; each is probed when one is loaded, and not taken where it fails; and one text in PROOF, by its
    hash, is encoded whole as well, which raises an error where it differs. Texts that may hold a special token (with
    "<|") are encoded whole. Of two generations of runs, each of REMEMBERED_BYTES, the older goes when the younger is
    full.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.old, self.size = Tokenizer.from_file(path), {}, 0
        self.model = self.tokenizer.model
        probe = "The end.\n\n it's 12 naïve—Ünïcode,  words"
        self.by_runs = [i for x in probe.replace("\n", " ").split(" ") if x for i in self.whole(x)] == self.whole(probe)
        latin_probe = "".join(map(chr, [*range(33, 127), *range(161, 256)]))
        self.caseless = self.whole(latin_probe) == self.whole(latin_probe.lower())
        self.apart = all(self.whole(x) == [i for run in NEXT_MARK.sub(r" \g<0>", x).split(" ") for i in self.whole(run)] for x in ("word7.,", "n\xe4.x", "".join(f"a{x}9{x}{x}\xe9" for x in MARKS)))
        # Words of small Latin letters are one piece of the pattern, so the model alone can give their ids.
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {i: bytes_of(chr(i))[0][0] for i in range(0xDF, 0x100) if i != 0xF7}
        words = ["word", "n\xe4here", "\xe9t\xe9", "".join(map(chr, self.letters))]
        self.plain = all(self.whole(x) == self.model_ids(x) for x in words)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def model_ids(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = packed(self.model_ids(run) if self.plain and LATIN.fullmatch(run) else self.whole(run))
        size = RUN_BYTES + len(run) + len(ids)
        if size > REMEMBERED_BYTES >> 4:
            return ids
        if self.size + size > REMEMBERED_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        self[run], self.size = ids, self.size + size
        return ids

    def ids(self, text: str) -> bytes:
        """A text's ids and END_ID, as little-endian int32."""
        if not self.by_runs or "<|" in text:
            return packed([*self.whole(text), END_ID])
        body = text.lower() if self.caseless and latin(text) else text
        if self.apart:
            body = NEXT_MARK.sub(r" \g<0>", body)
        ids = b"".join(map(self.__getitem__, body.replace("\n", " ").split(" "))) + END
        if zlib.crc32(text[:64].encode("utf-8", "surrogatepass"), len(text)) % PROOF == 0 and ids != packed([*self.whole(text), END_ID]):
            raise ValueError("this tokenizer's ids of a text are not those of its runs")
        return ids


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = Encoder(path)  # of this task alone: it goes with it
        pos = at = 0
        for batch in batches:
            ids, texts, shards = batch.column(0), batch.column(1), batch.column(2)
            i = 0
            while i < batch.num_rows:
                some, chars, j = [], 0, i
                while j < batch.num_rows and (not some or chars < AT_ONCE):
                    some.append(texts[j].as_py() or "")
                    chars += len(some[-1])
                    j += 1
                found = [encoder.ids(x) for x in some]
                n = np.array([len(x) // 4 for x in found], dtype=np.int64)
                starts = at + np.concatenate([[0], np.cumsum(n)[:-1]])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                yield pa.record_batch([ids.slice(i, j - i), shards.slice(i, j - i), pa.array(np.arange(pos, pos + j - i)), pa.array(starts), pa.array(n), tokens], names=["doc_id", "shard", "pos", "shard_start", "n_tokens", "ids"])
                at, pos, i = at + int(n.sum()), pos + j - i, j
                del some, found, tokens
                pa.default_memory_pool().release_unused()

    return run


SCHEMA = "doc_id long, shard int, pos long, shard_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> None:
    """Encode every whole text and write the ids below folder, in ascending id order over the files.

    Columns: doc_id; shard, pos (the document's place: shards follow each other); shard_start, n_tokens (token offsets
    within the shard); ids (list of int, each document closed by END_ID). Ids are dictionary encoded while that pays
    and delta packed beyond (format version 2), the metadata columns delta packed, in row groups and pages of bounded
    bytes; Parquet's own page index is kept, so a read of a range of doc_id touches its pages alone and one of the
    metadata no token. The texts, not the larger ids, are ordered by ranges. A null text is an empty one; null ids come
    first; rows with equal ids stay beside each other, ordered by a hash of the text, and may lie in several shards, as
    rows that repeat as a whole may too. Extra columns are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    n = max(1, -(-count // shard_docs), -(-(size or 0) // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    ordered = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("shard"))
    encoded = ordered.mapInArrow(freeing(_encode(tokenizer_path)), SCHEMA)
    with small_batches(docs.sparkSession):
        (encoded.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.writer.version", "v2")
         .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true").option("parquet.dictionary.page.size", 1 << 20)
         .option("compression", "zstd").parquet(folder))


def shard_bases(tokens: DataFrame) -> DataFrame:
    """(shard, base): tokens of all shards before each; reads metadata columns only."""
    sums = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        lists = batch.column("ids")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends)]
        yield pa.record_batch([*batch.columns[:4], pa.array(crcs, pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The files as written, with `start`, the tokens of all documents before each."""
    tokens = spark.read.schema(SCHEMA).parquet(folder)
    bases = cut(shard_bases(tokens))
    return tokens.join(F.broadcast(bases) if fits_broadcast(bases, 40) else bases, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    tokens = spark.read.schema(SCHEMA).parquet(folder)
    bases = cut(shard_bases(tokens))
    crcs = tokens.select("doc_id", "shard", "shard_start", "n_tokens", "ids").mapInArrow(freeing(_digest), "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    placed = crcs.join(F.broadcast(bases) if fits_broadcast(bases, 40) else bases, "shard")
    return placed.select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> str:
    """write_tokens to a folder, or to one below the session's shared folder; returns the folder."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer_path)
    return folder
