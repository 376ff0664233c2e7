"""The corpus pipeline: from documents to token files, each stage on all that the one before it kept.

Documents the quality classifier rejects go; of each group of near copies (and exact ones) one document stays, that with
the smallest id; documents that hold a benchmark item go; the rest are mixed to source weights, a document standing as
often as the mix takes it; the last stage writes token files and returns what they hold.

Stages know documents by row, not by id: rows that share an id, or have none, are documents of their own, each with its
own verdict. The number of a row is its place in the files that the stage reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.llm import bloom
from opsledger.llm.common import cut, fresh, numbered, remove, scratch, small
from opsledger.llm.decontaminate import decontaminate
from opsledger.llm.kneser_ney import classify
from opsledger.llm.mixing import mix
from opsledger.llm.ngram_join import ngram_components
from opsledger.llm.tokens import encode_documents, token_digests

TOKENIZER = "word_bpe_49k.json"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the numbers of their rows, and the name of that column."""
    row, = fresh(docs, "pipeline_row")
    return numbered(docs, row), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the classifier rejects: perplexity above its language's threshold, or no words at all."""
    rows, row = _numbered(docs)
    judged = classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=row)
    return bloom.without(rows, row, judged.where("not accepted").select("row")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: that with the smallest id, a null id last; of equal ids the first in the files."""
    rows, row = _numbered(docs)
    found = cut(ngram_components(rows, id_col=row).where("doc_id <> component_id").select(F.col("doc_id").alias("r"), F.col("component_id").alias("c")))
    members = found.unionByName(found.select(F.col("c").alias("r"), "c").distinct())
    ids = rows.select(row, F.col("doc_id").alias("id")).join(small(cut(members), 24), F.col(row) == F.col("r"))
    best = cut(ids.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "r"))["r"].alias("best")))
    gone = members.join(small(best, 24), "c").where("r <> best").select("r")
    return bloom.without(rows, row, gone).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text holds a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop each row as the mix takes it; copies are rows alike, with the columns of documents."""
    rows, row = _numbered(docs)
    key, n, k = fresh(rows, "key", "n", "k")
    copies = mix(rows, row_col=row).where("copies <> 1").select(F.col("key").alias(key), F.col("copies").cast("int").alias(n))
    taken = rows.join(small(cut(copies), 24), F.col(row) == F.col(key), "left").withColumn(n, F.coalesce(n, F.lit(1)))
    return taken.where(F.col(n) > 0).withColumn(k, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files below the shared folder; (doc_id, start, n_tokens, ids_crc32) as they hold them."""
    folder = encode_documents(docs, public_tokenizers.path(TOKENIZER), scratch(spark, "pipeline-tokens"))
    return token_digests(spark, folder)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]
#: The classifier, the mix and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written as Parquet and read again; only the token files stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return out
