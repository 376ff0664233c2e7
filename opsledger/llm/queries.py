"""The queries of the corpus operators, their SQL, and nothing else."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.llm.common import cut, remove, scratch
from opsledger.llm.decontaminate import find_leaks
from opsledger.llm.exact_dedup import exact_dedup
from opsledger.llm.kneser_ney import classify
from opsledger.llm.line_dedup import line_dedup
from opsledger.llm.mixing import mix
from opsledger.llm.ngram_join import ngram_components
from opsledger.llm.sentence_dedup import sentence_dedup
from opsledger.llm.tokens import encode_documents, token_digests
from opsledger.llm.url_filter import filter_urls
from opsledger.llm.warc import archive, read_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that later windows cover; the cleaned text as its digest."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its text without repeated passages."""
    return sentence_dedup(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, and the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and whether its language's threshold accepts it."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold; the query's own go once they are read."""
    folder = scratch(spark, "op3")
    found = cut(read_archives(archive(table(spark, sf_dir, "pages"), folder)))
    remove(spark, folder)
    return found


def op9_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold; the query's own go once they are read."""
    folder = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    found = cut(token_digests(spark, folder))
    remove(spark, folder)
    return found


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_quality, op3_warc, op9_token_parquet, op4_exact_dedup, op5_line_dedup, op6_mixing, op7_substring_dedup, op8_url_filter, op10_ngram_join)}


#: A-Z only.
AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH h AS (SELECT doc_id, sha256({AZ}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
"""

OP5 = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, len(l) AS n, l, unnest(range(len(l) - 2)) AS pos FROM l WHERE len(l) >= 3),
t AS (SELECT doc_id, pos, list_aggregate(l[pos + 1:pos + 3], 'string_agg', chr(10)) AS run FROM w
      WHERE trim(l[pos + 1]) <> '' OR trim(l[pos + 2]) <> '' OR trim(l[pos + 3]) <> ''),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM t),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM f WHERE k > 1),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
o AS (SELECT l.doc_id, l.text, l.l, coalesce(g.gone, []) AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(CASE WHEN len(gone) = 0 THEN text ELSE coalesce(array_to_string(
           list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)), '') END) AS text_sha256
FROM o
"""

OP8 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, says) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'), ('example.net/de/8', 'allow'), ('org/es/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, r.rule, r.says,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
      FROM p LEFT JOIN r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
                        AND starts_with(p.path, substr(r.rule, instr(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM m WHERE k = 1
"""


OP3 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM g
"""


#: All pairs that share a shingle, counted, and the components of those that link.
OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({AZ}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE 100 * met >= 80 * (u.n_shingles + v.n_shingles - met)),
r AS (SELECT a AS doc_id, a AS seen FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT n.doc_id, n.n_shingles, coalesce(m.least, n.doc_id) AS component_id
FROM n LEFT JOIN (SELECT doc_id, min(seen) AS least FROM r GROUP BY 1) m ON m.doc_id = n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_ngram_join": OP10, "op3_warc": OP3, "op4_exact_dedup": OP4, "op5_line_dedup": OP5, "op8_url_filter": OP8}
