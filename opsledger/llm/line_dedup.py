"""Line deduplication by overlapping windows of three lines, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import fresh
from opsledger.llm.spans import covered_intervals, inside, text_key, with_intervals

WIDTH = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_blank: bool = True) -> DataFrame:
    """docs with text cleaned, and the columns n_lines and n_removed (long).

    Lines are what "\n" separates; every window of `width` consecutive lines is hashed, but with keep_blank not those
    that are blank all through, and of equal windows in the corpus all but the one with the smallest (id, line) are
    removed: the lines they cover, merged over overlapping windows, go. Shorter documents have no window. A null text
    stays null with 0 lines; an empty text has one line. Rows that share an id and a text are one document, and all stay
    as their first does; other rows are documents of their own, those of a null id too. Columns of docs named n_lines or
    n_removed are replaced.
    """
    text = F.col(text_col)
    lines = F.split(text, "\n")
    ids = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), lines.alias("l")).where(F.size("l") >= width)
    window = lambda i: F.slice("l", i + 1, width)
    hashes = F.transform(F.sequence(F.lit(0), F.size("l") - width), lambda i: F.struct(
        i.alias("pos"), F.xxhash64(window(i)).alias("h1"), F.xxhash64(F.lit(1), window(i)).alias("h2"),
        (F.forall(window(i), lambda x: F.trim(x) == "") if keep_blank else F.lit(False)).alias("blank")))
    runs = ids.select("id", "key", F.explode(hashes).alias("r")).select("id", "key", "r.*").where("not blank").drop("blank")
    gone, kept = fresh(docs, "gone", "kept")
    joined = with_intervals(docs, F.col(id_col), text, covered_intervals(runs, width), gone)
    left = F.when(F.col(gone).isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~inside(i, F.col(gone))))
    count = lambda x: F.when(text.isNull(), 0).otherwise(F.size(x)).cast("long")
    out = joined.withColumn(kept, left).withColumns({
        "n_lines": count(lines), "n_removed": count(lines) - count(F.col(kept)),
        text_col: F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n")),
    })
    return out.drop(gone, kept)
