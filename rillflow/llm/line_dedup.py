"""Line dedup: lines that many documents share lose all their copies, by exploded line hashes.

No Python runs in it. The lines of the corpus never travel: pass one writes 128-bit hashes of the
normalised lines (id, position, hash); the hashes are counted over distinct documents after a
map-side combine, so a line that a third of all documents hold is a few rows per task; the
positions to drop come back per document and meet the text once, by ``doc_id``. That join is told to be
a sort-merge join, so that the plan is the same at every size; adaptive execution splits its hot partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import LOWER, SPACE, UPPER, discard, let, materialise


def line_key(line: Column) -> Column:
    """The line without the white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    """Null and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(positions, frequent): every line's place and hash, and the hashes of lines over the threshold.

    A document is a distinct ``doc_id``; null counts as one id. Rows that repeat a ``doc_id`` are one
    document in the count.
    """
    long = docs.select(
        F.col(id_col).alias("__id"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("__crc"),
        F.posexplode(F.transform(split_lines(F.col(text_col)), line_key)).alias("__pos", "__key"),
    )
    lines = materialise(
        long.where(F.char_length("__key") >= min_chars).select(
            "__id", "__crc", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), F.col("__key")).alias("__h2")
        ),
        "lines",
    )
    frequent = (
        lines.select("__id", "__h1", "__h2")
        .distinct()
        .groupBy("__h1", "__h2")
        .count()
        .where(F.col("count") >= min_docs)
        .select("__h1", "__h2")
    )
    return lines, materialise(frequent, "frequent-lines")


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", report: bool = False
) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text_col``; the other lines keep their order, joined by ``\\n``.

    A line's key strips ``[\\x20\\x09-\\x0D]`` at both ends and lower-cases A-Z; keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents go, in every document. Null
    and empty texts are one empty line and come back as the empty text. Ids may be of any type. Rows
    keep all other columns, repeated rows stay repeated, and an empty table stays empty. Whole texts are
    read, however long; one text is one row in one task. ``report`` adds ``n_lines`` and ``n_dropped``
    in place of columns of these names.
    """
    lines, frequent = repeated_lines(docs, min_docs, min_chars, id_col, text_col)
    hits = (
        lines.join(frequent.hint("merge"), ["__h1", "__h2"], "left_semi")
        .groupBy("__id", "__crc")
        .agg(F.collect_set("__pos").alias("__drop"))
        .select(F.col("__id").alias("__hit_id"), F.col("__crc").alias("__hit_crc"), "__drop")
    )
    hits = materialise(hits, "line-hits")
    discard(lines, frequent)
    rows = docs.withColumn("__crc", F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.col("__crc") == F.col("__hit_crc"))
    joined = rows.join(hits.hint("merge"), same, "left").withColumn("__drop", F.coalesce("__drop", F.array().cast("array<int>")))

    def without(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    whole = F.coalesce(F.col(text_col), F.lit(""))
    out = joined
    if report:
        n = F.size(split_lines(F.col(text_col))).cast("long")
        out = out.withColumns({"n_lines": n, "n_dropped": F.size("__drop").cast("long")})
    kept = F.when(F.size("__drop") == 0, whole).otherwise(let(split_lines(F.col(text_col)), without))
    return out.withColumn(text_col, kept).drop("__crc", "__drop", "__hit_id", "__hit_crc")
