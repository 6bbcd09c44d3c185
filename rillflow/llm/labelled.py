"""The fit set of the classifiers: a bounded, seeded sample of the labelled rows that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.llm.common import materialise


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; an id that is null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_rows(
    docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 128 << 20
) -> DataFrame:
    """(place, text, y) of at most ``max_rows`` labelled rows of ``max_bytes`` bytes of text, none of them held out, in a seeded order.

    Labels other than 0 and 1 and null ids or labels are left out; of an id with several labels the smallest
    counts, of one with several texts the one that sorts first, so that an id is one row, however often it is
    repeated; null texts count as empty. Rows are taken in the seeded order until the next would exceed
    ``max_bytes``. The bounds are on what is learnt from alone, the corpus is not sampled: only the rows the
    sampled ids name are read.
    """
    seeded = F.xxhash64(F.lit(5), F.col(id_col))
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    ids = ids.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"), seeded.alias("place"))
    # At most max_rows rows of 20 bytes, hence the broadcast.
    ids = materialise(ids.groupBy("__id", "place").agg(F.min("y").alias("y")).orderBy("place", "__id").limit(max_rows), "fit-ids")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = rows.join(F.broadcast(ids), "__id").groupBy("__id", "place", "y").agg(F.min("text").alias("text"))
    one = materialise(one.withColumn("size", F.octet_length("text").cast("long")), "fit-texts")
    # The running sum is over max_rows rows of a few numbers.
    upto = F.sum("size").over(Window.orderBy("place", "__id"))
    within = one.select("__id", upto.alias("upto"), "place", "size").where(F.col("upto") <= max_bytes).select("__id")
    return one.join(F.broadcast(within), "__id").select("place", "text", "y")
