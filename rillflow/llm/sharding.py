"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank is the middle of its
place in that order, (2 r - 1) / (2 n); all rows are sorted by it and cut into shards of equal
counts, so that every shard holds every source in proportion. Law: ``rows`` (counts of shards at
most one apart).

No task sees a whole source: ranks are counted in cells of the key's first hex digits
(:func:`rillflow.llm.common.bucketed_rank`), and the global order in cells of the fractional rank.
Only the rows themselves are shuffled, twice; the cells that the offsets come from are counted over
narrow columns with a map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import bucketed_rank, id_text, seeded_key, spread, stratum

#: Rows that a cell should hold at most, on average.
CELL_ROWS = 20_000


def hex_digits(rows: int) -> int:
    """So many leading hex digits that a cell of the largest source holds about CELL_ROWS rows at most."""
    digits = 1
    while 16**digits * CELL_ROWS < rows and digits < 7:
        digits += 1
    return max(2, digits)


def interleave(docs: DataFrame, seed: str = "shard", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``__place`` (from 0, the interleaved global order) and ``__all`` (rows in all).

    Null sources are a source of their own, null ids an id of their own; ids may be of any type; rows that
    tie in source and id are told apart by a hash of all columns, and wholly equal rows may stand in either
    order. Texts are carried along and not looked at, whether null, empty or very long; an empty table stays
    empty; columns may have any names but those two.
    """
    total = docs.count()
    digits = hex_digits(total)
    key = seeded_key(seed, id_text(F.col(id_col)))
    keyed = docs.withColumns({"__part": stratum(F.col(source_col)), "__key": key}).withColumn("__cell", F.substring("__key", 1, digits))
    cells = keyed.groupBy("__part", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    tie = spread(docs)
    ranked = bucketed_rank(keyed, cells, "__part", "__cell", [F.col("__key"), tie], "__rank", "__of")
    width = 16**digits
    placed = ranked.withColumn("__at", (2 * F.col("__rank") - 1) / (2 * F.col("__of")).cast("double"))
    placed = placed.withColumn("__slice", F.floor(F.col("__at") * width).cast("long")).withColumn("__every", F.lit(0))
    # Ties change which row stands at a rank, never the ranks there are: a narrow copy of the plan counts the slices.
    narrow = bucketed_rank(
        keyed.select("__part", "__cell", "__key"), cells, "__part", "__cell", [F.col("__key")], "__rank", "__of"
    )
    slices = (
        narrow.select(F.floor(((2 * F.col("__rank") - 1) / (2 * F.col("__of")).cast("double")) * width).cast("long").alias("__slice"))
        .groupBy("__slice")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__every", F.lit(0))
    )
    order = [F.col("__at"), F.col("__part"), F.col("__key"), tie]
    ordered = bucketed_rank(placed, slices, "__every", "__slice", order, "__place", "__all")
    out = ordered.withColumn("__place", F.col("__place") - 1)
    return out.drop("__part", "__key", "__cell", "__rank", "__of", "__at", "__slice", "__every")


def shard(docs: DataFrame, n_shards: int = 40, seed: str = "shard", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within the shard).

    Shard sizes differ by one at most; with fewer rows than shards some stay empty. Columns of
    ``docs`` named ``shard`` or ``slot`` are replaced.
    """
    placed = interleave(docs.drop("shard", "slot"), seed, id_col, source_col)
    number = F.expr(f"__place * {n_shards} div __all")
    first = F.expr(f"(shard * __all + {n_shards - 1}) div {n_shards}")
    out = placed.withColumn("shard", number).withColumn("slot", (F.col("__place") - first).cast("long"))
    return out.withColumn("shard", F.col("shard").cast("int")).drop("__place", "__all")
