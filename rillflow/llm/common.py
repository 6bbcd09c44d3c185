"""What the corpus operators share: tables, the shared scratch folder, seeded keys and bucketed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.operators.batch import ranged
from rillflow.scratch import discard, materialise, scope, scratch_dir  # noqa: F401

#: ``[\x20\x09-\x0D]``, the white space of every word and line rule here.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: ``[\x20\x09-\x0D]`` as a Java pattern.
SPACE_CLASS = r"[\x20\x09-\x0D]"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), lambda one: body(one)), 1)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def run_hashes(hashes: Column, widths: list[int]) -> Column:
    """Of an array of hashes: those of all runs of ``widths[0]`` neighbours in order, then of ``widths[1]``, and so on.

    Runs of 2, 4, 8 .. are hashed from two halves each and others put together from these, so that a position costs
    a few hashes of two numbers and no slice. A width beyond the array gives none.
    """

    def joined(a: Column, b: Column, gap: int) -> Column:
        return F.transform(a, lambda x, i: F.xxhash64(x, F.get(b, i + gap)))

    def of(width: int, powers: dict[int, Column]) -> Column:
        found, at = None, 0
        for p in sorted((p for p in powers if width & p), reverse=True):
            found, at = powers[p] if found is None else joined(found, powers[p], at), at + p
        return F.slice(found, 1, F.greatest(F.size(found) - (width - 1), F.lit(0)))

    def grow(p: int, powers: dict[int, Column]) -> Column:
        if 2 * p <= max(widths):
            return let(joined(powers[p], powers[p], p), lambda b: grow(2 * p, powers | {2 * p: b}))
        return F.concat(*[of(w, powers) for w in widths])

    return let(hashes, lambda a: grow(1, {1: a})) if widths else F.array().cast("array<bigint>")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def stratum(source: Column) -> Column:
    """A key that is never null and tells null from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def seeded_key(seed: str, *parts: Column) -> Column:
    """32 hex digits that order rows at random, the same in every run and every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def unit_interval(hex_key: Column) -> Column:
    """The first 52 bits of a hex key as a double in [0, 1)."""
    return F.conv(F.substring(hex_key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def spread(df: DataFrame, *cols: str) -> Column:
    """A tie-break over every column that can be hashed, for rows that share their keys."""
    plain = [c for c, kind in df.dtypes if c not in cols and not kind.startswith(("map", "variant")) and "map<" not in kind]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0)


def bucketed_rank(df: DataFrame, cells: DataFrame, part: str, bucket: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """Row numbers from 1 within ``part``, in the order of ``bucket`` and then ``order``, without one task per part.

    ``cells`` counts the rows of each (part, bucket): columns part, bucket, ``__n``. Each window task
    sorts one cell only; what lies before the cell comes from running sums over the cells. The cells of a
    part are summed in one task: at most as many as the bucket key has values, 16 to the power of its hex
    digits, which grow with rows over :data:`rillflow.llm.sharding.CELL_ROWS` (16**4 cells for 10**9 rows).
    """
    before = Window.partitionBy(part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        part,
        bucket,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(part)).alias(total),
    )
    own = Window.partitionBy(part, bucket).orderBy(*order)
    joined = df.join(offsets, [part, bucket])
    return joined.withColumn(rank, F.row_number().over(own) + F.col("__before")).drop("__before")


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` (part and others) with ``pos`` from 0 in ``order`` within the part, and its rows ``n``, by a range sort."""
    rows = ranged(nodes, [F.col("part"), *order])
    cells = rows.groupBy("part", "__p").agg(F.min("__l").alias("__first"), F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy("part")
    before = every.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part and range partition that holds it.
    cells = cells.select("part", "__p", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("n"))
    pos = F.col("__l") - F.col("__first") + F.col("__before")
    return rows.join(cells, ["part", "__p"]).withColumn("pos", pos).drop("__p", "__l", "__first", "__before")
