"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k drawn by inverting the Poisson distribution whose mean is the
repetition rate of its source, at a point that a hash of the document's id gives; copies are then
shuffled globally by a second hash. Draws are per document, so a hot source needs no shuffle at all
before the explode, and a rerun of a lost task draws the same counts.

No Python runs in it. A mean above ``PIECE`` is the sum of several draws of at most ``PIECE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import bucketed_rank, id_text, let, materialise, seeded_key, spread, stratum, unit_interval
from rillflow.llm.sharding import hex_digits

#: Largest mean of one draw, and the terms of its distribution beyond which nothing is left in double precision.
PIECE, TERMS = 8.0, 60


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """(__part, n_rows, __rate): how often each document of a source is to be repeated, on average.

    ``weights`` gives the share of sources in the result, in rows (unnamed ones get none; they need
    not sum to one). Without it a source's share goes with its rows to the power ``temperature``. The
    result has ``epochs`` times as many rows as ``docs`` on average.
    """
    counts = docs.groupBy(stratum(F.col(source_col)).alias("__part")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        share = F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("__part") == F.lit("n" if name is None else f"s{name}"), F.lit(float(weight))).otherwise(share)
    shared = counts.withColumn("__share", share)
    shares, rows = shared.agg(F.sum("__share"), F.sum("n_rows")).first()
    rate = F.lit(float(epochs) * (rows or 0)) * F.col("__share") / (F.lit(shares or 1.0) * F.col("n_rows"))
    return shared.select("__part", "n_rows", rate.alias("__rate"))


def cumulative(mean: Column) -> Column:
    """P(K <= j) for j = 0 .. TERMS of a Poisson distribution of the mean."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(a: Column, j: Column) -> Column:
        p = a["p"] * mean / j
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["all"])


def repetitions(key: Column, rate: Column, cdf: Column) -> Column:
    """The count drawn for a document: ``key`` seeds it, ``cdf`` belongs to the mean of one piece."""
    pieces = F.greatest(F.ceil(rate / PIECE).cast("int"), F.lit(1))

    def one(j: Column) -> Column:
        u = unit_interval(F.md5(F.concat_ws(":", key, j.cast("string")).cast("binary")))
        return let(u, lambda at: F.size(F.filter(cdf, lambda c: c <= at)))

    return F.when(rate > 0, F.aggregate(F.transform(F.sequence(F.lit(1), pieces), one), F.lit(0), lambda a, k: a + k)).otherwise(F.lit(0))


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    max_broadcast_sources: int = 20_000,
) -> DataFrame:
    """``docs`` with each row repeated by its draw, and ``copy`` (1 .. k), in no order.

    The rates of the sources are broadcast after they are counted (a row of them takes about 600 bytes);
    beyond ``max_broadcast_sources`` they are joined by a shuffle in which each source is dealt to 64
    salts. Null sources are a source of their own, null ids one id, rows that repeat an id get the same draw,
    an empty table stays empty. Ids may be of any type. Texts are not looked at, so null, empty and very long
    ones are repeated like any other. A column ``copy`` of ``docs`` is replaced, all others stay.
    """
    table = materialise(rates(docs, weights, temperature, epochs, source_col), "rates")
    mean = F.col("__rate") / F.greatest(F.ceil(F.col("__rate") / PIECE), F.lit(1))
    table = table.select("__part", "__rate", cumulative(mean).alias("__cdf"))
    rows = docs.withColumn("__part", stratum(F.col(source_col)))
    if table.count() <= max_broadcast_sources:
        joined = rows.join(F.broadcast(table), "__part")
    else:
        salts = 64
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(salts)).cast("int"))
        table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.join(table, ["__part", "__salt"]).drop("__salt")
    key = F.concat_ws(":", F.lit(seed), id_text(F.col(id_col)))
    drawn = joined.withColumn("__times", repetitions(key, F.col("__rate"), F.col("__cdf"))).where("__times > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__part", "__rate", "__cdf", "__times")


def shuffled(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """Rows dealt to partitions by a seeded hash of id and copy, and in its order within each: a global shuffle."""
    key = seeded_key(seed + "-order", id_text(F.col(id_col)), F.col("copy").cast("string"))
    keyed = docs.withColumn("__order", key)
    return keyed.repartition(F.substring("__order", 1, 4)).sortWithinPartitions("__order").drop("__order")


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, rows repeated to the target weights, globally shuffled."""
    inner = docs.withColumnRenamed("copy", "__own_copy") if "copy" in docs.columns else docs
    out = shuffled(replicate(inner, seed=seed, id_col=id_col, **options), seed, id_col).drop("copy")
    return out.withColumnRenamed("__own_copy", "copy").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture_places(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """(id, source, copy, place): where each copy stands in the shuffled mixture, gapless from 0."""
    copies = replicate(docs.select(id_col, source_col), seed=seed, id_col=id_col, source_col=source_col, **options)
    copies = copies.withColumn("__key", seeded_key(seed + "-order", id_text(F.col(id_col)), F.col("copy").cast("string")))
    copies = materialise(copies, "copies")
    digits = hex_digits(copies.count())
    keyed = copies.withColumn("__cell", F.substring("__key", 1, digits)).withColumn("__every", F.lit(0))
    cells = keyed.groupBy("__every", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    ranked = bucketed_rank(keyed, cells, "__every", "__cell", [F.col("__key"), spread(copies)], "__place", "__all")
    return ranked.select(id_col, source_col, F.col("copy").cast("int").alias("copy"), (F.col("__place") - 1).cast("long").alias("place"))
