"""Order statistics of tables of any size: exact values at ranks, quantiles, and the first k rows as a threshold.

Nothing is sorted as a whole. Each round splits what is left at approximate quantiles, counts exactly how many rows lie
below the cell that a rank falls into, and goes on with that cell's rows, about one in a hundred. Cells of
:data:`CELL` rows or fewer, or of one value however often it is repeated, end the rounds; only then a task sorts
one cell. Rounds go with the logarithm of the rows: two for 10**7, three for 10**9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.operators.batch import row_index
from rillflow.scratch import materialise, scope

#: Approximate quantiles of a round, and the rows that a task may sort.
SPLITS, CELL = 256, 1 << 18


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cell(rank: Column) -> list[Column]:
    """(lo, hi): values between which the row of a rank lies. Splits are off by a tenth of a cell at most; there is one to spare on each side."""
    at = F.floor(rank * SPLITS / F.col("n")).cast("int")
    lo = F.when(at <= 1, F.col("least")).otherwise(F.get("splits", at - 1))
    hi = F.when(at >= SPLITS - 2, F.col("most")).otherwise(F.get("splits", at + 2))
    return [lo.alias("lo"), hi.alias("hi")]


def _splits(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    fractions = [i / SPLITS for i in range(SPLITS + 1)]
    splits = F.percentile_approx("__v", fractions, 10 * SPLITS).alias("splits")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), splits, *more)


def _counts(lo: Column, hi: Column) -> list[Column]:
    v = F.col("__v")
    return [F.sum((v < lo).cast("long")).alias("below"), F.sum(((v >= lo) & (v <= hi)).cast("long")).alias("inside")]


def at_ranks(df: DataFrame, value: Column | str, ranks: dict[str, Column], keys: list[str] = (), carry: list[str] = (), cell: int = CELL) -> DataFrame:
    """One row per key: keys, ``n`` (its rows with a value) and, per name, a struct (rank, value, below, upto).

    ``ranks`` are expressions over ``n`` and the greatest values of ``carry``, 0 for the smallest value; the value at the rank comes
    with the rows less than it (``below``) and not greater than it (``upto``). A rank that is not one of a key's rows gives null.
    Values are read as doubles; nulls don't count, NaN is the greatest. Without keys there is one row, for an empty table too.
    """
    names, keys = list(ranks), list(keys)
    with scope() as kept:
        key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
        rows = materialise(df.select(key.alias("__k"), *carry, _col(value).cast("double").alias("__v")).where("__v is not null"), "values")
        first = _splits(rows, ["__k"], *[F.max(c).alias(c) for c in carry])
        rank = {x: F.when((r >= 0) & (r < F.col("n")), r.cast("long")) for x, r in ranks.items()}
        first = materialise(first.select("__k", "n", *[F.struct(rank[x].alias("r"), *_cell(rank[x])).alias(f"t_{x}") for x in names]), "cells")
        met = rows.join(first.drop("n"), "__k")
        within = lambda x: F.col("__v").between(F.col(f"t_{x}.lo"), F.col(f"t_{x}.hi"))
        sums = [F.struct(*_counts(F.col(f"t_{x}.lo"), F.col(f"t_{x}.hi"))).alias(f"c_{x}") for x in names]
        counted = first.join(met.groupBy("__k").agg(*sums), "__k")
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"t_{x}.r").alias("r"), f"t_{x}.lo", f"t_{x}.hi", f"c_{x}.below", f"c_{x}.inside") for x in names]))
        targets = materialise(counted.select("__k", each.alias("t")).select("__k", "t.*").withColumn("r", F.col("r") - F.col("below")), "ranks")
        inside = met.select("__k", "__v", F.explode(F.array(*[F.when(within(x) & (F.col(f"t_{x}.lo") < F.col(f"t_{x}.hi")), F.lit(x)) for x in names])).alias("name"))
        inside = inside.where("name is not null")
        by = ["__k", "name"]
        open_ = lambda: targets.where("lo < hi").agg(F.max("inside")).first()[0] or 0
        before, most = None, open_()
        while most > cell and most != before:  # a cell of a few rows may not split any further
            before = most
            inside = materialise(inside, "inside")
            cells = _splits(inside, by).join(targets.select(*by, "r"), by)
            cells = materialise(cells.select(*by, "r", *_cell(F.col("r"))), "cells")
            met = inside.join(cells, by)
            counted = cells.join(met.groupBy(*by).agg(*_counts(F.col("lo"), F.col("hi"))), by).withColumn("r", F.col("r") - F.col("below"))
            # What is found already stays.
            targets = materialise(targets.where("lo = hi or r is null").unionByName(counted, allowMissingColumns=True), "ranks")
            inside = met.where((F.col("__v").between(F.col("lo"), F.col("hi"))) & (F.col("lo") < F.col("hi"))).select("__k", "__v", "name")
            most = open_()
        place = F.row_number().over(Window.partitionBy(*by).orderBy("__v")) - 1
        picked = inside.withColumn("at", place).join(targets.where("lo < hi").select(*by, "r"), by).where("at = r")
        found = targets.where("lo = hi").select(*by, F.col("lo").alias("__v")).unionByName(picked.select(*by, "__v"))
        wide = found.groupBy("__k").agg(*[F.max(F.when(F.col("name") == x, F.col("__v"))).alias(f"v_{x}") for x in names])
        asked = first.select("__k", "n", *[F.col(f"t_{x}.r").alias(f"r_{x}") for x in names])
        wide = materialise(asked.join(wide, "__k", "left"), "values-at-ranks")
        v = F.col("__v")
        sums = [F.struct(F.first(f"r_{x}").alias("rank"), F.first(f"v_{x}").alias("value"), F.sum((v < F.col(f"v_{x}")).cast("long")).alias("below"), F.sum((v <= F.col(f"v_{x}")).cast("long")).alias("upto")).alias(x) for x in names]
        out = rows.select("__k", "__v").join(wide, "__k").groupBy("__k").agg(F.first("n").alias("n"), *sums)
        empty = [F.lit(None).cast("struct<rank:bigint,value:double,below:bigint,upto:bigint>").alias(x) for x in names]
        out = materialise(out.select(*([F.col(f"__k.{k}").alias(k) for k in keys]), "n", *[F.when(F.col(x)["value"].isNotNull(), F.col(x)).alias(x) for x in names]), "order-statistics")
        kept.append(out)
    if not keys:
        none = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), *empty)
        one = out.unionByName(none).agg(F.max_by(F.struct("n", *names), "n").alias("x"))
        return one.select("x.*")
    return out


def quantiles(df: DataFrame, value: Column | str, fractions: dict[str, float], keys: list[str] = (), cell: int = CELL) -> DataFrame:
    """One row per key: keys and, per name, the exact quantile with linear interpolation between neighbours; null without values."""
    ranks = {}
    for x, q in fractions.items():
        at = F.lit(float(q)) * (F.col("n") - 1)
        ranks |= {f"{x}__lo": F.floor(at), f"{x}__hi": F.ceil(at)}
    found = at_ranks(df, value, ranks, keys, cell=cell)
    lo, hi = (lambda x: F.col(f"{x}__lo.value")), (lambda x: F.col(f"{x}__hi.value"))
    part = lambda q: F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1))
    return found.select(*keys, *[F.when(part(q) == 0, lo(x)).otherwise(lo(x) * (1 - part(q)) + hi(x) * part(q)).alias(x) for x, q in fractions.items()])


def flag_first(df: DataFrame, value: Column, k: Column, tie: list[Column], name: str, where: Column | None = None, carry: list[str] = (), cell: int = CELL) -> DataFrame:
    """``df`` with ``name``: whether a row is one of the first ``k`` by ``value``, ties by ``tie``, of those for which ``where`` holds.

    ``k`` is an expression over ``n`` (the rows that take part) and ``carry``; all rows are taken where there are no more. The flag is a
    comparison with a threshold, four numbers found before, so that nothing is sorted or joined but rows that tie there. ``df`` is written
    once and read from there: a sum of doubles differs in its last digits from run to run, as partial results arrive in any order, and a value
    made anew from it would miss the threshold. Rows with a null value or equal in ``tie`` throughout aren't told apart: null is never first, and
    all equal rows at the threshold are.
    """
    with scope() as kept:
        df = materialise(df, "rows")
        kept.append(df)
        taking = df if where is None else df.where(where)
        found = at_ranks(taking, value, {"x": F.least(k, F.col("n")) - 1}, carry=carry, cell=cell).first()
        ok = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        if found["x"] is None:
            return df.withColumn(name, F.lit(False))
        rank, v, below, upto = found["x"]
        more = rank + 1 - below
        own = value.cast("double")
        same = own == F.lit(v)
        if more < upto - below:
            tied = taking.where(same).select(*[t.alias(f"t{i}") for i, t in enumerate(tie)])
            order = [F.col(f"t{i}") for i in range(len(tie))]
            if upto - below <= cell:
                last = tied.orderBy(*order).offset(more - 1).limit(1).first()
            else:
                last = row_index(tied, order, "at").where(F.col("at") == more - 1).first()
            upto_last = F.struct(*[F.lit(last[f"t{i}"]).cast(tied.schema[f"t{i}"].dataType).alias(f"t{i}") for i in range(len(tie))])
            same = same & (F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tie)]) <= upto_last)
    return df.withColumn(name, F.coalesce(ok & ((own < F.lit(v)) | same), F.lit(False)))
