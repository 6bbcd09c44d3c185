"""Record-batch algebra on DataFrames. Rows have no order of their own: what depends on order takes ``order_by``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillflow.functions import seeded
from rillflow.scratch import discard, materialise

#: Rows of a key, or of a result, that one task may sort.
MOST = 1 << 18
#: Low bits of ``monotonically_increasing_id`` that number rows within a partition.
_LOCAL = (1 << 33) - 1


def _orders(order_by) -> list:
    return list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]


def ranged(df: DataFrame, order_by) -> DataFrame:
    """``df`` in a total order, written once to the scratch folder: ``__p`` numbers the range partitions, ``__l`` the rows of each from 0."""
    tagged = df.orderBy(*_orders(order_by)).withColumn("__m", F.monotonically_increasing_id())
    return materialise(tagged.withColumns({"__p": F.shiftright("__m", 33), "__l": F.col("__m").bitwiseAND(F.lit(_LOCAL))}).drop("__m"), "ranged")


def before(parts: DataFrame, value: str) -> DataFrame:
    """(__p, __before): the sum of ``value`` over the range partitions before each. There is one row per partition, a few thousand at most."""
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__p", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("__before"))


def row_index(df: DataFrame, order_by, name: str = "row_idx") -> DataFrame:
    """Dense row numbers from 0 in a total order, without one task for all rows.

    Rows are range-sorted and written once to the scratch folder; a row's number is its place in its partition plus the
    rows of the partitions before, which are counted from the written table and broadcast (a row per partition).
    Nothing is gathered on the driver and nothing stays in executors' memory. Columns in ``order_by`` must tell all rows
    apart where the numbers are to be the same in every run.
    """
    rows = ranged(df, order_by)
    counts = before(rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")), "__n")
    return rows.join(F.broadcast(counts), "__p").withColumn(name, F.col("__before") + F.col("__l")).drop("__p", "__l", "__before")


def index_within(df: DataFrame, keys: list[str], order_by, name: str, most: int = MOST) -> DataFrame:
    """Row numbers from 0 within each key, in the given order, without one task for a hot key.

    Keys of at most ``most`` rows are numbered by a window. Where a count shows greater ones, their rows are range-sorted by
    key and order, so that each takes as many tasks as it fills, and numbered from the counts of the partitions before.
    ``order_by`` should tell a key's rows apart, else equal ones may change places. Null keys are keys.
    """
    orders = _orders(order_by)
    window = F.row_number().over(Window.partitionBy(*keys).orderBy(*orders)).cast("long") - 1
    hot = df.groupBy(F.struct(*keys).alias("__k")).count().where(F.col("count") > most).select("__k")
    hot = materialise(hot, "hot-keys")
    if hot.isEmpty():
        discard(hot)
        return df.withColumn(name, window)
    tagged = df.withColumn("__k", F.struct(*keys))
    cold = tagged.join(hot, "__k", "left_anti").withColumn(name, window)
    rows = ranged(tagged.join(hot, "__k"), ["__k", *orders])
    cells = rows.groupBy("__k", "__p").agg(F.min("__l").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # One row per hot key and range partition that holds it.
    earlier = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__k", "__p", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    at = F.col("__l") - F.col("__first") + F.col("__before")
    numbered = rows.join(cells, ["__k", "__p"]).withColumn(name, at).drop("__p", "__l", "__first", "__before")
    return cold.unionByName(numbered).drop("__k")


def running_total(df: DataFrame, value: str, order_by, name: str = "__upto") -> DataFrame:
    """Sums of ``value`` up to and including each row, in a total order: partition sums first, windows within partitions."""
    rows = ranged(df, order_by)
    sums = before(rows.groupBy("__p").agg(F.sum(F.col(value).cast("double")).alias("__s")), "__s")
    own = Window.partitionBy("__p").orderBy("__l").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(own) + F.col("__before")
    return rows.join(F.broadcast(sums), "__p").withColumn(name, total).drop("__p", "__l", "__before")


# ---------------------------------------------------------------- columns


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(", ".join(missing))
    return df.select(*columns)


def pop(df: DataFrame, columns: list[str], keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest); ``keys`` stay in both."""
    taken = select(df, [*keys, *[c for c in columns if c not in keys]])
    return taken, df.drop(*[c for c in columns if c not in keys])


def get(df: DataFrame, name: str, default=None) -> Column:
    """The column, or the default as a constant where there is none."""
    return F.col(name) if name in df.columns else F.lit(default)


def rename(df: DataFrame, old: list[str] | str, new: list[str] | str) -> DataFrame:
    old, new = ([old], [new]) if isinstance(old, str) else (old, new)
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names and {len(new)} new ones")
    return df.withColumnsRenamed(dict(zip(old, new)))


def prefix(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: f"{text}{c}" for c in columns or df.columns})


def assign(df: DataFrame, **values) -> DataFrame:
    """Constants or column expressions as new columns."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def append_lists(df: DataFrame, key: str, columns: list[str], order_by: str) -> DataFrame:
    """One row per key with the list of each column's values, in the order of ``order_by``."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order_by).alias("__order"), *columns))).alias("x"))
    return rows.select(key, *[F.col(f"x.{c}").alias(c) for c in columns])


def to_columns(df: DataFrame, rows: str) -> DataFrame:
    """A column of rows (an array of structs) as a column per field, each an array in the order of the rows; other columns stay."""
    fields = df.schema[rows].dataType.elementType.names
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != rows], *[F.col(f"`{rows}`.`{f}`").alias(f) for f in fields])


def collate(df: DataFrame, batch: str, padded: dict[str, object], left: bool = False, mask: str | None = None) -> DataFrame:
    """Array columns filled up, each with its value, to the longest of their batch; ``mask`` names a column of 1 for entries that were there.

    Lengths are one aggregate per batch, joined back, so that rows of a batch stay rows. A null array is an empty one;
    the mask is of the first column named.
    """
    own = df.withColumns({c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in padded})
    most = own.groupBy(F.col(batch).alias("__b")).agg(*[F.max(F.size(c)).alias(f"__n{i}") for i, c in enumerate(padded)])
    t = own.join(most, F.col(batch).eqNullSafe(F.col("__b")))
    fill = lambda c, i, v: F.array_repeat(F.lit(v).cast(df.schema[c].dataType.elementType), F.col(f"__n{i}") - F.size(c))
    both = lambda a, b: F.concat(b, a) if left else F.concat(a, b)
    first = next(iter(padded))
    more = {mask: both(F.transform(first, lambda x: F.lit(1)), F.array_repeat(F.lit(0), F.col("__n0") - F.size(first)))} if mask else {}
    t = t.withColumns(more | {c: both(F.col(c), fill(c, i, v)) for i, (c, v) in enumerate(padded.items())})
    return t.drop("__b", *[f"__n{i}" for i in range(len(padded))])


def from_rows(spark, rows: list[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows as dictionaries to columns; rows with other keys than the first raise."""
    if rows and any(set(r) != set(rows[0]) for r in rows):
        raise ValueError("rows differ in their keys")
    return spark.createDataFrame(rows, schema)


def generation_inputs(df: DataFrame, inputs: list[str], scoring: tuple[str, ...] = ("data_source", "reward_model", "extra_info", "uid")) -> tuple[DataFrame, DataFrame]:
    """(what a model gets, what scoring keeps): the model's inputs leave the batch, scoring columns are in both."""
    keep = [c for c in scoring if c in df.columns]
    return select(df, [*inputs, *keep]), df.drop(*[c for c in inputs if c not in keep])


# ---------------------------------------------------------------- rows


def take(df: DataFrame, indices: list[int], order_by) -> DataFrame:
    """The rows at these places, in their order and as often as named; negative places count from the end."""
    indexed = row_index(df, order_by)
    n = indexed.count()
    wanted = [(o, i + n if i < 0 else i) for o, i in enumerate(indices)]
    if any(not 0 <= i < n for _, i in wanted):
        raise IndexError(f"{n} rows")
    places = df.sparkSession.createDataFrame(wanted or [(0, -1)], "out_pos long, row_idx long")
    return indexed.join(F.broadcast(places), "row_idx").drop("row_idx")


def take_mask(df: DataFrame, mask: str) -> DataFrame:
    return df.where(F.col(mask)).drop(mask)


def reorder(df: DataFrame, permutation: DataFrame, order_by) -> DataFrame:
    """Rows with ``out_pos``: ``permutation`` has (row_idx, out_pos)."""
    return row_index(df, order_by).join(permutation, "row_idx").drop("row_idx")


def slice_rows(df: DataFrame, order_by, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """As slices of lists, bounds from the end included; rows keep ``row_idx``."""
    indexed = row_index(df, order_by)
    a, b, s = slice(start, stop, step).indices(indexed.count())
    low, high = (a, b) if s > 0 else (b + 1, a + 1)
    return indexed.where((F.col("row_idx") >= low) & (F.col("row_idx") < high) & (F.pmod(F.col("row_idx") - a, F.lit(abs(s))) == 0))


def concat(frames: list[DataFrame]) -> DataFrame:
    """Union of rows; all frames have the same columns."""
    if any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("frames differ in their columns")
    return reduce(DataFrame.unionByName, frames)


def union_columns(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Columns side by side by row id; a column in both must be equal in every row (null and NaN equal themselves)."""
    shared = [c for c in left.columns if c in right.columns and c != on]
    other = right.withColumnsRenamed({c: f"__{c}" for c in shared})
    joined = left.join(other, on)
    if shared:
        same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in shared])
        joined = joined.withColumn(shared[0], F.when(same, F.col(shared[0])).otherwise(F.raise_error(F.lit("columns of one name differ")).cast(left.schema[shared[0]].dataType)))
    return joined.drop(*[f"__{c}" for c in shared])


def repeat(df: DataFrame, times: int, name: str = "rep") -> DataFrame:
    """Each row ``times`` times, numbered by ``name`` from 0. In the order (row, rep) copies stand together, in (rep, row) the table is tiled."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn(name, F.lit(0)).limit(0)


def repeat_rows(df: DataFrame, times: Column | str, name: str = "rep") -> DataFrame:
    """Each row as often as its own ``times``; 0 and less and null drop it."""
    times = F.col(times) if isinstance(times, str) else times
    return df.withColumn("__t", times.cast("int")).where("__t > 0").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("__t") - 1))).drop("__t")


def unfold_chunks(df: DataFrame, parts: int, columns: list[str], name: str = "chunk") -> DataFrame:
    """Array columns cut into ``parts`` equal pieces, one row each; other columns are repeated."""
    exploded = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cut = {c: F.slice(F.col(c), F.col(name) * F.expr(f"size({c}) div {parts}").cast("int") + 1, F.expr(f"size({c}) div {parts}").cast("int")) for c in columns}
    return exploded.withColumns(cut)


def fold(df: DataFrame, size: int, order_by, columns: list[str]) -> DataFrame:
    """``size`` neighbours to a row of arrays: columns ``group`` and the named ones. Raises where rows don't divide."""
    indexed = row_index(df, order_by)
    if indexed.count() % size:
        raise ValueError(f"rows are no multiple of {size}")
    grouped = indexed.groupBy(F.expr(f"row_idx div {size}").alias("group")).agg(F.sort_array(F.collect_list(F.struct("row_idx", *columns))).alias("x"))
    return grouped.select("group", *[F.col(f"x.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, columns: list[str], name: str = "place") -> DataFrame:
    """The inverse of ``fold``."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias(name, "x")).select(*rest, name, *[F.col(f"x.{c}").alias(c) for c in columns])


def chunk(df: DataFrame, chunks: int, order_by, even: bool = False, name: str = "chunk") -> DataFrame:
    """Contiguous chunks of ceil(n / chunks) rows; ``even``: sizes that differ by one at most, larger ones first."""
    indexed = row_index(df, order_by)
    n = indexed.count()
    if not even:
        return indexed.withColumn(name, F.expr(f"row_idx div {max(1, -(-n // chunks))}").cast("int")).drop("row_idx")
    size, more = divmod(n, chunks)
    edge = more * (size + 1)
    late = F.expr(f"{more} + (row_idx - {edge}) div {max(1, size)}")
    return indexed.withColumn(name, F.when(F.col("row_idx") < edge, F.expr(f"row_idx div {size + 1}")).otherwise(late).cast("int")).drop("row_idx")


def batches(df: DataFrame, size: int, order_by, drop_last: bool = False, name: str = "batch") -> DataFrame:
    """Batches of ``size`` rows in order; ``drop_last`` leaves the short one out."""
    indexed = row_index(df, order_by)
    if drop_last:
        indexed = indexed.where(F.col("row_idx") < indexed.count() // size * size)
    return indexed.withColumn(name, F.expr(f"row_idx div {size}")).drop("row_idx")


def pad_to_divisor(df: DataFrame, divisor: int, order_by) -> DataFrame:
    """Rows from the head again, round and round, until the count divides: column ``is_pad``."""
    indexed = row_index(df, order_by)
    n = indexed.count()
    missing = -n % divisor
    if not n or not missing:
        return indexed.withColumn("is_pad", F.lit(False))
    turns = -(-missing // n)
    extra = indexed.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.lit(turns)))).withColumn("row_idx", F.col("row_idx") + F.col("__turn") * n)
    extra = extra.where(F.col("row_idx") < n + missing).drop("__turn").withColumn("is_pad", F.lit(True))
    return indexed.withColumn("is_pad", F.lit(False)).unionByName(extra)


def whole(df: DataFrame, order_by, name: str = "batch") -> DataFrame:
    """All rows as one batch, as validation takes them, with ``row_idx`` in order."""
    return row_index(df, order_by).withColumn(name, F.lit(0).cast("long"))


def union_maps(left: Column | str, right: Column | str) -> Column:
    """Both maps as one; a key in both must have one value, else it raises. Null counts as empty."""
    a, b = (F.coalesce(F.col(m) if isinstance(m, str) else m, F.create_map()) for m in (left, right))
    differ = F.exists(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    merged = F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))
    return F.when(differ, F.map_from_arrays(F.array(F.raise_error(F.lit("maps differ in a key")).cast("string")), F.array(F.lit(None)))).otherwise(merged)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad", "row_idx")


def pad_rows(df: DataFrame, size: int, order_by, candidate: str = "first") -> DataFrame:
    """``size`` more rows that repeat the first row, or the last."""
    indexed = row_index(df, order_by)
    one = indexed.where(F.col("row_idx") == 0) if candidate == "first" else indexed.orderBy(F.col("row_idx").desc()).limit(1)
    return indexed.withColumn("is_pad", F.lit(False)).unionByName(repeat(one, size).drop("rep").withColumn("is_pad", F.lit(True)))


def shuffle_order(df: DataFrame, key: str, seed: int) -> Column:
    """A random order that depends on key and seed only, the same in every partitioning."""
    return seeded.order(seed, key)


def minibatches(df: DataFrame, size: int, epochs: int, key: str, seed: int | None = None) -> DataFrame:
    """(epoch, batch) for every row and epoch; rows in the order of ``key``, or reshuffled every epoch. Rows must divide by ``size``."""
    if df.count() % size:
        raise ValueError(f"rows are no multiple of {size}")
    out = []
    for epoch in range(epochs):
        order = [F.col(key)] if seed is None else [shuffle_order(df, key, seed + epoch), F.col(key)]
        out.append(batches(df, size, order).withColumn("epoch", F.lit(epoch)))
    return concat(out)


def curriculum(df: DataFrame, stats: DataFrame, key: str, priority: Column, name: str = "row_idx", tie: list[str] = ()) -> DataFrame:
    """Rows in the order of a priority over feedback that ``stats`` holds by key, ties by ``tie`` or the key; rows without feedback come first."""
    joined = df.join(stats, key, "left")
    return row_index(joined, [priority.asc_nulls_first(), *[F.col(c) for c in tie or [key]]], name)


def first_samples(df: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """The first ``n`` rows by key, or ``n`` rows at random, without replacement; more than :data:`MOST` come from a range sort, not from one task."""
    if n < 0:
        return df
    order = [F.col(key)] if seed is None else [shuffle_order(df, key, seed), F.col(key)]
    if n <= MOST:
        return df.orderBy(*order).limit(n)
    return row_index(df, order, "__i").where(F.col("__i") < n).drop("__i")


def flatten_trajectories(df: DataFrame, step_columns: list[str], name: str = "step") -> DataFrame:
    """Arrays of steps to one row per step; columns of the trajectory are repeated."""
    return unfold(df, step_columns, name)


def upsample(frames: list[tuple[DataFrame, int]]) -> DataFrame:
    """The union of frames, each so many times."""
    return concat([repeat(f, k).drop("rep") for f, k in frames])


def rank_shards(df: DataFrame, ranks: int, key: str, seed: int) -> DataFrame:
    """Shuffled rows dealt to ranks in turn, all ranks equally many; what is left over is dropped."""
    indexed = row_index(df, [shuffle_order(df, key, seed), F.col(key)])
    n = indexed.count() // ranks * ranks
    return indexed.where(F.col("row_idx") < n).withColumn("rank", F.pmod("row_idx", F.lit(ranks)).cast("int")).drop("row_idx")


def fan_out(df: DataFrame, samples: int, replicas: int, order_by) -> DataFrame:
    """Each prompt ``samples`` times in a row, split over replicas in contiguous near-equal parts: ``rep``, ``replica``."""
    repeated = repeat(row_index(df, order_by, "prompt_idx"), samples)
    return chunk(repeated, replicas, ["prompt_idx", "rep"], even=True, name="replica")


def grow(df: DataFrame, generated: DataFrame, keep: Column) -> DataFrame:
    """The dataset with the generated rows that pass."""
    return concat([df, generated.where(keep).select(*df.columns)])


def resume(df: DataFrame, epoch: int, batch: int) -> DataFrame:
    """The batches of :func:`minibatches` that a run which stopped before (epoch, batch) has still to see; orders depend on seeds alone."""
    return df.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("batch") >= batch)))


def assert_equal(left: DataFrame, right: DataFrame) -> None:
    """Raises where two frames differ in columns, types or rows, in whatever order."""
    from pyspark.testing import assertDataFrameEqual

    assertDataFrameEqual(left, right.select(*left.columns))
