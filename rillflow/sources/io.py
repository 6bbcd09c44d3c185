"""Readers and writers. Paths go to Spark as they are, so that every store Spark knows serves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.batch import row_index


def read_parquet(spark: SparkSession, *paths: str, drifting: bool = False) -> DataFrame:
    """One table of several files or folders; ``drifting``: their schemas differ, and what is missing is null."""
    if not drifting:
        return spark.read.parquet(*paths)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def nested(path: list[str] | str) -> Column:
    """A column, or the field of structs that a list of keys leads to."""
    return F.col(".".join(path) if isinstance(path, list) else path)


def unwrap_singleton(df: DataFrame, column: str) -> Column:
    """The element of arrays of one; other arrays as they are can't be told apart by type, so longer ones raise."""
    c = F.col(column)
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        return c
    many = F.raise_error(F.lit(f"{column} has several elements")).cast(df.schema[column].dataType.elementType)
    return F.when(F.size(c) > 1, many).otherwise(F.get(c, F.lit(0)))


def json_to_parquet(spark: SparkSession, path: str, out: str, ratio: float, order_by=None) -> tuple[int, int]:
    """A JSON array file to ``train`` and ``test`` Parquet: the first floor(n ratio) rows, and the rest."""
    df = spark.read.json(path, multiLine=True)
    indexed = row_index(df, order_by or F.monotonically_increasing_id())
    n = indexed.count()
    cut = int(n * ratio)
    indexed.where(F.col("row_idx") < cut).drop("row_idx").write.mode("overwrite").parquet(f"{out}/train")
    indexed.where(F.col("row_idx") >= cut).drop("row_idx").write.mode("overwrite").parquet(f"{out}/test")
    return cut, n - cut


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``id`` and ``contents``."""
    return spark.read.schema("id string, contents string").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def dump_rollouts(df: DataFrame, path: str, extras: tuple[DataFrame, ...] = (), key: str = "sample_id") -> None:
    """JSON lines of samples, a folder per ``step``. Of ``extras``, frames by sample, those with a row for every sample are joined, others left out."""
    n = df.count() if extras else 0
    for e in extras:
        if e.count() == n:
            df = df.join(e, key)
    df.write.mode("append").partitionBy("step").json(path)


def read_rollouts(spark: SparkSession, path: str, masks: list[str] = ()) -> DataFrame:
    """Dumped samples of all steps, with ``sample``, their number within the step; what ``masks`` match becomes ``*``; structures become JSON."""
    df = spark.read.json(path)
    if "step" not in df.columns:
        df = df.withColumn("step", F.regexp_extract(F.input_file_name(), r"(\d+)\.jsonl?$", 1).cast("long"))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            df = df.withColumn(f.name, F.to_json(f.name))
        if isinstance(f.dataType, T.StringType):
            df = df.withColumn(f.name, reduce(lambda c, m: F.regexp_replace(c, m, "*"), masks, F.col(f.name)))
    from pyspark.sql.window import Window

    rest = [c for c in df.columns if c != "step"]
    return df.withColumn("sample", F.row_number().over(Window.partitionBy("step").orderBy(*rest)) - 1)


def view(df: DataFrame, step: int | None = None, request: str | None = None, keyword: str | None = None, fields: list[str] | None = None, best_first: bool = True) -> DataFrame:
    """Samples by score (``score``, else ``score_1``, else 0), of one step, one request (dashes don't matter), or with a keyword."""
    out = df if step is None else df.where(F.col("step") == step)
    if request is not None:
        out = out.where(F.replace("request_id", F.lit("-"), F.lit("")) == request.replace("-", ""))
    if keyword is not None:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        out = out.where(reduce(lambda a, b: a | b, [F.contains(c, F.lit(keyword)) for c in texts], F.lit(False)))
    score = F.coalesce(*[F.col(c) for c in ("score", "score_1") if c in df.columns], F.lit(0.0))
    out = out.orderBy(score.desc() if best_first else score.asc(), "step", "sample")
    return out.select(*fields) if fields else out


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached_rollout(spark: SparkSession, root: str, experiment: str, project: str, batch: int, n: int, make) -> DataFrame:
    """A rollout from the cache that its options name, or made, written and read."""
    path = f"{root}/{experiment}_{project}/GBS{batch}__N{n}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        save(make(), path)
    return load(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def make_dirs(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def copy(spark: SparkSession, source: str, target: str) -> None:
    conf = spark._jsc.hadoopConfiguration()
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def local_cache_path(path: str, cache: str) -> str:
    """Where a copy of a remote path is kept: a folder named by the md5 of the path."""
    import hashlib

    return f"{cache}/{hashlib.md5(path.encode()).hexdigest()}/{path.rstrip('/').rsplit('/', 1)[-1]}"


def cached_copy(spark: SparkSession, source: str, cache: str, always: bool = False, verify: bool = True) -> str:
    """A copy of a file or folder below ``cache``, made if it is not there; its path.

    The copy is made beside its place and renamed when it is whole, so that readers never see half of it; of two that
    copy at once the first one wins. ``always`` copies anew, ``verify`` does so where the sizes differ.
    """
    import uuid

    conf, target = spark._jsc.hadoopConfiguration(), local_cache_path(source, cache)
    a, b, t = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target, f"{target}.{uuid.uuid4().hex[:8]}"))
    files_a, files_b = a.getFileSystem(conf), b.getFileSystem(conf)
    length = lambda files, p: files.getContentSummary(p).getLength()
    there = files_b.exists(b)
    if there and not always and not (verify and length(files_a, a) != length(files_b, b)):
        return target
    files_b.mkdirs(b.getParent())
    copy(spark, source, t.toString())
    if verify and length(files_a, a) != length(files_b, t):
        files_b.delete(t, True)
        raise OSError(f"{source} was not copied whole")
    if there:
        files_b.delete(b, True)
    if files_b.exists(b) or not files_b.rename(t, b):
        files_b.delete(t, True)
    return target


def save_state(spark: SparkSession, path: str, epoch: int, batch: int, seed: int) -> None:
    """The place of a loader in its data, from which :func:`rillflow.operators.batch.resume` goes on."""
    spark.createDataFrame([(epoch, batch, seed)], "epoch int, batch int, seed int").coalesce(1).write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str) -> dict[str, int]:
    return spark.read.schema("epoch int, batch int, seed int").json(path).first().asDict()


def dump_trajectories(df: DataFrame, path: str, key: str = "conv_id", order: str = "turn") -> None:
    """JSON lines of conversations with their turns in order, a folder per ``step`` where there is one."""
    keys = [key, *(["step"] if "step" in df.columns else [])]
    rest = [c for c in df.columns if c not in (*keys, order)]
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("turns"))
    (g.write.mode("append").partitionBy("step") if "step" in keys else g.write.mode("append")).json(path)


def log_metrics(df: DataFrame, path: str, format: str = "json") -> None:
    """Long metrics (step, metric, value) appended, or with ``format="console"`` printed as ``step:k - name:v``."""
    if format == "console":
        # One line per step of a training run's metrics.
        for r in console_lines(df).orderBy("step").toLocalIterator():
            print(r["line"])
        return
    rows = df.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("data"))
    (rows.write.mode("append").json(path) if format == "json" else df.write.mode("append").format(format).save(path))


def console_lines(df: DataFrame) -> DataFrame:
    """(step, line): ``step:k - name:v - ...``, names in order."""
    parts = F.transform("x", lambda m: F.concat(m["metric"], F.lit(":"), m["value"].cast("string")))
    g = df.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("x"))
    return g.select("step", F.concat(F.lit("step:"), F.col("step").cast("string"), F.lit(" - "), F.array_join(parts, " - ")).alias("line"))


def titled(df: DataFrame) -> DataFrame:
    """Metrics with ``title`` and ``series``, the name cut at its first slash; what is no number goes."""
    parts = F.split("metric", "/", 2)
    return df.where(F.col("value").isNotNull()).withColumns({"title": F.get(parts, F.lit(0)), "series": F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))})
