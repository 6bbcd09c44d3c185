"""A curriculum that learns: what a run reports of its samples, as a stream, decides the next order and what the dataset grows by.

Each micro-batch of feedback is a folder of its own, named by the batch's number, and writing it again replaces it. So a
batch that is delivered twice changes nothing, which is all that ``foreachBatch`` promises; the next order is computed
from the folders that there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.batch import curriculum, grow


@dataclass(frozen=True)
class Feedback:
    """Feedback rows (``key``, ``value`` columns and others) below ``path``, a folder that all executors share."""

    path: str
    key: str
    value: str

    def sink(self, df: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: idempotent by the batch's number."""
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch:010d}")

    def rows(self, spark: SparkSession, schema) -> DataFrame:
        """All feedback so far with its ``batch_id``; none where nothing was reported yet."""
        files = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
            return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0).cast("long"))
        return spark.read.schema(schema).parquet(f"{self.path}/batch_id=*").withColumn("batch_id", F.regexp_extract(F.input_file_name(), "batch_id=(\\d+)", 1).cast("long"))

    def summary(self, spark: SparkSession, schema, decay: float = 1.0) -> DataFrame:
        """(key, n, mean, last): of each sample, how often it was reported, the mean of its values, weighed by ``decay`` per batch of age, and the last batch's mean."""
        rows = self.rows(spark, schema)
        per = rows.groupBy(self.key, "batch_id").agg(F.count(self.value).alias("n"), F.sum(F.col(self.value).cast("double")).alias("s"))
        per = per.crossJoin(F.broadcast(rows.agg(F.max("batch_id").alias("__now"))))
        w = F.pow(F.lit(float(decay)), F.col("__now") - F.col("batch_id"))
        mean = F.try_divide(F.sum(w * F.col("s")), F.sum(w * F.col("n")))
        return per.groupBy(self.key).agg(F.sum("n").alias("n"), mean.alias("mean"), F.max_by(F.try_divide("s", "n"), "batch_id").alias("last"))

    def next_order(self, df: DataFrame, schema, priority: Column, decay: float = 1.0, name: str = "row_idx") -> DataFrame:
        """``df`` in ascending order of ``priority`` (over n, mean, last), samples without feedback first."""
        return curriculum(df, self.summary(df.sparkSession, schema, decay), self.key, priority, name)

    def grown(self, df: DataFrame, schema, made: str, keep: Column) -> DataFrame:
        """``df`` with the rows that the feedback brings in the struct column ``made``, those for which ``keep`` holds; a row made twice comes once."""
        new = self.rows(df.sparkSession, schema).where(F.col(made).isNotNull() & keep).select(f"{made}.*").distinct()
        return grow(df, new, F.lit(True))
