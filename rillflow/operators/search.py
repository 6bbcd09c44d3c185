"""Retrieval: dense top-k by inner product, and sparse ranking by BM25."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.scratch import materialise
from rillflow.session import ship


def pool(hidden: str, mask: str, how: str = "mean") -> Column:
    """A vector from vectors of tokens: their masked mean, or the first."""
    if how == "cls":
        return F.get(hidden, F.lit(0))
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}")
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    zero = F.transform(F.get(hidden, F.lit(0)), lambda x: F.lit(0.0))
    kept = F.zip_with(hidden, mask, lambda v, m: F.transform(v, lambda x: x * m))
    total = F.aggregate(kept, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


#: Rows of a block of vectors, bytes of the blocks that one task meets all queries with, and of scores that it holds at once.
BLOCK, GROUP_BYTES, SCORE_BYTES = 1024, 256 << 20, 32 << 20


def best_of(q: np.ndarray, k: int, parts: Iterator[tuple[pa.Array, np.ndarray]]):
    """(scores, ids) of the k best rows of all parts (ids, matrix) for each query; ties by the smaller id, fewer where there are fewer."""
    best_s, best_d = np.zeros((len(q), 0)), None
    for names, x in parts:
        ids = names.to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        top = min(k, len(ids))
        s, d = np.empty((len(q), top)), np.empty((len(q), top), ids.dtype)
        rows = max(1, SCORE_BYTES // (8 * len(ids)))
        for a in range(0, len(q), rows):  # rows stand in the order of their ids, so a stable sort keeps ties right
            part = q[a : a + rows] @ x.T
            at = np.argsort(-part, axis=1, kind="stable")[:, :top]
            s[a : a + rows], d[a : a + rows] = np.take_along_axis(part, at, 1), ids[at]
        if best_d is not None:
            s, d = np.concatenate([best_s, s], 1), np.concatenate([best_d, d], 1)
            by_id = np.argsort(d, axis=1, kind="stable")
            s, d = np.take_along_axis(s, by_id, 1), np.take_along_axis(d, by_id, 1)
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            s, d = np.take_along_axis(s, at, 1), np.take_along_axis(d, at, 1)
        best_s, best_d = s, d
    return best_s, best_d


def blocks(df: DataFrame, name: str, vector: str, rows: int, label: str) -> DataFrame:
    """(no, ids, vectors), written: rows with a vector, packed ``rows`` to a block where they stand; vectors lie one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                flat = part.column(1).flatten().cast(pa.float64())
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["ids", "vectors"])

    kind = df.schema[name].dataType.simpleString()
    packed = df.select(name, vector).mapInArrow(run, f"ids array<{kind}>, vectors array<double>")
    return materialise(packed.withColumn("no", F.monotonically_increasing_id()), label)


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "query_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank from 1) of the k best inner products; ties by the smaller doc id.

    Both sides are packed into blocks, which meet on the executors: blocks of the corpus are dealt to groups, each group's are
    joined with all blocks of queries, and a task multiplies one matrix with another and keeps its k best per
    query until the next block of queries comes, so that k rows per query and group are shuffled. Nothing passes the driver but
    the numbers of blocks. Ids are of any type with an order; rows without a vector are no candidates and ask nothing.
    """
    ship()
    spark = corpus.sparkSession
    asked, stored = blocks(queries, query_id, vector, block, "query-blocks"), blocks(corpus, doc_id, vector, block, "corpus-blocks")
    n, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("vectors").cast("long")), F.lit(0))).first()
    groups = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))))
    name_kind, doc_kind = asked.schema["ids"].dataType.elementType, stored.schema["ids"].dataType.elementType
    kinds = f"query_id {name_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score double"

    def matrix(cells: pa.Array, i: int, rows: int) -> np.ndarray:
        return cells[i].values.to_numpy(zero_copy_only=False).reshape(rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (no, ids and vectors of the queries, ids and vectors of the corpus); those of one block of queries come in a row."""
        pairs = ((batch, i) for batch in batches for i in range(batch.num_rows))
        for _, own in groupby(pairs, key=lambda x: x[0].column(0)[x[1]].as_py()):
            batch, i = next(own)
            names = batch.column(1)[i].values
            q = matrix(batch.column(2), i, len(names))
            parts = ((b.column(3)[j].values, matrix(b.column(4), j, len(b.column(3)[j]))) for b, j in chain([(batch, i)], own))
            scores, ids = best_of(q, k, parts)
            who = names.take(pa.array(np.repeat(np.arange(len(names)), ids.shape[1])))
            yield pa.RecordBatch.from_arrays([who, pa.array(ids.ravel(), batch.column(3).type.value_type), pa.array(scores.ravel())], names=["query_id", "doc_id", "score"])

    left = asked.select("no", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = stored.select(F.pmod(F.hash("no"), F.lit(groups)).alias("g"), F.col("ids").alias("d_ids"), F.col("vectors").alias("d"))
    met = left.hint("merge").join(right, "g").select("no", "q_ids", "q", "d_ids", "d")
    found = met.mapInArrow(run, kinds)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("query_id").alias(query_id), F.col("doc_id").alias(doc_id), "score", "rank")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def beside(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """A written table to join with: broadcast if its measured bytes allow, else by sort-merge."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.agg(F.count(F.lit(1)) * (32 + 8 * len(df.columns)), *[F.sum(t.cast("long")) for t in texts]).first()
    return F.broadcast(df) if sum(x or 0 for x in size) <= max_bytes else df.hint("merge")


#: Bytes of texts whose words a task counts, and pairs of a query and a document that it adds up.
COUNT_BYTES, TASK_PAIRS = 8 << 20, 1 << 20


def bm25(corpus: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text", k1: float = 0.9, b: float = 0.4, max_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best by BM25.

    Documents are dealt by their id over as many tasks as their bytes and, for the scores, their pairs with queries ask for, so
    that what a task holds does not grow with the corpus, and words and scores of a document are added up where it lies.
    Texts are split once: only words of the queries are counted, and a row without a word stands for each document and
    carries its length. Frequencies are written, as both document frequencies and scores come from them. What grows with the
    queries (their words, and which query has which) is broadcast up to ``max_bytes`` as measured, else joined by sort-merge.
    The k best of a query are cut per task before they meet.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    size = corpus.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    q = materialise(queries.select(query_id, F.explode(F.array_distinct(terms(F.col(text)))).alias("term")), "query-words")
    words = materialise(q.select("term").distinct().unionByName(q.sparkSession.range(1).select(F.lit("").alias("term"))), "words")
    dealt = corpus.select(doc_id, text).repartition(max(cores, -(-size // COUNT_BYTES)), doc_id)
    docs = dealt.select(doc_id, terms(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    every = docs.select(doc_id, "len", F.explode(F.concat(F.array(F.lit("")), "t")).alias("term")).join(beside(words, max_bytes), "term")
    tf = materialise(every.groupBy(doc_id, "len", "term").agg(F.count(F.lit(1)).alias("tf")), "frequencies")
    totals = tf.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    found = tf.where("term <> ''")
    df_ = materialise(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    asked = q.groupBy("term").agg(F.count(F.lit(1)).alias("qf"))
    pairs = min(df_.join(asked, "term").agg(F.sum(F.col("df") * F.col("qf"))).first()[0] or 0, (totals.first()["n"] or 0) * q.select(query_id).distinct().count())
    t = found.join(beside(df_, max_bytes), "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    t = t.select(doc_id, "term", weight.alias("w")).repartition(max(cores, -(-pairs // TASK_PAIRS)), doc_id)
    scored = t.join(beside(q, max_bytes), "term").groupBy(query_id, doc_id).agg(F.sum("w").alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), doc_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lookup(corpus: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents by id, for the few rows of a result."""
    return wanted.join(corpus, key, "left")


def title_and_text(contents: Column) -> tuple[Column, Column]:
    """The first line, and the rest."""
    parts = F.split(contents, "\n", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def passages(results: str) -> Column:
    """``Doc 1 (Title: ...)`` blocks of an array of contents, with an empty line between them."""

    def one(contents: Column, i: Column) -> Column:
        title, text = title_and_text(contents)
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), title, F.lit(")\n"), text)

    return F.trim(F.array_join(F.transform(results, one), "\n\n"))
