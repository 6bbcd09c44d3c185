"""Filters on rows and on groups of rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import seeded
from rillflow.operators.batch import row_index


def mixed_groups(df: DataFrame, metric: str, group: str = "uid") -> DataFrame:
    """Rows of groups whose metric varies, and of groups of one."""
    g = df.groupBy(F.col(group).alias("__g")).agg((F.max(metric) != F.min(metric)).alias("__v"), F.count(F.lit(1)).alias("__n"))
    keep = g.where("__v or __n = 1").select("__g")
    return df.join(keep, F.col(group).eqNullSafe(F.col("__g")), "left_semi")


def dynamic_sampling(df: DataFrame, metric: str, prompts: int, group: str = "uid", batch: str = "gen_batch", max_batches: int = 0) -> DataFrame:
    """Mixed groups of as many generation batches as it takes, cut to ``prompts`` groups, in the order of (batch, group).

    Raises where ``max_batches`` (0: no limit) batches don't hold enough of them.
    """
    kept = mixed_groups(df, metric, group)
    order = row_index(kept.groupBy(group).agg(F.min(batch).alias("__b")), ["__b", group], "__rank")
    used = order.where(F.col("__rank") < prompts)
    if max_batches and used.where(F.col("__b") < max_batches).count() < prompts:
        raise ValueError(f"{max_batches} batches hold fewer than {prompts} mixed prompts")
    return kept.join(used.select(F.col(group).alias("__g")), F.col(group).eqNullSafe(F.col("__g")), "left_semi")


def accuracy_band(df: DataFrame, acc: str, length: str, low: float, high: float, max_length: int, oversample: float, group: str = "uid", order: str = "seq_id") -> DataFrame:
    """Groups whose mean accuracy lies in [low, high] and whose longest row stays below max_length - 1 come first; the first rows / oversample rows stay.

    Other groups may fill the rest: this reorders and cuts.
    """
    g = df.groupBy(F.col(group).alias("__g")).agg(F.avg(acc).alias("__a"), F.max(length).alias("__l"), F.min(order).alias("__o"))
    ok = (F.col("__a") >= low) & (F.col("__a") <= high) & (F.col("__l") < max_length - 1)
    t = df.join(g.select("__g", "__o", ok.alias("passed")).hint("shuffle_hash"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    indexed = row_index(t, [F.col("passed").desc(), F.col("__o"), F.col(order)], "rank")
    return indexed.where(F.col("rank") < int(indexed.count() // oversample)).drop("__o")


def not_aborted(length: str = "response_length") -> Column:
    return F.col(length) > 0


def sample_groups(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """All rows of at most k groups, chosen by a seeded hash."""
    chosen = df.select(F.col(group).alias("__g")).distinct().orderBy(seeded.order(seed, "__g"), "__g").limit(k)
    return df.join(chosen, F.col(group).eqNullSafe(F.col("__g")), "left_semi")


def within_length(df: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """Prompts of at most ``limit`` tokens; where the count is null, the tokenizer failed, and the row goes."""
    return df.where(F.coalesce(tokens <= limit, F.lit(False)))


def valid_content(content: Column) -> Column:
    """Text with something visible outside its think block, and inside; at most one block, opened and closed. A null content is no text and passes."""
    opens, closes = F.regexp_count(content, F.lit("<think>")), F.regexp_count(content, F.lit("</think>"))
    inside = F.regexp_extract(content, r"(?s)<think>(.*?)</think>", 1)
    seen = F.regexp_replace(F.trim(F.regexp_replace(content, r"(?s)<think>.*?</think>", "")), r"<\|im_end\|>$", "")
    blank = lambda c: ~c.rlike(r"\S")
    return F.when(content.isNull(), F.lit(True)).otherwise((opens == closes) & (opens <= 1) & ((opens == 0) | ~blank(inside)) & ~blank(seen))


def valid_messages(messages: str = "messages") -> Column:
    return F.coalesce(F.forall(messages, lambda m: valid_content(m["content"])), F.lit(False))


def without_think(text: Column) -> Column:
    """The text without its think block."""
    return F.trim(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def date_range(column: str, start: str, end: str) -> Column:
    """Strings of ISO dates within [start, end), compared as strings; pushed down to the scan."""
    return (F.col(column) >= start) & (F.col(column) < end)
