"""Benchmark decontamination: document token windows are looked up in a hash set of benchmark n-grams.

No Python runs in it. One scan of the documents explodes the hashes of their windows into a broadcast
hash join with the distinct windows of the benchmark, hits are verified on the words themselves, and
only hits are shuffled. The broadcast holds each window once, however many items share it, and its bytes
are measured first; a benchmark beyond ``max_broadcast_bytes`` is met by one sort-merge join on the window
hash instead, again with one scan that explodes, and candidates are verified when they meet the texts.

Windows that are in the same items share an item set, and documents that hit the same sets share their union: item
lists are put together once for each such union, not for each document, and need not come along with documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import ascii_lower, discard, let, materialise, run_hashes, word_hashes

#: A word is a run of a-z, 0-9 and all that lies beyond ASCII, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: The hash under which every document itself is joined, at position 0 only.
MARKER = -(1 << 63)


def token_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, sets), both written: each distinct window (w_hash, w_width, w_words, w_set), and the items of each set (w_set, items).

    An item of fewer words than ``width``, but not none, is one window of all its words; items without
    words have none; null ids are one item ``null``. ``w_set`` is the count of the items and two
    xor-ed hashes of them, so that no item list is gathered per window; a set's list is gathered once,
    sorted as strings, and is as long as the list of a document that hits it.
    """
    words = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("__item"), token_words(F.col(text_col)).alias("__words"))
    own = F.least(F.size("__words"), F.lit(width))
    spans = F.transform(F.sequence(F.lit(0), F.size("__words") - own), lambda i: F.slice("__words", i + 1, own))
    pairs = materialise(words.where(F.size("__words") > 0).select("__item", F.explode(spans).alias("w_words")).distinct(), "window-items")
    mark = F.struct(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("__item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), F.col("__item"))).alias("b")
    )
    windows = pairs.groupBy("w_words").agg(mark.alias("w_set"))
    each = word_hashes(F.col("w_words"))
    whole = F.coalesce(*[F.when(F.size("w_words") == k, F.get(run_hashes(each, [k]), F.lit(0))) for k in range(1, width + 1)])
    windows = materialise(windows.select(whole.alias("w_hash"), F.size("w_words").alias("w_width"), "w_words", "w_set"), "windows")
    one = windows.groupBy("w_set").agg(F.min("w_words").alias("w_words"))
    sets = one.join(pairs.hint("merge"), "w_words").groupBy("w_set").agg(F.sort_array(F.collect_set("__item")).alias("items"))
    sets = materialise(sets, "window-sets")
    discard(pairs)
    return windows, sets


def broadcast_bytes(windows: DataFrame) -> int:
    """About the bytes that ``windows`` takes as a broadcast hash table."""
    each = F.octet_length(F.array_join("w_words", "")) + F.lit(16) * F.col("w_width") + F.lit(120)
    return windows.agg(F.sum(each.cast("long"))).first()[0] or 0


def hit_positions(
    docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """(__id, text_crc, __n, __rows, hits, sets) of every distinct id and text of ``docs``.

    ``__n`` words, ``__rows`` equal rows, ``hits`` the words (from 0, ascending) inside any occurrence of a
    window, ``sets`` the item sets of those windows.
    """
    # At most ``width`` different widths exist, however large the benchmark is.
    widths = sorted(r[0] for r in windows.select("w_width").distinct().collect())
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_crc"), token_words(F.col(f"`{text_col}`")).alias("__words")
    )
    probes = F.concat(F.array(F.lit(MARKER)), run_hashes(word_hashes(F.col("__words")), widths))
    start, starts = F.lit(1), {}
    for k in widths:
        starts[k] = start
        start = start + F.greatest(F.col("__n") - (k - 1), F.lit(0))
    first = reduce(lambda c, k: c.when(F.col("w_width") == k, starts[k]), widths, F.when(F.col("w_width") == 0, F.lit(0)))
    covered = lambda spans: F.sort_array(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["k"] - 1)))))
    counted = rows.select("__id", "text_crc", "__words", F.size("__words").alias("__n"))
    if broadcast_bytes(windows) <= max_broadcast_bytes:
        # One row per document that always joins: it carries the word count and the number of equal rows.
        marker = docs.sparkSession.range(1).select(
            F.lit(MARKER).alias("w_hash"), F.lit(0).alias("w_width"), F.array().cast("array<string>").alias("w_words"), F.lit(None).cast(windows.schema["w_set"].dataType).alias("w_set")
        )
        probed = counted.select("*", F.posexplode(probes).alias("__pos", "__hash"))
        found = probed.join(F.broadcast(windows.unionByName(marker)), F.col("__hash") == F.col("w_hash")).withColumn("__at", F.col("__pos") - first)
        is_marker = (F.col("w_width") == 0) & (F.col("__pos") == 0)
        same = F.slice("__words", F.greatest(F.col("__at"), F.lit(0)) + 1, F.greatest("w_width", F.lit(1))) == F.col("w_words")
        is_window = (F.col("w_width") > 0) & (F.col("__at") >= 0) & same
        hits = found.where(is_marker | is_window).select(
            "__id",
            "text_crc",
            "__n",
            F.when(F.col("w_width") == 0, 1).otherwise(0).alias("__row"),
            F.when(F.col("w_width") > 0, F.struct(F.col("__at").alias("at"), F.col("w_width").alias("k"))).alias("__span"),
            "w_set",
        )
        grouped = hits.groupBy("__id", "text_crc", "__n").agg(
            F.sum("__row").alias("__rows"), F.collect_set("__span").alias("__spans"), F.collect_set("w_set").alias("sets")
        )
        return grouped.select("__id", "text_crc", "__n", "__rows", covered(F.col("__spans")).alias("hits"), "sets")
    # Texts stay behind while positions meet the windows: 40 bytes a word are shuffled, whatever hits.
    probed = counted.select("__id", "text_crc", "__n", F.posexplode(probes).alias("__pos", "__hash"))
    met = probed.join(windows.hint("merge"), F.col("__hash") == F.col("w_hash")).withColumn("__at", F.col("__pos") - first).where("__at >= 0")
    likely = met.groupBy("__id", "text_crc").agg(F.collect_set(F.struct(F.col("__at").alias("at"), F.col("w_width").alias("k"), "w_words", "w_set")).alias("__met"))
    likely = likely.select(F.col("__id").alias("__met_id"), F.col("text_crc").alias("__met_crc"), "__met")
    same = F.col("__id").eqNullSafe(F.col("__met_id")) & (F.col("text_crc") == F.col("__met_crc"))
    beside = counted.join(likely.hint("merge"), same, "left")
    true = F.filter(F.coalesce("__met", F.array().cast(likely.schema["__met"].dataType)), lambda m: F.slice("__words", m["at"] + 1, m["k"]) == m["w_words"])
    return (
        beside.select("__id", "text_crc", "__n", true.alias("__true"))
        .groupBy("__id", "text_crc", "__n")
        .agg(F.count(F.lit(1)).alias("__rows"), F.first("__true").alias("__true"))
        .select("__id", "text_crc", "__n", "__rows", covered(F.col("__true")).alias("hits"), F.array_distinct(F.transform("__true", lambda m: m["w_set"])).alias("sets"))
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    max_broadcast_bytes: int = 64 << 20,
    lists: bool = True,
) -> DataFrame:
    """Per row of ``docs``: id, a checksum of its text, n_words, hit positions (ascending) and the items found.

    Columns: ``id_col`` (any type; not one of the other names), ``text_crc``, ``n_words`` long, ``hits array<int>`` (0-based
    words inside any occurrence of a window), ``items array<string>`` (sorted as strings), or, without ``lists``, ``n_items`` and
    the digest ``items_sha256`` of the list; no other column of ``docs`` is read. Null and empty texts have no words, whole texts are read, however long. Rows that repeat both
    id and text come back as often as they came. An empty benchmark hits nothing, an empty table stays empty.
    """
    windows, sets = benchmark_windows(benchmark, width, item_col, text_col)
    found = materialise(hit_positions(docs, windows, id_col, text_col, max_broadcast_bytes), "window-hits")
    discard(windows)
    # Documents that hit the same sets, as copies of a passage do, share their list: it is put together once.
    found = found.withColumn("__sets", F.sort_array("sets"))
    some = materialise(found.where(F.size("sets") > 0).select("__sets").distinct(), "set-unions")
    each = some.select("__sets", F.explode("__sets").alias("w_set")).join(sets.hint("merge"), "w_set")
    unions = each.groupBy("__sets").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    if not lists:
        unions = unions.select("__sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    unions = materialise(unions, "items-of-sets")
    discard(some, sets)
    out = found.join(unions.hint("merge"), "__sets", "left")
    if lists:
        told = [F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    else:
        told = [F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256")]
    return out.select(
        F.col("__id").alias(id_col),
        "text_crc",
        F.col("__n").cast("long").alias("n_words"),
        "hits",
        *told,
        F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))).alias("__copy"),
    ).drop("__copy")


def hit_texts(docs: DataFrame, benchmark: DataFrame, max_hit_words: int, width: int, id_col: str, text_col: str, item_col: str, max_broadcast_bytes: int) -> DataFrame:
    """(__hit_id, __hit_crc, __hits) of the texts with more than ``max_hit_words`` hit words, written."""
    windows, sets = benchmark_windows(benchmark, width, item_col, text_col)
    found = hit_positions(docs, windows, id_col, text_col, max_broadcast_bytes).where(F.size("hits") > max_hit_words)
    found = materialise(found.select(F.col("__id").alias("__hit_id"), F.col("text_crc").alias("__hit_crc"), F.col("hits").alias("__hits")), "hit-texts")
    discard(windows, sets)
    return found


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    max_hit_words: int = 0,
    width: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` without the documents that have more than ``max_hit_words`` hit words; all columns stay.

    Null and empty texts stay, repeated rows stay repeated, an empty table stays empty, columns may have any
    other names. Texts and what was found meet in a sort-merge join at every size.
    """
    bad = hit_texts(docs, benchmark, max_hit_words, width, id_col, text_col, item_col, max_broadcast_bytes).drop("__hits")
    rows = docs.withColumn("__crc", F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.col("__crc") == F.col("__hit_crc"))
    return rows.join(bad.hint("merge"), same, "left_anti").drop("__crc")


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` with the hit words cut out of the text, and the separators that follow them.

    Texts without hits are returned as they are, null and empty ones too; all columns and rows stay.
    """
    found = hit_texts(docs, benchmark, 0, width, id_col, text_col, item_col, max_broadcast_bytes)
    rows = docs.withColumn("__crc", F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.col("__crc") == F.col("__hit_crc"))
    # Separators may be A-Z free only after lower-casing, so the cut runs on a class that holds both cases.
    token = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"

    def cut(pieces: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("__hits"))
        return F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "")

    lead = F.regexp_extract(F.col(text_col), r"\A[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    body = let(F.regexp_extract_all(F.col(text_col), F.lit(token), F.lit(0)), cut)
    out = rows.join(found.hint("merge"), same, "left").withColumn(text_col, F.when(F.col("__hits").isNull(), F.col(text_col)).otherwise(F.concat(lead, body)))
    return out.drop("__crc", "__hits", "__hit_id", "__hit_crc")
