"""MinHash near-dedup with exact confirmation.

1. One Arrow pass over the texts: the set of hashed word shingles, its size and 128-bit fingerprint,
   many universal hash minima, and a bucket per band of minima.
2. Documents of equal sets form classes (map-side combine; a group of a million exact copies is one
   row from here on).
3. Every bucket with several classes names its smallest class the hub; each other class is a candidate
   for its hub: as many candidates as bucket entries, never all pairs. Candidates pass when their
   signatures agree (far below the threshold, so that no true link is lost) and are then confirmed on
   the full sets. Components of confirmed links by alternating large-star and small-star.
4. What hubs could not decide: buckets with several components among the members that are no hub. Their
   signatures, not their texts, are dealt in block pairs of bounded size, which say whose signature agrees
   with that of a member of another component.
5. Only the texts of those are dealt, in block pairs that are bounded in rows and in bytes; pairs of
   different components are compared on the full sets in the first bucket they share, until links join the
   two. A block pair yields fewer links than it has members. Components are found again.

No step gathers a bucket or a component into one task, and nothing of the corpus goes to the driver
but counts. Each step writes to the shared scratch folder, so a lost executor repeats tasks only. Joins
of texts and signatures are told to be sort-merge joins: the same plan at every size, whose hot partitions
are split. Tables of links, roots and buckets are of known size and broadcast below the session's threshold.

Rules: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer words than a shingle are one shingle;
null and empty texts and texts without words have an empty set and no links; whole texts are read, however
long. Ids are of any type that has an order. Where an id comes with several texts, which one pass over digests
tells, each id and text gets a number that stands for the id. Rows without an
id are linked with nothing and kept. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm import words as W
from rillflow.llm.common import discard, materialise, scope
from rillflow.operators.batch import row_index
from rillflow.session import ship

U64 = np.uint64


@dataclass(frozen=True)
class Plan:
    """Shingle width, similarity (``num``/``den``), bands x rows of minima and the signature test.

    With 30 bands of 7 rows a pair at 0.85 shares no bucket once in 110,000 times, at 0.9 once in
    300 million, if minima are independent; of 1,000,000 pairs at 0.85 exactly, 6 shared none. ``least_agree`` of
    the first ``n_sign`` minima must be equal: a pair at 0.85 fails that (more than 5 standard deviations below
    its mean) less than once in 10 million times; none of the million did (``tests/llm/test_near.py``).

    Undecided buckets are dealt in blocks of ``block`` signatures, and of up to ``most`` where a bucket would need over
    8 of them (a pair of blocks takes 3 MB at most); what is left in blocks of ``text_block`` texts or
    ``block_bytes`` of texts and sets, on average.
    """

    width: int = 5
    num: int = 85
    den: int = 100
    bands: int = 30
    rows: int = 7
    n_sign: int = 160
    block: int = 512
    most: int = 2048
    text_block: int = 256
    block_bytes: int = 32 << 20

    @property
    def least_agree(self) -> int:
        p = self.num / self.den
        return max(1, int(self.n_sign * p - 5.3 * (self.n_sign * p * (1 - p)) ** 0.5))


PRODUCTION = Plan()
#: Of ``drop_near_duplicates``: 0.8 or more. A pair at 0.80 shares none of the 40 buckets once in 190,000 times.
DROPPING = Plan(num=80, bands=40, rows=6)
_MULT = {w: W.constants(101, w) | U64(1) for w in (1, 2, 3, 4, 5, 6, 7, 8)}


def weights(width: int) -> np.ndarray:
    return _MULT[width] if width in _MULT else W.constants(101, width) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    found = W.find(data, offsets)
    hashes = found.hashes()
    shingles, owner = W.runs(hashes, found.first, width, weights(width))
    ends = np.searchsorted(owner, np.arange(len(offsets)))
    out, counts, w = [], np.diff(found.first), weights(width)
    for i in range(len(offsets) - 1):
        if counts[i] >= width:
            out.append(np.unique(shingles[ends[i] : ends[i + 1]]))
        elif counts[i]:
            own = hashes[found.first[i] : found.first[i + 1]]
            with np.errstate(over="ignore"):
                out.append(W.mix(np.array([(own * w[: len(own)]).sum(dtype=U64) + U64(len(own))])))
        else:
            out.append(np.zeros(0, U64))
    return out


def minima(values: np.ndarray, mult: np.ndarray, add: np.ndarray, piece: int = 512) -> np.ndarray:
    """The smallest of ``mult * x + add`` (mod 2**32) over the set, for each of the hash functions."""
    x = (values >> U64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.full(len(mult), np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(x), piece):
            part = x[None, a : a + piece] * mult[:, None]
            part += add[:, None]
            np.minimum(out, part.min(axis=1), out=out)
    return out


def fingerprints(plan: Plan):
    """The Arrow function of step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = plan.bands * plan.rows
        mult = (W.constants(7, k) >> U64(32)).astype(np.uint32) | np.uint32(1)
        add = (W.constants(8, k) >> U64(32)).astype(np.uint32)
        spice = W.constants(9, plan.rows) | U64(1)
        band_no = np.arange(plan.bands, dtype=U64) * U64(0x9E3779B97F4A7C15)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, offsets in W.slices(texts):
                sets = shingle_sets(data, offsets, plan.width)
                n = np.array([len(s) for s in sets], np.int64)
                h1, h2 = np.zeros(b - a, U64), np.zeros(b - a, U64)
                bands, signs = np.zeros((b - a, plan.bands), np.int64), np.zeros((b - a, plan.n_sign), np.uint16)
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        if not len(s):
                            continue
                        h1[i], h2[i] = s.sum(dtype=U64), W.mix(s ^ U64(0x5555)).sum(dtype=U64)
                        low = minima(s, mult, add)
                        keys = (low.reshape(plan.bands, plan.rows).astype(U64) * spice).sum(axis=1, dtype=U64)
                        bands[i] = W.mix(keys + band_no).view(np.int64)
                        signs[i] = low[: plan.n_sign].astype(np.uint16)
                flat = pa.array(bands.reshape(-1))
                starts = pa.array(np.arange(0, (b - a + 1) * plan.bands, plan.bands, dtype=np.int32))
                width = plan.n_sign * 2
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(n),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(starts, flat),
                        pa.array([signs[i].tobytes() for i in range(b - a)], pa.binary()) if width else None,
                    ],
                    names=["id", "n", "h1", "h2", "bands", "sign"],
                )

    return run


def agreeing(least: int):
    """Candidates whose signatures agree in ``least`` places at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.filter(pa.array((a == b).sum(axis=1) >= least)).select([0, 1])

    return run


def similar(plan: Plan):
    """Candidates (u, v, text of u, text of v), in the order of v, whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_text, hub_set = None, None, None
        for batch in batches:
            v, text_v = batch.column(1).to_numpy(zero_copy_only=False), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for a, b, data, offsets in W.slices(batch.column(2)):
                for i, own in enumerate(shingle_sets(data, offsets, plan.width), start=a):
                    if hub != v[i] or hub_text != text_v[i]:
                        hub, hub_text = v[i], text_v[i]
                        hub_set = shingle_sets(*W.buffers(text_v.slice(i, 1)), plan.width)[0]
                    both = len(np.intersect1d(own, hub_set, assume_unique=True))
                    keep[i] = both > 0 and plan.den * both >= plan.num * (len(own) + len(hub_set) - both)
            yield batch.filter(pa.array(keep)).select([0, 1])

    return run


def confirm(edges: DataFrame, classes: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The candidates (u, v) of ``edges`` that hold on their signatures and then on their full sets."""
    kind = edges.schema["u"].dataType.simpleString()
    signs = classes.select("rep", "sign")
    signed = edges.join(signs.select(F.col("rep").alias("u"), F.col("sign").alias("su")).hint("merge"), "u")
    signed = signed.join(signs.select(F.col("rep").alias("v"), F.col("sign").alias("sv")).hint("merge"), "v").select("u", "v", "su", "sv")
    likely = materialise(signed.mapInArrow(W.tidy(agreeing(plan.least_agree)), f"u {kind}, v {kind}"), "likely")
    paired = likely.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("tu")).hint("merge"), "u")
    paired = paired.join(texts.select(F.col("rep").alias("v"), F.col("text").alias("tv")).hint("merge"), "v").select("u", "v", "tu", "tv")
    links = materialise(paired.mapInArrow(W.tidy(similar(plan)), f"u {kind}, v {kind}").distinct(), "links")
    discard(likely)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every vertex of ``links`` (u, v), written: root is the smallest vertex of its component.

    Alternating large-star and small-star; each turn is three aggregates by a vertex with a map-side
    combine and a join that adaptive execution splits where a star is large. Ends when a turn changes
    nothing, after about log(diameter) turns.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = materialise(edges, "edges")
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        turned = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        older, edges = edges, materialise(turned.select("e.u", "e.v").where("u > v").distinct(), "edges")
        discard(older)
        before, now = now, state(edges)
        if before == now:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    found = materialise(roots.select(F.col("u").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct()), "roots")
    discard(edges)
    return found


class Block:
    """The members of a block pair of a bucket, in the order of their ids."""

    def __init__(self, key, table, plan: Plan):
        rep = table.column("rep").to_numpy()
        self.table = table.take(pa.array(np.argsort(rep, kind="stable")))
        self.rep, root, self.side = (self.table.column(c).to_numpy() for c in ("rep", "root", "side"))
        self.n, self.plan, band = len(rep), plan, table.column("band")[0].as_py()
        self.signs = np.frombuffer(b"".join(self.table.column("sign").to_pylist()), np.uint16).reshape(self.n, -1)
        self.earlier = np.array(self.table.column("bands").to_pylist(), np.int64).reshape(self.n, -1)[:, :band]
        self.group = np.unique(root, return_inverse=True)[1]
        self.sizes = self.table.column("n").to_numpy()
        self.alone = key[1].as_py() == key[2].as_py()

    def agreeing(self, i: int) -> np.ndarray:
        """The later members of other components and of the other side that are alike in size and signature and share no earlier bucket, the likeliest first."""
        plan, other = self.plan, np.arange(i + 1, self.n)
        other = other[(self.group[other] != self.group[i]) & (self.alone | (self.side[other] != self.side[i]))]
        small, large = np.minimum(self.sizes[other], self.sizes[i]), np.maximum(self.sizes[other], self.sizes[i])
        other = other[plan.den * small >= plan.num * large]
        agree = (self.signs[other] == self.signs[i]).sum(axis=1)
        keep = (agree >= plan.least_agree) & ~(self.earlier[other] == self.earlier[i]).any(axis=1)
        return other[keep][np.argsort(-agree[keep], kind="stable")]

    def join(self, i: int, j: int) -> None:
        self.group[self.group == self.group[j]] = self.group[i]

    def pairs(self, found: list[tuple[int, int]]):
        kind = self.table.schema.field("rep").type
        us, vs = ([f(self.rep[i], self.rep[j]) for i, j in found] for f in (max, min))
        return pa.table({"u": pa.array(us, kind), "v": pa.array(vs, kind)})


def still_open(plan: Plan):
    """(bucket, rep, n) of the members of a block pair with an agreeing member of another component."""

    def run(key, table):
        block = Block(key, table, plan)
        some = np.zeros(block.n, bool)
        for i in range(block.n):
            other = block.agreeing(i)
            some[other] = True
            some[i] |= len(other) > 0
        return block.table.filter(pa.array(some)).select(["bucket", "rep", "n"])

    return run


def undecided(plan: Plan):
    """Links between members of a block pair that belong to different components, by their full sets.

    A pair is looked at in the first bucket it shares only, and only while no link found here joins the
    two already. So a block pair yields fewer links than it has members, whatever their number of similar pairs.
    """

    def run(key, table):
        block, found = Block(key, table, plan), []
        sets: list[np.ndarray] = []
        for _, _, data, offsets in W.slices(block.table.column("text")):
            sets += shingle_sets(data, offsets, plan.width)
        for i in range(block.n):
            for j in block.agreeing(i):
                if block.group[j] == block.group[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if plan.den * both >= plan.num * (len(sets[i]) + len(sets[j]) - both):
                    found.append((i, j))
                    block.join(i, j)
        return block.pairs(found)

    return run


def dealt(members: DataFrame, blocks: Column, carried: list[str]) -> DataFrame:
    """Members (bucket, rep, ..) once for each pair (i, j) of blocks of their bucket that theirs is in, and the side they are on."""
    own = members.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    pair = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")),
    )
    return own.select(*carried, F.explode(pair).alias("p")).select(*carried, "p.i", "p.j", "p.side")


def judge(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id, n, root) of every row, and the tables it reads."""
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, h1 long, h2 long, bands array<long>, sign binary"
    prints = materialise(source.mapInArrow(W.tidy(fingerprints(plan)), schema), "prints")
    named = prints.where("n > 0 and id is not null")
    classes = materialise(
        named.groupBy("h1", "h2", "n")
        .agg(F.min_by(F.struct("id", "bands", "sign"), "id").alias("x"), F.count(F.lit(1)).alias("members"))
        .select("h1", "h2", "n", F.col("x.id").alias("rep"), "members", F.col("x.bands").alias("bands"), F.col("x.sign").alias("sign")),
        "classes",
    )
    entries = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = materialise(entries.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = materialise(entries.join(shared.hint("merge"), "bucket"), "members")
    needed = members.select(F.col("rep").alias("id")).distinct()
    texts = source.join(needed.hint("merge"), "id", "left_semi").select(F.col("id").alias("rep"), "text").distinct()
    texts = materialise(texts, "texts")
    first = members.where("rep > hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    links = confirm(first, classes, texts, plan)
    roots = components(links)

    # The hub stood for its pairs already, so two components among the others make a bucket undecided.
    rooted = members.where("size > 2 and rep <> hub").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "rep")), "rooted")
    mixed = materialise(rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket"), "mixed")
    undone = rooted.join(mixed, "bucket", "left_semi").join(classes.select("rep", "n", "bands", "sign").hint("merge"), "rep")
    undone = materialise(undone, "undone")
    carried = ["bucket", "band", "rep", "root", "n", "bands", "sign"]
    blocks = F.least(F.ceil(F.col("size") / plan.block), F.greatest(F.lit(8), F.ceil(F.col("size") / plan.most))).cast("int")
    signed = dealt(undone, blocks, carried).groupBy("bucket", "i", "j")
    opened = materialise(signed.applyInArrow(still_open(plan), f"bucket long, rep {kind}, n long").distinct(), "open")
    weighed = materialise(opened.groupBy("bucket").agg(F.count(F.lit(1)).alias("left"), F.sum(F.lit(16) * F.col("n")).alias("volume")), "weighed")
    left = undone.join(opened.select("bucket", "rep"), ["bucket", "rep"], "left_semi").join(weighed, "bucket").join(texts.hint("merge"), "rep")
    blocks = F.greatest(F.ceil(F.col("left") / plan.text_block), F.ceil(F.col("volume") / plan.block_bytes)).cast("int")
    more = dealt(left, blocks, [*carried, "text"]).groupBy("bucket", "i", "j").applyInArrow(undecided(plan), f"u {kind}, v {kind}")
    more = materialise(more.distinct(), "more-links")
    discard(rooted, mixed, undone, opened, weighed)
    if not more.isEmpty():
        first_roots, roots = roots, components(links.unionByName(more))
        discard(first_roots)
    discard(shared, members, texts, links, more)

    # Only classes with several documents or another root than their own change anything.
    moved = classes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").where("members > 1 or root is not null")
    moved = materialise(moved.select("h1", "h2", "n", F.coalesce("root", "rep").alias("root")), "moved")
    discard(classes, roots)
    salts = 16
    salted = moved.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    judged = prints.select("id", "n", "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    judged = judged.join(salted.hint("merge"), ["h1", "h2", "n", "salt"], "left")
    root = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("root", "id")).otherwise(F.col("id"))
    return judged.select("id", "n", root.alias("root")), [prints, moved]


def text_digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))


def texts_of_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(id, digest, no), written: a number for each id and text, in the order of ids; None where no id has several texts."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_digest(text_col).alias("digest")).where("id is not null")
    if rows.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").isEmpty():
        return None
    with scope() as kept:
        numbered = materialise(row_index(rows.distinct(), ["id", "digest"], "no"), "texts-of-ids")
        kept.append(numbered)
    return numbered


def judge_texts(docs: DataFrame, numbers: DataFrame, plan: Plan, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """:func:`judge` with the numbers of :func:`texts_of_ids` for ids; rows without an id have none."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), text_digest(text_col).alias("digest"))
    return judge(rows.join(numbers.hint("merge"), ["id", "digest"], "left").select("no", "text"), plan, "no", "text")


def near_duplicates(docs: DataFrame, plan: Plan = PRODUCTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept``.

    An id with several texts is one document that is linked with whatever any of them is near. Null and empty texts, texts
    without words and rows without an id are linked with nothing and kept; repeated rows come back as often as
    they came, an empty table stays empty.
    """
    numbers = texts_of_ids(docs, id_col, text_col)
    if numbers is None:
        out = judge(docs, plan, id_col, text_col)[0]
    else:
        judged = judge_texts(docs, numbers, plan, id_col, text_col)[0]
        one = numbers.groupBy("id").agg(F.min("no").alias("v"))
        links = judged.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(numbers.join(one, "id").select(F.col("no").alias("u"), "v"))
        found = components(links.where("u <> v").distinct()).select(F.col("id").alias("no"), F.col("root").alias("end"))
        rooted = judged.select(F.col("id").alias("no"), "n").join(found, "no", "left").withColumn("end", F.coalesce("end", "no"))
        rooted = rooted.join(numbers.select("no", "id"), "no", "left")
        out = rooted.join(numbers.select(F.col("no").alias("end"), F.col("id").alias("root")), "end", "left").select("id", "n", "root")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, plan: Plan = DROPPING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id; all columns stay.

    Where an id has several texts, each is judged by itself, and the text that sorts first stays of those that are near
    each other, so that every text that goes has one that stays. Rows that repeat id and text go or stay
    together. Documents without words or without an id stay, an empty table stays empty, columns may have any other names.
    """
    numbers = texts_of_ids(docs, id_col, text_col)
    if numbers is None:
        judged, used = judge(docs, plan, id_col, text_col)
        gone = materialise(judged.where("id <> root").select(F.col("id").alias("__gone")).distinct(), "gone")
        discard(*used)
        return docs.join(gone.hint("merge"), F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    judged, used = judge_texts(docs, numbers, plan, id_col, text_col)
    gone = judged.where("id <> root").select(F.col("id").alias("no")).distinct().join(numbers, "no")
    gone = materialise(gone.select(F.col("id").alias("__gone"), F.col("digest").alias("__digest")), "gone")
    discard(*used)
    same = (F.col(f"`{id_col}`") == F.col("__gone")) & (text_digest(text_col) == F.col("__digest"))
    return docs.join(gone.hint("merge"), same, "left_anti")
