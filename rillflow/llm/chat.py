"""Chat formatting: conversations as one text each, with the span of every turn and the part of it that is learnt from.

A template is a black box, a function from a list of messages (``role``, ``content``) to a text. Successive
prefixes of a conversation are rendered; what a prefix has more than the one before is the new turn's span. A
prefix that doesn't start with the one before gives away a template that rewrites history: its turns are named, and
nothing of that text is put under the loss mask. Within a span, the content is found by rendering the same turn
with a stand-in for its content: what stands before and behind the stand-in is the template's.

Rendering every prefix costs the square of a conversation, and a conversation may be as long as it likes. So a
template has a ``reach``: how many turns back it looks or rewrites. Prefixes then start that many turns before a window of
``window`` turns, and a conversation of more than ``piece`` turns is dealt out in pieces, each with the turns before it
that the template can see. Pieces are found by a range sort, so that a conversation with a third of all rows is
many tasks. ``reach=None`` renders all prefixes of whole conversations, which is right for every template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm import words as W
from rillflow.llm.common import materialise, numbered
from rillflow.session import ship

Render = Callable[[list[dict]], str]

#: Turns of a piece, and of a window of prefixes within it.
PIECE, WINDOW = 256, 32
#: Stand-ins for contents, private characters; the first that a text has not.
STAND_INS = [chr(0xE000 + i) for i in range(64)]

TURNS = "array<struct<role:string,start:int,end:int,body_start:int,body_end:int,loss:boolean,rewrote:boolean>>"

_MARKS = re.compile(r"\\|</?turn")
_ROLE = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n", re.S)


def marked_turns(messages: list[dict]) -> str:
    """The template of the registered query: ``<turn ROLE>``, the content and ``</turn>``, a line break behind either mark.

    A backslash stands before each backslash, ``<turn`` and ``</turn`` of a content, so that marks can't be forged and
    contents can be read back.
    """
    return "".join(f"<turn {_ROLE.sub(r'\\\g<0>', m['role'])}>\n{_MARKS.sub(r'\\\g<0>', m['content'])}</turn>\n" for m in messages)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_marked(text: str) -> list[tuple[str, str]]:
    """The roles and contents of a text of :func:`marked_turns`."""
    out, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def locate(render: Render, messages: list[dict], first: int, loss_roles: frozenset[str], reach: int | None, window: int) -> tuple[str, list[dict]]:
    """The text of ``messages[first:]`` and where its turns are; those before ``first`` are only looked back at."""
    start, text, length, turns, broken = 0, [], 0, [], False
    before = render(messages[:first]) if first else ""
    for k in range(first, len(messages)):
        if reach is not None and k - start >= window + reach:
            start = k - reach
            before = render(messages[start:k]) if start < k else ""
        now, m = render(messages[start : k + 1]), messages[k]
        turn = {"role": m["role"], "start": length, "end": None, "body_start": None, "body_end": None, "loss": False, "rewrote": not now.startswith(before)}
        if turn["rewrote"]:
            broken = True
        else:
            span = now[len(before) :]
            turn["end"] = length + len(span)
            if m["role"] in loss_roles:
                body = content(render, messages[start:k], m["role"], before, span)
                if body:
                    turn |= {"body_start": length + body[0], "body_end": length + body[1], "loss": True}
            text.append(span)
            length += len(span)
        turns.append(turn)
        before = now
    if broken:
        whole, base = render(messages), render(messages[:first]) if first else ""
        for t in turns:
            t |= {"start": None, "end": None, "body_start": None, "body_end": None, "loss": False}
        return whole[len(base) :] if whole.startswith(base) else whole, turns
    return "".join(text), turns


def content(render: Render, earlier: list[dict], role: str, before: str, span: str) -> tuple[int, int] | None:
    """Where a turn's content lies in its span; None where what stands around it depends on it."""
    mark = next((c for c in STAND_INS if c not in span), None)
    shown = render([*earlier, {"role": role, "content": mark}]) if mark else ""
    if not mark or not shown.startswith(before) or shown.count(mark, len(before)) != 1:
        return None
    head, _, foot = shown[len(before) :].partition(mark)
    if len(span) < len(head) + len(foot) or not span.startswith(head) or not span.endswith(foot):
        return None
    return len(head), len(span) - len(foot)


def renderer(render: Render, loss_roles: frozenset[str], reach: int | None, window: int):
    """Batches (first, messages, others..) to (others.., formatted, turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), *[(c, pa.int32()) for c in ("start", "end", "body_start", "body_end")], ("loss", pa.bool_()), ("rewrote", pa.bool_())]))
        for batch in batches:
            for i in range(batch.num_rows):
                text, turns = locate(render, batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), loss_roles, reach, window)
                others = [c.slice(i, 1) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*others, pa.array([text], pa.string()), pa.array([turns], kind)], names=[*batch.schema.names[2:], "formatted", "turns"])

    return W.tidy(run)


def format_conversations(
    rows: DataFrame,
    render: Render = marked_turns,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
    reach: int | None = 1,
    window: int = WINDOW,
    piece: int = PIECE,
) -> DataFrame:
    """(conv, piece, n_pieces, formatted, turns): a conversation is its pieces' texts one after another, one piece unless it has more than ``piece`` turns.

    ``turns`` has, per turn, role, start and end in its piece's text (code points), body_start and body_end (its content,
    where it is under the loss mask), loss, and rewrote (its prefix doesn't start with the one before). Where a turn
    rewrote, the piece is the rendering of its messages and no turn has a place.

    Rows are ordered by turn (null first), then role, then the MD5 of the text; repeated rows are turns of their own. Null roles and
    texts are empty; a null id is a conversation of its own; an empty table has none. Texts are as long as they like.
    Ids may be of any type that can be grouped, other columns are not read, whatever their names.
    """
    if reach is not None and not 0 <= reach <= piece:
        raise ValueError("a reach is 0 to the turns of a piece")
    ship(rows.sparkSession)
    col = lambda c: F.col(f"`{c}`")
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    plain = rows.select(F.struct(col(conv_col).alias("id")).alias("part"), col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("content"))
    plain = plain.withColumn("tie", F.md5(F.col("content").cast("binary")))
    messages = lambda c: F.transform(c, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    step = renderer(render, frozenset(loss_roles), reach, window)
    kind = rows.schema[conv_col].dataType.simpleString()

    def rendered(pieces: DataFrame) -> DataFrame:
        """``pieces``: part, piece, n_pieces, first, x (ordered)."""
        given = pieces.select("first", messages(F.col("x")).alias("messages"), F.col("part.id").alias("id"), "piece", "n_pieces")
        return given.mapInArrow(step, f"id {kind}, piece long, n_pieces long, formatted string, turns {TURNS}")

    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    one = [F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("n_pieces"), F.lit(0).alias("first"), "x"]
    long = None
    if reach is not None:
        found = materialise(plain.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece), "long-conversations")
        long = found if found.limit(1).count() else None
    if long is None:
        short = plain
    else:
        # Their number is below rows / piece, yet without a bound: Spark decides by the size of the written table.
        short = plain.join(long, "part", "left_anti")
        rest = numbered(plain.join(long.select("part"), "part"), [F.col("turn"), F.col("role"), F.col("tie"), F.rand(5)])
        own = F.expr(f"pos div {piece}")
        last = (F.pmod("pos", F.lit(piece)) >= piece - reach) & ((own + 1) * piece < F.col("n"))
        dealt = rest.withColumn("piece", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
        ahead = F.sum(F.when(F.col("pos") < F.col("piece") * piece, 1).otherwise(0)).cast("int").alias("first")
        pieces = dealt.groupBy("part", "piece").agg(F.max("n").alias("n"), ahead, ordered("pos", "role", "content").alias("x"))
        pieces = pieces.select("part", "piece", F.expr(f"(n + {piece - 1}) div {piece}").alias("n_pieces"), "first", "x")
    whole = rendered(short.groupBy("part").agg(ordered("turn", "role", "tie", "content").alias("x")).select("part", *one))
    whole = whole.withColumn("n_pieces", F.lit(1).cast("long"))
    if long is not None:
        whole = whole.unionByName(rendered(pieces).where("n_pieces > 1"))
    return whole.withColumnRenamed("id", conv_col)


DIGESTS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (formatted, turns, others..) to (others.., n_turns, turns, loss, formatted_chars), all read from the text."""
    for batch in batches:
        n, whole, under, chars = [], [], [], []
        for formatted, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = read_marked(formatted)
            n.append(len(found))
            whole.append("".join(f"{role}\n{text}\n" for role, text in found))
            under.append("".join(unescape(formatted[t["body_start"] : t["body_end"]]) for t in turns if t["loss"]))
            chars.append(len(formatted))
        columns = [pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(under, pa.string()), pa.array(chars, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], names=[*batch.schema.names[2:], "n_turns", "turns", "loss", "formatted_chars"])


def fold_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of id and piece to one row per conversation: digests go on from piece to piece, texts don't stay."""
    own = None
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
        for i, (piece, n_pieces, n, turns, loss, chars) in enumerate(rows):
            if piece == 0:
                own = [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            own[0].update(turns.encode())
            own[1].update(loss.encode())
            own[2:] = own[2] + n, own[3] + len(loss), own[4] + chars
            if piece == n_pieces - 1:
                values = [[own[2]], [own[0].hexdigest()], [own[3]], [own[1].hexdigest()], [own[4]]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array(v) for v in values]], names=["id", *DIGESTS])


def digests(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation of :func:`format_conversations` with :func:`marked_turns`: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    All of it is read back from the formatted texts and the places in them. A digest is of one conversation from its
    first turn to its last: pieces are rendered and read by many tasks, and their texts pass one in order, of which it keeps none.
    """
    kind = pieces.schema[conv_col].dataType.simpleString()
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)

    def read(part: DataFrame) -> DataFrame:
        given = part.select("formatted", "turns", F.col(f"`{conv_col}`").alias("id"), "piece", "n_pieces")
        return given.mapInArrow(W.tidy(read_pieces), f"id {kind}, piece long, n_pieces long, n_turns long, turns string, loss string, formatted_chars long")

    one = read(pieces.where("n_pieces = 1"))
    one = one.select("id", "n_turns", sha("turns").alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), "formatted_chars")
    many = read(pieces.where("n_pieces > 1")).repartition("id").sortWithinPartitions("id", "piece")
    many = many.mapInArrow(fold_pieces, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return one.unionByName(many).select(F.col("id").alias(conv_col), *DIGESTS)


def rewrites() -> Column:
    """The places, in a piece, of the turns at which its template rewrote history."""
    places = F.transform("turns", lambda t, i: F.when(t["rewrote"], i))
    return F.filter(places, lambda i: i.isNotNull())
