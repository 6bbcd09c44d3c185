"""Tool calls of responses as rows: one response to many calls, by a table function.

What Spark's expressions can parse (:func:`rillflow.functions.scoring.tool_calls`) needs no Python. A parser of one's own is
a function of a text that gives (name, arguments) pairs; it runs in a table function that is partitioned by
conversation and sorted by turn, so that a call knows its number in the conversation and whether it was made before.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators import plugins
from rillflow.session import ship

Parse = Callable[[str], Iterable[tuple[str, str]]]
_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)


def tagged(text: str) -> Iterable[tuple[str, str]]:
    """The calls ``<tool_call>{json}</tool_call>`` of a text, arguments as compact JSON; what is no such JSON is skipped."""
    for found in _CALL.findall(text):
        try:
            call = json.loads(found)
            yield str(call["name"]), json.dumps(call["arguments"], separators=(",", ":"), ensure_ascii=False)
        except (ValueError, KeyError, TypeError):
            continue


def call_rows(df: DataFrame, parser: str = "hermes", text: str = "response", outer: bool = False) -> DataFrame:
    """``df`` with a row per call of a registered parser: ``place`` from 0, ``name``, ``arguments``. Rows without calls go, or with ``outer`` stay once."""
    found = plugins.parsers.get(parser)(text)
    spread = (F.posexplode_outer if outer else F.posexplode)(found)
    return df.select("*", spread.alias("place", "__call")).select("*", F.col("__call.name").alias("name"), F.col("__call.arguments").alias("arguments")).drop("__call")


def conversation_calls(df: DataFrame, parse: Parse = tagged, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conversation, turn, call, name, arguments, repeated): each call of each conversation, numbered from 1 in the order of turns.

    ``repeated``: the conversation made the same call before. A conversation's turns pass one task row by row, which keeps a
    digest per call; the rows of conversations are not gathered. Null texts have no calls, a null conversation is one of its own.
    """
    ship(df.sparkSession)
    kind = lambda c: df.schema[c].dataType.simpleString()

    class Calls:
        def __init__(self):
            self.n, self.seen = 0, set()

        def eval(self, row):
            for name, arguments in parse(row["x"]) if row["x"] is not None else ():
                self.n += 1
                key = hashlib.sha256(f"{name}\0{arguments}".encode()).digest()
                yield row["c"], row["t"], self.n, name, arguments, key in self.seen
                self.seen.add(key)

    function = F.udtf(Calls, returnType=f"c {kind(conversation)}, t {kind(turn)}, call int, name string, arguments string, repeated boolean")
    rows = df.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.col(text).alias("x"))
    return function(rows.asTable().partitionBy("c").orderBy("t")).withColumnsRenamed({"c": conversation, "t": turn})
