"""Quality rules: a threshold table compiled into one Spark projection, without user functions or shuffles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import SPACE, ascii_lower, let, run_hashes, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the languages served (English, German, French, Spanish).
STOP_WORDS = (
    "the of and to in is a that it for on with as was be by at this from are or an have not which "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an er "
    "de la le les et des en un une du est que dans qui pour au sur par pas avec "
    "el los las y a se del con una su al lo como mas o"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text where ``factor * left > limit * right`` (``over``) or ``<`` (``under``): whole numbers only."""

    name: str
    left: str
    factor: int
    over: bool
    limit: int
    right: str


#: The production thresholds. Columns are those of :func:`measures`, or ``one``.
RULES = (
    Rule("too_few_words", "n_words", 1, False, 20, "one"),
    Rule("repeated_words", "n_repeat_words", 100, True, 30, "n_words"),
    Rule("many_symbols", "n_symbols", 100, True, 30, "n_words"),
    Rule("long_words", "word_chars", 1, True, 25, "n_words"),
    Rule("short_words", "word_chars", 1, False, 2, "n_words"),
    Rule("shouting", "n_upper", 100, True, 50, "word_chars"),
    Rule("repeated_lines", "n_dup_lines", 100, True, 50, "n_lines"),
    Rule("few_stop_words", "n_stop_words", 100, False, 2, "n_words"),
)
#: The rules of the base verdict; the others are the method's own.
BASE = ("too_few_words", "repeated_words")


def n_chars_of(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside a window of ``width`` words that the text holds twice or more, the first included.

    Only texts with a repeated window are sorted; windows are compared by 64-bit hashes of their words' hashes,
    within one text.
    """

    def spans(hashes: Column) -> Column:
        def twice(ordered: Column) -> Column:
            def same(e: Column, i: Column) -> Column:
                before = F.get(ordered, i - 1)["h"] == e["h"]
                after = F.get(ordered, i + 1)["h"] == e["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.transform(F.filter(ordered, same), lambda e: e["i"])

        def covered(at: Column) -> Column:
            own = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
            return F.aggregate(own, F.lit(0), lambda a, n: a + n).cast("long")

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.lit(0).cast("long")
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(F.sort_array(let(ordered, twice)), covered))


    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(run_hashes(word_hashes(words), [width]), spans))


def measures(text_col: str = "text") -> dict[str, Column]:
    """Name to expression over a text column; null counts as the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.char_length(F.btrim(line, F.lit(SPACE))) > 0)
    stops = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    plain = F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = words_of(F.col(text_col))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": n_chars_of(text, SYMBOLS),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": let(words, repeated_words),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": n_chars_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_stop_words": F.size(F.filter(plain, lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long"),
    }


def failed(rule: Rule) -> Column:
    left = F.col(rule.left) * rule.factor
    right = F.lit(rule.limit) * (F.lit(1) if rule.right == "one" else F.col(rule.right))
    return left > right if rule.over else left < right


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``.

    A null or empty text has no words and so fails the base; whole texts are measured, however long; ties and
    repeated rows are judged alike; an empty table stays empty; columns of ``docs`` that share a measure's name
    are replaced.
    """
    base_rules, own = [failed(r) for r in rules if r.name in base], [failed(r) for r in rules if r.name not in base]
    either = lambda found: reduce(lambda a, b: a | b, found, F.lit(False))
    measured = docs.withColumns(measures(text_col))
    return measured.withColumn("base_failed", either(base_rules)).withColumn("kept", ~(F.col("base_failed") | either(own)))


def keep_quality(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that pass every rule, with their own columns only, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    renamed = docs.select(row.alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    return apply_rules(renamed, text_col="__text", **options).where("kept").select("__row.*")
