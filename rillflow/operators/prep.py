"""Dataset preparation: rows of prompts, preferences and conversations from raw tables, splits and encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.functions import masked as M
from rillflow.functions import scoring as S
from rillflow.functions import seeded
from rillflow.operators.batch import row_index


def message(role: str, content) -> Column:
    content = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def rl_row(df: DataFrame, source: str, question: Column, truth: Column, ability: str, style: str = "rule", split: str = "train", index: Column | None = None,
           system: str | None = None, answer: Column | None = None, tools: Column | None = None, agent: str | None = None, **extra: Column) -> DataFrame:
    """Rows of the prompt schema; ``tools`` and ``extra`` go to ``extra_info``, ``agent`` to ``agent_name``."""
    info = [F.lit(split).alias("split"), (index if index is not None else F.lit(None).cast("long")).cast("long").alias("index")]
    info += [(answer if answer is not None else truth).alias("answer"), question.alias("question")]
    if tools is not None:
        info += [F.lit(True).alias("need_tools_kwargs"), tools.alias("tools_kwargs")]
    info += [v.alias(k) for k, v in extra.items()]
    turns = ([message("system", system)] if system else []) + [message("user", question)]
    columns = [
        F.lit(source).alias("data_source"), F.array(*turns).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(*info).alias("extra_info"),
    ]
    if agent:
        columns.append(F.lit(agent).alias("agent_name"))
    return df.select(*columns)


#: What prompts end with (fixed values).
MATH_SUFFIX = " Let's think step by step and output the final answer within \\boxed{}."
GSM8K_SUFFIX = ' Let\'s think step by step and output the final answer after "####".'


BOXED_SUFFIX = "\n\nPlease reason step by step, and put your final answer within \\boxed{}."
LETTER_SUFFIX = "\n\nPlease reason step by step, and put your final answer (only the choice letter) within \\boxed{}."


def gsm8k(df: DataFrame, variant: str = "plain", **options) -> DataFrame:
    """``question`` and ``answer`` (with #### number). Variants: ``plain``, ``sft`` (messages), ``tool``, ``interaction``, ``agent``."""
    truth = F.translate(F.regexp_extract("answer", "#### (-?[0-9.,]+)", 1), ",", "")
    question = F.concat("question", F.lit(GSM8K_SUFFIX))
    if variant == "sft":
        return df.select(F.array(message("user", F.col("question")), message("assistant", F.col("answer"))).alias("messages"))
    tools = F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias("calc_gsm8k_reward"))
    ask = "You are a math expert. Reason step by step, check your answer with the calc_gsm8k_reward tool, then put it after ####."
    extra = {}
    if variant == "interaction":
        extra["interaction_kwargs"] = F.struct(F.lit("gsm8k").alias("name"), F.col("question").alias("query"), truth.alias("ground_truth"))
    elif variant in ("tool", "agent"):
        extra["interaction_kwargs"] = F.struct(F.col("question").alias("query"), truth.alias("ground_truth"))
    elif variant != "plain":
        raise ValueError(f"unknown variant {variant!r}")
    if variant in ("tool", "agent"):
        options |= {"system": ask, "tools": tools}
    return rl_row(df, "openai/gsm8k", question, truth, "math", answer=F.col("answer"), agent="tool_agent" if variant == "agent" else None, **extra, **options)


def math_rows(df: DataFrame, source: str = "math", **options) -> DataFrame:
    """``problem`` and ``solution``: the truth is what the solution's last box holds."""
    from rillflow.functions.answers import boxed_udf

    t = df.withColumn("__truth", boxed_udf("solution"))
    return rl_row(t, source, F.concat("problem", F.lit(MATH_SUFFIX)), F.col("__truth"), "math", **options)


def exam_rows(df: DataFrame, source: str, question: str = "question", answer: str = "answer", language: str = "en", suffix: str = MATH_SUFFIX, **options) -> DataFrame:
    """Competition problems with one final answer, for evaluation only: the question with a suffix, the answer as text; rows without one go."""
    text = F.concat(F.trim(question), F.lit(suffix))
    return rl_row(df.where(F.col(answer).isNotNull()), source, text, F.col(answer).cast("string"), "math", split="test", language=F.lit(language), **options)


def turn_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tools: str | None = None) -> DataFrame:
    """One row per conversation for multi-turn fine-tuning: ``messages`` in order, and ``tools`` as JSON where a column has them."""
    picked = [F.sort_array(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content")))).alias("x")]
    picked += [F.first(F.to_json(tools), ignorenulls=True).alias("tools")] if tools else []
    g = df.groupBy(conv).agg(*picked)
    messages = F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    return g.select(conv, messages, *(["tools"] if tools else []))


def choice_rows(df: DataFrame, source: str, question: str, right: str, wrong: list[str], key: str, seed: int = 0, **options) -> DataFrame:
    """Questions with lettered choices in a seeded order of their own, asking for the letter; the truth is the letter of the right one."""
    t = shuffled_choices(df, question, right, wrong, key, seed)
    text = F.concat(F.regexp_replace("prompt", r"(?m)^([A-H])\) ", "$1. "), F.lit(LETTER_SUFFIX))
    return rl_row(t, source, text, F.col("answer"), "general", split="test", **options)


def clean_activity(text: Column) -> Column:
    """Without titles in brackets and doubled spaces."""
    out = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(out, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def multiple_endings(df: DataFrame, source: str = "hellaswag", **options) -> DataFrame:
    """``activity_label``, ``ctx_a``, ``ctx_b``, ``endings`` and ``label``; rows without a label go."""
    context = F.concat(F.col("ctx_a"), F.lit(" "), F.initcap(F.substring("ctx_b", 1, 1)), F.substring("ctx_b", 2, 1 << 30))
    question = clean_activity(F.concat("activity_label", F.lit(": "), context))
    choices = F.transform("endings", lambda e: clean_activity(e))
    t = df.where(F.coalesce(F.col("label") != "", F.lit(False)))
    return rl_row(t, source, question, F.col("label"), "nlp", style="model", choices=choices, **options)


def preferences(df: DataFrame) -> dict[str, DataFrame]:
    """``prompt``, ``chosen``, ``rejected`` as ``sft`` (two rows each), ``rm`` (pairs) and ``rl`` rows."""
    return {
        "sft": df.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response")),
        "rm": df.select("prompt", "chosen", "rejected"),
        "rl": rl_row(df, "hh", F.col("prompt"), F.col("chosen"), "alignment", style="model"),
    }


def positional_split(df: DataFrame, ratio: float, order_by) -> tuple[DataFrame, DataFrame]:
    """The first floor(n ratio) rows, and the rest."""
    indexed = row_index(df, order_by)
    n = int(indexed.count() * ratio)
    return indexed.where(F.col("row_idx") < n).drop("row_idx"), indexed.where(F.col("row_idx") >= n).drop("row_idx")


def hash_split(df: DataFrame, ratio: float, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A seeded random split by key: no shuffle, and the same rows in every run."""
    first = seeded.unit(seed, key) < F.lit(float(ratio))
    return df.where(first), df.where(~first)


def search_rows(df: DataFrame, source: str = "searchR1_", system: str = "You are a helpful assistant.", intro: str = "Answer the given question. ") -> DataFrame:
    """``question``, ``data_source`` and ``golden_answers`` or ``reward_model.ground_truth``: prompts with tool arguments."""
    golds = F.col("golden_answers") if "golden_answers" in df.columns else F.array()
    if "reward_model" in df.columns:
        golds = F.coalesce(F.col("reward_model.ground_truth.target"), golds)
    truth = F.to_json(F.struct(golds.alias("target")))
    name = F.concat(F.lit(source), F.col("data_source"))
    args = F.struct(F.struct(F.struct(truth.alias("ground_truth"), F.col("question").alias("question"), name.alias("data_source")).alias("create_kwargs")).alias("search"))
    out = rl_row(df.withColumn("__name", name), source, F.concat(F.lit(intro), F.col("question")), truth, "fact-reasoning", system=system, tools=args, __name=F.col("__name"))
    return out.withColumn("data_source", F.col("extra_info.__name")).withColumn("extra_info", F.col("extra_info").dropFields("__name"))


def with_tool(df: DataFrame, tool: str = "code_interpreter") -> DataFrame:
    """Rows as they are, with ``need_tools_kwargs`` and the tool's arguments in ``extra_info``."""
    args = F.struct(F.struct(F.struct(F.col("reward_model.ground_truth").alias("ground_truth")).alias("create_kwargs")).alias(tool))
    return df.withColumn("extra_info", F.col("extra_info").withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", args))


def geometry_rows(df: DataFrame, with_tools: bool = False) -> DataFrame:
    """``problem``, ``answer`` and ``images``: one user turn, images carried along."""
    tools = F.struct(F.struct(F.struct(F.col("answer").alias("ground_truth")).alias("create_kwargs")).alias("calc_geo3k_reward")) if with_tools else None
    keyed = row_index(df, df.columns[0])
    out = rl_row(keyed, "geometry3k", F.concat("problem", F.lit(MATH_SUFFIX)), F.col("answer"), "math", index=F.col("row_idx"), tools=tools,
                 system="You are a math expert with a tool that checks answers." if with_tools else None, images=F.col("images"))
    return out.withColumn("images", F.col("extra_info.images")).withColumn("extra_info", F.col("extra_info").dropFields("images"))


ROLES = {"gpt": "assistant", "human": "user", "system": "system"}


def remap_roles(messages: str, roles: dict[str, str] = ROLES, role: str = "from", content: str = "value") -> Column:
    """Messages with the usual role names; an unknown role raises."""
    known = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])

    def one(m: Column) -> Column:
        name = F.coalesce(F.try_element_at(known, m[role]), F.raise_error(F.concat(F.lit("unknown role "), m[role])).cast("string"))
        return F.struct(name.alias("role"), m[content].alias("content"))

    return F.transform(messages, one)


def shuffled_choices(df: DataFrame, question: str, right: str, wrong: list[str], key: str, seed: int = 0) -> DataFrame:
    """``prompt`` with choices A to D in a seeded order of their own per row, and ``answer``, the letter of the right one."""
    options = F.array(*[F.struct(F.xxhash64(F.col(key), F.lit(seed), F.lit(i)).alias("h"), F.col(c).alias("text"), F.lit(c == right).alias("ok")) for i, c in enumerate([right, *wrong])])
    t = df.withColumn("__o", F.array_sort(options))
    lines = F.array_join(F.transform("__o", lambda o, i: F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(") "), o["text"])), "\n")
    at = F.array_position(F.transform("__o", lambda o: o["ok"]), True).cast("int")
    return t.withColumn("prompt", F.concat(F.col(question), F.lit("\n"), lines)).withColumn("answer", F.substring(F.lit("ABCDEFGH"), at, F.lit(1))).drop("__o")


def merged_tests(public: str, private: str) -> Column:
    """Public and private test cases, JSON lists of {input, output}, as one JSON of inputs and outputs."""
    kind = "array<struct<input:string,output:string>>"
    cases = F.concat(*[F.coalesce(F.from_json(F.col(c), kind), F.array().cast(kind)) for c in (public, private)])
    return F.to_json(F.struct(F.transform(cases, lambda c: c["input"]).alias("inputs"), F.transform(cases, lambda c: c["output"]).alias("outputs")))


def collapse(df: DataFrame, keep: list[str], name: str = "extra") -> DataFrame:
    """Columns besides ``keep`` as one struct."""
    return df.select(*keep, F.struct(*[c for c in df.columns if c not in keep]).alias(name))


def spread(df: DataFrame) -> Column:
    """A hash of all columns that have one, which tells rows apart that tie."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0).cast("long")


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row by ``order`` (ascending columns) of each key, by an aggregate: a hot key is one row per task before the shuffle."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def dedup_prompts(df: DataFrame, prompt: str, order: str) -> DataFrame:
    """The first row by ``order`` of each prompt, compared as JSON: one row per prompt, of rows that tie one of equal right; null is a prompt of its own."""
    text = F.col(prompt) if df.schema[prompt].dataType.simpleString() == "string" else F.to_json(prompt)
    return keep_first(df, [text.alias("__json")], [F.col(order), spread(df)])


def best_per_conversation(df: DataFrame, conv: str = "conv_id", turn: str = "turn_id", score: str = "score") -> DataFrame:
    """Of each conversation the last turn, of its responses the best: one row.

    A score that is null is the worst, a turn that is null the first; null ids are one conversation; of rows that tie in
    both the one whose hash over all columns is greatest stays, the same in every run.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = F.max_by(whole, F.struct(F.col(turn), F.col(score), spread(df)))
    return df.groupBy(F.col(conv).alias("__c")).agg(best.alias("__row")).select("__row.*")


def problem_rows(df: DataFrame, kind: str, extras: list[str]) -> DataFrame:
    """Rows of one ``problem_type`` with messages and extras in a struct."""
    t = df.where(F.col("problem_type") == kind)
    return t.select(F.array(message("user", F.col("problem")), message("assistant", F.col("generated_solution"))).alias("messages"), F.struct(*extras).alias("extra_info"))


def task_states(df: DataFrame, task: str, n_states: str, train: int, test: int, held_out: list[int], seed: int = 0) -> DataFrame:
    """(task, state, env, split): states of each task numbered through, random ones for training and testing, tasks held out for testing only."""
    # One row per task of the benchmark, some hundred at most.
    w = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    bins = df.select(task, n_states, F.coalesce(F.sum(n_states).over(w), F.lit(0)).alias("first"))
    states = bins.where(F.col(n_states) > 0).select(task, "first", F.explode(F.sequence(F.lit(0), F.col(n_states) - 1)).alias("state"))
    rank = F.row_number().over(Window.partitionBy(task).orderBy(seeded.order(seed, task, "state"), "state"))
    t = states.withColumn("env", F.col("first") + F.col("state")).withColumn("__r", rank)
    split = F.when(F.col(task).isin(*held_out), F.when(F.col("__r") <= test, "test_ood")).when(F.col("__r") <= train, "train").when(F.col("__r") <= train + test, "test")
    return t.withColumn("split", split).where("split is not null").select(task, "state", "env", "split")


# ---------------------------------------------------------------- encoders over token arrays


def encode_sft(df: DataFrame, prompt: str, response: str, eos: int, length: int, pad_id: int, side: str = "error") -> DataFrame:
    """``input_ids``, ``attention_mask``, ``position_ids`` and ``loss_mask`` of prompt, response and end.

    The loss leaves out the prompt but its last token, and the last token of all, which predicts nothing.
    """
    ids = F.concat(prompt, response, F.array(F.lit(eos).cast("long")))
    t = df.withColumn("__ids", M.truncate(ids, length, side)).withColumn("__p", F.least(F.size(prompt), F.size("__ids")))
    n = F.size("__ids")
    loss = F.transform("__ids", lambda x, i: ((i >= F.col("__p") - 1) & (i < n - 1)).cast("int"))
    t = t.withColumns(
        {
            "input_ids": M.pad("__ids", length, F.lit(pad_id).cast("long")),
            "attention_mask": M.pad(F.array_repeat(F.lit(1), n), length, F.lit(0)),
            "position_ids": F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.least(i, F.greatest(n - 1, F.lit(0)))),
            "loss_mask": M.pad(loss, length, F.lit(0)),
        }
    )
    return t.drop("__ids", "__p")


def encode_turns(df: DataFrame, turns: str = "turns", length: int | None = None, pad_id: int = 0, generation_prompt: int = 0) -> DataFrame:
    """``turns``: array of (role, ids). Ids joined; the loss is on what assistants say, less the ``generation_prompt`` tokens before it."""
    ids = F.flatten(F.transform(turns, lambda t: t["ids"]))
    own = lambda t: F.transform(t["ids"], lambda x, i: ((t["role"] == "assistant") & (i >= generation_prompt)).cast("int"))
    t = df.withColumns({"input_ids": ids, "loss_mask": F.flatten(F.transform(turns, own))})
    t = t.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    if length is None:
        return t
    fill = {"input_ids": F.lit(pad_id).cast("long"), "loss_mask": F.lit(0), "attention_mask": F.lit(0)}
    return t.withColumns({c: F.slice(M.pad(c, length, v), 1, length) for c, v in fill.items()})


def encode_pairs(df: DataFrame, length: int, eos: int, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Two rows per pair, chosen first: prompt and response with their end, zero-padded or cut on the right."""
    both = F.array(*[F.struct(F.lit(k).alias("side"), F.concat(prompt, c, F.array(F.lit(eos).cast("long"))).alias("ids")) for k, c in ((0, chosen), (1, rejected))])
    t = df.select(*[c for c in df.columns if c not in (prompt, chosen, rejected)], F.explode(both).alias("x")).select("*", "x.side", "x.ids").drop("x")
    cut = F.slice("ids", 1, length)
    return t.withColumns({"input_ids": M.pad(cut, length, F.lit(0).cast("long")), "attention_mask": M.pad(F.transform(cut, lambda x: F.lit(1)), length, F.lit(0))}).drop("ids")


def content_parts(content: Column) -> Column:
    """Text with <image> and <video> marks as parts (type, text), in order; empty pieces go."""
    pieces = F.split(content, "(?=<image>|<video>)|(?<=<image>)|(?<=<video>)")
    part = lambda p: F.when(p == "<image>", F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))).when(
        p == "<video>", F.struct(F.lit("video").alias("type"), F.lit(None).cast("string").alias("text"))
    ).otherwise(F.struct(F.lit("text").alias("type"), p.alias("text")))
    return F.transform(F.filter(pieces, lambda p: p != ""), part)


def assemble_trajectory(df: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", role: str = "role", ids: str = "ids", logprobs: str | None = None) -> DataFrame:
    """One row per conversation: ``response_ids``, ``response_mask`` (1 for the model's tokens), log-probabilities (0.0 for others), ``num_turns``.

    Turns stand in their order while the budget lasts; a turn of a tool or user that would overflow is left out with all that follow,
    a turn of the model is cut. ``num_turns`` counts the prompt as one.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = F.size(ids)
    t = df.withColumn("__upto", F.sum(n).over(w)).withColumn("__before", F.col("__upto") - n)
    own = F.col(role) == "assistant"
    ok = F.col("__before") < budget
    ok = ok & (own | (F.col("__upto") <= budget))
    t = t.withColumn("__ok", F.min(ok.cast("int")).over(w)).where("__ok = 1")
    lp = F.col(logprobs) if logprobs else F.transform(ids, lambda x: F.lit(0.0))
    t = t.select(key, order, F.col(ids).alias("i"), F.transform(ids, lambda x: own.cast("int")).alias("m"), F.when(own, lp).otherwise(F.transform(ids, lambda x: F.lit(0.0))).alias("l"))
    g = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "i", "m", "l"))).alias("x"))
    cut = lambda c: F.slice(F.flatten(F.col(f"x.{c}")), 1, budget)
    return g.select(key, cut("i").alias("response_ids"), cut("m").alias("response_mask"), cut("l").alias("response_logprobs"), (F.size("x") + 1).alias("num_turns"))


def last_assistant(df: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(key, content) of each conversation's last assistant turn."""
    return df.where(F.col("role") == "assistant").groupBy(key).agg(F.max_by("text", turn).alias("content"))


def interaction_scores(df: DataFrame, truth: str, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The grade-school score of the last assistant turn, and whether it ends the interaction."""
    last = df.groupBy(key, truth).agg(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col(turn))).alias("content"))
    score = S.gsm8k_score("content", truth, "flexible")
    return last.select(key, score.alias("score"), (score == 1.0).alias("terminate"))


def tool_step_rewards(df: DataFrame, key: str, order: str, score: str = "score", penalty: float = -0.05) -> DataFrame:
    """0 for a submission that beats the one before, the penalty otherwise; the first is compared with 0."""
    before = F.lag(score, 1, 0.0).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("tool_reward", F.when(F.col(score) > before, 0.0).otherwise(penalty))
