"""Queries over scoring functions. Responses are made from documents, benchmark items and conversations by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions import answers
from rillflow.functions import scoring as S
from rillflow.operators import calls, filters, plugins, prep
from rillflow.plans.frames import TOK, conversations, sequences, table, tokens
from rillflow.plans.learning import r
from rillflow.plans.registry import query
from rillflow.streaming import fields as E


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


#: A response that ends in a number, well marked for two of three documents.
GSM = """g AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' #### ' || n_chars || ',' ELSE ' it is ' || n_chars || '.' END AS response, CAST(n_chars AS VARCHAR) AS truth FROM documents)"""


def gsm(spark, d):
    n = F.col("n_chars").cast("string")
    end = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" #### "), n, F.lit(","))).otherwise(F.concat(F.lit(" it is "), n, F.lit(".")))
    return docs(spark, d).select("doc_id", F.concat("text", end).alias("response"), n.alias("truth"))


@query("gsm8k_extract", f"""WITH {GSM}, x AS (SELECT doc_id, truth, regexp_extract_all(right(response, 300), '#### (-?[0-9.,]+)', 1) AS s, list_filter(regexp_extract_all(right(response, 300), '(-?[0-9.,]+)', 1), lambda v: v <> '.') AS f FROM g)
 SELECT doc_id, CASE WHEN len(s) = 0 THEN NULL ELSE replace(s[-1], ',', '') END AS strict, CASE WHEN len(s) = 0 THEN 0.0::DOUBLE WHEN replace(s[-1], ',', '') = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, f[-1] AS flexible FROM x""")
def gsm8k_extract(spark, d):
    g = gsm(spark, d)
    return g.select("doc_id", S.gsm8k_answer("response").alias("strict"), S.gsm8k_score("response", "truth").alias("score"), S.gsm8k_answer("response", "flexible").alias("flexible"))


@query("minerva_verify", """WITH g AS (SELECT doc_id, 'So. Answer: ' || CASE doc_id % 4 WHEN 0 THEN '$' || n_chars || '$ dollars' WHEN 1 THEN 'x = ' || n_chars || ' units' WHEN 2 THEN '\\text{' || n_chars || '}' ELSE lang END AS response, CAST(n_chars AS VARCHAR) AS truth FROM documents)
 SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN lang ELSE truth END AS pred, CASE doc_id % 4 WHEN 3 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM g JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
def minerva_verify(spark, d):
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 4
    form = F.when(k == 0, F.concat(F.lit("$"), n, F.lit("$ dollars"))).when(k == 1, F.concat(F.lit("x = "), n, F.lit(" units"))).when(k == 2, F.concat(F.lit("\\text{"), n, F.lit("}"))).otherwise(F.col("lang"))
    t = docs(spark, d).select("doc_id", F.concat(F.lit("So. Answer: "), form).alias("response"), n.alias("truth"))
    return t.withColumn("m", S.minerva("response", "truth")).select("doc_id", "m.pred", "m.score")


@query("multiple_choice", "SELECT doc_id, CASE WHEN chr(CAST(65 + doc_id % 4 AS INTEGER)) = chr(CAST(65 + n_chars % 4 AS INTEGER)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")
def multiple_choice(spark, d):
    letter = lambda c: F.char(65 + F.col(c) % 4)
    t = docs(spark, d).select("doc_id", F.concat(F.lit("hm\nANSWER : $"), letter("doc_id"), F.lit("$")).alias("response"), letter("n_chars").alias("truth"))
    return t.select("doc_id", S.multiple_choice("response", "truth").alias("score"))


@query("qa_exact_match", r"""WITH n AS (SELECT doc_id, lang, source, trim(regexp_replace(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents),
 p AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN norm ELSE lang END AS a, norm FROM n) SELECT doc_id, CASE WHEN a = norm THEN CASE WHEN doc_id % 5 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS em,
 CASE WHEN contains(a, norm) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sub_em FROM p""")
def qa_exact_match(spark, d):
    first = F.get(F.split("text", "\n"), F.lit(0))
    said = F.when(F.col("doc_id") % 2 == 0, first).otherwise(F.col("lang"))
    noise = F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("</answer>"), F.lit(11))).otherwise(F.lit(""))
    t = docs(spark, d).select("doc_id", F.concat(noise, F.lit("<answer>no</answer> <answer> "), said, F.lit(" </answer>")).alias("response"), F.array(F.upper(F.lit("zz zz")), first).alias("golds"))
    return t.select("doc_id", S.exact_match("response", "golds").alias("em"), S.contained_match("response", "golds").alias("sub_em"))


@query("geometry_format", "SELECT doc_id, round(0.9 * (doc_id % 2) + 0.1 * CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM documents")
def geometry_format(spark, d):
    form = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>\n so \\boxed{3} ."))).otherwise(F.concat(F.lit("x <think>"), "text", F.lit("</think> \\boxed{3}")))
    return docs(spark, d).select("doc_id", r(S.geometry_score(F.col("doc_id") % 2, form)).alias("score"))


@query("tool_call_parse", """SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS calls, 'search' AS name, json('{"q":' || doc_id || '}')::VARCHAR AS arguments, 'before  after' AS rest FROM documents""")
def tool_call_parse(spark, d):
    one = F.concat(F.lit('<tool_call>{"name":"search","arguments":{"q":'), F.col("doc_id").cast("string"), F.lit("}}</tool_call>"))
    more = F.when(F.col("doc_id") % 3 == 0, one).otherwise(F.lit("<tool_call>{not json</tool_call>"))
    t = docs(spark, d).select("doc_id", F.concat(F.lit("before "), one, more, F.lit(" after")).alias("response"))
    calls = S.tool_calls("response")
    return t.select("doc_id", F.size(calls).alias("calls"), F.get(calls, F.lit(0))["name"].alias("name"), F.get(calls, F.lit(0))["arguments"].alias("arguments"), S.without_tool_calls("response").alias("rest"))


@query("channel_calls", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS calls FROM documents")
def channel_calls(spark, d):
    body = F.when(F.col("doc_id") % 2 == 0, F.lit('{"city": "x"}')).otherwise(F.lit("{bad"))
    t = F.concat(F.lit("<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>commentary to=functions.weather <|constrain|>json<|message|>"), body, F.lit("<|call|>"))
    return docs(spark, d).select("doc_id", F.size(S.channel_calls(t)).alias("calls"))


@query("code_blocks", "SELECT doc_id, lang || chr(10) AS code FROM documents")
def code_blocks(spark, d):
    t = F.concat(F.lit("a\n```python\nold\n```\nb\n```python\n"), "lang", F.lit("\n```\nc"))
    return docs(spark, d).select("doc_id", S.last_code_block(t).alias("code"))


@query("test_case_fractions", f"""WITH {TOK} SELECT seq_id, CASE WHEN sum(mask) = count(*) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS every, round(sum(CASE WHEN pos < 10 THEN mask ELSE 0 END) / sum(CASE WHEN pos < 10 THEN 1 ELSE 0 END), 6) AS share FROM tok GROUP BY seq_id""")
def test_case_fractions(spark, d):
    s = sequences(spark, d).withColumn("ok", F.transform("mask", lambda m: m == 1))
    return s.select("seq_id", S.pass_fraction("ok").alias("every"), r(S.pass_fraction("ok", continuous=True)).alias("share"))


@query("judge_and_flaws", "SELECT doc_id, doc_id % 3 = 0 AS judged, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE -1.0::DOUBLE END AS score FROM documents")
def judge_and_flaws(spark, d):
    verdict = F.when(F.col("doc_id") % 3 == 0, "\\boxed{False} then \\boxed{ True }").otherwise("\\boxed{True} then \\boxed{False}")
    t = docs(spark, d).withColumn("judged", S.judge_says_true(F.concat("text", verdict)))
    return t.select("doc_id", "judged", S.flawed_positive(F.col("doc_id") % 2 == 0, "judged").alias("score"))


@query("screen_points", "WITH x AS (SELECT doc_id, doc_id % 5 AS k FROM documents) SELECT doc_id, round(CASE WHEN k < 4 THEN 1 / sqrt(4.0 * (k + 1)) ELSE -0.25 END, 6)::DOUBLE AS reward, k % 2 = 0 AS line FROM x")
def screen_points(spark, d):
    k = F.col("doc_id") % 5
    xy = lambda i: F.struct(F.array(F.lit(float(i)), F.when((k % 2 == 0) | (F.lit(i) > 0), F.lit(2.0 * i)).otherwise(F.lit(1.0))).alias("point_2d"))
    t = docs(spark, d).select("doc_id", F.to_json(F.array(*[xy(i) for i in range(4)])).alias("j"), k.alias("k"))
    box = F.array(F.col("k") - 0.5, F.lit(-1.0), F.col("k") + 0.5, F.lit(99.0))
    t = t.withColumn("p", S.points("j"))
    return t.select("doc_id", r(S.point_rank_reward("p", box)).alias("reward"), S.collinear("p").alias("line"))


@query("think_cascade", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE lang || ' only' END AS answer, doc_id % 3 <> 1 AS balanced FROM documents")
def think_cascade(spark, d):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.lit("<think>x</think> <answer> "), "lang", F.lit(" </answer>"))).when(k == 1, F.concat(F.lit("x</think> "), "source")).otherwise(F.concat("lang", F.lit(" only")))
    return docs(spark, d).select("doc_id", S.answer_cascade(t).alias("answer"), S.tag_balance(t, "think").alias("balanced"))


@query("transcripts", "SELECT conv_id, string_agg('**' || upper(role[1]) || role[2:] || '**: ' || text, chr(10) || chr(10) ORDER BY turn) FILTER (role <> 'system') AS transcript, CAST(sum(CASE WHEN turn >= 1 THEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) ELSE 0 END) AS BIGINT) AS words FROM conversations GROUP BY conv_id")
def transcripts(spark, d):
    c = conversations(spark, d)
    return c.select("conv_id", F.nullif(S.transcript("messages", skip_system=True), F.lit("")).alias("transcript"), S.token_amount("messages", F.lit(1)).alias("words"))


@query("valid_messages", "SELECT conv_id, bool_and(regexp_matches(text, '\\S')) AS valid FROM conversations GROUP BY conv_id")
def valid_messages(spark, d):
    return conversations(spark, d).select("conv_id", filters.valid_messages("messages").alias("valid"))


@query("tool_response_truncation", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...(truncated)' ELSE text END AS head, CASE WHEN length(text) > 100 THEN '(truncated)...' || right(text, 100) ELSE text END AS tail, CASE WHEN length(text) > 100 THEN left(text, 50) || '...(truncated)...' || right(text, 50) ELSE text END AS middle FROM documents")
def tool_response_truncation(spark, d):
    return docs(spark, d).select("doc_id", *[S.truncate_response("text", 100, side).alias(name) for side, name in (("left", "head"), ("right", "tail"), ("middle", "middle"))])


@query("overlong_penalty", "SELECT doc_id, round(least((2000 - 500 - n_chars) / 500.0, 0), 6)::DOUBLE AS penalty, n_chars > 1500 AS overlong, round(1 + least((2000 - 500 - n_chars) / 500.0, 0), 6)::DOUBLE AS reward FROM documents")
def overlong_penalty(spark, d):
    t = docs(spark, d).withColumn("x", S.dapo_reward(F.lit(1.0), "n_chars", 2000, 500))
    return t.select("doc_id", r("x.overlong_reward").alias("penalty"), "x.overlong", r("x.reward").alias("reward"))


@query("reward_placement", f"WITH {TOK}, s AS (SELECT seq_id, sum(reward) AS sc, CAST(sum(mask) AS BIGINT) AS len, count(*) AS n FROM tok GROUP BY seq_id) SELECT seq_id, CASE WHEN len = 0 THEN 0 ELSE len END AS at, round(CASE WHEN len = 0 THEN 0 ELSE sc END, 6) AS total, n FROM s")
def reward_placement(spark, d):
    t = tokens(spark, d).groupBy("seq_id").agg(F.sum("reward").alias("s"), F.sum("mask").alias("len"), F.count(F.lit(1)).alias("n"))
    t = t.withColumn("x", S.place_reward("s", "len", "n"))
    at = F.array_position(F.transform("x", lambda v: v > 0), True)
    return t.select("seq_id", at.alias("at"), r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"), F.size("x").cast("long").alias("n"))


@query("reward_manager_naive", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.5::DOUBLE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")
def reward_manager_naive(spark, d):
    t = gsm(spark, d).select("doc_id", "response", F.col("truth").alias("ground_truth"), F.lit("openai/gsm8k").alias("data_source"), F.when(F.col("doc_id") % 4 == 0, 0.5).alias("rm_score"),
                             F.lit(3).alias("response_length"), F.lit(5).alias("max_length"))
    out = plugins.reward_managers.get("naive")(t)
    return out.select("doc_id", F.get("rewards", F.lit(2)).alias("score"))


@query("reward_manager_prime", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")
def reward_manager_prime(spark, d):
    def score(text, truth):
        return 1.0 if text.rpartition("#### ")[1] and text.rpartition("#### ")[2].rstrip(",") == truth else [0.0][0 if "it is" in text else 1]

    t = gsm(spark, d).select("doc_id", "response", F.col("truth").alias("ground_truth"), F.lit(1).alias("response_length"), F.lit(1).alias("max_length"))
    return plugins.reward_managers.get("prime")(t, score=score).select("doc_id", "score")


@query("boxed_answers", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{' || lang || '}' WHEN 1 THEN CAST(n_chars AS VARCHAR) ELSE NULL END AS boxed FROM documents")
def boxed_answers(spark, d):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.lit("\\boxed{1} and \\boxed{{"), "lang", F.lit("}} ."))).when(k == 1, F.concat(F.lit("\\fbox{"), F.col("n_chars").cast("string"), F.lit("}"))).otherwise("none \\boxed{open")
    return docs(spark, d).select("doc_id", answers.boxed_udf(t).alias("boxed"))


@query("math_equivalence", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM documents")
def math_equivalence(spark, d):
    k = F.col("doc_id") % 5
    said = F.when(k == 0, "\\dfrac12").when(k == 1, "x = \\frac{1}{2}").when(k == 2, "0.5").when(k == 3, "1/2").otherwise("\\frac13")
    t = docs(spark, d).select("doc_id", F.concat(F.lit("so \\boxed{"), said, F.lit("}")).alias("response"))
    return t.select("doc_id", answers.math_score_udf("response", F.lit("\\frac{1}{2}")).alias("score"))


@query("graded_answers", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN false ELSE true END AS correct FROM documents")
def graded_answers(spark, d):
    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    said = F.when(k == 0, F.concat(F.lit("The answer is "), n)).when(k == 1, F.concat(F.lit("Answer: $"), n, F.lit(" dollars$").substr(F.lit(9), F.lit(1)))).when(k == 2, F.concat(F.lit("we get \\boxed{"), n, F.lit(".0}"))).otherwise("The answer is 0.123")
    t = docs(spark, d).select("doc_id", said.alias("response"), n.alias("truth"))
    return t.select("doc_id", answers.graded_udf("response", "truth")["correct"].alias("correct"))


@query("repetition_flags")
def repetition_flags(spark, d):
    return docs(spark, d).select("doc_id", answers.repetitive_udf("text").alias("repetitive"))


@query("bleu_scores")
def bleu_scores(spark, d):
    return docs(spark, d).select("doc_id", r(answers.bleu_udf("text", F.expr("substring(text, 20)"))).alias("bleu"))


@query("tolerant_json", """SELECT doc_id, '{"k": ' || doc_id || ', "ok": true}' AS parsed FROM documents""")
def tolerant_json(spark, d):
    t = F.concat(F.lit("sure: {'k': "), F.col("doc_id").cast("string"), F.lit(", 'ok': True,} done"))
    return docs(spark, d).select("doc_id", answers.tolerant_json_udf(t).alias("parsed"))


@query("content_parts", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 2 END AS INTEGER) AS parts, CASE WHEN doc_id % 2 = 0 THEN 'text,image,text,video' ELSE 'image,text' END AS kinds FROM documents")
def content_parts(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("look "), F.lit("<image> at "), "lang", F.lit("<video>"))).otherwise(F.concat(F.lit("<image>"), "lang"))
    p = prep.content_parts(t)
    return docs(spark, d).select("doc_id", F.size(p).alias("parts"), F.array_join(F.transform(p, lambda x: x["type"]), ",").alias("kinds"))


@query("interaction_scores", "WITH l AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS t FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, t, list_filter(regexp_extract_all(right(t, 300), '(-?[0-9.,]+)', 1), lambda v: v <> '.') AS f FROM l) SELECT conv_id, CASE WHEN len(f) > 0 AND f[-1] = '42' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM x")
def interaction_scores(spark, d):
    c = table(spark, d, "conversations").withColumn("truth", F.lit("42"))
    return prep.interaction_scores(c, "truth").select("conv_id", "score")


@query("clean_activity", r"SELECT page_id, replace(regexp_replace(replace(trim(html), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS text FROM pages")
def clean_activity(spark, d):
    return table(spark, d, "pages").select("page_id", prep.clean_activity(F.col("html")).alias("text"))


SOURCES = ["openai/gsm8k", "lighteval/MATH", "math_dapo", "aime2024", "numina_olympiads", "codecontests", "hiyouga/geometry3k", "gpqa_diamond", "searchR1_nq"]


@query("default_scores", f"""SELECT doc_id, ({SOURCES})[doc_id % 9 + 1] AS data_source, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE WHEN doc_id % 9 IN (2, 3) THEN -1.0::DOUBLE WHEN doc_id % 9 = 6 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents""")
def default_scores(spark, d):
    """Every family of scorers, half of the answers wrong."""
    n, k = F.col("n_chars"), F.col("doc_id") % 9
    said = F.when(F.col("doc_id") % 2 == 0, n).otherwise(2 * n + 7).cast("string")
    n, pick = n.cast("string"), lambda values, rest: reduce(lambda c, iv: c.when(k == iv[0], iv[1]), list(values.items())[1:], F.when(k == list(values)[0], values[list(values)[0]])).otherwise(rest)
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    code = line("```python\nprint(int(input()) + ", said, ")\n```")
    response = pick({0: line("so #### ", said), 1: line("it is \\boxed{", said, "}"), 4: line("The answer is \\boxed{", said, "}"), 5: code, 6: line("<think>t</think> \\boxed{", said, "}"),
                     7: line("Answer: ", F.when(F.col("doc_id") % 2 == 0, "B").otherwise("C")), 8: line("<answer>", said, "</answer>")}, line("Answer: ", said))
    truth = pick({5: line('{"inputs": ["0"], "outputs": ["', n, '"]}'), 7: F.lit("B"), 8: line('{"target": ["', n, '"]}')}, n)
    t = docs(spark, d).select("doc_id", F.get(F.array(*map(F.lit, SOURCES)), k.cast("int")).alias("data_source"), response.alias("response"), truth.alias("ground_truth"))
    return S.default_score(t, run_programs=True).select("doc_id", "data_source", r("score").alias("score"))


@query("tool_call_rows", """WITH c AS (SELECT doc_id, unnest(range(0, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END)) AS place FROM documents)
 SELECT doc_id // 4 AS conv_id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id, place) AS INTEGER) AS call, 'search' AS name, '{"q":' || doc_id % 2 || '}' AS arguments,
 row_number() OVER (PARTITION BY doc_id // 4, doc_id % 2 ORDER BY doc_id, place) > 1 AS repeated FROM c""")
def tool_call_rows(spark, d):
    """Four documents are a conversation, whose calls ask one of two things."""
    one = F.concat(F.lit('<tool_call>{"name":"search","arguments":{"q":'), (F.col("doc_id") % 2).cast("string"), F.lit("}}</tool_call>"))
    said = F.concat(F.lit("before "), one, F.when(F.col("doc_id") % 3 == 0, one).otherwise(F.lit("<tool_call>{not json</tool_call>")))
    t = docs(spark, d).select(F.expr("doc_id div 4").alias("conv_id"), "doc_id", said.alias("text"))
    return calls.conversation_calls(t, turn="doc_id")


@query("task_readiness", """SELECT event_id::VARCHAR AS sample_id, task, CASE task WHEN 'actor' THEN '{"k":"' || json_extract_string(props, '$.k') || '","kind":' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"' || event_type || '"' END || '}'
 ELSE '{"k":"' || json_extract_string(props, '$.k') || '"}' END AS fields FROM events, (VALUES ('actor'), ('critic')) t(task)
 WHERE event_id % 3 <> 0 AND (task = 'critic' OR event_id % 2 = 0 OR event_id % 7 = 0) AND NOT (task = 'critic' AND event_id % 5 = 0)""")
def task_readiness(spark, d):
    """Two fields of events arrive on their own, some only as an end mark; one task has taken some samples."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.get_json_object("props", "$.k").alias("k"))
    kind = E.arrivals(e.where("id % 2 = 0 or id % 7 = 0"), "id", "kind", F.when(F.col("id") % 7 != 0, F.col("event_type")))
    took = E.taken(e.where("id % 5 = 0").withColumn("task", F.lit("critic")), "id", "task")
    return E.readiness(E.united(kind, E.arrivals(e.where("id % 3 <> 0"), "id", "k", F.col("k")), took), {"actor": ["kind", "k"], "critic": ["k"]})
