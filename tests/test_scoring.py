import pytest
from pyspark.sql import functions as F

from rillflow.functions import answers as A
from rillflow.functions import scoring as S
from rillflow.operators import filters, plugins, prep


def ev(spark, value, f):
    kind = "string" if isinstance(value, (str, type(None))) else None
    df = spark.createDataFrame([(value,)], f"x {kind}") if kind else spark.createDataFrame([(value,)], ["x"])
    return df.select(f("x").alias("y")).first()["y"]


def test_gsm8k(spark):
    assert ev(spark, "so #### 1,234 and #### -5.0$", S.gsm8k_answer) == "-5.0"
    assert ev(spark, "none", S.gsm8k_answer) is None
    assert ev(spark, "it is 7. ", lambda c: S.gsm8k_answer(c, "flexible")) == "7."
    assert ev(spark, "well . .", lambda c: S.gsm8k_answer(c, "flexible")) == "."
    assert ev(spark, "#### 3" + "x" * 300, S.gsm8k_answer) is None
    assert ev(spark, "#### 3", lambda c: S.gsm8k_score(c, F.lit("4"), format_score=0.1)) == 0.1
    with pytest.raises(ValueError):
        S.gsm8k_answer("x", "other")


def test_minerva(spark):
    norm = lambda s: ev(spark, s, S.normalise_final)
    assert norm("x = $1,000$ dollars") == "1000"
    assert norm("\\text{yes}") == "yes" and norm("\\frac12") == "\\frac{1}{2}" and norm("\\sqrt2") == "\\sqrt{2}"
    assert norm("90^\\circ") == "90" and norm("12 km") == "12"
    got = ev(spark, "Answer: 3\nAnswer: $\\boxed{5}$", lambda c: S.minerva(c, F.lit("5")))
    assert (got["score"], got["acc"], got["pred"]) == (1.0, True, "5")
    got = ev(spark, "nothing", lambda c: S.minerva(c, F.lit("5")))
    assert got["score"] == -1.0 and got["pred"] == "[INVALID]"


def test_question_answering(spark):
    golds = F.array(F.lit("The  Beatles!"), F.lit("x"))
    em = lambda s: ev(spark, s, lambda c: S.exact_match(c, golds, format_score=0.1))
    assert em("<answer>no</answer><answer> beatles </answer>") == 1.0
    assert em("<answer>beatles band</answer>") == 0.1 and em("beatles") == 0.0
    assert em("<answer>a beatles</answer>" + "</answer>" * 11) == 0.25
    assert ev(spark, "<answer>the beatles band</answer>", lambda c: S.contained_match(c, golds)) == 1.0


def test_tool_calls(spark):
    calls = ev(spark, 'a<tool_call>{"name":"f","arguments":{"x":[1]}}</tool_call><tool_call>oops</tool_call>', S.tool_calls)
    assert [(c["name"], c["arguments"]) for c in calls] == [("f", '{"x":[1]}')]
    assert ev(spark, "a<tool_call>x</tool_call>b", S.without_tool_calls) == "ab"


def test_truncation_of_tool_responses_keeps_the_named_end_the_other_way(spark):
    assert ev(spark, "abcdef", lambda c: S.truncate_response(c, 4, "left")) == "abcd...(truncated)"
    assert ev(spark, "abcdef", lambda c: S.truncate_response(c, 4, "right")) == "(truncated)...cdef"
    assert ev(spark, "abcdef", lambda c: S.truncate_response(c, 4)) == "ab...(truncated)...ef"
    assert ev(spark, "abc", lambda c: S.truncate_response(c, 4)) == "abc"


def test_penalties_and_placement(spark):
    got = [ev(spark, n, lambda c: S.overlong(c, 100, 20)) for n in (70, 80, 90, 100)]
    assert got == [0.0, 0.0, -0.5, -1.0]
    assert ev(spark, 2, lambda c: S.place_reward(F.lit(3.0), c, F.lit(4))) == [0.0, 3.0, 0.0, 0.0]
    assert ev(spark, 0, lambda c: S.place_reward(F.lit(3.0), c, F.lit(2))) == [0.0, 0.0]


def test_dispatch(spark):
    df = spark.createDataFrame([("openai/gsm8k", "#### 3", "3"), ("aime2025", "Answer: 3", "4"), ("searchR1_nq", "<answer>x</answer>", "x")], "data_source string, response string, ground_truth string")
    assert [r["score"] for r in S.default_score(df).collect()] == [1.0, -1.0, 1.0]
    with pytest.raises(Exception, match="no scorer for other"):
        S.default_score(df.limit(1).withColumn("data_source", F.lit("other"))).collect()


SCORED = [
    ("openai/gsm8k", "#### 3", "3", 1.0),
    ("lighteval/MATH", "so \\boxed{\\frac12}", "0.5", 1.0),
    ("DigitalLearningGmbH/MATH-lighteval", "so \\boxed{2}", "3", 0.0),
    ("HuggingFaceH4/MATH-500", None, "3", 0.0),
    ("math", "Answer: 4", "4", 1.0),
    ("math_dapo", "Answer: 5", "4", -1.0),
    ("math_dapo_reasoning", "Answer: $4$", "4", 1.0),
    ("aime2024", "Answer: 033", "33", -1.0),
    ("numina_olympiads", "The answer is \\boxed{x+1}", "1+x", 1.0),
    ("numina_cn_k12", "The answer is 3", "4", 0.0),
    ("codecontests", "```python\nprint(int(input()) * 2)\n```", '{"inputs": ["2", "3"], "outputs": ["4\\n", "7"]}', 0.5),
    ("apps", "```python\nclass Solution:\n    def f(self, a, b):\n        return a + b\n```", '{"fn_name": "f", "inputs": [[1, 2]], "outputs": [[3]]}', 1.0),
    ("taco", "oops(", '{"inputs": ["2"], "outputs": ["4"]}', 0.0),
    ("codeforces", "print(1)", "no json", 0.0),
    ("hiyouga/geometry3k", "<think>t</think> \\boxed{12 cm}", "12", 1.0),
    ("hiyouga/geometry3k", "\\boxed{12}", "12", 0.9),
    ("gpqa_diamond", "Answer: B", "B", 1.0),
    ("searchR1_nq", "<answer>the x</answer>", '{"target": ["y", "X"]}', 1.0),
    ("searchR1_popqa", "<answer>y</answer>", '{"target": "y"}', 1.0),
    ("searchR1_musique", "<answer>z</answer>", "z", 1.0),
]


def test_every_source_scores(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(SCORED)], "i int, data_source string, response string, ground_truth string, want double")
    got = {r["i"]: (r["score"], r["want"]) for r in S.default_score(df, run_programs=True).collect()}
    assert all(abs(a - b) < 1e-9 for a, b in got.values()), [(SCORED[i][0], v) for i, v in got.items() if v[0] != v[1]]
    named = {s for s in S.sources() if not s.endswith("*")}
    assert {s for s, *_ in SCORED} | {"numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc"} >= named
    golds = df.where("data_source = 'searchR1_nq'").withColumn("ground_truth", F.struct(F.array(F.lit("x")).alias("target")))
    assert S.default_score(golds).first()["score"] == 1.0


def test_programs_are_run_on_demand_only(spark):
    df = spark.createDataFrame([("apps", "print(1)", "{}", [True, False, False, True]), ("taco", "x", "{}", []), ("math_dapo", "Answer: 3", "3", None)], "data_source string, response string, ground_truth string, case_results array<boolean>")
    assert [r["score"] for r in S.default_score(df).collect()] == [0.5, 0.0, 1.0]
    with pytest.raises(Exception, match="run_programs"):
        S.default_score(df.drop("case_results")).collect()


def test_limits_of_programs():
    from rillflow.functions import cases

    assert cases.output_of("print(input())", "a") == "a\n" and cases.output_of("1/0", "") is None
    assert cases.output_of("while True: pass", "", seconds=1) is None
    assert cases.output_of("x = bytearray(1 << 31)", "", memory_mb=256) is None
    assert cases.same_output("1.0000000001 a", "1 a") and not cases.same_output("1 b", "1 a") and not cases.same_output(None, "")
    many = '{"inputs": %s, "outputs": %s}' % (["1"] * 12, ["1"] * 10 + ["2"] * 2)
    many = many.replace("'", '"')
    assert cases.code_score("print(input())", many) == 1.0 and cases.code_score("print(input())", many, continuous=False) == 0.0


@pytest.mark.parametrize("a, b, want", [("x+1", "1+x", True), ("(x+1)^2", "x^2+2x+1", True), ("\\sqrt{8}", "2\\sqrt{2}", True), ("2\\pi", "\\pi \\cdot 2", True), ("x-y", "y-x", False), ("sin(x)^2+cos(x)^2", "1", True),
                                        ("1/3", "0.3333333333", False), ("a+b+c", "c+b+a", False), ("9^9^9^9", "9^9^9^9", False), ("1e999999999", "1", False), ("(" * 200 + "1", "1", False), ("\\sqrt[3]{27}", "3", True)])
def test_symbolic_equality(a, b, want):
    from rillflow.functions import symbolic

    assert symbolic.same(a, b) == want


def test_verified_and_matrices():
    assert A.verified("so \\boxed{\\frac{2}{4}}", "0.5") == 1.0 and A.verified("about 1,000", "1000") == 1.0 and A.verified("none", "1") == 0.0
    assert A.verified("\\boxed{(1, x+1)}", "(1,1+x)") == 1.0 and A.verified("\\boxed{(1,2]}", "(1,2)") == 0.0
    one, other = "\\begin{pmatrix} 1 & 2 \\\\ 3 & 4.0 \\end{pmatrix}", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}"
    assert A.close(one, other) and not A.close(one, other.replace("4", "5")) and A.close("[0.5, 1]", "[1/2, 1]")


def test_points(spark):
    pts = ev(spark, '[{"point_2d": [1, 2]}, {"point_2d": [3, 4]}]', S.points)
    assert pts == [[1.0, 2.0], [3.0, 4.0]] and ev(spark, "no", S.points) is None
    box = F.array(*[F.lit(float(x)) for x in (2, 3, 4, 5)])
    assert ev(spark, pts, lambda c: S.point_rank_reward(c, box)) == 0.5
    assert ev(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], S.collinear) and not ev(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 3.0]], S.collinear)


def test_boxes():
    assert A.last_boxed("a \\boxed{1} b \\boxed{x{y}z} c") == "\\boxed{x{y}z}" and A.unboxed("\\boxed{x{y}z}") == "x{y}z"
    assert A.last_boxed("\\fbox{2}") == "\\fbox{2}" and A.last_boxed("\\boxed{open") is None and A.last_boxed(None) is None
    assert A.unboxed(A.last_boxed("so \\boxed 5$ end")) == "5"
    assert A.strict_box("x" * 200 + "\\boxed{3}", "3") == 1.0 and A.strict_box("\\boxed{3}" + "x" * 200, "3") == -1.0


@pytest.mark.parametrize("a, b", [("\\frac12", "\\frac{1}{2}"), ("0.5", "1/2"), ("x=3", "3"), ("\\sqrt2", "\\sqrt{2}"), ("\\tfrac{1}{3}", "\\dfrac13"), ("5\\text{ cm}", "5"), (".5", "1/2"), ("10\\%", "10")])
def test_equal_latex(a, b):
    assert A.latex_equal(a, b)


def test_unequal_latex():
    assert not A.latex_equal("1/2", "1/3") and not A.latex_equal(None, "1") and A.latex_equal("\\frac", "\\frac")


def test_expressions():
    assert A.rational("2*(3+4)^2/7") == 14 and A.rational("\\frac{1}{2}+1") == A.Fraction(3, 2)
    for bad in ("__import__('os')", "2**", "1/0", "x+1", "2^999", ""):
        assert A.rational(bad) is None
    assert A.expressions_equal("1,000", "1000") and A.expressions_equal("(1, 2)", "(1,2)") and not A.expressions_equal("[1,2]", "(1,2)")
    assert A.expressions_equal("2 million", "2*10^6") and A.expressions_equal("12 cm", "12") and A.expressions_equal("1 1/2", "1+1/2")
    assert not A.expressions_equal("4/2", "2") and not A.expressions_equal(None, "2") and not A.expressions_equal("2/4", "1/2")
    assert A.close("33.3%", "0.333") and A.close("3.14160", "3.1416") and not A.close("3", "4")


def test_finding_and_grading_answers():
    assert A.find_answer("I think. The answer is 42") == (True, "42")
    assert A.find_answer("so we get x = 5") == (True, "5")
    assert A.find_answer("no digits, the answer is yes")[0] is False
    assert A.graded("The answer is \\boxed{0.5}.", "\\frac{1}{2}")[0] and not A.graded("The answer is 3", "4")[0]
    assert A.graded("Answer: 2\\pi", "6.28318")[0]
    assert A.graded(None, "4") == (False, False, "")


def test_text_measures():
    assert A.repetitive("ab" * 50) and not A.repetitive("the quick brown fox jumps") and not A.repetitive("a") and not A.repetitive("")
    assert A.bleu("a b c d e", "a b c d e") == pytest.approx(1.0) and A.bleu("x y", "a b") == 0.0 and 0 < A.bleu("a b c", "a b c d e") < 1
    assert A.tolerant_json("ok {'a': 'it\\'s', 'b': None, \"c\": [1,],} x") == {"a": "it's", "b": None, "c": [1]}
    assert A.tolerant_json("{broken [1, 2]") == [1, 2] and A.tolerant_json("none") is None


def test_brute_force_of_the_repetition_measure():
    import random

    r = random.Random(1)
    for _ in range(60):
        s = "".join(r.choice("ab") for _ in range(r.randrange(2, 30)))
        suffixes = sorted(s[i:] for i in range(len(s)))
        lcp = sum(next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:]))
        assert A.repetitive(s, 0.2) == (2 * lcp / (len(s) * (len(s) + 1)) > 0.2)


def test_messages(spark):
    ok = lambda c: ev(spark, c, lambda x: filters.valid_content(F.col(x)))
    assert ok("hi") and ok("<think>a</think> b") and ok(None)
    assert not any(ok(x) for x in (" ", "<think>a", "<think></think> b", "<think>a</think>", "<think>a</think><think>b</think> c", "<|im_end|>"))
    assert ev(spark, "<think>a\nb</think> c", filters.without_think) == "c"


def test_roles(spark):
    df = spark.createDataFrame([([("human", "a"), ("gpt", "b")],)], "m array<struct<from:string,value:string>>")
    assert [tuple(x) for x in df.select(prep.remap_roles("m").alias("m")).first()["m"]] == [("user", "a"), ("assistant", "b")]
    bad = spark.createDataFrame([([("robot", "a")],)], "m array<struct<from:string,value:string>>")
    with pytest.raises(Exception, match="unknown role robot"):
        bad.select(prep.remap_roles("m")).collect()


def test_reward_managers(spark, tmp_path):
    df = spark.createDataFrame([("openai/gsm8k", "#### 3", "3", 2, 3, None), ("openai/gsm8k", "#### 3", "4", 3, 3, 0.7)], "data_source string, response string, ground_truth string, response_length int, max_length int, rm_score double")
    assert [r["rewards"] for r in plugins.reward_managers.get("naive")(df).collect()] == [[0.0, 1.0, 0.0], [0.0, 0.0, 0.7]]
    long = plugins.reward_managers.get("dapo")(df, longest=3, buffer=1).collect()
    assert [r["overlong"] for r in long] == [False, True] and long[1]["rewards"] == [0.0, 0.0, -1.0]
    assert [r["overlong"] for r in plugins.reward_managers.get("dapo")(df).collect()] == [False, False]

    def flaky(text, truth):
        if truth == "4":
            raise RuntimeError
        return 2.0

    assert [r["score"] for r in plugins.reward_managers.get("prime")(df.drop("rm_score"), score=flaky).orderBy("ground_truth").collect()] == [2.0, 0.0]
    (tmp_path / "own.py").write_text("def score(text, truth, bonus=0.0):\n    return len(text) + bonus\n")
    f = plugins.function_from_file(str(tmp_path / "own.py"), "score", bonus=1.0)
    assert [r["score"] for r in plugins.scored_by(df, f).collect()] == [7.0, 7.0]
    with pytest.raises(AttributeError):
        plugins.function_from_file(str(tmp_path / "own.py"), "other")
    with pytest.raises(ValueError):
        plugins.reward_managers.get("other")
    with pytest.raises(TimeoutError), plugins.time_limit(0.05):
        while True:
            pass


def test_dispatch_of_rows(spark):
    df = spark.range(6).withColumnRenamed("id", "row_idx")
    assert plugins.dispatchers.get("one_to_all")(df, 2).count() == 12
    got = plugins.dispatchers.get("nd_compute")(df, 2, ranks={0: 0, 1: 0, 2: 1, 3: 1})
    assert {r["worker"]: r["count"] for r in got.groupBy("worker").count().collect()} == {0: 3, 1: 3, 2: 3, 3: 3}
    assert plugins.collect(got, {0: True, 2: True, 1: False}).count() == 6


def test_long_texts_get_a_repetition_flag(spark, sf_dir):
    """All documents have a row; long texts against brute force over sorted suffixes."""
    import random

    from rillflow.plans import registry

    got = {r["doc_id"]: r["repetitive"] for r in registry.queries()["repetition_flags"](spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(got) == set(docs) and any(len(t) >= 2000 for t in docs.values())

    def brute(s):
        suffixes = sorted(s[i:] for i in range(len(s)))
        lcp = 0
        for a, b in zip(suffixes, suffixes[1:]):
            lcp += next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return 2 * lcp / (len(s) * (len(s) + 1)) > 0.2 if len(s) > 1 else False

    some = sorted((i for i in docs if 2000 <= len(docs[i]) < 4000))[:10]
    assert some and all(got[i] == brute(docs[i]) for i in some)
    r = random.Random(2)
    for n in (300, 1200, 2500):
        one = "".join(r.choice("abcdefgh é") for _ in range(n))
        for s in (one, one + one, one + one[: n // 3], one[: n // 2] * 3):
            assert A.repetitive(s) == brute(s)


def test_bleu_scores_are_of_whole_texts(spark, sf_dir):
    from rillflow.plans import registry

    got = {r["doc_id"]: r["bleu"] for r in registry.queries()["bleu_scores"](spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert any(len(t) > 419 for t in docs.values())
    assert got == {i: pytest.approx(A.bleu(t, t[19:]), abs=1e-5) for i, t in docs.items()}
