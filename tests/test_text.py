from pyspark.sql import functions as F

from quadrant.functions import text as tx


def one(spark, col_expr, value):
    return spark.createDataFrame([(value,)], "s string").select(col_expr).first()[0]


def test_strip_is_python_strip(spark):
    for s in ["  a b \t", "　x ", "\x1cy\x1f", "\xa0 z ", "", "a\r\n"]:
        assert one(spark, tx.py_strip("s"), s) == s.strip()


def test_tag_extraction(spark):
    assert one(spark, tx.tag_body("s"), "x <dsl>\n a = 1 \n</DSL> y") == "a = 1"
    assert one(spark, tx.tag_body("s"), "<DSL>first</DSL><DSL>second</DSL>") == "first"
    assert one(spark, tx.has_tag("s"), "no tags") is False


def test_script_from_completion(spark):
    s = "<DSL>\n M1 = a * b <|im_end|>\n\n C[0,0] = M1 \n</DSL>"
    assert one(spark, tx.script_from_completion("s"), s) == "M1 = a * b\nC[0,0] = M1"
    assert one(spark, tx.is_sentinel(tx.script_from_completion("s")), "<DSL>Error: Cannot determine full sequence.</DSL>")


def test_reply_endings(spark):
    df = spark.createDataFrame([("P", "Pbody<|im_end|>"), ("P", "Pbody<|endoftext|><|im_end|>"),
                                ("P", "Pbody<|im_end|><|endoftext|>"),
                                ("Q", "x<|im_start|>assistant\nreply<|im_end|>"),
                                ("Q", "x<|im_start|>assistant\nold reply<|im_start|>assistant")], "p string, t string")
    got = [r[0] for r in df.select(tx.reply_from_generation("t", "p")).collect()]
    # a last marker that does not end its line: the whole text
    assert got == ["body", "body", "body<|im_end|>", "reply", "x<|im_start|>assistant\nold reply<|im_start|>assistant"]


def test_first_value_of_a_metric(spark):
    from pyspark.sql import functions as F

    from quadrant.operators import evaluate as ev
    df = spark.sql("SELECT map('old/entropy', CAST(NULL AS DOUBLE), 'Entropy', 0.5D, 'entropy2', 9D) AS logs")
    assert df.select(ev.first_key_containing(F.col("logs"), "entropy")).first()[0] == 0.5


def test_decimal_literals(spark):
    from quadrant.functions import matrix as mx
    df = spark.createDataFrame([("[[1.50, 2], [-3, 40000000.25]]", "[[1, 0], [0, 2]]"), ("nope", "[[1, x]]")], "a string, b string")
    rows = df.select(mx.literal_repr(mx.literal_matrix("a")).alias("a"), mx.literal_matrix("b").isNull().alias("bad"),
                     mx.literal_repr(mx.literal_product(mx.literal_matrix("a"), mx.literal_matrix("b"))).alias("c")).collect()
    a = [[1.50, 2], [-3, 40000000.25]]
    b = [[1, 0], [0, 2]]
    c = [[a[r][0] * b[0][k] + a[r][1] * b[1][k] for k in (0, 1)] for r in (0, 1)]
    assert (rows[0].a, rows[0].c, rows[0].bad) == (str(a), str(c), False) and rows[1].a is None and rows[1].bad


def test_format_cases(spark):
    cases = {"<think>a</think><answer>b</answer>": True, " <think>a</think><answer>b</answer>": False,
             "<think>a</think><answer>b</answer>\n": True, "<think>a</think><answer>b</answer>\r\n": False,
             "<think>a</think>": False}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    for r in df.select("s", tx.think_answer_format("s").alias("ok")).collect():
        assert r.ok == cases[r.s]


def test_canonical_name(spark):
    assert one(spark, tx.canonical_name("s"), " a[0 , 1] ") == "A[0,1]"
    assert one(spark, tx.drop_trailing_semicolon("s"), "x = 1 ;") == "x = 1"


def test_normalize_completion(spark):
    df = spark.createDataFrame([([("assistant", "hi")],), ([("a", "x"), ("b", "y")],)],
                               "c array<struct<role:string,content:string>>")
    got = [r.completion for r in tx.normalize_completion(df, "c").collect()]
    assert got[0] == "hi" and got[1].startswith("[{")
    assert tx.token_list(["<|im_end|>", "", "<eos>"]) == tx.SPECIAL_TOKENS + ["<eos>"]


def test_inference_prompt(spark):
    df = spark.createDataFrame([("q", [[1, 2], [3, 4]], [[5, 6], [7, 8]])],
                               "u string, a array<array<bigint>>, b array<array<bigint>>")
    assert df.select(tx.inference_prompt("u", "a", "b")).first()[0] == "q (Using A=[[1, 2], [3, 4]], B=[[5, 6], [7, 8]])"


def test_truncate(spark):
    df = spark.createDataFrame([("x" * 99 + "é!",), ("short",), (None,)], "m string")
    assert [r[0] for r in df.select(tx.truncate("m")).collect()] == ["x" * 99 + "é", "short", None]


def test_scripts_are_extracted_without_lambdas(spark):
    """A completion's lines were cleaned by interpreted lambdas."""
    cases = {"x<dSL>\n a \n\n<|im_end|>b</DsL> y <DSL>z</DSL>": (True, "a\nb"), "é<dſl> c</DSL>": (True, "c"), "<DSL> a": (False, "<DSL> a"),
             "</DSL><DSL>": (False, "</DSL><DSL>"), "<DSL></DSL>q": (True, ""), " a \n\x85\nb<|endoftext|>": (False, "a\nb"), "": (False, "")}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "s string").withColumn("f", tx.tagged_script("s"))
    df = df.withColumn("one", tx.script_from_completion("s")).withColumn("flag", tx.has_tag("s"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString().replace("<lambda>", "")
    for r in df.collect():
        want = cases.get(r.s)
        assert (r.f.tagged, r.f.script) == (want or (None, None)) and r.one == (want and want[1]) and r.flag == (want and want[0]), r.s
