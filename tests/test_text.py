import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from stateforge.functions import answers, arrays, constraints, text

SAMPLES = ["", " ", "a  b", "\\, lead", "x\\quad y\\quadz", "Ünïcode\u00a0nb", "\u3000wide\u3000", "ﬁne ①", "tab\tnl\n\x0bend", "\x1cctl\x1f", "\x85next", "İstanbul ẞ", "e\u0301", "a" * 50]


def model(s):
    out = unicodedata.normalize("NFKC", s).lower().strip()
    return re.sub(r"\s+", " ", re.sub(r"\\(?:,|;|!|quad\b|qquad\b)", " ", out))


def test_normalize_text_is_pythons(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = {r[0]: r[1] for r in df.select("s", text.normalize_text(F.col("s"))).collect()}
    assert got == {s: model(s) for s in SAMPLES}


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame([("a b c d e f",), ("a b",), ("",), ("x x x x x x x",)], "s string")
    rows = df.withColumn("w", text.tokens(F.col("s"))).select("s", text.shingles(F.col("w"), 5)).collect()
    assert {r[0]: r[1] for r in rows} == {"a b c d e f": ["a b c d e", "b c d e f"], "a b": ["a b"], "": [], "x x x x x x x": ["x x x x x"]}
    pairs = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in pairs.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3]


def test_json_strings_are_pythons(spark):
    words = ['q"uote', "back\\slash", "nl\n", "ctl\x01\x1f", "é😀\u2028", "\x7f", ""]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = [r[0] for r in df.select(text.canonical_json(b=text.json_string(F.col("s")), a=F.lit("1"))).collect()]
    assert got == [json.dumps({"a": 1, "b": w}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for w in words]


@pytest.mark.parametrize(
    ("response", "found"),
    [
        ("\\boxed{1} and \\boxed {2}", "2"),
        ("\\boxed{\\frac{1}{2}}\nanswer is: 7.", "7"),
        ("The Final Answer： x。", "x"),
        ("答案是 42", "42"),
        ("so\n#### 13.", "13"),
        ("only line.", "only line"),
        ("a" * 80, "a" * 80),
        ("a" * 81, None),
        ("one\x0btwo", None),
        ("", None),
    ],
)
def test_extract_answer(spark, response, found):
    assert spark.createDataFrame([(response,)], "r string").select(answers.extract_answer(F.col("r"))).head()[0] == found


def test_numbers_and_equivalence(spark):
    numbers = {"1/2": 0.5, "\\frac{1}{2}": 0.5, "frac12": None, "1/0": None, "1_000": 1000.0, "1d": None, "５": 5.0, "$3$": 3.0, "1e5": 1e5, "+.5": 0.5, "5.": 5.0, "12345678901234567890": 12345678901234567890.0, "x": None, "-1/3": -1 / 3}
    numbers["frac12"] = None if re.fullmatch(r"frac\{?(-?\d+)\}?\{?(-?\d+)\}?", "frac12") is None else 0.5
    df = spark.createDataFrame([(k,) for k in numbers], "s string").withColumn("n", answers.normalize_answer(F.col("s")))
    assert {r[0]: r[1] for r in df.select("s", answers.as_number(F.col("n"))).collect()} == numbers
    pairs = [("0.5", "1/2", True), ("1e-12", "0", True), ("inf", "inf", True), ("nan", "nan", False), ("inf", "1", False), ("\\left(x\\right)", "(x)", True), ("x", "y", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.equivalent == r.want for r in answers.with_equivalence(df, "a", "b").collect())


def test_verified(spark):
    df = spark.createDataFrame([("\\boxed{2}", "2"), ("\\boxed{3}", "2"), (None, "2")], "response string, reference_answer string")
    rows = answers.verified(df).collect()
    assert [(r.status, r.score, r.error_type, r.details["reason"]) for r in rows] == [("pass", 1.0, None, "equivalent"), ("fail", 0.0, "wrong_answer", "not_equivalent"), ("unknown", 0.0, "answer_not_found", "answer_not_found")]


def test_constraints(spark):
    cases = [
        (" Hello World ", {"exact_text": "hello world"}, True),
        ("Hello", {"exact_text": "hello", "case_sensitive": True}, False),
        ("a b c", {"required_substrings": ["A", "c"], "forbidden_substrings": ["d"]}, True),
        ("a b c", {"forbidden_substrings": ["B"]}, False),
        ("start mid end", {"starts_with": "START", "ends_with": "end", "min_words": 3, "max_words": 3}, True),
        ("one", {"min_words": 2}, False),
        (None, {}, True),
    ]
    df = spark.createDataFrame([(r, json.dumps(m), w) for r, m, w in cases], "r string, m string, want boolean")
    assert all(r[0] == r[1] for r in df.select(constraints.passes(F.col("r"), F.col("m")), "want").collect())


def test_arrays(spark):
    one = spark.range(1)
    entropy = [0.1, 2.0, 9.0]
    raw = [min(max(1 - x / math.log(256), 0.1), 1.0) for x in entropy]
    mean = sum(raw) / 3
    got = one.select(arrays.confidence_weights(F.array(*map(F.lit, entropy)), 256)).head()[0]
    assert got == pytest.approx([x / mean for x in raw], abs=1e-12)
    assert one.select(arrays.confidence_weights(F.array().cast("array<double>"), 256)).head()[0] == []
    with pytest.raises(ValueError, match="vocab_size"):
        arrays.confidence_weights(F.lit(None), 1)
    rng = random.Random(1)
    import numpy as np

    logits = [rng.gauss(0, 1) for _ in range(8)]
    ids, lp, tail = [0, 3], [math.log(0.5), math.log(0.3)], 0.2
    want = arrays.sparse_kl_numpy(np.array([logits]), np.array([ids]), np.array([lp]), np.array([tail]))
    got = one.select(arrays.sparse_kl_token(F.array(*map(F.lit, logits)), F.array(*map(F.lit, ids)), F.array(*map(F.lit, lp)), F.lit(tail))).head()[0]
    assert got == pytest.approx(want, abs=1e-12)
    x = one.select(arrays.response_labels(F.array(F.lit(10), F.lit(11)), F.array(F.lit(20), F.lit(21), F.lit(22)), 2, 5).alias("x")).head()[0]
    assert (x.input_ids, x.labels) == ([10, 11, 20, 21, 22], [-100, -100, 20, 21, 22])
    assert one.select(arrays.logit_bounds(F.lit(2), F.lit(3), F.lit(6)).alias("x")).head()[0].asDict() == {"start": 1, "end": 4}
    with pytest.raises(Exception, match="beyond the causal input"):
        one.select(arrays.logit_bounds(F.lit(2), F.lit(5), F.lit(6))).collect()
    with pytest.raises(Exception, match="Missing verifier weight"):
        one.select(arrays.verifier_weight(F.lit("odd"), {"pass": 1.0})).collect()


def test_comparers(spark):
    """A registered comparer decides what isn't numbers; where it fails, hangs or can't be built, the plain comparison does."""
    import time

    from stateforge.functions import answers

    def odd(reference, candidate):
        if reference == "boom":
            raise RuntimeError("no")
        if reference == "slow":
            time.sleep(30)
        return sorted(reference) == sorted(candidate)

    def broken():
        raise ImportError("not here")

    answers.COMPARERS["odd"], answers.COMPARERS["broken"] = lambda: odd, broken
    rows = [("ab", "ba"), ("ab", "ac"), ("1", "1.0"), ("12", "21"), ("boom", "boom"), ("boom", "moob"), ("slow", "slow"), (None, "x"), ("x", None)] * 2
    df = spark.createDataFrame(rows, "r string, c string")
    got = [(x.r, x.c, x.equivalent) for x in answers.with_equivalence(df, "r", "c", comparer="odd", patience=0.5).collect()]
    want = {("ab", "ba"): True, ("ab", "ac"): False, ("1", "1.0"): True, ("12", "21"): False, ("boom", "boom"): True, ("boom", "moob"): False, ("slow", "slow"): True, (None, "x"): None, ("x", None): None}
    assert sorted(map(str, got)) == sorted(str((r, c, want[r, c])) for r, c in rows)
    plain = [(x.r, x.c, x.equivalent) for x in answers.with_equivalence(df, "r", "c", comparer="broken").collect()]
    assert sorted(map(str, plain)) == sorted(str((x.r, x.c, x.equivalent)) for x in answers.with_equivalence(df, "r", "c").collect())
    verdicts = answers.verified(spark.createDataFrame([("\\boxed{ba}", "ab")], "response string, reference_answer string"), comparer="odd").collect()
    assert verdicts[0].status == "pass"


def test_arithmetic():
    from stateforge.operators.rollout import arithmetic

    for expression in ("1", "-2**2", "2**3**2", "2**-1", "(1+2)*-3", "7//2-7/2", "- - 3", "2*(3+(4-1))**2//5", "1_000*0x10", "1.5e1-3", "-(2)", "10-3-2", "8/4/2", "(((((1)))))", "2 ** - 3 ** 2"):
        assert arithmetic(expression) == eval(expression), expression
    for wrong in ("", "1 2", "+1", "a", "1+", "(1", "1)", "()", "1**", "2j", "f(1)", "1 % 2", "1\n+2"):
        with pytest.raises((ValueError, SyntaxError)):
            arithmetic(wrong)
    with pytest.raises(OverflowError):
        arithmetic("9**9**9")
