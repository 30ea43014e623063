"""Answers as expressions: known identities, and random expressions against exact fractions."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from quadrant.operators import algebra
from quadrant.operators import evaluate as ev
from quadrant.session import materialize

EQUAL = [(r"\frac{1}{2}", "0.5"), ("2/4", r"\dfrac{1}{2}"), ("(x+1)^2", "x^2+2x+1"), (r"\frac{\frac{1}{2}}{3}", "1/6"),
         (r"\sqrt{8}", r"2\sqrt{2}"), (r"\sqrt{2}\cdot\sqrt{3}", r"\sqrt{6}"), ("x = 3", "3"), ("-x^2", "-(x^2)"), ("2^{-1}", "0.5"),
         (r"\left(a+b\right)\left(a-b\right)", "a^{2} - b^{2}"), ("1,234,567", "1234567"), ("2^3^2", "512"), ("x^{1/2}", r"\sqrt x"),
         (r"\frac12", ".5"), ("--3", "3"), ("3 \\times 4 \\div 6", "2"), (r"2\pi r", "r*2*pi"), ("(x^2-1)/(x-1)", "x+1"), ("4^{0.5}", "2"),
         ("0.1+0.2", "0.3"), (r"\frac{x}{\sqrt{x}}", r"\sqrt{x}"), ("10^{20}", "100000000000000000000"), ("a/b/c", "a/(bc)")]
DIFFERENT = [("1/2", "1/3"), ("(x+1)^2", "x^2+1"), ("x", "y"), ("-2^2", "4"), (r"\sqrt{2}", "1.41421356"), ("a/b/c", "a/(b/c)"),
             ("0.333", "1/3"), ("x", "X"), ("2^3^2", "64")]
NOT_READ = ["", "yes and no", "(1, 2)", "1 2", "1 1/2", "x +", "((1)", "1)", ")(", "5 cm^2 each", "2^x", r"\sqrt[3]{8}", "1..2", "*3", None]


def pairs(spark, rows):
    df = materialize(spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", algebra.residues("a").alias("x"), algebra.residues("b").alias("y")))
    return {(r.a, r.b): r.same for r in df.select("a", "b", algebra.same(F.col("x"), F.col("y")).alias("same")).collect()}


def test_identities(spark):
    got = pairs(spark, EQUAL + DIFFERENT)
    assert [p for p in EQUAL if got[p] is not True] == []
    assert [p for p in DIFFERENT if got[p] is not False] == []


def test_what_is_not_read(spark):
    df = spark.createDataFrame([(t,) for t in NOT_READ], "t string").select("t", algebra.residues("t").alias("x"))
    assert [r.t for r in df.collect() if r.x is not None and any(v is not None for v in r.x)] == []


def test_random_expressions_against_fractions(spark):
    rng = random.Random(11)

    def made(depth):
        if depth == 0:
            n = rng.randrange(0, 12)
            return (str(n), Fraction(n)) if rng.random() < 0.7 else (f"{n}.25", Fraction(n) + Fraction(1, 4))
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        op = rng.choice("+-*/^~f")
        if op == "^":
            k = rng.randrange(0, 4)
            return f"({a})^{{{k}}}", x ** k
        if op == "~":
            return f"(-({a}))", -x
        if op in "/f" and y:
            return (rf"\frac{{{a}}}{{{b}}}" if op == "f" else f"({a})/({b})"), x / y
        return {"+": (f"({a}+{b})", x + y), "-": (f"({a})-({b})", x - y)}.get(op, (f"({a})*({b})", x * y))

    rows, want = [], []
    for k in range(150):
        text, value = made(3)
        other = value if k % 2 else value + Fraction(rng.randrange(1, 5), rng.randrange(1, 5))
        rows.append((text, f"{other.numerator}/{other.denominator}" if other >= 0 else f"-{-other.numerator}/{other.denominator}"))
        want.append(bool(k % 2))
    got = pairs(spark, rows)
    assert [r for r, w in zip(rows, want) if got[r] is not w] == []


def test_the_primes():
    for p in algebra.PRIMES:
        assert p % 8 == 7 and pow(3, p - 1, p) == 1
        assert all(pow(q, (p - 1) // 2, p) == 1 for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67))


def test_answer_reward_compares_expressions(spark):
    rows = [(r"<answer>$\frac{1}{2}$</answer>", r"so \boxed{0.5}", 1.0), (r"<answer>$2x+1$</answer>", r"$1+2x$", 1.0),
            (r"<answer>$x$</answer>", r"$y$", 0.0), ("<answer>$7$</answer>", "$7.0$", 1.0), ("<answer>$a b$</answer>", "$ab$", 1.0),
            ("<answer>$(1, 2)$</answer>", "$(1,2)$", 1.0), ("no answer", "$1$", 0.0)]
    df = spark.createDataFrame(rows, "c string, s string, want double")
    assert [r for r in df.select("c", "want", ev.accuracy_reward("c", "s").alias("got")).collect() if r.want != r.got] == []
