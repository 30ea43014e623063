"""Equality of answers as expressions (R6), in Catalyst expressions.

An answer is normalised (LaTeX fractions, roots, exponents and products to plain operators), cut into
tokens, brought to postfix order by operator precedence, and evaluated modulo two primes at
pseudorandom points, one per letter.  Two answers are equal if they agree wherever both have a value.

Error: different rational expressions of degree D agree by chance at a point with probability at most (D / 2^30)^2;
different constants only if their difference has a numerator that both primes divide.  Equal
expressions always agree; where a root of a variable term has no value modulo a prime, that point says nothing.

Read: integers, decimals, thousands commas, single letters, pi, + - * / ^, roots, parentheses and braces, implied
products (of the same rank as * and /), ``x = ..``.  Not read (NULL): words, tuples, intervals, units, higher
roots, exponents that are neither integers nor halves, numbers apart by blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrant.functions.text import col, let, py_strip
from quadrant.operators.dsl import digits_mod

# The two greatest primes p = 7 modulo 8 below 2^31 - 1 for which every prime up to 67 is a square: then the root
# of a square number is v^((p+1)/4), and roots multiply as they should.
PRIMES = (2_089_006_391, 2_080_052_831)
SEEDS = (12_345, 67_890)                           # one point of evaluation each
LANES = [(p, s) for s in SEEDS for p in PRIMES]
VALUE = "struct<v:array<bigint>,n:bigint,d:bigint>"  # residues per lane; the number itself where it is a small fraction

REPLACED = [  # LaTeX and other spellings of operators, in order
    (r"\\left|\\right|\\[,!;: ]|\$|\{,\}", ""), (r"\\cdot|\\times|\\ast|\*(?!\*)|×|·", "*"), (r"\*\*", "^"), (r"\\div|÷", "/"),
    (r"\\[dt]frac", r"\\frac"), (r"\\frac\s*(\d)\s*(\d)", r"\\frac{$1}{$2}"), (r"\\pi|(?<![a-zA-Z])pi(?![a-zA-Z])", "π"),
    (r"−", "-"), (r"(?<=\d),(?=\d{3}(?!\d))", ""),
]
INNERMOST = [  # rewritten from the innermost braces outwards
    (r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "(($1)/($2))"), (r"\\sqrt\s*\{([^{}]*)\}", "√($1)"), (r"\^\s*\{([^{}]*)\}", "^($1)"),
]
FINISHED = [
    (r"\\?sqrt", "√"), (r"\{", "("), (r"\}", ")"), (r"\s+", ""),
    (r"(?<=[0-9a-zA-Zπ)])(?=[a-zA-Zπ√(])", "*"), (r"(?<=[a-zA-Zπ)])(?=[0-9])", "*"),
    (r"(?<![0-9a-zA-Zπ).])-", "~"), (r"(?<![0-9a-zA-Zπ).])\+", ""),
]
TOKEN = r"\d+\.\d*|\.\d+|\d+|[a-zA-Zπ√~^*/+()-]"


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def normalised(text) -> Column:
    """The answer in plain infix: ``~`` is a minus sign before an operand, ``√`` a root."""
    plain = _replaced(F.regexp_replace(py_strip(col(text)), r"^[a-zA-Z]\s*=(?!=)", ""), REPLACED)
    # a pass resolves the innermost braces, so there are at most as many as braces
    passes = let(plain, lambda t: F.aggregate(F.sequence(F.lit(0), F.regexp_count(t, F.lit(r"\{"))), t,
                                              lambda acc, _: _replaced(acc, INNERMOST)))
    return _replaced(passes, FINISHED)


def tokens(text) -> Column:
    """The tokens of an answer; NULL if it has other parts, words, or numbers apart by blanks."""
    text = col(text)
    readable = ~text.rlike(r"\d\s+[\d.]") & ~F.regexp_replace(text, r"\\[a-zA-Z]+|sqrt", "").rlike("[a-zA-Z]{3}")
    return F.when(readable, let(normalised(text), lambda s: let(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)), lambda found: F.when(
        (F.array_join(found, "") == s) & (F.size(found) > 0), found))))


def _rank(op: Column) -> Column:
    return (F.when(op.isin("+", "-"), 1).when(op.isin("*", "/"), 2).when(op == "~", 3).when(op == "^", 4)
             .when(op == "√", 5).otherwise(0))  # 0: a parenthesis


def postfix(toks: Column) -> Column:
    """Tokens in postfix order.  A parenthesis without its partner stays in the result as ``?``."""
    empty = F.array().cast("array<string>")

    def popped(acc, stays):
        """How many operators on top do not satisfy ``stays``."""
        start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"))
        return F.aggregate(F.reverse(acc["ops"]), start, lambda s, x: F.when(
            s["stop"] | stays(x), F.struct(s["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(
            F.struct((s["n"] + 1).alias("n"), F.lit(False).alias("stop"))))["n"]

    def moved(acc, n, push, drop=0):
        out = F.concat(acc["out"], F.slice(F.reverse(acc["ops"]), F.lit(1), n))
        left = F.greatest(F.size(acc["ops"]) - n - drop, F.lit(0))
        lost = F.when(F.size(acc["ops"]) - n < drop, F.array(F.lit("?"))).otherwise(empty)
        return F.struct(F.concat(out, lost).alias("out"), F.concat(F.slice(acc["ops"], F.lit(1), left), push).alias("ops"))

    def step(acc, t):
        rank = _rank(t)
        operator = let(rank, lambda r: let(popped(acc, lambda x: F.when(r == 4, _rank(x) <= 4).otherwise(_rank(x) < r)),
                                           lambda n: moved(acc, n, F.array(t))))
        closed = let(popped(acc, lambda x: x == "("), lambda n: moved(acc, n, empty, 1))
        pushed = F.struct(acc["out"].alias("out"), F.concat(acc["ops"], F.array(t)).alias("ops"))
        operand = F.struct(F.concat(acc["out"], F.array(t)).alias("out"), acc["ops"].alias("ops"))
        return (F.when(t.isin("(", "~", "√"), pushed).when(t == ")", closed).when(rank > 0, operator).otherwise(operand))

    start = F.struct(empty.alias("out"), empty.alias("ops"))
    return F.aggregate(toks, start, step, lambda acc: F.concat(
        acc["out"], F.transform(F.reverse(acc["ops"]), lambda o: F.when(o == "(", F.lit("?")).otherwise(o))))


def _power(base: Column, exponent: Column, p: Column) -> Column:
    """base^exponent modulo the prime p, for an exponent from zero up."""
    start = F.struct(F.lit(1).cast("bigint").alias("r"), base.alias("b"))
    e = F.pmod(exponent, p - 1)
    return let(e, lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, lambda acc, k: F.struct(
        F.when(F.getbit(x, k) == 1, F.pmod(acc["r"] * acc["b"], p)).otherwise(acc["r"]).alias("r"),
        F.pmod(acc["b"] * acc["b"], p).alias("b"))))["r"]


def _inverse(x: Column, p: Column) -> Column:
    return F.when(x != 0, _power(x, p - 2, p))


def _root(x: Column, p: Column) -> Column:
    """The root that is itself a square; NULL if there is none."""
    r = _power(x, F.call_function("div", p + 1, F.lit(4)), p)
    return let(r, lambda s: F.when(F.pmod(s * s, p) == x, s))


def _values(step) -> Column:
    """An array of ``step(lane, prime)`` over the lanes (numbered from 1)."""
    primes = F.array(*[F.lit(p).cast("bigint") for p, _ in LANES])
    return F.transform(primes, lambda p, i: step(i + 1, p))


def _value(v: Column, n: Column, d: Column) -> Column:
    return F.struct(v.alias("v"), n.cast("bigint").alias("n"), d.cast("bigint").alias("d"))


def _operand(t: Column) -> Column:
    """A number or letter as a value."""
    digits, places = F.replace(t, F.lit("."), F.lit("")), F.length(F.regexp_extract(t, r"\.(\d*)$", 1))
    scale = F.concat(F.lit("1"), F.repeat(F.lit("0"), places))
    number = _value(_values(lambda i, p: F.pmod(digits_mod(digits, p) * _inverse(digits_mod(scale, p), p), p)),
                    digits.try_cast("bigint"), scale.try_cast("bigint"))
    seeds = F.array(*[F.lit(s).cast("bigint") for _, s in LANES])

    def point(i, p):  # a square, so that a letter has a root
        return let(F.pmod((F.ascii(t) + F.length(t)).cast("bigint") * 48_271 * F.element_at(seeds, i) + 11, p),
                   lambda x: F.pmod(x * x, p))
    letter = _value(_values(point), F.lit(None), F.lit(None))
    return F.when(t.rlike(r"^[0-9.]"), number).otherwise(letter)


def _small_power(x: Column, e: Column) -> Column:
    """x^e as it is, if it fits."""
    return F.when(e == 0, F.lit(1).cast("bigint")).when(e.between(1, 63), F.aggregate(
        F.array_repeat(x, F.least(F.greatest(e, F.lit(0)), F.lit(63)).cast("int")), F.lit(1).cast("bigint"), F.try_multiply))


def _applied(op: Column, a: Column, b: Column) -> Column:
    """The value of a binary operator."""
    def lane(fn):
        return _values(lambda i, p: fn(F.element_at(a["v"], i), F.element_at(b["v"], i), p))

    cross = F.try_multiply(a["n"], b["d"]), F.try_multiply(b["n"], a["d"]), F.try_multiply(a["d"], b["d"])
    whole = let(b, lambda e: F.when((e["d"] != 0) & (F.pmod(e["n"], e["d"]) == 0), F.call_function("div", e["n"], e["d"])))
    half = F.when((F.try_multiply(b["n"], F.lit(2)) != 0) & (b["d"] != 0) & (F.pmod(F.try_multiply(b["n"], F.lit(2)), b["d"]) == 0),
                  F.call_function("div", F.try_multiply(b["n"], F.lit(2)), b["d"]))

    def raised(x, e, p):
        return F.when(e >= 0, _power(x, e, p)).otherwise(_inverse(_power(x, -e, p), p))

    power = let(F.struct(whole.alias("w"), half.alias("h")), lambda e: F.when(
        e["w"].isNotNull(), _values(lambda i, p: raised(F.element_at(a["v"], i), e["w"], p))).when(
        e["h"].isNotNull(), _values(lambda i, p: raised(_root(F.element_at(a["v"], i), p), e["h"], p))))
    return (F.when(op == "+", _value(lane(lambda x, y, p: F.pmod(x + y, p)), F.try_add(cross[0], cross[1]), cross[2]))
             .when(op == "-", _value(lane(lambda x, y, p: F.pmod(x - y, p)), F.try_subtract(cross[0], cross[1]), cross[2]))
             .when(op == "*", _value(lane(lambda x, y, p: F.pmod(x * y, p)), F.try_multiply(a["n"], b["n"]), cross[2]))
             .when(op == "/", _value(lane(lambda x, y, p: F.pmod(x * _inverse(y, p), p)), cross[0], cross[1]))
             .when(op == "^", let(whole, lambda e: _value(power, _small_power(a["n"], e), _small_power(a["d"], e)))))


def evaluated(post: Column) -> Column:
    """The residues of a postfix expression (an array over the lanes); NULL if it is none."""
    def step(stack, t):
        top, below = F.get(stack, F.size(stack) - 1), F.get(stack, F.size(stack) - 2)
        size = F.size(stack)
        operand = F.concat(stack, F.array(_operand(t)))
        minus = let(top, lambda a: _value(F.transform(a["v"], lambda x, i: F.pmod(-x, F.element_at(_primes(), i + 1))),
                                          F.try_multiply(a["n"], F.lit(-1)), a["d"]))
        root = let(top, lambda a: _value(_values(lambda i, p: _root(F.element_at(a["v"], i), p)), F.lit(None), F.lit(None)))
        one = F.concat(F.slice(stack, F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(F.when(t == "~", minus).otherwise(root)))
        two = F.concat(F.slice(stack, F.lit(1), F.greatest(size - 2, F.lit(0))),
                       F.array(let(F.struct(below.alias("a"), top.alias("b")), lambda x: _applied(t, x["a"], x["b"]))))
        nothing = F.array(F.lit(None).cast(VALUE), F.lit(None).cast(VALUE))  # two left over: no expression
        return (F.when(t.isin("~", "√"), F.when(size >= 1, one).otherwise(nothing))
                 .when(_rank(t) > 0, F.when(size >= 2, two).otherwise(nothing))
                 .when(t.isin("?", "("), nothing).otherwise(operand))

    start = F.array().cast(f"array<{VALUE}>")
    return F.aggregate(post, start, step, lambda stack: F.when(F.size(stack) == 1, F.get(stack, 0)["v"]))


def _primes() -> Column:
    return F.array(*[F.lit(p).cast("bigint") for p, _ in LANES])


def residues(text) -> Column:
    """What an answer evaluates to; NULL if it is not read as an expression."""
    return let(tokens(text), lambda t: let(postfix(t), evaluated))


def same(a: Column, b: Column) -> Column:
    """Whether two arrays of residues agree; NULL if they have no lane of either prime in common."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), x == y)), lambda e: e.isNotNull())
    known = [F.exists(F.zip_with(F.slice(a, k, 1), F.slice(b, k, 1), lambda x, y: x.isNotNull() & y.isNotNull()), lambda e: e)
             for k in range(1, len(LANES) + 1)]
    enough = (known[0] | known[2]) & (known[1] | known[3])
    return F.when(enough, F.forall(both, lambda e: e))
