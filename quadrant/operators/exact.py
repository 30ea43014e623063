"""Exact results of integer scripts of any size, as decimal text.

A run whose BIGINT lane overflows is run again in Python integers modulo a power of two beyond a bound on its
results (a run of its own gives the bound, in bits), so nothing on the way grows larger; see ``steps.exact_cells``.
``mixed_radix`` and ``decimal_text`` turn residues modulo primes below 10^9 into decimal text, in expressions."""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrant.functions.text import let
from quadrant.operators import dsl, steps

LIMB = 10 ** 9
MAX_BITS = 16_000  # results that may be larger keep NULL unless they are known to be correct


@lru_cache(maxsize=4)
def primes_below(top: int, count: int) -> tuple[int, ...]:
    """The ``count`` greatest primes below ``top``."""
    root = math.isqrt(top)
    small = bytearray([1]) * (root + 1)
    small[:2] = b"\0\0"
    for q in range(2, math.isqrt(root) + 1):
        if small[q]:
            small[q * q::q] = bytes(len(range(q * q, root + 1, q)))
    factors = [q for q in range(root + 1) if small[q]]
    found: list[int] = []
    while len(found) < count:
        low = max(2, top - 20_000)
        window = bytearray([1]) * (top - low)
        for q in factors:
            first = max(q * q, -(-low // q) * q)
            window[first - low::q] = bytes(len(range(first - low, top - low, q)))
        found += [low + i for i in range(top - low - 1, -1, -1) if window[i]]
        top = low
    return tuple(found[:count])


def _div(x: Column, y: Column | int) -> Column:
    return F.call_function("div", x, F.lit(y) if isinstance(y, int) else y)


def _inverse(x: Column, p: Column) -> Column:
    """x^(p-2) modulo the prime p."""
    start = F.struct(F.lit(1).cast("bigint").alias("r"), x.alias("b"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(29)), start, lambda acc, k: F.struct(
        F.when(F.getbit(p - 2, k) == 1, F.pmod(acc["r"] * acc["b"], p)).otherwise(acc["r"]).alias("r"),
        F.pmod(acc["b"] * acc["b"], p).alias("b")))
    return done["r"]


def mixed_radix(residues: Column, primes: Column) -> Column:
    """Digits d with value d0 + d1 p0 + d2 p0 p1 + .., from the residues modulo the first primes."""
    def digit(ds, p, r):
        zipped = F.zip_with(ds, F.slice(primes, F.lit(1), F.size(ds)), lambda d, q: F.struct(d.alias("d"), q.alias("q")))
        start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("m"))
        known = F.aggregate(zipped, start, lambda acc, x: F.struct(
            F.pmod(acc["v"] + x["d"] * acc["m"], p).alias("v"), F.pmod(acc["m"] * x["q"], p).alias("m")))
        return let(known, lambda k: F.pmod(F.pmod(r - k["v"], p) * _inverse(k["m"], p), p))

    return F.aggregate(F.arrays_zip(F.slice(primes, F.lit(1), F.size(residues)).alias("p"), residues.alias("r")),
                       F.array().cast("array<bigint>"), lambda ds, x: F.concat(ds, F.array(digit(ds, x["p"], x["r"]))))


def decimal_text(digits: Column, primes: Column) -> Column:
    """The number of mixed-radix digits, in decimal."""
    def carried(limbs, first):
        return let(limbs, lambda a: F.transform(a, lambda x, i: F.pmod(x, F.lit(LIMB)) + F.when(i == 0, first).otherwise(
            _div(F.element_at(a, F.greatest(i, F.lit(1))), LIMB))))

    def step(limbs, x):
        raw = F.transform(F.concat(limbs, F.array(F.lit(0).cast("bigint"))), lambda v: v * x["p"])
        return carried(carried(raw, x["d"]), F.lit(0).cast("bigint"))

    pairs = F.reverse(F.arrays_zip(digits.alias("d"), F.slice(primes, F.lit(1), F.size(digits)).alias("p")))
    limbs = F.aggregate(pairs, F.array().cast("array<bigint>"), step)
    start = F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).cast("bigint").alias("c"))
    done = F.aggregate(limbs, start, lambda acc, v: F.struct(
        F.concat(F.array(F.lpad(F.pmod(v + acc["c"], F.lit(LIMB)).cast("string"), 9, "0")), acc["t"]).alias("t"),
        _div(v + acc["c"], LIMB).alias("c")))
    text = F.regexp_replace(F.array_join(done["t"], ""), "^0+", "")
    return F.when(text == "", F.lit("0")).otherwise(text)


def with_exact_results(df: DataFrame, prog: str = "prog", a: str = "A", b: str = "B", out: str = "exact",
                       max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with ``out``: the four output cells of every run in integers, as decimal texts (row by row).

    NULL where the script fails, has a decimal literal or the matrices are NULL, and where a cell may need more
    than ``max_bits`` bits."""
    def run(code: pa.Array, literals: pa.Array, slots: pa.Array, cells: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = zip(dsl._lists(code), dsl._lists(literals), dsl._lists(slots), dsl._lists(cells), wanted.to_pylist())
        return pa.array([steps.exact_cells(c, lit, o, x, max_bits) if w else None for c, lit, o, x, w in rows], pa.list_(pa.string()))

    p, cells = F.col(prog), dsl.cells_of(a, b, "bigint")
    wanted = p["ok"] & ~p["has_float"] & F.forall(cells, lambda x: x.isNotNull())
    return df.withColumn(out, dsl._column(run, "array<string>", p["code"], p["literals"], p["out"], cells, wanted))
