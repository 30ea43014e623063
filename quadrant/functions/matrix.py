"""2x2 matrices as ``ARRAY<ARRAY<..>>`` columns: deterministic generation,
products, validity and the string fallbacks used when preparing prompts.

Generation uses plain BIGINT arithmetic (no ``rand()``, which depends on
partitioning, and no engine-specific hash), so any SQL engine can recompute
the same cells from the same key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrant.functions.text import col

P = 2147483647  # 2^31 - 1, modulus of the integer mixer


def mix(key, slot: int) -> Column:
    """Deterministic integer mix of (key, slot) into [0, P)."""
    k = F.pmod(col(key).cast("bigint"), F.lit(P))
    h = F.pmod(k * 48271 + (slot * 7919 + 1), F.lit(P))
    h = F.pmod(h * 16807 + 12345, F.lit(P))
    return F.pmod(h * 48271, F.lit(P))


def mix_sql(key: str, slot: int) -> str:
    """The same mixer as SQL text (used by DuckDB oracles)."""
    k = f"(({key})::BIGINT % {P})"
    h = f"(({k} * 48271 + {slot * 7919 + 1}) % {P})"
    h = f"(({h} * 16807 + 12345) % {P})"
    return f"(({h} * 48271) % {P})"


def matrix(c00, c01, c10, c11) -> Column:
    return F.array(F.array(col(c00), col(c01)), F.array(col(c10), col(c11)))


def at(m, r: int, c: int) -> Column:
    return F.get(F.get(col(m), r), c)


def product(a, b) -> Column:
    """Ground-truth 2x2 product."""
    def cell(r, c):
        return at(a, r, 0) * at(b, 0, c) + at(a, r, 1) * at(b, 1, c)
    return matrix(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))


def is_2x2(m) -> Column:
    """Accepted by the executors (F4): two rows, the first exactly two wide,
    the second at least two wide (only row 0's width is checked), and every
    element numeric."""
    m = col(m)
    return F.coalesce(
        (F.size(m) == 2) & (F.size(F.get(m, 0)) == 2) & (F.size(F.get(m, 1)) >= 2)
        & F.forall(m, lambda row: F.forall(row, lambda x: x.isNotNull())),
        F.lit(False))


def product_ok(m) -> Column:
    """The unchecked product function reads [r][0..1] of rows 0..1."""
    m = col(m)
    return F.coalesce((F.size(m) >= 2) & (F.size(F.get(m, 0)) >= 2) & (F.size(F.get(m, 1)) >= 2)
                      & F.forall(F.slice(m, 1, 2), lambda row: F.forall(F.slice(row, 1, 2), lambda x: x.isNotNull())),
                      F.lit(False))


def parse_matrix(s, element: str = "bigint") -> Column:
    """Matrix text -> array; NULL when not a JSON-style nested list."""
    return F.from_json(col(s), f"array<array<{element}>>")


def is_float_text(x: Column) -> Column:
    """A Python number literal with a point or an exponent."""
    return x.rlike("[.eE]")


def py_float(x: Column) -> Column:
    """A double as Python prints it (positional below 1e16)."""
    wide = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", "")
    positional = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    plain = x.cast("string")
    return F.when(plain.contains("E") & (F.abs(x) >= 1) & (F.abs(x) < 1e16), positional).otherwise(plain)


def literal_matrix(s) -> Column:
    """Matrix text -> its numbers as Python would print them; NULL when not a
    nested list of numbers."""
    numbers = F.from_json(col(s), "array<array<string>>")
    good = F.forall(F.from_json(col(s), "array<array<double>>"), lambda row: row.isNotNull())
    return F.when(good, F.transform(numbers, lambda row: F.transform(
        row, lambda x: F.when(is_float_text(x), py_float(x.try_cast("double"))).otherwise(x))))


def literal_product(a, b) -> Column:
    """Ground-truth product of two ``literal_matrix``: a cell is a float when any of its
    four operands is, else an exact integer."""
    def cell(r, c):
        xs = [at(a, r, 0), at(b, 0, c), at(a, r, 1), at(b, 1, c)]
        f = [x.try_cast("double") for x in xs]
        i = [x.try_cast("bigint") for x in xs]
        floating = is_float_text(xs[0]) | is_float_text(xs[1]) | is_float_text(xs[2]) | is_float_text(xs[3])
        return F.when(floating, py_float(f[0] * f[1] + f[2] * f[3])).otherwise((i[0] * i[1] + i[2] * i[3]).cast("string"))
    return matrix(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))


def literal_repr(m) -> Column:
    """Python ``str()`` of a ``literal_matrix``."""
    rows = F.transform(col(m), lambda row: F.concat(F.lit("["), F.array_join(row, ", "), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]"))


def py_repr(m) -> Column:
    """Python ``str()`` of a nested int list: ``[[1, 2], [3, 4]]``."""
    return F.regexp_replace(F.to_json(col(m)), ",", ", ")


def compact_repr(m) -> Column:
    """``str(m).replace(' ', '')`` as used in query text."""
    return F.to_json(col(m))


def constant_matrix(v: int) -> Column:
    x = F.lit(v).cast("bigint")
    return F.array(F.array(x, x), F.array(x, x))

# Four numbers inside [[a, b], [c, d]] with optional blanks and decimals.
MATRIX_TEXT_RE = ("\\[\\[\\s*(-?\\d+(?:\\.\\d+)?)\\s*,\\s*(-?\\d+(?:\\.\\d+)?)\\s*\\]\\s*,"
                  "\\s*\\[\\s*(-?\\d+(?:\\.\\d+)?)\\s*,\\s*(-?\\d+(?:\\.\\d+)?)\\s*\\]\\]")


def matrices_from_text(text) -> Column:
    """First two 2x2 matrices written in free text, as doubles (R10, T-3);
    NULL when fewer than two are found."""
    found = F.regexp_extract_all(col(text), F.lit(MATRIX_TEXT_RE), 0)

    def to_m(s):
        nums = F.regexp_extract_all(s, F.lit("-?\\d+(?:\\.\\d+)?"), 0)
        d = [F.get(nums, i).cast("double") for i in range(4)]
        return matrix(*d)

    return F.when(F.size(found) >= 2,
                  F.struct(to_m(F.get(found, 0)).alias("A"), to_m(F.get(found, 1)).alias("B")))
