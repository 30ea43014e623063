"""Straight-line matrix scripts, compiled and executed in Arrow batches.

A script is newline-separated ``target = expression`` lines.  Four dialects
of the accepted grammar exist (``E1``..``E4``, see README); each dialect only
differs in how a line is *parsed*.  Every accepted right-hand side is a signed
sum of terms, each term a product of at most two factors, each factor a signed
sum of atoms (a name or a number literal).

``compile_script`` resolves names into slots: every statement writes a new one,
and every name read points at the slot of its latest assignment before that line
(inputs A/B are slots 1..8 and may be overwritten).  All failures - a line
without ``=``, an unparseable expression, an undefined name, a missing C cell -
depend on the script only, so they are decided here, not per matrix pair.

``execute`` then runs the code over one matrix pair.  Integers are exact: a
value is carried as BIGINT (NULL after overflow) and, where an output cell
overflowed, run again modulo two 31-bit primes, so equality with the expected
product stays decidable after overflow (the residues of a product or sum are
exact).  A double lane is used when the matrices are floating point or the
script has a decimal literal.

What happens to one script is in ``steps``; the columns here hand it the rows of a batch.
Spark neither copies these columns into filters nor computes them again (they are marked as not deterministic).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrant.functions.text import WS, WS_CHARS, col
from quadrant.operators import batches, steps
from quadrant.session import materialize

# ---- fixed values: the accepted grammar ------------------------------------
NAME = f"[A-Za-z_][A-Za-z0-9_]*(?:\\[[0-9,{WS_CHARS}]*\\])?"
NUM = "\\-?\\d+(?:\\.\\d+)?"
ASSIGN_RE = f"^{WS}*({NAME}|{NUM}){WS}*$"
PAREN_MUL_RE = f"^{WS}*\\(([^)]+)\\){WS}*\\*{WS}*\\(([^)]+)\\){WS}*$"
NAME_PAREN_RE = f"^{WS}*({NAME}){WS}*\\*{WS}*\\(([^)]+)\\){WS}*$"
PAREN_NAME_RE = f"^{WS}*\\(([^)]+)\\){WS}*\\*{WS}*({NAME}){WS}*$"
BINARY_RE = f"^{WS}*({NAME}|{NUM}){WS}*([*+-]){WS}*({NAME}|{NUM}){WS}*$"
SIMPLE_ATOM_RE = f"^{NAME}$|^{NUM}$"
# Short-form dialects: operands are word characters, brackets, commas,
# dots, digits and hyphens.
SHORT_OPERAND = "[\\p{L}\\p{N}_\\[\\],.\\-]+"
SHORT_BINARY_RE = f"^({SHORT_OPERAND}){WS}*([*+\\-]){WS}*({SHORT_OPERAND})$"
INPUT_NAMES = ["A[0,0]", "A[0,1]", "A[1,0]", "A[1,1]", "B[0,0]", "B[0,1]", "B[1,0]", "B[1,1]"]
OUTPUT_NAMES = ["C[0,0]", "C[0,1]", "C[1,0]", "C[1,1]"]
# ---------------------------------------------------------------------------

# Number literals we evaluate: Python integer literals (no leading zeros) and
# plain decimals.  Other Python literals (1e3, 0x10, True) are not numbers here.
INT_LIT_RE = "^-?(0+|[1-9][0-9]*)$"
FLOAT_LIT_RE = "^-?[0-9]+\\.[0-9]+$"
P1 = 2147483647
P2 = 2147483629
DIALECTS = ("E1", "E2", "E3", "E4")


@lru_cache(maxsize=1)
def grammar() -> steps.Grammar:
    """The compiled patterns, and what is remembered of lines and scripts, of a Python worker."""
    from quadrant.operators import dsl
    return steps.Grammar(dsl)


def _column(fn: Callable[..., pa.Array], kind: T.DataType, *args: Column) -> Column:
    return F.arrow_udf(fn, kind).asNondeterministic()(*args)


def _struct(kind: pa.StructType, rows: list[tuple | None]) -> pa.Array:
    """Rows (None: NULL) as a struct array, built field by field."""
    blank = (None,) * kind.num_fields
    columns = zip(*[blank if r is None else r for r in rows]) if rows else [()] * kind.num_fields
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind),
                                      mask=pa.array([r is None for r in rows], pa.bool_()))


def _lists(array: pa.Array) -> list[list]:
    """The lists of an array; of NULL, an empty one."""
    values = array.values.to_numpy().tolist() if array.values.null_count == 0 and pa.types.is_primitive(array.values.type) else array.values.to_pylist()
    ends = array.offsets.to_pylist()
    return [values[i:j] for i, j in zip(ends, ends[1:])]


# ---- compile: parse and SSA resolution (D1-D4, J5-J7, D7) ------------------------

PROGRAM_T = T.StructType([
    T.StructField("ok", T.BooleanType()), T.StructField("err", T.StringType()), T.StructField("eline", T.IntegerType()),
    T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("literals", T.ArrayType(T.StringType())),
    T.StructField("out", T.ArrayType(T.IntegerType())), T.StructField("has_float", T.BooleanType()),
    T.StructField("n_stmts", T.IntegerType())])
_PROGRAM = pa.struct([("ok", pa.bool_()), ("err", pa.string()), ("eline", pa.int32()), ("code", pa.list_(pa.int32())),
                      ("literals", pa.list_(pa.string())), ("out", pa.list_(pa.int32())), ("has_float", pa.bool_()), ("n_stmts", pa.int32())])


def compile_script(script, dialect: str = "E1", drop_comments: bool = False) -> Column:
    """Script text -> program struct:

    ``ok``, ``err``/``eline`` (first failure and its line), ``code`` and ``literals`` (SSA
    statements, see ``steps``), ``out`` (slots of the four C cells), ``has_float`` (a literal is no BIGINT)."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")

    def run(scripts: pa.Array) -> pa.Array:
        g = grammar()

        def program(s):
            err, *rest = g.program(s, dialect, drop_comments)
            return err is None, err, *rest
        return _struct(_PROGRAM, [None if s is None else program(s) for s in scripts.to_pylist()])
    return _column(run, PROGRAM_T, col(script))


def digits_mod(text: Column, p: int) -> Column:
    """Residue of a (possibly long) signed integer literal modulo p, nine digits at a time."""
    digits = F.regexp_replace(text, "^-", "")
    long = F.aggregate(F.regexp_extract_all(digits, F.lit("[0-9]{1,9}"), 0), F.lit(0).cast("bigint"),
                       lambda acc, d: F.pmod(acc * F.rpad(F.lit("1"), F.length(d) + 1, F.lit("0")).cast("bigint") + d.cast("bigint"), F.lit(p)))
    m = F.when(F.length(digits) <= 18, F.pmod(digits.cast("bigint"), F.lit(p))).otherwise(long)
    return F.when(text.startswith("-"), F.pmod(-m, F.lit(p))).otherwise(m)


# ---- execute: the code over one matrix pair ---------------------------------------

def cells_of(a, b, kind: str) -> Column:
    """The eight cells of a matrix pair, as ``kind``."""
    return F.array(*[F.get(F.get(col(m), r), c).cast(kind) for m in (a, b) for r in (0, 1) for c in (0, 1)])


LANES_T = T.StructType([T.StructField(k, T.ArrayType(t)) for k, t in (
    ("v", T.LongType()), ("d", T.DoubleType()), ("m1", T.LongType()), ("m2", T.LongType()))])
_LANES = pa.struct([("v", pa.list_(pa.int64())), ("d", pa.list_(pa.float64())), ("m1", pa.list_(pa.int64())), ("m2", pa.list_(pa.int64()))])


def lanes(prog: Column, longs: Column, doubles: Column, as_long: Column, as_double: Column) -> Column:
    """The output cells of a run: ``v`` where ``as_long`` holds (with residues ``m1`` and ``m2`` if one overflowed), ``d`` where ``as_double`` does."""
    def run(code: pa.Array, literals: pa.Array, out: pa.Array, longs: pa.Array, doubles: pa.Array, as_long: pa.Array, as_double: pa.Array) -> pa.Array:
        found = []
        for c, lit, o, x, y, in_long, in_double in zip(_lists(code), _lists(literals), _lists(out), _lists(longs), _lists(doubles),
                                                       as_long.to_pylist(), as_double.to_pylist()):
            if in_double or in_long:
                found.append(steps.output_cells(c, lit, o, x, y, in_double, P1, P2))
            else:
                found.append((None, None, None, None))
        return _struct(_LANES, found)
    return _column(run, LANES_T, prog["code"], prog["literals"], prog["out"], longs, doubles, as_long, as_double)


def execute(df: DataFrame, prog: str = "prog", a: str = "A", b: str = "B", expected: str | None = None,
            out: str = "exec", double_inputs: bool = False, doubles: tuple[str, str, str] | None = None,
            floating: Column | None = None) -> DataFrame:
    """Run compiled programs on each row's matrices.

    ``doubles`` names double versions of a, b and expected, used for rows where
    ``floating`` holds (matrices that are no integers) or the script has a decimal literal.

    Adds struct ``out``: ``ok, err, eline, result, correct, lane``.
    ``result`` is ``array<array<bigint>>`` (NULL cells where BIGINT overflowed on the way
    to anything but the expected value; see ``exact`` for their decimal text)
    or ``array<array<double>>`` for double inputs; rows whose script has a
    decimal literal put the double result in ``result_double``.  ``correct``
    stays exact through overflow: an overflowed cell is compared by its
    residues modulo two primes."""
    p = F.col(prog)
    da, db, de = doubles or (a, b, expected)
    use_double = F.lit(True) if double_inputs else p["has_float"]
    if floating is not None:
        use_double = use_double | floating
    run = p["ok"]
    no_cells = F.array().cast("array<bigint>")
    found = lanes(p, no_cells if double_inputs else cells_of(a, b, "bigint"), cells_of(da, db, "double"), run & ~use_double, run & use_double)
    df = df.withColumn(f"__{out}_lanes", found)
    return _with_outcome(df, p, F.col(f"__{out}_lanes"), use_double, expected, de, out, double_inputs).drop(f"__{out}_lanes")


def _with_outcome(df: DataFrame, p: Column, found: Column, use_double: Column, expected: str | None, doubles: str | None, out: str,
                  double_inputs: bool, *more: Column) -> DataFrame:
    """The struct ``out`` of ``execute`` from a program's ``ok``, ``err``, ``eline`` and its ``lanes``."""
    run, shown = p["ok"], f"__{out}_shown"
    cv, cd, m1, m2 = (found[k] for k in ("v", "d", "m1", "m2"))

    def as_matrix(c):
        return F.array(F.slice(c, 1, 2), F.slice(c, 3, 2))

    def every(test):
        return test(0) & test(1) & test(2) & test(3)

    fields = [run.alias("ok"), p["err"].alias("err"), p["eline"].alias("eline")]
    if double_inputs:
        fields.append(F.when(run, as_matrix(cd)).alias("result"))
    else:
        fields.append(F.when(run & ~use_double, as_matrix(cv if expected is None else F.col(shown))).alias("result"))
        fields.append(F.when(run & use_double, as_matrix(cd)).alias("result_double"))
    if expected is not None:
        e, ed = F.flatten(F.col(expected)), F.flatten(F.col(doubles))
        eq_d = every(lambda k: F.get(cd, k) == F.get(ed, k).cast("double")) & (F.size(ed) <= 4)
        if double_inputs:
            correct = eq_d
        else:
            def same(k):
                x = F.get(e, k).cast("bigint")
                return F.when(F.get(cv, k).isNotNull(), F.get(cv, k) == x).otherwise(
                    (F.get(m1, k) == F.pmod(x, F.lit(P1))) & (F.get(m2, k) == F.pmod(x, F.lit(P2))))
            correct = F.when(use_double, eq_d).otherwise(every(same))
            # a cell that overflowed on the way to the right value has that value
            df = df.withColumn(shown, F.when(m1.isNotNull() & correct, e.cast("array<bigint>")).otherwise(cv))
        fields.append(F.when(run, F.coalesce(correct, F.lit(False))).alias("correct"))
    fields.append(F.when(use_double, F.lit("double")).otherwise(F.lit("int")).alias("lane"))
    return df.withColumn(out, F.when(p.isNotNull(), F.struct(*fields, *more))).drop(shown)


RUN_T = T.StructType([*PROGRAM_T.fields[:3], T.StructField("has_float", T.BooleanType()), T.StructField("n_mults", T.IntegerType()), *LANES_T.fields])
_RUN = pa.struct([*[_PROGRAM.field(k) for k in range(3)], pa.field("has_float", pa.bool_()), pa.field("n_mults", pa.int32()), *_LANES])


def run_batch(scripts: pa.Array, longs: pa.Array, doubles: pa.Array, floating: pa.Array, dialect: str, counter: str | None = None) -> pa.Array:
    """The runs of a batch: in E2 side by side by ``batches``, others and what that leaves one by one (in E1, whose lines
    are mostly remembered, that takes no longer)."""
    g = grammar()
    count = getattr(g, f"count_{counter}") if counter else None

    def found(s, x, y, in_double):
        err, eline, has_float, *cells = g.run(s, dialect, x, y, in_double, P1, P2)
        return err is None, err, eline, has_float, count(s) if count else None, *cells

    def one_by_one(*rows):
        scripts, longs, doubles, floating = rows
        return _struct(_RUN, [None if s is None else found(s, x, y, f) for s, x, y, f in zip(
            scripts.to_pylist(), _lists(longs), _lists(doubles), floating.to_pylist())])
    if dialect != "E2":
        return one_by_one(scripts, longs, doubles, floating)
    done, (err, eline, n_mults, *lanes) = batches.run(g, scripts, longs, doubles, floating, dialect, counter == "pattern", P1, P2)
    if counter != "pattern":
        n_mults = pa.array([count(s) if count else None for s in scripts.take(pa.array(done)).to_pylist()], pa.int32())
    together = pa.StructArray.from_arrays([err.is_null(), err, eline, pa.array(np.zeros(len(done), bool)), n_mults, *lanes], fields=list(_RUN))
    left = np.setdiff1d(np.arange(len(scripts)), done)
    rest = one_by_one(*[x.take(pa.array(left)) for x in (scripts, longs, doubles, floating)])
    return pa.concat_arrays([together, rest]).take(pa.array(np.argsort(np.concatenate([done, left]))))


def run_scripts(df: DataFrame, script: str = "script", dialect: str = "E1", a: str = "A", b: str = "B", expected: str | None = None,
                out: str = "exec", double_inputs: bool = False, doubles: tuple[str, str, str] | None = None,
                floating: Column | None = None, counter: str | None = None) -> DataFrame:
    """``compile_script`` and ``execute`` in one Arrow column: no program leaves the worker.  Adds the struct ``out`` of ``execute``
    (NULL of no script); with ``counter``, its field ``n_mults`` holds the script's multiplications."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    da, db, de = doubles or (a, b, expected)

    def run(scripts: pa.Array, longs: pa.Array, doubles: pa.Array, floating: pa.Array) -> pa.Array:
        return run_batch(scripts, longs, doubles, floating, dialect, counter)

    no_cells = F.array().cast("array<bigint>")
    in_double = F.lit(True) if double_inputs else F.lit(False) if floating is None else floating
    tmp = f"__{out}_run"
    df = df.withColumn(tmp, _column(run, RUN_T, col(script), no_cells if double_inputs else cells_of(a, b, "bigint"),
                                    cells_of(da, db, "double"), in_double))
    r = F.col(tmp)
    more = [r["n_mults"].alias("n_mults")] if counter else []
    return _with_outcome(df, r, r, r["has_float"] | in_double, expected, de, out, double_inputs, *more).drop(tmp)


CASES_T = "struct<ok:boolean,n_mults:int,correct:array<boolean>>"
_CASES = pa.struct([("ok", pa.bool_()), ("n_mults", pa.int32()), ("correct", pa.list_(pa.bool_()))])


def equals(found: tuple, expected: list) -> bool:
    """Whether the cells that ``Grammar.run`` found are those expected, as ``execute`` compares them."""
    err, _, _, v, d, m1, m2 = found
    if err is not None or None in expected:
        return False
    if d is not None:
        return all([x == float(e) for x, e in zip(d, expected)])
    return all([x == e if x is not None else (m1[k], m2[k]) == (e % P1, e % P2) for k, (x, e) in enumerate(zip(v, expected))])


def cases_batch(scripts: pa.Array, cases: list[tuple[list, list, list]], dialect: str, counter: str) -> pa.Array:
    """The scripts of a batch over every case: side by side by ``batches``, what that leaves one by one."""
    g = grammar()
    count = getattr(g, f"count_{counter}")

    def one(s):
        found = [(g.run(s, dialect, longs, doubles, False, P1, P2), expected) for longs, doubles, expected in cases]
        return all([run[0] is None for run, _ in found]), count(s), [equals(run, expected) for run, expected in found]
    done, ok, n_mults, correct = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32), np.zeros((0, len(cases)), bool)
    if cases and all([None not in [*longs, *expected] and min(longs) >= -steps.MAX_LONG for longs, _, expected in cases]):
        done, ok, n_mults, correct = batches.run_cases(g, scripts, [(longs, expected) for longs, _, expected in cases], dialect,
                                                       counter == "pattern", P1, P2)
        if counter != "pattern":
            n_mults = [count(s) for s in scripts.take(pa.array(done)).to_pylist()]
    each = np.arange(len(done) + 1, dtype=np.int32) * len(cases)
    together = pa.StructArray.from_arrays([pa.array(ok), pa.array(n_mults, pa.int32()), pa.ListArray.from_arrays(pa.array(each), pa.array(correct.ravel()))],
                                          fields=list(_CASES))
    left = np.setdiff1d(np.arange(len(scripts)), done)
    rest = _struct(_CASES, [one(s) for s in scripts.take(pa.array(left)).to_pylist()])
    return pa.concat_arrays([together, rest]).take(pa.array(np.argsort(np.concatenate([done, left]))))


def run_cases(df: DataFrame, cases: list[tuple[list, list, list]], script: str = "script", dialect: str = "E1",
              out: str = "exec", counter: str = "pattern") -> DataFrame:
    """``compile_script`` and ``execute`` of every script on each of a few cases - the cells of A and B as integers and as doubles, and of the
    expected product - in one Arrow column, each distinct script of a batch once.  Adds the struct ``out`` (NULL of no
    script): ``ok``, ``n_mults``, and ``correct`` of every case."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")

    def run(scripts: pa.Array) -> pa.Array:
        coded = scripts.dictionary_encode()
        return cases_batch(coded.dictionary, cases, dialect, counter).take(coded.indices)
    return df.withColumn(out, _column(run, CASES_T, col(script)))


# ---- multiplication counters (A1-A3) ------------------------------------------

# fixed values: the four product shapes of the pattern counter, in order
COUNT_PATTERNS = [
    f"\\([^)]+\\){WS}*\\*{WS}*\\([^)]+\\)",
    f"{NAME}{WS}*\\*{WS}*\\([^)]+\\)",
    f"\\([^)]+\\){WS}*\\*{WS}*{NAME}",
    f"{NAME}{WS}*\\*{WS}*{NAME}",
]
PRODUCT_LINE_RE = f"={WS}*[\\p{{L}}\\p{{N}}_\\[\\],{WS_CHARS}.\\-]+{WS}*\\*{WS}*[\\p{{L}}\\p{{N}}_\\[\\],{WS_CHARS}.\\-]+"


def count_stars(script) -> Column:
    """A1: every ``*`` in the text."""
    return F.regexp_count(col(script), F.lit("\\*")).cast("int")


def _per_text(fn: Callable[[str], int], text) -> Column:
    """An integer of every text, NULL of NULL."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.int32())
    return _column(run, T.IntegerType(), col(text))


def count_by_pattern(script) -> Column:
    """A2: per line with ``=``, the larger of pattern hits and stars left
    outside brackets and matches; summed over lines."""
    return _per_text(lambda s: grammar().count_pattern(s), script)


def count_product_lines(script) -> Column:
    """A3: lines with ``= operand * operand``."""
    return _per_text(lambda s: grammar().count_product_lines(s), script)


COUNTERS = {"stars": count_stars, "pattern": count_by_pattern, "product_lines": count_product_lines}


# ---- DataFrame-level helpers ---------------------------------------------------

def per_script(df: DataFrame, script: str, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with ``columns`` (name -> function of the script column), row by row: nothing is shuffled, and what equal
    scripts and lines share is what a Python worker remembers of the last ones (D1)."""
    others = [c for c in df.columns if c != script]
    return df.select(*others, script, *[fn(F.col(script)).alias(name) for name, fn in columns.items()])


def compile_shared(df: DataFrame, script: str = "script", dialect: str = "E1", drop_comments: bool = False,
                   per_script_columns: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Attach ``prog`` (compiled script), plus ``per_script_columns`` (e.g. a multiplication counter), as ``per_script``."""
    return per_script(df, script, {"prog": lambda s: compile_script(s, dialect, drop_comments), **(per_script_columns or {})})


def script_hash(script) -> Column:
    """128 bits that stand for a script."""
    return F.md5(col(script).cast("binary"))


def script_dictionary(df: DataFrame, script: str = "script", dialect: str = "E1", drop_comments: bool = False,
                      columns: dict[str, Callable[[Column], Column]] | None = None, path: str | None = None) -> DataFrame:
    """D1 for a whole table: every different script once, compiled once - script_hash, script, n_rows, ``prog``, ``columns``.

    Rows are reduced to different scripts before the shuffle, and these are dealt out evenly before they are
    compiled (that costs far more than their bytes suggest).  The dictionary is kept: as Parquet at ``path``, for
    other jobs over the same scripts, or as a checkpoint.  NULL is no script."""
    # kept, so that a script derived in the plan is computed once, not again by every use below
    counted = materialize(df.groupBy(F.col(script).alias("script")).agg(F.count(F.lit(1)).alias("n_rows")))
    counted = (counted.where("script IS NOT NULL").select(script_hash("script").alias("script_hash"), "script", "n_rows")
               .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "script_hash"))
    made = counted.select("*", compile_script(F.col("script"), dialect, drop_comments).alias("prog"),
                          *[fn(F.col("script")).alias(name) for name, fn in (columns or {}).items()])
    if path is None:
        return materialize(made)
    made.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_dictionary(df: DataFrame, dictionary: DataFrame, script: str = "script") -> DataFrame:
    """``df`` with the dictionary's columns, joined on the hash; a script that many rows carry
    is a skewed join partition, which adaptive execution splits."""
    found = dictionary.drop("script", "n_rows").withColumnRenamed("script_hash", "__hash")
    return df.join(found, script_hash(script) == F.col("__hash"), "left").drop("__hash")


# ---- lint in the row (J5-J7) -----------------------------------------------------

LINT_T = "n_uses int, n_undefined int, first_undefined_line int, n_missing_cells int"
_LINT = pa.struct([(x.split()[0], pa.int32()) for x in LINT_T.split(", ")])


def lint_script(script, dialect: str = "E1") -> Column:
    """Reads and definitions of a script in one pass over its statements:
    struct(n_uses, n_undefined, first_undefined_line, n_missing_cells).

    A use is a distinct name read on a line that parses; it is undefined when no
    earlier line (nor an input) defines it (J5, J6); an output cell is missing
    when no line defines it (J7)."""
    def run(scripts: pa.Array) -> pa.Array:
        return _struct(_LINT, [None if s is None else grammar().lint(s, dialect) for s in scripts.to_pylist()])
    return _column(run, LINT_T, col(script))
