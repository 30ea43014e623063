"""Reads and definitions of scripts as tables, matched by an as-of join.

``dsl.lint_script`` folds one script in its row, with a list of names that grows; here a script of any length is
exploded into statements, every name read becomes a row, and its definition - the latest line before it
that assigns the name, inputs at line 0 - is found by ``scan.asof_join``, whose work is linear (up to
sorting) in the statements.  A script is one row, so no task needs another's statements: the tables are Arrow tables of
the scripts of a batch, some ``PART`` bytes of them at a time, and nothing is shuffled or written.  Each distinct script of a batch, and
each distinct line of a part, is parsed once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.operators import dsl
from quadrant.operators.scan import asof_join

PART = 1 << 22  # bytes of scripts whose tables a worker holds; a longer script is a part of its own
LINT_T = ("n_uses bigint, n_undefined bigint, first_undefined_line int, n_missing_cells bigint, "
          "sum_distance bigint, max_distance int")
_LINT = pa.struct([(x.split()[0], {"bigint": pa.int64(), "int": pa.int32()}[x.split()[1]]) for x in LINT_T.split(", ")])


def distinct_scripts(scripts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Every different script once, and its number for every row (NULL is none)."""
    coded = scripts.dictionary_encode()
    return coded.dictionary, coded.indices


def parts(scripts: pa.Array) -> Iterator[pa.Array]:
    """The scripts in turn, up to ``PART`` bytes together."""
    part = np.cumsum(pc.binary_length(scripts).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(scripts)]
    return (scripts.slice(i, j - i) for i, j in zip(cuts, cuts[1:]))


def statements(scripts: pa.Array, names: dict[str, int], dialect: str = "E1") -> pa.Table:
    """script, line, target, names: the statements that parse, with the distinct names they read.  Scripts are known by their
    place, names by their numbers in ``names``, which gets the new ones."""
    g = dsl.grammar()
    split = pc.split_pattern(scripts, "\n")
    coded = split.flatten().dictionary_encode()
    code, size = coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    there, targets, reads = [], [], []
    for line in map(str.strip, coded.dictionary.to_pylist()):
        target, read = line and g.reads(line, dialect) or (None, ())
        there.append(line != "")
        targets.append(-1 if target is None else names.setdefault(target, len(names)))
        reads.append([names.setdefault(x, len(names)) for x in read])
    target = np.array(targets, np.int32)[code]
    counted = np.cumsum(np.concatenate([[0], np.array(there, bool)[code]]))
    script = np.repeat(np.arange(len(scripts)), size)
    line = counted[1:] - counted[np.cumsum(size) - size][script]
    kept = np.flatnonzero(target >= 0)
    return pa.table({"script": script[kept], "line": line[kept].astype(np.int32), "target": target[kept],
                     "names": pa.array(reads, pa.list_(pa.int32())).take(pa.array(code[kept]))})


def definitions(stmts: pa.Table, n_scripts: int, names: dict[str, int]) -> pa.Table:
    """script, name, def_line: every assignment, and the inputs at line 0."""
    inputs = [names.setdefault(n, len(names)) for n in dsl.INPUT_NAMES]
    given = pa.table({"script": np.repeat(np.arange(n_scripts), len(inputs)), "name": pa.array(np.tile(inputs, n_scripts), pa.int32()),
                      "def_line": np.zeros(n_scripts * len(inputs), np.int32)})
    return pa.concat_tables([given, stmts.select(["script", "target", "line"]).rename_columns(["script", "name", "def_line"])])


def resolved_uses(stmts: pa.Table, defs: pa.Table) -> pa.Table:
    """script, name, use_line, def_line: what each read sees (J5); NULL where nothing defines it."""
    reads = stmts["names"].combine_chunks()
    of = pc.list_parent_indices(reads)
    uses = pa.table({"script": stmts["script"].take(of), "name": pc.list_flatten(reads), "use_line": stmts["line"].take(of)})
    return asof_join(uses, defs, ["script", "name"], "use_line", "def_line", ["def_line"])


def lint_part(scripts: pa.Array, dialect: str) -> pa.StructArray:
    """The columns of ``lint``, a row a script."""
    n, names = len(scripts), {}
    stmts = statements(scripts, names, dialect)
    defs = definitions(stmts, n, names)
    seen = resolved_uses(stmts, defs)
    undefined = pc.is_null(seen["def_line"])
    seen = pa.table({"script": seen["script"], "undefined": pc.cast(undefined, pa.int64()),
                     "line": pc.if_else(undefined, seen["use_line"], pa.scalar(None, pa.int32())),
                     "distance": pc.subtract(seen["use_line"], seen["def_line"])})

    def per_script(grouped: pa.Table) -> pa.Table:
        """``grouped``, a row for every script; NULL of those without rows."""
        row = np.full(n, -1)
        row[grouped["script"].to_numpy()] = np.arange(len(grouped))
        return grouped.take(pa.array(row, mask=row < 0))
    uses = per_script(seen.group_by("script", use_threads=False).aggregate([
        ("undefined", "count"), ("undefined", "sum"), ("line", "min"), ("distance", "sum"), ("distance", "max")]))
    outputs = pa.array([names.setdefault(x, len(names)) for x in dsl.OUTPUT_NAMES], pa.int32())
    cells = per_script(defs.filter(pc.is_in(defs["name"], value_set=outputs)).group_by("script", use_threads=False)
                       .aggregate([("name", "count_distinct")]))

    def counted(column: pa.ChunkedArray) -> pa.ChunkedArray:
        return column.fill_null(0)
    found = [counted(uses["undefined_count"]), counted(uses["undefined_sum"]), uses["line_min"],
             pc.subtract(len(dsl.OUTPUT_NAMES), counted(cells["name_count_distinct"])), counted(uses["distance_sum"]), uses["distance_max"]]
    return pa.StructArray.from_arrays([c.combine_chunks().cast(f.type) for c, f in zip(found, _LINT)], fields=list(_LINT))


def lint(df: DataFrame, keys: list[str], script: str = "script", dialect: str = "E1") -> DataFrame:
    """``keys`` and, per row: n_uses, n_undefined, first_undefined_line, n_missing_cells (as
    ``dsl.lint_script``), and sum_distance, max_distance: lines between reads and what they see.  All NULL for a NULL script."""
    def run(scripts: pa.Array) -> pa.Array:
        distinct, number = distinct_scripts(scripts)
        found = [lint_part(part, dialect) for part in parts(distinct)]
        return pa.concat_arrays([*found, pa.array([], _LINT)]).take(number)
    return df.select(*keys, dsl._column(run, LINT_T, F.col(script)).alias("__found")).select(*keys, "__found.*")
