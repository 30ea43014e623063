"""Prefix scans and as-of joins over a total order, without one task that sees all rows.

``prefix_scan`` is a two-level scan.  Rows are dealt into key ranges (by sampling, so a
hot group is cut into several) and cut from their lineage; each range folds its rows to one summary per group; an
exclusive scan over the summaries, one row per (group, range), gives what precedes a range.  That carried
value joins the range as a row ahead of its first, and a window inside each range folds on.  No array of a
group's rows is built and no group is one window.

``asof_join`` gives every row of one table the latest row of another that precedes it, as a scan over
the union of both: the last match so far, per group.  Neither a hot group nor many rows at one place share a task.
Of two Arrow tables - rows that a worker holds, whose groups no other has - it gives an Arrow table.

Order: rows whose order columns are all equal are peers and share a range (add a unique column where
many may tie).  An inclusive scan counts all peers of a row, an exclusive one none.  NULLs in the order come
first, NULL is a group like others, NULL values are skipped."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrant.session import materialize

KINDS = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum,
         "first": lambda v: F.first(v, ignorenulls=True),  # of values that are not NULL
         "last": lambda v: F.last(v, ignorenulls=True)}


def ranged(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` dealt into ranges of (by, order), with the range's number as ``_range``; peers share a range.
    Cut by a checkpoint, so the ranges stay what they are when a task runs again."""
    return materialize(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))


def prefix_scan(df: DataFrame, kind: str, value: str | Column, order: Sequence[str], out: str,
                by: Sequence[str] = (), inclusive: bool = True, dealt: bool = False) -> DataFrame:
    """``df`` with ``out``: the ``kind`` (see ``KINDS``) of ``value`` over the rows of the same ``by`` up to
    each row (``inclusive``: its peers too) in the order of the columns ``order``.

    ``dealt`` says that ``df`` comes from ``ranged`` with the same columns (several scans can share it, and
    ``_range`` stays); otherwise it is dealt here.  Over no value a count is 0, everything else NULL."""
    value = F.col(value) if isinstance(value, str) else value
    if kind == "count":
        value = F.when(value.isNotNull(), F.lit(1).cast("long"))
    fold = KINDS[kind]
    rows = (df if dealt else ranged(df, order, by)).withColumns({"_value": value, "_after": F.lit(1)})
    keys = list(by)

    # level 1: a summary per group and range, and what the ranges before hold
    if kind in ("first", "last"):
        place = F.when(F.col("_value").isNotNull(), F.struct(*order))
        summary = (F.min_by if kind == "first" else F.max_by)("_value", place)
    else:
        summary = fold("_value")
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (rows.groupBy(*keys, "_range").agg(summary.alias("_summary"))
               .select(*keys, "_range", fold("_summary").over(before).alias("_value"), F.lit(0).alias("_after"))
               .where("_value IS NOT NULL"))

    # level 2: inside the ranges, the carried value first
    both = rows.unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_range").orderBy("_after", *order)
    if inclusive:
        found = both.withColumn(out, fold("_value").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        # up to the row before; of a row with peers, what the first of them has
        found = both.withColumns({"_value": fold("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1)),
                                  "_nth": F.row_number().over(inside)})
        peers = Window.partitionBy(*keys, "_range", "_after", *order)
        found = found.withColumn(out, F.min_by("_value", "_nth").over(peers)).drop("_nth")
    if kind == "count":
        found = found.withColumn(out, F.coalesce(out, F.lit(0).cast("long")))
    return found.where("_after = 1").drop("_value", "_after", *([] if dealt else ["_range"]))


def asof_join(left: DataFrame | pa.Table, right: DataFrame | pa.Table, by: Sequence[str], left_on: str, right_on: str,
              carry: Sequence[str], strict: bool = True, prefix: str = "") -> DataFrame | pa.Table:
    """Every row of ``left`` with the columns ``carry`` of the row of ``right`` that has the same ``by`` and the
    greatest ``right_on`` below ``left_on`` (``strict``) or not above it; NULL where there is none.

    Of several rows of ``right`` at that place the one with the greatest ``carry`` counts.  A NULL
    ``left_on`` has no match, a NULL ``right_on`` is none; NULL in ``by`` equals NULL.  Matched columns are named
    ``prefix + name``.  Of Arrow tables, whose places are integers, the rows stay in the order of ``left``."""
    if isinstance(left, pa.Table):
        return _asof_arrow(left, right, by, left_on, right_on, carry, strict, prefix)
    matches = (right.where(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_at"))
               .agg(F.max(F.struct(*carry)).alias("_match")))
    match_type, row_type = matches.schema["_match"].dataType, _struct_of(left)
    # at the same place, matches come after the rows if strict, else before; rows there may fall into several ranges
    both = (left.select(*by, F.col(left_on).alias("_at"), F.lit(0).alias("_side"),
                        F.monotonically_increasing_id().alias("_nth_row"),
                        F.struct(*left.columns).alias("_row"), F.lit(None).cast(match_type).alias("_match"))
            .unionByName(matches.select(*by, "_at", F.lit(1 if strict else -1).alias("_side"), F.lit(0).cast("long").alias("_nth_row"),
                                        F.lit(None).cast(row_type).alias("_row"), "_match")))
    found = prefix_scan(both, "last", "_match", ["_at", "_side", "_nth_row"], "_found", by).where("_side = 0")
    found = found.withColumn("_found", F.when(F.col("_at").isNotNull(), F.col("_found")))
    return found.select("_row.*", *[F.col("_found")[c].alias(prefix + c) for c in carry])


def _struct_of(df: DataFrame):
    """The type of a struct of all columns."""
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def _asof_arrow(left: pa.Table, right: pa.Table, by: Sequence[str], left_on: str, right_on: str, carry: Sequence[str],
                strict: bool, prefix: str) -> pa.Table:
    """``asof_join`` of Arrow tables: ``right`` is sorted by group and place, and every row of ``left`` looked up in it."""
    right, n = right.filter(pc.is_valid(right[right_on])), len(left)

    def both(x: str, y: str) -> pa.Array:
        return pa.chunked_array([*left[x].chunks, *right[y].cast(left[x].type).chunks], left[x].type).combine_chunks()

    def numbers(column: pa.Array) -> tuple[np.ndarray, int]:
        coded = column.dictionary_encode(null_encoding="encode")
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    group, groups = np.zeros(n + len(right), np.int64), 1
    for name in by:
        number, size = numbers(both(name, name))
        group, groups = numbers(pa.array(group * size + number))
    place = both(left_on, right_on)
    known = place.is_valid().to_numpy(zero_copy_only=False)[:n]
    place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(place) and (int(place.max()) - int(place.min()) + 1) * groups >= 1 << 62:
        place = np.unique(place, return_inverse=True)[1]
    low, high = place.min(initial=0), place.max(initial=0)
    key = group * (high - low + 1) + place - low
    if set(carry) <= {*by, right_on}:
        order = np.argsort(key[n:], kind="stable")
    else:  # of several at one place, the greatest last
        ranked = pa.table({"key": key[n:], **{f"carry {c}": right[c] for c in carry}})
        order = pc.sort_indices(ranked, sort_keys=[(c, "ascending") for c in ranked.column_names], null_placement="at_start").to_numpy().astype(np.int64)
    at = np.searchsorted(key[n:][order], key[:n], side="left" if strict else "right") - 1
    order, held = np.append(order, 0), np.append(group[n:][order], -1)
    there = (at >= 0) & (held[at] == group[:n]) & known
    found = right.select(list(carry)).take(pa.array(order[at], mask=~there))
    for c in carry:
        left = left.append_column(prefix + c, found[c])
    return left
