"""Users' own reward functions, Arrow batches at a time (Q1, Q2).

A reward is ``fn(completions, **columns) -> list of floats``, one a completion, as trainers call it.  Any number of
them run in one pass over the rows, in the tasks.  If a function raises on a batch, or returns another number of
values than it was given, the batch's rows are given to it one by one, so its failure is that of the rows that
cause it: their reward is ``on_error`` (NULL) and the message is kept.  So the result does not depend on where batches end,
as long as a function treats its rows independently."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

UserReward = Callable[..., Sequence[float | None]]


def _called(fn: UserReward, completions: list, columns: dict[str, list]) -> list[float | None]:
    values = list(fn(completions, **columns))
    if len(values) != len(completions):
        raise ValueError(f"{len(values)} rewards for {len(completions)} completions")
    return [None if v is None else float(v) for v in values]


def called_safely(fn: UserReward, completions: list, columns: dict[str, list],
                  on_error: float | None = None) -> tuple[list[float | None], list[str | None]]:
    """Rewards and error messages of a batch."""
    try:
        return _called(fn, completions, columns), [None] * len(completions)
    except Exception as e:  # noqa: BLE001 - the user's code may raise anything
        if len(completions) == 1:
            return [on_error], [f"{type(e).__name__}: {e}"]
    done = [called_safely(fn, [c], {k: [v[i]] for k, v in columns.items()}, on_error) for i, c in enumerate(completions)]
    return [r[0] for r, _ in done], [m[0] for _, m in done]


def with_user_rewards(df: DataFrame, functions: Mapping[str, UserReward], completion: str = "completion",
                      columns: Sequence[str] = (), on_error: float | None = None) -> DataFrame:
    """``df`` with, for each function, ``reward_<name>`` and ``error_<name>`` (NULL where it worked).

    ``columns`` are handed to every function as keyword arguments of their names."""
    functions = dict(functions)
    added = [T.StructField(f"{part}_{name}", kind) for name in functions
             for part, kind in (("reward", T.DoubleType()), ("error", T.StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            completions = batch.column(completion).to_pylist()
            given = {c: batch.column(c).to_pylist() for c in columns}
            arrays, names = list(batch.columns), list(batch.schema.names)
            for name, fn in functions.items():
                rewards, errors = called_safely(fn, completions, given, on_error)
                arrays += [pa.array(rewards, pa.float64()), pa.array(errors, pa.string())]
                names += [f"reward_{name}", f"error_{name}"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))
