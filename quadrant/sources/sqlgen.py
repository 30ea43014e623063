"""Small SQL-text helpers for expressions shared by Spark (``F.expr``) and the
DuckDB oracles: both engines must build byte-identical inputs from the driver
tables, so the derivations are written once and rendered for either engine.
Only the handful of spellings that differ are covered here."""

from __future__ import annotations

from dataclasses import dataclass

P = 2147483647


@dataclass(frozen=True)
class Sql:
    engine: str  # "spark" or "duckdb"

    @property
    def spark(self) -> bool:
        return self.engine == "spark"

    def lam(self, args: str, body: str) -> str:
        if self.spark:
            return f"({args}) -> {body}" if "," in args else f"{args} -> {body}"
        return f"lambda {args}: {body}"

    def transform(self, arr: str, args: str, body: str) -> str:
        fn = "transform" if self.spark else "list_transform"
        return f"{fn}({arr}, {self.lam(args, body)})"

    def filter(self, arr: str, args: str, body: str) -> str:
        fn = "filter" if self.spark else "list_filter"
        return f"{fn}({arr}, {self.lam(args, body)})"

    def seq(self, n: str) -> str:
        """[1..n], empty when n <= 0."""
        if self.spark:
            return f"slice(sequence(1, greatest(({n}), 1)), 1, greatest(({n}), 0))"
        return f"range(1, greatest(({n}), 0) + 1)"

    def join(self, arr: str, sep: str) -> str:
        return f"array_join({arr}, {sep})" if self.spark else f"array_to_string({arr}, {sep})"

    def cat(self, *arrs: str) -> str:
        if self.spark:
            return f"concat({', '.join(arrs)})"
        out = arrs[0]
        for a in arrs[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def at(self, arr: str, i: str) -> str:
        """1-based element."""
        return f"element_at({arr}, CAST({i} AS INT))" if self.spark else f"list_extract({arr}, {i})"

    def slice(self, arr: str, n: str) -> str:
        """First n elements (n >= 0)."""
        if self.spark:
            return f"slice({arr}, 1, greatest({n}, 0))"
        return f"list_slice({arr}, 1, greatest({n}, 0))"

    def split(self, s: str, sep_char: str) -> str:
        """Split on a literal one-character separator, keeping empties."""
        if sep_char == "\n":
            return f"split({s}, chr(10), -1)" if self.spark else f"string_split({s}, chr(10))"
        if self.spark:
            return f"split({s}, '[{sep_char}]', -1)"
        return f"string_split({s}, '{sep_char}')"

    def nl(self) -> str:
        return "chr(10)"

    def lit(self, text: str) -> str:
        """A string literal; newlines become chr(10) so no engine sees raw
        control characters or backslash escapes in the SQL."""
        if "\n" in text:
            parts = text.split("\n")
            return "(" + " || chr(10) || ".join(self.lit(p) for p in parts) + ")"
        return "'" + text.replace("'", "''") + "'"

    def str(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def mix(self, key: str, slot: str) -> str:
        """Same integer mixer as quadrant.functions.matrix.mix."""
        k = f"((CAST({key} AS BIGINT) % {P} + {P}) % {P})"
        h = f"(({k} * 48271 + ({slot}) * 7919 + 1) % {P})"
        h = f"(({h} * 16807 + 12345) % {P})"
        return f"(({h} * 48271) % {P})"

    def mix_key(self, key: str) -> str:
        """The key's part of ``mix``."""
        return f"(((CAST({key} AS BIGINT) % {P} + {P}) % {P}) * 48271)"

    def mix_from(self, part: str, slot: str) -> str:
        """``mix``, given ``mix_key``."""
        h = f"(({part} + ({slot}) * 7919 + 1) % {P})"
        h = f"(({h} * 16807 + 12345) % {P})"
        return f"(({h} * 48271) % {P})"

    def uniform(self, key: str, slot: str, low: int, high: int) -> str:
        return f"({low} + {self.mix(key, slot)} % {high - low + 1})"


SPARK = Sql("spark")
DUCK = Sql("duckdb")


def apply_stages(df, stages):
    """Spark: add each (name, sql) stage as its own projection."""
    from pyspark.sql import functions as F
    for name, expr in stages:
        df = df.withColumn(name, F.expr(expr))
    return df


def nest_stages(from_sql: str, stages) -> str:
    """DuckDB: one nested SELECT per stage, mirroring apply_stages."""
    sql = from_sql
    for name, expr in stages:
        sql = f"(SELECT *, {expr} AS {name} FROM {sql})"
    return sql
