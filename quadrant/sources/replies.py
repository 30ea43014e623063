"""The texts of ``derive.completion_stages`` in Arrow batches (numpy over the rows of a batch).

A text is a sequence of tokens (operand, operator and operand, head of a line, catalogue script, wrapper): their numbers are
computed for all rows at once, and taken from one table of strings end to end.  ``test_replies.py`` compares
them with the SQL stages, which the DuckDB oracles keep reading."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrant.sources import derive as dv
from quadrant.sources.sqlgen import P

MAX_MUL = 12
NAMES = [f"{p}{i + 1}" for p, n in (("T", 3), ("U", 3), ("M", MAX_MUL), ("S", 3)) for i in range(n)]
OPERANDS = NAMES + [f"{m}{c}" for m in "AB" for c in dv.CELLS]
FIRST = {p: NAMES.index(f"{p}1") for p in "TUMS"} | {m: OPERANDS.index(f"{m}[0,0]") for m in "AB"}
TARGETS = NAMES + [f"C{c}" for c in dv.CELLS]
C_TARGET = len(NAMES)
STRASSEN_LINES = dv.STRASSEN.split("\n")
SCRIPTS = {6: dv.STRASSEN, 7: dv.STRASSEN, 8: dv.NAIVE8_STEPS, 9: dv.NAIVE8_INLINE, 10: dv.PROMPT_EXAMPLE7, 11: dv.ATTEMPT6,
           13: dv.CANT_ANSWER}  # by kind
CONSTANTS, DROPPED = 12, 15
WRAPPERS = [("<DSL>\n", "\n</DSL>"), ("Here is the script:\n<DSL>\n", "\n</DSL>\nIt uses few products."), ("<dsl>\n", "\n</dsl>"),
            ("<DSL>\n", "<|im_end|>\n</DSL>"), ("", ""), ("<DSL>\n", "\n</DSL>"), ("<DSL>\n", ";\n</DSL>"),
            ("<DSL>\n", "\n</DSL>\n<DSL>\nC[0,0] = 0\n</DSL>")]
SPACED, SEMICOLONS = 5, 6  # wrappers that change the body


def _tokens() -> tuple[list[str], dict[str, int]]:
    """All tokens and where each kind of them begins; number 0 is none."""
    kinds = {"none": [""], "plain": OPERANDS, "times": [f" * {x}" for x in OPERANDS], "plus": [f" + {x}" for x in OPERANDS],
             "minus": [f" - {x}" for x in OPERANDS], "head": [f"\n{x} = " for x in TARGETS], "first": [f"{x} = " for x in TARGETS],
             "number": [str(v) for v in range(-99, 100)], "script": [SCRIPTS.get(k, "") for k in range(16)],
             "dropped": ["\n".join(STRASSEN_LINES[:i] + STRASSEN_LINES[i + 1:]) for i in range(len(STRASSEN_LINES))]}
    at, words = {}, []
    for kind, found in kinds.items():
        at[kind] = len(words)
        words += found
    at["variant"] = len(words)
    spaced = [w.replace("[0,0]", "[0, 0]").replace("M", "m") for w in words]
    words = words + spaced + [w.replace("\n", ";\n") for w in words]
    at["before"] = len(words)
    at["after"] = at["before"] + len(WRAPPERS)
    return words + [w for w, _ in WRAPPERS] + [w for _, w in WRAPPERS], at


TOKENS, AT = _tokens()


@lru_cache(maxsize=1)
def token_array() -> pa.Array:
    return pa.array(TOKENS, pa.string())


def key_part(key: np.ndarray) -> np.ndarray:
    return np.mod(key, P).astype(np.uint64) * np.uint64(48271)


def _mod_p(x: np.ndarray) -> np.ndarray:
    """x % P (P = 2^31 - 1) of unsigned numbers below 2^61: the upper bits count once each."""
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    return np.minimum(x, x - np.uint64(P))  # below P, the difference wraps around to a larger number


def mixed(part: np.ndarray, slot) -> np.ndarray:
    """``Sql.mix_from``."""
    h = _mod_p(part + (np.asarray(slot, np.uint64) * np.uint64(7919) + np.uint64(1)))
    h = _mod_p(h * np.uint64(16807) + np.uint64(12345))
    return _mod_p(h * np.uint64(48271)).astype(np.int32)


def program_tokens(part: np.ndarray) -> np.ndarray:
    """The tokens of ``derive.program_stages``' lines, a row a program."""
    part = part[:, None]

    def h(slot):
        return mixed(part, slot)

    n_t, n_u, n_m, n_s = h(1) % 4, h(2) % 4, 2 + h(3) % (MAX_MUL - 1), h(4) % 4

    def name(d):
        """The operand that stands at place ``d`` of the program's names."""
        u, m = d - n_t, d - n_t - n_u
        return np.where(u < 0, d, np.where(m < 0, FIRST["U"] + u, np.where(m < n_m, FIRST["M"] + m, FIRST["S"] + m - n_m)))

    def pick2(d, s1, s2):
        i = h(s1) % np.maximum(d, 1)
        return i, (i + 1 + h(s2) % np.maximum(d - 1, 1)) % np.maximum(d, 1)

    def signed(slot, operand):
        return np.where(h(slot) % 2 == 0, AT["plus"], AT["minus"]) + operand

    def lines(there, first, *tokens):
        """Lines side by side: tokens of a line, where it is there."""
        made = np.stack(np.broadcast_arrays(*tokens), axis=2)
        made[:, :, 0] += np.where(first, AT["first"] - AT["head"], 0)
        return (made * there[:, :, None]).reshape(len(made), made.shape[1] * made.shape[2])

    i = np.arange(1, 4, dtype=np.int32)
    t_lines = lines(i <= n_t, i == 1, AT["head"] + FIRST["T"] + i - 1, AT["plain"] + FIRST["A"] + h(1000 + 8 * i) % 4,
                    signed(1002 + 8 * i, FIRST["A"] + h(1001 + 8 * i) % 4))
    u_lines = lines(i <= n_u, (i == 1) & (n_t == 0), AT["head"] + FIRST["U"] + i - 1, AT["plain"] + FIRST["B"] + h(2000 + 8 * i) % 4,
                    signed(2002 + 8 * i, FIRST["B"] + h(2001 + 8 * i) % 4))
    k = np.arange(1, MAX_MUL + 1, dtype=np.int32)
    d = n_t + n_u + k - 1
    a1, a2 = pick2(d, 3001 + 16 * k, 3002 + 16 * k)
    f3, f4, f5, f6 = (h(s + 16 * k) % (d + 4) for s in (3003, 3004, 3005, 3006))

    def cell_or_name(e):
        return np.where(e < 4, FIRST["B"] + e, name(e - 4))

    def name_or_cell(e, m):
        return np.where(e < d, name(e), FIRST[m] + e - d)

    fma = (h(3000 + 16 * k) % 5 == 0) & (d >= 2)
    m_lines = lines(k <= n_m, (k == 1) & (n_t + n_u == 0), AT["head"] + FIRST["M"] + k - 1,
                    AT["plain"] + np.where(fma, name(a1), name_or_cell(f5, "A")),
                    AT["times"] + np.where(fma, cell_or_name(f3), name_or_cell(f6, "B")),
                    np.where(fma, AT["plus"] + name(a2), 0), np.where(fma, AT["times"] + cell_or_name(f4), 0))
    v, w = pick2(n_t + n_u + n_m + i - 1, 4000 + 8 * i, 4001 + 8 * i)
    s_lines = lines(i <= n_s, False, AT["head"] + FIRST["S"] + i - 1, AT["plain"] + name(v), signed(4002 + 8 * i, name(w)))
    d, b = n_t + n_u + n_m + n_s, 5000 + 8 * np.arange(4, dtype=np.int32)
    i1, i2 = pick2(d, b + 1, b + 2)
    r = h(b + 3) % np.maximum(d - 2, 1)
    j = r + (r >= np.minimum(i1, i2))
    i3 = j + (j >= np.maximum(i1, i2))
    third = h(b) % (np.minimum(3, d) - 1) == 1
    c_lines = lines(np.broadcast_to(True, i1.shape), False, AT["head"] + C_TARGET + np.arange(4, dtype=np.int32), AT["plain"] + name(i1),
                    signed(b + 4, name(i2)), np.where(third, signed(b + 5, name(i3)), 0))
    return np.hstack([t_lines, u_lines, m_lines, s_lines, c_lines])


WIDTH = 3 * 3 + 3 * 3 + 5 * MAX_MUL + 3 * 3 + 4 * 4  # tokens of a program's lines


def reply_texts(keys: pa.Array, partkeys: pa.Array) -> pa.Array:
    """The completion of every (key, part key); NULL of a NULL key, and of a NULL part key where constants are made of it."""
    key = keys.fill_null(0).to_numpy(zero_copy_only=False)
    partkey = partkeys.fill_null(0).to_numpy(zero_copy_only=False)
    part = key_part(key)
    kind, wrap = mixed(part, 100) % 16, mixed(part, 102) % 8
    tokens = np.zeros((len(key), WIDTH + 2), np.int32)
    body = tokens[:, 1:-1]
    body[kind < 6] = program_tokens(part[kind < 6])
    whole = (kind >= 6) & (kind != CONSTANTS) & (kind != 14)
    body[whole, 0] = np.where(kind == DROPPED, AT["dropped"] + mixed(part, 101) % len(STRASSEN_LINES), AT["script"] + kind)[whole]
    constants = kind == CONSTANTS
    for n in range(4):
        body[constants, 2 * n] = AT["head" if n else "first"] + C_TARGET + n
        body[constants, 2 * n + 1] = AT["number"] + 99 + np.fmod(partkey[constants] + 31 * n, 100)
    tokens[:, 0], tokens[:, -1] = AT["before"] + wrap, AT["after"] + wrap
    used = tokens > 0
    counts = used.sum(axis=1)
    variant = np.where(wrap == SPACED, 1, np.where(wrap == SEMICOLONS, 2, 0)) * AT["variant"]
    flat = tokens[used]
    flat += np.where(flat < AT["before"], np.repeat(variant, counts), 0).astype(np.int32)
    taken = token_array().take(pa.array(flat))
    ends = np.concatenate([[0], np.cumsum(counts)])
    _, offsets, data = taken.buffers()
    offsets = np.frombuffer(offsets, np.int32)[ends] if len(taken) else np.zeros(len(key) + 1, np.int32)
    texts = pa.StringArray.from_buffers(len(key), pa.py_buffer(offsets), data)
    missing = pc.or_(keys.is_null(), pc.and_(partkeys.is_null(), pa.array(constants)))
    return pc.if_else(missing, pa.scalar(None, pa.string()), texts)


def reply(key: Column, partkey: Column) -> Column:
    """The completion of generation ``key``."""
    return F.arrow_udf(reply_texts, "string")(key, partkey.cast("bigint"))
