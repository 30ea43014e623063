"""Inputs derived from the driver's tables, as SQL expression text.

* prompts: one per ``orders`` row; the matrix pair is a pure function of
  ``o_orderkey`` (edge rows for keys 0..6, uniform cells otherwise).
* completions: one per ``lineitem`` row (``l_orderkey`` = prompt,
  ``l_linenumber`` = generation); the text is a generated random program or
  a catalogue script, wrapped and mutated by the row's hash.
* responses: one per ``lineitem`` row as a reply of model ``p_brand`` to
  test ``l_orderkey``.
* programs: the random-program corpus generator (G6).

Each function takes an :class:`~quadrant.sources.sqlgen.Sql` renderer so the
Spark job and its DuckDB oracle read the same derivation.
"""

from __future__ import annotations

from quadrant.sources.sqlgen import Sql

# ---- fixed values: catalogue scripts ------------------------------------------
# Strassen's product, written in the script syntax.
STRASSEN = """M1 = (A[0,0] + A[1,1]) * (B[0,0] + B[1,1])
M2 = (A[1,0] + A[1,1]) * B[0,0]
M3 = A[0,0] * (B[0,1] - B[1,1])
M4 = A[1,1] * (B[1,0] - B[0,0])
M5 = (A[0,0] + A[0,1]) * B[1,1]
M6 = (A[1,0] - A[0,0]) * (B[0,0] + B[0,1])
M7 = (A[0,1] - A[1,1]) * (B[1,0] + B[1,1])
C[0,0] = M1 + M4 - M5 + M7
C[0,1] = M3 + M5
C[1,0] = M2 + M4
C[1,1] = M1 - M2 + M3 + M6"""
# The schoolbook product, one product per line.
NAIVE8_STEPS = """M1 = A[0,0] * B[0,0]
M2 = A[0,1] * B[1,0]
M3 = A[0,0] * B[0,1]
M4 = A[0,1] * B[1,1]
M5 = A[1,0] * B[0,0]
M6 = A[1,1] * B[1,0]
M7 = A[1,0] * B[0,1]
M8 = A[1,1] * B[1,1]
C[0,0] = M1 + M2
C[0,1] = M3 + M4
C[1,0] = M5 + M6
C[1,1] = M7 + M8"""
# The schoolbook product with sums of products on one line.
NAIVE8_INLINE = """C[0,0] = A[0,0] * B[0,0] + A[0,1] * B[1,0]
C[0,1] = A[0,0] * B[0,1] + A[0,1] * B[1,1]
C[1,0] = A[1,0] * B[0,0] + A[1,1] * B[1,0]
C[1,1] = A[1,0] * B[0,1] + A[1,1] * B[1,1]"""
# The example shown to the model in its system prompt (not a correct product).
PROMPT_EXAMPLE7 = """M1 = (A[0,0] - A[1,1]) * (B[1,0] + B[1,1])
M2 = (A[1,0] + A[0,1]) * (B[0,1])
M3 = A[1,1] * (B[0,0] - B[1,1])
M4 = A[0,0] * (B[1,1] + B[0,0])
M5 = (A[0,1] + A[1,1]) * (B[0,0])
M6 = (A[1,0] - A[0,0]) * (B[1,0] - B[0,1])
M7 = (A[0,0] + A[1,0]) * (B[0,1] - B[1,1])

C[0,0] = M2 + M3 - M5 + M6
C[0,1] = M1 + M6 - M4
C[1,0] = M7 - M2 + M1
C[1,1] = M3 - M4 + M5 - M7"""
# A six-product attempt with a sum of products on one line (not correct).
ATTEMPT6 = """U1 = A[0,0] + B[0,1]
U2 = A[1,1] - A[0,0]
U3 = B[0,0] + B[1,0]
M1 = A[1,1] * B[1,0]
M2 = A[1,0] * M1
M3 = A[1,1] * U2
M4 = B[1,0] * B[0,1]
M5 = M1 * B[0,0] + U1 * B[1,1]
S1 = U3 - M5
C[0,0] = M1 - U3 - M2
C[0,1] = M2 - M5 - S1
C[1,0] = M2 + U2
C[1,1] = M1 + M4"""
CANT_ANSWER = "Error: Cannot determine full sequence."
CELLS = ["[0,0]", "[0,1]", "[1,0]", "[1,1]"]
# ---------------------------------------------------------------------------


def _case(q: Sql, sel: str, options: list[str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"(CASE {sel} {whens} ELSE {default} END)"


# ---- prompts (G1, G2, G3) -----------------------------------------------------

def prompt_cell(q: Sql, key: str, m: str, idx: int) -> str:
    """Cell idx (0..3, row-major) of matrix m ('A'/'B') for prompt ``key``."""
    slot = (1 if m == "A" else 5) + idx
    rnd = q.uniform(key, str(slot), -9999, 9999)
    ident = "1" if idx in (0, 3) else "0"
    fixed4 = {"A": ["-2", "3", "1", "-4"], "B": ["5", "-1", "-2", "6"]}[m][idx]
    edge = {
        0: ident if m == "A" else rnd,
        1: rnd if m == "A" else ident,
        2: "0" if m == "A" else rnd,
        3: rnd if m == "A" else "0",
        4: fixed4,
        5: q.uniform(key, str(slot), 0, 9),
        6: q.uniform(key, str(slot), -9, 0),
    }
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in edge.items())
    return f"CAST((CASE {key} {whens} ELSE {rnd} END) AS BIGINT)"


def matrix_sql(q: Sql, cells: list[str]) -> str:
    return q.arr(q.arr(cells[0], cells[1]), q.arr(cells[2], cells[3]))


def prompt_matrices(q: Sql, key: str) -> tuple[str, str]:
    a = matrix_sql(q, [prompt_cell(q, key, "A", i) for i in range(4)])
    b = matrix_sql(q, [prompt_cell(q, key, "B", i) for i in range(4)])
    return a, b


# ---- random programs (G6) -----------------------------------------------------

def program_stages(q: Sql, key: str, prefix: str = "_g", max_mul: int = 12,
                   when: str | None = None) -> list[tuple[str, str]]:
    """Stages computing a random program's lines into ``{prefix}_lines``.

    Line counts are drawn first (0-3 T lines, 0-3 U lines, 2..max_mul
    products, 0-3 sums), so every line is a pure function of (key, line
    number) and the name pool is an array indexed by position."""
    nT, nU, nM, nS, names = (f"{prefix}_nT", f"{prefix}_nU", f"{prefix}_nM", f"{prefix}_nS", f"{prefix}_names")

    def h(slot: str) -> str:  # Spark keeps the key's part of the mixer as a column
        return q.mix_from(f"{prefix}_k", slot) if q.spark else q.mix(key, slot)

    def pool_at(first: str, second: str, n_first: str, e: str) -> str:
        """Element ``e`` (from 1) of two lists end to end."""
        if not q.spark:
            return q.at(q.cat(first, second), e)
        return f"(CASE WHEN {e} <= {n_first} THEN {q.at(first, f'least({e}, {n_first})')} ELSE {q.at(second, f'greatest({e} - {n_first}, 1)')} END)"

    a_cells = q.arr(*[q.lit(f"A{c}") for c in CELLS])
    b_cells = q.arr(*[q.lit(f"B{c}") for c in CELLS])

    def name(d: str) -> str:
        return q.at(names, f"({d}) + 1")

    def cell(cells: str, e: str) -> str:
        return q.at(cells, f"({e}) + 1")

    def op(slot: str) -> str:
        return f"(CASE WHEN {h(slot)} % 2 = 0 THEN ' + ' ELSE ' - ' END)"

    def pick2(d: str, s1: str, s2: str) -> tuple[str, str]:
        """Two distinct indices in [0, d)."""
        i1 = f"({h(s1)} % greatest({d}, 1))"
        i2 = f"(({i1} + 1 + {h(s2)} % greatest({d} - 1, 1)) % greatest({d}, 1))"
        return i1, i2

    name_pool = q.cat(
        q.transform(q.seq(nT), "i", f"'T' || {q.str('i')}"),
        q.transform(q.seq(nU), "i", f"'U' || {q.str('i')}"),
        q.transform(q.seq(nM), "i", f"'M' || {q.str('i')}"),
        q.transform(q.seq(nS), "i", f"'S' || {q.str('i')}"))
    t_lines = q.transform(q.seq(nT), "i", (
        f"'T' || {q.str('i')} || ' = ' || {cell(a_cells, h('1000 + 8 * i') + ' % 4')}"
        f" || {op('1002 + 8 * i')} || {cell(a_cells, h('1001 + 8 * i') + ' % 4')}"))
    u_lines = q.transform(q.seq(nU), "j", (
        f"'U' || {q.str('j')} || ' = ' || {cell(b_cells, h('2000 + 8 * j') + ' % 4')}"
        f" || {op('2002 + 8 * j')} || {cell(b_cells, h('2001 + 8 * j') + ' % 4')}"))
    d_m = f"({nT} + {nU} + k - 1)"
    a1, a2 = pick2(d_m, "3001 + 16 * k", "3002 + 16 * k")
    defined = names if q.spark else f"{q.slice(names, d_m)}"  # the places asked for are within the first d_m
    rest = f" % ({d_m} + 4) + 1"
    fma = (f"{name(a1)} || ' * ' || {pool_at(b_cells, defined, '4', h('3003 + 16 * k') + rest)} || ' + ' || "
           f"{name(a2)} || ' * ' || {pool_at(b_cells, defined, '4', h('3004 + 16 * k') + rest)}")
    mul = (f"{pool_at(defined, a_cells, d_m, h('3005 + 16 * k') + rest)} || ' * ' || "
           f"{pool_at(defined, b_cells, d_m, h('3006 + 16 * k') + rest)}")
    m_lines = q.transform(q.seq(nM), "k", (
        f"'M' || {q.str('k')} || ' = ' || (CASE WHEN {h('3000 + 16 * k')} % 5 = 0 AND {d_m} >= 2 "
        f"THEN {fma} ELSE {mul} END)"))
    d_s = f"({nT} + {nU} + {nM} + s - 1)"
    v, w = pick2(d_s, "4000 + 8 * s", "4001 + 8 * s")
    s_lines = q.transform(q.seq(nS), "s", (
        f"'S' || {q.str('s')} || ' = ' || {name(v)} || {op('4002 + 8 * s')} || {name(w)}"))
    d_c = f"({nT} + {nU} + {nM} + {nS})"
    c_lines = []
    for ci, c in enumerate(CELLS):
        b = 5000 + 8 * ci
        i1, i2 = pick2(d_c, str(b + 1), str(b + 2))
        r = f"({h(str(b + 3))} % greatest({d_c} - 2, 1))"
        lo, hi = f"least({i1}, {i2})", f"greatest({i1}, {i2})"
        j1 = f"({r} + (CASE WHEN {r} >= {lo} THEN 1 ELSE 0 END))"
        i3 = f"({j1} + (CASE WHEN {j1} >= {hi} THEN 1 ELSE 0 END))"
        k3 = f"({h(str(b))} % (least(3, {d_c}) - 1) = 1)"
        c_lines.append(f"'C{c} = ' || {name(i1)} || {op(str(b + 4))} || {name(i2)} || "
                       f"(CASE WHEN {k3} THEN {op(str(b + 5))} || {name(i3)} ELSE '' END)")
    return [
        *([(f"{prefix}_k", q.mix_key(key))] if q.spark else []),
        (nT, f"CAST({h('1')} % 4 AS INT)"),
        (nU, f"CAST({h('2')} % 4 AS INT)"),
        (nM, f"CAST(2 + {h('3')} % {max_mul - 1} AS INT)"),
        (nS, f"CAST({h('4')} % 4 AS INT)"),
        (names, name_pool if when is None else f"CASE WHEN {when} THEN {name_pool} END"),
        (f"{prefix}_lines", q.cat(t_lines, u_lines, m_lines, s_lines, q.arr(*c_lines)) if when is None else
         f"CASE WHEN {when} THEN {q.cat(t_lines, u_lines, m_lines, s_lines, q.arr(*c_lines))} END"),
    ]


def program_text(q: Sql, prefix: str = "_g") -> str:
    """Raw program text (no tags) from ``program_stages`` output."""
    return q.join(f"{prefix}_lines", q.nl())


def wrap_dsl(q: Sql, body: str) -> str:
    return f"('<DSL>' || {q.nl()} || {body} || {q.nl()} || '</DSL>')"


# ---- completions (model replies for training prompts) ----------------------------

def completion_stages(q: Sql, key: str, partkey: str) -> list[tuple[str, str]]:
    """Reply for generation ``key`` into column ``completion``: kind by hash
    (random program, catalogue script, constants, can't-answer, empty, a
    catalogue script with one line dropped), then a wrapper by hash (tags,
    prose, lower-case tags, special token, no tags, spaced indices and
    lower-case names, semicolons, two tag blocks)."""
    kind = f"({q.mix(key, '100')} % 16)"
    stages = program_stages(q, key, when=f"{kind} < 6")
    drop_at = f"({q.mix(key, '101')} % 11)"
    strassen_lines = q.split(q.lit(STRASSEN), "\n")
    dropped = q.join(q.filter(strassen_lines, "x, i", f"i <> {drop_at}" if q.spark else f"i - 1 <> {drop_at}"),
                     q.nl())
    consts = " || chr(10) || ".join(
        f"'C{c} = ' || {q.str(f'({partkey} + {31 * n}) % 100')}" for n, c in enumerate(CELLS))
    body = _case(q, kind, [program_text(q)] * 6 + [
        q.lit(STRASSEN), q.lit(STRASSEN), q.lit(NAIVE8_STEPS), q.lit(NAIVE8_INLINE), q.lit(PROMPT_EXAMPLE7),
        q.lit(ATTEMPT6), f"({consts})", q.lit(CANT_ANSWER), "''", dropped])
    nl = q.nl()
    b = "_body"
    spaced = f"replace(replace({b}, '[0,0]', '[0, 0]'), 'M', 'm')"
    semis = f"(replace({b}, {nl}, ';' || {nl}) || ';')"
    text = _case(q, "_wrap", [
        wrap_dsl(q, b),
        f"('Here is the script:' || {nl} || {wrap_dsl(q, b)} || {nl} || 'It uses few products.')",
        f"('<dsl>' || {nl} || {b} || {nl} || '</dsl>')",
        f"('<DSL>' || {nl} || {b} || '<|im_end|>' || {nl} || '</DSL>')",
        b,
        wrap_dsl(q, spaced),
        wrap_dsl(q, semis),
        f"({wrap_dsl(q, b)} || {nl} || '<DSL>' || {nl} || 'C[0,0] = 0' || {nl} || '</DSL>')",
    ])
    return stages + [("_body", body), ("_wrap", f"({q.mix(key, '102')} % 8)"), ("completion", text)]


# ---- responses (evaluation replies) ------------------------------------------------

def test_cell(q: Sql, test_key: str, m: str, idx: int) -> str:
    """Evaluation matrices: integers 1..10 held as doubles."""
    slot = (201 if m == "A" else 205) + idx
    return f"CAST({q.uniform(test_key, str(slot), 1, 10)} AS DOUBLE)"


def test_matrices(q: Sql, test_key: str) -> tuple[str, str]:
    return (matrix_sql(q, [test_cell(q, test_key, "A", i) for i in range(4)]),
            matrix_sql(q, [test_cell(q, test_key, "B", i) for i in range(4)]))


def response_text(q: Sql, key: str) -> str:
    """A plain reply to an evaluation prompt (no tags expected)."""
    kind = f"({q.mix(key, '110')} % 8)"
    nl = q.nl()
    naive = q.lit(NAIVE8_STEPS)
    return _case(q, kind, [
        naive,
        f"('# schoolbook product' || {nl} || {naive})",
        q.lit(STRASSEN),
        q.lit(NAIVE8_STEPS.replace("C[0,0] = M1 + M2", "C[0,0] = M1 - M2")),
        "''",
        q.lit(NAIVE8_STEPS.replace("M3 = A[0,0] * B[0,1]\n", "")),
        q.lit("C[0,0] = 1\nC[0,1] = 2\nC[1,0] = 3\nC[1,1] = 4"),
        wrap_dsl(q, naive),
    ])
