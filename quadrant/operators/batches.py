"""The scripts of an Arrow batch run side by side: line k of all of them in one numpy step.

Every different line of a batch is read once, those of plain names from their words, others by ``steps.Grammar``.  What is
carried is one value for each name of a script, so memory follows the text.  Scripts or lines beyond the bounds below, texts beyond ASCII,
literals and inputs that are no BIGINT and doubles that are no number are not run here, but by ``Grammar.run``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quadrant.operators.steps import MAX_LONG, Grammar, as_long

MAX_LINES, MAX_TEXT, TERMS = 64, 1 << 12, 4  # a line is a sum of so many products of two sums of at most two names
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "  # of ASCII, those that str.strip drops
PLAIN_NAME = r"^[A-Z][A-Za-z0-9_]*(\[[0-9]+,[0-9]+\])?$"
UNDEFINED, MISSING, COMPLEX = "undefined name", "missing output cell", "complex expression"
ZERO, FIRST_CELL = 0, 1  # the value of a name that is not there
UNKNOWN, LOST = 1, 2  # a value not defined yet; one that overflowed


def cells(lists: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The eight cells of every row, and whether all are there."""
    n, flat = len(lists), lists.flatten()
    if len(flat) != 8 * n:
        return np.zeros((n, 8), kind), np.zeros(n, bool)
    there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(n, 8).all(axis=1)
    return flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(n, 8).astype(kind), there


class Lines:
    """The different lines of a batch: target, names (first and second factor of every term, two places each) as numbers, signs, errors."""

    def __init__(self, g: Grammar, found: pa.Array, dialect: str, counter: bool) -> None:
        n, width = len(found), 4 * TERMS
        self.names, self.sign = np.full((n, width), -1, np.int32), np.ones((n, width), np.int8)
        self.term_sign, self.product = np.ones((n, TERMS), np.int8), np.zeros((n, TERMS), bool)
        self.terms, self.target = np.zeros(n, np.int8), np.zeros(n, np.int64)
        self.err, self.skip, self.hard = np.zeros(n, np.int16), np.zeros(n, bool), np.zeros(n, bool)
        self.errors, self.values, self.count = ["", UNDEFINED, MISSING], {}, np.zeros(n, np.int64)
        words = self.read_words(found, dialect)
        self.ids = {w: k for k, w in enumerate(words)}
        text = found.to_pylist()
        self.found: tuple[list, list, list] = ([], [], [])  # line, place and number of a name
        for k in np.flatnonzero(self.whole).tolist():
            self.place(k, 0, text[k].partition("=")[2].strip())
        for k in np.flatnonzero(~self.plain).tolist():
            self.read(k, *g.line(text[k], dialect)[:4])
            if counter and "*" in text[k] and "=" in text[k]:
                self.count[k] = g.pattern_count(text[k].partition("=")[2].strip())
        lines, places, numbers = self.found
        self.names[lines, places] = numbers

    def place(self, line: int, place: int, name: str | tuple) -> None:
        lines, places, numbers = self.found
        lines.append(line)
        places.append(place)
        numbers.append(self.ids.setdefault(name, len(self.ids)))

    def read_words(self, found: pa.Array, dialect: str) -> list[str]:
        """Lines of plain names between single blanks, as ``Grammar.parse_plain`` and ``parse_e4`` read them; all words are returned."""
        if dialect == "E2":
            found = pc.if_else(pc.ends_with(found, ";"), pc.ascii_rtrim(pc.utf8_slice_codeunits(found, 0, -1), BLANKS), found)
        split = pc.split_pattern(found, " ")
        size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        vocabulary = coded.dictionary
        name = pc.match_substring_regex(vocabulary, PLAIN_NAME).to_numpy(zero_copy_only=False)
        op = pc.fill_null(pc.index_in(vocabulary, value_set=pa.array(["=", "+", "-", "*"])), -1).to_numpy(zero_copy_only=False)
        at = np.cumsum(size) - size
        code = np.append(coded.indices.to_numpy(zero_copy_only=False), np.zeros(9, np.int32))[at[:, None] + np.arange(9)]
        ops, is_name = op[code], name[code]
        plain = np.isin(size, (3, 5, 7, 9)) & (ops[:, 1] == 0) & is_name[:, 0] & is_name[:, 2]
        plus, minus, times = (sum(((size > at) & (ops[:, at] == op)).astype(np.int8) for at in (3, 5, 7)) for op in (1, 2, 3))
        for at in (3, 5, 7):
            plain &= (size <= at) | (ops[:, at] > 0) & is_name[:, at + 1]
            star = (ops[:, at] == 3) & (size > at)
            if at > 3:  # no two products in a row, and in E1 none beside others
                plain &= ~(star & (ops[:, at - 2] == 3)) & ((dialect != "E1") | (size <= at) | ~star & (ops[:, at - 2] != 3))
        self.whole, wrong = np.zeros(len(size), bool), np.zeros(len(size), bool)
        if dialect in ("E3", "E4"):  # longer sums are one name; in E4 not "a * b + c * d" and "a - b - c", and some are left to parse_e4
            mixed, differences = ((dialect == "E4") & x for x in ((plus > 0) & (times > 0), minus == 2))
            wrong = plain & mixed & (plus > 1)
            plain &= ~(mixed & (plus == 1) & (minus > 0)) & ~(differences & ~mixed & (plus + times > 0))
            self.whole = plain & (size > 5) & ~mixed & ~differences
        self.plain, rows = plain, np.flatnonzero(plain)
        code, ops, size, term = code[rows], ops[rows], size[rows], np.zeros(len(rows), np.int64)
        self.target[rows] = code[:, 0]
        self.count[rows] = times[rows]
        if wrong.any():
            self.errors.append(COMPLEX)
            self.err[wrong] = len(self.errors) - 1
        self.terms[self.whole] = 1
        summed = ~(self.whole | wrong)[rows]
        rows, code, ops, size, term = (x[summed] for x in (rows, code, ops, size, term))
        self.names[rows, 0] = code[:, 2]
        for at in (3, 5, 7):
            here = size > at
            star = here & (ops[:, at] == 3)
            term += here & ~star
            self.names[rows[here], 4 * term[here] + 2 * star[here]] = code[here, at + 1]
            self.term_sign[rows[here & (ops[:, at] == 2)], term[here & (ops[:, at] == 2)]] = -1
            self.product[rows[star], term[star]] = True
        self.terms[rows] = term + 1
        return vocabulary.to_pylist()

    def number(self, name: str | tuple) -> int:
        """A name's number; a literal is named (text,)."""
        return self.ids.setdefault(name, len(self.ids))

    def read(self, k: int, target: str, terms: list, err: str | None, skip: bool) -> None:
        self.target[k] = self.number(target)
        if skip:
            self.skip[k] = True
        if err:
            if err not in self.errors:
                self.errors.append(err)
            self.err[k] = self.errors.index(err)
            return
        if len(terms) > TERMS or any([len(f or ()) > 2 for _, *factors in terms for f in factors]):
            self.hard[k] = True
            return
        self.terms[k] = len(terms)
        if len(terms) == 1 and terms[0][0] == 1 and not terms[0][2] and len(terms[0][1]) == 1 and terms[0][1][0][::2] == (1, False):
            self.place(k, 0, terms[0][1][0][1])
            return
        for t, (sign, *factors) in enumerate(terms):
            if sign != 1:
                self.term_sign[k, t] = sign
            if factors[1]:
                self.product[k, t] = True
            for f, factor in enumerate(factors):
                for j, (s, name, literal) in enumerate(factor or ()):
                    if literal:
                        value = as_long(name)
                        self.hard[k] |= value is None or value < -MAX_LONG
                        name = (name,)
                        self.values[self.number(name)] = (value, float(name[0]))
                    self.place(k, 4 * t + 2 * f + j, name)
                    if s != 1:
                        self.sign[k, 4 * t + 2 * f + j] = s


class Run:
    """The outcome of every script, by row: error, its line, output cells, whether a cell overflowed."""

    def __init__(self, lines: Lines, code: np.ndarray, row: np.ndarray, n: int, inputs: np.ndarray, g: Grammar) -> None:
        self.lines, self.n = lines, n
        at = np.searchsorted(row, np.arange(n + 1))
        step = np.arange(len(row)) - at[row]
        order = np.argsort(step, kind="stable")
        self.code, self.row, self.ends = code[order], row[order], np.cumsum(np.bincount(step[order], minlength=1))
        outputs, ins = [lines.number(x) for x in g.outputs], {lines.number(x): k for k, x in enumerate(g.inputs)}
        size = len(lines.ids)
        names = lines.names.T.copy().take(self.code, axis=1)  # place by place
        there = names >= 0
        first = self.row * size
        keys = np.concatenate([first + lines.target[self.code], *[first[t] + x[t] for x, t in zip(names, there)],
                               (np.arange(n)[:, None] * size + outputs).ravel()])
        coded = pa.array(keys).dictionary_encode()
        cell = coded.indices.to_numpy(zero_copy_only=False) + FIRST_CELL
        self.target, self.outputs = cell[:len(code)], cell[len(cell) - 4 * n:].reshape(n, 4)
        self.names = np.full(names.shape, ZERO, np.int32)
        self.names[there] = cell[len(code):len(cell) - 4 * n]
        known = coded.dictionary.to_numpy(zero_copy_only=False)
        of, name = np.divmod(known, size)
        self.start, self.defined = np.zeros(len(known) + FIRST_CELL, inputs.dtype), np.zeros(len(known) + FIRST_CELL, bool)
        self.defined[ZERO] = True
        held = np.full(size, -1)
        held[list(ins)] = list(ins.values())
        self.given = np.flatnonzero(held[name] >= 0)
        self.of, self.cell = of[self.given], held[name[self.given]]
        self.defined[FIRST_CELL + self.given] = True
        self.give(inputs)
        lane = int(inputs.dtype == np.float64)
        literal = np.zeros(size, inputs.dtype)
        is_literal = np.zeros(size, bool)
        for k, v in lines.values.items():
            if lane or v[0] is not None and v[0] >= -MAX_LONG:
                literal[k], is_literal[k] = v[lane], True
        self.start[FIRST_CELL:][is_literal[name]] = literal[name[is_literal[name]]]
        self.defined[FIRST_CELL:] |= is_literal[name]
        self.hard = np.zeros(n, bool)

    def give(self, inputs: np.ndarray) -> None:
        """Start from these inputs, a row a script."""
        self.start[FIRST_CELL + self.given] = inputs[self.of, self.cell]

    def go(self, p: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(error, line, output cells, lost cells) of every script; modulo ``p``, if given."""
        t, double = self.lines, self.start.dtype == np.float64
        value, state = self.start % p if p else self.start.copy(), np.where(self.defined, 0, UNKNOWN).astype(np.uint8)
        err, eline, begin = np.zeros(self.n, np.int16), np.zeros(self.n, np.int32), 0
        for number, end in enumerate(self.ends, 1):
            rows, codes, target = (x[begin:end] for x in (self.row, self.code, self.target))
            terms = t.terms[codes]
            names, begin = self.names[:4 * int(terms.max(initial=0)), begin:end], end
            read = np.bitwise_or.reduce(state[names], axis=0)
            wrong = np.where(t.err[codes] > 0, t.err[codes], (read & UNKNOWN).astype(np.int16))
            wrong[t.skip[codes]] = 0
            failed = (wrong > 0) & (err[rows] == 0)
            err[rows[failed]], eline[rows[failed]] = wrong[failed], number
            go_on = np.flatnonzero((err[rows] == 0) & ~t.skip[codes] & ~self.hard[rows])
            if not len(go_on):
                continue
            if len(go_on) < len(rows):
                rows, codes, names, target, terms, read = rows[go_on], codes[go_on], names[:, go_on], target[go_on], terms[go_on], read[go_on]
            total, gone, bad = np.zeros(len(rows), value.dtype), (read & LOST) > 0, np.zeros(len(rows), bool)

            def add(x, y, at):
                s = x + y
                if p:
                    return s % p
                if not double:
                    gone[at] |= ((x ^ s) & (y ^ s)) < 0
                    bad[at] |= s == -MAX_LONG - 1
                return s

            def factor(at, place):
                """The sum of the names at ``place`` and beside it."""
                c, second = codes[at], names[place + 1, at]
                x = value[names[place, at]] * t.sign[c, place] + 0
                if second.any():
                    x = add(x, value[second] * t.sign[c, place + 1], at)
                return x

            def times(x, y, at):
                if p:
                    return x % p * (y % p) % p
                if not double:
                    near = np.abs(x.astype(np.float64) * y.astype(np.float64)) / 2.0 ** 63
                    gone[at] |= near > 1
                    bad[at] |= np.abs(near - 1) < 1e-9
                return x * y

            for k in range(int(terms.max(initial=0))):
                at = np.flatnonzero(terms > k) if k else np.arange(len(rows))
                x = factor(at, 4 * k)
                pair = np.flatnonzero(t.product[codes[at], k])
                if len(pair):
                    x[pair] = times(x[pair], factor(at[pair], 4 * k + 2), at[pair])
                total[at] = add(total[at], x * t.term_sign[codes[at], k], at)
            if double:
                bad |= np.isnan(total)
            self.hard[rows[bad]] = True
            value[target], state[target] = total, gone * np.uint8(LOST)
        out = state[self.outputs]
        err[(err == 0) & (out == UNKNOWN).any(axis=1)] = 2
        return err, eline, value[self.outputs], out == LOST


def fours(values: np.ndarray, there: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Lists of four, NULL where none is ``there``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(4 * there)]).astype(np.int32)),
                                    pa.array(values[there].ravel(), mask=None if missing is None else missing[there].ravel()), mask=pa.array(~there))


def small(scripts: pa.Array) -> np.ndarray:
    """The rows whose scripts are within the bounds."""
    found = pc.and_(pc.and_(pc.less_equal(pc.binary_length(scripts), MAX_TEXT), pc.string_is_ascii(scripts)),
                    pc.less(pc.count_substring(scripts, "\n"), MAX_LINES))
    return found.fill_null(False).to_numpy(zero_copy_only=False)


class Batch:
    """The scripts at ``rows`` as their lines' numbers in ``Lines``; by script, multiplications (``counter``) and whether it is not run here."""

    def __init__(self, g: Grammar, scripts: pa.Array, rows: np.ndarray, dialect: str, counter: bool) -> None:
        split, self.g = pc.split_pattern(scripts.take(pa.array(rows)), "\n"), g
        found, row = pc.ascii_trim(split.flatten(), BLANKS), np.repeat(np.arange(len(rows)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        kept = pc.greater(pc.binary_length(found), 0)
        coded, self.row = found.filter(kept).dictionary_encode(), row[kept.to_numpy(zero_copy_only=False)]
        self.code, self.lines, self.n = coded.indices.to_numpy(zero_copy_only=False), Lines(g, coded.dictionary, dialect, counter), len(rows)
        self.count = np.bincount(self.row, self.lines.count[self.code], minlength=self.n).astype(np.int32)
        self.hard = np.bincount(self.row, self.lines.hard[self.code], minlength=self.n) > 0

    def part(self, chosen: np.ndarray, inputs: np.ndarray) -> Run:
        """The run of the chosen scripts over their inputs."""
        at = np.zeros(self.n, np.int64)
        at[chosen] = np.arange(len(chosen))
        mine = np.isin(self.row, chosen)
        return Run(self.lines, self.code[mine], at[self.row[mine]], len(chosen), inputs, self.g)


def run(g: Grammar, scripts: pa.Array, longs: pa.Array, doubles: pa.Array, floating: pa.Array, dialect: str, counter: bool,
        p1: int, p2: int) -> tuple[np.ndarray, list[pa.Array]]:
    """The rows that are run here, and their error, its line, multiplications (``counter``) and lanes v, d, m1, m2."""
    as_double = floating.fill_null(False).to_numpy(zero_copy_only=False)
    (ints, ints_there), (reals, reals_there) = cells(longs, np.int64), cells(doubles, np.float64)
    fits = np.where(as_double, reals_there, ints_there & (ints.min(axis=1, initial=0) >= -MAX_LONG))
    rows = np.flatnonzero(fits & small(scripts))
    b = Batch(g, scripts, rows, dialect, counter)
    err, eline, lost, hard = np.zeros(b.n, np.int16), np.zeros(b.n, np.int32), np.zeros((b.n, 4), bool), b.hard
    found = {k: np.zeros((b.n, 4), np.float64 if k == "d" else np.int64) for k in ("v", "d", "m1", "m2")}
    for lane, chosen, inputs in (("v", np.flatnonzero(~as_double[rows] & ~hard), ints), ("d", np.flatnonzero(as_double[rows] & ~hard), reals + 0.0)):
        if len(chosen):
            r = b.part(chosen, inputs[rows[chosen]])
            with np.errstate(all="ignore"):
                err[chosen], eline[chosen], found[lane][chosen], lost[chosen] = r.go()
            hard[chosen] |= r.hard
    again = np.flatnonzero(lost.any(axis=1) & (err == 0) & ~hard)
    if len(again):
        r = b.part(again, ints[rows[again]])
        found["m1"][again], found["m2"][again] = r.go(p1)[2], r.go(p2)[2]
    done = np.flatnonzero(~hard)
    err, eline, lost, real = err[done], eline[done], lost[done], as_double[rows[done]]
    ok = err == 0
    wide = ok & ~real & lost.any(axis=1)
    return rows[done], [pa.array([None, *b.lines.errors[1:]], pa.string()).take(pa.array(err)), pa.array(eline, mask=eline == 0), pa.array(b.count[done]),
                        fours(found["v"][done], ok & ~real, lost), fours(found["d"][done], ok & real), fours(found["m1"][done], wide), fours(found["m2"][done], wide)]


def run_cases(g: Grammar, scripts: pa.Array, cases: list[tuple[list, list]], dialect: str, counter: bool,
              p1: int, p2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows that are run here, each over every case (cells of A and B, and of the product; all integers beyond -2^63): whether
    they run, multiplications (``counter``), and for every case whether the output cells are the product's."""
    rows = np.flatnonzero(small(scripts))
    b = Batch(g, scripts, rows, dialect, counter)
    chosen = np.flatnonzero(~b.hard)
    n, ok, hard = len(b.hard), np.zeros(len(b.hard), bool), b.hard.copy()
    correct, r = np.zeros((n, len(cases)), bool), None
    for k, (given, expected) in enumerate(cases):
        inputs = np.broadcast_to(np.array(given, np.int64), (n, 8))
        if k == 0:
            r = b.part(chosen, inputs)
        elif k == 1:  # what fails, fails in every case
            chosen = np.flatnonzero(ok & ~hard)
            r = b.part(chosen, inputs)
        else:
            r.give(inputs)
        with np.errstate(all="ignore"):
            err, _, value, lost = r.go()
        runs, same = err == 0, value == np.array(expected, np.int64)
        hard[chosen] |= r.hard
        again = np.flatnonzero(lost.any(axis=1) & runs & ~r.hard)
        if len(again):  # cells that overflowed are compared by their residues
            wide = b.part(chosen[again], inputs)
            x1, x2 = ([x % p for x in expected] for p in (p1, p2))
            alike = (wide.go(p1)[2] == x1) & (wide.go(p2)[2] == x2)
            same[again] = np.where(lost[again], alike, same[again])
        if k == 0:
            ok[chosen] = runs
        correct[chosen, k] = runs & same.all(axis=1)
    done = np.flatnonzero(~hard)
    return rows[done], ok[done], b.count[done], correct[done]
