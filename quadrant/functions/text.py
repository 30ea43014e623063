"""Text scalars with Python string semantics, as Spark Column expressions.

Spark's ``trim`` removes only spaces and Java's ``\\s`` is ASCII, while the
scores we reproduce use Python's ``str.strip()`` and Unicode ``\\s``.  The
whitespace class below is spelled out so the same pattern text works in
Java regex and in RE2 (DuckDB oracle).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the scoring rules we reproduce) -------------
# Characters for which Python's str.isspace() is true.
WS_CHARS = ("\\t\\n\\x{0b}\\f\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
            "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")
WS = f"[{WS_CHARS}]"
# Special tokens removed from a completion before its lines are read.
SPECIAL_TOKENS = ["<|im_end|>", "<|endoftext|>", "<|file_separator|>"]
# The reply a model gives when it cannot answer, compared case-folded.
SENTINEL = "error: cannot determine full sequence."
# Chat-template marker that opens an assistant turn.
ASSISTANT_MARKER = "<|im_start|>assistant"
# Reply endings cut by the reply extractor, in this order.
REPLY_END_TOKENS = ["<|im_end|>", "<|endoftext|>"]
# ---------------------------------------------------------------------------

STRIP_RE = f"^{WS}+|{WS}+\\z"
TAG_RE = "(?isu)<DSL>(.*?)</DSL>"
PYTHON_TAG = re.compile(TAG_RE)
ANSWER_RE = "(?s)<answer>(.*?)</answer>"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element
    transform): interpreted lambdas do not share common subexpressions."""
    return F.get(F.transform(F.array(value), body), 0)


# The same set as plain characters, for trim(): a scan, not a regex.
WS_TRIM = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
           + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """``str.strip()`` (X1): Unicode whitespace off both ends."""
    return F.trim(col(c), F.lit(WS_TRIM))


def remove_tokens(c, tokens=None) -> Column:
    """Remove every occurrence of each token, in list order."""
    out = col(c)
    for tok in (SPECIAL_TOKENS if tokens is None else tokens):
        if tok:
            out = F.replace(out, F.lit(tok), F.lit(""))
    return out


def split_lines(c) -> Column:
    """``s.split('\\n')`` keeping empties."""
    return F.split(col(c), "\n", -1)


def clean_line_array(c, drop_comments: bool = False) -> Column:
    """Lines stripped, blank lines dropped (F1); optionally ``#`` lines (F2)."""
    lines = F.transform(split_lines(c), py_strip)
    if drop_comments:
        return F.filter(lines, lambda l: (l != "") & ~l.startswith("#"))
    return F.filter(lines, lambda l: l != "")


def clean_text(text: str, drop_comments: bool = False) -> str:
    lines = map(str.strip, text.split("\n"))
    return "\n".join([x for x in lines if x and not (drop_comments and x[0] == "#")])


def clean_lines(c, drop_comments: bool = False) -> Column:
    """Joined clean lines (F1 + X8), in Arrow batches."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean_text(t, drop_comments) for t in texts.to_pylist()], pa.string())
    return F.arrow_udf(run, "string")(col(c))


def is_sentinel(script) -> Column:
    """Empty script or the can't-answer sentinel."""
    s = col(script)
    return (s == "") | (F.lower(py_strip(s)) == F.lit(SENTINEL))


def has_tag(c) -> Column:
    """A ``<DSL>..</DSL>`` block exists, case-insensitive, across lines."""
    return col(c).rlike(TAG_RE)


def tag_body(c) -> Column:
    """Stripped body of the first tag block (T-1); '' when absent."""
    return py_strip(F.regexp_extract(col(c), TAG_RE, 1))


def script_of(text: str, tokens: tuple[str, ...]) -> tuple[bool, str]:
    """Whether a completion holds a tag block, and its clean script: the first block's body
    or the whole text, special tokens removed, lines stripped, blank lines dropped."""
    if text.isascii():  # TAG_RE by two searches
        low = text.lower()
        start = low.find("<dsl>")
        end = low.find("</dsl>", start + 5) if start >= 0 else -1
        body = text[start + 5:end] if end >= 0 else None
    else:
        found = PYTHON_TAG.search(text)
        body = found[1] if found else None
    script = text if body is None else body.strip()
    for tok in tokens:
        if tok in script:
            script = script.replace(tok, "")
    return body is not None, clean_text(script)


def _removed(tokens) -> tuple[str, ...]:
    return tuple(t for t in (SPECIAL_TOKENS if tokens is None else tokens) if t)


def tagged_script(content, tokens=None) -> Column:
    """struct(tagged, script) of a completion (F5, R2), in Arrow batches; NULL of NULL."""
    tokens = _removed(tokens)

    def run(texts: pa.Array) -> pa.Array:
        found = [(None, None) if t is None else script_of(t, tokens) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.bool_()), pa.array([s for _, s in found], pa.string())],
                                          ["tagged", "script"])
    return F.arrow_udf(run, "tagged boolean, script string")(col(content))


def script_from_completion(content, tokens=None) -> Column:
    """Clean script out of a completion (R2), in Arrow batches."""
    tokens = _removed(tokens)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else script_of(t, tokens)[1] for t in texts.to_pylist()], pa.string())
    return F.arrow_udf(run, "string")(col(content))


def reply_from_generation(full_text, prompt_text, end_tokens=None) -> Column:
    """Assistant reply out of generated text (R1, T-2, X6, X7).

    Prefix cut when the text starts with the prompt; else the text after the
    line holding the last assistant marker; else (no marker, or none that ends
    its line) the whole text.  Then each end token is cut once if the reply ends
    with it, in list order.
    """
    text, prompt = col(full_text), col(prompt_text)
    cut_prefix = py_strip(text.substr(F.length(prompt) + 1, F.lit(1 << 30)))
    after = F.substring_index(text, ASSISTANT_MARKER, -1)  # behind the last marker
    line_end = F.when(F.instr(text, ASSISTANT_MARKER) > 0, F.instr(after, "\n")).otherwise(0)
    reply = (F.when(text.startswith(prompt), cut_prefix)
             .when(line_end > 0, py_strip(after.substr(line_end + 1, F.lit(1 << 30))))
             .otherwise(text))

    def without(tok):
        return lambda r: F.when(r.endswith(F.lit(tok)), py_strip(drop_last(r, len(tok)))).otherwise(r)

    for tok in (REPLY_END_TOKENS if end_tokens is None else end_tokens):
        reply = let(reply, without(tok))
    return reply


def drop_last(c, n: int) -> Column:
    """``s[:-n]``."""
    s = col(c)
    return s.substr(F.lit(1), F.greatest(F.length(s) - n, F.lit(0)))


def answer_body(c) -> Column:
    """Stripped ``<answer>`` body (X10); NULL when there is no block."""
    return F.when(col(c).rlike(ANSWER_RE), py_strip(F.regexp_extract(col(c), ANSWER_RE, 1)))


def think_answer_format(c) -> Column:
    """``^<think>.*?</think>\\s*<answer>.*?</answer>$`` with Python's ``$``
    (end, or before one final newline) (F6, trap T3)."""
    pattern = f"(?s)\\A<think>.*?</think>{WS}*<answer>.*?</answer>\\n?\\z"
    return col(c).rlike(pattern)


def may_change_name(script) -> Column:
    """False when ``canonical_name`` leaves every name of the script as it is:
    no lower-case letter, and no white space inside brackets."""
    s = col(script)
    return (F.upper(s) != s) | s.rlike(f"\\[[^\\]]*{WS}")


def canonical_name(c) -> Column:
    """Upper-case a leading letter, drop blanks inside ``[r,c]``.
    The regexes only run when they can change the name: the first character
    changes under upper-casing, or the name holds whitespace."""
    s = py_strip(c)
    first = F.substring(s, 1, 1)
    upped = F.when((F.upper(first) != first) & first.rlike("^\\p{L}"),
                   F.concat(F.upper(first), s.substr(F.lit(2), F.lit(1 << 30)))).otherwise(s)
    has_ws = F.length(F.translate(s, WS_TRIM, "")) != F.length(s)
    return F.when(has_ws, F.regexp_replace(upped, f"\\[{WS}*(\\d+){WS}*,{WS}*(\\d+){WS}*\\]", "[$1,$2]")).otherwise(upped)


def drop_trailing_semicolon(c) -> Column:
    """One trailing ``;`` removed, then right-strip."""
    s = col(c)
    return F.when(s.endswith(";"), F.regexp_replace(drop_last(s, 1), f"{WS}+\\z", "")).otherwise(s)


def truncate(c, n: int = 100) -> Column:
    """Message truncation."""
    return F.substring(col(c), 1, n)


def token_list(extras=None) -> list[str]:
    """Fixed special tokens united with tokenizer extras (e.g. the
    tokenizer's special tokens and eos), de-duplicated, empties dropped;
    resolved on the driver once, then folded into the plan as literals."""
    out = []
    for t in SPECIAL_TOKENS + list(extras or []):
        if t and isinstance(t, str) and t not in out:
            out.append(t)
    return out


def run_stamp(fmt: str = "yyyyMMdd_HHmmss") -> Column:
    """Run label from the current time (``%Y%m%d_%H%M%S``; use
    ``HH:mm:ss`` for the log-line clock)."""
    return F.date_format(F.current_timestamp(), fmt)


def basic_chat_text(system, user) -> Column:
    """P9, second format: system text, a user line, an open assistant line."""
    return F.concat(col(system), F.lit("\nUser: "), col(user), F.lit("\nAssistant:"))


def inference_prompt(user, a, b, style: str = "using") -> Column:
    """The evaluation prompt suffix: `` (Using A=.., B=..)`` or
    ``\\nA = ..\\nB = ..`` with matrices rendered like Python lists."""
    from quadrant.functions.matrix import py_repr
    if style == "using":
        return F.concat(col(user), F.lit(" (Using A="), py_repr(a), F.lit(", B="), py_repr(b), F.lit(")"))
    return F.concat(col(user), F.lit("\nA = "), py_repr(a), F.lit("\nB = "), py_repr(b))


def normalize_variant(c) -> Column:
    """P11 / X20, decided per row: a VARIANT completion - text, a message object with ``role`` and ``content``, a
    list of one of either, or anything else - as text.

    A message's content counts if it is text; whatever is neither text nor such a message (longer lists, empty
    lists, numbers, objects without content) gives its JSON text, keys in order; a JSON null or NULL gives NULL."""
    c = col(c)
    single = F.size(F.try_variant_get(c, "$", "array<variant>")) == 1
    one = F.when(single, F.try_variant_get(c, "$[0]", "variant")).otherwise(c)

    def text(x):
        kind = F.schema_of_variant(x)
        content = F.try_variant_get(x, "$.content", "variant")
        is_text = (kind.startswith("OBJECT") & F.try_variant_get(x, "$.role", "variant").isNotNull()
                   & F.coalesce(F.schema_of_variant(content) == "STRING", F.lit(False)))
        return (F.when(x.isNull() | F.is_variant_null(x), F.lit(None)).when(kind == "STRING", F.variant_get(x, "$", "string"))
                 .when(is_text, F.try_variant_get(content, "$", "string")).otherwise(F.to_json(x)))

    return let(one, text)


def normalize_json(raw) -> Column:
    """P11 for completions logged as JSON of any shape; a line that is no JSON counts as plain text."""
    raw = col(raw)
    parsed = F.try_parse_json(raw)
    return F.when(parsed.isNull(), raw).otherwise(normalize_variant(parsed))


def normalize_completion(df, name: str, out: str = "completion"):
    """A completion given as text, a {role, content} message, or a
    list of either becomes text; the branch is chosen from the column's type
    at analysis time (a one-element list yields its element's content; other
    lists and shapes their JSON text); a VARIANT is decided row by row."""
    from pyspark.sql import types as T
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.StringType):
        v = c
    elif isinstance(dt, T.VariantType):
        v = normalize_variant(c)
    elif isinstance(dt, T.StructType) and "content" in dt.fieldNames():
        v = c["content"]
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType) \
            and "content" in dt.elementType.fieldNames():
        v = F.when(F.size(c) == 1, F.get(c, 0)["content"]).otherwise(F.to_json(c))
    elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
        v = F.when(F.size(c) == 1, F.get(c, 0)).otherwise(F.to_json(c))
    else:
        v = F.to_json(c) if isinstance(dt, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
    return df.withColumn(out, v)
