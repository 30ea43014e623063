"""Small tables for the tests: awkward rows, and brute-force versions of operators."""

import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree and nobody "
         "says a word until the moon is up and the river runs silver under the bridge").split()


def prose(k, n=40):
    return " ".join(PROSE[(k * 7 + i * (k % 5 + 1)) % len(PROSE)] for i in range(n))


def awkward(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated
    rows, ties, and columns whose names the operators use themselves."""
    base = prose(1)
    rows = [(1, base, "en", "a", 5), (2, base.upper(), "en", "a", None), (2, base.upper(), "en", "a", None),
            (3, None, None, None, None), (None, None, "en", "b", 1), (None, prose(2), None, None, 2),
            (4, "", "en", "b", 0), (5, "  \t\n ", "de", "b", 5), (6, "Ünïcödé ÄÖ ß ñ 日本語 🙂", "de", "c", 9),
            (7, " ".join(prose(k, 50) for k in range(400)), "en", "c", 1), (8, "x" * 50_000, None, "d", 1),
            (9, base + " end", "en", "d", 1), (10, "ünïcödé äö ß ñ 日本語 🙂", "de", "c", 9), (11, "one", "en", "", 3)]
    clash = "size int, key string, id int, fp string, score double, start long, number int, label string"
    extra = (1, "k", 1, "f", 0.5, 1, 1, "l")
    return spark.createDataFrame([r + extra for r in rows], f"{DOCUMENTS}, {clash}")


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents(spark, texts, source=lambda k: "s"):
    rows = [(k, t, "en", source(k), len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def components(n, linked):
    """The smallest member of each one's component."""
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
