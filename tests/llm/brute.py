"""Plain Python versions of the operators, and documents with every awkward case."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or return.
CLASHING = ("keep_id", "kept", "size", "shard", "group", "bucket", "rank", "_salt", "length", "ids", "n_norm", "lines", "starts", "score", "root", "hub", "rep", "part", "sequence_id")


def documents(seed=1, n=60):
    """Copies, near copies, shared passages, repeated lines, nulls, empty, blank and very long texts."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(1, 5)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared, lines = text(45), "\n".join(text(6) for _ in range(6))
    rows = []
    for i in range(n):
        body = text(pick.randint(1, 90))
        kind = i % 10
        if kind == 1 and rows:
            body = rows[-1][1] or ""
        elif kind == 2 and rows:
            words = (rows[-2][1] or "x").split()
            words[len(words) // 2] = "changed"
            body = " ".join(words)
        elif kind == 3:
            body = f"{text(5)} {shared} {text(7)}"
        elif kind == 4:
            body = f"{text(4)}\n{lines}\n{text(3)}"
        elif kind == 5:
            body = "  " + (rows[0][1] or "").replace(" ", "\t ") + "\n"
        rows.append((i, body, pick.choice(["en", "de", None]), f"src{i % 3}", len(body)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \n\t", "en", "s", 3), (n + 3, "É 日本語 ß", "de", "s", 7), (n + 4, text(3000), "en", "s", 9), (n + 5, "same " * 50, "en", "s", 9)]
    return rows


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F

    out = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in CLASHING if clash else ():
        out = out.withColumn(name, F.lit("x"))
    return out


def words(text):
    return WORD.findall(text or "")


def repeated_windows(rows, split, size):
    """Ids of the items of each row that lie in a window which also starts earlier."""
    first, gone = {}, {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        items = split(text)
        for i in range(len(items) - size + 1):
            key = tuple(items[i : i + size])
            if key in first:
                gone.setdefault(doc, set()).update(range(i, i + size))
            else:
                first[key] = (doc, i)
    return gone


def repeated_lines(rows, run, passage):
    """The same for lines: runs of ``run`` lines that are not all blank, and single lines of ``passage`` words; by the place of a row."""
    first, gone = set(), {}
    for at, (_, text, *_rest) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        lines = [] if text is None else text.split("\n")
        spans = [(i, run) for i in range(len(lines) - run + 1)]
        spans += [(i, 1) for i, line in enumerate(lines) if run > 1 and passage and len(words(line)) >= passage]
        for i, n in spans:
            key = tuple(lines[i : i + n])
            if not any(words(x) for x in key):
                continue
            if key in first:
                gone.setdefault(at, set()).update(range(i, i + n))
            first.add(key)
    return gone


def shingles(text, n):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n, above, below=100):
    sets = [(r[0], shingles(r[1], n)) for r in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and below * len(x & y) >= above * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(s), root(d)) for d, s in sets}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
