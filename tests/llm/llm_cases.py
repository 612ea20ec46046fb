"""Small tables with everything an operator has to bear, and plain versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

CLASHES = "id version row line lines word n h1 score label s block c key positions dropped words rank".split()
WHITE = " \t\n\x0b\x0c\r"


def documents(spark, rows):
    """(doc_id, text, source) rows with the other columns of the table and columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASHES
    )
    full = [(i, t, "en", s, None if t is None else len(t), *CLASHES) for i, t, s in rows]
    return spark.createDataFrame(full, schema)


def edge_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    shared = "A line that Many share "
    rows = [
        (0, "", "a"),
        (1, None, "a"),
        (2, "one two three four five six seven", None),
        (2, "one two three four five six seven", None),
        (2, "the same id with other words", "b"),
        (None, "no id but some words in here", "b"),
        (3, "\n\n \t\n", "b"),
        (4, long, "a"),
        (5, long + " end", "a"),
        (6, "Ünï çødé x 日本 😀\r\nzwei", None),
        (7, "x" * 300, "c"),
    ]
    rows += [(10 + i, f"{shared}\nown {i}\n\t{shared.upper()}\r", "a") for i in range(12)]
    return rows


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text):
    w = words(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def components(rows):
    """Smallest id reachable, per row of (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = [None] * len(rows)
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(ids, default=None)
    return out


def line_key(line):
    return lower(line.strip(WHITE))


def kept_lines(rows, min_docs, keep_first=False):
    """Per row of (id, text): lines, dropped, kept text."""
    documents = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    found = defaultdict(list)
    for d in documents:
        for pos, line in enumerate(d[1].split("\n")):
            if line_key(line):
                found[line_key(line)].append((d, pos))
    gone = set()
    for places in found.values():
        if len({d for d, _ in places}) >= min_docs:
            gone |= set(places[keep_first:])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for pos, x in enumerate(lines) if ((i, t or ""), pos) not in gone]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def counts(rows):
    return Counter(w for _, t in rows for w in words(t))
