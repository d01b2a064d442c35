"""Documents with every awkward case, and brute-force versions of what the operators promise."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, count long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(2 + rng.randrange(6))) if rng.random() < 0.5 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """Null and empty texts, blanks, ties, repeated rows, one very long text, null columns; extra columns that clash with names used inside."""
    long_text = prose(1, 60_000)
    rows = [
        (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \t\n ", None, "s2"), (4, "one", "de", None), (5, "é", None, None),
        (6, prose(2, 300), "en", "s1"), (7, prose(2, 300), "en", "s1"), (8, prose(2, 300) + " tail", "de", "s2"), (9, long_text, "en", "s1"),
        (10, "the same line here\n" * 40, "fr", "s1"), (10, "the same line here\n" * 40, "fr", "s1"), (11, "x" * 5000, "fr", "s3"),
        (12, prose(3, 50) + " " + prose(99, 80) + " " + prose(4, 50), "en", "s1"), (13, prose(5, 60) + " " + prose(99, 80) + " " + prose(6, 40), "en", "s1"),
        (14, "ÄÖÜ ß çà 漢字 🙂 " * 30, "de", "s2"), (None, "no id at all " + prose(7, 40), "en", "s1"), (16, "a b c", "en", "s1"), (17, "A B C", "en", "s1"),
        (2**40, prose(8, 120), "es", "s4"), (-5, prose(9, 120), "es", "s4"),
    ]
    return [(d, t, lang, s, None if t is None else len(t), "x", 7) for d, t, lang, s in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, n):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(docs, n, percent):
    """docs: {doc_id: text} -> {doc_id: component}."""
    sets = {d: shingle_set(t, n) for d, t in docs.items()}
    index = defaultdict(list)
    links = []
    for d, s in sets.items():
        both = Counter(e for g in s for e in index[g])
        links += [(d, e) for e, k in both.items() if 100 * k >= percent * (len(s) + len(sets[e]) - k)]
        for g in s:
            index[g].append(d)
    return components(list(docs), links)


def removed(rows, length=200):
    """rows: [(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, sha256)]."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in raw for i in range(len(x) - length + 1))
    out = []
    for d, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
