"""Documents with every odd case, and brute-force helpers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, key int, copies int, doc int, h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(seed=0, n=60):
    """Nulls in any column, empty, blank, long and repeated texts, repeated rows, clashing extra columns."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gämma", "d#lta", "eps", "zeta!", "eta", "theta", "iota", "kappa"]
    line = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(k))
    base = ["\n".join(line(rng.randrange(3, 14)) for _ in range(rng.randrange(1, 7))) for _ in range(n // 3)]
    texts = []
    for i in range(n):
        t = rng.choice(base)
        if i % 3:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "edited" + str(i % 4)
            t = " ".join(w)
        texts.append(t)
    texts += ["", " \t\n", None, "one", "ONE", "two words", base[0], base[0], line(3000), "\n".join([line(9)] * 40), "\u00a0x\u2003y"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), i, f"x{i}", i, 3, 1, 2) for i, t in enumerate(texts)]
    return [*rows, (None, base[1], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), rows[3], rows[3]]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_groups(rows, width, percent):
    """{doc_id: smallest id reachable} over rows (doc_id, text, ...), each pair compared."""
    sets, g = [(r[0], shingles(r[1], width)) for r in rows if r[0] is not None], Groups()
    for i, (a, x) in enumerate(sets):
        g.find(a)
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                g.link(a, b)
    return {a: g.find(a) for a, _ in sets}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines_gone(rows, threshold, min_chars):
    """{doc_id: line numbers} that an earlier line equals or comes near."""
    seen, gone = [], {}
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[1] is not None}
    for d in sorted(texts):
        for p, x in enumerate(texts[d].split("\n")):
            if len(x) >= min_chars:
                if any(abs(len(x) - len(y)) <= threshold and edits(x, y) <= threshold for y in seen):
                    gone.setdefault(d, set()).add(p)
                seen.append(x)
    return gone
