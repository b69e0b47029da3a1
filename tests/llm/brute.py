"""Plain versions of the operators for small tables."""

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    w = WORD.findall(low(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def near_components(rows):
    """id -> least id reachable over links of Jaccard 0.75."""
    sets = {d: shingles(t) for d, t in rows}
    groups = Groups()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        groups.find(a)
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {d: groups.find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def rule_counts(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if n[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def plain_line(line):
    """A-Z lower-cased, digits as 0, other ASCII but letters as blanks."""
    out = "".join(c if ord(c) > 127 else c.lower() if c.isalpha() else "0" if c.isdigit() else " " for c in line)
    return " ".join(WORD.findall(out))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def repeated_lines(rows, distance, share=0.9):
    """id -> numbers of the lines that go: plain edit similarity over all pairs of distinct lines with a word (``distance`` is one held against the plain one).

    Pairs whose counts of single characters differ by more than the edits allowed could do are passed over.
    """
    found = [(d, k, plain_line(x)) for d, t in sorted(rows, key=lambda r: r[0]) if t is not None for k, x in enumerate(t.split("\n"))]
    found = [f for f in found if f[2]]
    names, groups = sorted({x for _, _, x in found}), Groups()
    signs = {c: i for i, c in enumerate(sorted({c for x in names for c in x}))}
    counts = np.zeros((len(names), len(signs)), np.int32)
    for i, x in enumerate(names):
        for c, n in Counter(x).items():
            counts[i, signs[c]] = n
    size = counts.sum(1)
    for i, a in enumerate(names):
        apart = np.abs(counts[i + 1:] - counts[i]).sum(1)
        most = (1 - share) * np.maximum(size[i + 1:], size[i]) + 1e-9
        for j in np.flatnonzero((apart <= 2 * most) & (np.abs(size[i + 1:] - size[i]) <= most)):
            b = names[i + 1 + j]
            if groups.find(a) != groups.find(b) and distance(a, b) <= (1 - share) * max(len(a), len(b)):
                groups.join(a, b)
    kept, gone = set(), {}
    for d, k, x in found:
        root = groups.find(x)
        if root in kept:
            gone.setdefault(d, []).append(k)
        kept.add(root)
    return gone


def tiles(doc, item, least):
    """Greedy string tiling by search for the longest unmarked match, one at a time."""
    md, mi, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in md and i + n not in mi:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < least:
            return out
        out.append((d, i, n))
        md.update(range(d, d + n))
        mi.update(range(i, i + n))


def leaks(text, items, covered=0.6, seed=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = []
    for k, t in items:
        own = re.findall(r"[^\W_]+", (t or "").lower())
        if own and sum(x[2] for x in tiles(words, own, min(seed, len(own)))) >= covered * len(own):
            out.append(k)
    return out
