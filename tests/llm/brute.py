"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def repeats(rows, width=20):
    """(doc_id, n_words, n_removed, sha256 of what is kept) for rows (doc_id, text)."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, size=5):
    w = words(text)
    return collections.Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 1.0


def classes(rows, threshold=0.8):
    """doc_id -> smallest doc_id of its class, for rows of different doc_id."""
    bags = {d: shingles(t) for d, t in rows}
    head = {d: d for d in bags}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if jaccard(bags[a], bags[b]) >= threshold:
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {d: find(d) for d in bags}


def targets(sizes, weights, most=3):
    """Each source's share of all words, in fractions: whoever is over ``most`` times its size gives the excess back to be shared by weight."""
    from fractions import Fraction

    got = [Fraction(0)] * len(sizes)
    excess = Fraction(sum(sizes))
    while excess:
        open_ = [i for i in range(len(sizes)) if got[i] < most * sizes[i]]
        unit = excess / sum(weights[i] for i in open_)
        excess = Fraction(0)
        for i in open_:
            got[i] += unit * weights[i]
            if got[i] > most * sizes[i]:
                excess += got[i] - most * sizes[i]
                got[i] = Fraction(most * sizes[i])
    return [float(x) for x in got]
