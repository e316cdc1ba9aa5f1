"""Near-duplicate classes from all pairs, the plain way."""

from itertools import combinations


def shingles(text, words=5):
    parts = (text or "").encode().lower().split()
    return frozenset(b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def closure(ids, pairs):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def wanted(texts, similarity=0.8):
    """Classes by the similarity of all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    return closure(sets, [(i, j) for i, j in combinations(sorted(sets), 2) if jaccard(sets[i], sets[j]) >= similarity])
