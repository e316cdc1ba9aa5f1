"""Similarity of strings: Jaro-Winkler, token-set ratio, weighted ratio. Arrow batches; equal pairs are computed once."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def winkler(a: str, b: str) -> float:
    s = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return s + same * 0.1 * (1 - s) if s > 0.7 else s


#: Letters are counted in so many buckets.
BUCKETS = 64


def letter_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its letters by bucket, and its length."""
    codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(x) for x in codes], dtype=np.int64)
    at = np.repeat(np.arange(len(texts)), sizes) * BUCKETS + (np.concatenate(codes).astype(np.int64) % BUCKETS if len(codes) else np.zeros(0, np.int64))
    return np.bincount(at, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.int16), sizes


def winkler_bound(a: list[str], b: list[str]) -> np.ndarray:
    """At least the Jaro-Winkler similarity of each pair: no more letters can be common than both have of a bucket, none
    moved, and the first letters that are equal count in full."""
    every = list(dict.fromkeys([*a, *b]))
    number = {t: i for i, t in enumerate(every)}
    counts, sizes = letter_counts(every)
    i, j = (np.fromiter((number[t] for t in side), dtype=np.int64, count=len(side)) for side in (a, b))
    common = np.minimum(counts[i], counts[j]).sum(axis=1, dtype=np.int64)
    n, m = np.maximum(sizes[i], 1), np.maximum(sizes[j], 1)
    jaro_most = np.where(common > 0, (common / n + common / m + 1) / 3, 0.0)
    jaro_most = np.where(i == j, 1.0, jaro_most)
    heads = np.array([[ord(c) for c in t[:4]] + [-1 - k for k in range(4 - len(t[:4]))] for t in every], dtype=np.int64).reshape(-1, 4)
    same = np.cumprod((heads[i] == heads[j]) & (heads[i] >= 0), axis=1).sum(axis=1)
    return np.where(jaro_most > 0.7, jaro_most + same * 0.1 * (1 - jaro_most), jaro_most)


def ratio(a: str, b: str) -> int:
    """0 to 100: twice the letters of the longest common stretches, found one after the other, by both lengths."""
    if a == b:
        return 100
    return round(100 * SequenceMatcher(None, a, b).ratio()) if a and b else 0


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter text with a stretch, as long, of the longer one that begins where a common stretch puts the shorter one's begin."""
    if a == b:
        return 100
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    starts = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long).get_matching_blocks()}
    best = max(SequenceMatcher(None, short, long[s : s + len(short)]).ratio() for s in starts)
    return 100 if best > 0.995 else round(100 * best)


def processed(text: str) -> str:
    """ASCII alone, in lower case, with blanks for whatever is neither letter, digit nor underscore."""
    return "".join(c if c.isalnum() or c == "_" else " " for c in text if c.isascii()).lower().strip()


def _by_sets(a: str, b: str, score) -> int:
    """Of two token sets: what is in both, against the same followed by what is in one alone; the best of all pairs."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = (f"{both} {left}".strip(), f"{both} {right}".strip())
    return max(score(both, one) if both else 0, score(both, two) if both else 0, score(one, two))


def _in_order(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_set_ratio(a: str, b: str) -> int:
    return _by_sets(processed(a), processed(b), ratio)


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(_in_order(processed(a)), _in_order(processed(b)))


def weighted_ratio(a: str, b: str) -> int:
    """0 to 100: the best of the plain ratio and, scaled down, those of sorted tokens and token sets (0.95); if one text
    is one and a half times as long or more, partial ratios instead (0.9; 0.6 beyond eight times)."""
    a, b = processed(a), processed(b)
    if not a or not b:
        return 0
    base, longer = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return round(max(base, 0.95 * ratio(_in_order(a), _in_order(b)), 0.95 * _by_sets(a, b, ratio)))
    scale = 0.6 if longer > 8 else 0.9
    return round(max(base, scale * partial_ratio(a, b), 0.95 * scale * partial_ratio(_in_order(a), _in_order(b)), 0.95 * scale * _by_sets(a, b, partial_ratio)))


def _pairs(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else f(*pair)
            out.append(known[pair])
        return pd.Series(out)

    return run


def jaro_winkler(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairs(winkler), "double")(a, b)


def jaro_winkler_from(threshold: float):
    """jaro_winkler() for pairs at least so alike, null for others. Pairs whose letters alone rule it out, which are nearly all, are never scored: the bound is exact and comes in numpy for a batch of pairs."""
    score = _pairs(winkler)

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=a.index, dtype="float64")
        there = (a.notna() & b.notna()).to_numpy()
        some = np.flatnonzero(there)
        if len(some):
            some = some[winkler_bound(a.iloc[some].tolist(), b.iloc[some].tolist()) >= threshold - 1e-9]
        if len(some):
            found = score(a.iloc[some], b.iloc[some]).to_numpy()
            out.iloc[some] = np.where(found >= threshold - 1e-9, found, np.nan)
        return out

    return lambda a, b: F.nanvl(F.pandas_udf(run, "double")(a, b), F.lit(None).cast("double"))


def token_set(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairs(token_set_ratio), "int")(a, b)


def weighted(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairs(weighted_ratio), "int")(a, b)
