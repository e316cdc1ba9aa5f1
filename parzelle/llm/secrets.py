"""Secrets: fixed patterns, and random strings told by few characters per token.

Base kinds, each leftmost and non-overlapping: assign (a name such as password, then a value of 8 characters or more),
access (AKIA ...) and hex (32 or more). The method adds kind random: a run of 16 or more key characters that a
vocabulary of common strings needs many tokens for. Known digests (hexadecimal of the usual lengths, UUIDs) and
identifiers are no random strings, and what a base span covers isn't reported again. Identifiers consist of parts, none
of which mixes letters and digits and of whose characters over half are in numbers and words; words are letters that
are one token or need few by the same ratio. Runs of plain words (letters of one case, or capitalised) and numbers are
held to a stricter ratio, since made-up names come near random strings. What is left of a run outside base spans is
judged for itself: words and digests are cut off its ends, and long ones part it, so that the words of a path neither
hide a random string nor become part of it. What remains is judged as a whole, then by stretches of parts, then by parts.

Spans are code points, end exclusive, ordered by start, then kind as listed.

Cases. Null and empty texts have no spans. Whole texts are searched, of any length. Of spans that begin alike the kind
listed first comes first. Repeated rows each get a row. An empty table gives no rows. scan() reads only the id and text
columns and redact() keeps all, so others can have any names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from parzelle.llm import bpe, common

KINDS = ("assign", "access", "hex", "random")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:0x)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})=*|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PART = re.compile(r"[A-Za-z0-9]+")
INNER = re.compile(rf"(?<![A-Za-z0-9])(?:{DIGEST.pattern})(?![A-Za-z0-9])|(?P<part>[A-Za-z0-9]+)")
PLAIN = re.compile(r"[A-Za-z]?(?:[a-z]+|[A-Z]+)|[0-9]+")
MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
#: Characters of a random string, at least.
LEAST = 16
#: Words of more characters in a row part random strings.
BRIDGE = 7
#: Strings of fewer characters per token are random.
RATIO, NAME_RATIO = 2.2, 2.0

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def is_word(part: str, count, ratio: float = RATIO) -> bool:
    """A number, or letters that the vocabulary knows."""
    return part.isdigit() or part.isalpha() and ((n := count(part)) == 1 or len(part) / n >= ratio)


def is_known(run: str, count, ratio: float = RATIO) -> bool:
    """A digest or an identifier."""
    if DIGEST.fullmatch(run):
        return True
    parts = PART.findall(run)
    return not MIXED.search(run) and 2 * sum(len(p) for p in parts if not is_word(p, count, ratio)) <= sum(map(len, parts))


def is_random(run: str, count, ratio: float = RATIO) -> bool:
    plain = all(PLAIN.fullmatch(p) for p in PART.findall(run))
    return not is_known(run, count, ratio) and len(run) / count(run) < (min(ratio, NAME_RATIO) if plain else ratio)


def judged(text: str, a: int, b: int, count, ratio: float = RATIO) -> list[Span]:
    """Random strings in a stretch of key characters. Words and digests at its ends, and those in its middle that are
    longer together than BRIDGE, belong to no random string; what lies between is judged whole, then by stretches of
    parts that are no words, then by single parts."""
    if b - a < LEAST:
        return []
    found: list[Span] = []
    runs: list[list[tuple[int, int, bool, int]]] = [[]]  # start, end, whether known, characters if it is a word
    words = 0
    for m in INNER.finditer(text, a, b):
        known = not m["part"] or is_word(m[0], count, ratio)
        size = len(m[0]) if known and len(m[0]) > 2 else 0
        words = words + size if known else 0
        if words > BRIDGE:
            runs.append([])
        runs[-1].append((*m.span(), known, size))
    for i, run in enumerate(runs):
        inner = [k for k, part in enumerate(run) if not part[2]]
        if not inner:
            continue
        # separators at an end stay if nothing was cut off there
        x = a if i == 0 and inner[0] == 0 else run[inner[0]][0]
        y = b if i == len(runs) - 1 and inner[-1] == len(run) - 1 else run[inner[-1]][1]
        found += [(p, q, "random") for p, q in narrowed(text, x, y, run[inner[0] : inner[-1] + 1], count, ratio)]
    return found


def narrowed(text: str, x: int, y: int, parts: list[tuple[int, int, bool, int]], count, ratio: float) -> list[tuple[int, int]]:
    def random(p: int, q: int) -> bool:
        return q - p >= LEAST and is_random(text[p:q], count, ratio)

    if random(x, y):
        return [(x, y)]
    stretches: list[list[tuple[int, int]]] = [[]]
    short: list[tuple[int, int]] = []
    for p, q, known, size in parts:
        if not known:
            # words of one or two characters, which random strings have too, end no stretch
            stretches[-1] += [*(short if stretches[-1] else ()), (p, q)]
            short = []
        elif not size:
            short.append((p, q))
        else:
            stretches.append([])
            short = []
    found = []
    for held in filter(None, stretches):
        whole = held[0][0], held[-1][1]
        found += [whole] if random(*whole) else [p for p in held if random(*p)]
    return found


def random_spans(text: str, count, base: list[Span], ratio: float = RATIO) -> list[Span]:
    found = []
    for m in RUN.finditer(text):
        at, b = m.span()
        covered = [s for s in base if s[0] < b and at < s[1]]
        if covered and DIGEST.fullmatch(m[0]):
            continue
        for x, y, _ in covered:
            found += judged(text, at, x, count, ratio)
            at = max(at, y)
        found += judged(text, at, b, count, ratio)
    return found


def spans(text: str, count, ratio: float = RATIO) -> tuple[list[Span], list[Span]]:
    """Base spans, and all."""
    base = base_spans(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted([*base, *random_spans(text, count, base, ratio)], key=lambda s: (s[0], rank[s[2]]))


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """id, the count of each kind, base_sha256, spans."""

    def make():
        encode = bpe.library(path, pattern).encode_ordinary

        def run(texts: pa.Array) -> dict:
            out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
            for text in common.as_texts(texts):
                base, found = spans(text, lambda s: len(encode(s)), ratio)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[2] == k for s in found))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(found))
            return out

        return run

    return common.map_texts(df, id_col, text_col, make, "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redacted(text: str, found: list[Span]) -> str:
    """Each covered stretch becomes one mark; overlapping spans are one stretch."""
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, path: str, pattern: str, text_col: str = "text", chars_col: str = "n_chars", ratio: float = RATIO) -> DataFrame:
    """All rows and columns, with secrets replaced in the text and the count of characters set anew; null texts stay null."""
    at, chars = df.columns.index(text_col), df.columns.index(chars_col)

    def run(batches):
        encode = bpe.library(path, pattern).encode_ordinary
        for part in common.slices(batches, text_col):
            texts = [None if t is None else redacted(t, spans(t, lambda s: len(encode(s)), ratio)[1]) for t in part.column(at).to_pylist()]
            cols = list(part.columns)
            cols[at] = pa.array(texts, pa.string())
            cols[chars] = pa.array([old if new == was else len(new) for old, was, new in zip(part.column(chars).to_pylist(), part.column(at).to_pylist(), texts, strict=True)], part.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return df.mapInArrow(run, df.schema)
