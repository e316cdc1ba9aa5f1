"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues. From each anchor a
local parser looks left and right as far as its kind of text reaches, and validates what lies between:

    email     an at-sign: the local part to its left, labels of the domain to its right
    phone     a plus sign: digits, blanks and punctuation to its right, 8 to 15 digits
    ip        a digit: numbers joined by single dots, four at a time, each at most 255
    card      a digit: digits with single blanks or hyphens between them, 16 to 19 that pass the Luhn test
    address   a scheme (://): a web address that names a person's account, by user information before the host
    account   a cue (iban, ssn, ...): the identifier after it; a bank account by its country's check digits

A parser is skipped where an earlier find of its kind has taken the text. So the first four kinds give the leftmost
non-overlapping matches of their patterns, also where a match fails its test and is dropped. Kinds address and account
are what the method adds; their finds don't remove those of the others.

Spans are code points, end exclusive, ordered by kind as listed, then start.

Cases. Null and empty texts have no spans. Whole texts are searched, of any length; text that anchors share is gone
through once. Only ASCII digits and letters count. Repeated rows each get a row. An empty table gives no rows. Only the
id and the text are read, so other columns can have any names.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from parzelle.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LABEL = frozenset(DIGITS + LETTERS + "-")
LOCAL = LABEL | frozenset("._%+")
DIAL = frozenset(DIGITS + " ().-")
#: Before the host of a web address.
USER = frozenset(DIGITS + LETTERS + "-._~%!$&'()*+,;=:")
#: Cues of identifiers; also found in upper case and with capitals.
CUES = ("iban", "ssn", "social security", "passport", "account", "konto", "tax id", "steuer-id")
BANK = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", re.ASCII)
SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", re.ASCII)
NUMBER = re.compile(r"(?=[A-Z]{0,2}[0-9])[A-Z]{0,2}[0-9][0-9\x20-]{5,}[0-9]", re.ASCII)
#: What may stand between a cue and its identifier.
LINK = re.compile(r"(?:\x20?(?:no|nr|number|num|id|is))?[\x20.:=#]{1,4}", re.ASCII | re.IGNORECASE)

Span = tuple[int, int, str]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, anchor in [("@", "@"), ("+", "+"), ("://", "/"), *[(d, "0") for d in DIGITS], *[(w, "cue") for c in CUES for w in (c, c.upper(), c.title(), c.capitalize())]]:
        found.add_word(word, (anchor, len(word)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def run_start(text: str, at: int, allowed: frozenset, least: int) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around an at-sign: a local part, and labels joined by single dots."""
    start = run_start(text, at, LOCAL, least)
    if start == at:
        return None
    end = run_end(text, at + 1, LABEL)
    if end == at + 1:
        return None
    first = end
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = run_end(text, end + 1, LABEL)
    return (start, end) if end > first else None


def phone(text: str, at: int) -> tuple[int, int] | None:
    """What begins with a plus sign and a digit: the end lies after the last digit, two characters on at least."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_end(text, at + 2, DIAL)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in DIGITS else None


def joined(text: str, at: int, between: str) -> tuple[list[tuple[int, int]], int]:
    """Runs of digits from a digit on, with single characters between them; where the last ends."""
    runs, n = [], len(text)
    while True:
        end = at
        while end < n and text[end] in DIGITS:
            end += 1
        runs.append((at, end))
        if end + 1 < n and text[end] in between and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return runs, end


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def address(text: str, at: int) -> tuple[int, int] | None:
    """From the scheme before :// (which begins at `at`) to the end of the host, if user information stands before the host."""
    start = run_start(text, at, LABEL | frozenset("+."), 0)
    while start < at and text[start] not in LETTERS:
        start += 1
    user = run_end(text, at + 3, USER)
    if start == at or user == at + 3 or user >= len(text) or text[user] != "@":
        return None
    end = run_end(text, user + 1, LABEL | frozenset("."))
    while end > user + 1 and text[end - 1] in ".-":
        end -= 1
    return (start, end) if end > user + 1 else None


def bank_number(found: str) -> int:
    """How many characters of a candidate are an account number with right check digits: the longest such, or 0."""
    for end in range(len(found), 14, -1):
        part = found[:end].replace(" ", "")
        if found[end - 1] != " " and 15 <= len(part) <= 34 and int("".join(str(int(c, 36)) for c in part[4:] + part[:4])) % 97 == 1:
            return end
    return 0


def account(text: str, end: int, cue: str) -> tuple[int, int] | None:
    """The identifier after a cue that ends at `end`."""
    link = LINK.match(text, end)
    if not link:
        return None
    at = link.end()
    if (m := BANK.match(text, at)) and (n := bank_number(m[0])):
        return at, at + n
    if cue in ("ssn", "social security"):
        return m.span() if (m := SOCIAL.match(text, at)) else None
    if cue != "iban" and (m := NUMBER.match(text, at)) and 8 <= sum(c in DIGITS for c in m[0]) <= 20:
        return m.span()
    return None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """Ordered by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    digits = 0  # digits before are in a run that was looked at
    for last, (anchor, size) in anchors.iter(text):
        at = last + 1 - size
        if anchor == "0":
            if at < digits:
                continue
            if at >= done["ip"]:
                dotted, done["ip"] = joined(text, at, ".")
                for i in range(0, len(dotted) - 3, 4):
                    if all(small(text[a:b]) for a, b in dotted[i : i + 4]):
                        found["ip"].append((dotted[i][0], dotted[i + 3][1]))
            if at >= done["card"]:
                runs, done["card"] = joined(text, at, " -")
                number = "".join(text[a:b] for a, b in runs)
                if 16 <= len(number) <= 19 and luhn(number):
                    found["card"].append((at, done["card"]))
            digits = min(done["ip"], done["card"])
        elif anchor == "@":
            if span := email(text, at, done["email"]):
                found["email"].append(span)
                done["email"] = span[1]
        elif anchor == "+":
            if at >= done["phone"] and (span := phone(text, at)):
                done["phone"] = span[1]
                if 8 <= sum(c in DIGITS for c in text[span[0] : span[1]]) <= 15:
                    found["phone"].append(span)
        elif anchor == "/":
            if at >= done["address"] and (span := address(text, at)):
                found["address"].append(span)
                done["address"] = span[1]
        elif (at == 0 or not text[at - 1].isalnum()) and at >= done["account"] and (span := account(text, last + 1, text[at : last + 1].lower())):
            found["account"].append(span)
            done["account"] = span[1]
    return [(a, b, k) for k in KINDS for a, b in found[k]]


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the count of each kind, base_sha256, spans."""

    def make():
        anchors = automaton()

        def run(texts: pa.Array) -> dict:
            out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
            for text in common.as_texts(texts):
                found = spans(text, anchors)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[2] == k for s in found))
                out["base_sha256"].append(hashlib.sha256(listed([s for s in found if s[2] in BASE]).encode()).hexdigest())
                out["spans"].append(listed(found))
            return out

        return run

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return common.map_texts(df, id_col, text_col, make, f"{counts}, base_sha256 string, spans string")
