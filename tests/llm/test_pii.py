"""Personal data by anchors against the plain patterns, on all texts and on made-up hard ones."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from parzelle.llm import pii, queries

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ANCHORS = pii.automaton()


def valid(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in p.finditer(text) if valid(k, m[0])]


def base(text):
    return [s for s in pii.spans(text, ANCHORS) if s[2] in pii.BASE]


PIECES = ["4417744280351547", "4952 9359 0025-3052", "129.38.82.176", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "+1 (017) 555-7713", "+49-30.12345678", "++1", "a.b@c.d", "x@y", "@", ".", "..", " ", "-", "--", "(", ")", "+", "%", "_", "é", "🙂", "٣", "1", "22", "0", "\n", "iban", "://", "http://u:p@h.de"]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.text(alphabet="0123456789.-+@ ()ab_é", max_size=60)))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


def test_very_long_runs_are_gone_through_once():
    """Short forms equal the patterns; long ones, which some patterns need the square of, end."""
    for make in (lambda n: "1" * n, lambda n: "1." * n + "1", lambda n: "1 " * n, lambda n: "a" * n + "@x.y", lambda n: "a@b." * n, lambda n: "+1" + " " * n + "2", lambda n: "+1" * n, lambda n: "x@" + "a." * n + "b", lambda n: "://" * n):
        assert base(make(500)) == plain(make(500))
        assert base(make(200_000)) is not None


@pytest.mark.parametrize(
    "text,span",
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 bitte", ("DE89 3704 0044 0532 0130 00", "account")),
        ("my iban GB82WEST12345698765432.", ("GB82WEST12345698765432", "account")),
        ("IBAN DE89 3704 0044 0532 0130 01", None),
        ("SSN 123-45-6789,", ("123-45-6789", "account")),
        ("ssn: 000-45-6789", None),
        ("Account number: 12345678-90 is", ("12345678-90", "account")),
        ("on account of 3 things", None),
        ("accountable 123456789", None),
        ("see https://ann:secret@host.example.com/x", ("https://ann:secret@host.example.com", "address")),
        ("see https://host.example.com/x@y", None),
        ("ftp://@host", None),
    ],
)
def test_added_spans(text, span):
    added = [(text[a:b], k) for a, b, k in pii.spans(text, ANCHORS) if k not in pii.BASE]
    assert added == ([span] if span else [])


def test_query_equals_the_patterns_on_all_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_pii(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in want) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == [f"{k}:{a}:{b}" for a, b, k in want]
        assert len(spans) == len(want) + r["n_address"] + r["n_account"]
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows) > 0


def test_odd_rows(spark, odd, none):
    rows = pii.scan(odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] is not None for r in rows)
    assert {r["spans"] for r in rows if r["doc_id"] in (2, 3)} == {""}
    assert pii.scan(none).collect() == []
