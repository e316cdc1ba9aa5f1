import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from parzelle.llm import bpe, packing, queries, token_counts

RANKS, PATTERN = queries.RANKS, queries.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS), PATTERN)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_transducer_equals_the_library_on_odd_texts(encoder, library):
    r = random.Random(3)
    alphabet = "ab  \n\t'stre.,!é漢0123  \r\x1c\x85AKIAz-_🙂²\u3000\u200b"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["", "a" * 5000, "\n" * 700, " " * 300, "<|endoftext|>", "thethethe" * 200, "0" * 999]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [ids(x) for x in encoder.encode(part)] == [library.encode_ordinary(t) for t in part]


def test_transducer_starts_anew_when_full(monkeypatch, library):
    monkeypatch.setattr(bpe, "TRANSITIONS", 300)
    monkeypatch.setattr(bpe, "CHUNKS", 10)
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(200)]
    small = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN)
    for at in range(0, 200, 20):
        assert [ids(x) for x in small.encode(texts[at : at + 20])] == [library.encode_ordinary(t) for t in texts[at : at + 20]]


def test_each_token_encodes_to_itself_and_borders_are_right(encoder):
    t = encoder.transducer
    r = random.Random(5)
    for _ in range(3000):
        a, b = r.randrange(50256), r.randrange(50256)
        assert t.merged(t.tokens[a]) == [a]
        assert t.fit(a, b) == (t.merged(t.tokens[a] + t.tokens[b]) == [a, b])


def test_stream_decodes_characters_that_span_tokens(encoder):
    text = "漢字 🙂🙂 é ÄÖ plain"
    pieces = list(encoder.stream(ids(encoder.encode([text])[0])))
    assert "".join(pieces) == text and len(pieces) > 3
    half = ids(encoder.encode(["🙂"])[0])[:-1]
    assert "".join(encoder.stream(half)).startswith("\ufffd")


def test_blocks_hand_over_open_characters(encoder, monkeypatch):
    text = "漢字 🙂🙂 é ÄÖ plain"
    coded = encoder.encode([text])[0]
    for size in (1, 2, 3, 1000):
        monkeypatch.setattr(bpe, "BLOCK", size)
        assert "".join(encoder.blocks(coded)) == text
    assert "".join(encoder.blocks(b"")) == "" and "".join(encoder.blocks(encoder.encode(["🙂"])[0][:-4])).endswith("\ufffd")


def test_query_equals_library(spark, plain, library):
    found = {r["doc_id"]: r for r in queries.op7_byte_bpe(spark, SF).collect()}
    assert found.keys() == plain.keys()
    for doc, text in plain.items():
        own = np.array(library.encode_ordinary(text), "<u4")
        assert found[doc]["n_tokens"] == len(own)
        assert found[doc]["ids_sha256"] == hashlib.sha256(own.tobytes()).hexdigest()
        assert found[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_odd_rows(odd, none):
    rows = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert bpe.encode_decode(none, RANKS, PATTERN).count() == 0
    assert bpe.encode_decode(odd, RANKS, PATTERN).where("not lossless").count() == 0


def check_pieces(rows, texts, encode):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    padding = 0
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        at = 0
        for r in held:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len(held) <= packing.SEGMENTS and sum(r["loss"] for r in held) <= packing.LOSS
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    wanted = Counter()
    for doc, text in texts:
        wanted[doc, len(encode(text or "")) + 1] += 1
    for key, n in wanted.items():
        assert sum(r["length"] for r in by_doc[key]) == key[1] * n
    assert sum(map(len, by_doc.values())) == len(rows) and by_doc.keys() == wanted.keys()
    return padding


def test_packing_covers_each_id_once(spark, plain):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    rows = queries.op3_packing(spark, SF).collect()
    assert check_pieces(rows, plain.items(), encode) < 0.005 * sum(r["length"] for r in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert max(sum(r["loss"] for r in held) for held in by_sequence.values()) == packing.LOSS
    for doc, text in plain.items():
        own = np.array([*encode(text), 1], "<u4").tobytes()
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(own[at * 4 : (at + r["length"]) * 4])
            at += r["length"]
        assert at * 4 == len(own)


def test_packing_of_odd_rows(odd, none, library):
    rows = packing.pack_documents(odd, RANKS, PATTERN).collect()
    assert check_pieces(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], library.encode_ordinary) <= packing.PAD * len(rows)
    assert packing.pack_documents(none, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize(("pad", "least"), [(0, 1), (64, 32), (3, 2)])
@pytest.mark.parametrize("limits", [(2048, 256, 2048), (2048, 12, 2040), (64, 3, 40), (10, 2, 3), (5, 1, 1)])
def test_pack_keeps_all_limits(limits, pad, least):
    r = random.Random(sum(limits))
    for _ in range(30 if limits[0] > 20 else 2):
        pieces = [(i, 0, n := r.choice([1, 2, 5, 700, 3000, r.randrange(1, 300)]), r.randrange(n + 1)) for i in range(r.randrange(60))]
        done, left = packing.pack(pieces, limits, pad=pad, least=least)
        assert not left
        parts = defaultdict(list)
        for sequence in done:
            total = sum(p[2] for p in sequence)
            assert total <= limits[0] and len(sequence) <= limits[1] and sum(p[3] for p in sequence) <= limits[2]
            assert limits[0] - total <= pad or total & (total - 1) == 0
            for p in sequence:
                parts[p[0]].append(p)
        for item, _, n, loss in pieces:
            at = 0
            for p in sorted(parts[item], key=lambda p: p[1]):
                assert p[1] == at
                at += p[2]
            assert at == n and sum(p[3] for p in parts[item]) == loss


def test_choice_is_the_largest_dot_product():
    """Items that all fit some sequence: what each sequence gets, item by item, against a search of all items left."""
    r = random.Random(4)
    limits = (100, 5, 60)
    for _ in range(40):
        pieces = [(i, 0, n := r.randrange(1, 60), r.randrange(n + 1)) for i in range(r.randrange(1, 50))]
        # least is larger than any item, so nothing is cut to fill a rest; pad lets every sequence end where it does
        done, _ = packing.pack(pieces, limits, pad=100, least=1000)
        rest = [p[2:] for p in pieces]
        for sequence in done:
            left = list(limits)
            for _, _, n, loss in sequence:
                score = lambda need: sum(a * b / c / c for a, b, c in zip((need[0], 1, need[1]), left, limits, strict=True))  # noqa: B023, E731
                fitting = [x for x in rest if x[0] <= left[0] and x[1] <= left[2]]
                assert abs(score((n, loss)) - max(map(score, fitting))) < 1e-9
                rest.remove((n, loss))
                left = [left[0] - n, left[1] - 1, left[2] - loss]
            assert left[1] == 0 or not any(x[0] <= left[0] and x[1] <= left[2] for x in rest)
        assert not rest


def test_packing_takes_added_tokens_as_the_tokenizer_does(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(12)
    parts = ["<|endoftext|>", "<|endof", "text|>", "a", " b", "  ", "\n", "'s", "1", "é", "<|", " \t "]
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 3, "x  <|endoftext|>  y", *("".join(r.choices(parts, k=r.randrange(1, 12))) for _ in range(300))]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), RANKS, PATTERN).collect()
    wanted = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert wanted[0] == [64, 220, 50256, 275, 1]
    assert {r["doc_id"] for r in rows} == wanted.keys() and sum(r["length"] for r in rows) == sum(map(len, wanted.values()))
    for x in rows:
        own = wanted[x["doc_id"]]
        assert x["doc_tokens"] == len(own)
        assert x["ids_crc32"] == zlib.crc32(np.array(own[x["start"] : x["start"] + x["length"]], "<u4").tobytes())


def test_windows_hand_over(monkeypatch, odd, library):
    monkeypatch.setattr(packing, "WINDOW_ROWS", 1)
    rows = packing.pack_documents(odd.coalesce(1), RANKS, PATTERN).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], library.encode_ordinary)


def test_histogram_answers_every_limit(spark, plain, library):
    found = sorted(queries.op4_token_counts(spark, SF).collect(), key=lambda r: r["n_tokens"])
    sizes = [len(library.encode_ordinary(t)) for t in plain.values()]
    assert [r["n_tokens"] for r in found] == sorted(set(sizes))
    for r in found:
        n = r["n_tokens"]
        assert r["docs"] == sizes.count(n) and r["docs_ge"] == sum(x >= n for x in sizes)
        assert r["tokens_ge"] == sum(x for x in sizes if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in sizes)
        assert r["share_le"] == pytest.approx(sum(x <= n for x in sizes) / len(sizes))
    for c in (1, 37, 500, 2048):
        low = next((r for r in reversed(found) if r["n_tokens"] <= c), None)
        high = next((r for r in found if r["n_tokens"] > c), None)
        base, at = (low["truncated_total"], low["n_tokens"]) if low else (0, 0)
        assert base + (c - at) * (high["docs_ge"] if high else 0) == sum(min(x, c) for x in sizes)


def test_histogram_of_odd_rows(odd, none, library):
    found = token_counts.histogram(token_counts.lengths(odd, RANKS, PATTERN)).collect()
    assert sum(r["docs"] for r in found) == odd.count()
    assert max(r["docs_ge"] for r in found) == odd.count()
    assert token_counts.histogram(token_counts.lengths(none, RANKS, PATTERN)).count() == 0


def test_conversations_are_packed_whole_under_all_limits(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = rows.unionByName(spark.createDataFrame([(-1, t, "assistant", "word " * 3000) for t in range(2)] + [(-2, 0, None, None), (-3, 1, "user", "Hi."), (-3, 0, "assistant", "Ho.")], rows.schema))
    library = packing.bpe.library(RANKS, PATTERN)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        ids = [*library.encode_ordinary(r["text"] or ""), 1]
        want.setdefault(r["conv_id"], []).extend((x, r["role"] == "assistant") for x in ids)
    found = packing.pack_conversations(rows, RANKS, PATTERN).collect()
    by_sequence, by_conv = {}, {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_conv.setdefault(r["conv_id"], []).append(r)
        own = want[r["conv_id"]][r["start"] : r["start"] + r["length"]]
        assert r["loss"] == sum(b for _, b in own) and r["conv_tokens"] == len(want[r["conv_id"]])
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x, _ in own))
    assert by_conv.keys() == want.keys()
    for c, held in by_conv.items():
        held.sort(key=lambda r: r["start"])
        assert [r["start"] for r in held] == [sum(x["length"] for x in held[:i]) for i in range(len(held))] and sum(r["length"] for r in held) == len(want[c])
        small = len(want[c]) <= packing.TOKENS and sum(b for _, b in want[c]) <= packing.CHAT_LOSS
        assert len(held) == 1 or not small
    for held in by_sequence.values():
        assert sum(r["length"] for r in held) <= packing.TOKENS and len(held) <= packing.SEGMENTS and sum(r["loss"] for r in held) <= packing.CHAT_LOSS
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [sum(x["length"] for x in held[:i]) for i in range(len(held))]
    # no more sequences than in the order of the table, each put where it first fits
    order: list[list[int]] = []
    for r in sorted(found, key=lambda r: (r["conv_id"], r["start"])):
        for s in order:
            if s[0] + r["length"] <= packing.TOKENS and s[1] < packing.SEGMENTS and s[2] + r["loss"] <= packing.CHAT_LOSS:
                s[0], s[1], s[2] = s[0] + r["length"], s[1] + 1, s[2] + r["loss"]
                break
        else:
            order.append([r["length"], 1, r["loss"]])
    assert len(by_sequence) <= len(order)
    # and few more than any packing needs
    least = max(sum(map(len, want.values())) / packing.TOKENS, sum(b for v in want.values() for _, b in v) / packing.CHAT_LOSS)
    assert len(by_sequence) <= 1.15 * least + 4
