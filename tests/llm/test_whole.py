"""Operators against plain versions of themselves, on whole tables and on very long texts."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import tiktoken
import xxhash

from parzelle.llm import bpe, fingerprints, langid, media, neardup, packing, queries, secrets, token_counts

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def plain_grams(text):
    """Buckets of the n-grams of letters, one text character at a time."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = re.sub(" +", " ", f" {kept} ")
    if not kept.strip():
        return []
    full, out = (1 << 64) - 1, []
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            h = ord(kept[i])
            for c in kept[i + 1 : i + n]:
                h = (h * 0x100000001B3 + ord(c)) & full
            out.append(((h + n) * 0x9E3779B97F4A7C15 & full) >> 48)
    return out


def test_language_query_against_plain_naive_bayes(spark, docs):
    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    counts, texts = defaultdict(Counter), Counter()
    grams = {r["doc_id"]: plain_grams(r["text"] or "") for r in rows}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and not held[r["doc_id"]]:
            counts[r["lang"]].update(grams[r["doc_id"]])
            texts[r["lang"]] += 1
    total = {k: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for k, c in counts.items()}
    found = {r["doc_id"]: r for r in queries.op9_language_id(spark, SF).collect()}
    assert found.keys() == held.keys()
    for doc, own in grams.items():
        assert found[doc]["held_out"] == held[doc]
        if not own:
            assert (found[doc]["lang_pred"], found[doc]["score"]) == ("und", 0.0)
            continue
        prior = {k: math.log(texts[k] / sum(texts.values())) for k in counts}
        evidence = {k: sum(math.log((counts[k][g] + langid.SMOOTHING) / total[k]) for g in own) for k in counts}
        best = max(sorted(counts), key=lambda k: prior[k] + evidence[k])
        scaled = {k: prior[k] + evidence[k] * min(1.0, langid.EVIDENCE / len(own)) for k in counts}
        share = math.exp(scaled[best]) / sum(map(math.exp, scaled.values()))
        assert found[doc]["lang_pred"] == best and abs(found[doc]["score"] - share) < 1e-3


def test_near_duplicates_of_a_larger_table_against_all_pairs(spark):
    table = pq.read_table(f"{LARGER}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    prints = np.array([neardup.simhash(neardup.shingle_hashes((t or "").encode(), 4, 42)) for t in table["text"]], dtype=np.int64).view(np.uint64)
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    order = np.argsort(table["doc_id"])
    for n, i in enumerate(order):
        for j in order[n + 1 :][np.bitwise_count(prints[order[n + 1 :]] ^ prints[i]) <= 4]:
            a, b = top(i), top(j)
            if a != b:
                first, second = sorted((a, b), key=lambda k: table["doc_id"][k])
                root[second] = first
    want = {d: (f"{int(prints[i]):016x}", table["doc_id"][top(i)]) for i, d in enumerate(table["doc_id"])}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash_neardup(spark, LARGER).collect()}
    assert found == want and len({c for _, c in want.values()}) < len(want)


def test_planted_secrets_of_four_shapes(docs):
    encode = bpe.library(queries.RANKS, queries.PATTERN).encode_ordinary
    count = lambda s: len(encode(s))
    r = random.Random(11)
    base62 = string.ascii_letters + string.digits
    shapes = {
        "letters and digits": lambda: "".join(r.choices(base62, k=24)),
        "mixed letters": lambda: "".join(r.choices(string.ascii_letters, k=24)),
        "in a path": lambda: "/users/account/verification/" + "".join(r.choices(base62, k=32)),
        "parts": lambda: "-".join("".join(r.choices(base62, k=20)) for _ in range(2)),
    }
    for name, make in shapes.items():
        hits = 0
        for _ in range(200):
            secret = make()
            text = f"the key is {secret} and nothing else"
            spans = [s for s in secrets.spans(text, count)[1] if s[2] == "random"]
            start = text.index(secret) + secret.rfind("/") + 1
            # both ends: the words of the path stay
            hits += any((a, b) == (start, text.index(secret) + len(secret)) for a, b, _ in spans)
        assert hits >= 180, (name, hits)
    text = "see https://example.com/users/account/verification/confirm/q8Zt3vXk9LmP2sRw7YbN for"
    assert secrets.redacted(text, secrets.spans(text, count)[1]) == "see https://example.com/users/account/verification/confirm/[random] for"
    text = "at /q8Zt3vXk9LmP2sRw7YbN/account/settings/xK3vWq9ZtB7nLp2RmY5c/internationalisation/x"
    assert secrets.redacted(text, secrets.spans(text, count)[1]) == "at [random]/account/settings/[random]/internationalisation/x"
    false = [text[a:b] for row in docs.collect() if (text := row["text"]) for a, b, k in secrets.spans(text, count)[1] if k == "random"]
    runs = sum(len(secrets.RUN.findall(row["text"] or "")) for row in docs.collect())
    assert len(false) <= 0.02 * runs
    names = ["/usr/local/share/applications/firefox", "AbstractSingletonProxyFactoryBean", "https://example.com/de/some-long-article-name", "get_user_account_by_identifier", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "1234567890123456"]
    assert not [s for n in names for s in secrets.spans(f"see {n} here", count)[1] if s[2] == "random"]


def test_very_long_texts_go_through_all_operators(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdeéß漢 ", k=r.randrange(3, 9)))
    long = " ".join(word() for _ in range(300_000)) + " password = hunter2hunter2"
    short = "plain words in a row"
    df = spark.createDataFrame([(1, long), (2, short), (3, long + " end"), (4, "x" * 300_000)], "doc_id long, text string")
    raw = long.encode()
    rows = {x["doc_id"]: x for x in media.digests(df).collect()}
    assert rows[1]["n_bytes"] == len(raw) > 2_000_000 and rows[1]["payload_sha256"] == hashlib.sha256(media.pad(raw)).hexdigest()
    own = tiktoken.Encoding("x", pat_str=queries.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANKS), special_tokens={}).encode_ordinary(long)
    coded = {x["doc_id"]: x for x in bpe.encode_decode(df, queries.RANKS, queries.PATTERN).collect()}
    assert coded[1]["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest() and all(x["lossless"] for x in coded.values())
    assert {x["doc_id"]: x["n_tokens"] for x in token_counts.lengths(df, queries.RANKS, queries.PATTERN).collect()}[1] == len(own)
    pieces = [x for x in packing.pack_documents(df, queries.RANKS, queries.PATTERN).collect() if x["doc_id"] == 1]
    assert sum(x["length"] for x in pieces) == len(own) + 1 == pieces[0]["doc_tokens"]
    near = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df).collect()}
    assert near[1] == near[3] == 1
    prints = {x["doc_id"]: x for x in fingerprints.compare(df).collect()}
    assert prints[3]["first_near"] == 1 and prints[1]["n_chars"] == len(long)
    found = {x["doc_id"]: x for x in secrets.scan(df, queries.RANKS, queries.PATTERN).collect()}
    assert found[1]["n_assign"] == 1 and f"assign:{len(long) - 25}:{len(long)}" in found[1]["spans"]
    model = langid.fit(spark.createDataFrame([(1, "der die das", "de"), (2, "the of and", "en")], "doc_id long, text string, lang string"))
    assert langid.predict(df, model).where("lang_pred IN ('de', 'en')").count() == 4


def test_shingle_hashes_of_a_word_by_word_version():
    text = "A b  C\td e\x0bf É g " * 3
    parts = bytes(x + 32 if 65 <= x <= 90 else x for x in text.encode()).split()
    want = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + 4]), 42) for i in range(len(parts) - 3)]
    assert neardup.shingle_hashes(text.encode(), 4, 42) == want
