import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parzelle.llm import fingerprints, langid, media, queries, secrets, sharding, url_filters

SF = "/root/testdata/sf0.001"


def test_media_round_trip_and_index():
    r = random.Random(1)
    for n in (0, 1, 575, 576, 577, 576 * 8, 576 * 8 + 1, 50_000):
        data = media.pad(r.randbytes(n))
        assert len(data) % 576 == 0 and len(data) >= 576 and set(data[n:]) <= {255}
        found = media.index(made := media.store(data))
        assert found.error is None and found.codec == "raw" and media.payload(made, found) == data
        assert found.duration == len(data) // 576 * media.TICKS and len(found.key) == -(-len(data) // (576 * 8))
        for a, b in zip(*found.key_ranges(), strict=True):
            assert made[a : a + b] in data


def test_media_with_other_tables():
    sizes = [3, 5, 2, 7]
    payload = bytes(range(17))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", b"\0" * 8)), media.full(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 4)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), media.full(b"stz2", struct.pack(">II", 4, 4), bytes([0x35, 0x27])), media.full(b"co64", struct.pack(">IQQ", 2, 8, 16)))
    moov = media.box(b"moov", media.box(b"udta", b"skipped"), media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl))))
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + 17)[:8] + payload + moov
    data = media.box(b"mdat", payload) + struct.pack(">I4s", 0, b"moov") + moov[8:]
    found = media.index(data)
    assert found.error is None and found.codec == "mp4a" and found.sizes.tolist() == sizes
    assert found.offsets.tolist() == [8, 11, 16, 18] and found.duration == 34 and found.key.tolist() == [0, 1, 2, 3]


def track(number, kind, sizes, offset):
    """A track whose samples lie one after the other from an offset; none are listed for an empty list."""
    tkhd = media.full(b"tkhd", struct.pack(">III", 0, 0, number), b"\0" * 68)
    hdlr = media.full(b"hdlr", b"\0" * 4, kind, b"\0" * 13)
    mdhd = media.full(b"mdhd", struct.pack(">IIIII", 0, 0, 1000, 10 * len(sizes), 0))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1" if kind == b"vide" else b"mp4a", b"\0" * 8)), media.full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 1, max(1, len(sizes)), 1)), media.full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), media.full(b"stco", struct.pack(">I", 1 if sizes else 0), struct.pack(">I", offset) if sizes else b""))
    return media.box(b"trak", tkhd, media.box(b"mdia", mdhd, hdlr, media.box(b"minf", stbl)))


def test_media_with_several_tracks(spark):
    data = media.box(b"mdat", bytes(range(30))) + media.box(b"moov", track(1, b"soun", [4, 6], 8), track(2, b"vide", [5, 5, 5], 18))
    found, error = media.tracks(data)
    assert error is None and [t.codec for t in found] == ["mp4a", "avc1"] and [t.offsets.tolist() for t in found] == [[8, 12], [18, 23, 28]]
    assert media.index(data).kind == "vide"
    df = spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, media binary")
    assert [(r["id"], r["track"], r["codec"], r["samples"], r["duration"]) for r in media.media_columns(df, all_tracks=True).orderBy("id", "track").collect()] == [(1, 1, "mp4a", 2, 20), (1, 2, "avc1", 3, 30), (2, None, None, 0, None)]
    assert [(r["id"], r["track"]) for r in media.media_columns(df).orderBy("id").collect()] == [(1, 2), (2, None)]


def test_media_in_fragments():
    trex = media.full(b"trex", struct.pack(">5I", 7, 1, 100, 9, 0x10000))
    head = media.box(b"moov", track(7, b"vide", [], 0), media.box(b"mvex", trex))

    def fragment(*truns, flags=0x20000, extra=b""):
        traf = media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7), extra, flags=flags), *truns)
        return media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), traf)

    # sizes of their own, the first a key frame; then two by default, neither a key frame
    one = lambda at: fragment(media.full(b"trun", struct.pack(">IiI", 3, at, 0), struct.pack(">3I", 5, 6, 7), flags=0x205), media.full(b"trun", struct.pack(">I", 2)))
    first = one(len(one(0)) + 8) + media.box(b"mdat", bytes(36))
    # an offset from the file's beginning; duration, size and flags for each sample
    two = lambda base: fragment(media.full(b"trun", struct.pack(">I", 2), struct.pack(">6I", 50, 3, 0, 60, 4, 0x10000), flags=0x700), flags=1, extra=struct.pack(">Q", base))
    base = len(head) + len(first) + len(two(0)) + 8
    data = head + first + two(base) + media.box(b"mdat", b"abcdefg")
    found = media.index(data)
    at = len(head) + len(first) - 36
    assert found.error is None and found.sizes.tolist() == [5, 6, 7, 9, 9, 3, 4]
    assert found.offsets.tolist() == [at, at + 5, at + 11, at + 18, at + 27, base, base + 3]
    assert found.key.tolist() == [0, 5] and found.duration == 5 * 100 + 50 + 60
    assert media.payload(data, found)[-7:] == b"abcdefg"
    r = random.Random(6)
    for _ in range(300):
        bad = bytearray(data)
        for _ in range(3):
            bad[r.randrange(len(data))] = r.randrange(256)
        media.index(bytes(bad))
        media.index(data[: r.randrange(len(data))])
    assert media.index(head + first[:-1]).error


def test_damaged_media_never_crash(spark):
    r = random.Random(2)
    whole = media.store(media.pad(b"x" * 3000))
    for _ in range(400):
        bad = bytearray(whole)
        for _ in range(3):
            bad[r.randrange(800)] = r.randrange(256)
        media.index(bytes(bad))
        media.index(whole[: r.randrange(len(whole))])
    rows = spark.createDataFrame([(1, bytearray(whole)), (2, None), (3, bytearray(b"junk")), (4, bytearray(b""))], "id long, media binary")
    found = {x["id"]: x for x in media.media_columns(rows).collect()}
    assert found[1]["error"] is None and found[1]["samples"] == 6
    assert found[2]["error"] == "null" and found[3]["error"] and found[4]["error"] == "no sample table"


def test_media_query(spark, plain, odd, none):
    for r in queries.op1_media_columns(spark, SF).collect():
        data = media.pad(plain[r["doc_id"]].encode())
        assert r["n_bytes"] == len(plain[r["doc_id"]].encode()) and r["payload_bytes"] == len(data)
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-32:])
        made, n = media.store(data), len(data) // 576
        # the payload is the end of the file, frame after frame, with a key frame every eight
        assert made.endswith(data) and r["media_bytes"] == len(made) and r["media_sha256"] == hashlib.sha256(made).hexdigest()
        keys = ",".join(f"{len(made) - len(data) + 576 * k}+576" for k in range(0, n, 8))
        assert r["feature"] == f"codec=raw;timescale=24000;duration={1000 * n};samples={n};keyframes={keys}"
    assert media.digests(odd).count() == odd.count() and media.digests(none).count() == 0
    by_text = {}
    for r in media.digests(odd).collect():
        assert by_text.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def slow_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1] + best[2])):
            best = (verdict, h, p)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_urls_against_rule_by_rule(spark, none):
    urls = [None, "", "no scheme/en/", "http://", "http://COM/en/x", "http://a.com/en/?q=/de/", "http://xcom/en/", "http://a.b.example.com/en/7#x", "http://example.net/de/81", "http://x.org/en/a.com/en/", "HTTP://É.Org/es/é", "a://b://c.com/en/1", "http://com?/en/", "http://u@com:80/en/", "http://a.com/en/" + "long" * 5000, "http://" + "a." * 3000 + "net/de/\nx"]
    r = random.Random(6)
    urls += ["http://" + ".".join(r.choice(["com", "net", "org", "example", "a"]) for _ in range(r.randrange(1, 5))) + "/" + "/".join(r.choice(["en", "de", "es", "7", "8", ""]) for _ in range(3)) for _ in range(800)]
    rules = queries.RULES + [("block", f"host{i}.example", "/" + "p" * i) for i in range(30)]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, id string, host int")
    for row in url_filters.judge(df, rules).collect():
        assert tuple(row)[1:] == slow_rule(urls[row["page_id"]], rules), urls[row["page_id"]]
    assert url_filters.judge(df, []).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert url_filters.judge(df.limit(0), rules).count() == 0


def test_rules_of_the_contract(spark):
    listed = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(h, p): verdict for verdict, h, p in queries.RULES} == listed
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/7", "http://x.example.net/de/8", "http://a.org/es/", "http://a.org/en/", None]
    found = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES)
    got = [r["verdict"] for r in found.orderBy("page_id").collect()]
    assert got == ["block", "allow", "allow", "allow", "block", "block", "allow", "allow"]


def test_many_rules_are_dealt_by_host():
    r = random.Random(3)
    labels = ["com", "net", "a", "b", "shop", "www", "x1"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randrange(1, 5)))
    path = lambda: r.choice(["", "/", "/en/", "/en/7", "/de"])
    rules = [("block", host(), path()) for _ in range(300)] + [("allow", "", "/de")]
    urls = [(host() if r.random() < 0.95 else "", path() + r.choice(["", "x", "/y"])) for _ in range(600)]
    fits = lambda rule, h, p: (not rule[1] or h == rule[1] or h.endswith("." + rule[1])) and p.startswith(rule[2])
    for most in (1, 7, 1000):
        dealt = url_filters.Dealt([x for x in rules if x[1]], most)
        assert most == 1000 or len(dealt.parts) > 10
        want = [next((k for k, rule in enumerate(dealt.rules) if fits(rule, h, p)), -1) for h, p in urls]
        assert dealt.fits(*map(list, zip(*urls, strict=True))) == want
        assert all(len(a.final) == 2 * len(n) for a, n in dealt.made.values())


def test_globs_against_regular_expressions():
    r = random.Random(7)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(r.randrange(1, 12))) for _ in range(60)]
    strings = ["".join(r.choice("ab/") for _ in range(r.randrange(0, 20))) for _ in range(300)]
    hits = url_filters.Automaton([url_filters.parse(g) for g in globs]).run([s.encode() for s in strings])
    for j, g in enumerate(globs):
        pattern = re.compile(re.sub(r"\*\*|\*|\?", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}[m[0]], g), re.S)
        assert hits[:, j].tolist() == [bool(pattern.fullmatch(s)) for s in strings], g


def slow_secrets(text):
    found = []
    pattern = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets_against_plain_patterns(spark, plain, odd, none):
    for r in queries.op8_secret_scans(spark, SF).collect():
        base = slow_secrets(plain[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert secrets.scan(odd, queries.RANKS, queries.PATTERN).where("n_assign = 1 and n_access = 1").count() == 1
    assert secrets.scan(none, queries.RANKS, queries.PATTERN).count() == 0
    r = random.Random(8)
    for _ in range(2000):
        text = "".join(r.choice(["password", "Token", "API_key", "apikey", "=", ": ", '"', "'", " ", "AKIA", "0123456789abcdef", "x", "ABCDEFGH12", "ſecret", "é", "\n"]) for _ in range(12))
        assert secrets.listed(secrets.base_spans(text)) == slow_secrets(text)


def test_random_strings_but_no_digests_or_names():
    from parzelle.llm import bpe

    encode = bpe.library(queries.RANKS, queries.PATTERN).encode_ordinary
    kinds = lambda t: [k for *_, k in secrets.spans(t, lambda s: len(encode(s)))[1]]
    assert kinds("use q8Zt3vXk9LmP2sRw7YbN now") == ["random"]
    assert kinds("id 550e8400-e29b-41d4-a716-446655440000 and 20240101-123456-000017") == []
    assert kinds("D41D8CD98F00B204E9800998ECF8427E some_long_variable_name_here internationalisation") == []
    assert secrets.redacted("a password=abcdefgh1 b", secrets.base_spans("a password=abcdefgh1 b")) == "a [assign] b"


def test_random_letters_are_random_strings():
    from parzelle.llm import bpe

    encode = bpe.library(queries.RANKS, queries.PATTERN).encode_ordinary
    found = lambda t: secrets.spans(t, lambda s: len(encode(s)))[1]
    for x in ("qzkxvbnwpltrjhgfdsmcqyxzkwvbtnpr", "XqZkVbNwPlTrJhGfDsMcQyRxKwVbTnPz", "qzkx-vbnw-pltr-jhgf-dsmc"):
        assert found(f"use {x} now") == [(4, 4 + len(x), "random")]
    r = random.Random(10)
    for n, least in ((26, 470), (52, 500)):
        drawn = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[:n], k=32)) for _ in range(500)]
        assert sum(bool(found(x)) for x in drawn) >= least
    for x in ("getElementsByTagName", "kubernetes-dashboard-deployment", "/usr/local/lib/python/my-kqv-lib-to-use", "a/b/c/d/e/f/g/h/i/j", "-" * 40, "landwirtschaftlich", "Grundstuecksverkehrsgenehmigung", "dieeinkeitgekeit", "1234-5678-9012-3456"):
        assert found(x) == []


def test_random_strings_among_other_parts_of_a_run():
    from parzelle.llm import bpe

    encode = bpe.library(queries.RANKS, queries.PATTERN).encode_ordinary
    found = lambda t: secrets.spans(t, lambda s: len(encode(s)))[1]
    text = "/files/0123456789abcdef0123456789abcdef/q8Zt3vXk9LmP2sRw7YbN"
    assert found(text) == [(7, 39, "hex"), (39, 60, "random")]
    assert secrets.redacted(text, found(text)) == "/files/[hex][random]"
    r = random.Random(11)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for path in ("/users/account/verification/confirm/", "/users/account/verification/confirm/internationalisation/administration/responsibilities/"):
        for _ in range(200):
            key = "".join(r.choices(base62, k=24))
            assert any(b == len(path) + 24 and a <= len(path) for a, b, _ in found(path + key)), key
    path = "/users/account/verification/confirm/internationalisation/administration/"
    assert found(path + "q8Zt3vXk-9LmP2sRw7YbN/settings") == [(len(path), len(path) + 21, "random")]
    assert found(path + "550e8400-e29b-41d4-a716-446655440000") == found(path + "D41D8CD98F00B204E9800998ECF8427E") == []


def test_redact_keeps_rows_and_columns(odd):
    out = secrets.redact(odd, queries.RANKS, queries.PATTERN)
    assert out.schema == odd.schema and out.count() == odd.count()
    row = out.where("doc_id = 8").first()
    assert row["text"] == "[assign]\" and [access]" and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 2 and text is null and n_chars is null").count() == 1


def test_languages_on_held_out_documents(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(odd, none):
    model = langid.fit(odd)
    assert model.langs == ["de", "en"]
    found = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [found[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and found[7]["lang_pred"] == "en"
    empty = langid.fit(none)
    assert empty.langs == [] and {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
    kept = langid.keep_known(odd, model)
    assert kept.schema == odd.schema and kept.where("doc_id in (2, 3, 4)").count() == 0


def test_scores_do_not_depend_on_the_batch(odd):
    model = langid.fit(odd)
    texts = [r["text"] for r in odd.collect()]
    together = langid.score_batch(texts, model)
    apart = [langid.score_batch([t], model) for t in texts]
    assert together[0] == [a[0][0] for a in apart] and together[1] == pytest.approx([a[1][0] for a in apart])


def check_shards(rows, texts, shards, fixed=None):
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= largest


def test_shards_are_near_equal(spark, plain, docs):
    rows = queries.op6_sharding(spark, SF).collect()
    check_shards(rows, plain, 24)
    for r in rows:
        data = plain[r["doc_id"]].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(docs.repartition(7), 24).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows}


def test_ranges_of_keys(spark):
    r = np.random.default_rng(4)
    keys = [-(2**63), 2**63 - 1, 0, *r.integers(-(2**63), 2**63 - 1, size=300).tolist()]
    for n in (0, 1, 2, 3, 10, 200):
        cuts = np.unique(np.array(keys[:n], dtype=np.int64))
        rows = sharding._in_ranges(spark.createDataFrame([(k,) for k in keys], "key long"), cuts).collect()
        assert [x["part"] for x in rows] == np.searchsorted(cuts, [x["key"] for x in rows], side="right").tolist()


def test_a_hot_group_is_split(spark):
    rows = spark.createDataFrame([(i, "copy" * 20 if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    check_shards(sharding.shard(rows, 8).collect(), range(3000), 8)


def test_a_column_of_too_many_languages_is_refused(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="3000 different values"):
        langid.fit(rows)


def test_copies_of_one_row_are_spread(spark):
    """12,000 of 20,000 rows are one row: no range holds them all."""
    rows = spark.createDataFrame([(7, "the same " * 5)] * 12_000 + [(i, f"text {i}") for i in range(8000)], "doc_id long, text string").repartition(5)
    out = sharding.shard(rows, 24).collect()
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(24)]
    assert len(out) == 20_000 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    keyed = rows.select(sharding.shard_key(F.col("text"), F.col("doc_id").cast("string"), F.monotonically_increasing_id()).alias("key"))
    assert keyed.groupBy("key").count().agg(F.max("count")).first()[0] <= 30


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == odd.count()
    for s in range(3):
        own = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))
    assert sharding.shard(none, 3).count() == 0


def slow_fingerprint(text):
    """By the definition, term by term and bit by bit."""
    full = (1 << 64) - 1
    words = text.lower().encode().split() if text.isascii() else bytes(x + 32 if 65 <= x <= 90 else x for x in text.encode()).split()
    votes = np.zeros(256, int)
    before, size_before = 0x1234567, 0
    for word in words:
        own = xxhash.xxh64_intdigest(word, 1)
        term, weight = (own * 0x9E3779B97F4A7C15 + before) & full, min(len(word) + size_before, 16)
        bits = b""
        for lane in range(1, 5):
            x = (term + lane * 0xD1B54A32D192ED03) & full
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
            bits += (x ^ x >> 31).to_bytes(8, "little")
        votes += weight * (2 * np.unpackbits(np.frombuffer(bits, np.uint8)).astype(int) - 1)
        before, size_before = own, len(word)
    return sum(int(v > 0) << 255 - k for k, v in enumerate(votes))


def slow_compare(rows, radius=7):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    like = lambda x, y: max(0.0, math.cos(math.pi * (x ^ y).bit_count() / 256))
    prints = [slow_fingerprint(t) for _, t in rows]
    for i, (doc, text) in enumerate(rows):
        k = (i + 1) % len(rows)
        n = len(text) // 4
        new = text[: len(text) - n] + rows[k][1][:n]
        a, b = prints[i], slow_fingerprint(new)
        first = min((d for (d, _), x in zip(rows, prints, strict=True) if d is not None and (x ^ a).bit_count() <= radius), default=None)
        yield doc, len(text), hashlib.sha256(new.encode()).hexdigest(), f"{a:064x}", f"{b:064x}", like(a, b), like(a, prints[k]), first


def test_fingerprints_of_edited_texts(spark, plain, odd, none):
    found = sorted(map(tuple, queries.op5_fingerprints(spark, SF).collect()))
    want = sorted(slow_compare(list(plain.items())))
    assert [r[:5] + r[7:] for r in found] == [r[:5] + r[7:] for r in want]
    assert np.allclose([r[5:7] for r in found], [r[5:7] for r in want], atol=1e-12)
    assert sum(r[7] != r[0] for r in found) > 5
    assert np.mean([r[5] for r in found]) > 0.6 > 0.3 > np.mean([r[6] for r in found])
    key = lambda r: (r[0] is not None, str(r[:5] + r[7:]))
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    got, want = sorted(map(tuple, fingerprints.compare(odd).collect()), key=key), sorted(slow_compare(rows), key=key)
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in want]
    assert np.allclose([r[5:7] for r in got], [r[5:7] for r in want], atol=1e-12)
    assert fingerprints.compare(none).count() == 0
    one = fingerprints.compare(odd.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_block_tables_find_all_neighbours(spark):
    r = random.Random(9)
    prints = [r.randbytes(32) for _ in range(60)]
    for _ in range(200):
        x = int.from_bytes(r.choice(prints))
        for _ in range(r.randrange(12)):
            x ^= 1 << r.randrange(256)
        prints.append(x.to_bytes(32))
    df = spark.createDataFrame([(bytearray(x),) for x in [*prints, prints[0]]] + [(None,)], "fingerprint binary")
    distinct = sorted(set(prints))
    apart = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    ids = {x: i for i, x in enumerate(distinct)}
    named = spark.createDataFrame([(i, bytearray(x)) for x, i in ids.items()] + [(None, bytearray(distinct[3]))], "id long, fp binary")
    for radius, extra, hot in ((8, 1, 20_000), (5, 2, 20_000), (8, 1, 3)):
        first = {x: min(i for y, i in ids.items() if apart(x, y) <= radius) for x in distinct}
        assert {bytes(x["fp"]): x["first_near"] for x in fingerprints.first_near(named, radius, extra, hot=hot).collect()} == first
        want = {(a, b, apart(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if apart(a, b) <= radius}
        assert {(bytes(x["a"]), bytes(x["b"]), x["apart"]) for x in fingerprints.neighbours(df, radius, extra, hot=hot).collect()} == want
