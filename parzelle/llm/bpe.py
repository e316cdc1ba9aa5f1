"""Byte-level BPE as a lazily determinised finite-state transducer, and an incremental decoder.

How encoding works. A token sequence is a valid encoding exactly if each neighbouring pair is one, so the encoding of
every prefix of a piece ends in one token that fits the token before it. The transducer reads a piece byte by byte. A
state holds, for each position from which a token may still grow, the place in the vocabulary's trie, the last token
before that position and the tokens that are not yet certain; what all these paths share is emitted at once. The
lookahead is therefore bounded by the longest token. States and transitions are made when first needed and kept.

Pieces are the matches of the pattern. A space in front of a character that isn't white space always starts a piece, so
texts are cut there with str.split and whole chunks are looked up in a bounded table of chunks seen before. The pieces
of a batch that are not in it take their steps through the transducer together, as numpy arrays of states.

Cases. Null and empty texts have no ids. A text may hold any characters; special tokens' strings are ordinary text. Very
long texts are encoded whole and decoded in blocks. Repeated rows are encoded each; an empty table gives no rows. Only
the id and text columns are read, so others can have any names. Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from parzelle.llm import common

#: Bounds of what a worker keeps: chunks with their ids, and transitions. Each table starts anew when it is full.
CHUNKS, TRANSITIONS = 250_000, 300_000
#: Longer chunks are encoded each time; longer pieces go through the transducer one by one.
CHUNK_CHARS, PIECE_BYTES = 48, 200
#: Ids that are decoded at once.
BLOCK = 4096
#: A text in which a space stands before white space or the end, or which has a character that Python and Unicode
#: classify differently as white space, is cut by the pattern alone.
UNEVEN = re.compile(r" (?:\s|\Z)|[\x1c-\x1f]")
#: Multiplier of the hash over transitions: 2**64 divided by the golden ratio.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        inner, nodes = set(), 1
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                inner.add(node)
                if (after := self.child.get(key)) is None:
                    after = self.child[key] = nodes
                    nodes += 1
                node = after
            self.token_at[node] = rank
        self.inner = inner
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list] = {}
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: Hash table of transitions, open addressing: state and byte, then the number of the transition.
        self.bits = max(12, (2 * TRANSITIONS).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        #: By transition: the state behind it and what it emits; by state: what the end of the piece emits.
        self.to, self.emit, self.last = _Ints(), _Ints(), _Ints()
        #: What is emitted, by number: tokens, one after the other. Number 0 is nothing.
        self.outs, self.out_at, self.out_n, self.flat = {(): 0}, _Ints([0]), _Ints([0]), _Ints()
        self.of(((0, -1, ()),))

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: always join the leftmost pair of lowest rank. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def spine(self, token: int, right: bool) -> list[tuple[int, bytes, int]]:
        """What stood at that edge of the token while it was built, from the whole down to a byte: the rank at which it came to be, the part, the rank at which it was joined."""
        if (known := self.spines.get((token, right))) is None:
            part, until, known = self.tokens[token], 1 << 40, []
            while True:
                rank = self.ranks[part] if len(part) > 1 else -1
                known.append((rank, part, until))
                if rank < 0:
                    break
                part, until = self.halves(part)[right], rank
            self.spines[token, right] = known
        return known

    def halves(self, data: bytes) -> tuple[bytes, bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def fit(self, last: int, token: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes: no join across the border comes first at any time."""
        if last < 0:
            return True
        key = last << 20 | token
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > TRANSITIONS:
                self.fits.clear()
            left, right = self.spine(last, True), self.spine(token, False)
            i = j = 0
            known = True
            while i < len(left) and j < len(right):
                a, x, a_end = left[i]
                b, y, b_end = right[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < a_end and rank <= b_end:
                    known = False
                    break
                if a > b:
                    i += 1
                else:
                    j += 1
            self.fits[key] = known
        return known

    def move(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        paths, ended = [], None
        child, token_at, inner = self.child, self.token_at, self.inner
        for node, last, held in state:
            after = child.get(node << 8 | byte)
            if after is None:
                continue
            token = token_at.get(after)
            if ended is None and token is not None and self.fit(last, token):
                ended = (0, token, (*held, token))
            if after in inner:
                paths.append((after, last, held))
        if ended:
            paths.append(ended)
        if not paths:
            raise ValueError("the vocabulary lacks a byte")
        if len(paths) == 1:
            node, last, sure = paths[0]
            return ((node, last, ()),), sure
        first, n = paths[0][2], 0
        while n < len(first) and all(len(p[2]) > n and p[2][n] == first[n] for p in paths):
            n += 1
        return (tuple((node, last, held[n:]) for node, last, held in paths) if n else tuple(paths)), first[:n]

    def of(self, state: tuple) -> int:
        if (n := self.number.get(state)) is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            self.last.add(self.out(next((held for node, _, held in state if not node), ())))
        return n

    def out(self, tokens: tuple[int, ...]) -> int:
        if (n := self.outs.get(tokens)) is None:
            n = self.outs[tokens] = len(self.outs)
            self.out_at.add(self.flat.n)
            self.out_n.add(len(tokens))
            for token in tokens:
                self.flat.add(token)
        return n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the transitions, -1 where there is none yet."""
        mask = (1 << self.bits) - 1
        at = ((keys.astype(np.uint64) * GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.where((there := self.keys[at]) == keys, self.values[at], -1)
        rest = np.flatnonzero((there != keys) & (there != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & mask
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            found[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return found

    def learn(self, key: int) -> int:
        to, sure = self.move(self.states[key >> 8], key & 255)
        n = self.to.n
        self.to.add(self.of(to))
        self.emit.add(self.out(sure))
        mask = (1 << self.bits) - 1
        at = (key * int(GOLDEN) & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[at] != -1:
            at = at + 1 & mask
        self.keys[at], self.values[at] = key, n
        return n

    def one(self, data: bytes) -> list[int]:
        """A single piece of any length; nothing is kept but the current state."""
        state, out = ((0, -1, ()),), []
        known: dict[tuple, tuple] = {}
        for byte in data:
            if (step := known.get((state, byte))) is None:
                if len(known) > 4096:
                    known.clear()
                step = known[state, byte] = self.move(state, byte)
            state, sure = step
            out += sure
        return out + list(next((held for node, _, held in state if not node), ()))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, four bytes each. All pieces take their steps together."""
        long = [i for i, x in enumerate(pieces) if len(x) > PIECE_BYTES]
        if long:
            found = self.encode([b"" if len(x) > PIECE_BYTES else x for x in pieces])
            for i in long:
                found[i] = np.array(self.one(pieces[i]), dtype="<u4").tobytes()
            return found
        if self.to.n >= TRANSITIONS:
            self.forget()
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(pieces) + b"\0", dtype=np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        ordered = -sizes[order]
        state = np.zeros(len(pieces), dtype=np.int64)
        who, what = [], []
        for step in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(ordered, -step, side="left"))
            keys = state[:n] << 8 | data[starts[:n] + step]
            moved = self.find(keys)
            new = np.flatnonzero(moved < 0)
            if len(new):
                fresh, back = np.unique(keys[new], return_inverse=True)
                if self.to.n + len(fresh) >= 2 * TRANSITIONS:
                    self.forget()  # more than fits: these pieces begin again, in halves
                    half = len(pieces) // 2
                    return self.encode(pieces[:half]) + self.encode(pieces[half:]) if half else [np.array(self.one(x), dtype="<u4").tobytes() for x in pieces]
                moved[new] = np.array([self.learn(int(k)) for k in fresh])[back]
            state[:n] = self.to.all[moved]
            sure = self.emit.all[moved]
            some = np.flatnonzero(sure)
            who.append(some)
            what.append(sure[some])
        who.append(np.arange(len(pieces)))
        what.append(self.last.all[state])
        by, out = np.concatenate(who), np.concatenate(what)
        out = out[(kept := np.argsort(order[by], kind="stable"))]
        by = order[by][kept]
        n = self.out_n.all[out]
        ids = self.flat.all[np.repeat(self.out_at.all[out] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(by, weights=n, minlength=len(pieces))) * 4).astype(np.int64).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]


class _Ints:
    """A growing array."""

    def __init__(self, values: Iterable[int] = ()):
        self.n, self.all = 0, np.zeros(1024, dtype=np.int64)
        for x in values:
            self.add(x)

    def add(self, x: int) -> None:
        if self.n == len(self.all):
            self.all = np.concatenate([self.all, np.zeros(self.n, dtype=np.int64)])
        self.all[self.n] = x
        self.n += 1


class Encoder:
    """Texts to ids. What encodes pieces is the transducer, unless another function is given."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces=None):
        self.pieces = regex.compile(pattern).findall
        self.transducer = None if pieces else Transducer(ranks)
        self.of_pieces = pieces or self.transducer.encode
        #: Chunks with their ids: those met lately, and those met before, of which those met again come over.
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table = np.zeros(max(ranks.values()) + 1, dtype=object)
        for token, rank in ranks.items():
            self.table[rank] = token

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        known, cut = self.chunks, {}
        missing: set[str] = set()
        pieces: dict[str, None] = {}
        work = []
        for text in texts:
            if not text or UNEVEN.search(text):
                first, rest = self.pieces(text), []
            else:
                first, *rest = text.split(" ")
                first = self.pieces(first)
            pieces.update(dict.fromkeys(first))
            missing.update(set(rest).difference(known))
            work.append((first, rest))
        for chunk in missing:
            if (ids := self.older.get(chunk)) is not None:
                known[chunk] = ids
            else:
                cut[chunk] = parts = self.pieces(" " + chunk)
                pieces.update(dict.fromkeys(parts))
        ids = dict(zip(pieces, self.of_pieces([x.encode() for x in pieces]), strict=True))
        known.update((chunk, b"".join([ids[x] for x in parts])) for chunk, parts in cut.items())
        out = [b"".join([*map(ids.__getitem__, first), *map(known.__getitem__, rest)]) for first, rest in work]
        for chunk in cut:
            if len(chunk) > CHUNK_CHARS:
                del known[chunk]
        if len(known) > CHUNKS:
            self.older, self.chunks = known, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.table[np.frombuffer(ids, dtype="<u4")])

    def blocks(self, ids: bytes) -> Iterator[str]:
        """As stream(), for blocks of BLOCK ids: the machine's state goes from block to block, so a character may span them."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), 4 * BLOCK):
            yield machine.decode(self.decode(ids[at : at + 4 * BLOCK]))
        yield machine.decode(b"", final=True)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are complete; a machine over the UTF-8 states holds the open ones. Bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.table[i]):
                yield text
        if text := machine.decode(b"", final=True):
            yield text


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """Kept by each Python worker."""
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def library(path: str, pattern: str) -> tiktoken.Encoding:
    """The same vocabulary in the library, for operators that need counts or ids but aren't about how they are made."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """Those that the tokenizer file of the same name as the ranks adds; none if there is no such file."""
    file = Path(path).with_suffix(".json")
    added = json.loads(file.read_text(encoding="utf-8"))["added_tokens"] if file.exists() else []
    if any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take in more or less than their own text aren't known here")
    return {x["content"]: x["id"] for x in added}


@lru_cache(maxsize=2)
def with_added(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids as the tokenizer file gives them: added tokens that stand in a text have their own id."""
    added = added_tokens(path)
    known = tiktoken.Encoding("added", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens=added)
    names = set(added)
    return lambda text: known.encode(text, allowed_special=names) if any(x in text for x in names) else known.encode_ordinary(text)


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, lossless for every row; null texts count as empty."""

    def make():
        enc = encoder(path, pattern)

        def run(texts: pa.Array) -> dict:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "lossless": []}
            plain = common.as_texts(texts)
            for text, ids in zip(plain, enc.encode(plain), strict=True):
                back = "".join(enc.blocks(ids)).encode()
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                out["lossless"].append(back == text.encode())
            gc.freeze()  # the tables hold many tuples; the collector needn't go through them again and again
            return out

        return run

    return common.map_texts(df, id_col, text_col, make, "n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the ids as array<long>."""

    def make():
        enc = encoder(path, pattern)
        return lambda texts: {"ids": [np.frombuffer(x, dtype="<u4").astype("int64") for x in enc.encode(common.as_texts(texts))]}

    return common.map_texts(df, id_col, text_col, make, "ids array<long>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text of array<long> ids, by the streaming decoder; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = ["".join(enc.stream(ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    picked = df.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids")
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
