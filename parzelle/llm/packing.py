"""Vector bin packing of token sequences by the dot-product heuristic.

An item needs (tokens, one segment, loss-bearing tokens); a sequence offers at most that many of each. The open sequence
takes the fitting item whose needs, as shares of the limits, have the largest dot product with what is left; items of
equal needs are one class, so a choice looks at classes only. When nothing fits, the largest item is cut to fill the
rest, unless that would break off a fragment of fewer than `least` tokens. Each task packs the rows it reads, window by
window, and hands what is left of a window to the next; what is left at its end becomes sequences whose lengths are
powers of two, which need no padding. A sequence that only lacks `pad` tokens is padded instead. No row leaves its task,
so there is no shuffle and no group that could grow hot; memory is bounded by a window and one text.

Loss-bearing tokens are the last ones of an item: of a document all but its first HEAD, for which there is too little
context. For plain documents the token and the segment limit bind, the loss limit hardly: with 2048 of each, 6,400
documents of sf0.1 give 0.03 % of padding and 25 cut documents of 5,694 that are shorter than a sequence.

Instruction data is what the third limit is for. pack_conversations() takes conversations, whose assistant turns alone
bear loss: some are nearly all prompt, some nearly all answer, so needs differ in direction, and the dot product puts
them together such that neither limit is used up before the other. Conversations that one sequence can hold stay whole.

Ids are those of the tokenizer file beside the ranks, whose added tokens are found in texts too.

Cases. A null or empty text is the end token alone. A very long text is cut into as many sequences as it needs. Repeated
rows are packed each for itself; of items that score alike any is taken. A null id is kept. An empty table gives
no rows. Only the id and text columns are read, so other columns can have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parzelle.llm import bpe, common

TOKENS, SEGMENTS, LOSS = 2048, 12, 2048
#: Loss-bearing tokens of a sequence of conversations.
CHAT_LOSS = 1024
#: First tokens of a document, which bear no loss; tokens that a sequence may lack; the smallest piece to break off.
HEAD, PAD, LEAST = 8, 64, 32
#: A window: documents, and ids in it.
WINDOW_ROWS, WINDOW_IDS = 4096, 4_000_000
#: Sequence ids: the task's number, then a number within the task.
TASK_SHIFT = 36

#: item number, first token, tokens, loss-bearing tokens
Piece = tuple[int, int, int, int]


class Pool:
    """Items by class of needs."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, int], int] = {}
        self.free: list[int] = []
        self.items: list[list[Piece]] = []
        self.needs = np.zeros((64, 3))
        self.there = np.zeros(64, dtype=bool)
        self.n = 0

    def add(self, piece: Piece) -> None:
        key = piece[2:]
        if (k := self.of.get(key)) is None:
            k = self.of[key] = self.free.pop() if self.free else len(self.items)
            if k == len(self.items):
                self.items.append([])
            if k == len(self.there):
                self.needs = np.concatenate([self.needs, np.zeros_like(self.needs)])
                self.there = np.concatenate([self.there, np.zeros_like(self.there)])
            self.needs[k] = key[0], 1, key[1]
        self.items[k].append(piece)
        self.there[k] = True
        self.n += 1

    def take(self, k: int) -> Piece:
        piece = self.items[k].pop()
        if not self.items[k]:
            self.there[k] = False
            self.free.append(self.of.pop(piece[2:]))
        self.n -= 1
        return piece

    def all(self) -> list[Piece]:
        return [x for held in self.items for x in held]


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    item, start, length, loss = piece
    tail = min(loss, length - n)
    return (item, start, n, loss - tail), (item, start + n, length - n, tail)


def pack(pieces: list[Piece], limits: tuple[int, int, int], last: bool = True, pad: int = 0, least: int = 1) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences, and the pieces left over: those of the last open sequence, none if this is the last window."""
    tokens, segments, loss = limits
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    whole = np.array(limits, dtype=float)
    pool, done = Pool(), []
    for piece in pieces:
        # what fills a sequence by itself
        while piece[2] >= tokens and loss + piece[2] - piece[3] >= tokens:
            head, piece = cut(piece, tokens)
            done.append([head])
        if piece[2]:
            pool.add(piece)
    while pool.n:
        held: list[Piece] = []
        left = whole.copy()
        while pool.n and left[0] > 0 and left[1] > 0:
            k = len(pool.items)
            needs = pool.needs[:k]
            fits = pool.there[:k] & (needs <= left).all(axis=1)
            if fits.any():
                score = (needs / whole) @ (left / whole)
                piece = pool.take(int(np.argmax(np.where(fits, score, -1.0))))
            else:
                room = np.minimum(left[0], left[2] + needs[:, 0] - needs[:, 2])
                room = np.where(pool.there[:k], room, 0)
                if room.max() < least:
                    break
                k = int(np.argmax(np.where(room >= least, needs[:, 0], -1)))
                piece, rest = cut(pool.take(k), int(room[k]))
                pool.add(rest)
            held.append(piece)
            left -= (piece[2], 1, piece[3])
        if left[0] > pad and not pool.n and not last:
            return done, held
        total = int(tokens - left[0])
        if not held:
            # what is left can't be cut so coarsely: break off what there is room for
            k = int(np.argmax(np.where(pool.there[: len(pool.items)], pool.needs[: len(pool.items), 0], -1)))
            piece = pool.take(k)
            n = int(min(tokens, loss + piece[2] - piece[3]))
            piece, rest = cut(piece, n)
            held, total = [piece], n
            pool.add(rest)
        if tokens - total > pad:
            keep = 1 << total.bit_length() - 1
            for piece in reversed(held[:]):
                if total == keep:
                    break
                held.pop()
                n = min(piece[2], total - keep)
                total -= n
                if n < piece[2]:
                    piece, rest = cut(piece, piece[2] - n)
                    held.append(piece)
                    pool.add(rest)
                else:
                    pool.add(piece)
        done.append(held)
    return done, []


def pack_documents(df: DataFrame, path: str, pattern: str, end: int = 1, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), head: int = HEAD, pad: int = PAD, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss."""
    picked = df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.with_added(path, pattern)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << TASK_SHIFT
        kept: dict[int, tuple] = {}
        left: list[Piece] = []
        pieces: list[Piece] = []
        n = held = 0

        def out(last: bool) -> pa.RecordBatch:
            nonlocal left, number
            done, left = pack(left + pieces, limits, last, pad, least)
            rows: list[list] = [[] for _ in names]
            for sequence in done:
                at = 0
                for item, start, length, loss in sequence:
                    doc, ids = kept[item]
                    for column, x in zip(rows, (doc, start, length, zlib.crc32(ids[start * 4 : (start + length) * 4]), len(ids) // 4, number, at, loss), strict=True):
                        column.append(x)
                    at += length
                number += 1
            for item in set(kept) - {x[0] for x in left}:
                del kept[item]
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], id_type), *(pa.array(x, pa.int64()) for x in rows[1:])], names=names)

        id_type = pa.int64()
        for batch in common.slices(batches, "text"):
            id_type = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), common.as_texts(batch.column("text")), strict=True):
                ids = np.array([*encode(text), end], dtype="<u4").tobytes()
                kept[n] = doc, ids
                pieces.append((n, 0, len(ids) // 4, max(0, len(ids) // 4 - head)))
                n += 1
                held += len(ids) // 4
            if len(pieces) >= WINDOW_ROWS or held >= WINDOW_IDS:
                yield out(False)
                held = 0
        if pieces or left:
            yield out(True)

    schema = f"id {picked.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """id and turns (role, text) in order, a row for each conversation."""
    c = F.col(f"`{conv}`")
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return df.groupBy(c.alias("id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def chunks(loss: np.ndarray, limits: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """First token, tokens, loss-bearing tokens: an item in as few pieces, one after the other, as the limits allow."""
    found, at, upto = [], 0, np.concatenate([[0], np.cumsum(loss)])
    while at < len(loss):
        end = min(at + limits[0], int(np.searchsorted(upto, upto[at] + limits[2], side="right")) - 1)
        found.append((at, end - at, int(upto[end] - upto[at])))
        at = end
    return found


def pack_conversations(df: DataFrame, path: str, pattern: str, end: int = 1, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, CHAT_LOSS), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bears: str = "assistant") -> DataFrame:
    """One row for each piece of a conversation: id, start, length, ids_crc32, conv_tokens, sequence_id, offset, loss. Each
    turn ends with the end token; the turns of one role bear loss. A conversation within the limits is one piece; a
    longer one, of any length, is cut where a limit is reached. Its turns are gathered into one row, so a conversation
    must fit into a row. Null roles and texts are empty; an empty table gives no rows."""
    names = ["id", "start", "length", "ids_crc32", "conv_tokens", "sequence_id", "offset", "loss"]
    picked = turns_of(df, conv, turn, role, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.with_added(path, pattern)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << TASK_SHIFT
        kept: dict[int, tuple] = {}
        pieces: list[Piece] = []
        n = held = 0
        id_type = pa.int64()

        def out() -> pa.RecordBatch:
            nonlocal number
            done, _ = pack(pieces, limits, True, limits[0], limits[0] + 1)
            rows: list[list] = [[] for _ in names]
            for sequence in done:
                at = 0
                for item, start, length, loss in sequence:
                    name, ids = kept[item]
                    for column, x in zip(rows, (name, start, length, zlib.crc32(ids[start * 4 : (start + length) * 4]), len(ids) // 4, number, at, loss), strict=True):
                        column.append(x)
                    at += length
                number += 1
            pieces.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], id_type), *(pa.array(x, pa.int64()) for x in rows[1:])], names=names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for name, turns in zip(batch.column("id").to_pylist(), batch.column("turns"), strict=True):
                ids, loss = [], []
                for one in turns.as_py():
                    more = [*encode(one["text"]), end]
                    ids += more
                    loss += [one["role"] == bears] * len(more)
                kept[n] = name, np.array(ids, dtype="<u4").tobytes()
                pieces += [(n, *c) for c in chunks(np.array(loss), limits)]
                n += 1
                held += len(ids)
                if len(pieces) >= WINDOW_ROWS or held >= WINDOW_IDS:
                    yield out()
                    held = 0
        if pieces:
            yield out()

    schema = f"id {picked.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", conv)
