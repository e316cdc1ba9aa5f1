"""Language ID: multinomial naive Bayes over hashed character n-grams.

Features. Lower-cased letters; any run of other characters is one blank; all n-grams of one to three characters, hashed
into a fixed number of buckets. Fitting counts buckets per language over a bounded sample of labelled rows (SAMPLE_ROWS,
chosen by a hash of the id), as partial aggregates; the matrix of log probabilities, languages x buckets, is broadcast.
Its size grows with the languages alone, of which MOST_LANGS are taken at most (64 MB); a column of more different values
holds no languages, and fit() refuses it with an error before anything is gathered. Scoring gathers the rows of the matrix for the n-grams of a batch and sums them by
document in numpy.

The score is the predicted language's posterior, with the evidence scaled to that of EVIDENCE n-grams, so that it
doesn't saturate with length.

Cases. Null texts, and texts without a letter, are `und` with score 0; so is everything if no labelled row was given.
Ties go to the language that sorts first. Rows whose id is null are not learned from. Repeated rows count each. Very
long texts are scored in parts of AT_ONCE n-grams. An empty table gives no rows. Only the id, text and language columns
are read, so others can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parzelle.llm import common

BUCKETS, ORDERS = 1 << 16, 3
#: Labelled rows that are learned from, on average.
SAMPLE_ROWS = 20_000
SMOOTHING, EVIDENCE = 0.5, 25.0
#: The least score of a language that counts as known.
LEAST = 0.5
#: Different values of a column of languages, at most.
MOST_LANGS = 256
#: Languages whose counts a task holds at once, whatever the table has.
LANGS_HELD = 64
#: n-grams that are gathered at once.
AT_ONCE = 1 << 17
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray  # buckets x languages


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def prepare(text: str) -> np.ndarray:
    """Code points, blanks for what is no letter; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alpha = letters()[codes]
    if not alpha.any():
        return np.zeros(0, dtype=np.uint64)
    codes = np.concatenate([[32], np.where(alpha, codes, 32), [32]])
    keep = (codes != 32) | np.append(True, codes[:-1] != 32)
    return codes[keep].astype(np.uint64)


def buckets(codes: np.ndarray) -> np.ndarray:
    """The bucket of each n-gram."""
    out = []
    with np.errstate(over="ignore"):
        grams = codes
        for n in range(1, ORDERS + 1):
            if len(codes) < n:
                break
            if n > 1:
                grams = grams[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            out.append(((grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def remainder(doc: Column) -> Column:
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(3))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    total, langs = rows.agg(F.count(F.lit(1)), F.count_distinct(F.col(lang_col))).first()
    if langs > MOST_LANGS:
        raise ValueError(f"{lang_col} has {langs} different values; a model takes {MOST_LANGS} languages at most")
    if not total:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    chance = F.pmod(F.xxhash64(F.lit(9), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(chance < sample_rows / total).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in sums.items():
                some = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for part in common.slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if lang not in sums:
                    if len(sums) >= LANGS_HELD:
                        yield from flush()
                    sums[lang] = np.zeros(BUCKETS + 1, dtype=np.int64)
                held = sums[lang]
                held[:-1] += np.bincount(buckets(prepare(text)), minlength=BUCKETS)
                held[-1] += 1
        yield from flush()

    found = picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    if not langs:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    counts = np.zeros((len(langs), BUCKETS + 1))
    at = {lang: i for i, lang in enumerate(langs)}
    counts[[at[x] for x in found["lang"].to_pylist()], found["bucket"].to_numpy()] = found["n"].to_numpy()
    docs, grams = counts[:, -1], counts[:, :-1] + SMOOTHING
    matrix = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    return Model(langs, np.log(docs / docs.sum()), np.ascontiguousarray(matrix))


def score_batch(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    if not model.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(model.langs)))
    counts = np.zeros(len(texts))
    held: list[np.ndarray] = []
    whose: list[int] = []

    def add() -> None:
        sizes = np.array([len(x) for x in held])
        gathered = model.matrix[np.concatenate(held)]
        found = np.add.reduceat(gathered, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
        np.add.at(sums, whose, found)
        np.add.at(counts, whose, sizes)
        held.clear()
        whose.clear()

    n = 0
    for i, text in enumerate(texts):
        codes = buckets(prepare(text)) if text else np.zeros(0, np.int64)
        for at in range(0, len(codes), AT_ONCE):
            held.append(codes[at : at + AT_ONCE])
            whose.append(i)
            n += len(held[-1])
            if n >= AT_ONCE:
                add()
                n = 0
    if held:
        add()
    best = (model.prior + sums).argmax(axis=1)
    scaled = model.prior + sums * np.minimum(1.0, EVIDENCE / np.maximum(counts, 1))[:, None]
    scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    share = (scaled / scaled.sum(axis=1, keepdims=True))[np.arange(len(texts)), best]
    known = counts > 0
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(share, known, strict=True)]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns to keep, lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts: pa.Array) -> dict:
            langs, scores = score_batch(texts.to_pylist(), shared.value)
            return {"lang_pred": langs, "score": scores}

        return run

    return common.map_texts(df, id_col, text_col, make, "lang_pred string, score double", keep)


def keep_known(df: DataFrame, model: Model, least: float = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with all columns, whose language is known with a score of at least `least`; a null language becomes the predicted one."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = df.columns.index(text_col), df.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text_col):
            langs, scores = score_batch(part.column(text_at).to_pylist(), shared.value)
            cols = list(part.columns)
            cols[lang_at] = pc.coalesce(cols[lang_at], pa.array(langs, cols[lang_at].type))
            filled = pa.RecordBatch.from_arrays(cols, names=part.schema.names)
            yield filled.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
