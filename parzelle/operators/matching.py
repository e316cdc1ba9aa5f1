"""Fuzzy joins and canonical names. Pairs come from equi-joins on blocks, never from a cross join."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parzelle.functions import similarity
from parzelle.operators.lineage import durable
from parzelle.operators.ranks import places


#: Texts of each side of a block that one task compares; larger blocks are dealt into as many parts as they need.
BLOCK = 5_000
#: Names that one automaton looks for.
PATTERNS = 50_000


def best_in_block(left: DataFrame, right: DataFrame, block: str, text: str, threshold, score=similarity.jaro_winkler, shortest: float = 0.0, strict: bool = False) -> DataFrame:
    """For each left row the best right text of its block, at least `threshold` alike (strict: more); ties go to the smallest text.

    Equal texts are scored once. threshold: a number, or the name of a left column. shortest: texts whose lengths differ
    more than by this factor can't be alike enough and aren't scored; for Jaro-Winkler at 0.93 that is 0.65, since the
    plain Jaro value must be 1 - 0.07 / 0.6 at least and is (2 + shorter / longer) / 3 at most. They meet by bands of
    lengths, each neighbouring two of which cover the factor. Both sides of a large block are dealt into parts, each two
    of which meet in a tile, so a task has BLOCK texts of each side at most, of a block of any size.
    """
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    band = lambda c: F.floor(F.ln(F.length(c)) / -F.ln(F.lit(shortest))) if shortest else F.lit(0)
    a = left.where(F.col(text).isNotNull()).select(block, text, limit.alias("_limit")).distinct().withColumn("_w", F.explode(F.array(*[band(F.col(text)) + d for d in ((-1, 0, 1) if shortest else (0,))])))
    b = right.where(F.col(text).isNotNull()).select(block, F.col(text).alias("match")).distinct().withColumn("_w", band(F.col("match")))
    many = lambda df, name: df.groupBy(block, "_w").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    # one row for each block and band that both sides have
    tiles = many(a, "_m").join(many(b, "_n"), [block, "_w"])
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(tiles, [block, "_w"]).withColumn("_p", own(text, "_m")).withColumn("_q", every("_n")).drop("_m", "_n")
    b = b.join(tiles, [block, "_w"]).withColumn("_q", own("match", "_n")).withColumn("_p", every("_m")).drop("_m", "_n")
    pairs = a.join(b, [block, "_w", "_p", "_q"])
    if shortest:
        n, m = F.length(text), F.length("match")
        pairs = pairs.where(F.least(n, m) >= F.greatest(n, m) * (shortest - 1e-9))
    scored = pairs.withColumn("score", score(F.col(text), F.col("match")))
    scored = scored.where(F.col("score") > F.col("_limit") if strict else F.col("score") >= F.col("_limit"))
    best = scored.groupBy(block, text, "_limit").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("match").alias("m"))).alias("_b"))
    return left.withColumn("_limit", limit).join(best, [block, text, "_limit"], "left").select(*left.columns, F.col("_b.m").alias("match"), (-F.col("_b.s")).alias("score"))


def canonical_names(counted: DataFrame, name: str, freq: str, threshold: float, reach: int = 20, score=similarity.token_set) -> DataFrame:
    """name, canonical: in alphabetical order, the most frequent of a name and those of the next reach - 1 that are more than `threshold` alike; ties go to the first.

    Names are numbered through sampled ranges, so that no task sorts them all; neighbours then meet through blocks of
    `reach` numbers.
    """
    rows = places(counted.select(F.col(name).alias("name"), F.col(freq).alias("freq")), "name").withColumnRenamed("place", "rn")
    block = F.floor(F.col("rn") / reach)
    ahead = rows.select(F.col("name").alias("other"), F.col("freq").alias("other_freq"), F.col("rn").alias("other_rn"), F.explode(F.array(block, block - 1)).alias("_b"))
    near = rows.withColumn("_b", block).join(ahead, "_b").where((F.col("other_rn") > F.col("rn")) & (F.col("other_rn") < F.col("rn") + reach))
    near = near.withColumn("_s", score(F.col("name"), F.col("other"))).where(F.col("_s") > threshold)
    both = near.select("name", F.col("other").alias("c"), F.col("other_freq").alias("f"), F.col("other_rn").alias("r")).unionByName(rows.select("name", F.col("name").alias("c"), F.col("freq").alias("f"), F.col("rn").alias("r")))
    return both.groupBy("name").agg(F.min(F.struct((-F.col("f")).alias("f"), "r", "c"))["c"].alias("canonical"))


def containing(people: DataFrame, names: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """Pairs of a person and a name that has the last name as a word and the first name as a part: blocked by the words of the name."""
    words = names.select(name, F.explode(F.array_distinct(F.split(F.lower(F.col(name)), " "))).alias("_w")).where("_w <> ''")
    return people.join(words, F.lower(people[last]) == words["_w"]).where(F.contains(F.lower(F.col(name)), F.lower(F.col(first)))).drop("_w").distinct()


def parts_containing(people: DataFrame, names: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """As containing(), but the last name may be any part of the name. Aho-Corasick automata, of PATTERNS last names each,
    go over the names where they lie: each name is read once for each automaton, and nothing but hits is shuffled."""
    low = F.lower(F.col(last))
    wanted = people.select(low.alias("p")).where(F.length("p") > 0).distinct()
    numbered = places(wanted, "p")
    ranges = -(-numbered.count() // PATTERNS)
    schema = f"{name} string, _l string"

    def look(patterns: list[str]) -> DataFrame:
        shared = names.sparkSession.sparkContext.broadcast(patterns)

        def run(batches):
            automaton = ahocorasick.Automaton()
            for p in shared.value:
                automaton.add_word(p, p)
            automaton.make_automaton()
            for batch in batches:
                texts = [(n, x) for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if n is not None]
                hits = [(n, p) for n, x in texts for p in {p for _, p in automaton.iter(x)}]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.string()) for i in (0, 1)], names=[name, "_l"])

        return names.select(name, F.lower(F.col(name)).alias("_low")).mapInArrow(run, schema)

    # a range of names is PATTERNS strings, whatever their number is in all
    found = [look([r["p"] for r in numbered.where(F.col("place").between(i * PATTERNS + 1, (i + 1) * PATTERNS)).select("p").collect()]) for i in range(ranges)]
    if not found:
        return people.select("*", *[F.lit(None).cast(names.schema[c].dataType).alias(c) for c in [name, *(c for c in names.columns if c != name)]]).where("false")
    hits = reduce(DataFrame.unionByName, found).distinct()
    met = people.withColumn("_l", low).join(hits, "_l").where(F.contains(F.lower(F.col(name)), F.lower(F.col(first))))
    rest = [c for c in names.columns if c != name]
    out = met.join(names, name) if rest else met
    return out.select(*people.columns, name, *rest).distinct()


def with_overrides(df: DataFrame, overrides: DataFrame, key: str, old: str, columns: dict[str, str]) -> DataFrame:
    """Columns replaced where a table of corrections has the old key and a new value; of several corrections the smallest counts."""
    best = overrides.groupBy(F.col(old).alias("_old")).agg(*[F.min(new).alias(f"_{c}") for c, new in columns.items()])
    joined = df.join(best, df[key] == best["_old"], "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def resolved(mapping: DataFrame, old: str, new: str) -> DataFrame:
    """A mapping whose targets are themselves mapped, followed to the end in doubling steps, each of which ends in a checkpoint. A name that leads into a cycle gets the smallest name of the cycle."""
    now = durable(mapping.select(F.col(old).alias("old"), F.col(new).alias("new"), F.col(new).alias("low")).distinct())
    names = now.where("new IS NOT NULL").select(F.col("old").alias("new")).distinct()
    # after so many doublings only what leads into a cycle is still mapped, and low covers all of the cycle
    for _ in range(names.count().bit_length()):
        if now.join(names, "new", "left_semi").isEmpty():
            break
        step = now.where("new IS NOT NULL").select(F.col("old").alias("_o"), F.col("new").alias("_n"), F.col("low").alias("_l"))
        now = durable(now.join(step, now["new"] == step["_o"], "left").select("old", F.coalesce("_n", "new").alias("new"), F.least("low", "_l").alias("low")).distinct())
    ends = now.join(names, "new", "left_semi").select(F.col("old").alias("_o"), F.col("low").alias("_l"))
    return now.join(ends, now["new"] == ends["_o"], "left").select("old", F.coalesce("_l", "new").alias("new"))
