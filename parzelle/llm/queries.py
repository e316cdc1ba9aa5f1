"""The operators of this subpackage as queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from parzelle.llm import bpe, conversations, fingerprints, funnels, langid, media, neardup, packing, pii, secrets, sharding, token_counts, url_filters
from parzelle.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SHARDS = 24

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


FUNNELS = [
    funnels.Funnel("A", ("view", "click", "view", "purchase"), "error"),
    funnels.Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    funnels.Funnel("C", ("click", "click", "purchase", "view"), "signup"),
]


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), RULES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), RANKS, PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"), RANKS, PATTERN))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = langid.remainder(F.col("doc_id"))
    model = langid.fit(docs.where(left != 1))
    held = docs.select("doc_id", "text", F.coalesce(left == 1, F.lit(False)).alias("held_out"))
    return langid.predict(held, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", neardup.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op11_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.count(table(spark, sf_dir, "clicks"), FUNNELS)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_media_columns, op2_url_filters, op3_packing, op4_token_counts, op5_fingerprints, op6_sharding, op7_byte_bpe, op8_secret_scans, op9_language_id, op10_simhash_neardup, op11_funnels, op12_conversation_repair, op13_pii, pack_conversations]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return {
        "op2_url_filters": f"""
            WITH cut AS (
                SELECT page_id, COALESCE({rest}, '') AS rest FROM pages
            ), parts AS (
                SELECT page_id,
                       translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
                FROM cut
            ), ruled AS (
                SELECT *, CASE
                    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
                    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
                    END AS rule
                FROM parts
            )
            SELECT page_id, host, path, rule, CASE WHEN rule IS NULL OR rule = 'example.com/en/7' THEN 'allow' ELSE 'block' END AS verdict FROM ruled""",
        "op11_funnels": """
            WITH r AS (
                SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks
                WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL
            ), defs(funnel, step, kind, bad) AS (
                VALUES ('A', 1, 'view', 'error'), ('A', 2, 'click', 'error'), ('A', 3, 'view', 'error'), ('A', 4, 'purchase', 'error'),
                       ('B', 1, 'signup', 'error'), ('B', 2, 'view', 'error'), ('B', 3, 'click', 'error'), ('B', 4, 'purchase', 'error'),
                       ('C', 1, 'click', 'signup'), ('C', 2, 'click', 'signup'), ('C', 3, 'purchase', 'signup'), ('C', 4, 'view', 'signup')
            ), s1 AS (
                SELECT d.funnel, r.client_id, d.bad, r.t AS s, r.t AS p FROM r JOIN defs d ON d.step = 1 AND d.kind = r.kind
            ), s2 AS (
                SELECT q.*, y.t AS n FROM (SELECT s1.*, d.kind AS want FROM s1 JOIN defs d ON d.funnel = s1.funnel AND d.step = 2) q
                ASOF JOIN r y ON y.client_id = q.client_id AND y.kind = q.want AND y.t > q.p
            ), k2 AS (
                SELECT funnel, client_id, bad, s, p, n FROM s2
                WHERE n - s <= 300000000 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.client_id = s2.client_id AND x.kind = s2.bad AND x.t > s2.p AND x.t <= s2.n)
            ), s3 AS (
                SELECT q.funnel, q.client_id, q.bad, q.s, q.n AS p, y.t AS n FROM (SELECT k2.*, d.kind AS want FROM k2 JOIN defs d ON d.funnel = k2.funnel AND d.step = 3) q
                ASOF JOIN r y ON y.client_id = q.client_id AND y.kind = q.want AND y.t > q.n
            ), k3 AS (
                SELECT * FROM s3
                WHERE n - s <= 300000000 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.client_id = s3.client_id AND x.kind = s3.bad AND x.t > s3.p AND x.t <= s3.n)
            ), s4 AS (
                SELECT q.funnel, q.client_id, q.bad, q.s, q.n AS p, y.t AS n FROM (SELECT k3.*, d.kind AS want FROM k3 JOIN defs d ON d.funnel = k3.funnel AND d.step = 4) q
                ASOF JOIN r y ON y.client_id = q.client_id AND y.kind = q.want AND y.t > q.n
            ), k4 AS (
                SELECT * FROM s4
                WHERE n - s <= 300000000 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.client_id = s4.client_id AND x.kind = s4.bad AND x.t > s4.p AND x.t <= s4.n)
            ), steps AS (
                SELECT funnel, client_id, 1 AS step, 0 AS d FROM s1 UNION ALL SELECT funnel, client_id, 2, n - p FROM k2
                UNION ALL SELECT funnel, client_id, 3, n - p FROM k3 UNION ALL SELECT funnel, client_id, 4, n - p FROM k4
            ), ranked AS (
                SELECT *, ROW_NUMBER() OVER (PARTITION BY funnel, client_id, step ORDER BY d) AS i,
                       (25 * COUNT(*) OVER (PARTITION BY funnel, client_id, step) + 99) // 100 AS k FROM steps
            ), found AS (
                SELECT funnel, client_id,
                       COUNT(*) FILTER (step = 1) AS n1, COUNT(*) FILTER (step = 2) AS n2, COUNT(*) FILTER (step = 3) AS n3, COUNT(*) FILTER (step = 4) AS n4,
                       MAX(step) AS deepest,
                       MAX(d) FILTER (step = 2 AND i = k) AS t2, MAX(d) FILTER (step = 3 AND i = k) AS t3, MAX(d) FILTER (step = 4 AND i = k) AS t4
                FROM ranked GROUP BY 1, 2
            )
            SELECT *, COUNT(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM found""",
    }

