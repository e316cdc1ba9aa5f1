"""Raw entries over whole texts: owners, address parts, rebuilt addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parzelle.functions import text as T
from parzelle.plans.registry import Tables, query

c = F.col

#: Comma parts that are addresses, as DuckDB says it (a letter or digit of any alphabet is [\pL\pN_]).
_SPACE = r"[ \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}]"
_STRIP = lambda x: rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_IS_ADDRESS = r"(regexp_matches({0}, '[0-9]{{4,5}} [\pL\pM\pN_]') OR regexp_matches({0}, '[0-9]{{5}}') OR regexp_matches({0}, '^[^\n]+[\s\x0b\x{{85}}\x{{a0}}][0-9]+([^0-9]*[^0-9\s\x0b\x{{85}}\x{{a0}}])?$') OR regexp_matches({0}, '[A-Za-z][^\n]*[0-9]$'))"


@query(
    "str_owner_parts",
    f"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, ','), lambda p: NOT {_IS_ADDRESS.format('p')}), lambda p: {_STRIP('p')}), ', ') AS kept FROM documents WHERE text IS NOT NULL",
)
def str_owner_parts(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", T.drop_address_parts(c("text")).alias("kept"))


@query(
    "str_owners",
    f"""WITH x AS (SELECT doc_id, string_split({_STRIP("regexp_replace(lower(CASE WHEN text IS NULL OR regexp_full_match(text, '[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}]*') THEN 'unbekannt' ELSE text END), '^,+|,+$', '', 'g')")}, chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i, len(lines) AS n FROM x),
    p AS (SELECT doc_id, i, n, list_transform(list_filter(list_filter(string_split(line, ','), lambda p: NOT list_contains(string_split(p, ' '), 'geb.')), lambda p: NOT {_IS_ADDRESS.format('p')}), lambda p: {_STRIP('p')}) AS ps FROM l),
    o AS (SELECT doc_id, i, n, array_to_string(CASE WHEN len(list_filter(ps, lambda q: contains(q, '*'))) > 0 THEN ps[1:list_position(list_transform(ps, lambda q: contains(q, '*')), true)] ELSE ps END, ', ') AS owner FROM p),
    e AS (SELECT doc_id, max(CASE WHEN i = n - 1 THEN owner END) AS last FROM o GROUP BY doc_id),
    g AS (SELECT o.doc_id, bool_or(i < n - 1 AND contains(owner, last)) AND NOT bool_or(i < n - 1 AND owner = last) AS gone FROM o JOIN e USING (doc_id) GROUP BY o.doc_id),
    k AS (SELECT doc_id, replace({_STRIP('owner')}, '  ', ' ') AS owner, min(i) AS i FROM o JOIN g USING (doc_id) WHERE NOT (gone AND i = n - 1) GROUP BY ALL)
    SELECT doc_id, string_agg(owner, ' | ' ORDER BY i) AS owners, count(*) AS n FROM k GROUP BY doc_id""",
)
def str_owners(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.owners(c("text")).alias("o")).select("doc_id", F.array_join("o", " | ").alias("owners"), F.size("o").cast("long").alias("n"))


#: Two alternatives from a client: street and place in either order, with numbers and districts as they come.
_ONE = "name || ' Straße ' || CAST(client_id % 150 AS VARCHAR(9)) || CASE WHEN client_id % 3 = 0 THEN ' b' WHEN client_id % 3 = 1 THEN '' ELSE 'k' END || ', ' || CAST(client_id * 7919 % 100000 AS VARCHAR(9)) || ' ' || city || CASE WHEN nation_id % 4 = 0 THEN ' OT Nord' WHEN nation_id % 4 = 1 THEN '/Süd' ELSE '' END"
_TWO = "CAST(client_id * 7919 % 100000 AS VARCHAR(9)) || ' ' || city || ', ' || name || '-strasse: 0' || CAST(nation_id AS VARCHAR(9))"


@query(
    "str_clean_addresses",
    f"""WITH x AS (SELECT client_id, updated_at, {_ONE} || '_' || {_TWO} AS a FROM clients),
    s AS (SELECT client_id, updated_at, a, trim(unnest(string_split(replace(replace(replace(replace(replace(replace(replace(replace(lower(a), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '.', ''), ':', ''), '-', ' '), 'strasse', 'str'), '_'))) AS p FROM x),
    q AS (SELECT *, string_split(p, ',') AS ps FROM s WHERE NOT contains(p, '00000') AND NOT contains(p, 'unbekannt')),
    f AS (SELECT client_id, updated_at, a,
        coalesce(trim(list_filter(ps, lambda u: regexp_matches(u, '[0-9]( ?[a-f])?$'))[1]), '') AS street,
        coalesce(list_filter(list_transform(ps, lambda u: CASE WHEN regexp_matches(u, '[0-9]{{5}} [\\pL\\pN_]') THEN regexp_extract(u, '[0-9]{{5}}') WHEN regexp_matches(u, '[0-9]{{4}} [\\pL\\pN_]') THEN regexp_extract(u, '[0-9]{{4}}') WHEN regexp_matches(u, '[0-9]{{5}}') THEN regexp_extract(u, '[0-9]{{5}}') END), lambda v: v IS NOT NULL)[1], '') AS plz,
        trim(coalesce(array_to_string(regexp_extract_all(list_filter(ps, lambda u: regexp_matches(u, '[0-9]{{4}} [\\pL\\pN_]'))[1], '[^0-9]{{1,100}}'), ' '), '')) AS town FROM q),
    h AS (SELECT *, regexp_extract(street, '[0-9]{{1,4}}[ ]?[a-f]?$') AS number, trim(split_part(town, '/', 1)) AS t0 FROM f),
    w AS (SELECT *, list_position(string_split(t0, ' '), 'ot') AS pos FROM h),
    r AS (SELECT *, CASE WHEN pos > 0 THEN trim(replace(t0, array_to_string(string_split(t0, ' ')[pos:pos + 1], ' '), '')) ELSE t0 END AS place FROM w),
    b AS (SELECT DISTINCT client_id, updated_at, a, CASE WHEN street = '' THEN '' ELSE trim(street[:length(street) - length(number)]) || ' ' || regexp_replace(replace(number, ' ', ''), '^0', '') || ', ' END || plz || ' ' || place AS v FROM r WHERE plz || place <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY client_id, updated_at, a ORDER BY length(v), v) AS i FROM b),
    m AS (SELECT client_id, updated_at, a, string_agg(v, '_' ORDER BY i) AS v FROM o WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.client_id IS NOT DISTINCT FROM o.client_id AND y.updated_at IS NOT DISTINCT FROM o.updated_at AND y.a = o.a AND y.i > o.i AND contains(replace(y.v, ' ', ''), replace(o.v, ' ', ''))) GROUP BY ALL)
    SELECT x.client_id, count(*) AS n, coalesce(m.v, CASE WHEN x.a IS NULL THEN NULL ELSE 'unbekannt' END) AS addresses FROM x LEFT JOIN m ON x.client_id IS NOT DISTINCT FROM m.client_id AND x.updated_at IS NOT DISTINCT FROM m.updated_at AND x.a = m.a GROUP BY ALL""",
)
def str_clean_addresses(t: Tables) -> DataFrame:
    both = F.concat(F.expr(_ONE), F.lit("_"), F.expr(_TWO))
    # only distinct texts are cleaned
    rows = t.clients.groupBy("client_id", both.alias("a")).agg(F.count(F.lit(1)).alias("n"))
    cleaned = rows.select("client_id", "n", F.when(c("a").isNotNull(), T.clean_addresses(c("a"))).alias("addresses"))
    return cleaned.groupBy("client_id", "addresses").agg(F.sum("n").alias("n"))
