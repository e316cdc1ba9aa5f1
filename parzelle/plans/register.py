"""Queries from raw entries to classified owners, and from register entries to networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parzelle.functions import similarity, text as T
from parzelle.operators import classify, matching as M, network as N, register as G, relational as R
from parzelle.plans import domain as D
from parzelle.plans.registry import Tables, query

c = F.col

#: Raw entries of two owners, from customers; each third one has the second owner without an address, each fifth ends in a repetition of the first that is cut off.
_RAW = "concat('Müller, Anna', chr(97 + c_custkey % 9), ', * 1950-01-02, Haupt Str ', CAST(c_custkey % 90 + 1 AS VARCHAR(9)), ', ', lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR(9)), 5, '0'), ' Ort', CAST(c_nationkey AS VARCHAR(9)), chr(10), CASE c_custkey % 4 WHEN 0 THEN 'Acker AG' WHEN 1 THEN 'Kirchgemeinde Dorf' WHEN 2 THEN 'Land Brandenburg' ELSE 'Hof GmbH' END, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(', Am Weg ', CAST(c_custkey % 70 + 1 AS VARCHAR(9)), ', 01234 Stadt') END, CASE WHEN c_custkey % 5 = 0 THEN concat(chr(10), 'Müller, Anna', chr(97 + c_custkey % 9)) ELSE '' END)"


def raw(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.lower(F.expr(_RAW)).alias("raw"), c("c_acctbal").alias("area"))


@query(
    "own_from_raw",
    """WITH x AS (SELECT c_custkey, c_acctbal, 'müller, anna' || chr(CAST(97 + c_custkey % 9 AS INT)) || ', * 1950-01-02' AS one, 'haupt str ' || c_custkey % 90 + 1 || ', ' || lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') || ' ort' || c_nationkey AS a1,
        CASE c_custkey % 4 WHEN 0 THEN 'acker ag' WHEN 1 THEN 'kirchgemeinde dorf' WHEN 2 THEN 'land brandenburg' ELSE 'hof gmbh' END AS two, CASE WHEN c_custkey % 3 = 0 THEN 'unkown 1, 00000 unkown' ELSE 'am weg ' || c_custkey % 70 + 1 || ', 01234 stadt' END AS a2,
        CASE c_custkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 20 WHEN 2 THEN 23 ELSE 8 END AS k FROM customer)
    SELECT c_custkey, one AS owner, a1 AS address, 1 AS category, '1_1_1' AS level3, round(c_acctbal / 2, 6) AS area, 2::BIGINT AS n_owners FROM x
    UNION ALL SELECT c_custkey, two, a2, k, CASE k WHEN 7 THEN '2_1_1' WHEN 20 THEN '4_1_1' WHEN 23 THEN '5_2_2' ELSE '2_1_2' END, round(c_acctbal / 2, 6), 2 FROM x""",
)
def own_from_raw(t: Tables) -> DataFrame:
    # entries are short rows but long work, and a small file is one task, so they are dealt to as many tasks as a shuffle has
    entries = raw(t).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    rows = entries.select("*", F.explode(F.array(T.owners(c("raw")))).alias("names"))
    # an address belongs to its own line of the entry
    rows = rows.withColumn("addresses", F.transform("names", lambda o: T.addresses_of(o, F.replace(c("raw"), F.lit("\n"), F.lit(",\n")))))
    each = R.stretch(rows.drop("raw"), "names", "addresses", "unbekannt", ["area"])
    clean = each.select("c_custkey", c("name").alias("owner"), c("other").alias("address"), F.round("area", 6).alias("area"), c("n_owners").cast("long").alias("n_owners"), classify.normalised(c("name")).alias("clean"))
    return clean.withColumn("category", classify.class_id(c("clean"))).withColumn("level3", classify.levels(c("category"))[2]).drop("clean")


@query(
    "str_addresses",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'unkown 1, 00000 unkown' WHEN 1 THEN 'weg ' || c_nationkey + 1 || ',12345 ort' WHEN 2 THEN '04567 dorf' WHEN 3 THEN 'gasse ' || c_nationkey + 1 || 'a' ELSE 'platz 3, 11111 stadt_weg 2, 22222 stadt' END AS address FROM customer""",
)
def str_addresses(t: Tables) -> DataFrame:
    n = (c("c_nationkey") + 1).cast("string")
    entry = F.when(c("c_custkey") % 5 == 0, F.lit("muster, max (gbr)")).when(c("c_custkey") % 5 == 1, F.concat(F.lit("muster, max (gbr),weg "), n, F.lit(",12345 ort,rest"))).when(c("c_custkey") % 5 == 2, F.lit("vor, muster, max (gbr), 04567 dorf,hinten")).when(c("c_custkey") % 5 == 3, F.concat(F.lit("muster, max (gbr), gasse "), n, F.lit("a"))).otherwise(F.lit("muster, max (gbr),weg 2, 22222 stadt, muster, max (gbr),platz 3, 11111 stadt, muster, max (gbr),weg 2, 22222 stadt"))
    return t.customer.select("c_custkey", T.addresses_of(F.lit("muster, max (gbr)"), entry).alias("address"))


_ALT = "CASE c_custkey % 3 WHEN 0 THEN concat('bahnhofstr ', CAST(c_nationkey AS VARCHAR(9)), ', 16352 basdorf_bahnhofstr ', CAST(c_nationkey AS VARCHAR(9)), ', 16348 basdorf bei w') WHEN 1 THEN 'borkumstr 2, 13189 berlin_hauptstr 120, 16352 berlin' ELSE 'weg 1, 11111 ort' END"


@query("str_jaro_rule", f"WITH x AS (SELECT c_custkey, {_ALT} AS a FROM customer), y AS (SELECT *, list_sort([[lpad(length(trim(s))::VARCHAR, 5, '0'), trim(s)] FOR s IN string_split(a, '_')]) AS l FROM x) SELECT c_custkey, CASE WHEN len(l) > 1 AND jaro_winkler_similarity(l[1][2], l[2][2]) > 0.93 THEN l[2][2] ELSE a END AS address FROM y")
def str_jaro_rule(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.expr(_ALT).alias("a"))
    one, two = T.shortest_two(c("a"))
    return rows.select("c_custkey", T.one_address(c("a"), similarity.jaro_winkler(one, two), 0.93).alias("address"))


@query("date_age_reset", "WITH x AS (SELECT o_orderkey, CAST(floor(date_diff('day', (o_orderdate - INTERVAL 82 YEAR)::DATE, DATE '2020-11-15') / 365.2425) AS INT) AS age FROM orders) SELECT o_orderkey, age, CASE WHEN age > 101 THEN 'unbekannt' ELSE 'wer' END AS owner, CASE WHEN age > 101 THEN 26 ELSE 1 END AS category FROM x")
def date_age_reset(t: Tables) -> DataFrame:
    years, name, klass = T.age_or_unknown(F.date_format(F.add_months("o_orderdate", -82 * 12), "yyyy-MM-dd"), F.lit("wer"), F.lit(1))
    return t.orders.select("o_orderkey", years.alias("age"), name.alias("owner"), klass.alias("category"))


# Words of nobility; code words of international companies.
NOBILITY = ["van", "von", "graf", "graefin", "baronin", "baron", "freiherr", "freifrau", "herzog", "herzogin"]
INTERNATIONAL = ["sp.", "s.p.a.", "ltd.", "limited", "s.a.", " se ", "sp.z o.o.", "b.v.", "bhd.", "srl", "ltd", "s.à r.l.", " sa ", " bv ", " sl ", "inc.", "s.r.l.", " inc "]
_NOBLE = "CASE c_custkey % 4 WHEN 0 THEN 'von der muehle, anna' WHEN 1 THEN 'graf, max' WHEN 2 THEN 'freiherr von stein, carl' ELSE 'mueller, eva' END"


@query("str_nobility", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'der muehle, anna' WHEN 1 THEN 'graf, max' WHEN 2 THEN 'stein, carl' ELSE 'mueller, eva' END AS name FROM customer")
def str_nobility(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.without_nobility(F.expr(_NOBLE), NOBILITY).alias("name"))


_FIRM = "CASE c_custkey % 5 WHEN 0 THEN 'Acker Ltd.' WHEN 1 THEN 'Hof SE Holding' WHEN 2 THEN 'Agri s.r.l.' WHEN 3 THEN 'Feld GmbH' ELSE 'Sellin KG' END"


@query("str_international", "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN 1 ELSE 0 END AS international FROM customer")
def str_international(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.has_any(F.lower(F.expr(_FIRM)), INTERNATIONAL).cast("int").alias("international"))


# The clean-up rules of recipients' names and addresses that can change a text, in order.
RECIPIENT_RULES = [("[.]", ""), ("landwirtschaftl ", "landwirtschaftliche"), ("lwb", "landwirtschaftsbetrieb"), ("apg", "agrarproduktivgenossenschaft"), ("leg ", "landwirtschaftsgesellschaft"), ("ag ", "agrargenossenschaft"), ("landwirtschaftsb ", "landwirtschaftsbetrieb"), ("agrarges ", "agrargesellschaft"), ("gesellschaftmbh", "gmbh"), ("gemeinnuetzigegmbh", "ggmbh"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("-", ""), ("´", ""), ("`", ""), ("'", ""), ("&", ""), (" ", ""), ("ß", "ss"), ("/", ""), (",", ""), ('["]', "")]
RECIPIENT_ADDRESS_RULES = [("[.]", ""), ("straße", "str"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("-", ""), ("´", ""), ("`", ""), ("'", ""), ("&", ""), ("ß", "ss"), ("/", ""), (" ", "")]


def _gsub(x: str) -> str:
    for a, b in RECIPIENT_RULES:
        x = f"regexp_replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b}', 'g')"
    return x


_RECIPIENT = "CASE c_custkey % 4 WHEN 0 THEN 'landwirtschaftl betrieb müller & söhne' WHEN 1 THEN 'lwb groß-dorf' WHEN 2 THEN 'apg, am weg' ELSE 'beteiligungsgesellschaftmbh/feld' END"


@query("str_rule_chain", f"SELECT c_custkey, {_gsub(_RECIPIENT)} AS name FROM customer")
def str_rule_chain(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.rule_chain(F.expr(_RECIPIENT), RECIPIENT_RULES).alias("name"))


#: Names and addresses as recipients write them, from clients.
_WRITTEN = "lower(name) || CASE WHEN client_id % 6 = 0 THEN ' landwirtschaftsb & söhne' WHEN client_id % 6 = 1 THEN ' agrarges \"nord\"' WHEN client_id % 6 = 2 THEN ' gemeinnuetzigegmbh' WHEN client_id % 6 = 3 THEN '´s agrargesellschaftmbh, süd' WHEN client_id % 6 = 4 THEN ' ag leg land/forst' ELSE '`-e.g.' END"
_PLACED = "lower(city) || '-straße ' || CAST(client_id % 90 AS VARCHAR(9)) || CASE WHEN client_id % 4 = 0 THEN ' a/b' WHEN client_id % 4 = 1 THEN '. & ´c`' WHEN client_id % 4 = 2 THEN ' größe' ELSE '' END"


@query(
    "str_recipients",
    f"""WITH x AS (SELECT client_id, updated_at, {_WRITTEN} AS a, {_PLACED} AS b FROM clients),
    y AS (SELECT client_id, updated_at, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(a, '.', ''), 'landwirtschaftl ', 'landwirtschaftliche'), 'lwb', 'landwirtschaftsbetrieb'), 'apg', 'agrarproduktivgenossenschaft'), 'leg ', 'landwirtschaftsgesellschaft'), 'ag ', 'agrargenossenschaft'), 'landwirtschaftsb ', 'landwirtschaftsbetrieb'), 'agrarges ', 'agrargesellschaft'), 'gesellschaftmbh', 'gmbh'), 'gemeinnuetzigegmbh', 'ggmbh') AS a, replace(replace(b, '.', ''), 'straße', 'str') AS b FROM x)
    SELECT client_id, updated_at, translate(replace(replace(replace(replace(a, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '-´`''& /,"', '') AS name, translate(replace(replace(replace(replace(b, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '-´`''& /', '') AS address FROM y""",
)
def str_recipients(t: Tables) -> DataFrame:
    name, address = T.rule_chain(F.expr(_WRITTEN), RECIPIENT_RULES), T.rule_chain(F.expr(_PLACED), RECIPIENT_ADDRESS_RULES)
    return t.clients.select("client_id", "updated_at", name.alias("name"), address.alias("address"))


@query("str_postcode_pad", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey % 9000 + 1000 AS VARCHAR), 5, '0') WHEN 1 THEN '16352' ELSE '' END AS postcode FROM customer")
def str_postcode_pad(t: Tables) -> DataFrame:
    k = c("c_custkey")
    written = F.when(k % 3 == 0, F.concat(F.lit("DE-"), (k % 9000 + 1000).cast("string"))).when(k % 3 == 1, F.lit("16352 basdorf")).otherwise("ohne")
    return t.customer.select("c_custkey", T.padded_postcode(written).alias("postcode"))


@query("str_drop_phrase", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'basdorf' WHEN 1 THEN 'wandlitz  nord' ELSE 'berlin' END AS city FROM customer")
def str_drop_phrase(t: Tables) -> DataFrame:
    place = F.when(c("c_custkey") % 3 == 0, "basdorf bei berlin ot dorf").when(c("c_custkey") % 3 == 1, "wandlitz ot klosterfelde nord").otherwise("berlin")
    return t.customer.select("c_custkey", T.drop_word_and_next(place, ["bei", "ot"]).alias("city"))


@query("rsh_separate", "SELECT c_custkey, trim(split_part(a, ',', 1)) AS p1, trim(split_part(a, ',', 2)) AS p2, CASE WHEN c_custkey % 2 = 0 THEN trim(split_part(a, ',', 3)) || ', ' || trim(split_part(a, ',', 4)) END AS p3 FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a, b' || c_nationkey || ', c, d' ELSE 'x, y' END AS a FROM customer)")
def rsh_separate(t: Tables) -> DataFrame:
    a = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("a, b"), "c_nationkey", F.lit(", c, d"))).otherwise("x, y")
    return t.customer.select("c_custkey", *[p.alias(f"p{i + 1}") for i, p in enumerate(T.separated(a, 3))])


@query("rsh_two_persons", "SELECT c_custkey, unnest(string_split(CASE WHEN c_custkey % 3 = 0 THEN 'anna und max ' || c_nationkey ELSE 'eva ' || c_nationkey END, ' und ')) AS person FROM customer")
def rsh_two_persons(t: Tables) -> DataFrame:
    name = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("anna und max "), "c_nationkey")).otherwise(F.concat(F.lit("eva "), "c_nationkey"))
    return t.customer.select("c_custkey", F.explode(F.slice(F.split(name, " und "), 1, 2)).alias("person"))


@query(
    "str_descriptors",
    "WITH w AS (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS w FROM part), n AS (SELECT p_brand, w, count(*) AS n FROM w WHERE length(w) > 2 AND w NOT IN ('the', 'green') GROUP BY ALL) SELECT p_brand, string_agg(w, '|' ORDER BY n DESC, w) AS words FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w) <= 3) GROUP BY 1",
)
def str_descriptors(t: Tables) -> DataFrame:
    stop = t.spark.createDataFrame([("the",), ("green",)], "word string")
    return R.top_words(t.part, "p_brand", "p_name", stop, 3)


#: Made-up register entries; lists are joined by line ends.
_REG = {
    "company": "concat('co', CAST(s_suppkey AS VARCHAR(9)))",
    "csh": "CASE WHEN s_suppkey % 4 < 3 THEN concat('holding ', CAST(s_suppkey % 7 AS VARCHAR(9)), chr(10), 'mr boss', CAST(s_suppkey % 3 AS VARCHAR(9)), ' klein') END",
    "csh_share": "concat('>50', chr(10), CAST(s_suppkey % 90 AS VARCHAR(9)), ',5')",
    "csh_man": "concat('no', chr(10), 'yes')",
    "sub": "CASE WHEN s_suppkey % 3 = 0 THEN concat('tochter', CAST(s_suppkey % 11 AS VARCHAR(9)), chr(10), 'tochter', CAST(s_suppkey % 13 + 20 AS VARCHAR(9))) END",
    "sub_share": "concat('WO', chr(10), 'n.v.')",
    "man": "CASE WHEN s_suppkey % 2 = 0 THEN concat('max muster', CAST(s_suppkey % 5 AS VARCHAR(9)), chr(10), 'verwaltungsgesellschaft x') END",
    "titled": "concat('hr. max muster', CAST(s_suppkey % 5 AS VARCHAR(9)))",
    "man_fun": "concat('Vorstand', chr(10), 'Prokurist')",
    "man_loc": "'berlin'",
}


def register(t: Tables) -> DataFrame:
    return t.supplier.select(*[F.expr(x).alias(k) for k, x in _REG.items()])


def relations(t: Tables) -> DataFrame:
    r = register(t)
    chain = G.relation_rows(r, "company", "csh", "CSH", F.lit("mother company"), shares="csh_share", managers="csh_man", upward=True)
    subs = G.relation_rows(r, "company", "sub", "TGS", F.lit("subsidiary"), shares="sub_share", distance=-1)
    return chain.unionByName(subs).unionByName(G.manager_rows(r, "company", "man", "titled", "man_fun", "man_loc"))


_RELATIONS = """rl AS (
    SELECT 'co' || s_suppkey AS company, 'holding ' || s_suppkey % 7 AS connection, 'CSH' AS attribute, 2 AS distance, 50.09999 AS share, 'no' AS ismanager, 'Unternehmen' AS person, 'mother company' AS function, '' AS location FROM supplier WHERE s_suppkey % 4 < 3
    UNION ALL SELECT 'co' || s_suppkey, 'boss' || s_suppkey % 3 || ' klein', 'CSH', 1, s_suppkey % 90 + 0.5, 'yes', 'Person', 'mother company', '' FROM supplier WHERE s_suppkey % 4 < 3
    UNION ALL SELECT 'co' || s_suppkey, 'tochter' || s_suppkey % 11, 'TGS', -1, 98.09999, NULL, 'Unternehmen', 'subsidiary', '' FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT 'co' || s_suppkey, 'tochter' || s_suppkey % 13 + 20, 'TGS', -1, NULL, NULL, 'Unternehmen', 'subsidiary', '' FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT 'co' || s_suppkey, 'max muster' || s_suppkey % 5, 'MAN', 1, 0, 'Vorstand', 'Person', 'Vorstand', 'berlin' FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 'co' || s_suppkey, 'verwaltungsgesellschaft x', 'MAN', 1, 0, 'Prokurist', 'Unternehmen', 'Prokurist', '' FROM supplier WHERE s_suppkey % 2 = 0)"""


@query("reg_relations", f"WITH {_RELATIONS} SELECT company, connection, attribute, distance, round(share::DOUBLE, 6) AS share, ismanager, person, function, location FROM rl")
def reg_relations(t: Tables) -> DataFrame:
    return relations(t).withColumn("share", F.round("share", 6))


#: Entries of all sources from sales lines: which sources a company (an order's client) has, differs by company.
_SOURCES = ["CSH", "KMn", "KMg", "ATE", "TGS", "TGS2", "MAN"]
_LISTED = """src AS (SELECT s.client_id AS company, (l.item_id % 8)::BIGINT AS connection, ['CSH', 'KMn', 'KMg', 'ATE', 'TGS', 'TGS2', 'MAN'][CAST((s.client_id // 3 + l.line_no * (1 + s.client_id % 5)) % 7 AS INT) + 1] AS attribute,
        l.line_no AS distance, l.quantity % 90 AS share, CASE WHEN l.vendor_id % 3 = 0 THEN 'yes' ELSE 'no' END AS ismanager, CASE WHEN l.vendor_id % 4 = 0 THEN 'ort' || l.vendor_id % 5 ELSE '' END AS location
        FROM sales s JOIN sale_lines l USING (sale_id) WHERE s.client_id IS NOT NULL AND l.item_id IS NOT NULL AND l.vendor_id IS NOT NULL AND l.line_no IS NOT NULL)"""


def listed(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in _SOURCES]), ((F.floor(c("client_id") / 3) + c("line_no") * (1 + c("client_id") % 5)) % 7 + 1).cast("int"))
    rows = t.sales.select("sale_id", "client_id").join(t.sale_lines, "sale_id").dropna(subset=["client_id", "item_id", "vendor_id", "line_no"])
    return rows.select(c("client_id").alias("company"), (c("item_id") % 8).cast("long").alias("connection"), kind.alias("attribute"), c("line_no").alias("distance"), (c("quantity") % 90).alias("share"), F.when(c("vendor_id") % 3 == 0, "yes").otherwise("no").alias("ismanager"), F.when(c("vendor_id") % 4 == 0, F.concat(F.lit("ort"), c("vendor_id") % 5)).otherwise("").alias("location"))


@query(
    "reg_sources",
    f"""WITH {_LISTED}, csh AS (SELECT company, arg_max(connection, (distance, -connection)) AS mother FROM src WHERE attribute = 'CSH' GROUP BY 1), kmn AS (SELECT company, min(connection) AS mother FROM src WHERE attribute = 'KMn' GROUP BY 1), kmg AS (SELECT company, min(connection) AS top FROM src WHERE attribute = 'KMg' GROUP BY 1),
    kept AS (SELECT * FROM src WHERE attribute IN ('CSH', 'ATE', 'TGS', 'TGS2', 'MAN')
        UNION ALL SELECT src.* FROM src JOIN kmn USING (company) WHERE attribute = 'KMn' AND company NOT IN (SELECT company FROM csh) AND kmn.mother <> company
        UNION ALL SELECT src.* FROM src JOIN kmg USING (company) LEFT JOIN csh USING (company) LEFT JOIN kmn USING (company) WHERE attribute = 'KMg' AND top <> company AND top IS DISTINCT FROM coalesce(csh.mother, kmn.mother))
    SELECT company, connection, arg_min(attribute, list_position(['CSH', 'KMn', 'KMg', 'ATE', 'TGS', 'TGS2', 'MAN'], attribute)) AS attribute, max(share) AS share, max(ismanager) AS ismanager, max(CASE WHEN location <> '' THEN location END) AS location FROM kept GROUP BY ALL""",
)
def reg_sources(t: Tables) -> DataFrame:
    return N.merged_relations(N.preferred_sources(listed(t)), _SOURCES)


@query(
    "reg_edges",
    f"""WITH {_RELATIONS} SELECT r.company AS conn_left, connection AS conn_right, round(share::DOUBLE, 6) AS share, ismanager, function, attribute, person AS isperson FROM rl r WHERE attribute = 'CSH' AND distance = 1
    UNION ALL SELECT b.connection, a.connection, round(a.share::DOUBLE, 6), a.ismanager, a.function, a.attribute, a.person FROM rl a JOIN rl b ON a.company = b.company AND a.distance = 2 AND b.distance = 1 AND a.attribute = 'CSH' AND b.attribute = 'CSH'
    UNION ALL SELECT connection, company, round(share::DOUBLE, 6), ismanager, function, attribute, person FROM rl WHERE distance < 0
    UNION ALL SELECT company, connection || CASE WHEN location <> '' THEN '_' || location ELSE '' END, share, ismanager, function, attribute, person FROM rl WHERE attribute = 'MAN'""",
)
def reg_edges(t: Tables) -> DataFrame:
    return G.edges_of(relations(t)).withColumn("share", F.round("share", 6))


_PEOPLE = "SELECT 'co' || s_suppkey % 20 AS company, CASE s_suppkey % 5 WHEN 0 THEN 'anna muster-klein' WHEN 1 THEN 'anna muster' WHEN 2 THEN 'eva frei-herr' WHEN 3 THEN 'klein carl' ELSE 'hof gmbh-x' END AS connection, CASE WHEN s_suppkey % 5 = 4 THEN 'Unternehmen' ELSE 'Person' END AS person, s_suppkey AS k FROM supplier"


@query("reg_unified_names", f"WITH p AS ({_PEOPLE}) SELECT k, company, person, CASE WHEN connection = 'anna muster-klein' AND EXISTS (SELECT 1 FROM p q WHERE q.company = p.company AND q.connection = 'anna muster') THEN 'anna muster' WHEN connection = 'klein carl' THEN 'carl klein' ELSE connection END AS connection FROM p")
def reg_unified_names(t: Tables) -> DataFrame:
    k = c("s_suppkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("anna muster-klein", "anna muster", "eva frei-herr", "klein carl", "hof gmbh-x")]), (k % 5 + 1).cast("int"))
    rows = t.supplier.select(F.concat(F.lit("co"), k % 20).alias("company"), name.alias("connection"), F.when(k % 5 == 4, G.COMPANY).otherwise(G.PERSON).alias("person"), k.alias("k"))
    return G.unified_persons(rows, {"klein carl": "carl klein"})


_NAMED = "SELECT DISTINCT o_custkey % 30 AS comp, 'k' || o_custkey AS l, CASE o_orderkey % 4 WHEN 0 THEN 'anna muster' WHEN 1 THEN 'anna muster_ort' || o_orderkey % 7 WHEN 2 THEN 'eva frei' ELSE 'hof gmbh' END AS r, CASE WHEN o_orderkey % 4 = 3 THEN 'Unternehmen' ELSE 'Person' END AS isperson FROM orders"


@query("reg_located_names", f"WITH e AS ({_NAMED}), b AS (SELECT comp, max(r) AS best FROM e WHERE r LIKE 'anna muster\\_%' ESCAPE '\\' GROUP BY 1) SELECT DISTINCT e.comp, l, CASE WHEN r = 'anna muster' THEN coalesce(best, r) ELSE r END AS r, isperson FROM e LEFT JOIN b ON e.comp = b.comp")
def reg_located_names(t: Tables) -> DataFrame:
    k = c("o_orderkey")
    name = F.when(k % 4 == 0, "anna muster").when(k % 4 == 1, F.concat(F.lit("anna muster_ort"), k % 7)).when(k % 4 == 2, "eva frei").otherwise("hof gmbh")
    rows = t.orders.select((c("o_custkey") % 30).alias("comp"), F.concat(F.lit("k"), "o_custkey").alias("l"), name.alias("r"), F.when(k % 4 == 3, G.COMPANY).otherwise(G.PERSON).alias("isperson")).distinct()
    return G.located_names(rows, "comp", "l", "r")


@query("gra_lookup", f"WITH {D._EDGES} SELECT DISTINCT CAST(substr(a, 2) AS BIGINT) % 9 AS comp, 2 AS how FROM e WHERE b = 's3'")
def gra_lookup(t: Tables) -> DataFrame:
    return G.community_of(D.edges(t).withColumn("comp", F.substring("a", 2, 20).cast("long") % 9), "s3", "comp", "a", "b")


@query("gra_lookup_part", f"WITH {D._EDGES} SELECT DISTINCT CAST(substr(a, 2) AS BIGINT) % 50 AS comp, 3 AS how FROM e WHERE contains('x' || a, 'c1') OR contains('x' || b, 'c1')")
def gra_lookup_part(t: Tables) -> DataFrame:
    e = D.edges(t).select((F.substring("a", 2, 20).cast("long") % 50).alias("comp"), F.concat(F.lit("x"), "a").alias("a"), F.concat(F.lit("x"), "b").alias("b"))
    return G.community_of(e, "c1", "comp", "a", "b")


@query(
    "gra_owner_communities",
    """WITH x AS (SELECT o_orderkey, 'w' || o_custkey % 300 AS owner, CASE WHEN o_custkey % 300 % 4 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE 'k' || o_orderkey % 3 END AS community FROM orders), n AS (SELECT owner, community, count(*) n FROM x WHERE community IS NOT NULL GROUP BY ALL),
    b AS (SELECT owner, community AS best FROM n QUALIFY row_number() OVER (PARTITION BY owner ORDER BY n DESC, community) = 1), a AS (SELECT owner, CAST(9998 + row_number() OVER (ORDER BY owner) AS VARCHAR) AS nr FROM (SELECT DISTINCT owner FROM x WHERE owner NOT IN (SELECT owner FROM b)))
    SELECT o_orderkey, x.owner, coalesce(best, nr) AS community FROM x LEFT JOIN b USING (owner) LEFT JOIN a USING (owner)""",
)
def gra_owner_communities(t: Tables) -> DataFrame:
    w, k = c("o_custkey") % 300, c("o_orderkey")
    rows = t.orders.select("o_orderkey", F.concat(F.lit("w"), w).alias("owner"), F.when((w % 4 != 0) & (k % 5 != 0), F.concat(F.lit("k"), k % 3)).alias("community"))
    return G.owner_communities(rows, "owner", "community")


@query(
    "gra_members_report",
    f"""WITH {_RELATIONS}, e AS (SELECT 'n' || CAST(substr(company, 3) AS INT) % 6 AS comp, company AS l, connection AS r, person FROM rl), mb AS (SELECT comp, l AS member FROM e UNION SELECT comp, r FROM e), kd AS (SELECT r AS member, max(person) AS kind FROM e GROUP BY 1), ld AS (SELECT 'co' || l_suppkey AS member, sum(l_quantity) AS area, count(*) AS parcels FROM lineitem GROUP BY 1)
    SELECT comp, member, coalesce(kind, 'Unternehmen') AS kind, area, coalesce(parcels, 0) AS parcels FROM mb LEFT JOIN kd USING (member) LEFT JOIN ld USING (member)""",
)
def gra_members_report(t: Tables) -> DataFrame:
    e = relations(t).select(F.concat(F.lit("n"), F.substring("company", 3, 20).cast("int") % 6).alias("comp"), c("company").alias("l"), c("connection").alias("r"), c("person").alias("isperson"))
    land = t.lineitem.select(F.concat(F.lit("co"), "l_suppkey").alias("owner"), "l_quantity")
    return G.members_report(e, land, "comp", "l", "r", "owner", "l_quantity")


@query(
    "jn_owner_matches",
    """WITH p AS (SELECT 'co' || s_suppkey AS company, 'p' || s_suppkey AS person, 'f' || s_suppkey % 40 AS f, ['an', 'max', 'eva-maria'][s_suppkey % 3 + 1] AS g FROM supplier), o AS (SELECT 'o' || c_custkey AS owner, 'a' || c_nationkey AS address, 'f' || c_custkey % 60 AS f, ['anna', 'maxim', 'eva', 'jo'][c_custkey % 4 + 1] AS g, c_acctbal AS area FROM customer),
    x AS (SELECT company, person, owner || '_' || address AS match, area FROM p JOIN o ON p.f = o.f AND contains(o.g, split_part(p.g, '-', 1)))
    SELECT company, person, row_number() OVER (PARTITION BY company, person ORDER BY match, area) AS nr, match, max(area) OVER (PARTITION BY company, person) AS max_area, count(*) OVER (PARTITION BY company, person) AS matches FROM x""",
)
def jn_owner_matches(t: Tables) -> DataFrame:
    pick = lambda k, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    s, k = c("s_suppkey"), c("c_custkey")
    people = t.supplier.select(F.concat(F.lit("co"), s).alias("company"), F.concat(F.lit("p"), s).alias("person"), F.concat(F.lit("f"), s % 40).alias("family"), pick(s, "an", "max", "eva-maria").alias("given"))
    owners = t.customer.select(F.concat(F.lit("o"), k).alias("owner"), F.concat(F.lit("a"), "c_nationkey").alias("address"), F.concat(F.lit("f"), k % 60).alias("family"), pick(k, "anna", "maxim", "eva", "jo").alias("given"), c("c_acctbal").alias("area"))
    return G.owner_matches(people, owners, "company", "person", "family", "given", "owner", "address", "area").withColumn("nr", c("nr").cast("long"))


def _keyed_cc(name: str, where: str) -> str:
    return f"""u{name} AS (SELECT a, b FROM e WHERE {where} UNION SELECT b, a FROM e WHERE {where}),
    cc{name}(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u{name} GROUP BY a UNION SELECT u.a, min(cc{name}.component) FROM cc{name} JOIN u{name} u ON cc{name}.node = u.b JOIN recurring.cc{name} AS old ON old.node = u.a WHERE cc{name}.component < old.component GROUP BY u.a)"""


_STRONG = "(share >= {0} OR ismanager = 'yes' AND share < {0})"


def _nested_sql(thresholds: tuple[int, ...]) -> str:
    parts = [_keyed_cc("", "TRUE")]
    for t in thresholds:
        parts.append(_keyed_cc(str(t), _STRONG.format(t)))
        parts.append(f"l{t} AS (SELECT cc{t}.node, cc.component || '_' || dense_rank() OVER (PARTITION BY cc.component ORDER BY cc{t}.component) AS label FROM cc{t} JOIN cc ON cc.node = cc{t}.node)")
    out = ", ".join(f"CASE WHEN {_STRONG.format(t)} THEN l{t}.label END AS community_{t}" for t in thresholds)
    joins = " ".join(f"LEFT JOIN l{t} ON e.a = l{t}.node" for t in thresholds)
    return f"WITH RECURSIVE {D._EDGES}, {', '.join(parts)} SELECT e.a, e.b, cc.component AS community_0, {out} FROM e JOIN cc ON e.a = cc.node {joins}"


@query("gra_cc_nested", _nested_sql((15, 25, 50)))
def gra_cc_nested(t: Tables) -> DataFrame:
    return G.hierarchy(D.edges(t), "a", "b", "share", (15, 25, 50), c("ismanager") == "yes").select("a", "b", "community_0", "community_15", "community_25", "community_50")


@query("jn_accept_by_class")
def jn_accept_by_class(t: Tables) -> DataFrame:
    """The best name of a size, by the weighted ratio: more than 85 for private owners, 70 for others."""
    left = t.part.where("p_partkey % 2 = 0").select("p_partkey", "p_size", "p_name", F.when(c("p_partkey") % 4 == 0, 85).otherwise(70).alias("accept"))
    return M.best_in_block(left, t.part.where("p_partkey % 2 = 1").select("p_size", "p_name"), "p_size", "p_name", "accept", similarity.weighted, strict=True)


@query(
    "jn_contains_part",
    """WITH p AS (SELECT DISTINCT substr(split_part(p_name, ' ', 1), 1, 3) AS first, substr(split_part(p_name, ' ', 2), 2, 4) AS last FROM part), n AS (SELECT DISTINCT p_name FROM part)
    SELECT first, last, p_name FROM p JOIN n ON contains(lower(p_name), lower(last)) AND contains(lower(p_name), lower(first)) WHERE last <> ''""",
)
def jn_contains_part(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    people = t.part.select(F.substring(F.get(words, F.lit(0)), 1, 3).alias("first"), F.substring(F.coalesce(F.get(words, F.lit(1)), F.lit("")), 2, 4).alias("last")).distinct()
    return M.parts_containing(people, t.part.select("p_name").distinct(), "first", "last", "p_name").select("first", "last", "p_name")
