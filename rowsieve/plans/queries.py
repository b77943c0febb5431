"""One query per operator over the driver's tables, and SQL that gives the same rows.

All run over whole tables. Pairs for the pair operators are rows with successive keys, so there are as many pairs as rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.config import LshParams, MinHashConfig, SieveConfig
from rowsieve.functions import grams, keys, similarity
from rowsieve.functions import normalize as n
from rowsieve.functions.latin import register
from rowsieve.functions.phone import normalize_phone
from rowsieve.operators import candidates, exact, scoring
from rowsieve.operators.components import connected_components
from rowsieve.operators.normalize import normalize_rows
from rowsieve.plans.duplicates import find_duplicates, find_in_normalized
from rowsieve.plans.storage import store
from rowsieve.sources import rows as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The band parameters as configured, for queries whose SQL has them written out.
FIXED = MinHashConfig(calibrate=False)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_table(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


def part_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_rows(part_rows(spark, sf_dir))


def name_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in four spellings, for the exact stage."""
    k, name = F.col("p_partkey"), F.concat("p_name", F.lit(" of the main store"))
    spelt = F.when(k % 4 == 0, F.concat(name, F.lit(" "), "p_brand")).when(k % 4 == 1, F.concat("p_brand", F.lit(" "), name))
    spelt = spelt.when(k % 4 == 2, F.replace(F.concat(name, F.lit(" "), "p_brand"), F.lit("#"), F.lit(""))).otherwise(F.concat(name, F.lit(" - "), "p_brand"))
    return table(spark, sf_dir, "part").select(k.alias("row_id"), F.lower(spelt).alias("value"))


def value_pairs(values: DataFrame) -> DataFrame:
    a = values.select(F.col("row_id").alias("first"), F.col("value").alias("left"))
    b = values.select(F.col("row_id").alias("second"), F.col("value").alias("right"))
    return a.join(b, F.col("first") + 1 == F.col("second"))


# The same in SQL.

TEXT = "trim(regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '[^a-z0-9\\s@._/#&+\\-]', '', 'g'))"
PART = f"""
cells AS (SELECT p_partkey AS row_id, list_filter([{', '.join(TEXT.format(f'lower({c})') for c in ('p_name', 'p_brand', 'p_type'))}], lambda x: length(x) >= 2) AS cells FROM part),
vals AS (SELECT row_id, array_to_string(cells, ' | ') AS value FROM cells WHERE length(array_to_string(cells, ' | ')) >= 3)"""
NAMES = """
names AS (SELECT p_partkey, p_brand, p_name || ' of the main store' AS p_name FROM part),
vals AS (SELECT p_partkey AS row_id, lower(CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN p_brand || ' ' || p_name
    WHEN 2 THEN replace(p_name || ' ' || p_brand, '#', '') ELSE p_name || ' - ' || p_brand END) AS value FROM names)"""
KEYED = """
keyed AS (SELECT row_id, value, list_sort(list_filter(string_split_regex(value, '[^\\p{L}0-9]+'), lambda t: t <> '')) AS tokens,
    regexp_replace(value, '[^A-Za-z0-9]', '', 'g') AS alnum FROM vals)"""
TYPE = """CASE WHEN regexp_matches({0}, '(?i)\\b(?:isbn(?::|\\s))?\\s*(97[89][- ]?)?\\d{{1,5}}[- ]?\\d{{1,7}}[- ]?\\d{{1,7}}[- ]?[\\dX]\\b') THEN 'ISBN'
    WHEN regexp_matches({0}, '\\b(?:[0-9a-fA-F]{{32}}|[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}})\\b') THEN 'HASH'
    WHEN regexp_full_match({0}, '(?i)(?:[a-z][a-z0-9+.-]*://.*|\\w+\\.[a-z]{{2,}}.*)') THEN 'URL'
    WHEN length(regexp_replace({0}, '\\D', '', 'g')) >= 10 THEN 'PHONE' ELSE 'PLAIN' END"""
EXACT = f"""
{KEYED},
typed AS (SELECT *, array_to_string(tokens, chr(1)) AS canonical, {TYPE.format('value')} AS type FROM keyed),
classes AS (SELECT canonical, min(row_id) AS class, any_value(tokens) AS tokens FROM typed GROUP BY canonical),
forms AS (SELECT DISTINCT alnum, type, canonical, length(value) AS len, class, c.tokens FROM typed JOIN classes c USING (canonical) WHERE alnum <> ''),
edges AS (
    SELECT DISTINCT a.class AS a, b.class AS b FROM forms a JOIN forms b ON a.alnum = b.alnum AND a.type = b.type AND a.class < b.class AND abs(a.len - b.len) <= 2
    WHERE 2 * list_sum(list_transform(list_distinct(a.tokens), lambda t: least(len(list_filter(a.tokens, lambda x: x = t)), len(list_filter(b.tokens, lambda y: y = t)))))
        >= len(a.tokens) + len(b.tokens) - list_sum(list_transform(list_distinct(a.tokens), lambda t: least(len(list_filter(a.tokens, lambda x: x = t)), len(list_filter(b.tokens, lambda y: y = t)))))
),
reach AS (SELECT class AS node, class AS top FROM classes UNION SELECT e.node, r.top FROM (SELECT a AS node, b AS other FROM edges UNION SELECT b, a FROM edges) e JOIN reach r ON r.node = e.other),
groups AS (SELECT row_id, value, min(top) AS component FROM typed JOIN classes USING (canonical) JOIN reach ON node = class GROUP BY row_id, value),
sized AS (SELECT *, count(*) OVER (PARTITION BY component) AS group_size FROM groups)"""
PADDED = "' ' || replace({}, '|', ' ') || ' '"
GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))".format(f"({PADDED.format('value')})")


HASHED = f"""
points AS (SELECT row_id, value, list_transform({GRAMS}, lambda g: ((unicode(substr(g, 1, 1)) * 31 + unicode(substr(g, 2, 1))) * 31 + unicode(substr(g, 3, 1)))::UBIGINT & 4294967295) AS raw FROM vals),
h1 AS (SELECT row_id, value, unnest(raw) AS x FROM points),
h2 AS (SELECT row_id, value, (xor(x, x >> 16) * {grams.FIRST}::UBIGINT) & 4294967295 AS x FROM h1),
h3 AS (SELECT row_id, value, (xor(x, x >> 15) * {grams.SECOND}::UBIGINT) & 4294967295 AS x FROM h2),
hashed AS (SELECT DISTINCT row_id, value, xor(x, x >> 16) AS x FROM h3)"""
SEEDS = f"seeds AS (SELECT unnest({[int(s) for s in grams.seeds(FIXED)]}::UBIGINT[]) AS seed, unnest(range({FIXED.signature})) AS slot)"
SIGNED = f"""
{HASHED}, {SEEDS},
s1 AS (SELECT DISTINCT value, x FROM hashed),
s2 AS (SELECT value, slot, (xor(xor(x, seed), xor(x, seed) >> 16) * {grams.FIRST}::UBIGINT) & 4294967295 AS x FROM s1, seeds),
s3 AS (SELECT value, slot, (xor(x, x >> 15) * {grams.SECOND}::UBIGINT) & 4294967295 AS x FROM s2),
s4 AS (SELECT value, slot, xor(x, x >> 16)::BIGINT AS x FROM s3),
mins AS (SELECT value, slot, min(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) AS x FROM s4 GROUP BY value, slot)"""
KEYS = f"""
bands AS (SELECT DISTINCT a.value, a.x AS high, b.x AS low FROM mins a JOIN mins b ON a.value = b.value AND b.slot = a.slot + 1 WHERE a.slot % {FIXED.lsh.band_size} = 0)"""


# Normalizers.


@query(f"SELECT p_partkey, {TEXT.format("lower(p_name || chr(9) || '(' || p_brand || ')')")} AS value FROM part")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = n.prepare(F.concat("p_name", F.lit("\t("), "p_brand", F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", n.normalize_text(cell).alias("value"))


@query("""
SELECT page_id, array_to_string(list_slice(string_split(regexp_replace(string_split(string_split(
    regexp_replace(lower(trim(url)), '^(?:https?://)?(?:www\\.)?', ''), '#')[1], '?')[1], '/+$', ''), '/'), 1, 3), '/') AS value FROM pages""")
def norm_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", n.normalize_url(n.prepare(F.col("url"))).alias("value"))


def _emails() -> Column:
    k = F.col("c_custkey")
    domain = F.element_at(F.array(*map(F.lit, ["GoogleMail.com", "gmail.com", "yandex.ru", "example.org", "localhost"])), (k % 5 + 1).cast("int"))
    return F.concat(F.lit(" John.Q."), k.cast("string"), F.when(k % 2 == 0, "+list").otherwise(""), F.lit("@"), domain)


@query("""
WITH e AS (SELECT c_custkey, lower('john.q.' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '+list' ELSE '' END) AS local,
    lower(['GoogleMail.com', 'gmail.com', 'yandex.ru', 'example.org', 'localhost'][c_custkey % 5 + 1]) AS domain FROM customer)
SELECT c_custkey, domain <> 'localhost' AS is_email, CASE WHEN domain <> 'localhost' THEN
    CASE WHEN domain IN ('googlemail.com', 'gmail.com', 'yandex.ru') THEN regexp_replace(replace(local, '.', ''), '\\+[^@]+$', '') ELSE local END
    || '@' || replace(domain, 'googlemail', 'gmail') END AS value FROM e""")
def norm_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", n.prepare(_emails()).alias("v"))
    return rows.select("c_custkey", n.is_email(F.col("v")).alias("is_email"), F.when(n.is_email(F.col("v")), n.normalize_email(F.col("v"))).alias("value"))


@query("""
WITH d AS (SELECT o_orderkey, o_orderkey % 5 AS kind, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, strftime(CASE kind
    WHEN 1 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END
    WHEN 4 THEN make_date(year(d), 2, CASE WHEN year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0) THEN 29 ELSE 28 END)
    ELSE d END, '%Y-%m-%d') AS value FROM d""")
def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    forms = ["dd/MM/yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd't'HH:mm:ss", "'31/02/'yyyy"]
    spelt = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        spelt = F.when(F.col("o_orderkey") % 5 == i, F.date_format(d, form)).otherwise(spelt)
    return table(spark, sf_dir, "orders").select("o_orderkey", n.normalize_date(spelt).alias("value"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN (s_suppkey % 90) || '.5,' || CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '' END || (s_suppkey % 180) || '.25' END AS value FROM supplier""")
def norm_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lat, lon = F.concat((k % 90).cast("string"), F.lit(".5")), F.concat(F.when(k % 2 == 0, "-").otherwise(""), (k % 180).cast("string"), F.lit(".25"))
    spelt = F.when(k % 3 == 0, F.concat(F.lit("("), lat, F.lit(", "), lon, F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("lat: "), lat, F.lit("° n "), lon, F.lit("° e"))).otherwise(F.concat(lat, lon))
    return table(spark, sf_dir, "supplier").select("s_suppkey", n.normalize_geo(spelt).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN '0.5' END AS value FROM part")
def norm_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = F.element_at(F.array(*map(F.lit, ["1/2", "50%", "50 %", "51%"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", n.normalize_fraction(spelt).alias("value"))


@query("""
WITH p AS (SELECT c_custkey, 200 + c_custkey % 800 AS area, 100 + c_custkey % 900 AS office, 1000 + c_custkey % 9000 AS line FROM customer)
SELECT c_custkey, CASE WHEN office >= 200 AND regexp_full_match(area::VARCHAR, '[2-9](?:[02-8][0-9]|1[02-9]|9[0-8])') THEN '+1' || area || office || line END AS value FROM p""")
def norm_phone_nanp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    area, office, line = ((low + k % high).cast("string") for low, high in ((200, 800), (100, 900), (1000, 9000)))
    spelt = F.when(k % 3 == 0, F.concat(F.lit("+1 ("), area, F.lit(") "), office, F.lit("-"), line)).when(k % 3 == 1, F.concat_ws("-", area, office, line)).otherwise(F.concat(F.lit("001"), area, office, line))
    return table(spark, sf_dir, "customer").select("c_custkey", normalize_phone(spelt, "US").alias("value"))


@query(f"WITH {PART} SELECT row_id, value FROM vals")
def norm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_values(spark, sf_dir)


@query(f"""
WITH cells AS (SELECT c_custkey AS row_id, {TEXT.format("lower(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a!' ELSE left(c_mktsegment, (1 + c_custkey % 5)::INTEGER) END)")} AS cell FROM customer)
SELECT row_id, cell AS value FROM cells WHERE length(cell) >= 3""")
def short_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cell = F.when(k % 3 == 0, "").when(k % 3 == 1, "a!").otherwise(F.left("c_mktsegment", (1 + k % 5).cast("int")))
    return normalize_rows(table(spark, sf_dir, "customer").select(k.alias("row_id"), F.array(cell, F.lit(None).cast("string")).alias("cells")))


@query(f"WITH {PART} SELECT row_id AS id, array_to_string(list_transform(cells, lambda c: coalesce(c, '')), ' | ') AS line FROM cells")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_rows(spark, sf_dir)
    made = F.transform("cells", lambda c: n.normalize_cell(c))
    return rows.select(F.col("row_id").alias("id"), F.array_join(F.filter(made, lambda c: F.length(c) >= 2), " | ").alias("line"))


# Exact stage.


@query("""
WITH v AS (SELECT doc_id, regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS v FROM documents),
t AS (SELECT doc_id, CASE WHEN contains(v, '|') THEN string_split_regex(regexp_replace(v, '(?:[ \\t\\n\\f\\r\\v]*\\|[ \\t\\n\\f\\r\\v]*)+$', ''), '[ \\t\\n\\f\\r\\v]*\\|[ \\t\\n\\f\\r\\v]*')
    ELSE string_split_regex(regexp_replace(v, '[^\\p{L}0-9]+$', ''), '[^\\p{L}0-9]+') END AS tokens FROM v)
SELECT doc_id, md5(array_to_string(list_sort(tokens), chr(1))) AS canonical FROM t""")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(keys.canonical(keys.original(F.col("text")))).alias("canonical"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS alnum FROM documents")
def alnum_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(keys.alnum(keys.original(F.col("text")))).alias("alnum"))


@query(f"SELECT page_id, {TYPE.format('url')} AS type FROM (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN md5(url) ELSE '+' || page_id || ' / 1 / 2 / 3 / 4 / 5 / 6 / 7 / 8 / 9' END) AS url FROM pages)")
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id"), F.col("url")
    v = F.when(k % 3 == 0, url).when(k % 3 == 1, F.md5(url)).otherwise(F.concat(F.lit("+"), k.cast("string"), F.lit(" / 1 / 2 / 3 / 4 / 5 / 6 / 7 / 8 / 9")))
    return table(spark, sf_dir, "pages").select("page_id", keys.detect_type(keys.original(v)).alias("type"))


@query(f"WITH RECURSIVE {NAMES}, {EXACT} SELECT row_id, component, group_size FROM sized")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(name_values(spark, sf_dir)).select("row_id", "component", "group_size")


@query(f"WITH RECURSIVE {NAMES}, {EXACT} SELECT a.row_id AS first, b.row_id AS second FROM sized a JOIN sized b ON a.component = b.component AND a.row_id < b.row_id")
def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_pairs(exact.exact_groups(name_values(spark, sf_dir)))


@query(f"WITH RECURSIVE {NAMES}, {EXACT} SELECT component, list_sort(list(row_id)) AS members FROM sized WHERE group_size > 1 GROUP BY component")
def exact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.members(exact.exact_groups(name_values(spark, sf_dir)))


@query(f"WITH RECURSIVE {NAMES}, {EXACT} SELECT a, b FROM edges")
def alnum_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(exact.keyed(name_values(spark, sf_dir)), "exact-keys")
    return exact.alnum_edges(rows, exact.canonical_classes(rows))


@query(f"WITH RECURSIVE {NAMES}, {EXACT} SELECT row_id, value FROM sized WHERE group_size = 1")
def remaining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.remaining(exact.exact_groups(name_values(spark, sf_dir)))


@query("""
WITH RECURSIVE edges AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b FROM part WHERE p_partkey % 7 <> 0),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS top FROM both_ways UNION SELECT e.a, least(r.top, e.a) FROM both_ways e JOIN reach r ON r.node = e.b WHERE r.top < e.a)
SELECT node, min(top) AS component FROM reach GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return connected_components(table(spark, sf_dir, "part").where(k % 7 != 0).select(k.alias("a"), (k + 1 + F.col("p_size") % 3).alias("b")))


# Candidate stage.


@query(f"SELECT item_id, unnest({GRAMS}) AS gram FROM (SELECT item_id, text AS value FROM benchmark)")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(grams.trigrams(F.col("text"))).alias("gram"))


@query(f"WITH {PART}, {HASHED} SELECT (x & {grams.LOW_BITS})::INTEGER AS gram, count(*) AS df FROM hashed GROUP BY gram")
def gram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.document_frequency(part_values(spark, sf_dir))


@query(f"""
WITH {PART}, {HASHED}, df AS (SELECT (x & {grams.LOW_BITS})::INTEGER AS gram, count(*) AS df FROM hashed GROUP BY gram)
SELECT gram FROM df WHERE df >= (SELECT greatest(20, count(*) // 50) FROM vals) AND (SELECT count(*) >= 200 FROM vals)""")
def stop_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = store(part_values(spark, sf_dir), "values")
    return spark.createDataFrame([(int(g),) for g in candidates.noisy_grams(values, values.count(), FIXED)], "gram int")


@query("SELECT item_id, array_to_string(list_transform(list_filter(string_split_regex(text, '\\W+'), lambda w: w <> ''), lambda w: lower(left(w, 1))), '') AS acronym FROM benchmark")
def acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", grams.acronym(F.col("text")).alias("acronym"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))::INTEGER AS eff_len FROM documents")
def eff_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", grams.effective_length(F.col("text")).alias("eff_len"))


LENGTHS = """
lens AS (SELECT item_id, length(text)::INTEGER AS len, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))::INTEGER AS eff FROM benchmark)"""


@query(f"WITH {LENGTHS} SELECT a.item_id AS first, b.item_id AS second, least(a.eff, b.eff) < 16 OR abs(a.eff - b.eff) <= 0.5::DOUBLE * greatest(a.eff, b.eff) AS fits FROM lens a JOIN lens b ON a.item_id + 1 = b.item_id")
def len_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = value_pairs(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("value")))
    return pairs.select("first", "second", grams.lengths_compatible(grams.effective_length(F.col("left")), grams.effective_length(F.col("right"))).alias("fits"))


@query("""
WITH lens AS (SELECT c_custkey AS k, 1 + c_custkey % 40 AS a, 1 + c_custkey % 31 AS b FROM customer)
SELECT k, round(CASE WHEN least(a, b) < 5 THEN 0.22::DOUBLE WHEN least(a, b) >= 20 THEN 0.23::DOUBLE ELSE 0.22::DOUBLE + (least(a, b) - 5) / 15.0::DOUBLE * 0.01::DOUBLE END, 9) AS threshold,
    (CASE WHEN least(a, b) < 18 THEN 5 ELSE 8 END)::INTEGER AS least_overlap FROM lens""")
def lsh_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a, b = (1 + k % 40).cast("int"), (1 + k % 31).cast("int")
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.round(grams.threshold(a, b), 9).alias("threshold"), grams.least_overlap(a, b).alias("least_overlap"))


@query(f"""
WITH {NAMES}, g AS (SELECT row_id, {GRAMS} AS grams FROM vals)
SELECT a.row_id AS first, b.row_id AS second, round(len(list_intersect(a.grams, b.grams))::DOUBLE / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))), 6) AS jaccard
FROM g a JOIN g b ON a.row_id + 1 = b.row_id""")
def trigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = value_pairs(name_values(spark, sf_dir))
    return pairs.select("first", "second", F.round(grams.jaccard(grams.trigrams(F.col("left")), grams.trigrams(F.col("right"))), 6).alias("jaccard"))


@query("""
WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\\W+'), lambda x: length(x) > 3) AS words FROM benchmark)
SELECT a.item_id AS first, b.item_id AS second, len(list_filter(b.words, lambda x: list_contains(a.words, x))) >= 2 AS overlap FROM w a JOIN w b ON a.item_id + 1 = b.item_id""")
def word_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = value_pairs(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("value")))
    return pairs.select("first", "second", grams.words_overlap(F.col("left"), F.col("right")).alias("overlap"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the stop list, whose SQL is a query of its own."""
    return candidates.features(part_values(spark, sf_dir), np.zeros(0, dtype=np.int32), FIXED)


@query(f"WITH {PART}, {SIGNED} SELECT row_id, slot::INTEGER AS slot, x::INTEGER AS x FROM vals JOIN mins USING (value)")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("row_id", F.posexplode("signature").alias("slot", "x"))


@query(f"WITH {PART}, {SIGNED}, {KEYS} SELECT high::INTEGER AS high, low::INTEGER AS low, count(*) AS n FROM vals JOIN bands USING (value) GROUP BY high, low")
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys_ = _features(spark, sf_dir).select(F.explode("keys").alias("key"))
    # The key is high << 32 ^ low, low without a sign.
    low = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    signed = F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")
    return keys_.groupBy(F.shiftright("key", 32).cast("int").alias("high"), signed.alias("low")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH vals AS (SELECT item_id AS row_id, text AS value FROM benchmark), {SIGNED}, {KEYS}, k AS (SELECT row_id, high, low FROM vals JOIN bands USING (value))
SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM k a JOIN k b ON a.high = b.high AND a.low = b.low AND a.row_id < b.row_id""")
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("value"))
    return candidates.bucket_pairs(candidates.features(values, np.zeros(0, dtype=np.int32), FIXED))


@query()
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = part_values(spark, sf_dir).groupBy("value").agg(F.min("row_id").alias("row_id")).select("row_id", "value")
    return candidates.candidate_pairs(values).select("first", "second", F.round("jaccard", 6).alias("jaccard"))


PAIRS = f"""
{NAMES}, pairs AS (SELECT a.row_id AS first, b.row_id AS second, a.value AS l, b.value AS r FROM vals a JOIN vals b ON a.row_id + 1 = b.row_id)"""


@query(f"""
WITH {NAMES}, p AS (SELECT a.row_id AS first, b.row_id AS second, round(len(list_intersect({GRAMS.replace('value', 'a.value')}, {GRAMS.replace('value', 'b.value')}))::DOUBLE
    / (len({GRAMS.replace('value', 'a.value')}) + len({GRAMS.replace('value', 'b.value')}) - len(list_intersect({GRAMS.replace('value', 'a.value')}, {GRAMS.replace('value', 'b.value')}))), 6) AS jaccard
    FROM vals a JOIN vals b ON b.row_id - a.row_id BETWEEN 1 AND 5),
ends AS (SELECT first, second, first AS row, second AS other, jaccard FROM p UNION ALL SELECT first, second, second, first, jaccard FROM p),
placed AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY jaccard DESC, other) AS place FROM ends)
SELECT first, second FROM placed WHERE place <= 3 GROUP BY first, second HAVING count(*) = 2""")
def topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap of partners per row, on the pairs of rows up to five keys apart, with three kept."""
    values = name_values(spark, sf_dir)
    a = values.select(F.col("row_id").alias("first"), F.col("value").alias("left"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    b = values.select(F.col("row_id").alias("second"), F.col("value").alias("right"))
    pairs = a.join(b, F.col("first") + F.col("step") == F.col("second"))
    pairs = pairs.select("first", "second", F.round(grams.jaccard(grams.trigrams(F.col("left")), grams.trigrams(F.col("right"))), 6).alias("jaccard"))
    return candidates.best_partners(pairs, 3)


@query()
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = store(part_values(spark, sf_dir), "values")
    p: LshParams = candidates.calibrated(values, values.count(), MinHashConfig())
    return spark.createDataFrame([(p.band_size, p.band_count, p.thr_short, p.thr_long)], "band_size int, band_count int, thr_short double, thr_long double")


# Scores.


WORDS = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda t: t <> '' AND t <> '|'))"


@query(f"""
WITH {PAIRS}, t AS (SELECT first, second, {WORDS.format('l')} AS a, {WORDS.format('r')} AS b FROM pairs)
SELECT first, second, round(2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)), 9) AS score FROM t""")
def token_set_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_pairs(name_values(spark, sf_dir)).select("first", "second", F.round(similarity.token_set(F.col("left"), F.col("right")), 9).alias("score"))


@query(f"""
WITH {PAIRS}, d AS (SELECT first, second, l, r, greatest(length(l), length(r)) AS longer, ceil(greatest(length(l), length(r)) * 0.7::DOUBLE) AS most, levenshtein(l, r) AS d FROM pairs)
SELECT first, second, round(CASE WHEN l = '' OR r = '' OR abs(length(l) - length(r)) > most THEN 0.0::DOUBLE
    WHEN d <= most OR list_min(list_transform(range(0, length(r) + 1), lambda j: CASE WHEN j = 0 THEN length(l) ELSE levenshtein(l, left(r, j)) END)) <= most THEN 1 - d / longer::DOUBLE ELSE 0 END, 9) AS score FROM d""")
def levenshtein_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_pairs(name_values(spark, sf_dir)).select("first", "second", F.round(similarity.levenshtein(F.col("left"), F.col("right")), 9).alias("score"))


JARO = """
pair AS (SELECT *, greatest(greatest(length(l), length(r)) // 2 - 1, 0) AS reach FROM pairs),
step AS (
    SELECT *, 0::BIGINT AS i, []::BIGINT[] AS taken, '' AS hits FROM pair
    UNION ALL
    SELECT first, second, l, r, reach, i + 1, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END, CASE WHEN j IS NULL THEN hits ELSE hits || substr(l, i + 1, 1) END
    FROM (SELECT *, list_min(list_filter(range(greatest(1, i + 1 - reach), least(length(r), i + 1 + reach) + 1), lambda p: substr(r, p, 1) = substr(l, i + 1, 1) AND NOT list_contains(taken, p))) AS j
        FROM step WHERE i < length(l))
),
matched AS (SELECT *, len(taken) AS m, list_sum(list_transform(range(1, len(taken) + 1), lambda k: CASE WHEN substr(hits, k, 1) <> substr(r, list_sort(taken)[k], 1) THEN 1 ELSE 0 END)) AS moved FROM step WHERE i = length(l)),
jaro AS (SELECT *, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m / length(l)::DOUBLE + m / length(r)::DOUBLE + (m - moved / 2.0::DOUBLE) / m) / 3 END AS jaro,
    list_min(list_filter(range(1, 6), lambda k: k > least(4, length(l), length(r)) OR substr(l, k, 1) <> substr(r, k, 1))) - 1 AS prefix FROM matched),
winkler AS (SELECT first, second, l, r, CASE WHEN lower(l) = lower(r) THEN 1.0::DOUBLE WHEN abs(length(l) - length(r)) * 2 > greatest(length(l), length(r)) THEN 0.0::DOUBLE
    ELSE least(1.0::DOUBLE, jaro + prefix * 0.1::DOUBLE * (1 - jaro)) END AS jw FROM jaro)"""
WEIGHTED = f"""
{JARO},
t AS (SELECT *, {WORDS.format('l')} AS a, {WORDS.format('r')} AS b, greatest(length(l), length(r)) AS longer, ceil(greatest(length(l), length(r)) * 0.7::DOUBLE) AS most, levenshtein(l, r) AS d FROM winkler),
s AS (SELECT *, CASE WHEN len(list_intersect(a, b)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS token,
    CASE WHEN abs(length(l) - length(r)) > most THEN 0.0::DOUBLE
        WHEN d <= most OR list_min(list_transform(range(0, length(r) + 1), lambda j: CASE WHEN j = 0 THEN length(l) ELSE levenshtein(l, left(r, j)) END)) <= most THEN 1 - d / longer::DOUBLE ELSE 0.0::DOUBLE END AS lev FROM t),
weighted AS (SELECT first, second, l, r, longer::INTEGER AS max_len, 0.6::DOUBLE * token + 0.25::DOUBLE * lev + 0.1::DOUBLE * jw AS weighted FROM s),
routed AS (SELECT *, CASE WHEN weighted <= CASE WHEN max_len < 15 THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END THEN 'hard_reject'
    WHEN weighted >= CASE WHEN max_len < 30 THEN 0.65::DOUBLE ELSE 0.55::DOUBLE END THEN 'confirm' WHEN weighted > 0.35::DOUBLE THEN 'neural' ELSE 'drop' END AS route FROM weighted)"""


@query(f"WITH RECURSIVE {PAIRS}, {JARO} SELECT first, second, round(jw, 9) AS score FROM winkler")
def jaro_winkler_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_pairs(name_values(spark, sf_dir)).select("first", "second", F.round(similarity.jaro_winkler("left", "right"), 9).alias("score"))


@query(f"WITH RECURSIVE {PAIRS}, {WEIGHTED} SELECT first, second, round(weighted, 9) AS weighted, max_len FROM weighted")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(value_pairs(name_values(spark, sf_dir))).select("first", "second", F.round("weighted", 9).alias("weighted"), "max_len")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber * 13) % 96 / 100.0::DOUBLE AS weighted, ((l_orderkey + l_linenumber) % 50)::INTEGER AS max_len FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN weighted <= CASE WHEN max_len < 15 THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END THEN 'hard_reject'
    WHEN weighted >= CASE WHEN max_len < 30 THEN 0.65::DOUBLE ELSE 0.55::DOUBLE END THEN 'confirm' WHEN weighted > 0.35::DOUBLE THEN 'neural' ELSE 'drop' END AS route,
    weighted >= CASE WHEN max_len < 20 THEN 0.65::DOUBLE ELSE 0.78::DOUBLE END AS neural_confirm FROM p""")
def route_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both decisions, on scores and lengths made from keys."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 96 / F.lit(100.0)).alias("w"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 50).cast("int").alias("len"))
    return rows.select("l_orderkey", "l_linenumber", scoring.route(F.col("w"), F.col("len")).alias("route"), scoring.neural_confirmed(F.col("w"), F.col("len")).alias("neural_confirm"))


@query(f"WITH RECURSIVE {PAIRS}, {WEIGHTED} SELECT route, count(*) AS n FROM routed GROUP BY route")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.routed(scoring.scored(value_pairs(name_values(spark, sf_dir))))
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def length_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """A stand-in for a model: the shorter length by the longer."""
    return [min(len(a), len(b)) / max(len(a), len(b)) for a, b in pairs]


@query(f"""
WITH RECURSIVE {PAIRS}, {WEIGHTED}
SELECT first, second, round(least(length(l), length(r)) / max_len::DOUBLE, 9) AS neural,
    least(length(l), length(r)) / max_len::DOUBLE >= CASE WHEN max_len < 20 THEN 0.65::DOUBLE ELSE 0.78::DOUBLE END AS neural_confirm FROM routed WHERE route = 'neural'""")
def neural_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.routed(scoring.scored(value_pairs(name_values(spark, sf_dir)))).where("route = 'neural'")
    return scoring.with_neural(rows, length_scorer).select("first", "second", F.round("neural", 9).alias("neural"), "neural_confirm")


@query()
def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_in_normalized(name_values(spark, sf_dir)).counters


@query()
def find_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_duplicates(part_rows(spark, sf_dir), SieveConfig()).pairs
