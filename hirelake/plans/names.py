"""Registered queries on names, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import names
from hirelake.operators.pages import STOPWORDS
from hirelake.plans.catalog import _SOC
from hirelake.plans.companies import rows_sql
from hirelake.plans.fixtures import SOCS, TITLES, pick, view
from hirelake.plans.jobs import HOSTS, PATHS

COMPANY = (
    "Acme Holdings, Inc. dba Foo", "São Paulo Analytics / Zürich Labs (Formerly X)", "AT&T", "GE HealthCare Technologies Inc", "Loréal USA, Inc.", "The Big Company Group", "5 Consulting GmbH",
    "IBM/Red Hat LLC (US)", "X", "Blue Co", "formerly known", "Müller & Söhne AG", "/ /", "Uber Technologies",
)
LOUD = ("IT MANAGER II", "DIRECTOR OF (SQL) SYSTEMS", "VP, HEAD OF THE UX", "ENGINEER (III)", "[QA] LEAD, AND  MORE.", "A B", "123 - 4", "ÉTÉ ANALYST", "Mixed CASE Title", "THE END OF X", "((NEW) ONE", "")
NAMED = f"SELECT DISTINCT concat({pick(COMPANY, 'c_custkey')}, CASE WHEN c_custkey % 5 = 0 THEN concat(' ', CAST(c_custkey % 30 AS varchar(9))) ELSE '' END) AS name FROM customer"
EXTRA = rows_sql("name, match_key, match_kind", ("AT&T", "att", "prefix"), ("AT&T", "at-and-t", "prefix"), ("X", "ex", "exact"), ("Nobody", "none", "prefix"))
GUESSED = f"SELECT page_id AS site_id, concat({pick(COMPANY, 'page_id')}, CASE WHEN page_id % 3 = 0 THEN concat(' ', CAST(page_id AS varchar(20))) ELSE '' END) AS name, concat('https://', {pick(HOSTS, 'page_id')}, {pick(PATHS, 'page_id % 77')}) AS url, {pick((None, 'www.jobs.idbny.com', 'careers.acme-corp.io', 'newscorp.com', 'hr'), 'page_id')} AS domain FROM pages"
MAPPED = f"""
SELECT o_orderkey AS row_number, concat(' ', upper({pick(TITLES, 'o_custkey')}), {pick((' ', ' (SQL) ', ''), 'o_orderkey')}) AS raw_job_title, concat(' ', {pick(SOCS, 'o_custkey')}, ' ') AS soc_code, upper({pick(TITLES, 'o_custkey + 1')}) AS soc_title, CAST(o_orderkey % 50 AS varchar(9)) AS soc_count,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('1,', lpad(CAST(o_orderkey % 300 AS varchar(9)), 3, '0')) END AS raw_count FROM orders"""
SHOUTED = f"SELECT l_partkey % 997 AS k, CASE WHEN l_partkey % 3 = 0 THEN upper({pick(TITLES, 'l_partkey')}) ELSE {pick(LOUD, 'l_partkey')} END AS raw FROM lineitem"


def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, SHOUTED, "lineitem").groupBy("raw").agg(F.count("*").alias("rows"))
    return rows.select("raw", "rows", names.display_title(F.col("raw")).alias("title"))


def match_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.match_terms(view(spark, sf_dir, NAMED, "customer"), spark.sql(EXTRA))


def slug_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = names.slug_variants(F.col("name"), F.col("url"), F.col("domain"), STOPWORDS)
    return view(spark, sf_dir, GUESSED, "pages").select("site_id", F.posexplode(variants).alias("place", "slug"))


def title_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.title_mappings(view(spark, sf_dir, MAPPED, "orders"))


QUERIES = {f.__name__: f for f in (display_titles, match_terms, slug_variants, title_mappings)}

_OUT = r"[^\p{L}\p{N}]"


def _display(raw: str) -> str:
    core = rf"regexp_replace(w, '^{_OUT}+|{_OUT}+$', '', 'g')"
    shown = f"CASE WHEN upper({core}) IN {names.ACRONYMS!r} OR regexp_full_match(upper({core}), '[IVX]+') THEN upper({core}) WHEN i > 1 AND lower({core}) IN {names.SMALL_WORDS!r} THEN lower({core}) ELSE upper(left({core}, 1)) || lower(substr({core}, 2)) END"
    word = rf"{shown} || reverse(regexp_extract(w, '^({_OUT}*)[\p{{L}}\p{{N}}]', 1)) || regexp_extract(w, '({_OUT}*)$', 1)"
    text = rf"trim(regexp_replace({raw}, '\s+', ' ', 'g'))"
    return rf"CASE WHEN length(regexp_replace({text}, '[^\p{{Lu}}]', '', 'g')) * 10 > length(regexp_replace({text}, '[^\p{{L}}]', '', 'g')) * 9 THEN array_to_string(list_transform(string_split({text}, ' '), lambda w, i: {word}), ' ') ELSE {text} END"


def _slug(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(strip_accents({text})), '&', ' and '), '[^a-z0-9\s-]', ' ', 'g')), '\s+', '-', 'g'), '-+', '-', 'g'), '-')"


def _label(host: str) -> str:
    parts = rf"list_filter(string_split(regexp_replace(lower({host}), '^www\.', ''), '.'), lambda p: p <> '')"
    label = f"regexp_replace(CASE WHEN {parts}[1] IN {names.NOISE!r} AND len({parts}) > 1 THEN {parts}[2] ELSE {parts}[1] END, '[^a-z0-9]', '', 'g')"
    return f"CASE WHEN length({label}) >= 3 AND {label} NOT IN {names.NOISE!r} THEN {label} END"


ORACLES = {
    "display_titles": f"SELECT raw, count(*) AS rows, {_display('raw')} AS title FROM ({SHOUTED}) GROUP BY raw",
    "match_terms": rf"""
WITH n AS ({NAMED}), b AS (SELECT name, list_filter(list_transform(string_split(name, '/'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM n),
c AS (SELECT name, unnest(CASE WHEN len(ps) > 0 THEN list_transform(ps, lambda p: trim(regexp_replace(p, '\s*\([^)]*\)\s*$', ''))) ELSE [name] END) AS brand, generate_subscripts(CASE WHEN len(ps) > 0 THEN ps ELSE [name] END, 1) AS k FROM b),
t AS (SELECT name, 4 * k AS o, {_slug('brand')} AS key, 'brand' AS source FROM c UNION ALL SELECT name, 4 * k + 2, {_slug('name')}, 'linkedin_name' FROM c),
u AS (SELECT name, o, key, source FROM t UNION ALL SELECT name, o + 1, regexp_replace(key, '{names.LEGAL}', ''), source || ':stripped' FROM t),
v AS (SELECT name, o, key AS match_key, CASE WHEN length(key) <= 3 THEN 'exact' ELSE 'prefix' END AS match_kind, source AS term_source FROM u WHERE key <> '' UNION ALL SELECT name, 1000000, match_key, match_kind, 'manual_alias' FROM ({EXTRA}) WHERE name IN (SELECT name FROM n))
SELECT name, match_key, match_kind, arg_min(term_source, o) AS term_source FROM v GROUP BY ALL""",
    "slug_variants": rf"""
WITH w AS (SELECT site_id, list_filter(regexp_extract_all(lower(regexp_replace(name, '{names.ALSO}', ' ')), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN {STOPWORDS!r}) AS ws, [{_label('domain')}, {_label("regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)")}] AS hs FROM ({GUESSED})),
v AS (SELECT site_id, list_concat([array_to_string(ws, ''), array_to_string(ws, '-'), array_to_string(ws[1:2], ''), array_to_string(ws[1:2], '-')], list_filter(hs, lambda h: h IS NOT NULL AND (length(h) >= 7 OR len(list_filter(ws, lambda x: length(x) >= 4 AND contains(h, x))) > 0))) AS vs FROM w),
c AS (SELECT site_id, unnest(list_transform(vs, lambda x: trim(regexp_replace(x, '[^a-z0-9-]', '', 'g'), '-'))) AS slug, generate_subscripts(vs, 1) AS k FROM v),
d AS (SELECT site_id, slug, min(k) AS k FROM c WHERE length(slug) >= 3 AND slug NOT IN {names.COMMON!r} GROUP BY ALL)
SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY k) - 1 AS integer) AS place, slug FROM d QUALIFY place < 8""",
    "title_mappings": f"""
WITH r AS (SELECT row_number AS k, trim(raw_job_title) AS raw_job_title, {_SOC.replace('soc_code', 'trim(soc_code)')} AS normalized_soc_code, trim(soc_title) AS st, CAST(soc_count AS BIGINT) AS soc_lca_count, coalesce(CAST(replace(raw_count, ',', '') AS BIGINT), 0) AS raw_lca_count FROM ({MAPPED})),
b AS (SELECT * FROM r WHERE raw_job_title <> '' AND normalized_soc_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raw_job_title, normalized_soc_code ORDER BY raw_lca_count DESC, k) = 1)
SELECT raw_job_title, normalized_soc_code, {_display('st')} AS soc_title, soc_lca_count, raw_lca_count, {_display('raw_job_title')} AS normalized_job_title FROM b""",
}
