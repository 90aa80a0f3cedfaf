"""Names of companies and titles: display forms, slugs, match terms and guessed board names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hirelake.functions.titles import normalize_soc_code

#: Words that stay in capitals, and small words of titles.
ACRONYMS = (
    "IT", "SQL", "API", "UI", "UX", "HR", "AI", "ML", "AWS", "SAP", "QA", "SDE", "H1B", "II", "III", "IV", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "PM", "VP", "SVP",
    "EVP", "CEO", "CFO", "CTO", "COO", "US", "UK", "NYC", "SF", "LA",
)
SMALL_WORDS = ("a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "with")
#: Legal forms at the end of a key, labels of hosts that name nothing, and names too common for a board.
LEGAL = "-(inc|llc|ltd|corp|corporation|company|co|plc|gmbh|sa|ag|group)$"
NOISE = ("www", "jobs", "job", "careers", "career", "apply", "work", "join", "recruiting", "talent", "people", "hr")
COMMON = (
    "international", "national", "global", "services", "systems", "technology", "technologies", "solutions", "consulting", "corporate", "company", "group",
    "capital", "health", "medical", "blue", "green", "new", "advanced", "staging", "test", "demo", "jobs", "careers", "career", "healthcare",
    "careeronestop", "obsglobal", "str", "glassdoor",
)
ALSO = r"(?i)\b(dba|d/b/a|fka|formerly|aka)\b.*$"
BOARDS = 8


def display_title(raw: Column) -> Column:
    """A title in capitals (over nine tenths of its letters) in title case; others with single spaces.

    Acronyms and roman numerals stay in capitals, small words after the first go to lower case. What stands
    before a word's first letter or digit moves behind it, the last sign first.
    """
    text = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    letters, capitals = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))

    def word(w: Column, k: Column) -> Column:
        before, after = F.regexp_extract(w, r"^([^\p{L}\p{N}]*)[\p{L}\p{N}]", 1), F.regexp_extract(w, r"([^\p{L}\p{N}]*)$", 1)
        core = F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        up, low = F.upper(core), F.lower(core)
        shown = F.when(up.isin(*ACRONYMS) | up.rlike("^[IVX]+$"), up).when((k > 0) & low.isin(*SMALL_WORDS), low).otherwise(F.concat(F.left(up, F.lit(1)), F.substring(low, 2, 2**30)))
        return F.concat(shown, F.reverse(before), after)

    return F.when(capitals * 10 > letters * 9, F.array_join(F.transform(F.split(text, " "), word), " ")).otherwise(text)


@F.pandas_udf(StringType())
def _plain_letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def slugify(text: Column) -> Column:
    """Letters without accents in lower case, digits, and single hyphens; ``&`` is ``and``."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_plain_letters(text)), "&", " and "), r"[^a-z0-9\s-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(plain), r"\s+", "-"), "-+", "-"), F.lit("-"))


def match_terms(names: DataFrame, extra: DataFrame) -> DataFrame:
    """(name, match_key, match_kind, term_source) of each name: its brands, itself, both without a legal form, and ``extra`` terms.

    Brands are parts between slashes without a last bracket. Keys of three letters or fewer match exactly.
    Of equal terms the first source counts. extra: (name, match_key, match_kind).
    """
    pieces = F.filter(F.transform(F.split("name", "/"), lambda p: F.trim(p)), lambda p: p != "")
    brands = F.transform(pieces, lambda p: F.trim(F.regexp_replace(p, r"\s*\([^)]*\)\s*$", "")))
    both = F.flatten(F.transform(F.when(F.size(brands) > 0, brands).otherwise(F.array("name")), lambda b: F.array(F.struct(b.alias("raw"), F.lit("brand").alias("source")), F.struct(F.col("name").alias("raw"), F.lit("linkedin_name").alias("source")))))
    rows = names.select("name").distinct().select("name", F.posexplode(both).alias("k", "t")).select("name", "k", "t.source", slugify(F.col("t.raw")).alias("key"))
    bare = F.regexp_replace("key", LEGAL, "")
    keys = F.array(F.struct(F.lit(0).alias("j"), F.col("key"), F.col("source")), F.struct(F.lit(1).alias("j"), bare.alias("key"), F.concat("source", F.lit(":stripped")).alias("source")))
    terms = rows.select("name", "k", F.explode(keys).alias("t")).select("name", F.struct("k", "t.j").alias("order"), F.col("t.key").alias("match_key"), F.when(F.length("t.key") <= 3, "exact").otherwise("prefix").alias("match_kind"), F.col("t.source").alias("term_source"))
    more = extra.join(names.select("name").distinct(), "name", "left_semi").select("name", F.struct(F.lit(2**31 - 1).alias("k"), F.lit(0).alias("j")).alias("order"), "match_key", "match_kind", F.lit("manual_alias").alias("term_source"))
    return terms.unionByName(more).where("match_key <> ''").groupBy("name", "match_key", "match_kind").agg(F.min_by("term_source", "order").alias("term_source"))


def host_slug(host: Column) -> Column:
    """The telling label of a host; null without one."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\."), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    label = F.regexp_replace(F.when(first.isin(*NOISE) & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(first), "[^a-z0-9]", "")
    return F.when((F.length(label) >= 3) & ~label.isin(*NOISE), label)


def slug_variants(name: Column, url: Column, domain: Column, stopwords: tuple[str, ...]) -> Column:
    """At most eight names that a company's board may have, the likeliest first: of its own words, then of its hosts."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), ALSO, " ")), F.lit("[a-z0-9]+"), F.lit(0))
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
    two = F.slice(words, 1, 2)
    own = F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(two, ""), F.array_join(two, "-"))
    netloc = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    hosts = F.filter(F.array(host_slug(domain), host_slug(netloc)), lambda s: s.isNotNull() & ((F.length(s) >= 7) | F.exists(words, lambda w: (F.length(w) >= 4) & F.contains(s, w))))
    clean = F.transform(F.concat(own, hosts), lambda v: F.trim(F.regexp_replace(v, "[^a-z0-9-]", ""), F.lit("-")))
    return F.slice(F.array_distinct(F.filter(clean, lambda v: (F.length(v) >= 3) & ~v.isin(*COMMON))), 1, BOARDS)


def parse_count(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, ",", "")), F.lit("")).try_cast("long"), F.lit(0))


def title_mappings(rows: DataFrame) -> DataFrame:
    """One row for each raw title and occupation code: that of the highest count, of equal ones the first.

    rows: row_number, raw_job_title, soc_code, soc_title, soc_count and raw_count as text. Rows without a
    title or a valid code go.
    """
    r = rows.select(F.trim("raw_job_title").alias("raw_job_title"), normalize_soc_code(F.trim("soc_code")).alias("normalized_soc_code"), F.trim("soc_title").alias("soc_title"), parse_count(F.col("soc_count")).alias("soc_lca_count"), parse_count(F.col("raw_count")).alias("raw_lca_count"), "row_number")
    best = r.where("raw_job_title <> '' AND normalized_soc_code IS NOT NULL").groupBy("raw_job_title", "normalized_soc_code").agg(F.min_by(F.struct("soc_title", "soc_lca_count", "raw_lca_count"), F.struct(-F.col("raw_lca_count"), "row_number")).alias("m"))
    return best.select("raw_job_title", "normalized_soc_code", display_title(F.col("m.soc_title")).alias("soc_title"), "m.soc_lca_count", "m.raw_lca_count", display_title(F.col("raw_job_title")).alias("normalized_job_title"))
