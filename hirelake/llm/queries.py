"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hirelake.llm import oracles
from hirelake.llm.bpe import encode_texts
from hirelake.llm.collocations import mine_collocations
from hirelake.llm.common import table
from hirelake.llm.conversations import repair_conversations
from hirelake.llm.decontaminate import find_contaminated
from hirelake.llm.langid import identify
from hirelake.llm.pii import find_spans
from hirelake.llm.pivots import near_links
from hirelake.llm.simhash import simhash_components
from hirelake.llm.topk import exact_topk
from hirelake.llm.tokencount import count_tokens
from hirelake.llm.suffixes import remove_repeats
from hirelake.llm.toxicity import score_toxicity
from hirelake.llm.urlfilter import Rule, filter_urls

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, with_ids=False)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_urlfilter, op3_embeddings, op4_toxicity, op5_suffixes, op6_bpe, op7_langid, op8_decontaminate, op9_tokencount, op10_pii, op11_collocations, op12_conversations, op13_topk)
}

ORACLES = {
    "op1_simhash": oracles.OP1,
    "op3_embeddings": oracles.OP3,
    "op5_suffixes": oracles.OP5,
    "op11_collocations": oracles.OP11,
    "op12_conversations": oracles.OP12,
    "op13_topk": oracles.OP13,
    "op2_urlfilter": r"""
WITH rest AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest),
rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, rules.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
""",
}
