"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import string

import public_tokenizers

import corpus_pipeline
from binsieve.llm import toxicity
from binsieve.llm.bpe_automaton import bpe_round_trip
from binsieve.llm.common import table
from binsieve.llm.imatch import imatch_edits
from binsieve.llm.media import media_round_trip
from binsieve.llm.packing import pack_documents
from binsieve.llm.pii import find_pii
from binsieve.llm.simhash import simhash_components
from binsieve.llm.token_counts import token_counts
from binsieve.llm.token_files import token_files_round_trip
from binsieve.llm.url_rules import RULE_SCHEMA, judge_urls

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_media(spark, sf_dir):
    return media_round_trip(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark, sf_dir):
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op4_imatch(spark, sf_dir):
    return imatch_edits(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024, end_id=2)


def op6_token_files(spark, sf_dir):
    return token_files_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


def op7_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, RULE_SCHEMA)
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents")).drop("redacted")


QUERIES = {f.__name__: f for f in (op1_media, op2_bpe_round_trip, op3_token_counts, op4_imatch, op5_packing, op6_token_files, op7_url_rules, op8_simhash, op9_toxicity, op10_pii)} | {"pipeline": corpus_pipeline.run}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLES: dict[str, str] = {
    "op7_url_rules": rf"""
        WITH rest AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        cut AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
        page AS (SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
        rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
        best AS (
            SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
            FROM page LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id, host, path)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best""",
}
