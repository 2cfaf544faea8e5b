"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import audited_repairs, damaged_turns
from .extraction import extract_main_text
from .filter_audit import filter_interactions
from .line_dedup import drop_repeated_lines
from .minhash import fingerprints
from .neighbours import near_vectors
from .packing import pack
from .quality import score_quality
from .repair_sql import REPAIR_SQL
from .sentencepieces import with_pieces
from .simhash import near_duplicate_classes
from .substrings import remove_repeated_passages
from .toxicity import score_toxicity
from .url_rules import Rule, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "spans")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_passages(_table(spark, sf_dir, "documents"), rejoin=True)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = with_pieces(texts, public_tokenizers.path("piece_bpe_32k.model"))
    return told.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids_crc32",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("same_text"),
    )


#: Fixed values of the contract.
URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return audited_repairs(conversations, damaged_turns(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_extraction": op4_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_url_filter": op11_url_filter,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

_LINES = f"""
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
    FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
"""

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op13_conversation_repair": REPAIR_SQL,
    "op12_filter_audit": rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, part, t, {_WORDS} AS ws, length(t) AS n, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals FROM d),
    l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
    firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY 1),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END ||
        CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END ||
        CASE WHEN 100 * capitals > 10 * n THEN 'C' ELSE '' END ||
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
        CASE WHEN w.doc_id > firsts.first THEN 'E' ELSE '' END AS fails
        FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
    p AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
    c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c3.x || d4.x || e5.x AS filter_order FROM c a, c b, c c3, c d4, c e5
        WHERE len(list_distinct([a.x, b.x, c3.x, d4.x, e5.x])) = 5),
    s AS (SELECT *, filter_order[step] AS letter,
        coalesce(list_min([k FOR k IN range(1, 6) IF contains(fails, filter_order[k])]), 6) AS first
        FROM p, o, (SELECT unnest(range(1, 6)) AS step)),
    r AS (SELECT part, filter_order, step, letter,
        sum(CASE WHEN first > step THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN first = step THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN first < step AND contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN first = step AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN first = step AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
        FROM s GROUP BY ALL)
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM r
    """,
    "op2_line_dedup": f"""
    WITH k AS ({_LINES}),
    r AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= 20)
          GROUP BY key HAVING count(*) >= 3)
    SELECT doc_id, count(*) AS n_lines,
           count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
    FROM k LEFT JOIN r USING (key) GROUP BY doc_id
    """,
}
