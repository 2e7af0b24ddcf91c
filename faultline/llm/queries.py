"""Registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, tokenizer_path
from .exact_dedup import exact_duplicates
from .language_id import language_id
from .ngram_lm import score_held_out
from .packing import pack_documents
from .quality_classifier import classify_quality
from .quality_rules import RULES, quality_rules
from .sentencepiece_codec import encode_decode
from .simhash import near_duplicates
from .suffix_dedup import repeated_substrings
from .token_counts import token_counts


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumn("rules_failed", F.array_join("rules_failed", ","))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_simhash_near_dedup, op3_quality_rules, op4_lm_scoring, op5_language_id, op6_suffix_dedup, op7_token_counts, op8_exact_dedup, op9_quality_classifier, op10_sentencepiece)}

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORD, _GAP = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _rules_sql() -> str:
    """The rules, their priors and the host verdicts over again."""
    fails = ", ".join(f"CAST({r.fails} AS INTEGER) AS f_{r.name}" for r in RULES)
    sums = ", ".join(f"sum(f_{r.name}) AS f_{r.name}" for r in RULES)
    means = ", ".join(f"least(greatest(avg(f_{r.name} / n), 1e-6), 1 - 1e-6) AS m_{r.name}, coalesce(var_samp(f_{r.name} / n), 0) AS v_{r.name}" for r in RULES)
    strengths = ", ".join(f"m_{r.name}, CASE WHEN v_{r.name} - m_{r.name} * (1 - m_{r.name}) * noise > 0 THEN least(greatest(m_{r.name} * (1 - m_{r.name}) / (v_{r.name} - m_{r.name} * (1 - m_{r.name}) * noise) - 1, 1), 1e4) ELSE 1e4 END AS s_{r.name}" for r in RULES)
    verdict = " OR ".join(f"(f_{r.name} + m_{r.name} * s_{r.name}) / (n + s_{r.name}) > {r.host_limit}" for r in RULES)
    own = " OR ".join(f"f_{r.name} = 1" for r in RULES if r.rejects)
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN f_{r.name} = 1 THEN '{r.name}' END" for r in RULES) + ")"
    return f"""
        WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
             w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_GAP}')) AS lines FROM t),
             p AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
             r AS (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
             c AS (SELECT doc_id, CAST(sum(least(5, coalesce(step, 5))) AS BIGINT) AS again FROM r GROUP BY doc_id),
             m AS (SELECT w.doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
             f AS (SELECT *, {fails} FROM m),
             h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {sums} FROM f GROUP BY host),
             q AS (SELECT avg(1 / n) AS noise, {means} FROM h),
             s AS (SELECT {strengths} FROM q),
             v AS (SELECT host, {verdict} AS host_rejected FROM h, s)
        SELECT doc_id, f.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short = 1 OR f_repeats = 1 AS base_failed,
               NOT (f_short = 1 OR f_repeats = 1 OR {own} OR host_rejected) AS kept, host_rejected, {names} AS rules_failed
        FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host"""


ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _rules_sql(),
    "op8_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORMAL} AS normal FROM documents),
             g AS (SELECT normal, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY normal)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256
        FROM n JOIN g USING (normal)""",
    "op6_suffix_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
             w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM t WHERE n >= 50)),
             m AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
             g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w JOIN m USING (s) WHERE doc_id > first_id),
             k AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
             r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY ALL),
             e AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM r
                   UNION ALL SELECT doc_id, coalesce(max(r.b), 0), any_value(n) FROM t LEFT JOIN r USING (doc_id) GROUP BY doc_id),
             c AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM e JOIN t USING (doc_id) GROUP BY doc_id),
             x AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs FROM r GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM t JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)""",
}
