"""Host-level quality rules.

Each document is measured (words, symbols, repeated lines, repeated five-word
windows) and held against rules.  Rule failures are counted by host; a host's
failure rate for a rule is shrunk by a beta prior whose two parameters are fitted
to the rates of all hosts (method of moments), so a host of few documents leans
on the prior.  A host whose shrunk rate passes a rule's limit is rejected, and
its verdict goes back to its documents: a document is kept if it passes the base
rules, its own failures do not reject it, and its host stands.

DataFrame operations only; the failures of a host are summed before any shuffle.
Windows are compared by a 64-bit hash of their five words.

Defined results: a null text has no words; null hosts form one host; repeated
rows count each; an empty table gives an empty table; extra columns are ignored;
texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import WORD_GAP, materialize, text_or_empty

WINDOW = 5
MIN_WORDS = 10
#: Share of repeated words, in percent, above which the base rule fails.
MAX_REPEAT = 20


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL predicate on the measures; ``host_limit``: shrunk rate that rejects a host;
    ``rejects``: whether a failure also rejects the document itself."""

    name: str
    fails: str
    host_limit: float
    rejects: bool = False


RULES = (
    Rule("short", f"n_words < {MIN_WORDS}", 0.6),
    Rule("repeats", f"100 * n_repeat_words > {MAX_REPEAT} * n_words", 0.6),
    Rule("symbols", "10 * n_symbols > 3 * n_words", 0.6, True),
    Rule("lines", "10 * n_dup_lines > 4 * n_lines", 0.6, True),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)", 0.6, True),
)


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every text."""
    words = F.array_remove(F.split(text_or_empty("text"), WORD_GAP), "")
    lines = F.filter(F.split(text_or_empty("text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", F.col(host).cast("string").alias("host"), words.alias("words"), lines.alias("lines"), F.length(F.regexp_replace(text_or_empty("text"), r"[^#*$%&|<>]+", "")).alias("n_symbols"))
    windows = F.expr(f"if(size(words) < {WINDOW}, array(), transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))))")
    df = df.select("doc_id", "host", "n_symbols", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), windows.alias("windows"))
    # only texts with a repeated window are sorted; neighbours in order that are equal repeat
    df = df.withColumn("ranked", F.expr("if(size(array_distinct(windows)) = size(windows), array(), array_sort(transform(windows, (h, i) -> struct(h, i))))")).drop("windows")
    df = df.withColumn("again", F.expr("array_sort(transform(filter(ranked, (x, k) -> (k > 0 and ranked[greatest(k - 1, 0)].h = x.h) or (k < size(ranked) - 1 and ranked[least(k + 1, size(ranked) - 1)].h = x.h)), x -> x.i))")).drop("ranked")
    covered = F.expr(f"if(size(again) = 0, 0, aggregate(zip_with(slice(again, 2, size(again)), slice(again, 1, greatest(size(again) - 1, 1)), (b, a) -> least({WINDOW}, coalesce(b - a, 0))), {WINDOW}, (s, x) -> s + x))")
    return df.select("doc_id", "host", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")], covered.cast("long").alias("n_repeat_words"))


def beta_priors(hosts: DataFrame, rules=RULES) -> dict[str, tuple[float, float]]:
    """Prior parameters of each rule from the mean and variance of the hosts' rates (two numbers a rule)."""
    rate = {r.name: F.col(f"fail_{r.name}") / F.col("n_docs") for r in rules}
    row = hosts.agg(F.count("*").alias("hosts"), F.avg(1 / F.col("n_docs")).alias("noise"), *[F.avg(rate[r.name]).alias(f"m_{r.name}") for r in rules], *[F.var_samp(rate[r.name]).alias(f"v_{r.name}") for r in rules]).first()
    out = {}
    for r in rules:
        mean = min(max(row[f"m_{r.name}"] or 0.0, 1e-6), 1 - 1e-6)
        # what sampling alone would give is taken off the variance of the rates
        spread = (row[f"v_{r.name}"] or 0.0) - mean * (1 - mean) * (row["noise"] or 0.0)
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4) if spread > 0 else 1e4
        out[r.name] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(measured: DataFrame, rules=RULES) -> DataFrame:
    """host, n_docs, shrunk_<rule>, host_rejected."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(F.expr(r.fails)).alias(f"fail_{r.name}") for r in rules])
    hosts = materialize(hosts, "hosts")
    priors = beta_priors(hosts, rules)
    shrunk = {r.name: (F.col(f"fail_{r.name}") + F.lit(priors[r.name][0])) / (F.col("n_docs") + F.lit(sum(priors[r.name]))) for r in rules}
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | (shrunk[r.name] > r.host_limit)
    return hosts.select("host", "n_docs", *[shrunk[r.name].alias(f"shrunk_{r.name}") for r in rules], rejected.alias("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source", rules=RULES) -> DataFrame:
    """Measures, base_failed, host_rejected, rules_failed and kept of every document."""
    measured = materialize(measures(docs, host), "measures")
    verdicts = host_verdicts(measured, rules).select(F.col("host").alias("__host"), "host_rejected")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("__host")), "left")
    failed = F.array_compact(F.array(*[F.when(F.expr(r.fails), F.lit(r.name)) for r in rules]))
    base = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    own = F.expr(" or ".join(f"({r.fails})" for r in rules if r.rejects) or "false")
    return joined.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~own & ~F.col("host_rejected")).alias("kept"), "host_rejected", failed.alias("rules_failed"))
