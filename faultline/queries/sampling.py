"""Splits, folds, draws, neighbours and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prng import MODULUS, sql_draw, sql_name_key
from ..operators import resample, split
from ..sources.readers import EVENT_FEATURES, event_instances
from .base import EVENTS, query
from .selection import MARKED

_POSITIVE = f"{EVENTS}, c AS (SELECT project, y, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT project, arg_min(y, n * 10 + y) AS minority, max(n) AS n_majority, min(n) AS n_minority, sum(CASE WHEN y = 1 THEN n ELSE 0 END) / sum(n) AS rate FROM c GROUP BY project), mi AS (SELECT e.*, n_minority AS m, CAST(greatest(CASE WHEN rate >= 2e-1 THEN n_majority ELSE floor(n_majority * 6e-1) END - n_minority, 0) AS BIGINT) AS n_syn, greatest(1, least(5, n_minority - 1)) AS kk FROM e JOIN t ON e.project = t.project AND e.y = t.minority)"
_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in EVENT_FEATURES)
_NEAR = f"{_POSITIVE}, d AS (SELECT a.project, a.row_id, b.row_id AS other, {_D2} AS d2 FROM mi a JOIN mi b ON a.project = b.project AND a.row_id <> b.row_id), nn AS (SELECT *, row_number() OVER (PARTITION BY project, row_id ORDER BY d2, other) AS place FROM d QUALIFY place <= 5)"


@query(f"WITH {EVENTS}, {MARKED} SELECT project, y, labelled, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM m GROUP BY ALL")
def q20_label_split(spark, sf_dir):
    df = split.stratified_labels(event_instances(spark, sf_dir))
    return df.groupBy("project", "y", "labelled").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(f"WITH {EVENTS}, p AS (SELECT DISTINCT project FROM e), q AS (SELECT a.project AS target, b.project AS source, repeat FROM p a JOIN p b ON a.project <> b.project, range(5) r(repeat)) SELECT target, source, repeat, row_number() OVER (PARTITION BY target, repeat ORDER BY md5(concat_ws('|', target, source, repeat)), source) AS rank FROM q QUALIFY rank <= 3")
def q21_random_sources(spark, sf_dir):
    return split.random_sources(event_instances(spark, sf_dir)).select("target", "source", "repeat", "rank")


@query(f"WITH {EVENTS}, n AS (SELECT project, count(*) AS n FROM e GROUP BY project), o AS (SELECT project, row_id, row_number() OVER (PARTITION BY project ORDER BY {sql_draw('row_id')}, row_id) AS place FROM e), p AS (SELECT a.project AS target, b.project AS source, least(a.n, b.n, 300) AS m FROM n a JOIN n b ON a.project <> b.project), s AS (SELECT target, source, m, 0 AS domain, source AS project FROM p UNION ALL SELECT target, source, m, 1, target FROM p) SELECT target, source, domain, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM s JOIN o USING (project) WHERE place <= m GROUP BY ALL")
def q22_balanced_domains(spark, sf_dir):
    df = split.balanced_domains(event_instances(spark, sf_dir))
    return df.groupBy("target", "source", "domain").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(f"WITH {EVENTS}, m AS (SELECT *, row_number() OVER (PARTITION BY project, y ORDER BY {sql_draw('row_id', 7)}, row_id) <= greatest(1, floor(count(*) OVER (PARTITION BY project, y) * 2e-1)) AS labelled FROM e) SELECT project, labelled AS test, count(*) AS n, round(avg(y), 6) AS rate FROM m GROUP BY ALL")
def q23_holdout_split(spark, sf_dir):
    df = split.stratified_labels(event_instances(spark, sf_dir), 0.2, 7)
    return df.groupBy("project", F.col("labelled").alias("test")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"))


@query(f"WITH {EVENTS}, m AS (SELECT *, (row_number() OVER (PARTITION BY project, y ORDER BY {sql_draw('row_id')}, row_id) - 1) % 5 AS fold, ntile(5) OVER (PARTITION BY project ORDER BY row_id) - 1 AS block FROM e) SELECT project, fold, block, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM m GROUP BY ALL")
def q24_folds(spark, sf_dir):
    df = split.contiguous_folds(split.stratified_folds(event_instances(spark, sf_dir), 5, by=("project", "y")).withColumnRenamed("fold", "f1"), 5).withColumnRenamed("fold", "block")
    return df.groupBy("project", F.col("f1").alias("fold"), "block").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(f"WITH {EVENTS} SELECT project, row_id, row_number() OVER (PARTITION BY project ORDER BY {sql_draw('row_id', 5)}, row_id) AS place FROM e")
def q25_permutation(spark, sf_dir):
    return split.permutation(event_instances(spark, sf_dir), 5).select("project", "row_id", "place")


@query(f"WITH {EVENTS} SELECT target, trial, trial * 7 + 13 AS seed FROM (SELECT DISTINCT project AS target FROM e), range(30) t(trial)")
def q26_trials(spark, sf_dir):
    return split.trials(event_instances(spark, sf_dir), 30)


@query(f"WITH {_NEAR} SELECT project, row_id, other, place, round(d2, 5) AS d2 FROM nn")
def q27_neighbours(spark, sf_dir):
    rows = resample.minority(event_instances(spark, sf_dir))
    return resample.neighbours(rows, EVENT_FEATURES).select("project", "row_id", "other", "place", F.round("d2", 5).alias("d2"))


_KEY = f"synthetic + 1000003 * {sql_name_key('project')}"
_HIGH = lambda seed: f"CAST(floor(({sql_draw(_KEY, seed)}) / 65536e0) AS BIGINT)"


@query(f"""WITH {_NEAR}, s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY row_id) - 1 AS slot FROM mi WHERE m > 1 AND n_syn > 0),
  g AS (SELECT project, max(m) AS m, max(kk) AS kk, max(y) AS cls, max(n_syn) AS n_syn FROM s GROUP BY project),
  pl AS (SELECT project, cls, synthetic, {_HIGH(42)} % m AS slot, {_HIGH(43)} % kk + 1 AS place, ({sql_draw(_KEY, 44)}) / {MODULUS}e0 AS gap FROM (SELECT *, unnest(range(n_syn)) AS synthetic FROM g))
  SELECT pl.project, synthetic, a.row_id AS base_id, b.row_id AS other_id, {', '.join(f'round(a.{c} + gap * (b.{c} - a.{c}), 5) AS {c}' for c in EVENT_FEATURES)}, cls AS y
  FROM pl JOIN s a ON pl.project = a.project AND pl.slot = a.slot JOIN nn ON nn.project = pl.project AND nn.row_id = a.row_id AND nn.place = pl.place JOIN e b ON b.project = pl.project AND b.row_id = nn.other""")
def q28_smote(spark, sf_dir):
    new = resample.smote(event_instances(spark, sf_dir), EVENT_FEATURES)
    return new.select("project", "synthetic", "base_id", "other_id", *[F.round(c, 5).alias(c) for c in EVENT_FEATURES], "y")


@query(f"WITH {_POSITIVE}, g AS (SELECT project, y, max(n_syn) AS extra FROM mi GROUP BY ALL) SELECT e.project, e.y, count(*) + coalesce(max(extra), 0) AS n FROM e LEFT JOIN g ON g.project = e.project AND g.y = e.y GROUP BY ALL")
def q29_balanced_counts(spark, sf_dir):
    return resample.balanced(event_instances(spark, sf_dir), EVENT_FEATURES).groupBy("project", "y").agg(F.count("*").alias("n"))
