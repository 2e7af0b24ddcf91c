"""Scores, thresholds, summaries, comparisons and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, metrics
from ..operators.metrics import THRESHOLDS
from ..sources.readers import event_instances
from .base import EVENTS, query

#: A simple deterministic score on events: value squeezed to 0..1, so that ties and all classes occur.
SCORED = f"{EVENTS}, s AS (SELECT project, row_id, row_id % 5 AS trial, y, round((x0 + x2) / (x0 + x2 + 50), 2) AS score, CAST(round((x0 + x2) / (x0 + x2 + 50), 2) >= 6e-1 AS INTEGER) AS pred FROM e)"
_COUNTS = "c AS (SELECT {by}, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM s GROUP BY ALL)"
_RANKS = "a AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2e0 AS r FROM s), u AS (SELECT {by}, CASE WHEN sum(y) * sum(1 - y) > 0 THEN (sum(r * y) - sum(y) * (sum(y) + 1) / 2e0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) END AS auc FROM a GROUP BY ALL)"
_F1 = "coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0)"
_UNDER = "(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))"
_MCC = f"CASE WHEN {_UNDER} > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt({_UNDER}) ELSE 0 END"


def _sql(by: str) -> str:
    return f"WITH {SCORED}, {_COUNTS.format(by=by)}, {_RANKS.format(by=by)}, sc AS (SELECT {by}, {_F1} AS f1, auc, {_MCC} AS mcc FROM c JOIN u USING ({by}))"


def scored_events(spark, sf_dir):
    e = event_instances(spark, sf_dir)
    raw = (F.col("x0") + F.col("x2")) / (F.col("x0") + F.col("x2") + 50)
    return e.select("project", "row_id", (F.col("row_id") % 5).alias("trial"), "y", F.round(raw, 2).alias("score"), (F.round(raw, 2) >= 0.6).cast("int").alias("pred"))


@query(f"{_sql('project')} SELECT project, round(f1, 6) AS f1, round(auc, 6) AS auc, round(mcc, 6) AS mcc FROM sc")
def q30_scores(spark, sf_dir):
    return metrics.scores(scored_events(spark, sf_dir), ["project"]).select("project", *[F.round(c, 6).alias(c) for c in ("f1", "auc", "mcc")])


_GRID = "[" + ", ".join(f"{t!r}e0" for t in THRESHOLDS) + "]"


@query(f"WITH {SCORED}, t AS (SELECT unnest({_GRID}) AS threshold), f AS (SELECT project, threshold, coalesce(2e0 * count(*) FILTER (y = 1 AND score >= threshold) / nullif(count(*) FILTER (score >= threshold) + sum(y), 0), 0) AS f1 FROM s, t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY f1 DESC, threshold) AS k FROM f) SELECT project, round(CASE WHEN f1 > 0 THEN threshold ELSE 5e-1 END, 6) AS threshold, round(f1, 6) AS f1 FROM r WHERE k = 1")
def q31_best_threshold(spark, sf_dir):
    return metrics.best_threshold(scored_events(spark, sf_dir), ["project"]).select("project", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


_SUM = ", ".join(f"coalesce(avg({m}), 0) AS {m}_mean, coalesce(median({m}), 0) AS {m}_median, coalesce(stddev_pop({m}), 0) AS {m}_std" for m in ("f1", "auc", "mcc"))
_TRIALS = f"{_sql('project, trial')}, tr AS (SELECT project AS target, count(f1) AS n_ok, {_SUM} FROM sc GROUP BY project)"


def _summary(spark, sf_dir):
    return metrics.summarise(metrics.scores(scored_events(spark, sf_dir), ["project", "trial"]).withColumnRenamed("project", "target"))


_NAMES = [f"{m}_{s}" for m in ("f1", "auc", "mcc") for s in ("mean", "median", "std")]


@query(f"{_TRIALS} SELECT target, n_ok, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM tr")
def q32_trial_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("target", "n_ok", *[F.round(c, 6).alias(c) for c in _NAMES])


@query(f"{_TRIALS}, p AS (SELECT unnest(['f1', 'auc', 'mcc']) AS metric, unnest([avg(f1_mean), avg(auc_mean), avg(mcc_mean)]) AS mean, unnest([627e-3, 663e-3, 245e-3]) AS paper FROM tr) SELECT metric, round(mean, 6) AS mean, paper, round((mean - paper) / paper * 100, 4) AS delta_pct FROM p")
def q33_paper_comparison(spark, sf_dir):
    return metrics.against_paper(_summary(spark, sf_dir)).select("metric", F.round("mean", 6).alias("mean"), "paper", F.round("delta_pct", 4).alias("delta_pct"))


@query(f"WITH {EVENTS}, d AS (SELECT project, floor(x0 - 3 * x1) AS d FROM e WHERE floor(x0 - 3 * x1) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY project ORDER BY abs(d)) + (count(*) OVER (PARTITION BY project, abs(d)) - 1) / 2e0 AS r FROM d), w AS (SELECT project, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY project) SELECT project, n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4e0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24e0), 6) AS z FROM w")
def q34_wilcoxon(spark, sf_dir):
    pairs = event_instances(spark, sf_dir).select("project", F.floor(F.col("x0") - 3 * F.col("x1")).alias("a"), F.lit(0).alias("b"))
    return metrics.wilcoxon(pairs, ["project"]).select("project", "n", "w_plus", "w_minus", F.round("z", 6).alias("z"))


@query(f"WITH {EVENTS}, d AS (SELECT a.project, sum(sign(a.x0 - b.x0)) / CAST(count(*) AS DOUBLE) AS delta FROM e a JOIN e b ON a.project = b.project AND a.y = 1 AND b.y = 0 GROUP BY a.project) SELECT project, round(delta, 6) AS delta, CASE WHEN abs(delta) < 147e-3 THEN 'negligible' WHEN abs(delta) < 474e-3 THEN 'medium' ELSE 'large' END AS band FROM d")
def q35_cliffs_delta(spark, sf_dir):
    return metrics.cliffs_delta(event_instances(spark, sf_dir), ["project"], "y", "x0").select("project", F.round("delta", 6).alias("delta"), "band")


def _coral_sql(reg: str) -> str:
    return f"""WITH {EVENTS}, c AS (SELECT project, covar_samp(x0, x0) + {reg} AS p, covar_samp(x0, x2) AS q, covar_samp(x2, x2) + {reg} AS r FROM e GROUP BY project),
      w AS (SELECT project, (p + sqrt(p * r - q * q)) / sqrt(p + r + 2 * sqrt(p * r - q * q)) AS u, q / sqrt(p + r + 2 * sqrt(p * r - q * q)) AS v, (r + sqrt(p * r - q * q)) / sqrt(p + r + 2 * sqrt(p * r - q * q)) AS w FROM c),
      i AS (SELECT project, w / (u * w - v * v) AS iu, -v / (u * w - v * v) AS iv, u / (u * w - v * v) AS iw FROM w), t AS (SELECT u, v, w FROM w WHERE project = 0)
      SELECT e.project, row_id, round(x0 * (iu * u + iv * v) + x2 * (iv * u + iw * v), 4) + 0e0 AS x0, round(x0 * (iu * v + iv * w) + x2 * (iv * v + iw * w), 4) + 0e0 AS x2 FROM e JOIN i ON e.project = i.project, t"""


@query(_coral_sql("1e-3"))
def q36_coral(spark, sf_dir):
    out = align.align_pairs(event_instances(spark, sf_dir), 0, "x0", "x2", 1e-3)
    return out.select("project", "row_id", (F.round("x0", 4) + 0.0).alias("x0"), (F.round("x2", 4) + 0.0).alias("x2"))


@query(_coral_sql("1e0"))
def q37_coral_identity(spark, sf_dir):
    out = align.align_pairs(event_instances(spark, sf_dir), 0, "x0", "x2", 1.0)
    return out.select("project", "row_id", (F.round("x0", 4) + 0.0).alias("x0"), (F.round("x2", 4) + 0.0).alias("x2"))


@query(f"WITH {SCORED}, {_COUNTS.format(by='project')} SELECT project, tp, fp, fn, tn FROM c")
def q38_confusion(spark, sf_dir):
    return scored_events(spark, sf_dir).groupBy("project").agg(*metrics.confusion())


_WIDE = ", ".join(f"('x{i}', 'x{j}', (SELECT covar_samp(x{i}, x{j}) FROM e WHERE project = 0))" for i in range(4) for j in range(4))


@query(f"WITH {EVENTS}, w(a, b, goal) AS (VALUES {_WIDE}) SELECT a, b, round(goal, 4) AS goal, TRUE AS reached FROM w")
def q39_coral_wide(spark, sf_dir):
    """General width: the goal, and whether the aligned covariance reaches it, one row a pair of features."""
    import numpy as np

    from ..operators import stats
    from ..sources.readers import EVENT_FEATURES

    df = event_instances(spark, sf_dir)
    one, two = df.filter("project = 1"), df.filter("project = 0")
    a = align.fit(one, two, EVENT_FEATURES)
    got, want = stats.covariance(align.transform(one, EVENT_FEATURES, a), EVENT_FEATURES), stats.covariance(two, EVENT_FEATURES)
    error = np.abs(got + 1e-3 * a.T @ a - want - 1e-3 * np.eye(len(want)))
    return spark.createDataFrame([(EVENT_FEATURES[i], EVENT_FEATURES[j], float(want[i, j]), bool(error[i, j] < 1e-6 * max(1.0, abs(want[i, j])))) for i in range(4) for j in range(4)], "a string, b string, goal double, reached boolean").withColumn("goal", F.round("goal", 4))


@query(f"{_sql('project')} SELECT count(*) AS n, round(avg(f1), 3) AS f1, round(avg(auc), 3) AS auc, round(avg(mcc), 3) AS mcc FROM sc")
def q97_overall_averages(spark, sf_dir):
    return metrics.overall(metrics.scores(scored_events(spark, sf_dir), ["project"]))
