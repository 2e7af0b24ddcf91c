"""Profiles, scaling, similarity and source selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prng import sql_draw
from ..functions.vectors import cosine
from ..operators import models, select, split, stats
from ..sources import schema
from ..sources.readers import EVENT_FEATURES, LINE_FEATURES, event_instances, line_instances, vector_instances, document_instances
from .base import EVENTS, LINES, VECTORS, query

R = lambda c, n=6: F.round(c, n).alias(c)

MARKED = f"m AS (SELECT *, row_number() OVER (PARTITION BY project, y ORDER BY {sql_draw('row_id')}, row_id) <= greatest(1, floor(count(*) OVER (PARTITION BY project, y) * 1e-1)) AS labelled FROM e)"
RANKED = f"""WITH {EVENTS}, {MARKED},
  f AS (SELECT project, labelled, unnest([0, 1, 2, 3]) AS k, unnest([x0, x1, x2, x3]) AS v FROM m),
  own AS (SELECT project, k, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM f GROUP BY ALL),
  lab AS (SELECT project, k, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM f WHERE labelled GROUP BY ALL),
  tot AS (SELECT k, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM own GROUP BY k),
  mean AS (SELECT lab.project, k, lab.s / lab.n AS c, tot.n - own.n + lab.n AS n, (tot.s - own.s + lab.s) / (tot.n - own.n + lab.n) AS mu, tot.q - own.q + lab.q AS q FROM lab JOIN own USING (project, k) JOIN tot USING (k)),
  fit AS (SELECT project, k, c, mu, CASE WHEN sqrt(greatest(q / n - mu * mu, 0)) = 0 THEN 1 ELSE sqrt(greatest(q / n - mu * mu, 0)) END AS sd FROM mean),
  z AS (SELECT fit.project AS target, own.project AS source, (fit.c - mu) / sd AS ct, (own.s / own.n - mu) / sd AS cs FROM fit JOIN own ON fit.k = own.k AND fit.project <> own.project),
  rate AS (SELECT project, avg(y) AS full_rate, avg(y) FILTER (labelled) AS lab_rate FROM m GROUP BY project),
  p AS (SELECT target, source, CASE WHEN sum(ct * ct) * sum(cs * cs) > 0 THEN sum(ct * cs) / (sqrt(sum(ct * ct)) * sqrt(sum(cs * cs))) ELSE 0 END AS cos, sum((ct - cs) * (ct - cs)) AS mmd FROM z GROUP BY ALL),
  r AS (SELECT p.*, 1 - abs(a.lab_rate - b.full_rate) AS dr FROM p JOIN rate a ON a.project = target JOIN rate b ON b.project = source),
  sc AS (SELECT *, 35e-2 * cos + 35e-2 * (1 - mmd / CASE WHEN max(mmd) OVER (PARTITION BY target) > 0 THEN max(mmd) OVER (PARTITION BY target) ELSE 1 END) + 15e-2 * dr AS score FROM r),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS rank FROM sc)"""


def _ranked(spark, sf_dir):
    return select.rank_sources(split.stratified_labels(event_instances(spark, sf_dir)), EVENT_FEATURES, "labelled")


@query(f"{RANKED} SELECT target, source, rank, round(score, 6) AS score FROM ranked WHERE rank <= 3")
def q01_top_sources(spark, sf_dir):
    return select.select_sources(_ranked(spark, sf_dir), 3).select("target", "source", "rank", R("score"))


@query(f"{RANKED} SELECT target, source, rank, round(score, 6) AS score FROM ranked WHERE score >= 75e-2 OR rank = 1")
def q02_adaptive_sources(spark, sf_dir):
    return select.select_sources(_ranked(spark, sf_dir), None, 0.75).select("target", "source", "rank", R("score"))


@query(f"{RANKED} SELECT target, source, round(cos, 6) AS cos, round(mmd, 6) AS mmd, round(dr, 6) AS dr FROM ranked")
def q03_pair_components(spark, sf_dir):
    return _ranked(spark, sf_dir).select("target", "source", R("cos"), R("mmd"), R("dr"))


@query(f"WITH {LINES} SELECT project, count(*) AS n, round(avg(y), 6) AS defect_rate FROM l GROUP BY project")
def q04_profile(spark, sf_dir):
    return stats.profile(line_instances(spark, sf_dir)).select("project", "n", R("defect_rate"))


@query(f"WITH {LINES} SELECT project, {', '.join(f'round(avg({c}), 4) AS {c}' for c in LINE_FEATURES)} FROM l GROUP BY project")
def q05_centroids(spark, sf_dir):
    return stats.centroids(line_instances(spark, sf_dir), LINE_FEATURES).select("project", *[R(c, 4) for c in LINE_FEATURES])


_Z = ", ".join(f"round(avg(({c} - m_{c}) / s_{c}), 6) AS {c}" for c in LINE_FEATURES)
_FIT = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in LINE_FEATURES)


@query(f"WITH {LINES}, f AS (SELECT {_FIT} FROM l) SELECT project, {_Z} FROM l, f GROUP BY project")
def q06_standardised_means(spark, sf_dir):
    df = line_instances(spark, sf_dir)
    z = stats.standardise(df, LINE_FEATURES, stats.scaler(df, LINE_FEATURES))
    return stats.centroids(z, LINE_FEATURES).select("project", *[(F.round(c, 6) + 0.0).alias(c) for c in LINE_FEATURES])


_PAIRS = [(a, b) for i, a in enumerate(EVENT_FEATURES) for b in EVENT_FEATURES[i:]]


@query(f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT project, '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov FROM e GROUP BY project" for a, b in _PAIRS))
def q07_covariance(spark, sf_dir):
    return stats.covariance_pairs(event_instances(spark, sf_dir), EVENT_FEATURES, "project").select("project", "a", "b", R("cov", 4))


_VEC = ", ".join(f"avg({c}) AS {c}" for c in LINE_FEATURES)
_COS = f"""WITH {LINES}, c AS (SELECT project, {_VEC} FROM l GROUP BY project), u AS (SELECT project, unnest([{', '.join(map(str, range(len(LINE_FEATURES))))}]) AS k, unnest([{', '.join(LINE_FEATURES)}]) AS v FROM c),
  z AS (SELECT project, k, (v - avg(v) OVER (PARTITION BY k)) / CASE WHEN stddev_pop(v) OVER (PARTITION BY k) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY k) END AS v FROM u),
  s AS (SELECT a.project AS target, b.project AS source, CASE WHEN sum(a.v * a.v) * sum(b.v * b.v) > 0 THEN sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) ELSE 0 END AS similarity FROM z a JOIN z b ON a.k = b.k AND a.project <> b.project GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) AS rank FROM s)"""


@query(f"{_COS} SELECT target, source, round(similarity, 6) AS similarity, rank FROM r WHERE target = 0")
def q08_similarity_report(spark, sf_dir):
    return select.cosine_ranking(line_instances(spark, sf_dir), LINE_FEATURES).filter("target = 0").select("target", "source", R("similarity"), "rank")


@query(f"{_COS} SELECT target, source, rank FROM r WHERE rank <= 3")
def q09_lopo_sources(spark, sf_dir):
    return select.cosine_ranking(line_instances(spark, sf_dir), LINE_FEATURES).filter("rank <= 3").select("target", "source", "rank")


@query(f"{_COS}, t AS (SELECT target, source AS project FROM r WHERE rank <= 3) SELECT target, count(*) AS n, round(avg(y), 6) AS defect_rate FROM t JOIN l USING (project) GROUP BY target")
def q10_source_rows(spark, sf_dir):
    df = line_instances(spark, sf_dir)
    chosen = select.cosine_ranking(df, LINE_FEATURES).filter("rank <= 3").select("target", F.col("source").alias("project"))
    return df.join(chosen, "project").groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("defect_rate"))


@query(f"""WITH {EVENTS}, c AS (SELECT project, y, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT project, arg_max(y, n * 10 - y) AS majority, arg_min(y, n * 10 + y) AS minority, max(n) AS n_majority, min(n) AS n_minority, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS n1 FROM c GROUP BY project)
  SELECT project, majority, minority, n_majority, n_minority, round(n0 / greatest(n1, 1), 6) AS pos_weight, CAST(greatest(CASE WHEN n1 / (n0 + n1) >= 2e-1 THEN n_majority ELSE floor(n_majority * 6e-1) END - n_minority, 0) AS BIGINT) AS n_synthetic, greatest(1, least(5, n_minority - 1)) AS k FROM t""")
def q11_class_counts(spark, sf_dir):
    return stats.class_counts(event_instances(spark, sf_dir)).select("project", "majority", "minority", "n_majority", "n_minority", R("pos_weight"), "n_synthetic", "k")


@query(f"WITH {EVENTS}, n AS (SELECT project, row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE x0 END AS x0 FROM e) SELECT project, count(*) AS n, round(avg(coalesce(x0, m)), 6) AS x0, round(max(m), 6) AS med FROM n JOIN (SELECT project, median(x0) AS m FROM n GROUP BY project) USING (project) GROUP BY project")
def q12_median_imputation(spark, sf_dir):
    df = event_instances(spark, sf_dir).select("project", "row_id", F.when(F.col("row_id") % 7 != 0, F.col("x0")).alias("x0"))
    filled = schema.impute_median(df, ["x0"])
    return filled.join(df.groupBy("project").agg(F.median("x0").alias("m")), "project").groupBy("project").agg(F.count("*").alias("n"), F.round(F.avg("x0"), 6).alias("x0"), F.round(F.max("m"), 6).alias("med"))


@query(f"WITH {VECTORS}, c AS (SELECT project, k, avg(x[k]) AS v FROM v, range(1, 65) t(k) GROUP BY ALL) SELECT row_id, CASE WHEN sum(x[k] * x[k]) * sum(c.v * c.v) > 0 THEN round(sum(x[k] * c.v) / (sqrt(sum(x[k] * x[k])) * sqrt(sum(c.v * c.v))), 5) ELSE 0 END AS similarity FROM v JOIN c USING (project) GROUP BY row_id")
def q13_vector_cosine(spark, sf_dir):
    from ..functions.vectors import mean_vector

    v = vector_instances(spark, sf_dir)
    means = v.groupBy("project").agg(mean_vector(F.col("x"), 64).alias("c"))
    return v.join(means, "project").select("row_id", F.round(cosine(F.col("x"), F.col("c")), 5).alias("similarity"))


@query("SELECT source AS project, count(*) AS n, count(quality) AS n_labelled, round(avg(quality), 6) AS rate, count(DISTINCT quality) >= 2 AS usable FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def q14_labelled_documents(spark, sf_dir):
    d = document_instances(spark, sf_dir)
    return d.groupBy("project").agg(F.count("*").alias("n"), F.count("y").alias("n_labelled"), F.round(F.avg("y"), 6).alias("rate"), (F.count_distinct("y") >= 2).alias("usable"))


@query(f"WITH {EVENTS} SELECT project, count(DISTINCT y) AS n_classes, count(DISTINCT y) >= 2 AS usable FROM e GROUP BY project")
def q15_two_class_guard(spark, sf_dir):
    return schema.two_class(event_instances(spark, sf_dir))


@query(f"WITH {EVENTS}, p AS (SELECT DISTINCT project FROM e) SELECT a.project AS target, b.project AS source, TRUE AS bounded FROM p a JOIN p b ON a.project <> b.project")
def q16_a_distance(spark, sf_dir):
    """A domain discriminator for every pair; its distance is from 0 to 2."""
    d = models.a_distances(event_instances(spark, sf_dir), EVENT_FEATURES)
    return d.select("target", "source", F.col("adist").between(0, 2).alias("bounded"))


@query(f"WITH {EVENTS} SELECT DISTINCT project AS target, 3 AS n_sources, TRUE AS falling FROM e")
def q17_top_sources_with_a_distance(spark, sf_dir):
    """Three sources a target, by falling score."""
    df = split.stratified_labels(event_instances(spark, sf_dir))
    found = select.select_sources(select.rank_sources(df, EVENT_FEATURES, "labelled", a_distance=models.a_distances(df, EVENT_FEATURES)), 3)
    order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda r: r["score"])
    return found.groupBy("target").agg(F.count_distinct("source").alias("n_sources"), (order == F.reverse(F.array_sort(order))).alias("falling"))
