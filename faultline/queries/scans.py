"""Scans, schema checks, projections, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import sigmoid
from ..operators import select
from ..sources import schema
from ..sources.readers import LINE_FEATURES, event_instances, line_instances, vector_instances
from .base import EVENTS, LINES, VECTORS, query

_T = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")
R = lambda c, n=6: F.round(c, n).alias(c)

# Small headers that show each verdict.
_HEADERS = {"full": schema.CONTRACT, "short": schema.CONTRACT[:-1], "swapped": [*schema.CONTRACT[:3], "dit", "wmc", *schema.CONTRACT[5:]], "labels": ["Defective", "loc", "bug"], "none": ["loc"]}
_HEADER_SQL = "h(file, pos, col) AS (VALUES " + ", ".join(f"('{f}', {i}, '{c}')" for f, cols in _HEADERS.items() for i, c in enumerate(cols)) + ")"
_WANT_SQL = "w(pos, want) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(schema.CONTRACT)) + ")"
_LABEL_SQL = "k(rank, col) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(schema.LABELS)) + ")"


@query(f"WITH {_HEADER_SQL}, {_WANT_SQL}, n AS (SELECT file, count(*) AS n FROM h GROUP BY file), b AS (SELECT file, min(h.pos) AS bad FROM h LEFT JOIN w USING (pos) WHERE col IS DISTINCT FROM want GROUP BY file) SELECT n.file, n AS n_columns, CAST(coalesce(CASE WHEN n = 24 THEN bad END, -1) AS BIGINT) AS first_bad_pos, CASE WHEN n <> 24 THEN 'count' WHEN bad IS NOT NULL THEN 'name' ELSE 'ok' END AS verdict FROM n LEFT JOIN b USING (file)")
def q60_schema_verdicts(spark, sf_dir):
    return schema.schema_verdicts(schema.headers(spark, _HEADERS))


@query(f"WITH {_HEADER_SQL}, {_LABEL_SQL} SELECT file, arg_min(k.col, rank) AS label FROM h LEFT JOIN k ON h.col = k.col GROUP BY file")
def q61_label_columns(spark, sf_dir):
    return schema.label_columns(schema.headers(spark, _HEADERS))


@query("WITH u AS (SELECT 'customer' AS origin, c_custkey AS id, c_acctbal AS loc, NULL AS wmc FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, s_nationkey FROM supplier) SELECT origin, count(*) AS n, round(sum(coalesce(wmc, 0)), 2) AS wmc, round(sum(loc), 2) AS loc, 0e0 AS dit FROM u GROUP BY origin")
def q62_union_by_name(spark, sf_dir):
    c = _T(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("loc"))
    s = _T(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("loc"), F.col("s_nationkey").alias("wmc"))
    full = schema.with_metrics(c.unionByName(s, allowMissingColumns=True), ["wmc", "loc", "dit"])
    return full.groupBy("origin").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("wmc", F.lit(0.0))), 2).alias("wmc"), F.round(F.sum("loc"), 2).alias("loc"), F.sum("dit").alias("dit"))


@query("SELECT l_linestatus AS project, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY l_linestatus")
def q63_numeric_projection(spark, sf_dir):
    li = _T(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "class")
    names = [c for c in schema.numeric_features(li) if dict(li.dtypes)[c] == "double"]
    return li.groupBy(F.col("l_linestatus").alias("project")).agg(*[F.round(F.sum(c), 2).alias(c) for c in names])


@query(f"WITH {EVENTS} SELECT project, CAST(x0 > 50 AS INTEGER) AS label, count(*) AS n, count(*) FILTER (y = 1) AS n_pos FROM e WHERE x1 IS NOT NULL GROUP BY ALL")
def q64_binarise(spark, sf_dir):
    e = event_instances(spark, sf_dir).filter(F.col("x1").isNotNull()).withColumn("bug", F.col("x0") - 50)
    return e.groupBy("project", schema.binarise().alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"))


@query(f"WITH {VECTORS}, t AS (SELECT project, row_id, x[1:CASE WHEN project % 2 = 0 THEN 64 ELSE 48 END] AS x FROM v), w AS (SELECT min(len(x)) AS w FROM t) SELECT project, count(*) AS n, count(DISTINCT len(t.x)) AS widths, max(len(t.x[1:w])) AS width FROM t, w GROUP BY project")
def q65_width_alignment(spark, sf_dir):
    t = vector_instances(spark, sf_dir).select("project", "row_id", F.slice("x", F.lit(1), F.when(F.col("project") % 2 == 0, 64).otherwise(48)).alias("x"))
    cut = schema.trim_positional(t.withColumn("was", F.size("x")))
    return cut.groupBy("project").agg(F.count("*").alias("n"), F.count_distinct("was").alias("widths"), F.max(F.size("x")).cast("long").alias("width"))


@query(f"WITH {VECTORS}, o AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY row_id) - 1 AS pos, x FROM v), s AS (SELECT DISTINCT project, unnest(range(60)) AS pos FROM v) SELECT s.project, s.pos, round(coalesce(x[1] + x[2] + x[3], 0), 5) AS total FROM s LEFT JOIN o USING (project, pos)")
def q66_pad_or_trim(spark, sf_dir):
    o = schema.ordinal(vector_instances(spark, sf_dir), "project", ["row_id"], "pos")
    fitted = schema.pad_or_trim(o, o.select("project").distinct().withColumn("n", F.lit(60).cast("long")), 3)
    return fitted.select("project", "pos", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query(f"WITH {EVENTS} SELECT row_id, round(ln(x0 + 1), 5) AS a, round(abs(x0 - 50), 5) AS b, round(sqrt(x0), 5) AS c, round(x0 * x0 * x0 / 1000, 4) AS d, round(greatest(least(x0, 80), 20), 5) AS e, round(1 / (1 + exp(-x0 / 50)), 6) AS f, CAST(abs(x0 - 50) > 1e-6 AS INTEGER) AS g FROM e WHERE x0 >= 0")
def q68_scalars(spark, sf_dir):
    e = event_instances(spark, sf_dir).filter("x0 >= 0")
    x = F.col("x0")
    return e.select("row_id", F.round(F.ln(x + 1), 5).alias("a"), F.round(F.abs(x - 50), 5).alias("b"), F.round(F.sqrt(x), 5).alias("c"), F.round(F.pow(x, F.lit(3)) / 1000, 4).alias("d"), F.round(F.greatest(F.least(x, F.lit(80.0)), F.lit(20.0)), 5).alias("e"), F.round(sigmoid(x / 50), 6).alias("f"), (F.abs(x - 50) > 1e-6).cast("int").alias("g"))


@query(f"WITH {LINES}, p AS (SELECT DISTINCT project FROM l) SELECT a.project AS target, count(*) AS n_candidates, CAST(sum(b.project) AS BIGINT) AS sources FROM p a JOIN p b ON a.project <> b.project GROUP BY a.project")
def q69_candidates(spark, sf_dir):
    ranked = select.rank_sources(line_instances(spark, sf_dir), LINE_FEATURES)
    return ranked.groupBy("target").agg(F.count("*").alias("n_candidates"), F.sum("source").alias("sources"))


@query(f"WITH {LINES} SELECT project, round(avg(CAST(quantity AS REAL)), 3) AS quantity, round(avg(CAST(discount AS REAL)), 4) AS discount FROM l GROUP BY project")
def q70_single_precision(spark, sf_dir):
    df = line_instances(spark, sf_dir).select("project", *[F.col(c).cast("float").alias(c) for c in ("quantity", "discount")])
    return df.groupBy("project").agg(F.round(F.avg("quantity"), 3).alias("quantity"), F.round(F.avg("discount"), 4).alias("discount"))
