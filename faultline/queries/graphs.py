"""Dependency extraction, graphs, message passing and joint vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prng import sql_draw, draw
from ..functions.vectors import mean_vector, relu, sigmoid, unit
from ..operators import graph
from ..sources.readers import vector_instances
from .base import LINKS, VECTORS, query

_T = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")


def nation_links(spark, sf_dir):
    """project, src, dst: strong trade links between nations as a directed graph."""
    c, o, li, s = (_T(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier"))
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    n = j.groupBy(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")).agg(F.count("*").alias("w"))
    mean = n.agg(F.avg("w").alias("m"))
    return n.join(F.broadcast(mean)).filter("a <> b AND w > 1.5 * m").select(F.lit(0).alias("project"), F.col("a").alias("src"), F.col("b").alias("dst"))


def nation_nodes(spark, sf_dir):
    return _T(spark, sf_dir, "nation").select(F.lit(0).alias("project"), F.col("n_nationkey").cast("long").alias("node"))


def nation_features(spark, sf_dir):
    """Two features a nation: its key and its square, scaled."""
    k = F.col("node") / 25.0
    return nation_nodes(spark, sf_dir).select("project", "node", F.array(k, k * k).alias("h"))


_H = "h AS (SELECT CAST(n_nationkey AS BIGINT) AS node, n_nationkey / 25e0 AS h0, (n_nationkey / 25e0) * (n_nationkey / 25e0) AS h1 FROM nation)"
_ADJ = "adj AS (SELECT src AS node, dst AS other FROM g UNION ALL SELECT dst, src FROM g)"
_MEAN = f"{LINKS}, {_H}, {_ADJ}, m AS (SELECT a.node, avg(h0) AS m0, avg(h1) AS m1 FROM adj a JOIN h ON h.node = a.other GROUP BY a.node), nm AS (SELECT h.node, h0, h1, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1 FROM h LEFT JOIN m ON h.node = m.node)"


@query(f"WITH {LINKS} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g")
def q43_undirected(spark, sf_dir):
    return graph.undirected(nation_links(spark, sf_dir)).select("a", "b")


@query(f"WITH {LINKS}, {_ADJ} SELECT node, count(*) AS degree FROM adj GROUP BY node")
def q44_degrees(spark, sf_dir):
    return graph.degrees(nation_links(spark, sf_dir)).select("node", "degree")


@query(f"WITH {LINKS} SELECT (SELECT count(*) FROM nation) AS n_nodes, count(*) AS n_edges FROM g")
def q45_graph_size(spark, sf_dir):
    return graph.size(nation_nodes(spark, sf_dir), nation_links(spark, sf_dir)).select("n_nodes", "n_edges")


@query(f"WITH {_MEAN} SELECT node, round(m0, 6) AS m0, round(m1, 6) AS m1 FROM nm")
def q46_neighbour_mean(spark, sf_dir):
    m = graph.neighbour_mean(nation_features(spark, sf_dir), graph.adjacency(nation_links(spark, sf_dir)), 2)
    return m.select("node", F.round(F.get("m", 0), 6).alias("m0"), F.round(F.get("m", 1), 6).alias("m1"))


W = [[0.5, -0.25], [0.75, 1.0], [-0.5, 0.5], [1.0, 0.25]]


@query(f"WITH {_MEAN}, o AS (SELECT node, greatest(h0 * 5e-1 + h1 * 75e-2 - m0 * 5e-1 + m1, 0) AS a, greatest(-h0 * 25e-2 + h1 + m0 * 5e-1 + m1 * 25e-2, 0) AS b FROM nm) SELECT node, round(a / CASE WHEN sqrt(a * a + b * b) < 1e-8 THEN 1 ELSE sqrt(a * a + b * b) END, 6) AS a, round(b / CASE WHEN sqrt(a * a + b * b) < 1e-8 THEN 1 ELSE sqrt(a * a + b * b) END, 6) AS b FROM o")
def q47_message_passing(spark, sf_dir):
    h = graph.sage_layer(nation_features(spark, sf_dir), graph.adjacency(nation_links(spark, sf_dir)), W)
    return h.select("node", F.round(F.get("h", 0), 6).alias("a"), F.round(F.get("h", 1), 6).alias("b"))


@query(f"WITH {LINKS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g), p AS (SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey), f AS (SELECT p.* FROM p ANTI JOIN u USING (a, b)) SELECT a, b FROM f QUALIFY row_number() OVER (ORDER BY {sql_draw('a * 1000 + b')}, a, b) <= 3 * (SELECT count(*) FROM u)")
def q48_negative_pairs(spark, sf_dir):
    return graph.negative_pairs(nation_nodes(spark, sf_dir), nation_links(spark, sf_dir), 3, draw(F.col("a") * 1000 + F.col("b"))).select("a", "b")


@query(f"WITH {VECTORS}, t AS (SELECT project, x[1] AS a, x[2] AS b, CAST(row_id % 3 > 0 AS INTEGER) AS mask FROM v) SELECT project, round(sum(a * mask) / sum(mask), 5) AS a, round(sum(b * mask) / sum(mask), 5) AS b FROM t GROUP BY project")
def q50_masked_mean(spark, sf_dir):
    t = vector_instances(spark, sf_dir).select("project", F.slice("x", 1, 2).alias("h"), (F.col("row_id") % 3 > 0).cast("int").alias("mask"))
    return graph.masked_mean(t, ["project"], 2).select("project", F.round(F.get("pooled", 0), 5).alias("a"), F.round(F.get("pooled", 1), 5).alias("b"))


@query(f"WITH {VECTORS} SELECT row_id, 8 AS width, round(list_sum(x[1:3]) , 5) AS first, round(x[61] + x[62], 5) AS last, round(greatest(x[1], 0) / sqrt(list_sum(list_transform(x, lambda t: t * t))), 5) AS scaled, round(1 / (1 + exp(-x[2])), 6) AS squashed FROM v")
def q51_joint_vectors(spark, sf_dir):
    v = vector_instances(spark, sf_dir)
    parts = {"semantic": v.select("project", "row_id", F.slice("x", 1, 3).alias("x")), "structural": v.select("project", "row_id", F.slice("x", 61, 2).alias("x")), "metrics": v.select("project", "row_id", F.slice("x", 2, 3).alias("x"))}
    joint = graph.joint_features(parts).join(v.select("project", "row_id", F.get(relu(unit(F.col("x"))), 0).alias("scaled")), ["project", "row_id"])
    total = lambda a, n: F.aggregate(F.slice("x", a, n), F.lit(0.0), lambda s, t: s + t)
    return joint.select("row_id", F.size("x").alias("width"), F.round(total(1, 3), 5).alias("first"), F.round(total(4, 2), 5).alias("last"), F.round("scaled", 5).alias("scaled"), F.round(sigmoid(F.get("x", 5)), 6).alias("squashed"))


@query(f"WITH {VECTORS} SELECT project, count(*) AS n, round(avg(x[1]), 5) AS a, round(avg(x[64]), 5) AS z FROM v GROUP BY project")
def q52_vector_centroids(spark, sf_dir):
    c = vector_instances(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"), mean_vector(F.col("x"), 64).alias("c"))
    return c.select("project", "n", F.round(F.get("c", 0), 5).alias("a"), F.round(F.get("c", 63), 5).alias("z"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS node, 32 AS width, TRUE AS unit FROM nation")
def q53_trained_embeddings(spark, sf_dir):
    """A vector of unit length, or zeros, for every node."""
    h = graph.embed(nation_nodes(spark, sf_dir), nation_links(spark, sf_dir))
    size = F.aggregate("h", F.lit(0.0), lambda s, x: s + x * x)
    return h.select("node", F.size("h").cast("long").alias("width"), ((F.abs(size - 1) < 1e-6) | (size == 0)).alias("unit"))


@query("SELECT page_id, 256 AS width, regexp_matches(html, '[0-9A-Za-z_]') AS unit FROM pages")
def q54_text_vectors(spark, sf_dir):
    """Unit length where there is a token, else zeros."""
    v = graph.hashed_text_vectors(_T(spark, sf_dir, "pages"), 256, "html")
    size = F.aggregate("semantic", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("page_id", F.size("semantic").cast("long").alias("width"), (F.abs(size - 1) < 1e-6).alias("unit"))
