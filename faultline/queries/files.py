"""CSV and source folders: files are written from the tables, read back by the readers and held against the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import javacode
from ..operators import graph
from ..sources import readers, schema
from .base import query

_T = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")

# The metric tables: a project for each remainder of the part's key by 5, a class a part, metrics by arithmetic on the part's key.
_METRIC = {c: f"p_partkey * {j + 3} % {j + 7}" for j, c in enumerate(schema.METRICS)} | {"loc": "p_size", "amc": "p_retailprice", "cam": "CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 10 END"}
_FROM = "concat('maker-', p_partkey % 5 + 1) AS project"
_PARTS = "p AS (SELECT " + ", ".join([_FROM, "'C' || p_partkey AS classname", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _METRIC.items()], "p_size % 4 AS bug", "CAST(p_size % 4 > 0 AS INTEGER) AS y"]) + " FROM part)"


def folder(spark) -> str:
    """A new folder that driver and executors share; in local mode a temporary one if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="faultline-files-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def write_named(df, key: str, path: str, ending: str, fmt: str, **options) -> str:
    """A file a key, named by it: written as partitions, then moved by Hadoop's file system."""
    spark = df.sparkSession
    df.repartition(key).write.partitionBy(key).options(**options).format(fmt).save(f"{path}/parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/parts/{key}=*/part-*")):
        source = status.getPath()
        fs.rename(source, jvm.org.apache.hadoop.fs.Path(f"{path}/{source.getParent().getName().split('=', 1)[1]}{ending}"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/parts"), True)
    return path


def metric_folder(spark, sf_dir) -> str:
    p = _T(spark, sf_dir, "part").selectExpr(_FROM, "concat('maker-', p_partkey % 5 + 1) AS name", "'1.0' AS version", "concat('C', p_partkey) AS classname", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _METRIC.items()], "p_size % 4 AS bug")
    return write_named(p, "project", folder(spark), ".csv", "csv", header=True)


_SUMS = ", ".join(f"round(sum({c}), 3) AS {c}" for c in schema.METRICS)


@query(f"WITH {_PARTS} SELECT project, count(*) AS n, count(DISTINCT classname) AS classes, {_SUMS}, sum(y) AS y FROM p GROUP BY project")
def q84_csv_projects(spark, sf_dir):
    df = readers.read_projects(spark, metric_folder(spark, sf_dir))
    return df.groupBy("project").agg(F.count("*").alias("n"), F.count_distinct("classname").alias("classes"), *[F.round(F.sum(c), 3).alias(c) for c in schema.METRICS], F.sum("y").cast("double").alias("y"))


@query(f"WITH {_PARTS} SELECT project, y, count(*) AS n FROM p GROUP BY ALL")
def q85_csv_labels(spark, sf_dir):
    return readers.read_labels(spark, metric_folder(spark, sf_dir)).groupBy("project", "y").agg(F.count("*").alias("n"))


@query(f"WITH {_PARTS}, m AS (SELECT project, median(cam) AS med FROM p GROUP BY project) SELECT project, row_number() OVER (ORDER BY project) AS place, count(*) AS n, round(sum(coalesce(cam, med)), 4) AS cam, round(sum(loc), 3) AS loc, sum(y) AS y FROM p JOIN m USING (project) GROUP BY project")
def q86_load_projects(spark, sf_dir):
    """Every file of a folder in order of name, medians for nulls."""
    df, _, _ = readers.load_projects(spark, metric_folder(spark, sf_dir))
    place = {name: k + 1 for k, name in enumerate(schema.require_projects(df))}
    sums = df.groupBy("project").agg(F.count("*").alias("n"), F.round(F.sum("cam"), 4).alias("cam"), F.round(F.sum("loc"), 3).alias("loc"), F.sum("y").cast("double").alias("y"))
    return sums.withColumn("place", F.element_at(F.create_map(*[F.lit(x) for k in place.items() for x in k]), F.col("project")).cast("long"))


def _two_tables(spark, sf_dir) -> str:
    c = _T(spark, sf_dir, "customer").selectExpr("'customer' AS file", "c_custkey AS id", "c_nationkey AS dit", "c_acctbal AS loc")
    path = write_named(c, "file", folder(spark), ".csv", "csv", header=True)
    s = _T(spark, sf_dir, "supplier").selectExpr("'supplier' AS file", "s_suppkey AS id", "s_acctbal AS loc", "s_nationkey AS wmc")
    more = write_named(s, "file", folder(spark), ".csv", "csv", header=True)
    return f"{path}/customer.csv", f"{more}/supplier.csv"


@query("WITH u AS (SELECT c_custkey AS id, c_nationkey AS dit, c_acctbal AS loc, NULL AS wmc FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal, s_nationkey FROM supplier) SELECT count(*) AS n, count(dit) AS n_dit, count(wmc) AS n_wmc, round(sum(loc), 2) AS loc, CAST(sum(id) AS BIGINT) AS ids FROM u")
def q87_concat_files(spark, sf_dir):
    u = readers.concat_files(spark, list(_two_tables(spark, sf_dir)))
    return u.agg(F.count("*").alias("n"), F.count("dit").alias("n_dit"), F.count("wmc").alias("n_wmc"), F.round(F.sum("loc"), 2).alias("loc"), F.sum("id").cast("long").alias("ids"))


@query("WITH u AS (SELECT 0 AS frame, c_custkey AS id, c_acctbal AS loc FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier) SELECT frame, 2 AS width, count(*) AS n, round(sum(loc), 2) AS loc FROM u GROUP BY frame")
def q67_set_difference(spark, sf_dir):
    """Columns that not all frames have go, whatever their place."""
    frames = [spark.read.option("header", True).option("inferSchema", True).csv(p) for p in _two_tables(spark, sf_dir)]
    aligned = [f.select(F.lit(k).alias("frame"), F.lit(len(f.columns)).alias("width"), *f.columns) for k, f in enumerate(schema.align_by_name(frames))]
    return aligned[0].unionByName(aligned[1]).groupBy("frame", "width").agg(F.count("*").alias("n"), F.round(F.sum("loc"), 2).alias("loc"))


@query(f"WITH {_PARTS} SELECT project, count(*) AS n, sum(y) AS y, round(sum(wmc), 3) AS wmc, round(sum(avg_cc), 3) AS avg_cc, 20 AS n_features FROM p WHERE project = 'maker-1' GROUP BY project")
def q88_fixed_path(spark, sf_dir):
    df = readers.read_dynamic(spark, f"{metric_folder(spark, sf_dir)}/maker-1.csv")
    return df.groupBy("project").agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("y"), F.round(F.sum("wmc"), 3).alias("wmc"), F.round(F.sum("avg_cc"), 3).alias("avg_cc"), F.lit(len(df.columns) - 2).alias("n_features"))


@query(f"WITH {_PARTS} SELECT project, count(cam) AS n_cam, round(sum(rfc), 3) AS rfc, round(sum(amc), 2) AS amc FROM p GROUP BY project")
def q89_feature_table(spark, sf_dir):
    return readers.feature_table(spark, metric_folder(spark, sf_dir)).groupBy("project").agg(F.count("cam").alias("n_cam"), F.round(F.sum("rfc"), 3).alias("rfc"), F.round(F.sum("amc"), 2).alias("amc"))


@query(f"WITH {_PARTS} SELECT count(*) AS n, sum(y) AS y, round(sum(wmc), 3) AS wmc, 20 AS n_features FROM p")
def q90_combined_table(spark, sf_dir):
    path = metric_folder(spark, sf_dir)
    names = [f"{path}/maker-{k}.csv" for k in range(1, 6)]
    df = readers.combined_table(spark, names)
    return df.agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("y"), F.round(F.sum("wmc"), 3).alias("wmc"), F.lit(len(df.columns) - 1).alias("n_features"))


@query("SELECT concat('maker-', p_partkey % 5 + 1) AS project, count(*) AS n_bad, count(*) + count(*) FILTER (p_partkey % 13 = 0) AS n_unread FROM part WHERE p_partkey % 17 = 0 GROUP BY ALL")
def q91_failed_rows(spark, sf_dir):
    """Rows that do not parse are counted by file; the rest of the file is read."""
    p = _T(spark, sf_dir, "part").selectExpr(_FROM, "concat('maker-', p_partkey % 5 + 1) AS name", "'1.0' AS version", "concat('C', p_partkey) AS classname", *[f"{'CASE WHEN p_partkey % 17 = 0 THEN ' + chr(39) + 'many' + chr(39) + ' ELSE ' if c == 'wmc' else ''}CAST(CAST({e} AS DOUBLE) AS STRING){' END' if c == 'wmc' else ''} AS {c}" for c, e in _METRIC.items()], "p_size % 4 AS bug")
    return readers.failed_files(spark, write_named(p, "project", folder(spark), ".csv", "csv", header=True)).select("project", "n_bad", "n_unread")


# ---- sources: a class a nation, whose imports, parents and members are other nations' classes ----

_OTHER = {"imported": "(7 * n_nationkey + 3) % 25", "parent": "n_nationkey * n_nationkey % 25", "member": "(n_nationkey + 5) % 25"}
_NODES = "s AS (SELECT CAST(n_nationkey AS BIGINT) AS k, 'N' || n_nationkey AS node, " + ", ".join(f"'N' || {e} AS {c}" for c, e in _OTHER.items()) + ", 'Region' || n_regionkey AS region FROM nation)"
_EDGES = f"{_NODES}, d AS (SELECT node AS src, unnest([imported, parent, member, 'List', 'implements', region]) AS dst FROM s), e AS (SELECT DISTINCT src, dst FROM d WHERE src <> dst AND dst IN (SELECT node FROM s))"


def java_sources(spark, sf_dir):
    """project, path, content."""
    n = _T(spark, sf_dir, "nation").selectExpr("concat('N', n_nationkey) AS node", *[f"concat('N', {e}) AS {c}" for c, e in _OTHER.items()], "concat('Region', n_regionkey) AS region")
    text = F.format_string("package demo;\nimport demo.%s;\nimport java.util.List;\n/* café */\npublic class %s extends %s implements %s {\n  private %s field;\n}\n", "imported", "node", "parent", "region", "member")
    return n.select(F.lit("demo").alias("project"), F.concat(F.lit("/code/demo/"), "node", F.lit(".java")).alias("path"), text.alias("content"))


@query(f"WITH {_NODES} SELECT node, imported || ',List' AS imports, parent || ',implements,' || region AS parents, member AS members FROM s")
def q40_java_declarations(spark, sf_dir):
    s = java_sources(spark, sf_dir)
    text = lambda c: F.array_join(c, ",")
    return s.select(javacode.class_name(F.col("content"), F.col("path")).alias("node"), text(javacode.imports(F.col("content"))).alias("imports"), text(javacode.parents(F.col("content"))).alias("parents"), text(javacode.members(F.col("content"))).alias("members"))


@query(f"WITH {_NODES} SELECT node AS stem, 'demo.' || node AS dotted, node AS last FROM s")
def q41_class_paths(spark, sf_dir):
    s = java_sources(spark, sf_dir)
    return s.select(javacode.stem(F.col("path")).alias("stem"), javacode.dotted(F.col("path"), "/code").alias("dotted"), javacode.last_part(javacode.dotted(F.col("path"), "/code")).alias("last"))


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def q42_edges(spark, sf_dir):
    return graph.edges(graph.parse(java_sources(spark, sf_dir))).select("src", "dst")


@query(f"WITH {_EDGES} SELECT node, '/code/demo/' || node || '.java' AS path, count(dst) AS out FROM s LEFT JOIN e ON src = node GROUP BY node")
def q92_dependency_network(spark, sf_dir):
    """Nodes with their files and how many known classes each refers to."""
    parsed = graph.parse(java_sources(spark, sf_dir))
    out = graph.edges(parsed).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    return graph.nodes(parsed).join(out, "node", "left").select("node", "path", F.coalesce("out", F.lit(0)).alias("out"))


@query(f"WITH {_NODES} SELECT node, size, last, k % 3 = 0 AS latin FROM (SELECT *, 119 + length(node || imported || parent || region || member) AS size, '}}' AS last FROM s)")
def q93_source_scan(spark, sf_dir):
    """Files below nested folders, some in another encoding than UTF-8."""
    key = F.substring("node", 2, 2).cast("int")
    s = java_sources(spark, sf_dir).select(javacode.stem(F.col("path")).alias("node"), "content").orderBy("node").withColumn("raw", F.when(key % 3 == 0, F.encode("content", "ISO-8859-1")).otherwise(F.encode("content", "UTF-8")))
    path = folder(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in s.select("node", "raw").collect():  # a file a nation
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{r['node'][-1]}/{r['node']}.java")
        stream = place.getFileSystem(conf).create(place, True)
        stream.write(r["raw"])
        stream.close()
    found = readers.read_sources(spark, path).withColumn("node", javacode.stem(F.col("path")))
    return found.select("node", F.length("content").alias("size"), F.substring(F.rtrim(F.regexp_replace("content", r"\s+$", "")), -1, 1).alias("last"), (F.contains("content", F.lit("café")) & (key % 3 == 0)).alias("latin"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS row_id, CAST(CASE WHEN n_nationkey % 3 < 2 THEN n_nationkey + 1 ELSE 0 END AS DOUBLE) AS a, CAST(CASE WHEN n_nationkey % 3 < 2 THEN n_nationkey * n_nationkey ELSE 0 END AS DOUBLE) AS b, n_nationkey % 3 < 2 AS matched FROM nation")
def q49_prioritised_lookup(spark, sf_dir):
    """Exact class name first, then the simple name, else zeros."""
    n = _T(spark, sf_dir, "nation").select(F.lit("demo").alias("project"), F.col("n_nationkey").cast("long").alias("row_id"), F.concat(F.lit("demo.N"), "n_nationkey").alias("classname"))
    k = F.col("row_id")
    known = n.filter(k % 3 < 2).select("project", F.when(k % 3 == 0, F.col("classname")).otherwise(javacode.last_part(F.col("classname"))).alias("node"), F.array((k + 1).cast("double"), (k * k).cast("double")).alias("h"))
    # a class of the same simple name elsewhere: the exact one wins
    decoy = n.filter(k % 3 == 0).select("project", F.concat(F.lit("aaa."), javacode.last_part(F.col("classname"))).alias("node"), F.array(F.lit(-1.0), F.lit(-1.0)).alias("h"))
    found = graph.align_embeddings(n, known.unionByName(decoy), 2)
    return found.select("row_id", F.get("emb", 0).alias("a"), F.get("emb", 1).alias("b"), "matched")


@query("SELECT n_nationkey % 3 < 2 AS matched, count(*) AS n FROM nation GROUP BY ALL")
def q94_unmatched_classes(spark, sf_dir):
    return q49_prioritised_lookup(spark, sf_dir).groupBy("matched").agg(F.count("*").alias("n"))
