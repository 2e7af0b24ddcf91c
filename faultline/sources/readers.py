"""Readers and writers: metric tables, source files, caches, reports, instance views."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .schema import CONTRACT, LABELS, METRICS, SCHEMA, align_by_name, binarise, impute_median, numeric_features, resolve_label, with_metrics

def _project() -> Column:
    """Project name: the file's name without its ending."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("project")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder under the strict schema, ``project`` from the file name and ``y`` from ``bug``.

    The schema is given, so the files are read once; malformed rows have nulls and
    their text in ``_bad``; only columns that a query asks for are parsed, so a row
    counts as malformed by these alone.
    """
    reader = spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField("_bad", T.StringType())])).option("header", True).option("enforceSchema", False)
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.csv").csv(path)
    return df.select(_project(), "*", binarise().alias("y"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """project, y; only the label column is parsed."""
    return read_projects(spark, path).select("project", "y")


def read_dynamic(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One file with whatever columns it has: numeric features, and ``y`` from the first label name it knows.

    A label of words must be yes or no.  ``keep`` names further columns to hold, with a ``row_id``.
    """
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    label = resolve_label(df.columns)
    value = F.col(f"`{label}`")
    y = (value > 0).cast("int") if dict(df.dtypes)[label] != "string" else F.upper(value).isin("Y", "YES", "TRUE").cast("int")
    held = [F.col(f"`{c}`").cast("string").alias(c) for c in keep if c in df.columns]
    rows = [F.xxhash64(*df.columns).alias("row_id")] if keep else []
    return df.select(_project(), *held, *rows, *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric_features(df, LABELS)], y.alias("y"))


def load_projects(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """(rows, features, skipped): every CSV of a folder, whatever its schema.

    Folders of strict tables are one scan.  Otherwise files are read by their own headers and
    aligned on the numeric columns that all have; a file without a usable label is skipped, with
    its reason.  Nulls become the column's median within the project.
    """
    files = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect())
    headers = {f: spark.read.option("header", True).csv(f).columns for f in files}
    if files and all(h == CONTRACT for h in headers.values()):
        df = with_metrics(read_projects(spark, path).drop("_bad"))
        return impute_median(df, METRICS).withColumn("row_id", F.xxhash64("project", "classname")), list(METRICS), {}
    frames, skipped = [], {}
    for f in files:
        try:
            frames.append(read_dynamic(spark, f, keep=("classname", "name")))
        except ValueError as error:
            skipped[f] = str(error)
    if not frames:
        raise ValueError(f"no usable table in {path}")
    frames = align_by_name(frames)
    features = [c for c in frames[0].columns if c not in ("project", "classname", "name", "row_id", "y")]
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other)
    return impute_median(df, features), features, skipped


def combined_table(spark: SparkSession, paths: list[str], label: str = "bug") -> DataFrame:
    """All files below each other: numeric columns but labels and names, then ``y``."""
    df = concat_files(spark, paths)
    return df.select(*numeric_features(df, [label]), binarise(label).alias("y"))


def concat_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Vertical concatenation with columns matched by name, missing ones null."""
    frames = [spark.read.option("header", True).option("inferSchema", True).csv(p) for p in sorted(paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Strict metric columns of every project, missing metrics 0."""
    return with_metrics(read_projects(spark, path).drop("_bad"))


def failed_files(spark: SparkSession, path: str) -> DataFrame:
    """project, n_bad, n_unread: files with rows that did not parse, and how many metric values
    these lack; the other files go on."""
    unread = sum((F.col(c).isNull().cast("int") for c in [*METRICS, "bug"]), F.lit(0))
    rows = read_projects(spark, path).select("project", "_bad", unread.alias("unread")).filter(F.col("_bad").isNotNull())
    return rows.groupBy("project").agg(F.count("*").alias("n_bad"), F.sum("unread").alias("n_unread"))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_sources(spark: SparkSession, path: str, pattern: str = "*.java") -> DataFrame:
    """path, content (text) of all source files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", decode_text(F.col("content")).alias("content"))


# Where a project's sources may lie below a root, in order.
SOURCE_SUBFOLDERS = ("", "src", "src/main/java", "source")


def source_folders(roots: list[str], project: str, subfolders: tuple[str, ...] = SOURCE_SUBFOLDERS) -> str | None:
    """First existing folder for a project: by its name, its name without version, its name with underscores."""
    names = dict.fromkeys([project, project.split("-")[0], project.replace("-", "_")])
    tries = (Path(root) / name / sub for root in roots for name in names for sub in subfolders)
    return next((str(p) for p in tries if p.is_dir()), None)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cached(df: DataFrame, folder: str, *key: str) -> DataFrame:
    """Parquet cache named by a hash of what made it: another input or setting is another name."""
    spark = df.sparkSession
    name = hashlib.sha256("\0".join([*key, df.schema.json(), str(df.semanticHash())]).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{name}"
    try:
        return spark.read.schema(df.schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def synthetic_projects(spark: SparkSession, sizes: dict[str, int], features: int = 20, rate: float = 0.3, separable: bool = False) -> DataFrame:
    """Gaussian features and Bernoulli labels; ``separable`` makes the label depend on the first two features."""
    out = None
    for seed, (name, n) in enumerate(sizes.items(), 1):
        df = spark.range(n).select(F.lit(name).alias("project"), F.col("id").alias("row_id"), *[F.randn(1000 * seed + k).alias(f"x{k}") for k in range(features)], F.rand(seed).alias("u"), F.randn(7000 + seed).alias("noise"))
        y = (F.col("x0") + 0.5 * F.col("x1") + 0.3 * F.col("noise") > 0) if separable else (F.col("u") < rate)
        df = df.withColumn("y", y.cast("int")).drop("u", "noise")
        out = df if out is None else out.unionByName(df)
    return out


# ---- instance views over the relational tables ----

EVENT_FEATURES = ["x0", "x1", "x2", "x3"]
LINE_FEATURES = ["quantity", "price", "discount", "tax", "size", "retail", "balance"]


def event_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, row_id, x0..x3, y from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select((F.col("user_id") % 25).alias("project"), F.col("event_id").alias("row_id"), F.col("value").alias("x0"), k.alias("x1"), F.hour("ts").cast("double").alias("x2"), (F.dayofweek("ts") - 1).cast("double").alias("x3"), (F.col("event_type") == "error").cast("int").alias("y"))


def line_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project (supplier's nation), seven features, y from the star join."""
    li, s, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "part"))
    joined = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    return joined.select(F.col("s_nationkey").cast("long").alias("project"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"), F.col("s_acctbal").alias("balance"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def vector_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project (label), row_id, x (array<double>) from embeddings."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.col("label").cast("long").alias("project"), F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"))


def document_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project (source), row_id, n_chars, y (quality; null if unlabelled)."""
    d, q = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return d.select("doc_id", "source", "n_chars").join(q, "doc_id", "left").select(F.col("source").alias("project"), F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("n_chars"), F.col("quality").alias("y"))
