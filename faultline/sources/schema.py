"""Metric-table schema: fixed names, validation rows, label and feature resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

# The metric columns, the id columns and the accepted label names, in order.
METRICS = ["wmc", "dit", "noc", "cbo", "rfc", "lcom", "ca", "ce", "npm", "lcom3", "loc", "dam", "moa", "mfa", "cam", "ic", "cbm", "amc", "max_cc", "avg_cc"]
IDS = ["name", "version", "classname"]
LABELS = ["bug", "defects", "label", "Defective", "class", "bugs", "isDefective"]
CONTRACT = [*IDS, *METRICS, "bug"]

SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in IDS], *[T.StructField(c, T.DoubleType()) for c in METRICS], T.StructField("bug", T.IntegerType())])


def headers(spark: SparkSession, by_file: dict[str, list[str]]) -> DataFrame:
    """file, pos, column: one row a header field."""
    rows = [(f, i, c) for f, columns in sorted(by_file.items()) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "file string, pos int, column string")


def schema_verdicts(found: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """file, n_columns, first_bad_pos (-1 if none), verdict ('ok', 'count' or 'name') of each file's header."""
    spark = found.sparkSession
    want = spark.createDataFrame(list(enumerate(expected or CONTRACT)), "pos int, want string")
    size = len(expected or CONTRACT)
    files = found.groupBy("file").agg(F.count("*").alias("n_columns"))
    bad = found.join(F.broadcast(want), "pos", "left").filter(~F.col("column").eqNullSafe(F.col("want"))).groupBy("file").agg(F.min("pos").alias("first_bad_pos"))
    verdict = F.when(F.col("n_columns") != size, "count").when(F.col("first_bad_pos").isNotNull(), "name").otherwise("ok")
    return files.join(bad, "file", "left").select("file", "n_columns", F.when(verdict == "name", F.col("first_bad_pos")).otherwise(-1).cast("long").alias("first_bad_pos"), verdict.alias("verdict"))


def label_columns(found: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """file, label: the first accepted label name that the header has; null if it has none."""
    order = found.sparkSession.createDataFrame(list(enumerate(labels or LABELS)), "rank int, column string")
    hit = found.join(F.broadcast(order), "column", "left")
    return hit.groupBy("file").agg(F.min_by("column", "rank").alias("label"))


def resolve_label(columns: list[str], labels: list[str] | None = None) -> str:
    for name in labels or LABELS:
        if name in columns:
            return name
    raise ValueError(f"no label column among {columns}")


def numeric_features(df: DataFrame, labels: list[str] | None = None) -> list[str]:
    """Numeric columns that are neither labels nor ids."""
    out = {*(labels or LABELS), "name", "version", "name.1"}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in out]


def binarise(label: str = "bug"):
    return (F.col(label) > 0).cast("int")


def with_metrics(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Canonical order; metrics that are missing become 0, nulls stay."""
    metrics = metrics or METRICS
    return df.select(*[c for c in df.columns if c not in metrics], *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in metrics])


def align_by_name(frames: list[DataFrame]) -> list[DataFrame]:
    """Each frame reduced to the columns that all have, in the first one's order."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return [f.select(*common) for f in frames]


def trim_positional(df: DataFrame, features: str = "x") -> DataFrame:
    """Compatibility: vectors cut to the least width over all projects, names ignored."""
    width = df.agg(F.min(F.size(features))).first()[0] or 0
    return df.withColumn(features, F.slice(features, 1, width))


def exact_medians(df: DataFrame, columns: list[str], by: str = "project") -> DataFrame:
    """by, ``__med_<column>``: medians from counts by value.

    Values are counted before the shuffle and ranked by a running sum, so a group of any size
    costs a sort of its distinct values, spread over its columns, and no value list is held.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
    long = df.select(F.col(by).alias("__by"), cells.alias("c")).select("__by", "c.k", "c.v").filter("v is not null")
    counts = long.groupBy("__by", "k", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("__by", "k").agg(F.sum("n").alias("t")).withColumnsRenamed({"__by": "__tby", "k": "__tk"})
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("__by", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    placed = upto.join(totals, F.col("__by").eqNullSafe(F.col("__tby")) & (F.col("k") == F.col("__tk")))
    holds = lambda at: F.max(F.when((F.col("upto") >= at) & (F.col("upto") - F.col("n") < at), F.col("v")))
    middle = placed.groupBy("__by", "k").agg(((holds(F.floor((F.col("t") + 1) / 2)) + holds(F.floor((F.col("t") + 2) / 2))) / 2).alias("m"))
    return middle.groupBy("__by").agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(f"__med_{c}") for k, c in enumerate(columns)])


def impute_median(df: DataFrame, columns: list[str], by: str = "project") -> DataFrame:
    """Exact median of the column within its group where null; an all-null column stays null."""
    joined = df.join(exact_medians(df, columns, by), F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__med_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def pad_or_trim(df: DataFrame, counts: DataFrame, width: int, key: str = "project", position: str = "pos", vector: str = "x") -> DataFrame:
    """Exactly ``n`` rows a key (``counts``: key, n), rows missing at the end as zeros, vectors as wide as asked."""
    slots = counts.select(key, F.explode(F.expr("sequence(cast(0 as bigint), n - 1)")).alias(position))
    zeros = F.array_repeat(F.lit(0.0), width)
    fitted = F.slice(F.concat(F.col(vector), zeros), 1, width)
    return slots.join(df.select(key, F.col(position).cast("long").alias(position), fitted.alias(vector)), [key, position], "left").select(key, position, F.coalesce(vector, zeros).alias(vector))


def two_class(df: DataFrame, by: str = "project") -> DataFrame:
    """Groups whose labels have both classes."""
    return df.groupBy(by).agg(F.count_distinct("y").alias("n_classes")).select(by, "n_classes", (F.col("n_classes") >= 2).alias("usable"))


def require_projects(df: DataFrame, least: int = 2) -> list:
    """Sorted project names; an error if there are too few."""
    names = sorted(r[0] for r in df.select("project").distinct().collect())
    if len(names) < least:
        raise ValueError(f"{least} projects are needed, {len(names)} found")
    return names


def ordinal(df: DataFrame, by: str, order: list[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
