"""Splits, folds and draws that are the same on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.prng import draw, trial_seed


def stratified_labels(df: DataFrame, ratio: float = 0.10, seed: int = 42, by: tuple = ("project", "y"), key: str = "row_id") -> DataFrame:
    """Adds ``labelled``: of each class at least one row and ``floor(n * ratio)`` at random."""
    w = Window.partitionBy(*by)
    order = w.orderBy(draw(F.col(key), seed), key)
    return df.withColumn("labelled", F.row_number().over(order) <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(ratio))))


def random_sources(df: DataFrame, k: int = 3, repeats: int = 5) -> DataFrame:
    """target, repeat, source, rank: ``k`` other projects at random for each target and repeat."""
    p = df.select("project").distinct()
    pairs = p.select(F.col("project").alias("target")).join(p.select(F.col("project").alias("source")), F.col("target") != F.col("source"))
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("repeat"))
    order = Window.partitionBy("target", "repeat").orderBy(F.md5(F.concat_ws("|", "target", "source", "repeat")), "source")  # any kind of name
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def balanced_domains(df: DataFrame, cap: int = 300, seed: int = 42, target=None) -> DataFrame:
    """target, source, domain, row_id, place (by draw): ``min(n_source, n_target, cap)`` random rows of either side; of all targets or one."""
    order = Window.partitionBy("project").orderBy(draw(F.col("row_id"), seed), "row_id")
    # a pair needs at most ``cap`` rows of a project: the rest never leaves this stage
    few = df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)
    n = df.groupBy("project").agg(F.count("*").alias("n"))
    pairs = n.select(F.col("project").alias("target"), F.col("n").alias("nt")).join(n.select(F.col("project").alias("source"), F.col("n").alias("ns")), F.col("target") != F.col("source"))
    if target is not None:
        pairs = pairs.filter(F.col("target") == target)
    pairs = pairs.select("target", "source", F.least("nt", "ns", F.lit(cap)).alias("m"))
    sides = pairs.select("*", F.explode(F.array(F.struct(F.lit(0).alias("domain"), F.col("source").alias("project")), F.struct(F.lit(1).alias("domain"), F.col("target").alias("project")))).alias("side"))
    return sides.select("target", "source", "m", "side.*").join(few, "project").filter(F.col("place") <= F.col("m")).drop("m", "project")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, by: tuple = ("y",), key: str = "row_id", shuffle: bool = True) -> DataFrame:
    """Adds ``fold`` (0..k-1): classes dealt round robin, in random or row order."""
    order = [draw(F.col(key), seed), key] if shuffle else [key]
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % k).cast("long"))


def contiguous_folds(df: DataFrame, k: int = 5, by: str = "project", key: str = "row_id") -> DataFrame:
    """Adds ``fold``: contiguous blocks in row order, larger ones first."""
    return df.withColumn("fold", (F.ntile(k).over(Window.partitionBy(by).orderBy(key)) - 1).cast("long"))


def global_blocks(df: DataFrame, k: int = 5, key: str = "row_id") -> DataFrame:
    """Adds ``fold``: ``k`` contiguous blocks of all rows in order of ``key``, larger ones first; equal keys share one.

    Keys are sorted by ranges, and only the k - 1 keys at which blocks begin come to the driver.
    """
    keys = df.select(key).repartitionByRange(key).sortWithinPartitions(key).select(key, F.monotonically_increasing_id().alias("at")).persist()
    try:
        part = F.shiftrightunsigned("at", 33)
        sizes = {r["part"]: r["n"] for r in keys.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
        total, begins, edges = sum(sizes.values()), [], 0
        for i in range(k - 1):
            edges += total // k + (i < total % k)
            begins.append(edges)
        wanted, before = [], 0
        for p in sorted(sizes):
            wanted += [(p << 33) + b - before for b in begins if before <= b < before + sizes[p]]
            before += sizes[p]
        bounds = sorted(r[key] for r in keys.filter(F.col("at").isin(wanted)).collect())
    finally:
        keys.unpersist()
    return df.withColumn("fold", sum((F.when(F.col(key) >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)).cast("long"))


def permutation(df: DataFrame, seed: int = 42, by: str = "project", key: str = "row_id") -> DataFrame:
    """Adds ``place``: a random order of each group's rows."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(draw(F.col(key), seed), key)).cast("long"))


def trials(df: DataFrame, count: int = 30) -> DataFrame:
    """target, trial, seed."""
    return df.select(F.col("project").alias("target")).distinct().select("target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("trial")).withColumn("seed", trial_seed(F.col("trial")))
