"""Moments, centroids, covariances and distances between projects.

Per-project sums are additive: statistics over any union of projects come from one
pass over the rows and arithmetic on a row a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def centroids(df: DataFrame, features: list[str], by: str = "project") -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in features])


def profile(df: DataFrame, by: str = "project") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg("y").alias("defect_rate"))


def scaler(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation by column; deviation 0 becomes 1."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in features}


def standardise(df: DataFrame, features: list[str], fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[((F.col(c) - fitted[c][0]) / fitted[c][1]).alias(c) if c in fitted and c in features else F.col(c) for c in df.columns])


def covariance_pairs(df: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """Sample covariances, one row a pair of columns (and group)."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    sums = (df.groupBy(by) if by else df).agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs])).alias("r")
    return sums.select(*([by] if by else []), rows).select(*([by] if by else []), "r.a", "r.b", "r.cov")


def covariance(df: DataFrame, features: list[str]):
    """Sample covariance as a numpy matrix: one aggregation, d x d numbers to the driver."""
    import numpy as np

    if len(features) > 64:  # too many expressions for one plan: sums of outer products per partition
        return _covariance_wide(df, features)
    place, out = {c: i for i, c in enumerate(features)}, np.zeros((len(features),) * 2)
    for r in covariance_pairs(df, features).collect():
        out[place[r["a"]], place[r["b"]]] = out[place[r["b"]], place[r["a"]]] = r["cov"] if r["cov"] is not None else np.nan
    return out


def _covariance_wide(df: DataFrame, features: list[str]):
    import numpy as np

    d = len(features)

    def sums(batches):
        import pandas as pd

        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    # partial sums meet in a tree of aggregations, not on the driver
    parts = df.select(*features).mapInPandas(sums, "n long, s array<double>, q array<double>")
    add = parts.select("n", F.posexplode(F.concat("s", "q"))).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v")).orderBy("pos").collect()
    n, v = add[0]["n"], np.array([r["v"] for r in add])
    mean = v[:d] / n
    return (v[d:].reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)


def project_vectors(df: DataFrame, features: list[str], by: str = "project") -> DataFrame:
    """Centroids scaled over the projects (not the rows), as one vector: by, v."""
    means = centroids(df, features, by)
    fitted = scaler(means, features)
    return standardise(means, features, fitted).select(by, F.array(*features).alias("v"))


def mean_discrepancy(a: Column, b: Column) -> Column:
    """Linear-kernel discrepancy of two mean vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def class_counts(df: DataFrame, by: str = "project") -> DataFrame:
    """Majority and minority class (ties: the lowest), their sizes, positive weight and resampling policy."""
    each = df.groupBy(by, "y").agg(F.count("*").alias("n"))
    top = each.groupBy(by).agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("majority"), F.min_by("y", F.struct("n", "y")).alias("minority"), F.max("n").alias("n_majority"), F.min("n").alias("n_minority"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"))
    rate = F.col("n1") / (F.col("n0") + F.col("n1"))
    wanted = F.when(rate >= 0.20, F.col("n_majority")).otherwise(F.floor(F.col("n_majority") * F.lit(0.6)))
    return top.select("*", (F.col("n0") / F.greatest(F.col("n1"), F.lit(1))).alias("pos_weight"), F.greatest(wanted - F.col("n_minority"), F.lit(0)).cast("long").alias("n_synthetic"), F.greatest(F.lit(1), F.least(F.lit(5), F.col("n_minority") - 1)).cast("long").alias("k"))
