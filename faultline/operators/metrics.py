"""Scores of binary predictions and comparisons of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Threshold grid of 40 steps, and the published averages that results are held against.
THRESHOLDS = [0.1 + i * 0.020000000000000004 for i in range(40)]
PAPER = {"f1": 0.627, "auc": 0.663, "mcc": 0.245}
CLIFF_BANDS = ((0.147, "negligible"), (0.474, "medium"))


def confusion() -> list[Column]:
    """Aggregates over columns y and pred."""
    hit = lambda y, p: F.count_if((F.col("y") == y) & (F.col("pred") == p))
    return [hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")]


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    d = [c.cast("double") for c in (tp, fp, fn, tn)]
    under = (d[0] + d[1]) * (d[0] + d[2]) * (d[3] + d[1]) * (d[3] + d[2])
    return F.when(under > 0, (d[0] * d[3] - d[1] * d[2]) / F.sqrt(under)).otherwise(F.lit(0.0))


def auc(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Exact area under the curve: average ranks of ties, null if a class is absent.

    Scores are counted by value first, so ties never sit in one window row by row.
    """
    values = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    below = F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranked = values.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / F.lit(2.0))
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("n1"), F.sum(F.col("n") - F.col("p")).cast("double").alias("n0"))
    return sums.select(*by, F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"))


def scores(df: DataFrame, by: list[str]) -> DataFrame:
    """by, f1, auc, mcc from columns y, pred and score."""
    c = df.groupBy(*by).agg(*confusion())
    c = c.select(*by, f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("mcc"))
    return c.join(auc(df, by), by)


def best_threshold(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, threshold, f1: the first best of the grid; 0.5 and 0 if none predicts a true positive."""
    grid = F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold")
    # counts by value before the grid: 40 times the distinct scores, not the rows
    values = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    each = values.select(*by, F.col(score).alias("s"), "n", "p", grid).groupBy(*by, "threshold")
    counts = each.agg(F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("pos"), F.sum("p").alias("all"))
    tried = counts.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("pos") + F.col("all")), F.lit(0.0)))
    useful = tried.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f1"), "threshold"))).filter("rank = 1")
    return useful.select(*by, F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(0.5)).alias("threshold"), "f1")


def summarise(trials: DataFrame, by: str = "target") -> DataFrame:
    """Mean, median and population deviation of each score over the trials that gave one; zeros if none did."""
    out = []
    for m in ("f1", "auc", "mcc"):
        out += [F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean"), F.coalesce(F.median(m), F.lit(0.0)).alias(f"{m}_median"), F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias(f"{m}_std")]
    return trials.groupBy(by).agg(F.count("f1").alias("n_ok"), *out)


def overall(rows: DataFrame, digits: int = 3) -> DataFrame:
    """n and the rounded average of each score over rows of targets (and repeats); rows without a score are left out of it."""
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in ("f1", "auc", "mcc")])


def against_paper(summary: DataFrame) -> DataFrame:
    """metric, mean, paper, delta_pct: averages over targets against the published ones."""
    means = summary.agg(*[F.avg(f"{m}_mean").alias(m) for m in PAPER])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean"), F.lit(v).alias("paper")) for m, v in PAPER.items()])).alias("r")
    return means.select(rows).select("r.*").withColumn("delta_pct", (F.col("mean") - F.col("paper")) / F.col("paper") * 100)


def wilcoxon(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """by, n, w_plus, w_minus, z: signed ranks of the differences, zeros dropped, ties averaged."""
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("d")).filter("d <> 0").withColumn("m", F.abs("d"))
    values = d.groupBy(*by, "m").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("plus"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = values.withColumn("rank", below + (F.col("n") + 1) / F.lit(2.0))
    w = r.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("plus"))).alias("w_minus"))
    n = F.col("n").cast("double")
    return w.withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))


def cliffs_delta(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """by, delta, band: share of pairs (1 over 0) above less share below, from counts by value, without pairs."""
    values = df.groupBy(*by, value).agg(F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n0").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = values.withColumn("win", F.col("n1") * before).withColumn("lose", F.col("n1") * (F.sum("n0").over(w) - before - F.col("n0")))
    s = r.groupBy(*by).agg(F.sum("win").alias("win"), F.sum("lose").alias("lose"), F.sum("n1").cast("double").alias("n1"), F.sum("n0").cast("double").alias("n0"))
    s = s.select(*by, F.try_divide((F.col("win") - F.col("lose")).cast("double"), F.col("n1") * F.col("n0")).alias("delta"))
    size = F.abs("delta")
    return s.withColumn("band", F.when(size < CLIFF_BANDS[0][0], "negligible").when(size < CLIFF_BANDS[1][0], "medium").otherwise("large"))


def scott_knott(means: dict[str, list[float]], least_effect: float = 0.2) -> dict[str, int]:
    """Rank groups of treatments: sorted by mean and split where the between-group sum of squares is
    largest, as long as the two sides differ by a non-negligible effect (Cohen's d).  A result table is a
    row a treatment and trial, so this runs on the driver."""
    import numpy as np

    order = sorted(means, key=lambda k: -float(np.mean(means[k])))
    ranks: dict[str, int] = {}

    def split(names: list[str]) -> None:
        best, at = 0.0, 0
        mu = np.array([np.mean(means[n]) for n in names])
        for k in range(1, len(names)):
            gain = k * (mu[:k].mean() - mu.mean()) ** 2 + (len(names) - k) * (mu[k:].mean() - mu.mean()) ** 2
            if gain > best:
                best, at = gain, k
        if at:
            a, b = (np.concatenate([means[n] for n in part]) for part in (names[:at], names[at:]))
            pooled = np.sqrt((a.var(ddof=0) * len(a) + b.var(ddof=0) * len(b)) / max(1, len(a) + len(b) - 2))
            if abs(a.mean() - b.mean()) > least_effect * pooled:
                split(names[:at])
                split(names[at:])
                return
        number = max(ranks.values(), default=0) + 1
        ranks.update(dict.fromkeys(names, number))

    split(order)
    return ranks
