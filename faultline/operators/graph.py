"""Class dependency networks and node embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import javacode
from ..functions.vectors import mean_vector, relu, times_matrix, unit


# ---- building ----

def parse(sources: DataFrame) -> DataFrame:
    """project, path, node, deps from project, path, content."""
    named = sources.withColumn("node", javacode.class_name(F.col("content"), F.col("path")))
    return named.select("project", "path", "node", javacode.dependencies(F.col("content"), F.col("node")).alias("deps"))


def nodes(parsed: DataFrame) -> DataFrame:
    """project, node, path: one row a simple name; of several files the last by path."""
    return parsed.groupBy("project", "node").agg(F.max("path").alias("path"))


def edges(parsed: DataFrame) -> DataFrame:
    """project, src, dst: dependencies on known other classes."""
    wanted = parsed.select("project", F.col("node").alias("src"), F.explode("deps").alias("dst")).filter("src <> dst").distinct()
    known = nodes(parsed).select("project", F.col("node").alias("dst"))
    return wanted.join(known, ["project", "dst"], "left_semi").select("project", "src", "dst")


def undirected(directed: DataFrame) -> DataFrame:
    """project, a < b, each pair once."""
    return directed.select("project", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def adjacency(directed: DataFrame) -> DataFrame:
    """project, node, other: both ends of every edge; reciprocal edges count twice."""
    back = directed.select("project", F.col("dst").alias("node"), F.col("src").alias("other"))
    return directed.select("project", F.col("src").alias("node"), F.col("dst").alias("other")).unionAll(back)


def degrees(directed: DataFrame) -> DataFrame:
    return adjacency(directed).groupBy("project", "node").agg(F.count("*").alias("degree"))


def size(all_nodes: DataFrame, directed: DataFrame) -> DataFrame:
    n = all_nodes.groupBy("project").agg(F.count("*").alias("n_nodes"))
    e = directed.groupBy("project").agg(F.count("*").alias("n_edges"))
    return n.join(e, "project", "left").select("project", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def negative_pairs(all_nodes: DataFrame, directed: DataFrame, ratio: int = 3, rank=None) -> DataFrame:
    """project, a < b: node pairs without an edge, ``ratio`` for each edge or all there are.

    A project whose pairs are few against those wanted lists them all; ``rank`` orders them (default: a hash).  In
    any other, pairs are drawn - three for each that is wanted, which leaves enough where free pairs abound - so
    the work follows the edges, not the square of the nodes.
    """
    linked = undirected(directed)
    n = all_nodes.groupBy("project").agg(F.count("*").alias("n"))
    wanted = linked.groupBy("project").agg((F.count("*") * ratio).alias("wanted")).join(n, "project")
    few = F.col("n") * (F.col("n") - 1) <= 16 * F.col("wanted")
    order = rank if rank is not None else F.xxhash64("a", "b")
    one, two = all_nodes.select("project", F.col("node").alias("a")), all_nodes.select("project", F.col("node").alias("b"))
    listed = one.join(wanted.filter(few), "project").join(two, "project").filter("a < b").select("project", "wanted", "a", "b").withColumn("order", order.cast("long"))
    numbered = all_nodes.select("project", "node", (F.row_number().over(Window.partitionBy("project").orderBy("node")) - 1).alias("number"))
    tries = wanted.filter(~few).select("project", "wanted", "n", F.explode(F.sequence(F.lit(0).cast("long"), 3 * F.col("wanted") + 20)).alias("order"))
    tries = tries.select("project", "wanted", "order", *[F.pmod(F.xxhash64("project", "order", F.lit(k)), F.col("n")).cast("int").alias(k) for k in ("x", "y")])
    for k in ("x", "y"):
        tries = tries.join(numbered.select("project", F.col("number").alias(k), F.col("node").alias(f"node_{k}")), ["project", k])
    drawn = tries.filter("node_x <> node_y").select("project", "wanted", F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), "order")
    drawn = drawn.groupBy("project", "wanted", "a", "b").agg(F.min("order").alias("order"))
    free = listed.select("project", "wanted", "a", "b", "order").unionByName(drawn).join(linked, ["project", "a", "b"], "left_anti")
    placed = free.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy("order", "a", "b")))
    return placed.filter("place <= wanted").select("project", "a", "b")


# ---- message passing ----

def neighbour_mean(features: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """project, node, h, m: own vector and mean of the neighbours' (zeros without any)."""
    got = links.join(features.select("project", F.col("node").alias("other"), F.col("h").alias("oh")), ["project", "other"])
    means = got.groupBy("project", "node").agg(mean_vector(F.col("oh"), width).alias("m"))
    return features.join(means, ["project", "node"], "left").select("project", "node", "h", F.coalesce("m", F.array_repeat(F.lit(0.0), width)).alias("m"))


def sage_layer(features: DataFrame, links: DataFrame, weights: list[list[float]]) -> DataFrame:
    """unit(relu([h | mean of neighbours] W)); W has twice as many rows as h is wide."""
    joined = neighbour_mean(features, links, len(weights) // 2)
    return joined.select("project", "node", unit(relu(times_matrix(F.concat("h", "m"), weights))).alias("h"))


def align_embeddings(rows: DataFrame, embedded: DataFrame, width: int, name: str = "classname", fallback: str | None = "name") -> DataFrame:
    """Adds ``emb`` and ``matched``: exact name, then simple name (last file wins), then zeros."""
    exact = embedded.groupBy("project", F.col("node").alias("k1")).agg(F.max_by("h", "node").alias("e1"))
    simple = embedded.groupBy("project", javacode.last_part(F.col("node")).alias("k2")).agg(F.max_by("h", "node").alias("e2"))
    key = F.coalesce(*[F.col(c) for c in (name, fallback) if c and c in rows.columns])
    keyed = rows.withColumn("k1", key).withColumn("k2", javacode.last_part(key))
    joined = keyed.join(exact, ["project", "k1"], "left").join(simple, ["project", "k2"], "left")
    return joined.select(*rows.columns, F.coalesce("e1", "e2", F.array_repeat(F.lit(0.0), width)).alias("emb"), F.coalesce("e1", "e2").isNotNull().alias("matched"))


# ---- learned embeddings: a project's graph is small, one task each ----

def svd_features(adjacent: np.ndarray, width: int = 32) -> np.ndarray:
    """Leading singular directions of A + I, scaled, padded with zeros."""
    n = len(adjacent)
    if n == 1:
        return np.ones((1, width)) * (np.arange(width) == 0)
    u, s, _ = np.linalg.svd(adjacent + np.eye(n))
    k = max(1, min(width, n - 1))
    return np.pad(u[:, :k] * s[:k], ((0, 0), (0, width - k)))


def sage_weights(width: int = 32, hidden: int = 64, seed: int = 42) -> list[np.ndarray]:
    """Fixed random projections of the two layers."""
    rng = np.random.default_rng(seed)
    return [rng.standard_normal((2 * a, b)) * np.sqrt(2 / (2 * a)) for a, b in ((width, hidden), (hidden, width))]


def _forward(h: np.ndarray, mean: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    for w in weights:
        h = np.maximum(np.hstack([h, mean @ h]) @ w, 0)
        length = np.linalg.norm(h, axis=1, keepdims=True)
        h = h / np.where(length < 1e-8, 1, length)
    return h


def train_features(h: np.ndarray, links: np.ndarray, weights: list[np.ndarray], epochs: int = 100, rate: float = 0.01, margin: float = 0.5, ratio: int = 3, sign: str = "as_coded", seed: int = 42) -> np.ndarray:
    """Moves input features along linked nodes: by default apart, as the surveyed method is coded; ``sign="contrastive"`` draws them together.

    ``links``: pairs a, b as index rows, reciprocal ones twice.  Negative pairs are drawn from
    the non-edges there are; a complete graph has none.
    """
    n = len(h)
    if not len(links):
        return _forward(h, np.zeros((n, n)), weights)
    counts = np.zeros((n, n))
    np.add.at(counts, (links[:, 0], links[:, 1]), 1)
    np.add.at(counts, (links[:, 1], links[:, 0]), 1)
    mean = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    positive = np.argwhere(np.triu(counts, 1))
    free = np.argwhere(np.triu(counts == 0, 1))
    rng, way = np.random.default_rng(seed), 1.0 if sign == "contrastive" else -1.0
    h = h.astype(float).copy()
    for _ in range(epochs):
        out, grad = _forward(h, mean, weights), np.zeros_like(h)
        negative = free[rng.integers(0, len(free), len(positive) * ratio)] if len(free) else free
        for pairs, pull in ((positive, True), (negative, False)):
            if not len(pairs):
                continue
            a, b = out[pairs[:, 0]], out[pairs[:, 1]]
            close = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + 1e-8)
            force = 2 * (1 - close) if pull else -2 * np.maximum(close - margin, 0)
            step = way * force[:, None] * (a - b) / (n + 1)
            np.add.at(grad, pairs[:, 0], step)
            np.add.at(grad, pairs[:, 1], -step)
        h -= rate * grad
    return _forward(h, mean, weights)


def embed(all_nodes: DataFrame, directed: DataFrame, width: int = 32, epochs: int = 100, sign: str = "as_coded") -> DataFrame:
    """project, node, h: trained embedding of every project's graph, projects in parallel."""
    import pandas as pd

    weights = sage_weights(width)

    def run(key, mine: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = sorted(mine["node"])
        place = {x: i for i, x in enumerate(names)}
        pairs = np.array([(place[a], place[b]) for a, b in zip(links["src"], links["dst"])], dtype=int).reshape(-1, 2)
        adjacent = np.zeros((len(names),) * 2)
        adjacent[pairs[:, 0], pairs[:, 1]] = adjacent[pairs[:, 1], pairs[:, 0]] = 1
        h = train_features(svd_features(adjacent, width), pairs, weights, epochs, sign=sign)
        return pd.DataFrame({"project": [key[0]] * len(names), "node": names, "h": h.tolist()})

    # new column ids: both sides may come from one parse
    all_nodes, directed = all_nodes.select("project", "node").toDF("project", "node"), directed.select("project", "src", "dst").toDF("project", "src", "dst")
    schema = all_nodes.select("project", "node").schema.add("h", T.ArrayType(T.DoubleType()))
    return all_nodes.groupBy("project").cogroup(directed.groupBy("project")).applyInPandas(run, schema)


# ---- vectors of text and joint features ----

def masked_mean(tokens: DataFrame, by: list[str], width: int, vector: str = "h", mask: str = "mask") -> DataFrame:
    """by, pooled: mean of the vectors where the mask is 1 (null if nowhere)."""
    kept = [F.try_divide(F.sum(F.get(vector, k) * F.col(mask)), F.sum(mask)) for k in range(width)]
    return tokens.groupBy(*by).agg(F.array(*kept).alias("pooled"))


def hashed_text_vectors(df: DataFrame, width: int = 256, text: str = "content") -> DataFrame:
    """Adds ``semantic``: hashed token counts of the first 512 tokens, to unit length.

    A stand-in where no pretrained encoder is at hand; precomputed embeddings are taken as a table.
    """
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    tokens = F.slice(F.filter(F.split(text, r"\W+"), lambda t: t != ""), 1, 512)
    counted = HashingTF(numFeatures=width, inputCol="__tokens", outputCol="__counts").transform(df.withColumn("__tokens", tokens))
    return counted.withColumn("semantic", unit(vector_to_array("__counts"))).drop("__tokens", "__counts")


#: Parts of the joint vector by mode, in their order.
MODES = {"metrics": ("metrics",), "graphsage": ("structural", "metrics"), "codet5": ("semantic", "metrics"), "full": ("semantic", "structural", "metrics")}


def joint_features(parts: dict[str, DataFrame], mode: str = "full", keys: tuple = ("project", "row_id")) -> DataFrame:
    """keys, x: vectors of the mode's parts side by side.  Each part: keys and ``x``."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {sorted(MODES)}")
    if missing := [p for p in MODES[mode] if p not in parts]:
        raise ValueError(f"mode {mode!r} needs {missing}")
    out = None
    for name in MODES[mode]:
        part = parts[name].select(*keys, F.col("x").alias(name))
        out = part if out is None else out.join(part, list(keys))
    return out.select(*keys, F.concat(*MODES[mode]).alias("x"))
