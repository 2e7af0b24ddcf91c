"""Command line: ``python -m faultline.plans.cli --data_dir data --target ant``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from ..operators import graph, metrics
from ..sources import readers, schema
from . import experiment


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Cross-project defect prediction on Spark")
    p.add_argument("--data_dir", required=True, help="folder of metric tables, one CSV a project")
    p.add_argument("--src_root", default=None, help="folder of source trees, for modes with structure or text")
    p.add_argument("--mode", default="metrics", choices=sorted(graph.MODES))
    p.add_argument("--target", default=None, help="one target project; all of them if left out")
    p.add_argument("--top_k", type=int, default=3)
    p.add_argument("--trials", type=int, default=30)
    p.add_argument("--epochs", type=int, default=100, help="rounds of structural training")
    p.add_argument("--output", default=None, help="folder for the result table as CSV")
    p.add_argument("--master", default=None)
    return p


def load(spark: SparkSession, data_dir: str, mode: str = "metrics", src_root: str | None = None, epochs: int = 100):
    """(rows, feature names): metric columns with medians for nulls, and the mode's vectors beside them.

    Projects without sources are left out of modes that need them.
    """
    df, metrics_, skipped = readers.load_projects(spark, data_dir)
    for path, reason in skipped.items():
        print(f"skipped {path}: {reason}")
    if mode == "metrics":
        return df, metrics_
    if not src_root:
        raise ValueError(f"mode {mode!r} needs --src_root")
    sources = None
    for name in schema.require_projects(df):
        if folder := readers.source_folders([src_root], name):
            own = readers.read_sources(spark, folder).withColumn("project", F.lit(name))
            sources = own if sources is None else sources.unionByName(own)
    if sources is None:
        raise ValueError("no project has sources")
    parsed = graph.parse(sources)
    df = df.join(parsed.select("project").distinct(), "project", "left_semi")
    columns, width = list(metrics_), {"structural": 32, "semantic": 256}
    for part in (p for p in graph.MODES[mode] if p != "metrics"):
        if part == "structural":
            vectors = graph.embed(graph.nodes(parsed), graph.edges(parsed), epochs=epochs)
        else:
            text = graph.hashed_text_vectors(sources.withColumn("node", graph.javacode.class_name(F.col("content"), F.col("path"))))
            vectors = text.select("project", "node", F.col("semantic").alias("h"))
        df = graph.align_embeddings(df, vectors, width[part])
        names = [f"{part}{k}" for k in range(width[part])]
        df = df.withColumns({n: F.get("emb", k) for k, n in enumerate(names)}).drop("emb", "matched")
        columns = names + columns
    return df, columns


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("faultline")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    df, columns = load(spark, args.data_dir, args.mode, args.src_root, args.epochs)
    names = schema.require_projects(df)
    if args.target and args.target not in names:
        print(f"unknown target {args.target!r}; known: {', '.join(map(str, names))}")
        return 1
    rows = df.select("project", "row_id", *columns, "y").persist()
    result = metrics.summarise(experiment.evaluate_targets(rows, columns, [args.target] if args.target else None, args.trials, args.top_k)).orderBy("target").persist()
    result.show(100, truncate=False)
    metrics.against_paper(result).show(truncate=False)
    if args.output:
        readers.write_report(result.withColumnRenamed("target", "project"), args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
