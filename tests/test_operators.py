"""Properties and worked cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import align, features, graph, metrics, models, resample, select, split, stats, trees
from faultline.plans import cli, experiment
from faultline.sources import readers, schema


@pytest.fixture(scope="module")
def projects(spark):
    sizes = {"ant": 120, "camel": 100, "jedit": 80, "lucene": 60}
    df = readers.synthetic_projects(spark, sizes, 6, separable=True).persist()
    df.count()
    return df


X = [f"x{k}" for k in range(6)]


def test_scaler_gives_mean_zero_and_deviation_one(projects):
    z = stats.standardise(projects, X, stats.scaler(projects, X))
    row = z.agg(*[F.avg(c).alias(f"m{c}") for c in X], *[F.stddev_pop(c).alias(f"s{c}") for c in X]).first()
    assert all(abs(row[f"m{c}"]) < 1e-9 and abs(row[f"s{c}"] - 1) < 1e-9 for c in X)


def test_constant_column_is_divided_by_one(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "project int, x double")
    assert stats.scaler(df, ["x"]) == {"x": (5.0, 1.0)}


def test_covariance_matches_numpy(projects):
    x = np.array(projects.select(*X).collect())
    assert np.allclose(stats.covariance(projects, X), np.cov(x, rowvar=False))
    assert np.allclose(stats._covariance_wide(projects, X), np.cov(x, rowvar=False))


def test_alignment_reaches_the_goal(projects):
    one, two = projects.filter("project = 'ant'"), projects.filter("project = 'camel'")
    cs, ct = stats.covariance(one, X), stats.covariance(two, X)
    a = align.coral_matrix(cs, ct)
    eye = 1e-3 * np.eye(6)
    assert np.abs(a.T @ (cs + eye) @ a - ct - eye).max() < 1e-8
    moved = np.array(align.transform(one, X, a).select(*X).collect())
    assert np.allclose(moved, np.array(one.select(*X).collect()) @ a)


def test_split_is_disjoint_and_sized(projects):
    df = split.stratified_labels(projects.withColumn("row_id", F.col("row_id")), 0.1)
    for r in df.groupBy("project", "y").agg(F.count("*").alias("n"), F.count_if("labelled").alias("k")).collect():
        assert r["k"] == max(1, int(r["n"] * 0.1))


def test_folds_partition_the_rows(projects):
    df = split.stratified_folds(projects, 5, by=("project", "y"))
    sizes = [r["count"] for r in df.filter("project = 'ant' and y = 1").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_smote_rows_lie_between_two_minority_rows(projects):
    df = projects.filter("project = 'ant'").filter("y = 1 or row_id % 4 = 0").withColumn("project", F.lit(1))
    new = resample.smote(df, X).collect()
    counts = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    rate = counts[1] / sum(counts.values())
    wanted = max(counts.values()) if rate >= 0.2 else int(0.6 * max(counts.values()))
    assert len(new) == wanted - min(counts.values())
    rows = {r["row_id"]: np.array([r[c] for c in X]) for r in df.collect()}
    for r in new:
        a, b, x = rows[r["base_id"]], rows[r["other_id"]], np.array([r[c] for c in X])
        gap = np.linalg.norm(x - a) / np.linalg.norm(b - a)
        assert 0 <= gap < 1 and np.allclose(x, a + gap * (b - a))


@pytest.mark.parametrize("ys", [[0, 0, 1, 1], [0, 0, 0, 1]])
def test_smote_leaves_balanced_and_single_rows(spark, ys):
    df = spark.createDataFrame([(1, i, float(i), y) for i, y in enumerate(ys)], "project long, row_id long, x double, y int")
    assert resample.smote(df, ["x"]).count() == 0


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 1), (1, 0, 0.9, 1), (1, 1, 0.2, 0), (1, 0, 0.1, 0), (2, 0, 0.5, 0)], "g int, y int, score double, pred int")
    rows = {r["g"]: r for r in metrics.scores(df, ["g"]).collect()}
    assert rows[1]["f1"] == 0.5 and rows[1]["mcc"] == 0 and rows[1]["auc"] == 0.625
    assert rows[2]["f1"] == 0 and rows[2]["auc"] is None


def test_auc_of_reversed_scores(projects):
    df = projects.withColumn("score", F.col("x0")).withColumn("g", F.lit(1))
    one = metrics.auc(df, ["g"]).first()["auc"]
    two = metrics.auc(df.withColumn("score", -F.col("score")), ["g"]).first()["auc"]
    assert one > 0.7 and abs(one + two - 1) < 1e-12


def test_threshold_default(spark):
    df = spark.createDataFrame([(1, 0, 0.05), (1, 1, 0.01)], "g int, y int, score double")
    assert metrics.best_threshold(df, ["g"]).first()["threshold"] == 0.5


def test_summary_of_failed_trials(spark):
    df = spark.createDataFrame([("a", None, None, None)], "target string, f1 double, auc double, mcc double")
    row = metrics.summarise(df).first()
    assert row["n_ok"] == 0 and row["f1_mean"] == 0 and row["mcc_std"] == 0


def test_wilcoxon_and_cliff(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 2.0, 4.0), (1, 3.0, 3.0)], "g int, a double, b double")
    row = metrics.wilcoxon(df, ["g"]).first()
    assert (row["n"], row["w_plus"], row["w_minus"]) == (2, 2.0, 1.0)
    df = spark.createDataFrame([(1, 1, 3.0), (1, 0, 1.0), (1, 0, 3.0)], "g int, y int, v double")
    assert metrics.cliffs_delta(df, ["g"], "y", "v").first()["delta"] == 0.5


def test_scott_knott_separates():
    ranks = metrics.scott_knott({"a": [0.9, 0.91], "b": [0.5, 0.51], "c": [0.9, 0.9]})
    assert ranks["a"] == 1 and ranks["b"] > ranks["a"]


def test_adaptive_selection_keeps_one(spark):
    ranked = spark.createDataFrame([(1, 2, 0.1, 1), (1, 3, 0.05, 2)], "target int, source int, score double, rank long")
    assert [r["source"] for r in select.select_sources(ranked, None, 0.4).collect()] == [2]


def test_selection_with_equal_centroids(spark):
    df = spark.createDataFrame([(p, i, 1.0, i % 2) for p in (1, 2, 3) for i in range(4)], "project int, row_id int, x double, y int")
    rows = select.rank_sources(df, ["x"]).collect()
    assert len(rows) == 6 and all(r["mmd"] == 0 and r["cos"] == 0 for r in rows)


def test_lasso_optimality(projects):
    z = stats.standardise(projects, X, stats.scaler(projects, X))
    gram = sum(features.gram_by_fold(z.withColumn("fold", F.lit(0)), X).values())
    w = features.lasso(gram, 0.05)
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    c = gram[1:, 1:] / n - np.outer(mean, mean)
    slope = c[:-1, -1] - c[:-1, :-1] @ w
    assert np.all(np.abs(slope) <= 0.05 + 1e-7)
    assert np.allclose(slope[w != 0], 0.05 * np.sign(w[w != 0]), atol=1e-7)


def test_survivors_fall_back_to_the_largest():
    assert features.survivors(np.array([0.0, 1e-9, -0.5, 0.0]), 2) == [1, 2]


def test_feature_selection_finds_the_signal(projects):
    found = features.select_features(projects, X, least=2, trees=10)
    assert "x0" in found["features"] and len(found["features"]) >= 2


def test_a_distance_of_shifted_projects(spark):
    rng = np.random.default_rng(1)
    rows = [(p, i, float(rng.normal(10 * (p == 3)))) for p in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "project long, row_id long, x double")
    d = {(r["target"], r["source"]): r["adist"] for r in models.a_distances(df, ["x"]).collect()}
    assert d[1, 3] > 1.8 > d[1, 2]


def test_trials_on_a_separable_fixture(projects):
    rows = experiment.evaluate_targets(projects, X, ["ant"], 2).collect()
    assert len(rows) == 2 and all(r["auc"] > 0.8 and len(r["selected_sources"]) == 3 for r in rows)


def test_small_and_distributed_trials_agree(projects):
    """Label split, sources and scores: the models differ, what they are fitted on does not."""
    small = experiment.evaluate_targets(projects, X, ["ant"], 1).first()
    large = experiment.run_trial(projects, "ant", X, seed=13, trees=10, rounds=5, folds=2)
    assert small["selected_sources"] == large["selected_sources"] and abs(small["auc"] - large["auc"]) < 0.15
    mark = split.stratified_labels(projects.filter("project = 'ant'"), 0.1, 13).orderBy("row_id").select("row_id", "y", "labelled").toPandas()
    assert (experiment.label_split(mark["row_id"].to_numpy(), mark["y"].to_numpy(), 0.1, 13) == mark["labelled"]).all()


def test_draws_are_the_same_in_numpy(spark):
    from faultline.functions.prng import draw, draws

    ids = np.array([0, 5, -7, 2**62 + 11, -(2**62) - 3])
    df = spark.createDataFrame([(int(i),) for i in ids], "i long")
    assert {r["i"]: r["d"] for r in df.select("i", draw(F.col("i"), 13).alias("d")).collect()} == dict(zip(ids.tolist(), draws(ids, 13).tolist()))


def test_predicting_needs_no_labels(projects):
    train, test = projects.filter("project <> 'ant'"), projects.filter("project = 'ant'")
    test = test.select("row_id", *[(F.col(c) * 50 + 7).alias(c) for c in X], "y")
    train = train.select(F.xxhash64("project", "row_id").alias("row_id"), *[(F.col(c) * 50 + 7).alias(c) for c in X], "y")
    model = models.StackedEnsemble(X, 2, trees=5, rounds=3).fit(train)
    one, two = ({r["row_id"]: r["score"] for r in model.predict(t).collect()} for t in (test, test.drop("y")))
    assert one == two and len(set(one.values())) > 10


def test_named_projects_draw_sources_and_rows(projects):
    drawn = split.random_sources(projects, 2, 3).collect()
    assert len(drawn) == 4 * 2 * 3 and all(r["target"] != r["source"] for r in drawn)
    rare = projects.filter((F.col("y") == 0) | (F.col("row_id") % 4 == 0))
    assert {r["project"] for r in resample.smote(rare, X).collect()} <= {"ant", "camel", "jedit", "lucene"}
    assert len(experiment.leave_one_out_random(projects, X, ["ant"], 2, 2, rounds=5)) == 2


def test_neighbours_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (90, 2)).astype(float)  # many ties
    df = spark.createDataFrame([("p", k, *map(float, v)) for k, v in enumerate(x)] + [("q", 1000, 0.0, 0.0)], "project string, row_id long, a double, b double")
    monkeypatch.setattr(resample, "BLOCK_ROWS", 20)
    got = {(r["row_id"], r["place"]): r["other"] for r in resample.neighbours(df, ["a", "b"], 4).collect()}
    for i in range(90):
        order = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in range(90) if j != i)[:4]
        assert [got[i, p + 1] for p in range(4)] == [j for _, j in order]
    assert not any(k == 1000 for k, _ in got)


def test_global_blocks_are_contiguous(spark):
    df = spark.range(1003).select((F.col("id") * 7919 % 100003).alias("row_id")).repartition(5)
    got = split.global_blocks(df, 5).toPandas().sort_values("row_id")["fold"].tolist()
    assert got == [0] * 201 + [1] * 201 + [2] * 201 + [3] * 200 + [4] * 200


def test_negative_pairs_of_a_large_sparse_graph(spark):
    nodes = spark.range(400).selectExpr("'p' AS project", "id AS node")
    links = spark.range(40).selectExpr("'p' AS project", "id AS src", "id + 1 AS dst")
    got = {(r["a"], r["b"]) for r in graph.negative_pairs(nodes, links).collect()}
    assert len(got) == 120 and all(a < b and not (a < 40 and b == a + 1) for a, b in got)


def test_trees_learn_and_weigh_columns():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 1] + 0.2 * rng.normal(size=400) > 0).astype(int)
    learn = np.arange(400)[None] < 300
    code = trees.binned(x)
    scored, importance = trees.forest(code, y, learn, 30, 1)
    assert importance.argmax() == 1 and ((scored[0] > 0.5) == y)[300:].mean() > 0.85
    hidden = np.where(learn[0], y, 0)  # labels of rows that are not learnt from do not matter
    assert (trees.boosted(code, y, learn, 20, 0.3, 3) == trees.boosted(code, hidden, learn, 20, 0.3, 3)).all()
    assert ((trees.boosted(code, hidden, learn, 20, 0.3, 3)[0] > 0.5) == y)[300:].mean() > 0.85


def test_neighbours_of_many_rows_in_little_memory(monkeypatch):
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(5000, 4)).round(1)  # with ties
    tracemalloc.start()
    near = experiment.small_smote(x, np.r_[np.zeros(4000, int), np.ones(1000, int)], 3), experiment.small_neighbours(x, 5)
    assert tracemalloc.get_traced_memory()[1] < 200e6  # all distances at once are 800 MB
    tracemalloc.stop()
    d = ((x[:800, None] - x[None]) ** 2).sum(2)
    d[np.arange(800), np.arange(800)] = np.inf
    assert (near[1][:800] == np.argsort(d, axis=1, kind="stable")[:, :5]).all()
    monkeypatch.setattr(experiment, "NEAR_CELLS", 1)
    assert (experiment.small_neighbours(x[:60], 5) == np.argsort(np.where(np.eye(60) > 0, np.inf, ((x[:60, None] - x[None, :60]) ** 2).sum(2)), axis=1, kind="stable")[:, :5]).all()


def test_rows_with_equal_bins_are_one_cell():
    rng = np.random.default_rng(2)
    x, n = rng.normal(size=(300, 3)).round(1), rng.integers(1, 5, 300)
    pos = rng.binomial(n, np.where(x[:, 0] > 0, 0.8, 0.3))
    y = np.concatenate([np.r_[np.ones(p, int), np.zeros(k - p, int)] for p, k in zip(pos, n)])
    first, learn = np.r_[0, np.cumsum(n)[:-1]], np.arange(300) < 200
    code = trees.binned(np.repeat(x, n, axis=0))
    assert (trees.binned(x, n=n) == code[first]).all()
    whole = trees.boosted(code, y, np.repeat(learn, n)[None], 20, 0.3, 4)[0][first]
    assert np.allclose(trees.boosted(code[first], pos, learn[None], 20, 0.3, 4, n)[0], whole)
    distinct, of = trees.cells(code)
    assert (distinct[of] == code).all() and len(np.unique(distinct, axis=0)) == len(distinct)
    wide = np.tile(code, (1, 5))  # too wide for one number
    assert (trees.cells(wide)[0][trees.cells(wide)[1]] == wide).all() and len(trees.cells(wide)[0]) == len(distinct)


def test_distributed_trial(projects):
    r = experiment.run_trial(projects, "ant", X, trees=5, rounds=3, folds=2, use_a_distance=False)
    assert r["auc"] > 0.7 and len(r["selected_sources"]) == 3


def test_boosted_baselines(projects):
    assert experiment.within_project(projects, "ant", X, 5)["auc"] > 0.6
    rows = experiment.leave_one_out(projects, X, ["ant"], rounds=5)
    assert rows[0]["auc"] > 0.6


def test_too_few_projects(spark):
    with pytest.raises(ValueError):
        schema.require_projects(spark.createDataFrame([("a",)], "project string"))


JAVA = {
    "a/A.java": "import a.b.C; import static x.Y.z; import q.*;\npublic class A extends B implements C, D { private Foo bar; private final Foo baz; }",
    "a/B.java": "// this class is here\nclass B extends A<T> { public Foo make( ) {} }",
    "a/C.java": "interface C { }",
    "a/Foo.java": "no declaration",
}


def test_java_dependencies(spark):
    df = spark.createDataFrame([("p", k, v) for k, v in JAVA.items()], "project string, path string, content string")
    parsed = {r["path"]: r for r in graph.parse(df).collect()}
    assert parsed["a/A.java"]["node"] == "A" and set(parsed["a/A.java"]["deps"]) == {"C", "B", "implements", "D", "Foo"}
    assert parsed["a/B.java"]["node"] == "is"
    assert parsed["a/Foo.java"]["node"] == "Foo"
    edges = {(r["src"], r["dst"]) for r in graph.edges(graph.parse(df)).collect()}
    assert edges == {("A", "C"), ("A", "Foo"), ("is", "Foo")}


def test_same_name_in_two_files_is_one_node(spark):
    df = spark.createDataFrame([("p", "x/A.java", "class A {}"), ("p", "y/A.java", "class A {}")], "project string, path string, content string")
    assert [tuple(r) for r in graph.nodes(graph.parse(df)).collect()] == [("p", "A", "y/A.java")]


def test_decode_falls_back(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "content binary")
    assert [r[0] for r in df.select(readers.decode_text(F.col("content"))).collect()] == ["é", "é"]


def test_graph_degenerate_cases(spark):
    nodes = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "project string, node string")
    none = spark.createDataFrame([], "project string, src string, dst string")
    full = spark.createDataFrame([("p", "a", "b"), ("p", "a", "c"), ("p", "b", "c")], "project string, src string, dst string")
    assert graph.negative_pairs(nodes, none).count() == 0
    assert graph.negative_pairs(nodes, full).count() == 0
    assert graph.embed(nodes, none, 4, 3).count() == 3
    assert graph.embed(nodes, full, 4, 3).count() == 3
    assert graph.size(nodes, none).first()["n_edges"] == 0


def test_training_draws_neighbours_together():
    links = np.array([[0, 1], [1, 2], [3, 4], [4, 5]])
    adjacent = np.zeros((6, 6))
    adjacent[links[:, 0], links[:, 1]] = adjacent[links[:, 1], links[:, 0]] = 1
    h = graph.svd_features(adjacent, 8)
    out = graph.train_features(h, links, graph.sage_weights(8, 16), 50, rate=0.1)
    assert out.shape == (6, 8) and np.isfinite(out).all()
    assert not np.allclose(out, graph.train_features(h, links, graph.sage_weights(8, 16), 50, rate=0.1, sign="contrastive"))


def test_embeddings_fall_back_to_zeros(spark):
    rows = spark.createDataFrame([("p", "a.X"), ("p", "b.Y"), ("p", "Z")], "project string, classname string")
    emb = spark.createDataFrame([("p", "a.X", [1.0, 2.0]), ("p", "c.Y", [3.0, 4.0])], "project string, node string, h array<double>")
    got = {r["classname"]: (r["emb"], r["matched"]) for r in graph.align_embeddings(rows, emb, 2, fallback=None).collect()}
    assert got == {"a.X": ([1.0, 2.0], True), "b.Y": ([3.0, 4.0], True), "Z": ([0.0, 0.0], False)}


def test_mode_errors(spark):
    with pytest.raises(ValueError):
        graph.joint_features({}, "full")
    with pytest.raises(ValueError):
        graph.joint_features({}, "other")


def write_projects(folder, n=60):
    rng = np.random.default_rng(0)
    for name in ("ant-1.0", "camel-1.0", "jedit-1.0"):
        lines = [",".join(schema.CONTRACT)]
        for i in range(n):
            x = rng.normal(size=20)
            lines.append(",".join([name, "1.0", f"c.K{i}", *[f"{v:.4f}" for v in x], str(int(x[0] + x[1] > 0.3))]))
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")


def test_csv_scan_cli_and_report(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    write_projects(data)
    (data / "notes.txt").write_text("not a table")
    df = readers.feature_table(spark, str(data))
    assert sorted(r[0] for r in df.select("project").distinct().collect()) == ["ant-1.0", "camel-1.0", "jedit-1.0"]
    assert df.select("version").first()[0] == "1.0" and df.count() == 180
    assert cli.main(["--data_dir", str(data), "--target", "none"]) == 1
    assert cli.main(["--data_dir", str(data), "--target", "ant-1.0", "--trials", "1", "--output", str(tmp_path / "out")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_mixed_schemas_are_aligned_by_name(spark, tmp_path):
    (tmp_path / "kc3.csv").write_text("id,loc,wmc,Defective,bug\n1,10,1,Y,1\n2,,2,N,0\n3,30,3,N,0\n")
    (tmp_path / "ant.csv").write_text("name,classname,wmc,loc,defects\nant,c.A,1,5,2\nant,c.B,2,6,0\n")
    (tmp_path / "broken.csv").write_text("loc,wmc\n1,2\n")
    df, features, skipped = readers.load_projects(spark, str(tmp_path))
    assert sorted(features) == ["loc", "wmc"] and len(skipped) == 1 and "broken" in next(iter(skipped))
    rows = sorted((r["project"], r["loc"], r["y"]) for r in df.collect())
    assert rows == [("ant", 5.0, 1), ("ant", 6.0, 0), ("kc3", 10.0, 1), ("kc3", 20.0, 0), ("kc3", 30.0, 0)]
    both = readers.combined_table(spark, [str(tmp_path / "kc3.csv")])
    assert both.columns == ["id", "loc", "wmc", "y"] or "wmc" in both.columns


def test_cli_with_source_trees(spark, tmp_path):
    data, src = tmp_path / "data", tmp_path / "trees"
    data.mkdir()
    write_projects(data, 40)
    for name in ("ant", "camel-1.0", "jedit_1.0"):
        (src / name / "src").mkdir(parents=True)
        for i in range(8):
            (src / name / "src" / f"K{i}.java").write_text(f"class K{i} extends K{(i + 1) % 8} {{ private K{(i + 3) % 8} f; }}")
    df, columns = cli.load(spark, str(data), "full", str(src), epochs=3)
    assert len(columns) == 308 and df.count() == 120
    assert df.filter("structural0 <> 0 or structural1 <> 0 or structural2 <> 0").count() > 0
    with pytest.raises(ValueError):
        cli.load(spark, str(data), "full")


def test_bad_rows_are_reported(spark, tmp_path):
    write_projects(tmp_path, 5)
    with open(tmp_path / "ant-1.0.csv", "a") as f:
        f.write("x,1.0,c.Bad," + ",".join(["oops"] * 20) + ",1\n")
    assert [tuple(r) for r in readers.failed_files(spark, str(tmp_path)).collect()] == [("ant-1.0", 1, 20)]


def test_dynamic_schema(spark, tmp_path):
    (tmp_path / "kc3.csv").write_text("id,loc,Defective,bug\n1,10,Y,1\n2,20,N,0\n")
    df = readers.read_dynamic(spark, str(tmp_path / "kc3.csv"))
    assert df.columns == ["project", "id", "loc", "y"] and [r["y"] for r in df.orderBy("id").collect()] == [1, 0]
    with pytest.raises(ValueError):
        schema.resolve_label(["loc"])


def test_median_imputation_keeps_empty_columns(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("a", 3.0, None)], "project string, x double, z double")
    rows = schema.impute_median(df, ["x", "z"]).collect()
    assert sorted(r["x"] for r in rows) == [1.0, 2.0, 3.0] and all(r["z"] is None for r in rows)


def test_cache_is_keyed_by_content(spark, tmp_path):
    a, b = spark.range(3), spark.range(4)
    assert readers.cached(a, str(tmp_path), "k").count() == 3 and readers.cached(b, str(tmp_path), "k").count() == 4
    assert readers.cached(a, str(tmp_path), "k").count() == 3


def test_source_folders(tmp_path):
    (tmp_path / "ant" / "src").mkdir(parents=True)
    assert readers.source_folders([str(tmp_path)], "ant-1.7").endswith("/ant")
    assert readers.source_folders([str(tmp_path)], "ivy") is None


def test_streaming_equals_batch(spark, tmp_path):
    from faultline.streaming import incremental

    write_projects(tmp_path, 20)
    got = {}
    stream = incremental.read_stream(spark, str(tmp_path), schema.SCHEMA, files_per_trigger=1)
    stream = stream.withColumn("project", F.col("name")).withColumn("y", schema.binarise())
    q = incremental.start(incremental.running_profile(stream, ["loc"]), str(tmp_path / "state"), lambda df, i: got.update({r["project"]: (r["n"], round(r["loc"], 9)) for r in df.collect()}))
    q.awaitTermination(120)
    batch = readers.read_projects(spark, str(tmp_path))
    want = {r["project"]: (r["n"], round(r["m"], 9)) for r in batch.groupBy("project").agg(F.count("*").alias("n"), F.avg("loc").alias("m")).collect()}
    assert got == want
