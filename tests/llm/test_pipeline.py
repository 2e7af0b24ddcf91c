"""The pipeline's stages on a small table, each against a plain version on its own input."""

import brute

import corpus_pipeline
from faultline.llm import queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        before, after = ([(r["doc_id"], r["text"]) for r in d.collect()] for d in (docs, out))
        if name == "exact_dedup":
            assert sorted(i for i, _ in after) == sorted(i for i, _, _, kept, _ in brute.exact(before) if kept)
        if name == "simhash_near_dedup":
            kept = {i for i, _ in after}
            assert kept <= {i for i, _, least in brute.near(before) if i == least}
            # what else went is similar to a document, gone or kept; nearly all similar pairs lost one side
            pairs = brute.similar(before)
            linked = {i for p in pairs for i in p}
            assert {i for i, _, least in brute.near(before) if i == least} - kept <= linked
            assert sum(a in kept and b in kept for a, b in pairs) <= 0.1 * len(pairs)
        if name == "suffix_array_dedup":
            whole = {i: n - gone for i, n, gone, _, _ in brute.repeats(before)}
            assert all(abs(len((t or "").encode()) - whole[i]) <= 8 for i, t in after)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert packed.count() == corpus_pipeline.run(spark, sf).count()


def test_pipeline_on_odd_rows(spark, docs, empty, tmp_path):
    for k, table in enumerate((docs, empty)):
        table.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "0")).collect()
    assert corpus_pipeline.run(spark, str(tmp_path / "1")).count() == 0
    got = {r["doc_id"] for r in rows}
    text = {r["doc_id"]: r["text"] for r in docs.filter("doc_id is not null").collect()}
    assert not got & {i for i, t in text.items() if not (t or "").split()}  # no words: rejected
    copies = [i for i, t in text.items() if t and t.lower() == text[7].lower()]
    assert len(copies) > 2 and len(got & set(copies)) <= 1  # of equal texts one at most
    assert {10, 11} <= got and 13 in got  # clean documents and the first of two long near copies stay
    assert all(1 <= r["length"] <= 1024 and 0 <= r["offset"] <= 1024 - r["length"] for r in rows)


def test_columns_named_like_helpers_survive(spark, docs, sf):
    clash = docs.selectExpr("*", "1 AS __digest", "2 AS __null", "3 AS __gone", "4 AS draw", "5 AS cell")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns and out.count() > 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stage_tables_are_released(spark, sf, tmp_path):
    import os

    from faultline.llm.common import materialize, release

    df = materialize(spark.range(5), "released")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and release(spark) >= 1 and not os.path.exists(path)


def test_similar_documents_send_no_copies_through_the_driver(spark, docs, monkeypatch):
    import corpus_pipeline
    from faultline.llm import simhash

    plans, made = [], simhash.close_pairs
    monkeypatch.setattr(simhash, "close_pairs", lambda *a: plans.append(made(*a)) or plans[-1])
    dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").count()
    assert len(plans) == 2 and all("Broadcast" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
