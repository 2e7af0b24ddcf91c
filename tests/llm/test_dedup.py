import random

import brute
import numpy as np
import pytest
from conftest import ordered
from hypothesis import given, settings, strategies as st

from faultline.llm import exact_dedup, simhash, suffix_dedup
from faultline.llm.components import components


def test_exact_equals_brute_force(docs, pairs, empty):
    want = ordered(brute.exact(pairs))
    # a tiny capacity doubles the directory many times, few hash bits make texts collide in chains, no broadcast takes the shuffle join
    for capacity, bits, links in ((4096, 62, 20_000), (1, 62, 0), (2, 2, 0), (4, 0, 20_000)):
        got = exact_dedup.exact_duplicates(docs, capacity, bits, links).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert ordered(got) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(8 * k,) for k in range(40)] + [(1,)], "key long")
    directory, depth = exact_dedup.directory_of(keys, 41, 4)
    rows = {r["slot"]: r for r in directory.collect()}
    held = {}
    for k in [8 * k for k in range(40)] + [1]:
        held.setdefault(rows[k & ((1 << depth) - 1)]["bucket"], []).append(k)
    assert max(map(len, held.values())) <= 4 and rows[1]["local_depth"] == 3 < depth
    assert len({r["bucket"] for r in rows.values() if r["local_depth"] == 3}) < sum(r["local_depth"] == 3 for r in rows.values())


def test_verdicts_come_from_the_pages(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    entries = exact_dedup.entries_of(docs)
    index = exact_dedup.index_of(docs, entries)
    assert ordered(index.probe(entries).select("doc_id", "keep_id", "group_size").collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]
    index.pages = index.pages.limit(0)
    assert index.probe(entries).count() == 0


def test_hot_text_is_one_link_before_the_shuffle(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Hot', concat('t', id)) AS text")
    found = exact_dedup.exact_duplicates(docs, 64)
    assert found.filter("group_size = 1000 and keep_id = 2997").count() == 1000


def test_dropping_exact_copies_keeps_columns_and_one_row(docs, pairs, empty):
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert "__digest" in exact_dedup.drop_exact_duplicates(docs.selectExpr("*", "1 AS __digest")).columns
    texts = [(r["text"] or "").translate(brute.UPPER) for r in left.collect()]
    assert sorted(texts) == sorted({(t or "").translate(brute.UPPER) for _, t in pairs})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_near_equals_brute_force(docs, pairs, empty):
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert ordered(got) == ordered(brute.near(pairs))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(str(k * k) for k in range(500))
    want = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash.word_blocks, "__defaults__", (64,))
    assert simhash.fingerprint(text.encode()) == want and want & (2**64 - 1) == brute.fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_anchors_meet_within_the_threshold(a, bits):
    b = a
    for k in bits:
        b ^= 1 << k
    one, two = (np.array([x], dtype=np.uint64).view(np.int64) for x in (a, b))
    assert simhash.anchors(one, 0)[1][0] in simhash.anchors(two, 2)[1]


def test_close_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)} | set(base)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = simhash.close_pairs(spark.createDataFrame([(0, p) for p in signed] + [(1, signed[0])], "table int, print long")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want)


def test_copies_at_anchors_are_not_broadcast(spark):
    nodes = simhash.materialize(spark.range(1000).selectExpr("0 AS table", "xxhash64(id) AS print"), "nodes")
    plan = simhash.close_pairs(nodes)._jdf.queryExecution().executedPlan().toString()  # under the session's usual limit of 10 MB
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_similar_documents(spark, docs, empty):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    texts, near = [], set()
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(300)]
        texts.append(" ".join(words))
        if k % 2:  # a copy with two words changed: an overlap of about 0.93
            for place in (50, 200):
                words[place] = "changed"
            near.add((len(texts) - 1, len(texts)))
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in simhash.similar_documents(df).collect()}
    assert got <= near and len(got) >= 0.9 * len(near)
    assert simhash.drop_near_duplicates(df).count() == len(texts) - len(got)
    assert simhash.similar_documents(empty).count() == 0
    assert all(simhash.shingle_set((t or "").encode(), 5).size == len({tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} - {()}) for t in texts[:5])
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_similar_documents_behind_a_dissimilar_smaller_one(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    lines = [words[k : k + 15] for k in range(0, 300, 15)]
    flat = lambda order: [w for k in order for w in lines[k]]

    def moved(n):  # n lines, none next to another, go to the end
        gone = [1 + 4 * k for k in range(n)]
        return flat([k for k in range(20) if k not in gone] + gone[::-1])

    mixed = rng.sample(words, 300)
    changed = moved(1)
    changed[150] = "changed"
    texts = [mixed, words, moved(1), moved(2), moved(5), mixed[::-1], changed]  # one bag of words but for the last
    sets = [{tuple(t[k : k + 5]) for k in range(296)} for t in texts]
    near = {(a, b) for b in range(7) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert (1, 2) in near and (1, 4) not in near and (3, 4) in near and not any(a in (0, 5) for a, _ in near)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {tuple(r) for r in simhash.similar_documents(df).collect()}
    assert got <= near
    # what is similar is linked, over others if need be
    assert linked({p for p in got if p[1] < 6}, 6) == linked({p for p in near if p[1] < 6}, 6)
    assert simhash.drop_near_duplicates(df.filter("doc_id < 6")).count() == 3


def linked(pairs, n):
    """The smallest that each of n reaches."""
    least = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_second_look_makes_no_more_pairs_than_members(spark):
    """A large group of one bag of words with two kinds of texts: pairs stay in proportion to it."""
    rng = random.Random(6)
    lines = [[f"w{k}x{j}" for j in range(12)] for k in range(20)]
    other = lines[:]
    rng.shuffle(other)
    # words shuffled within lines too, so the two kinds share no shingles but each kind is its own copies with one line moved
    other = [rng.sample(x, len(x)) for x in other]
    kinds = [lines, other]
    texts = [" ".join(w for x in (kinds[k % 2][k % 7 :] + kinds[k % 2][: k % 7]) for w in x) for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.similar_documents(df)
    assert found.count() <= 200 * simhash.TABLES * (2 * simhash.DRAWS + 1)
    assert simhash.drop_near_duplicates(df).count() == 2


def test_components_by_shuffle_and_by_broadcast_agree(spark, monkeypatch):
    from faultline.llm import components as module

    links = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(500 + k, 501 + k) for k in range(30)], "a long, b long")
    want = ordered(components(links).collect())
    monkeypatch.setattr(module, "BROADCAST_LINKS", 0)
    assert ordered(components(links).collect()) == want


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(5, 5), (7, 7)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{1000 + k: 1000 for k in range(1, 40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [2, 100_000])
def test_suffix_equals_brute_force(docs, pairs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_DOCS", hot)
    got = suffix_dedup.repeated_substrings(docs).collect()
    assert ordered(got) == ordered(brute.repeats(pairs))
    assert suffix_dedup.repeated_substrings(empty).count() == 0


def test_rows_with_one_id_and_two_texts(spark):
    shared, other = "abcdefghij" * 8, "".join(map(str, range(60)))
    rows = [(1, shared), (2, shared + other), (2, other + shared), (2, other), (3, other)]
    got = suffix_dedup.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(brute.repeats(rows))


def test_removal_keeps_columns(docs, empty):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [r["text"] for r in out.filter("doc_id = 0").collect()] == [None]
    kept = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert len(kept[14]) < 100 and kept[13].startswith(docs.filter("doc_id = 13").first()["text"][:40])
    assert suffix_dedup.remove_repeats(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=60, max_size=200), st.integers(2, 4))
def test_refinement_classes_are_equal_windows(seed, copies):
    x = np.frombuffer((seed[:80] + b"#") * copies + seed, dtype=np.uint8)
    starts = np.arange(len(x) - 49)
    bucket = suffix_dedup.refine(x, starts)
    windows = [bytes(x[s : s + 50]) for s in starts]
    for a in range(len(starts)):
        same = [b for b in range(len(starts)) if windows[b] == windows[a]]
        assert (bucket[a] == -1) == (len(same) == 1)
        assert bucket[a] == -1 or [b for b in range(len(starts)) if bucket[b] == bucket[a]] == same


def test_anchors_across_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    x, ends = rng.integers(97, 101, 5000).astype(np.uint8), np.array([1000, 1040, 1040, 5000])
    want = suffix_dedup.anchors(x, ends)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    got = suffix_dedup.anchors(x, ends)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    for s in range(0, 951):  # every window holds an anchor
        assert ((want[0] >= s) & (want[0] <= s + 30)).any()
