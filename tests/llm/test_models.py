import collections
import math

import brute
import numpy as np
import pytest
from conftest import ordered
from pyspark.sql import functions as F

from faultline.llm.hashed_linear import fit_logistic
from faultline.llm import language_id, ngram_lm, quality_classifier, quality_rules


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_rules_equal_brute_force(docs, pairs, empty):
    got = quality_rules.quality_rules(docs).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert ordered((r["doc_id"], *[r[c] for c in columns]) for r in got) == ordered((i, *brute.measures(t)) for i, t in pairs)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(empty).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"word{k}" for k in range(30)), "$ # % " * 10
    rows = [(i, bad if host == "worst" and i % 10 else good + f" {i}", host) for h, host in enumerate(["worst", *(f"h{k}" for k in range(9))]) for i in range(1000 * h, 1000 * h + 40)]
    rows += [(99_999, bad, "tiny")]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["host"] for r in got if r["host_rejected"]} == {"worst"}  # one bad document does not condemn a small host
    assert all(r["kept"] for r in got if r["host"].startswith("h")) and not any(r["kept"] for r in got if r["host"] == "worst")


def test_elias_fano_finds_all_and_nothing_else():
    rng = np.random.default_rng(0)
    for n, top in ((1, 3), (9, 10), (1000, 2**63), (5000, 5100), (3, 2**64 - 1), (2000, 2**40)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        coded = ngram_lm.EliasFano.build(values)
        asked = np.unique(np.r_[values, rng.integers(0, top, n, dtype=np.uint64), values + np.uint64(1)])
        place = {int(v): k for k, v in enumerate(values)}
        assert [place.get(int(q), -1) for q in asked] == coded.find(asked).tolist()
    assert ngram_lm.EliasFano.build(np.zeros(0, np.uint64)).find(np.array([1], np.uint64)).tolist() == [-1]


def test_shards_survive_the_file(tmp_path):
    from pyarrow import fs

    values = np.arange(5, 900, 7).astype(np.uint64)
    path = f"file://{tmp_path}/shard"
    ngram_lm.write_shard(path, {}, {"nodes": ngram_lm.EliasFano.build(values)}, {"prob": ngram_lm.quantise(np.full(len(values), -1.5))})
    shard = ngram_lm.Shard(path)
    assert shard.sequence("nodes").find(values).tolist() == list(range(len(values)))
    assert abs(shard.arrays["prob"][3] * ngram_lm.STEP - 1.5) < ngram_lm.STEP
    copied = ngram_lm._private_copy(fs.LocalFileSystem(), f"{tmp_path}/shard")
    assert copied.tobytes() == (tmp_path / "shard").read_bytes()


def brute_scores(rows, order):
    """Base and n-gram scores by definition."""
    train = [brute.tokens(t) for i, t in rows if brute.fold(i, 7) != 2]
    c = collections.Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    once, twice = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    grams = collections.Counter(tuple(x[k : k + size]) for x in train for size in range(2, order + 1) for k in range(len(x) - size + 1))
    grams = {g: m for g, m in grams.items() if m >= 2}
    times = {(w,): m for w, m in c.items()} | grams
    kept = collections.Counter()
    for g, m in grams.items():
        kept[g[:-1]] += m - 0.75

    def chance(context, w):
        if not context:
            return (c[w] - d) / n if c[w] else d * v / n
        below = chance(context[1:], w)
        if context not in kept:
            return below
        return max(grams.get((*context, w), 0) - 0.75, 0) / times[context] + (1 - kept[context] / times[context]) * below

    out = {}
    for i, t in rows:
        x = brute.tokens(t)
        s = sum(math.log10(chance(tuple(x[max(0, k - order + 1) : k]), x[k])) for k in range(len(x)))
        out[i] = (len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), s)
    return out


def test_new_words_are_looked_up_once_a_block(monkeypatch):
    import xxhash

    words = [f"w{k}".encode() for k in range(9)]
    place = {h: k for k, h in enumerate(sorted(xxhash.xxh64_intdigest(w) for w in words))}
    asked = []

    class Words:
        def find_words(self, hashes):
            asked.append(len(hashes))
            return np.array([place.get(int(h), -1) for h in hashes])

    monkeypatch.setattr(ngram_lm, "KNOWN_WORDS", 4)
    trie, known = ngram_lm.Trie([Words()], 1, 9, 0.5), ngram_lm._Known()
    want = lambda block: [place.get(xxhash.xxh64_intdigest(w), -1) for w in block]
    for block in ([*words[:3], b"no", *words[:3], b"no"], words[1:4], words[3:9], [], [words[0], b"no"]):
        assert trie.number(block, known).tolist() == want(block)
    assert asked == [4, 1, 6, 2]  # forgotten once there are more than may be kept


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_brute_force(real, empty, order):
    want = brute_scores([(r["doc_id"], r["text"]) for r in real.collect()], order)
    for r in ngram_lm.score_held_out(real, order).collect():
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, brute.fold(r["doc_id"], 7) == 2)
        assert abs(r["base_score"] - base) <= 1e-9 * abs(base) + 1e-9
        assert abs(r["score"] - score) <= 2 * order * ngram_lm.STEP * n
    assert ngram_lm.score_held_out(empty).count() == 0


def test_rare_words_keep_their_bigrams_in_a_large_corpus(spark):
    rows = [(k, "a " * 1_100_000, None) for k in range(4) if brute.fold(k, 7) != 2]
    ids = [k for k in range(100, 140) if brute.fold(k, 7) != 2]
    rows += [(k, "a " * 1_100_000, None) for k in ids[:4]] + [(ids[4], "zig zag", None), (ids[5], "zig zag", None), (ids[6], "zag zig", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score_held_out(docs, 2).collect()}
    # three tokens each and the same words; only the first order was seen twice
    assert got[ids[4]] > got[ids[6]] + 3


def test_ranges_runs_and_blocks_do_not_change_the_model(real, monkeypatch):
    one = ordered(tuple(r) for r in ngram_lm.score_held_out(real, 3).collect())
    for name, value in (("RUN_NGRAMS", 500), ("RANGE_TOKENS", 30), ("ROW_TOKENS", 700), ("BLOCK_TOKENS", 3000), ("KNOWN_WORDS", 100), ("DENSE_WORDS", 0)):
        monkeypatch.setattr(ngram_lm, name, value)
    two = ordered(tuple(r) for r in ngram_lm.score_held_out(real, 3).collect())
    assert [r[:5] for r in one] == [r[:5] for r in two]
    # sums in another order may move a back-off weight by one step
    assert all(abs(a[-1] - b[-1]) <= ngram_lm.STEP * a[2] and math.isclose(a[-2], b[-2]) for a, b in zip(one, two))


def test_a_frequent_context_is_dealt_to_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "RANGE_TOKENS", 100)
    rows = [(k, " ".join(f"the w{j}" for j in range(k % 5, 120))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_scores(rows, 3)
    trie, _ = ngram_lm.train(docs, ngram_lm.fold_of(F.col("doc_id"), 7) != 2, 2)
    words = trie.words + 1
    the = [s for s, e in zip(trie.levels[1].firsts, trie.levels[1].firsts[1:]) if int(s) % words and int(s) // words == int(e) // words]
    assert len(the) > 3  # whole ranges within one context
    for r in ngram_lm.score_held_out(docs, 3).collect():
        assert abs(r["score"] - want[r["doc_id"]][4]) <= 6 * ngram_lm.STEP * want[r["doc_id"]][0]


def test_higher_orders_score_better(real):
    mean = lambda order: ngram_lm.score_held_out(real, order).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    one, two, three = mean(1), mean(2), mean(3)
    assert one[0] < two[0] < three[0] and two[0] > two[1]


def test_scores_of_odd_rows(docs):
    rows = ngram_lm.score_held_out(docs, 3).collect()
    assert len(rows) == docs.count() and all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    same = {(r["score"], r["n_tokens"]) for r in rows if r["doc_id"] in (0, 1, 2)}
    assert len(same) == 1  # null, empty and blank are one end token


def test_language_on_held_out_rows(real, docs, empty):
    got = language_id.language_id(real).join(real.select("doc_id", "lang"), "doc_id")
    share = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.98
    rows = language_id.language_id(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {0, 1, 2, 18} <= und and 7 not in und
    assert language_id.language_id(empty).count() == 0


def test_nothing_to_learn_is_undetermined(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.language_id(df).collect()} == {"und"}


@pytest.mark.parametrize("classes", [2, 3, 4, 6, 7, 20])
def test_codewords_are_apart(classes):
    code = language_id.codewords(classes)
    least = min((code[i] != code[j]).sum() for i in range(classes) for j in range(i))
    assert least >= max(1, code.shape[1] // 4)


def test_weak_labels_find_the_junk(spark, real, sf, empty):
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.classify_quality(real).join(truth, "doc_id")
    rates = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] >= 0.99 and rates[0] <= 0.1
    assert quality_classifier.classify_quality(empty).count() == 0


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.8
    n = len(quality_classifier.LABELLERS)
    right = np.linspace(0.7, 0.95, n)
    votes = np.where(rng.random((20000, n)) < right, np.where(good, 2, 1)[:, None], np.where(good, 1, 2)[:, None])
    codes, counts = np.unique((votes * 3 ** np.arange(n - 1, -1, -1)).sum(1), return_counts=True)
    model = quality_classifier.LabelModel(codes, counts)
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.chance[0, :, 2] - right).max() < 0.05


def test_classifier_on_odd_rows(docs):
    rows = {r["doc_id"]: r for r in quality_classifier.classify_quality(docs).collect()}
    assert not any(rows[i]["kept"] for i in (0, 1, 2))
    left = quality_classifier.drop_low_quality(docs)
    assert left.columns == docs.columns and left.filter("text is null or trim(text) = ''").count() == 0


def test_decoding_equals_brute_force(real):
    model = language_id.train(real, F.lit(True))
    for r in real.limit(40).collect():
        if not r["text"] or not any(map(str.isalpha, r["text"])):
            continue
        x = language_id.features(r["text"])
        margins = [sum(float(a) * float(b) for a, b in zip(x, model.w[:, k])) + float(model.b[k]) for k in range(model.w.shape[1])]
        losses = {}
        for name, word in zip(model.names, model.code):
            losses[name] = sum(float(w) * math.log1p(math.exp(-bit * m)) for w, bit, m in zip(model.weight, word, margins)) / float(model.weight.sum())
        assert model.predict(r["text"])[0] == min(losses, key=lambda n: (round(losses[n], 6), n))


def test_samples_hold_their_bounds_whatever_repeats(spark, monkeypatch):
    texts = {"en": "the river runs past the old mill and the bridge of stone", "de": "der alte Fluss fliesst an der Muehle und der Bruecke vorbei"}
    rows = [(7, t, lang) for lang, t in texts.items() for _ in range(400)] + [(None, texts["en"] + f" {k}", "en") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "fit_logistic", lambda x, y, *a, **k: seen.append(len(x)) or fit_logistic(x, y, *a, **k))
    model = language_id.train(df, F.lit(True), sample_rows=100)
    assert seen == [100] and model.names == ["de", "en"] and model.predict(texts["de"])[0] == "de"
    bad = "$ # % & * | " * 30
    rows = [(1, bad)] * 300 + [(1, " ".join(texts.values()) + ". ")] * 300 + [(k, f"{texts['en']} {k}. It was so.") for k in range(100)]
    seen.clear()
    monkeypatch.setattr(quality_classifier, "fit_logistic", lambda x, y, w, **k: seen.append((len(x), float(w.sum()))) or fit_logistic(x, y, w, **k))
    scorer = quality_classifier.train(spark.createDataFrame(rows, "doc_id long, text string"), sample_rows=60)
    assert seen[0][0] <= 60 and abs(seen[0][1] - 2) < 1e-9
    assert scorer.score(bad.encode())[0] < 0.5 < scorer.score(texts["en"].encode())[0]


def test_expectation_maximisation_equals_a_plain_one(real):
    """The fit on pattern counts is the one on documents, written out."""
    codes = [quality_classifier.pattern((r["text"] or "").encode()) for r in real.collect()]
    votes = quality_classifier.votes_of(np.array(codes)).tolist()
    unique, counts = np.unique(codes, return_counts=True)
    model = quality_classifier.LabelModel(unique, counts, rounds=4)
    good = [0.1 if 1 in v else 0.95 for v in votes]
    for _ in range(4):
        prior = min(max(sum(good) / len(good), 0.02), 0.98)
        odds = []
        for j in range(len(votes[0])):
            chance = [[(sum(w for w, v in zip(weights, votes) if v[j] == x) + 0.5) / (sum(weights) + 1.5) for x in range(3)] for weights in (good, [1 - g for g in good])]
            o = [math.log(chance[0][x]) - math.log(chance[1][x]) for x in range(3)]
            o[2], o[1] = max(o[2], 0), min(o[1], 0)
            odds.append([min(max(x, -8), 8) for x in o])
        for i, v in enumerate(votes):
            gain = sum(odds[j][x] for j, x in enumerate(v))
            gain = gain if 1 in v else max(gain, 0)
            good[i] = 1 / (1 + math.exp(-min(max(math.log(prior / (1 - prior)) + gain, -40), 40)))
    assert np.allclose(model.posterior(np.array(codes)), good, atol=1e-9)
