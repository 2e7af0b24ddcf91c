import random
import zlib

import pytest
from conftest import TEXTS, ordered  # noqa: F401

from faultline.llm import bpe, packing
from faultline.llm.common import tokenizer_path
from faultline.llm.sentencepiece_codec import BacktrackingEncoder, encode_decode
from faultline.llm.token_counts import token_counts

BPE, PIECE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def noise(seed, alphabet="abcde fgh  \n\t'sre1é日.!▁<|>", n=60):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_counts_and_ids_equal_the_library(library):
    counter, encoder = bpe.PrefixCounter(BPE), bpe.IdEncoder(BPE)
    for text in [*TEXTS, *map(noise, range(300))]:
        ids = library(text)
        assert counter.count(text) == len(ids)
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_every_prefix(library):
    counter = bpe.PrefixCounter(BPE)
    for text in ["it's  we'll \n\n go ", noise(1), noise(2), "a<|endoftext|>b", TEXTS[17][:60]]:
        index = counter.prefix(text)
        counts = [len(library(text[:k])) for k in range(len(text) + 1)]
        assert [index.count_at(k) for k in range(len(text) + 1)] == counts
        for budget in range(max(counts) + 2):
            assert counts[index.truncate(budget)] <= budget


def test_caches_stay_bounded(library):
    counter = bpe.PrefixCounter(BPE, cache_entries=5)
    assert [counter.count(noise(k)) for k in range(50)] == [len(library(noise(k))) for k in range(50)]
    assert len(counter.chunks) <= 5 and len(counter.pretokens) <= 5


def test_token_counts_table(spark, docs, empty, library):
    got = ordered(token_counts(docs, BPE, 100).collect())
    want = ordered((r["doc_id"], len((r["text"] or "").encode()), len(library(r["text"])), len(library(r["text"])) > 100) for r in docs.collect())
    assert got == want and token_counts(empty, BPE).count() == 0
    row = token_counts(docs.filter("doc_id = 7"), BPE, budgets=(10,)).first()
    assert len(library(TEXTS[7][: row["cut_10"]])) <= 10


def test_sentencepiece_equals_the_library(spark, docs, empty):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    enc = BacktrackingEncoder(PIECE, cache_entries=50)
    for text in [*TEXTS, *map(noise, range(300))]:
        assert enc.encode(text) == sp.encode(text or "", add_eos=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = sp.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert ordered(encode_decode(docs, PIECE).collect()) == ordered(want)
    assert encode_decode(empty, PIECE).count() == 0
    row = encode_decode(docs.filter("doc_id = 15"), PIECE, with_ids=True).first()
    assert row["decoded"] == sp.decode(row["ids"])


def check_packing(rows, documents, library, capacity):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in documents:
        ids = b"".join(i.to_bytes(4, "little") for i in [*library(text), 2])
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids) // 4
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, docs, empty, library, capacity):
    own = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    documents = [(r["doc_id"], r["text"]) for r in own.collect()]
    rows = packing.pack_documents(own, BPE, capacity).collect()
    bins = check_packing(rows, documents, library, capacity)
    total = sum(r["length"] for r in rows)
    assert bins <= -(-total // capacity) + 2
    assert packing.pack_documents(empty, BPE, capacity).count() == 0
    assert packing.pack_documents(docs, BPE, capacity).count() > len(rows)  # repeated rows are packed too


def test_packing_in_rounds(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.randint(1, 100)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    out = packing.pack(df, 100, group_items=40).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in out) == sorted(rows)
    fill = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 100 and len(fill) <= 1.05 * sum(r[2] for r in rows) / 100 + 1


def test_local_search_empties_bins():
    bins = packing.Bins([6, 4, 3, 3, 4, 5, 5], 10)
    bins.items, bins.fill = [[0, 2], [1, 5], [3, 4], [6]], [9, 9, 7, 5]
    before = sum(f * f for f in bins.fill)
    assert bins.improve() == 1
    assert sorted(i for b in bins.items for i in b) == list(range(7)) and max(bins.fill) <= 10
    assert sum(f * f for f in bins.fill) > before


def test_ids_stay_what_they_are_beside_null_ones(spark):
    big = 2**53 + 1  # not a floating-point number
    df = spark.createDataFrame([(big, "one two"), (None, "three"), (big + 2, "four")], "doc_id long, text string")
    rows = packing.pack_documents(df, BPE).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == [(False, big), (False, big + 2), (True, None)]


def test_repeated_rows_spread_over_groups(spark):
    df = spark.range(4000).selectExpr("7L AS doc_id", "0 AS piece", "50L AS length", "'x' AS open").repartition(3)
    out = packing.pack(df, 100, group_items=200).collect()
    assert len(out) == 4000 and len({r["sequence_id"] for r in out}) <= 2000 + 20
    assert len({r["sequence_id"] >> 24 for r in out}) > 10  # groups


def fewest_bins(lengths, capacity):
    """The least number of bins, by trying everything."""
    best, lengths = [len(lengths)], sorted(lengths, reverse=True)

    def place(k, fills):
        if len(fills) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(fills)
            return
        for i in range(len(fills)):
            if fills[i] + lengths[k] <= capacity and fills[i] not in fills[:i]:
                place(k + 1, [*fills[:i], fills[i] + lengths[k], *fills[i + 1 :]])
        place(k + 1, [*fills, lengths[k]])

    place(0, [])
    return best[0]


def test_search_against_the_optimum():
    """On small groups the search never needs more than one bin over the optimum, and mends what best fit leaves."""
    rng, over, mended = random.Random(5), 0, 0
    for _ in range(400):
        lengths = [rng.randint(1, 24) + rng.choice((0, 8)) for _ in range(rng.randint(4, 11))]
        bins = packing.Bins(lengths, 40)
        bins.best_fit()
        first = len(bins.items)
        mended += bins.improve()
        packed = [b for b in bins.items if b]
        assert sorted(i for b in packed for i in b) == list(range(len(lengths))) and max(sum(lengths[i] for i in b) for b in packed) <= 40
        assert fewest_bins(lengths, 40) <= len(packed) <= min(first, fewest_bins(lengths, 40) + 1)
        over += len(packed) > fewest_bins(lengths, 40)
    assert over <= 8 and mended >= 1
